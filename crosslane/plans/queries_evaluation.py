"""Registered queries of ranking quality, books, robustness and ensembles."""

from __future__ import annotations

from pyspark.sql import functions as F

from crosslane.operators import diagnostics as dg
from crosslane.operators import ensembles as en
from crosslane.operators import metrics as mt
from crosslane.operators import robustness as rb
from crosslane.operators import turnover as tn
from crosslane.operators.features import add_forward_simple_return
from crosslane.operators.folds import stride_dates
from crosslane.operators.neutralize import neutralized_ic
from crosslane.plans import binding as b
from crosslane.plans.catalog import query, rounded, shortened
from crosslane.plans.oracle import BLOCKS, average_rank, r, rank_share, with_blocks
from crosslane.session import broadcast_dates, cut
from crosslane.sources.membership import filter_to_members, survivors


def _frame(spark, sf):
    return b.evaluation(spark, sf), b.names_bound(spark, sf)


# ---- quality --------------------------------------------------------------------


@query("daily_ic", with_blocks(("ic",), f"SELECT model_id, date, {r('ic')} AS ic, n FROM ic"))
def daily_ic(spark, sf):
    df, rows = _frame(spark, sf)
    return rounded(mt.daily_ic(df, rows=rows))


@query("long_short_returns", with_blocks(("book",), f"SELECT model_id, date, {r('ret')} AS ret FROM book"))
def long_short_returns(spark, sf):
    df, rows = _frame(spark, sf)
    return rounded(mt.long_short(df, rows=rows))


def _ann(h: int) -> str:
    return f"sqrt(252.0 / {h})"


BLOCKS["summary"] = (
    ("valid", "ic", "book"),
    f"""SELECT v.model_id, n_observations, n_dates, information_coefficient, ic_t_stat, hit_rate, mae, rmse, long_short_sharpe
FROM (SELECT model_id, count(*) AS n_observations, count(DISTINCT date) AS n_dates,
    avg(CASE WHEN sign(prediction) = sign(realized) THEN 1.0 ELSE 0.0 END) AS hit_rate,
    avg(abs(prediction - realized)) AS mae, sqrt(avg((prediction - realized) * (prediction - realized))) AS rmse
  FROM valid GROUP BY 1) v
LEFT JOIN (SELECT model_id, CASE WHEN count(*) >= 2 THEN avg(ic) END AS information_coefficient,
    CASE WHEN count(*) >= 2 AND stddev_samp(ic) > 0 THEN avg(ic) * sqrt(count(*)) / stddev_samp(ic) END AS ic_t_stat
  FROM ic GROUP BY 1) i USING (model_id)
LEFT JOIN (SELECT model_id, CASE WHEN count(*) >= 20 AND stddev_samp(ret) > 0 THEN avg(ret) / stddev_samp(ret) * {_ann(5)} END AS long_short_sharpe
  FROM book GROUP BY 1) s USING (model_id)""",
)
_SUMMARY = ("information_coefficient", "ic_t_stat", "hit_rate", "mae", "rmse", "long_short_sharpe")


@query(
    "summarize_models",
    with_blocks(("summary",), "SELECT model_id, n_observations, n_dates, " + ", ".join(f"{r(c)} AS {c}" for c in _SUMMARY) + " FROM summary"),
)
def summarize_models(spark, sf):
    df, rows = _frame(spark, sf)
    return rounded(mt.compare_models(df, horizon=5, rows=rows))


@query(
    "hit_rate",
    with_blocks(("valid",), f"SELECT model_id, {r('avg(CASE WHEN sign(prediction) = sign(realized) THEN 1.0 ELSE 0.0 END)')} AS hit_rate FROM valid GROUP BY 1"),
)
def hit_rate(spark, sf):
    df, _ = _frame(spark, sf)
    hit = (F.signum("prediction") == F.signum("realized")).cast("double")
    return rounded(mt.scored(df).groupBy("model_id").agg(F.avg(hit).alias("hit_rate")))


def _hac_sql(lag: int) -> str:
    lags = ", ".join(f"sum(d * l{k}) AS s{k}" for k in range(1, lag + 1))
    cols = ", ".join(f"lag(d, {k}) OVER (PARTITION BY model_id ORDER BY date) AS l{k}" for k in range(1, lag + 1))
    total = " + ".join([f"2.0 * (1.0 - {k} / {lag + 1}.0) * coalesce(s{k}, 0) / n" for k in range(1, lag + 1)])
    return f"""SELECT model_id, n, m AS mean, CASE WHEN sd > 0 THEN m * sqrt(n) / sd END AS t_naive,
  CASE WHEN n >= 2 AND v > 0 THEN m / sqrt(v / n) END AS t_hac
FROM (SELECT model_id, n, m, sd, g0 / n + {total} AS v FROM (
  SELECT model_id, count(*) AS n, avg(ic) AS m, stddev_samp(ic) AS sd, sum(d * d) AS g0, {lags}
  FROM (SELECT *, {cols} FROM (SELECT model_id, date, ic, ic - avg(ic) OVER (PARTITION BY model_id) AS d FROM src)) GROUP BY 1))"""


@query(
    "hac_t_stat",
    with_blocks(
        ("ic",),
        f"SELECT model_id, n, {r('mean')} AS mean, {r('t_naive', 4)} AS t_naive, {r('t_hac', 4)} AS t_hac FROM h",
        {"src": "SELECT * FROM ic", "h": _hac_sql(21)},
    ),
)
def hac_t_stat(spark, sf):
    df, rows = _frame(spark, sf)
    out = mt.hac_t(mt.daily_ic(df, rows=rows), "ic", 21)
    return rounded(out.withColumns({c: shortened(c, 4) for c in ("t_naive", "t_hac")}))


@query(
    "monthly_ic",
    with_blocks(
        ("ic",),
        f"SELECT model_id, CAST(date_trunc('month', date) AS DATE) AS month, {r('avg(ic)')} AS mean_ic, count(*) AS n_dates FROM ic GROUP BY 1, 2",
    ),
)
def monthly_ic(spark, sf):
    df, rows = _frame(spark, sf)
    return rounded(mt.monthly_ic(mt.daily_ic(df, rows=rows)))


@query(
    "rolling_ic_60d",
    with_blocks(
        ("ic",),
        f"""SELECT model_id, date, {r("avg(ic) OVER (PARTITION BY model_id ORDER BY date RANGE BETWEEN INTERVAL 59 DAYS PRECEDING AND CURRENT ROW)")} AS rolling_ic
FROM ic""",
    ),
)
def rolling_ic_60d(spark, sf):
    df, rows = _frame(spark, sf)
    return rounded(mt.rolling_ic(mt.daily_ic(df, rows=rows), 60).select("model_id", "date", "rolling_ic"))


_HALF = "DATE '1998-06-01'"


@query(
    "time_split",
    with_blocks(
        ("valid", "ic", "book", "evaluation"),
        f"""SELECT e.model_id, e."window", first_date, last_date, n_observations, n_dates, {r('information_coefficient')} AS information_coefficient,
  {r('ic_t_stat')} AS ic_t_stat, {r('hit_rate')} AS hit_rate, {r('mae')} AS mae, {r('rmse')} AS rmse, {r('long_short_sharpe')} AS long_short_sharpe
FROM (SELECT model_id, CASE WHEN date < {_HALF} THEN 'A' ELSE 'B' END AS "window", min(date) AS first_date, max(date) AS last_date
  FROM evaluation GROUP BY 1, 2) e
JOIN (SELECT model_id, CASE WHEN date < {_HALF} THEN 'A' ELSE 'B' END AS "window", count(*) AS n_observations, count(DISTINCT date) AS n_dates,
    avg(CASE WHEN sign(prediction) = sign(realized) THEN 1.0 ELSE 0.0 END) AS hit_rate, avg(abs(prediction - realized)) AS mae,
    sqrt(avg((prediction - realized) * (prediction - realized))) AS rmse FROM valid GROUP BY 1, 2) v USING (model_id, "window")
JOIN (SELECT model_id, CASE WHEN date < {_HALF} THEN 'A' ELSE 'B' END AS "window", avg(ic) AS information_coefficient,
    avg(ic) * sqrt(count(*)) / stddev_samp(ic) AS ic_t_stat FROM ic GROUP BY 1, 2) i USING (model_id, "window")
JOIN (SELECT model_id, CASE WHEN date < {_HALF} THEN 'A' ELSE 'B' END AS "window", avg(ret) / stddev_samp(ret) * {_ann(5)} AS long_short_sharpe
  FROM book GROUP BY 1, 2) s USING (model_id, "window")""",
    ),
)
def time_split(spark, sf):
    df, rows = _frame(spark, sf)
    return rounded(mt.time_split(df, "1998-06-01", rows=rows))


@query(
    "common_dates",
    with_blocks(
        ("predictions",),
        "SELECT date FROM predictions GROUP BY 1 HAVING count(DISTINCT model_id) = (SELECT count(DISTINCT model_id) FROM predictions)",
    ),
)
def common_dates(spark, sf):
    return mt.common_dates(b.predictions(spark, sf))


@query(
    "full_coverage_pairs",
    with_blocks(
        ("predictions",),
        f"""SELECT model_id, date, ticker, {r('prediction')} AS prediction FROM predictions WHERE (date, ticker) IN (
  SELECT (date, ticker) FROM predictions GROUP BY date, ticker HAVING count(DISTINCT model_id) = 4)""",
    ),
)
def full_coverage_pairs(spark, sf):
    return rounded(mt.full_coverage(b.predictions(spark, sf)).select("model_id", "date", "ticker", "prediction"))


@query(
    "common_date_slice",
    with_blocks(
        ("predictions",),
        """SELECT model_id, count(*) AS n FROM predictions WHERE date IN (SELECT date FROM predictions GROUP BY 1
  HAVING count(DISTINCT model_id) = 4) AND date >= DATE '1996-01-01' AND date < DATE '2000-01-01' GROUP BY 1""",
    ),
)
def common_date_slice(spark, sf):
    """Predictions on shared dates inside a since / until window."""
    sliced = mt.on_common_dates(b.predictions(spark, sf)).where(
        (F.col("date") >= "1996-01-01") & (F.col("date") < "2000-01-01")
    )
    return sliced.groupBy("model_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "binding_model",
    with_blocks(("predictions",), "SELECT model_id, max(date) AS last_date FROM predictions GROUP BY 1"),
)
def binding_model(spark, sf):
    return mt.binding_model(b.predictions(spark, sf))


@query(
    "join_realized_left",
    with_blocks(
        ("evaluation",),
        "SELECT model_id, count(*) AS n, count(realized) AS n_realized FROM evaluation GROUP BY 1",
    ),
)
def join_realized_left(spark, sf):
    joined = mt.join_realized(b.predictions(spark, sf), b.matrix(spark, sf), "y")
    return joined.groupBy("model_id").agg(F.count(F.lit(1)).alias("n"), F.count("realized").alias("n_realized"))


@query(
    "join_realized_inner",
    with_blocks(
        ("predictions", "matrix"),
        f"""SELECT model_id, date, ticker, {r('prediction')} AS prediction, {r('y')} AS realized
FROM predictions JOIN matrix USING (date, ticker) WHERE y IS NOT NULL""",
    ),
)
def join_realized_inner(spark, sf):
    known = b.matrix(spark, sf).where(F.col("y").isNotNull())
    out = mt.join_realized(b.predictions(spark, sf), known, "y", "inner")
    return rounded(out.select("model_id", "date", "ticker", "prediction", "realized"))


@query(
    "stride_dates",
    with_blocks(
        ("bars",),
        f"""SELECT date, ticker, {r('close')} AS close FROM bars WHERE date IN (
  SELECT date FROM (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i FROM (SELECT DISTINCT date FROM bars)) WHERE i % 21 = 0)""",
    ),
)
def stride_dates_q(spark, sf):
    return rounded(stride_dates(b.bars(spark, sf), 21).select("date", "ticker", "close"))


# ---- books ----------------------------------------------------------------------

BLOCKS["weights"] = (("legs",), "SELECT model_id, date, ticker, side * 1.0 / k AS weight FROM legs")


def _turnover_block(src: str, lag: int) -> str:
    return f"""SELECT model_id, date, sum(abs(coalesce(w, 0) - coalesce(pw, 0))) / 2 AS turnover FROM (
  SELECT model_id, i, t, max(w) AS w, max(pw) AS pw FROM (
    SELECT x.model_id, d.i, x.ticker AS t, x.weight AS w, NULL AS pw FROM {src} x JOIN di d ON d.model_id = x.model_id AND d.date = x.date
    UNION ALL
    SELECT x.model_id, d.i + {lag}, x.ticker, NULL, x.weight FROM {src} x JOIN di d ON d.model_id = x.model_id AND d.date = x.date)
  GROUP BY 1, 2, 3) JOIN di USING (model_id, i) GROUP BY 1, 2"""


def _index_block(src: str) -> str:
    return f"SELECT model_id, date, row_number() OVER (PARTITION BY model_id ORDER BY date) AS i FROM (SELECT DISTINCT model_id, date FROM {src})"


@query("weight_book", with_blocks(("weights",), f"SELECT model_id, date, ticker, {r('weight')} AS weight FROM weights"))
def weight_book(spark, sf):
    df, rows = _frame(spark, sf)
    return rounded(tn.weights(mt.legs(df, rows=rows)))


@query(
    "turnover_lag5",
    with_blocks(
        ("weights",),
        f"SELECT model_id, date, {r('turnover')} AS turnover FROM t",
        {"di": _index_block("weights"), "t": _turnover_block("weights", 5)},
    ),
)
def turnover_lag5(spark, sf):
    df, rows = _frame(spark, sf)
    return rounded(tn.turnover(mt.legs(df, rows=rows), 5))


def _net(bp: int) -> str:
    return f"(ret - turnover * {2.0 * bp / 10000.0})"


_COSTS = (3, 10, 20)


@query(
    "cost_adjusted_summary",
    with_blocks(
        ("weights", "summary", "book"),
        f"""SELECT s.model_id, s.n_observations, b.n_dates, {r('information_coefficient')} AS gross_ic, {r('ic_t_stat')} AS gross_ic_t_stat,
  {r('g')} AS gross_long_short_sharpe, {r('dt')} AS daily_turnover_mean, {r('yt')} AS annual_turnover,
  {', '.join(f'{r(f"n{c}")} AS after_cost_sharpe_{c}bp' for c in _COSTS)}
FROM summary s LEFT JOIN (SELECT model_id, count(*) AS n_dates, avg(ret) / stddev_samp(ret) * {_ann(5)} AS g,
  avg(turnover) / 5 AS dt, avg(turnover) * 252.0 / 5 AS yt,
  {', '.join(f'avg({_net(c)}) / stddev_samp({_net(c)}) * {_ann(5)} AS n{c}' for c in _COSTS)}
  FROM t JOIN book USING (model_id, date) GROUP BY 1) b USING (model_id)""",
        {"di": _index_block("weights"), "t": _turnover_block("weights", 5)},
    ),
)
def cost_adjusted_summary(spark, sf):
    df, rows = _frame(spark, sf)
    return rounded(tn.compare_costs(df, horizon=5, rows=rows))


BLOCKS["rebal"] = (
    ("legs",),
    """SELECT * FROM legs JOIN (SELECT model_id, date, row_number() OVER (PARTITION BY model_id ORDER BY date) - 1 AS j
  FROM (SELECT DISTINCT model_id, date FROM valid)) USING (model_id, date) WHERE j % 21 = 0""",
)
_REBAL = {
    "rw": "SELECT model_id, date, ticker, side * 1.0 / k AS weight FROM rebal",
    "di": _index_block("rw"),
    "t": _turnover_block("rw", 1),
    "rbk": "SELECT model_id, date, avg(realized) FILTER (WHERE side = 1) - avg(realized) FILTER (WHERE side = -1) AS ret FROM rebal GROUP BY 1, 2",
    "bt": "SELECT * FROM rbk JOIN t USING (model_id, date)",
}


@query(
    "rebalanced_book_stats",
    with_blocks(
        ("rebal", "ic_all"),
        f"""SELECT h.model_id, n AS n_dates, {r('mean')} AS ic, {r('t_naive', 4)} AS t_naive, {r('t_hac', 4)} AS t_hac, n_rebalances,
  {r('g', 4)} AS gross_sharpe, {r('a')} AS annual_turnover, {', '.join(f'{r(f"n{c}", 4)} AS net_sharpe_{c}bp' for c in _COSTS)}
FROM h JOIN (SELECT model_id, count(*) AS n_rebalances, avg(ret) / stddev_samp(ret) * {_ann(21)} AS g, avg(turnover) * 12.0 AS a,
  {', '.join(f'avg({_net(c)}) / stddev_samp({_net(c)}) * {_ann(21)} AS n{c}' for c in _COSTS)} FROM bt GROUP BY 1) s USING (model_id)""",
        {**_REBAL, "src": "SELECT * FROM ic_all WHERE n >= 10 AND ic IS NOT NULL AND isfinite(ic)", "h": _hac_sql(21)},
    ),
)
def rebalanced_book_stats(spark, sf):
    df, rows = _frame(spark, sf)
    out = tn.rebalanced_stats(df, 21, rows=rows)
    short = ["t_naive", "t_hac", "gross_sharpe", *[f"net_sharpe_{c}bp" for c in _COSTS]]
    return rounded(out.withColumns({c: shortened(c, 4) for c in short}))


@query(
    "cadence_stats",
    with_blocks(
        ("rebal", "ic_all"),
        f"""SELECT s.model_id, n_rebalances, {r('g', 4)} AS gross_sharpe, {r('a')} AS annual_turnover,
  {', '.join(f'{r(f"n{c}", 4)} AS net_sharpe_{c}bp' for c in _COSTS)}, {r('i.ic')} AS ic
FROM (SELECT model_id, count(*) AS n_rebalances, avg(ret) / stddev_samp(ret) * {_ann(21)} AS g, avg(turnover) * 12.0 AS a,
  {', '.join(f'avg({_net(c)}) / stddev_samp({_net(c)}) * {_ann(21)} AS n{c}' for c in _COSTS)} FROM bt GROUP BY 1) s
JOIN (SELECT model_id, avg(ic) AS ic FROM ic_all JOIN di USING (model_id, date) WHERE n >= 10 AND ic IS NOT NULL AND isfinite(ic) GROUP BY 1) i USING (model_id)""",
        _REBAL,
    ),
)
def cadence_stats(spark, sf):
    df, rows = _frame(spark, sf)
    out = tn.cadence_stats(df, 21, rows=rows)
    return rounded(out.withColumns({c: shortened(c, 4) for c in ["gross_sharpe", *[f"net_sharpe_{c}bp" for c in _COSTS]]}))


@query(
    "dollar_pnl",
    with_blocks(
        ("rebal",),
        f"""SELECT model_id, line, count(*) AS n_rebalances, {r('avg(x)')} AS mean_return, {r('sum(x)')} AS sum_return,
  {r('sum(x) * 500')} AS half_leg_sum, {r('(exp(sum(ln(1 + x / 2))) - 1) * 1000')} AS half_leg_compounded, {r('sum(x) * 1000')} AS full_leg_sum
FROM (SELECT model_id, 'gross' AS line, ret * 0.05 AS x FROM bt UNION ALL SELECT model_id, 'net', ret * 0.05 - turnover * 0.002 FROM bt) GROUP BY 1, 2""",
        _REBAL,
    ),
)
def dollar_pnl(spark, sf):
    """Returns are scaled down: the test prices move far more than one percent a day."""
    df, rows = _frame(spark, sf)
    valid = tn.on_rebalance_dates(mt.scored(df), 21)
    books = tn.books_with_turnover(valid, lag=1, rows=rows)
    return rounded(tn.dollar_pnl(books.withColumn("ret", F.col("ret") * 0.05), 10))


_LONG_ONLY = {
            "fw": "SELECT date, ticker, lead(adj_close, 21) OVER (PARTITION BY ticker ORDER BY date) / adj_close - 1 AS raw FROM bars",
            "v": "SELECT p.*, raw FROM predictions p JOIN fw USING (date, ticker) WHERE raw IS NOT NULL",
            "rd": """SELECT v.* FROM v JOIN (SELECT model_id, date, row_number() OVER (PARTITION BY model_id ORDER BY date) - 1 AS i
  FROM (SELECT DISTINCT model_id, date FROM v)) USING (model_id, date) WHERE i % 21 = 0""",
            "pl": """SELECT *, row_number() OVER (PARTITION BY model_id, date ORDER BY prediction, ticker) AS pos,
  count(*) OVER (PARTITION BY model_id, date) AS n FROM rd""",
            "tp": """SELECT *, greatest(1, CAST(round_even(n * 0.2, 0) AS INT)) AS k, pos > n - greatest(1, CAST(round_even(n * 0.2, 0) AS INT)) AS top,
  dense_rank() OVER (PARTITION BY model_id ORDER BY date) AS j FROM pl WHERE n >= 10""",
    "lo": """SELECT model_id, date, avg(raw) FILTER (WHERE top) AS book, avg(raw) AS bench,
  sum(CASE WHEN top AND pj IS NULL THEN 1 ELSE 0 END) * 1.0 / max(k) AS turnover
  FROM (SELECT p.*, q.j AS pj FROM tp p LEFT JOIN (SELECT model_id, j + 1 AS j, ticker FROM tp WHERE top) q
    ON p.model_id = q.model_id AND p.j = q.j AND p.ticker = q.ticker) GROUP BY 1, 2""",
}


@query(
    "long_only_book",
    with_blocks(
        ("predictions", "bars"),
        f"SELECT model_id, date, {r('book')} AS book, {r('bench')} AS bench, {r('turnover')} AS turnover FROM lo",
        _LONG_ONLY,
    ),
)
def long_only_book(spark, sf):
    return rounded(_long_only(spark, sf))


def _long_only(spark, sf):
    forward = add_forward_simple_return(b.bars(spark, sf), 21, out="realized").select("date", "ticker", "realized")
    frame = b.predictions(spark, sf).join(forward, ["date", "ticker"])
    return tn.long_only_books(frame, 21, rows=b.names_bound(spark, sf))


def _cum(x: str) -> str:
    return f"(exp(sum(ln(1 + {x}))) - 1)"


@query(
    "long_only_summary",
    with_blocks(
        ("predictions", "bars"),
        f"""SELECT model_id, count(*) AS n_rebalances, {r('avg(turnover) * 12.0')} AS annual_turnover, {r('avg(b)')} AS mean_book, {r('avg(e)')} AS mean_bench,
  {r('avg(b - e)')} AS mean_alpha, {r(_cum('b') + ' * 1000', 4)} AS book_pnl, {r(_cum('e') + ' * 1000', 4)} AS bench_pnl,
  {r(f"({_cum('b')} - {_cum('e')}) * 1000", 4)} AS alpha_pnl, {r(f"{_cum('e')} / {_cum('b')}")} AS bench_share,
  {', '.join(r(_cum(f'b - turnover * {2 * c / 10000}') + ' * 1000', 4) + f' AS net_pnl_{c}bp' for c in (3, 10))}
FROM (SELECT *, book * 0.005 AS b, bench * 0.005 AS e FROM lo) GROUP BY 1""",
        _LONG_ONLY,
    ),
)
def long_only_summary(spark, sf):
    """Returns are scaled down, as for the dollar profit."""
    books = _long_only(spark, sf).withColumns({c: F.col(c) * 0.005 for c in ("book", "bench")})
    out = tn.long_only_summary(books)
    money = [c for c in out.columns if "pnl" in c]
    return rounded(out.withColumns({c: shortened(c, 4) for c in money}))


@query(
    "deflated_sharpe",
    with_blocks(
        ("book",),
        f"""SELECT model_id, n_periods, {r('sr', 5)} AS sharpe_obs, {r('g1', 5)} AS skew, {r('g2', 5)} AS kurt, {r('em')} AS expected_max_sharpe,
  {r('ts', 4)} AS test_statistic, {r('CASE WHEN ts > 6 THEN 1.0 WHEN ts < -6 THEN 0.0 ELSE 0.5 + exp(-ts * ts / 2) / sqrt(2 * pi()) * se END', 4)} AS prob_positive
FROM (SELECT *, ts * list_sum(list_transform(range(0, 150), lambda k: CASE WHEN k = 0 THEN 1.0 WHEN ts = 0 THEN 0.0
    ELSE exp(2 * k * ln(abs(ts)) - (lgamma(2 * k + 2) - k * ln(2.0) - lgamma(k + 1))) END)) AS se
FROM (SELECT *, (sr - em) * sqrt(n_periods - 1) / sqrt(greatest(1 - g1 * sr + (g2 - 1) / 4 * sr * sr, 1e-12)) AS ts
FROM (SELECT *, sqrt(2 * ln(4.0) / n_periods) AS em FROM (
  SELECT model_id, count(*) AS n_periods, avg(ret) / stddev_samp(ret) * {_ann(5)} AS sr, max(m3) / pow(max(m2), 1.5) AS g1, max(m4) / (max(m2) * max(m2)) AS g2
  FROM (SELECT model_id, ret, avg(d * d) OVER w AS m2, avg(d * d * d) OVER w AS m3, avg(d * d * d * d) OVER w AS m4
    FROM (SELECT model_id, ret, ret - avg(ret) OVER (PARTITION BY model_id) AS d FROM book) WINDOW w AS (PARTITION BY model_id)) GROUP BY 1))))""",
    ),
)
def deflated_sharpe(spark, sf):
    df, rows = _frame(spark, sf)
    out = mt.deflated_sharpe(mt.long_short(df, rows=rows), 4, 5)
    digits = {"sharpe_obs": 5, "skew": 5, "kurt": 5, "test_statistic": 4, "prob_positive": 4}
    return rounded(out.withColumns({c: shortened(c, d) for c, d in digits.items()}))


# ---- robustness -------------------------------------------------------------------


@query(
    "bucket_returns",
    with_blocks(
        ("placed",),
        f"""SELECT model_id, bucket, {r('avg(m)')} AS mean_realized, {r('stddev_samp(m)')} AS std_realized, count(*) AS n_dates
FROM (SELECT model_id, date, ((pos - 1) * 10) // n + 1 AS bucket, avg(realized) AS m FROM placed WHERE n >= 10 GROUP BY 1, 2, 3) GROUP BY 1, 2""",
    ),
)
def bucket_returns(spark, sf):
    df, rows = _frame(spark, sf)
    return rounded(rb.bucket_returns(df, 10, rows=rows))


@query(
    "bucket_monotonicity",
    with_blocks(
        ("placed",),
        """SELECT a.model_id, count(*) FILTER (WHERE z.m > a.m) AS steps_up, count(*) AS steps FROM bk a
JOIN bk z ON z.model_id = a.model_id AND z.bucket = a.bucket + 1 GROUP BY 1""",
        {
            "bk": """SELECT model_id, bucket, avg(m) AS m FROM (SELECT model_id, date, ((pos - 1) * 10) // n + 1 AS bucket, avg(realized) AS m
  FROM placed WHERE n >= 10 GROUP BY 1, 2, 3) GROUP BY 1, 2"""
        },
    ),
)
def bucket_monotonicity(spark, sf):
    df, rows = _frame(spark, sf)
    return rb.is_monotonic(rb.bucket_returns(df, 10, rows=rows))


_BOOT = 1000
_PLACED_IC = """SELECT model_id, ic, row_number() OVER (PARTITION BY model_id ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY model_id) AS n FROM ic"""


BLOCKS["bands"] = (
    ("ic",),
    f"""SELECT * FROM (SELECT model_id, avg(ic) AS pe, count(*) AS n_ic_dates FROM ic GROUP BY 1)
JOIN (SELECT model_id, quantile_cont(m, 0.05) AS p05, quantile_cont(m, 0.5) AS p50, quantile_cont(m, 0.95) AS p95, count(*) AS n_bootstrap
  FROM (SELECT d.model_id, d.replicate, avg(s.ic) AS m FROM
    (SELECT x.model_id, g.replicate, ('0x' || substr(md5('42|' || g.replicate || '|' || x.i), 1, 8))::BIGINT % x.n AS pick
     FROM ({_PLACED_IC}) x, (SELECT unnest(range(0, {_BOOT})) AS replicate) g) d
    JOIN ({_PLACED_IC}) s ON s.model_id = d.model_id AND s.i = d.pick GROUP BY 1, 2) GROUP BY 1) USING (model_id)""",
)
_BANDS = f"{r('pe')} AS point_estimate, {r('p05')} AS p05, {r('p50')} AS p50, {r('p95')} AS p95, n_bootstrap, p05 > 0 OR p95 < 0 AS excludes_zero"


@query("bootstrap_ic", with_blocks(("bands",), f"SELECT model_id, n_ic_dates AS n_dates, {_BANDS} FROM bands"))
def bootstrap_ic(spark, sf):
    df, rows = _frame(spark, sf)
    return rounded(rb.bootstrap_ic(df, _BOOT, rows=rows))


_SHUFFLES = 1000


def _shuffle_rounds(place: str) -> str:
    """The rounds of a permutation as columns that build on each other."""
    out = [f"{place} // nb AS l0", f"{place} % nb AS r0"]
    for k in range(8):
        side, other, length = ("l", "r", "na") if k % 2 == 0 else ("r", "l", "nb")
        last, seen = k // 2, (k + 1) // 2
        out.append(f"(k{2 * k} * {other}{seen} + k{2 * k + 1}) % 2147483647 AS v{k}")
        out.append(f"({side}{last} + v{k} * v{k} % 2147483647 % {length}) % {length} AS {side}{last + 1}")
    return ", ".join([*out, "l4 * nb + r4 AS q"])


_WORDS = ", ".join(
    f"('0x' || substr(h{part}, {1 + 8 * w}, 8))::BIGINT % 2147483647 AS k{4 * part + w}" for part in range(4) for w in range(4)
)
_KEYS = ", ".join(f"k{w}" for w in range(16))
_DIGESTS = ", ".join(f"md5('42|' || it || '|' || CAST(date AS VARCHAR) || '|{part}') AS h{part}" for part in range(4))


@query(
    "shuffle_null",
    with_blocks(
        ("ranked", "ic"),
        f"""SELECT model_id, {r('o')} AS observed_ic, {r('avg(m)')} AS null_mean, {r('stddev_pop(m)')} AS null_std,
  {r('avg(CASE WHEN m >= o THEN 1.0 ELSE 0.0 END)')} AS p_value, count(*) AS n_iterations, {r('(o - avg(m)) / stddev_pop(m)', 4)} AS z_score
FROM (SELECT model_id, it, avg(CASE WHEN s = 0 THEN 0.0 ELSE (list_dot_product(places, a) / n - f) / s END) AS m
  FROM base JOIN drawn USING (date, n) GROUP BY 1, 2)
JOIN (SELECT model_id, avg(ic) AS o FROM ic GROUP BY 1) USING (model_id) GROUP BY model_id, o""",
        {
            "base": """SELECT model_id, date, count(*) AS n, CAST(list(rp ORDER BY realized, ticker) AS DOUBLE[]) AS a,
    avg(rp) * (count(*) - 1) / 2 AS f, CASE WHEN min(realized) < max(realized) THEN stddev_pop(rp) * sqrt((count(*) * count(*) - 1) / 12.0) ELSE 0 END AS s
  FROM ranked GROUP BY 1, 2 HAVING count(*) >= 5""",
            "parts": f"""SELECT date, it, {_WORDS} FROM (SELECT date, it, {_DIGESTS}
    FROM (SELECT DISTINCT date FROM base), (SELECT unnest(range(0, {_SHUFFLES})) AS it))""",
            "grids": """SELECT date, n, na, CAST(ceil(n / na) AS BIGINT) AS nb FROM (
    SELECT DISTINCT date, n, CAST(ceil(sqrt(n)) AS BIGINT) AS na FROM base)""",
            "walk": f"""SELECT date, n, it, x, q, na, nb, {_KEYS} FROM (SELECT *, {_shuffle_rounds('x')} FROM (
      SELECT *, unnest(range(0, n)) AS x FROM grids JOIN parts USING (date)))
    UNION ALL SELECT date, n, it, x, q, na, nb, {_KEYS} FROM (SELECT * EXCLUDE (q), {_shuffle_rounds('z')} FROM (
      SELECT *, q AS z FROM walk WHERE q >= n))""",
            "drawn": "SELECT date, n, it, CAST(list(q ORDER BY x) AS DOUBLE[]) AS places FROM walk WHERE q < n GROUP BY 1, 2, 3",
        },
        recursive=True,
    ),
)
def shuffle_null(spark, sf):
    df, rows = _frame(spark, sf)
    out = rb.shuffle_null(df, _SHUFFLES, 42, rows=rows)
    return rounded(out.withColumn("z_score", shortened("z_score", 4)))


@query(
    "neutralized_ic",
    with_blocks(
        ("evaluation", "matrix", "ic"),
        f"""SELECT model_id, {r('g')} AS ic_gross, {r('avg(c)')} AS ic_neutralized, count(*) AS n_dates, {r('g - avg(c)')} AS delta
FROM cc JOIN (SELECT model_id, avg(ic) AS g FROM ic GROUP BY 1) USING (model_id) WHERE n >= 5 AND c IS NOT NULL AND isfinite(c) GROUP BY model_id, g""",
        {
            "f": "SELECT e.*, m.adj_close AS x FROM evaluation e JOIN matrix m USING (date, ticker)",
            "rs": """SELECT model_id, date, round(prediction - CASE WHEN n1 > 2 AND vx1 > 0 THEN my1 + cxy1 / vx1 * (x - mx1) ELSE 0 END, 10) AS p,
  round(realized - CASE WHEN n2 > 2 AND vx2 > 0 THEN my2 + cxy2 / vx2 * (x - mx2) ELSE 0 END, 10) AS z FROM (
  SELECT *, count(prediction) OVER w AS n1, avg(x) OVER w AS mx1, avg(prediction) OVER w AS my1, covar_pop(x, prediction) OVER w AS cxy1, var_pop(x) OVER w AS vx1,
    count(realized) OVER w AS n2, avg(CASE WHEN realized IS NOT NULL THEN x END) OVER w AS mx2, avg(realized) OVER w AS my2,
    covar_pop(x, realized) OVER w AS cxy2, var_pop(CASE WHEN realized IS NOT NULL THEN x END) OVER w AS vx2
  FROM f WINDOW w AS (PARTITION BY model_id, date)) WHERE prediction IS NOT NULL AND realized IS NOT NULL""",
            "rk": f"SELECT model_id, date, {average_rank('p', 'model_id, date')} AS a, {average_rank('z', 'model_id, date')} AS d FROM rs",
            "cc": "SELECT model_id, date, corr(a, d) AS c, count(*) AS n FROM rk GROUP BY 1, 2",
        },
    ),
)
def neutralized(spark, sf):
    df, rows = _frame(spark, sf)
    side = b.matrix(spark, sf).select("date", "ticker", F.col("adj_close").alias("x"))
    return rounded(neutralized_ic(df.join(side, ["date", "ticker"]), ["x"], rows=rows))


@query(
    "neutralized_ic_multi",
    with_blocks(
        ("evaluation", "bars", "ic"),
        f"""SELECT model_id, {r('g')} AS ic_gross, {r('avg(c)')} AS ic_neutralized, count(*) AS n_dates, {r('g - avg(c)')} AS delta
FROM cc JOIN (SELECT model_id, avg(ic) AS g FROM ic GROUP BY 1) USING (model_id) WHERE n >= 5 AND c IS NOT NULL AND isfinite(c) GROUP BY model_id, g""",
        {
            "f": """SELECT model_id, e.date, prediction AS p, realized AS y, CAST(volume AS DOUBLE) AS x, adj_close AS z FROM evaluation e JOIN bars m USING (date, ticker)
  WHERE prediction IS NOT NULL""",
            "s": """SELECT *, count(*) OVER w AS n1, count(y) OVER w AS n2,
    covar_pop(x, x) OVER w AS a, covar_pop(x, z) OVER w AS b, covar_pop(z, z) OVER w AS d, covar_pop(x, p) OVER w AS e, covar_pop(z, p) OVER w AS g,
    avg(p) OVER w AS mp, avg(x) OVER w AS mx, avg(z) OVER w AS mz,
    covar_pop(xx, xx) OVER w AS a2, covar_pop(xx, zz) OVER w AS b2, covar_pop(zz, zz) OVER w AS d2, covar_pop(xx, y) OVER w AS e2, covar_pop(zz, y) OVER w AS g2,
    avg(y) OVER w AS my, avg(xx) OVER w AS mx2, avg(zz) OVER w AS mz2
  FROM (SELECT *, CASE WHEN y IS NOT NULL THEN x END AS xx, CASE WHEN y IS NOT NULL THEN z END AS zz FROM f) WINDOW w AS (PARTITION BY model_id, date)""",
            "rs": """SELECT model_id, date, round(p - CASE WHEN n1 > 3 THEN mp + CASE WHEN a < 1e-12 THEN g / d * (z - mz) ELSE (e * d - g * b) / (a * d - b * b) * (x - mx) + (g * a - e * b) / (a * d - b * b) * (z - mz) END ELSE 0 END, 9) AS u,
  round(y - CASE WHEN n2 > 3 THEN my + CASE WHEN a2 < 1e-12 THEN g2 / d2 * (z - mz2) ELSE (e2 * d2 - g2 * b2) / (a2 * d2 - b2 * b2) * (x - mx2) + (g2 * a2 - e2 * b2) / (a2 * d2 - b2 * b2) * (z - mz2) END ELSE 0 END, 9) AS v
  FROM s WHERE y IS NOT NULL""",
            "rk": f"SELECT model_id, date, {average_rank('u', 'model_id, date')} AS ru, {average_rank('v', 'model_id, date')} AS rv FROM rs",
            "cc": "SELECT model_id, date, corr(ru, rv) AS c, count(*) AS n FROM rk GROUP BY 1, 2",
        },
    ),
)
def neutralized_multi(spark, sf):
    df, rows = _frame(spark, sf)
    side = b.bars(spark, sf).select("date", "ticker", F.col("volume").cast("double").alias("x"), F.col("adj_close").alias("z"))
    return rounded(neutralized_ic(df.join(side, ["date", "ticker"]), ["x", "z"], rows=rows))


@query(
    "robustness_panel",
    with_blocks(
        ("summary", "bands", "placed"),
        f"""SELECT model_id, n_observations, {', '.join(f'{r(c)} AS {c}' for c in _SUMMARY)}, {_BANDS}, {r('top')} AS top_bucket, {r('bottom')} AS bottom_bucket,
  {r('ic_a')} AS ic_before, {r('ic_b')} AS ic_after
FROM summary JOIN bands USING (model_id)
JOIN (SELECT model_id, arg_max(m, bucket) AS top, arg_min(m, bucket) AS bottom FROM bk GROUP BY 1) USING (model_id)
JOIN (SELECT model_id, avg(ic) FILTER (WHERE date < {_HALF}) AS ic_a, avg(ic) FILTER (WHERE date >= {_HALF}) AS ic_b FROM ic GROUP BY 1) USING (model_id)""",
        {
            "bk": """SELECT model_id, bucket, avg(m) AS m FROM (SELECT model_id, date, ((pos - 1) * 10) // n + 1 AS bucket, avg(realized) AS m
  FROM placed WHERE n >= 10 GROUP BY 1, 2, 3) GROUP BY 1, 2"""
        },
    ),
)
def robustness_panel(spark, sf):
    """Bootstrap band, bucket returns and time split of every model side by side."""
    df, rows = _frame(spark, sf)
    parts = rb.robustness_panel(df, time_cutoff="1998-06-01", rows=rows)
    spread = parts["buckets"].groupBy("model_id").agg(
        F.max_by("mean_realized", "bucket").alias("top_bucket"), F.min_by("mean_realized", "bucket").alias("bottom_bucket")
    )
    halves = parts["time_split"].groupBy("model_id").agg(
        F.max(F.when(F.col("window") == "A", F.col("information_coefficient"))).alias("ic_before"),
        F.max(F.when(F.col("window") == "B", F.col("information_coefficient"))).alias("ic_after"),
    )
    return rounded(parts["headline"].join(parts["bootstrap"], "model_id").join(spread, "model_id").join(halves, "model_id").drop("n_dates"))


# ---- reports ------------------------------------------------------------------------

BLOCKS["latest"] = (
    ("predictions",),
    "SELECT p.* FROM predictions p JOIN (SELECT model_id, max(date) AS date FROM predictions GROUP BY 1) USING (model_id, date)",
)


@query(
    "consensus_board",
    with_blocks(
        ("latest",),
        "SELECT ticker, "
        + ", ".join(f"{r(f"max(prediction) FILTER (WHERE model_id = '{m}')")} AS {m}" for m in b.MODELS)
        + f", {r('avg(prediction)')} AS consensus, {r('stddev_samp(prediction)')} AS disagreement FROM latest GROUP BY 1",
    ),
)
def consensus_board(spark, sf):
    return rounded(dg.consensus(b.predictions(spark, sf), b.MODELS))


@query(
    "top_bottom_consensus",
    with_blocks(
        ("latest",),
        """SELECT ticker, 'top' AS list FROM (SELECT ticker FROM c ORDER BY consensus DESC NULLS LAST, ticker LIMIT 5)
UNION ALL SELECT ticker, 'bottom' FROM (SELECT ticker FROM c ORDER BY consensus ASC NULLS LAST, ticker LIMIT 5)
UNION ALL SELECT ticker, 'disagree' FROM (SELECT ticker FROM c ORDER BY disagreement DESC NULLS LAST, ticker LIMIT 5)""",
        {"c": "SELECT ticker, avg(prediction) AS consensus, stddev_samp(prediction) AS disagreement FROM latest GROUP BY 1"},
    ),
)
def top_bottom_consensus(spark, sf):
    return dg.top_and_bottom(dg.consensus(b.predictions(spark, sf), b.MODELS), 5).select("ticker", "list")


@query(
    "ticker_history",
    with_blocks(
        ("predictions",),
        f"SELECT date, model_id, {r('prediction')} AS prediction FROM predictions WHERE ticker = 'Brand#12'",
    ),
)
def ticker_history(spark, sf):
    return rounded(dg.ticker_history(b.predictions(spark, sf), "Brand#12"))


@query(
    "ticker_last_30",
    with_blocks(
        ("predictions",),
        f"SELECT date, model_id, {r('prediction')} AS prediction FROM predictions WHERE ticker = 'Brand#3' ORDER BY date DESC, model_id LIMIT 30",
    ),
)
def ticker_last_30(spark, sf):
    return rounded(dg.ticker_history(b.predictions(spark, sf), "Brand#3", 30))


@query(
    "pivot_by_model",
    with_blocks(
        ("predictions",),
        "SELECT date, ticker, " + ", ".join(f"{r(f"max(prediction) FILTER (WHERE model_id = '{m}')")} AS {m}" for m in b.MODELS) + " FROM predictions GROUP BY 1, 2",
    ),
)
def pivot_by_model(spark, sf):
    wide = b.predictions(spark, sf).groupBy("date", "ticker").pivot("model_id", list(b.MODELS)).agg(F.first("prediction"))
    return rounded(wide)


@query(
    "prediction_dispersion",
    with_blocks(
        ("evaluation",),
        f"""SELECT model_id, {r('stddev_samp(prediction)')} AS prediction_std, {r('stddev_samp(realized)')} AS target_std,
  {r('stddev_samp(prediction) / stddev_samp(realized)')} AS dispersion_ratio FROM evaluation GROUP BY 1""",
    ),
)
def prediction_dispersion(spark, sf):
    return rounded(dg.prediction_dispersion(b.evaluation(spark, sf)))


@query(
    "survivorship_inflation",
    with_blocks(
        ("ic", "evaluation", "membership"),
        f"""SELECT model_id, {r('a')} AS pit, {r('s')} AS survivor, {r('s - a')} AS inflation, {r('(s - a) / abs(a) * 100', 4)} AS inflation_pct FROM (
  SELECT model_id, avg(ic) FILTER (WHERE arm = 'pit') AS a, avg(ic) FILTER (WHERE arm = 'survivor') AS s FROM ics
  WHERE n >= 5 AND ic IS NOT NULL AND isfinite(ic) GROUP BY 1)""",
        {
            "last": "SELECT max(date) AS d FROM bars",
            "arms": """SELECT 'pit' AS arm, e.* FROM evaluation e JOIN membership m ON e.ticker = m.ticker AND m.added <= e.date AND (m.removed IS NULL OR e.date < m.removed)
  UNION ALL SELECT 'survivor', e.* FROM evaluation e WHERE ticker IN (SELECT ticker FROM membership, last WHERE added <= d AND (removed IS NULL OR removed > d))""",
            "vv": "SELECT * FROM arms WHERE prediction IS NOT NULL AND realized IS NOT NULL",
            "rk": f"SELECT arm, model_id, date, {average_rank('prediction', 'arm, model_id, date')} AS x, {average_rank('realized', 'arm, model_id, date')} AS z FROM vv",
            "ics": "SELECT arm, model_id, date, corr(x, z) AS ic, count(*) AS n FROM rk GROUP BY 1, 2, 3",
        },
    ),
)
def survivorship_inflation(spark, sf):
    """IC of point-in-time members against IC of the names alive at the end."""
    df, rows = _frame(spark, sf)
    members = b.membership(spark, sf)
    arms = filter_to_members(df, members).withColumn("arm", F.lit("pit")).unionByName(
        survivors(df, members).withColumn("arm", F.lit("survivor"))
    )
    ic = mt.daily_ic(arms, ["arm", "model_id"], rows=rows).groupBy("arm", "model_id").agg(F.avg("ic").alias("ic"))
    out = dg.arm_difference(ic, "arm", "ic", "pit", "survivor", ["model_id"])
    return rounded(out.withColumn("inflation_pct", shortened("inflation_pct", 4)))


# ---- ensembles ----------------------------------------------------------------------


@query(
    "rank_average_ensemble",
    with_blocks(
        ("predictions",),
        f"SELECT date, ticker, {r('avg(x)')} AS prediction FROM (SELECT date, ticker, {rank_share('prediction', 'model_id, date')} AS x FROM fc) GROUP BY 1, 2",
        {
            "fc": """SELECT * FROM predictions WHERE (date, ticker) IN (SELECT (date, ticker) FROM predictions GROUP BY date, ticker HAVING count(DISTINCT model_id) = 4)"""
        },
    ),
)
def rank_average_ensemble(spark, sf):
    out = en.rank_average(b.predictions(spark, sf), b.MODELS, rows=b.names_bound(spark, sf))
    return rounded(out.select("date", "ticker", "prediction"))


@query(
    "rank_average_comparison",
    with_blocks(
        ("predictions", "matrix"),
        f"""SELECT model_id, n_observations, n_dates, {r('information_coefficient')} AS information_coefficient, {r('ic_t_stat')} AS ic_t_stat, {r('hit_rate')} AS hit_rate,
  {r('mae')} AS mae, {r('rmse')} AS rmse, {r('long_short_sharpe')} AS long_short_sharpe
FROM (SELECT model_id, count(*) AS n_observations, count(DISTINCT date) AS n_dates, avg(CASE WHEN sign(p) = sign(y) THEN 1.0 ELSE 0.0 END) AS hit_rate,
  avg(abs(p - y)) AS mae, sqrt(avg((p - y) * (p - y))) AS rmse FROM v GROUP BY 1)
JOIN (SELECT model_id, avg(ic) AS information_coefficient, avg(ic) * sqrt(count(*)) / stddev_samp(ic) AS ic_t_stat FROM ics
  WHERE n >= 5 AND ic IS NOT NULL AND isfinite(ic) GROUP BY 1) USING (model_id)
JOIN (SELECT model_id, avg(ret) / stddev_samp(ret) * {_ann(5)} AS long_short_sharpe FROM bk GROUP BY 1) USING (model_id)""",
        {
            "fc": "SELECT * FROM predictions WHERE (date, ticker) IN (SELECT (date, ticker) FROM predictions GROUP BY date, ticker HAVING count(DISTINCT model_id) = 4)",
            "al": f"""SELECT model_id, date, ticker, prediction AS p FROM fc UNION ALL SELECT 'rank_average', date, ticker, avg(x) FROM (
  SELECT date, ticker, {rank_share('prediction', 'model_id, date')} AS x FROM fc) GROUP BY 2, 3""",
            "v": "SELECT al.*, round(p, 12) AS q, m.y FROM al JOIN matrix m USING (date, ticker) WHERE m.y IS NOT NULL",
            "rk": f"SELECT model_id, date, {average_rank('q', 'model_id, date')} AS a, {average_rank('y', 'model_id, date')} AS z FROM v",
            "ics": "SELECT model_id, date, corr(a, z) AS ic, count(*) AS n FROM rk GROUP BY 1, 2",
            "pl": """SELECT *, row_number() OVER (PARTITION BY model_id, date ORDER BY q, ticker) AS pos, count(*) OVER (PARTITION BY model_id, date) AS n FROM v""",
            "bk": """SELECT model_id, date, avg(y) FILTER (WHERE pos > n - k) - avg(y) FILTER (WHERE pos <= k) AS ret FROM (
  SELECT *, greatest(1, CAST(round_even(n * 0.2, 0) AS INT)) AS k FROM pl WHERE n >= 10) GROUP BY 1, 2""",
        },
    ),
)
def rank_average_comparison(spark, sf):
    """The ensemble and its constituents on the pairs all of them cover."""
    rows = b.names_bound(spark, sf)
    single = mt.full_coverage(b.predictions(spark, sf)).select("model_id", "date", "ticker", "prediction")
    both = single.unionByName(en.rank_average(single, b.MODELS, rows=rows).select(*single.columns))
    # Means of equal ranks in another order differ in the last bit; they are ties.
    both = both.withColumn("prediction", F.round("prediction", 12))
    return rounded(mt.compare_models(mt.join_realized(both, b.matrix(spark, sf)), rows=rows))


def _wide(spark, sf):
    days = dg.dispersion_by_date(b.bars(spark, sf))
    frame = b.evaluation(spark, sf).join(broadcast_dates(days), "date")
    return en.prediction_matrix(frame, b.MODELS, ["realized", "dispersion"], b.names_bound(spark, sf))


_WIDE_BLOCKS = {
    "e": """SELECT e.*, dispersion FROM evaluation e JOIN dispersion USING (date)""",
    "cd": "SELECT date FROM e GROUP BY 1 HAVING count(DISTINCT model_id) = 4",
    "z": """SELECT *, (prediction - avg(prediction) OVER (PARTITION BY model_id, date)) / CASE WHEN stddev_samp(prediction) OVER (PARTITION BY model_id, date) = 0
  THEN 1.0 ELSE stddev_samp(prediction) OVER (PARTITION BY model_id, date) END AS s FROM e WHERE date IN (SELECT date FROM cd)""",
    "w": "SELECT date, ticker, max(realized) AS realized, max(dispersion) AS dispersion, "
    + ", ".join(f"max(s) FILTER (WHERE model_id = '{m}') AS {m}" for m in b.MODELS)
    + " FROM z GROUP BY 1, 2",
}


@query(
    "prediction_matrix",
    with_blocks(
        ("evaluation", "dispersion"),
        "SELECT date, ticker, " + ", ".join(f"{r(m)} AS {m}" for m in b.MODELS) + f", {r('realized')} AS realized, {r('dispersion')} AS dispersion FROM w"
        + " WHERE realized IS NOT NULL AND " + " AND ".join(f"{m} IS NOT NULL" for m in b.MODELS),
        _WIDE_BLOCKS,
    ),
)
def prediction_matrix(spark, sf):
    return rounded(_wide(spark, sf))


def _stack(kind: str, buckets: int):
    def run(spark, sf):
        out, _ = en.stack_ensemble(_wide(spark, sf), b.MODELS, kind, buckets)
        return rounded(out.select("date", "ticker", "ensemble_prediction"))

    return run


def _stack_blocks(kind: str, buckets: int, name: str) -> dict[str, str]:
    """Blocks that end in ``name``: (bucket, c0.., a, alpha), the stack of each bucket from the first half of the dates.

    Least squares by coordinate descent on the centred products, for every penalty and every left-out fold at once.
    """
    models = list(b.MODELS)
    k, steps = len(models), 400
    place = "CASE WHEN dispersion < t1 THEN 0 WHEN dispersion < t2 THEN 1 ELSE 2 END" if buckets > 1 else "0"
    products = ", ".join(f"count(*) * covar_pop({models[i]}, {models[j]}) AS x{i}{j}" for i in range(k) for j in range(i, k))
    plain = ", ".join(f"avg({m}) AS m{i}, count(*) * covar_pop({m}, realized) AS y{i}" for i, m in enumerate(models))
    pulls = []
    for i in range(k):
        other = " - ".join([f"y{i}", *[f"x{min(i, j)}{max(i, j)} * {'n' if j < i else 'c'}{j}" for j in range(k) if j != i]])
        pulls.append(f"CASE WHEN x{i}{i} > 0 THEN greatest(0.0, ({other}) / x{i}{i}) ELSE 0.0 END AS n{i}" if kind == "nnls" else f"({other}) / (x{i}{i} + alpha) AS n{i}")
    grid = (
        "(SELECT unnest(range(0, 40)) AS g), (SELECT unnest([-1, 0, 1, 2, 3, 4]) AS f)" if kind == "ridge" else "(SELECT 0 AS g), (SELECT -1 AS f)"
    )
    alpha = "pow(10, -3 + g * 8.0 / 39)" if kind == "ridge" else "0.0::DOUBLE"
    cs, ns = [f"c{i}" for i in range(k)], [f"n{i}" for i in range(k)]
    rule = " + ".join(["a", *[f"c{i} * {m}" for i, m in enumerate(models)]])
    p = f"{name}_"
    return {
        f"{p}pl": f"SELECT w0.*, fold, {place} AS own FROM w0 JOIN w_folds USING (date), w_edges",
        # A bucket of fewer than 100 rows is fitted on all rows.
        f"{p}tr": f"""SELECT l.* EXCLUDE (own), g.bucket FROM {p}pl l JOIN (SELECT b.bucket, (SELECT count(*) FROM {p}pl WHERE own = b.bucket) AS c
  FROM (SELECT unnest(range(0, {buckets})) AS bucket) b) g ON l.own = g.bucket OR g.c < 100""",
        f"{p}st": f"""SELECT bucket, f, count(*) AS n, avg(realized) AS my, {plain}, {products}
  FROM {p}tr, (SELECT unnest([-1, 0, 1, 2, 3, 4]) AS f) WHERE fold <> f GROUP BY 1, 2""",
        f"{p}cd": f"""SELECT bucket, f, g, {alpha} AS alpha, 0 AS step, {', '.join(f'0.0::DOUBLE AS {c}' for c in cs)}
  FROM (SELECT DISTINCT bucket FROM {p}tr), {grid}
UNION ALL SELECT bucket, f, g, alpha, step + 1, {', '.join(ns)} FROM (
  SELECT d.bucket, d.f, d.g, d.alpha, d.step, {', '.join(pulls)} FROM {p}cd d JOIN {p}st s ON s.bucket = d.bucket AND s.f = d.f WHERE step < {steps})""",
        f"{p}fit": f"""SELECT d.*, my - ({' + '.join(f'c{i} * m{i}' for i in range(k))}) AS a FROM {p}cd d JOIN {p}st s ON s.bucket = d.bucket AND s.f = d.f
  WHERE step = {steps}""",
        f"{p}sc": f"""SELECT bucket, g, avg(r2) AS score FROM (SELECT t.bucket, d.g, d.f, 1 - sum(pow(realized - ({rule}), 2)) / (count(*) * var_pop(realized)) AS r2
  FROM {p}fit d JOIN {p}tr t ON t.bucket = d.bucket AND t.fold = d.f GROUP BY 1, 2, 3) GROUP BY 1, 2""",
        f"{p}pk": f"SELECT bucket, g FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY score DESC, g) AS o FROM {p}sc) WHERE o = 1"
        if kind == "ridge"
        else f"SELECT DISTINCT bucket, 0 AS g FROM {p}tr",
        name: f"SELECT d.* FROM {p}fit d JOIN {p}pk k ON k.bucket = d.bucket AND k.g = d.g WHERE d.f = -1",
    }


_WIDE_ROWS = " AND ".join(f"{m} IS NOT NULL" for m in ("realized", *b.MODELS))
_STACK_FRAME = {
    "wd": f"SELECT * FROM w WHERE {_WIDE_ROWS}",
    "w_half": "SELECT date AS h FROM (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS nd FROM (SELECT DISTINCT date FROM wd)) WHERE i = nd // 2",
    "w0": "SELECT wd.* FROM wd, w_half WHERE date < h",
    "w_folds": """SELECT date, CAST(floor(i * 5 / n) AS INT) AS fold FROM (
  SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM w0))""",
    "w_edges": "SELECT quantile_cont(dispersion, 1.0 / 3) AS t1, quantile_cont(dispersion, 2.0 / 3) AS t2 FROM w0",
}


def _stack_sql(kind: str, buckets: int) -> str:
    place = "CASE WHEN dispersion < t1 THEN 0 WHEN dispersion < t2 THEN 1 ELSE 2 END" if buckets > 1 else "0"
    rule = " + ".join(["a", *[f"c{i} * {m}" for i, m in enumerate(b.MODELS)]])
    return with_blocks(
        ("evaluation", "dispersion"),
        f"""SELECT date, ticker, {r(rule)} AS ensemble_prediction FROM (
  SELECT wd.*, {place} AS bucket FROM wd, w_half, w_edges WHERE date >= h) t JOIN stack s ON s.bucket = t.bucket""",
        {**_WIDE_BLOCKS, **_STACK_FRAME, **_stack_blocks(kind, buckets, "stack")},
        recursive=True,
    )


query("ridge_stack", _stack_sql("ridge", 1))(_stack("ridge", 1))
query("ridge_stack_by_regime", _stack_sql("ridge", 3))(_stack("ridge", 3))
query("nnls_stack", _stack_sql("nnls", 1))(_stack("nnls", 1))
query("nnls_stack_by_regime", _stack_sql("nnls", 3))(_stack("nnls", 3))


def _weights_sql() -> str:
    k = len(b.MODELS)
    total = " + ".join(f"abs(c{i})" for i in range(k))
    part = """SELECT CAST(bucket AS INT) AS bucket, model_id, {c} AS coef, {s} AS share, {a} AS intercept, CAST({z} AS INT) AS n_nonzero, {al} AS alpha, '{kind}' AS kind
FROM (SELECT *, unnest([{names}]) AS model_id, unnest([{cs}]) AS coef FROM {kind}_stack)"""
    texts = [
        part.format(
            c=r("coef"),
            s=r(f"CASE WHEN {total} > 0 THEN coef / ({total}) END"),
            a=r("a"),
            z=" + ".join(f"(abs(c{i}) > 1e-12)::INT" for i in range(k)),
            al=r("alpha") if kind == "ridge" else "NULL::DOUBLE",
            kind=kind,
            names=", ".join(f"'{m}'" for m in b.MODELS),
            cs=", ".join(f"c{i}" for i in range(k)),
        )
        for kind in ("ridge", "nnls")
    ]
    blocks = {**_WIDE_BLOCKS, **_STACK_FRAME, **_stack_blocks("ridge", 3, "ridge_stack"), **_stack_blocks("nnls", 3, "nnls_stack")}
    return with_blocks(("evaluation", "dispersion"), "\nUNION ALL ".join(texts), blocks, recursive=True)


@query("stack_weights", _weights_sql())
def stack_weights(spark, sf):
    wide = cut(_wide(spark, sf), "wide")
    parts = None
    for kind in ("ridge", "nnls"):
        _, stacks = en.stack_ensemble(wide, b.MODELS, kind, 3)
        part = en.stack_weights(spark, stacks).withColumn("kind", F.lit(kind))
        parts = part if parts is None else parts.unionByName(part)
    return rounded(parts)


_SOFTMAX = {
    "e": "SELECT * FROM evaluation WHERE date IN (SELECT date FROM evaluation GROUP BY 1 HAVING count(DISTINCT model_id) = 4)",
    "z": """SELECT model_id, date, ticker, realized, dispersion, (prediction - avg(prediction) OVER w) / CASE WHEN stddev_samp(prediction) OVER w = 0 THEN 1.0
  ELSE stddev_samp(prediction) OVER w END AS prediction FROM e JOIN dispersion USING (date) WINDOW w AS (PARTITION BY model_id, date)""",
    "dx": "SELECT date, dispersion, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS nd FROM (SELECT DISTINCT date, dispersion FROM z)",
}
_IC_OF = """SELECT model_id, date, corr(a, c) AS ic FROM (SELECT model_id, date, {0} AS a, {1} AS c FROM {2} WHERE prediction IS NOT NULL AND realized IS NOT NULL)
  GROUP BY 1, 2 HAVING count(*) >= 5"""


_REGIME_BLOCKS = {
    **_SOFTMAX,
    "half": "SELECT date AS h FROM dx WHERE i = nd // 2",
    "tr": "SELECT z.* FROM z, half WHERE date < h",
    "dd": "SELECT dispersion, row_number() OVER (ORDER BY dispersion) - 1 AS p, count(*) OVER () AS n FROM (SELECT date, dispersion FROM dx, half WHERE date < h)",
    "th": "SELECT max(CASE WHEN p = floor((n - 1) / 3.0 + 0.5) THEN dispersion END) AS t1, max(CASE WHEN p = floor((n - 1) * 2.0 / 3 + 0.5) THEN dispersion END) AS t2 FROM dd",
    "ics": _IC_OF.format(average_rank("prediction", "model_id, date"), average_rank("realized", "model_id, date"), "tr"),
    "mi": """SELECT CASE WHEN dispersion < t1 THEN 0 WHEN dispersion < t2 THEN 1 ELSE 2 END AS bucket, model_id, avg(ic) AS mic
  FROM ics JOIN dx USING (date), th WHERE ic IS NOT NULL AND isfinite(ic) GROUP BY 1, 2""",
}


@query(
    "regime_softmax_weights",
    with_blocks(
        ("evaluation", "dispersion"),
        f"""SELECT CAST(bucket AS INT) AS bucket, model_id, {r('exp(200 * (ic - mx)) / sum(exp(200 * (ic - mx))) OVER (PARTITION BY bucket)', 4)} AS weight
FROM (SELECT g.bucket, g.model_id, coalesce(m.mic, 0.0) AS ic, max(coalesce(m.mic, 0.0)) OVER (PARTITION BY g.bucket) AS mx
  FROM (SELECT unnest([0, 1, 2]) AS bucket, mm.model_id FROM (SELECT DISTINCT model_id FROM z) mm) g LEFT JOIN mi m ON m.bucket = g.bucket AND m.model_id = g.model_id)""",
        _REGIME_BLOCKS,
    ),
)
def regime_softmax_weights(spark, sf):
    days = dg.dispersion_by_date(b.bars(spark, sf))
    _, weights = en.regime_softmax(b.evaluation(spark, sf), days, b.MODELS, 3, 200.0, b.names_bound(spark, sf))
    return rounded(weights, 4)


@query(
    "regime_softmax_ensemble",
    with_blocks(
        ("evaluation", "dispersion"),
        f"""SELECT date, ticker, {r('sum(prediction * weight)')} AS prediction, {r('max(realized)')} AS realized FROM (
  SELECT z.*, CASE WHEN dispersion < t1 THEN 0 WHEN dispersion < t2 THEN 1 ELSE 2 END AS bucket FROM z, th, half WHERE date >= h) t
JOIN wt ON wt.bucket = t.bucket AND wt.model_id = t.model_id GROUP BY 1, 2 HAVING count(prediction) = 4""",
        {
            **_REGIME_BLOCKS,
            "wt": """SELECT bucket, model_id, exp(200 * (ic - mx)) / sum(exp(200 * (ic - mx))) OVER (PARTITION BY bucket) AS weight
  FROM (SELECT g.bucket, g.model_id, coalesce(m.mic, 0.0) AS ic, max(coalesce(m.mic, 0.0)) OVER (PARTITION BY g.bucket) AS mx
    FROM (SELECT unnest([0, 1, 2]) AS bucket, mm.model_id FROM (SELECT DISTINCT model_id FROM z) mm) g
    LEFT JOIN mi m ON m.bucket = g.bucket AND m.model_id = g.model_id)""",
        },
    ),
)
def regime_softmax_ensemble(spark, sf):
    days = dg.dispersion_by_date(b.bars(spark, sf))
    out, _ = en.regime_softmax(b.evaluation(spark, sf), days, b.MODELS, 3, 200.0, b.names_bound(spark, sf))
    return rounded(out)


@query(
    "walk_forward_softmax",
    with_blocks(
        ("evaluation", "dispersion"),
        f"""SELECT z.date, z.ticker, {r('sum(coalesce(z.prediction, 0) * w.weight)', 4)} AS prediction, {r('max(z.realized)')} AS realized
FROM z JOIN w ON w.date = z.date AND w.model_id = z.model_id GROUP BY 1, 2""",
        {
            **_SOFTMAX,
            "dd": "SELECT dispersion, row_number() OVER (ORDER BY dispersion) - 1 AS p, count(*) OVER () AS n FROM dx WHERE i < 252",
            "th": "SELECT max(CASE WHEN p = floor((n - 1) / 3.0 + 0.5) THEN dispersion END) AS t1, max(CASE WHEN p = floor((n - 1) * 2.0 / 3 + 0.5) THEN dispersion END) AS t2 FROM dd",
            "bk": "SELECT date, i, CASE WHEN dispersion < t1 THEN 0 WHEN dispersion < t2 THEN 1 ELSE 2 END AS bucket FROM dx, th",
            "ics": _IC_OF.format(average_rank("prediction", "model_id, date"), average_rank("realized", "model_id, date"), "z"),
            "gr": """SELECT bk.*, mm.model_id, CASE WHEN isfinite(x.ic) THEN x.ic END AS ic FROM bk CROSS JOIN (SELECT DISTINCT model_id FROM z) mm
  LEFT JOIN ics x ON x.date = bk.date AND x.model_id = mm.model_id""",
            "av": "SELECT *, avg(ic) OVER (PARTITION BY bucket, model_id ORDER BY i RANGE BETWEEN 258 PRECEDING AND 7 PRECEDING) AS m FROM gr",
            "w": """SELECT date, model_id, exp(200 * (coalesce(m, 0) - mx)) / sum(exp(200 * (coalesce(m, 0) - mx))) OVER (PARTITION BY date) AS weight
  FROM (SELECT *, max(coalesce(m, 0)) OVER (PARTITION BY date) AS mx FROM av) WHERE i >= 252 + 252 + 6""",
        },
    ),
)
def walk_forward_softmax(spark, sf):
    days = dg.dispersion_by_date(b.bars(spark, sf))
    out = en.walk_forward_softmax(b.evaluation(spark, sf), days, b.MODELS, rows=b.names_bound(spark, sf))
    return rounded(out.withColumn("prediction", shortened("prediction", 4)))


_W, _PW = (0.4, 0.3, 0.2, 0.1), (0.05, 0.02, -0.02, -0.05)


def _blend_sql() -> str:
    def part(order: str, share: float) -> str:
        return f"""SELECT date, ticker, sum(v * (w + [{', '.join(map(str, _PW))}][CAST(p AS INT)])) * {share} AS x FROM (
  SELECT *, row_number() OVER (PARTITION BY date, ticker ORDER BY v {order}, m) AS p FROM u) GROUP BY 1, 2"""

    full = " AND ".join(f"{m} IS NOT NULL" for m in b.MODELS)
    wide = "SELECT date, ticker, " + ", ".join(f"max(prediction) FILTER (WHERE model_id = '{m}') AS {m}" for m in b.MODELS) + " FROM predictions GROUP BY 1, 2"
    union = " UNION ALL ".join(
        f"SELECT date, ticker, {i} AS m, {m} AS v, {_W[i]} AS w FROM wide WHERE {full}" for i, m in enumerate(b.MODELS)
    )
    return with_blocks(
        ("predictions",),
        f"SELECT date, ticker, {r('sum(x)')} AS prediction FROM ({part('ASC', 0.3)} UNION ALL {part('DESC', 0.7)}) GROUP BY 1, 2",
        {"wide": wide, "u": union},
    )


@query("position_blend", _blend_sql())
def position_blend(spark, sf):
    wide = b.predictions(spark, sf).groupBy("date", "ticker").pivot("model_id", list(b.MODELS)).agg(F.first("prediction"))
    out = en.position_blend(wide.dropna(subset=list(b.MODELS)), b.MODELS, _W, _PW)
    return rounded(out.select("date", "ticker", "prediction"))
