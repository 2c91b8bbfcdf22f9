"""Registered queries of the feature registry and the per-date transforms."""

from __future__ import annotations

from pyspark.sql import functions as F

from crosslane.operators import features as ft
from crosslane.operators.diagnostics import (
    bucket_by,
    dispersion_by_date,
    feature_correlations,
    feature_dispersion,
    high_pairs,
    ic_by_volatility,
    ic_versus_beta,
    redundancy_clusters,
    suggested_drops,
    thresholds_of,
    univariate_ic,
)
from crosslane.operators.metrics import daily_ic, ic_stats
from crosslane.operators.neutralize import residualize
from crosslane.operators.ranking import add_average_rank, add_position, quantiles
from crosslane.operators.registry import get_feature, list_features
from crosslane.operators.rolling import add_ewm_mean, add_ewm_std, add_rolling, full
from crosslane.operators.smoothing import smooth_predictions
from crosslane.plans import binding as b
from crosslane.plans.catalog import query, rounded, shortened
from crosslane.plans.oracle import BLOCKS, average_rank, lag, ols_blocks, r, rank_share, rolling, win, with_blocks
from crosslane.sources.factors import FACTORS

# ---- SQL of the features ------------------------------------------------------

BLOCKS["series"] = (
    ("returns", "market", "factors"),
    f"""SELECT r.*, m.mkt, m.xs_std, f.MKT_RF, f.SMB, f.HML, f.RMW, f.CMA,
  adj_close - {lag('adj_close', 1)} AS delta, greatest(close * volume, 1.0) AS dollar,
  volume * (close / greatest(adj_close, 1e-9)) AS vadj, open * (adj_close / greatest(close, 1e-9)) AS aopen
FROM returns r LEFT JOIN market m USING (date) LEFT JOIN factors f USING (date)""",
)


def _moments(x: str, y: str) -> tuple[str, str]:
    mean_y = rolling("avg", y, 60)
    cov = f"({rolling('avg', f'{x} * {y}', 60)}) - ({rolling('avg', x, 60)}) * ({mean_y})"
    var = f"({rolling('avg', f'{y} * {y}', 60)}) - ({mean_y}) * ({mean_y})"
    return cov, var


def _beta_block(y: str) -> str:
    cov, var = _moments("lr", y)
    return f"SELECT *, CASE WHEN v > 1e-12 THEN c / v END AS beta FROM (SELECT *, {cov} AS c, {var} AS v FROM series)"


def _median_gap(x: str, by: str) -> str:
    return f"{x} - median({x}) OVER (PARTITION BY {by})"


_MOM60 = f"{lag('lp', 5)} - {lag('lp', 65)}"
_VOL20 = rolling("stddev_samp", "lr", 20)
_MA200 = f"(adj_close - ({rolling('avg', 'adj_close', 200)})) / ({rolling('avg', 'adj_close', 200)})"
_RET5 = f"lp - {lag('lp', 5)}"
_PAST252 = "(PARTITION BY ticker ORDER BY date ROWS BETWEEN 252 PRECEDING AND 1 PRECEDING)"
_GAIN = rolling("avg", "CASE WHEN delta > 0 THEN delta ELSE 0.0 END", 14)
_LOSS = rolling("avg", "CASE WHEN delta < 0 THEN -delta ELSE 0.0 END", 14)

# name -> expression over the block ``series``
SIMPLE = {
    "return_5d": _RET5,
    "momentum_60": _MOM60,
    "vol_20": _VOL20,
    "rsi_14": f"100.0 - 100.0 / (1.0 + ({_GAIN}) / CASE WHEN ({_LOSS}) = 0 THEN 1e-12 ELSE ({_LOSS}) END)",
    "distance_ma_200": _MA200,
    "momentum_12_1": f"{lag('lp', 21)} - {lag('lp', 252)}",
    "distance_52w_high": f"lp - ln(CASE WHEN count(adj_close) OVER {_PAST252} = 252 THEN max(adj_close) OVER {_PAST252} END)",
    "return_1d": "lr",
    "momentum_378": f"lp - {lag('lp', 378)}",
    "momentum_504": f"lp - {lag('lp', 504)}",
    "momentum_756": f"lp - {lag('lp', 756)}",
    "range_ratio": "(high - low) / close",
    "body_ratio": "abs(open - close) / close",
    "parkinson_vol_20": f"sqrt({rolling('avg', '(ln(high) - ln(low)) * (ln(high) - ln(low)) / (4.0 * ln(2.0))', 20)})",
    "log_dollar_volume": "ln(dollar)",
    "max_return_21d": rolling("max", "lr", 21),
    "overnight_return_1d": f"ln(aopen) - {lag('lp', 1)}",
    "intraday_return_1d": "lp - ln(aopen)",
    "amihud_illiquidity_20": rolling("avg", "abs(lr) / dollar", 20),
    "cs_return_dispersion_20": rolling("avg", "xs_std", 20),
}
SIMPLE["abnormal_volume"] = (
    f"vadj / CASE WHEN ({rolling('avg', 'vadj', 20)}) > 1.0 THEN ({rolling('avg', 'vadj', 20)}) ELSE 1.0 END"
)
# name -> (base block over ``series``, expression over it)
LAYERED = {
    "momentum_60_sector_rel": (f"SELECT *, {_MOM60} AS x FROM series", _median_gap("x", "date, sector")),
    "sector_relative_return_5d": (f"SELECT *, {_RET5} AS x FROM series", _median_gap("x", "date, sector")),
    "momentum_60_rank": (f"SELECT *, {_MOM60} AS x FROM series", rank_share("x")),
    "vol_20_rank": (f"SELECT *, {_VOL20} AS x FROM series", rank_share("x")),
    "distance_ma_200_rank": (f"SELECT *, {_MA200} AS x FROM series", rank_share("x")),
    "vol_20_cs_min_dist": (f"SELECT *, {_VOL20} AS x FROM series", "x - min(x) OVER (PARTITION BY date)"),
    "mom60_minus_dist_ma200": (f"SELECT *, {_MOM60} AS x, {_MA200} AS z FROM series", "x - z"),
    "beta_60": (_beta_block("mkt"), "beta"),
    "residual_return_5d": (_beta_block("mkt"), f"{_RET5} - beta * ({rolling('sum', 'mkt', 5)})"),
    "idio_vol_20": (
        f"SELECT *, lr - CASE WHEN v > 1e-12 THEN c / v ELSE 0.0 END * mkt AS e FROM ({_beta_block('mkt')})",
        rolling("stddev_samp", "e", 20),
    ),
    "mkt_beta_xs_dispersion": (_beta_block("MKT_RF"), _median_gap("beta", "date")),
}
for _f in FACTORS:
    _s = _f.split("_")[0].lower()
    LAYERED[f"{_s}_beta_60"] = (_beta_block(_f), "beta")
    if _f in ("MKT_RF", "SMB", "HML"):
        LAYERED[f"{_s}_beta_x_{_s}_20d"] = (_beta_block(_f), f"beta * ({rolling('sum', _f, 20)})")
# Scales that bring tiny values into the rounded range.
SCALE = {"amihud_illiquidity_20": 1e6}


def _ewm_std_sql() -> str:
    # Weights by row distance; the correction uses the sums of weights and squared weights.
    pairs = """SELECT a.date, a.ticker, count(*) AS k, sum(w) AS w, sum(w * w) AS ww, sum(w * b.lr) AS wx,
  sum(w * b.lr * b.lr) AS wxx
FROM numbered a JOIN (SELECT * FROM numbered WHERE lr IS NOT NULL) b ON a.ticker = b.ticker AND b.i <= a.i AND b.i > a.i - 420,
  LATERAL (SELECT pow(1.0 - 2.0 / 21.0, a.i - b.i) AS w)
WHERE a.lr IS NOT NULL GROUP BY 1, 2"""
    value = "CASE WHEN k = 1 THEN 0.0 ELSE sqrt(greatest(wxx / w - (wx / w) * (wx / w), 0.0) / (1.0 - ww / (w * w))) END"
    return with_blocks(
        ("returns",),
        f"SELECT n.date, n.ticker, {r(value)} AS vol_ewm_20 FROM numbered n LEFT JOIN pairs USING (date, ticker)",
        {
            "numbered": "SELECT date, ticker, lr, row_number() OVER (PARTITION BY ticker ORDER BY date) AS i FROM returns",
            "pairs": pairs,
        },
    )


def _feature_sql(name: str) -> str | None:
    if name == "vol_ewm_20":
        return _ewm_std_sql()
    scale = f" * {SCALE[name]}" if name in SCALE else ""
    if name in SIMPLE:
        return with_blocks(
            ("series",), f"SELECT date, ticker, {r(f'x{scale}')} AS {name} FROM v", {"v": f"SELECT *, {SIMPLE[name]} AS x FROM series"}
        )
    base, value = LAYERED[name]
    return with_blocks(
        ("series",),
        f"SELECT date, ticker, {r(f'val{scale}')} AS {name} FROM w",
        {"v": base, "w": f"SELECT *, {value} AS val FROM v"},
    )


def _register_feature(name: str) -> None:
    @query(f"feature_{name}", _feature_sql(name))
    def run(spark, sf):
        feature = get_feature(name)
        needs_factors = any(f in FACTORS for f in feature.needs) or any(
            f in FACTORS for n in feature.needs if n in list_features() for f in get_feature(n).needs
        )
        out = ft.add_features(
            b.panel(spark, sf), [name], b.factors(spark, sf) if needs_factors else None, b.names_bound(spark, sf)
        )
        if name in SCALE:
            out = out.withColumn(name, F.col(name) * SCALE[name])
        return rounded(out.select("date", "ticker", name))


for _name in list_features():
    _register_feature(_name)


# ---- flagship -------------------------------------------------------------------

_FLAG = ("return_5d", "vol_20", "return_1d", "range_ratio", "max_return_21d")


def _flag_sql() -> str:
    ranks = ", ".join(f"{rank_share(f)} AS r_{f}" for f in _FLAG)
    union = " UNION ALL ".join(f"SELECT '{f}' AS model_id, date, ticker, r_{f} AS prediction, y AS realized FROM rk" for f in _FLAG)
    return with_blocks(
        ("returns",),
        f"""SELECT model_id, CAST(count(*) AS BIGINT) AS n_ic_dates, {r('avg(ic)')} AS information_coefficient,
  {r('avg(ic) * sqrt(count(*)) / stddev_samp(ic)', 4)} AS ic_t_stat FROM ic GROUP BY 1""",
        {
            "m": f"""SELECT date, ticker, {_RET5} AS return_5d, {_VOL20} AS vol_20, lr AS return_1d, (high - low) / close AS range_ratio,
  {rolling('max', 'lr', 21)} AS max_return_21d, lead(lp, 5) OVER (PARTITION BY ticker ORDER BY date) - lp AS a FROM returns""",
            "rk": f"SELECT date, ticker, {ranks}, a - avg(a) OVER (PARTITION BY date) AS y FROM m",
            "p": f"SELECT * FROM ({union}) WHERE prediction IS NOT NULL AND realized IS NOT NULL",
            "q": f"""SELECT model_id, date, {average_rank('prediction', 'model_id, date')} AS rp,
  {average_rank('realized', 'model_id, date')} AS rr FROM p""",
            "ic": "SELECT * FROM (SELECT model_id, date, corr(rp, rr) AS ic, count(*) AS n FROM q GROUP BY 1, 2) "
            "WHERE n >= 5 AND ic IS NOT NULL AND isfinite(ic)",
        },
    )


@query("flagship_feature_ic", _flag_sql())
def flagship(spark, sf):
    """Panel -> features -> per-date ranks -> forward excess return -> IC and t of every feature as a model."""
    rows = b.names_bound(spark, sf)
    matrix = ft.build_feature_matrix(b.bars(spark, sf), _FLAG, "rank", 5, rows=rows)
    long = matrix.unpivot(["date", "ticker", "y"], list(_FLAG), "model_id", "prediction").withColumnRenamed("y", "realized")
    out = ic_stats(daily_ic(long, rows=rows))
    return out.select(
        "model_id",
        "n_ic_dates",
        shortened("information_coefficient", 6).alias("information_coefficient"),
        shortened("ic_t_stat", 4).alias("ic_t_stat"),
    )


_WIDE = ("return_5d", "return_1d", "range_ratio")


def _wide_sql() -> str:
    """The brand blocks over suppliers: the same text with another key and no join."""
    ranks = ", ".join(f"{rank_share(f)} AS r_{f}" for f in _WIDE)
    union = " UNION ALL ".join(f"SELECT '{f}' AS model_id, date, r_{f} AS p, y FROM rk" for f in _WIDE)
    bars = BLOCKS["bars"][1].replace("p_brand AS ticker", "'S' || CAST(l_suppkey AS VARCHAR) AS ticker").replace(
        " JOIN part ON l_partkey = p_partkey", ""
    )
    return (
        f"WITH wb AS MATERIALIZED ({bars}), "
        f"m AS (SELECT date, ticker, lp - {lag('lp', 5)} AS return_5d, lp - {lag('lp', 1)} AS return_1d, (high - low) / close AS range_ratio, "
        "lead(lp, 5) OVER (PARTITION BY ticker ORDER BY date) - lp AS a FROM (SELECT *, ln(adj_close) AS lp FROM wb)), "
        f"rk AS (SELECT date, ticker, {ranks}, a - avg(a) OVER (PARTITION BY date) AS y FROM m), "
        f"v AS (SELECT * FROM ({union}) WHERE p IS NOT NULL AND y IS NOT NULL), "
        f"q AS (SELECT model_id, date, {average_rank('p', 'model_id, date')} AS rp, {average_rank('y', 'model_id, date')} AS rr FROM v), "
        "ic AS (SELECT * FROM (SELECT model_id, date, corr(rp, rr) AS ic, count(*) AS n FROM q GROUP BY 1, 2) "
        "WHERE n >= 5 AND ic IS NOT NULL AND isfinite(ic)) "
        f"SELECT model_id, CAST(count(*) AS BIGINT) AS n_ic_dates, {r('avg(ic)')} AS information_coefficient, "
        f"{r('avg(ic) * sqrt(count(*)) / stddev_samp(ic)', 4)} AS ic_t_stat FROM ic GROUP BY 1"
    )


@query("wide_universe_feature_ic", _wide_sql())
def wide_universe(spark, sf):
    """The flagship steps with every supplier as an entity, so the universe grows with the data."""
    rows = b.supplier_bars(spark, sf).select("ticker").distinct().count()
    matrix = ft.build_feature_matrix(b.supplier_bars(spark, sf), _WIDE, "rank", 5, rows=rows)
    long = matrix.unpivot(["date", "ticker", "y"], list(_WIDE), "model_id", "prediction").withColumnRenamed("y", "realized")
    out = ic_stats(daily_ic(long, rows=rows))
    return out.select(
        "model_id",
        "n_ic_dates",
        shortened("information_coefficient", 6).alias("information_coefficient"),
        shortened("ic_t_stat", 4).alias("ic_t_stat"),
    )


# ---- transforms -----------------------------------------------------------------

_XS = ("return_5d", "vol_20", "range_ratio")


@query(
    "normalize_zscore",
    with_blocks(
        ("matrix",),
        "SELECT date, ticker, "
        + ", ".join(
            r(
                f"({c} - avg({c}) OVER (PARTITION BY date)) / CASE WHEN stddev_samp({c}) OVER (PARTITION BY date) = 0"
                f" THEN 1.0 ELSE stddev_samp({c}) OVER (PARTITION BY date) END"
            )
            + f" AS {c}"
            for c in _XS
        )
        + " FROM matrix",
    ),
)
def normalize_zscore(spark, sf):
    out = ft.normalize(b.matrix(spark, sf), list(_XS), "zscore", b.names_bound(spark, sf))
    return rounded(out.select("date", "ticker", *_XS))


@query(
    "normalize_rank",
    with_blocks(("matrix",), "SELECT date, ticker, " + ", ".join(f"{r(rank_share(c))} AS {c}" for c in _XS) + " FROM matrix"),
)
def normalize_rank(spark, sf):
    out = ft.normalize(b.matrix(spark, sf), list(_XS), "rank", b.names_bound(spark, sf))
    return rounded(out.select("date", "ticker", *_XS))


@query("normalize_none", with_blocks(("matrix",), "SELECT date, ticker, " + ", ".join(f"{r(c)} AS {c}" for c in _XS) + " FROM matrix"))
def normalize_none(spark, sf):
    """A matrix without normalization holds the features as they are."""
    out = ft.build_feature_matrix(b.bars(spark, sf), _XS, "none", 5, rows=b.names_bound(spark, sf))
    return rounded(out.select("date", "ticker", *_XS))


@query("forward_excess_return", with_blocks(("matrix",), f"SELECT date, ticker, {r('y')} AS y FROM matrix"))
def forward_excess_return(spark, sf):
    out = ft.add_forward_excess_return(b.bars(spark, sf), 5, rows=b.names_bound(spark, sf))
    return rounded(out.select("date", "ticker", "y"))


@query(
    "forward_simple_return",
    with_blocks(
        ("bars",),
        f"""SELECT date, ticker, {r('lead(adj_close, 21) OVER (PARTITION BY ticker ORDER BY date) / adj_close - 1')} AS raw_fwd21
FROM bars""",
    ),
)
def forward_simple_return(spark, sf):
    out = ft.add_forward_simple_return(b.bars(spark, sf), 21, out="raw_fwd21")
    return rounded(out.select("date", "ticker", "raw_fwd21"))


@query(
    "demean_predictions",
    with_blocks(
        ("predictions",),
        f"""SELECT model_id, date, ticker, {r('prediction - avg(prediction) OVER (PARTITION BY model_id, date)')} AS prediction
FROM predictions""",
    ),
)
def demean_predictions(spark, sf):
    out = ft.demean_by_date(b.predictions(spark, sf), "prediction", ("model_id", "date"), b.names_bound(spark, sf))
    return rounded(out.select("model_id", "date", "ticker", "prediction"))


@query(
    "drop_warmup",
    with_blocks(
        ("matrix",),
        "SELECT count(*) AS n, count(DISTINCT ticker) AS n_tickers, min(date) AS first_date FROM matrix "
        "WHERE return_5d IS NOT NULL AND momentum_60 IS NOT NULL AND vol_20 IS NOT NULL AND range_ratio IS NOT NULL",
    ),
)
def drop_warmup(spark, sf):
    kept = ft.drop_warmup_rows(b.matrix(spark, sf), ["return_5d", "momentum_60", "vol_20", "range_ratio"])
    return kept.agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("ticker").alias("n_tickers"), F.min("date").alias("first_date")
    )


@query(
    "return_skew_20",
    with_blocks(
        ("returns",),
        f"""SELECT date, ticker, {r("CASE WHEN c = 20 THEN (m3 - 3 * m1 * m2 + 2 * m1 * m1 * m1) / pow(m2 - m1 * m1, 1.5) END", 5)} AS return_skew_20
FROM (SELECT date, ticker, count(lr) OVER w AS c, avg(lr) OVER w AS m1, avg(lr * lr) OVER w AS m2, avg(lr * lr * lr) OVER w AS m3
  FROM returns WINDOW w AS {win(20)})""",
    ),
)
def return_skew_20(spark, sf):
    """A plug-in style feature: rolling skewness of the daily return."""
    panel = b.bars(spark, sf).withColumn("_lr", ft.log_return())
    out = add_rolling(
        panel,
        ["ticker"],
        ["date"],
        [lambda w: {"return_skew_20": full(F.skewness("_lr"), F.col("_lr"), w, 20)}],
        back=20,
    )
    return rounded(out.select("date", "ticker", "return_skew_20"), 5)


@query(
    "smooth_predictions",
    with_blocks(
        ("predictions",),
        f"""SELECT model_id, date, ticker, {r('s')} AS prediction FROM (
SELECT a.model_id, a.date, a.ticker, sum(b.prediction * CASE WHEN b.i = 1 THEN 1.0 ELSE a.al END * pow(1.0 - a.al, a.i - b.i)) AS s
FROM n a JOIN n b ON a.model_id = b.model_id AND a.ticker = b.ticker AND b.i <= a.i GROUP BY 1, 2, 3)""",
        {
            "n": """SELECT *, 1.0 - pow(0.5, 1.0 / 5.0) AS al,
  row_number() OVER (PARTITION BY model_id, ticker ORDER BY date) AS i FROM predictions"""
        },
    ),
)
def smooth(spark, sf):
    return rounded(smooth_predictions(b.predictions(spark, sf), 5, keys=("model_id", "ticker")).select("model_id", "date", "ticker", "prediction"))


@query(
    "residualize_one",
    with_blocks(
        ("predictions", "matrix"),
        f"""SELECT f.model_id, f.date, ticker, {r('CASE WHEN n > 2 AND vx > 0 AND x IS NOT NULL THEN prediction - my - (cxy / vx) * (x - mx) ELSE prediction END')} AS prediction
FROM f LEFT JOIN g ON g.model_id = f.model_id AND g.date = f.date""",
        {
            "f": "SELECT p.model_id, p.date, p.ticker, p.prediction, m.vol_20 AS x FROM predictions p JOIN matrix m ON m.date = p.date AND m.ticker = p.ticker",
            "g": """SELECT model_id, date, count(*) AS n, avg(x) AS mx, avg(prediction) AS my, covar_pop(x, prediction) AS cxy, var_pop(x) AS vx
  FROM f WHERE x IS NOT NULL AND prediction IS NOT NULL GROUP BY 1, 2""",
        },
    ),
)
def residualize_one(spark, sf):
    side = b.matrix(spark, sf).select("date", "ticker", F.col("vol_20").alias("x"))
    frame = b.predictions(spark, sf).join(side, ["date", "ticker"])
    return rounded(residualize(frame, "prediction", ["x"]).select("model_id", "date", "ticker", "prediction"))


@query("regime_dispersion", with_blocks(("dispersion",), f"SELECT date, {r('dispersion')} AS dispersion FROM dispersion"))
def regime_dispersion(spark, sf):
    return rounded(dispersion_by_date(b.bars(spark, sf)))


@query(
    "regime_buckets",
    with_blocks(
        ("dispersion",),
        """SELECT CASE WHEN dispersion < q1 THEN 0 WHEN dispersion < q2 THEN 1 ELSE 2 END AS bucket, count(*) AS n_dates
FROM dispersion, (SELECT quantile_cont(dispersion, 1.0 / 3) AS q1, quantile_cont(dispersion, 2.0 / 3) AS q2 FROM dispersion
  WHERE date < DATE '1999-01-01') GROUP BY 1""",
    ),
)
def regime_buckets(spark, sf):
    days = dispersion_by_date(b.bars(spark, sf))
    edges = thresholds_of(days.where(F.col("date") < "1999-01-01"), "dispersion", 3)
    return days.groupBy(bucket_by("dispersion", edges).alias("bucket")).agg(F.count(F.lit(1)).alias("n_dates"))


@query(
    "regime_high_low_ic",
    with_blocks(
        ("ic", "market"),
        f"""SELECT model_id, xs_std > med AS high_vol, {r('avg(ic)')} AS mean_ic, {r('stddev_samp(ic)')} AS std_ic, count(*) AS n_dates
FROM ic JOIN market USING (date), (SELECT median(xs_std) AS med FROM market) WHERE xs_std IS NOT NULL GROUP BY 1, 2""",
    ),
)
def regime_high_low_ic(spark, sf):
    ic = daily_ic(b.evaluation(spark, sf), rows=b.names_bound(spark, sf))
    return rounded(ic_by_volatility(ic, b.bars(spark, sf)))


# ---- feature reports --------------------------------------------------------------

_REPORT = ("return_5d", "momentum_60", "vol_20", "range_ratio")


@query(
    "feature_dispersion",
    with_blocks(("matrix",), "SELECT date, " + ", ".join(f"{r(f'stddev_samp({c})')} AS {c}" for c in _REPORT) + " FROM matrix GROUP BY 1"),
)
def feature_dispersion_q(spark, sf):
    return rounded(feature_dispersion(b.matrix(spark, sf), _REPORT))


def _corr_sql(rank: bool) -> str:
    cols = _REPORT
    src = "SELECT * FROM matrix WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in cols)
    if rank:
        src = "SELECT " + ", ".join(
            f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}" for c in cols
        ) + f" FROM ({src})"
    parts = [
        f"SELECT '{a}' AS feature_a, '{c}' AS feature_b, {r(f'corr({a}, {c})')} AS corr FROM t"
        for i, a in enumerate(cols)
        for c in cols[i + 1 :]
    ]
    return with_blocks(("matrix",), " UNION ALL ".join(parts), {"t": src})


@query("feature_correlation_pearson", _corr_sql(False))
def feature_correlation_pearson(spark, sf):
    return rounded(feature_correlations(b.matrix(spark, sf), _REPORT))


@query("feature_correlation_spearman", _corr_sql(True))
def feature_correlation_spearman(spark, sf):
    return rounded(feature_correlations(b.matrix(spark, sf), _REPORT, "spearman"))


def _uic_blocks(source: str) -> dict[str, str]:
    union = " UNION ALL ".join(f"SELECT '{f}' AS feature, date, {f} AS p, y FROM {source} WHERE {f} IS NOT NULL AND y IS NOT NULL" for f in _REPORT)
    return {
        "u": union,
        "k": f"SELECT feature, date, {average_rank('p', 'feature, date')} AS a, {average_rank('y', 'feature, date')} AS z FROM u",
        "c": "SELECT feature, date, corr(a, z) AS ic, count(*) AS n FROM k GROUP BY 1, 2",
        "ui": "SELECT feature, avg(ic) AS ic, count(*) AS n_dates FROM c WHERE n >= 5 AND ic IS NOT NULL AND isfinite(ic) GROUP BY 1",
    }


def _uic_sql() -> str:
    return with_blocks(("matrix",), f"SELECT feature, {r('ic')} AS univariate_ic, n_dates FROM ui", _uic_blocks("matrix"))


@query("univariate_ic", _uic_sql())
def univariate_ic_q(spark, sf):
    return rounded(univariate_ic(b.matrix(spark, sf), _REPORT, rows=b.names_bound(spark, sf)))


@query(
    "ic_versus_beta",
    with_blocks(
        ("matrix",),
        f"""SELECT feature, {r('ic')} AS univariate_ic, n_dates, {r('beta')} AS partial_beta, sign(ic) = sign(beta) AS agree
FROM ui JOIN (SELECT unnest([{', '.join(f"'{f}'" for f in _REPORT)}]) AS feature, unnest([{', '.join(f'b{i}' for i in range(len(_REPORT)))}]) AS beta FROM ls) USING (feature)""",
        {
            "whole": "SELECT * FROM matrix WHERE y IS NOT NULL AND " + " AND ".join(f"{f} IS NOT NULL" for f in _REPORT),
            **_uic_blocks("whole"),
            **ols_blocks("ls", "whole", [], _REPORT, "y"),
        },
    ),
)
def ic_versus_beta_q(spark, sf):
    return rounded(ic_versus_beta(b.matrix(spark, sf), _REPORT, rows=b.names_bound(spark, sf)))


@query("redundancy_clusters")
def redundancy_clusters_q(spark, sf):
    """Correlated features of the matrix and the ones to drop, by own IC as importance."""
    rows = b.names_bound(spark, sf)
    names = ["return_5d", "return_1d", "momentum_60", "vol_20", "parkinson_vol_20", "range_ratio", "rsi_14"]
    matrix = ft.build_feature_matrix(b.bars(spark, sf), names, "rank", 5, rows=rows)
    pairs = high_pairs(feature_correlations(matrix, names), 0.3)
    own = univariate_ic(matrix, names, rows=rows).select("feature", F.abs("univariate_ic").alias("importance"))
    clusters = redundancy_clusters(pairs, own)
    return rounded(clusters.join(suggested_drops(clusters, own, 2), "feature", "full"))


# ---- kernels over a raw table -------------------------------------------------------


@query(
    "rank_in_groups",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {r(average_rank('l_extendedprice', 'l_shipdate'))} AS price_rank,
  count(*) OVER (PARTITION BY l_shipdate) AS n FROM lineitem""",
)
def rank_in_groups(spark, sf):
    """Average rank of every line's price inside its ship date; the route follows the measured group size."""
    lines = b.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"
    )
    out = add_average_rank(lines, ["l_shipdate"], "l_extendedprice", "price_rank", "n")
    return rounded(out.drop("l_extendedprice", "l_shipdate"))


@query(
    "exact_quantiles",
    f"""SELECT l_returnflag, {r('quantile_cont(l_extendedprice, 0.05)')} AS p05, {r('quantile_cont(l_extendedprice, 0.5)')} AS p50,
  {r('quantile_cont(l_extendedprice, 0.95)')} AS p95 FROM lineitem GROUP BY 1""",
)
def exact_quantiles(spark, sf):
    lines = b.table(spark, sf, "lineitem").select("l_returnflag", "l_extendedprice")
    return rounded(quantiles(lines, ["l_returnflag"], "l_extendedprice", {"p05": 0.05, "p50": 0.5, "p95": 0.95}))


@query(
    "row_positions",
    """SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS place,
  count(*) OVER (PARTITION BY event_type) AS n FROM events""",
)
def row_positions(spark, sf):
    """Place of every event inside its type: five keys hold the whole table."""
    events = b.table(spark, sf, "events").select("event_id", "event_type", "ts")
    return add_position(events, ["event_type"], ["ts", "event_id"], "place", "n").select("event_id", "place", "n")


@query(
    "ewm_long_keys",
    f"""WITH n AS (SELECT event_id, event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i FROM events)
SELECT a.event_id, {r('sum(b.value * CASE WHEN b.i = 1 THEN 1.0 ELSE 1.0 / 3 END * pow(2.0 / 3, a.i - b.i))')} AS value
FROM n a JOIN n b ON a.event_type = b.event_type AND b.i <= a.i AND b.i > a.i - 100 GROUP BY 1""",
)
def ewm_long_keys(spark, sf):
    events = b.table(spark, sf, "events").select("event_id", "event_type", "ts", "value")
    out = add_ewm_mean(events, ["event_type"], ["ts", "event_id"], "value", 1.0 / 3.0, "value")
    return rounded(out.select("event_id", "value"))


# Values on a high level in the first 40 of every 2,000 (mean) or 60 (spread) rows of a type.
_SPARSE = """SELECT event_id, event_type, i, CASE WHEN (i - 1) % {} < 40 THEN value + 1000000 END AS x FROM (
  SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i FROM events)"""


def _sparse_events(spark, sf, every: int):
    events = b.table(spark, sf, "events").select("event_id", "event_type", "ts", "value")
    placed = add_position(events, ["event_type"], ["ts", "event_id"], "i")
    return placed.withColumn("x", F.when((F.col("i") - 1) % every < 40, F.col("value") + 1000000.0))


@query(
    "ewm_null_runs",
    f"""WITH n AS ({_SPARSE.format(2000)}),
v AS (SELECT *, i - lag(i) OVER (PARTITION BY event_type ORDER BY i) AS d FROM n WHERE x IS NOT NULL),
f AS (SELECT *, coalesce(ln(greatest(pow(2.0 / 3, d), 1e-300) / (pow(2.0 / 3, d) + 1.0 / 3)), 0) AS lg,
  CASE WHEN d IS NULL THEN x ELSE x / 3 / (pow(2.0 / 3, d) + 1.0 / 3) END AS part FROM v),
s AS (SELECT *, sum(lg) OVER (PARTITION BY event_type ORDER BY i) AS sc FROM f),
m AS (SELECT a.event_id, sum(z.part * exp(a.sc - z.sc)) AS mean FROM s a JOIN s z ON z.event_type = a.event_type AND z.i <= a.i GROUP BY 1)
SELECT event_id, {r('last_value(mean IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY i)', 4)} AS mean FROM n LEFT JOIN m USING (event_id)""",
)
def ewm_null_runs(spark, sf):
    """Exponential mean over five long keys whose null runs are longer than a chunk: the mean is carried through."""
    placed = _sparse_events(spark, sf, 2000)
    out = add_ewm_mean(placed, ["event_type"], ["i"], "x", 1.0 / 3.0, "mean")
    return rounded(out.select("event_id", "mean"), 4)


@query(
    "ewm_spread_null_runs",
    f"""WITH n AS ({_SPARSE.format(60)}),
p AS (SELECT a.event_id, count(*) AS k, sum(w) AS w, sum(w * w) AS ww, sum(w * (z.x - 1000000)) AS wx, sum(w * (z.x - 1000000) * (z.x - 1000000)) AS wxx
  FROM n a JOIN n z ON z.event_type = a.event_type AND z.i <= a.i AND z.i > a.i - 120, LATERAL (SELECT pow(0.5, a.i - z.i) AS w)
  WHERE a.x IS NOT NULL AND z.x IS NOT NULL GROUP BY 1)
SELECT event_id, {r('CASE WHEN k = 1 THEN 0.0 ELSE sqrt((wxx / w - (wx / w) * (wx / w)) / (1 - ww / (w * w))) END', 4)} AS spread
FROM n LEFT JOIN p USING (event_id)""",
)
def ewm_spread_null_runs(spark, sf):
    """Exponential deviation of values far from 0, over null runs that cross chunks."""
    placed = _sparse_events(spark, sf, 60)
    out = add_ewm_std(placed, ["event_type"], ["i"], "x", 3, "spread")
    return rounded(out.select("event_id", "spread"), 4)
