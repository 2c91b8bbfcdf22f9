"""Registered queries of the models, fits, folds, searches and experiments."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from crosslane.operators import diagnostics as dg
from crosslane.operators import search as se
from crosslane.operators import series_models as sm
from crosslane.operators import trees as tr
from crosslane.operators.features import build_feature_matrix, drop_warmup_rows
from crosslane.operators.gram import collect_grams, gram, solve_nnls, solve_ols, solve_ridge
from crosslane.operators.models import (
    ElasticNetCrossSectional,
    LassoCrossSectional,
    Model,
    ModelConfig,
    OLSCrossSectional,
    RidgeCrossSectional,
    build_model,
    l1_alpha_grid,
    list_model_classes,
    ridge_alpha_grid,
)
from crosslane.plans import binding as b
from crosslane.plans import experiment as ex
from crosslane.plans.catalog import ORACLE, query, rounded, shortened
from crosslane.plans.oracle import BLOCKS, lag, ols_blocks, r, rank_share, with_blocks
from crosslane.session import cut, fresh_path
from crosslane.sources.factors import FACTORS
from crosslane.sources.store import PredictionStore

TWO = ("return_5d", "range_ratio")
FOUR = ("return_5d", "momentum_60", "vol_20", "range_ratio")


def build_ranked(spark, sf):
    """The four features as per-date ranks with the forward return, warm rows only."""
    rows = b.names_bound(spark, sf)
    return drop_warmup_rows(build_feature_matrix(b.bars(spark, sf), FOUR, "rank", 5, rows=rows), FOUR).select(
        "date", "ticker", "adj_close", *FOUR, "y"
    )


ranked = b.once("ranked", ("lineitem", "part"), build_ranked)

BLOCKS["ranks"] = (
    ("matrix",),
    "SELECT date, ticker, adj_close, y, " + ", ".join(f"r_{f} AS {f}" for f in FOUR) + " FROM (SELECT date, ticker, adj_close, y, "
    + ", ".join(f"{rank_share(f)} AS r_{f}" for f in FOUR)
    + " FROM matrix) WHERE " + " AND ".join(f"r_{f} IS NOT NULL" for f in FOUR),
)


# ---- baselines --------------------------------------------------------------------


@query("zero_predictor", with_blocks(("ranks",), "SELECT date, ticker, 0.0::DOUBLE AS prediction FROM ranks"))
def zero_predictor(spark, sf):
    model = build_model("ZeroPredictor", ModelConfig("zero", FOUR)).fit(ranked(spark, sf))
    return model.predict(ranked(spark, sf))


@query("last_return_predictor", with_blocks(("ranks",), f"SELECT date, ticker, {r('return_5d')} AS prediction FROM ranks"))
def last_return_predictor(spark, sf):
    model = build_model("LastReturnPredictor", ModelConfig("last", FOUR)).fit(ranked(spark, sf))
    return rounded(model.predict(ranked(spark, sf)))


@query("momentum_factor", with_blocks(("ranks",), f"SELECT date, ticker, {r('-momentum_60')} AS prediction FROM ranks"))
def momentum_factor(spark, sf):
    config = ModelConfig("mom", FOUR, params={"feature_name": "momentum_60", "sign": -1})
    return rounded(build_model("MomentumFactor", config).fit(ranked(spark, sf)).predict(ranked(spark, sf)))


# ---- linear models ------------------------------------------------------------------

_GRAM2 = """SELECT count(*) AS n, avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my, count(*) * covar_pop(x1, x1) AS a, count(*) * covar_pop(x1, x2) AS c,
  count(*) * covar_pop(x2, x2) AS d, count(*) * covar_pop(x1, y) AS p, count(*) * covar_pop(x2, y) AS q
FROM (SELECT return_5d AS x1, range_ratio AS x2, y FROM ranks WHERE y IS NOT NULL)"""


def _coef_rows(spark, features, coef, intercept):
    rows = [(f, float(c)) for f, c in zip(features, coef, strict=True)] + [("intercept", float(intercept))]
    return spark.createDataFrame(rows, "feature string, coef double")


def _two_sql(extra_diagonal: str) -> str:
    return with_blocks(
        ("ranks",),
        f"""SELECT unnest(['return_5d', 'range_ratio', 'intercept']) AS feature, unnest([{r('b1')}, {r('b2')}, {r('my - m1 * b1 - m2 * b2')}]) AS coef
FROM (SELECT *, (p * dd - q * c) / (aa * dd - c * c) AS b1, (q * aa - p * c) / (aa * dd - c * c) AS b2 FROM (
  SELECT *, a + ({extra_diagonal}) AS aa, d + ({extra_diagonal}) AS dd FROM g))""",
        {"g": _GRAM2},
    )


@query("ols_coefficients", _two_sql("0"))
def ols_coefficients(spark, sf):
    model = OLSCrossSectional(ModelConfig("ols", TWO)).fit(ranked(spark, sf))
    return rounded(_coef_rows(spark, TWO, model.state["coef"], model.state["intercept"]))


@query("ridge_coefficients", _two_sql("1000.0"))
def ridge_coefficients(spark, sf):
    config = ModelConfig("ridge", TWO, params={"alphas": [1000.0]})
    model = RidgeCrossSectional(config).fit(ranked(spark, sf), rows=b.names_bound(spark, sf))
    return rounded(_coef_rows(spark, TWO, model.state["coef"], model.state["intercept"]))


def _descent_sql(shrink: str, l1: str, l2: str) -> str:
    """Coordinate descent on the two-column sums as a recursive statement."""

    def soft(pull: str) -> str:
        return f"(sign({pull}) * greatest(abs({pull}) - {l1}, 0.0))"

    first, second = "(p / n - c / n * b2)", "(q / n - c / n * nb1)"
    return with_blocks(
        ("ranks",),
        f"""SELECT unnest(['return_5d', 'range_ratio', 'intercept']) AS feature, unnest([{r('b1')}, {r('b2')}, {r('my - m1 * b1 - m2 * b2')}]) AS coef
FROM cd, g WHERE step = 400""",
        {
            "g": _GRAM2,
            "cd": f"""SELECT 0 AS step, 0.0::DOUBLE AS b1, 0.0::DOUBLE AS b2 UNION ALL
SELECT step + 1, nb1, {soft(second) if not shrink else f'greatest(0.0, {second})'} / (d / n + {l2}) FROM (
  SELECT step, b2, {soft(first) if not shrink else f'greatest(0.0, {first})'} / (a / n + {l2}) AS nb1 FROM cd, g WHERE step < 400), g""",
        },
        recursive=True,
    )


@query("lasso_coefficients", _descent_sql("", "0.0005", "0.0"))
def lasso_coefficients(spark, sf):
    config = ModelConfig("lasso", TWO, params={"alphas": [0.0005]})
    model = LassoCrossSectional(config).fit(ranked(spark, sf), rows=b.names_bound(spark, sf))
    return rounded(_coef_rows(spark, TWO, model.state["coef"], model.state["intercept"]))


@query("elastic_net_coefficients", _descent_sql("", "0.0005", "0.0005"))
def elastic_net_coefficients(spark, sf):
    config = ModelConfig("enet", TWO, params={"alphas": [0.001], "l1_ratios": [0.5]})
    model = ElasticNetCrossSectional(config).fit(ranked(spark, sf), rows=b.names_bound(spark, sf))
    return rounded(_coef_rows(spark, TWO, model.state["coef"], model.state["intercept"]))


@query("nnls_coefficients", _descent_sql("clip", "0.0", "0.0"))
def nnls_coefficients(spark, sf):
    sums = collect_grams(gram(ranked(spark, sf), TWO, "y", [F.lit(0).alias("g")]), "g")[0]
    coef = solve_nnls(sums)
    return rounded(_coef_rows(spark, TWO, coef, sums.intercept(coef)))


def _shifted(spark, sf):
    """The ranked matrix with its two columns on a level of a million."""
    return ranked(spark, sf).withColumns({f: F.col(f) + 1e6 for f in TWO})


@query(
    "shifted_coefficients",
    with_blocks(
        ("ranks",),
        f"""SELECT kind, unnest(['return_5d', 'range_ratio']) AS feature, unnest([{r('b1')}, {r('b2')}]) AS coef
FROM (SELECT kind, (p * dd - q * c) / (aa * dd - c * c) AS b1, (q * aa - p * c) / (aa * dd - c * c) AS b2 FROM (
  SELECT *, a + x AS aa, d + x AS dd FROM g, (SELECT unnest(['ols', 'ridge']) AS kind, unnest([0.0, 500.0]) AS x)))""",
        {"g": _GRAM2},
    ),
)
def shifted_coefficients(spark, sf):
    """Slopes do not move when a million is added to every column: the sums are centred."""
    sums = collect_grams(gram(_shifted(spark, sf), TWO, "y", [F.lit(0).alias("g")]), "g")[0]
    rows = [(k, f, float(c)) for k, coef in (("ols", solve_ols(sums)), ("ridge", solve_ridge(sums, 500.0))) for f, c in zip(TWO, coef, strict=True)]
    return rounded(spark.createDataFrame(rows, "kind string, feature string, coef double"))


@query(
    "shifted_walk_forward",
    with_blocks(
        ("ranks",),
        f"""SELECT CAST(split AS INT) AS split, unnest(['return_5d', 'range_ratio']) AS feature, unnest([{r('b1')}, {r('b2')}]) AS coef FROM (
  SELECT split, (p * d - q * c) / (a * d - c * c) AS b1, (q * a - p * c) / (a * d - c * c) AS b2 FROM gs)""",
        {
            "sp": """SELECT row_number() OVER (ORDER BY ts) - 1 AS split, ts - 12 AS tend FROM (
  SELECT CAST(unnest(range(s + 730, e + 1, INTERVAL 21 DAY)) AS DATE) AS ts FROM (SELECT min(date) AS s, max(date) AS e FROM ranks))""",
            "gs": """SELECT split, covar_pop(return_5d, return_5d) AS a, covar_pop(return_5d, range_ratio) AS c, covar_pop(range_ratio, range_ratio) AS d,
  covar_pop(return_5d, y) AS p, covar_pop(range_ratio, y) AS q FROM ranks JOIN sp ON date <= tend WHERE y IS NOT NULL GROUP BY 1""",
        },
    ),
)
def shifted_walk_forward(spark, sf):
    """As above for every refit of a walk-forward: merged segments keep their digits too."""
    run = ex.run_walk_forward(_shifted(spark, sf), OLSCrossSectional(ModelConfig("ols", TWO)), 5, _WF, rows=b.names_bound(spark, sf))
    return rounded(run.coefficients.select("split", "feature", "coef"))


@query(
    "ols_predictions",
    with_blocks(
        ("ranks",),
        f"""SELECT date, ticker, {r('my - m1 * b1 - m2 * b2 + b1 * return_5d + b2 * range_ratio')} AS prediction FROM ranks,
  (SELECT *, (p * d - q * c) / (a * d - c * c) AS b1, (q * a - p * c) / (a * d - c * c) AS b2 FROM g)""",
        {"g": _GRAM2},
    ),
)
def ols_predictions(spark, sf):
    model = OLSCrossSectional(ModelConfig("ols", TWO)).fit(ranked(spark, sf))
    return rounded(model.predict(ranked(spark, sf)))


@query(
    "alpha_grids",
    with_blocks(
        ("ranks",),
        f"""SELECT 'l1' AS grid, CAST(i AS INT) AS place, {r('pow(10, log10(t * 0.001) + i * 3.0 / 24)', 8)} AS alpha FROM (
  SELECT greatest(abs(p), abs(q)) / n AS t FROM g), (SELECT unnest(range(0, 25)) AS i)
UNION ALL SELECT 'ridge', CAST(i AS INT), {r('pow(10, -4 + i * 8.0 / 19) * (a + d) / 2', 4)} FROM g, (SELECT unnest(range(0, 20)) AS i)""",
        {"g": _GRAM2},
    ),
)
def alpha_grids(spark, sf):
    sums = collect_grams(gram(ranked(spark, sf), TWO, "y", [F.lit(0).alias("g")]), "g")[0]
    rows = [("l1", i, a) for i, a in enumerate(l1_alpha_grid(sums, 25))]
    rows += [("ridge", i, a) for i, a in enumerate(ridge_alpha_grid(sums, 20))]
    out = spark.createDataFrame(rows, "grid string, place int, alpha double")
    digits = F.when(F.col("grid") == "l1", shortened("alpha", 8)).otherwise(shortened("alpha", 4))
    return out.withColumn("alpha", digits)


@query("lasso_alpha_trace")
def lasso_alpha_trace(spark, sf):
    """Every alpha of the grid with its mean fold IC, and the one that was picked."""
    model = LassoCrossSectional(ModelConfig("lasso", FOUR)).fit(ranked(spark, sf), rows=b.names_bound(spark, sf))
    return model.alpha_trace(spark)


@query("ridge_by_ic")
def ridge_by_ic(spark, sf):
    model = RidgeCrossSectional(ModelConfig("ridge", FOUR)).fit(ranked(spark, sf), rows=b.names_bound(spark, sf))
    return _coef_rows(spark, FOUR, model.state["coef"], model.state["intercept"])


@query("elastic_net_by_ic")
def elastic_net_by_ic(spark, sf):
    config = ModelConfig("enet", FOUR)
    model = ElasticNetCrossSectional(config).fit(ranked(spark, sf), rows=b.names_bound(spark, sf))
    return model.alpha_trace(spark)


@query("grader_comparison")
def grader_comparison(spark, sf):
    return rounded(se.grader_comparison(ranked(spark, sf), FOUR, rows=b.names_bound(spark, sf)))


@query("ablation_grid")
def ablation_grid(spark, sf):
    """Feature subsets x linear models, all from one aggregation."""
    variants = {"all": FOUR, "no_vol": [f for f in FOUR if f != "vol_20"], "two": TWO}
    return rounded(se.ablation(ranked(spark, sf), variants, rows=b.names_bound(spark, sf)))


@query("save_and_load", ORACLE["ols_predictions"])
def save_and_load(spark, sf):
    """Predictions of a model that was saved and read back."""
    model = OLSCrossSectional(ModelConfig("ols", TWO)).fit(ranked(spark, sf))
    path = fresh_path(spark, "model")
    model.save(spark, path)
    return rounded(Model.load(spark, path).predict(ranked(spark, sf)))


@query("model_registry")
def model_registry(spark, sf):
    """Fitted importances of every linear class, by class name."""
    fitted = {
        name: build_model(name, ModelConfig(name, FOUR, params={})).fit(ranked(spark, sf))
        for name in list_model_classes()
        if name in ("OLSCrossSectional", "RidgeCrossSectional", "LassoCrossSectional")
    }
    return rounded(tr.importance_table(spark, fitted))


# ---- walk-forward and experiments -----------------------------------------------------

_WF = {"refit_freq_days": 21, "embargo_days": 12, "min_train_days": 730}


def _run(spark, sf, model, **options):
    return ex.run_walk_forward(ranked(spark, sf), model, 5, {**_WF, **options}, rows=b.names_bound(spark, sf))


@query(
    "walk_forward_ols",
    with_blocks(
        ("ranks",),
        f"""SELECT k.date, k.ticker, CAST(s.split AS INT) AS split, {r('my - m1 * b1 - m2 * b2 + b1 * return_5d + b2 * range_ratio')} AS prediction
FROM ranks k JOIN sp s ON k.date BETWEEN s.ts AND s.te JOIN co USING (split)""",
        {
            "sp": """SELECT row_number() OVER (ORDER BY ts) - 1 AS split, ts, ts - 12 AS tend, least(ts + 20, e) AS te FROM (
  SELECT e, CAST(unnest(range(s + 730, e + 1, INTERVAL 21 DAY)) AS DATE) AS ts FROM (SELECT min(date) AS s, max(date) AS e FROM ranks))""",
            "gs": """SELECT split, count(*) AS n, avg(return_5d) AS m1, avg(range_ratio) AS m2, avg(y) AS my, covar_pop(return_5d, return_5d) AS a,
  covar_pop(return_5d, range_ratio) AS c, covar_pop(range_ratio, range_ratio) AS d, covar_pop(return_5d, y) AS p, covar_pop(range_ratio, y) AS q
  FROM ranks JOIN sp ON date <= tend WHERE y IS NOT NULL GROUP BY 1""",
            "co": "SELECT *, (p * d - q * c) / (a * d - c * c) AS b1, (q * a - p * c) / (a * d - c * c) AS b2 FROM gs",
        },
    ),
)
def walk_forward_ols(spark, sf):
    """All refits from one scan of the matrix."""
    run = _run(spark, sf, OLSCrossSectional(ModelConfig("ols", TWO)))
    return rounded(run.predictions.select("date", "ticker", "split", "prediction"))


@query("walk_forward_lasso_coefficients")
def walk_forward_lasso_coefficients(spark, sf):
    run = _run(spark, sf, LassoCrossSectional(ModelConfig("lasso", FOUR)))
    return rounded(run.coefficients.join(dg.cancellation(run.coefficients), "refit_date"))


_SPLITS = """SELECT row_number() OVER (ORDER BY ts) - 1 AS split, ts, ts - 12 AS tend, least(ts + 20, e) AS te FROM (
  SELECT e, CAST(unnest(range(s + 730, e + 1, INTERVAL 21 DAY)) AS DATE) AS ts FROM (SELECT min(date) AS s, max(date) AS e FROM ranks))"""
_TRAIN_RETURNS = "SELECT date, ticker, ln(adj_close) AS lp, ln(adj_close) - lag(ln(adj_close)) OVER (PARTITION BY ticker ORDER BY date) AS lr FROM ranks WHERE y IS NOT NULL"


def _walk_sql(prediction: str, fit: str, extra: str = "", more: dict[str, str] | None = None) -> str:
    """Every refit by a join of its whole training rows: what the running sums have to equal."""
    return with_blocks(
        ("ranks",),
        f"""SELECT date, ticker, CAST(split AS INT) AS split, {prediction} AS prediction{extra} FROM (
  SELECT k.date, k.ticker, split, f.* EXCLUDE (split, ticker) FROM ranks k JOIN sp ON k.date BETWEEN ts AND te JOIN f USING (split, ticker))""",
        {"sp": _SPLITS, "tr": _TRAIN_RETURNS, **(more or {}), "f": fit},
    )


@query(
    "walk_forward_ar_drift",
    _walk_sql(
        r("p - avg(p) OVER (PARTITION BY date)"),
        """SELECT split, ticker, m * 5 + (last - m) * phi * (1 - pow(phi, 5)) / (1 - phi) AS p FROM (
  SELECT split, ticker, phi, c / (1 - phi) AS m, last FROM (
    SELECT split, ticker, regr_slope(lr, pr) AS phi, regr_intercept(lr, pr) AS c, arg_max(lr, date) FILTER (WHERE lr IS NOT NULL) AS last
    FROM l JOIN sp ON date <= tend GROUP BY 1, 2 HAVING count(lr) >= 252 AND abs(regr_slope(lr, pr)) < 1))""",
        more={"l": "SELECT *, lag(lr) OVER (PARTITION BY ticker ORDER BY date) AS pr FROM tr"},
    ),
)
def walk_forward_ar_drift(spark, sf):
    """The autoregression refitted every 21 days, all refits from one table of running sums."""
    return rounded(_run(spark, sf, build_model("ArDriftPerTicker", ModelConfig("ar", ()))).predictions)


@query(
    "walk_forward_gbm",
    _walk_sql(
        r("p - avg(p) OVER (PARTITION BY date)"),
        """SELECT split, ticker, (avg(lr) - 0.5 * var_samp(lr)) * 5 AS p, 2 * stddev_samp(lr) * sqrt(5.0) AS w
  FROM tr JOIN sp ON date <= tend GROUP BY 1, 2 HAVING count(lr) >= 252""",
        f", {r('p - w')} AS pred_lower, {r('p + w')} AS pred_upper",
    ),
)
def walk_forward_gbm(spark, sf):
    return rounded(_run(spark, sf, build_model("GbmMaximumLikelihood", ModelConfig("gbm", ()))).predictions)


@query(
    "walk_forward_volatility",
    _walk_sql(
        "0.0::DOUBLE",
        """SELECT split, ticker, 2 * sqrt(greatest(5 * tv + (lv - tv) * (ps + ps * ps + pow(ps, 3) + pow(ps, 4) + pow(ps, 5)), 0)) AS w FROM (
  SELECT split, ticker, avg(q) AS tv, arg_max(rec, date) AS lv, CASE WHEN corr(q, q1) > 0 THEN greatest(0.0, least(0.999, corr(q, q2) / corr(q, q1))) ELSE 0.0 END AS ps
  FROM ql JOIN sp ON date <= tend GROUP BY 1, 2 HAVING count(q) >= 252)""",
        f", {r('-w', 5)} AS pred_lower, {r('w', 5)} AS pred_upper",
        {
            "q": "SELECT ticker, date, lr * lr AS q FROM tr WHERE lr IS NOT NULL",
            "ql": f"SELECT *, {lag('q', 1)} AS q1, {lag('q', 2)} AS q2, avg(q) OVER (PARTITION BY ticker ORDER BY date ROWS 19 PRECEDING) AS rec FROM q",
        },
    ),
)
def walk_forward_volatility(spark, sf):
    return rounded(_run(spark, sf, build_model("MomentVolForecaster", ModelConfig("vol", ()))).predictions, 5)


@query("experiment_comparison")
def experiment_comparison(spark, sf):
    """A whole experiment: matrix, walk-forward of three models, store, comparison."""
    spec = {
        "experiment_id": "demo",
        "features": list(FOUR),
        "normalize_kind": "rank",
        "target_horizon": 5,
        "walk_forward": _WF,
        "models": [
            {"id": "zero", "class": "ZeroPredictor"},
            {"id": "ols", "class": "OLSCrossSectional", "features": list(TWO)},
            {"id": "ridge", "class": "RidgeCrossSectional"},
        ],
    }
    store = PredictionStore(spark, fresh_path(spark, "store"))
    result = ex.run_experiment(spark, spec, b.bars(spark, sf), store=store, rows=b.names_bound(spark, sf))
    counts = store.table().groupBy("model_id").agg(F.count(F.lit(1)).alias("n_stored"))
    return rounded(result.summary.join(counts, "model_id"))


# ---- per-ticker models ------------------------------------------------------------------

BLOCKS["lret"] = (("bars",), f"SELECT date, ticker, adj_close, ln(adj_close) - {lag('ln(adj_close)', 1)} AS lr FROM bars")


@query(
    "gbm_drift",
    with_blocks(
        ("lret",),
        f"""SELECT date, ticker, {r('p - avg(p) OVER (PARTITION BY date)')} AS prediction, {r('p - 2 * s * sqrt(5.0)')} AS pred_lower,
  {r('p + 2 * s * sqrt(5.0)')} AS pred_upper FROM (SELECT date, ticker, (mu - 0.5 * s * s) * 5 AS p, s FROM lret JOIN (
  SELECT ticker, avg(lr) AS mu, stddev_samp(lr) AS s FROM lret GROUP BY 1 HAVING count(lr) >= 252) USING (ticker))""",
    ),
)
def gbm_drift(spark, sf):
    model = build_model("GbmMaximumLikelihood", ModelConfig("gbm", ())).fit(b.bars(spark, sf))
    return rounded(model.predict(b.bars(spark, sf)))


@query(
    "ar_drift",
    with_blocks(
        ("lret",),
        f"""SELECT date, ticker, {r('p - avg(p) OVER (PARTITION BY date)')} AS prediction FROM (SELECT date, ticker,
  m * 5 + (last - m) * phi * (1 - pow(phi, 5)) / (1 - phi) AS p FROM lret JOIN (SELECT *, c / (1 - phi) AS m FROM f) USING (ticker))""",
        {
            "l": f"SELECT ticker, date, lr, {lag('lr', 1)} AS pr FROM lret",
            "f": """SELECT ticker, regr_slope(lr, pr) AS phi, regr_intercept(lr, pr) AS c, arg_max(lr, date) FILTER (WHERE lr IS NOT NULL) AS last
  FROM l GROUP BY 1 HAVING count(lr) >= 252 AND abs(regr_slope(lr, pr)) < 1""",
        },
    ),
)
def ar_drift(spark, sf):
    model = build_model("ArDriftPerTicker", ModelConfig("ar", ())).fit(b.bars(spark, sf))
    return rounded(model.predict(b.bars(spark, sf)))


_VOL = {
    "q": "SELECT ticker, date, lr * lr AS q FROM lret WHERE lr IS NOT NULL",
    "ql": f"""SELECT *, {lag('q', 1)} AS q1, {lag('q', 2)} AS q2, avg(q) OVER (PARTITION BY ticker ORDER BY date ROWS 19 PRECEDING) AS rec FROM q""",
    "vf": """SELECT ticker, avg(q) AS tv, arg_max(rec, date) AS lv, CASE WHEN corr(q, q1) > 0 THEN greatest(0.0, least(0.999, corr(q, q2) / corr(q, q1))) ELSE 0.0 END AS ps
  FROM ql GROUP BY 1 HAVING count(q) >= 252""",
}


@query(
    "volatility_band",
    with_blocks(
        ("lret",),
        f"""SELECT date, ticker, 0.0::DOUBLE AS prediction, {r('-w', 5)} AS pred_lower, {r('w', 5)} AS pred_upper FROM (SELECT date, ticker,
  2 * sqrt(greatest(5 * tv + (lv - tv) * (ps + ps * ps + pow(ps, 3) + pow(ps, 4) + pow(ps, 5)), 0)) AS w FROM lret JOIN vf USING (ticker))""",
        _VOL,
    ),
)
def volatility_band(spark, sf):
    model = build_model("MomentVolForecaster", ModelConfig("vol", ())).fit(b.bars(spark, sf))
    return rounded(model.predict(b.bars(spark, sf)), 5)


@query(
    "volatility_half_life",
    with_blocks(
        ("lret",),
        f"SELECT ticker, {r('ps', 5)} AS persistence, {r('CASE WHEN ps > 0 AND ps < 1 THEN -ln(2.0) / ln(ps) END', 3)} AS half_life FROM vf",
        _VOL,
    ),
)
def volatility_half_life(spark, sf):
    model = build_model("MomentVolForecaster", ModelConfig("vol", ())).fit(b.bars(spark, sf))
    out = sm.volatility_half_life(model)
    return out.withColumns({"persistence": shortened("persistence", 5), "half_life": shortened("half_life", 3)})


@query(
    "volatility_paths",
    with_blocks(
        ("lret",),
        f"""SELECT l.date, l.ticker, {r('sqrt(greatest(tv + ps * (avg(lr * lr) OVER w - tv), 0))', 5)} AS model_vol,
  {r('CASE WHEN count(lr) OVER w = 20 THEN stddev_samp(lr) OVER w END', 5)} AS realized_vol
FROM lret l JOIN vf USING (ticker) WINDOW w AS (PARTITION BY l.ticker ORDER BY l.date ROWS 19 PRECEDING)""",
        _VOL,
    ),
)
def volatility_paths(spark, sf):
    model = build_model("MomentVolForecaster", ModelConfig("vol", ())).fit(b.bars(spark, sf))
    return rounded(sm.volatility_paths(b.bars(spark, sf), model), 5)


@query(
    "annualized_stats",
    with_blocks(
        ("lret",),
        f"""SELECT ticker, {r('avg(lr)')} AS mu_daily, {r('stddev_samp(lr)')} AS sigma_daily, {r('avg(lr) * 252')} AS mu_annual,
  {r('stddev_samp(lr) * sqrt(252.0)')} AS sigma_annual, {r('avg(lr) * 252 / (stddev_samp(lr) * sqrt(252.0))')} AS sharpe_annual FROM lret GROUP BY 1""",
    ),
)
def annualized_stats(spark, sf):
    return rounded(sm.annualized_stats(b.bars(spark, sf)))


_ACF = {
    "d": "SELECT ticker, date, lr - avg(lr) OVER (PARTITION BY ticker) AS x, count(*) OVER (PARTITION BY ticker) AS n FROM lret WHERE lr IS NOT NULL",
    "o": "SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) AS i FROM d",
    "acf": """SELECT a.ticker, CAST(k AS INT) AS lag, sum(a.x * z.x) / max(v) AS acf, max(a.n) AS n FROM o a, (SELECT unnest(range(1, 31)) AS k)
  JOIN o z ON z.ticker = a.ticker AND z.i = a.i - k JOIN (SELECT ticker, sum(x * x) AS v FROM o GROUP BY 1) s ON s.ticker = a.ticker GROUP BY 1, 2""",
}


@query("autocorrelation", with_blocks(("lret",), f"SELECT ticker, lag, {r('acf')} AS acf, n FROM acf", _ACF))
def autocorrelation(spark, sf):
    return rounded(sm.autocorrelation(b.bars(spark, sf), 30))


@query(
    "ljung_box",
    with_blocks(
        ("lret",),
        f"""SELECT ticker, h AS lags, {r('max(n) * (max(n) + 2) * sum(acf * acf / (n - lag))', 4)} AS q FROM acf, (SELECT unnest([10, 20]) AS h)
WHERE lag <= h GROUP BY 1, 2""",
        _ACF,
    ),
)
def ljung_box(spark, sf):
    return rounded(sm.ljung_box(sm.autocorrelation(b.bars(spark, sf), 30)), 4)


def _adf_sql(series: str, x: str) -> str:
    return f"""SELECT '{series}' AS series, ticker, n, {r('t', 4)} AS adf_stat, t < -2.86 AS stationary_5pct FROM (
  SELECT ticker, n, (p * d - q * c) / (a * d - c * c) / sqrt(n * (v - (p * (p * d - q * c) + q * (q * a - p * c)) / (a * d - c * c)) / (n - 3) * d / (n * (a * d - c * c))) AS t
  FROM (SELECT ticker, count(*) AS n, var_pop(dy) AS v, covar_pop(l, l) AS a, covar_pop(l, dl) AS c, covar_pop(dl, dl) AS d, covar_pop(l, dy) AS p, covar_pop(dl, dy) AS q
    FROM (SELECT *, {lag('dy', 1)} AS dl FROM (SELECT ticker, date, {x} - {lag(x, 1)} AS dy, {lag(x, 1)} AS l FROM lret WHERE {x} IS NOT NULL))
    WHERE dl IS NOT NULL GROUP BY 1))"""


@query("adf_statistic", with_blocks(("lret",), f"{_adf_sql('price', 'adj_close')} UNION ALL {_adf_sql('return', 'lr')}"))
def adf_statistic(spark, sf):
    prices = sm.adf_statistic(b.bars(spark, sf), "adj_close").withColumn("series", F.lit("price"))
    returns = sm.adf_statistic(sm.add_log_return(b.bars(spark, sf)), "log_return").withColumn("series", F.lit("return"))
    return rounded(prices.unionByName(returns), 4)


# ---- factor models ------------------------------------------------------------------------


_BETAS = [f"b{i}" for i in range(len(FACTORS))]
_EXCESS = f"SELECT date, ticker, lr - RF AS e, {', '.join(FACTORS)} FROM lret JOIN factors USING (date) WHERE lr IS NOT NULL"


@query(
    "fama_macbeth",
    with_blocks(
        ("lret", "factors"),
        f"SELECT date, ticker, {r('5 * (daily - avg(daily) OVER (PARTITION BY date))')} AS prediction FROM bars JOIN dl USING (ticker)",
        {
            "ex": _EXCESS,
            **ols_blocks("ld", "ex", ["ticker"], FACTORS, "e", "count(*) >= 252"),
            "ft": f"SELECT date, ticker, e, {', '.join(_BETAS)} FROM ex JOIN ld USING (ticker)",
            "rc": "SELECT * FROM ft WHERE date IN (SELECT DISTINCT date FROM ft ORDER BY date DESC LIMIT 60)",
            **ols_blocks("pr", "rc", ["date"], _BETAS, "e", f"count(*) >= {len(FACTORS)}"),
            "dl": f"SELECT ticker, {' + '.join(f'ld.{x} * l.{x}' for x in _BETAS)} AS daily FROM ld, (SELECT {', '.join(f'avg({x}) AS {x}' for x in _BETAS)} FROM pr) l",
        },
    ),
)
def fama_macbeth(spark, sf):
    model = sm.FamaFrenchFactorModel(ModelConfig("ff", ())).fit(b.bars(spark, sf), b.factors(spark, sf))
    return rounded(model.predict(b.bars(spark, sf)))


def _loadings(spark, sf):
    return sm.factor_loadings(b.bars(spark, sf), b.factors(spark, sf), 252)


_NAMED = {f"beta_{f}": x for f, x in zip(FACTORS, _BETAS, strict=True)}
_LOADINGS = {
    "ex": _EXCESS,
    "late": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS k FROM ex) WHERE k <= 252",
    **ols_blocks("fl", "late", ["ticker"], FACTORS, "e", "count(*) >= 60"),
    "vol": "SELECT *, sqrt(sse / (n - 1) * 252) AS idio_vol_ann FROM fl",
    "w": "SELECT DISTINCT ticker, 1.0 / (SELECT count(DISTINCT ticker) FROM bars) AS weight FROM bars",
}


def _loadings_sql(query_text: str, **extra: str) -> str:
    return with_blocks(("lret", "factors"), query_text, {**_LOADINGS, **extra})


@query(
    "factor_loadings",
    _loadings_sql(
        f"SELECT ticker, {r('a')} AS alpha_daily, {', '.join(f'{r(x)} AS {k}' for k, x in _NAMED.items())}, {r('r2')} AS r2, "
        f"{r('idio_vol_ann')} AS idio_vol_ann, n FROM vol"
    ),
)
def factor_loadings(spark, sf):
    return rounded(_loadings(spark, sf))


@query(
    "single_factor_loading",
    with_blocks(
        ("lret", "factors"),
        f"""SELECT ticker, {r('a', 5)} AS alpha_daily, {r('be', 5)} AS beta_MKT_RF, {r('r2')} AS r2, {r('sqrt((1 - r2) * v * n / (n - 1) * 252)', 5)} AS idio_vol_ann, n
FROM (SELECT ticker, regr_intercept(e, MKT_RF) AS a, regr_slope(e, MKT_RF) AS be, regr_r2(e, MKT_RF) AS r2, var_pop(e) AS v, count(*) AS n
  FROM (SELECT ticker, lr - RF AS e, MKT_RF, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS k FROM lret JOIN factors USING (date) WHERE lr IS NOT NULL)
  WHERE k <= 252 GROUP BY 1) WHERE n >= 60""",
    ),
)
def single_factor_loading(spark, sf):
    out = sm.factor_loadings(b.bars(spark, sf), b.factors(spark, sf), 252, names=("MKT_RF",))
    digits = {"alpha_daily": 5, "beta_MKT_RF": 5, "r2": 6, "idio_vol_ann": 5}
    return out.withColumns({c: shortened(c, d) for c, d in digits.items()})


def _weights(spark, sf):
    """Every brand with the same weight."""
    names = b.bars(spark, sf).select("ticker").distinct()
    return names.withColumn("weight", F.lit(1.0 / max(1, names.count())))


_EXPOSED = f"SELECT {', '.join(f'sum({x} * weight) AS {x}' for x in _BETAS)}, sum(a * weight) * 252 AS alpha FROM fl JOIN w USING (ticker)"


@query(
    "portfolio_exposure",
    _loadings_sql(f"SELECT {', '.join(f'{r(x)} AS {k}' for k, x in _NAMED.items())}, {r('alpha')} AS alpha_ann FROM xp", xp=_EXPOSED),
)
def portfolio_exposure(spark, sf):
    return rounded(sm.portfolio_exposure(_loadings(spark, sf), _weights(spark, sf)))


_VIA = {f"via_{f}": f"{f} * {x}" for f, x in zip(FACTORS, _BETAS, strict=True)}


@query(
    "realized_attribution",
    _loadings_sql(
        " UNION ALL ".join(
            f"SELECT '{c}' AS component, {r(f'sum({c})')} AS total FROM dy" for c in ["portfolio", "RF", "excess", *_VIA, "factor_total", "residual"]
        ),
        xp=_EXPOSED,
        held="""SELECT date, sum(lr * weight) AS portfolio FROM lret JOIN w USING (ticker)
  WHERE lr IS NOT NULL AND date IN (SELECT DISTINCT date FROM lret WHERE lr IS NOT NULL ORDER BY date DESC LIMIT 1000)
  GROUP BY 1 HAVING count(*) = (SELECT count(*) FROM w)""",
        dy=f"""SELECT date, portfolio, RF, portfolio - RF AS excess, {', '.join(f'{v} AS {k}' for k, v in _VIA.items())},
  {' + '.join(_VIA.values())} AS factor_total, portfolio - RF - ({' + '.join(_VIA.values())}) AS residual FROM held JOIN factors USING (date), xp""",
    ),
)
def realized_attribution(spark, sf):
    exposure = sm.portfolio_exposure(_loadings(spark, sf), _weights(spark, sf)).first()
    betas = {f: exposure[f"beta_{f}"] for f in FACTORS}
    daily = sm.realized_attribution(b.bars(spark, sf), b.factors(spark, sf), _weights(spark, sf), betas, 1000)
    return rounded(sm.attribution_totals(daily))


@query(
    "risk_concentration",
    _loadings_sql(
        f"""SELECT ticker, {r('weight')} AS weight, {r('idio_vol_ann')} AS idio_vol_ann, {r('v')} AS idio_var, {r('v / sum(v) OVER () * 100.0')} AS share_pct
FROM (SELECT *, pow(weight * idio_vol_ann, 2) AS v FROM vol JOIN w USING (ticker))"""
    ),
)
def risk_concentration(spark, sf):
    return rounded(sm.risk_concentration(_loadings(spark, sf), _weights(spark, sf)))


# ---- residual reports -----------------------------------------------------------------------


def _scored(spark, sf):
    """OLS on the first part of the dates, residuals on the rest."""
    train = ranked(spark, sf).where(F.col("date") < "1999-01-01")
    test = ranked(spark, sf).where((F.col("date") >= "1999-01-01") & F.col("y").isNotNull())
    model = OLSCrossSectional(ModelConfig("ols", TWO)).fit(train)
    scored = test.join(model.predict(test), ["date", "ticker"])
    return scored.withColumn("residual", F.col("y") - F.col("prediction"))


BLOCKS["scored"] = (
    ("ranks",),
    """SELECT k.*, my - m1 * b1 - m2 * b2 + b1 * return_5d + b2 * range_ratio AS fitted, y - (my - m1 * b1 - m2 * b2 + b1 * return_5d + b2 * range_ratio) AS residual
FROM ranks k, (SELECT *, (p * d - q * c) / (a * d - c * c) AS b1, (q * a - p * c) / (a * d - c * c) AS b2 FROM (
  SELECT avg(return_5d) AS m1, avg(range_ratio) AS m2, avg(y) AS my, covar_pop(return_5d, return_5d) AS a, covar_pop(return_5d, range_ratio) AS c,
    covar_pop(range_ratio, range_ratio) AS d, covar_pop(return_5d, y) AS p, covar_pop(range_ratio, y) AS q FROM ranks WHERE y IS NOT NULL AND date < DATE '1999-01-01'))
WHERE date >= DATE '1999-01-01' AND y IS NOT NULL""",
)


@query(
    "residual_report",
    with_blocks(
        ("scored",),
        f"""SELECT n, {r('1 - s2 / (n * vy)')} AS r2, {r('(s3 / n - 3 * m * s2 / n + 2 * m * m * m) / pow(s2 / n - m * m, 1.5)', 5)} AS skewness,
  {r('(s4 / n - 4 * m * s3 / n + 6 * m * m * s2 / n - 3 * pow(m, 4)) / pow(s2 / n - m * m, 2)', 5)} AS kurtosis, {r('dw / s2')} AS durbin_watson
FROM (SELECT count(*) AS n, avg(residual) AS m, sum(residual * residual) AS s2, sum(pow(residual, 3)) AS s3, sum(pow(residual, 4)) AS s4, var_pop(y) AS vy,
  sum(st * st) AS dw FROM (SELECT *, residual - lag(residual) OVER (ORDER BY ticker, date) AS st FROM scored))""",
    ),
)
def residual_report(spark, sf):
    out = dg.residual_report(_scored(spark, sf))
    digits = {"r2": 6, "skewness": 5, "kurtosis": 5, "durbin_watson": 6}
    return out.withColumns({c: shortened(c, d) for c, d in digits.items()})


@query(
    "heteroskedasticity",
    with_blocks(
        ("scored",),
        f"""SELECT n, {r('n * (p * (p * d - q * c) + q * (q * a - p * c)) / (a * d - c * c) / v', 4)} AS breusch_pagan_lm FROM (
  SELECT count(*) AS n, var_pop(e) AS v, covar_pop(return_5d, return_5d) AS a, covar_pop(return_5d, range_ratio) AS c, covar_pop(range_ratio, range_ratio) AS d,
    covar_pop(return_5d, e) AS p, covar_pop(range_ratio, e) AS q FROM (SELECT *, residual * residual AS e FROM scored))""",
    ),
)
def heteroskedasticity(spark, sf):
    out = dg.heteroskedasticity(_scored(spark, sf), TWO)
    frame = spark.createDataFrame([(out["n"], out["breusch_pagan_lm"])], "n bigint, breusch_pagan_lm double")
    return rounded(frame, 4)


_SQUARES = [f"{x} * {z}" for i, x in enumerate(FOUR) for z in FOUR[i:]]


@query(
    "white_statistic",
    with_blocks(
        ("scored",),
        f"SELECT bp.n, {r('bp.n * bp.r2', 4)} AS breusch_pagan_lm, {r('wh.n * wh.r2', 4)} AS white_lm FROM bp, wh",
        {
            "sq": f"SELECT {', '.join(FOUR)}, {', '.join(f'{q} AS q{i}' for i, q in enumerate(_SQUARES))}, residual * residual AS e2 FROM scored",
            **ols_blocks("bp", "sq", [], FOUR, "e2"),
            **ols_blocks("wh", "sq", [], [*FOUR, *(f"q{i}" for i in range(len(_SQUARES)))], "e2"),
        },
    ),
)
def white_statistic(spark, sf):
    out = dg.heteroskedasticity(_scored(spark, sf), FOUR)
    return rounded(spark.createDataFrame([tuple(out.values())], "n bigint, breusch_pagan_lm double, white_lm double"), 4)


@query(
    "residual_spread_by_decile",
    with_blocks(
        ("scored",),
        f"""SELECT CAST(bucket AS INT) AS bucket, count(*) AS n, {r('stddev_samp(residual)')} AS std FROM (
  SELECT residual, len(list_filter(list_distinct(q), lambda e: adj_close > e)) AS bucket FROM scored, (
    SELECT quantile_cont(adj_close, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS q FROM scored)) GROUP BY 1""",
    ),
)
def residual_spread_by_decile(spark, sf):
    """Residual deviation by price decile (a rank feature has few distinct values)."""
    return rounded(dg.spread_by_quantile(_scored(spark, sf), "residual", "adj_close", 10))


@query(
    "residual_outliers",
    with_blocks(
        ("scored",),
        f"""SELECT date, ticker, {r('residual')} AS residual, {r('exp(y) - 1')} AS implied_move FROM scored ORDER BY abs(residual) DESC, ticker, date LIMIT 25""",
    ),
)
def residual_outliers(spark, sf):
    out = dg.residual_outliers(_scored(spark, sf), 25)
    return rounded(out.select("date", "ticker", "residual", "implied_move"))


@query(
    "outlier_spans",
    with_blocks(
        ("scored",),
        """SELECT ticker, min(date) AS first_date, max(date) AS last_date, count(*) AS n FROM (
  SELECT * FROM scored ORDER BY abs(residual) DESC, ticker, date LIMIT 25) GROUP BY 1""",
    ),
)
def outlier_spans(spark, sf):
    return dg.outlier_spans(dg.residual_outliers(_scored(spark, sf), 25))


# ---- trees ----------------------------------------------------------------------------------

# The operators' own defaults but for the rounds: 500 take minutes each on a test host (README, "Measured").
_ROUNDS = {"n_estimators": 30}


def _trees(name: str, **params):
    def run(spark, sf):
        train = ranked(spark, sf).where(F.col("date") < "1999-01-01")
        test = ranked(spark, sf).where(F.col("date") >= "1999-01-01")
        model = build_model(name, ModelConfig(name, FOUR, params={**_ROUNDS, **params})).fit(train)
        return rounded(model.predict(test))

    return run


query("boosted_trees_leafwise")(_trees("LeafwiseBoosting", seeds=[1, 2]))
query("boosted_trees_depthwise")(_trees("DepthwiseBoosting"))
query("boosted_trees_symmetric")(_trees("SymmetricBoosting", early_stopping_rounds=8, val_fraction=0.2, learning_rate=0.1))
query("forest")(_trees("ForestCrossSectional"))


@query("boosting_curve")
def boosting_curve(spark, sf):
    """Validation score after every round on the last fifth of the dates, and the rounds that are kept."""
    params = {**_ROUNDS, "n_estimators": 40, "early_stopping_rounds": 5, "val_fraction": 0.2, "learning_rate": 0.2}
    model = build_model("LeafwiseBoosting", ModelConfig("leaf", FOUR, params=params)).fit(ranked(spark, sf))
    return rounded(model.curve(spark), 8)


@query("boosting_curve_weighted")
def boosting_curve_weighted(spark, sf):
    """As above, weighted by row and stopped by the weighted score of scored tables."""
    params = {**_ROUNDS, "early_stopping_rounds": 5, "val_fraction": 0.2, "metric": "weighted_score", "weight_col": "w"}
    data = ranked(spark, sf).withColumn("w", F.col("adj_close"))
    model = build_model("DepthwiseBoosting", ModelConfig("deep", FOUR, params=params)).fit(data)
    return rounded(model.curve(spark), 8)


@query("tree_importance")
def tree_importance(spark, sf):
    model = build_model("LeafwiseBoosting", ModelConfig("leaf", FOUR, params=_ROUNDS)).fit(ranked(spark, sf))
    return rounded(tr.importance_table(spark, {"leaf": model}))


@query("tree_sweep")
def tree_sweep(spark, sf):
    """A random search of 40 trials over purged folds: every parameter as drawn, the rounds out of a smaller range."""
    trials = se.draw_params({**se.TREE_SPACES["LeafwiseBoosting"], "n_estimators": (2, 8, "int")})
    data = se.confine(ranked(spark, sf), date(2000, 1, 1))
    return rounded(se.sweep(data, "LeafwiseBoosting", FOUR, trials, 2, 21, rows=b.names_bound(spark, sf), parallel=6))


@query("sweep_overview")
def sweep_overview(spark, sf):
    """Linear sweep results next to the scores of the models they belong to."""
    data, rows = ranked(spark, sf), b.names_bound(spark, sf)
    fitted = {
        "lasso": LassoCrossSectional(ModelConfig("lasso", FOUR)).fit(data, rows=rows),
        "ridge": RidgeCrossSectional(ModelConfig("ridge", FOUR)).fit(data, rows=rows),
    }
    frames, sweeps = None, None
    for name, model in fitted.items():
        part = ex.join_realized(model.predict(data), data).withColumn("model_id", F.lit(name))
        frames = part if frames is None else frames.unionByName(part)
        trace = model.alpha_trace(spark).withColumn("model_id", F.lit(name))
        sweeps = trace if sweeps is None else sweeps.unionByName(trace)
    scores = ex.compare_models(cut(frames, "scores"), rows=rows)
    return rounded(se.sweep_overview(sweeps, scores))


