from datetime import date

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from crosslane.operators import folds as fo
from crosslane.operators import gram as gr
from crosslane.operators import models
from crosslane.operators import search as se
from crosslane.operators import series_models as sm
from crosslane.operators import staged as st
from crosslane.operators.features import build_feature_matrix, drop_warmup_rows
from crosslane.operators.models import (
    DateGrams,
    LassoCrossSectional,
    Model,
    ModelConfig,
    OLSCrossSectional,
    RidgeCrossSectional,
    Rule,
    build_model,
    l1_alpha_grid,
    list_model_classes,
    register_model,
    ridge_alpha_grid,
    score_rules,
)
from crosslane.operators.trees import LeafwiseBoosting, prepared
from crosslane.plans import experiment as ex
from crosslane.session import fresh_path
from crosslane.sources.store import PredictionStore
from tests.conftest import make_panel, noise

X = ("x1", "x2", "x3")


@pytest.fixture(scope="module")
def train(spark):
    """y = 2 x1 - x2 + noise; x3 is idle."""
    base = spark.range(80 * 25).select(
        F.date_add(F.lit("2022-01-03").cast("date"), F.floor(F.col("id") / 25).cast("int")).alias("date"),
        F.concat(F.lit("T"), F.lpad((F.col("id") % 25).cast("string"), 2, "0")).alias("ticker"),
    )
    cols = {x: noise(i, "date", "ticker") for i, x in enumerate(X)}
    df = base.withColumns(cols).withColumn("y", 2 * F.col("x1") - F.col("x2") + 0.5 * (noise(9, "date", "ticker") - 0.5))
    return df.cache()


@pytest.fixture(scope="module")
def arrays(train):
    pdf = train.orderBy("date", "ticker").toPandas()
    return pdf[list(X)].to_numpy(), pdf["y"].to_numpy(), pdf


def _gram(train):
    return gr.collect_grams(gr.gram(train, X, "y", [F.lit(0).alias("g")]), "g")[0]


def test_closed_forms(train, arrays):
    x, y, _ = arrays
    g = _gram(train)
    xc, yc = x - x.mean(0), y - y.mean()
    np.testing.assert_allclose(gr.solve_ols(g), np.linalg.lstsq(xc, yc, rcond=None)[0], rtol=1e-8)
    want = np.linalg.solve(xc.T @ xc + 50 * np.eye(3), xc.T @ yc)
    np.testing.assert_allclose(gr.solve_ridge(g, 50.0), want, rtol=1e-8)
    coef = gr.solve_ols(g)
    pred = x @ coef + g.intercept(coef)
    assert g.squared_error(coef, g.intercept(coef)) == pytest.approx(((y - pred) ** 2).sum())


def test_l1_meets_its_optimality_conditions(train, arrays):
    x, y, _ = arrays
    g, alpha, ratio = _gram(train), 0.05, 0.7
    w = gr.solve_l1(g, alpha, ratio)
    xc, yc = x - x.mean(0), y - y.mean()
    slope = xc.T @ (yc - xc @ w) / len(y) - alpha * (1 - ratio) * w
    for j in range(3):
        if w[j] != 0:
            assert slope[j] == pytest.approx(alpha * ratio * np.sign(w[j]), abs=1e-8)
        else:
            assert abs(slope[j]) <= alpha * ratio + 1e-9
    assert np.count_nonzero(gr.solve_l1(g, l1_alpha_grid(g, 5)[-1] * 1.001)) == 0


def test_nnls_conditions(train, arrays):
    x, y, _ = arrays
    w = gr.solve_nnls(_gram(train))
    xc, yc = x - x.mean(0), y - y.mean()
    slope = xc.T @ (yc - xc @ w)
    assert w[1] == 0 and (w >= 0).all()
    assert abs(slope[0]) < 1e-6 and slope[1] < 0


@pytest.mark.parametrize("level", [1e6, 1e7])
def test_large_levels_do_not_move_the_slopes(spark, level):
    base = spark.range(10_000).select(
        (noise(1, "id") * 3.4).alias("x1"), (noise(2, "id") - 0.5).alias("x2"), (F.col("id") % 7).alias("part")
    ).withColumn("y", 0.5 * F.col("x1") - F.col("x2") + noise(3, "part", "x1"))
    moved = base.withColumns({"x1": F.col("x1") + level, "y": F.col("y") - level})
    want, got = (gr.collect_grams(gr.gram(d, ["x1", "x2"], "y", ["part"]), "part") for d in (base, moved))
    np.testing.assert_allclose(gr.solve_ols(got[3]), gr.solve_ols(want[3]), rtol=1e-7)
    both = [sum(g.values(), gr.Gram.zero(2)) for g in (want, got)]
    whole = gr.collect_grams(gr.gram(moved, ["x1", "x2"], "y", [F.lit(0).alias("g")]), "g")[0]
    for solve in (gr.solve_ols, lambda g: gr.solve_ridge(g, 3.0), lambda g: gr.solve_l1(g, 0.01), lambda g: gr.solve_nnls(g)):
        np.testing.assert_allclose(solve(both[1]), solve(both[0]), rtol=1e-7, atol=1e-9)
        np.testing.assert_allclose(solve(whole), solve(both[0]), rtol=1e-7, atol=1e-9)
    by_group = gr.ols_by_group(gr.gram(moved, ["x1", "x2"], "y", ["part"]), "part bigint", ["x1", "x2"]).orderBy("part").toPandas()
    for part, g in want.items():
        np.testing.assert_allclose(by_group.loc[part, ["x1", "x2"]].astype(float), gr.solve_ols(g), rtol=1e-7)


def test_states_merge_in_any_order(train):
    parts = gr.collect_grams(gr.gram(train.withColumn("k", F.dayofmonth("date") % 5), X, "y", ["k"]), "k")
    there = sum(parts.values(), gr.Gram.zero(3))
    back = sum(reversed(parts.values()), gr.Gram.zero(3))
    whole = _gram(train)
    for name in ("n", "x_mean", "y_mean", "cxx", "cxy", "cyy"):
        np.testing.assert_allclose(getattr(there, name), getattr(whole, name), rtol=1e-10, atol=1e-10)
        np.testing.assert_allclose(getattr(back, name), getattr(whole, name), rtol=1e-10, atol=1e-10)
    assert (gr.Gram.zero(3) + gr.Gram.zero(3)).n == 0


def test_grids(train, arrays):
    x, y, _ = arrays
    g = _gram(train)
    xc, yc = x - x.mean(0), y - y.mean()
    grid = l1_alpha_grid(g, 10, 1e-3)
    assert grid[-1] == pytest.approx(np.abs(xc.T @ yc).max() / len(y)) and grid[0] == pytest.approx(grid[-1] * 1e-3)
    ridge = ridge_alpha_grid(g, 9)
    assert ridge[4] == pytest.approx((xc * xc).sum() / 3)


def test_date_grams_add_up(train):
    index = fo.date_index(train)
    sums = DateGrams(train, X, "y", index, [10, 30, 55, 80])
    part = sums.span(10, 55)
    want = _gram(train.join(index.where("idx >= 10 and idx < 55"), "date", "left_semi"))
    assert part.n == want.n
    np.testing.assert_allclose(part.sxx, want.sxx)
    np.testing.assert_allclose(part.only([0, 2]).sxy, want.sxy[[0, 2]])


def test_alpha_selection_against_loop(train, arrays):
    _, _, pdf = arrays
    model = LassoCrossSectional(ModelConfig("l", X, params={"alphas": [0.3, 0.1, 0.01, 0.001], "cv_embargo": 3})).fit(train, rows=25)
    days = np.sort(pdf["date"].unique())
    scores = []
    for alpha in (0.3, 0.1, 0.01, 0.001):
        fold_ics = []
        for f in fo.chain_folds(len(days), 3, 3):
            tr, va = pdf[pdf["date"].isin(days[: f.train_to])], pdf[pdf["date"].isin(days[f.val_from : f.val_to])]
            x, y = tr[list(X)].to_numpy(), tr["y"].to_numpy()
            rows = {"n": len(y), "sx": x.sum(0), "sxx": [(x[:, i] * x[:, j]).sum() for i in range(3) for j in range(i, 3)], "sxy": x.T @ y, "sy": y.sum(), "syy": (y * y).sum()}
            w = gr.solve_l1(gr.Gram.from_row(rows), alpha)
            ics = []
            for _, g in va.groupby("date"):
                p = (g[list(X)].to_numpy() @ w).round(14)
                if np.ptp(p) > 0:
                    ics.append(g.assign(p=p)["p"].rank().corr(g["y"].rank()))
            if ics:
                fold_ics.append(np.mean(ics))
        scores.append(np.mean(fold_ics) if fold_ics else None)
    got = [s for _, s in model.choices[0].table]
    for a, z in zip(got, scores, strict=True):
        assert (a is None and z is None) or a == pytest.approx(z, abs=1e-9)
    trace = model.alpha_trace(train.sparkSession).collect()
    assert sum(r["selected"] for r in trace) == 1 and trace[0]["selected"]


def test_selection_without_scores_takes_the_smallest_alpha(train):
    model = LassoCrossSectional(ModelConfig("l", X, params={"alphas": [90.0, 50.0], "cv_embargo": 3})).fit(train, rows=25)
    assert model.selected_alpha() == 50.0 and model.state["coef"] == [0.0, 0.0, 0.0]


def test_graders_agree_on_clean_data(train):
    out = se.grader_comparison(train, X, rows=25).toPandas().set_index("arm")
    assert (out["ic"] > 0.7).all() and set(out.index) == {"lasso_mse", "lasso_ic", "ridge_mse", "ridge_ic"}


def test_no_intercept_and_null_features(train):
    ols = OLSCrossSectional(ModelConfig("o", X, params={"fit_intercept": False})).fit(train)
    assert ols.state["intercept"] == 0.0
    gap = train.limit(1).withColumn("x1", F.lit(None).cast("double"))
    row, p = gap.first(), ols.predict(gap).first()["prediction"]
    assert p == pytest.approx(row["x2"] * ols.state["coef"][1] + row["x3"] * ols.state["coef"][2])


def test_registry_and_round_trip(spark, train):
    assert {"ZeroPredictor", "OLSCrossSectional", "LassoCrossSectional", "GbmMaximumLikelihood", "LeafwiseBoosting"} <= set(list_model_classes())
    with pytest.raises(KeyError):
        build_model("Nothing", ModelConfig("n", ()))
    with pytest.raises(RuntimeError):
        RidgeCrossSectional(ModelConfig("r", X)).predict(train)
    with pytest.raises(ValueError):
        register_model(type("OLSCrossSectional", (Model,), {}))
    with pytest.raises(ValueError):
        OLSCrossSectional(ModelConfig("o", X)).fit(train.where("x1 > 9"))
    model = RidgeCrossSectional(ModelConfig("r", X, params={"cv_embargo": 3})).fit(train, rows=25)
    path = fresh_path(spark, "model")
    model.save(spark, path)
    again = Model.load(spark, path)
    assert again.feature_importance() == model.feature_importance() and again.config == model.config
    a, z = (m.predict(train).orderBy("date", "ticker").toPandas()["prediction"] for m in (model, again))
    np.testing.assert_array_equal(a, z)
    assert all(c != 0 for c in model.state["coef"])


def test_momentum_factor_rules(train):
    def make(**p):
        return build_model("MomentumFactor", ModelConfig("m", X, params=p))

    for bad in ({}, {"feature_name": "zz"}, {"feature_name": "x1", "sign": 2}):
        with pytest.raises(ValueError):
            make(**bad).fit(train)
    model = make(feature_name="x2", sign=-1).fit(train)
    row = train.orderBy("date", "ticker").first()
    assert model.predict(train).orderBy("date", "ticker").first()["prediction"] == -row["x2"]
    assert model.feature_importance() == {"x2": -1.0}


def test_trees(spark, train):
    p = {"n_estimators": 5, "max_depth": 3, "min_data_in_leaf": 10, "seeds": [1, 2], "early_stopping_rounds": 3, "val_fraction": 0.2}
    model = LeafwiseBoosting(ModelConfig("t", X, params=p)).fit(train)
    assert len(model.boosters) == 2 and model.params["min_rows_leaf"] == 10
    gain = model.feature_importance()
    assert gain["x1"] > gain["x3"]
    path = fresh_path(spark, "trees")
    model.save(spark, path)
    again = LeafwiseBoosting.load(spark, path)
    a, z = (m.predict(train).orderBy("date", "ticker").toPandas()["prediction"] for m in (model, again))
    np.testing.assert_allclose(a, z)


def _plain_rounds(model, held, score):
    """Scores of every prefix of an ensemble, one prediction pass per prefix."""
    out = []
    for n in range(1, model.getNumTrees + 1):
        p = st.shortened_model(model, n).transform(held).select("y", "w", "prediction").toPandas()
        out.append(score(p["y"].to_numpy(), p["prediction"].to_numpy(), p["w"].to_numpy()))
    return out


def test_round_scores_equal_prefix_predictions(spark, train):
    from pyspark.ml.regression import GBTRegressor

    rows = prepared(train.withColumn("w", F.abs("x2") + 0.1), list(X), "y", "date", "w").persist()
    fit, held = fo.split_by_fraction(rows, 0.25)
    model = GBTRegressor(featuresCol="_features", labelCol="y", maxIter=9, maxDepth=3, stepSize=0.4, seed=5).fit(fit)
    rmse = st.round_scores(model, held, "y", st.METRICS["rmse"])
    np.testing.assert_allclose(rmse, _plain_rounds(model, held, lambda y, p, w: -np.sqrt(((y - p) ** 2).mean())), rtol=1e-9)
    weighted = st.round_scores(model, held, "y", st.METRICS["weighted_score"], "w")
    want = _plain_rounds(model, held, lambda y, p, w: np.sqrt(1 - np.clip((w * (y - p) ** 2).sum() / (w * y * y).sum(), 0, 1)))
    np.testing.assert_allclose(weighted, want, rtol=1e-9)
    with pytest.raises(ValueError, match="held-out"):
        st.round_scores(model, held.where("false"), "y", st.METRICS["rmse"])
    rows.unpersist()


@pytest.mark.parametrize(
    ("scores", "patience", "kept"),
    [([1.0], 3, 1), ([1, 2, 3, 4], 2, 4), ([1, 3, 2, 2, 9], 2, 2), ([1, 3, 2, 2, 9], 3, 5), ([5, 5, 5, 5], 2, 1), ([1, 2, 1, 3, 1, 1], 2, 4)],
)
def test_best_round(scores, patience, kept):
    assert st.best_round(np.array(scores, dtype=float), patience) == kept


def test_stopping_cuts_the_ensemble_by_a_callers_metric(spark, train, monkeypatch):
    """A metric that is best after three rounds: the sum of absolute predictions against a fixed level."""
    level = {}
    monkeypatch.setitem(
        st.METRICS, "near_level", st.StageMetric(lambda p, y, w: (np.abs(p), np.ones_like(p)), lambda s, n: -np.abs(s / n - level["at"]))
    )
    base = {"n_estimators": 12, "max_depth": 3, "min_rows_leaf": 10, "val_fraction": 0.2, "learning_rate": 0.3}
    level["at"] = 100.0
    full = LeafwiseBoosting(ModelConfig("f", X, params={**base, "early_stopping_rounds": 12, "metric": "near_level"})).fit(train)
    sizes = [s + 100.0 for s in full.curves[0][1]]
    level["at"] = sizes[2]
    again = LeafwiseBoosting(ModelConfig("f", X, params={**base, "early_stopping_rounds": 4, "metric": "near_level"})).fit(train)
    assert len(sizes) == 12 and again.state["rounds"] == [3] and again.boosters[0].getNumTrees == 3
    curve = again.curve(spark).toPandas()
    assert len(curve) == 12 and curve["kept"].sum() == 3 and curve["score"].idxmax() == 2
    path = fresh_path(spark, "cut")
    again.save(spark, path)
    assert LeafwiseBoosting.load(spark, path).boosters[0].getNumTrees == 3
    with pytest.raises(ValueError, match="unknown metric"):
        LeafwiseBoosting(ModelConfig("f", X, params={"metric": "nope"}))
    with pytest.raises(ValueError, match="rounds"):
        build_model("ForestCrossSectional", ModelConfig("f", X, params={"early_stopping_rounds": 3}))
    assert LeafwiseBoosting(ModelConfig("f", X, params={"num_leaves": 31})).params["max_depth"] == 5
    assert LeafwiseBoosting(ModelConfig("f", X)).params["n_estimators"] == 500
    with pytest.raises(ValueError, match="taken|already"):
        st.register_metric("rmse", st.METRICS["rmse"])


def test_sweep_runs_every_drawn_parameter(train):
    for family, space in se.TREE_SPACES.items():
        for trial in se.draw_params({**space, "n_estimators": (2, 3, "int")}, 3):
            assert build_model(family, ModelConfig("t", X, params=trial)).params["n_estimators"] == trial["n_estimators"]
    trials = [{"n_estimators": 2, "max_depth": 2, "min_rows_leaf": 10}, {"n_estimators": 4, "max_depth": 3, "min_rows_leaf": 10}]
    both = se.sweep(train, "DepthwiseBoosting", X, trials, 3, 3, rows=25, parallel=3).orderBy("trial").toPandas()
    one = [se.sweep(train, "DepthwiseBoosting", X, [t], 3, 3, rows=25, parallel=1).first()["score"] for t in trials]
    assert both["score"].tolist() == pytest.approx(one) and both["error"].isna().all()
    with pytest.raises(ValueError, match="cannot honour"):
        se.sweep(train, "DepthwiseBoosting", X, [{"max_dept": 2}], 3, 3, rows=25)


def test_sweep_scores_failed_trials_minus_one(train):
    trials = [{"n_estimators": 3, "max_depth": 2, "min_rows_leaf": 10}, {"n_estimators": 3, "seeds": []}]
    out = se.sweep(train, "LeafwiseBoosting", X, trials[:1], 3, 3, rows=25).first()
    assert out["score"] > 0.3
    bad = se.sweep(train, "MomentumFactor", X, [{"feature_name": "none"}], 3, 3, rows=25).first()
    assert bad["score"] == -1.0
    assert se.draw_params(se.TREE_SPACE, 3) == se.draw_params(se.TREE_SPACE, 3)


def test_ablation_uses_subsets(train):
    out = se.ablation(train, {"all": X, "idle": ["x3"]}, ("ols", "lasso"), embargo=3, rows=25).toPandas().set_index(["variant", "kind"])
    assert out.loc[("all", "ols"), "ic"] > 0.7 > abs(out.loc[("idle", "ols"), "ic"]) + 0.4


# ---- folds --------------------------------------------------------------------------


def test_walk_forward_splits():
    splits = fo.walk_forward_splits(date(2020, 1, 1), date(2021, 1, 1), 21, 6, 100)
    assert splits[0].refit_date == date(2020, 4, 10) and splits[-1].test_end == date(2021, 1, 1)
    for a, z in zip(splits, splits[1:], strict=False):
        assert a.train_end < a.test_start <= a.test_end < z.test_start
    assert fo.walk_forward_splits(date(2020, 1, 1), date(2020, 2, 1), 7, 6, 3)[0].refit_date == date(2020, 1, 11)
    with pytest.raises(ValueError):
        fo.walk_forward_splits(date(2020, 1, 1), date(2021, 1, 1), 21, 0)


@pytest.mark.parametrize("n, k, e", [(120, 5, 21), (50, 3, 10), (10, 4, 21)])
def test_chain_folds(n, k, e):
    folds = fo.chain_folds(n, k, e)
    assert folds[-1].val_to == n and len(folds) >= 2
    for a, z in zip(folds, folds[1:], strict=False):
        assert a.train_to < z.train_to and a.val_to == z.val_from
    chunk = n // (min(k, n - 1) + 1)
    assert all(f.val_from - f.train_to == min(e, chunk - 1) for f in folds)


def test_fold_errors():
    with pytest.raises(ValueError):
        fo.chain_folds(2, 5, 1)
    with pytest.raises(ValueError):
        fo.expanding_time_folds(1, 3, 0.5, 0.9)
    assert [f.fold for f in fo.block_folds(100, 4, 30)] == [3]


# ---- per-ticker models ----------------------------------------------------------------


def test_gbm_and_history_limit(panel):
    model = build_model("GbmMaximumLikelihood", ModelConfig("g", ())).fit(panel)
    pdf = panel.where("ticker = 'T02'").orderBy("date").toPandas()
    r = np.log(pdf["adj_close"]).diff().dropna()
    row = model.table().where("ticker = 'T02'").first()
    assert row["mu"] == pytest.approx(r.mean()) and row["sigma"] == pytest.approx(r.std())
    out = model.predict(panel.where("date >= '2022-06-01'"))
    means = out.groupBy("date").agg(F.avg("prediction").alias("m")).agg(F.max(F.abs("m"))).first()[0]
    assert means < 1e-12
    short = build_model("GbmMaximumLikelihood", ModelConfig("g", ())).fit(panel.where("date < '2020-06-01'"))
    assert short.table().isEmpty()


def test_ar_sum_equals_recursion(panel):
    model = build_model("ArDriftPerTicker", ModelConfig("a", (), params={"horizon_days": 4})).fit(panel)
    out = model.predict(panel.where("date = '2022-01-05'")).toPandas().set_index("ticker")["prediction"]
    sums = {}
    for r in model.table().collect():
        total, x = 0.0, r["last_return"]
        for _ in range(4):
            x = r["c"] + r["phi"] * x
            total += x
        sums[r["ticker"]] = total
    mean = np.mean(list(sums.values()))
    for t, v in sums.items():
        assert out[t] == pytest.approx(v - mean, abs=1e-12)


def test_volatility_band(panel):
    model = build_model("GarchVolForecaster", ModelConfig("v", ())).fit(panel)
    row = model.predict(panel.limit(1)).first()
    assert row["prediction"] == 0.0 and row["pred_upper"] == -row["pred_lower"] > 0
    p = model.table().agg(F.min("persistence"), F.max("persistence")).first()
    assert 0 <= p[0] <= p[1] < 1


def test_factor_model_recovers_premia(spark, factors):
    """Returns built from known betas: the loadings come back and the prediction orders by them."""
    days = factors.select("date").distinct()
    names = spark.createDataFrame([(f"T{i:02d}", 0.5 + 0.1 * i) for i in range(12)], "ticker string, b double")
    w = sm.Window.partitionBy("ticker").orderBy("date")
    ret = F.col("RF") + F.col("b") * (F.col("MKT_RF") + 0.002) + 0.0005 * (noise(4, "date", "ticker") - 0.5)
    base = days.withColumn("b", F.explode(F.array(*[F.lit(0.5 + 0.1 * i) for i in range(12)]))).join(names, "b")
    panel = base.join(factors, "date").withColumn("r", ret).withColumn("adj_close", F.exp(F.sum("r").over(w))).select("date", "ticker", "adj_close", "b")
    shifted = factors.withColumn("MKT_RF", F.col("MKT_RF") + 0.002)
    model = sm.FamaFrenchFactorModel(ModelConfig("f", ())).fit(panel.drop("b"), shifted)
    got = model.table().join(names, "ticker").toPandas()
    np.testing.assert_allclose(got["beta_MKT_RF"], got["b"], atol=0.02)
    out = model.predict(panel.where("date = '2021-06-01'")).toPandas()
    assert abs(out["prediction"].mean()) < 1e-12 and len(out) == 12
    loads = sm.factor_loadings(panel.drop("b"), shifted).toPandas()
    assert (loads["r2"] > 0.9).all() and (loads["n"] == 252).all()


def test_attribution_adds_up(spark, panel, factors):
    loads = sm.factor_loadings(panel, factors)
    weights = spark.createDataFrame([("T00", 0.6), ("T01", 0.4)], "ticker string, weight double")
    row = sm.portfolio_exposure(loads, weights).first()
    betas = {f: row[f"beta_{f}"] for f in sm.FACTORS}
    daily = sm.realized_attribution(panel, factors, weights, betas, 100)
    assert daily.count() == 100
    gap = daily.agg(F.max(F.abs(F.col("portfolio") - F.col("RF") - F.col("factor_total") - F.col("residual")))).first()[0]
    assert gap < 1e-15
    shares = sm.risk_concentration(loads, weights)
    assert shares.agg(F.sum("share_pct")).first()[0] == pytest.approx(100.0)


def test_series_reports(panel):
    r = np.log(panel.where("ticker = 'T00'").orderBy("date").toPandas()["adj_close"]).diff().dropna().to_numpy()
    d = r - r.mean()
    acf = sm.autocorrelation(panel, 5)
    got = {x["lag"]: x["acf"] for x in acf.where("ticker = 'T00'").collect()}
    for k in range(1, 6):
        assert got[k] == pytest.approx((d[k:] @ d[:-k]) / (d @ d))
    q = sm.ljung_box(acf, (3,)).where("ticker = 'T00'").first()["q"]
    n = len(r)
    assert q == pytest.approx(n * (n + 2) * sum(got[k] ** 2 / (n - k) for k in (1, 2, 3)))
    stat = sm.adf_statistic(sm.add_log_return(panel), "log_return")
    assert stat.where("not stationary_5pct").isEmpty() and stat.count() == 6
    walk = sm.adf_statistic(panel).agg(F.min("adf_stat")).first()[0]
    assert walk > -10


# ---- experiments ------------------------------------------------------------------------

SPEC = {
    "experiment_id": "t",
    "features": ["return_5d", "vol_20"],
    "normalize_kind": "rank",
    "target_horizon": 5,
    "walk_forward": {"refit_freq_days": 200, "embargo_days": 10, "min_train_days": 300},
    "models": [
        {"id": "ols", "class": "OLSCrossSectional"},
        {"id": "one", "class": "RidgeCrossSectional", "features": ["vol_20"], "params": {"alphas": [1.0]}},
        {"id": "gbm", "class": "GbmMaximumLikelihood", "params": {"min_history": 100}},
    ],
}


def test_experiment_end_to_end(spark):
    panel = make_panel(spark, 12, 700, 5).cache()
    store = PredictionStore(spark, fresh_path(spark, "store"))
    result = ex.run_experiment(spark, SPEC, panel, store=store, rows=12)
    assert {r["model_id"] for r in result.summary.collect()} == {"ols", "one", "gbm"}
    assert store.table().count() == result.predictions.count()
    stamps = store.table().where("model_id = 'ols'").select("generated_at").distinct().count()
    assert stamps == len(result.runs["ols"].splits)
    # The one-scan refits equal separate fits of every split.
    run = result.runs["ols"]
    for i, split in enumerate(run.splits):
        train = fo.slice_train(result.matrix, split).dropna(subset=["y", "return_5d", "vol_20"])
        coef = OLSCrossSectional(ModelConfig("o", ("return_5d", "vol_20"))).fit(train).state["coef"]
        got = {r["feature"]: r["coef"] for r in run.coefficients.where(F.col("split") == i).collect()}
        assert [got["return_5d"], got["vol_20"]] == pytest.approx(coef, rel=1e-6)
        days = run.predictions.where(F.col("split") == i).agg(F.min("date"), F.max("date")).first()
        assert split.test_start <= days[0] and days[1] <= split.test_end


def test_walk_forward_rules(spark, panel):
    matrix = drop_warmup_rows(build_feature_matrix(panel, ["vol_20"], "rank", 5, rows=6), ["vol_20"])
    model = OLSCrossSectional(ModelConfig("o", ("vol_20",)))
    with pytest.raises(ValueError):
        ex.run_walk_forward(matrix, model, 21, {"embargo_days": 6})
    run = ex.run_walk_forward(
        matrix, model, 5, {"refit_freq_days": 9999, "embargo_days": 10, "first_refit": "2021-06-01", "train_start": "2020-06-01"}
    )
    assert len(run.splits) == 1 and run.predictions.agg(F.min("date")).first()[0] == date(2021, 6, 1)
    used = matrix.where("date >= '2020-06-01' and date <= '2021-05-22' and y is not null").count()
    assert model.state["n"] == used


@pytest.mark.parametrize("name", ["ArDriftPerTicker", "GbmMaximumLikelihood", "MomentVolForecaster"])
@pytest.mark.parametrize("train_start", [None, "2020-03-01"])
def test_running_sums_equal_separate_fits(spark, name, train_start):
    """Tickers that begin late, end early, pause or lack prices; every refit against a fit of its own rows."""
    panel = make_panel(spark, 5, 420, 9).withColumn("y", F.when(noise(5, "ticker", "date") > 0.02, 1.0))
    gone = (F.col("ticker") == "T01") & (F.col("date") < "2020-09-01") | (F.col("ticker") == "T02") & (F.col("date") > "2020-08-01")
    pause = (F.col("ticker") == "T03") & F.col("date").between("2020-06-01", "2020-09-15")
    matrix = panel.where(~gone & ~pause).withColumn("adj_close", F.when(noise(6, "ticker", "date") > 0.03, F.col("adj_close") * 1e4))
    options = {"refit_freq_days": 40, "embargo_days": 7, "min_train_days": 100, "train_start": train_start}
    config = ModelConfig("m", (), params={"min_history": 50})
    run = ex.run_walk_forward(matrix, build_model(name, config), 5, options)
    assert len(run.splits) >= 6
    for i, split in enumerate(run.splits):
        train = fo.slice_train(matrix, split, ex.day(train_start)).dropna(subset=["y"])
        model = build_model(name, config).fit(train)
        want = model.predict(fo.slice_test(matrix, split)).toPandas().sort_values(["date", "ticker"], ignore_index=True)
        got = run.predictions.where(F.col("split") == i).drop("split").toPandas().sort_values(["date", "ticker"], ignore_index=True)
        assert got[["date", "ticker"]].equals(want[["date", "ticker"]])
        for c in [c for c in want.columns if c not in ("date", "ticker")]:
            np.testing.assert_allclose(got[c], want[c], rtol=1e-7, atol=1e-13)


@pytest.mark.parametrize(
    ("name", "params"), [("ZeroPredictor", {}), ("LastReturnPredictor", {}), ("MomentumFactor", {"feature_name": "return_5d", "sign": -1})]
)
def test_fixed_rules_read_the_matrix_once_for_all_refits(spark, name, params):
    """As many jobs for 28 refits as for 4, and the rows of separate fits, of which the first ones have no training rows."""
    matrix = make_panel(spark, 4, 400, 9).withColumns({
        "y": F.when((noise(5, "ticker", "date") > 0.02) & (F.col("date") > "2020-08-01"), 1.0),
        "return_5d": F.when(noise(6, "ticker", "date") > 0.05, noise(7, "ticker", "date")),
    })
    config = ModelConfig("m", ("return_5d",), params=params)

    def jobs(freq, train_start=None):
        group, options = f"{name}-{freq}", {"refit_freq_days": freq, "embargo_days": 7, "min_train_days": 100, "train_start": train_start}
        spark.sparkContext.setJobGroup(group, group)
        run = ex.run_walk_forward(matrix, build_model(name, config), 5, options)
        run.predictions.count()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return run, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    (_, few), (run, many) = jobs(80), jobs(11, "2020-09-01")
    assert len(run.splits) == 28 and few == many
    want = []
    for i, split in enumerate(run.splits):
        train = fo.slice_train(matrix, split, date(2020, 9, 1)).dropna(subset=["y", "return_5d"])
        if not train.isEmpty():
            part = build_model(name, config).fit(train).predict(fo.slice_test(matrix, split).dropna(subset=["return_5d"]))
            want += [(r.date, r.ticker, r.prediction, i) for r in part.collect()]
    assert 0 < min(r[3] for r in want)
    assert sorted(tuple(r) for r in run.predictions.collect()) == sorted(want)
    with pytest.raises(ValueError, match="no split"):
        ex.run_walk_forward(matrix.withColumn("y", F.lit(None).cast("double")), build_model(name, config), 5, {"embargo_days": 7, "min_train_days": 50})


def test_date_ics_share_places_among_equals():
    rng = np.random.default_rng(3)
    x = np.repeat(rng.integers(0, 6, (20, 3)) / 4, 3, axis=0)
    x[5, 2] = np.nan
    realized = pd.Series(rng.normal(size=60)).rank().to_numpy()
    coefs = np.vstack([rng.normal(size=(40, 3)), [[0, 0, 0], [1, 0, 0], [1, -1, 0]]]) * [1, 1, 0]
    found = models._date_ics(x[:, :2], realized, coefs[:, :2])
    predicted = [sum(x[:, j] * c[j] for j in range(2)) for c in coefs]
    want = [np.corrcoef(pd.Series(p).rank(), realized)[0, 1] if p.std() > 0 else np.nan for p in predicted]
    np.testing.assert_allclose(found, want, rtol=1e-12)
    with_nan = models._date_ics(x, realized, np.array([[1.0, 0.5, 0.25]]))
    ranks = pd.Series(x @ [1.0, 0.5, 0.25]).rank(na_option="bottom").to_numpy()
    np.testing.assert_allclose(with_nan, [np.corrcoef(ranks, realized)[0, 1]], rtol=1e-12)


def test_running_sums_against_pandas(spark):
    panel = make_panel(spark, 3, 200, 4)
    model = build_model("ArDriftPerTicker", ModelConfig("a", (), params={"min_history": 20})).fit(panel)
    fits = model.table().toPandas().set_index("ticker")
    pdf = panel.toPandas().sort_values(["ticker", "date"])
    for ticker, part in pdf.groupby("ticker"):
        lr = np.log(part["adj_close"]).diff().to_numpy()
        slope, start = np.polyfit(lr[1:-1], lr[2:], 1)
        assert fits.loc[ticker, ["phi", "c", "last_return", "n"]].tolist() == pytest.approx([slope, start, lr[-1], 199])
    with pytest.raises(ValueError, match="no split"):
        ex.run_walk_forward(panel.withColumn("y", F.lit(None).cast("double")), model, 5, {"embargo_days": 7, "min_train_days": 50})


def test_rules_are_scored_alike_in_arrays_by_joins_and_by_pandas(train, small_tasks):
    index = fo.date_index(train)
    rules = [Rule((1.0, -0.5, 0.0), 0, 80), Rule((0.0, 0.0, 0.0), 0, 80), Rule((0.2, 0.0, 1.0), 10, 31), Rule((0.0, 0.0, 1.0), 90, 95)]
    coarse = train.withColumn("x3", F.floor(F.col("x3") * 4) / 4)
    arrays = score_rules(coarse, X, "y", index, rules, rows=small_tasks).orderBy("rule").toPandas()
    joins = score_rules(coarse, X, "y", index, rules, rows=small_tasks + 5).orderBy("rule").toPandas()
    assert arrays["rule"].tolist() == joins["rule"].tolist() == [0, 2]
    np.testing.assert_allclose(arrays[["ic", "n_dates"]], joins[["ic", "n_dates"]], rtol=1e-9)
    pdf = coarse.join(index, "date").toPandas()
    for number, ic, n in arrays.itertuples(index=False):
        rule = rules[number]
        part = pdf[(pdf["idx"] >= rule.low) & (pdf["idx"] < rule.high)]
        part = part.assign(p=part[list(X)].to_numpy() @ np.array(rule.coef))
        want = part.groupby("date").apply(lambda g: g["p"].rank().corr(g["y"].rank()), include_groups=False)
        assert n == len(want) and ic == pytest.approx(want.mean())
