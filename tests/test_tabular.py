import numpy as np
import pytest
from pyspark.sql import functions as F

from crosslane.operators import tabular_features as tf
from crosslane.operators import tabular_quality as tq
from crosslane.operators.staged import best_round
from tests.conftest import noise

K, O = ("code",), ("ts_index",)


@pytest.fixture(scope="module")
def table(spark):
    """One code holds a third of the rows."""
    code = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("c"), F.col("id") % 7))
    return spark.range(400).select(
        "id",
        code.alias("code"),
        (F.col("id") % 5).cast("string").alias("sub_code"),
        F.element_at(F.array(F.lit(1), F.lit(3)), (F.col("id") % 2 + 1).cast("int")).alias("horizon"),
        F.col("id").cast("int").alias("ts_index"),
        F.when(F.col("id") % 9 != 0, noise(1, "id")).alias("feature_a"),
        noise(2, "id").alias("feature_b"),
        (noise(3, "id") * 4).alias("weight"),
        (noise(4, "id") - 0.5).alias("y_target"),
    ).cache()


def test_windows_of_a_hot_key(table, small_tasks):
    out = tf.add_lags(table, ["feature_b"], [1, 3], K, O)
    out = tf.add_moving(out, ["feature_b"], [5], K, O)
    out = tf.add_past_moving(out, "feature_b", [3], K, O)
    out = tf.add_ewm(out, ["feature_b"], [5], K, O).toPandas().sort_values("id")
    for _, p in out.groupby("code"):
        x = p["feature_b"]
        np.testing.assert_allclose(p["feature_b_lag3"], x.shift(3))
        np.testing.assert_allclose(p["feature_b_roll5"], x.rolling(5, min_periods=1).mean())
        np.testing.assert_allclose(p["feature_b_rollstd5"], x.rolling(5, min_periods=1).std(), atol=1e-12)
        np.testing.assert_allclose(p["roll_mean_3"], x.shift(1).rolling(3, min_periods=1).mean())
        np.testing.assert_allclose(p["feature_b_ewm5"], x.ewm(span=5, adjust=False).mean())


def test_target_encoding_sees_training_rows_only(table):
    train = table.where("ts_index < 200")
    out = tf.add_target_encoding(table, train, ["code"]).toPandas()
    means = train.toPandas().groupby("code")["y_target"].mean()
    np.testing.assert_allclose(out["code_mean"], out["code"].map(means))
    unseen = tf.add_target_encoding(table, train.where("code = 'hot'"), ["code"], fallback="zero")
    assert unseen.where("code <> 'hot'").agg(F.max(F.abs("code_mean"))).first()[0] == 0.0


def test_codes_and_one_hot(table):
    codes = tf.label_codes([table.where("id < 9"), table], "code")
    got = {r["value"]: r["label"] for r in codes.collect()}
    assert got == {v: i for i, v in enumerate(sorted({*[f"c{i}" for i in range(7)], "hot"}))}
    hot = tf.add_one_hot(table, "sub_code").toPandas()
    assert (hot[[f"is_{i}" for i in range(5)]].sum(axis=1) == 1).all()
    with pytest.raises(ValueError):
        tf.categories(table, "id", limit=10)


def test_soft_weights(table):
    w = table.toPandas()["weight"]
    out = tf.soften_weights(table, "sqrt_clip").toPandas()["soft_weight"]
    s = np.sqrt(w).clip(np.sqrt(w).quantile(0.05), np.sqrt(w).quantile(0.95))
    np.testing.assert_allclose(out, s / s.mean())
    with pytest.raises(ValueError):
        tf.soften_weights(table, "cube")


def test_impute_and_clip(table):
    pdf = table.toPandas()
    train = table.where("ts_index < 200")
    out = tf.impute_medians(table, train, ["feature_a"]).toPandas()
    np.testing.assert_allclose(out["feature_a"], pdf["feature_a"].fillna(pdf["feature_a"][pdf["ts_index"] < 200].median()))
    clipped = tf.clip_to_quantiles(table, train, "y_target", 0.1, 0.9).toPandas()["y_target"]
    y = pdf["y_target"][pdf["ts_index"] < 200]
    np.testing.assert_allclose(clipped, pdf["y_target"].clip(y.quantile(0.1), y.quantile(0.9)))


def test_scores(table):
    df = table.withColumn("prediction", F.col("y_target") * 0.5)
    assert tq.weighted_score(df).first()["score"] == pytest.approx(np.sqrt(0.75))
    assert tq.weighted_score(df.withColumn("y_target", F.lit(0.0))).first()["score"] == 0.0
    assert tq.weighted_score(df.withColumn("prediction", F.col("y_target") * 9)).first()["score"] == 0.0
    m = tq.error_metrics(df).first()
    pdf = df.toPandas()
    e = pdf["y_target"] - pdf["prediction"]
    assert m["rmse"] == pytest.approx(np.sqrt((e**2).mean())) and m["mse"] == pytest.approx((e**2).mean())
    assert m["weighted_mae"] == pytest.approx((pdf["weight"] * e.abs()).sum() / pdf["weight"].sum())


def test_profiles(table, small_tasks):
    pdf = table.toPandas()
    out = tq.describe_numeric(table, ["feature_a", "weight"]).toPandas().set_index("column")
    for c in ("feature_a", "weight"):
        assert out.loc[c, "count"] == pdf[c].count()
        assert out.loc[c, "iqr"] == pytest.approx(pdf[c].quantile(0.75) - pdf[c].quantile(0.25))
    k = int(len(pdf) * 0.1)
    share = tq.top_weight_share(table).first()["top_share"]
    assert share == pytest.approx(pdf["weight"].sort_values().iloc[-k:].sum() / pdf["weight"].sum())
    miss = tq.missing_summary(table).collect()
    assert [(r["column"], r["missing"]) for r in miss] == [("feature_a", int(pdf["feature_a"].isna().sum()))]
    both = table.unionByName(table.limit(7))
    assert tq.duplicate_rows(both).first()["n_duplicates"] == 7


def test_correlations_and_moments(table):
    pdf = table.toPandas()
    out = tq.target_correlations(table, ["feature_a", "feature_b"]).toPandas().set_index("feature")
    full = pdf.dropna(subset=["feature_a"])
    assert out.loc["feature_a", "spearman"] == pytest.approx(full["feature_a"].rank().corr(full["y_target"].rank()))
    assert out.loc["feature_a", "pearson"] == pytest.approx(pdf["feature_a"].fillna(0).corr(pdf["y_target"]))
    mom = tq.target_moments(table).toPandas().set_index("horizon")
    for h, p in pdf.groupby("horizon"):
        assert mom.loc[h, "skew"] == pytest.approx(p["y_target"].skew()) and mom.loc[h, "kurt"] == pytest.approx(p["y_target"].kurtosis())


def test_outliers(table):
    pdf = table.toPandas()
    spiky = table.withColumn("weight", F.when(F.col("id") == 5, 1000.0).otherwise(F.col("weight")))
    got = tq.outlier_summary(spiky, ["weight"], "zscore").first()
    assert got["outlier_count"] == 1 and got["percent_outliers"] == pytest.approx(100 / len(pdf))
    assert tq.outlier_summary(spiky, ["weight"], "iqr").first()["outlier_count"] == 1
    with pytest.raises(ValueError):
        tq.outlier_bounds(table, ["weight"], "other")


def test_out_of_fold_training(table):
    out = tq.train_by_horizon(table, ["feature_b"], 2, seeds=(1, 2), params={"maxIter": 2, "maxDepth": 2})
    oof = out["oof"].toPandas()
    assert set(oof["horizon"]) == {1, 3} and set(oof["fold"]) == {1, 2}
    assert not oof.duplicated(["id", "fold"]).any()
    assert out["scores"].count() == 2
    top = tq.importance_summary(out["importances"], 1).first()
    assert top["feature"] == "feature_b" and top["count"] == 8
    curves = out["curves"].toPandas()
    assert len(curves) == 2 * 2 * 2 * 2 and curves["kept"].all()


def test_horizons_stop_by_the_weighted_score(table):
    options = {"maxIter": 6, "maxDepth": 2, "stepSize": 0.9}
    whole = tq.train_by_horizon(table, ["feature_b"], 2, params=options, parallel=1)
    cut = tq.train_by_horizon(table, ["feature_b"], 2, params=options, patience=1, parallel=4)
    curves, short = (o["curves"].toPandas().sort_values(["horizon", "fold", "round"], ignore_index=True) for o in (whole, cut))
    np.testing.assert_allclose(curves["score"], short["score"])
    for _, part in short.groupby(["horizon", "fold"]):
        assert part["kept"].sum() == best_round(part["score"].to_numpy(), 1)
    last = curves[curves["round"] == 6].set_index(["horizon", "fold"])["score"]
    by_fold = tq.weighted_score(whole["oof"], ["horizon", "fold"]).toPandas().set_index(["horizon", "fold"])["score"]
    np.testing.assert_allclose(by_fold.loc[last.index], last, rtol=1e-9)
