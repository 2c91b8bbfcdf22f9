import numpy as np
import pytest
from pyspark.sql import functions as F

from crosslane.operators import features as ft
from crosslane.operators.registry import (
    describe_features,
    forget_feature,
    get_feature,
    list_features,
    series_feature,
)


@pytest.fixture(scope="module")
def matrix(panel, factors):
    return ft.add_features(panel, list_features(), factors, rows=6).cache()


def test_registry_has_all_features():
    assert len(list_features()) == 41


def test_truncation_invariance(panel, factors, matrix):
    """A value does not change when later rows are taken away."""
    cut = "2022-02-01"
    names = list_features()
    early = ft.add_features(panel.where(F.col("date") <= cut), names, factors, rows=6)
    day = "2022-01-25"
    a = matrix.where(F.col("date") == day).orderBy("ticker").toPandas()
    z = early.where(F.col("date") == day).orderBy("ticker").toPandas()
    for name in names:
        np.testing.assert_allclose(a[name].astype(float), z[name].astype(float), rtol=1e-9, atol=1e-12, err_msg=name)


def test_isolation(panel, factors, matrix):
    """Changing one ticker leaves the series features of the others alone."""
    changed = panel.withColumn("adj_close", F.when(F.col("ticker") == "T00", F.col("adj_close") * 3).otherwise(F.col("adj_close")))
    names = ["momentum_60", "vol_20", "rsi_14", "distance_52w_high", "vol_ewm_20"]
    a = ft.add_features(changed, names, rows=6).where("ticker = 'T03'").orderBy("date").toPandas()
    z = matrix.where("ticker = 'T03'").orderBy("date").toPandas()
    for name in names:
        np.testing.assert_allclose(a[name].astype(float), z[name].astype(float), rtol=1e-12)


@pytest.mark.parametrize(
    "name, nulls",
    [
        ("return_1d", 1),
        ("return_5d", 5),
        ("momentum_60", 65),
        ("vol_20", 20),
        ("rsi_14", 13),
        ("distance_ma_200", 199),
        ("momentum_12_1", 252),
        ("distance_52w_high", 252),
        ("parkinson_vol_20", 19),
        ("max_return_21d", 21),
        ("beta_60", 60),
        ("vol_ewm_20", 1),
    ],
)
def test_warmup(matrix, name, nulls):
    counts = matrix.groupBy("ticker").agg(F.count(F.when(F.col(name).isNull(), 1)).alias("n"))
    assert {r["n"] for r in counts.collect()} == {nulls}


def test_identities(matrix):
    pdf = matrix.dropna(subset=["return_1d", "momentum_60", "vol_ewm_20"]).toPandas()
    np.testing.assert_allclose(pdf["overnight_return_1d"] + pdf["intraday_return_1d"], pdf["return_1d"], atol=1e-12)
    gaps = pdf.groupby(["date", "sector"])["momentum_60_sector_rel"].median()
    np.testing.assert_allclose(gaps, 0, atol=1e-12)
    assert (pdf.groupby("date")["momentum_60_rank"].max() <= 1).all()


def test_ewm_and_rolling_against_pandas(matrix, panel):
    pdf = matrix.where("ticker = 'T01'").orderBy("date").toPandas()
    lr = np.log(pdf["adj_close"]).diff()
    np.testing.assert_allclose(pdf["vol_20"], lr.rolling(20).std(), rtol=1e-9)
    want = lr.ewm(span=20).std()
    np.testing.assert_allclose(pdf["vol_ewm_20"].iloc[2:], want.iloc[2:], rtol=1e-8)
    assert pdf["vol_ewm_20"].iloc[1] == 0.0


def test_beta_recovery(spark, panel):
    """A ticker that moves 1.5 times the factor has beta 1.5 on it."""
    from crosslane.sources.factors import FACTORS
    from tests.conftest import make_factors

    factors = make_factors(spark, panel)
    w = ft.Window.partitionBy("ticker").orderBy("date")
    moved = panel.where("ticker = 'T00'").join(factors, "date").withColumn(
        "adj_close", F.exp(F.sum(1.5 * F.col("MKT_RF")).over(w))
    )
    out = ft.add_features(moved.drop(*FACTORS, "RF"), ["mkt_beta_60"], factors, rows=1).dropna(subset=["mkt_beta_60"])
    lo, hi = out.agg(F.min("mkt_beta_60"), F.max("mkt_beta_60")).first()
    assert lo == pytest.approx(1.5, abs=1e-6) and hi == pytest.approx(1.5, abs=1e-6)


def test_matrix(panel):
    names = ["return_5d", "vol_20"]
    out = ft.build_feature_matrix(panel, names, "zscore", 5, rows=6)
    assert set(out.columns) == {*panel.columns, *names, "y"}
    stats = ft.drop_warmup_rows(out, names).groupBy("date").agg(
        F.avg("vol_20").alias("m"), F.stddev_samp("vol_20").alias("s"), F.avg("y").alias("y")
    )
    for r in stats.limit(50).collect():
        assert abs(r["m"]) < 1e-9 and r["s"] == pytest.approx(1.0)
        assert r["y"] is None or abs(r["y"]) < 1e-12
    assert ft.drop_warmup_rows(out, []) is out


def test_split_route_gives_the_same_matrix(spark, panel, factors):
    names = ["momentum_60_sector_rel", "vol_20_rank", "vol_20_cs_min_dist", "return_5d"]
    part = panel.where(F.col("date") < "2020-06-01")
    plain = ft.build_feature_matrix(part, names, "rank", 5, rows=6).orderBy("ticker", "date").toPandas()
    spark.conf.set("crosslane.taskRows", "3")
    try:
        split = ft.build_feature_matrix(part, names, "rank", 5, rows=6).orderBy("ticker", "date").toPandas()
    finally:
        spark.conf.unset("crosslane.taskRows")
    for n in [*names, "y"]:
        np.testing.assert_allclose(plain[n].astype(float), split[n].astype(float), rtol=1e-12, err_msg=n)


def test_errors(panel):
    with pytest.raises(ValueError):
        ft.normalize(panel, ["close"], "other")
    assert ft.normalize(panel, ["close"], "none") is panel
    with pytest.raises(KeyError):
        get_feature("no_such_feature")
    with pytest.raises(ValueError):
        ft.add_features(panel, ["mkt_beta_60"], rows=6)
    with pytest.raises(ValueError):
        ft.add_features(panel.drop("sector"), ["momentum_60_sector_rel"], rows=6)


def test_plug_in(spark, panel):
    @series_feature("close_gap", ("close",), 1)
    def close_gap(w):
        return F.col("close") - F.lag("close").over(w)

    try:
        out = ft.add_features(panel, ["close_gap"], rows=6)
        assert out.where(F.col("close_gap").isNull()).count() == 6
        with pytest.raises(ValueError):
            series_feature("close_gap", ("close",), 1)(close_gap)
        assert describe_features(spark).where("name = 'close_gap'").first()["lookback_days"] == 1
    finally:
        forget_feature("close_gap")


def test_forward_return_is_null_at_the_end(panel):
    out = ft.add_forward_excess_return(panel, 21, rows=6)
    assert out.where(F.col("y").isNull()).groupBy("ticker").count().select("count").distinct().collect()[0][0] == 21
