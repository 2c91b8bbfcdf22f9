"""The two routes of every ordering kernel give the same exact rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from crosslane.operators import ranking as rk
from crosslane.operators import rolling as ro
from tests.conftest import noise


def hot_rows(spark, n=600):
    """One group with a third of the rows, one value with a third of them, some nulls."""
    df = spark.range(n).select(
        "id",
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 40).alias("g"),
        F.when(F.col("id") % 5 < 2, 1.5)
        .when(F.col("id") % 17 == 0, None)
        .otherwise(F.round(noise(3, "id") * 50, 1))
        .alias("v"),
    )
    return df


def test_average_rank_of_large_groups(spark, small_tasks):
    df = hot_rows(spark)
    out = rk.add_average_rank(df, ["g"], "v", "r", "n").toPandas().sort_values("id").reset_index(drop=True)
    want = out.groupby("g")["v"].rank(method="average")
    np.testing.assert_allclose(out["r"], want)
    assert (out["n"] == out.groupby("g")["v"].transform("count")).all()


def test_rank_without_groups(spark, small_tasks):
    out = rk.add_average_rank(hot_rows(spark), [], "v", "r").toPandas()
    np.testing.assert_allclose(out["r"], out["v"].rank(method="average"))
    assert list(out.columns) == ["id", "g", "v", "r"]


def test_positions_are_unique_and_ordered(spark, small_tasks):
    df = hot_rows(spark).where("v is not null")
    out = rk.add_position(df, ["g"], ["v", "id"], "p", "n").toPandas().sort_values(["g", "v", "id"])
    assert (out.groupby("g").cumcount() + 1 == out["p"]).all()
    assert (out["n"] == out.groupby("g")["id"].transform("count")).all()


@pytest.mark.parametrize("nearest", [False, True])
def test_quantiles(spark, small_tasks, nearest):
    df = hot_rows(spark)
    probs = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.93, "e": 1.0}
    out = rk.quantiles(df, ["g"], "v", probs, nearest=nearest).toPandas().set_index("g")
    pdf = df.toPandas().dropna()
    for g, part in pdf.groupby("g"):
        v = np.sort(part["v"].to_numpy())
        for name, p in probs.items():
            want = v[int(np.floor(p * (len(v) - 1) + 0.5))] if nearest else np.quantile(v, p)
            assert out.loc[g, name] == pytest.approx(want)


def test_group_stats_and_median(spark, small_tasks):
    df = hot_rows(spark)
    out = rk.add_group_stats(df, ["g"], {"m": F.avg("v"), "s": F.stddev_samp("v")})
    out = rk.add_group_median(out, ["g"], "v", "med").toPandas()
    by = out.groupby("g")["v"]
    np.testing.assert_allclose(out["m"], by.transform("mean"))
    np.testing.assert_allclose(out["s"], by.transform("std"))
    np.testing.assert_allclose(out["med"], by.transform("median"))


def test_value_at(spark, small_tasks):
    df = hot_rows(spark)
    values = np.sort(df.toPandas()["v"].dropna().to_numpy())
    for place in (0, 7, len(values) // 2, len(values) - 1):
        assert rk.value_at(df, "v", place) == values[place]


def long_keys(spark):
    return spark.range(500).select(
        "id",
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 25)).alias("k"),
        noise(5, "id").alias("x"),
    )


def test_chunked_windows_equal_plain_ones(spark, small_tasks):
    df = long_keys(spark)

    def first(w):
        return {"d": F.col("x") - F.lag("x").over(w)}

    def second(w):
        return {"s": ro.full(F.stddev_samp("d"), F.col("d"), w, 6), "up": F.lead("x", 2).over(w)}

    out = ro.add_rolling(df, ["k"], ["id"], [first, second], back=7, forward=2).toPandas()
    assert len(out) == 500 and out["id"].is_unique
    pdf = out.sort_values("id")
    for _, part in pdf.groupby("k"):
        d = part["x"].diff()
        np.testing.assert_allclose(part["d"], d)
        np.testing.assert_allclose(part["s"], d.rolling(6).std(), atol=1e-12)
        np.testing.assert_allclose(part["up"], part["x"].shift(-2))


@pytest.mark.parametrize("span", [3, 20])
def test_ewm_mean_equals_pandas(spark, small_tasks, span):
    out = ro.add_ewm_mean(long_keys(spark), ["k"], ["id"], "x", 2 / (span + 1), "m").toPandas().sort_values("id")
    for _, part in out.groupby("k"):
        np.testing.assert_allclose(part["m"], part["x"].ewm(span=span, adjust=False).mean(), rtol=1e-12)


def test_ewm_over_many_chunks(spark):
    """Span 2 has chunks of a few hundred rows, so one key of 3000 rows is cut many times."""
    df = spark.range(3000).select("id", F.lit("a").alias("k"), (noise(9, "id") - 0.5).alias("x"))
    out = ro.add_ewm_mean(df, ["k"], ["id"], "x", 2 / 3, "m", rows=3000)
    out = ro.add_ewm_std(out, ["k"], ["id"], "x", 2, "s", rows=3000).toPandas().sort_values("id")
    assert len(out) == 3000
    np.testing.assert_allclose(out["m"], out["x"].ewm(span=2, adjust=False).mean(), rtol=1e-9, atol=1e-12)
    want = out["x"].ewm(span=2).std()
    np.testing.assert_allclose(out["s"].iloc[1:], want.iloc[1:], rtol=1e-8)
    assert out["s"].iloc[0] == 0.0


def test_frame_guard(spark):
    df = spark.createDataFrame([(i, None if i == 2 else float(i)) for i in range(6)], "i int, x double").withColumn("k", F.lit(1))
    out = ro.add_rolling(df, ["k"], ["i"], [lambda w: {"m": ro.full(F.avg("x"), F.col("x"), w, 2)}], back=2).toPandas()
    got = out.sort_values("i")["m"].tolist()
    assert pd.isna(got[0]) and got[1] == 0.5 and pd.isna(got[2]) and pd.isna(got[3]) and got[4] == 3.5


def null_keys(spark):
    return spark.range(90).select(
        "id",
        F.when(F.col("id") % 2 == 0, F.col("id") % 6).alias("g"),
        F.when(F.col("id") % 7 != 0, F.round(noise(4, "id") * 9, 0)).alias("v"),
    )


@pytest.mark.parametrize("task_rows", ["1000000", "6"])
def test_null_keys_keep_their_rows(spark, task_rows):
    spark.conf.set("crosslane.taskRows", task_rows)
    try:
        df = null_keys(spark)
        pdf = df.toPandas().sort_values("id").reset_index(drop=True)
        by = pdf.assign(g=pdf["g"].fillna(-1)).groupby("g")
        ranked = rk.add_average_rank(df, ["g"], "v", "r", "n").toPandas().sort_values("id")
        np.testing.assert_allclose(ranked["r"], by["v"].rank(method="average"))
        placed = rk.add_position(df, ["g"], ["id"], "p", "n").toPandas().sort_values("id")
        assert (placed["p"].to_numpy() == (by.cumcount() + 1).to_numpy()).all() and len(placed) == 90
        stats = rk.add_group_median(rk.add_group_stats(df, ["g"], {"m": F.avg("v")}), ["g"], "v", "med").toPandas().sort_values("id")
        np.testing.assert_allclose(stats["m"], by["v"].transform("mean"))
        np.testing.assert_allclose(stats["med"], by["v"].transform("median"))
        assert rk.quantiles(df, ["g"], "v", {"q": 0.5}, nearest=True).count() == by.ngroups
        rolled = ro.add_rolling(df, ["g"], ["id"], [lambda w: {"l": F.lag("id").over(w)}], back=1).toPandas()
        assert len(rolled) == 90 and rolled["l"].isna().sum() == by.ngroups
    finally:
        spark.conf.unset("crosslane.taskRows")


def gappy(spark):
    """Keys with nulls at the start, in the middle, and one without any value."""
    return spark.range(400).select(
        "id",
        (F.col("id") % 4).alias("k"),
        F.when((F.col("id") % 4 != 3) & (F.col("id") > 40 * (F.col("id") % 4)) & (noise(8, "id") > 0.4), noise(6, "id")).alias("x"),
    )


@pytest.mark.parametrize("span", [3, 20])
@pytest.mark.parametrize("task_rows", ["1000000", "20"])
def test_ewm_with_gaps_equals_pandas(spark, span, task_rows):
    spark.conf.set("crosslane.taskRows", task_rows)
    try:
        df = gappy(spark)
        out = ro.add_ewm_mean(df, ["k"], ["id"], "x", 2 / (span + 1), "m")
        out = ro.add_ewm_mean(out, ["k"], ["id"], "x", 2 / (span + 1), "s", carry=False)
        out = ro.add_ewm_std(out, ["k"], ["id"], "x", span, "d").toPandas().sort_values("id")
    finally:
        spark.conf.unset("crosslane.taskRows")
    for _, part in out.groupby("k"):
        want = part["x"].ewm(span=span, adjust=False).mean()
        np.testing.assert_allclose(part["m"], want, rtol=1e-9)
        np.testing.assert_allclose(part["s"], want.where(part["x"].notna()), rtol=1e-9)
        spread = part["x"].ewm(span=span).std().where(part["x"].notna())
        first = part["x"].first_valid_index()
        if first is not None:
            spread[first] = 0.0
        np.testing.assert_allclose(part["d"], spread, rtol=1e-6, atol=1e-9)


def sparse_long_key(spark, rows=6000):
    """One key of values in few places: null runs over several chunks, at the start, in the middle and at the end."""
    here = (F.col("id") >= 900) & ((F.col("id") < 905) | F.col("id").between(3300, 3302) | (F.col("id") == 5200))
    return spark.range(rows).select(
        "id", F.when(F.col("id") % 2 == 0, F.lit("a")).alias("k"), F.when(here, 1e6 + noise(3, "id")).alias("x")
    )


@pytest.mark.parametrize("scan_span", [1024, 2])
@pytest.mark.parametrize("span", [2, 5])
def test_ewm_over_null_runs_of_many_chunks(spark, monkeypatch, scan_span, span):
    monkeypatch.setattr(ro, "_SCAN_SPAN", scan_span)
    monkeypatch.setattr(ro, "_EXPONENT_ROOM", 60.0)
    df = sparse_long_key(spark)
    out = ro.add_ewm_mean(df, ["k"], ["id"], "x", 2 / (span + 1), "m")
    out = ro.add_ewm_mean(out, ["k"], ["id"], "x", 2 / (span + 1), "s", carry=False)
    out = ro.add_ewm_std(out, ["k"], ["id"], "x", span, "d").toPandas().sort_values("id")
    assert len(out) == 6000
    for _, part in out.groupby("k", dropna=False):
        want = part["x"].ewm(span=span, adjust=False).mean()
        np.testing.assert_allclose(part["m"], want, rtol=1e-12)
        np.testing.assert_allclose(part["s"], want.where(part["x"].notna()), rtol=1e-12)
        assert part["m"].notna().sum() > 2400
        spread = (part["x"] - 1e6).ewm(span=span).std().where(part["x"].notna())
        spread[part["x"].first_valid_index()] = 0.0
        dense = part["id"] < 1000
        np.testing.assert_allclose(part["d"][dense], spread[dense], rtol=1e-6)


def test_ewm_states_do_not_depend_on_the_chunk(spark, monkeypatch):
    df = spark.range(2000).select(
        "id", F.lit(1).alias("k"), F.when(noise(2, "id") > 0.7, 1e5 + noise(1, "id")).alias("x")
    )
    found = []
    for room, scan in ((340.0, 1024), (5.0, 1024), (3.0, 8)):
        monkeypatch.setattr(ro, "_EXPONENT_ROOM", room)
        monkeypatch.setattr(ro, "_SCAN_SPAN", scan)
        out = ro.add_ewm_std(ro.add_ewm_mean(df, ["k"], ["id"], "x", 0.4, "m"), ["k"], ["id"], "x", 4, "d")
        found.append(out.toPandas().sort_values("id"))
    for other in found[1:]:
        np.testing.assert_allclose(other["m"], found[0]["m"], rtol=1e-13)
        np.testing.assert_allclose(other["d"], found[0]["d"], rtol=1e-6)
    with pytest.raises(ValueError, match="alpha"):
        ro.add_ewm_mean(df, ["k"], ["id"], "x", 1.0, "m")
