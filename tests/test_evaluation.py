import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from crosslane.operators import diagnostics as dg
from crosslane.operators import ensembles as en
from crosslane.operators import metrics as mt
from crosslane.operators import robustness as rb
from crosslane.operators import turnover as tn
from crosslane.operators.neutralize import neutralized_ic, residualize
from crosslane.operators.smoothing import smooth_predictions
from tests.conftest import make_panel, make_scores, noise

ROWS = 30


@pytest.fixture(scope="module")
def scores(spark):
    good = make_scores(spark, strength=1.0, model="good")
    bad = make_scores(spark, strength=0.0, seed=77, model="bad")
    return good.unionByName(bad).cache()


def _spearman(part):
    return part["prediction"].rank().corr(part["realized"].rank())


def test_daily_ic_against_pandas(scores):
    pdf = scores.toPandas()
    want = pdf.groupby(["model_id", "date"]).apply(_spearman, include_groups=False)
    got = mt.daily_ic(scores, rows=ROWS).toPandas().set_index(["model_id", "date"])["ic"]
    np.testing.assert_allclose(got.sort_index(), want.sort_index(), rtol=1e-9)


def test_constant_and_thin_dates_are_left_out(spark):
    df = make_scores(spark, dates=4, tickers=12)
    first, second = [r[0] for r in df.select("date").distinct().orderBy("date").limit(2).collect()]
    df = df.withColumn("prediction", F.when(F.col("date") == F.lit(first), 1.0).otherwise(F.col("prediction")))
    df = df.where((F.col("date") != F.lit(second)) | (F.col("ticker") < "T04"))
    assert mt.daily_ic(df, rows=12).count() == 2


def test_summary_against_pandas(scores):
    out = mt.compare_models(scores, horizon=5, rows=ROWS).toPandas().set_index("model_id")
    pdf = scores.toPandas()
    for model, part in pdf.groupby("model_id"):
        err = part["prediction"] - part["realized"]
        assert out.loc[model, "mae"] == pytest.approx(err.abs().mean())
        assert out.loc[model, "rmse"] == pytest.approx(math.sqrt((err**2).mean()))
        assert out.loc[model, "hit_rate"] == pytest.approx((np.sign(part["prediction"]) == np.sign(part["realized"])).mean())
        rets = []
        for _, g in part.sort_values(["prediction", "ticker"]).groupby("date"):
            k = max(1, round(len(g) * 0.2))
            rets.append(g["realized"].tail(k).mean() - g["realized"].head(k).mean())
        sr = np.mean(rets) / np.std(rets, ddof=1) * math.sqrt(252 / 5)
        assert out.loc[model, "long_short_sharpe"] == pytest.approx(sr)
    assert out.loc["good", "information_coefficient"] > 0.5 > abs(out.loc["bad", "information_coefficient"])
    with pytest.raises(ValueError):
        mt.compare_models(scores.drop("model_id"))


def test_hac_against_loop(scores):
    ic = mt.daily_ic(scores, rows=ROWS)
    out = mt.hac_t(ic, "ic", 7).toPandas().set_index("model_id")
    for model, part in ic.toPandas().sort_values("date").groupby("model_id"):
        x = part["ic"].to_numpy()
        d, n = x - x.mean(), len(x)
        var = d @ d / n + sum(2 * (1 - k / 8) * (d[k:] @ d[:-k]) / n for k in range(1, 8))
        assert out.loc[model, "t_hac"] == pytest.approx(x.mean() / math.sqrt(var / n))
        assert out.loc[model, "t_naive"] == pytest.approx(x.mean() * math.sqrt(n) / x.std(ddof=1))


def _turnover_loop(part, lag):
    books = []
    for d, g in sorted(part.groupby("date")):
        g = g.sort_values(["prediction", "ticker"])
        k = max(1, round(len(g) * 0.2))
        books.append((d, {**dict.fromkeys(g["ticker"].tail(k), 1 / k), **dict.fromkeys(g["ticker"].head(k), -1 / k)}))
    out = {}
    for i, (d, w) in enumerate(books):
        prev = books[i - lag][1] if i >= lag else {}
        out[d] = 0.5 * sum(abs(w.get(t, 0) - prev.get(t, 0)) for t in set(w) | set(prev))
    return out


@pytest.mark.parametrize("lag", [1, 5])
def test_turnover_against_loop(scores, lag):
    got = tn.turnover(mt.legs(scores, rows=ROWS), lag).toPandas()
    for model, part in scores.toPandas().groupby("model_id"):
        want = _turnover_loop(part, lag)
        mine = got[got["model_id"] == model].set_index("date")["turnover"].to_dict()
        assert mine.keys() == want.keys()
        for d in want:
            assert mine[d] == pytest.approx(want[d])


def test_static_ranking_has_no_turnover_and_costs_hurt(spark):
    base = make_scores(spark, dates=50, tickers=50)
    fixed = base.withColumn("prediction", F.substring("ticker", 2, 2).cast("double")).withColumn("model_id", F.lit("static"))
    out = tn.compare_costs(base.unionByName(fixed), horizon=5, rows=50).toPandas().set_index("model_id")
    assert out.loc["static", "annual_turnover"] == pytest.approx(5 / 50 * 252 / 5)
    assert out.loc["m", "annual_turnover"] > 20
    assert out.loc["m", "after_cost_sharpe_3bp"] > out.loc["m", "after_cost_sharpe_20bp"]
    assert out.loc["m", "gross_long_short_sharpe"] > out.loc["m", "after_cost_sharpe_3bp"]


def test_shuffle_null(scores):
    out = rb.shuffle_null(scores, 30, rows=ROWS).toPandas().set_index("model_id")
    assert abs(out.loc["good", "null_mean"]) < 0.05 and out.loc["good", "p_value"] == 0.0 and out.loc["good", "z_score"] > 5
    assert out.loc["bad", "p_value"] > 0.0


def test_shuffle_null_routes_agree_and_spread_as_uniform_permutations(spark, scores, small_tasks):
    frame = scores.withColumn("date", F.when(F.col("date") != "2022-01-05", F.col("date")))
    whole = rb.shuffle_null(frame, 40, rows=small_tasks).orderBy("model_id").toPandas()
    split = rb.shuffle_null(frame, 40, rows=small_tasks + 1).orderBy("model_id").toPandas()
    assert np.allclose(whole.drop(columns="model_id").astype(float), split.drop(columns="model_id").astype(float), atol=1e-9)
    sizes = mt.scored(scores).groupBy("model_id", "date").count().toPandas().groupby("model_id")["count"]
    expected = sizes.apply(lambda n: np.sqrt((1 / (n - 1)).sum()) / len(n))
    many = rb.shuffle_null(scores, 1000, rows=ROWS).toPandas().set_index("model_id")
    assert (many["n_iterations"] == 1000).all()
    assert ((many["null_std"] / expected.loc[many.index] - 1).abs() < 0.1).all()
    assert (many["null_mean"].abs() < 4 * expected.loc[many.index] / np.sqrt(1000)).all()


@pytest.mark.parametrize("n", [1, 2, 5, 7, 10, 25, 26, 97, 500, 10_007])
def test_shuffles_are_permutations(n):
    moved = rb.Shuffles(1, "2020-01-02", range(60), n).of(np.arange(n))
    assert (np.sort(moved, axis=1) == np.arange(n)).all()
    some = np.arange(0, n, 3)[::-1]
    assert (rb.Shuffles(1, "2020-01-02", range(60), n).of(some) == moved[:, some]).all()
    if n > 5:
        assert (rb.Shuffles(2, "2020-01-02", range(60), n).of(np.arange(n)) != moved).any()


@pytest.mark.parametrize("n", [6, 10, 25, 61, 400])
def test_shuffles_spread_as_uniform_permutations(n):
    """Every place is hit alike, and the rank correlation with a fixed order has mean 0 and variance 1 / (n - 1)."""
    draws = 20_000
    moved = rb.Shuffles(3, "d", range(draws), n).of(np.arange(n))
    hits = np.bincount(moved[:, 0], minlength=n)
    assert (abs(hits - draws / n) < 6 * np.sqrt(draws / n)).all()
    pairs = np.bincount(moved[:, 0] * n + moved[:, n // 2], minlength=n * n).reshape(n, n)
    off, expected = pairs[~np.eye(n, dtype=bool)], draws / (n * (n - 1))
    if expected > 5:
        assert ((off - expected) ** 2).sum() / expected < off.size + 8 * np.sqrt(2 * off.size) + 0.005 * draws
    for fixed in (np.arange(n), np.arange(n)[::-1] % 3, (np.arange(n) * 7919) % n):
        a, z = fixed - fixed.mean(), moved - (n - 1) / 2
        ic = (z @ a) / np.sqrt((a @ a) * (n * (n * n - 1) / 12))
        assert abs(ic.mean()) * np.sqrt(n - 1) < 0.05
        assert ic.var() * (n - 1) == pytest.approx(1, abs=0.05)
        assert (ic**4).mean() / ic.var() ** 2 < 3.2


@pytest.mark.parametrize("block", [8192, 4])
def test_shuffle_null_against_plain_loop(spark, monkeypatch, block):
    monkeypatch.setattr(rb, "BLOCK_PLACES", block)
    frame = make_scores(spark, dates=9, tickers=13, strength=0.4).withColumn(
        "realized", F.when(F.col("date") == "2022-01-04", 1.0).when(F.col("date") == "2022-01-05", F.round("realized", 0)).otherwise(F.col("realized"))
    )
    frame = frame.where("not (date = '2022-01-06' and ticker > 'T02')").withColumn("prediction", F.round("prediction", 1))
    frame = frame.withColumn("date", F.when(F.col("date") != "2022-01-07", F.col("date")))
    out = rb.shuffle_null(frame, 50, 7, rows=13).first()
    means = np.zeros(50)
    dates = 0
    for day, part in frame.toPandas().groupby("date", dropna=False):
        if len(part) < 5:
            continue
        dates += 1
        part = part.sort_values(["realized", "ticker"])
        left = part["prediction"].rank().to_numpy()
        if left.std() == 0 or part["realized"].nunique() == 1:
            continue
        moved = rb.Shuffles(7, "" if day != day or day is None else str(day), range(50), len(part)).of(np.arange(len(part)))
        means += [np.corrcoef(left, m)[0, 1] for m in moved]
    means /= dates
    assert (out["null_mean"], out["null_std"]) == pytest.approx((means.mean(), means.std()))
    assert out["p_value"] == pytest.approx((means >= out["observed_ic"]).mean())


def test_bootstrap_against_plain_loop(scores):
    out = rb.bootstrap_ic(scores, 60, 5, rows=ROWS).toPandas().set_index("model_id")
    daily = mt.daily_ic(scores, rows=ROWS).toPandas().sort_values("date")
    for model, part in daily.groupby("model_id"):
        ic = part["ic"].to_numpy()
        picks = [[int(hashlib.md5(f"5|{b}|{i}".encode()).hexdigest()[:8], 16) % len(ic) for i in range(len(ic))] for b in range(60)]
        means = ic[np.array(picks)].mean(axis=1)
        got = out.loc[model]
        assert [got["p05"], got["p50"], got["p95"]] == pytest.approx(np.percentile(means, [5, 50, 95]).tolist())
        assert got["n_bootstrap"] == 60 and got["n_dates"] == len(ic)


def test_bootstrap(scores):
    out = rb.bootstrap_ic(scores, 200, rows=ROWS).toPandas().set_index("model_id")
    assert out.loc["good", "excludes_zero"] and not out.loc["bad", "excludes_zero"]
    assert (out["p05"] < out["p50"]).all() and (out["p50"] < out["p95"]).all()
    assert out.loc["good", "p50"] == pytest.approx(out.loc["good", "point_estimate"], abs=0.02)


def test_buckets(scores):
    buckets = rb.bucket_returns(scores, 5, rows=ROWS)
    good = buckets.where("model_id = 'good'").orderBy("bucket").toPandas()
    assert good["bucket"].tolist() == [1, 2, 3, 4, 5] and good["mean_realized"].is_monotonic_increasing
    assert rb.is_monotonic(buckets).where("model_id = 'good'").first()["steps_up"] == 4
    assert rb.bucket_returns(scores, 31, rows=ROWS).isEmpty()


def test_time_split_partitions(scores):
    out = mt.time_split(scores, "2022-02-01", rows=ROWS)
    total = out.groupBy("model_id").agg(F.sum("n_observations").alias("n"), F.sum("n_dates").alias("d")).first()
    assert total["n"] == 1800 and total["d"] == 60


def test_residuals_of_several_targets_are_those_of_each(spark):
    """Missing values in one target do not change the other; null dates and models keep their rows."""
    df = make_scores(spark, dates=6, tickers=15).withColumn("x", noise(1, "ticker", "date") + 1e6)
    df = df.withColumns(
        {
            "realized": F.when(noise(3, "ticker", "date") > 0.2, F.col("realized")),
            "x": F.when(noise(4, "ticker", "date") > 0.1, F.col("x")),
            "date": F.when(F.col("date") != "2022-01-04", F.col("date")),
        }
    )
    both = residualize(df, ["prediction", "realized"], ["x"]).toPandas().sort_values(["date", "ticker"], ignore_index=True)
    one = residualize(residualize(df, "prediction", ["x"]), "realized", ["x"]).toPandas().sort_values(["date", "ticker"], ignore_index=True)
    assert len(both) == 90 and both["date"].isna().sum() == 15
    for c in ("prediction", "realized"):
        np.testing.assert_allclose(both[c], one[c], atol=1e-9)
    raw = df.toPandas()
    for d, part in raw.groupby("date", dropna=False):
        full = part.dropna(subset=["x", "realized"])
        a = np.column_stack([np.ones(len(full)), full["x"] - 1e6])
        want = full["realized"] - a @ np.linalg.lstsq(a, full["realized"], rcond=None)[0]
        mine = both[both["date"].isna() if d != d or d is None else both["date"] == d].set_index("ticker")["realized"]
        np.testing.assert_allclose(mine.loc[full["ticker"]], want, atol=1e-8)


def test_residuals_against_lstsq(spark):
    df = make_scores(spark, dates=8, tickers=20).withColumn("x", noise(1, "ticker", "date")).withColumn("z", noise(2, "ticker", "date"))
    out = residualize(df, "prediction", ["x", "z"]).toPandas()
    raw = df.toPandas()
    for d, part in raw.groupby("date"):
        a = np.column_stack([np.ones(len(part)), part["x"], part["z"]])
        want = part["prediction"] - a @ np.linalg.lstsq(a, part["prediction"], rcond=None)[0]
        got = out[out["date"] == d].set_index("ticker")["prediction"]
        np.testing.assert_allclose(got.loc[part["ticker"]], want, atol=1e-10)
    thin = residualize(df.where("ticker < 'T03'"), "prediction", ["x", "z"]).toPandas().sort_values(["date", "ticker"])
    same = df.where("ticker < 'T03'").toPandas().sort_values(["date", "ticker"])
    np.testing.assert_allclose(thin["prediction"], same["prediction"])


def test_neutralization_kills_factor_signal(spark):
    df = make_scores(spark, dates=40, tickers=50, strength=0.0)
    f = noise(5, "date", "ticker") - 0.5
    df = df.withColumn("f", f).withColumn("prediction", F.col("f") + 0.01 * F.col("prediction"))
    df = df.withColumn("realized", F.col("f") + 0.05 * F.col("realized"))
    out = neutralized_ic(df, ["f"], rows=50).first()
    assert out["ic_gross"] > 0.9 and abs(out["ic_neutralized"]) < 0.1
    none = neutralized_ic(df, [], rows=50).first()
    assert none["delta"] == 0.0 and none["ic_gross"] == none["ic_neutralized"]


def test_deflated_sharpe_falls_with_trials(scores):
    ret = mt.long_short(scores, rows=ROWS)
    few, many = (mt.deflated_sharpe(ret, n, 5).toPandas().set_index("model_id") for n in (2, 500))
    assert (few["prob_positive"] >= many["prob_positive"]).all()
    assert few.loc["good", "expected_max_sharpe"] == pytest.approx(math.sqrt(2 * math.log(2) / 60))


def test_durbin_watson_against_numpy(spark, small_tasks):
    df = make_scores(spark, dates=40, tickers=25).select("ticker", "date", F.col("realized").alias("residual"))
    e = df.toPandas().sort_values(["ticker", "date"])["residual"].to_numpy()
    got = dg.durbin_watson(df).first()["durbin_watson"]
    assert got == pytest.approx(np.sum(np.diff(e) ** 2) / np.sum(e**2))


def test_clusters(spark):
    pairs = spark.createDataFrame([("a", "b", 0.9), ("b", "c", 0.9), ("x", "y", -0.95)], "feature_a string, feature_b string, corr double")
    gain = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("c", 2.0), ("x", 5.0), ("y", 4.0), ("z", 0.1)], "feature string, importance double")
    clusters = dg.redundancy_clusters(pairs, gain)
    assert {(r["feature"], r["place"]) for r in clusters.collect()} == {("b", 1), ("c", 2), ("a", 3), ("x", 1), ("y", 2)}
    drops = {r["feature"] for r in dg.suggested_drops(clusters, gain, 1).collect()}
    assert drops == {"a", "c", "y", "z"}


def test_smoothing(spark):
    df = make_scores(spark, dates=50, tickers=5)
    out = smooth_predictions(df, 10).toPandas().sort_values(["ticker", "date"])
    raw = df.toPandas().sort_values(["ticker", "date"])
    for t, part in raw.groupby("ticker"):
        want = part["prediction"].ewm(halflife=10, adjust=False).mean()
        np.testing.assert_allclose(out[out["ticker"] == t]["prediction"], want, rtol=1e-10)
    with pytest.raises(ValueError):
        smooth_predictions(df, 0)
    with pytest.raises(ValueError):
        smooth_predictions(df.drop("date"), 5)


# ---- ensembles ----------------------------------------------------------------------


@pytest.fixture(scope="module")
def three(spark):
    frames = [make_scores(spark, dates=80, seed=s, model=m) for m, s in (("a", 7), ("b", 70), ("c", 700))]
    # One target for all models, driven by model a most.
    base = frames[0].select("date", "ticker", F.col("prediction").alias("pa"))
    target = base.withColumn("realized", 2 * F.col("pa") + 0.3 * (noise(1, "date", "ticker") - 0.5)).drop("pa")
    out = None
    for f in frames:
        part = f.drop("realized").join(target, ["date", "ticker"])
        out = part if out is None else out.unionByName(part)
    return out.cache()


def test_rank_average(three):
    out = en.rank_average(three, ["a", "b", "c"], rows=ROWS).toPandas()
    pdf = three.toPandas()
    pdf["r"] = pdf.groupby(["model_id", "date"])["prediction"].rank() / pdf.groupby(["model_id", "date"])["prediction"].transform("count")
    want = pdf.groupby(["date", "ticker"])["r"].mean()
    np.testing.assert_allclose(out.set_index(["date", "ticker"])["prediction"].sort_index(), want.sort_index())


@pytest.mark.parametrize("kind", ["ridge", "nnls"])
@pytest.mark.parametrize("buckets", [1, 3])
def test_stacks_weigh_the_good_model_most(spark, three, kind, buckets):
    days = three.select("date").distinct().withColumn("dispersion", noise(3, "date"))
    wide = en.prediction_matrix(three.join(days, "date"), ["a", "b", "c"], ["realized", "dispersion"], ROWS)
    out, stacks = en.stack_ensemble(wide, ["a", "b", "c"], kind, buckets)
    assert len(stacks) == buckets
    for s in stacks:
        assert s.coef[0] > 5 * max(abs(s.coef[1]), abs(s.coef[2]))
        assert kind == "ridge" or min(s.coef) >= 0
    assert out.where("ensemble_prediction is null").isEmpty() and out.count() == 40 * 30


def test_softmax_weights(spark):
    ic = spark.createDataFrame([(0, "a", 0.05), (0, "b", 0.01)], "bucket int, model_id string, mean_ic double")
    got = {(r["bucket"], r["model_id"]): r["weight"] for r in en.softmax_weights(ic, ["a", "b", "c"], 2, 100.0).collect()}
    e = np.exp(100 * np.array([0.05, 0.01, 0.0]))
    assert [got[0, m] for m in "abc"] == pytest.approx(list(e / e.sum()))
    assert [got[1, m] for m in "abc"] == pytest.approx([1 / 3] * 3)


def test_walk_forward_weights_use_only_the_window(three):
    days = three.select("date").distinct().withColumn("dispersion", noise(3, "date"))
    out = en.walk_forward_softmax(three, days, ["a", "b", "c"], 2, 10, 10, 2, rows=ROWS)
    assert out.select("date").distinct().count() == 80 - 22
    changed = three.withColumn("realized", F.when(F.col("date") > "2022-03-20", -F.col("realized")).otherwise(F.col("realized")))
    again = en.walk_forward_softmax(changed, days, ["a", "b", "c"], 2, 10, 10, 2, rows=ROWS)
    early = F.col("date") <= "2022-03-20"
    a = out.where(early).orderBy("date", "ticker").toPandas()["prediction"]
    np.testing.assert_allclose(a, again.where(early).orderBy("date", "ticker").toPandas()["prediction"], atol=1e-12)


def test_position_blend(spark):
    df = spark.createDataFrame([(1, 3.0, 1.0, 2.0)], "id int, a double, b double, c double")
    w, pw = [0.5, 0.3, 0.2], [0.1, 0.0, -0.1]
    asc = 1.0 * (0.3 + 0.1) + 2.0 * (0.2 + 0.0) + 3.0 * (0.5 - 0.1)
    desc = 3.0 * (0.5 + 0.1) + 2.0 * (0.2 + 0.0) + 1.0 * (0.3 - 0.1)
    got = en.position_blend(df, ["a", "b", "c"], w, pw).first()["prediction"]
    assert got == pytest.approx(0.3 * asc + 0.7 * desc)


def test_regime_buckets(spark):
    panel = make_panel(spark, 5, 60)
    days = dg.dispersion_by_date(panel)
    assert days.count() == 40
    edges = dg.thresholds_of(days, "dispersion", 4)
    counts = [r["n"] for r in days.groupBy(dg.bucket_by("dispersion", edges).alias("g")).agg(F.count("*").alias("n")).orderBy("g").collect()]
    assert counts == [10, 10, 10, 10]
