"""Scores, profiles and data-quality reports of a weighted table, and per-horizon training."""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial
from typing import Any

from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from crosslane.functions.numeric import correlation
from crosslane.operators.folds import Fold, expanding_time_folds
from crosslane.operators.ranking import add_average_rank, quantiles, value_at
from crosslane.operators.staged import METRICS, best_round, importances, round_scores, shortened_model
from crosslane.operators.trees import as_vectors, submit_all
from crosslane.session import broadcast_if, cut

# ---- scores ---------------------------------------------------------------------


def weighted_score(
    df: DataFrame, by: Sequence[str] = (), y: str = "y_target", p: str = "prediction", w: str = "weight"
) -> DataFrame:
    """sqrt(1 - clip01(sum w (y - p)^2 / sum w y^2)); 0 when the denominator is not positive."""
    error = F.col(y) - F.col(p)
    top, bottom = F.sum(F.col(w) * error * error), F.sum(F.col(w) * F.col(y) * F.col(y))
    share = F.least(F.greatest(F.try_divide(top, bottom), F.lit(0.0)), F.lit(1.0))
    return df.groupBy(*by).agg(F.when(bottom > 0, F.sqrt(1.0 - share)).otherwise(0.0).alias("score"))


def error_metrics(
    df: DataFrame, by: Sequence[str] = (), y: str = "y_target", p: str = "prediction", w: str = "weight"
) -> DataFrame:
    """Weighted RMSE and MAE (negative weights count 0) and plain MSE, RMSE, MAE."""
    error, weight = F.col(y) - F.col(p), F.greatest(F.col(w), F.lit(0.0))
    total = F.sum(weight) + F.lit(1e-12)
    return df.groupBy(*by).agg(
        F.sqrt(F.sum(weight * error * error) / total).alias("weighted_rmse"),
        (F.sum(weight * F.abs(error)) / total).alias("weighted_mae"),
        F.avg(error * error).alias("mse"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.avg(F.abs(error)).alias("mae"),
    )


# ---- profile --------------------------------------------------------------------


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, NumericType)]


def describe_numeric(df: DataFrame, columns: Sequence[str] | None = None, rows: int | None = None) -> DataFrame:
    """(column, count, mean, std, min, q25, q50, q75, max, iqr): all columns in one pass over long rows."""
    columns = list(columns or numeric_columns(df))
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "column", "value")
    basics = long.groupBy("column").agg(
        F.count("value").alias("count"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    spots = quantiles(long, ["column"], "value", {"q25": 0.25, "q50": 0.5, "q75": 0.75}, rows)
    return basics.join(spots, "column", "left").withColumn("iqr", F.col("q75") - F.col("q25"))


def describe_categorical(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, count, n_unique, top, freq) of text columns; the smallest of equally frequent values."""
    long = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], list(columns), "column", "value")
    counts = long.where(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count(F.lit(1)).alias("_n"))
    best = F.min(F.struct((-F.col("_n")).alias("n"), F.col("value").alias("v")))
    return (
        counts.groupBy("column")
        .agg(F.sum("_n").alias("count"), F.count(F.lit(1)).alias("n_unique"), best.alias("_b"))
        .select("column", "count", "n_unique", F.col("_b.v").alias("top"), (-F.col("_b.n")).alias("freq"))
    )


def column_types(df: DataFrame) -> DataFrame:
    """(data_type, n) of the schema."""
    counts: dict[str, int] = {}
    for _, kind in df.dtypes:
        counts[kind] = counts.get(kind, 0) + 1
    return df.sparkSession.createDataFrame(sorted(counts.items()), "data_type string, n int")


def missing_summary(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, missing, percent) of columns with nulls; one scan."""
    columns = list(columns or df.columns)
    row = df.agg(
        F.count(F.lit(1)).alias("_n"), F.array(*[F.count(F.when(F.col(c).isNull(), 1)) for c in columns]).alias("_m")
    )
    names = F.array(*[F.lit(c) for c in columns])
    return (
        row.select("_n", F.explode(F.arrays_zip(names.alias("column"), F.col("_m").alias("missing"))).alias("_x"))
        .select("_x.column", "_x.missing", (F.col("_x.missing") * 100.0 / F.col("_n")).alias("percent"))
        .where(F.col("missing") > 0)
    )


def duplicate_rows(df: DataFrame) -> DataFrame:
    """(n_rows, n_duplicates): rows that repeat an earlier one."""
    counts = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_c"))
    return counts.agg(F.sum("_c").alias("n_rows"), F.sum(F.col("_c") - 1).alias("n_duplicates"))


def missing_over_time(df: DataFrame, column: str, time: str = "ts_index") -> DataFrame:
    return df.groupBy(time).agg(F.avg(F.col(column).isNull().cast("double")).alias("missing_rate"))


def missing_drift(df: DataFrame, time: str = "ts_index") -> DataFrame:
    """Per time step the mean missing rate over all columns."""
    columns = df.columns
    total = None
    for c in columns:
        rate = F.avg(F.col(c).isNull().cast("double"))
        total = rate if total is None else total + rate
    return df.groupBy(time).agg((total / F.lit(float(len(columns)))).alias("missing_rate"))


def outlier_bounds(
    df: DataFrame, columns: Sequence[str], method: str = "iqr", threshold: float = 2.5, z: float = 3.0, rows=None
) -> dict[str, tuple[float, float]]:
    """Per column the band outside of which a value is an outlier."""
    if method not in ("iqr", "zscore"):
        raise ValueError("method must be 'iqr' or 'zscore'")
    if method == "iqr":
        table = describe_numeric(df, columns, rows).collect()
        return {r["column"]: (r["q25"] - threshold * r["iqr"], r["q75"] + threshold * r["iqr"]) for r in table}
    row = df.agg(*[F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(c) for c in columns]).first()
    return {c: (row[c]["m"] - z * row[c]["s"], row[c]["m"] + z * row[c]["s"]) for c in columns}


def flag_outliers(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns(
        {
            f"{c}_outlier": F.coalesce((F.col(c) < F.lit(low)) | (F.col(c) > F.lit(high)), F.lit(False))
            for c, (low, high) in bounds.items()
        }
    )


def outlier_summary(df: DataFrame, columns: Sequence[str], method: str = "iqr", rows=None, **options) -> DataFrame:
    """(column, outlier_count, percent_outliers)."""
    flagged = flag_outliers(df, outlier_bounds(df, columns, method, rows=rows, **options))
    long = flagged.select(*[F.col(f"{c}_outlier").cast("long").alias(c) for c in columns]).unpivot(
        [], list(columns), "column", "hit"
    )
    return long.groupBy("column").agg(
        F.sum("hit").alias("outlier_count"), (F.avg("hit") * 100.0).alias("percent_outliers")
    )


def target_correlations(df: DataFrame, features: Sequence[str], target: str = "y_target", rows=None) -> DataFrame:
    """(feature, spearman, pearson): rank correlation over full pairs, Pearson with nulls as 0."""
    long = df.unpivot([target], list(features), "feature", "value").where(F.col(target).isNotNull())
    pearson = long.groupBy("feature").agg(correlation(F.coalesce("value", F.lit(0.0)), F.col(target)).alias("pearson"))
    pairs = long.where(F.col("value").isNotNull())
    pairs = add_average_rank(pairs, ["feature"], "value", "_rv", rows=rows)
    pairs = add_average_rank(pairs, ["feature"], target, "_rt", rows=rows)
    spearman = pairs.groupBy("feature").agg(correlation("_rv", "_rt").alias("spearman"))
    return spearman.join(pearson, "feature", "full").select("feature", "spearman", "pearson")


def weight_profile(df: DataFrame, target: str = "y_target", weight: str = "weight", rows=None) -> DataFrame:
    """One row: moments, high percentiles and correlations of the weight."""
    size = F.abs(F.col(target))
    base = df.agg(
        F.avg(weight).alias("mean"),
        F.stddev_samp(weight).alias("std"),
        F.min(weight).alias("min"),
        F.max(weight).alias("max"),
        correlation(weight, target).alias("corr_target"),
        correlation(F.col(weight), size).alias("corr_abs_target"),
    ).withColumn("_k", F.lit(0))
    spots = quantiles(df, [], weight, {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99, "p999": 0.999}, rows)
    return base.join(spots.withColumn("_k", F.lit(0)), "_k").drop("_k")


def top_weight_share(df: DataFrame, weight: str = "weight", share: float = 0.1, rows=None) -> DataFrame:
    """Share of the total weight in the heaviest ``share`` of the rows.

    The weight of the last row inside is an order statistic; heavier rows are summed and rows of
    that weight fill the rest, so no global sort is needed.
    """
    n = df.where(F.col(weight).isNotNull()).count()
    k = int(n * share)
    if k == 0:
        return df.agg(F.lit(0.0).alias("top_share"))
    edge = F.lit(value_at(df, weight, n - k, rows))
    above = F.col(weight) > edge
    inside = F.coalesce(F.sum(F.when(above, F.col(weight))), F.lit(0.0)) + (k - F.count(F.when(above, 1))) * edge
    return df.agg((inside / F.sum(weight)).alias("top_share"))


def heaviest_time(df: DataFrame, weight: str = "weight", time: str = "ts_index") -> DataFrame:
    """(ts, share): the time step with most weight."""
    sums = df.groupBy(time).agg(F.sum(weight).alias("_w"))
    return sums.agg(
        F.min(F.struct((-F.col("_w")).alias("w"), F.col(time).alias("t")))["t"].alias(time),
        (F.max("_w") / F.sum("_w")).alias("share"),
    )


def spread_over_time(df: DataFrame, columns: Sequence[str], time: str = "ts_index") -> DataFrame:
    return df.groupBy(time).agg(*[F.stddev_samp(c).alias(f"{c}_std") for c in columns])


def target_moments(df: DataFrame, target: str = "y_target", by: str = "horizon") -> DataFrame:
    """Mean, deviation and bias-corrected skewness and excess kurtosis."""
    n, g1, g2 = F.col("n"), F.col("_g1"), F.col("_g2")
    base = df.groupBy(by).agg(
        F.count(target).alias("n"),
        F.avg(target).alias("mean"),
        F.stddev_samp(target).alias("std"),
        F.skewness(target).alias("_g1"),
        F.kurtosis(target).alias("_g2"),
    )
    skew = F.when(n > 2, g1 * F.sqrt(n * (n - 1)) / (n - 2))
    kurt = F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6.0))
    return base.withColumns({"skew": skew, "kurt": kurt}).drop("_g1", "_g2")


def names_per_time(df: DataFrame, by: str = "horizon", time: str = "ts_index", name: str = "sub_code") -> DataFrame:
    """Mean number of rows per time step for each horizon."""
    per_time = df.groupBy(by, time).agg(F.count(name).alias("_n"))
    return per_time.groupBy(by).agg(F.avg("_n").alias("avg_names"))


def prediction_summary(df: DataFrame, by: str = "horizon", column: str = "prediction") -> DataFrame:
    return df.groupBy(by).agg(
        F.min(column).alias("min"), F.max(column).alias("max"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("std")
    )


def category_ranges(df: DataFrame, category: str, target: str, top_k: int = 10, method: str = "iqr", rows=None) -> DataFrame:
    """(category, n, range) of the most frequent categories: distance of quartiles, or of min and max."""
    if method not in ("iqr", "minmax"):
        raise ValueError("method must be 'iqr' or 'minmax'")
    top = df.groupBy(category).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), category).limit(top_k)
    part = df.join(broadcast_if(top.select(category), top_k), category, "left_semi")
    if method == "iqr":
        spots = quantiles(part, [category], target, {"lo": 0.25, "hi": 0.75}, rows)
    else:
        spots = part.groupBy(category).agg(F.min(target).alias("lo"), F.max(target).alias("hi"))
    return top.join(spots, category).select(category, "n", (F.col("hi") - F.col("lo")).alias("range"))


# ---- training -------------------------------------------------------------------


def importance_summary(importances: DataFrame, top_k: int | None = None) -> DataFrame:
    """(feature, mean, std, count) over folds, best mean first and steadier first on ties."""
    out = importances.groupBy("feature").agg(
        F.avg("importance").alias("mean"), F.stddev_samp("importance").alias("std"), F.count("importance").alias("count")
    )
    out = out.orderBy(F.desc("mean"), F.asc_nulls_last("std"), "feature")
    return out if top_k is None else out.limit(top_k)


def train_by_horizon(
    df: DataFrame,
    features: Sequence[str],
    n_folds: int = 2,
    seeds: Sequence[int] = (42,),
    keys: Sequence[str] = ("id",),
    target: str = "y_target",
    weight: str = "weight",
    time: str = "ts_index",
    params: dict[str, Any] | None = None,
    metric: str = "weighted_score",
    patience: int = 0,
    parallel: int = 4,
) -> dict[str, DataFrame]:
    """Per horizon and fold: weighted boosted trees, seeds averaged, predictions kept out of fold.

    Returns ``oof`` (keys, horizon, fold, target, weight, prediction), ``scores`` per horizon, ``importances`` per fold and
    ``curves`` (horizon, fold, seed, round, score, kept). With ``patience`` every ensemble is cut after its best round by the
    named metric on the fold's held-out rows. Features are put into vectors once for all fits; horizons and folds are ranges of
    that one persisted table. Every fit is distributed over the rows; ``parallel`` of them run at a time.
    """
    options = {"maxIter": 500, "maxDepth": 5, "stepSize": 0.05, "maxBins": 32, **(params or {})}
    spark = df.sparkSession
    steps = df.groupBy("horizon", time).agg(F.count(F.lit(1)).alias("_n"))
    numbered = steps.withColumn("idx", F.row_number().over(Window.partitionBy("horizon").orderBy(time)) - 1).drop("_n")
    sizes = {r["horizon"]: r["n"] for r in numbered.groupBy("horizon").agg(F.max("idx").alias("n")).collect()}
    table = as_vectors(df.join(broadcast_if(numbered, sum(n + 1 for n in sizes.values())), ["horizon", time]), list(features))
    table = table.persist()

    def fit(horizon: int, fold: Fold) -> tuple[DataFrame, list, list]:
        part = table.where(F.col("horizon") == F.lit(horizon))
        train = part.where(F.col("idx") < fold.train_to)
        held = part.where((F.col("idx") >= fold.val_from) & (F.col("idx") < fold.val_to))
        names, gains, curves, out = [], [], [], held
        for seed in seeds:
            model = GBTRegressor(featuresCol="_features", labelCol=target, weightCol=weight, seed=int(seed), **options).fit(train)
            scores = round_scores(model, held, target, METRICS[metric], weight)
            kept = best_round(scores, patience) if patience > 0 else len(scores)
            if kept < len(scores):
                model = shortened_model(model, kept)
            curves += [(int(horizon), fold.fold, int(seed), n, float(s), n <= kept) for n, s in enumerate(scores, start=1)]
            names.append(f"_p{seed}")
            out = model.setPredictionCol(names[-1]).transform(out)
            shares = importances(model, len(features))
            gains += [(int(horizon), fold.fold, f, g) for f, g in zip(features, shares, strict=True)]
        mean = sum((F.col(n) for n in names[1:]), F.col(names[0])) / float(len(names))
        out = out.select(*keys, "horizon", F.lit(fold.fold).alias("fold"), target, weight, mean.alias("prediction"))
        return cut(out, "oof"), gains, curves

    try:
        tasks = [partial(fit, h, fold) for h in sorted(sizes) for fold in expanding_time_folds(sizes[h] + 1, n_folds)]
        results = submit_all(spark, tasks, parallel)
    finally:
        table.unpersist()
    oof = results[0][0]
    for part, _, _ in results[1:]:
        oof = oof.unionByName(part)
    return {
        "oof": oof,
        "scores": weighted_score(oof, ["horizon"], target, "prediction", weight),
        "importances": spark.createDataFrame(
            [g for _, gains, _ in results for g in gains], "horizon int, fold int, feature string, importance double"
        ),
        "curves": spark.createDataFrame(
            [c for _, _, curves in results for c in curves],
            "horizon int, fold int, seed int, round int, score double, kept boolean",
        ),
    }
