"""Combining models: rank averages, stacks, regime weights and rank-position blends."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crosslane.functions.numeric import dot, softmax_share
from crosslane.operators.diagnostics import bucket_by, thresholds_of
from crosslane.operators.folds import date_index
from crosslane.operators.gram import Gram, collect_grams, gram, solve_nnls, solve_ridge
from crosslane.operators.metrics import daily_ic, full_coverage, on_common_dates
from crosslane.operators.ranking import add_average_rank, add_group_stats
from crosslane.session import broadcast_dates, broadcast_if, cut
from crosslane.sources.store import mean_predictions

BY_MODEL_DATE = ("model_id", "date")


def zscore_predictions(df: DataFrame, rows: int | None = None) -> DataFrame:
    stats = {"_m": F.avg("prediction"), "_s": F.stddev_samp("prediction")}
    out = add_group_stats(df, BY_MODEL_DATE, stats, rows)
    scale = F.when(F.col("_s") == 0, 1.0).otherwise(F.col("_s"))
    return out.withColumn("prediction", (F.col("prediction") - F.col("_m")) / scale).drop("_m", "_s")


def rank_average(df: DataFrame, models: Sequence[str], name: str = "rank_average", rows: int | None = None) -> DataFrame:
    """(model_id, date, ticker, prediction): mean rank share over the pairs all models cover."""
    covered = full_coverage(df.where(F.col("model_id").isin(list(models))), len(models))
    ranked = add_average_rank(covered, BY_MODEL_DATE, "prediction", "_r", "_n", rows)
    share = F.avg(F.col("_r") / F.col("_n"))
    return ranked.groupBy("date", "ticker").agg(share.alias("prediction")).withColumn("model_id", F.lit(name))


def prediction_matrix(
    df: DataFrame, models: Sequence[str], keep: Sequence[str], rows: int | None = None
) -> DataFrame:
    """z-scored predictions, one column per model, on the dates all models share; full rows only."""
    scores = df.where(F.col("model_id").isin(list(models))).select("date", "ticker", *keep, "model_id", "prediction")
    extra = [F.max(c).alias(c) for c in keep]
    mean = scores.groupBy("date", "ticker", "model_id").agg(F.avg("prediction").alias("prediction"), *extra)
    wide = (
        zscore_predictions(on_common_dates(mean), rows)
        .groupBy("date", "ticker")
        .agg(
            *extra,
            *[F.max(F.when(F.col("model_id") == m, F.col("prediction"))).alias(m) for m in models],
        )
    )
    return wide.dropna(subset=[*models, *[c for c in keep if c == "realized"]])


def midpoint(df: DataFrame):
    """Distinct date number n // 2: the first date of the second half."""
    index = date_index(df)
    return index.where(F.col("idx") == index.count() // 2).first()["date"]


@dataclass(frozen=True)
class Stack:
    bucket: int
    models: tuple[str, ...]
    coef: tuple[float, ...]
    intercept: float
    alpha: float | None

    def column(self):
        return dot(self.models, self.coef, self.intercept)


# 40 points from 1e-3 to 1e5 on a log scale, 5 folds, 100 rows per bucket.
RIDGE_GRID = tuple(float(a) for a in np.logspace(-3, 5, 40))
STACK_FOLDS, MIN_BUCKET_ROWS = 5, 100


def _fold_grams(train: DataFrame, models: Sequence[str], bucket) -> dict[tuple[int, int], Gram]:
    """Sums per (bucket, fold of consecutive dates): everything the stacks need, in one scan."""
    index = date_index(train)
    n = index.count()
    fold = index.withColumn("_fold", F.floor(F.col("idx") * STACK_FOLDS / n).cast("int")).drop("idx")
    # One row per calendar day.
    marked = train.join(broadcast_dates(fold), "date").withColumn("_bucket", bucket)
    return {
        (r["_bucket"], r["_fold"]): Gram.from_row(r)
        for r in gram(marked, models, "realized", ["_bucket", "_fold"]).collect()
    }


def _total(grams: Sequence[Gram], p: int) -> Gram:
    return sum(grams, Gram.zero(p))


def _r2(g: Gram, coef: np.ndarray, intercept: float) -> float:
    _, _, yy = g.centered()
    return 1.0 - g.squared_error(coef, intercept) / yy if yy > 0 else float("nan")


def pick_ridge_alpha(folds: Sequence[Gram], grid: Sequence[float] = RIDGE_GRID) -> float:
    """The alpha with the best mean R2 on the held-out folds."""
    p = len(folds[0].x_mean)
    best, best_score = grid[0], -math.inf
    for alpha in grid:
        scores = []
        for i, held in enumerate(folds):
            rest = _total([g for j, g in enumerate(folds) if j != i], p)
            coef = solve_ridge(rest, alpha)
            scores.append(_r2(held, coef, rest.intercept(coef)))
        score = float(np.nanmean(scores))
        if score > best_score:
            best, best_score = alpha, score
    return best


def fit_stack(
    train: DataFrame,
    models: Sequence[str],
    kind: str = "ridge",
    thresholds: Sequence[float] = (),
    indicator: str = "dispersion",
) -> list[Stack]:
    """One linear rule per regime bucket (one bucket without thresholds); thin buckets use all rows."""
    bucket = bucket_by(indicator, thresholds) if thresholds else F.lit(0)
    grams = _fold_grams(train, models, bucket)
    p, out = len(models), []
    for b in range(len(thresholds) + 1):
        mine = [g for (gb, _), g in sorted(grams.items()) if gb == b]
        if sum(g.n for g in mine) < MIN_BUCKET_ROWS:
            per_fold: dict[int, Gram] = {}
            for (_, f), g in sorted(grams.items()):
                per_fold[f] = per_fold.get(f, Gram.zero(p)) + g
            mine = list(per_fold.values())
        total = _total(mine, p)
        if kind == "ridge":
            alpha = pick_ridge_alpha(mine)
            coef = solve_ridge(total, alpha)
        elif kind == "nnls":
            alpha, coef = None, solve_nnls(total)
        else:
            raise ValueError(f"unknown stack {kind!r}")
        out.append(Stack(b, tuple(models), tuple(float(c) for c in coef), total.intercept(coef), alpha))
    return out


def apply_stack(df: DataFrame, stacks: Sequence[Stack], thresholds: Sequence[float] = (), indicator: str = "dispersion"):
    """Add ``ensemble_prediction`` by each row's bucket; a row-local expression, no join."""
    bucket = bucket_by(indicator, thresholds) if thresholds else F.lit(0)
    value = None
    for stack in stacks:
        hit = bucket == stack.bucket
        value = F.when(hit, stack.column()) if value is None else value.when(hit, stack.column())
    return df.withColumn("ensemble_prediction", value)


def stack_weights(spark, stacks: Sequence[Stack]) -> DataFrame:
    """(bucket, model_id, coef, share, intercept, n_nonzero, alpha) of fitted stacks."""
    rows = []
    for s in stacks:
        total = sum(abs(c) for c in s.coef)
        nonzero = sum(abs(c) > 1e-12 for c in s.coef)
        for m, c in zip(s.models, s.coef, strict=True):
            rows.append((s.bucket, m, c, c / total if total > 0 else None, s.intercept, nonzero, s.alpha))
    return spark.createDataFrame(
        rows,
        "bucket int, model_id string, coef double, share double, intercept double, n_nonzero int, alpha double",
    )


def stack_ensemble(
    wide: DataFrame, models: Sequence[str], kind: str = "ridge", n_buckets: int = 1
) -> tuple[DataFrame, list[Stack]]:
    """Fit on the first half of the dates, score the second half."""
    wide = cut(wide, "wide")
    half = F.lit(midpoint(wide))
    train, test = wide.where(F.col("date") < half), wide.where(F.col("date") >= half)
    thresholds = thresholds_of(train, "dispersion", n_buckets) if n_buckets > 1 else []
    stacks = fit_stack(train, models, kind, thresholds)
    return apply_stack(test, stacks, thresholds), stacks


def softmax_weights(
    mean_ic: DataFrame, models: Sequence[str], n_buckets: int, temperature: float = 200.0
) -> DataFrame:
    """(bucket, model_id, weight) from mean ICs; a missing model counts 0, an empty bucket is uniform."""
    spark = mean_ic.sparkSession
    grid = spark.createDataFrame([(b, m) for b in range(n_buckets) for m in models], "bucket int, model_id string")
    scored = grid.join(mean_ic, ["bucket", "model_id"], "left").withColumn("_ic", F.coalesce("mean_ic", F.lit(0.0)))
    weight = softmax_share(F.col("_ic"), temperature, Window.partitionBy("bucket"))
    return scored.select("bucket", "model_id", weight.alias("weight"))


def regime_softmax(
    df: DataFrame,
    dispersion: DataFrame,
    models: Sequence[str],
    n_buckets: int = 3,
    temperature: float = 200.0,
    rows: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(second-half predictions, weights): softmax of first-half mean IC per dispersion bucket."""
    eval_df = df.where(F.col("model_id").isin(list(models)))
    scores = mean_predictions(on_common_dates(eval_df))
    realized = eval_df.groupBy("date", "ticker").agg(F.max("realized").alias("realized"))
    # Read by the split date, the edges, the scores and the weighting.
    frame = cut(
        zscore_predictions(scores.join(realized, ["date", "ticker"]).join(broadcast_dates(dispersion), "date"), rows),
        "scores",
    )
    half = F.lit(midpoint(frame))
    train, test = frame.where(F.col("date") < half), frame.where(F.col("date") >= half)
    days = train.select("date", "dispersion").distinct()
    edges = thresholds_of(days, "dispersion", n_buckets, nearest=True)
    bucket = bucket_by("dispersion", edges)
    ic = daily_ic(train, ["model_id"], rows=rows).join(broadcast_dates(days), "date").withColumn("bucket", bucket)
    mean_ic = ic.groupBy("bucket", "model_id").agg(F.avg("ic").alias("mean_ic"))
    weights = softmax_weights(mean_ic, models, n_buckets, temperature)
    # buckets x models rows.
    weighted = test.withColumn("bucket", bucket).join(broadcast_if(weights, n_buckets * len(models)), ["bucket", "model_id"])
    return combine(weighted, len(models)), weights


def combine(weighted: DataFrame, n_models: int) -> DataFrame:
    """Weighted sum per (date, ticker) over the names that every model covers."""
    return (
        weighted.groupBy("date", "ticker")
        .agg(
            F.sum(F.col("prediction") * F.col("weight")).alias("prediction"),
            F.max("realized").alias("realized"),
            F.count("prediction").alias("_have"),
        )
        .where(F.col("_have") == n_models)
        .drop("_have")
    )


def walk_forward_weights(
    ic: DataFrame,
    days: DataFrame,
    models: Sequence[str],
    window: int = 252,
    embargo: int = 6,
    temperature: float = 200.0,
) -> DataFrame:
    """(date, idx, model_id, weight) from the mean IC of the same bucket over the last dates.

    ``days`` has (date, idx, bucket). The window runs over date numbers
    [idx - window - embargo, idx - embargo). Dates x models rows; ordered windows hold one
    model's dates.
    """
    grid = days.withColumn("model_id", F.explode(F.array(*[F.lit(m) for m in models])))
    grid = grid.join(ic.select("date", "model_id", "ic"), ["date", "model_id"], "left")
    frame = (
        Window.partitionBy("bucket", "model_id").orderBy("idx").rangeBetween(-(window + embargo), -(embargo + 1))
    )
    seen = grid.withColumn("_ic", F.avg("ic").over(frame))
    share = softmax_share(F.coalesce("_ic", F.lit(0.0)), temperature, Window.partitionBy("idx"))
    return seen.select("date", "idx", "model_id", share.alias("weight"))


def walk_forward_softmax(
    df: DataFrame,
    dispersion: DataFrame,
    models: Sequence[str],
    n_buckets: int = 3,
    train_window: int = 252,
    rolling_window: int = 252,
    embargo: int = 6,
    temperature: float = 200.0,
    rows: int | None = None,
) -> DataFrame:
    """(date, ticker, prediction, realized) after the burn-in, weights re-estimated on every date."""
    eval_df = df.where(F.col("model_id").isin(list(models)))
    scores = mean_predictions(on_common_dates(eval_df))
    realized = eval_df.groupBy("date", "ticker").agg(F.max("realized").alias("realized"))
    dispersion = cut(dispersion, "dispersion")
    frame = cut(
        zscore_predictions(scores.join(realized, ["date", "ticker"]).join(broadcast_dates(dispersion), "date"), rows),
        "scores",
    )
    days = date_index(frame).join(broadcast_dates(dispersion), "date")
    edges = thresholds_of(days.where(F.col("idx") < train_window), "dispersion", n_buckets, nearest=True)
    days = days.withColumn("bucket", bucket_by("dispersion", edges)).select("date", "idx", "bucket")
    weights = walk_forward_weights(
        daily_ic(frame, ["model_id"], rows=rows), days, models, rolling_window, embargo, temperature
    ).where(F.col("idx") >= train_window + rolling_window + embargo)
    weighted = frame.join(weights, ["date", "model_id"])
    return weighted.groupBy("date", "ticker").agg(
        F.sum(F.coalesce("prediction", F.lit(0.0)) * F.col("weight")).alias("prediction"),
        F.max("realized").alias("realized"),
    )


def position_blend(
    df: DataFrame,
    models: Sequence[str],
    weights: Sequence[float],
    position_weights: Sequence[float],
    ascending_share: float = 0.3,
    descending_share: float = 0.7,
    out: str = "prediction",
) -> DataFrame:
    """Sum of value * (model weight + weight of the value's place in the row), both directions mixed.

    The models are columns, so the row's values are sorted as an array: no shuffle.
    """
    n = len(models)
    places = F.array(*[F.lit(float(w)) for w in position_weights])

    def blend(sign: float):
        items = F.array(
            *[
                F.struct(
                    (F.col(m) * F.lit(sign)).alias("key"),
                    F.lit(i).alias("model"),
                    F.col(m).alias("value"),
                    F.lit(float(weights[i])).alias("weight"),
                )
                for i, m in enumerate(models)
            ]
        )
        terms = F.zip_with(F.sort_array(items), places, lambda s, p: s["value"] * (s["weight"] + p))
        return F.aggregate(terms, F.lit(0.0), lambda total, term: total + term)

    if len(position_weights) != n or len(weights) != n:
        raise ValueError("one weight and one position weight per model")
    return df.withColumn(out, blend(1.0) * F.lit(ascending_share) + blend(-1.0) * F.lit(descending_share))
