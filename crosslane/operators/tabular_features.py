"""Features of a weighted multi-horizon table: keys, an integer time and numeric columns.

A key may hold any share of the rows: ordered windows go through ``add_rolling``,
which cuts long keys into overlapping chunks, and statistics of one time step go
through ``add_group_stats``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crosslane.operators.ranking import add_average_rank, add_group_stats, add_position, quantiles
from crosslane.operators.rolling import add_ewm_mean, add_rolling, full

KEYS = ("code", "sub_code", "sub_category", "horizon")
TIME = ("ts_index",)
# Small terms that keep divisions finite.
EPS_RATIO, EPS_OVER, EPS_LAG = 1e-7, 1e-3, 1e-6


def add_lags(df, columns: Sequence[str], lags: Sequence[int], keys=KEYS, order=TIME, rows=None) -> DataFrame:
    return add_rolling(
        df,
        keys,
        order,
        [lambda w: {f"{c}_lag{k}": F.lag(c, k).over(w) for c in columns for k in lags}],
        back=max(lags),
        rows=rows,
    )


def add_changes(df, columns: Sequence[str], keys=KEYS, order=TIME, rows=None) -> DataFrame:
    """Absolute value, first difference, and relative change with null and infinite as 0."""

    def build(w):
        out = {}
        for c in columns:
            before = F.lag(c).over(w)
            out[f"{c}_abs"] = F.abs(c)
            out[f"{c}_diff"] = F.col(c) - before
            out[f"{c}_pct"] = F.coalesce(F.try_divide(F.col(c), before) - 1.0, F.lit(0.0))
        return out

    return add_rolling(df, keys, order, [build], back=1, rows=rows)


def add_moving(df, columns: Sequence[str], windows: Sequence[int], keys=KEYS, order=TIME, rows=None) -> DataFrame:
    """Mean and deviation of the last rows, from the first row on."""

    def build(w):
        out = {}
        for c in columns:
            for n in windows:
                frame = w.rowsBetween(-(n - 1), 0)
                out[f"{c}_roll{n}"] = F.avg(c).over(frame)
                out[f"{c}_rollstd{n}"] = F.stddev_samp(c).over(frame)
        return out

    return add_rolling(df, keys, order, [build], back=max(windows), rows=rows)


def add_past_moving(df, column: str, windows: Sequence[int], keys=KEYS, order=TIME, rows=None) -> DataFrame:
    """Mean and deviation of the rows before this one (this row is not used)."""

    def build(w):
        out = {}
        for n in windows:
            frame = w.rowsBetween(-n, -1)
            out[f"roll_mean_{n}"] = F.avg(column).over(frame)
            out[f"roll_std_{n}"] = F.stddev_samp(column).over(frame)
        return out

    return add_rolling(df, keys, order, [build], back=max(windows), rows=rows)


def add_strict_moving(df, columns: Sequence[str], n: int = 3, keys=("code",), order=TIME, rows=None) -> DataFrame:
    """Mean of the last ``n`` rows, null until they are there."""
    return add_rolling(
        df,
        keys,
        order,
        [lambda w: {f"{c}_roll_mean{n}": full(F.avg(c), F.col(c), w, n) for c in columns}],
        back=n,
        rows=rows,
    )


def add_ewm(df, columns: Sequence[str], spans: Sequence[int], keys=KEYS, order=TIME, rows=None) -> DataFrame:
    for c in columns:
        for span in spans:
            df = add_ewm_mean(df, keys, order, c, 2.0 / (span + 1.0), f"{c}_ewm{span}", rows=rows)
    return df


def add_pair_features(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Spread, ratio, product and bounded ratio of column pairs."""
    out: dict[str, Column] = {}
    for a, b in pairs:
        x, y = F.col(a), F.col(b)
        out[f"spread_{a}_{b}"] = x - y
        out[f"ratio_{a}_{b}"] = F.try_divide(x, y + EPS_RATIO)
        out[f"{a}_x_{b}"] = x * y
        out[f"{a}_over_{b}"] = x / (F.abs(y) + EPS_OVER)
    return df.withColumns(out)


def add_level_means(df, columns: Sequence[str], levels: Sequence[str], time: str = "ts_index", rows=None) -> DataFrame:
    """Mean over (level, time) and the distance from it."""
    for level in levels:
        stats = {f"{c}_{level}_mean": F.avg(c) for c in columns}
        df = add_group_stats(df, [level, time], stats, rows)
        df = df.withColumns({f"{c}_vs_{level}": F.col(c) - F.col(f"{c}_{level}_mean") for c in columns})
    return df


def add_time_stats(df, columns: Sequence[str], time: str = "ts_index", rows=None) -> DataFrame:
    """Deviation, min, max, range and distances inside each time step, scaled value, z-score, rank share."""
    stats = {}
    for c in columns:
        stats |= {
            f"{c}_ts_mean": F.avg(c),
            f"{c}_ts_std": F.stddev_samp(c),
            f"{c}_ts_min": F.min(c),
            f"{c}_ts_max": F.max(c),
        }
    df = add_group_stats(df, [time], stats, rows)
    out = {}
    for c in columns:
        x = F.col(c)
        out[f"{c}_ts_range"] = F.col(f"{c}_ts_max") - F.col(f"{c}_ts_min")
        out[f"{c}_dist_min"] = x - F.col(f"{c}_ts_min")
        out[f"{c}_dist_max"] = F.col(f"{c}_ts_max") - x
        out[f"{c}_norm_vol"] = x / (F.col(f"{c}_ts_std") + EPS_RATIO)
        out[f"{c}_z"] = (x - F.col(f"{c}_ts_mean")) / (F.col(f"{c}_ts_std") + EPS_RATIO)
    df = df.withColumns(out)
    for c in columns:
        df = add_average_rank(df, [time], c, "_place", "_n", rows)
        df = df.withColumn(f"{c}_rank", F.col("_place") / F.col("_n")).drop("_place", "_n")
    return df


def add_calendar(df: DataFrame, time: str = "ts_index", horizon: str = "horizon") -> DataFrame:
    """Cycles, logs, squares and the horizon interaction of an integer time; one scan for its range."""
    t = F.col(time)
    low, high = df.agg(F.min(time), F.max(time)).first()
    out = {f"ts_mod_{m}": t % m for m in (7, 30, 90)}
    for period, suffix in ((365, ""), (100, "_100")):
        angle = t * F.lit(2.0 * math.pi / period)
        out[f"ts_sin{suffix}"], out[f"ts_cos{suffix}"] = F.sin(angle), F.cos(angle)
    out |= {
        "ts_log": F.log1p(t),
        "ts_sq": t * t,
        "horizon_sq": F.col(horizon) * F.col(horizon),
        "ts_horizon": t * F.col(horizon),
        "ts_norm": (t - F.lit(low)) / F.lit(high - low + 1e-6),
    }
    return df.withColumns(out)


def add_trend(df: DataFrame, lags: Sequence[tuple[int, int]] = ((1, 7), (3, 14), (1, 3)), column: str = "feature_a") -> DataFrame:
    """Lag ratios, trend strength and volatility strength from lag and past-mean columns; nulls as 0."""
    out = {f"lag_ratio_{a}_{b}": F.try_divide(F.col(f"{column}_lag{a}"), F.col(f"{column}_lag{b}") + EPS_LAG) for a, b in lags}
    out["trend_strength"] = F.col("roll_mean_3") - F.col("roll_mean_14")
    out["volatility_strength"] = F.try_divide(F.col("roll_std_7"), F.col("roll_mean_7") + EPS_LAG)
    return df.withColumns(out).fillna(0.0, list(out))


# ---- encodings ----------------------------------------------------------------


def target_encoding(train: DataFrame, column: str, target: str = "y_target") -> DataFrame:
    """(column, mean, std) of the target on training rows only."""
    return train.groupBy(column).agg(F.avg(target).alias("_mean"), F.stddev_samp(target).alias("_std"))


def add_target_encoding(
    df: DataFrame, train: DataFrame, columns: Sequence[str], target: str = "y_target", fallback: str = "global"
) -> DataFrame:
    """Training means (and deviations) per category; unseen categories get the global mean or 0."""
    default = 0.0 if fallback == "zero" else train.agg(F.avg(target)).first()[0]
    for c in columns:
        df = (
            df.join(target_encoding(train, c, target), c, "left")
            .withColumns(
                {f"{c}_mean": F.coalesce("_mean", F.lit(default)), f"{c}_std": F.coalesce("_std", F.lit(0.0))}
            )
            .drop("_mean", "_std")
        )
    return df


def add_frequency(df: DataFrame, train: DataFrame, column: str = "sub_code", time: str = "ts_index", rows=None) -> DataFrame:
    """Training count of the category, its log and dense rank, its count in the time step and their ratio.

    An unseen category counts 1 and ranks behind all categories of ``df``.
    """
    counts = train.groupBy(column).agg(F.count(F.lit(1)).alias("_f"))
    # Dense ranks need only the distinct counts.
    places = counts.select("_f").distinct().withColumn("_all", F.lit(0))
    places = places.withColumn("_r", F.dense_rank().over(Window.partitionBy("_all").orderBy(F.desc("_f")))).drop("_all")
    table = counts.join(places, "_f")
    last = df.select(column).distinct().count()
    df = df.join(table, column, "left")
    df = add_group_stats(df, [time, column], {f"{column}_ts_freq": F.count(F.lit(1))}, rows)
    df = df.withColumns(
        {f"{column}_freq": F.coalesce("_f", F.lit(1)), f"{column}_freq_rank": F.coalesce("_r", F.lit(last))}
    ).drop("_f", "_r")
    return df.withColumns(
        {
            f"{column}_log_freq": F.log1p(f"{column}_freq"),
            f"{column}_rel_freq": F.col(f"{column}_ts_freq") / (F.col(f"{column}_freq") + 1),
        }
    )


def add_pair_frequency(df: DataFrame, train: DataFrame, a: str = "code", b: str = "horizon") -> DataFrame:
    counts = train.groupBy(a, b).agg(F.count(F.lit(1)).alias("_f"))
    out = f"{a}_{b}_freq"
    return df.join(counts, [a, b], "left").withColumn(out, F.coalesce("_f", F.lit(1))).drop("_f")


def categories(df: DataFrame, column: str, limit: int = 1000) -> list:
    """Sorted distinct values; more than ``limit`` raise, since each becomes a column."""
    found = [r[0] for r in df.select(column).distinct().limit(limit + 1).collect()]
    if len(found) > limit:
        raise ValueError(f"{column} has more than {limit} categories")
    return sorted(v for v in found if v is not None)


def add_one_hot(df: DataFrame, column: str, values: Sequence | None = None, prefix: str = "is") -> DataFrame:
    values = categories(df, column) if values is None else values
    return df.withColumns(
        {f"{prefix}_{v}": F.when(F.col(column) == F.lit(v), 1).otherwise(0) for v in values}
    )


def label_codes(frames: Sequence[DataFrame], column: str, rows: int | None = None) -> DataFrame:
    """(value, label): values of all frames in sorted order, numbered from 0."""
    both = None
    for frame in frames:
        part = frame.select(F.col(column).cast("string").alias("value"))
        both = part if both is None else both.unionByName(part)
    values = both.where(F.col("value").isNotNull()).distinct()
    return add_position(values, [], ["value"], "_p", rows=rows).select("value", (F.col("_p") - 1).alias("label"))


def add_label_codes(df: DataFrame, codes: DataFrame, column: str) -> DataFrame:
    table = codes.select(F.col("value").alias("_text"), F.col("label").alias(f"{column}_code"))
    return df.withColumn("_text", F.col(column).cast("string")).join(table, "_text", "left").drop("_text")


# ---- weights and targets --------------------------------------------------------


def soften_weights(
    df: DataFrame, method: str = "sqrt_clip", weight: str = "weight", clip: tuple[float, float] = (0.05, 0.95), rows=None
) -> DataFrame:
    """Root and/or clip the weights at quantiles, then divide by their mean."""
    if method not in ("none", "normalize", "clip", "sqrt", "sqrt_clip"):
        raise ValueError(f"unknown weight method {method!r}")
    w = F.col(weight)
    if method in ("sqrt", "sqrt_clip"):
        w = F.sqrt(F.greatest(w, F.lit(0.0)))
    out = df.withColumn("soft_weight", w)
    if method in ("clip", "sqrt_clip"):
        row = quantiles(out, [], "soft_weight", {"lo": clip[0], "hi": clip[1]}, rows).first()
        out = out.withColumn("soft_weight", F.least(F.greatest("soft_weight", F.lit(row["lo"])), F.lit(row["hi"])))
    mean = out.agg(F.avg("soft_weight")).first()[0]
    return out.withColumn("soft_weight", F.col("soft_weight") / F.lit(mean + 1e-12))


def clip_to_quantiles(
    df: DataFrame, train: DataFrame, column: str, low: float = 0.01, high: float = 0.99, out: str | None = None, rows=None
) -> DataFrame:
    """Clip a column to quantiles of the training rows."""
    row = quantiles(train, [], column, {"lo": low, "hi": high}, rows).first()
    return df.withColumn(out or column, F.least(F.greatest(column, F.lit(row["lo"])), F.lit(row["hi"])))


def clip_to_range(df: DataFrame, column: str, train: DataFrame, target: str) -> DataFrame:
    """Clip predictions to the training target's range."""
    low, high = train.agg(F.min(target), F.max(target)).first()
    return df.withColumn(column, F.least(F.greatest(column, F.lit(low)), F.lit(high)))


def recency_weights(df: DataFrame, weight: str = "weight", time: str = "ts_index") -> DataFrame:
    """weight * (0.6 + 40 * share of the time range passed)."""
    low, high = df.agg(F.min(time), F.max(time)).first()
    share = (F.col(time) - F.lit(low)) / F.lit(high - low + 1e-6)
    return df.withColumn("recency_weight", F.col(weight) * (0.6 + 40.0 * share))


def impute_medians(df: DataFrame, train: DataFrame, columns: Sequence[str], rows=None) -> DataFrame:
    """Nulls to the training median of their column."""
    long = train.unpivot([], list(columns), "column", "value")
    medians = {r["column"]: r["m"] for r in quantiles(long, ["column"], "value", {"m": 0.5}, rows).collect()}
    return df.fillna({c: float(m) for c, m in medians.items()})
