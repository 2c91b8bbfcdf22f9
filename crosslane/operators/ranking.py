"""Exact ordering inside groups of any size.

Every function here gives the same rows on two routes, null keys included. A
group that fits one task (``crosslane.taskRows``) is ordered by a plain window.
A larger group is dealt by ranges of its values, each range is ordered by its
own task, and the ranges are put together by their counts, so a date or key
that holds a third of all rows is spread over the cluster. ``rows`` is a proven bound of the largest
group; without it the bound is measured by one counting job.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crosslane.session import broadcast_dates, cut, task_rows


def largest_group(df: DataFrame, by: Sequence[str]) -> int:
    """Rows of the largest group; the counts are combined before the shuffle."""
    counted = df.groupBy(*by).count() if by else df.select(F.count(F.lit(1)).alias("count"))
    return int(counted.agg(F.max("count")).first()[0] or 0)


def fits(df: DataFrame, by: Sequence[str], rows: int | None) -> bool:
    bound = largest_group(df, by) if rows is None else rows
    return bound <= task_rows(df.sparkSession)


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on keys that may be null: null meets null. The left side's keys are kept."""
    renamed = right.withColumnsRenamed({k: f"_on_{k}" for k in keys})
    match = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_on_{k}")) for k in keys])
    return left.join(renamed, match, how).drop(*[f"_on_{k}" for k in keys])


def _range_positions(keyed: DataFrame, by: Sequence[str], key: str) -> DataFrame:
    """(by, key, _eq, _less, _n): equal, smaller and total counts for each distinct key.

    Equal keys are counted before the shuffle, so a hot value travels as one row per task. Spark
    deals the distinct keys by ranges of (by, key); a group of any size spreads over consecutive
    ranges, and the counts of the ranges before it place each one. The dealt table is written, so
    every reader and every retried task sees the same ranges.
    """
    parts = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = keyed.groupBy(*by, key).agg(F.count(F.lit(1)).alias("_eq"))
    ranged = cut(counts.repartitionByRange(parts, *by, key).withColumn("_range", F.spark_partition_id()), "ranges")
    over_ranges = Window.partitionBy(*by).orderBy("_range")
    offsets = (
        ranged.groupBy(*by, "_range")
        .agg(F.sum("_eq").alias("_c"))
        .select(
            *by,
            "_range",
            F.coalesce(F.sum("_c").over(over_ranges.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"),
            F.sum("_c").over(Window.partitionBy(*by)).alias("_n"),
        )
    )
    inside = Window.partitionBy(*by, "_range").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("_in", F.coalesce(F.sum("_eq").over(inside), F.lit(0)))
    return join_on(placed, offsets, [*by, "_range"]).select(
        *by, key, "_eq", (F.col("_off") + F.col("_in")).alias("_less"), "_n"
    )


def _grouped(df: DataFrame, by: Sequence[str]) -> tuple[DataFrame, list[str]]:
    return (df, list(by)) if by else (df.withColumn("_all", F.lit(0)), ["_all"])


def add_average_rank(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    rank_as: str,
    count_as: str | None = None,
    rows: int | None = None,
) -> DataFrame:
    """Average rank (1-based) of the non-null ``value`` inside ``by``; null stays null."""
    kept = df.columns
    df, keys = _grouped(df, by)
    temp_count = count_as or "_count"
    if fits(df, keys, rows):
        whole = Window.partitionBy(*keys)
        ordered = whole.orderBy(F.col(value).asc_nulls_last())
        peers = ordered.rangeBetween(Window.currentRow, Window.currentRow)
        out = df.withColumns(
            {
                rank_as: F.when(
                    F.col(value).isNotNull(),
                    F.rank().over(ordered) + (F.count(value).over(peers) - 1) / F.lit(2.0),
                ),
                temp_count: F.count(value).over(whole),
            }
        )
    else:
        df = cut(df, "rank")
        present = df.where(F.col(value).isNotNull())
        positions = _range_positions(present.select(*keys, value), keys, value).select(
            *keys,
            value,
            (F.col("_less") + (F.col("_eq") + 1) / F.lit(2.0)).alias(rank_as),
        )
        totals = present.groupBy(*keys).agg(F.count(F.lit(1)).alias(temp_count))
        out = (
            join_on(join_on(df, positions, [*keys, value], "left"), totals, keys, "left")
            .withColumn(temp_count, F.coalesce(temp_count, F.lit(0)))
        )
    return out.select(*kept, rank_as, *([count_as] if count_as else []))


def add_position(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    position_as: str,
    count_as: str | None = None,
    rows: int | None = None,
) -> DataFrame:
    """1-based place of each row by a unique ``order`` inside ``by`` (all ascending, non-null)."""
    kept = df.columns
    df, keys = _grouped(df, by)
    temp_count = count_as or "_count"
    if fits(df, keys, rows):
        whole = Window.partitionBy(*keys)
        out = df.withColumns(
            {
                position_as: F.row_number().over(whole.orderBy(*order)),
                temp_count: F.count(F.lit(1)).over(whole),
            }
        )
    else:
        df = cut(df, "position").withColumn("_key", F.struct(*order))
        positions = _range_positions(df.select(*keys, "_key"), keys, "_key").select(
            *keys, "_key", (F.col("_less") + 1).alias(position_as), F.col("_n").alias(temp_count)
        )
        out = join_on(df, positions, [*keys, "_key"])
    return out.select(*kept, position_as, *([count_as] if count_as else []))


def quantiles(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    probs: dict[str, float],
    rows: int | None = None,
    nearest: bool = False,
) -> DataFrame:
    """Exact quantiles per group: linear interpolation, or the nearest rank."""
    present = df.where(F.col(value).isNotNull()).select(*by, value)
    present, keys = _grouped(present, by)
    if not nearest and fits(present, keys, rows):
        return (
            present.groupBy(*keys)
            .agg(*[F.percentile(value, F.lit(float(p))).alias(name) for name, p in probs.items()])
            .drop(*([] if by else keys))
        )
    if fits(present, keys, rows):
        whole = Window.partitionBy(*keys)
        counts = present.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_eq"))
        running = whole.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        positions = counts.withColumns(
            {"_n": F.sum("_eq").over(whole), "_less": F.sum("_eq").over(running) - F.col("_eq")}
        )
    else:
        positions = cut(_range_positions(present, keys, value), "quantile")

    def at(place: Column) -> Column:
        return F.max(F.when((F.col("_less") <= place) & (place < F.col("_less") + F.col("_eq")), F.col(value)))

    aggs = []
    for name, p in probs.items():
        spot = (F.col("_n") - 1) * F.lit(float(p))
        if nearest:
            aggs.append(at(F.floor(spot + 0.5)).alias(name))
        else:
            low, high = at(F.floor(spot)), at(F.ceil(spot))
            part = F.max(spot - F.floor(spot))
            aggs.append((low + (high - low) * part).alias(name))
    return positions.groupBy(*keys).agg(*aggs).drop(*([] if by else keys))


def _small_if_dates(table: DataFrame, by: Sequence[str]) -> DataFrame:
    """One row per date is broadcast, so the wide side is not shuffled; other groups are left to Catalyst."""
    return broadcast_dates(table, by[0]) if len(by) == 1 else table


def add_group_stats(
    df: DataFrame, by: Sequence[str], stats: dict[str, Column], rows: int | None = None
) -> DataFrame:
    """Add group aggregates to every row.

    Groups that fit a task use one window. Larger groups are aggregated with
    partial sums and joined back, so no task ever holds a whole group.
    """
    if fits(df, by, rows):
        whole = Window.partitionBy(*by)
        return df.withColumns({name: agg.over(whole) for name, agg in stats.items()})
    kept = df.columns
    df = cut(df, "stats")
    table = df.groupBy(*by).agg(*[agg.alias(name) for name, agg in stats.items()])
    return join_on(df, _small_if_dates(table, by), by, "left").select(*kept, *stats)


def add_group_median(
    df: DataFrame, by: Sequence[str], value: str, median_as: str, rows: int | None = None
) -> DataFrame:
    if fits(df, by, rows):
        return df.withColumn(median_as, F.median(value).over(Window.partitionBy(*by)))
    kept = df.columns
    df = cut(df, "median")
    table = quantiles(df, by, value, {median_as: 0.5}, rows=rows)
    return join_on(df, _small_if_dates(table, by), by, "left").select(*kept, median_as)


def value_at(df: DataFrame, value: str, place: int, rows: int | None = None):
    """The value at 0-based ``place`` of the ascending order of all non-null values."""
    present = df.where(F.col(value).isNotNull()).select(F.lit(0).alias("_all"), value)
    if fits(present, ["_all"], rows):
        whole = Window.partitionBy("_all").orderBy(value)
        counts = present.groupBy("_all", value).agg(F.count(F.lit(1)).alias("_eq"))
        running = whole.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        positions = counts.withColumn("_less", F.sum("_eq").over(running) - F.col("_eq"))
    else:
        positions = _range_positions(present, ["_all"], value)
    hit = positions.where((F.col("_less") <= place) & (F.col("_less") + F.col("_eq") > place)).first()
    return None if hit is None else hit[value]
