"""Expanding fits per ticker from running sums: one scan serves every refit.

Rows are summed per (ticker, date segment); a segment ends where a refit's training ends. Running sums over a ticker's segments
then hold each refit's training rows. The sums are centred: a segment keeps its own means and centred products, and segments are
added up around one common point per ticker, so a large level of a column does not cancel its spread.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crosslane.session import broadcast_dates

# A pair of columns: (y, x); moments count the rows where both are there.
Pairs = dict[str, tuple[str, str]]


def with_segments(rows: DataFrame, ends: Sequence[date], first: date, column: str = "date") -> DataFrame:
    """Rows up to the last end with ``segment``: the number of the first end that is not before their date.

    ``ends`` ascend; the calendar that carries the segments has one row per day.
    """
    spans, start = [], first
    for number, end in enumerate(ends):
        if end >= start:
            spans.append((number, start, end))
            start = date.fromordinal(end.toordinal() + 1)
    table = rows.sparkSession.createDataFrame(spans, "segment int, _from date, _to date")
    days = table.select("segment", F.explode(F.sequence("_from", "_to")).alias(column))
    return rows.join(broadcast_dates(days, column), column)


def prefix_moments(
    rows: DataFrame, splits: int, pairs: Pairs, counts: dict[str, str], last: dict[str, str], key: str = "ticker"
) -> DataFrame:
    """(key, split, moments): what each of ``splits`` expanding fits sees of each key.

    For a pair ``p``: p_n, p_mx, p_my, p_sxx, p_sxy, p_syy (means and centred sums); ``counts`` are numbers of non-null values,
    ``last`` the newest non-null value. A key without new rows in a segment keeps its sums for the splits that follow; one
    without any rows yet has no row. A key has at most one row per split in the ordered window.
    """
    aggs: list[Column] = []
    for name, (y, x) in pairs.items():
        aggs += [
            F.regr_count(y, x).alias(f"{name}_n"),
            F.regr_avgx(y, x).alias(f"{name}_mx"),
            F.regr_avgy(y, x).alias(f"{name}_my"),
            F.regr_sxx(y, x).alias(f"{name}_sxx"),
            F.regr_sxy(y, x).alias(f"{name}_sxy"),
            F.regr_syy(y, x).alias(f"{name}_syy"),
        ]
    aggs += [F.count(c).alias(n) for n, c in counts.items()]
    aggs += [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("date"))).alias(n) for n, c in last.items()]
    parts = rows.groupBy(key, "segment").agg(*aggs)
    order = Window.partitionBy(key).orderBy("segment")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = {"_next": F.lead("segment").over(order)}
    for name in pairs:
        out |= _added_up(name, so_far)
    out |= {n: F.sum(n).over(so_far) for n in counts}
    out |= {n: F.last(n, ignorenulls=True).over(so_far) for n in last}
    running = parts.select(key, "segment", *[c.alias(n) for n, c in out.items()])
    held = F.sequence(F.col("segment"), F.coalesce(F.col("_next"), F.lit(splits)) - 1)
    return running.withColumn("split", F.explode(held)).drop("segment", "_next")


def _added_up(name: str, so_far) -> dict[str, Column]:
    n, mx, my = (F.col(f"{name}_{c}") for c in ("n", "mx", "my"))
    # The means of the first segment that has rows: the same point on every row of the key that has sums.
    dx = F.coalesce(mx - F.first(mx, ignorenulls=True).over(so_far), F.lit(0.0))
    dy = F.coalesce(my - F.first(my, ignorenulls=True).over(so_far), F.lit(0.0))

    def total(own: str, shift: Column) -> Column:
        return F.sum(F.coalesce(F.col(f"{name}_{own}"), F.lit(0.0)) + n * shift).over(so_far)

    count = F.sum(n).over(so_far)
    some = F.nullif(count, F.lit(0))
    x, y = F.sum(n * dx).over(so_far), F.sum(n * dy).over(so_far)
    return {
        f"{name}_n": count,
        f"{name}_mx": F.first(mx, ignorenulls=True).over(so_far) + x / some,
        f"{name}_my": F.first(my, ignorenulls=True).over(so_far) + y / some,
        f"{name}_sxx": total("sxx", dx * dx) - x * x / some,
        f"{name}_sxy": total("sxy", dx * dy) - x * y / some,
        f"{name}_syy": total("syy", dy * dy) - y * y / some,
    }


def slope(name: str) -> Column:
    return F.try_divide(F.col(f"{name}_sxy"), F.col(f"{name}_sxx"))


def intercept(name: str) -> Column:
    return F.col(f"{name}_my") - slope(name) * F.col(f"{name}_mx")


def pair_correlation(name: str) -> Column:
    return F.try_divide(F.col(f"{name}_sxy"), F.sqrt(F.col(f"{name}_sxx") * F.col(f"{name}_syy")))
