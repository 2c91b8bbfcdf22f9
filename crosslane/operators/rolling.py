"""Row-based rolling windows per key, exact for keys of any length.

A key that fits one task is one window partition. A longer key is cut into
chunks of consecutive rows; each chunk also gets the ``back`` rows before it
(and ``forward`` rows after it), so every frame is complete inside its chunk.

Exponential weights reach back without end. There each chunk is summed up as one
small state, the states of all earlier chunks are combined by a prefix scan, and
the result is handed to the chunk: exact for any run of nulls and any length.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from crosslane.operators.ranking import add_position, join_on, largest_group
from crosslane.session import task_rows

Exprs = Callable[[WindowSpec], dict[str, Column]]


def full(agg: Column, over: Column, window: WindowSpec, n: int) -> Column:
    """``agg`` over the last ``n`` rows, null until ``n`` non-null values are there."""
    frame = window.rowsBetween(-(n - 1), 0)
    return F.when(F.count(over).over(frame) == n, agg.over(frame))


def in_chunks(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: int,
    back: int,
    forward: int = 0,
    rows: int | None = None,
) -> DataFrame:
    """Number the rows of each key (``_rn``) and copy them to the chunks whose frames need them."""
    numbered = add_position(df, keys, order, "_rn", "_len", rows=rows)
    index = F.col("_rn") - 1
    last = F.floor((F.col("_len") - 1) / chunk)
    first_chunk = F.greatest(F.lit(0), F.floor((index - forward) / chunk))
    last_chunk = F.least(last, F.floor((index + back) / chunk))
    return (
        numbered.withColumn("_chunk", F.explode(F.sequence(first_chunk, last_chunk)))
        .withColumn("_own", F.col("_chunk") == F.floor(index / chunk))
        .drop("_len")
    )


def add_rolling(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    stages: Sequence[Exprs],
    back: int,
    forward: int = 0,
    rows: int | None = None,
) -> DataFrame:
    """Apply stages of window expressions; ``back``/``forward`` is the reach of all stages together."""
    bound = largest_group(df, keys) if rows is None else rows
    if bound <= task_rows(df.sparkSession):
        window = Window.partitionBy(*keys).orderBy(*order)
        for stage in stages:
            df = df.withColumns(stage(window))
        return df
    chunk = max(task_rows(df.sparkSession), 4 * (back + forward))
    parts = in_chunks(df, keys, order, chunk, back, forward, rows=bound)
    window = Window.partitionBy(*keys, "_chunk").orderBy("_rn")
    for stage in stages:
        parts = parts.withColumns(stage(window))
    return parts.where("_own").drop("_rn", "_chunk", "_own")


# Room for (1 - alpha) ** -position in one chunk; its square must stay finite.
_EXPONENT_ROOM = 340.0
# Chunk states that one window of the scan combines; the windows' own totals are combined by a second level.
_SCAN_SPAN = 1024

Combine = Callable[[Column, Column], Column]


def _check(alpha: float) -> None:
    if not 0.0 < alpha < 1.0:
        raise ValueError(f"alpha must lie between 0 and 1, got {alpha}")


def _either(combine: Combine, before: Column, after: Column) -> Column:
    """``combine``, where a missing state is the neutral one."""
    return F.when(before.isNull(), after).when(after.isNull(), before).otherwise(combine(before, after))


def _running(states: DataFrame, by: Sequence[str], place: str, combine: Combine, length: int) -> DataFrame:
    """Each ``_state`` combined with all before it inside ``by``: every round doubles how far back it reaches."""
    order = Window.partitionBy(*by).orderBy(place)
    reach = 1
    while reach < length:
        states = states.withColumn("_before", F.lag("_state", reach).over(order))
        states = states.withColumn("_state", _either(combine, F.col("_before"), F.col("_state"))).drop("_before")
        reach *= 2
    return states


def _earlier_states(states: DataFrame, keys: Sequence[str], combine: Combine, chunks: int) -> DataFrame:
    """(keys, _chunk, _in): the combined state of all chunks before this one; null where none holds a value.

    Two levels: spans of ``_SCAN_SPAN`` chunks, and the totals of the spans, so that no task holds all states of a long key.
    """
    spans = math.ceil(chunks / _SCAN_SPAN)
    states = states.withColumn("_span", F.floor(F.col("_chunk") / _SCAN_SPAN))
    inside = _running(states, [*keys, "_span"], "_chunk", combine, min(chunks, _SCAN_SPAN))
    order = Window.partitionBy(*keys, "_span").orderBy("_chunk")
    inside = inside.withColumn("_in", F.lag("_state").over(order))
    if spans > 1:
        totals = inside.groupBy(*keys, "_span").agg(F.max_by("_state", "_chunk").alias("_state"))
        totals = _running(totals, keys, "_span", combine, spans).select(
            *keys, (F.col("_span") + 1).alias("_span"), F.col("_state").alias("_carried")
        )
        inside = join_on(inside, totals, [*keys, "_span"], "left")
        inside = inside.withColumn("_in", _either(combine, F.col("_carried"), F.col("_in")))
    return inside.select(*keys, "_chunk", "_in")


def _chunked(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], alpha: float, rows: int | None
) -> tuple[DataFrame, int, int]:
    """Rows with their place (``_rn``) and chunk, the rows of a chunk, and a bound of the chunks of a key."""
    bound = largest_group(df, keys) if rows is None else rows
    chunk = max(1, math.floor(_EXPONENT_ROOM / -math.log1p(-alpha)))
    numbered = add_position(df, keys, order, "_rn", rows=bound)
    return numbered.withColumn("_chunk", F.floor((F.col("_rn") - 1) / chunk)), chunk, max(1, math.ceil(bound / chunk))


def _with_earlier(
    parts: DataFrame, keys: Sequence[str], state: dict[str, Column], present: Column, combine: Combine, chunks: int
) -> DataFrame:
    """Rows with ``_in``, the state of all earlier chunks; ``state`` are aggregates over the values of one chunk.

    A chunk without a value has no state and hands on the one before it.
    """
    by = [*keys, "_chunk"]
    states = parts.groupBy(*by).agg(F.count(F.when(present, 1)).alias("_n"), *[c.alias(n) for n, c in state.items()])
    states = states.select(*by, F.when(F.col("_n") > 0, F.struct(*state)).alias("_state"))
    if chunks > 1:
        return join_on(parts, _earlier_states(states, keys, combine, chunks), by, "left")
    return parts.withColumn("_in", F.lit(None).cast(states.schema["_state"].dataType))


def add_ewm_mean(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: str,
    alpha: float,
    out: str,
    rows: int | None = None,
    carry: bool = True,
) -> DataFrame:
    """Recursive mean, starting at the first value; a null row only lets the old mean fade.

    A value ``d`` rows after the one before it gives s = (q ** d * s_prev + alpha * x) / (q ** d + alpha) with
    q = 1 - alpha, which is alpha * x + q * s_prev without gaps. On a null row the last mean stays (``carry``) or
    the result is null. Inside a chunk every mean is a linear function r * s + t of the mean s at the chunk's first value,
    by one running sum with the factors summed as logarithms; chunks are functions of the same kind and are combined
    by ``_earlier_states``. ``rows`` is a proven bound of a key's rows; without it the longest key is counted.
    """
    _check(alpha)
    parts, _, chunks = _chunked(df, keys, order, alpha, rows)
    x, rn, q = F.col(value), F.col("_rn"), F.lit(1.0 - alpha)
    there = x.isNotNull()
    place = F.when(there, rn)
    by_place = Window.partitionBy(*keys, "_chunk").orderBy("_rn")
    so_far = by_place.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = by_place.rowsBetween(Window.unboundedPreceding, -1)

    def weights(gap: Column) -> tuple[Column, Column]:
        fade = F.pow(q, gap)
        return fade / (fade + alpha), F.lit(alpha) / (fade + alpha)

    parts = parts.withColumns(
        {
            "_last": F.max(place).over(before),
            "_first": F.min(place).over(so_far),
            "_fx": F.first(x, ignorenulls=True).over(so_far),
        }
    )
    keep, take = weights(rn - F.col("_last"))
    later = there & F.col("_last").isNotNull()
    parts = parts.withColumns({"_log": F.when(later, F.log(keep)).otherwise(0.0), "_part": F.when(later, x * take)})
    parts = parts.withColumn("_scale", F.sum("_log").over(so_far))
    parts = parts.withColumns(
        {
            "_r": F.exp("_scale"),
            "_t": F.coalesce(F.sum(F.col("_part") * F.exp(-F.col("_scale"))).over(so_far), F.lit(0.0)) * F.exp("_scale"),
        }
    )

    def after(a: Column, b: Column) -> Column:
        keep, take = weights(b["first"] - a["last"])
        return F.struct(
            a["first"].alias("first"),
            b["last"].alias("last"),
            a["fx"].alias("fx"),
            (a["r"] * keep * b["r"]).alias("r"),
            (b["r"] * (keep * a["t"] + take * b["fx"]) + b["t"]).alias("t"),
        )

    state = {
        "first": F.min(place),
        "last": F.max(place),
        "fx": F.min_by(x, place),
        "r": F.max_by("_r", place),
        "t": F.max_by("_t", place),
    }
    parts = _with_earlier(parts, keys, state, there, after, chunks)
    old = F.col("_in.r") * F.col("_in.fx") + F.col("_in.t")
    keep, take = weights(F.col("_first") - F.col("_in.last"))
    at_first = F.when(F.col("_in").isNull(), F.col("_fx")).otherwise(keep * old + take * F.col("_fx"))
    mean = F.when(F.col("_first").isNull(), old).otherwise(F.col("_r") * at_first + F.col("_t"))
    kept = [c for c in df.columns if c != out]
    return parts.select(*kept, (mean if carry else F.when(there, mean)).alias(out))


def add_ewm_std(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: str,
    span: int,
    out: str,
    rows: int | None = None,
) -> DataFrame:
    """Adjusted, bias-corrected exponential deviation; a key's first value gives 0.

    The state up to a value: its place, the weights' sum and sum of squares (that value weighs 1), the mean and the centred
    sum of squares. Two states combine by letting the older one fade. Inside a chunk the sums run over differences from the
    chunk's first value, so a large level of the values does not cancel their spread.
    """
    alpha = 2.0 / (span + 1.0)
    _check(alpha)
    parts, chunk, chunks = _chunked(df, keys, order, alpha, rows)
    x, rn, q = F.col(value), F.col("_rn"), F.lit(1.0 - alpha)
    there = x.isNotNull()
    so_far = Window.partitionBy(*keys, "_chunk").orderBy("_rn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = parts.withColumns(
        {
            "_fx": F.first(x, ignorenulls=True).over(so_far),
            "_grow": F.pow(q, -(rn - 1 - F.col("_chunk") * chunk).cast("double")),
        }
    )
    g, d = F.when(there, F.col("_grow")), x - F.col("_fx")
    sums = {"_w": g, "_ww": g * g, "_wx": g * d, "_wxx": g * d * d}
    parts = parts.withColumns({"_n": F.count(x).over(so_far), **{n: F.sum(c).over(so_far) for n, c in sums.items()}})
    offset = F.col("_wx") / F.col("_w")
    parts = parts.withColumn(
        "_own",
        F.when(
            there,
            F.struct(
                rn.alias("last"),
                (F.col("_w") / F.col("_grow")).alias("w"),
                (F.col("_ww") / (F.col("_grow") * F.col("_grow"))).alias("ww"),
                (F.col("_fx") + offset).alias("mean"),
                (F.greatest(F.col("_wxx") - F.col("_wx") * offset, F.lit(0.0)) / F.col("_grow")).alias("s"),
            ),
        ),
    )

    def after(a: Column, b: Column) -> Column:
        fade = F.pow(q, b["last"] - a["last"])
        old = fade * a["w"]
        total, gap = old + b["w"], b["mean"] - a["mean"]
        return F.struct(
            b["last"].alias("last"),
            total.alias("w"),
            (fade * fade * a["ww"] + b["ww"]).alias("ww"),
            (a["mean"] + gap * b["w"] / total).alias("mean"),
            (fade * a["s"] + b["s"] + old * b["w"] / total * gap * gap).alias("s"),
        )

    names = ("last", "w", "ww", "mean", "s")
    state = {n: F.max_by(F.col("_own")[n], F.when(there, rn)) for n in names}
    parts = _with_earlier(parts, keys, state, there, after, chunks)
    parts = parts.withColumn("_all", F.when(there, _either(after, F.col("_in"), F.col("_own"))))
    share = F.col("_all.ww") / (F.col("_all.w") * F.col("_all.w"))
    only = F.col("_in").isNull() & (F.col("_n") == 1)
    result = F.when(there & only, F.lit(0.0)).otherwise(
        F.sqrt(F.col("_all.s") / F.col("_all.w") / F.nullif(1.0 - share, F.lit(0.0)))
    )
    return parts.select(*[c for c in df.columns if c != out], result.alias(out))
