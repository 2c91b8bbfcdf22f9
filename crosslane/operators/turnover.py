"""Weight books, turnover and net-of-cost results, grouped by model.

Rows are ranked once per (model, date). The IC, the legs and the legs' returns of a date come out of that one frame; what
follows is a small table with a row per date, and the legs' names, which meet the book before along their own dates.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crosslane.functions.numeric import correlation, leg_size
from crosslane.operators.folds import date_index
from crosslane.operators.metrics import (
    MIN_BOOK_ROWS,
    MIN_IC_ROWS,
    MODEL,
    TRADING_DAYS,
    hac_t,
    ic_stats,
    legs,
    scored,
    sharpe,
)
from crosslane.operators.ranking import add_average_rank, add_position


def weights(book: DataFrame, keys: Sequence[str] = MODEL) -> DataFrame:
    """(keys, date, ticker, weight): +1/k for the long leg, -1/k for the short leg."""
    return book.select(*keys, "date", "ticker", (F.col("side") / F.col("k")).alias("weight"))


def numbered(days: DataFrame, keys: Sequence[str] = MODEL) -> DataFrame:
    """``days``, one row per (keys, date), with ``idx`` from 0. The calendar bounds the rows of a key; a time column of another
    type is numbered by the kernel that measures."""
    if dict(days.dtypes)["date"] == "date":
        return days.withColumn("idx", F.row_number().over(Window.partitionBy(*keys).orderBy("date")) - 1)
    return days.join(date_index(days, by=keys), [*keys, "date"])


def turnover(book: DataFrame, lag: int = 1, keys: Sequence[str] = MODEL, days: DataFrame | None = None) -> DataFrame:
    """(keys, date, turnover): half the absolute weight change against the book ``lag`` kept dates ago.

    Each name looks along its own dates: its change on a date where it is held, and its exit ``lag`` dates later where it is
    not. No join of books. The first ``lag`` books are measured against nothing. ``days`` (keys, date, idx) are the kept
    dates; without them they are the book's.
    """
    days = date_index(book, by=keys) if days is None else days
    later = F.lead("date", lag).over(Window.partitionBy(*keys).orderBy("idx"))
    placed = weights(book, keys).join(days.select(*keys, "date", "idx", later.alias("_later")), [*keys, "date"])
    along = Window.partitionBy(*keys, "ticker").orderBy("idx")
    old = F.coalesce(F.max("weight").over(along.rangeBetween(-lag, -lag)), F.lit(0.0))
    again = F.max("weight").over(along.rangeBetween(lag, lag))
    placed = placed.withColumns({"_change": F.abs(F.col("weight") - old), "_exit": F.when(again.isNull(), F.col("_later"))})
    own = F.struct(F.col("date"), F.col("_change").alias("change"))
    gone = F.struct(F.col("_exit").alias("date"), F.abs("weight").alias("change"))
    parts = placed.select(*keys, F.explode(F.array(own, gone)).alias("_x")).select(*keys, "_x.*")
    return parts.where(F.col("date").isNotNull()).groupBy(*keys, "date").agg((F.sum("change") / 2.0).alias("turnover"))


def ranked_frame(
    df: DataFrame, keys: Sequence[str] = MODEL, top_frac: float = 0.2, rows: int | None = None
) -> DataFrame:
    """Scored rows with average ranks (``_rp``, ``_rr``), the date's size ``_n``, and ``side`` and ``k`` of the legs."""
    by = [*keys, "date"]
    out = scored(df).select(*by, "ticker", "prediction", "realized")
    out = add_position(out, by, ["prediction", "ticker"], "_pos", "_n", rows)
    out = add_average_rank(out, by, "prediction", "_rp", rows=rows)
    out = add_average_rank(out, by, "realized", "_rr", rows=rows)
    out = out.withColumn("k", F.when(F.col("_n") >= MIN_BOOK_ROWS, leg_size(F.col("_n"), top_frac)))
    side = F.when(F.col("_pos") > F.col("_n") - F.col("k"), 1).when(F.col("_pos") <= F.col("k"), -1)
    return out.withColumn("side", side).drop("_pos")


def daily_results(ranked: DataFrame, keys: Sequence[str] = MODEL) -> DataFrame:
    """(keys, date, n, ic, ret) of a ranked frame; ``ret`` is null on dates too thin for a book."""
    long = F.avg(F.when(F.col("side") == 1, F.col("realized")))
    short = F.avg(F.when(F.col("side") == -1, F.col("realized")))
    return ranked.groupBy(*keys, "date").agg(
        F.count(F.lit(1)).alias("n"), correlation("_rp", "_rr").alias("ic"), (long - short).alias("ret")
    )


def _with_turnover(ranked: DataFrame, daily: DataFrame, lag: int, keys: Sequence[str]) -> DataFrame:
    """``daily`` with the turnover of the book on its dates; null where there is none."""
    days = numbered(daily.where(F.col("ret").isNotNull()).select(*keys, "date"), keys)
    moved = turnover(ranked.where(F.col("side").isNotNull()), lag, keys, days)
    return daily.join(moved, [*keys, "date"], "left")


def books_with_turnover(
    df: DataFrame,
    keys: Sequence[str] = MODEL,
    top_frac: float = 0.2,
    lag: int = 1,
    rows: int | None = None,
) -> DataFrame:
    """(keys, date, ret, turnover) of the long-short book."""
    ranked = ranked_frame(df, keys, top_frac, rows)
    books = _with_turnover(ranked, daily_results(ranked, keys), lag, keys)
    return books.where(F.col("ret").isNotNull()).select(*keys, "date", "ret", "turnover")


def net_return(bps: int):
    """Return after a round trip: 2 * turnover * cost per side."""
    return F.col("ret") - F.col("turnover") * F.lit(2.0 * bps / 10000.0)


def cost_summary(
    df: DataFrame,
    keys: Sequence[str] = MODEL,
    top_frac: float = 0.2,
    cost_bps: Sequence[int] = (3, 10, 20),
    horizon: int = 5,
    rows: int | None = None,
) -> DataFrame:
    """Gross and net results per model; the book is held for ``horizon`` dates."""
    hold = max(int(horizon), 1)
    ranked = ranked_frame(df, keys, top_frac, rows)
    daily = _with_turnover(ranked, daily_results(ranked, keys), hold, keys)
    daily = daily.withColumn("ic", F.when(F.col("n") >= MIN_IC_ROWS, F.col("ic")))
    rebalances = TRADING_DAYS / hold
    mean, spread, two = F.avg("ic"), F.stddev_samp("ic"), F.count("ic") >= 2
    return daily.groupBy(*keys).agg(
        F.sum("n").alias("n_observations"),
        F.when(two, mean).alias("gross_ic"),
        F.when(two & (spread > 0), mean * F.sqrt(F.count("ic")) / spread).alias("gross_ic_t_stat"),
        F.count("ret").alias("n_dates"),
        sharpe(F.col("ret"), horizon, 2).alias("gross_long_short_sharpe"),
        (F.avg("turnover") * F.lit(rebalances / TRADING_DAYS)).alias("daily_turnover_mean"),
        (F.avg("turnover") * F.lit(rebalances)).alias("annual_turnover"),
        *[sharpe(net_return(b), horizon, 2).alias(f"after_cost_sharpe_{b}bp") for b in sorted(cost_bps)],
    )


def compare_costs(df: DataFrame, model_ids: Sequence[str] | None = None, **options) -> DataFrame:
    """Cost summaries of all models, best gross IC first."""
    if model_ids is not None:
        df = df.where(F.col("model_id").isin(list(model_ids)))
    return cost_summary(df, MODEL, **options).orderBy(F.desc_nulls_last("gross_ic"))


def on_rebalance_dates(df: DataFrame, step: int, keys: Sequence[str] = MODEL) -> DataFrame:
    """Rows on every ``step``-th date of each model, counted over its scored dates."""
    kept = date_index(df, by=keys).where(F.col("idx") % step == 0).select(*keys, "date")
    return df.join(kept, [*keys, "date"], "left_semi")


def _rebalanced(
    df: DataFrame, step: int, keys: Sequence[str], rows: int | None
) -> tuple[DataFrame, DataFrame]:
    """All dates' results, and those of every ``step``-th scored date of each key with the turnover between their books."""
    ranked = ranked_frame(df, keys, 0.2, rows)
    daily = numbered(daily_results(ranked, keys), keys)
    kept = daily.where(F.col("idx") % step == 0).drop("idx")
    names = ranked.where(F.col("side").isNotNull())
    days = numbered(kept.where(F.col("ret").isNotNull()).select(*keys, "date"), keys)
    return daily, kept.join(turnover(names, 1, keys, days), [*keys, "date"], "left")


def _book_stats(step: int, cost_bps: Sequence[int]) -> list[Column]:
    return [
        F.count("ret").alias("n_rebalances"),
        sharpe(F.col("ret"), step, 2).alias("gross_sharpe"),
        (F.avg("turnover") * F.lit(TRADING_DAYS / step)).alias("annual_turnover"),
        *[sharpe(net_return(b), step, 2).alias(f"net_sharpe_{b}bp") for b in cost_bps],
    ]


def rebalanced_stats(
    df: DataFrame,
    step: int = 21,
    keys: Sequence[str] = MODEL,
    cost_bps: Sequence[int] = (3, 10, 20),
    hac_lag: int = 21,
    min_rows: int = 10,
    rows: int | None = None,
) -> DataFrame:
    """Daily IC with naive and HAC t, and the book rebalanced every ``step`` dates without overlap."""
    daily, kept = _rebalanced(df, step, keys, rows)
    usable = daily.where((F.col("n") >= min_rows) & F.col("ic").isNotNull())
    ic = hac_t(usable, "ic", hac_lag, keys).select(*keys, F.col("n").alias("n_dates"), F.col("mean").alias("ic"), "t_naive", "t_hac")
    books = kept.where(F.col("ret").isNotNull())
    return ic.join(books.groupBy(*keys).agg(*_book_stats(step, cost_bps)), list(keys), "left")


def cadence_stats(
    df: DataFrame, step: int = 21, keys: Sequence[str] = MODEL, cost_bps: Sequence[int] = (3, 10, 20), rows: int | None = None
) -> DataFrame:
    """The same book with the IC of the rebalance dates only."""
    _, kept = _rebalanced(df, step, keys, rows)
    quality = F.avg(F.when(F.col("n") >= MIN_BOOK_ROWS, F.col("ic"))).alias("ic")
    return kept.groupBy(*keys).agg(*_book_stats(step, cost_bps), quality).where(F.col("n_rebalances") > 0)


def _compounded(value: Column) -> Column:
    return F.exp(F.sum(F.log1p(value))) - 1.0


def dollar_pnl(books: DataFrame, bps: int = 10, capital: float = 1000.0, keys: Sequence[str] = MODEL) -> DataFrame:
    """Gross and net profit on ``capital``: half per leg (summed, compounded) or all of it per leg (summed)."""
    lines = books.select(
        *keys,
        F.explode(
            F.array(
                F.struct(F.lit("gross").alias("line"), F.col("ret").alias("r")),
                F.struct(F.lit("net").alias("line"), net_return(bps).alias("r")),
            )
        ).alias("_x"),
    ).select(*keys, "_x.*")
    return lines.groupBy(*keys, "line").agg(
        F.count("r").alias("n_rebalances"),
        F.avg("r").alias("mean_return"),
        F.sum("r").alias("sum_return"),
        (F.sum("r") * (capital / 2)).alias("half_leg_sum"),
        (_compounded(F.col("r") / 2) * capital).alias("half_leg_compounded"),
        (F.sum("r") * capital).alias("full_leg_sum"),
    )


def long_only_books(
    df: DataFrame, step: int = 21, keys: Sequence[str] = MODEL, top_frac: float = 0.2, rows: int | None = None
) -> DataFrame:
    """(keys, date, book, bench, turnover) of the top names against all names, every ``step`` dates.

    ``realized`` is a simple forward return. Turnover is the share of names that were not in the
    book before; the first book counts 1.
    """
    by = [*keys, "date"]
    valid = df.where(F.col("realized").isNotNull()).select(*by, "ticker", "prediction", "realized")
    days = numbered(valid.groupBy(*by).agg(F.avg("realized").alias("bench")), keys).where(F.col("idx") % step == 0).drop("idx")
    top = legs(valid.join(days.select(*by), by, "left_semi"), keys, top_frac, rows).where(F.col("side") == 1)
    # Books are numbered by themselves: a date without one does not come between two.
    placed = top.select(*by, "ticker", "realized", "k")
    order = numbered(placed.groupBy(*by).agg(F.max("k").alias("k")), keys)
    along = Window.partitionBy(*keys, "ticker").orderBy("idx")
    held = placed.drop("k").join(order, by).withColumn("_held", F.lag("idx").over(along) == F.col("idx") - 1)
    books = held.groupBy(*by).agg(
        F.avg("realized").alias("book"),
        (F.count(F.when(~F.coalesce("_held", F.lit(False)), 1)) / F.max("k")).alias("turnover"),
    )
    return books.join(days, by)


def long_only_summary(
    books: DataFrame, cost_bps: Sequence[int] = (3, 10), capital: float = 1000.0, step: int = 21, keys: Sequence[str] = MODEL
) -> DataFrame:
    """Compounded profit of book, benchmark and net books, alpha and the benchmark's share."""
    book, bench = _compounded(F.col("book")), _compounded(F.col("bench"))
    nets = {}
    for b in cost_bps:
        net = F.col("book") - F.col("turnover") * F.lit(2.0 * b / 10000.0)
        nets[f"net_pnl_{b}bp"] = _compounded(net) * capital
    return books.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rebalances"),
        (F.avg("turnover") * (TRADING_DAYS / step)).alias("annual_turnover"),
        F.avg("book").alias("mean_book"),
        F.avg("bench").alias("mean_bench"),
        F.avg(F.col("book") - F.col("bench")).alias("mean_alpha"),
        (book * capital).alias("book_pnl"),
        (bench * capital).alias("bench_pnl"),
        ((book - bench) * capital).alias("alpha_pnl"),
        F.try_divide(bench, book).alias("bench_share"),
        *[agg.alias(name) for name, agg in nets.items()],
    )
