"""The registered features and the matrix builder.

The matrix costs one shuffle by ticker for every series feature together. What a
series feature needs from whole dates (market return, dispersion, factors) comes
as date tables: they are aggregated with partial sums from three columns of the
panel and joined by broadcast, since a date table has one row per calendar day.
Only ranks and medians then read whole dates.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from crosslane.operators.ranking import add_average_rank, add_group_median, add_group_stats
from crosslane.operators.registry import (
    CROSS,
    SERIES,
    SERIES_FRAME,
    cross_feature,
    get_feature,
    series_feature,
    series_frame_feature,
)
from crosslane.operators.rolling import add_ewm_std, full
from crosslane.session import broadcast_dates
from crosslane.sources.bars import log_return
from crosslane.sources.factors import FACTORS, attach_factors

BY_TICKER = ("ticker",)
BY_DATE = ("date",)
_TINY_VARIANCE = 1e-12


def _lag(name: str, steps: int, w: WindowSpec) -> Column:
    return F.lag(name, steps).over(w)


def _mean(x: Column, n: int, w: WindowSpec) -> Column:
    return full(F.avg(x), x, w, n)


# ---- shared columns ---------------------------------------------------------

# Built in this order; a later one may use an earlier one.
_SHARED: dict[str, tuple[tuple[str, ...], Callable[[WindowSpec], Column]]] = {
    "_lp": ((), lambda w: F.log("adj_close")),
    "_lr": (("_lp",), lambda w: F.col("_lp") - _lag("_lp", 1, w)),
    "_delta": ((), lambda w: F.col("adj_close") - _lag("adj_close", 1, w)),
    "_turnover": ((), lambda w: F.when(F.col("close") * F.col("volume") > 1.0, F.col("close") * F.col("volume")).otherwise(1.0)),
    "_adj_volume": (
        (),
        lambda w: F.col("volume").cast("double")
        * (F.col("close") / F.when(F.col("adj_close") > 1e-9, F.col("adj_close")).otherwise(1e-9)),
    ),
    "_adj_open": (
        (),
        lambda w: F.col("open") * (F.col("adj_close") / F.when(F.col("close") > 1e-9, F.col("close")).otherwise(1e-9)),
    ),
    "_mkt_cov": (("_lr", "_mkt"), lambda w: _moments("_lr", "_mkt", 60, w)[0]),
    "_mkt_var": (("_lr", "_mkt"), lambda w: _moments("_lr", "_mkt", 60, w)[1]),
    "_idio": (
        ("_mkt_cov", "_mkt_var"),
        lambda w: F.col("_lr")
        - F.when(F.col("_mkt_var") > _TINY_VARIANCE, F.col("_mkt_cov") / F.col("_mkt_var")).otherwise(0.0) * F.col("_mkt"),
    ),
}
_DATE_COLUMNS = ("_mkt", "_xs_std")
# A daily panel has one row per ticker and date: a bound for more than a century.
CALENDAR_ROWS = 40_000


def _moments(x: str, y: str, n: int, w: WindowSpec) -> tuple[Column, Column]:
    """Covariance of x and y and variance of y over n rows, as differences of means."""
    a, b = F.col(x), F.col(y)
    mean_b = _mean(b, n, w)
    return _mean(a * b, n, w) - _mean(a, n, w) * mean_b, _mean(b * b, n, w) - mean_b * mean_b


def _guarded(cov: Column, var: Column) -> Column:
    return F.when(var > _TINY_VARIANCE, cov / var)


# ---- price, volume and volatility -------------------------------------------


def _momentum(name: str, near: int, far: int) -> None:
    def build(w: WindowSpec) -> Column:
        recent = F.col("_lp") if near == 0 else _lag("_lp", near, w)
        return recent - _lag("_lp", far, w)

    series_feature(name, ("adj_close",), far, ("_lp",))(build)


# Fixed values: (newer lag, older lag) in rows.
for _name, _near, _far in (
    ("return_5d", 0, 5),
    ("momentum_60", 5, 65),
    ("momentum_12_1", 21, 252),
    ("return_1d", 0, 1),
    ("momentum_378", 0, 378),
    ("momentum_504", 0, 504),
    ("momentum_756", 0, 756),
):
    _momentum(_name, _near, _far)


@series_feature("vol_20", ("adj_close",), 21, ("_lr",))
def vol_20(w):
    return full(F.stddev_samp("_lr"), F.col("_lr"), w, 20)


@series_feature("rsi_14", ("adj_close",), 15, ("_delta",))
def rsi_14(w):
    up = F.when(F.col("_delta") > 0, F.col("_delta")).otherwise(0.0)
    down = F.when(F.col("_delta") < 0, -F.col("_delta")).otherwise(0.0)
    mean_down = _mean(down, 14, w)
    strength = _mean(up, 14, w) / F.when(mean_down == 0, 1e-12).otherwise(mean_down)
    return 100.0 - 100.0 / (1.0 + strength)


@series_feature("distance_ma_200", ("adj_close",), 200)
def distance_ma_200(w):
    mean = _mean(F.col("adj_close"), 200, w)
    return (F.col("adj_close") - mean) / mean


@series_feature("distance_52w_high", ("adj_close",), 252, ("_lp",))
def distance_52w_high(w):
    past = w.rowsBetween(-252, -1)
    peak = F.when(F.count("adj_close").over(past) == 252, F.max("adj_close").over(past))
    return F.col("_lp") - F.log(peak)


@series_feature("range_ratio", ("high", "low", "close"), 1)
def range_ratio(w):
    return F.try_divide(F.col("high") - F.col("low"), F.col("close"))


@series_feature("body_ratio", ("open", "close"), 1)
def body_ratio(w):
    return F.try_divide(F.abs(F.col("open") - F.col("close")), F.col("close"))


@series_feature("parkinson_vol_20", ("high", "low"), 21)
def parkinson_vol_20(w):
    gap = F.log("high") - F.log("low")
    return F.sqrt(_mean(gap * gap / (4.0 * math.log(2.0)), 20, w))


@series_feature("log_dollar_volume", ("close", "volume"), 1, ("_turnover",))
def log_dollar_volume(w):
    return F.log("_turnover")


@series_feature("abnormal_volume", ("volume", "close", "adj_close"), 21, ("_adj_volume",))
def abnormal_volume(w):
    mean = _mean(F.col("_adj_volume"), 20, w)
    return F.col("_adj_volume") / F.when(mean > 1.0, mean).otherwise(1.0)


@series_feature("max_return_21d", ("adj_close",), 22, ("_lr",))
def max_return_21d(w):
    return full(F.max("_lr"), F.col("_lr"), w, 21)


@series_feature("overnight_return_1d", ("open", "close", "adj_close"), 1, ("_lp", "_adj_open"))
def overnight_return_1d(w):
    return F.log("_adj_open") - _lag("_lp", 1, w)


@series_feature("intraday_return_1d", ("open", "close", "adj_close"), 0, ("_lp", "_adj_open"))
def intraday_return_1d(w):
    return F.col("_lp") - F.log("_adj_open")


@series_feature("amihud_illiquidity_20", ("adj_close", "close", "volume"), 21, ("_lr", "_turnover"))
def amihud_illiquidity_20(w):
    return _mean(F.abs("_lr") / F.col("_turnover"), 20, w)


# ---- market and dispersion --------------------------------------------------


@series_feature("idio_vol_20", ("adj_close",), 81, ("_idio",))
def idio_vol_20(w):
    return full(F.stddev_samp("_idio"), F.col("_idio"), w, 20)


@series_feature("beta_60", ("adj_close",), 61, ("_mkt_cov", "_mkt_var"))
def beta_60(w):
    return _guarded(F.col("_mkt_cov"), F.col("_mkt_var"))


@series_feature("residual_return_5d", ("adj_close",), 65, ("_lp", "_mkt_cov", "_mkt_var"))
def residual_return_5d(w):
    market = full(F.sum("_mkt"), F.col("_mkt"), w, 5)
    return F.col("_lp") - _lag("_lp", 5, w) - _guarded(F.col("_mkt_cov"), F.col("_mkt_var")) * market


@series_feature("cs_return_dispersion_20", ("adj_close",), 21, ("_xs_std",))
def cs_return_dispersion_20(w):
    return _mean(F.col("_xs_std"), 20, w)


# ---- factor loadings --------------------------------------------------------


def _loading(factor: str) -> None:
    short = factor.split("_")[0].lower()

    def beta(w: WindowSpec) -> Column:
        return _guarded(*_moments("_lr", factor, 60, w))

    series_feature(f"{short}_beta_60", ("adj_close",), 61, ("_lr", factor))(beta)
    if factor in ("MKT_RF", "SMB", "HML"):

        def with_trend(w: WindowSpec) -> Column:
            return beta(w) * full(F.sum(factor), F.col(factor), w, 20)

        series_feature(f"{short}_beta_x_{short}_20d", ("adj_close",), 61, ("_lr", factor))(with_trend)


for _factor in FACTORS:
    _loading(_factor)


# ---- features of whole dates ------------------------------------------------


def _rank_of(name: str, base: str, lookback: int) -> None:
    def build(df: DataFrame, rows: int | None) -> DataFrame:
        ranked = add_average_rank(df, BY_DATE, base, "_place", "_present", rows)
        return ranked.withColumn(name, F.col("_place") / F.col("_present")).drop("_place", "_present")

    cross_feature(name, ("adj_close",), lookback, (base,))(build)


_rank_of("momentum_60_rank", "momentum_60", 65)
_rank_of("vol_20_rank", "vol_20", 21)
_rank_of("distance_ma_200_rank", "distance_ma_200", 200)


def _less_median(name: str, base: str, keys: tuple[str, ...], lookback: int, inputs: tuple[str, ...]) -> None:
    def build(df: DataFrame, rows: int | None) -> DataFrame:
        absent = set(keys) - set(df.columns)
        if absent:
            raise ValueError(f"{name} needs the columns {sorted(absent)} on the panel")
        return (
            add_group_median(df, keys, base, "_middle", rows)
            .withColumn(name, F.col(base) - F.col("_middle"))
            .drop("_middle")
        )

    cross_feature(name, inputs, lookback, (base,))(build)


_less_median("momentum_60_sector_rel", "momentum_60", ("date", "sector"), 65, ("adj_close", "sector"))
_less_median("sector_relative_return_5d", "return_5d", ("date", "sector"), 5, ("adj_close", "sector"))
_less_median("mkt_beta_xs_dispersion", "mkt_beta_60", ("date",), 61, ("adj_close",))


@cross_feature("vol_20_cs_min_dist", ("adj_close",), 21, ("vol_20",))
def vol_20_cs_min_dist(df, rows):
    low = add_group_stats(df, BY_DATE, {"_low": F.min("vol_20")}, rows)
    return low.withColumn("vol_20_cs_min_dist", F.col("vol_20") - F.col("_low")).drop("_low")


@cross_feature("mom60_minus_dist_ma200", ("adj_close",), 200, ("momentum_60", "distance_ma_200"))
def mom60_minus_dist_ma200(df, rows):
    return df.withColumn("mom60_minus_dist_ma200", F.col("momentum_60") - F.col("distance_ma_200"))


@series_frame_feature("vol_ewm_20", ("adj_close",), 100, ("_lr",))
def vol_ewm_20(df):
    return add_ewm_std(df, BY_TICKER, BY_DATE, "_lr", 20, "vol_ewm_20", rows=CALENDAR_ROWS)


# ---- matrix -----------------------------------------------------------------


def market_table(panel: DataFrame) -> DataFrame:
    """Per date: equal-weight mean (``_mkt``) and deviation (``_xs_std``) of the daily return."""
    returns = panel.select("date", log_return().alias("_r"))
    return returns.groupBy("date").agg(F.avg("_r").alias("_mkt"), F.stddev_samp("_r").alias("_xs_std"))


def add_features(
    panel: DataFrame, names: Sequence[str], factors: DataFrame | None = None, rows: int | None = None
) -> DataFrame:
    """Add the raw feature columns. ``rows`` bounds the number of rows of one date."""
    wanted, shared, date_columns, factor_columns = [], set(), set(), set()

    def visit(name: str) -> None:
        if name in _SHARED:
            for need in _SHARED[name][0]:
                visit(need)
            shared.add(name)
        elif name in _DATE_COLUMNS:
            date_columns.add(name)
        elif name in FACTORS:
            factor_columns.add(name)
        elif name not in wanted:
            for need in get_feature(name).needs:
                visit(need)
            wanted.append(name)

    for name in names:
        visit(name)
    kept = list(panel.columns)
    df = panel
    if date_columns:
        # One row per calendar day.
        df = df.join(broadcast_dates(market_table(panel)), "date", "left")
    if factor_columns:
        if factors is None:
            raise ValueError("these features need a factor table")
        df = attach_factors(df, factors, sorted(factor_columns))
    # One row per date and ticker, so a ticker's window is bounded by the calendar.
    window = Window.partitionBy("ticker").orderBy("date")
    for name, (_, build) in _SHARED.items():
        if name in shared:
            df = df.withColumn(name, build(window))
    series = [get_feature(n) for n in wanted if get_feature(n).kind == SERIES]
    if series:
        df = df.withColumns({f.name: f.build(window) for f in series})
    for feature in (get_feature(n) for n in wanted):
        if feature.kind == SERIES_FRAME:
            df = feature.build(df)
    for feature in (get_feature(n) for n in wanted):
        if feature.kind == CROSS:
            df = feature.build(df, rows)
    return df.select(*kept, *[n for n in names if n not in kept])


def normalize(df: DataFrame, names: Sequence[str], kind: str = "zscore", rows: int | None = None) -> DataFrame:
    """Per-date z-score or rank in (0, 1] of each column; 'none' changes nothing."""
    if kind == "none":
        return df
    if kind == "zscore":
        stats = {f"_m_{n}": F.avg(n) for n in names} | {f"_s_{n}": F.stddev_samp(n) for n in names}
        out = add_group_stats(df, BY_DATE, stats, rows)
        return out.withColumns(
            {
                n: (F.col(n) - F.col(f"_m_{n}")) / F.when(F.col(f"_s_{n}") == 0, 1.0).otherwise(F.col(f"_s_{n}"))
                for n in names
            }
        ).drop(*stats)
    if kind == "rank":
        for n in names:
            df = add_average_rank(df, BY_DATE, n, "_place", "_present", rows)
            df = df.withColumn(n, F.col("_place") / F.col("_present")).drop("_place", "_present")
        return df
    raise ValueError(f"unknown normalization {kind!r}")


def add_forward_excess_return(
    panel: DataFrame,
    horizon: int = 5,
    price: str = "adj_close",
    target: str = "y",
    rows: int | None = None,
) -> DataFrame:
    """log(P[t+h] / P[t]) less its mean over the date; null where the future is not there."""
    out = panel.withColumn(target, forward_log_return(horizon, price))
    return demean_by_date(out, target, rows=rows)


def forward_log_return(horizon: int, price: str = "adj_close") -> Column:
    return F.lead(F.log(price), horizon).over(Window.partitionBy("ticker").orderBy("date")) - F.log(price)


def add_forward_simple_return(panel: DataFrame, horizon: int, price: str = "adj_close", out: str = "raw_fwd") -> DataFrame:
    later = F.lead(price, horizon).over(Window.partitionBy("ticker").orderBy("date"))
    return panel.withColumn(out, F.try_divide(later, F.col(price)) - 1.0)


def demean_by_date(df: DataFrame, column: str, by: Sequence[str] = BY_DATE, rows: int | None = None) -> DataFrame:
    out = add_group_stats(df, by, {"_mean": F.avg(column)}, rows)
    return out.withColumn(column, F.col(column) - F.col("_mean")).drop("_mean")


def build_feature_matrix(
    panel: DataFrame,
    names: Sequence[str],
    kind: str = "zscore",
    horizon: int = 5,
    target: str = "y",
    factors: DataFrame | None = None,
    rows: int | None = None,
) -> DataFrame:
    """Features, then the per-date normalization, then the forward target."""
    # The forward return is read in the same pass over the tickers as the series features.
    out = add_features(panel.withColumn(target, forward_log_return(horizon)), names, factors, rows)
    return demean_by_date(normalize(out, list(names), kind, rows), target, rows=rows)


def drop_warmup_rows(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(names)) if names else df
