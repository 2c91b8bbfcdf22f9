"""Ranking quality of predictions. Every metric is grouped by ``keys`` (one or more model columns).

An evaluation frame has (keys, date, ticker, prediction, realized). ``rows`` is a
proven bound on the rows of one (keys, date) cross-section; without it the bound
is measured. Series of one value per date are bounded by the calendar.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crosslane.functions.numeric import correlation, leg_size, normal_cdf
from crosslane.operators.ranking import add_average_rank, add_position
from crosslane.session import broadcast_dates

MODEL = ("model_id",)
TRADING_DAYS = 252
MIN_IC_ROWS, MIN_BOOK_ROWS, MIN_SHARPE_DATES = 5, 10, 20


def scored(df: DataFrame) -> DataFrame:
    return df.dropna(subset=["prediction", "realized"])


def annualizer(horizon: int) -> float:
    return math.sqrt(TRADING_DAYS / max(horizon, 1))


def daily_ic(
    df: DataFrame,
    keys: Sequence[str] = MODEL,
    min_rows: int = MIN_IC_ROWS,
    rows: int | None = None,
    realized_is_ranked: bool = False,
) -> DataFrame:
    """(keys, date, ic, n): Spearman correlation per date; constant or thin dates are left out.

    ``realized_is_ranked`` says that ``realized`` already holds the ranks inside (keys, date) over
    these same rows, as when many predictions share one target.
    """
    by = [*keys, "date"]
    df = scored(df).select(*by, "prediction", "realized")
    df = add_average_rank(df, by, "prediction", "_rp", rows=rows)
    if realized_is_ranked:
        df = df.withColumnRenamed("realized", "_rr")
    else:
        df = add_average_rank(df, by, "realized", "_rr", rows=rows)
    out = df.groupBy(*by).agg(correlation("_rp", "_rr").alias("ic"), F.count(F.lit(1)).alias("n"))
    return out.where((F.col("n") >= min_rows) & F.col("ic").isNotNull())


def ic_stats(ic: DataFrame, keys: Sequence[str] = MODEL) -> DataFrame:
    """Mean IC and its t-statistic; both null below two dates, t null for a constant IC."""
    two = F.count("ic") >= 2
    spread = F.stddev_samp("ic")
    return ic.groupBy(*keys).agg(
        F.count("ic").alias("n_ic_dates"),
        F.when(two, F.avg("ic")).alias("information_coefficient"),
        F.when(two & (spread > 0), F.avg("ic") * F.sqrt(F.count("ic")) / spread).alias("ic_t_stat"),
    )


def legs(
    df: DataFrame,
    keys: Sequence[str] = MODEL,
    top_frac: float = 0.2,
    rows: int | None = None,
    min_rows: int = MIN_BOOK_ROWS,
) -> DataFrame:
    """Rows of the top and bottom ``top_frac`` of each date with ``side`` (+1, -1) and leg size ``k``.

    Ties in the prediction are ordered by ticker.
    """
    by = [*keys, "date"]
    df = scored(df).select(*by, "ticker", "prediction", "realized")
    placed = add_position(df, by, ["prediction", "ticker"], "_pos", "_n", rows)
    placed = placed.where(F.col("_n") >= min_rows).withColumn("k", leg_size(F.col("_n"), top_frac))
    side = F.when(F.col("_pos") > F.col("_n") - F.col("k"), 1).when(F.col("_pos") <= F.col("k"), -1)
    return placed.withColumn("side", side).where(F.col("side").isNotNull()).drop("_pos", "_n")


def book_returns(book: DataFrame, keys: Sequence[str] = MODEL) -> DataFrame:
    """(keys, date, ret): mean realized of the long leg less that of the short leg."""
    long = F.avg(F.when(F.col("side") == 1, F.col("realized")))
    short = F.avg(F.when(F.col("side") == -1, F.col("realized")))
    return book.groupBy(*keys, "date").agg((long - short).alias("ret"))


def long_short(df: DataFrame, keys: Sequence[str] = MODEL, top_frac: float = 0.2, rows: int | None = None) -> DataFrame:
    return book_returns(legs(df, keys, top_frac, rows), keys)


def sharpe(value: Column, horizon: int, min_dates: int) -> Column:
    spread = F.stddev_samp(value)
    return F.when(
        (F.count(value) >= min_dates) & (spread > 0), F.avg(value) / spread * F.lit(annualizer(horizon))
    )


def summarize(
    df: DataFrame, keys: Sequence[str] = MODEL, horizon: int = 5, rows: int | None = None
) -> DataFrame:
    """One row per key: counts, mean IC and t, hit rate, MAE, RMSE, long-short Sharpe."""
    valid = scored(df)
    error = F.col("prediction") - F.col("realized")
    hit = (F.signum("prediction") == F.signum("realized")).cast("double")
    errors = valid.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_observations"),
        F.countDistinct("date").alias("n_dates"),
        F.avg(hit).alias("hit_rate"),
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
    )
    quality = ic_stats(daily_ic(valid, keys, rows=rows), keys).drop("n_ic_dates")
    books = long_short(valid, keys, rows=rows).groupBy(*keys).agg(
        sharpe(F.col("ret"), horizon, MIN_SHARPE_DATES).alias("long_short_sharpe")
    )
    return (
        errors.join(quality, list(keys), "left")
        .join(books, list(keys), "left")
        .select(
            *keys,
            "n_observations",
            "n_dates",
            "information_coefficient",
            "ic_t_stat",
            "hit_rate",
            "mae",
            "rmse",
            "long_short_sharpe",
        )
    )


def compare_models(
    df: DataFrame, model_ids: Sequence[str] | None = None, horizon: int = 5, rows: int | None = None
) -> DataFrame:
    """All models in one job, one row each."""
    if "model_id" not in df.columns:
        raise ValueError("comparing models needs a model_id column")
    if model_ids is not None:
        df = df.where(F.col("model_id").isin(list(model_ids)))
    return summarize(df, MODEL, horizon, rows).orderBy("model_id")


def hac_t(series: DataFrame, value: str, lag: int, keys: Sequence[str] = MODEL) -> DataFrame:
    """(keys, n, mean, t_naive, t_hac) of a dated series: Newey-West with a Bartlett kernel.

    The series has one row per date, so its ordered window is bounded by the calendar.
    """
    series = series.where(F.col(value).isNotNull() & ~F.isnan(value))
    whole = Window.partitionBy(*keys)
    ordered = whole.orderBy("date")
    centered = series.withColumn("_d", F.col(value) - F.avg(value).over(whole))
    centered = centered.withColumns({f"_l{k}": F.col("_d") * F.lag("_d", k).over(ordered) for k in range(1, lag + 1)})
    n = F.count(F.lit(1))
    variance = F.sum(F.col("_d") * F.col("_d")) / n
    for k in range(1, lag + 1):
        variance = variance + F.lit(2.0 * (1.0 - k / (lag + 1.0))) * F.coalesce(F.sum(f"_l{k}"), F.lit(0.0)) / n
    return (
        centered.groupBy(*keys)
        .agg(
            n.alias("n"),
            F.avg(value).alias("mean"),
            F.stddev_samp(value).alias("_s"),
            variance.alias("_v"),
        )
        .select(
            *keys,
            "n",
            "mean",
            F.when(F.col("_s") > 0, F.col("mean") * F.sqrt("n") / F.col("_s")).alias("t_naive"),
            F.when((F.col("n") >= 2) & (F.col("_v") > 0), F.col("mean") / F.sqrt(F.col("_v") / F.col("n"))).alias("t_hac"),
        )
    )


def monthly_ic(ic: DataFrame, keys: Sequence[str] = MODEL) -> DataFrame:
    month = F.date_trunc("month", "date").cast("date")
    return ic.groupBy(*keys, month.alias("month")).agg(F.avg("ic").alias("mean_ic"), F.count("ic").alias("n_dates"))


def rolling_ic(ic: DataFrame, days: int = 60, keys: Sequence[str] = MODEL) -> DataFrame:
    """Mean IC over the last ``days`` calendar days, today included."""
    day = F.unix_date("date").cast("long")
    frame = Window.partitionBy(*keys).orderBy("_day").rangeBetween(-(days - 1), 0)
    return ic.withColumn("_day", day).withColumn("rolling_ic", F.avg("ic").over(frame)).drop("_day")


def deflated_sharpe(returns: DataFrame, n_trials: int, horizon: int, keys: Sequence[str] = MODEL) -> DataFrame:
    """Probability that the true Sharpe is positive, given the number of trials and the moments.

    The expected best of n trials without skill is sqrt(2 ln n / periods).
    """
    base = returns.groupBy(*keys).agg(
        F.count("ret").alias("n_periods"),
        sharpe(F.col("ret"), horizon, MIN_SHARPE_DATES).alias("sharpe_obs"),
        F.skewness("ret").alias("skew"),
        (F.kurtosis("ret") + 3.0).alias("kurt"),
    )
    sr = F.col("sharpe_obs")
    best = F.sqrt(F.lit(2.0 * math.log(max(n_trials, 1))) / F.col("n_periods"))
    shape = F.greatest(1.0 - F.col("skew") * sr + (F.col("kurt") - 1.0) / 4.0 * sr * sr, F.lit(1e-12))
    return (
        base.where(sr.isNotNull())
        .withColumn("expected_max_sharpe", best)
        .withColumn(
            "test_statistic", (sr - F.col("expected_max_sharpe")) * F.sqrt(F.col("n_periods") - 1) / F.sqrt(shape)
        )
        .withColumn("prob_positive", normal_cdf("test_statistic"))
    )


def common_dates(df: DataFrame, model: str = "model_id") -> DataFrame:
    """Dates on which every model has a prediction."""
    total = df.select(model).distinct().count()
    per_date = df.groupBy("date").agg(F.countDistinct(model).alias("_have"))
    return per_date.where(F.col("_have") == total).select("date")


def on_common_dates(df: DataFrame, model: str = "model_id") -> DataFrame:
    # One row per calendar day.
    return df.join(broadcast_dates(common_dates(df, model)), "date", "left_semi")


def full_coverage(df: DataFrame, n_models: int | None = None, model: str = "model_id") -> DataFrame:
    """Rows of the (date, ticker) pairs that every model covers."""
    if n_models is None:
        n_models = df.select(model).distinct().count()
    pairs = df.groupBy("date", "ticker").agg(F.countDistinct(model).alias("_have")).where(F.col("_have") == n_models)
    return df.join(pairs.select("date", "ticker"), ["date", "ticker"], "left_semi")


def binding_model(df: DataFrame, model: str = "model_id") -> DataFrame:
    """Last date per model, the model that ends first on top."""
    return df.groupBy(model).agg(F.max("date").alias("last_date")).orderBy("last_date", model)


def join_realized(predictions: DataFrame, panel: DataFrame, target: str = "y", how: str = "left") -> DataFrame:
    """Predictions with the target of their (date, ticker) as ``realized``."""
    realized = panel.select("date", "ticker", F.col(target).alias("realized"))
    return predictions.join(realized, ["date", "ticker"], how)


def time_split(
    df: DataFrame, cutoff: str, keys: Sequence[str] = MODEL, horizon: int = 5, rows: int | None = None
) -> DataFrame:
    """``summarize`` before and from ``cutoff`` on, with the dates each window really has."""
    marked = df.withColumn("window", F.when(F.col("date") < F.lit(cutoff).cast("date"), "A").otherwise("B"))
    groups = [*keys, "window"]
    spans = marked.groupBy(*groups).agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"))
    return spans.join(summarize(marked, groups, horizon, rows), groups, "left")
