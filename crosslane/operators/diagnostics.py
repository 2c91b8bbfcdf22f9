"""Reports on features, residuals, coefficients, stored predictions and ablations."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crosslane.functions.numeric import correlation
from crosslane.operators.gram import Gram, collect_grams, gram, solve_ols
from crosslane.operators.metrics import daily_ic
from crosslane.operators.ranking import add_average_rank, quantiles
from crosslane.operators.rolling import add_rolling
from crosslane.session import broadcast_dates, broadcast_if
from crosslane.sources.bars import log_return

# ---- features ---------------------------------------------------------------


def unpivot_features(df: DataFrame, features: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """(keep, feature, value): one row per feature."""
    return df.unpivot(list(keep), list(features), "feature", "value")


def univariate_ic(df: DataFrame, features: Sequence[str], target: str = "y", rows: int | None = None) -> DataFrame:
    """(feature, univariate_ic, n_dates): each feature's own mean daily rank correlation."""
    long = unpivot_features(df, features, ["date", "ticker", target]).select(
        "feature", "date", "ticker", F.col("value").alias("prediction"), F.col(target).alias("realized")
    )
    ic = daily_ic(long, ["feature"], rows=rows)
    return ic.groupBy("feature").agg(F.avg("ic").alias("univariate_ic"), F.count(F.lit(1)).alias("n_dates"))


def ic_versus_beta(df: DataFrame, features: Sequence[str], target: str = "y", rows: int | None = None) -> DataFrame:
    """Own IC against the joint least squares slope, with sign agreement."""
    df = df.dropna(subset=[*features, target])
    coef = solve_ols(collect_grams(gram(df, features, target, [F.lit(0).alias("g")]), "g")[0])
    betas = df.sparkSession.createDataFrame(
        [(f, float(c)) for f, c in zip(features, coef, strict=True)], "feature string, partial_beta double"
    )
    return univariate_ic(df, features, target, rows).join(broadcast_if(betas, len(features)), "feature").withColumn(
        "agree", F.signum("univariate_ic") == F.signum("partial_beta")
    )


def feature_dispersion(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Per date: deviation of each raw feature."""
    return df.groupBy("date").agg(*[F.stddev_samp(f).alias(f) for f in features])


def feature_correlations(
    df: DataFrame, features: Sequence[str], method: str = "pearson"
) -> DataFrame:
    """(feature_a, feature_b, corr) of the upper triangle, over rows where all features are set.

    One aggregation for all pairs; Spearman ranks each column over the whole frame first.
    """
    df = df.dropna(subset=list(features)).select(*features)
    names = list(features)
    if method == "spearman":
        for f in features:
            df = add_average_rank(df, [], f, f"_r_{f}")
        names = [f"_r_{f}" for f in features]
    elif method != "pearson":
        raise ValueError(f"unknown method {method!r}")
    pairs = [(i, j) for i in range(len(features)) for j in range(i + 1, len(features))]
    wide = df.agg(
        F.array(
            *[
                F.struct(
                    F.lit(features[i]).alias("feature_a"),
                    F.lit(features[j]).alias("feature_b"),
                    correlation(names[i], names[j]).alias("corr"),
                )
                for i, j in pairs
            ]
        ).alias("_p")
    )
    return wide.select(F.explode("_p").alias("_x")).select("_x.*")


def high_pairs(correlations: DataFrame, threshold: float = 0.8) -> DataFrame:
    return correlations.where(F.abs("corr") > threshold)


def redundancy_clusters(pairs: DataFrame, importance: DataFrame) -> DataFrame:
    """(cluster, feature, importance, place): features linked by the pairs, best first.

    The pair table is features x features, so the least label is carried along the links
    until nothing changes; a chain of n features needs at most n rounds.
    """
    edges = [(r["feature_a"], r["feature_b"]) for r in pairs.select("feature_a", "feature_b").collect()]
    label = {name: name for edge in edges for name in edge}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    members = pairs.sparkSession.createDataFrame(sorted(label.items()), "feature string, cluster string")
    order = Window.partitionBy("cluster").orderBy(F.desc("importance"), "feature")
    return (
        members.join(importance.select("feature", "importance"), "feature", "left")
        .withColumn("importance", F.coalesce("importance", F.lit(0.0)))
        .withColumn("place", F.row_number().over(order))
    )


def suggested_drops(clusters: DataFrame, importance: DataFrame, bottom: int = 5) -> DataFrame:
    """(feature, in_bottom, redundant): the least important features and all but the best per cluster."""
    lowest = importance.orderBy("importance", "feature").limit(bottom).select("feature", F.lit(True).alias("in_bottom"))
    redundant = clusters.where(F.col("place") > 1).select("feature", F.lit(True).alias("redundant"))
    return lowest.join(redundant, "feature", "full").na.fill(False, ["in_bottom", "redundant"])


# ---- residuals --------------------------------------------------------------


def durbin_watson(df: DataFrame, residual: str = "residual", rows: int | None = None) -> DataFrame:
    """Sum of squared steps over sum of squares, rows in (ticker, date) order.

    Steps inside a ticker use a lag; the step between neighbouring tickers joins the last
    value of one ticker to the first of the next through a table with one row per ticker.
    """
    inside = add_rolling(
        df.select("ticker", "date", F.col(residual).alias("_e")),
        ["ticker"],
        ["date"],
        [lambda w: {"_step": F.col("_e") - F.lag("_e").over(w)}],
        back=1,
        rows=rows,
    )
    per_ticker = inside.groupBy("ticker").agg(
        F.sum(F.col("_step") * F.col("_step")).alias("_steps"),
        F.sum(F.col("_e") * F.col("_e")).alias("_squares"),
        F.min_by("_e", "date").alias("_first"),
        F.max_by("_e", "date").alias("_last"),
    ).withColumn("_all", F.lit(0))
    chained = add_rolling(
        per_ticker,
        ["_all"],
        ["ticker"],
        [lambda w: {"_gap": F.col("_first") - F.lag("_last").over(w)}],
        back=1,
    )
    return chained.agg(
        (
            (F.coalesce(F.sum("_steps"), F.lit(0.0)) + F.coalesce(F.sum(F.col("_gap") * F.col("_gap")), F.lit(0.0)))
            / F.sum("_squares")
        ).alias("durbin_watson")
    )


def residual_report(df: DataFrame, target: str = "y", fitted: str = "prediction", rows: int | None = None) -> DataFrame:
    """One row: n, R2, Durbin-Watson, skewness and (not excess) kurtosis of target - fitted."""
    df = df.dropna(subset=[target, fitted]).withColumn("residual", F.col(target) - F.col(fitted))
    e, y = F.col("residual"), F.col(target)
    shape = df.agg(
        F.count(F.lit(1)).alias("n"),
        (1.0 - F.sum(e * e) / (F.count(F.lit(1)) * F.var_pop(y))).alias("r2"),
        F.skewness(e).alias("skewness"),
        (F.kurtosis(e) + 3.0).alias("kurtosis"),
    ).withColumn("_k", F.lit(0))
    return shape.join(durbin_watson(df, rows=rows).withColumn("_k", F.lit(0)), "_k").drop("_k")


def heteroskedasticity(df: DataFrame, features: Sequence[str], residual: str = "residual") -> dict[str, float]:
    """Breusch-Pagan and White statistics: n * R2 of the squared residual on x, and on x, x^2 and products.

    Both regressions come from one aggregation over the extended columns.
    """
    extended, columns = {}, list(features)
    for i, a in enumerate(features):
        for b in features[i:]:
            extended[f"_{a}__{b}"] = F.col(a) * F.col(b)
    wide = df.dropna(subset=[*features, residual]).withColumns(
        {**extended, "_e2": F.col(residual) * F.col(residual), "_g": F.lit(0)}
    )
    sums = collect_grams(gram(wide, [*columns, *extended], "_e2", ["_g"]), "_g")[0]

    def lm(part: Gram) -> float:
        xx, xy, yy = part.centered()
        coef = np.linalg.lstsq(xx, xy, rcond=None)[0]
        return float(part.n * (coef @ xy) / yy)

    return {
        "n": int(sums.n),
        "breusch_pagan_lm": lm(sums.only(range(len(columns)))),
        "white_lm": lm(sums),
    }


def spread_by_quantile(df: DataFrame, value: str, by: str, n: int = 10) -> DataFrame:
    """(bucket, n, std): deviation of ``value`` in the quantile buckets of ``by`` (equal edges merged)."""
    probs = {f"q{i}": i / n for i in range(1, n)}
    edges = sorted(set(quantiles(df, [], by, probs).first().asDict().values()))
    bucket = F.lit(0)
    for edge in edges:
        bucket = bucket + F.when(F.col(by) > F.lit(edge), 1).otherwise(0)
    return (
        df.where(F.col(by).isNotNull())
        .groupBy(bucket.alias("bucket"))
        .agg(F.count(value).alias("n"), F.stddev_samp(value).alias("std"))
    )


def residual_outliers(df: DataFrame, top_k: int = 25, residual: str = "residual", target: str = "y") -> DataFrame:
    """The ``top_k`` rows with the largest absolute residual and the move their target implies."""
    return (
        df.where(F.col(residual).isNotNull())
        .withColumn("implied_move", F.exp(target) - 1.0)
        .orderBy(F.abs(residual).desc(), "ticker", "date")
        .limit(top_k)
    )


def outlier_spans(outliers: DataFrame) -> DataFrame:
    """(ticker, first_date, last_date, n) of the outlier rows."""
    return outliers.groupBy("ticker").agg(
        F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count(F.lit(1)).alias("n")
    )


# ---- coefficients and ablations ---------------------------------------------


def cancellation(coefficients: DataFrame, keys: Sequence[str] = ("refit_date",)) -> DataFrame:
    """|sum| / sum of absolute values of the coefficients, and the share that is not zero."""
    return coefficients.groupBy(*keys).agg(
        F.try_divide(F.abs(F.sum("coef")), F.sum(F.abs("coef"))).alias("cancel_ratio"),
        F.avg((F.abs("coef") > 1e-12).cast("double")).alias("nonzero_share"),
        F.count(F.when(F.abs("coef") > 1e-12, 1)).alias("n_nonzero"),
    )


def prediction_dispersion(df: DataFrame, keys: Sequence[str] = ("model_id",)) -> DataFrame:
    """Deviation of predictions against that of the target."""
    return df.groupBy(*keys).agg(
        F.stddev_samp("prediction").alias("prediction_std"),
        F.stddev_samp("realized").alias("target_std"),
        F.try_divide(F.stddev_samp("prediction"), F.stddev_samp("realized")).alias("dispersion_ratio"),
    )


def arm_difference(scores: DataFrame, arm: str, value: str, base: str, inflated: str, keys: Sequence[str]) -> DataFrame:
    """Two arms side by side, their difference, and the difference in percent of the base arm."""
    wide = scores.groupBy(*keys).pivot(arm, [base, inflated]).agg(F.first(value))
    gap = F.col(inflated) - F.col(base)
    return wide.withColumns(
        {"inflation": gap, "inflation_pct": F.try_divide(gap, F.abs(F.col(base))) * 100.0}
    )


# ---- regimes ----------------------------------------------------------------


def dispersion_by_date(panel: DataFrame, n: int = 20) -> DataFrame:
    """(date, dispersion): mean over ``n`` dates of the deviation of daily returns across tickers.

    The panel is collapsed to one row per date before the ordered window.
    """
    returns = panel.select("date", log_return().alias("_r"))
    per_date = returns.groupBy("date").agg(F.stddev_samp("_r").alias("_s"))
    frame = Window.orderBy("date").rowsBetween(-(n - 1), 0)
    smooth = F.when(F.count("_s").over(frame) == n, F.avg("_s").over(frame))
    return per_date.select("date", smooth.alias("dispersion")).where(F.col("dispersion").isNotNull())


def bucket_by(column: str, thresholds: Sequence[float]):
    """The number of the first threshold that is above the value, else the last bucket."""
    out = F.lit(len(thresholds))
    for i in range(len(thresholds) - 1, -1, -1):
        out = F.when(F.col(column) < F.lit(thresholds[i]), i).otherwise(out)
    return out


def thresholds_of(df: DataFrame, column: str, n_buckets: int, nearest: bool = False) -> list[float]:
    """Inner quantile edges for ``n_buckets`` buckets."""
    probs = {f"q{i}": i / n_buckets for i in range(1, n_buckets)}
    row = quantiles(df, [], column, probs, nearest=nearest).first()
    return [float(row[name]) for name in probs]


def ic_by_volatility(ic: DataFrame, panel: DataFrame, keys: Sequence[str] = ("model_id",)) -> DataFrame:
    """Mean IC on dates with cross-section volatility above and not above its median."""
    returns = panel.select("date", log_return().alias("_r")).where(F.col("_r").isNotNull())
    volatility = returns.groupBy("date").agg(F.stddev_samp("_r").alias("xs_vol")).where(F.col("xs_vol").isNotNull())
    middle = quantiles(volatility, [], "xs_vol", {"m": 0.5}).first()["m"]
    # One row per calendar day.
    marked = ic.join(broadcast_dates(volatility), "date").withColumn("high_vol", F.col("xs_vol") > F.lit(middle))
    return marked.groupBy(*keys, "high_vol").agg(
        F.avg("ic").alias("mean_ic"), F.stddev_samp("ic").alias("std_ic"), F.count("ic").alias("n_dates")
    )


# ---- stored predictions -----------------------------------------------------


def latest_per_model(predictions: DataFrame) -> DataFrame:
    """Rows on each model's own last date."""
    last = predictions.groupBy("model_id").agg(F.max("date").alias("date"))
    return predictions.join(last, ["model_id", "date"], "left_semi")


def consensus(predictions: DataFrame, models: Sequence[str]) -> DataFrame:
    """(ticker, one column per model, consensus, disagreement) on each model's last date."""
    latest = latest_per_model(predictions.where(F.col("model_id").isin(list(models))))
    return latest.groupBy("ticker").agg(
        *[F.max(F.when(F.col("model_id") == m, F.col("prediction"))).alias(m) for m in models],
        F.avg("prediction").alias("consensus"),
        F.stddev_samp("prediction").alias("disagreement"),
    )


def top_and_bottom(board: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` highest and lowest consensus names and the ``n`` with most disagreement."""
    parts = [
        ("top", [F.desc_nulls_last("consensus"), "ticker"]),
        ("bottom", [F.asc_nulls_last("consensus"), "ticker"]),
        ("disagree", [F.desc_nulls_last("disagreement"), "ticker"]),
    ]
    out = None
    for label, order in parts:
        part = board.orderBy(*order).limit(n).withColumn("list", F.lit(label))
        out = part if out is None else out.unionByName(part)
    return out


def ticker_history(predictions: DataFrame, ticker: str, last: int | None = None) -> DataFrame:
    """(date, model_id, prediction) of one ticker, newest first; ``last`` limits the rows shown."""
    rows = predictions.where(F.col("ticker") == ticker).select("date", "model_id", "prediction")
    rows = rows.orderBy(F.desc("date"), "model_id")
    return rows if last is None else rows.limit(last)
