"""Closed-form models per ticker and per-ticker time series reports.

Every fit is a grouped aggregate over the ticker's returns, so it is one shuffle
with partial sums for any number of tickers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from typing import ClassVar

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crosslane.functions.numeric import correlation
from crosslane.operators.features import demean_by_date
from crosslane.operators.gram import gram, gram_columns, ols_by_group
from crosslane.operators.metrics import TRADING_DAYS
from crosslane.operators.models import Model, _keys, register_alias, register_model
from crosslane.operators.prefix_fits import intercept, pair_correlation, prefix_moments, slope
from crosslane.session import broadcast_dates, fresh_path
from crosslane.sources.bars import add_log_return
from crosslane.sources.factors import FACTORS, attach_factors

_MIN_HISTORY = 252


def with_lags(panel: DataFrame, column: str, lags: Sequence[int]) -> DataFrame:
    """Lag columns ``<column>_l<k>``; a ticker's window is bounded by the calendar."""
    w = Window.partitionBy("ticker").orderBy("date")
    return panel.withColumns({f"{column}_l{k}": F.lag(column, k).over(w) for k in lags})


class _PerTicker(Model):
    """State is a table with one row per ticker, kept as a plan or, once saved, as Parquet."""

    defaults: ClassVar = {"min_history": _MIN_HISTORY, "horizon_days": 5}

    def table(self) -> DataFrame:
        self._fitted()
        return self._table

    def _set(self, table: DataFrame) -> _PerTicker:
        path = fresh_path(table.sparkSession, "fit")
        table.write.parquet(path)
        self._table = table.sparkSession.read.parquet(path)
        self.state = {"table": path}
        return self

    def save(self, spark, path):
        self.table().write.mode("overwrite").parquet(f"{path}/table")
        kept, self.state = self.state, {"table": f"{path}/table"}
        super().save(spark, f"{path}/model")
        self.state = kept

    @staticmethod
    def load(spark, path):
        model = Model.load(spark, f"{path}/model")
        model._table = spark.read.parquet(model.state["table"])
        return model

    def _scored(self, panel: DataFrame) -> DataFrame:
        """Keys of the panel with the ticker's fit; a fit per split meets the rows of its split."""
        table = self.table()
        return panel.select(*_keys(panel)).distinct().join(table, [c for c in ("split", "ticker") if c in table.columns])


class _Expanding(_PerTicker):
    """A per-ticker fit whose expanding refits all come from one table of running sums (``prefix_fits``)."""

    def observations(self, panel: DataFrame) -> DataFrame:
        """Rows that the fit sums up, with lags that look back only, so that a shorter training set has the same ones."""
        raise NotImplementedError

    def moments(self) -> dict:
        """The arguments of ``prefix_moments`` beyond the rows."""
        raise NotImplementedError

    def solved(self, moments: DataFrame) -> DataFrame:
        """The fit's columns next to the keys of ``moments``."""
        raise NotImplementedError

    def fit_prefixes(self, rows: DataFrame, splits: int) -> _Expanding:
        """The fits of all splits out of observations with ``segment``."""
        return self._set(self.solved(prefix_moments(rows, splits, **self.moments())))

    def keep_split(self, split: int) -> None:
        """From now on the fit of this split is the model's."""
        self._set(self.table().where(F.col("split") == split).drop("split"))

    def fit(self, panel):
        rows = self.observations(panel).withColumn("segment", F.lit(0))
        return self._set(self.solved(prefix_moments(rows, 1, **self.moments())).drop("split"))


@register_model
class GbmMaximumLikelihood(_Expanding):
    """Drift and deviation of the log return; prediction (mu - s^2 / 2) h less the date's mean."""

    def observations(self, panel):
        return add_log_return(panel).where(F.col("log_return").isNotNull())

    def moments(self):
        return {"pairs": {"r": ("log_return", "log_return")}, "counts": {"n": "log_return"}, "last": {}}

    def solved(self, moments):
        return moments.where(F.col("n") >= int(self.params["min_history"])).select(
            "ticker",
            "split",
            F.col("r_mx").alias("mu"),
            F.sqrt(F.try_divide(F.col("r_sxx"), F.col("r_n") - 1)).alias("sigma"),
            "n",
        )

    def predict(self, panel):
        h = float(self.params["horizon_days"])
        point = (F.col("mu") - 0.5 * F.col("sigma") * F.col("sigma")) * h
        band = F.col("sigma") * (2.0 * math.sqrt(h))
        out = self._scored(panel).select(
            *_keys(panel),
            point.alias("prediction"),
            (point - band).alias("pred_lower"),
            (point + band).alias("pred_upper"),
        )
        return demean_by_date(out, "prediction")


@register_model
class ArDriftPerTicker(_Expanding):
    """r[t] = c + phi r[t-1] per ticker by least squares; prediction is the h-step sum, demeaned.

    With m = c / (1 - phi), the k-step forecast is m + phi^k (r - m), so the sum is
    h m + (r - m) phi (1 - phi^h) / (1 - phi).
    """

    def observations(self, panel):
        return with_lags(add_log_return(panel), "log_return", [1])

    def moments(self):
        return {
            "pairs": {"r": ("log_return", "log_return_l1")},
            "counts": {"n": "log_return"},
            "last": {"last_return": "log_return"},
        }

    def solved(self, moments):
        fitted = moments.withColumns({"phi": slope("r"), "c": intercept("r")})
        fitted = fitted.where((F.col("n") >= int(self.params["min_history"])) & (F.abs("phi") < 1.0))
        return fitted.select("ticker", "split", "phi", "c", "last_return", "n")

    def predict(self, panel):
        h = float(self.params["horizon_days"])
        mean = F.col("c") / (1.0 - F.col("phi"))
        pull = F.col("phi") * (1.0 - F.pow("phi", F.lit(h))) / (1.0 - F.col("phi"))
        total = mean * h + (F.col("last_return") - mean) * pull
        out = self._scored(panel).select(*_keys(panel), total.alias("prediction"))
        return demean_by_date(out, "prediction")


@register_model
class MomentVolForecaster(_Expanding):
    """Variance forecast by moments: point 0, band +-2 deviations of the h-step return.

    The squared return of a persistent-variance process has autocorrelations that fall by the
    persistence per lag, so persistence = acf2 / acf1 of r^2, kept inside [0, 0.999]. The k-step
    variance is then target + persistence^k (last - target), with ``last`` the mean of the
    newest 20 squared returns.
    """

    def observations(self, panel):
        squares = add_log_return(panel).withColumn("_q", F.col("log_return") * F.col("log_return"))
        squares = with_lags(squares.where(F.col("_q").isNotNull()), "_q", [1, 2])
        w = Window.partitionBy("ticker").orderBy("date").rowsBetween(-19, 0)
        return squares.withColumn("_recent", F.avg("_q").over(w))

    def moments(self):
        pairs = {"q": ("_q", "_q"), "q1": ("_q", "_q_l1"), "q2": ("_q", "_q_l2")}
        return {"pairs": pairs, "counts": {"n": "_q"}, "last": {"last_var": "_recent"}}

    def solved(self, moments):
        near, far = pair_correlation("q1"), pair_correlation("q2")
        ratio = F.greatest(F.lit(0.0), F.least(F.lit(0.999), F.try_divide(far, near)))
        return moments.where(F.col("n") >= int(self.params["min_history"])).select(
            "ticker",
            "split",
            F.col("q_mx").alias("target_var"),
            "last_var",
            "n",
            F.when(near > 0, ratio).otherwise(0.0).alias("persistence"),
        )

    def predict(self, panel):
        h = int(self.params["horizon_days"])
        gap, total = F.col("last_var") - F.col("target_var"), F.col("target_var") * float(h)
        for k in range(1, h + 1):
            total = total + gap * F.pow("persistence", F.lit(float(k)))
        band = 2.0 * F.sqrt(F.greatest(total, F.lit(0.0)))
        return self._scored(panel).select(
            *_keys(panel), F.lit(0.0).alias("prediction"), (-band).alias("pred_lower"), band.alias("pred_upper")
        )


register_alias("ArimaPerTicker", "ArDriftPerTicker")
register_alias("GarchVolForecaster", "MomentVolForecaster")


@register_model
class FamaFrenchFactorModel(_PerTicker):
    """Two passes: betas per ticker over time, then premia per date over the betas.

    The second pass uses the same day's returns. The prediction is beta . mean premium * h,
    less the date's mean.
    """

    defaults: ClassVar = {
        "factors": FACTORS,
        "min_history": _MIN_HISTORY,
        "horizon_days": 5,
        "lambda_window": 60,
    }

    def __init__(self, config, factors: DataFrame | None = None):
        super().__init__(config)
        self._factors = factors

    def fit(self, panel, factors: DataFrame | None = None):
        table = factors if factors is not None else self._factors
        if table is None:
            raise ValueError("the factor model needs a factor table")
        names = list(self.params["factors"])
        betas = [f"beta_{f}" for f in names]
        excess = excess_returns(panel, table, names)
        grams = gram(excess, names, "excess", ["ticker"]).where(F.col("n") >= int(self.params["min_history"]))
        loadings = ols_by_group(grams, "ticker string", betas).select("ticker", *betas)
        fitted = excess.join(loadings, "ticker").select("date", "ticker", "excess", *betas)
        days = fitted.select("date").distinct().orderBy(F.desc("date")).limit(int(self.params["lambda_window"]))
        recent = fitted.join(broadcast_dates(days), "date", "left_semi")
        premia = ols_by_group(
            gram(recent, betas, "excess", ["date"]).where(F.col("n") >= max(2, len(names))),
            "date date",
            [f"lambda_{f}" for f in names],
        )
        means = premia.agg(*[F.avg(f"lambda_{f}").alias(f) for f in names]).first()
        self.premia = {f: float(means[f] or 0.0) for f in names}
        daily = None
        for f, b in zip(names, betas, strict=True):
            term = F.col(b) * F.lit(self.premia[f])
            daily = term if daily is None else daily + term
        return self._set(loadings.withColumn("daily", daily))

    def predict(self, panel):
        h = float(self.params["horizon_days"])
        out = self._scored(panel).select(*_keys(panel), (F.col("daily") * h).alias("prediction"))
        return demean_by_date(out, "prediction")


def excess_returns(panel: DataFrame, factors: DataFrame, names: Sequence[str] = FACTORS) -> DataFrame:
    """Log return less the risk-free rate with the factors of the date; incomplete rows are left out."""
    joined = attach_factors(add_log_return(panel), factors, [*names, "RF"])
    return joined.withColumn("excess", F.col("log_return") - F.col("RF")).dropna(subset=["excess", *names])


def factor_loadings(
    panel: DataFrame, factors: DataFrame, window: int = 252, min_rows: int = 60, names: Sequence[str] = FACTORS
) -> DataFrame:
    """(ticker, alpha_daily, beta_*, r2, idio_vol_ann) over each ticker's last ``window`` rows."""
    excess = excess_returns(panel, factors, names)
    newest = Window.partitionBy("ticker").orderBy(F.desc("date"))
    recent = excess.withColumn("_k", F.row_number().over(newest)).where(F.col("_k") <= window)
    betas = [f"beta_{f}" for f in names]
    grams = gram(recent, list(names), "excess", ["ticker"]).where(F.col("n") >= min_rows)
    # Residuals have mean 0, so their sample variance is sse / (n - 1).
    return ols_by_group(grams, "ticker string", betas).select(
        "ticker",
        F.col("alpha").alias("alpha_daily"),
        *betas,
        "r2",
        F.sqrt(F.col("sse") / (F.col("n") - 1) * TRADING_DAYS).alias("idio_vol_ann"),
        "n",
    )


def portfolio_exposure(loadings: DataFrame, weights: DataFrame, names: Sequence[str] = FACTORS) -> DataFrame:
    """One row: weighted betas and annualized alpha of a (ticker, weight) portfolio."""
    held = loadings.join(weights, "ticker")
    return held.agg(
        *[F.sum(F.col(f"beta_{f}") * F.col("weight")).alias(f"beta_{f}") for f in names],
        (F.sum(F.col("alpha_daily") * F.col("weight")) * TRADING_DAYS).alias("alpha_ann"),
    )


def realized_attribution(
    panel: DataFrame,
    factors: DataFrame,
    weights: DataFrame,
    betas: dict[str, float],
    window: int = 252,
    names: Sequence[str] = FACTORS,
) -> DataFrame:
    """Per date: portfolio return, excess, factor contributions and residual.

    The last ``window`` dates of the panel; dates on which a held name is missing are left out.
    """
    held = weights.count()
    returns = add_log_return(panel).where(F.col("log_return").isNotNull())
    days = returns.select("date").distinct().orderBy(F.desc("date")).limit(window)
    daily = (
        returns.join(broadcast_dates(days), "date", "left_semi")
        .join(weights, "ticker")
        .groupBy("date")
        .agg(F.sum(F.col("log_return") * F.col("weight")).alias("portfolio"), F.count(F.lit(1)).alias("_have"))
        .where(F.col("_have") == held)
        .drop("_have")
        .join(factors.select("date", *names, "RF"), "date")
    )
    parts = {f"via_{f}": F.col(f) * F.lit(float(betas[f])) for f in names}
    out = daily.withColumn("excess", F.col("portfolio") - F.col("RF")).withColumns(parts)
    total = None
    for name in parts:
        total = F.col(name) if total is None else total + F.col(name)
    return out.withColumn("factor_total", total).withColumn("residual", F.col("excess") - F.col("factor_total")).drop(*names)


def attribution_totals(daily: DataFrame) -> DataFrame:
    """(component, total): sums over the window."""
    names = [c for c in daily.columns if c != "date"]
    return daily.agg(*[F.sum(c).alias(c) for c in names]).unpivot([], names, "component", "total")


def risk_concentration(loadings: DataFrame, weights: DataFrame) -> DataFrame:
    """Share of each name in the portfolio's idiosyncratic variance, in percent."""
    held = loadings.join(weights, "ticker").select("ticker", "weight", "idio_vol_ann")
    share = F.pow(F.col("weight") * F.col("idio_vol_ann"), F.lit(2.0))
    held = held.withColumn("idio_var", share)
    total = held.agg(F.sum("idio_var")).first()[0]
    return held.withColumn("share_pct", F.col("idio_var") / F.lit(total) * 100.0)


def annualized_stats(panel: DataFrame) -> DataFrame:
    """(ticker, mu_daily, sigma_daily, mu_annual, sigma_annual, sharpe_annual)."""
    days, root = float(TRADING_DAYS), math.sqrt(TRADING_DAYS)
    base = add_log_return(panel).groupBy("ticker").agg(
        F.avg("log_return").alias("mu_daily"), F.stddev_samp("log_return").alias("sigma_daily")
    )
    return base.withColumns(
        {"mu_annual": F.col("mu_daily") * days, "sigma_annual": F.col("sigma_daily") * root}
    ).withColumn("sharpe_annual", F.try_divide("mu_annual", "sigma_annual"))


def autocorrelation(panel: DataFrame, lags: int = 30) -> DataFrame:
    """(ticker, lag, acf, n): lagged products over the full variance, as for an ACF plot."""
    returns = add_log_return(panel).where(F.col("log_return").isNotNull())
    whole = Window.partitionBy("ticker")
    centered = returns.withColumn("_d", F.col("log_return") - F.avg("log_return").over(whole))
    lagged = with_lags(centered.select("ticker", "date", "_d"), "_d", range(1, lags + 1))
    sums = lagged.groupBy("ticker").agg(
        F.count("_d").alias("n"),
        F.sum(F.col("_d") * F.col("_d")).alias("_v"),
        *[F.sum(F.col("_d") * F.col(f"_d_l{k}")).alias(f"_c{k}") for k in range(1, lags + 1)],
    )
    pairs = F.array(*[F.struct(F.lit(k).alias("lag"), F.try_divide(f"_c{k}", "_v").alias("acf")) for k in range(1, lags + 1)])
    return sums.select("ticker", "n", F.explode(pairs).alias("_x")).select("ticker", "_x.lag", "_x.acf", "n")


def ljung_box(acf: DataFrame, lags: Sequence[int] = (10, 20)) -> DataFrame:
    """(ticker, lags, q): n (n + 2) sum acf^2 / (n - k)."""
    term = F.col("acf") * F.col("acf") / (F.col("n") - F.col("lag"))
    scale = F.max("n") * (F.max("n") + 2)
    sums = acf.groupBy("ticker").agg(
        F.array(
            *[
                F.struct(F.lit(h).alias("lags"), (scale * F.sum(F.when(F.col("lag") <= h, term))).alias("q"))
                for h in lags
            ]
        ).alias("_q")
    )
    return sums.select("ticker", F.explode("_q").alias("_x")).select("ticker", "_x.*")


# Dickey-Fuller critical values with a constant, large samples.
ADF_CRITICAL = {"1%": -3.43, "5%": -2.86, "10%": -2.57}


def adf_statistic(panel: DataFrame, column: str = "adj_close", lags: int = 1) -> DataFrame:
    """(ticker, adf_stat, n, stationary_5pct): t of y[t-1] in dy on (y[t-1], lagged dy), with constant."""
    w = Window.partitionBy("ticker").orderBy("date")
    df = panel.where(F.col(column).isNotNull()).select("ticker", "date", F.col(column).alias("_y"))
    df = df.withColumns({"_dy": F.col("_y") - F.lag("_y").over(w), "_l": F.lag("_y").over(w)})
    names = ["_l"] + [f"_dy_l{k}" for k in range(1, lags + 1)]
    grams = with_lags(df, "_dy", range(1, lags + 1)).dropna(subset=["_dy", *names])
    sums = grams.groupBy("ticker").agg(*gram_columns(names, "_dy"))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from crosslane.operators.gram import Gram

        for batch in batches:
            rows = []
            for record in batch.to_dict("records"):
                g = Gram.from_row(record)
                xx, xy, yy = g.centered()
                free = g.n - len(xy) - 1
                stat = None
                if free > 0 and np.linalg.matrix_rank(xx) == len(xy):
                    inverse = np.linalg.inv(xx)
                    coef = inverse @ xy
                    error = max(float(yy - coef @ xy), 0.0) / free
                    if error > 0:
                        stat = float(coef[0] / math.sqrt(error * inverse[0, 0]))
                rows.append((record["ticker"], stat, int(g.n)))
            yield pd.DataFrame(rows, columns=["ticker", "adf_stat", "n"])

    out = sums.mapInPandas(solve, "ticker string, adf_stat double, n bigint")
    return out.withColumn("stationary_5pct", F.col("adf_stat") < ADF_CRITICAL["5%"])


def volatility_paths(panel: DataFrame, model: MomentVolForecaster, n: int = 20) -> DataFrame:
    """(date, ticker, model_vol, realized_vol): one-step model deviation against the rolling one."""
    w = Window.partitionBy("ticker").orderBy("date")
    frame = w.rowsBetween(-(n - 1), 0)
    r = F.col("log_return")
    df = add_log_return(panel).join(model.table(), "ticker")
    recent = F.avg(r * r).over(frame)
    step = F.col("target_var") + F.col("persistence") * (recent - F.col("target_var"))
    realized = F.when(F.count(r).over(frame) == n, F.stddev_samp(r).over(frame))
    return df.select(
        "date", "ticker", F.sqrt(F.greatest(step, F.lit(0.0))).alias("model_vol"), realized.alias("realized_vol")
    )


def volatility_half_life(model: MomentVolForecaster) -> DataFrame:
    """(ticker, persistence, half_life): -ln 2 / ln(persistence)."""
    p = F.col("persistence")
    return model.table().select("ticker", "persistence", F.when((p > 0) & (p < 1), -math.log(2.0) / F.log(p)).alias("half_life"))
