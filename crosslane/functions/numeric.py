"""Scalar helpers shared by the operators."""

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def ratio(top: Column, bottom: Column) -> Column:
    """``top / bottom``, null where ``bottom`` is 0 or null."""
    return F.try_divide(top, bottom)


def correlation(x: str | Column, y: str | Column) -> Column:
    """Pearson correlation over rows where both are set; null where one side is constant.

    The built-in raises on a constant side in ANSI mode.
    """
    a, b = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    a, b = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def leg_size(n: Column, fraction: float) -> Column:
    """Names per leg: n * fraction rounded half to even, one at least."""
    return F.greatest(F.lit(1), F.bround(n * F.lit(float(fraction)), 0).cast("int"))


def md5_number(*parts: Column) -> Column:
    """A uniform 32-bit number keyed by ``parts``: the same on every run and engine."""
    digest = F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def dot(columns: Sequence[str], weights: Sequence[float], intercept: float = 0.0) -> Column:
    """intercept + sum of weight * column, a null column counting as 0."""
    total = F.lit(float(intercept))
    for name, weight in zip(columns, weights, strict=True):
        total = total + F.coalesce(F.col(name), F.lit(0.0)) * F.lit(float(weight))
    return total


def softmax_share(score: Column, temperature: float, window) -> Column:
    """exp(t * score) / sum, with the largest score subtracted first."""
    scaled = F.exp((score - F.max(score).over(window)) * F.lit(float(temperature)))
    return scaled / F.sum(scaled).over(window)


@F.pandas_udf(DoubleType())
def normal_cdf(x: pd.Series) -> pd.Series:
    """Standard normal distribution function; used on one row per model."""
    return x.map(lambda v: None if pd.isna(v) else 0.5 * (1.0 + math.erf(v / math.sqrt(2.0))))
