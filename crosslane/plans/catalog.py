"""The registered queries: a name, a function (spark, folder) -> DataFrame and, where SQL can say it, the SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is already registered")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def shortened(column: str | Column, digits: int) -> Column:
    """Rounded to ``digits`` decimals by one floor, the same arithmetic in every engine.

    The 0.51 keeps values that end in an exact 5 away from the edge, where sums in another order
    would fall on both sides.
    """
    scale = F.lit(float(10**digits))
    value = F.col(column) if isinstance(column, str) else column
    return F.floor(value * scale + F.lit(0.51)) / scale


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """All doubles shortened, so that sums in another order compare equal."""
    return df.select(*[shortened(n, digits).alias(n) if k == "double" else F.col(n) for n, k in df.dtypes])
