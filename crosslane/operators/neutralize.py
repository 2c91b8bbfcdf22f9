"""Per-date regression residuals and the neutralized IC."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from crosslane.operators.gram import Gram, gram_columns
from crosslane.operators.metrics import MODEL, daily_ic
from crosslane.operators.ranking import join_on


def residualize(df: DataFrame, target: str | Sequence[str], on: Sequence[str], keys: Sequence[str] = MODEL) -> DataFrame:
    """Replace each ``target`` by its residual on the columns ``on`` inside each (keys, date).

    The states of all targets are one aggregation with partial sums; the small systems are solved in the tasks and their
    coefficients go back in one join, a row per date. Rows with a null and dates with at most len(on) + 1 full rows keep
    their value; a target's full rows do not depend on the other targets.
    """
    if not on:
        return df
    targets = [target] if isinstance(target, str) else list(target)
    by = [*keys, "date"]

    def full(t: str):
        return reduce(and_, [F.col(c).isNotNull() for c in (*on, t)])

    states = df.groupBy(*by).agg(
        *[c.alias(f"{c_name}_{i}") for i, t in enumerate(targets) for c, c_name in _state(on, t, full(t))]
    )
    slots = [f"_b{i}_{j}" for i in range(len(targets)) for j in range(len(on) + 1)]
    names, width = ("n", "mx", "my", "cxx", "cxy", "cyy"), len(on)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for record in batch.to_dict("records"):
                found: list[float | None] = []
                for i in range(len(targets)):
                    if record[f"n_{i}"] <= width + 1:
                        found += [None] * (width + 1)
                        continue
                    g = Gram.from_row({n: record[f"{n}_{i}"] for n in names})
                    xx, xy, _ = g.centered()
                    coef = np.linalg.lstsq(xx, xy, rcond=None)[0]
                    found += [g.intercept(coef), *coef]
                rows.append([*[record[b] for b in by], *found])
            yield pd.DataFrame(rows, columns=[*by, *slots])

    schema = StructType([*[df.schema[b] for b in by], *[StructField(s, DoubleType()) for s in slots]])
    joined = join_on(df, states.mapInPandas(solve, schema), by, "left")
    residuals = {}
    for i, t in enumerate(targets):
        fitted = reduce(lambda total, j: total + F.col(on[j]) * F.col(f"_b{i}_{j + 1}"), range(width), F.col(f"_b{i}_0"))
        residuals[t] = F.coalesce(F.col(t) - fitted, F.col(t))
    return joined.withColumns(residuals).drop(*slots)


def _state(on: Sequence[str], target: str, where):
    return list(zip(gram_columns(list(on), target, where), ("n", "mx", "my", "cxx", "cxy", "cyy"), strict=True))


def neutralized_ic(
    df: DataFrame, on: Sequence[str], keys: Sequence[str] = MODEL, rows: int | None = None
) -> DataFrame:
    """Mean IC of raw prediction and realized, and of both after taking out the columns ``on``."""
    gross = daily_ic(df, keys, rows=rows).groupBy(*keys).agg(
        F.avg("ic").alias("ic_gross"), F.count(F.lit(1)).alias("_gross_dates")
    )
    if not on:
        return gross.select(
            *keys,
            "ic_gross",
            F.col("ic_gross").alias("ic_neutralized"),
            F.col("_gross_dates").alias("n_dates"),
            F.lit(0.0).alias("delta"),
        )
    clean = residualize(df, ["prediction", "realized"], on, keys)
    net = daily_ic(clean, keys, rows=rows).groupBy(*keys).agg(
        F.avg("ic").alias("ic_neutralized"), F.count(F.lit(1)).alias("n_dates")
    )
    return (
        gross.drop("_gross_dates")
        .join(net, list(keys), "left")
        .withColumn("delta", F.col("ic_gross") - F.col("ic_neutralized"))
    )
