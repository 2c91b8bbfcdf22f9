"""Causal smoothing of predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from crosslane.operators.rolling import add_ewm_mean


def smooth_predictions(
    df: DataFrame,
    halflife_days: int,
    column: str = "prediction",
    keys: Sequence[str] = ("ticker",),
    date: str = "date",
    rows: int | None = None,
) -> DataFrame:
    """Exponential smoothing per key: half of the weight reaches back ``halflife_days`` rows; a null row stays null."""
    if halflife_days <= 0:
        raise ValueError(f"halflife_days must be positive, got {halflife_days}")
    missing = {*keys, date, column} - set(df.columns)
    if missing:
        raise ValueError(f"frame lacks the columns {sorted(missing)}")
    alpha = 1.0 - 0.5 ** (1.0 / halflife_days)
    return add_ewm_mean(df, list(keys), [date], column, alpha, column, rows=rows, carry=False).select(*df.columns)
