"""Feature plug-ins: a feature is a named column builder plus what it needs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, WindowSpec

# A series feature reads one ticker's rows through a window, a series frame changes the
# frame's rows on the way, and a cross feature reads whole dates.
SERIES, SERIES_FRAME, CROSS = "series", "series_frame", "cross"


@dataclass(frozen=True)
class Feature:
    name: str
    inputs: tuple[str, ...]
    lookback_days: int
    kind: str
    build: Callable
    needs: tuple[str, ...] = ()
    version: int = 1


_FEATURES: dict[str, Feature] = {}


def _add(feature: Feature) -> None:
    if feature.name in _FEATURES:
        raise ValueError(f"feature {feature.name!r} is already registered")
    _FEATURES[feature.name] = feature


def series_feature(name: str, inputs: tuple[str, ...], lookback_days: int, needs: tuple[str, ...] = ()):
    """Register ``build(window) -> Column`` over the rows of one ticker.

    ``needs`` names shared columns (log price, return, market ...) or other features.
    """

    def register(build: Callable[[WindowSpec], Column]):
        _add(Feature(name, inputs, lookback_days, SERIES, build, needs))
        return build

    return register


def cross_feature(name: str, inputs: tuple[str, ...], lookback_days: int, needs: tuple[str, ...] = ()):
    """Register ``build(df, rows) -> df`` that adds the column from whole dates."""

    def register(build: Callable[[DataFrame, int | None], DataFrame]):
        _add(Feature(name, inputs, lookback_days, CROSS, build, needs))
        return build

    return register


def series_frame_feature(name: str, inputs: tuple[str, ...], lookback_days: int, needs: tuple[str, ...] = ()):
    """Register ``build(df) -> df`` that adds the column and keeps the split by ticker."""

    def register(build: Callable[[DataFrame], DataFrame]):
        _add(Feature(name, inputs, lookback_days, SERIES_FRAME, build, needs))
        return build

    return register


def get_feature(name: str) -> Feature:
    if name not in _FEATURES:
        raise KeyError(f"unknown feature {name!r}; have {list_features()}")
    return _FEATURES[name]


def list_features() -> list[str]:
    return sorted(_FEATURES)


def forget_feature(name: str) -> None:
    """Take a plug-in out again."""
    _FEATURES.pop(name, None)


def describe_features(spark) -> DataFrame:
    """(name, inputs, lookback_days, kind) of every registered feature."""
    rows = [(f.name, ",".join(f.inputs), f.lookback_days, f.kind) for f in map(get_feature, list_features())]
    return spark.createDataFrame(rows, "name string, inputs string, lookback_days int, kind string")
