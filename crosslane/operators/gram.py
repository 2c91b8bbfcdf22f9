"""Centred sums for least squares: one distributed aggregation, then p x p algebra.

The aggregate holds n, the means and the centred cross products per group, so its size depends on the number of columns and
groups and never on the rows. Spark merges these states pairwise (means first, then products around them), so a column whose
mean is large against its spread keeps its digits. States of disjoint row sets merge, which makes every expanding window,
fold and walk-forward split a merge over the same single scan.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _pairs(p: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(p) for j in range(i, p)]


def gram_columns(xs: Sequence[str | Column], y: str | Column, where: Column | None = None) -> list[Column]:
    """The state's aggregates, over the rows where ``where`` holds; without it x and y have to be complete."""
    cols = [F.col(x) if isinstance(x, str) else x for x in xs]
    target = F.col(y) if isinstance(y, str) else y
    n = F.count(F.lit(1))
    if where is not None:
        n, target = F.count(F.when(where, 1)), F.when(where, target)
        cols = [F.when(where, c) for c in cols]
    products = [F.var_pop(cols[i]) if i == j else F.covar_pop(cols[i], cols[j]) for i, j in _pairs(len(cols))]
    return [
        n.alias("n"),
        F.array(*[F.avg(c) for c in cols]).alias("mx"),
        F.avg(target).alias("my"),
        F.array(*[n * p for p in products]).alias("cxx"),
        F.array(*[n * F.covar_pop(c, target) for c in cols]).alias("cxy"),
        (n * F.var_pop(target)).alias("cyy"),
    ]


def gram(df: DataFrame, xs: Sequence[str], y: str, by: Sequence[str | Column] = ()) -> DataFrame:
    """One row per group with the state; rows with a null in x or y are left out."""
    return df.dropna(subset=[*xs, y]).groupBy(*by).agg(*gram_columns(xs, y))


@dataclass
class Gram:
    """The state of one row set on the driver: n, means, and sums of products of differences from the means."""

    n: float
    x_mean: np.ndarray
    y_mean: float
    cxx: np.ndarray
    cxy: np.ndarray
    cyy: float

    @classmethod
    def from_row(cls, row) -> Gram:
        """The state out of a row of ``gram``, or out of plain sums (sx, sxx, sxy, sy, syy)."""
        plain = "sx" in row
        p = len(row["sx" if plain else "mx"])
        full = np.zeros((p, p))
        for value, (i, j) in zip(row["sxx" if plain else "cxx"], _pairs(p), strict=True):
            full[i, j] = full[j, i] = value
        n = float(row["n"])
        if not plain:
            return cls(n, np.array(row["mx"], float), float(row["my"]), full, np.array(row["cxy"], float), float(row["cyy"]))
        mx, my = np.array(row["sx"], float) / n, row["sy"] / n
        return cls(n, mx, my, full - n * np.outer(mx, mx), np.array(row["sxy"], float) - n * mx * my, row["syy"] - n * my * my)

    @classmethod
    def zero(cls, p: int) -> Gram:
        return cls(0.0, np.zeros(p), 0.0, np.zeros((p, p)), np.zeros(p), 0.0)

    def __add__(self, other: Gram) -> Gram:
        n = self.n + other.n
        if n == 0:
            return self
        share, weight = other.n / n, self.n * other.n / n
        dx, dy = other.x_mean - self.x_mean, other.y_mean - self.y_mean
        return Gram(
            n,
            self.x_mean + share * dx,
            self.y_mean + share * dy,
            self.cxx + other.cxx + weight * np.outer(dx, dx),
            self.cxy + other.cxy + weight * dx * dy,
            self.cyy + other.cyy + weight * dy * dy,
        )

    @property
    def sxx(self) -> np.ndarray:
        """Products of the columns as they are."""
        return self.cxx + self.n * np.outer(self.x_mean, self.x_mean)

    @property
    def sxy(self) -> np.ndarray:
        return self.cxy + self.n * self.x_mean * self.y_mean

    def uncentered(self) -> Gram:
        """The same rows with means counted as 0: regression through the origin."""
        return Gram(
            self.n, np.zeros_like(self.x_mean), 0.0, self.sxx, self.sxy, self.cyy + self.n * self.y_mean * self.y_mean
        )

    def only(self, columns: Sequence[int]) -> Gram:
        """The state of a subset of the columns: variants need no second scan."""
        pick = list(columns)
        return Gram(self.n, self.x_mean[pick], self.y_mean, self.cxx[np.ix_(pick, pick)], self.cxy[pick], self.cyy)

    def centered(self) -> tuple[np.ndarray, np.ndarray, float]:
        """X'X, X'y and y'y of the centered columns."""
        return self.cxx, self.cxy, self.cyy

    def intercept(self, coef: np.ndarray) -> float:
        return float(self.y_mean - self.x_mean @ coef)

    def squared_error(self, coef: np.ndarray, intercept: float) -> float:
        """Sum of squared errors of a given linear rule on these rows."""
        c = np.asarray(coef)
        gap = self.y_mean - self.x_mean @ c - intercept
        return float(self.cyy - 2 * (c @ self.cxy) + c @ self.cxx @ c + self.n * gap * gap)


def collect_grams(grams: DataFrame, key: str) -> dict:
    """States keyed by a small set of groups (segments, folds, buckets)."""
    return {row[key]: Gram.from_row(row) for row in grams.collect()}


def solve_ols(g: Gram) -> np.ndarray:
    xx, xy, _ = g.centered()
    return np.linalg.lstsq(xx, xy, rcond=None)[0]


def solve_ridge(g: Gram, alpha: float) -> np.ndarray:
    xx, xy, _ = g.centered()
    return np.linalg.lstsq(xx + alpha * np.eye(len(xy)), xy, rcond=None)[0]


def solve_l1(
    g: Gram, alpha: float, l1_ratio: float = 1.0, max_iter: int = 5000, tol: float = 1e-10
) -> np.ndarray:
    """Coordinate descent for |y - Xw|^2 / 2n + alpha (l1 |w|_1 + (1 - l1) |w|^2 / 2)."""
    xx, xy, _ = g.centered()
    xx, xy = xx / g.n, xy / g.n
    w = np.zeros(len(xy))
    for _ in range(max_iter):
        step = 0.0
        for j in range(len(w)):
            if xx[j, j] <= 0:
                continue
            pull = xy[j] - xx[j] @ w + xx[j, j] * w[j]
            new = np.sign(pull) * max(abs(pull) - alpha * l1_ratio, 0.0) / (xx[j, j] + alpha * (1.0 - l1_ratio))
            step = max(step, abs(new - w[j]))
            w[j] = new
        if step <= tol * max(1.0, float(np.max(np.abs(w), initial=0.0))):
            return w
    warnings.warn(f"coordinate descent has not converged after {max_iter} sweeps", RuntimeWarning, stacklevel=2)
    return w


def solve_nnls(g: Gram, max_iter: int = 20000, tol: float = 1e-12) -> np.ndarray:
    """Least squares with slopes >= 0 and a free intercept."""
    xx, xy, _ = g.centered()
    w = np.zeros(len(xy))
    for _ in range(max_iter):
        step = 0.0
        for j in range(len(w)):
            if xx[j, j] <= 0:
                continue
            new = max(0.0, w[j] + (xy[j] - xx[j] @ w) / xx[j, j])
            step = max(step, abs(new - w[j]))
            w[j] = new
        if step <= tol:
            return w
    warnings.warn(f"non-negative least squares has not converged after {max_iter} sweeps", RuntimeWarning, stacklevel=2)
    return w


def ols_by_group(grams: DataFrame, by_schema: str, names: Sequence[str]) -> DataFrame:
    """Solve every group's regression in the tasks: (by, alpha, <names>, n, r2, sse).

    For group counts that grow with the data (tickers, dates); a row in, a row out.
    """
    by = [part.strip().split(" ")[0] for part in by_schema.split(",")]
    schema = f"{by_schema}, alpha double, {', '.join(f'{n} double' for n in names)}, n bigint, r2 double, sse double"

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for record in batch.to_dict("records"):
                g = Gram.from_row(record)
                xx, xy, yy = g.centered()
                coef = np.linalg.lstsq(xx, xy, rcond=None)[0]
                sse = max(float(yy - 2 * coef @ xy + coef @ xx @ coef), 0.0)
                r2 = 1.0 - sse / yy if yy > 0 else None
                rows.append([*[record[b] for b in by], g.intercept(coef), *coef, int(g.n), r2, sse])
            yield pd.DataFrame(rows, columns=[*by, "alpha", *names, "n", "r2", "sse"])

    return grams.mapInPandas(solve, schema)
