"""Scores of a boosted model after every round, stopping by rounds, and the shortened model.

One pass over the held-out rows gives the score of every prefix of the ensemble: the rows' leaves come from the model, a leaf's
share of the prediction from a table of its tree, and running sums over the trees are the predictions round by round. A score is
a function of sums over rows, so tasks add up and no row is written per round.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import SparkContext
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class StageMetric:
    """A score out of sums over rows.

    ``terms(prediction, target, weight)`` gets (rows, rounds) predictions and (rows, 1) columns, and returns arrays of that shape
    (or broadcastable to it) that are summed over the rows; ``finish`` gets one array of rounds per term. Higher is better.
    """

    terms: Callable[[np.ndarray, np.ndarray, np.ndarray], Sequence[np.ndarray]]
    finish: Callable[..., np.ndarray]


METRICS: dict[str, StageMetric] = {}


def register_metric(name: str, metric: StageMetric) -> StageMetric:
    """Make a metric known under a name, so that models can name it in their parameters; a taken name raises."""
    if name in METRICS:
        raise ValueError(f"metric {name!r} is already registered")
    METRICS[name] = metric
    return metric


def _weighted_score(error: np.ndarray, total: np.ndarray) -> np.ndarray:
    share = np.divide(error, total, out=np.zeros_like(error), where=total > 0)
    return np.where(total > 0, np.sqrt(1.0 - np.clip(share, 0.0, 1.0)), 0.0)


register_metric(
    "rmse",
    StageMetric(lambda p, y, w: (w * (y - p) ** 2, w * np.ones_like(p)), lambda e, n: -np.sqrt(np.divide(e, n))),
)
# The weighted score of scored tables (``tabular_quality.weighted_score``) as a stopping rule.
register_metric("weighted_score", StageMetric(lambda p, y, w: (w * (y - p) ** 2, w * y * y * np.ones_like(p)), _weighted_score))


def leaf_values(model: GBTRegressionModel) -> list[np.ndarray]:
    """Per tree, the leaves' predictions times the tree's weight, in the order of the leaf numbers (left to right)."""
    trees = re.split(r"\n\s*Tree \d+ \(weight [^)]*\):\n", "\n" + model.toDebugString)[1:]
    found = [np.array([float(v) for v in re.findall(r"Predict: (\S+)", t)]) for t in trees]
    return [values * weight for values, weight in zip(found, model.treeWeights, strict=True)]


def round_scores(
    model: GBTRegressionModel, vectors: DataFrame, target: str, metric: StageMetric, weight: str | None = None
) -> np.ndarray:
    """The metric after each round over rows with ``_features``."""
    leaves = leaf_values(model)
    width = max(len(v) for v in leaves)
    table = np.zeros((len(leaves), width))
    for n, values in enumerate(leaves):
        table[n, : len(values)] = values
    shared = vectors.sparkSession.sparkContext.broadcast(table)
    rows = model.copy({model.leafCol: "_leaves"}).transform(vectors).select(
        vector_to_array("_leaves").alias("leaves"),
        F.col(target).cast("double").alias("y"),
        (F.lit(1.0) if weight is None else F.col(weight).cast("double")).alias("w"),
    )

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, total = shared.value, None
        for batch in batches:
            if not len(batch):
                continue
            at = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(batch), len(values))
            predicted = np.cumsum(values[np.arange(len(values)), at], axis=1)
            y, w = (batch.column(k).to_numpy(zero_copy_only=False)[:, None] for k in (1, 2))
            sums = np.stack([np.broadcast_to(t, predicted.shape).sum(axis=0) for t in metric.terms(predicted, y, w)])
            total = sums if total is None else total + sums
        if total is not None:
            flat = pa.array([row.tolist() for row in total], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), flat], names=["term", "sums"])

    # A row per term and task: a few kilobytes each.
    parts = rows.mapInArrow(add_up, "term int, sums array<double>").collect()
    if not parts:
        raise ValueError("no held-out rows to score")
    count = max(r["term"] for r in parts) + 1
    sums = [np.sum([r["sums"] for r in parts if r["term"] == t], axis=0) for t in range(count)]
    return np.asarray(metric.finish(*sums), dtype=float)


def best_round(scores: np.ndarray, patience: int) -> int:
    """Number of rounds to keep: up to the first best score that the next ``patience`` rounds do not beat."""
    best = 0
    for n in range(1, len(scores)):
        if scores[n] > scores[best]:
            best = n
        elif n - best >= patience:
            break
    return best + 1


def shortened_model(model: GBTRegressionModel, rounds: int) -> GBTRegressionModel:
    """The model of the first ``rounds`` trees."""
    context = SparkContext.getOrCreate()
    made = context._jvm.org.apache.spark.ml.regression
    trees = context._gateway.new_array(made.DecisionTreeRegressionModel, rounds)
    weights = context._gateway.new_array(context._jvm.double, rounds)
    for n, (tree, weight) in enumerate(zip(model._java_obj.trees()[:rounds], model.treeWeights[:rounds], strict=True)):
        trees[n], weights[n] = tree, float(weight)
    short = GBTRegressionModel(made.GBTRegressionModel(model.uid, trees, weights))
    short._resetUid(model.uid)
    return short.setFeaturesCol(model.getFeaturesCol())


def importances(model, n_features: int) -> list[float]:
    """Gain shares; features after the last one that a tree uses may be missing from the model's own list."""
    shares = model.featureImportances.toArray().tolist()
    return shares + [0.0] * (n_features - len(shares))
