"""Hyperparameter search, ablation grids and grader comparisons."""

from __future__ import annotations

import random
from collections.abc import Sequence
from datetime import date
from functools import partial
from typing import Any

import numpy as np
from pyspark.errors import IllegalArgumentException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosslane.operators.folds import Fold, block_folds, chain_folds, date_index, fold_dates
from crosslane.operators.gram import Gram, solve_l1, solve_ols, solve_ridge
from crosslane.operators.metrics import daily_ic, join_realized
from crosslane.operators.models import (
    DateGrams,
    LassoCrossSectional,
    Model,
    ModelConfig,
    RidgeCrossSectional,
    Rule,
    Trial,
    build_model,
    l1_alpha_grid,
    ridge_alpha_grid,
    score_rules,
    select_by_error,
)
from crosslane.operators.trees import _Boosted, prepared, submit_all
from crosslane.session import broadcast_dates

# The search space of each family of boosted trees; (low, high, scale).
TREE_SPACES = {
    "LeafwiseBoosting": {
        "learning_rate": (0.005, 0.1, "log"),
        "num_leaves": (15, 200, "int"),
        "min_data_in_leaf": (50, 500, "int"),
        "feature_fraction": (0.5, 0.95, "linear"),
        "bagging_fraction": (0.5, 0.95, "linear"),
        "n_estimators": (200, 1500, "int"),
    },
    "DepthwiseBoosting": {
        "learning_rate": (0.005, 0.1, "log"),
        "max_depth": (3, 10, "int"),
        "min_child_weight": (5, 100, "int"),
        "subsample": (0.5, 0.95, "linear"),
        "colsample_bytree": (0.5, 0.95, "linear"),
        "n_estimators": (200, 1500, "int"),
    },
    "SymmetricBoosting": {
        "learning_rate": (0.005, 0.1, "log"),
        "depth": (3, 10, "int"),
        "rsm": (0.5, 0.95, "linear"),
        "subsample": (0.5, 0.95, "linear"),
        "n_estimators": (200, 1500, "int"),
    },
}
TREE_SPACE = TREE_SPACES["LeafwiseBoosting"]
# Trials of a sweep.
TRIALS = 40


def draw_params(space: dict[str, tuple], n_trials: int = TRIALS, seed: int = 42) -> list[dict[str, Any]]:
    """``n_trials`` random parameter sets."""
    rng = random.Random(seed)
    trials = []
    for _ in range(n_trials):
        params: dict[str, Any] = {}
        for name, (low, high, scale) in space.items():
            if scale == "int":
                params[name] = rng.randint(int(low), int(high))
            elif scale == "log":
                params[name] = float(np.exp(rng.uniform(np.log(low), np.log(high))))
            else:
                params[name] = rng.uniform(low, high)
        trials.append(params)
    return trials


def confine(matrix: DataFrame, max_date: date | None = None, train_start: date | None = None) -> DataFrame:
    """Rows a sweep may see."""
    if max_date is not None:
        matrix = matrix.where(F.col("date") <= F.lit(max_date))
    return matrix if train_start is None else matrix.where(F.col("date") >= F.lit(train_start))


def sweep(
    matrix: DataFrame,
    model_class: str,
    features: Sequence[str],
    trials: Sequence[dict[str, Any]],
    n_blocks: int = 4,
    embargo: int = 21,
    target: str = "y",
    rows: int | None = None,
    parallel: int = 4,
) -> DataFrame:
    """(trial, params, score, error) by the mean fold IC; a trial whose data cannot be fitted scores -1 and says why.

    Parameters that the model does not know raise before any fit. For trees the features are put into vectors once, and folds
    are ranges of the date number over that one persisted table. Every fit is distributed over the rows; ``parallel`` of them
    run at a time.
    """
    spark = matrix.sparkSession
    models = [
        (number, params, fold_model(model_class, number, features, target, params)) for number, params in enumerate(trials)
    ]
    data = matrix.dropna(subset=[target, *features])
    index = date_index(data)
    folds = block_folds(index.count(), n_blocks, embargo)
    numbered = data.join(broadcast_dates(index), "date")
    trees = all(isinstance(m, _Boosted) for _, _, m in models)
    if trees:
        numbered = prepared(numbered, list(features), target, "date", "ticker", "idx")
    numbered = numbered.persist()

    def score(number: int, params: dict[str, Any], fold: Fold) -> tuple[float | None, str | None]:
        train = numbered.where((F.col("idx") >= fold.train_from) & (F.col("idx") < fold.train_to))
        held = numbered.where((F.col("idx") >= fold.val_from) & (F.col("idx") < fold.val_to))
        try:
            model = fold_model(model_class, number, features, target, params).fit(train)
        except (ValueError, IllegalArgumentException) as failure:
            return None, str(failure).split("\n")[0]
        frame = join_realized(model.predict(held), held, target).withColumn("model_id", F.lit(number))
        return daily_ic(frame, rows=rows).agg(F.avg("ic")).first()[0], None

    try:
        tasks = [partial(score, number, params, fold) for number, params, _ in models for fold in folds]
        scores = submit_all(spark, tasks, parallel)
    finally:
        numbered.unpersist()
    rows_out = []
    for place, (number, params, _) in enumerate(models):
        mine = scores[place * len(folds) : (place + 1) * len(folds)]
        failures = [e for _, e in mine if e is not None]
        known = [s for s, _ in mine if s is not None]
        value = float(np.mean(known)) if known and not failures else -1.0
        rows_out.append((number, str(sorted(params.items())), value, failures[0] if failures else None))
    return spark.createDataFrame(rows_out, "trial int, params string, score double, error string")


def fold_model(model_class: str, number: int, features: Sequence[str], target: str, params: dict[str, Any]) -> Model:
    return build_model(model_class, ModelConfig(f"trial{number}", tuple(features), target, dict(params)))


def fold_ranges(matrix: DataFrame, n_splits: int = 3, embargo: int = 21) -> DataFrame:
    """Dates of the purged folds of a panel."""
    index = date_index(matrix)
    return fold_dates(index, chain_folds(index.count(), n_splits, embargo))


def _spans(index_size: int, folds: Sequence[Fold]) -> list[int]:
    return [e for f in folds for e in (f.train_to, f.val_from, f.val_to)] + [index_size]


def ablation(
    matrix: DataFrame,
    variants: dict[str, Sequence[str]],
    kinds: Sequence[str] = ("ols", "ridge", "lasso"),
    target: str = "y",
    train_share: float = 0.7,
    embargo: int = 21,
    rows: int | None = None,
) -> DataFrame:
    """(variant, kind, n_features, n_dates, ic): feature subsets x linear models on one split of the dates.

    One scan gives the sums of all columns; a subset takes its rows and columns from them. All
    variants are then scored in one job.
    """
    spark = matrix.sparkSession
    union = sorted({f for fs in variants.values() for f in fs})
    train = matrix.dropna(subset=[target, *union])
    index = date_index(train)
    n = index.count()
    start = int(n * train_share)
    stop = max(start - embargo, 1)
    inner = chain_folds(stop, 3, embargo)
    sums = DateGrams(train, union, target, index, [stop, start, *_spans(stop, inner)])
    coefs = []
    for variant, features in variants.items():
        pick = [union.index(f) for f in features]
        total = sums.span(0, stop).only(pick)
        for kind in kinds:
            coef = _fit_kind(kind, total, sums, pick, inner)
            full = np.zeros(len(union))
            full[pick] = coef
            coefs.append((variant, kind, len(features), [float(c) for c in full]))
    scores = score_rules(train, union, target, index, [Rule(tuple(c), start, n) for *_, c in coefs], rows)
    table = [(i, v, k, m) for i, (v, k, m, _) in enumerate(coefs)]
    named = spark.createDataFrame(table, "rule int, variant string, kind string, n_features int")
    return named.join(scores, "rule", "left").drop("rule")


def _fit_kind(kind: str, total: Gram, sums: DateGrams, pick: Sequence[int], folds: Sequence[Fold]) -> np.ndarray:
    """Coefficients of one linear kind; penalties are picked by validation error from the same sums."""
    if kind == "ols":
        return solve_ols(total)
    trials = [
        Trial(i, 0, f, sums.span(f.train_from, f.train_to).only(pick), sums.span(f.val_from, f.val_to).only(pick))
        for i, f in enumerate(folds)
    ]
    if kind == "ridge":
        grid, solve = ridge_alpha_grid(total), lambda g, p: solve_ridge(g, p["alpha"])
    elif kind == "lasso":
        grid, solve = l1_alpha_grid(total, 25), lambda g, p: solve_l1(g, p["alpha"])
    else:
        raise ValueError(f"unknown kind {kind!r}")
    choice = select_by_error(trials, {0: [{"alpha": a} for a in grid]}, solve)[0]
    return solve(total, choice.params)


def grader_comparison(
    matrix: DataFrame, features: Sequence[str], target: str = "y", test_share: float = 0.3, rows: int | None = None
) -> DataFrame:
    """(arm, alpha, n_nonzero, ic): lasso and ridge, each graded by error and by IC, on held-out dates."""
    spark = matrix.sparkSession
    data = matrix.dropna(subset=[target, *features])
    index = date_index(data)
    start = int(index.count() * (1.0 - test_share))
    numbered = data.join(broadcast_dates(index), "date")
    train, test = numbered.where(F.col("idx") < start), numbered.where(F.col("idx") >= start)
    arms, frames = [], None
    for name, cls in (("lasso", LassoCrossSectional), ("ridge", RidgeCrossSectional)):
        for grader in ("mse", "ic"):
            arm = f"{name}_{grader}"
            model = cls(ModelConfig(arm, tuple(features), target, {"grader": grader})).fit(train, rows=rows)
            arms.append((arm, model.selected_alpha(), int(sum(abs(c) > 1e-12 for c in model.state["coef"]))))
            frame = join_realized(model.predict(test), test, target).withColumn("arm", F.lit(arm))
            frames = frame if frames is None else frames.unionByName(frame)
    ic = daily_ic(frames, ["arm"], rows=rows).groupBy("arm").agg(F.avg("ic").alias("ic"))
    return spark.createDataFrame(arms, "arm string, alpha double, n_nonzero int").join(ic, "arm", "left")


def sweep_overview(sweeps: DataFrame, scores: DataFrame) -> DataFrame:
    """Sweep results next to the out-of-sample IC of the model they belong to."""
    return sweeps.join(scores.select("model_id", "information_coefficient"), "model_id", "left")
