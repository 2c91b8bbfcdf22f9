"""Walk-forward runs and experiment specs."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from datetime import date
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Importing the families registers their models.
from crosslane.operators import series_models, trees  # noqa: F401
from crosslane.operators.features import build_feature_matrix, drop_warmup_rows
from crosslane.operators.folds import Split, date_index, slice_test, slice_train, splits_table, walk_forward_splits
from crosslane.operators.metrics import compare_models, join_realized
from crosslane.operators.models import Model, ModelConfig, _Linear, build_model
from crosslane.operators.prefix_fits import with_segments
from crosslane.operators.series_models import _Expanding
from crosslane.session import broadcast_dates, broadcast_if, cut
from crosslane.sources.bars import attach_sector, between
from crosslane.sources.membership import filter_to_members
from crosslane.sources.store import PredictionStore, common_columns_union


def day(value: Any) -> date | None:
    """A date from a date or its ISO text; anything empty is None."""
    if not value:
        return None
    return value if isinstance(value, date) else date.fromisoformat(str(value))


def load_panel(
    bars: DataFrame,
    universe: DataFrame | None = None,
    start: Any = None,
    end: Any = None,
    membership: DataFrame | None = None,
    sectors: DataFrame | None = None,
) -> DataFrame:
    """Bars of the universe and dates, then the membership filter, then the sector.

    The membership filter comes before any feature, so row lags step over a removed span.
    """
    out = between(bars, start, end)
    if universe is not None:
        out = out.join(universe.select("ticker").distinct(), "ticker", "left_semi")
    if membership is not None:
        out = filter_to_members(out, membership)
    return out if sectors is None else attach_sector(out, sectors)


@dataclass
class WalkForward:
    predictions: DataFrame
    coefficients: DataFrame | None
    splits: list[Split]


def _plan(matrix: DataFrame, options: dict[str, Any], horizon: int) -> list[Split]:
    embargo = int(options.get("embargo_days", 6))
    if embargo < horizon:
        raise ValueError(f"embargo_days ({embargo}) must be at least the horizon ({horizon})")
    first, last = matrix.agg(F.min("date"), F.max("date")).first()
    if first is None:
        raise ValueError("the panel has no dates")
    return walk_forward_splits(
        day(options.get("start")) or first,
        day(options.get("end")) or last,
        int(options.get("refit_freq_days", 21)),
        embargo,
        int(options.get("min_train_days", 504)),
        day(options.get("first_refit")),
    )


def linear_walk_forward(
    matrix: DataFrame, model: _Linear, splits: Sequence[Split], train_start: date | None, rows: int | None
) -> WalkForward:
    """All refits from one scan: sums per date segment add up to every training span.

    The test rows meet their refit's coefficients through an equality join on the date: a date
    is in the test span of one refit, so that table has one row per calendar day.
    """
    spark, features = matrix.sparkSession, model.features
    train = matrix.dropna(subset=[model.config.target_col, *features])
    index = date_index(train)
    days = [(r["date"], r["idx"]) for r in index.orderBy("idx").collect()]

    def place(limit: date, inclusive: bool) -> int:
        return sum(1 for d, _ in days if d < limit or (inclusive and d == limit))

    low = place(train_start, False) if train_start else 0
    spans = [(low, place(s.train_end, True)) for s in splits]
    usable = [i for i, (a, b) in enumerate(spans) if b > a]
    states = model.fit_spans(train, index, [spans[i] for i in usable], rows)
    fitted = [(i, splits[i], s) for i, s in zip(usable, states, strict=True) if s is not None]
    if not fitted:
        raise ValueError("no split has training rows")
    model.state = fitted[-1][2]
    coefs = spark.createDataFrame(
        [(i, s["coef"], s["intercept"]) for i, _, s in fitted], "split int, coef array<double>, intercept double"
    )
    test_days = splits_table(spark, [s for _, s, _ in fitted]).select(
        "split", F.explode(F.sequence("test_start", "test_end")).alias("date")
    )
    numbers = {n: i for n, (i, _, _) in enumerate(fitted)}
    relabel = F.create_map(*[F.lit(x) for kv in numbers.items() for x in kv])
    schedule = test_days.withColumn("split", relabel[F.col("split")])
    value = F.aggregate(
        F.zip_with(F.array(*[F.col(f) for f in features]), "coef", lambda a, b: a * b),
        F.col("intercept"),
        lambda total, term: total + term,
    )
    predictions = (
        matrix.dropna(subset=features)
        .select("date", "ticker", *features)
        .join(broadcast_dates(schedule), "date")
        .join(broadcast_if(coefs, len(fitted)), "split")
        .select("date", "ticker", value.alias("prediction"), "split")
    )
    table = spark.createDataFrame(
        [
            (i, split.refit_date, f, c, s["intercept"], s.get("alpha"), s.get("l1_ratio"))
            for i, split, s in fitted
            for f, c in zip(features, s["coef"], strict=True)
        ],
        "split int, refit_date date, feature string, coef double, intercept double, alpha double, l1_ratio double",
    )
    return WalkForward(predictions, table, list(splits))


def prefix_walk_forward(
    matrix: DataFrame, model: _Expanding, splits: Sequence[Split], train_start: date | None
) -> WalkForward:
    """All refits of a per-ticker model from one table of running sums per ticker and training span.

    The test rows meet the fits of their split: a date is in the test span of one split.
    """
    train = matrix.dropna(subset=[model.config.target_col, *model.features])
    if train_start is not None:
        train = train.where(F.col("date") >= F.lit(train_start))
    first = train.agg(F.min("date")).first()[0]
    if first is None or not splits or splits[-1].train_end < first:
        raise ValueError("no split has training rows")
    rows = with_segments(model.observations(train), [s.train_end for s in splits], first)
    model.fit_prefixes(rows, len(splits))
    test_days = splits_table(matrix.sparkSession, splits).select(
        "split", F.explode(F.sequence("test_start", "test_end")).alias("date")
    )
    test = matrix.dropna(subset=model.features).drop("split").join(broadcast_dates(test_days), "date")
    predictions = cut(model.predict(test), "splits")
    model.keep_split(len(splits) - 1)
    return WalkForward(predictions, None, list(splits))


def fixed_walk_forward(
    matrix: DataFrame, model: Model, splits: Sequence[Split], train_start: date | None
) -> WalkForward:
    """All refits of a model that learns nothing from rows, in one pass: each test row meets the split of its date.

    As with separate fits, a split that has no training rows has no predictions.
    """
    train = matrix.dropna(subset=[model.config.target_col, *model.features])
    if train_start is not None:
        train = train.where(F.col("date") >= F.lit(train_start))
    first = train.agg(F.min("date")).first()[0]
    usable = [(i, s) for i, s in enumerate(splits) if first is not None and s.train_end >= first]
    if not usable:
        raise ValueError("no split has training rows")
    model.fit(train)
    numbers = F.create_map(*[F.lit(x) for n, (i, _) in enumerate(usable) for x in (n, i)])
    test_days = splits_table(matrix.sparkSession, [s for _, s in usable]).select(
        numbers[F.col("split")].alias("split"), F.explode(F.sequence("test_start", "test_end")).alias("date")
    )
    # One row per calendar day.
    test = matrix.dropna(subset=model.features).drop("split").join(broadcast_dates(test_days), "date")
    return WalkForward(model.predict(test).select("date", "ticker", "prediction", "split"), None, list(splits))


def run_walk_forward(
    matrix: DataFrame,
    model: Model,
    horizon: int,
    options: dict[str, Any] | None = None,
    store: PredictionStore | None = None,
    experiment_id: str = "experiment",
    rows: int | None = None,
) -> WalkForward:
    """Out-of-sample predictions of every refit; stored with the refit date as their time."""
    options = options or {}
    splits = _plan(matrix, options, horizon)
    train_start = day(options.get("train_start"))
    if isinstance(model, _Linear):
        run = linear_walk_forward(matrix, model, splits, train_start, rows)
    elif isinstance(model, _Expanding):
        run = prefix_walk_forward(matrix, model, splits, train_start)
    elif not model.learns:
        run = fixed_walk_forward(matrix, model, splits, train_start)
    else:
        parts = []
        for i, split in enumerate(splits):
            train = slice_train(matrix, split, train_start).dropna(subset=[model.config.target_col, *model.features])
            if train.isEmpty():
                continue
            model.fit(train)
            test = slice_test(matrix, split).dropna(subset=model.features)
            # A model object is refitted for the next split, so its predictions are written now.
            parts.append(cut(model.predict(test).withColumn("split", F.lit(i)), "split"))
        if not parts:
            raise ValueError("no split has training rows")
        run = WalkForward(common_columns_union(parts), None, splits)
    if store is not None:
        write_splits(store, run, model.config.model_id, experiment_id, horizon)
    return run


def write_splits(store: PredictionStore, run: WalkForward, model_id: str, experiment_id: str, horizon: int) -> int:
    """All splits in one write; ``generated_at`` is the refit date of the row's split."""
    if run.predictions.isEmpty():
        return 0
    refit = splits_table(run.predictions.sparkSession, run.splits).select("split", "refit_date")
    rows = run.predictions.join(broadcast_if(refit, len(run.splits)), "split")
    return store.write(rows, experiment_id, horizon, model_id=model_id, generated_at=F.col("refit_date"))


@dataclass
class Experiment:
    """One experiment: what to read, which features, how to split, which models."""

    experiment_id: str
    features: list[str]
    models: list[dict[str, Any]]
    target_horizon: int = 5
    normalize_kind: str = "zscore"
    walk_forward: dict[str, Any] = field(default_factory=dict)
    data: dict[str, Any] = field(default_factory=dict)

    @classmethod
    def from_dict(cls, spec: dict[str, Any]) -> Experiment:
        known = {k: spec[k] for k in cls.__dataclass_fields__ if k in spec}
        return cls(**known)


@dataclass
class ExperimentResult:
    matrix: DataFrame
    predictions: DataFrame
    summary: DataFrame
    runs: dict[str, WalkForward]


def run_experiment(
    spark: SparkSession,
    spec: Experiment | dict[str, Any],
    panel: DataFrame,
    factors: DataFrame | None = None,
    store: PredictionStore | None = None,
    rows: int | None = None,
    on_model: Callable[[str], None] | None = None,
) -> ExperimentResult:
    """Matrix once for all models (written to the shared folder), then each model's walk-forward, then one comparison.

    A model may name its own ``features``, a subset of the experiment's.
    """
    spec = spec if isinstance(spec, Experiment) else Experiment.from_dict(spec)
    matrix = build_feature_matrix(
        panel, spec.features, spec.normalize_kind, spec.target_horizon, factors=factors, rows=rows
    )
    matrix = cut(drop_warmup_rows(matrix, spec.features), "matrix")
    runs: dict[str, WalkForward] = {}
    parts = []
    for entry in spec.models:
        features = entry.get("features", spec.features)
        model = build_model(entry["class"], ModelConfig(entry["id"], tuple(features), "y", entry.get("params", {})))
        if entry["class"] == "FamaFrenchFactorModel":
            model._factors = factors
        if on_model is not None:
            on_model(entry["id"])
        run = run_walk_forward(
            matrix, model, spec.target_horizon, spec.walk_forward, store, spec.experiment_id, rows
        )
        runs[entry["id"]] = run
        parts.append(run.predictions.select("date", "ticker", "prediction").withColumn("model_id", F.lit(entry["id"])))
    predictions = common_columns_union(parts)
    # Three branches of the comparison read the joined rows.
    frame = cut(join_realized(predictions, matrix), "frame")
    return ExperimentResult(matrix, frame, compare_models(frame, horizon=spec.target_horizon, rows=rows), runs)
