"""Model contract and registry, baselines and the linear family.

``fit(panel)`` then ``predict(panel) -> (date, ticker, prediction[, pred_lower,
pred_upper])``. A linear fit is one aggregation over the training rows plus one
scoring job for all hyperparameters of all folds.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import asdict, dataclass, field
from typing import Any, ClassVar

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crosslane.functions.numeric import dot
from crosslane.operators.folds import Fold, chain_folds, date_index
from crosslane.operators.gram import Gram, collect_grams, gram, solve_l1, solve_ols, solve_ridge
from crosslane.operators.metrics import MIN_IC_ROWS, daily_ic
from crosslane.operators.ranking import add_average_rank, fits
from crosslane.session import broadcast_dates

# Predictions of one date that are ranked at once: few enough for a core's own cache.
RANKED_VALUES = 65_536


@dataclass(frozen=True)
class ModelConfig:
    model_id: str
    feature_cols: tuple[str, ...]
    target_col: str = "y"
    params: dict[str, Any] = field(default_factory=dict)


_MODELS: dict[str, type[Model]] = {}


def register_model(cls: type[Model]) -> type[Model]:
    """Class decorator: make the model available to ``build_model`` by its class name."""
    if cls.__name__ in _MODELS:
        raise ValueError(f"model {cls.__name__!r} is already registered")
    _MODELS[cls.__name__] = cls
    return cls


def register_alias(name: str, target: str) -> None:
    """Let specs that use another class name for the same model run unchanged."""
    _MODELS[name] = _MODELS[target]


def list_model_classes() -> list[str]:
    return sorted(_MODELS)


def build_model(name: str, config: ModelConfig) -> Model:
    if name not in _MODELS:
        raise KeyError(f"unknown model {name!r}; have {list_model_classes()}")
    return _MODELS[name](config)


class Model:
    """State is a small dict of plain values, so that saving is one JSON row."""

    defaults: ClassVar[dict[str, Any]] = {}
    # False: ``fit`` takes nothing from the rows and ``predict`` works row by row, so every refit is the same rule.
    learns: ClassVar[bool] = True

    def __init__(self, config: ModelConfig):
        self.config = config
        self.state: dict[str, Any] | None = None

    @property
    def params(self) -> dict[str, Any]:
        return {**self.defaults, **self.config.params}

    @property
    def features(self) -> list[str]:
        return list(self.config.feature_cols)

    def fit(self, panel: DataFrame) -> Model:
        raise NotImplementedError

    def predict(self, panel: DataFrame) -> DataFrame:
        raise NotImplementedError

    def feature_importance(self) -> dict[str, float]:
        return {}

    def _fitted(self) -> dict[str, Any]:
        if self.state is None:
            raise RuntimeError(f"{type(self).__name__} is not fitted")
        return self.state

    def save(self, spark: SparkSession, path: str) -> None:
        record = {"class": type(self).__name__, "config": asdict(self.config), "state": self._fitted()}
        spark.createDataFrame([(json.dumps(record),)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Model:
        record = json.loads(spark.read.text(path).first()["value"])
        config = record["config"]
        config["feature_cols"] = tuple(config["feature_cols"])
        model = build_model(record["class"], ModelConfig(**config))
        model.state = record["state"]
        return model


def _keys(panel: DataFrame) -> list[str]:
    return [c for c in ("split", "date", "ticker") if c in panel.columns]


# ---- baselines --------------------------------------------------------------


@register_model
class ZeroPredictor(Model):
    learns = False

    def fit(self, panel):
        self.state = {}
        return self

    def predict(self, panel):
        self._fitted()
        return panel.select(*_keys(panel), F.lit(0.0).alias("prediction"))


@register_model
class LastReturnPredictor(Model):
    """The last five-day return carried forward."""

    learns = False

    def fit(self, panel):
        if "return_5d" not in self.features:
            raise ValueError("LastReturnPredictor needs the feature return_5d")
        self.state = {}
        return self

    def predict(self, panel):
        self._fitted()
        return panel.select(*_keys(panel), F.col("return_5d").alias("prediction"))


@register_model
class MomentumFactor(Model):
    """sign * one feature."""

    learns = False

    def fit(self, panel):
        name, sign = self.params.get("feature_name"), self.params.get("sign", 1)
        if not name:
            raise ValueError("MomentumFactor needs feature_name")
        if name not in self.features:
            raise ValueError(f"{name!r} is not among the configured features")
        if sign not in (1, -1):
            raise ValueError("sign must be 1 or -1")
        self.state = {}
        return self

    def predict(self, panel):
        self._fitted()
        value = F.col(self.params["feature_name"]) * float(self.params.get("sign", 1))
        return panel.select(*_keys(panel), value.alias("prediction"))

    def feature_importance(self):
        return {self.params["feature_name"]: float(self.params.get("sign", 1))}


# ---- hyperparameters of the linear family ------------------------------------


def log_grid(anchor: float, low: float, high: float, count: int) -> list[float]:
    """``count`` values around an anchor (1 where there is none), evenly spaced in decades."""
    usable = anchor if np.isfinite(anchor) and anchor > 0 else 1.0
    return (usable * 10.0 ** np.linspace(low, high, int(count))).tolist()


def l1_alpha_grid(g: Gram, n_alphas: int = 100, eps: float = 1e-3, l1_ratio: float = 1.0) -> list[float]:
    """Penalties below the least one at which every coefficient is zero."""
    pull = max(abs(v) for v in g.centered()[1]) / g.n
    return log_grid(pull / max(l1_ratio, 1e-3), np.log10(eps), 0.0, n_alphas)


def ridge_alpha_grid(g: Gram, n_alphas: int = 20, lo_decade: float = -4.0, hi_decade: float = 4.0) -> list[float]:
    """Penalties around the mean variance sum of the centered features."""
    return log_grid(float(np.diag(g.centered()[0]).mean()), lo_decade, hi_decade, n_alphas)


class DateGrams:
    """Sums over date-number segments, from one scan; any span between two edges adds up."""

    def __init__(self, train: DataFrame, features: Sequence[str], target: str, index: DataFrame, edges: Sequence[int]):
        self.edges = sorted(set(edges) | {0})
        self.width = len(features)
        cuts = F.array(*[F.lit(e) for e in self.edges])
        segment = F.size(F.filter(cuts, lambda e: e <= F.col("idx"))) - 1
        # One row per calendar day.
        marked = train.join(broadcast_dates(index.select("date", segment.alias("_segment"))), "date")
        self.parts = collect_grams(gram(marked, features, target, ["_segment"]), "_segment")

    def span(self, low: int, high: int) -> Gram:
        inner = [self.parts[i] for i, e in enumerate(self.edges) if low <= e < high and i in self.parts]
        return sum(inner, Gram.zero(self.width))


@dataclass(frozen=True)
class Trial:
    """Coefficients of every candidate, fitted on the training part of one fold of one refit."""

    unit: int
    refit: int
    fold: Fold
    train: Gram
    held: Gram


Solver = Callable[[Gram, dict[str, float]], np.ndarray]


@dataclass(frozen=True)
class Rule:
    """A linear rule and the date numbers [low, high) on which it is scored."""

    coef: tuple[float, ...]
    low: int
    high: int


def _date_ics(x: np.ndarray, realized: np.ndarray, coefs: np.ndarray) -> np.ndarray:
    """IC of every rule (a row of ``coefs``) on one date; nan where one side is constant.

    Rows that a rule predicts alike share the middle of their places, so a sort and sums per run of equal predictions do
    the whole work; places are counted from their mean.
    """
    n, out = len(realized), np.full(len(coefs), np.nan)
    spread = realized.std()
    step = max(1, RANKED_VALUES // n)
    columns = np.ascontiguousarray(x.T)
    for k in range(0, len(coefs) if spread > 0 else 0, step):
        part = coefs[k : k + step]
        predicted = np.zeros((len(part), n))
        for j in range(len(columns)):
            predicted += columns[j] * part[:, j, None]
        # Only nan has an order of its own among equals.
        order = np.argsort(predicted, axis=1, kind="stable" if np.isnan(predicted).any() else None)
        ordered = np.take_along_axis(predicted, order, axis=1)
        opens = np.ones(ordered.shape, dtype=bool)
        opens[:, 1:] = ordered[:, 1:] != ordered[:, :-1]
        starts = np.flatnonzero(opens)
        sizes = np.diff(starts, append=opens.size)
        places = starts % n + (sizes - n) / 2
        lines = np.searchsorted(starts, np.arange(len(part)) * n)
        both = np.add.reduceat(np.add.reduceat(realized[order].ravel(), starts) * places, lines)
        spreads = np.sqrt(np.add.reduceat(sizes * places * places, lines) / n)
        with np.errstate(divide="ignore", invalid="ignore"):
            out[k : k + step] = np.where(spreads > 0, both / n / (spread * spreads), np.nan)
    return out


def score_rules(
    frame: DataFrame, features: Sequence[str], target: str, index: DataFrame, rules: Sequence[Rule], rows: int | None = None
) -> DataFrame:
    """(rule, ic, n_dates): mean daily IC of every rule over its dates; ``rule`` is its place in ``rules``.

    The rows are shuffled once, by date, whatever the number of rules: a date is one row of two arrays, and
    its rules are scored in one pass over them. Dates above ``crosslane.taskRows`` meet their rules by a join.
    """
    x = F.array(*[F.col(f).cast("double") for f in features])
    low, high = np.array([r.low for r in rules]), np.array([r.high for r in rules])
    coefs = np.array([r.coef for r in rules], dtype=float).reshape(len(rules), len(features))
    # Every rule sees whole dates, so the target is ranked once per date.
    base = frame.select("date", x.alias("_x"), F.col(target).alias("_y"))
    base = add_average_rank(base, ["date"], "_y", "_rank", "_n", rows=rows).drop("_y")
    base = base.join(broadcast_dates(index.select("date", "idx")), "date")
    if not fits(base, ["date"], rows):
        return _score_large_dates(base, coefs, low, high, rows)
    dates = base.where(F.col("_n") >= MIN_IC_ROWS).groupBy("idx").agg(F.collect_list(F.struct("_rank", "_x")).alias("_rows"))
    dates = dates.select("idx", F.col("_rows._rank").alias("_rank"), F.flatten("_rows._x").alias("_x"))

    def add_up(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in frames:
            total, count = np.zeros(len(coefs)), np.zeros(len(coefs), dtype=np.int64)
            for idx, ranks, flat in zip(part["idx"], part["_rank"], part["_x"], strict=True):
                mine = np.flatnonzero((low <= idx) & (idx < high))
                ics = _date_ics(np.asarray(flat).reshape(len(ranks), -1), np.asarray(ranks), coefs[mine])
                known = ~np.isnan(ics)
                total[mine[known]] += ics[known]
                count[mine[known]] += 1
            met = np.flatnonzero(count)
            yield pd.DataFrame({"rule": met.astype(np.int32), "_sum": total[met], "_dates": count[met]})

    sums = dates.mapInPandas(add_up, "rule int, _sum double, _dates long")
    return sums.groupBy("rule").agg((F.sum("_sum") / F.sum("_dates")).alias("ic"), F.sum("_dates").alias("n_dates"))


def _score_large_dates(base: DataFrame, coefs: np.ndarray, low: np.ndarray, high: np.ndarray, rows: int | None) -> DataFrame:
    """As ``score_rules`` where a date does not fit a task: rows x rules, ranked by ranges."""
    spans = zip(low.tolist(), high.tolist(), coefs.tolist(), strict=True)
    table = base.sparkSession.createDataFrame(
        [(i, a, b, c) for i, (a, b, c) in enumerate(spans)], "rule int, low int, high int, coef array<double>"
    )
    by_date = table.select("rule", "coef", F.explode(F.sequence("low", F.col("high") - 1)).alias("idx"))
    value = F.aggregate(F.zip_with("_x", "coef", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    scored = base.join(by_date, "idx").select("rule", "date", value.alias("prediction"), F.col("_rank").alias("realized"))
    ic = daily_ic(scored, ["rule"], rows=rows, realized_is_ranked=True)
    return ic.groupBy("rule").agg(F.avg("ic").alias("ic"), F.count(F.lit(1)).alias("n_dates"))


@dataclass
class Choice:
    params: dict[str, float]
    score: float | None
    table: list[tuple[dict[str, float], float | None]]


def choose(candidates: Sequence[dict[str, float]], scores: Sequence[float | None]) -> Choice:
    """The first candidate with the best score; without any score the smallest alpha."""
    table = list(zip(candidates, scores, strict=True))
    known = [(round(score, 12), -c) for c, (_, score) in enumerate(table) if score is not None]
    if not known:
        return Choice(min(candidates, key=lambda p: p.get("alpha", 0.0)), None, table)
    best = -max(known)[1]
    return Choice(*table[best], table)


def select_by_ic(
    train: DataFrame,
    features: Sequence[str],
    target: str,
    index: DataFrame,
    trials: Sequence[Trial],
    candidates: dict[int, Sequence[dict[str, float]]],
    solve: Solver,
    rows: int | None = None,
) -> dict[int, Choice]:
    """Per refit the candidate with the best mean over folds of the mean daily IC; all are scored in one job."""
    places = [(t, c) for t in trials for c in range(len(candidates[t.refit]))]
    rules = [
        Rule(tuple(map(float, solve(t.train, candidates[t.refit][c]))), t.fold.val_from, t.fold.val_to) for t, c in places
    ]
    sums: dict[tuple[int, int], list[float]] = {}
    # One row per rule; the rules are fitted here already.
    for r in score_rules(train, features, target, index, rules, rows).orderBy("rule").collect():
        t, c = places[r["rule"]]
        sums.setdefault((t.refit, c), []).append(r["ic"])
    out = {}
    for refit, options in candidates.items():
        found = [sums.get((refit, c)) for c in range(len(options))]
        out[refit] = choose(options, [float(np.mean(v)) if v else None for v in found])
    return out


def select_by_error(trials, candidates, solve: Solver) -> dict[int, Choice]:
    """Per refit the candidate with the least mean squared validation error; no further scan."""
    out = {}
    for refit, options in candidates.items():
        mine = [t for t in trials if t.refit == refit]
        scores = []
        for params in options:
            errors = []
            for t in mine:
                coef = solve(t.train, params)
                errors.append(t.held.squared_error(coef, t.train.intercept(coef)) / t.held.n)
            scores.append(-float(np.mean(errors)))
        out[refit] = choose(options, scores)
    return out


# ---- linear models ------------------------------------------------------------


class _Linear(Model):
    """Pooled linear model with intercept; nulls count 0 when predicting."""

    def _candidates(self, total: Gram) -> list[dict[str, float]]:
        return [{}]

    def _solve(self, g: Gram, params: dict[str, float]) -> np.ndarray:
        raise NotImplementedError

    def _solver(self) -> Solver:
        if self.params.get("fit_intercept", True):
            return self._solve
        return lambda g, params: self._solve(g.uncentered(), params)

    def fit_spans(
        self, panel: DataFrame, index: DataFrame, spans: Sequence[tuple[int, int]], rows: int | None = None
    ) -> list[dict[str, Any] | None]:
        """One state per training span [from, to) of date numbers, from one scan of the panel.

        With hyperparameters to choose, all folds of all spans are scored in one further job.
        """
        target, features, solve = self.config.target_col, self.features, self._solver()
        train = panel.dropna(subset=[target, *features])
        folds: dict[int, list[Fold]] = {}
        if self._needs_choice():
            for refit, (low, high) in enumerate(spans):
                inner = chain_folds(high - low, int(self.params["cv"]), int(self.params["cv_embargo"]))
                folds[refit] = [
                    Fold(f.fold, low + f.train_from, low + f.train_to, low + f.val_from, low + f.val_to) for f in inner
                ]
        edges = [e for span in spans for e in span]
        edges += [e for fs in folds.values() for f in fs for e in (f.train_to, f.val_from, f.val_to)]
        sums = DateGrams(train, features, target, index, edges)
        totals = [sums.span(low, high) for low, high in spans]
        chosen: dict[int, Choice] = {}
        if folds:
            trials, unit = [], 0
            for refit, fs in folds.items():
                for f in fs:
                    held = sums.span(f.val_from, f.val_to)
                    trials.append(Trial(unit, refit, f, sums.span(f.train_from, f.train_to), held))
                    unit += 1
            candidates = {refit: self._candidates(totals[refit]) for refit in folds}
            if self.params.get("grader", "ic") == "mse":
                chosen = select_by_error(trials, candidates, solve)
            else:
                chosen = select_by_ic(train, features, target, index, trials, candidates, solve, rows)
        states: list[dict[str, Any] | None] = []
        self.choices = chosen
        for refit, total in enumerate(totals):
            if total.n == 0:
                states.append(None)
                continue
            params = chosen[refit].params if refit in chosen else {}
            coef = solve(total, params)
            intercept = total.intercept(coef) if self.params.get("fit_intercept", True) else 0.0
            states.append({"coef": [float(c) for c in coef], "intercept": intercept, "n": int(total.n), **params})
        return states

    def fit(self, panel, rows: int | None = None):
        train = panel.dropna(subset=[self.config.target_col, *self.features])
        index = date_index(train)
        n = index.count()
        state = self.fit_spans(train, index, [(0, n)], rows)[0] if n else None
        if state is None:
            raise ValueError("no training rows after dropping nulls")
        self.state = state
        return self

    def _needs_choice(self) -> bool:
        return True

    def predict(self, panel):
        state = self._fitted()
        return panel.select(*_keys(panel), dot(self.features, state["coef"], state["intercept"]).alias("prediction"))

    def feature_importance(self):
        return dict(zip(self.features, self._fitted()["coef"], strict=True))

    def selected_alpha(self) -> float | None:
        return self._fitted().get("alpha")

    def alpha_trace(self, spark: SparkSession) -> DataFrame:
        """(alpha, l1_ratio, score, selected) of the last selection, best first."""
        state = self._fitted()
        picked = (state.get("alpha"), state.get("l1_ratio"))
        rows = [
            (p.get("alpha"), p.get("l1_ratio"), score, (p.get("alpha"), p.get("l1_ratio")) == picked)
            for p, score in self.choices[0].table
        ]
        out = spark.createDataFrame(rows, "alpha double, l1_ratio double, score double, selected boolean")
        return out.orderBy(F.desc_nulls_last("score"), "alpha")


@register_model
class OLSCrossSectional(_Linear):
    def _needs_choice(self):
        return False

    def _solve(self, g, params):
        return solve_ols(g)


@register_model
class RidgeCrossSectional(_Linear):
    defaults: ClassVar = {"alphas": 20, "cv": 3, "cv_embargo": 21, "fit_intercept": True}

    def _candidates(self, total):
        alphas = self.params["alphas"]
        grid = ridge_alpha_grid(total, alphas) if isinstance(alphas, int) else alphas
        return [{"alpha": float(a)} for a in grid]

    def _solve(self, g, params):
        return solve_ridge(g, params["alpha"])


@register_model
class LassoCrossSectional(_Linear):
    defaults: ClassVar = {"alphas": 25, "cv": 3, "cv_embargo": 21, "max_iter": 5000, "fit_intercept": True}

    def _candidates(self, total):
        alphas = self.params["alphas"]
        grid = l1_alpha_grid(total, alphas) if isinstance(alphas, int) else alphas
        return [{"alpha": float(a)} for a in grid]

    def _solve(self, g, params):
        return solve_l1(g, params["alpha"], 1.0, int(self.params["max_iter"]))


@register_model
class ElasticNetCrossSectional(_Linear):
    # The default mixing ratios and the number of alphas per ratio.
    defaults: ClassVar = {
        "l1_ratios": (0.1, 0.3, 0.5, 0.7, 0.9, 0.95, 1.0),
        "alphas": 25,
        "cv": 3,
        "cv_embargo": 21,
        "max_iter": 5000,
        "fit_intercept": True,
    }

    def _candidates(self, total):
        alphas, out = self.params["alphas"], []
        for ratio in self.params["l1_ratios"]:
            grid = l1_alpha_grid(total, alphas, l1_ratio=ratio) if isinstance(alphas, int) else alphas
            out += [{"alpha": float(a), "l1_ratio": float(ratio)} for a in grid]
        return out

    def _solve(self, g, params):
        return solve_l1(g, params["alpha"], params["l1_ratio"], int(self.params["max_iter"]))
