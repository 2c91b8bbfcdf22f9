"""Boosted trees on MLlib: three parameter families, several seeds, stopping by rounds on the last dates."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from typing import Any, ClassVar

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor, RandomForestRegressionModel, RandomForestRegressor
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crosslane.operators.folds import split_by_fraction
from crosslane.operators.models import Model, ModelConfig, _keys, register_alias, register_model
from crosslane.operators.staged import METRICS, best_round, importances, round_scores, shortened_model


def as_vectors(df: DataFrame, features: list[str], out: str = "_features") -> DataFrame:
    """Feature vector with nulls as 0."""
    filled = df.withColumns({f"_x_{f}": F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features})
    vector = VectorAssembler(inputCols=[f"_x_{f}" for f in features], outputCol=out)
    return vector.transform(filled).drop(*[f"_x_{f}" for f in features])


def prepared(df: DataFrame, features: list[str], target: str, *kept: str) -> DataFrame:
    """Complete rows with ``_features``: what any number of fits of a search or of folds can share."""
    rows = df.dropna(subset=[target, *features])
    return as_vectors(rows, features).select(*dict.fromkeys([*kept, target, "_features"]))


def submit_all(spark: SparkSession, tasks: Iterable[Callable[[], Any]], parallel: int) -> list[Any]:
    """Results in order. At most ``parallel`` fits are at work: their small jobs fill the gaps between each other's rounds."""
    with ThreadPoolExecutor(max_workers=max(1, parallel)) as pool:
        waiting = [pool.submit(inheritable_thread_target(spark)(task)) for task in tasks]
        return [w.result() for w in waiting]


class _Boosted(Model):
    """Seeds are fitted one after another, each fit distributed over the rows.

    With ``early_stopping_rounds`` and ``val_fraction`` the last dates are held out of the fit; the metric after every round is
    taken on them and the ensemble is cut after its best round. ``metric`` names a registered ``StageMetric``.
    """

    defaults: ClassVar = {
        "n_estimators": 500,
        "learning_rate": 0.05,
        "max_depth": 5,
        "min_rows_leaf": 100,
        "row_share": 0.9,
        "feature_share": 0.9,
        "seeds": (42,),
        "early_stopping_rounds": 0,
        "val_fraction": 0.0,
        "metric": "rmse",
        "weight_col": None,
        "max_bins": 32,
    }
    # Names that specs of the three families use for the same setting.
    synonyms: ClassVar[dict[str, str]] = {}

    def __init__(self, config: ModelConfig):
        super().__init__(config)
        unknown = set(self._named(config.params)) - set(self.defaults)
        if unknown:
            raise ValueError(f"{type(self).__name__} cannot honour the parameters {sorted(unknown)}")
        if self.params["metric"] not in METRICS:
            raise ValueError(f"unknown metric {self.params['metric']!r}; have {sorted(METRICS)}")
        self.boosters: list = []
        self.curves: list[tuple[int, list[float], int]] = []

    def _named(self, given: dict[str, Any]) -> dict[str, Any]:
        return {self.synonyms.get(k, k): v for k, v in given.items()}

    @property
    def params(self):
        return {**self.defaults, **self._named(self.config.params)}

    def _estimator(self, seed: int):
        p = self.params
        estimator = GBTRegressor(
            featuresCol="_features",
            labelCol=self.config.target_col,
            maxIter=int(p["n_estimators"]),
            stepSize=float(p["learning_rate"]),
            maxDepth=int(p["max_depth"]),
            minInstancesPerNode=int(p["min_rows_leaf"]),
            subsamplingRate=float(p["row_share"]),
            featureSubsetStrategy=str(float(p["feature_share"])) if float(p["feature_share"]) < 1.0 else "all",
            maxBins=int(p["max_bins"]),
            seed=int(seed),
        )
        return estimator.setWeightCol(p["weight_col"]) if p["weight_col"] else estimator

    def _vectors(self, panel: DataFrame) -> DataFrame:
        if "_features" in panel.columns:
            return panel
        weight = [self.params["weight_col"]] if self.params["weight_col"] else []
        return prepared(panel, self.features, self.config.target_col, "date", *weight)

    def fit(self, panel):
        """Fit on raw rows, or on rows of ``prepared`` that several fits share (then the caller keeps them persisted)."""
        p = self.params
        patience = int(p["early_stopping_rounds"])
        vectors = self._vectors(panel)
        shared = "_features" in panel.columns
        if not shared:
            vectors = vectors.persist()
        try:
            train, held = split_by_fraction(vectors, float(p["val_fraction"])) if patience > 0 else (vectors, None)
            self.boosters, self.curves = [], []
            for seed in p["seeds"]:
                booster = self._estimator(seed).fit(train)
                if held is not None:
                    scores = self._staged(booster, held)
                    rounds = best_round(scores, patience)
                    self.curves.append((int(seed), scores.tolist(), rounds))
                    booster = shortened_model(booster, rounds)
                self.boosters.append(booster)
        finally:
            if not shared:
                vectors.unpersist()
        self.state = {"seeds": [int(s) for s in p["seeds"]], "rounds": [b.getNumTrees for b in self.boosters]}
        return self

    def _staged(self, booster, held: DataFrame):
        return round_scores(booster, held, self.config.target_col, METRICS[self.params["metric"]], self.params["weight_col"])

    def curve(self, spark: SparkSession) -> DataFrame:
        """(seed, round, score, kept) on the held-out dates."""
        rows = [
            (seed, n, float(score), n <= rounds) for seed, scores, rounds in self.curves for n, score in enumerate(scores, start=1)
        ]
        return spark.createDataFrame(rows, "seed int, round int, score double, kept boolean")

    def predict(self, panel):
        self._fitted()
        out = panel if "_features" in panel.columns else as_vectors(panel, self.features)
        names = []
        for i, booster in enumerate(self.boosters):
            names.append(f"_p{i}")
            out = booster.setPredictionCol(names[-1]).transform(out)
        total = sum((F.col(n) for n in names[1:]), F.col(names[0]))
        return out.select(*_keys(panel), (total / float(len(names))).alias("prediction"))

    def feature_importance(self):
        self._fitted()
        shares = [importances(b, len(self.features)) for b in self.boosters]
        return {f: float(sum(s[i] for s in shares) / len(shares)) for i, f in enumerate(self.features)}

    def save(self, spark: SparkSession, path: str) -> None:
        super().save(spark, f"{path}/model")
        for i, booster in enumerate(self.boosters):
            booster.write().overwrite().save(f"{path}/seed{i}")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Model:
        model = Model.load(spark, f"{path}/model")
        model.boosters = [model.reader.load(f"{path}/seed{i}") for i in range(len(model.state["seeds"]))]
        return model

    reader = GBTRegressionModel


@register_model
class LeafwiseBoosting(_Boosted):
    """Family A: up to 31 leaves, so depth 5. ``num_leaves`` gives the depth that can hold so many."""

    synonyms: ClassVar = {
        "min_data_in_leaf": "min_rows_leaf",
        "feature_fraction": "feature_share",
        "bagging_fraction": "row_share",
    }

    def _named(self, given):
        named = super()._named(given)
        if "num_leaves" in named:
            named["max_depth"] = math.ceil(math.log2(max(2, int(named.pop("num_leaves")))))
        return named


@register_model
class DepthwiseBoosting(_Boosted):
    """Family B: depth 6 with column and row sampling."""

    defaults: ClassVar = {
        **_Boosted.defaults,
        "max_depth": 6,
        "min_rows_leaf": 20,
        "row_share": 0.8,
        "feature_share": 0.8,
    }
    synonyms: ClassVar = {
        "min_child_weight": "min_rows_leaf",
        "subsample": "row_share",
        "colsample_bytree": "feature_share",
    }


@register_model
class SymmetricBoosting(_Boosted):
    """Family C: a different preset, for predictions that differ from the other two."""

    defaults: ClassVar = {
        **_Boosted.defaults,
        "max_depth": 6,
        "min_rows_leaf": 50,
        "row_share": 0.8,
        "feature_share": 0.8,
        "learning_rate": 0.03,
    }
    synonyms: ClassVar = {"depth": "max_depth", "subsample": "row_share", "rsm": "feature_share"}


@register_model
class ForestCrossSectional(_Boosted):
    """Random forest variant for diversity."""

    defaults: ClassVar = {**_Boosted.defaults, "n_estimators": 30, "row_share": 0.7, "feature_share": 0.5}
    reader = RandomForestRegressionModel

    def __init__(self, config):
        super().__init__(config)
        if int(self.params["early_stopping_rounds"]) > 0:
            raise ValueError("a forest has no rounds to stop after")

    def _estimator(self, seed):
        p = self.params
        return RandomForestRegressor(
            featuresCol="_features",
            labelCol=self.config.target_col,
            numTrees=int(p["n_estimators"]),
            maxDepth=int(p["max_depth"]),
            minInstancesPerNode=int(p["min_rows_leaf"]),
            subsamplingRate=float(p["row_share"]),
            featureSubsetStrategy=str(float(p["feature_share"])),
            seed=int(seed),
        )


# Names that experiment specs use for the three families.
register_alias("LightGBMModel", "LeafwiseBoosting")
register_alias("XGBoostModel", "DepthwiseBoosting")
register_alias("CatBoostModel", "SymmetricBoosting")


def importance_table(spark: SparkSession, models: dict[str, Model]) -> DataFrame:
    """(model_id, feature, importance) of fitted models."""
    rows = [(m, f, v) for m, model in models.items() for f, v in model.feature_importance().items()]
    return spark.createDataFrame(rows, "model_id string, feature string, importance double")
