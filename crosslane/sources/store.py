"""The prediction store: an append-only Parquet table, one folder per experiment and model."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crosslane.session import list_names

STORE_SCHEMA = T.StructType(
    [
        T.StructField("generated_at", T.TimestampNTZType()),
        T.StructField("prediction_date", T.DateType()),
        T.StructField("target_date", T.DateType()),
        T.StructField("horizon_days", T.IntegerType()),
        T.StructField("ticker", T.StringType()),
        T.StructField("model_id", T.StringType()),
        T.StructField("experiment_id", T.StringType()),
        T.StructField("prediction", T.DoubleType()),
        T.StructField("pred_lower", T.DoubleType()),
        T.StructField("pred_upper", T.DoubleType()),
        T.StructField("prediction_kind", T.StringType()),
    ]
)


def to_store_rows(
    predictions: DataFrame,
    experiment_id: str,
    horizon_days: int,
    model_id: str | None = None,
    generated_at: datetime | Column | None = None,
    prediction_kind: str = "excess_return",
) -> DataFrame:
    """Predictions in the store's columns. ``target_date`` adds calendar days, as stored data does."""
    when = generated_at if isinstance(generated_at, Column) else F.lit(generated_at or datetime.now())
    when = when.cast("timestamp_ntz")
    optional = {
        name: F.col(name).cast("double") if name in predictions.columns else F.lit(None).cast("double")
        for name in ("pred_lower", "pred_upper")
    }
    return predictions.select(
        when.alias("generated_at"),
        F.col("date").alias("prediction_date"),
        F.date_add("date", horizon_days).alias("target_date"),
        F.lit(horizon_days).alias("horizon_days"),
        "ticker",
        (F.col("model_id") if model_id is None else F.lit(model_id)).alias("model_id"),
        F.lit(experiment_id).alias("experiment_id"),
        F.col("prediction").cast("double").alias("prediction"),
        optional["pred_lower"].alias("pred_lower"),
        optional["pred_upper"].alias("pred_upper"),
        F.lit(prediction_kind).alias("prediction_kind"),
    )


class PredictionStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def write(self, predictions: DataFrame, experiment_id: str, horizon_days: int, **stamp) -> int:
        """Append and return the number of rows; an empty frame changes nothing."""
        if predictions.isEmpty():
            return 0
        rows = to_store_rows(predictions, experiment_id, horizon_days, **stamp)
        seen = T.StructType([f for f in STORE_SCHEMA if f.name not in ("experiment_id", "model_id")])
        observed = rows.select(*STORE_SCHEMA.fieldNames())
        count = Observation()
        (
            observed.observe(count, F.count(F.lit(1)).alias("n"))
            .select(*seen.fieldNames(), "experiment_id", "model_id")
            .write.mode("append")
            .partitionBy("experiment_id", "model_id")
            .parquet(self.path)
        )
        return int(count.get["n"])

    def table(self) -> DataFrame:
        if not list_names(self.spark, self.path):
            return self.spark.createDataFrame([], STORE_SCHEMA)
        return self.spark.read.schema(STORE_SCHEMA).parquet(self.path).select(*STORE_SCHEMA.fieldNames())

    def query(self, sql: str) -> DataFrame:
        """Any SELECT over the view ``predictions``."""
        self.table().createOrReplaceTempView("predictions")
        return self.spark.sql(sql)

    def clear_experiment(self, experiment_id: str) -> None:
        """Drop the folder of one experiment; the rest of the table is not touched."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/experiment_id={experiment_id}")
        folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)

    def latest(self, model_ids: Sequence[str] | None = None, as_of: date | str | None = None) -> DataFrame:
        return latest_predictions(self.table(), model_ids, as_of)

    def models(self) -> DataFrame:
        return list_models(self.table())

    def health(self) -> DataFrame:
        return store_health(self.table())

    def export_csv(self, df: DataFrame, path: str) -> None:
        df.write.mode("overwrite").option("header", True).csv(path)


def latest_predictions(
    stored: DataFrame, model_ids: Sequence[str] | None = None, as_of: date | str | None = None
) -> DataFrame:
    """Rows on each model's last prediction date (<= ``as_of``).

    The last dates are one row per model, so the second read of the table is a join with a
    tiny table; a window would put a whole model into one task.
    """
    if model_ids is not None:
        stored = stored.where(F.col("model_id").isin(list(model_ids)))
    if as_of is not None:
        stored = stored.where(F.col("prediction_date") <= F.lit(str(as_of)).cast("date"))
    last = stored.groupBy("model_id").agg(F.max("prediction_date").alias("prediction_date"))
    return stored.join(last, ["model_id", "prediction_date"], "left_semi")


def list_models(stored: DataFrame) -> DataFrame:
    return stored.select("model_id").distinct().orderBy("model_id")


def store_health(stored: DataFrame) -> DataFrame:
    """Row, model and ticker counts and the last date."""
    return stored.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.countDistinct("model_id").alias("n_models"),
        F.countDistinct("ticker").alias("n_tickers"),
        F.max("prediction_date").alias("last_date"),
    )


def newest_predictions(stored: DataFrame) -> DataFrame:
    """The newest row per (model, date, ticker). ``max_by`` combines before the shuffle."""
    keys = ["model_id", "prediction_date", "ticker"]
    rest = [c for c in stored.columns if c not in keys]
    order = F.struct("generated_at", "experiment_id", "horizon_days", "prediction_kind", "prediction")
    newest = stored.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_row"))
    return newest.select(*keys, "_row.*").select(*stored.columns)


def mean_predictions(predictions: DataFrame) -> DataFrame:
    """Duplicates per (date, ticker, model) averaged."""
    return predictions.groupBy("date", "ticker", "model_id").agg(F.avg("prediction").alias("prediction"))


def common_columns_union(frames: Sequence[DataFrame]) -> DataFrame:
    """Union over the columns that every frame has, in the first frame's order."""
    shared = [c for c in frames[0].columns if all(c in f.columns for f in frames[1:])]
    out = frames[0].select(*shared)
    for frame in frames[1:]:
        out = out.unionByName(frame.select(*shared))
    return out


def align_prediction_files(
    spark: SparkSession, paths: dict[str, str], id_col: str, value_col: str
) -> DataFrame:
    """CSV files with (id, value) to one row per id and one column per file, missing as null."""
    parts = [
        spark.read.csv(path, header=True).select(
            id_col, F.lit(name).alias("_file"), F.col(value_col).try_cast("double").alias("_value")
        )
        for name, path in paths.items()
    ]
    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part)
    return both.groupBy(id_col).pivot("_file", list(paths)).agg(F.first("_value"))
