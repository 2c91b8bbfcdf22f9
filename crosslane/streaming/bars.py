"""Newly landed bar files extend the stored panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from crosslane.sources.bars import BAR_SCHEMA, BarStore, normalize_bars


def read_landed(spark: SparkSession, folder: str, fmt: str = "parquet", schema: T.StructType = BAR_SCHEMA) -> DataFrame:
    """A stream over a folder in which bar files arrive; files already seen are not read again."""
    reader = spark.readStream.schema(schema).format(fmt)
    return (reader.option("header", True) if fmt == "csv" else reader).load(folder)


def extend_from_stream(landed: DataFrame, store: BarStore, checkpoint: str) -> StreamingQuery:
    """Merge everything that has arrived and stop.

    The stream's checkpoint remembers the files, and the merge keeps one row per (date, ticker),
    so a batch that runs twice after a failure gives the same panel.
    """

    def merge(batch: DataFrame, _batch_id: int) -> None:
        store.extend(normalize_bars(batch))

    return (
        landed.writeStream.foreachBatch(merge)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
