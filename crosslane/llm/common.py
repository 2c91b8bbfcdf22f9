"""Helpers of the text operators: tables, scratch tables, shared files, words as bytes."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crosslane.session import cut, fresh_path, path_exists

# Rows and bytes that one Arrow batch hands to a Python task: texts can be long.
BATCH_ROWS = 256
BATCH_BYTES = 16 * 1024 * 1024

# Letters A-Z become a-z; bytes outside 0-9, a-z and 0x80-0xFF become blanks.
WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
# Letters A-Z become a-z; nothing else changes.
LOWER_BYTES = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound what a Python task holds of its input at once, whatever the texts' length."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def text_bytes(column: str | Column = "text") -> Column:
    """The text's UTF-8 bytes; null is empty."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column.cast("binary"), F.lit(b""))


def words_of(raw: bytes) -> list[bytes]:
    """Words of digits, ASCII letters and every character beyond ASCII, with A-Z lowered."""
    return raw.translate(WORD_BYTES).split()


def scratch(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder; the table read back and its path."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch table that this job wrote and whose readers are done."""
    if path_exists(spark, path):
        jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
        jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


def open_folder(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a shared folder (file, HDFS or an object store) and the path inside it."""
    return pafs.FileSystem.from_uri(uri)


def commit_file(files: pafs.FileSystem, path: str, parts: Iterable[bytes]) -> int:
    """Write under a name of this attempt, then move: a retried or doubled task replaces equal bytes."""
    attempt = f"{path}.{uuid.uuid4().hex}"
    size = 0
    with files.open_output_stream(attempt) as out:
        for part in parts:
            out.write(part)
            size += len(part)
    files.move(attempt, path)
    return size


def regrouped(batches: Iterator[pa.RecordBatch], size: int = 4 << 20) -> Iterator[tuple[list, list[bytes]]]:
    """(keys, texts) of two-column batches, in groups of at most about ``size`` bytes: more texts share look-ups."""
    keys, texts, held = [], [], 0
    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if held and held + len(text) > size:
                yield keys, texts
                keys, texts, held = [], [], 0
            keys.append(key)
            texts.append(text)
            held += len(text)
    if keys:
        yield keys, texts


def arrow_rows(rows: Iterator[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    """Record batches of at most ``size`` rows out of tuples."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield to_batch(held, schema)
            held = []
    if held:
        yield to_batch(held, schema)


def to_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


__all__ = [
    "BATCH_BYTES", "BATCH_ROWS", "LOWER_BYTES", "WORD_BYTES", "arrow_rows", "commit_file", "cut", "drop_path", "fresh_path",
    "open_folder", "regrouped", "scratch", "small_batches", "table", "text_bytes", "to_batch", "words_of",
]
