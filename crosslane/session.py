"""Session defaults, the shared working folder and lineage cuts."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_TASK_ROWS = 1_000_000


def build_session(master: str | None = None, app: str = "crosslane", **conf: str) -> SparkSession:
    """A session with the settings the operators expect; a cluster's own settings win."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # Call sites of every column cost more than planning does on wide matrices.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application, so that they can import it from any folder.

    The archive is staged on the driver; Spark's own file distribution carries it to the executors.
    """
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    staged = os.path.join(tempfile.mkdtemp(prefix="crosslane-code-"), "crosslane")
    spark.sparkContext.addPyFile(shutil.make_archive(staged, "zip", os.path.dirname(here), os.path.basename(here)))
    _shipped.add(app)


def task_rows(spark: SparkSession) -> int:
    """Rows one task may hold for a single window group (``crosslane.taskRows``)."""
    return int(spark.conf.get("crosslane.taskRows", str(DEFAULT_TASK_ROWS)))


_own_dirs: dict[str, str] = {}


def work_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local session without the setting gets a folder of its own; on a
    cluster a machine-local folder would be lost with its machine.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/") + "/crosslane"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="crosslane-")
    return _own_dirs[app]


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{work_dir(spark)}/{label}-{uuid.uuid4().hex}"


# Rows that a table may have to be sent to every executor without a further check.
BROADCAST_ROWS = 1_000_000


def broadcast_if(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast a table known to have ``rows`` rows if they are few, else leave the join to Catalyst."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def broadcast_dates(df: DataFrame, column: str = "date") -> DataFrame:
    """Broadcast a table with one row per day: the calendar bounds it.

    Only the date type gives that bound; with any other time type the join is left to Catalyst.
    """
    return F.broadcast(df) if dict(df.dtypes)[column] == "date" else df


def cut(df: DataFrame, label: str = "cut") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here.

    Used where several branches read one expensive or sampled result. A lost
    executor costs a re-read of files, and every branch sees the same rows.
    """
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path))


def touch(spark: SparkSession, path: str) -> None:
    """An empty file, with the folders above it."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).create(jvm_path, True).close()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder of this library; nothing happens where there is none."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none where the folder is not there."""
    if not path_exists(spark, path):
        return []
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in fs.listStatus(jvm_path)]


def source_stamp(spark: SparkSession, path: str) -> tuple[int, int]:
    """(bytes, modification time) of a file or folder, to notice changed sources."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    return (fs.getContentSummary(jvm_path).getLength(), fs.getFileStatus(jvm_path).getModificationTime())
