"""Daily factor returns: the text file reader and the range select."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crosslane.session import broadcast_dates
from crosslane.sources.bars import between

# Factor columns in file order; RF is the risk-free rate.
FACTORS = ("MKT_RF", "SMB", "HML", "RMW", "CMA")
FILE_COLUMNS = (*FACTORS, "RF")
HEADER_MARK = "Mkt-RF"


def parse_factor_lines(lines: DataFrame) -> DataFrame:
    """(line_no, line) of one file to daily factors in decimals.

    Text before the header is skipped; the daily block ends at the first line that does not
    start with a digit, so the annual block below it is left out.
    """
    head = lines.where(F.col("line").contains(HEADER_MARK)).agg(F.min("line_no").alias("head")).first()["head"]
    if head is None:
        raise ValueError(f"no header line with {HEADER_MARK!r} in the factor file")
    header = lines.where(F.col("line_no") == head).first()["line"]
    names = [c.strip().replace("-", "_").upper() for c in header.split(",")]
    absent = [c for c in FILE_COLUMNS if c not in names]
    if absent:
        raise ValueError(f"factor file lacks the columns {absent}")
    below = lines.where(F.col("line_no") > head)
    stop = below.where(~F.trim("line").rlike(r"^\d")).agg(F.min("line_no").alias("stop")).first()["stop"]
    if stop is not None:
        below = below.where(F.col("line_no") < stop)
    fields = F.split("line", ",")
    columns = [
        (F.trim(fields[names.index(c)]).try_cast("double") / 100.0).alias(c) for c in FILE_COLUMNS
    ]
    rows = below.select(F.try_to_timestamp(F.trim(fields[0]), F.lit("yyyyMMdd")).cast("date").alias("date"), *columns)
    rows = rows.where(F.col("date").isNotNull())
    if rows.isEmpty():
        raise ValueError("no daily rows below the factor header")
    return rows


def read_factor_file(spark: SparkSession, path: str) -> DataFrame:
    """One row per line of the file, numbered; a daily factor file is a few MB."""
    lines = (
        spark.read.text(path, wholetext=True)
        .select(F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "line"))
    )
    return parse_factor_lines(lines)


def factor_range(factors: DataFrame, start: date | str | None, end: date | str | None) -> DataFrame:
    return between(factors, start, end)


def attach_factors(panel: DataFrame, factors: DataFrame, names=FACTORS) -> DataFrame:
    """Left join by date. The factor table has one row per calendar day, which bounds the broadcast."""
    return panel.join(broadcast_dates(factors.select("date", *names)), "date", "left")


