"""Daily bars: normalizing vendor columns, the stored panel, log returns, sectors."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crosslane.session import cut, list_names, path_exists, remove, touch

BAR_SCHEMA = T.StructType(
    [
        T.StructField("date", T.DateType()),
        T.StructField("ticker", T.StringType()),
        T.StructField("open", T.DoubleType()),
        T.StructField("high", T.DoubleType()),
        T.StructField("low", T.DoubleType()),
        T.StructField("close", T.DoubleType()),
        T.StructField("adj_close", T.DoubleType()),
        T.StructField("volume", T.LongType()),
    ]
)
_REQUIRED = ("date", "open", "high", "low", "close", "volume")


def _plain_name(name: str) -> str:
    """Vendor header to canonical name; the ticker level of a two-level header is dropped."""
    levels = re.findall(r"'([^']*)'", name) if name.startswith("(") else [name]
    text = levels[0].strip().lower()
    if text == "datetime":
        return "date"
    return "adj_close" if text in ("adj close", "adj_close", "adjclose") else text


def normalize_bars(raw: DataFrame, ticker: str | Column | None = None) -> DataFrame:
    """Vendor rows to ``BAR_SCHEMA``; rows without a close are dropped."""
    found: dict[str, str] = {}
    for name in raw.columns:
        found.setdefault(_plain_name(name), name)
    missing = [name for name in _REQUIRED if name not in found]
    if missing:
        raise ValueError(f"bars lack the columns {missing}; found {raw.columns}")
    if ticker is None and "ticker" not in found:
        raise ValueError("bars lack a ticker column and no ticker was given")

    def source(name: str) -> Column:
        return F.col(f"`{found[name]}`")

    label = source("ticker") if ticker is None else F.lit(ticker) if isinstance(ticker, str) else ticker
    adjusted = source("adj_close") if "adj_close" in found else source("close")
    values = {"date": source("date"), "ticker": label, "adj_close": adjusted}
    values |= {name: source(name) for name in ("open", "high", "low", "close", "volume")}
    typed = []
    for field in BAR_SCHEMA:
        column = values[field.name]
        if field.name == "volume":
            column = column.try_cast("double")
        typed.append(column.try_cast(field.dataType).alias(field.name))
    return raw.select(*typed).withColumn("adj_close", F.coalesce("adj_close", "close")).where(F.col("close").isNotNull())


def one_per_key(bars: DataFrame) -> DataFrame:
    """One row per (date, ticker): of several, the largest by close, adjusted close and volume."""
    row = F.max_by(F.struct(*[f.name for f in BAR_SCHEMA]), F.struct("close", "adj_close", "volume"))
    return bars.groupBy("date", "ticker").agg(row.alias("_row")).select("_row.*")


def last_dates(stored: DataFrame) -> DataFrame:
    """(ticker, last_date): one row per ticker."""
    return stored.groupBy("ticker").agg(F.max("date").alias("last_date"))


def fresh_rows(landed: DataFrame, marks: DataFrame) -> DataFrame:
    """Landed rows from each ticker's last stored date on, one per (date, ticker)."""
    known = landed.join(marks, "ticker", "left")
    return one_per_key(known.where(F.col("last_date").isNull() | (F.col("date") >= F.col("last_date"))).drop("last_date"))


def replace_rows(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """``fresh`` rows and the stored rows of all other keys.

    The anti join leaves the stored side where it is when the fresh keys are small enough for
    Catalyst to broadcast.
    """
    kept = stored.join(fresh.select("date", "ticker"), ["date", "ticker"], "left_anti")
    return kept.select(*[f.name for f in BAR_SCHEMA]).unionByName(fresh)


def merge_bars(stored: DataFrame, landed: DataFrame, tickers: Sequence[str] | None = None) -> DataFrame:
    """Stored rows plus landed rows from each ticker's last stored date on; a landed row replaces the stored one."""
    if tickers is not None:
        wanted = F.col("ticker").isin(list(tickers))
        stored, landed = stored.where(wanted), landed.where(wanted)
    return replace_rows(stored, fresh_rows(landed, last_dates(stored)))


def between(df: DataFrame, start: date | str | None, end: date | str | None) -> DataFrame:
    """Rows dated from ``start`` to ``end``, both inclusive."""
    if start is not None:
        df = df.where(F.col("date") >= F.lit(str(start)).cast("date"))
    if end is not None:
        df = df.where(F.col("date") <= F.lit(str(end)).cast("date"))
    return df


class BarStore:
    """The panel as a Parquet table partitioned by the year of its dates.

    An extension overwrites only the years that it touches (dynamic partition overwrite). Files follow the size of
    the data: Spark rebalances each year's rows before they are written. The last date of each ticker is a small side table
    that every extension brings up to date, so an extension reads that table and the years it touches. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def read(self, start: date | str | None = None, end: date | str | None = None) -> DataFrame:
        low = int(str(start)[:4]) if start is not None else 0
        high = int(str(end)[:4]) if end is not None else 9999
        return between(self._years(F.col("year").between(low, high)), start, end)

    def _years(self, wanted: Column) -> DataFrame:
        names = [f.name for f in BAR_SCHEMA]
        if not path_exists(self.spark, self.path):
            return self.spark.createDataFrame([], BAR_SCHEMA)
        table = self.spark.read.schema(T.StructType([*BAR_SCHEMA, T.StructField("year", T.IntegerType())]))
        return table.parquet(self.path).where(wanted).select(*names)

    def last_dates(self) -> DataFrame:
        """(ticker, last_date) from the side table; from the whole table only where that is missing or not up to date."""
        kept = [n for n in list_names(self.spark, self._side) if n.startswith("v")]
        if len(kept) == 1 and not path_exists(self.spark, self._open):
            return self.spark.read.schema("ticker string, last_date date").parquet(f"{self._side}/{kept[0]}")
        return last_dates(self.read())

    @property
    def _side(self) -> str:
        # Spark does not read folders with a leading underscore as data.
        return f"{self.path}/_last"

    @property
    def _open(self) -> str:
        return f"{self._side}/changing"

    def _replace(self, rows: DataFrame, years: str, last: Callable[[], DataFrame]) -> None:
        """Write rows, then the last dates that belong to them. A mark stands while the two can differ, so that a writer that
        died in between leaves a table whose last dates are taken from the data again."""
        touch(self.spark, self._open)
        self._put(rows, years)
        older = [n for n in list_names(self.spark, self._side) if n.startswith("v")]
        last().select("ticker", "last_date").write.parquet(f"{self._side}/v{uuid.uuid4().hex}")
        for name in older:
            remove(self.spark, f"{self._side}/{name}")
        remove(self.spark, self._open)

    def _put(self, rows: DataFrame, years: str) -> None:
        dated = rows.withColumn("year", F.year("date")).hint("rebalance", F.col("year"))
        dated.write.option("partitionOverwriteMode", years).mode("overwrite").partitionBy("year").parquet(self.path)

    def write(self, panel: DataFrame) -> None:
        """Replace the table. Rows without a date or ticker are left out; a key that occurs twice raises."""
        rows = keyed(panel.select(*[f.name for f in BAR_SCHEMA]))
        if not rows.groupBy("date", "ticker").count().where("count > 1").isEmpty():
            raise ValueError("a (date, ticker) occurs more than once")
        self._replace(rows, "static", lambda: last_dates(self.read()))

    def extend(self, landed: DataFrame) -> None:
        """Merge landed bars; only the years they fall into are written again."""
        rows = keyed(landed.select(*[f.name for f in BAR_SCHEMA]))
        last = self.last_dates()
        fresh = cut(fresh_rows(rows, last), "fresh")
        years = [r[0] for r in fresh.select(F.year("date")).distinct().collect()]
        if years:
            newest = last.unionByName(last_dates(fresh)).groupBy("ticker").agg(F.max("last_date").alias("last_date"))
            # The years are read and then overwritten, so their new rows are written aside first; so are the last dates.
            merged = cut(replace_rows(self._years(F.col("year").isin(years)), fresh), "years")
            newest = cut(newest, "last")
            self._replace(merged, "dynamic", lambda: newest)


def keyed(rows: DataFrame) -> DataFrame:
    """Rows that have both parts of the panel's key."""
    return rows.where(F.col("date").isNotNull() & F.col("ticker").isNotNull())


def log_return(price: str = "adj_close", steps: int = 1) -> Column:
    by_ticker = Window.partitionBy("ticker").orderBy("date")
    return F.log(price) - F.lag(F.log(price), steps).over(by_ticker)


def add_log_return(panel: DataFrame, price: str = "adj_close", out: str = "log_return") -> DataFrame:
    """Daily log return; a ticker has one row per date, so its window is bounded by the calendar."""
    return panel.withColumn(out, log_return(price))


def attach_sector(panel: DataFrame, sectors: DataFrame) -> DataFrame:
    """Add ``sector`` from a (ticker, sector) table; tickers without one get 'Unknown'."""
    if "sector" in panel.columns:
        return panel
    return panel.join(sectors.select("ticker", "sector"), "ticker", "left").withColumn(
        "sector", F.coalesce("sector", F.lit("Unknown"))
    )


def read_bar_files(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Landed vendor files; a CSV is read by its header with every column as text."""
    reader = spark.read.option("header", True) if fmt == "csv" else spark.read
    return reader.format(fmt).load(path)
