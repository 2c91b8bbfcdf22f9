"""Symbol resolution: drop list, renames, punctuation; universe files."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crosslane.session import list_names

# Class-share symbols written with a dash.
PUNCTUATION = {"BRK.B": "BRK-B", "BF.B": "BF-B"}


@dataclass(frozen=True)
class SymbolRules:
    """Renames and dropped symbols are data of the user's vendor and are passed in."""

    renames: Mapping[str, str] = field(default_factory=dict)
    dropped: Iterable[str] = ()
    punctuation: Mapping[str, str] = field(default_factory=lambda: dict(PUNCTUATION))

    def all_dropped(self) -> set[str]:
        """Dropped symbols and those renamed into one."""
        gone = set(self.dropped)
        return gone | {old for old, new in self.renames.items() if new in gone}


@dataclass(frozen=True)
class SymbolTables:
    """The same rules as tables of any length: ``renames`` (old, new) and ``dropped`` (symbol)."""

    renames: DataFrame
    dropped: DataFrame
    punctuation: Mapping[str, str] = field(default_factory=lambda: dict(PUNCTUATION))


def read_rules(spark: SparkSession, renames_csv: str, dropped_txt: str) -> SymbolTables:
    """Rules from a two-column CSV (old, new) and a text file with one symbol per line."""
    renames = spark.read.csv(renames_csv, header=True).select(F.trim("old").alias("old"), F.trim("new").alias("new"))
    dropped = spark.read.text(dropped_txt).select(F.trim("value").alias("symbol")).where("symbol != ''")
    return SymbolTables(renames, dropped)


def rule_tables(spark: SparkSession, rules: SymbolRules | SymbolTables) -> SymbolTables:
    if isinstance(rules, SymbolTables):
        return rules
    renames = spark.createDataFrame(sorted(rules.renames.items()), "old string, new string")
    dropped = spark.createDataFrame([(s,) for s in sorted(rules.dropped)], "symbol string")
    return SymbolTables(renames, dropped, rules.punctuation)


def resolve(df: DataFrame, rules: SymbolRules | SymbolTables, symbol: str = "symbol", out: str = "ticker") -> DataFrame:
    """Add the canonical ticker and leave out dropped symbols and rows without a symbol.

    A dropped symbol is never followed through a rename; a rename into a dropped symbol is dropped as well. The rules are joined
    as tables, which Catalyst broadcasts while they are small; of several new names for one symbol the last in order counts.
    """
    tables = rule_tables(df.sparkSession, rules)
    dropped = tables.dropped.select(F.col("symbol").alias("_gone")).distinct()
    renames = tables.renames.groupBy(F.col("old").alias("_old")).agg(F.max("new").alias("_new"))
    kept = df.where(F.col(symbol).isNotNull()).join(dropped, F.col(symbol) == F.col("_gone"), "left_anti")
    kept = kept.join(renames, F.col(symbol) == F.col("_old"), "left").withColumn("_ticker", F.coalesce("_new", F.col(symbol)))
    kept = kept.drop("_old", "_new").join(dropped, F.col("_ticker") == F.col("_gone"), "left_anti")
    ticker = F.col("_ticker")
    for written, used in sorted(tables.punctuation.items()):
        ticker = F.when(F.col("_ticker") == written, F.lit(used)).otherwise(ticker)
    return kept.select(*[c for c in df.columns if c != out], ticker.alias(out))


def load_universe(spark: SparkSession, folder: str, name: str, rules: SymbolRules | SymbolTables | None = None) -> DataFrame:
    """Distinct sorted tickers of ``<folder>/<name>.txt``;"""
    if name not in list_universes(spark, folder):
        raise ValueError(f"unknown universe {name!r}; have {list_universes(spark, folder)}")
    lines = spark.read.text(f"{folder}/{name}.txt").select(F.trim("value").alias("symbol"))
    lines = lines.where(F.col("symbol") != "")
    return resolve(lines, rules or SymbolRules()).select("ticker").distinct().orderBy("ticker")


def list_universes(spark: SparkSession, folder: str) -> list[str]:
    return sorted(n[: -len(".txt")] for n in list_names(spark, folder) if n.endswith(".txt"))
