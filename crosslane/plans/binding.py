"""The test tables as inputs of the operators.

ticker = p_brand, date = ship date, price = extended price / quantity. Panel,
factors, scored predictions and the weighted table are all derived by Spark from
the given Parquet files, so their size follows the files.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crosslane.operators.features import add_features, add_forward_excess_return
from crosslane.session import cut, source_stamp
from crosslane.sources.bars import attach_sector
from crosslane.sources.factors import FACTORS

# Order priorities in the order of the factors.
_PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
MODELS = ("mom60", "range1", "ret5", "vol20")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


_built: dict[tuple, DataFrame] = {}


def once(name: str, sources: tuple[str, ...], build: Callable[[SparkSession, str], DataFrame]):
    """Build a derived table once per session and source state, in the shared folder."""

    def get(spark: SparkSession, sf: str) -> DataFrame:
        stamps = tuple(source_stamp(spark, f"{sf}/{s}.parquet") for s in sources)
        key = (spark.sparkContext.applicationId, name, sf, stamps)
        if key not in _built:
            _built[key] = cut(build(spark, sf), name)
        return _built[key]

    return get


def build_bars(spark: SparkSession, sf: str, by_supplier: bool = False) -> DataFrame:
    """Daily bars per brand, or per supplier for a wide universe.

    All aggregates combine before the shuffle, so a hot brand or date is no hot task; the join with
    the parts is left to Catalyst (broadcast by size, else skew-aware).
    """
    price = F.col("l_extendedprice") / F.col("l_quantity")
    # (order, line, price to 1e-6) in one wide decimal: a fixed-width buffer keeps this a hash
    # aggregate, where a struct would make it sort every input row.
    line = (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("decimal(20,0)")
    place = line * F.lit(Decimal(10**15)) + F.floor(price * 1e6).cast("decimal(15,0)")
    lines = table(spark, sf, "lineitem").select(
        "l_partkey",
        F.to_date("l_shipdate").alias("date"),
        price.alias("price"),
        "l_quantity",
        "l_discount",
        place.cast("decimal(38,0)").alias("place"),
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("supplier"),
    )
    if by_supplier:
        named = lines.withColumnRenamed("supplier", "ticker")
    else:
        brands = table(spark, sf, "part").select(
            F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("ticker")
        )
        named = lines.join(brands, "l_partkey")
    return (
        named.groupBy("date", "ticker")
        .agg(
            F.min_by("price", "place").alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", "place").alias("close"),
            F.avg("l_discount").alias("_discount"),
            F.sum("l_quantity").cast("long").alias("volume"),
        )
        .withColumn("adj_close", F.col("close") * (1 - F.col("_discount")))
        .select("date", "ticker", "open", "high", "low", "close", "adj_close", "volume")
    )


bars = once("bars", ("lineitem", "part"), build_bars)


supplier_bars = once("supplier_bars", ("lineitem",), lambda spark, sf: build_bars(spark, sf, by_supplier=True))


def names_bound(spark: SparkSession, sf: str) -> int:
    """Tickers: a bound on the rows of one date, since (date, ticker) is unique."""
    return table(spark, sf, "part").select("p_brand").distinct().count()


def sectors(spark: SparkSession, sf: str) -> DataFrame:
    """Sector of every brand whose number is not a multiple of 7."""
    number = F.substring("p_brand", 7, 10).cast("int")
    brands = table(spark, sf, "part").select("p_brand", number.alias("n")).distinct()
    return brands.where(F.col("n") % 7 != 0).select(
        F.col("p_brand").alias("ticker"), F.concat(F.lit("S"), (F.col("n") % 4).cast("string")).alias("sector")
    )


def panel(spark: SparkSession, sf: str) -> DataFrame:
    """Bars with sector."""
    return attach_sector(bars(spark, sf), sectors(spark, sf))


def membership(spark: SparkSession, sf: str) -> DataFrame:
    """(ticker, added, removed): first date on; brands with a multiple of 5 leave after 60% of their span."""
    span = bars(spark, sf).groupBy("ticker").agg(F.min("date").alias("added"), F.max("date").alias("_last"))
    days = F.floor(F.datediff("_last", "added") * 6 / 10).cast("int")
    leaves = F.substring("ticker", 7, 10).cast("int") % 5 == 0
    return span.select("ticker", "added", F.when(leaves, F.date_add("added", days)).alias("removed"))


def build_factors(spark: SparkSession, sf: str) -> DataFrame:
    """Per order date: mean price by priority less the mean of the date, scaled to return size."""
    orders = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("date"), "o_orderpriority", "o_totalprice")
    mean = F.avg("o_totalprice")
    columns = [
        (
            (F.coalesce(F.avg(F.when(F.col("o_orderpriority") == p, F.col("o_totalprice"))), mean) - mean) / F.lit(1e7)
        ).alias(f)
        for f, p in zip(FACTORS, _PRIORITIES, strict=True)
    ]
    return orders.groupBy("date").agg(*columns).withColumn("RF", F.lit(0.0001))


factors = once("factors", ("orders",), build_factors)


def build_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """Four raw features and the five-row forward excess return."""
    rows = names_bound(spark, sf)
    names = ["return_5d", "momentum_60", "vol_20", "range_ratio"]
    return add_forward_excess_return(add_features(bars(spark, sf), names, rows=rows), 5, rows=rows).select(
        "date", "ticker", "adj_close", *names, "y"
    )


matrix = once("matrix", ("lineitem", "part"), build_matrix)


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """(model_id, date, ticker, prediction): signed features as models."""
    signed = matrix(spark, sf).select(
        "date",
        "ticker",
        F.col("momentum_60").alias("mom60"),
        F.col("range_ratio").alias("range1"),
        (-F.col("return_5d")).alias("ret5"),
        (-F.col("vol_20")).alias("vol20"),
    )
    return signed.unpivot(["date", "ticker"], list(MODELS), "model_id", "prediction").where(
        F.col("prediction").isNotNull()
    )


def build_evaluation(spark: SparkSession, sf: str) -> DataFrame:
    realized = matrix(spark, sf).select("date", "ticker", F.col("y").alias("realized"))
    return predictions(spark, sf).join(realized, ["date", "ticker"], "left")


evaluation = once("evaluation", ("lineitem", "part"), build_evaluation)


def build_tabular(spark: SparkSession, sf: str) -> DataFrame:
    """The event table as a weighted multi-horizon table; ``feature_b`` has gaps."""
    events = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("double")
    hours = F.expr("timestampdiff(HOUR, TIMESTAMP_NTZ '2024-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))").cast("int")
    horizon = F.element_at(F.array(F.lit(1), F.lit(3), F.lit(10), F.lit(25)), (F.col("user_id") % 4 + 1).cast("int"))
    return events.select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("code"),
        F.col("event_type").alias("sub_code"),
        F.concat(F.lit("c"), F.length("event_type").cast("string")).alias("sub_category"),
        horizon.alias("horizon"),
        hours.alias("ts_index"),
        F.col("value").alias("feature_a"),
        F.when(k % 10 != 0, k).alias("feature_b"),
        (F.col("value") * (F.col("event_id") % 7 + 1)).alias("feature_c"),
        (F.lit(1.0) + F.col("value") * F.col("value") / 100.0).alias("weight"),
        ((F.col("value") - 20.0) / 10.0 + (F.col("event_id") % 11 - 5) / 5.0).alias("y_target"),
    )


tabular = once("tabular", ("events",), build_tabular)

KEY_COLUMNS = ("code", "sub_code")
KEY_ORDER = ("ts_index", "id")
