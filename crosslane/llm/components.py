"""Connected components of links between numbers, as aggregations and joins until nothing moves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosslane.llm.common import drop_path, scratch


def _stamp(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("node", "root").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (columns a and b) but the roots; a root is the smallest node it reaches.

    Alternates two steps: every node's larger neighbours move to its smallest one, then its smaller neighbours do. Each
    round is written to the shared folder, so a lost executor repeats one round; the one before is deleted. A node with
    many links is summed up before the shuffle, and the join back to it is split where it is skewed.
    """
    spark = links.sparkSession
    edges = links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root"))
    edges, path = scratch(edges.distinct(), "component-edges")
    stamp = None
    while stamp != (stamp := _stamp(edges)):
        turned = edges.unionByName(edges.select(F.col("root").alias("node"), F.col("node").alias("root")))
        least = turned.groupBy("node").agg(F.least(F.min("root"), F.first("node")).alias("least"))
        larger = turned.join(least, "node").where(F.col("root") > F.col("node"))
        large = larger.select(F.col("root").alias("node"), F.col("least").alias("root")).where("node != root").distinct()
        low = large.groupBy("node").agg(F.min("root").alias("least"))
        moved = large.join(low, "node").where("root != least").select(F.col("root").alias("node"), F.col("least").alias("root"))
        small = moved.unionByName(low.select("node", F.col("least").alias("root"))).distinct()
        edges, new_path = scratch(small, "component-edges")
        drop_path(spark, path)
        path = new_path
    return edges
