"""Connected components by alternating large-star and small-star, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = durable(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), F.least("u", "m").alias("m")), "cc-low")
    joined = both.where("v > u").join(low, F.col("u") == F.col("_u"))
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = durable(down.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "_u"), "cc-low")
    joined = down.join(low, F.col("u") == F.col("_u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return joined.unionByName(low.select(F.col("_u").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of a link other than the smallest of its component. Null ends are no links.

    A node with very many links is aggregated before the shuffle and joined to a written table of minima: Spark broadcasts
    that table where it is small and else splits the node's rows over tasks (the join's sides come straight from shuffles,
    which skew handling needs). The loop ends when an iteration leaves count and checksum of the edges as they were."""
    edges = durable(links.where(f"{a} <> {b}").select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "cc")
    mark = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark or not now[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        mark = now
        edges = durable(_small_star(_large_star(edges)), "cc")
