"""Connected components of a graph given by its links, by alternating star contraction.

Each round every node passes its larger neighbours (large star), then its smaller ones (small
star), to the smallest node it knows. Rounds needed grow with the logarithm of the longest path;
each is a few aggregations with map-side combining and joins that can be split where skewed.
Links never reach the driver: only their number and a checksum do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import cut, discard

ROUNDS = 100


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component for every node of a link: the smallest node it can reach.

    Null ends and links of a node with itself are ignored; repeated links don't matter.
    """
    x, y = F.col(a), F.col(b)
    edges = cut(links.where(x != y).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct())
    seen = None
    for _ in range(ROUNDS):
        new = cut(small_star(large_star(edges)))
        mark = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(edges)
        edges = new
        if mark == seen:
            roots = edges.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
        seen = mark
    raise RuntimeError(f"no end after {ROUNDS} rounds")


def large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
