"""Connected components of a graph too large for one machine, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import durable


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of `links` (columns a and b of one orderable type): root is the least node reachable.

    Loops and repeated links do no harm; without links the result is empty. Every step is a grouped minimum, which is
    combined before the shuffle, and a join of the links with these minima. The minima are written first: so neither
    side of the join is an aggregate, and adaptive execution can split a node with very many links among tasks.
    """
    edges = durable(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = _mark(edges)
    while True:
        both = edges.union(edges.select(F.col("v"), F.col("u"))).toDF("u", "v")
        least = durable(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
        star = durable(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        least = durable(star.groupBy("u").agg(F.min("v").alias("m")))
        edges = durable(star.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(least).distinct())
        now = _mark(edges)
        if now == before:
            break
        before = now
    root = edges.toDF("node", "root")
    return root.union(root.select("root", "root")).distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
