"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara.session import cut_lineage

PART_EDGES = 2_000  # a task has about as many, so that few edges make few files


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``(a, b)``; a component is its smallest node.

    Each round joins every edge with the smallest neighbour of its ends, so a hub costs
    one row per edge and never gathers its neighbours. Rounds grow with the logarithm of
    the longest path. No edges give no rows; loops and repeated edges change nothing.
    Shuffles are read by as many tasks as the edges need, since every task of every
    round leaves files.
    """
    edges = cut_lineage(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    n, mark = edges.count(), None
    while True:
        parts = max(1, -(-n // PART_EDGES))
        edges = edges.coalesce(parts)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            both.join(least, "u")
            .where("v > u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .coalesce(2 * parts)
            .distinct()
            .coalesce(2 * parts)
        )
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        edges = cut_lineage(
            small.select("u", F.col("m").alias("v"))
            .unionByName(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
            .coalesce(2 * parts)
            .distinct()
            .coalesce(2 * parts)
        )
        state = edges.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
        if tuple(state) == mark:
            break
        n, mark = state[0], tuple(state)
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
