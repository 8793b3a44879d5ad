"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.session import cut_lineage


def large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the least of its neighbours and itself."""
    both = cut_lineage(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))))
    least = cut_lineage(both.groupBy("u").agg(F.min("v").alias("m")))
    return (
        both.join(least, "u").where("v > u")
        .select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
    )


def small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the least of them."""
    down = cut_lineage(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
    least = cut_lineage(down.groupBy("u").agg(F.min("v").alias("m")))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` of the nodes of ``edges`` (u, v); the component is its least node.

    Loops and null ends are ignored. Steps run until the edges stay the same, when each node
    has one edge, to the least node of its component.
    """
    now = cut_lineage(edges.where("u <> v").select("u", "v").distinct())
    before = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.shiftright(F.xxhash64("u", "v"), 20))).first()
        if state == before or state[0] == 0:
            break
        before = state
        now = cut_lineage(small_star(large_star(now)))
    found = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return cut_lineage(found.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct())
