"""Connected components of a graph given as edges: alternating large-star and small-star rounds, without collecting anything."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, join_hot


def _least(pairs: DataFrame) -> DataFrame:
    """(u, m, n): the smallest of u and its neighbours v, and the number of these. Aggregates before the shuffle, so a hub is no hot key."""
    return cut(pairs.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n"), "least")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): for every node with an edge to another, the smallest node reachable.

    Each round makes at most two rows of an edge and shrinks distances by a constant factor; rounds go on to the fixed point. The
    least neighbours of hubs are broadcast (join_hot), so no task sees all edges of one. Loops and repeated edges change nothing;
    an empty table gives an empty one. Null ends are no edges.
    """
    edges = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    edges, seen = cut(edges, "edges"), None
    total = edges.count()
    while True:
        # Large star: every larger neighbour of a node is tied to the node's smallest neighbour.
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = join_hot(both, _least(both), "u", "n", 2 * total).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        large = cut(large, "edges")
        # Small star: a node and its smaller neighbours are tied to the smallest of these.
        low = _least(large)
        small = join_hot(large, low, "u", "n", total).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
        edges = cut(small.union(low.select("u", F.col("m").alias("v"))).where("u > v").distinct(), "edges")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if now == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        seen, total = now, now[0]
