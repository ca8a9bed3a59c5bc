"""Connected components as rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an edge; component is the least node that can be reached.

    Alternates the large-star and small-star steps: the number of rounds grows with the logarithm of the longest path. Each
    step takes the least neighbour by a plain aggregate (combined before the shuffle) and joins it back, so the edges of one
    node are never gathered in one task, and Spark can split a skewed join. Each round is checkpointed; a round that changes
    nothing ends the loop. No edges: no rows. Self-loops and repeated edges change nothing.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e = checkpointed(e)
    before = None
    for _ in range(max_rounds):
        # Large star: every larger neighbour of a node is linked with the node's least neighbour.
        both = e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = large.distinct()
        # Small star: every smaller neighbour, and the node itself, is linked with the least neighbour.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        near = large.join(low, "u")
        small = near.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.select("u", F.col("m").alias("v")))
        e = checkpointed(small.where("u <> v").distinct())
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    out = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return out.unionAll(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
