"""Connected components by alternating large-star and small-star steps.

Every step aggregates a minimum per node, which combines before the shuffle, and
joins it back to the edges, so no neighbourhood is ever gathered in one place.
Each round's edges are checkpointed in the shared folder: plans stay short and
lost executors cost one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.session import checkpointed


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (u, v) with u > v; each neighbour larger (or not larger) than u is linked to u's least neighbour."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        linked = edges.select(F.col("v").alias("u"), F.col("u").alias("v")).join(least, "u")
        return linked.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    linked = edges.join(least, "u")
    moved = linked.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _state(edges: DataFrame) -> tuple:
    total = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    return tuple(edges.agg(F.count("*"), total).first())


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", rounds: int = 50) -> DataFrame:
    """``node`` and ``component`` (the least node of its component) of every node that has an edge.

    Null ends and loops are ignored; repeated edges count once; no edges give no rows.
    Raises if ``rounds`` rounds do not suffice (they suffice for any graph of under 2^25 diameter).
    """
    edges = edges.filter(F.col(src) != F.col(dst)).select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"))
    edges = checkpointed(edges.distinct())
    before = _state(edges)
    if not before[0]:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    for _ in range(rounds):
        edges = checkpointed(_star(_star(edges, True), False))
        now = _state(edges)
        if now == before:
            found = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
            return found.unionByName(found.select(F.col("component").alias("node"), "component").distinct())
        before = now
    raise RuntimeError(f"components have not settled in {rounds} rounds")
