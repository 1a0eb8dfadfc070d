"""Leakage-safe splits: atoms of provenance, group hold-outs and folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.operators.graph import connected_components


def atoms(df: DataFrame, id_col: str, links: list[str]) -> DataFrame:
    """``id_col`` and ``atom``: documents that share a value of any of ``links`` are one atom, named by its least key.

    Members of a group are linked to its first one only, never to each other.
    """
    edges = None
    for c in links:
        least = df.filter(F.col(c).isNotNull()).groupBy(c).agg(F.min(id_col).alias("least"))
        star = df.join(least, c).select(F.col(id_col).alias("src"), F.col("least").alias("dst"))
        edges = star if edges is None else edges.unionByName(star)
    found = connected_components(edges)
    joined = df.select(id_col).join(found, F.col(id_col) == F.col("node"), "left")
    return joined.select(id_col, F.coalesce("component", id_col).alias("atom"))


def group_holdout(df: DataFrame, atom: str, test: Column, leakage: str | None = None) -> DataFrame:
    """``df`` with ``part``: an atom with any test row is test; rows that share a ``leakage`` group with test are left out (one step, not transitive)."""
    out = df.withColumn("__test", F.max(test.cast("int")).over(W.partitionBy(atom)) == 1)
    part = F.when(F.col("__test"), "test").otherwise("train")
    if leakage:
        near = out.filter("__test").select(leakage).distinct().withColumn("__near", F.lit(True))
        out = out.join(near, leakage, "left")
        part = F.when(F.col("__test"), "test").when(F.col("__near"), "left out").otherwise("train")
    return out.withColumn("part", part).drop("__test", "__near")


def folds(groups: DataFrame, by: str, size: str, name: str, n: int) -> DataFrame:
    """Groups dealt to folds in turn inside each class, the largest first."""
    nth = F.row_number().over(W.partitionBy(by).orderBy(F.desc(size), name))
    return groups.withColumn("fold", ((nth - 1) % n).cast("int"))


def greedy_folds(sizes: list[tuple[str, int]], n: int) -> dict[str, int]:
    """Largest group to the least loaded fold; for the keys of a design, which fit the driver."""
    load, out = [0] * n, {}
    for name, size in sorted(sizes, key=lambda x: (-x[1], x[0])):
        at = load.index(min(load))
        load[at] += size
        out[name] = at
    return out


def held_values(sizes: list[tuple[str, int]], share: float) -> list[str]:
    """Values in the given order until ``share`` of the volume is reached; those that would exceed it by half are skipped."""
    total, used, out = sum(n for _, n in sizes), 0, []
    for name, n in sizes:
        if used >= share * total:
            break
        if used + n <= 1.5 * share * total:
            used += n
            out.append(name)
    return out
