"""Vectors as arrays of numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null if either is a zero vector."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size)


def centroid(df: DataFrame, by: list[str], vector: str, out: str) -> DataFrame:
    """Element-wise mean: places are averaged with partial sums, then put in order."""
    each = df.select(*by, F.posexplode(vector).alias("__i", "__x"))
    means = each.groupBy(*by, "__i").agg(F.avg(F.col("__x").cast("double")).alias("__m"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("__i", "__m"))), lambda s: s["__m"])
    return means.groupBy(*by).agg(ordered.alias(out))
