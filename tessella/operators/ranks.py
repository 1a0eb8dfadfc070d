"""Ranks inside groups. Their tie rules differ, so each has its own operator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def strict_percentile(df: DataFrame, value: str, by: list[str], out: str) -> DataFrame:
    """Share of the group's non-null values strictly below the row's; rows without a value get null.

    Neither ``percent_rank`` (divides by n-1) nor ``cume_dist`` (counts ties).
    """
    ordered = Window.partitionBy(*by).orderBy(F.col(value).asc_nulls_last())
    share = (F.rank().over(ordered) - 1) / F.count(value).over(Window.partitionBy(*by))
    return df.withColumn(out, F.when(F.col(value).isNotNull(), share))


def tercile_score(percentile: Column) -> Column:
    """0, 0.5 or 1 by the third of the scale that a percentile falls in."""
    return F.when(percentile < 1 / 3, 0.0).when(percentile < 2 / 3, 0.5).when(percentile.isNotNull(), 1.0)
