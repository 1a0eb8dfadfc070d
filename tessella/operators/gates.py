"""Expectations: each rule is a query of its violations; a gate raises instead of repairing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class GateError(AssertionError):
    """Some rows break an expectation."""


def _violations(df: DataFrame, rule: str, key: Column, detail: Column) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), key.cast("string").alias("key"), detail.cast("string").alias("detail"))


def required(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    parts = [_violations(df.filter(F.col(c).isNull() | (F.col(c).cast("string") == "")), f"required:{c}", F.col(key), F.lit("")) for c in columns]
    return reduce(DataFrame.unionByName, parts)


def unique(df: DataFrame, columns: list[str]) -> DataFrame:
    counts = df.groupBy(*columns).agg(F.count("*").alias("n")).filter("n > 1")
    return _violations(counts, "unique:" + ",".join(columns), F.concat_ws("|", *columns), F.col("n"))


def allowed(df: DataFrame, key: str, column: str, values: list) -> DataFrame:
    return _violations(df.filter(~F.col(column).isin(values)), f"allowed:{column}", F.col(key), F.col(column))


def foreign_key(df: DataFrame, key: str, column: str, other: DataFrame, other_column: str) -> DataFrame:
    missing = df.join(other.select(F.col(other_column).alias(column)), column, "left_anti")
    return _violations(missing, f"foreign_key:{column}", F.col(key), F.col(column))


def holds(df: DataFrame, key: str, name: str, condition: Column, detail: Column) -> DataFrame:
    return _violations(df.filter(~condition), name, F.col(key), detail)


def functional_dependency(df: DataFrame, left: str, right: str) -> DataFrame:
    broken = df.groupBy(left).agg(F.count_distinct(right).alias("n")).filter("n > 1")
    return _violations(broken, f"depends:{left}->{right}", F.col(left), F.col("n"))


def at_most(df: DataFrame, group: str, limit: float, share: bool = False) -> DataFrame:
    """Groups of more rows (or a larger share of all rows) than ``limit``."""
    counts = df.groupBy(group).agg(F.count("*").alias("n"))
    if share:
        total = df.agg(F.count("*").alias("total"))
        counts = counts.crossJoin(total).withColumn("n", F.col("n") / F.col("total"))  # one row
    return _violations(counts.filter(F.col("n") > limit), f"at_most:{group}", F.col(group), F.round("n", 6))


def grid(df: DataFrame, dimensions: dict[str, list]) -> DataFrame:
    """Cells of the design that have no row; dimensions are lists of a design's values."""
    spark = df.sparkSession
    cells = reduce(DataFrame.crossJoin, [spark.createDataFrame([(v,) for v in values], [name]) for name, values in dimensions.items()])
    missing = cells.join(df.select(*dimensions).distinct(), list(dimensions), "left_anti")
    return _violations(missing, "grid", F.concat_ws("|", *dimensions), F.lit("missing"))


def gate(*violations: DataFrame) -> None:
    """Raises with the counts of all rules that are broken, and some of their keys."""
    found = reduce(DataFrame.unionByName, violations)
    rules = found.groupBy("rule").agg(F.count("*").alias("n"), F.min("key").alias("key")).orderBy("rule").collect()
    if rules:
        raise GateError("; ".join(f"{r.rule}: {r.n} rows, such as {r.key}" for r in rules))
