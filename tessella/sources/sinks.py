"""Sinks: tables, appends without repeats, content-addressed caches and run manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str) -> None:
    """With a header; nulls are empty cells."""
    df.write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)


def append_new(df: DataFrame, path: str, key: str) -> None:
    """Appends the rows whose key the table does not have yet."""
    known = df.sparkSession.read.parquet(path).select(key)
    df.join(known, key, "left_anti").dropDuplicates([key]).write.mode("append").parquet(path)


def write_features(matrix: DataFrame, path: str) -> None:
    """The long matrix by feature; only the features present are replaced."""
    matrix.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("feature_id").parquet(path)


def cache_index(df: DataFrame, key: str, text: str, version: str) -> DataFrame:
    """``key``, ``sha256`` of the text, and the versions that share it."""
    return df.groupBy(key, F.sha2(F.col(text), 256).alias("sha256")).agg(F.sort_array(F.collect_set(version)).alias("versions"))


def manifest(df: DataFrame, name: str) -> DataFrame:
    """One row: the table's name, rows, columns and a digest that does not depend on the order of rows."""
    row = F.xxhash64(*df.columns)
    digest = F.sum(row.cast("decimal(38,0)")).cast("string")
    return df.agg(F.count("*").alias("n_rows"), digest.alias("digest")).select(F.lit(name).alias("name"), "n_rows", F.lit(",".join(df.columns)).alias("columns"), "digest")
