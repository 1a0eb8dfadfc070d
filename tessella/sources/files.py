"""Files other than Parquet: CSV, journals, folders of texts, word lists and Markdown tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """With a header; a byte-order mark at its start does not matter, as columns go by the schema."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("multiLine", True).csv(path)


def journal(spark: SparkSession, path: str, schema: StructType | str, keys: list[str], order: str) -> DataFrame:
    """JSON lines: broken lines are skipped, the last record of each key (by ``order``) wins."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    nth = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(order)))
    return rows.withColumn("__nth", nth).filter("__nth = 1").drop("__nth")


def texts(spark: SparkSession, path: str) -> DataFrame:
    """``document_id`` (the file's stem) and ``text`` of every file of a folder."""
    rows = spark.read.text(path, wholetext=True).select(F.col("value").alias("text"), F.col("_metadata.file_name").alias("name"))
    return rows.select(F.regexp_replace("name", r"\.[^.]*$", "").alias("document_id"), "text")


def lexicon(spark: SparkSession, path: str) -> DataFrame:
    """``term, tag, ...`` lines with ``!`` comments: the tags of each term."""
    rows = spark.read.text(path).filter(~F.col("value").startswith("!") & (F.trim("value") != ""))
    parts = F.transform(F.split("value", ","), lambda x: F.trim(x))
    return rows.select(parts[0].alias("term"), parts[1].alias("tag")).groupBy("term").agg(F.sort_array(F.collect_set("tag")).alias("tags"))


def markdown_table(spark: SparkSession, path: str, first: str) -> DataFrame:
    """Cells (``row``, ``cells``) of the table of a Markdown document whose first header cell is ``first``."""
    text = spark.read.text(path, wholetext=True).select(F.explode(F.regexp_extract_all("value", F.lit(r"(?m)((?:^\|.*\|[ ]*\n?)+)"), 1)).alias("t"))
    cells = F.transform(F.filter(F.split("t", "\n"), lambda x: x != ""), lambda x: F.transform(F.split(F.btrim(x, F.lit("| ")), r"\|"), lambda c: F.trim(c)))
    found = text.select(cells.alias("c")).filter(F.col("c")[0][0] == first)
    rows = found.select(F.posexplode(F.slice("c", 3, 1_000_000)).alias("row", "cells"))
    return rows
