"""Repeated sentences, lines and boilerplate of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.functions.text import sentences


def repeat_scan(docs: DataFrame, id_col: str, text_col: str, at_least: int = 40) -> DataFrame:
    """Per document: sentences, share of those in repeated ones (the first included), their number, most copies, longest run, adjacent copies."""
    each = docs.select(F.col(id_col), F.posexplode(sentences(F.col(text_col), at_least)).alias("pos", "s"))
    each = each.withColumn("n", F.count("*").over(W.partitionBy(id_col, "s")))
    ordered = W.partitionBy(id_col).orderBy("pos")
    each = each.withColumn("again", F.col("n") > 1)
    each = each.withColumn("adjacent", F.when(F.lag("s").over(ordered) == F.col("s"), 1).otherwise(0))
    each = each.withColumn("island", F.sum(F.when(F.col("again"), 0).otherwise(1)).over(ordered))
    runs = each.groupBy(id_col, "island").agg(
        F.count("*").alias("n"),
        F.count_if("again").alias("run"),
        F.sum("adjacent").alias("adjacent"),
        F.max("n").alias("most"),
        F.sum(F.when(F.col("again"), 1.0 / F.col("n")).otherwise(0.0)).alias("kinds"),
    )
    return runs.groupBy(id_col).agg(
        F.sum("n").alias("n_sentences"),
        F.sum("run").alias("n_repeated"),
        (F.sum("run") / F.sum("n")).alias("repeat_share"),
        F.round(F.sum("kinds")).cast("long").alias("n_kinds"),
        F.max("most").alias("most_copies"),
        F.max("run").alias("longest_run"),
        F.sum("adjacent").alias("n_adjacent"),
    )


def boilerplate(docs: DataFrame, id_col: str, text_col: str, source_col: str, least: int = 3, share: float = 0.5) -> DataFrame:
    """Lines found in at least ``max(least, share of the source's documents)`` documents of a source."""
    lines = docs.select(id_col, source_col, F.explode(F.array_distinct(F.split(text_col, "\n"))).alias("line"))
    lines = lines.withColumn("line", F.btrim("line", F.lit(" \t"))).filter("line <> ''").distinct()
    counts = lines.groupBy(source_col, "line").agg(F.count("*").alias("n_docs"))
    sizes = docs.groupBy(source_col).agg(F.count("*").alias("n_source"))
    found = counts.join(sizes, source_col)
    return found.filter(F.col("n_docs") >= F.greatest(F.lit(float(least)), F.col("n_source") * share))


def strip_boilerplate(docs: DataFrame, lines: DataFrame, text_col: str, source_col: str) -> DataFrame:
    """``docs`` without the lines listed for their source; the order of the others stays."""
    drop = lines.groupBy(source_col).agg(F.collect_set("line").alias("__drop"))
    df = docs.join(drop, source_col, "left")
    listed = F.coalesce("__drop", F.array().cast("array<string>"))
    kept = F.filter(F.split(text_col, "\n"), lambda x: ~F.array_contains(listed, F.btrim(x, F.lit(" \t"))))
    return df.withColumn(text_col, F.array_join(kept, "\n")).select(*docs.columns)
