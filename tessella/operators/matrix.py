"""The long feature matrix (one row a document and feature) and what is done to it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEY = ["document_id", "feature_id"]


def cell_value(stat2: str, stat: str) -> Column:
    """The second statistic where it is given, else the first; cells are strings, ``""`` is missing and ``"0"`` a value."""
    return F.coalesce(F.nullif(F.col(stat2), F.lit("")), F.nullif(F.col(stat), F.lit(""))).cast("double")


def unpivot(wide: DataFrame, key: str, features: list[str]) -> DataFrame:
    cells = wide.select(F.col(key).alias("document_id"), *[F.col(f).cast("double").alias(f) for f in features])
    return cells.unpivot("document_id", features, "feature_id", "value")


def upsert(matrix: DataFrame, fresh: DataFrame, owned: list[str], alive: DataFrame) -> DataFrame:
    """``matrix`` of the ``alive`` documents with all rows of ``owned`` features replaced by ``fresh``."""
    kept = matrix.join(alive.select("document_id"), "document_id", "left_semi").filter(~F.col("feature_id").isin(owned))
    return kept.unionByName(fresh.filter(F.col("feature_id").isin(owned)).join(alive.select("document_id"), "document_id", "left_semi"))


def patch(matrix: DataFrame, fixes: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """``matrix`` with ``column`` overwritten where ``fixes`` has another value, and the log of those changes."""
    new = fixes.select(*KEY, F.col(column).alias("__new"))
    joined = matrix.join(new, KEY, "left")
    changed = F.col("__new").isNotNull() & ~F.col("__new").eqNullSafe(F.col(column))
    log = joined.filter(changed).select(*KEY, F.col(column).alias("old"), F.col("__new").alias("new"))
    return joined.withColumn(column, F.when(changed, F.col("__new")).otherwise(F.col(column))).select(*matrix.columns), log


def missingness(matrix: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Cells and missing cells of each feature and group, with their share."""
    out = matrix.groupBy("feature_id", *by).agg(F.count("*").alias("n"), F.count_if(F.col(value).isNull()).alias("n_missing"))
    return out.withColumn("share", F.col("n_missing") / F.col("n"))


def weighted_index(scores: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Mean of each category's scores, then their weighted mean times 100; a category without scores passes its weight on."""
    means = scores.groupBy("document_id", "category").agg(F.avg("score").alias("mean"))
    pairs = [x for kv in weights.items() for x in (F.lit(kv[0]), F.lit(kv[1]))]
    weight = F.element_at(F.create_map(*pairs), F.col("category"))
    means = means.withColumn("w", F.when(F.col("mean").isNotNull(), weight))
    return means.groupBy("document_id").agg((F.sum(F.col("w") * F.col("mean")) / F.sum("w") * 100).alias("index"))


def zscores(df: DataFrame, value: str, by: list[str], out: str) -> DataFrame:
    """Against the mean and population deviation of the group; null where that is 0."""
    whole = W.partitionBy(*by)
    sd = F.stddev_pop(value).over(whole)
    return df.withColumn(out, F.when(sd > 0, (F.col(value) - F.avg(value).over(whole)) / sd))


def imputed(df: DataFrame, columns: list[str], train: Column) -> DataFrame:
    """Missing values filled with the median of the training rows, 0 where they have none."""
    medians = df.filter(train).agg(*[F.coalesce(F.median(c), F.lit(0.0)).alias(f"__{c}") for c in columns])
    filled = df.crossJoin(F.broadcast(medians))  # one row
    return filled.select(*[F.coalesce(c, f"__{c}").alias(c) if c in columns else F.col(c) for c in df.columns])


def frozen_percentile(df: DataFrame, pool: DataFrame, value: str, by: list[str], out: str) -> DataFrame:
    """Share of the frozen ``pool``'s values strictly below; the pool is summed up, never joined value by value."""
    points = pool.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("__n"))
    both = df.withColumn("__n", F.lit(0)).unionByName(points, allowMissingColumns=True)
    # rows of the pool come after equal rows of df, so that only smaller values count
    order = W.partitionBy(*by).orderBy(value, F.col("__n") > 0).rowsBetween(W.unboundedPreceding, -1)
    below, total = F.coalesce(F.sum("__n").over(order), F.lit(0)), F.sum("__n").over(W.partitionBy(*by))
    ranked = both.withColumn(out, F.when(total > 0, below / total))
    return ranked.filter("__n = 0").select(*df.columns, out)
