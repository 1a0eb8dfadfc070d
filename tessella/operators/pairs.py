"""Paired contrasts between conditions, and their resampling by cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.functions.hashing import md5_int


def contrast_pairs(df: DataFrame, cell: list[str], condition: str, value: str, left: str, right: str) -> tuple[DataFrame, DataFrame]:
    """Cells that have both conditions, with their values, and those that lack one; a condition is unique in a cell."""
    sides = df.filter(F.col(condition).isin(left, right)).groupBy(*cell).agg(
        F.max(F.when(F.col(condition) == left, F.col(value))).alias("left"), F.max(F.when(F.col(condition) == right, F.col(value))).alias("right")
    )
    whole = F.col("left").isNotNull() & F.col("right").isNotNull()
    return sides.filter(whole), sides.filter(~whole)


def draws(reps: int, seed: int, groups: int, spark) -> DataFrame:
    """``rep`` and ``drawn``: ``groups`` draws with replacement of each repetition, by hash."""
    grid = spark.range(reps * groups).select((F.col("id") / groups).cast("long").alias("rep"), (F.col("id") % groups).alias("i"))
    return grid.select("rep", F.pmod(md5_int(F.concat_ws("|", F.lit(seed), "rep", "i")), F.lit(groups)).alias("drawn"))


def cluster_bootstrap(df: DataFrame, cluster: str, value: str, reps: int = 1000, seed: int = 1) -> DataFrame:
    """Percentile interval of the mean, drawing whole clusters; p is twice the smaller tail's share, at least 2 / reps.

    Clusters are summed up first, so a repetition reads one row a cluster, however many rows it has.
    """
    sums = df.groupBy(cluster).agg(F.sum(value).alias("s"), F.count(value).alias("n")).filter("n > 0")
    ordered = sums.select((F.row_number().over(W.orderBy(cluster)) - 1).cast("long").alias("drawn"), "s", "n")
    groups = ordered.count()  # the number of clusters, a design quantity
    if not groups:
        return df.sparkSession.createDataFrame([], "mean double, lo double, hi double, p double, n_clusters long, n long")
    means = draws(reps, seed, groups, df.sparkSession).join(ordered, "drawn").groupBy("rep").agg((F.sum("s") / F.sum("n")).alias("m"))
    of = means.agg(F.sort_array(F.collect_list("m")).alias("m"), F.count_if(F.col("m") <= 0).alias("low"), F.count_if(F.col("m") >= 0).alias("high"))
    point = ordered.agg((F.sum("s") / F.sum("n")).alias("mean"), F.count("*").alias("n_clusters"), F.sum("n").alias("n"))
    p = F.least(F.lit(1.0), 2 * F.greatest(F.least("low", "high"), F.lit(1)) / F.lit(float(reps)))
    lo, hi = F.get("m", F.lit(int(0.025 * reps))), F.get("m", F.lit(int(0.975 * reps) - 1))
    return point.crossJoin(of).select("mean", lo.alias("lo"), hi.alias("hi"), p.alias("p"), "n_clusters", "n")  # one row each


def wild_cluster_p(df: DataFrame, cluster: str, value: str, reps: int = 1000, seed: int = 1) -> DataFrame:
    """Sign-flip test of a zero mean: clusters keep or change their sign together, t is robust to clusters."""
    sums = df.groupBy(cluster).agg(F.sum(value).alias("s"), F.sum(F.col(value) * 0 + 1).alias("n"))
    total = sums.agg(F.sum("n").alias("total"), F.count("*").alias("groups"))
    grid = sums.crossJoin(df.sparkSession.range(-1, reps).withColumnRenamed("id", "rep"))  # clusters by repetitions: the design's size
    flipped = F.pmod(md5_int(F.concat_ws("|", F.lit(seed), "rep", F.col(cluster))), F.lit(2)) == 1
    sign = F.when((F.col("rep") >= 0) & flipped, -1).otherwise(1)
    grid = grid.withColumn("s", F.col("s") * sign)
    grid = grid.crossJoin(F.broadcast(total))
    mean = F.sum("s").over(W.partitionBy("rep")) / F.col("total")
    t = grid.withColumn("mean", mean).groupBy("rep").agg(
        F.max("mean").alias("mean"), (F.max("groups") / (F.max("groups") - 1) * F.sum((F.col("s") - F.col("n") * F.col("mean")) ** 2) / (F.max("total") ** 2)).alias("v")
    )
    t = t.withColumn("t", F.when(F.col("v") > 0, F.abs(F.col("mean")) / F.sqrt("v")).when(F.col("mean") == 0, 0.0).otherwise(float("inf")))
    own = F.max(F.when(F.col("rep") == -1, F.col("t"))).over(W.partitionBy())
    return t.withColumn("own", own).filter("rep >= 0").agg(
        (F.greatest(F.count_if(F.col("t") >= F.col("own") - 1e-12), F.lit(1)) / F.lit(float(reps))).alias("p"), F.max("own").alias("t")
    )
