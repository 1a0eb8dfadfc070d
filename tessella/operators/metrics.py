"""Measures of scored decisions. Each takes rows with a score of [0, 1] and a label 0 or 1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b)


def confusion(df: DataFrame, by: list[str], score: str, label: str, threshold: float = 0.5) -> DataFrame:
    """Counts, FPR, TPR, MCC and balanced accuracy (flagged above the threshold); null where a class is missing."""
    flagged, positive = F.col(score) > threshold, F.col(label) == 1
    counts = df.groupBy(*by).agg(
        F.count_if(flagged & positive).alias("tp"),
        F.count_if(flagged & ~positive).alias("fp"),
        F.count_if(~flagged & positive).alias("fn"),
        F.count_if(~flagged & ~positive).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    product = (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)
    return counts.select(
        "*",
        _ratio(fp, fp + tn).alias("fpr"),
        _ratio(tp, tp + fn).alias("tpr"),
        F.when(product > 0, (tp * tn - fp * fn) / F.sqrt(product)).alias("mcc"),
        ((_ratio(tp, tp + fn) + _ratio(tn, tn + fp)) / 2).alias("balanced_accuracy"),
    )


def auroc(df: DataFrame, by: list[str], score: str, label: str) -> DataFrame:
    """Rank statistic with ties counted half: scores are first summed to one row each, so no rank is taken over rows."""
    values = df.groupBy(*by, score).agg(F.count("*").alias("n"), F.sum(label).alias("pos"))
    below = F.coalesce(F.sum("n").over(W.partitionBy(*by).orderBy(score).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranked = values.withColumn("rank", below + (F.col("n") + 1) / 2)
    sums = ranked.groupBy(*by).agg(F.sum("pos").alias("n1"), (F.sum("n") - F.sum("pos")).alias("n0"), F.sum(F.col("rank") * F.col("pos")).alias("r"))
    area = (F.col("r") - F.col("n1") * (F.col("n1") + 1) / 2) / (F.col("n1") * F.col("n0"))
    return sums.select(*by, F.when((F.col("n1") > 0) & (F.col("n0") > 0), area).alias("auroc"))


def tpr_at_fpr(df: DataFrame, by: list[str], score: str, label: str, target: float) -> DataFrame:
    """Threshold: the k-th largest score of a negative, k = floor(target * negatives), the largest if k is 0; flagged strictly above."""
    negative = df.filter(F.col(label) == 0)
    nth = F.row_number().over(W.partitionBy(*by).orderBy(F.desc(score)))
    size = F.count("*").over(W.partitionBy(*by))
    at = negative.select(*by, F.col(score).alias("threshold"), nth.alias("nth"), size.alias("size"))
    at = at.filter(F.col("nth") == F.greatest(F.floor(F.col("size") * target + 1e-9), F.lit(1))).select(*by, "threshold")
    positive = df.filter(F.col(label) == 1).join(at, by)
    return positive.groupBy(*by, "threshold").agg((F.count_if(F.col(score) > F.col("threshold")) / F.count("*")).alias("tpr"))


def tie_safe_bins(df: DataFrame, by: list[str], score: str, label: str, bins: int = 10) -> DataFrame:
    """Equal-frequency bins that never split equal scores: the whole tie goes to the bin of its middle rank."""
    values = df.groupBy(*by, score).agg(F.count("*").alias("n"), F.sum(label).alias("pos"))
    whole = W.partitionBy(*by)
    below = F.coalesce(F.sum("n").over(whole.orderBy(score).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    middle = below + (F.col("n") - 1) / 2.0
    total = F.sum("n").over(whole)
    at = F.least(F.lit(bins - 1), F.floor(middle * bins / total)).cast("int")
    return values.withColumn("bin", at).groupBy(*by, "bin").agg(
        F.sum("n").alias("n"), (F.sum(F.col(score) * F.col("n")) / F.sum("n")).alias("mean_score"), (F.sum("pos") / F.sum("n")).alias("share")
    )


def calibration(df: DataFrame, by: list[str], score: str, label: str, bins: int = 10) -> DataFrame:
    """ECE and MCE over tie-safe bins, and the Brier score."""
    gap = F.abs(F.col("mean_score") - F.col("share"))
    errors = tie_safe_bins(df, by, score, label, bins).groupBy(*by).agg((F.sum(gap * F.col("n")) / F.sum("n")).alias("ece"), F.max(gap).alias("mce"))
    brier = df.groupBy(*by).agg(F.avg(F.pow(F.col(score) - F.col(label), F.lit(2))).alias("brier"), F.count("*").alias("n"))
    return errors.join(brier, by)


def risk_coverage(df: DataFrame, by: list[str], score: str, label: str, targets: list[float]) -> DataFrame:
    """Error share among the most confident rows; the cut goes on through ties, k = max(1, round half even(target * n))."""
    confidence = F.greatest(F.col(score), 1 - F.col(score))
    wrong = ((F.col(score) >= 0.5).cast("int") != F.col(label)).cast("int")
    values = df.select(*by, F.round(confidence, 12).alias("confidence"), wrong.alias("wrong"))
    values = values.groupBy(*by, "confidence").agg(F.count("*").alias("n"), F.sum("wrong").alias("wrong"))
    down = W.partitionBy(*by).orderBy(F.desc("confidence")).rowsBetween(W.unboundedPreceding, 0)
    values = values.select(*by, F.sum("n").over(down).alias("kept"), F.sum("wrong").over(down).alias("errors"), F.sum("n").over(W.partitionBy(*by)).alias("total"))
    each = values.withColumn("target", F.explode(F.array(*map(F.lit, targets))))
    k = F.greatest(F.lit(1), F.bround(F.col("target") * F.col("total"), 0))
    first = each.filter(F.col("kept") >= k).groupBy(*by, "target").agg(F.min(F.struct("kept", "errors", "total")).alias("x"))
    return first.select(*by, "target", F.col("x.kept").alias("n_kept"), (F.col("x.kept") / F.col("x.total")).alias("coverage"), (F.col("x.errors") / F.col("x.kept")).alias("risk"))


def icc21(df: DataFrame, subject: str, rater: str, value: str) -> DataFrame:
    """ICC(2,1) from a two-way analysis of variance; ``df`` has each subject rated once by every rater."""
    total = df.agg(F.countDistinct(subject).alias("n"), F.countDistinct(rater).alias("k"), F.avg(value).alias("m"), F.sum(F.col(value) ** 2).alias("ss"))
    rows = df.groupBy(subject).agg(F.avg(value).alias("a")).agg(F.sum(F.col("a") ** 2).alias("rows"))
    columns = df.groupBy(rater).agg(F.avg(value).alias("a")).agg(F.sum(F.col("a") ** 2).alias("cols"))
    x = total.crossJoin(rows).crossJoin(columns)  # one row each
    n, k, m = F.col("n"), F.col("k"), F.col("m")
    between = k * F.col("rows") - n * k * m * m
    raters = n * F.col("cols") - n * k * m * m
    rest = F.col("ss") - n * k * m * m - between - raters
    msr, msc, mse = between / (n - 1), raters / (k - 1), rest / ((n - 1) * (k - 1))
    return x.select(((msr - mse) / (msr + (k - 1) * mse + k * (msc - mse) / n)).alias("icc"), n.alias("n_subjects"), k.alias("n_raters"))


def cliffs_delta(df: DataFrame, by: list[str], value: str, group: str) -> DataFrame:
    """(pairs in which group 1 is greater - smaller) / all pairs, by rank sums instead of pairs."""
    area = auroc(df, by, value, group)
    return area.select(*by, (2 * F.col("auroc") - 1).alias("cliffs_delta"))
