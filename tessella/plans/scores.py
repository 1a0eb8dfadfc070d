"""Queries over scored documents: decisions, calibration, agreement and subgroups.

Scores are drawn by hash, so that any engine has the same; labels are ``labels.quality``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.functions import hashing as H
from tessella.operators import metrics as M
from tessella.sources import table


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a labelled document: ``split`` (its source's first two characters and last digit), ``p``, ``y``."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("y"), "toxic")
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    noise = H.unit_draw(F.concat(F.col("doc_id"), F.lit("p")), 100)
    return docs.join(labels, "doc_id").withColumn("p", F.round(0.6 * noise + 0.4 * F.col("y"), 4))


P = """
WITH pred AS (
  SELECT doc_id, lang, source, n_chars, quality AS y, toxic,
         round(0.6 * ((('0x' || substr(md5(doc_id || 'p'), 1, 8))::BIGINT % 100) / 100.0::DOUBLE) + 0.4 * quality, 4) AS p
  FROM documents JOIN labels USING (doc_id)
)
"""


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def q_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.confusion(predictions(spark, sf_dir), ["source"], "p", "y"))


SQL_CONFUSION = P + """
, c AS (
  SELECT source, count_if(p > 0.5 AND y = 1)::BIGINT AS tp, count_if(p > 0.5 AND y = 0)::BIGINT AS fp,
         count_if(p <= 0.5 AND y = 1)::BIGINT AS fn, count_if(p <= 0.5 AND y = 0)::BIGINT AS tn
  FROM pred GROUP BY source
), m AS (SELECT *, (tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn) AS q FROM c)
SELECT source, tp, fp, fn, tn, round(CASE WHEN fp + tn > 0 THEN fp / (fp + tn) END, 6) AS fpr, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END, 6) AS tpr,
  round(CASE WHEN q > 0 THEN (tp::DOUBLE * tn - fp::DOUBLE * fn) / sqrt(q) END, 6) AS mcc,
  round((CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END + CASE WHEN fp + tn > 0 THEN tn / (fp + tn) END) / 2, 6) AS balanced_accuracy
FROM m
"""


def q_auroc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.auroc(predictions(spark, sf_dir), ["lang"], "p", "y"))


SQL_AUROC = P + """
, pairs AS (SELECT a.lang, avg(CASE WHEN a.p > b.p THEN 1.0 WHEN a.p = b.p THEN 0.5 ELSE 0 END) AS v FROM pred a JOIN pred b ON a.lang = b.lang AND a.y = 1 AND b.y = 0 GROUP BY 1)
SELECT lang, round(v, 6) AS auroc FROM (SELECT DISTINCT lang FROM pred) LEFT JOIN pairs USING (lang)
"""


def q_cliffs_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.cliffs_delta(predictions(spark, sf_dir), ["lang"], "n_chars", "toxic"))


SQL_CLIFF = P + """
, pairs AS (SELECT a.lang, avg(sign(a.n_chars - b.n_chars)) AS v FROM pred a JOIN pred b ON a.lang = b.lang AND a.toxic = 1 AND b.toxic = 0 GROUP BY 1)
SELECT lang, round(v, 6) AS cliffs_delta FROM (SELECT DISTINCT lang FROM pred) LEFT JOIN pairs USING (lang)
"""


def q_tpr_at_fpr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.tpr_at_fpr(predictions(spark, sf_dir), ["lang"], "p", "y", 0.2))


SQL_TPR = P + """
, n AS (SELECT lang, p, row_number() OVER (PARTITION BY lang ORDER BY p DESC) AS k, count(*) OVER (PARTITION BY lang) AS n FROM pred WHERE y = 0),
t AS (SELECT lang, p AS threshold FROM n WHERE k = greatest(1, floor(n * 0.2 + 1e-9)))
SELECT lang, threshold, round(count_if(p > threshold) / count(*), 6) AS tpr FROM pred JOIN t USING (lang) WHERE y = 1 GROUP BY 1, 2
"""

BINS = P + """
, v AS (SELECT lang, p, count(*) AS n, sum(y) AS pos FROM pred GROUP BY 1, 2),
c AS (
  SELECT *, coalesce(sum(n) OVER (PARTITION BY lang ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below, sum(n) OVER (PARTITION BY lang) AS total FROM v
), b AS (
  SELECT lang, least(9, floor((below + (n - 1) / 2.0::DOUBLE) * 10 / total))::INT AS bin, p, n, pos FROM c
), g AS (SELECT lang, bin, sum(n)::BIGINT AS n, sum(p * n) / sum(n) AS mean_score, sum(pos) / sum(n) AS share FROM b GROUP BY 1, 2)
"""


def q_tie_safe_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.tie_safe_bins(predictions(spark, sf_dir), ["lang"], "p", "y"))


def q_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.calibration(predictions(spark, sf_dir), ["lang"], "p", "y"))


SQL_CALIBRATION = BINS + """
, e AS (SELECT lang, sum(abs(mean_score - share) * n) / sum(n) AS ece, max(abs(mean_score - share)) AS mce FROM g GROUP BY 1),
r AS (SELECT lang, avg((p - y) * (p - y)) AS brier, count(*) AS n FROM pred GROUP BY 1)
SELECT lang, round(ece, 6) AS ece, round(mce, 6) AS mce, round(brier, 6) AS brier, n FROM e JOIN r USING (lang)
"""


def q_risk_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.risk_coverage(predictions(spark, sf_dir), ["lang"], "p", "y", [1.0, 0.9, 0.8, 0.7, 0.5]))


SQL_RISK = P + """
, c AS (SELECT lang, round(greatest(p, 1 - p), 12) AS conf, ((p >= 0.5)::INT <> y)::INT AS wrong FROM pred),
t AS (SELECT unnest([1.0, 0.9, 0.8, 0.7, 0.5])::DOUBLE AS target),
z AS (SELECT lang, count(*) AS total FROM c GROUP BY 1),
k AS (SELECT lang, target, total, greatest(1, round_even(target * total, 0)) AS k FROM z, t),
o AS (SELECT lang, conf, row_number() OVER (PARTITION BY lang ORDER BY conf DESC) AS i FROM c),
e AS (SELECT k.lang, target, total, conf AS edge FROM k JOIN o ON o.lang = k.lang AND o.i = k.k)
SELECT e.lang, target, count(*) AS n_kept, round(count(*) / any_value(total), 6) AS coverage, round(sum(wrong) / count(*), 6) AS risk
FROM e JOIN c ON c.lang = e.lang AND c.conf >= e.edge GROUP BY 1, 2
"""


def q_icc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three drawn ratings of each labelled document, which share a part."""
    docs = table(spark, sf_dir, "labels").select("doc_id", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("seed"))
    rating = F.pmod(H.md5_int(F.col("doc_id")), F.lit(8)) + F.pmod(H.md5_int(F.concat("doc_id", F.lit("s"), "seed")), F.lit(3))
    return rounded(M.icc21(docs.withColumn("v", rating.cast("double")), "doc_id", "seed", "v"))


SQL_ICC = """
WITH d AS (
  SELECT doc_id, seed, (('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT % 8 + ('0x' || substr(md5(doc_id || 's' || seed), 1, 8))::BIGINT % 3)::DOUBLE AS v
  FROM labels, (SELECT unnest([1, 2, 3]) AS seed)
), t AS (SELECT count(DISTINCT doc_id) AS n, count(DISTINCT seed) AS k, avg(v) AS m, sum(v * v) AS ss FROM d),
r AS (SELECT sum(a * a) AS r FROM (SELECT avg(v) AS a FROM d GROUP BY doc_id)), c AS (SELECT sum(a * a) AS c FROM (SELECT avg(v) AS a FROM d GROUP BY seed)),
s AS (SELECT n, k, (k * r - n * k * m * m) AS sr, (n * c - n * k * m * m) AS sc, ss - n * k * m * m AS st FROM t, r, c),
q AS (SELECT n, k, sr / (n - 1) AS msr, sc / (k - 1) AS msc, (st - sr - sc) / ((n - 1) * (k - 1)) AS mse FROM s)
SELECT round((msr - mse) / (msr + (k - 1) * mse + k * (msc - mse) / n), 6) AS icc, n AS n_subjects, k AS n_raters FROM q
"""


def q_seed_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median of a document's ratings (two at least), range, and whether all agree; refused ratings are missing."""
    docs = table(spark, sf_dir, "labels").select("doc_id", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("seed"))
    h = H.md5_int(F.concat("doc_id", F.lit("r"), "seed"))
    rated = docs.withColumn("v", F.when(F.pmod(h, F.lit(7)) > 1, F.pmod(h, F.lit(5)).cast("double")))
    out = rated.groupBy("doc_id").agg(F.count("v").alias("n"), F.median("v").alias("m"), (F.max("v") - F.min("v")).alias("spread"))
    return out.select("doc_id", "n", F.when(F.col("n") >= 2, F.col("m")).alias("median"), "spread", (F.col("spread") == 0).cast("int").alias("agree"))


SQL_MEDIANS = """
WITH d AS (SELECT doc_id, ('0x' || substr(md5(doc_id || 'r' || seed), 1, 8))::BIGINT AS h FROM labels, (SELECT unnest([1, 2, 3]) AS seed)),
v AS (SELECT doc_id, CASE WHEN h % 7 > 1 THEN (h % 5)::DOUBLE END AS v FROM d)
SELECT doc_id, count(v) AS n, CASE WHEN count(v) >= 2 THEN median(v) END AS median, max(v) - min(v) AS spread, (max(v) - min(v) = 0)::INT AS agree FROM v GROUP BY 1
"""


def q_subgroups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flag shares of overlapping groups: all, language, source and length band, each against the rest of its family."""
    df = predictions(spark, sf_dir).filter("y = 1").withColumn("flag", (F.col("p") > 0.6).cast("int"))
    band = F.when(F.col("n_chars") < 1000, "short").when(F.col("n_chars") < 3000, "middle").otherwise("long")
    groups = F.array(F.struct(F.lit("all").alias("family"), F.lit("all").alias("name")), *[F.struct(F.lit(f).alias("family"), c.alias("name")) for f, c in (("lang", F.col("lang")), ("source", F.col("source")), ("length", band))])
    each = df.select("flag", F.explode(groups).alias("g")).select("flag", "g.*")
    sums = each.groupBy("family", "name").agg(F.sum("flag").alias("hits"), F.count("*").alias("n"))
    whole = W.partitionBy("family")
    rest_n, rest = F.sum("n").over(whole) - F.col("n"), F.sum("hits").over(whole) - F.col("hits")
    difference = F.when(rest_n > 0, F.col("hits") / F.col("n") - rest / rest_n)
    return sums.select("family", "name", "n", F.round(F.col("hits") / F.col("n"), 6).alias("share"), F.round(difference, 6).alias("difference"))


SQL_SUBGROUPS = P + """
, f AS (SELECT *, (p > 0.6)::INT AS flag, CASE WHEN n_chars < 1000 THEN 'short' WHEN n_chars < 3000 THEN 'middle' ELSE 'long' END AS band FROM pred WHERE y = 1),
g AS (SELECT 'all' AS family, 'all' AS name, flag FROM f UNION ALL SELECT 'lang', lang, flag FROM f UNION ALL SELECT 'source', source, flag FROM f UNION ALL SELECT 'length', band, flag FROM f),
s AS (SELECT family, name, sum(flag) AS hits, count(*) AS n FROM g GROUP BY 1, 2),
t AS (SELECT family, sum(hits) AS ah, sum(n) AS an FROM s GROUP BY 1)
SELECT family, name, n, round(hits / n, 6) AS share, round(CASE WHEN an > n THEN hits / n - (ah - hits) / (an - n) END, 6) AS difference FROM s JOIN t USING (family)
"""


def q_identical_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources whose labelled languages are the same set."""
    sets = predictions(spark, sf_dir).groupBy("source").agg(F.array_join(F.sort_array(F.collect_set("lang")), ",").alias("members"))
    return sets.groupBy("members").agg(F.count("*").alias("n_groups"), F.array_join(F.sort_array(F.collect_list("source")), ",").alias("sources"))


SQL_IDENTICAL = P + """
, s AS (SELECT source, string_agg(DISTINCT lang, ',' ORDER BY lang) AS members FROM pred GROUP BY 1)
SELECT members, count(*) AS n_groups, string_agg(source, ',' ORDER BY source) AS sources FROM s GROUP BY 1
"""


def q_macro_and_worst(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean over sources of the error share, and the worst source."""
    each = predictions(spark, sf_dir).groupBy("lang", "source").agg(F.avg(((F.col("p") > 0.5).cast("int") != F.col("y")).cast("int")).alias("risk"))
    return each.groupBy("lang").agg(
        F.count("*").alias("n_sources"), F.round(F.avg("risk"), 6).alias("macro"), F.round(F.max("risk"), 6).alias("worst"),
        F.max(F.struct("risk", "source")).getField("source").alias("worst_source"),
    )


SQL_MACRO = P + """
, e AS (SELECT lang, source, avg(((p > 0.5)::INT <> y)::INT) AS risk FROM pred GROUP BY 1, 2)
SELECT lang, count(*) AS n_sources, round(avg(risk), 6) AS macro, round(max(risk), 6) AS worst, max({'r': risk, 's': source}).s AS worst_source FROM e GROUP BY 1
"""

QUERIES = {
    "confusion": (q_confusion, SQL_CONFUSION),
    "auroc": (q_auroc, SQL_AUROC),
    "cliffs_delta": (q_cliffs_delta, SQL_CLIFF),
    "tpr_at_fpr": (q_tpr_at_fpr, SQL_TPR),
    "tie_safe_bins": (q_tie_safe_bins, BINS + "SELECT lang, bin, n, round(mean_score, 6) AS mean_score, round(share, 6) AS share FROM g"),
    "calibration": (q_calibration, SQL_CALIBRATION),
    "risk_coverage": (q_risk_coverage, SQL_RISK),
    "icc": (q_icc, SQL_ICC),
    "seed_medians": (q_seed_medians, SQL_MEDIANS),
    "subgroup_shares": (q_subgroups, SQL_SUBGROUPS),
    "identical_groups": (q_identical_groups, SQL_IDENTICAL),
    "macro_and_worst": (q_macro_and_worst, SQL_MACRO),
}
