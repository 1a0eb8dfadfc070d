"""Queries over cleaning steps and derived scalars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import hashing as H
from tessella.functions import prep as P
from tessella.functions import text as T
from tessella.operators.models import Classifier
from tessella.plans.text import NORMAL, WORDS
from tessella.sources import table


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def q_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = P.without_inline(P.without_counters(T.without_lines(P.unified(F.col("text")), T.PLATFORM_LINES)))
    return documents(spark, sf_dir).select("doc_id", F.length(text).cast("long").alias("n_left"), F.md5(text).alias("digest"), "text").drop("text")


def q_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks by kind, and words of the prose and full profiles."""
    df = documents(spark, sf_dir).select("doc_id", P.blocks(F.col("text")).alias("b"))
    size = lambda profile: F.size(T.words(P.rendered(F.col("b"), profile))).cast("long")
    return df.select("doc_id", F.size("b").cast("long").alias("n_blocks"), size("prose").alias("prose_words"), size("full").alias("full_words"))


def q_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = T.words(T.normalised(F.col("text")))
    return documents(spark, sf_dir).select("doc_id", F.round(P.mtld(w), 6).alias("mtld"))


COEFFICIENTS = [(7 * i * i + 1_000_003, 13 * i + 11) for i in range(16)]


def q_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashes = F.transform(F.array_distinct(T.words(T.normalised(F.col("text")))), H.md5_int)
    signature = T.let(hashes, lambda h: P.minhash(h, COEFFICIENTS))
    return documents(spark, sf_dir).select("doc_id", F.array_join(signature.cast("array<string>"), ",").alias("signature"))


SQL_MINHASH = rf"""
WITH h AS (SELECT doc_id, list_transform(list_distinct({WORDS.format(NORMAL.format("text"))}), lambda w: ('0x' || substr(md5(w), 1, 8))::BIGINT) AS h FROM documents),
c AS (SELECT unnest({[a for a, _ in COEFFICIENTS]}) AS a, unnest({[b for _, b in COEFFICIENTS]}) AS b, unnest(range({len(COEFFICIENTS)})) AS i),
m AS (SELECT doc_id, i, list_min(list_transform(h, lambda x: (a * x + b) % 2147483647)) AS m FROM h, c)
SELECT doc_id, string_agg(m::VARCHAR, ',' ORDER BY i) AS signature FROM m GROUP BY 1
"""


def q_score_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers made from the events: their status and score."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    answer = F.when(k % 7 == 0, "").when(k % 7 == 1, "no json").when(k % 7 == 2, F.concat(F.lit('{"score": "'), k, F.lit('"}'))).otherwise(F.concat(F.lit('{"score": '), k % 14 - 1, F.lit("}")))
    status, score = P.score_status(answer)
    return e.select(status.alias("status"), score.alias("score")).groupBy("status").agg(F.count("*").alias("n"), F.sum("score").alias("total"))


SQL_STATUS = """
WITH e AS (SELECT (props::JSON ->> '$.k')::INT AS k FROM events),
s AS (SELECT k % 7 AS r, CASE WHEN k % 7 = 2 THEN k ELSE k % 14 - 1 END AS v FROM e),
t AS (SELECT CASE WHEN r = 0 THEN 'refusal' WHEN r = 1 THEN 'invalid_json' WHEN v NOT BETWEEN 0 AND 10 THEN 'out_of_range' ELSE 'ok' END AS status, v FROM s)
SELECT status, count(*) AS n, sum(CASE WHEN status = 'ok' THEN v END)::BIGINT AS total FROM t GROUP BY 1
"""


def q_spline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spline terms of supplier balances with knots at 10, 50 and 90 %, summed up by nation parity."""
    s = table(spark, sf_dir, "supplier")
    knots = tuple(s.agg(F.percentile("s_acctbal", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))).first()[0])  # three numbers
    return s.groupBy((F.col("s_nationkey") % 2).alias("odd")).agg(F.round(F.sum(P.spline(F.col("s_acctbal"), knots)), 3).alias("total"))


SQL_SPLINE = """
WITH k AS (SELECT quantile_cont(s_acctbal, 0.1) AS a, quantile_cont(s_acctbal, 0.5) AS b, quantile_cont(s_acctbal, 0.9) AS c FROM supplier)
SELECT s_nationkey % 2 AS odd, round(sum((greatest(s_acctbal - a, 0) ** 3 - greatest(s_acctbal - b, 0) ** 3 * (c - a) / (c - b) + greatest(s_acctbal - c, 0) ** 3 * (b - a) / (c - b)) / (c - a) ** 2), 3) AS total
FROM supplier, k GROUP BY 1
"""


def q_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document scored by a linear model on counters, fitted on the documents whose key is of the other parity."""
    share = lambda p: (F.regexp_count("text", F.lit(p)) / F.greatest(F.length("text"), F.lit(1))).cast("double")
    docs = documents(spark, sf_dir).select("doc_id", share(r"[#*$%&|]").alias("symbols"), share(r"[A-Z]").alias("capitals"), share(r"[.]").alias("stops"), F.log1p("n_chars").alias("length"))
    rows = docs.join(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("y")), "doc_id")
    odd = F.pmod("doc_id", F.lit(2)) == 1
    scored = lambda train, held: Classifier(["symbols", "capitals", "stops", "length"]).fit(rows.filter(train), "y").score(rows.filter(held), "p")
    return scored(~odd, odd).unionByName(scored(odd, ~odd)).select("doc_id", "y", F.round("p", 4).alias("p"))


QUERIES = {
    "cleaning_chain": (q_clean, None),
    "block_profiles": (q_blocks, None),
    "mtld": (q_diversity, None),
    "minhash": (q_minhash, SQL_MINHASH),
    "score_status": (q_score_status, SQL_STATUS),
    "spline_terms": (q_spline, SQL_SPLINE),
    "quality_classifier": (q_classifier, None),
}
