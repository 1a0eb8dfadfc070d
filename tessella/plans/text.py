"""Queries over text: segmentation, counters, repeats, boilerplate, similarity and perturbations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.functions import hashing as H
from tessella.functions import text as T
from tessella.operators.graph import connected_components
from tessella.operators.ranks import strict_percentile, tercile_score
from tessella.operators.repeats import boilerplate, repeat_scan, strip_boilerplate
from tessella.operators.similarity import jaccard_join
from tessella.sources import table


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


# SQL spelling of the functions of tessella.functions.text
WORDS = r"list_filter(regexp_split_to_array({0}, '[ \t\n\x0B\f\r]+'), lambda w: w <> '')"
NORMAL = r"trim(regexp_replace(regexp_replace(lower({0}), '[!-/:-@\[-`{{-~]+', ' ', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g'))"
SENTENCES = (
    r"list_filter(list_transform(regexp_split_to_array(regexp_replace({0}, '([.!?])[ \t\n\x0B\f\r]+', '\1' || chr(10), 'g'), '\n+'), "
    r"lambda s: trim(s, ' ' || chr(9) || chr(13))), lambda s: s <> '' AND length(s) >= {1})"
)
SHINGLES = (
    "CASE WHEN len({0}) = 0 THEN [] WHEN len({0}) < {1} THEN [array_to_string({0}, ' ')] "
    "ELSE list_transform(range(1, (len({0}) - {1} + 2)::BIGINT), lambda i: array_to_string({0}[i : i + {1} - 1], ' ')) END"
)


def q_strict_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "lang", "source", F.size(T.words(F.col("text"))).cast("long").alias("n_words"))
    ranked = strict_percentile(docs, "n_words", ["source"], "percentile")
    return ranked.groupBy("lang").agg(
        F.count("*").alias("n_docs"),
        F.sum("n_words").alias("n_words"),
        F.round(F.avg(tercile_score(F.col("percentile"))), 6).alias("mean_score"),
    )


SQL_STRICT_PERCENTILE = rf"""
WITH d AS (SELECT doc_id, lang, source, len({WORDS.format("text")}) AS n_words FROM documents),
r AS (
  SELECT *, (rank() OVER (PARTITION BY source ORDER BY n_words) - 1)::DOUBLE / count(*) OVER (PARTITION BY source) AS p FROM d
)
SELECT lang, count(*) AS n_docs, sum(n_words)::BIGINT AS n_words,
       round(avg(CASE WHEN p < 1.0/3 THEN 0.0 WHEN p < 2.0/3 THEN 0.5 ELSE 1.0 END), 6) AS mean_score
FROM r GROUP BY lang
"""


def q_repeat_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeat_scan(documents(spark, sf_dir), "doc_id", "text")
    return found.withColumn("repeat_share", F.round("repeat_share", 6))


SQL_REPEAT_SCAN = rf"""
WITH s AS (
  SELECT doc_id, unnest(x) AS s, generate_subscripts(x, 1) AS pos
  FROM (SELECT doc_id, {SENTENCES.format("text", 40)} AS x FROM documents)
), n AS (
  SELECT *, count(*) OVER (PARTITION BY doc_id, s) AS n, coalesce(lag(s) OVER (PARTITION BY doc_id ORDER BY pos) = s, false) AS adj FROM s
), i AS (SELECT *, sum(CASE WHEN n > 1 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM n),
r AS (SELECT doc_id, island, count_if(n > 1) AS run FROM i GROUP BY 1, 2),
l AS (SELECT doc_id, max(run) AS longest_run FROM r GROUP BY 1),
k AS (SELECT doc_id, count(*) AS n_kinds FROM (SELECT doc_id, s FROM n WHERE n > 1 GROUP BY 1, 2) GROUP BY 1)
SELECT doc_id, count(*) AS n_sentences, count_if(n > 1)::BIGINT AS n_repeated, round(count_if(n > 1) / count(*), 6) AS repeat_share,
       any_value(coalesce(n_kinds, 0))::BIGINT AS n_kinds, max(n) AS most_copies, any_value(longest_run)::BIGINT AS longest_run,
       coalesce(count_if(adj), 0)::BIGINT AS n_adjacent
FROM n JOIN l USING (doc_id) LEFT JOIN k USING (doc_id) GROUP BY doc_id
"""


def q_boilerplate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boilerplate(documents(spark, sf_dir), "doc_id", "text", "source", share=0.05).select("source", "line", "n_docs", "n_source")


BOILER = r"""
WITH l AS (SELECT DISTINCT doc_id, source, trim(unnest(string_split(text, chr(10))), ' ' || chr(9)) AS line FROM documents),
c AS (SELECT source, line, count(*) AS n_docs FROM l WHERE line <> '' GROUP BY 1, 2),
z AS (SELECT source, count(*) AS n_source FROM documents GROUP BY 1),
b AS (SELECT source, line, n_docs, n_source FROM c JOIN z USING (source) WHERE n_docs >= greatest(3.0, 0.05 * n_source))
"""


def q_strip_boilerplate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    lines = boilerplate(docs, "doc_id", "text", "source", share=0.05)
    out = strip_boilerplate(docs, lines, "text", "source")
    return out.select("doc_id", F.length("text").cast("long").alias("n_left"), F.md5("text").alias("digest"))


SQL_STRIP = (
    BOILER
    + r"""
, d AS (SELECT source, list(line) AS x FROM b GROUP BY 1),
t AS (
  SELECT doc_id, array_to_string(list_filter(string_split(text, chr(10)),
         lambda q: NOT list_contains(coalesce(x, []), trim(q, ' ' || chr(9)))), chr(10)) AS t
  FROM documents LEFT JOIN d USING (source)
)
SELECT doc_id, length(t)::BIGINT AS n_left, md5(t) AS digest FROM t
"""
)


def q_surface_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.size(T.words(F.col("text")))
    counts = [F.round(F.regexp_count("text", F.lit(p)) * 1000 / F.greatest(n, F.lit(1)), 6).alias(f"{k}_per_1000") for k, p in T.SURFACE.items()]
    return documents(spark, sf_dir).select("doc_id", *counts)


SQL_SURFACE = (
    "SELECT doc_id, "
    + ", ".join(
        f"round(len(regexp_extract_all(text, '{p}')) * 1000 / greatest(len({WORDS.format('text')}), 1), 6) AS {k}_per_1000" for k, p in T.SURFACE.items()
    )
    + " FROM documents"
)


def q_first_failing_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.size(T.words(F.col("text")))
    copies = F.row_number().over(W.partitionBy(F.md5("text")).orderBy("doc_id"))
    reason = F.when(n < 50, "short").when(n > 3000, "long").when(T.letter_share(F.col("text"), "[a-zA-Z]") < 0.97, "script")
    df = documents(spark, sf_dir).withColumn("copy", copies).select(reason.when(F.col("copy") > 1, "duplicate").otherwise("kept").alias("reason"), "n_chars")
    return df.groupBy("reason").agg(F.count("*").alias("n_docs"), F.sum("n_chars").alias("n_chars"))


SQL_REASON = rf"""
WITH d AS (
  SELECT len({WORDS.format("text")}) AS n, len(regexp_extract_all(text, '[a-zA-Z]')) AS a, len(regexp_extract_all(text, '\p{{L}}')) AS l, n_chars,
         row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS copy
  FROM documents
)
SELECT CASE WHEN n < 50 THEN 'short' WHEN n > 3000 THEN 'long' WHEN l > 0 AND a / l < 0.97 THEN 'script' WHEN copy > 1 THEN 'duplicate' ELSE 'kept' END AS reason,
       count(*) AS n_docs, sum(n_chars)::BIGINT AS n_chars
FROM d GROUP BY 1
"""


def q_hash_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return documents(spark, sf_dir).select(
        "doc_id", H.sha256_hex(t).alias("sha256"), H.sha256_hex(t, 16).alias("sha256_16"), H.sha1_hex(t).alias("sha1_20"), H.md5_int(t).alias("md5_int")
    )


SQL_HASH = """
SELECT doc_id, sha256(text) AS sha256, substr(sha256(text), 1, 16) AS sha256_16, substr(sha1(text), 1, 20) AS sha1_20,
       ('0x' || substr(md5(text), 1, 8))::BIGINT AS md5_int
FROM documents
"""


def q_shingles(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = T.shingles(T.words(T.normalised(F.col("text"))), 5)
    return documents(spark, sf_dir).select("doc_id", F.size(s).cast("long").alias("n_shingles"), F.size(F.array_distinct(s)).cast("long").alias("n_distinct"))


SQL_SHINGLES = rf"""
WITH w AS (SELECT doc_id, {WORDS.format(NORMAL.format("text"))} AS w FROM documents),
s AS (SELECT doc_id, {SHINGLES.format("w", 5)} AS s FROM w)
SELECT doc_id, len(s)::BIGINT AS n_shingles, len(list_distinct(s))::BIGINT AS n_distinct FROM s
"""


def q_similarity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_join(documents(spark, sf_dir), "doc_id", "text")
    return found.select("left_id", "right_id", F.round("jaccard", 6).alias("jaccard"))


SQL_SIMILARITY = rf"""
WITH w AS (SELECT doc_id, {WORDS.format(NORMAL.format("text"))} AS w FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct({SHINGLES.format("w", 5)})) AS s FROM w),
c AS (SELECT s, min(doc_id) AS id FROM s WHERE len(s) > 0 GROUP BY s),
e AS (SELECT id, len(s) AS n, unnest(s) AS x FROM c),
p AS (SELECT a.id AS l, b.id AS r, count(*) AS common, any_value(a.n) AS na, any_value(b.n) AS nb FROM e a JOIN e b USING (x) WHERE a.id < b.id GROUP BY 1, 2)
SELECT l AS left_id, r AS right_id, round(common / (na + nb - common), 6) AS jaccard FROM p WHERE common / (na + nb - common) >= 0.8
UNION ALL
SELECT id, doc_id, 1.0 FROM s JOIN c USING (s) WHERE doc_id <> id
"""


def q_duplicate_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = jaccard_join(documents(spark, sf_dir), "doc_id", "text", forest=True).select("left_id", "right_id")  # equal texts have equal sets
    return connected_components(edges, "left_id", "right_id").select(F.col("node").alias("doc_id"), F.col("component").alias("cluster_id"))


SQL_CLUSTERS = rf"""
WITH RECURSIVE pairs AS ({SQL_SIMILARITY}),
edges AS (SELECT left_id AS a, right_id AS b FROM pairs UNION SELECT right_id, left_id FROM pairs),
reach AS (SELECT a AS node, a AS seen FROM edges UNION SELECT reach.node, edges.b FROM reach JOIN edges ON reach.seen = edges.a)
SELECT node AS doc_id, min(seen) AS cluster_id FROM reach GROUP BY node
"""


def q_lexical_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = T.words(T.normalised(F.col("text")))
    docs = documents(spark, sf_dir).select("doc_id", w.alias("w"))
    counts = docs.select("doc_id", F.explode("w").alias("x")).groupBy("doc_id", "x").agg(F.count("*").alias("n"))
    hapax = counts.groupBy("doc_id").agg(F.count("*").alias("n_types"), F.count_if(F.col("n") == 1).alias("n_hapax"))
    return docs.select("doc_id", F.round(T.mattr(F.col("w")), 6).alias("mattr")).join(hapax, "doc_id").withColumn(
        "hapax_share", F.round(F.col("n_hapax") / F.col("n_types"), 6)
    )


SQL_DIVERSITY = rf"""
WITH w AS (SELECT doc_id, {WORDS.format(NORMAL.format("text"))} AS w FROM documents),
m AS (
  SELECT doc_id, CASE WHEN len(w) < 50 THEN len(list_distinct(w)) / len(w)
    ELSE list_sum(list_transform(range(1, (len(w) - 48)::BIGINT), lambda i: len(list_distinct(w[i : i + 49])))) / ((len(w) - 49) * 50) END AS m
  FROM w
), c AS (SELECT doc_id, x, count(*) AS n FROM (SELECT doc_id, unnest(w) AS x FROM w) GROUP BY 1, 2),
h AS (SELECT doc_id, count(*) AS n_types, count_if(n = 1)::BIGINT AS n_hapax FROM c GROUP BY 1)
SELECT doc_id, round(m, 6) AS mattr, n_types, n_hapax, round(n_hapax / n_types, 6) AS hapax_share FROM m JOIN h USING (doc_id)
"""


def q_sentence_rhythm(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = documents(spark, sf_dir).select("doc_id", F.explode(T.sentences(F.col("text"))).alias("s")).select("doc_id", F.size(T.words(F.col("s"))).alias("n"))
    return each.groupBy("doc_id").agg(
        F.count("*").alias("n_sentences"),
        F.round(F.avg("n"), 6).alias("mean_length"),
        F.round(F.stddev_samp("n"), 6).alias("sd_length"),
        F.round(F.stddev_samp("n") / F.avg("n"), 6).alias("cv_length"),
        (F.max("n") - F.min("n")).cast("long").alias("length_range"),
        F.count_if(F.col("n").between(10, 20)).alias("n_middle"),
    )


SQL_RHYTHM = rf"""
WITH s AS (SELECT doc_id, unnest({SENTENCES.format("text", 0)}) AS s FROM documents),
n AS (SELECT doc_id, len({WORDS.format("s")}) AS n FROM s)
SELECT doc_id, count(*) AS n_sentences, round(avg(n), 6) AS mean_length, round(stddev_samp(n), 6) AS sd_length,
       round(stddev_samp(n) / avg(n), 6) AS cv_length, (max(n) - min(n))::BIGINT AS length_range, count_if(n BETWEEN 10 AND 20)::BIGINT AS n_middle
FROM n GROUP BY doc_id
"""


def q_perturbations(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    forms = {
        "dashes": T.dashes_to_commas(t), "markdown": T.without_markdown(t), "headings": T.without_headings(t), "punctuation": T.plain_punctuation(t),
        "shortened": T.shortened(t), "expanded": T.expanded(t),
    }
    return documents(spark, sf_dir).select("doc_id", *[F.md5(x).alias(k) for k, x in forms.items()])


SQL_PERTURBATIONS = rf"""
WITH s AS (SELECT doc_id, text, {SENTENCES.format("text", 0)} AS s FROM documents)
SELECT doc_id, md5(regexp_replace(text, ' [—–-] ', ', ', 'g')) AS dashes,
  md5(regexp_replace(regexp_replace(text, '\*\*([^*\n]+)\*\*', '\1', 'g'), '(?m)^#{{1,6}} +', '', 'g')) AS markdown,
  md5(array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(x, '^#{{1,6}} ')), chr(10))) AS headings,
  md5(regexp_replace(regexp_replace(text, '[!]+', '.', 'g'), '[;]', ',', 'g')) AS punctuation,
  md5(array_to_string(list_filter(s, lambda x, i: i % 4 <> 0), ' ')) AS shortened,
  md5(array_to_string(list_transform(s, lambda x, i: CASE WHEN i % 4 = 0 THEN x || ' That is worth noting.' ELSE x END), ' ')) AS expanded
FROM s
"""


def q_brief_echo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of an item's word pairs that a document has, where there are any."""
    pairs = lambda c: F.array_distinct(T.shingles(T.words(T.normalised(c)), 2))
    items = table(spark, sf_dir, "benchmark").select("item_id", pairs(F.col("text")).alias("b"))
    each = items.select("item_id", F.size("b").alias("n"), F.explode("b").alias("x"))
    docs = documents(spark, sf_dir).select("doc_id", F.explode(pairs(F.col("text"))).alias("x"))
    both = docs.join(each, "x").groupBy("doc_id", "item_id").agg(F.count("*").alias("n_shared"), F.max("n").alias("n"))
    return both.select("doc_id", "item_id", "n_shared", F.round(F.col("n_shared") / F.col("n"), 6).alias("echo")).filter("echo >= 0.5")


SQL_ECHO = rf"""
WITH b AS (SELECT item_id, list_distinct({SHINGLES.format("w", 2)}) AS b FROM (SELECT item_id, {WORDS.format(NORMAL.format("text"))} AS w FROM benchmark)),
d AS (SELECT doc_id, unnest(list_distinct({SHINGLES.format("w", 2)})) AS x FROM (SELECT doc_id, {WORDS.format(NORMAL.format("text"))} AS w FROM documents)),
e AS (SELECT item_id, len(b) AS n, unnest(b) AS x FROM b),
j AS (SELECT doc_id, item_id, count(*) AS n_shared, max(n) AS n FROM d JOIN e USING (x) GROUP BY 1, 2)
SELECT doc_id, item_id, n_shared, round(n_shared / n, 6) AS echo FROM j WHERE round(n_shared / n, 6) >= 0.5
"""


def q_shared_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: sentences also found in another document of its language, and their share."""
    each = documents(spark, sf_dir).select("doc_id", "lang", F.explode(T.sentences(F.col("text"), 30)).alias("s")).withColumn("s", T.normalised(F.col("s")))
    # a sentence's first and last document tell whether another one has it: no pairs are made
    known = each.groupBy("lang", "s").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).filter("a <> b")
    flagged = each.join(known, ["lang", "s"], "left")
    return flagged.groupBy("doc_id").agg(
        F.count("*").alias("n_sentences"), F.count("a").alias("n_shared"), F.round(F.count("a") / F.count("*"), 6).alias("shared")
    )


SQL_SHARED = rf"""
WITH s AS (SELECT doc_id, lang, {NORMAL.format("s")} AS s FROM (SELECT doc_id, lang, unnest({SENTENCES.format("text", 30)}) AS s FROM documents)),
k AS (SELECT lang, s, count(DISTINCT doc_id) AS n FROM s GROUP BY 1, 2)
SELECT doc_id, count(*) AS n_sentences, count_if(n > 1)::BIGINT AS n_shared, round(count_if(n > 1) / count(*), 6) AS shared FROM s JOIN k USING (lang, s) GROUP BY 1
"""


def q_novel_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences that add no word to those before them."""
    each = documents(spark, sf_dir).select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "s"))
    w = each.select("doc_id", "pos", F.explode(T.words(T.normalised(F.col("s")))).alias("w"))
    first = w.withColumn("first", F.min("pos").over(W.partitionBy("doc_id", "w")))
    by = first.groupBy("doc_id", "pos").agg(F.max("first").alias("newest"))
    return by.groupBy("doc_id").agg(F.count("*").alias("n_sentences"), F.count_if(F.col("newest") < F.col("pos")).alias("n_without_new_word"))


SQL_NOVEL = rf"""
WITH s AS (SELECT doc_id, unnest(x) AS s, generate_subscripts(x, 1) AS pos FROM (SELECT doc_id, {SENTENCES.format("text", 0)} AS x FROM documents)),
w AS (SELECT doc_id, pos, unnest({WORDS.format(NORMAL.format("s"))}) AS w FROM s),
f AS (SELECT *, min(pos) OVER (PARTITION BY doc_id, w) AS first FROM w),
b AS (SELECT doc_id, pos, max(first) AS newest FROM f GROUP BY 1, 2)
SELECT doc_id, count(*) AS n_sentences, count_if(newest < pos)::BIGINT AS n_without_new_word FROM b GROUP BY 1
"""


def q_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of artifact patterns in pages: placeholders, self-reference, address, and bold or list marks."""
    html = F.col("html")
    count = lambda p: F.regexp_count(html, F.lit(p)).cast("long")
    return table(spark, sf_dir, "pages").select(
        "page_id", count(r"\[[A-Za-z ]+\]|\{[A-Za-z_]+\}").alias("placeholders"), count(r"(?i)as an ai|i cannot|language model").alias("residue"),
        (count(r"(?i)dear reader|hello[,!]") > 0).cast("int").alias("address"), count(r"(?i)<(?:b|strong)>").alias("bold"), count(r"(?m)^ *[-*] ").alias("bullets"),
    )


SQL_ARTIFACTS = r"""
SELECT page_id, len(regexp_extract_all(html, '\[[A-Za-z ]+\]|\{[A-Za-z_]+\}'))::BIGINT AS placeholders,
  len(regexp_extract_all(html, '(?i)as an ai|i cannot|language model'))::BIGINT AS residue,
  (len(regexp_extract_all(html, '(?i)dear reader|hello[,!]')) > 0)::INT AS address,
  len(regexp_extract_all(html, '(?i)<(?:b|strong)>'))::BIGINT AS bold, len(regexp_extract_all(html, '(?m)^ *[-*] '))::BIGINT AS bullets
FROM pages
"""

QUERIES = {
    "strict_percentile": (q_strict_percentile, SQL_STRICT_PERCENTILE),
    "repeat_scan": (q_repeat_scan, SQL_REPEAT_SCAN),
    "boilerplate": (q_boilerplate, BOILER + "SELECT source, line, n_docs, n_source FROM b"),
    "strip_boilerplate": (q_strip_boilerplate, SQL_STRIP),
    "surface_counters": (q_surface_counters, SQL_SURFACE),
    "first_failing_reason": (q_first_failing_reason, SQL_REASON),
    "hash_family": (q_hash_family, SQL_HASH),
    "shingles": (q_shingles, SQL_SHINGLES),
    "similarity_join": (q_similarity_join, SQL_SIMILARITY),
    "duplicate_clusters": (q_duplicate_clusters, SQL_CLUSTERS),
    "lexical_diversity": (q_lexical_diversity, SQL_DIVERSITY),
    "sentence_rhythm": (q_sentence_rhythm, SQL_RHYTHM),
    "perturbations": (q_perturbations, SQL_PERTURBATIONS),
    "brief_echo": (q_brief_echo, SQL_ECHO),
    "shared_sentences": (q_shared_sentences, SQL_SHARED),
    "novel_sentences": (q_novel_sentences, SQL_NOVEL),
    "artifact_counters": (q_artifacts, SQL_ARTIFACTS),
}
