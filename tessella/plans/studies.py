"""Queries of corpus studies: lexicons, discourse, selections, gates and small sources, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.functions import hashing as H
from tessella.functions import text as T
from tessella.sources import table

#: A small lexicon: word and score.
LEXICON = {"the": 1, "and": 2, "with": 3, "les": -1, "dans": 2, "und": 1, "nicht": -2, "mit": 3, "que": -1, "los": 2, "para": 3, "was": -3}


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang", "source", "n_chars")
    return df.withColumn("w", F.array_remove(F.split(F.lower("text"), r"[^\p{L}]+"), ""))


D = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, lang, source, n_chars, regexp_extract_all(lower(coalesce(text, '')), '\p{L}+') AS w FROM documents)
"""


def share(a: Column, b: Column, times: float = 1.0) -> Column:
    return F.round(F.when(b > 0, times * a / b), 6)


def q_lexicon_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean score of the words a lexicon knows, its coverage, hits per 1,000 words and their negative share."""
    known = spark.createDataFrame(list(LEXICON.items()), "word string, score int")
    df = docs(spark, sf_dir).select("doc_id", F.size("w").alias("n"), F.explode_outer("w").alias("word"))
    df = df.join(known, "word", "left").groupBy("doc_id", "n").agg(F.count("score").alias("hits"), F.sum("score").alias("total"), F.count_if(F.col("score") < 0).alias("down"))
    hits, n = F.col("hits"), F.col("n")
    return df.select("doc_id", "hits", share(F.col("total"), hits).alias("mean_score"), share(hits, n).alias("coverage"), share(hits, n, 1000).alias("per_1000"), share(F.col("down"), hits).alias("negative"))


SQL_LEXICON = D + f"""
, lex(word, score) AS (VALUES {", ".join(str(x) for x in LEXICON.items())}),
e AS (SELECT doc_id, len(w) AS n, unnest(w) AS word FROM d),
g AS (SELECT doc_id, count(score) AS hits, sum(score) AS total, count(*) FILTER (score < 0) AS down FROM e LEFT JOIN lex USING (word) GROUP BY 1)
SELECT doc_id, coalesce(hits, 0) AS hits, round(CASE WHEN hits > 0 THEN total / hits END, 6) AS mean_score, round(CASE WHEN len(w) > 0 THEN hits / len(w) END, 6) AS coverage,
       round(CASE WHEN len(w) > 0 THEN 1000.0 * hits / len(w) END, 6) AS per_1000, round(CASE WHEN hits > 0 THEN down / hits END, 6) AS negative
FROM d LEFT JOIN g USING (doc_id)
"""


def q_hdd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HD-D: the chance of each type in a draw of 42 words, summed and divided by 42; null for shorter texts."""
    counts = docs(spark, sf_dir).filter(F.size("w") >= 42).select("doc_id", F.size("w").alias("n"), F.explode("w").alias("word")).groupBy("doc_id", "n", "word").agg(F.count("*").alias("c"))
    many = counts.groupBy("doc_id", "n", "c").agg(F.count("*").alias("types"))
    left = F.col("n") - F.col("c")
    none = F.aggregate(F.sequence(F.lit(0), F.lit(41)), F.lit(0.0), lambda a, k: a + F.ln(F.greatest(left - k, F.lit(1)) / (F.col("n") - k)))
    chance = 1 - F.when(left < 42, 0.0).otherwise(F.exp(none))
    found = many.groupBy("doc_id").agg(F.round(F.sum(F.col("types") * chance) / 42, 6).alias("hdd"))
    return docs(spark, sf_dir).select("doc_id").join(found, "doc_id", "left")


SQL_HDD = D + r"""
, c AS (SELECT doc_id, n, word, count(*) AS c FROM (SELECT doc_id, len(w) AS n, unnest(w) AS word FROM d WHERE len(w) >= 42) GROUP BY ALL),
p AS (SELECT doc_id, 1 - CASE WHEN n - c < 42 THEN 0 ELSE exp(list_sum(list_transform(range(42), lambda k: ln((n - c - k) / (n - k))))) END AS chance FROM c)
SELECT doc_id, round(sum(chance) / 42, 6) AS hdd FROM d LEFT JOIN p USING (doc_id) GROUP BY 1
"""


def q_lexical_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that occur once among types, function words per 1,000, words with a nominal ending per 100."""
    e = docs(spark, sf_dir).select("doc_id", F.explode("w").alias("word")).groupBy("doc_id", "word").agg(F.count("*").alias("c"))
    known, noun = F.col("word").isin(list(LEXICON)), F.col("word").rlike("(tion|ung|ment|dad)$")
    g = e.groupBy("doc_id").agg(F.count("*").alias("types"), F.count_if(F.col("c") == 1).alias("hapax"), F.sum("c").alias("n"), F.sum(F.when(known, F.col("c")).otherwise(0)).alias("f"), F.sum(F.when(noun, F.col("c")).otherwise(0)).alias("s"))
    return g.select("doc_id", "hapax", share(F.col("hapax"), F.col("types")).alias("hapax_share"), share(F.col("f"), F.col("n"), 1000).alias("function_words"), share(F.col("s"), F.col("n"), 100).alias("nominal"))


SQL_PROFILE = D + f"""
, e AS (SELECT doc_id, word, count(*) AS c FROM (SELECT doc_id, unnest(w) AS word FROM d) GROUP BY ALL),
g AS (SELECT doc_id, count(*) AS types, count(*) FILTER (c = 1) AS hapax, sum(c) AS n, coalesce(sum(c) FILTER (word IN {tuple(LEXICON)}), 0) AS f,
             coalesce(sum(c) FILTER (regexp_matches(word, '(tion|ung|ment|dad)$')), 0) AS s FROM e GROUP BY 1)
SELECT doc_id, hapax, round(hapax / types, 6) AS hapax_share, round(1000.0 * f / n, 6) AS function_words, round(100.0 * s / n, 6) AS nominal FROM g
"""

SENTENCE = r"[^.!?\n]+[.!?]*"


def q_openings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences whose first two words open another sentence of the text as well, and questions per 1,000 words."""
    s = docs(spark, sf_dir).select("doc_id", F.size("w").alias("n"), F.explode(F.regexp_extract_all("text", F.lit(SENTENCE), F.lit(0))).alias("s"))
    first = F.slice(F.array_remove(F.split(F.lower("s"), r"[^\p{L}]+"), ""), 1, 2)
    s = s.withColumn("first", F.array_join(first, " ")).filter("first like '% %'")
    g = s.groupBy("doc_id", "n", "first").agg(F.count("*").alias("c"), F.count_if(F.col("s").endswith("?")).alias("q"))
    g = g.groupBy("doc_id", "n").agg(F.sum("c").alias("n_sentences"), F.sum(F.when(F.col("c") > 1, F.col("c")).otherwise(0)).alias("repeated"), F.sum("q").alias("questions"))
    return g.select("doc_id", "n_sentences", "repeated", share(F.col("repeated"), F.col("n_sentences")).alias("repeated_share"), share(F.col("questions"), F.col("n"), 1000).alias("questions_per_1000"))


SQL_OPENINGS = D + r"""
, s AS (SELECT doc_id, len(w) AS n, unnest(regexp_extract_all(text, '[^.!?\n]+[.!?]*')) AS s FROM d),
f AS (SELECT *, array_to_string(regexp_extract_all(lower(s), '\p{L}+')[1:2], ' ') AS first FROM s),
g AS (SELECT doc_id, n, first, count(*) AS c, count(*) FILTER (ends_with(s, '?')) AS q FROM f WHERE first LIKE '% %' GROUP BY ALL),
h AS (SELECT doc_id, n, sum(c)::BIGINT AS n_sentences, coalesce(sum(c) FILTER (c > 1), 0)::BIGINT AS repeated, sum(q) AS questions FROM g GROUP BY 1, 2)
SELECT doc_id, n_sentences, repeated, round(repeated / n_sentences, 6) AS repeated_share, round(1000.0 * questions / n, 6) AS questions_per_1000 FROM h
"""


def q_paragraph_rhythm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, sample SD and variation of the paragraphs' words, and three-part enumerations."""
    d = docs(spark, sf_dir)
    p = d.select("doc_id", F.explode(F.split("text", "\n")).alias("p")).select("doc_id", F.size(F.array_remove(F.split(F.lower("p"), r"[^\p{L}]+"), "")).alias("n")).filter("n > 0")
    g = p.groupBy("doc_id").agg(F.count("*").alias("n_paragraphs"), F.avg("n").alias("mean"), F.stddev_samp("n").alias("sd"))
    three = F.regexp_count("text", F.lit(r"\p{L}+, \p{L}+,? (?:and|et|und|y) \p{L}+")).cast("long")
    g = g.select("doc_id", "n_paragraphs", F.round("mean", 6).alias("mean_words"), F.round("sd", 6).alias("sd_words"), F.round(F.col("sd") / F.col("mean"), 6).alias("variation"))
    return d.select("doc_id", three.alias("tricolons")).join(g, "doc_id", "left")


SQL_RHYTHM = D + r"""
, p AS (SELECT doc_id, len(regexp_extract_all(lower(p), '\p{L}+')) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS p FROM d)),
g AS (SELECT doc_id, count(*) AS n_paragraphs, avg(n) AS mean, stddev_samp(n) AS sd FROM p WHERE n > 0 GROUP BY 1)
SELECT doc_id, len(regexp_extract_all(text, '\p{L}+, \p{L}+,? (?:and|et|und|y) \p{L}+')) AS tricolons, n_paragraphs, round(mean, 6) AS mean_words, round(sd, 6) AS sd_words, round(sd / mean, 6) AS variation
FROM d LEFT JOIN g USING (doc_id)
"""

ITEM = r"^(?:[-*•] |[0-9]+[.)] )"


def q_list_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that look like list items, and those of them beside another one (blank lines between do not count)."""
    lines = F.filter(F.split("text", "\n"), lambda x: F.btrim(x) != "")

    def beside(marks: Column) -> Column:
        return F.size(F.filter(F.transform(marks, lambda m, i: m & (F.coalesce(F.get(marks, i - 1), F.lit(False)) | F.coalesce(F.get(marks, i + 1), F.lit(False)))), lambda x: x))

    marks = F.transform(lines, lambda x: x.rlike(ITEM))
    return docs(spark, sf_dir).select("doc_id", F.size(F.filter(marks, lambda m: m)).alias("candidates"), T.let(marks, beside).alias("items"))


SQL_ITEMS = D + r"""
, m AS (SELECT doc_id, list_transform(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''), lambda x: regexp_matches(x, '^(?:[-*•] |[0-9]+[.)] )')) AS m FROM d)
SELECT doc_id, len(list_filter(m, lambda x: x)) AS candidates,
       len(list_filter(range(1, len(m) + 1), lambda i: m[i] AND ((i > 1 AND m[i - 1]) OR (i < len(m) AND m[i + 1])))) AS items
FROM m
"""


def q_keep_first_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without blocks that repeat an earlier block of 40 characters or more, case and outer blanks aside."""

    def kept(blocks: Column) -> Column:
        key = lambda b: F.lower(F.btrim(b))
        keys = F.transform(blocks, key)
        return T.let(keys, lambda k: F.filter(blocks, lambda b, i: (F.length(F.btrim(b)) < 40) | (F.array_position(k, key(b)) == i + 1)))

    blocks = F.split("text", "\n")
    df = docs(spark, sf_dir).select("doc_id", F.size(blocks).alias("n_blocks"), kept(blocks).alias("kept"))
    return df.select("doc_id", "n_blocks", F.size("kept").alias("n_kept"), F.sha2(F.array_join("kept", "\n"), 256).alias("sha256"))


SQL_FIRST = D + r"""
, b AS (SELECT doc_id, string_split(text, chr(10)) AS b FROM d),
k AS (SELECT doc_id, b, list_transform(b, lambda x: lower(trim(x, ' '))) AS k FROM b),
f AS (SELECT doc_id, b, list_transform(list_filter(range(1, len(b) + 1), lambda i: length(trim(b[i], ' ')) < 40 OR list_position(k, k[i]) = i), lambda i: b[i]) AS kept FROM k)
SELECT doc_id, len(b) AS n_blocks, len(kept) AS n_kept, sha256(array_to_string(kept, chr(10))) AS sha256 FROM f
"""


def q_turn_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a turn loses from and adds to the one before it, as multisets."""
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_remove(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}]+"), "").alias("w"))
    words = t.distinct().select("conv_id", "turn", F.explode("w").alias("word")).groupBy("conv_id", "turn", "word").agg(F.count("*").alias("c"))
    before = words.select("conv_id", (F.col("turn") + 1).alias("turn"), "word", F.col("c").alias("b"))
    both = words.join(before, ["conv_id", "turn", "word"], "full").join(t.select("conv_id", "turn").distinct(), ["conv_id", "turn"], "left_semi")
    c, b = F.coalesce("c", F.lit(0)), F.coalesce("b", F.lit(0))
    return both.groupBy("conv_id", "turn").agg(F.sum(F.greatest(b - c, F.lit(0))).alias("lost"), F.sum(F.greatest(c - b, F.lit(0))).alias("extra"))


SQL_TURNS = r"""
WITH t AS (SELECT DISTINCT conv_id, turn, regexp_extract_all(lower(coalesce(text, '')), '\p{L}+') AS w FROM conversations),
x AS (SELECT conv_id, turn, word, count(*) AS c FROM (SELECT conv_id, turn, unnest(w) AS word FROM t) GROUP BY ALL),
y AS (SELECT coalesce(x.conv_id, b.conv_id) AS conv_id, coalesce(x.turn, b.turn + 1) AS turn, coalesce(x.c, 0) AS c, coalesce(b.c, 0) AS b
      FROM x FULL JOIN x b ON x.conv_id = b.conv_id AND x.turn = b.turn + 1 AND x.word = b.word)
SELECT conv_id, turn, sum(greatest(b - c, 0))::BIGINT AS lost, sum(greatest(c - b, 0))::BIGINT AS extra FROM y SEMI JOIN t USING (conv_id, turn) GROUP BY 1, 2
"""


def q_lexicon_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vocabularies of the languages: their size, what all have in common, and what only one has."""
    words = docs(spark, sf_dir).filter("lang is not null").select("lang", F.explode("w").alias("word")).distinct()
    langs = words.select("lang").distinct().count()  # languages, not documents
    n = words.groupBy("word").agg(F.count("*").alias("n"))
    return words.join(n, "word").groupBy("lang").agg(F.count("*").alias("n_words"), F.count_if(F.col("n") == langs).alias("core"), F.count_if(F.col("n") == 1).alias("single"))


SQL_ALGEBRA = D + r"""
, v AS (SELECT DISTINCT lang, unnest(w) AS word FROM d WHERE lang IS NOT NULL), n AS (SELECT word, count(*) AS n FROM v GROUP BY 1)
SELECT lang, count(*) AS n_words, count(*) FILTER (n = (SELECT count(DISTINCT lang) FROM v)) AS core, count(*) FILTER (n = 1) AS single FROM v JOIN n USING (word) GROUP BY 1
"""


def q_entity_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capitalised names, adjoining ones glued, before any line that opens a list of references; per 1,000 words; dates; lengths that texts state."""
    d = docs(spark, sf_dir).withColumn("body", F.regexp_replace("text", r"(?s)(^|\n)(References|Literatur|Bibliographie|Referencias).*$", ""))
    names = F.regexp_count("body", F.lit(r"\p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+)*")).cast("long")
    n = F.size(F.array_remove(F.split(F.lower("body"), r"[^\p{L}]+"), ""))
    dates = F.regexp_count("text", F.lit(r"[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}")).cast("long")
    stated = F.nullif(F.regexp_extract("text", r"([0-9]+) (?:words|mots|Wörter|palabras)", 1), F.lit("")).cast("long")
    return d.select("doc_id", names.alias("names"), share(names, n, 1000).alias("per_1000"), dates.alias("dates"), stated.alias("stated_words"))


SQL_ENTITIES = D + r"""
, b AS (SELECT *, regexp_replace(text, '(?s)(^|\n)(References|Literatur|Bibliographie|Referencias).*$', '') AS body FROM d),
n AS (SELECT *, len(regexp_extract_all(body, '\p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+)*')) AS names, len(regexp_extract_all(lower(body), '\p{L}+')) AS n FROM b)
SELECT doc_id, names, round(CASE WHEN n > 0 THEN 1000.0 * names / n END, 6) AS per_1000,
       len(regexp_extract_all(text, '[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}')) AS dates,
       nullif(regexp_extract(text, '([0-9]+) (?:words|mots|Wörter|palabras)', 1), '')::BIGINT AS stated_words
FROM n
"""


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).drop("w", "text").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")


L = "WITH l AS (SELECT d.doc_id, lang, source, n_chars, quality FROM documents d JOIN labels USING (doc_id))\n"


def q_case_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of low quality, and the first two others of each source that has such a row."""
    df = labelled(spark, sf_dir)
    cases = df.filter("quality = 0")
    clean = df.filter("quality = 1").join(cases.select("source").distinct(), "source", "left_semi")
    nth = F.row_number().over(W.partitionBy("source").orderBy("doc_id"))
    controls = clean.withColumn("nth", nth).filter("nth <= 2")
    return cases.select("doc_id", "source", F.lit("case").alias("role")).unionByName(controls.select("doc_id", "source", F.lit("control").alias("role")))


SQL_CASES = L + r"""
, c AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS nth FROM l WHERE quality = 1 AND source IN (SELECT source FROM l WHERE quality = 0))
SELECT doc_id, source, 'case' AS role FROM l WHERE quality = 0 UNION ALL SELECT doc_id, source, 'control' FROM c WHERE nth <= 2
"""


def q_holdout_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document once for each split that holds it out (by its language, by its source), with the size of the split's test."""
    df = labelled(spark, sf_dir)
    held = df.select("doc_id", "quality", F.explode(F.array(F.concat(F.lit("lang:"), "lang"), F.concat(F.lit("source:"), "source"))).alias("split")).filter("split is not null")
    size = held.groupBy("split").agg(F.count("*").alias("n_test"), F.sum("quality").alias("n_good"))
    return held.join(size, "split").select("doc_id", "split", "n_test", "n_good")


SQL_BRIDGE = L + r"""
, h AS (SELECT doc_id, quality, 'lang:' || lang AS split FROM l WHERE lang IS NOT NULL UNION ALL SELECT doc_id, quality, 'source:' || source FROM l WHERE source IS NOT NULL),
s AS (SELECT split, count(*) AS n_test, sum(quality)::BIGINT AS n_good FROM h GROUP BY 1)
SELECT doc_id, split, n_test, n_good FROM h JOIN s USING (split)
"""


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of three seeds a document."""
    df = labelled(spark, sf_dir).withColumn("seed", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    return df.withColumn("p", H.unit_draw(F.concat_ws("-", "doc_id", "seed")) * 0.5 + F.col("quality") * 0.4)


M = L + """
, m AS (SELECT l.*, seed, (('0x' || substr(md5(doc_id || '-' || seed), 1, 8))::BIGINT % 1000) / 1000.0::DOUBLE * 0.5 + quality * 0.4 AS p FROM l, (VALUES (1), (2), (3)) s(seed))
"""


def q_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of several runs made one a document: their mean, and the decision from 0.5 on."""
    g = members(spark, sf_dir).groupBy("doc_id", "quality").agg(F.avg("p").alias("p"), F.count("*").alias("n_runs"))
    p = F.round("p", 9)
    return g.select("doc_id", "quality", "n_runs", F.round("p", 6).alias("p"), (p >= 0.5).alias("decision"))


SQL_ENSEMBLE = M + "SELECT doc_id, quality, count(*) AS n_runs, round(avg(p), 6) AS p, round(avg(p), 9) >= 0.5 AS decision FROM m GROUP BY 1, 2"


def q_proxy_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall and agreement of a proxy (short texts) with manual labels (low quality)."""
    proxy, manual = F.col("n_chars") < 1000, F.col("quality") == 0
    g = labelled(spark, sf_dir).groupBy("lang").agg(F.count_if(proxy & manual).alias("both"), F.count_if(proxy).alias("proxy"), F.count_if(manual).alias("manual"), F.count_if(proxy == manual).alias("same"), F.count("*").alias("n"))
    c = F.col
    return g.select("lang", share(c("both"), c("proxy")).alias("precision"), share(c("both"), c("manual")).alias("recall"), share(c("same"), c("n")).alias("agreement"))


SQL_PROXY = L + r"""
, g AS (SELECT lang, count(*) FILTER (n_chars < 1000 AND quality = 0) AS b, count(*) FILTER (n_chars < 1000) AS p, count(*) FILTER (quality = 0) AS m, count(*) FILTER ((n_chars < 1000) = (quality = 0)) AS s, count(*) AS n FROM l GROUP BY 1)
SELECT lang, round(CASE WHEN p > 0 THEN b / p END, 6) AS precision, round(CASE WHEN m > 0 THEN b / m END, 6) AS recall, round(s / n, 6) AS agreement FROM g
"""


def q_stable_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of equal normalised words as clusters, each named by the least hash of its members, with its size."""
    d = docs(spark, sf_dir).select("doc_id", F.sha2(F.array_join("w", " "), 256).alias("key"), H.sha1_hex(F.col("doc_id")).alias("h"))
    names = d.groupBy("key").agg(F.min("h").alias("cluster"), F.count("*").alias("size"))
    return d.join(names, "key").select("doc_id", "cluster", "size")


SQL_STABLE = D + r"""
, h AS (SELECT doc_id, sha256(array_to_string(w, ' ')) AS key, substr(sha1(doc_id::VARCHAR), 1, 20) AS h FROM d)
SELECT doc_id, min(h) OVER (PARTITION BY key) AS cluster, count(*) OVER (PARTITION BY key) AS size FROM h
"""


def q_quota_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three documents of each language and quality at most, spread over sources: a source's second comes after all sources' firsts."""
    df = labelled(spark, sf_dir).withColumn("h", H.sha1_hex(F.col("doc_id")))
    df = df.withColumn("turn", F.row_number().over(W.partitionBy("lang", "quality", "source").orderBy("h"))).filter("turn <= 3")
    nth = F.row_number().over(W.partitionBy("lang", "quality").orderBy("turn", "h"))
    return df.withColumn("nth", nth).filter("nth <= 3").select("doc_id", "lang", "quality", "source", "turn", "nth")


SQL_QUOTA = L + r"""
, t AS (SELECT *, substr(sha1(doc_id::VARCHAR), 1, 20) AS h, row_number() OVER (PARTITION BY lang, quality, source ORDER BY substr(sha1(doc_id::VARCHAR), 1, 20)) AS turn FROM l),
n AS (SELECT *, row_number() OVER (PARTITION BY lang, quality ORDER BY turn, h) AS nth FROM t WHERE turn <= 3)
SELECT doc_id, lang, quality, source, turn, nth FROM n WHERE nth <= 3
"""


def q_blind_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled texts under names that do not give their key away, and whether a text itself does."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    leak = F.contains(F.lower("text"), F.lower("source")) | F.coalesce(F.regexp_extract("text", r"\bdoc[_-]?([0-9]+)\b", 1) == F.col("doc_id").cast("string"), F.lit(False))
    return d.select("doc_id", F.concat(F.lit("card-"), H.sha256_hex(F.concat(F.lit("salt-"), "doc_id"), 12)).alias("card"), F.coalesce(leak, F.lit(False)).alias("leaks"))


SQL_CARDS = r"""
SELECT doc_id, 'card-' || substr(sha256('salt-' || doc_id), 1, 12) AS card,
       coalesce(contains(lower(text), lower(source)) OR coalesce(regexp_extract(text, '\bdoc[_-]?([0-9]+)\b', 1) = doc_id::VARCHAR, false), false) AS leaks
FROM documents SEMI JOIN labels USING (doc_id)
"""


def q_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source key with defaults, and the stratum made of language and length."""
    key = F.coalesce(F.nullif("source", F.lit("")), F.nullif("lang", F.lit("")), F.lit("unknown"))
    band = F.when(F.col("n_chars") < 1000, "short").when(F.col("n_chars") < 3000, "middle").otherwise("long")
    digits = F.nullif(F.regexp_extract("source", "([0-9]+)", 1), F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", key.alias("source_key"), F.concat_ws("/", F.coalesce("lang", F.lit("?")), band).alias("stratum"), digits.alias("number"))


SQL_STRATA = r"""
SELECT doc_id, coalesce(nullif(source, ''), nullif(lang, ''), 'unknown') AS source_key,
       coalesce(lang, '?') || '/' || CASE WHEN n_chars < 1000 THEN 'short' WHEN n_chars < 3000 THEN 'middle' ELSE 'long' END AS stratum, nullif(regexp_extract(source, '([0-9]+)', 1), '') AS number
FROM documents
"""


def q_exclusion_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of what exclusion lists take away, list by list in their order: rows found, and rows left."""
    d = docs(spark, sf_dir)
    short = d.filter(F.size("w") < 20).select("doc_id", F.lit(1).alias("step"))
    low = table(spark, sf_dir, "labels").filter("quality = 0").select("doc_id", F.lit(2).alias("step"))
    copies = d.withColumn("first", F.min("doc_id").over(W.partitionBy(F.sha2("text", 256)))).filter("first < doc_id").select("doc_id", F.lit(3).alias("step"))
    first = short.unionByName(low).unionByName(copies).groupBy("doc_id").agg(F.min("step").alias("step"))
    gone = d.select("doc_id").join(first, "doc_id").groupBy("step").agg(F.count("*").alias("n_excluded"))
    total = d.agg(F.count("*").alias("total"))  # one row
    done = F.sum("n_excluded").over(W.orderBy("step"))  # a row a list
    return gone.withColumn("done", done).crossJoin(total).select("step", "n_excluded", (F.col("total") - F.col("done")).alias("n_left"))


SQL_EXCLUSION = D + r"""
, x AS (SELECT doc_id, 1 AS step FROM d WHERE len(w) < 20 UNION ALL SELECT doc_id, 2 FROM labels WHERE quality = 0
        UNION ALL SELECT doc_id, 3 FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS f FROM d) WHERE f < doc_id),
f AS (SELECT doc_id, min(step) AS step FROM x SEMI JOIN d USING (doc_id) GROUP BY 1), g AS (SELECT step, count(*) AS n_excluded FROM f GROUP BY 1)
SELECT step, n_excluded, ((SELECT count(*) FROM d) - sum(n_excluded) OVER (ORDER BY step))::BIGINT AS n_left FROM g
"""


def signed(x: Column, digits: int = 2) -> Column:
    """A number with its sign; the minus is U+2212."""
    return F.concat(F.when(x < 0, "−").otherwise("+"), F.format_string(f"%.{digits}f", F.abs(x)))


def q_report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a report by template: numbers with signs, an interval, a list of headings."""
    g = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.min(F.year("o_orderdate")).alias("lo"), F.max(F.year("o_orderdate")).alias("hi"), F.sort_array(F.collect_set("o_orderstatus")).alias("s"))
    number = signed((F.col("n") % 1000 - 500) / 4)
    line = F.concat(F.col("o_orderpriority"), F.lit(": "), number, F.lit(" ["), F.col("lo").cast("string"), F.lit("; "), F.col("hi").cast("string"), F.lit("] "), F.array_join(F.transform("s", lambda x: F.concat(F.lit("## "), x)), ", "))
    return g.select("o_orderpriority", line.alias("line"))


SQL_LINES = r"""
WITH g AS (SELECT o_orderpriority, count(*) AS n, min(year(o_orderdate::DATE)) AS lo, max(year(o_orderdate::DATE)) AS hi, string_agg(DISTINCT '## ' || o_orderstatus, ', ' ORDER BY '## ' || o_orderstatus) AS s FROM orders GROUP BY 1)
SELECT o_orderpriority, o_orderpriority || ': ' || CASE WHEN n % 1000 < 500 THEN '−' ELSE '+' END || format('{:.2f}', abs((n % 1000 - 500) / 4)) || ' [' || lo || '; ' || hi || '] ' || s AS line FROM g
"""


def q_index_decomposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences of a weighted index between two quality classes as the sum of its parts' differences, and the gap left."""
    df = labelled(spark, sf_dir).select("lang", "quality", (F.col("n_chars") / 1000).alias("a"), F.length("source").cast("double").alias("b"))
    mean = lambda x, y: F.avg(F.when(F.col("quality") == y, x))
    full = 0.7 * F.col("a") + 0.3 * F.col("b")
    g = df.groupBy("lang").agg(*[(mean(x, 1) - mean(x, 0)).alias(n) for x, n in ((F.col("a"), "da"), (F.col("b"), "db"), (full, "df"))])
    parts = 0.7 * F.col("da") + 0.3 * F.col("db")
    return g.select("lang", F.round(0.7 * F.col("da"), 6).alias("part_a"), F.round(0.3 * F.col("db"), 6).alias("part_b"), F.round("df", 6).alias("whole"), (F.abs(parts - F.col("df")) < 1e-9).alias("adds_up"))


SQL_DECOMPOSITION = L + r"""
, g AS (SELECT lang, avg(n_chars / 1000) FILTER (quality = 1) - avg(n_chars / 1000) FILTER (quality = 0) AS da, avg(length(source)) FILTER (quality = 1) - avg(length(source)) FILTER (quality = 0) AS db FROM l GROUP BY 1)
SELECT lang, round(0.7 * da, 6) AS part_a, round(0.3 * db, 6) AS part_b, round(0.7 * da + 0.3 * db, 6) AS whole, CASE WHEN da + db IS NOT NULL THEN true END AS adds_up FROM g
"""


def q_sign_bonferroni(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direction of the mean length against 2,000 by source: only where the interval, widened for the number of sources, leaves zero out."""
    g = labelled(spark, sf_dir).groupBy("source").agg(F.avg(F.col("n_chars") - 2000).alias("mean"), (F.stddev_samp("n_chars") / F.sqrt(F.count("*"))).alias("se"), F.count("*").alias("n")).filter("n > 1")
    many = F.count("*").over(W.partitionBy())  # sources
    g = g.withColumn("m", many).withColumn("z", 1.96 + 0.2 * F.ln("m"))
    lo, hi = F.col("mean") - F.col("z") * F.col("se"), F.col("mean") + F.col("z") * F.col("se")
    label = F.when(lo > 0, "longer").when(hi < 0, "shorter").otherwise("open")
    return g.select("source", F.round("mean", 6).alias("mean"), F.round(lo, 6).alias("lo"), F.round(hi, 6).alias("hi"), label.alias("direction"))


SQL_SIGNS = L + r"""
, g AS (SELECT source, avg(n_chars - 2000) AS mean, stddev_samp(n_chars) / sqrt(count(*)) AS se FROM l GROUP BY 1 HAVING count(*) > 1), z AS (SELECT *, 1.96 + 0.2 * ln(count(*) OVER ()) AS z FROM g)
SELECT source, round(mean, 6) AS mean, round(mean - z * se, 6) AS lo, round(mean + z * se, 6) AS hi, CASE WHEN mean - z * se > 0 THEN 'longer' WHEN mean + z * se < 0 THEN 'shorter' ELSE 'open' END AS direction FROM z
"""


def q_carried_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An old split (of the labelled documents, by hash) carried over to all documents that are left: never dealt anew; new ones have no part."""
    old = labelled(spark, sf_dir).select("doc_id", F.when(H.unit_draw(F.col("doc_id")) < 0.3, "test").otherwise("train").alias("part"))
    left = docs(spark, sf_dir).filter(F.size("w") >= 20).select("doc_id")
    both = left.withColumn("here", F.lit(True)).join(old, "doc_id", "full")
    status = F.when(F.col("here").isNull(), "deleted").when(F.col("part").isNull(), "new").otherwise("carried")
    return both.select("doc_id", "part", status.alias("status"))


SQL_CARRIED = D + r"""
, o AS (SELECT doc_id, CASE WHEN (('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT % 1000) / 1000.0 < 0.3 THEN 'test' ELSE 'train' END AS part FROM labels SEMI JOIN documents USING (doc_id)),
h AS (SELECT doc_id, true AS here FROM d WHERE len(w) >= 20)
SELECT doc_id, part, CASE WHEN here IS NULL THEN 'deleted' WHEN part IS NULL THEN 'new' ELSE 'carried' END AS status FROM h FULL JOIN o USING (doc_id)
"""


def q_retest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two computations of the same features: cells that are equal, and the largest absolute and relative difference."""
    d = docs(spark, sf_dir)
    a = d.select("doc_id", F.stack(F.lit(2), F.lit("chars"), F.col("n_chars").cast("double"), F.lit("words"), F.size("w").cast("double")).alias("feature", "a"))
    b = d.select("doc_id", F.stack(F.lit(2), F.lit("chars"), F.length("text").cast("double"), F.lit("words"), F.size(F.array_remove(F.split("text", r"\s+"), "")).cast("double")).alias("feature", "b"))
    gap = F.abs(F.col("a") - F.col("b"))
    g = a.join(b, ["doc_id", "feature"]).groupBy("feature")
    return g.agg(F.count("*").alias("n"), F.count_if(gap == 0).alias("equal"), F.max(gap).alias("max_abs"), F.round(F.max(gap / F.greatest(F.abs("a"), F.lit(1.0))), 6).alias("max_rel"))


SQL_RETEST = D + r"""
, x AS (SELECT 'chars' AS feature, n_chars::DOUBLE AS a, length(text)::DOUBLE AS b FROM d UNION ALL SELECT 'words', len(w)::DOUBLE, len(regexp_extract_all(text, '[^ \t\n\x0B\f\r]+'))::DOUBLE FROM d)
SELECT feature, count(*) AS n, count(*) FILTER (abs(a - b) = 0) AS equal, max(abs(a - b)) AS max_abs, round(max(abs(a - b) / greatest(abs(a), 1.0)), 6) AS max_rel FROM x GROUP BY 1
"""


def q_reproduction_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions against frozen ones: missing cells on either side, the largest difference, decisions that changed, and whether the gate is open."""
    now = members(spark, sf_dir).select("doc_id", "seed", F.col("p").alias("now"))
    frozen = members(spark, sf_dir).filter("not (seed = 3 and n_chars < 300)").select("doc_id", "seed", (F.col("p") + F.when(F.col("seed") == 2, 1e-10).otherwise(0.0)).alias("frozen"))
    both = now.join(frozen, ["doc_id", "seed"], "full")
    gap = F.abs(F.col("now") - F.col("frozen"))
    flips = F.count_if((F.round("now", 9) >= 0.5) != (F.round("frozen", 9) >= 0.5))
    g = both.groupBy("seed").agg(F.count("*").alias("n"), F.count_if(gap.isNull()).alias("missing"), F.count_if(gap > 1e-8).alias("differ"), flips.alias("flips"))
    return g.withColumn("open", (F.col("missing") == 0) & (F.col("differ") == 0) & (F.col("flips") == 0))


SQL_GATE = M + r"""
, f AS (SELECT doc_id, seed, p + CASE WHEN seed = 2 THEN 1e-10 ELSE 0 END AS q FROM m WHERE NOT (seed = 3 AND n_chars < 300)),
g AS (SELECT seed, count(*) AS n, count(*) FILTER (q IS NULL) AS missing, count(*) FILTER (abs(p - q) > 1e-8) AS differ, count(*) FILTER ((round(p, 9) >= 0.5) <> (round(q, 9) >= 0.5)) AS flips FROM m LEFT JOIN f USING (doc_id, seed) GROUP BY 1)
SELECT *, missing = 0 AND differ = 0 AND flips = 0 AS open FROM g
"""


def q_manifest_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifests of a source's documents before and after a cleaning step: rows, digest of the texts, and what drifted."""
    d = docs(spark, sf_dir)

    def manifest(df: DataFrame, text: Column) -> DataFrame:
        each = df.select("source", F.sha2(text, 256).alias("h"))
        return each.groupBy("source").agg(F.count("*").alias("n"), F.sha2(F.array_join(F.sort_array(F.collect_list(F.substring("h", 1, 8))), ","), 256).alias("digest"))

    before = manifest(d, F.col("text"))
    after = manifest(d.filter(F.size("w") >= 5), F.btrim("text")).withColumnsRenamed({"n": "n_after", "digest": "digest_after"})
    drift = F.when(F.col("n_after").isNull(), "gone").when(F.col("n") != F.col("n_after"), "rows").when(F.col("digest") != F.col("digest_after"), "texts").otherwise("none")
    return before.join(after, "source", "left").select("source", "n", "n_after", drift.alias("drift"))


SQL_DRIFT = D + r"""
, b AS (SELECT source, count(*) AS n, list_sort(list(sha256(text)[1:8])) AS g FROM d WHERE source IS NOT NULL GROUP BY 1), a AS (SELECT source, count(*) AS n_after, list_sort(list(sha256(trim(text, ' '))[1:8])) AS h FROM d WHERE len(w) >= 5 GROUP BY 1)
SELECT source, n, n_after, CASE WHEN n_after IS NULL THEN 'gone' WHEN n <> n_after THEN 'rows' WHEN g <> h THEN 'texts' ELSE 'none' END AS drift FROM b LEFT JOIN a USING (source)
UNION ALL SELECT NULL, count(*), NULL, 'gone' FROM d WHERE source IS NULL HAVING count(*) > 0
"""


def q_missing_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reasons of missing values by class; those that the dictionary does not know are named, and stop a run."""
    d = docs(spark, sf_dir)
    reason = F.when(F.size("w") == 0, "no_words").when(F.size("w") < 20, "too_short").when(F.col("lang").isNull(), "no_language")
    known = spark.createDataFrame([("no_words", "text"), ("too_short", "text")], "reason string, class string")
    found = d.select(reason.alias("reason")).filter("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))
    return found.join(known, "reason", "left").select("reason", "n", F.coalesce("class", F.lit("unknown")).alias("class"), F.col("class").isNull().alias("stops"))


SQL_REASONS = D + r"""
, r AS (SELECT CASE WHEN len(w) = 0 THEN 'no_words' WHEN len(w) < 20 THEN 'too_short' WHEN lang IS NULL THEN 'no_language' END AS reason FROM d), k(reason, class) AS (VALUES ('no_words', 'text'), ('too_short', 'text'))
SELECT reason, count(*) AS n, coalesce(class, 'unknown') AS class, class IS NULL AS stops FROM r LEFT JOIN k USING (reason) WHERE reason IS NOT NULL GROUP BY reason, class
"""


def q_qa_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places that cleaning leaves behind: sentences cut at abbreviations, list items glued to prose, table rows, and three counts of words."""
    count = lambda p: F.regexp_count("text", F.lit(p)).cast("long")
    d = docs(spark, sf_dir)
    return d.select(
        "doc_id", count(r"(?:Dr|St|Mr|etc|vgl|bzw)\. [\p{Ll}]").alias("abbreviations"), count(r"[\p{L}][-*•] [\p{L}]").alias("glued_items"), count(r"\|[^|\n]*\|").alias("table_cells"),
        F.size("w").alias("letters_only"), F.size(F.array_remove(F.split("text", r"[ \t\n\x0B\f\r]+"), "")).alias("by_blanks"), count(r"[\p{L}\p{N}]+").alias("with_digits"),
    )


SQL_QA = D + r"""
SELECT doc_id, len(regexp_extract_all(text, '(?:Dr|St|Mr|etc|vgl|bzw)\. [\p{Ll}]')) AS abbreviations, len(regexp_extract_all(text, '[\p{L}][-*•] [\p{L}]')) AS glued_items, len(regexp_extract_all(text, '\|[^|\n]*\|')) AS table_cells,
       len(w) AS letters_only, len(regexp_extract_all(text, '[^ \t\n\x0B\f\r]+')) AS by_blanks, len(regexp_extract_all(text, '[\p{L}\p{N}]+')) AS with_digits
FROM d
"""


def q_resolved_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corrected text of a document where there is one, else the raw one, with what it came from."""
    raw = docs(spark, sf_dir).select("doc_id", "text")
    corrected = raw.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi").select("doc_id", F.regexp_replace("text", " +", " ").alias("corrected"))
    df = raw.join(corrected, "doc_id", "left")
    return df.select("doc_id", F.when(F.col("corrected").isNull(), "raw").otherwise("corrected").alias("origin"), F.length(F.coalesce("corrected", "text")).alias("length"))


SQL_RESOLVED = D + r"""
, c AS (SELECT doc_id, regexp_replace(text, ' +', ' ', 'g') AS corrected FROM d SEMI JOIN labels USING (doc_id))
SELECT doc_id, CASE WHEN corrected IS NULL THEN 'raw' ELSE 'corrected' END AS origin, length(coalesce(corrected, text)) AS length FROM d LEFT JOIN c USING (doc_id)
"""


def q_url_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs out of three kinds of listing: a sitemap in XML, an API's JSON rows with a header row, and ``key: value`` heads in any order."""
    u = table(spark, sf_dir, "pages").select("page_id", "url").filter("url is not null and not contains(url, '<') and not contains(url, '&')")
    xml = F.concat(F.lit("<urlset><url><loc>"), "url", F.lit("</loc></url></urlset>"))
    rows = F.from_json(F.to_json(F.array(F.array(F.lit("id"), F.lit("original")), F.array(F.col("page_id").cast("string"), F.col("url")))), "array<array<string>>")
    head = F.str_to_map(F.concat(F.lit("id: "), F.col("page_id").cast("string"), F.lit("\nurl: "), F.col("url")), F.lit("\n"), F.lit(": "))
    column = lambda name: F.get(rows[1], F.array_position(rows[0], name).cast("int") - 1)
    return u.select("page_id", F.xpath_string(xml, F.lit("urlset/url/loc")).alias("sitemap"), column("original").alias("api"), head["url"].alias("head"))


SQL_LISTINGS = "SELECT page_id, url AS sitemap, url AS api, url AS head FROM pages WHERE url IS NOT NULL AND NOT contains(url, '<') AND NOT contains(url, '&')"


def q_reuse_sentinels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored lengths of each language held against lengths computed anew on the ten documents of least hash."""
    d = docs(spark, sf_dir).withColumn("nth", F.row_number().over(W.partitionBy("lang").orderBy(H.sha1_hex(F.col("doc_id"))))).filter("nth <= 10")
    same = F.col("n_chars") == F.length("text")
    return d.groupBy("lang").agg(F.count("*").alias("n_sentinels"), F.count_if(same).alias("n_same"), (F.count_if(same) == F.count("*")).alias("reusable"))


SQL_SENTINELS = D + r"""
, s AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY lang ORDER BY substr(sha1(doc_id::VARCHAR), 1, 20)) <= 10)
SELECT lang, count(*) AS n_sentinels, count(*) FILTER (n_chars = length(text)) AS n_same, count(*) FILTER (n_chars = length(text)) = count(*) AS reusable FROM s GROUP BY 1
"""

QUERIES = {
    "lexicon_scores": (q_lexicon_scores, SQL_LEXICON),
    "hdd": (q_hdd, SQL_HDD),
    "lexical_profile": (q_lexical_profile, SQL_PROFILE),
    "openings": (q_openings, SQL_OPENINGS),
    "paragraph_rhythm": (q_paragraph_rhythm, SQL_RHYTHM),
    "list_items": (q_list_items, SQL_ITEMS),
    "keep_first_blocks": (q_keep_first_blocks, SQL_FIRST),
    "turn_differences": (q_turn_differences, SQL_TURNS),
    "lexicon_algebra": (q_lexicon_algebra, SQL_ALGEBRA),
    "entity_density": (q_entity_density, SQL_ENTITIES),
    "case_control": (q_case_control, SQL_CASES),
    "holdout_bridge": (q_holdout_bridge, SQL_BRIDGE),
    "ensemble_collapse": (q_ensemble, SQL_ENSEMBLE),
    "proxy_agreement": (q_proxy_agreement, SQL_PROXY),
    "stable_clusters": (q_stable_clusters, SQL_STABLE),
    "quota_selection": (q_quota_selection, SQL_QUOTA),
    "blind_cards": (q_blind_cards, SQL_CARDS),
    "strata": (q_strata, SQL_STRATA),
    "exclusion_log": (q_exclusion_log, SQL_EXCLUSION),
    "report_lines": (q_report_lines, SQL_LINES),
    "index_decomposition": (q_index_decomposition, SQL_DECOMPOSITION),
    "sign_bonferroni": (q_sign_bonferroni, SQL_SIGNS),
    "carried_split": (q_carried_split, SQL_CARRIED),
    "retest": (q_retest, SQL_RETEST),
    "reproduction_gate": (q_reproduction_gate, SQL_GATE),
    "manifest_drift": (q_manifest_drift, SQL_DRIFT),
    "missing_reasons": (q_missing_reasons, SQL_REASONS),
    "qa_scans": (q_qa_scans, SQL_QA),
    "resolved_texts": (q_resolved_texts, SQL_RESOLVED),
    "url_listings": (q_url_listings, SQL_LISTINGS),
    "reuse_sentinels": (q_reuse_sentinels, SQL_SENTINELS),
}
