"""Queries for reports: distributions, agreement of procedures, samples, phrase lists and verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.functions import hashing as H
from tessella.functions import text as T
from tessella.operators.pairs import draws
from tessella.plans.scores import P as PRED
from tessella.plans.scores import predictions
from tessella.plans.text import NORMAL, SENTENCES, WORDS
from tessella.sources import table

MEASURES = {"a": "n_chars", "b": "n_lines", "c": "n_upper"}


def measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = lambda p: F.regexp_count("text", F.lit(p)).cast("long")
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars", count("\n").alias("n_lines"), count("[A-Z]").alias("n_upper"))


MEASURED = r"""
WITH m AS (SELECT doc_id, lang, source, n_chars, len(regexp_extract_all(text, '\n'))::BIGINT AS n_lines, len(regexp_extract_all(text, '[A-Z]'))::BIGINT AS n_upper FROM documents)
"""


def q_rank_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose places by three measures differ most; ties have places of their own, by key."""
    df = measured(spark, sf_dir)
    whole = W.partitionBy("lang")
    places = [(F.row_number().over(whole.orderBy(c, "doc_id")) / F.count("*").over(whole)).alias(k) for k, c in MEASURES.items()]
    df = df.select("doc_id", "lang", *places)
    df = df.withColumn("spread", F.greatest("a", "b", "c") - F.least("a", "b", "c"))
    nth = F.row_number().over(whole.orderBy(F.desc(F.round("spread", 9)), "doc_id"))
    return df.withColumn("nth", nth).filter("nth <= 10").select("doc_id", "lang", F.round("spread", 6).alias("spread"))


SQL_SPREAD = MEASURED + """
, p AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id) / count(*) OVER (PARTITION BY lang) AS a,
  row_number() OVER (PARTITION BY lang ORDER BY n_lines, doc_id) / count(*) OVER (PARTITION BY lang) AS b,
  row_number() OVER (PARTITION BY lang ORDER BY n_upper, doc_id) / count(*) OVER (PARTITION BY lang) AS c FROM m),
s AS (SELECT doc_id, lang, greatest(a, b, c) - least(a, b, c) AS spread FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY round(spread, 9) DESC, doc_id) AS nth FROM s)
SELECT doc_id, lang, round(spread, 6) AS spread FROM r WHERE nth <= 10
"""


def q_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Knots, index terciles, modal line count (the least on a tie) and correlation with log length, by language."""
    df = measured(spark, sf_dir)
    nth = F.row_number().over(W.partitionBy("lang").orderBy("n_chars", "doc_id")) - 1
    size = F.count("*").over(W.partitionBy("lang"))
    at = lambda k: F.max(F.when(F.col("nth") == F.floor(F.col("size") * k / 3), F.col("n_chars")))
    df = df.withColumn("nth", nth).withColumn("size", size)
    modes = df.groupBy("lang", "n_lines").agg(F.count("*").alias("n")).groupBy("lang").agg(F.max(F.struct("n", (-F.col("n_lines")).alias("v"))).alias("x"))
    out = df.groupBy("lang").agg(
        *[F.round(F.percentile("n_chars", F.lit(q)), 4).alias(f"p{round(q * 100)}") for q in (0.1, 0.5, 0.9)],
        at(1).alias("first_tercile"), at(2).alias("second_tercile"), F.round(F.corr("n_upper", F.log("n_chars")), 5).alias("r"),
    )
    return out.join(modes.select("lang", (-F.col("x.v")).alias("mode_lines")), "lang")


SQL_DISTRIBUTION = MEASURED + """
, r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id) - 1 AS nth, count(*) OVER (PARTITION BY lang) AS size FROM m),
k AS (SELECT lang, n_lines, count(*) AS n FROM m GROUP BY 1, 2),
o AS (SELECT lang, n_lines AS mode_lines FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, n_lines) AS i FROM k) WHERE i = 1)
SELECT lang, round(quantile_cont(n_chars, 0.1), 4) AS p10, round(quantile_cont(n_chars, 0.5), 4) AS p50, round(quantile_cont(n_chars, 0.9), 4) AS p90,
  max(CASE WHEN nth = floor(size / 3) THEN n_chars END) AS first_tercile, max(CASE WHEN nth = floor(size * 2 / 3) THEN n_chars END) AS second_tercile,
  round(corr(n_upper, ln(n_chars)), 5) AS r, any_value(mode_lines) AS mode_lines
FROM r JOIN o USING (lang) GROUP BY lang
"""


def q_cluster_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents with the same length: how many, singletons, least, lower median and largest size."""
    sizes = measured(spark, sf_dir).groupBy("lang", "n_chars").agg(F.count("*").alias("n"))
    ordered = sizes.withColumn("nth", F.row_number().over(W.partitionBy("lang").orderBy("n"))).withColumn("k", F.count("*").over(W.partitionBy("lang")))
    middle = F.max(F.when(F.col("nth") == F.floor((F.col("k") + 1) / 2), F.col("n")))
    return ordered.groupBy("lang").agg(F.count("*").alias("n_groups"), F.count_if(F.col("n") == 1).alias("n_single"), F.min("n").alias("least"), middle.alias("middle"), F.max("n").alias("largest"))


SQL_SIZES = MEASURED + """
, s AS (SELECT lang, n_chars, count(*) AS n FROM m GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n) AS nth, count(*) OVER (PARTITION BY lang) AS k FROM s)
SELECT lang, count(*) AS n_groups, count_if(n = 1)::BIGINT AS n_single, min(n) AS least, max(CASE WHEN nth = floor((k + 1) / 2) THEN n END) AS middle, max(n) AS largest FROM o GROUP BY 1
"""


def q_repeat_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent distance between two occurrences of a sentence (the least on a tie)."""
    each = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "s"))
    gap = F.col("pos") - F.lag("pos").over(W.partitionBy("doc_id", "s").orderBy("pos"))
    counts = each.select("doc_id", gap.alias("gap")).filter("gap is not null").groupBy("doc_id", "gap").agg(F.count("*").alias("n"))
    top = counts.groupBy("doc_id").agg(F.max(F.struct("n", (-F.col("gap")).alias("g"))).alias("x"), F.sum("n").alias("n_gaps"))
    return top.select("doc_id", (-F.col("x.g")).cast("long").alias("gap"), F.col("x.n").alias("n"), "n_gaps")


SQL_OFFSETS = rf"""
WITH s AS (SELECT doc_id, unnest(x) AS s, generate_subscripts(x, 1) AS pos FROM (SELECT doc_id, {SENTENCES.format("text", 0)} AS x FROM documents)),
g AS (SELECT doc_id, pos - lag(pos) OVER (PARTITION BY doc_id, s ORDER BY pos) AS gap FROM s),
c AS (SELECT doc_id, gap, count(*) AS n FROM g WHERE gap IS NOT NULL GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, gap) AS i, sum(n) OVER (PARTITION BY doc_id)::BIGINT AS n_gaps FROM c)
SELECT doc_id, gap, n, n_gaps FROM r WHERE i = 1
"""

#: Phrases, the longest first, so that a shorter one never takes part of a longer one.
PHRASES = sorted(["of the", "the the", "and the", "is the", "of", "to the the"], key=lambda p: (-len(p), p))


def q_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of a phrase list per 1,000 words."""
    text = T.normalised(F.col("text"))
    hits = F.regexp_count(text, F.lit(r"\b(?:" + "|".join(PHRASES) + r")\b"))
    n = F.size(T.words(text))
    return table(spark, sf_dir, "documents").select("doc_id", hits.cast("long").alias("hits"), F.round(hits * 1000 / F.greatest(n, F.lit(1)), 6).alias("per_1000"))


SQL_PHRASES = rf"""
WITH d AS (SELECT doc_id, {NORMAL.format("text")} AS t FROM documents), h AS (SELECT doc_id, len(regexp_extract_all(t, '\b(?:{"|".join(PHRASES)})\b')) AS h, len({WORDS.format("t")}) AS n FROM d)
SELECT doc_id, h::BIGINT AS hits, round(h * 1000 / greatest(n, 1), 6) AS per_1000 FROM h
"""


def q_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that are flagged more often than the others in at least half of the languages, and over 5 % in as many."""
    df = predictions(spark, sf_dir).withColumn("flag", (F.col("p") > 0.8).cast("int"))
    each = df.groupBy("source", "lang").agg(F.sum("flag").alias("h"), F.count("*").alias("n"))
    whole = W.partitionBy("lang")
    rest = (F.sum("h").over(whole) - F.col("h")) / F.nullif(F.sum("n").over(whole) - F.col("n"), F.lit(0))
    each = each.withColumn("share", F.col("h") / F.col("n")).withColumn("more", F.col("share") > rest)
    return each.groupBy("source").agg(
        F.count("*").alias("n_languages"), F.round(F.median("share"), 6).alias("median"),
        ((F.count_if("more") * 2 >= F.count("*")) & (F.count_if(F.col("share") > 0.05) * 2 >= F.count("*"))).cast("int").alias("systematic"),
    )


SQL_VERDICTS = PRED + """
, e AS (SELECT source, lang, sum((p > 0.8)::INT) AS h, count(*) AS n FROM pred GROUP BY 1, 2),
r AS (SELECT source, h / n AS share, h / n > (sum(h) OVER w - h) / nullif(sum(n) OVER w - n, 0) AS more FROM e WINDOW w AS (PARTITION BY lang))
SELECT source, count(*) AS n_languages, round(median(share), 6) AS median,
  (count_if(coalesce(more, false)) * 2 >= count(*) AND count_if(share > 0.05) * 2 >= count(*))::INT AS systematic FROM r GROUP BY 1
"""


def q_sign_synthesis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signs of three contrasts between toxic and other documents, by language, and whether they agree."""
    df = measured(spark, sf_dir).join(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id")
    contrast = lambda c: F.avg(F.when(F.col("toxic") == 1, F.col(c))) - F.avg(F.when(F.col("toxic") == 0, F.col(c)))
    signs = df.groupBy("lang").agg(*[F.signum(F.round(contrast(c), 9)).cast("int").alias(k) for k, c in MEASURES.items()])
    verdict = F.when((F.col("a") == F.col("b")) & (F.col("b") == F.col("c")), "agree").when(F.col("a").isNull() | F.col("b").isNull(), "missing").otherwise("differ")
    return signs.withColumn("verdict", verdict)


SQL_SIGNS = MEASURED + """
, j AS (SELECT m.*, toxic FROM m JOIN labels USING (doc_id)),
s AS (SELECT lang, sign(round(avg(n_chars) FILTER (toxic = 1) - avg(n_chars) FILTER (toxic = 0), 9))::INT AS a, sign(round(avg(n_lines) FILTER (toxic = 1) - avg(n_lines) FILTER (toxic = 0), 9))::INT AS b,
  sign(round(avg(n_upper) FILTER (toxic = 1) - avg(n_upper) FILTER (toxic = 0), 9))::INT AS c FROM j GROUP BY 1)
SELECT *, CASE WHEN a = b AND b = c THEN 'agree' WHEN a IS NULL OR b IS NULL THEN 'missing' ELSE 'differ' END AS verdict FROM s
"""


def q_top_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two largest weighted measures of each document, in order."""
    parts = [("length", F.log1p("n_chars") * 0.5), ("lines", F.log1p("n_lines") * -1.5), ("capitals", F.log1p("n_upper") * 0.75)]
    each = F.array(*[F.struct((-F.abs(v)).alias("k"), F.lit(n).alias("name"), v.alias("v")) for n, v in parts])
    top = F.slice(F.sort_array(each), 1, 2)
    return measured(spark, sf_dir).select("doc_id", top[0]["name"].alias("first"), F.round(top[0]["v"], 5).alias("first_value"), top[1]["name"].alias("second"))


SQL_TOP = MEASURED + """
, p AS (SELECT doc_id, unnest([{'n': 'length', 'v': ln(1 + n_chars) * 0.5}, {'n': 'lines', 'v': ln(1 + n_lines) * -1.5}, {'n': 'capitals', 'v': ln(1 + n_upper) * 0.75}]) AS s FROM m),
r AS (SELECT doc_id, s.n AS n, s.v AS v, row_number() OVER (PARTITION BY doc_id ORDER BY abs(s.v) DESC, s.n) AS i FROM p)
SELECT a.doc_id, a.n AS first, round(a.v, 5) AS first_value, b.n AS second FROM r a JOIN r b ON a.doc_id = b.doc_id AND a.i = 1 AND b.i = 2
"""


def q_joint_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Difference of group and rest, both resampled by the same draws of clusters; repetitions with an empty side are skipped."""
    df = predictions(spark, sf_dir).withColumn("inside", F.col("lang") == "en")
    sums = df.groupBy("source").agg(
        F.sum(F.when(F.col("inside"), F.col("y"))).alias("hi"), F.count_if("inside").alias("ni"), F.sum(F.when(~F.col("inside"), F.col("y"))).alias("ho"), F.count_if(~F.col("inside")).alias("no")
    )
    sums = sums.withColumn("drawn", (F.row_number().over(W.orderBy("source")) - 1).cast("long"))  # one row a cluster
    groups = sums.count()
    reps = draws(300, 5, groups, spark).join(sums, "drawn").groupBy("rep").agg(*[F.sum(c).alias(c) for c in ("hi", "ni", "ho", "no")])
    d = reps.filter("ni > 0 and no > 0").select((F.col("hi") / F.col("ni") - F.col("ho") / F.col("no")).alias("d"))
    x = d.agg(F.sort_array(F.collect_list("d")).alias("d"), F.count("*").alias("n"))
    return x.select("n", F.round(F.get("d", F.floor(F.col("n") * 0.025).cast("int")), 6).alias("lo"), F.round(F.get("d", (F.floor(F.col("n") * 0.975) - 1).cast("int")), 6).alias("hi"))


SQL_JOINT = PRED + """
, s AS (SELECT row_number() OVER (ORDER BY source) - 1 AS i, coalesce(sum(y) FILTER (lang = 'en'), 0) AS hi, count_if(lang = 'en') AS ni, coalesce(sum(y) FILTER (lang <> 'en'), 0) AS ho, count_if(lang <> 'en') AS no FROM pred GROUP BY source),
d AS (SELECT rep, ('0x' || substr(md5('5|' || rep || '|' || j), 1, 8))::BIGINT % (SELECT count(*) FROM s) AS i FROM (SELECT unnest(range(300)) AS rep), (SELECT i AS j FROM s)),
r AS (SELECT rep, sum(hi) AS hi, sum(ni) AS ni, sum(ho) AS ho, sum(no) AS no FROM d JOIN s USING (i) GROUP BY rep),
x AS (SELECT list(hi / ni - ho / no ORDER BY hi / ni - ho / no) AS d, count(*) AS n FROM r WHERE ni > 0 AND no > 0)
SELECT n, round(d[floor(n * 0.025::DOUBLE)::INT + 1], 6) AS lo, round(d[floor(n * 0.975::DOUBLE)::INT], 6) AS hi FROM x
"""


def q_label_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Negative control: source labels dealt anew by hash, twenty times; accuracy of the decisions each time."""
    df = predictions(spark, sf_dir)
    majority = df.groupBy("source").agg((F.avg("y") >= 0.5).cast("int").alias("label"))
    runs = majority.crossJoin(spark.range(20).withColumnRenamed("id", "run"))  # sources by runs
    nth = F.row_number().over(W.partitionBy("run").orderBy("source"))
    other = F.row_number().over(W.partitionBy("run").orderBy(H.md5_int(F.concat_ws("|", "run", "source")), "source"))
    left, right = runs.select("run", "source", nth.alias("i")), runs.select("run", "label", other.alias("i"))
    dealt = left.join(right, ["run", "i"]).select("run", "source", "label")
    counts = df.groupBy("source").agg(F.count("*").alias("n"), F.sum((F.col("p") > 0.5).cast("int")).alias("up"))
    right_ = F.when(F.col("label") == 1, F.col("up")).otherwise(F.col("n") - F.col("up"))
    return dealt.join(counts, "source").groupBy("run").agg(F.round(F.sum(right_) / F.sum("n"), 6).alias("accuracy"))


SQL_PERMUTATION = PRED + """
, m AS (SELECT source, (avg(y) >= 0.5)::INT AS label, count(*) AS n, sum((p > 0.5)::INT) AS up FROM pred GROUP BY 1), r AS (SELECT unnest(range(20)) AS run),
a AS (SELECT run, source, n, up, row_number() OVER (PARTITION BY run ORDER BY source) AS i FROM m, r),
b AS (SELECT run, label, row_number() OVER (PARTITION BY run ORDER BY ('0x' || substr(md5(run || '|' || source), 1, 8))::BIGINT, source) AS i FROM m, r)
SELECT run, round(sum(CASE WHEN label = 1 THEN up ELSE n - up END) / sum(n), 6) AS accuracy FROM a JOIN b USING (run, i) GROUP BY 1
"""


def q_url_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose URL has exactly one of the topics, every third of them by key."""
    topics = F.array(*[F.lit(f"/{t}/") for t in ("en", "de", "fr", "es")])
    df = table(spark, sf_dir, "pages").select("page_id", F.filter(topics, lambda t: F.contains("url", t)).alias("t")).filter("size(t) = 1")
    nth = F.row_number().over(W.partitionBy(F.col("t")[0]).orderBy("page_id"))
    return df.select("page_id", F.btrim(F.col("t")[0], F.lit("/")).alias("topic"), nth.alias("nth")).filter("nth % 3 = 1").select("page_id", "topic")


SQL_TOPICS = """
WITH p AS (SELECT page_id, list_filter(['/en/', '/de/', '/fr/', '/es/'], lambda t: contains(url, t)) AS t FROM pages),
o AS (SELECT page_id, trim(t[1], '/') AS topic, row_number() OVER (PARTITION BY t[1] ORDER BY page_id) AS nth FROM p WHERE len(t) = 1)
SELECT page_id, topic FROM o WHERE nth % 3 = 1
"""

QUERIES = {
    "rank_spread": (q_rank_spread, SQL_SPREAD),
    "distribution": (q_distribution, SQL_DISTRIBUTION),
    "cluster_sizes": (q_cluster_sizes, SQL_SIZES),
    "repeat_offsets": (q_repeat_offsets, SQL_OFFSETS),
    "phrase_hits": (q_phrases, SQL_PHRASES),
    "fairness_verdicts": (q_verdicts, SQL_VERDICTS),
    "sign_synthesis": (q_sign_synthesis, SQL_SIGNS),
    "top_contributions": (q_top_contributions, SQL_TOP),
    "joint_bootstrap": (q_joint_bootstrap, SQL_JOINT),
    "label_permutation": (q_label_permutation, SQL_PERMUTATION),
    "url_topics": (q_url_topics, SQL_TOPICS),
}
