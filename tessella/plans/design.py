"""Queries over designs: splits and folds, expectations, vectors, pages, streams of events."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.functions import html as P
from tessella.functions import vectors as V
from tessella.operators import gates as G
from tessella.operators import splits as S
from tessella.sources import sinks, table


def families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers with two group keys that overlap: nation by parity, and balance band."""
    s = table(spark, sf_dir, "supplier")
    first = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("n"), "s_nationkey"))
    second = F.when(F.col("s_suppkey") % 5 == 0, F.concat(F.lit("b"), F.floor(F.col("s_acctbal") / 500)))
    return s.select("s_suppkey", "s_nationkey", first.alias("family"), second.alias("cluster"))


FAMILIES = """
WITH RECURSIVE f AS (SELECT s_suppkey, s_nationkey, CASE WHEN s_suppkey % 3 = 0 THEN 'n' || s_nationkey END AS family,
  CASE WHEN s_suppkey % 5 = 0 THEN 'b' || floor(s_acctbal / 500)::BIGINT END AS cluster FROM supplier),
e AS (SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM f a JOIN f b ON a.family = b.family UNION SELECT a.s_suppkey, b.s_suppkey FROM f a JOIN f b ON a.cluster = b.cluster),
r AS (SELECT s_suppkey AS node, s_suppkey AS seen FROM f UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.seen),
atoms AS (SELECT node AS s_suppkey, min(seen) AS atom FROM r GROUP BY node)
"""


def q_atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.atoms(families(spark, sf_dir), "s_suppkey", ["family", "cluster"])


def q_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = families(spark, sf_dir)
    df = df.join(S.atoms(df, "s_suppkey", ["family", "cluster"]), "s_suppkey")
    out = S.group_holdout(df, "atom", F.col("s_nationkey").isin(3, 11), "s_nationkey")
    return out.groupBy("part").agg(F.count("*").alias("n"), F.countDistinct("atom").alias("n_atoms"))


SQL_HOLDOUT = FAMILIES + """
, j AS (SELECT f.*, atom, max((s_nationkey IN (3, 11))::INT) OVER (PARTITION BY atom) = 1 AS test FROM f JOIN atoms USING (s_suppkey)),
p AS (SELECT *, CASE WHEN test THEN 'test' WHEN s_nationkey IN (SELECT s_nationkey FROM j WHERE test) THEN 'left out' ELSE 'train' END AS part FROM j)
SELECT part, count(*) AS n, count(DISTINCT atom) AS n_atoms FROM p GROUP BY 1
"""


def q_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))
    return S.folds(sizes, "lang", "n", "source", 3)


SQL_FOLDS = """
WITH s AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2)
SELECT lang, source, n, ((row_number() OVER (PARTITION BY lang ORDER BY n DESC, source) - 1) % 3)::INT AS fold FROM s
"""


def q_time_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders after the date that 80 % of them are before (by index), per priority."""
    o = table(spark, sf_dir, "orders").select("o_orderpriority", F.to_date("o_orderdate").alias("day"))
    days = o.groupBy("day").agg(F.count("*").alias("n"))
    upto = days.select("day", F.sum("n").over(W.orderBy("day").rowsBetween(W.unboundedPreceding, 0)).alias("upto"))  # one row a day
    total = o.agg(F.count("*").alias("total"))
    cut = upto.crossJoin(total).filter(F.col("upto") > F.floor(F.col("total") * 0.8)).agg(F.min("day").alias("cut"))
    return o.crossJoin(cut).filter(F.col("day") > F.col("cut")).groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.min(F.col("cut").cast("string")).alias("cut"))


SQL_TIME = """
WITH o AS (SELECT o_orderpriority, o_orderdate::DATE AS day FROM orders), r AS (SELECT day, row_number() OVER (ORDER BY day) AS i, count(*) OVER () AS n FROM o),
c AS (SELECT day AS cut FROM r WHERE i = floor(n * 0.8::DOUBLE) + 1)
SELECT o_orderpriority, count(*) AS n, min(cut)::VARCHAR AS cut FROM o, c WHERE day > cut GROUP BY 1
"""


def q_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of broken expectations of the documents and labels."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    found = [
        G.required(docs, "doc_id", ["text", "lang"]),
        G.unique(docs.withColumn("digest", F.md5("text")), ["digest"]),
        G.allowed(docs, "doc_id", "lang", ["en", "de", "fr"]),
        G.foreign_key(docs.select("doc_id", F.col("doc_id").alias("label")), "doc_id", "label", labels, "doc_id"),
        G.holds(docs, "doc_id", "length", F.col("n_chars") < 10000, F.col("n_chars")),
        G.functional_dependency(docs, "source", "lang"),
        G.at_most(docs, "lang", 0.25, share=True),
    ]
    return reduce(DataFrame.unionByName, found).groupBy("rule").agg(F.count("*").alias("n"), F.min("key").alias("first_key"))


SQL_VIOLATIONS = """
WITH v AS (
  SELECT 'unique:digest' AS rule, md5(text) AS key FROM documents GROUP BY 2 HAVING count(*) > 1
  UNION ALL SELECT 'allowed:lang', doc_id::VARCHAR FROM documents WHERE lang NOT IN ('en', 'de', 'fr')
  UNION ALL SELECT 'foreign_key:label', doc_id::VARCHAR FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
  UNION ALL SELECT 'length', doc_id::VARCHAR FROM documents WHERE n_chars >= 10000
  UNION ALL SELECT 'depends:source->lang', source FROM documents GROUP BY 2 HAVING count(DISTINCT lang) > 1
  UNION ALL SELECT 'at_most:lang', lang FROM documents GROUP BY 2 HAVING count(*) / (SELECT count(*) FROM documents) > 0.25
)
SELECT rule, count(*) AS n, min(key) AS first_key FROM v GROUP BY 1
"""


def q_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ancestors of each run of a chain in which a run's parent is half its number."""
    spark.range(1, 33).selectExpr("id AS run", "cast(floor(id / 2) AS bigint) AS parent").createOrReplaceTempView("tessella_runs")
    return spark.sql("""
        WITH RECURSIVE a(run, ancestor, depth) AS (
          SELECT run, parent, 1 FROM tessella_runs WHERE parent > 0
          UNION ALL SELECT a.run, r.parent, depth + 1 FROM a JOIN tessella_runs r ON r.run = a.ancestor WHERE r.parent > 0
        ) SELECT run, count(*) AS n_ancestors, min(ancestor) AS root FROM a GROUP BY run""")


SQL_LINEAGE = """
WITH RECURSIVE r AS (SELECT i AS run, floor(i / 2)::BIGINT AS parent FROM range(1, 33) t(i)),
a AS (SELECT run, parent AS ancestor FROM r WHERE parent > 0 UNION ALL SELECT a.run, r.parent FROM a JOIN r ON r.run = a.ancestor WHERE r.parent > 0)
SELECT run, count(*) AS n_ancestors, min(ancestor) AS root FROM a GROUP BY run
"""


def q_adjacent_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of each vector with the next one of its label: mean and deviation."""
    e = table(spark, sf_dir, "embeddings")
    following = F.lead("embedding").over(W.partitionBy("label").orderBy("vec_id"))
    cos = e.withColumn("next", following).filter("next is not null").select("label", V.cosine(F.col("embedding"), F.col("next")).alias("c"))
    return cos.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg("c"), 5).alias("mean"), F.round(F.stddev_samp("c"), 5).alias("sd"))


SQL_COSINE = """
WITH n AS (SELECT label, embedding::DOUBLE[] AS a, lead(embedding::DOUBLE[]) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM embeddings)
SELECT label, count(*) AS n, round(avg(list_cosine_similarity(a, b)), 5) AS mean, round(stddev_samp(list_cosine_similarity(a, b)), 5) AS sd FROM n WHERE b IS NOT NULL GROUP BY 1
"""


def q_centroid_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector's cosine with its label's centroid, summed up by label."""
    e = table(spark, sf_dir, "embeddings")
    c = V.centroid(e, ["label"], "embedding", "centroid")
    cos = e.join(c, "label").select("label", V.cosine(F.col("embedding"), F.col("centroid")).alias("c"))
    return cos.groupBy("label").agg(F.round(F.avg("c"), 5).alias("mean"), F.round(F.min("c"), 5).alias("least"))


SQL_CENTROID = """
WITH x AS (SELECT label, vec_id, embedding::DOUBLE[] AS e FROM embeddings), u AS (SELECT label, unnest(e) AS v, generate_subscripts(e, 1) AS i FROM x),
m AS (SELECT label, i, avg(v) AS m FROM u GROUP BY 1, 2), c AS (SELECT label, list(m ORDER BY i) AS c FROM m GROUP BY 1)
SELECT label, round(avg(list_cosine_similarity(e, c)), 5) AS mean, round(min(list_cosine_similarity(e, c)), 5) AS least FROM x JOIN c USING (label) GROUP BY 1
"""


def q_half_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance of the centroids of a label's first and second half, by order."""
    e = table(spark, sf_dir, "embeddings")
    by = W.partitionBy("label")
    half = (F.row_number().over(by.orderBy("vec_id")) <= F.floor(F.count("*").over(by) / 2)).cast("int")
    c = V.centroid(e.withColumn("half", half), ["label", "half"], "embedding", "c")
    sides = c.groupBy("label").agg(F.max(F.when(F.col("half") == 1, F.col("c"))).alias("a"), F.max(F.when(F.col("half") == 0, F.col("c"))).alias("b"))
    return sides.select("label", F.round(1 - V.cosine(F.col("a"), F.col("b")), 5).alias("drift"))


SQL_DRIFT = """
WITH x AS (SELECT label, embedding::DOUBLE[] AS e, (row_number() OVER (PARTITION BY label ORDER BY vec_id) <= floor(count(*) OVER (PARTITION BY label) / 2))::INT AS half FROM embeddings),
u AS (SELECT label, half, unnest(e) AS v, generate_subscripts(e, 1) AS i FROM x), m AS (SELECT label, half, i, avg(v) AS m FROM u GROUP BY 1, 2, 3),
c AS (SELECT label, half, list(m ORDER BY i) AS c FROM m GROUP BY 1, 2)
SELECT a.label, round(1 - list_cosine_similarity(a.c, b.c), 5) AS drift FROM c a JOIN c b ON a.label = b.label AND a.half = 1 AND b.half = 0
"""


def q_page_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(
        "page_id", P.tag_text(F.col("html"), "title").alias("title"), P.first_date(F.concat_ws(" ", "url", "html")).cast("string").alias("day"),
        F.regexp_count("html", F.lit("(?i)<p[ >]")).cast("long").alias("n_paragraphs"), F.nullif(F.regexp_extract("html", '(?i)<html[^>]*lang="([^"]*)"', 1), F.lit("")).alias("lang"),
    )


SQL_PAGE = r"""
SELECT page_id, nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '') AS title,
  nullif(regexp_extract(url || ' ' || html, '((?:199|20[0-3])[0-9]-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01]))', 1), '') AS day,
  len(regexp_extract_all(html, '(?i)<p[ >]'))::BIGINT AS n_paragraphs, nullif(regexp_extract(html, '(?i)<html[^>]*lang="([^"]*)"', 1), '') AS lang
FROM pages
"""


def q_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed title and text blocks."""
    pages = table(spark, sf_dir, "pages").select("page_id", P.extract(F.col("html")).alias("x"))
    return pages.select("page_id", "x.title", F.size("x.blocks").cast("long").alias("n_blocks"), F.array_join("x.blocks", "\n").alias("text"))


def q_event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in six-hour windows, as the stream counts them."""
    e = table(spark, sf_dir, "events")
    w = e.groupBy(F.window("ts", "6 hours").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return w.select(F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", "total")


SQL_WINDOWS = """
SELECT strftime(time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2000-01-01'), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2
"""


def q_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's sessions: events less than a day apart."""
    e = table(spark, sf_dir, "events")
    w = e.groupBy(F.session_window("ts", "1 day").alias("w"), "user_id").agg(F.count("*").alias("n"))
    return w.groupBy("user_id").agg(F.count("*").alias("n_sessions"), F.max("n").alias("largest"))


SQL_SESSIONS = """
WITH l AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events),
s AS (SELECT user_id, sum(CASE WHEN before IS NULL OR ts >= before + INTERVAL 1 DAY THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM l),
c AS (SELECT user_id, s, count(*) AS n FROM s GROUP BY 1, 2)
SELECT user_id, count(*) AS n_sessions, max(n) AS largest FROM c GROUP BY 1
"""


def q_cache_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("source", "text", F.concat(F.lit("v"), F.col("doc_id") % 3).alias("version"))
    return sinks.cache_index(docs, "source", "text", "version").select("source", "sha256", F.array_join("versions", ";").alias("versions"))


SQL_CACHE = "SELECT source, sha256(text) AS sha256, string_agg(DISTINCT 'v' || (doc_id % 3), ';' ORDER BY 'v' || (doc_id % 3)) AS versions FROM documents GROUP BY 1, 2"

QUERIES = {
    "provenance_atoms": (q_atoms, FAMILIES + "SELECT s_suppkey, atom FROM atoms"),
    "group_holdout": (q_holdout, SQL_HOLDOUT),
    "fold_assignment": (q_folds, SQL_FOLDS),
    "time_holdout": (q_time_holdout, SQL_TIME),
    "violations": (q_violations, SQL_VIOLATIONS),
    "lineage": (q_lineage, SQL_LINEAGE),
    "adjacent_cosine": (q_adjacent_cosine, SQL_COSINE),
    "centroid_cosine": (q_centroid_cosine, SQL_CENTROID),
    "half_drift": (q_half_drift, SQL_DRIFT),
    "page_fields": (q_page_fields, SQL_PAGE),
    "page_text": (q_page_text, None),
    "event_windows": (q_event_windows, SQL_WINDOWS),
    "event_sessions": (q_sessions, SQL_SESSIONS),
    "cache_index": (q_cache_index, SQL_CACHE),
}
