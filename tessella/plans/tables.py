"""Queries over tables: joins, aggregates, windows, set operations, the feature matrix and paired contrasts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.functions import hashing as H
from tessella.operators import matrix as X
from tessella.operators import pairs as P
from tessella.operators.ranks import strict_percentile, tercile_score
from tessella.sources import table

FEATURES = ["n_chars", "n_lines", "n_commas"]


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = lambda p: F.regexp_count("text", F.lit(p)).cast("double")
    commas = F.when(count(",") > 0, count(","))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), "lang", "source", F.col("n_chars").cast("double"), (count("\n") + 1).alias("n_lines"), commas.alias("n_commas"))


def long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.unpivot(wide(spark, sf_dir), "document_id", FEATURES)


WIDE = r"""
WITH wide AS (
  SELECT doc_id AS document_id, lang, source, n_chars::DOUBLE AS n_chars, (len(regexp_extract_all(text, '\n')) + 1)::DOUBLE AS n_lines,
         nullif(len(regexp_extract_all(text, ',')), 0)::DOUBLE AS n_commas
  FROM documents
), long AS (
  SELECT document_id, 'n_chars' AS feature_id, n_chars AS value FROM wide UNION ALL SELECT document_id, 'n_lines', n_lines FROM wide
  UNION ALL SELECT document_id, 'n_commas', n_commas FROM wide
)
"""


def q_feature_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strict percentile of each feature within language."""
    cells = long(spark, sf_dir).join(wide(spark, sf_dir).select("document_id", "lang"), "document_id")
    ranked = strict_percentile(cells, "value", ["feature_id", "lang"], "percentile")
    return ranked.select("document_id", "feature_id", "value", F.round("percentile", 6).alias("percentile"))


SQL_MATRIX = WIDE + """
, c AS (SELECT long.*, lang FROM long JOIN wide USING (document_id))
SELECT document_id, feature_id, value, CASE WHEN value IS NOT NULL THEN
  round((rank() OVER (PARTITION BY feature_id, lang ORDER BY value NULLS LAST) - 1) / count(value) OVER (PARTITION BY feature_id, lang), 6) END AS percentile
FROM c
"""


def q_style_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = strict_percentile(long(spark, sf_dir), "value", ["feature_id"], "p")
    category = F.when(F.col("feature_id") == "n_commas", "punctuation").otherwise("size")
    scores = cells.select("document_id", category.alias("category"), tercile_score(F.col("p")).alias("score"))
    return X.weighted_index(scores, {"size": 0.57, "punctuation": 0.12}).select("document_id", F.round("index", 6).alias("index"))


SQL_INDEX = WIDE + """
, r AS (SELECT *, CASE WHEN value IS NOT NULL THEN (rank() OVER (PARTITION BY feature_id ORDER BY value NULLS LAST) - 1)::DOUBLE / count(value) OVER (PARTITION BY feature_id) END AS p FROM long),
s AS (SELECT document_id, CASE WHEN feature_id = 'n_commas' THEN 'punctuation' ELSE 'size' END AS category,
  CASE WHEN p < 1/3 THEN 0.0 WHEN p < 2/3 THEN 0.5 WHEN p IS NOT NULL THEN 1.0 END AS score FROM r),
m AS (SELECT document_id, category, avg(score) AS m, CASE WHEN category = 'size' THEN 0.57::DOUBLE ELSE 0.12::DOUBLE END AS w FROM s GROUP BY 1, 2)
SELECT document_id, round(sum(w * m) / sum(CASE WHEN m IS NOT NULL THEN w END) * 100, 6) AS index FROM m GROUP BY 1
"""


def q_matrix_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line counts recomputed without empty lines, for labelled documents only."""
    fresh = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.lit("n_lines").alias("feature_id"), F.size(F.filter(F.split("text", "\n"), lambda x: x != "")).cast("double").alias("value"))
    alive = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("document_id"))
    out = X.upsert(long(spark, sf_dir), fresh, ["n_lines"], alive)
    return out.groupBy("feature_id").agg(F.count("*").alias("n"), F.count("value").alias("n_values"), F.sum("value").alias("total"))


SQL_UPSERT = WIDE + """
, f AS (SELECT doc_id AS document_id, 'n_lines' AS feature_id, len(list_filter(string_split(text, chr(10)), lambda x: x <> ''))::DOUBLE AS value FROM documents),
u AS (SELECT * FROM long WHERE feature_id <> 'n_lines' UNION ALL SELECT * FROM f)
SELECT feature_id, count(*) AS n, count(value) AS n_values, sum(value) AS total FROM u WHERE document_id IN (SELECT doc_id FROM labels) GROUP BY 1
"""


def q_matrix_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change log of a patch that caps character counts."""
    cells = long(spark, sf_dir)
    fixes = cells.filter("feature_id = 'n_chars'").withColumn("value", F.least("value", F.lit(5000.0)))
    return X.patch(cells, fixes, "value")[1]


SQL_PATCH = WIDE + "SELECT document_id, feature_id, value AS old, 5000.0::DOUBLE AS new FROM long WHERE feature_id = 'n_chars' AND value > 5000"


def q_missingness(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = long(spark, sf_dir).join(wide(spark, sf_dir).select("document_id", "lang", "source"), "document_id")
    return X.missingness(cells, "value", ["lang"]).withColumn("share", F.round("share", 6))


SQL_MISSING = WIDE + """
SELECT feature_id, lang, count(*) AS n, (count(*) - count(value))::BIGINT AS n_missing, round((count(*) - count(value)) / count(*), 6) AS share
FROM long JOIN wide USING (document_id) GROUP BY 1, 2
"""


def q_zscore_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five documents farthest from the mean of each feature, by |z|."""
    z = X.zscores(long(spark, sf_dir), "value", ["feature_id"], "z").filter("z is not null")
    nth = F.row_number().over(W.partitionBy("feature_id").orderBy(F.desc(F.round(F.abs("z"), 9)), "document_id"))
    return z.withColumn("nth", nth).filter("nth <= 5").select("feature_id", "document_id", F.round("z", 6).alias("z"), F.col("nth").cast("long").alias("nth"))


SQL_Z = WIDE + """
, z AS (SELECT feature_id, document_id, (value - avg(value) OVER w) / nullif(stddev_pop(value) OVER w, 0) AS z FROM long WINDOW w AS (PARTITION BY feature_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY feature_id ORDER BY round(abs(z), 9) DESC, document_id) AS nth FROM z WHERE z IS NOT NULL)
SELECT feature_id, document_id, round(z, 6) AS z, nth FROM r WHERE nth <= 5
"""


def q_imputed(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = F.pmod(F.col("document_id"), F.lit(5)) != 0
    out = X.imputed(wide(spark, sf_dir), ["n_commas"], train)
    return out.groupBy("lang").agg(F.count("n_commas").alias("n"), F.sum("n_commas").alias("total"))


SQL_IMPUTED = WIDE + """
, m AS (SELECT coalesce(median(n_commas), 0.0) AS m FROM wide WHERE document_id % 5 <> 0)
SELECT lang, count(*) AS n, sum(coalesce(n_commas, m)) AS total FROM wide, m GROUP BY 1
"""


def q_frozen_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices of odd-numbered parts against the frozen prices of even-numbered ones of their brand."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_retailprice")
    odd = parts.filter("p_partkey % 2 = 1")
    out = X.frozen_percentile(odd, parts.filter("p_partkey % 2 = 0").select("p_brand", "p_retailprice"), "p_retailprice", ["p_brand"], "percentile")
    return out.select("p_partkey", F.round("percentile", 6).alias("percentile"))


SQL_FROZEN = """
SELECT a.p_partkey, round(count_if(b.p_retailprice < a.p_retailprice) / count(b.p_partkey), 6) AS percentile
FROM part a LEFT JOIN part b ON a.p_brand = b.p_brand AND b.p_partkey % 2 = 0 WHERE a.p_partkey % 2 = 1 GROUP BY 1
"""


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a design: cell = customer and year, condition = order status, value = mean price."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", F.year("o_orderdate").alias("year"), "o_orderstatus", "o_totalprice")
    return orders.groupBy("o_custkey", "year", "o_orderstatus").agg(F.avg("o_totalprice").alias("price"))


CELLS = """
WITH cells AS (SELECT o_custkey, year(o_orderdate) AS year, o_orderstatus, avg(o_totalprice) AS price FROM orders GROUP BY 1, 2, 3),
sides AS (SELECT o_custkey, year, max(CASE WHEN o_orderstatus = 'F' THEN price END) AS l, max(CASE WHEN o_orderstatus = 'O' THEN price END) AS r
  FROM cells WHERE o_orderstatus IN ('F', 'O') GROUP BY 1, 2),
nations AS (SELECT c_custkey AS o_custkey, c_nationkey FROM customer)
"""


def q_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per nation: pairs, incomplete cells and the mean difference."""
    whole, part = P.contrast_pairs(cells(spark, sf_dir), ["o_custkey", "year"], "o_orderstatus", "price", "F", "O")
    both = whole.withColumn("d", F.col("left") - F.col("right")).unionByName(part, allowMissingColumns=True)
    nations = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    return both.join(nations, "o_custkey").groupBy("c_nationkey").agg(
        F.count("d").alias("n_pairs"), F.count_if(F.col("d").isNull()).alias("n_incomplete"), F.round(F.avg("d"), 6).alias("mean_difference")
    )


SQL_CONTRAST = CELLS + """
SELECT c_nationkey, count(l - r) AS n_pairs, count_if(l - r IS NULL)::BIGINT AS n_incomplete, round(avg(l - r), 6) AS mean_difference FROM sides JOIN nations USING (o_custkey) GROUP BY 1
"""


def differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", (F.col("o_totalprice") / 1000 - 200).alias("d"))
    nations = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    return orders.join(nations, "o_custkey").select("c_nationkey", F.round("d", 3).alias("d"))


DIFFERENCES = """
WITH RECURSIVE x AS (SELECT c_nationkey, round(o_totalprice / 1000 - 200, 3) AS d FROM orders JOIN customer ON o_custkey = c_custkey),
s AS (SELECT row_number() OVER (ORDER BY c_nationkey) - 1 AS i, c_nationkey, sum(d) AS s, count(*) AS n FROM x GROUP BY c_nationkey), g AS (SELECT count(*) AS g, sum(n) AS total FROM s)
"""


def q_cluster_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = P.cluster_bootstrap(differences(spark, sf_dir), "c_nationkey", "d", reps=400, seed=7)
    return out.select(*[F.round(c, 6).alias(c) for c in ("mean", "lo", "hi", "p")], "n_clusters", "n")


SQL_BOOTSTRAP = DIFFERENCES + """
, draws AS (SELECT rep, ('0x' || substr(md5('7|' || rep || '|' || i), 1, 8))::BIGINT % g AS i FROM (SELECT unnest(range(400)) AS rep), (SELECT i, g FROM s, g)),
m AS (SELECT rep, sum(s) / sum(n) AS m FROM draws JOIN s USING (i) GROUP BY rep),
o AS (SELECT list(m ORDER BY m) AS m, count_if(m <= 0) AS low, count_if(m >= 0) AS high FROM m),
p AS (SELECT sum(s) / sum(n) AS mean, count(*) AS n_clusters, sum(n)::BIGINT AS n FROM s)
SELECT round(mean, 6) AS mean, round(m[11], 6) AS lo, round(m[390], 6) AS hi, round(least(1.0, 2 * greatest(least(low, high), 1) / 400), 6) AS p, n_clusters, n FROM o, p
"""


def q_wild_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = P.wild_cluster_p(differences(spark, sf_dir), "c_nationkey", "d", reps=400, seed=7)
    return out.select(F.round("p", 6).alias("p"), F.round("t", 6).alias("t"))


SQL_WILD = DIFFERENCES + """
, r AS (SELECT rep, n, g, total, s * CASE WHEN rep >= 0 AND ('0x' || substr(md5('7|' || rep || '|' || c_nationkey), 1, 8))::BIGINT % 2 = 1 THEN -1 ELSE 1 END AS s
  FROM s, g, (SELECT unnest(range(-1, 400)) AS rep)),
m AS (SELECT *, sum(s) OVER (PARTITION BY rep) / total AS m FROM r),
t AS (SELECT rep, abs(max(m)) / sqrt(max(g) / (max(g) - 1) * sum((s - n * m) * (s - n * m)) / (max(total) * max(total))) AS t FROM m GROUP BY rep),
o AS (SELECT t AS own FROM t WHERE rep = -1)
SELECT round(greatest(count_if(t >= own - 1e-12), 1) / 400, 6) AS p, round(max(own), 6) AS t FROM t, o WHERE rep >= 0
"""


def q_version_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions of the customers: unchanged, changed, gone and new keys."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    old = c.filter("c_custkey % 10 <> 3")
    new = c.filter("c_custkey % 10 <> 7").withColumn("c_acctbal", F.when(F.col("c_custkey") % 4 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")))
    both = old.withColumn("o", F.lit(1)).join(new.withColumnRenamed("c_acctbal", "b").withColumn("w", F.lit(1)), "c_custkey", "full_outer")
    state = F.when(F.col("o").isNull(), "new").when(F.col("w").isNull(), "gone").when(F.col("c_acctbal").eqNullSafe(F.col("b")), "unchanged").otherwise("changed")
    return both.groupBy(state.alias("state")).agg(F.count("*").alias("n"))


SQL_DIFF = """
WITH o AS (SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey % 10 <> 3),
w AS (SELECT c_custkey, c_acctbal + CASE WHEN c_custkey % 4 = 0 THEN 1 ELSE 0 END AS b FROM customer WHERE c_custkey % 10 <> 7)
SELECT CASE WHEN o.c_custkey IS NULL THEN 'new' WHEN w.c_custkey IS NULL THEN 'gone' WHEN c_acctbal = b THEN 'unchanged' ELSE 'changed' END AS state, count(*) AS n
FROM o FULL JOIN w ON o.c_custkey = w.c_custkey GROUP BY 1
"""


def q_semi_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with an urgent order and customers without any order, by segment."""
    customer, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    urgent = customer.join(orders.filter("o_orderpriority = '1-URGENT'"), "c_custkey", "left_semi").withColumn("kind", F.lit("urgent"))
    none = customer.join(orders, "c_custkey", "left_anti").withColumn("kind", F.lit("none"))
    return urgent.unionByName(none).groupBy("kind", "c_mktsegment").agg(F.count("*").alias("n"))


SQL_SEMI = """
SELECT 'urgent' AS kind, c_mktsegment, count(*) AS n FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') GROUP BY 2
UNION ALL SELECT 'none', c_mktsegment, count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) GROUP BY 2
"""


def q_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers in turns of nations, larger nations first, three each at most, twenty in all."""
    s = table(spark, sf_dir, "supplier").withColumn("size", F.count("*").over(W.partitionBy("s_nationkey")))
    s = s.withColumn("turn", F.row_number().over(W.partitionBy("s_nationkey").orderBy(F.desc("s_acctbal"), "s_suppkey")))
    top = s.filter("turn <= 3").orderBy("turn", F.desc("size"), "s_nationkey").limit(20)
    return top.select("s_suppkey", "s_nationkey", F.col("turn").cast("long").alias("turn"))


SQL_ROBIN = """
WITH s AS (SELECT *, count(*) OVER (PARTITION BY s_nationkey) AS size, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS turn FROM supplier)
SELECT s_suppkey, s_nationkey, turn FROM s WHERE turn <= 3 ORDER BY turn, size DESC, s_nationkey LIMIT 20
"""


def q_pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return df.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(net), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_discount"),
        F.round(F.median("l_quantity"), 6).alias("median_qty"), F.round(F.stddev_samp("l_quantity"), 6).alias("sd_qty"), F.count("*").alias("n"),
    )


SQL_PRICING = """
SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_discount,
  round(median(l_quantity), 6) AS median_qty, round(stddev_samp(l_quantity), 6) AS sd_qty, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2
"""


def q_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.cube("n_regionkey", "c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"), F.grouping_id().cast("long").alias("level"))


SQL_CUBE = """
SELECT n_regionkey, c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS balance, grouping(n_regionkey, c_mktsegment)::BIGINT AS level
FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY CUBE (n_regionkey, c_mktsegment)
"""


def q_dense_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types by days with the number of events, days without any included."""
    events = table(spark, sf_dir, "events").select("event_type", F.to_date("ts").alias("day"))
    grid = events.select("event_type").distinct().crossJoin(events.select("day").distinct())  # two small dimensions
    counts = events.groupBy("event_type", "day").agg(F.count("*").alias("n"))
    return grid.join(counts, ["event_type", "day"], "left").select("event_type", F.col("day").cast("string").alias("day"), F.coalesce("n", F.lit(0)).alias("n"))


SQL_GRID = """
WITH e AS (SELECT event_type, ts::DATE AS day FROM events), g AS (SELECT * FROM (SELECT DISTINCT event_type FROM e), (SELECT DISTINCT day FROM e))
SELECT g.event_type, g.day::VARCHAR AS day, count(e.day) AS n FROM g LEFT JOIN e ON e.event_type = g.event_type AND e.day = g.day GROUP BY 1, 2
"""


def q_last_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each user and type, with the key parsed from its JSON."""
    e = table(spark, sf_dir, "events")
    last = e.groupBy("user_id", "event_type").agg(F.max(F.struct("ts", "event_id", "value", "props")).alias("x"))
    return last.select("user_id", "event_type", "x.event_id", F.get_json_object("x.props", "$.k").cast("long").alias("k"))


SQL_LAST = """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS i FROM events)
SELECT user_id, event_type, event_id, (props::JSON ->> '$.k')::BIGINT AS k FROM r WHERE i = 1
"""


def q_set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of intersection, differences and symmetric difference of the keys of two tables."""
    a, b = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select((F.col("doc_id") + 3).alias("doc_id"))
    parts = {"both": a.intersect(b), "left": a.exceptAll(b), "right": b.exceptAll(a)}
    parts["either"] = parts["left"].unionAll(parts["right"])
    out = None
    for name, part in parts.items():
        one = part.agg(F.count("*").alias("n"), F.sum("doc_id").alias("total")).withColumn("part", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


SQL_SETS = """
WITH a AS (SELECT doc_id FROM documents), b AS (SELECT doc_id + 3 AS doc_id FROM labels),
i AS (SELECT doc_id FROM a INTERSECT SELECT doc_id FROM b), l AS (SELECT doc_id FROM a EXCEPT SELECT doc_id FROM b), r AS (SELECT doc_id FROM b EXCEPT SELECT doc_id FROM a)
SELECT count(*) AS n, sum(doc_id)::BIGINT AS total, 'both' AS part FROM i UNION ALL SELECT count(*), sum(doc_id), 'left' FROM l UNION ALL SELECT count(*), sum(doc_id), 'right' FROM r
UNION ALL SELECT count(*), sum(doc_id), 'either' FROM (SELECT * FROM l UNION ALL SELECT * FROM r)
"""


def q_stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of each source's documents, one at least, by hash."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", H.md5_int(F.col("doc_id")).alias("h"))
    by = W.partitionBy("source")
    docs = docs.withColumn("nth", F.row_number().over(by.orderBy("h", "doc_id"))).withColumn("n", F.count("*").over(by))
    return docs.filter(F.col("nth") <= F.greatest(F.lit(1), F.bround(F.col("n") * 0.1, 0))).select("doc_id", "source")


SQL_SAMPLE = """
WITH d AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT, doc_id) AS i, count(*) OVER (PARTITION BY source) AS n FROM documents)
SELECT doc_id, source FROM d WHERE i <= greatest(1, round_even(n * 0.1::DOUBLE, 0))
"""

QUERIES = {
    "feature_matrix": (q_feature_matrix, SQL_MATRIX),
    "style_index": (q_style_index, SQL_INDEX),
    "matrix_upsert": (q_matrix_upsert, SQL_UPSERT),
    "matrix_patch": (q_matrix_patch, SQL_PATCH),
    "missingness": (q_missingness, SQL_MISSING),
    "zscore_top": (q_zscore_top, SQL_Z),
    "median_imputation": (q_imputed, SQL_IMPUTED),
    "frozen_percentile": (q_frozen_percentile, SQL_FROZEN),
    "paired_contrast": (q_contrast, SQL_CONTRAST),
    "cluster_bootstrap": (q_cluster_bootstrap, SQL_BOOTSTRAP),
    "wild_cluster": (q_wild_cluster, SQL_WILD),
    "version_diff": (q_version_diff, SQL_DIFF),
    "semi_anti": (q_semi_anti, SQL_SEMI),
    "round_robin": (q_round_robin, SQL_ROBIN),
    "pricing_summary": (q_pricing_summary, SQL_PRICING),
    "segment_cube": (q_cube, SQL_CUBE),
    "dense_grid": (q_dense_grid, SQL_GRID),
    "last_record": (q_last_record, SQL_LAST),
    "set_operations": (q_set_operations, SQL_SETS),
    "stratified_sample": (q_stratified_sample, SQL_SAMPLE),
}
