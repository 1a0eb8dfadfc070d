"""Operator 9: benchmark decontamination as a prefix-filtered set join.

An item's windows are its runs of ``window`` words (an item of fewer words is one
window). A document word inside any occurrence of a window is hit.

Method: a window can only occur where all of its word shingles do, so for exact
containment one shingle is prefix enough: the rarest. Shingles are ordered by the number
of items that have them, then by hash, before any document is read; windows that
overlap mostly share their least one. One pass joins the documents' shingles to these
prefixes. Length and position bound the candidates (the window must lie inside the
text), and a second pass compares the words of each candidate's place with the window's.

All of it is DataFrame functions. The prefixes' hashes are broadcast if there are
``BROADCAST`` of them at most, which is counted; more are joined by shuffle. Candidates
are linear in the documents' shingles that are prefixes; equal windows of many items
are one window, whose items are looked up once a document.

Words are compared as their UTF-8 bytes read as ISO-8859-1: there, lower case changes
A-Z and the first bytes of some characters, and words stay equal or different as they
were, since what follows a first byte tells how long its character is.

Defined cases: null, empty and wordless texts have no words and no hits; items
without words have no windows; rows that repeat are judged alike, rows that share a
key but not a text each on their own; an empty table gives no rows; without items
nothing is hit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessella.llm.batches import row_key, without_rows
from tessella.session import written
from tessella.sources import table

WINDOW = 13
#: Words of a shingle; shorter items have one of their own length.
SHINGLE = 5
#: Hashes (8 bytes each) that are broadcast at most.
BROADCAST = 1_000_000
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Runs of digits, letters and all characters beyond ASCII, as ISO-8859-1, in lower case."""
    lowered = F.lower(F.decode(F.coalesce(text.cast("string"), F.lit("")).cast("binary"), "ISO-8859-1"))
    return F.array_remove(F.split(lowered, SEPARATORS), "")


def shingled(df: DataFrame, sizes: list[int]) -> DataFrame:
    """``df``, which has words ``w``, with a row for each shingle of one of ``sizes`` words: ``size``, ``pos``, ``hash``; made without a lambda."""
    most = max(sizes)
    starts = F.arrays_zip(*[F.slice("w", i + 1, F.greatest(F.size("w"), F.lit(1))).alias(f"w{i}") for i in range(most)])
    kept = [c for c in df.columns if c != "w"]
    df = df.select(*kept, F.posexplode(starts).alias("pos", "run"))
    word = lambda i: F.col("run").getField(f"w{i}")
    hashed = lambda n: F.xxhash64(*[word(i) for i in range(n)])
    if sizes == [most]:
        return df.filter(word(most - 1).isNotNull()).select(*kept, F.lit(most).alias("size"), "pos", hashed(most).alias("hash"))
    each = F.array(*[F.when(word(n - 1).isNotNull(), F.struct(F.lit(n).alias("size"), hashed(n).alias("hash"))) for n in sizes])
    return df.select(*kept, "pos", F.explode(each).alias("s")).filter("s is not null").select(*kept, "s.size", "pos", "s.hash")


def windows(items: DataFrame, item_id: str, item_text: str, window: int) -> DataFrame:
    """One row for each distinct window: ``window`` (its number), ``words``, ``length``, ``items`` (ids as strings)."""
    df = items.select(F.col(item_id).cast("string").alias("item"), words(F.col(item_text)).alias("w")).filter("size(w) > 0")
    n = F.least(F.size("w"), F.lit(window))
    runs = F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.slice("w", i, n))
    df = df.withColumn("words", F.explode(runs)).groupBy("words").agg(F.collect_set("item").alias("items"))
    df = df.select(F.monotonically_increasing_id().alias("window"), "words", F.size("words").alias("length"), "items")
    return written(df, "windows")


def hits(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    shingle: int = SHINGLE,
) -> DataFrame:
    """``key`` (see ``row_key``), ``doc_id``, ``n_words``, ``n_hit``, ``n_items``, ``items`` (sorted ids as strings) of each row."""
    docs = docs.select(row_key(id_col, text_col).alias("key"), F.col(text_col).cast("string").alias("text"))
    known = windows(items, item_id, item_text, window)
    lengths = [r.length for r in known.select("length").distinct().collect()]  # ``window`` values at most
    sizes = sorted({min(n, shingle) for n in lengths}) or [shingle]
    size = F.least("length", F.lit(shingle))
    parts = shingled(known.select("window", "length", size.alias("own"), F.size("items").alias("n"), F.col("words").alias("w")), sizes).filter("size = own")
    # rarest first: by the most items that one of its windows has, then by hash
    spread = parts.groupBy("hash").agg(F.max("n").alias("spread"))
    first = F.row_number().over(W.partitionBy("window").orderBy("spread", "hash", "pos"))
    prefix = parts.join(spread, "hash").withColumn("nth", first).filter("nth = 1")
    prefix = written(prefix.select("hash", "window", "length", F.col("pos").alias("offset")), "prefixes")

    wanted = prefix.select("hash").distinct()
    if wanted.count() <= BROADCAST:
        wanted = F.broadcast(wanted)
    each = docs.select("key", words(F.col("text")).alias("w")).withColumn("n_words", F.size("w"))
    found = shingled(each, sizes).join(wanted, "hash", "left_semi")
    found = written(found.select("key", "n_words", "hash", "pos"), "shared-shingles")

    maybe = found.join(prefix, "hash").withColumn("start", F.col("pos") - F.col("offset"))
    maybe = maybe.filter("start >= 0 and start + length <= n_words")
    maybe = maybe.groupBy("key").agg(F.collect_set(F.struct("start", "length", "window")).alias("maybe"))

    places = F.transform(
        "maybe", lambda c: F.struct(c["start"].alias("start"), c["window"].alias("window"), F.slice("w", c["start"] + 1, c["length"]).alias("here"))
    )
    read = docs.join(maybe, "key", "left").withColumn("w", words(F.col("text")))  # texts are smaller to move than their words
    read = written(read.select("key", F.size("w").alias("n_words"), places.alias("places")), "places")

    placed = read.filter("places is not null").select("key", F.explode("places").alias("p")).distinct()
    true = placed.select("key", "p.*").join(known.select("window", "words", "length"), "window").filter(F.col("here") == F.col("words"))
    true = written(true.select("key", "start", "length", "window"), "occurrences")

    before = F.max(F.col("start") + F.col("length")).over(W.partitionBy("key").orderBy("start", "length").rowsBetween(W.unboundedPreceding, -1))
    fresh = F.greatest(F.lit(0), F.col("start") + F.col("length") - F.greatest("start", F.coalesce(before, F.lit(0))))
    spans = true.select("key", "start", "length").distinct().withColumn("fresh", fresh)
    covered = spans.groupBy("key").agg(F.sum("fresh").alias("n_hit"))
    named = true.select("key", "window").distinct().join(known.select("window", "items"), "window")
    ids = named.select("key", F.explode("items").alias("item")).distinct().groupBy("key").agg(F.sort_array(F.collect_set("item")).alias("items"))
    out = read.join(covered.join(ids, "key"), "key", "left")
    none = F.array().cast("array<string>")
    return out.select(
        "key",
        "key.doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", none).alias("items"),
    )


def contaminated() -> Column:
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", ids.alias("items_sha256"), contaminated().alias("contaminated"))


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without contaminated rows."""
    return without_rows(docs, hits(docs, items, id_col, text_col).filter(contaminated()).select("key"), id_col, text_col)


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), win AS (
  SELECT DISTINCT item_id, n, array_to_string(w[p + 1 : p + n], ' ') AS gram
  FROM (SELECT item_id, w, least(len(w), 13) AS n, unnest(range(0, len(w) - least(len(w), 13) + 1)) AS p FROM i WHERE len(w) > 0)
), lens AS (SELECT DISTINCT n FROM win),
grams AS (
  SELECT doc_id, n, p, array_to_string(w[p + 1 : p + n], ' ') AS gram
  FROM (SELECT doc_id, w, n, unnest(range(0, len(w) - n + 1)) AS p FROM d, lens WHERE len(w) >= n)
), occ AS (SELECT doc_id, n, p, item_id FROM grams JOIN win USING (n, gram)),
hit AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit
  FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT doc_id, p, n FROM occ)) GROUP BY doc_id
), ids AS (
  SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS xs
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM occ) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(xs, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN ids USING (doc_id)
"""

QUERIES = {"op9_decontaminate": op9_decontaminate}
ORACLE = {"op9_decontaminate": SQL}
