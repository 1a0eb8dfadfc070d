"""Exact set-similarity joins of documents by their shingles, without comparing all pairs."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tessella.functions.text import normalised
from tessella.session import discard, written

#: Rows whose words are held at a time, and shingles of which repeats are counted at a time.
ROWS, COUNTED = 1_000, 4_000_000
#: Shingles whose counts order prefixes. Any order gives the same pairs: a count that is not known costs time only.
KNOWN = 1_000_000
#: Shingles of the sets of a part of a group of near copies, where a set counts as ``A_SET`` at least; a cell has two parts.
A_CELL, A_SET = 500_000, 500
#: Bits of the table in which ids are looked up before their texts move.
BITS = 1 << 26
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _runs(words: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of the runs of ``n`` word hashes, or of the one shorter run."""
    k = min(n, len(words))
    with np.errstate(over="ignore"):
        mixed = np.full(len(words) - k + 1 if k else 0, k, np.uint64)
        for j in range(k):
            mixed = (mixed ^ words[j : len(words) - k + 1 + j]) * MULTIPLIER
            mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        return mixed ^ mixed >> np.uint64(32)


def _sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """Sorted distinct shingles of normalised texts, whose words are parted by single spaces."""
    lists = pc.split_pattern(pc.fill_null(texts.cast(pa.string()), ""), " ")
    coded = pc.dictionary_encode(lists.flatten())
    hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    words = hashes[coded.indices.to_numpy(zero_copy_only=False)] if len(hashes) else hashes
    ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    empty = pc.equal(pc.fill_null(texts, ""), "").to_numpy(zero_copy_only=False)
    nothing = np.zeros(0, np.uint64)
    found = []
    for a, b, none in zip([0, *ends[:-1].tolist()], ends.tolist(), empty.tolist(), strict=False):
        found.append(np.unique(_runs(nothing if none else words[a:b], n).view(np.int64)))
    return found


def _digest(found: np.ndarray) -> int:
    n = xxhash.xxh64_intdigest(found.tobytes())
    return n - (n >> 63 << 64)


def _packed(found: np.ndarray) -> bytes:
    """The upper halves of sorted shingles, as differences by byte plane: under four bytes each."""
    marks = (found >> 32) + (1 << 31)
    steps = np.diff(marks, prepend=0).astype("<u4")
    return np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 4).T).tobytes()


def _marks(data: bytes) -> np.ndarray:
    steps = np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel()
    return np.cumsum(steps.astype(np.int64)) - (1 << 31)


def shingle_sets(docs: DataFrame, id_col: str, text_col: str, n: int = 5) -> DataFrame:
    """``id``, ``digest`` of the set and ``set``: the hashes of the distinct shingles of the normalised text, sorted; of each the upper half, packed (``_packed``)."""
    texts = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                sets = _sets(part.column(1), n)
                values = pa.array([_packed(s) for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([_digest(s) for s in sets], pa.int64()), values], ["id", "digest", "set"])

    return texts.mapInArrow(run, f"id {texts.schema['id'].dataType.simpleString()}, digest long, set binary")


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Marks of shingles that some ``COUNTED`` successive ones repeat, with how often."""
    waiting, held = [], 0

    def counted() -> pa.RecordBatch:
        hashes, n = np.unique(np.concatenate(waiting), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(hashes[n > 1]), pa.array(n[n > 1].astype(np.int64))], ["hash", "n"])

    for batch in batches:
        for value in batch.column(0):
            waiting.append(_marks(value.as_py()))
            held += len(waiting[-1])
            if held >= COUNTED:
                yield counted()
                waiting, held = [], 0
    if held:
        yield counted()


def prefixes(sets: DataFrame, threshold: float) -> DataFrame:
    """``digest``, ``size`` and ``hash`` (a mark) of the shingles on which a set meets every set as similar as ``threshold``; a task has a set once.

    Of a set of s shingles these are the first ``s - ceil(threshold * s) + 1`` in an order that all
    sets share: by a count, then by mark. Two shingles of the same mark are two of the set: where no
    mark of two prefixes is equal, the one that ends first has none of its marks in the other set, so
    too few are left to share. The counts of frequent marks put them last; they are
    gathered where a part of a table repeats one, and decide on time alone.
    """
    spark = sets.sparkSession
    counts = sets.select("set").mapInArrow(_repeats, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))
    known = counts.orderBy(F.desc("n"), "hash").limit(KNOWN).toArrow()
    hashes, n = (known[c].to_numpy().astype(np.int64) for c in ("hash", "n"))
    order = np.argsort(hashes)
    held = spark.sparkContext.broadcast((hashes[order], n[order]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, n = held.value
        seen: set[int] = set()
        for batch in (b.slice(start, ROWS) for b in batches for start in range(0, b.num_rows, ROWS)):
            digests, sets = [], []
            for digest, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if digest not in seen:
                    seen.add(digest)
                    digests.append(digest)
                    sets.append(_marks(value.as_py()))
            size = np.array([len(s) for s in sets], np.int64)
            flat = np.concatenate(sets) if sets else np.zeros(0, np.int64)
            row = np.repeat(np.arange(len(size)), size)
            starts = np.cumsum(size) - size
            if len(hashes):
                place = np.minimum(np.searchsorted(hashes, flat), len(hashes) - 1)
                count = np.where(hashes[place] == flat, n[place], 0)
                some = np.flatnonzero(np.isin(row, row[count > 0]))  # other rows are in order
                flat = flat.copy()
                flat[some] = flat[some][np.lexsort((flat[some], count[some], row[some]))]
            taken = np.array([s - math.ceil(threshold * s - 1e-9) + 1 if s else 0 for s in size.tolist()], np.int64)
            kept = np.arange(len(flat)) - starts[row] < taken[row]
            row = row[kept]
            columns = [pa.array(np.array(digests, np.int64)[row]), pa.array(size[row].astype(np.int32)), pa.array(flat[kept].astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["digest", "size", "hash"])

    return sets.select("digest", "set").mapInArrow(run, "digest long, size int, hash int")


def meeting(prefix: DataFrame, threshold: float) -> DataFrame:
    """``a`` < ``b``, ``a_size`` and ``b_size`` of the sets that share a prefix shingle and are near in size. The rows of ``prefix`` move once, and those of marks that no other set has stay behind."""
    once = prefix.repartition("hash").groupBy("hash", "digest", "size").agg(F.lit(1).alias("one"))
    others = F.count("*").over(Window.partitionBy("hash"))
    shared = written(once.select("hash", "digest", "size", others.alias("n")).filter("n > 1").drop("n"), "similarity-prefixes")
    left, right = (shared.select("hash", F.col("digest").alias(side), F.col("size").alias(f"{side}_size")) for side in ("a", "b"))
    near = F.least("a_size", "b_size") >= F.lit(threshold) * F.greatest("a_size", "b_size") - 1e-9
    found = written(left.join(right, "hash").filter("a < b").filter(near).select("a", "b", "a_size", "b_size").distinct(), "similarity-pairs")
    discard(shared)
    return found


def cells(pairs: DataFrame) -> DataFrame:
    """``a`` and ``b`` of ``pairs`` with the cell (``g``, ``i``, ``j``) that compares them.

    A pair's ``g`` is the least neighbour of ``a`` or ``a`` itself, which in a group of near copies is the same for most; a group of
    more than ``A_CELL`` shingles is cut into parts, and a cell has the sets of two parts. So a text is sent to
    a cell once, however many pairs it is in, and a cell's memory does not grow with the group.
    """
    sides = [pairs.select(F.col(x).alias("a"), F.col(f"{x}_size").alias("size"), F.col(y).alias("other")) for x, y in (("a", "b"), ("b", "a"))]
    least = sides[0].unionByName(sides[1]).groupBy("a").agg(F.least(F.min("other"), F.col("a")).alias("g"), F.max("size").alias("size"))
    others = pairs.select("a", "b", "b_size").join(least.select("a", "g"), "a").select("g", F.col("b").alias("a"), F.col("b_size").alias("size"))
    size = least.select("g", "a", "size").unionByName(others).distinct().groupBy("g").agg(F.sum(F.greatest("size", F.lit(A_SET))).alias("total"))
    large = size.filter(F.col("total") > A_CELL).select("g", F.ceil(F.col("total") / A_CELL).alias("parts"))
    grouped = pairs.select("a", "b").join(least.select("a", "g").join(large, "g", "left"), "a")
    i, j = (F.pmod(F.xxhash64(side), F.coalesce("parts", F.lit(1))) for side in ("a", "b"))
    return grouped.select("a", "b", "g", F.least(i, j).alias("i"), F.greatest(i, j).alias("j"))


def texts_of(docs: DataFrame, met: DataFrame) -> DataFrame:
    """``id`` and the compressed normalised ``text`` of the documents whose ids ``met`` has, and of a few more: ids are looked up in a table of ``BITS`` bits, so the others' texts don't move."""
    at = F.pmod(F.xxhash64("id"), F.lit(BITS))
    bits = met.select(at.alias("at")).groupBy(F.expr("cast(at div 32 AS int)").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at % 32 AS int)))").alias("bits")).toArrow()
    table = np.zeros(BITS // 32, np.int64)
    table[bits["word"].to_numpy()] = bits["bits"].to_numpy()
    held = docs.sparkSession.sparkContext.broadcast(table.astype(np.uint32))

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.column(2).to_numpy(zero_copy_only=False)
            yield batch.filter(pa.array(held.value[place // 32] >> (place % 32).astype(np.uint32) & 1 > 0)).select(["id", "text"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [zlib.compress(t.encode(), 1) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["id", "text"])

    kind = docs.schema["id"].dataType.simpleString()
    raw = docs.select("id", F.col("text").cast("string").alias("text"), at.alias("at")).filter("id is not null and text is not null").mapInArrow(some, f"id {kind}, text string")
    return raw.select("id", normalised(F.col("text")).alias("text")).mapInArrow(packed, f"id {kind}, text binary")


def compared(placed: DataFrame, texts: DataFrame, met: DataFrame, n: int, threshold: float, forest: bool) -> DataFrame:
    """``left_id``, ``right_id`` and ``jaccard`` of the pairs of ``cells`` at or above ``threshold``; ``forest``: of each cell only those that join what was not joined before.

    Texts go to the cells, which make the whole sets: compressed they are a third of those.
    """
    kind = texts.schema["id"].dataType
    arrow = to_arrow_type(kind)
    where = ["g", "i", "j"]
    needed = placed.select(*where, F.col("a").alias("digest")).unionByName(placed.select(*where, F.col("b").alias("digest"))).distinct()
    needed = needed.join(met, "digest").select("id", "digest", *(F.col(c).alias(f"to_{c}") for c in where))
    sent = texts.join(needed, "id")

    def run(pairs: pa.Table, sets: pa.Table) -> pa.Table:
        at, each, rows = {}, [], []
        wanted = sets["digest"].to_pylist()
        for lo in range(0, len(wanted), ROWS):
            made = _sets(pa.array([zlib.decompress(t.as_py()).decode() for t in sets["text"][lo : lo + ROWS]], pa.string()), n)
            for k, one in enumerate(made, lo):
                if wanted[k] not in at and _digest(one) == wanted[k]:  # rows may share an id
                    at[wanted[k]] = len(each)
                    each.append(one)
                    rows.append(k)
        parent = list(range(len(each)))

        def root(k: int) -> int:
            while parent[k] != k:
                parent[k] = parent[parent[k]]
                k = parent[k]
            return k

        left, right, share = [], [], []
        for a, b in zip(pairs["a"].to_pylist(), pairs["b"].to_pylist(), strict=True):
            a, b = at[a], at[b]
            x, y = each[a], each[b]
            if forest and root(a) == root(b):
                continue
            both = np.concatenate((x, y))
            both.sort()
            common = int((both[1:] == both[:-1]).sum())
            jaccard = common / (len(both) - common)
            if jaccard >= threshold:
                parent[root(a)] = root(b)
                left.append(a)
                right.append(b)
                share.append(jaccard)
        ids = sets["id"].combine_chunks().cast(arrow).take(pa.array(rows, pa.int64()))
        columns = [ids.take(pa.array(c, pa.int64())) for c in (left, right)]
        return pa.table([*columns, pa.array(share, pa.float64())], names=["a_id", "b_id", "jaccard"])

    name = kind.simpleString()
    found = placed.groupBy(*where).cogroup(sent.groupBy(*(f"to_{c}" for c in where))).applyInArrow(run, f"a_id {name}, b_id {name}, jaccard double")
    return found.select(F.least("a_id", "b_id").alias("left_id"), F.greatest("a_id", "b_id").alias("right_id"), "jaccard")


def jaccard_join(docs: DataFrame, id_col: str, text_col: str, n: int = 5, threshold: float = 0.8, forest: bool = False) -> DataFrame:
    """``left_id`` < ``right_id`` and ``jaccard`` of all pairs of different sets at or above ``threshold``; equal sets are linked to their least id.

    Equal sets are one class, known by a 64-bit digest, so groups of copies make no pairs among
    themselves. Classes meet on prefix shingles (``prefixes``); the texts of those that meet are read
    again and go to the cells (``cells``) that compare their whole sets. What a step has written goes when no later one reads it.
    ``forest``: fewer pairs, as many as it takes to have the same connected components.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sets = written(shingle_sets(docs, "id", "text", n).filter("length(`set`) > 0"), "similarity-sets")
    ids = written(sets.select("id", "digest"), "similarity-ids")
    prefix = prefixes(sets, threshold)
    pairs = meeting(prefix, threshold)
    discard(sets)
    placed = written(cells(pairs), "similarity-cells")
    discard(pairs)
    classes = ids.groupBy("digest").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    met = placed.select(F.col("a").alias("digest")).unionByName(placed.select(F.col("b").alias("digest"))).distinct().join(classes, "digest")
    met = written(met.select(F.col("least").alias("id"), "digest"), "similarity-met")
    pairs = compared(placed, texts_of(docs, met), met, n, threshold, forest)
    repeated = classes.filter("n > 1").select("digest", "least")
    copies = ids.join(repeated, "digest").filter("id <> least")
    return pairs.unionByName(copies.select(F.col("least").alias("left_id"), F.col("id").alias("right_id"), F.lit(1.0).alias("jaccard")))


def exact_groups(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id`` and ``group_id``, the least id with the same normalised text, of texts found more than once."""
    digest = F.sha2(normalised(F.col(text_col)), 256)
    keyed = docs.select(F.col(id_col).alias("id"), digest.alias("digest"))
    least = keyed.groupBy("digest").agg(F.min("id").alias("group_id"), F.count("*").alias("n")).filter("n > 1")
    return keyed.join(least, "digest").select("id", "group_id")
