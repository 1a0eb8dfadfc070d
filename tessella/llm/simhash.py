"""Operator 10: SimHash near-duplicates by Golay-code fuzzy hashing.

A fingerprint has a bit set where over half of the XXH64 hashes (seed 42) of the
text's word shingles have it. Two fingerprints link if two bits or
fewer differ.

Method: a 64-bit fingerprint is cut into segments of 22, 21 and 21 bits. Two
errors leave at least one of three segments exact (pigeonhole); the next segment
then has two errors at most. The Golay code [23,12] is perfect: of any two words
that differ in at most two bits, a word midway has a codeword within 3, so both
have that codeword within 4. The indices of the codewords within 4 of a segment
(one or six of them) are its keys. Exact segment and codeword index together make
33 bits: up to 18 keys a fingerprint. Fingerprints that share a key are compared.

Skew: equal fingerprints are one row before any key is made. Buckets of up to
``bucket`` fingerprints are compared pair by pair. Larger ones are compared
without pairs, also exactly: each member stands at itself and at its one-bit
neighbours, and those that meet at a place (two bits or fewer apart) are linked to
the least of them. That is 65 rows a member, however large the bucket.

Defined cases: null, empty or blank texts have fingerprint zero, linked like any
other; texts of fewer than three words have one shingle; exact copies share a
class; a null key is kept and never names a class; an empty table gives no rows.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.batches import documents, map_batches, row_key, without_rows
from tessella.operators.graph import connected_components
from tessella.session import written
from tessella.sources import table

SEED = 42
SHINGLE = 3
#: Bits in which linked fingerprints differ at most; segments, keys and places are made for two.
DISTANCE = 2
#: Fingerprints in a bucket that are still compared pair by pair.
BUCKET = 48
#: First bit and width of the segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
GENERATOR = 0b110001110101


def hashes(text: str | None, words: int = SHINGLE) -> list[int]:
    data = (text or "").encode().lower().split()
    if len(data) <= words:
        return [xxhash.xxh64_intdigest(b" ".join(data), SEED)] if data else []
    joined = b" ".join(data)
    ends = np.cumsum(np.fromiter(map(len, data), np.int64, len(data)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: len(data) - words + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], SEED) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist(), strict=True)]


def fingerprint(text: str | None, words: int = SHINGLE) -> int:
    found = np.array(hashes(text, words), dtype=">u8")
    if not len(found):
        return 0
    votes = np.unpackbits(found.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > len(found)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE) -> DataFrame:
    """``doc_id`` and ``fp``, the fingerprint's 64 bits as a signed long; no shuffle."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = np.array([fingerprint(t, words) for t in batch.column(1).to_pylist()], dtype=np.uint64)
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

        return step

    docs = documents(docs, id_col, text_col)
    return map_batches(docs, make, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


@cache
def golay() -> tuple[np.ndarray, np.ndarray]:
    """By syndrome: the error patterns of weight 4 or less (six columns, the first the leader's), and how many there are."""
    remainder = np.arange(1 << 23, dtype=np.int32)
    for bit in range(22, 10, -1):
        remainder = np.where(remainder >> bit & 1, remainder ^ (GENERATOR << (bit - 11)), remainder)
    patterns: dict[int, list[int]] = {}
    for weight in range(5):
        for at in combinations(range(23), weight):
            error = sum(1 << i for i in at)
            patterns.setdefault(int(remainder[error]), []).append(error)
    table_, count = np.zeros((2048, 6), np.int32), np.zeros(2048, np.int8)
    for syndrome, errors in patterns.items():
        table_[syndrome, : len(errors)], count[syndrome] = errors, len(errors)
    return table_, count


def syndromes(word: np.ndarray) -> np.ndarray:
    word = word.copy()
    for bit in range(22, 10, -1):
        word = np.where(word >> bit & 1, word ^ (GENERATOR << (bit - 11)), word)
    return word


def codeword_keys(word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and indices (12 bits) of all codewords within distance 4 of 23-bit words."""
    patterns, count = golay()
    of = syndromes(word)
    n = count[of].astype(np.int64)
    row = np.repeat(np.arange(len(word)), n)
    column = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    return row, (word[row] ^ patterns[of[row], column]) >> 11


def bucket_keys(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and bucket keys of fingerprints (uint64)."""
    cut = [((found >> np.uint64(a)) & np.uint64((1 << n) - 1)).astype(np.int64) for a, n in SEGMENTS]
    rows, keys = [], []
    for i in range(3):
        row, index = codeword_keys(cut[(i + 1) % 3])
        rows.append(row)
        keys.append((np.int64(i) << 34) | (cut[i][row] << 12) | index)
    return np.concatenate(rows), np.concatenate(keys)


def keyed(distinct: DataFrame) -> DataFrame:
    """``key`` and ``fp``: each fingerprint under its bucket keys."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = batch.column(0).to_numpy(zero_copy_only=False)
            row, key = bucket_keys(found.view(np.uint64))
            return pa.RecordBatch.from_arrays([pa.array(key), pa.array(found[row])], ["key", "fp"])

        return step

    return map_batches(distinct.select("fp"), make, "key long, fp long")


def links(distinct: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """``src`` and ``dst``: verified links that connect all distinct fingerprints within ``DISTANCE`` bits."""
    keys = written(keyed(distinct), "simhash-keys")
    sizes = keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    members = keys.join(sizes, "key")
    small = members.filter(F.col("n") <= bucket).groupBy("key").agg(F.sort_array(F.collect_list("fp")).alias("fps"))
    near = F.flatten(
        F.transform(
            "fps",
            lambda x: F.transform(
                F.filter("fps", lambda y: (y > x) & (F.bit_count(x.bitwiseXOR(y)) <= DISTANCE)),
                lambda y: F.struct(x.alias("src"), y.alias("dst")),
            ),
        )
    )
    pairs = small.select(F.explode(near).alias("p")).select("p.src", "p.dst")
    flips = [0, *(_signed(1 << b) for b in range(64))]
    places = F.transform(F.array(*[F.lit(f) for f in flips]), lambda f: F.col("fp").bitwiseXOR(f))
    large = members.filter(F.col("n") > bucket).select("key", "fp", F.explode(places).alias("place"))
    least = large.groupBy("key", "place").agg(F.min("fp").alias("dst"), F.count("*").alias("n")).filter("n > 1")
    stars = large.join(least, ["key", "place"]).filter("fp <> dst").select(F.col("fp").alias("src"), "dst")
    return pairs.unionByName(stars).distinct()


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket: int = BUCKET) -> DataFrame:
    """``doc_id``, ``fp`` and ``component_id``, the least ``doc_id`` that links reach."""
    found = written(fingerprints(docs, id_col, text_col), "simhash-fp")
    distinct = written(found.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    classes = connected_components(links(distinct, bucket=bucket))
    linked = distinct.join(classes, distinct.fp == classes.node, "left")
    linked = linked.select("fp", "least", F.coalesce("component", "fp").alias("component"))
    least = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    of = linked.join(least, "component").select("fp", "component_id")
    return found.join(of, "fp").select("doc_id", "fp", "component_id")


def hexadecimal(fp: str):
    return F.lpad(F.lower(F.hex(F.col(fp))), 16, "0")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", hexadecimal("fp").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each near-duplicate class: that of the least key, then of the least hash of its text.

    Rows with a null key are kept. Rows that repeat a key are told apart by their texts; of equal rows all stay.
    """
    keyed = docs.filter(F.col(id_col).isNotNull()).select(row_key(id_col, text_col).alias("key"), F.col(text_col).alias("text"))
    found = near_duplicates(keyed, "key", "text")
    return without_rows(docs, found.filter("doc_id <> component_id").select("doc_id"), id_col, text_col)


QUERIES = {"op10_simhash": op10_simhash}
ORACLE: dict[str, str] = {}
