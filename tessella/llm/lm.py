"""Operator 1: language-model scoring with a weighted backoff automaton.

Model: n-grams up to ``order`` words, each order smoothed towards the shorter one
(Dirichlet prior of ``STRENGTH`` pseudo-tokens); the shortest is the base: additive
counts over the training words and one unknown word. Every order is a distribution.

Method: histories are states. A seen n-gram is an arc with its log-probability; a
failure arc, weighted with the mass a history leaves to others, leads to the history
without its first word. A text is read once, from left to right: the state is
carried, words without an arc take failure arcs, and weights add up. All texts of a
block take their steps together.

Scale: the model is never in one place. Documents are dealt into blocks of about
``BLOCK`` bytes by hash of key and text. A block sends each distinct n-gram once, as
a 64-bit hash with its training count, to one of as many shards; the shards add up and
answer; the block builds the automaton of just its own n-grams. Blocks and shards
grow in number, not in size; a frequent n-gram is one entry a block, so none is hot.
N and V are the only values that pass the driver. No n-gram is cut off.

Defined cases: a null, empty or blank text is its end alone; a null key counts as
the empty key; without training rows all counts are 0; repeated rows score alike and
each counts in training; an empty table gives no rows. Words are equal if their
64-bit hashes are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tessella.llm.batches import slices
from tessella.session import written
from tessella.sources import table

ORDER = 2
#: Pseudo-tokens that a history gives to the shorter order.
STRENGTH = 1000.0
#: Bytes of text in a block, and what a shard's share is made of.
BLOCK = 8_000_000
#: Bytes of text that a task deals over the blocks at a time.
AT_ONCE = 32_000_000
ADD = 0.1
#: The end of a text (no word is empty) and what stands before its first word.
END, BEGIN = 0, 1


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64-bit hash of pairs of 64-bit hashes."""
    with np.errstate(over="ignore"):
        x = a * np.uint64(0x9E3779B97F4A7C15) + b
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def packed(x: np.ndarray) -> bytes:
    """Sorted 64-bit numbers as the bytes of their differences, highest bytes first: the first planes are zeros, which shuffles compress."""
    steps = np.diff(x, prepend=np.uint64(0)).astype(">u8")
    return steps.view(np.uint8).reshape(-1, 8).T.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    steps = np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(">u8").ravel()
    return np.cumsum(steps.astype(np.uint64), dtype=np.uint64)


def small(x: np.ndarray) -> bytes:
    """Counts by byte plane, in as many bytes as the largest needs, after that number."""
    most = int(x.max(initial=0))
    width = next(w for w in (1, 2, 4, 8) if most < 1 << 8 * w)
    return bytes([width]) + x.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes()


def grown(data: bytes) -> np.ndarray:
    width = data[0]
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, offset=1).reshape(width, -1).T).view(f"<u{width}").ravel().astype(np.int64)


class Grams:
    """Distinct n-grams of a block of texts.

    Of each order k: ``keys[k]`` (number of the prefix of order k - 1 times the words, plus the last word;
    sorted), ``hashes[k]``, and ``at[k]``, the number of the n-gram that ends at a place, -1 if the text is too short.
    """

    def __init__(self, texts: list[str | None], order: int):
        ids: dict[bytes, int] = {b"": END, b"\n": BEGIN}
        rows = []
        for text in texts:
            words = (text or "").encode().lower().split()
            words.append(b"")
            row = [ids.get(w, -1) for w in words]
            if -1 in row:
                row = [ids.setdefault(w, len(ids)) for w in words]
            rows.append(np.array(row, np.int32))
        self.lengths = np.array([len(r) for r in rows], np.int64)
        self.words = np.concatenate(rows).astype(np.int64) if rows else np.zeros(0, np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.size, self.order = len(ids), order
        word_hash = np.fromiter((xxhash.xxh64_intdigest(w) for w in ids), np.uint64, len(ids))
        self.keys, self.hashes, self.at = {1: np.arange(self.size)}, {1: word_hash}, {1: self.words}
        first = np.zeros(len(self.words), bool)
        first[self.starts] = True
        before = np.where(first, BEGIN, np.roll(self.words, 1))
        for k in range(2, order + 1):
            key = before * self.size + self.words
            key[before < 0] = -1
            self.keys[k], place = np.unique(key, return_inverse=True)
            if len(self.keys[k]) and self.keys[k][0] < 0:
                self.keys[k], place = self.keys[k][1:], place - 1
            self.at[k] = place
            prefix, last = self.keys[k] // self.size, self.keys[k] % self.size
            self.hashes[k] = mixed(self.hashes[k - 1][prefix], word_hash[last])
            before = np.where(first, -1, np.roll(place, 1))

    def counts(self, training: np.ndarray) -> dict[int, np.ndarray]:
        inside = np.repeat(training, self.lengths)
        out = {}
        for k in range(1, self.order + 1):
            place = self.at[k][inside]
            out[k] = np.bincount(place[place >= 0], minlength=len(self.keys[k]))
        return out

    def dealt(self, k: int, shards: int) -> tuple[np.ndarray, np.ndarray]:
        """The n-grams' order by hash; where each shard's begin. Shards are ranges of hashes, so that those of a shard are near each other."""
        order = np.argsort(self.hashes[k], kind="stable")
        shard = (self.hashes[k][order] >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)
        return order, np.searchsorted(shard, np.arange(shards + 1, dtype=np.uint64))


class Automaton:
    """States: 0 is the empty history; the n-grams of orders below ``order`` follow, order by order."""

    def __init__(self, grams: Grams, counts: dict[int, np.ndarray], total: int, distinct: int, strength: float):
        self.grams, self.size = grams, grams.size
        counts = {k: c.copy() for k, c in counts.items()}
        base = np.log10((counts[1] + ADD) / (total + ADD * (distinct + 1)))
        counts[1][BEGIN] = counts[1][END]  # as a history
        offset, n = {0: 0, 1: 1}, 1 + self.size
        for k in range(2, grams.order):
            offset[k] = n
            n += len(grams.keys[k])
        self.fail, self.loss = np.zeros(n, np.int64), np.zeros(n)
        # number of the n-gram of order k - 1 that an n-gram of order k ends with
        shorter = {}
        for k in range(2, grams.order + 1):
            shorter[k] = np.full(len(grams.keys[k]), -1)
            inside = grams.at[k] >= 0
            shorter[k][grams.at[k][inside]] = grams.at[k - 1][inside]
        for k in range(1, grams.order):
            own = offset[k] + np.arange(len(grams.keys[k]))
            self.fail[own] = 0 if k == 1 else offset[k - 1] + shorter[k]
            self.loss[own] = np.log10(strength / (counts[k] + strength))
        weight, keys, weights, nexts = {1: base}, [np.arange(self.size)], [base], [offset[1] + np.arange(self.size)]
        for k in range(2, grams.order + 1):
            prefix = grams.keys[k] // self.size
            lower = 10.0 ** weight[k - 1][shorter[k]]
            weight[k] = np.log10((counts[k] + strength * lower) / (counts[k - 1][prefix] + strength))
            seen = counts[k] > 0
            state = offset[k - 1] + prefix
            keys.append((state * self.size + grams.keys[k] % self.size)[seen])
            weights.append(weight[k][seen])
            nexts.append((offset[k] + np.arange(len(seen)) if k < grams.order else offset[k - 1] + shorter[k])[seen])
        # histories without training have no arcs and lose nothing on failing: reading on from them or from shorter ones is the same
        order = np.argsort(np.concatenate(keys), kind="stable")
        self.keys, self.weights, self.nexts = np.concatenate(keys)[order], np.concatenate(weights)[order], np.concatenate(nexts)[order]

    def read(self) -> np.ndarray:
        """Log-probability of each text. Longer texts come first, so the texts still being read are a prefix."""
        lengths, starts, words = self.grams.lengths, self.grams.starts, self.grams.words
        order = np.argsort(-lengths, kind="stable")
        left = lengths[order]
        state = np.full(len(order), 1 + BEGIN, np.int64)
        score = np.zeros(len(order))
        place = starts[order].copy()
        alive = len(order)
        for step in range(int(left[0]) if len(left) else 0):
            while alive and left[alive - 1] <= step:
                alive -= 1
            word = words[place[:alive]]
            at = np.arange(alive)
            while len(at):
                key = state[at] * self.size + word[at]
                arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                found = self.keys[arc] == key
                taken, arc = at[found], arc[found]
                score[taken] += self.weights[arc]
                state[taken] = self.nexts[arc]
                at = at[~found]
                score[at] += self.loss[state[at]]
                state[at] = self.fail[state[at]]
            place[:alive] += 1
        out = np.empty(len(order))
        out[order] = score
        return out


class Rows:
    """How rows travel: those of a block that are dealt at a time are a compressed record batch."""

    def __init__(self, kind: pa.DataType):
        self.schema = pa.schema([("doc_id", kind), ("text", pa.string()), ("held_out", pa.bool_())])

    def pack(self, rows: pa.Table) -> tuple[int, bytes]:
        """The bytes and their number uncompressed."""
        (batch,) = rows.cast(self.schema).combine_chunks().to_batches()
        data = batch.serialize()
        return data.size, pa.compress(data, codec="zstd", asbytes=True)

    def unpack(self, block: pa.Table) -> pa.Table:
        """All rows of the column ``rows``."""
        found = zip(block.column("size").to_pylist(), block.column("rows").to_pylist(), strict=True)
        batches = [pa.ipc.read_record_batch(pa.decompress(data, size, codec="zstd"), self.schema) for size, data in found]
        return pa.Table.from_batches(batches, self.schema)

    def dealt(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """``block``, ``size`` and ``rows`` of batches of the key, the text, ``held_out`` and ``block``."""
        waiting: list[pa.RecordBatch] = []
        held = 0
        for batch in batches:
            for part in slices(batch):
                waiting.append(part)
                held += part.nbytes
                if held >= AT_ONCE:
                    yield self._blocks(waiting)
                    waiting, held = [], 0
        if waiting:
            yield self._blocks(waiting)

    def _blocks(self, waiting: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(waiting)
        block = rows.column("block").to_numpy()
        order = np.argsort(block, kind="stable")
        edges = np.flatnonzero(np.diff(block[order], prepend=-1))
        found = [self.pack(rows.select(self.schema.names).take(some)) for some in np.split(order, edges[1:])]
        columns = [pa.array(block[order[edges]]), pa.array([n for n, _ in found], pa.int64()), pa.array([d for _, d in found], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["block", "size", "rows"])


def remainder(key: Column) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 10


def requests(number: int, block: pa.Table, order: int, shards: int) -> pa.Table:
    """For each shard: the n-grams of the block of that ``number`` that the shard adds up, with their training counts."""
    grams = Grams(block.column("text").to_pylist(), order)
    counts = grams.counts(~block.column("held_out").to_numpy())
    columns: dict[str, list] = {"shard": list(range(shards)), "block": [number] * shards}
    for k in range(1, order + 1):
        by, ends = grams.dealt(k, shards)
        hashes, n = grams.hashes[k][by], counts[k][by].astype(np.int64)
        columns[f"h{k}"] = [packed(hashes[a:b]) for a, b in zip(ends, ends[1:], strict=False)]
        columns[f"c{k}"] = [small(n[a:b]) for a, b in zip(ends, ends[1:], strict=False)]
    return pa.table(columns, schema=request_schema(order))


def request_schema(order: int) -> pa.Schema:
    kinds = [(f"{x}{k}", pa.binary()) for k in range(1, order + 1) for x in "hc"]
    return pa.schema([("shard", pa.int64()), ("block", pa.int64()), *kinds])


def answers(shard: pa.Table, order: int) -> pa.Table:
    """Sums over all blocks, in the order in which each block asked; the first block's row also has the shard's N and V."""
    columns: dict[str, list] = {"block": shard.column("block").to_pylist(), "shard": shard.column("shard").to_pylist()}
    tokens = distinct = 0
    for k in range(1, order + 1):
        asked = [unpacked(x) for x in shard.column(f"h{k}").to_pylist()]
        n = np.concatenate([grown(x) for x in shard.column(f"c{k}").to_pylist()])
        known, place = np.unique(np.concatenate(asked), return_inverse=True)
        total = np.zeros(len(known), np.int64)
        np.add.at(total, place, n)
        ends = np.cumsum([0, *map(len, asked)])
        total_at = total[place]
        columns[f"c{k}"] = [small(total_at[a:b]) for a, b in zip(ends, ends[1:], strict=False)]
        if k == 1:
            tokens, distinct = int(total.sum()), int((total > 0).sum())
    rows = len(columns["block"])
    columns["tokens"], columns["distinct"] = [tokens] + [0] * (rows - 1), [distinct] + [0] * (rows - 1)
    kinds = [(f"c{k}", pa.binary()) for k in range(1, order + 1)]
    return pa.table(columns, schema=pa.schema([("block", pa.int64()), ("shard", pa.int64()), *kinds, ("tokens", pa.int64()), ("distinct", pa.int64())]))


OUT = "doc_id {id}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def scores(block: pa.Table, answered: pa.Table, order: int, shards: int, total: int, distinct: int, strength: float) -> pa.Table:
    grams = Grams(block.column("text").to_pylist(), order)
    rows = {s: i for i, s in enumerate(answered.column("shard").to_pylist())}
    counts = {}
    for k in range(1, order + 1):
        by, _ = grams.dealt(k, shards)
        got = answered.column(f"c{k}")
        counts[k] = np.empty(len(by), np.int64)
        counts[k][by] = np.concatenate([grown(got[rows[s]].as_py()) for s in range(shards)])
    known = (counts[1] > 0)[grams.words]
    base = np.log10((counts[1] + ADD) / (total + ADD * (distinct + 1)))[grams.words]
    n = len(grams.lengths)
    sums = lambda x: np.add.reduceat(x, grams.starts) if n else np.zeros(0)
    found = Automaton(grams, counts, total, distinct, strength).read()
    columns = [grams.lengths, sums(known.astype(np.int64)), np.full(n, total), sums(base), found]
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    return pa.table([block.column("doc_id"), block.column("held_out"), *map(pa.array, columns)], names=names)


def score(
    docs: DataFrame,
    held_out: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    order: int = ORDER,
    strength: float = STRENGTH,
    block_bytes: int = BLOCK,
) -> DataFrame:
    """Scores of all rows by a model of the rows where ``held_out`` is false; see ``OUT`` for the columns."""
    held = F.coalesce(held_out, F.lit(False)).alias("held_out")
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), held)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = shards = max(1, math.ceil(size / block_bytes))
    rows = Rows(to_arrow_type(docs.schema["doc_id"].dataType))
    dealt = docs.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks))).mapInArrow(rows.dealt, "block long, size long, rows binary")
    fields = ", ".join(f"h{k} binary, c{k} binary" for k in range(1, order + 1))
    asked = dealt.groupBy("block").applyInArrow(
        lambda t: requests(t.column("block")[0].as_py(), rows.unpack(t), order, shards), f"shard long, block long, {fields}"
    )
    fields = ", ".join(f"c{k} binary" for k in range(1, order + 1))
    replies = asked.groupBy("shard").applyInArrow(lambda t: answers(t, order), f"block long, shard long, {fields}, tokens long, distinct long")
    replies = written(replies, "lm-counts")
    total, distinct = replies.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()
    replies = replies.drop("tokens", "distinct")
    kind = docs.schema["doc_id"].dataType.simpleString()
    both = dealt.groupBy("block").cogroup(replies.groupBy("block"))
    return both.applyInArrow(lambda t, a: scores(rows.unpack(t), a, order, shards, total, distinct, strength), OUT.format(id=kind))


def op1_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), remainder(F.col("doc_id")) == 0)


QUERIES = {"op1_lm": op1_lm}
ORACLE: dict[str, str] = {}
