"""Operator 8: token ids as files of range-coded blocks.

Method: ids are predicted by what most often follows the last one and the last two ids (orders
1 and 2) in the frame, with a level of trust for each. Whether the better prediction holds is a
binary decision whose probability mixes those of the two orders and of order 0 in the logistic
domain, with weights fitted to the frame; an id that was not predicted is coded by how often that
befalls it in the frame. A carry-less range coder takes the probabilities. The tables and weights, the frame's
model, are read off all its ids first and stored in it, so that nothing is learned in decoding. All arithmetic
of decoding is on integers (a quotient of integers below 2^30 aside, which is exact), so files decode alike everywhere. Blocks of
``BLOCK`` ids start from the same state, so with its frame's model any block decodes alone, and all
blocks of a frame are coded in step, as lanes of numpy arrays.

File format: a table of frames in Parquet (so that Spark's commit protocol covers
lost executors). ``part`` and ``seq`` give their order, which is that of the documents'
keys. A frame's bytes: ``FRAME`` header (magic, version, ids of a block, documents,
blocks, ids, bytes of the model), the documents' lengths in ids, each block's number of bytes, their CRC-32 and that of its ids, the model, the CRC-32 of
all before, then the blocks. Documents do not cross frames. ``keys`` holds the documents' keys.

Scale: documents are dealt by ranges of their key and written as they come; the
places where documents start are sums over frames within a part and over parts.

Defined cases: a null or empty text is its end id alone; null keys come first;
keys of any type that sorts keep their type and order; repeated keys are all written, in the order of their texts; a vocabulary
with ids of 65,536 or more is refused; a text of any length is
one document of a frame; an empty table has no frames. A damaged frame raises.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_type

from tessella.llm import batch_bpe, bpe
from tessella.llm.batches import documents, release, slices
from tessella.session import scratch
from tessella.sources import table

END = 1
BLOCK = 4096
#: Blocks that are coded in step.
LANES = 2048
#: Ids after which a frame ends with the next document: its blocks are coded in step, and share a model.
FRAME_IDS = (LANES - 32) * BLOCK
#: Texts that are encoded at a time.
ROWS = 2048
#: Bytes of text in a part.
PART = 48_000_000

FRAME = struct.Struct("<4sIIIIII")
MAGIC, VERSION = b"TIDF", 2

#: Bits of a pair of ids' place in the table of order 2, of the decision's probability, and of an id's interval after a missed one.
PLACES, DECISION, BITS = 16, 12, 18
TOTAL = DECISION + BITS
LEVELS = 32
#: Ids that are looked up at a time, of all lanes.
AT_ONCE = 1 << 16
WORD = np.uint64(16)
TOP, BOTTOM = np.uint64(1 << 48), np.uint64(1 << TOTAL)


def _squash() -> np.ndarray:
    x = np.arange(-2047, 2048) / 256
    return np.clip(np.round(4096 / (1 + np.exp(-x))), 1, 4095).astype(np.int64)


SQUASH = _squash()
#: The logistic value of each level of trust; level 0 has no prediction.
VALUE = np.r_[0, np.arange(1, LEVELS) * 132 - 2048]


def _inputs() -> np.ndarray:
    """What is mixed for each cell (trust in order 1, in order 2, whether both say the same): order 0, both orders where they back the best prediction, and where they don't."""
    cell = np.arange(2 * LEVELS * LEVELS)
    one, two, same = cell // (2 * LEVELS), cell // 2 % LEVELS, cell % 2
    backed_one, backed_two = (one >= two) | (same == 1), (one < two) | (same == 1)
    columns = [np.full(len(cell), 256), VALUE[one] * backed_one, VALUE[two] * backed_two, VALUE[one] * ~backed_one, VALUE[two] * ~backed_two]
    return np.stack(columns, axis=1)


INPUTS = _inputs()


def place(last: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Where the table of order 2 has what followed two ids."""
    return (last * np.uint32(0x9E3779B1) + before * np.uint32(0x85EBCA77)) >> np.uint32(32 - PLACES)


def _followers(context: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The most frequent follower of each context, as ``id << 5 | trust``."""
    keys = context << np.uint32(16) | ids
    keys.sort()
    edges = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
    counts = np.diff(np.r_[edges, len(keys)])
    keys = keys[edges]
    of = keys >> np.uint32(16)
    heads = np.flatnonzero(np.r_[True, of[1:] != of[:-1]][: len(of)])
    out = np.zeros(1 << 16, np.int32)
    if not len(heads):
        return out
    most, total = np.maximum.reduceat(counts, heads), np.add.reduceat(counts, heads)
    found = np.flatnonzero(counts == np.repeat(most, np.diff(np.r_[heads, len(of)])))
    first = found[np.searchsorted(found, heads)]
    share = most / (total + 1)
    trust = np.clip(np.ceil((np.log(share / (1 - share)) * 256 + 2048) / 132), 1, LEVELS - 1).astype(np.int64)
    kept = (most > 1) & (total > 2) & (share > 1 / 16)
    out[of[heads][kept]] = ((keys[first] & np.uint32(0xFFFF)).astype(np.int64) << 5 | trust)[kept]
    return out


def _planes(x: np.ndarray, n: int) -> bytes:
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :n].T).tobytes()


def _sparse(x: np.ndarray) -> bytes:
    """The places and values that are not 0, each by byte plane."""
    at = np.flatnonzero(x)
    return struct.pack("<I", len(at)) + _planes(np.diff(at, prepend=0), 2) + _planes(x[at], 3)


class Model:
    """What the ids of a frame are predicted by: tables of orders 1 and 2, the weights that mix them, and parts of ids that were not predicted."""

    def __init__(self, one: np.ndarray, two: np.ndarray, weights: np.ndarray, parts: np.ndarray):
        self.one, self.two, self.weights, self.parts = one, two, weights, parts
        mixed = np.clip((INPUTS * weights).sum(axis=1) >> 16, -2047, 2047)
        #: Of each cell: the probability that the best prediction holds.
        self.odds = SQUASH[mixed + 2047]
        ends = np.cumsum(parts)
        self.begin = ends - parts
        self._symbol: np.ndarray | None = None

    @property
    def symbol(self) -> np.ndarray:
        """The id at each of the parts."""
        if self._symbol is None:
            self._symbol = np.repeat(np.arange(1 << 16, dtype=np.uint16), self.parts)
        return self._symbol

    def guessed(self, last: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best prediction after two ids, and the cell it comes from."""
        one, two = self.one[last], self.two[place(last, before)]
        trust_one, trust_two = one & 31, two & 31
        best = np.where(trust_two > trust_one, two, one) >> 5
        return best, trust_one << 6 | trust_two << 1 | ((one ^ two) < 32)

    @classmethod
    def fit(cls, groups: list[tuple[np.ndarray, np.ndarray]]) -> Model:
        """The model of blocks that are columns of tables, below two rows of 0; beside each table: how many columns go on in each row."""

        def rows(step: int) -> Iterator[tuple[np.ndarray, ...]]:
            for wide, running in groups:
                for lo in range(0, len(running), step):
                    some = running[lo : lo + step]
                    inside = slice(None) if (some == wide.shape[1]).all() else np.arange(wide.shape[1]) < some[:, None]
                    yield tuple(wide[lo + k : lo + k + len(some)][inside].astype(np.uint32).ravel() for k in (2, 1, 0))

        none = np.zeros(0, np.uint32)
        ids, last, before = (np.concatenate([none, *c]) for c in zip((none, none, none), *rows(BLOCK), strict=True))
        one, two = _followers(last, ids), _followers(place(last, before), ids)
        del ids, last, before
        empty = cls(one, two, np.zeros(5, np.int64), np.full(1 << 16, 1 << BITS - 16))
        tried, held, missed = np.zeros(len(INPUTS), np.int64), np.zeros(len(INPUTS), np.int64), np.zeros(1 << 16, np.int64)
        for ids, last, before in rows(max(1, AT_ONCE // LANES)):
            best, cell = empty.guessed(last, before)
            hit = best == ids
            tried += np.bincount(cell, minlength=len(INPUTS))
            held += np.bincount(cell[hit], minlength=len(INPUTS))
            missed += np.bincount(ids[~hit], minlength=1 << 16)
        return cls(one, two, _weights(tried, held), _parts(missed))

    def dump(self) -> bytes:
        flat = bool((self.parts == self.parts[0]).all())
        raw = self.weights.astype("<i4").tobytes() + _sparse(self.one) + _sparse(self.two) + _sparse(np.zeros(0, np.int64) if flat else self.parts)
        return zlib.compress(raw, 6)

    @classmethod
    def load(cls, data: bytes) -> Model:
        raw, at, tables = zlib.decompress(data), 20, []
        for _ in range(3):
            (n,) = struct.unpack_from("<I", raw, at)
            planes = np.frombuffer(raw, np.uint8, 5 * n, at + 4).reshape(5, n).astype(np.int64)
            table = np.zeros(1 << 16, np.int64)
            table[np.cumsum(planes[0] | planes[1] << 8)] = planes[2] | planes[3] << 8 | planes[4] << 16
            tables.append(table if n else None)
            at += 4 + 5 * n
        one, two = (np.zeros(1 << 16, np.int32) if t is None else t.astype(np.int32) for t in tables[:2])
        parts = np.full(1 << 16, 1 << BITS - 16) if tables[2] is None else tables[2]
        return cls(one, two, np.frombuffer(raw, "<i4", 5).astype(np.int64), parts)


def _weights(tried: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Whole weights of the mix, by Newton's steps on how often the predictions of each cell held; what they are decides on size alone."""
    x, n, y, w = INPUTS / 256, tried.astype(float), held.astype(float), np.array([0.0, 0.5, 0.5, 0.0, 0.0])
    for _ in range(12):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -8, 8)))
        slope = x.T @ (y - n * p) - w
        curve = (x * (n * p * (1 - p))[:, None]).T @ x + np.eye(5)
        w = np.clip(w + np.clip(np.linalg.solve(curve, slope), -1, 1), -16, 16)
    return np.round(w * (1 << 16)).astype(np.int64)


def _parts(missed: np.ndarray) -> np.ndarray:
    """How many of 2^BITS parts each id has, by how often it was not predicted; equal ones if a table would take more than it saves."""
    flat, total, used = np.full(1 << 16, 1 << BITS - 16), int(missed.sum()), np.flatnonzero(missed)
    if not total:
        return flat
    parts = np.zeros(1 << 16, np.int64)
    parts[used] = 1 + missed[used] * ((1 << BITS) - len(used)) // total
    parts[missed.argmax()] += (1 << BITS) - parts.sum()
    cost = (missed[used] * (BITS - np.log2(parts[used]))).sum() / 8 + len(zlib.compress(_sparse(parts), 1))
    return parts if cost < 2 * total else flat


class Coder:
    """The lanes' intervals, and their words out or in."""

    def __init__(self, lanes: int, longest: int, data: list[bytes] | None = None):
        self.low, self.range = np.zeros(lanes, np.uint64), np.full(lanes, ~np.uint64(0))
        self.rows, self.at = np.arange(lanes), np.zeros(lanes, np.int64)
        self.code = np.zeros(lanes, np.uint64) if data is not None else None
        width = 2 * longest + 8 if data is None else max(map(len, data), default=0) // 2 + 8  # two words an id at most
        self.words = np.zeros((lanes, width), np.uint16)
        for i, d in enumerate(data or []):
            self.words[i, : len(d) // 2] = np.frombuffer(d, "<u2")
        if data is not None:
            for _ in range(4):
                self._take(self.rows)

    def _take(self, lanes: np.ndarray) -> None:
        at = self.at[lanes]
        self.code[lanes] = self.code[lanes] << WORD | self.words[lanes, at]
        self.at[lanes] = at + 1

    def narrow(self, n: int, unit: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
        """The first ``n`` lanes' intervals become the parts from ``start`` of ``size`` units; settled words go out or come in."""
        low, wide = self.low[:n], self.range[:n]
        low += unit * start
        np.multiply(unit, size, out=wide)
        settled = (low ^ (low + wide)) < TOP
        some = np.flatnonzero(settled | (wide < BOTTOM))
        settled = settled[some]
        while len(some):
            some_low = low[some]
            # an interval too narrow to go on, yet astride a word's edge, is cut off at that edge
            some_wide = np.where(settled, wide[some], -some_low & (BOTTOM - np.uint64(1)))
            if self.code is not None:
                self._take(some)
            else:
                at = self.at[some]
                self.words[some, at] = some_low >> np.uint64(48)
                self.at[some] = at + 1
            some_low, some_wide = some_low << WORD, some_wide << WORD
            low[some], wide[some] = some_low, some_wide
            settled = (some_low ^ (some_low + some_wide)) < TOP
            more = settled | (some_wide < BOTTOM)
            some, settled = some[more], settled[more]

    def put(self, model: Model, wide: np.ndarray, running: np.ndarray) -> list[bytes]:
        """The lanes' bytes; ``wide`` and ``running`` as in ``Model.fit``."""
        step = max(1, AT_ONCE // len(self.rows))
        for lo in range(0, len(running), step):
            hi = min(len(running), lo + step)
            ids, last, before = (wide[lo + k : hi + k].astype(np.uint32) for k in (2, 1, 0))
            best, cell = model.guessed(last, before)
            hit, odds = best == ids, model.odds[cell]
            start = np.where(hit, 0, (odds << BITS) + (4096 - odds) * model.begin[ids]).astype(np.uint64)
            size = np.where(hit, odds << BITS, (4096 - odds) * model.parts[ids]).astype(np.uint64)
            for t in range(lo, hi):
                n = int(running[t])
                self.narrow(n, self.range[:n] >> np.uint64(TOTAL), start[t - lo, :n], size[t - lo, :n])
        for _ in range(4):
            self.words[self.rows, self.at] = self.low >> np.uint64(48)
            self.low = self.low << WORD
            self.at += 1
        return [self.words[i, :n].astype("<u2").tobytes() for i, n in enumerate(self.at.tolist())]

    def get(self, model: Model, running: np.ndarray) -> np.ndarray:
        """The lanes' ids, as columns."""
        wide = np.zeros((len(running) + 2, len(self.rows)), np.uint32)
        symbols = model.symbol
        for t, n in enumerate(running.tolist()):
            best, cell = model.guessed(wide[t + 1, :n], wide[t, :n])
            odds = model.odds[cell]
            unit = self.range[:n] >> np.uint64(TOTAL)
            value = np.minimum((self.code[:n] - self.low[:n]) // unit, BOTTOM - np.uint64(1)).astype(np.int64)
            size = odds << BITS
            start = np.zeros(n, np.int64)
            missed = np.flatnonzero(value >= size)
            if len(missed):
                base, rest = size[missed], 4096 - odds[missed]
                symbol = symbols[((value[missed] - base) / rest).astype(np.int64)]  # whole numbers below 2^30: exact
                best[missed] = symbol
                start[missed] = base + rest * model.begin[symbol]
                size[missed] = rest * model.parts[symbol]
            self.narrow(n, unit, start.astype(np.uint64), size.astype(np.uint64))
            wide[t + 2, :n] = best
        return wide[2:]


def _in_step(sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks in groups of ``LANES``, the longer first, with the number of lanes that still run at each step."""
    order = np.argsort(-sizes, kind="stable")
    for i in range(0, len(order), LANES):
        group = order[i : i + LANES]
        yield group, np.searchsorted(-sizes[group], -np.arange(sizes[group[0]] if len(group) else 0), side="left")


def pack_with(blocks: list[np.ndarray]) -> tuple[Model, list[bytes]]:
    """Range-coded bytes of blocks of ids below 65,536, and the model of them all."""
    groups, out = [], [b""] * len(blocks)
    for group, running in _in_step(np.array([len(b) for b in blocks], np.int64)):
        wide = np.zeros((len(running) + 2, len(group)), np.uint16)
        for lane, i in enumerate(group):
            wide[2 : len(blocks[i]) + 2, lane] = blocks[i]
        groups.append((group, running, wide))
    model = Model.fit([(wide, running) for _, running, wide in groups])
    for group, running, wide in groups:
        for lane, data in zip(group, Coder(len(group), len(running)).put(model, wide, running), strict=True):
            out[lane] = data
    return model, out


def unpack_with(data: list[bytes], sizes: list[int], model: Model) -> list[np.ndarray]:
    out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(data)
    for group, running in _in_step(np.array(sizes, np.int64)):
        wide = Coder(len(group), 0, [data[i] for i in group]).get(model, running)
        for lane, i in enumerate(group):
            out[i] = wide[: sizes[i], lane].copy()
    return out


def pack(blocks: list[np.ndarray]) -> list[bytes]:
    """Blocks that stand alone: each has a model of its own before it."""
    out = []
    for block in blocks:
        model, (data,) = pack_with([block])
        held = model.dump()
        out.append(struct.pack("<I", len(held)) + held + data)
    return out


def unpack(data: list[bytes], sizes: list[int]) -> list[np.ndarray]:
    """The ids of blocks that stand alone, whose numbers of ids are ``sizes``."""
    out = []
    for one, size in zip(data, sizes, strict=True):
        end = 4 + struct.unpack_from("<I", one)[0]
        out += unpack_with([one[end:]], [size], Model.load(one[4:end]))
    return out


def cut(ids: np.ndarray) -> list[np.ndarray]:
    return [ids[i : i + BLOCK] for i in range(0, len(ids), BLOCK)]


def frame(lengths: np.ndarray, ids: np.ndarray) -> bytes:
    blocks = cut(ids)
    model, packed = pack_with(blocks)
    held = model.dump()
    head = FRAME.pack(MAGIC, VERSION, BLOCK, len(lengths), len(blocks), len(ids), len(held)) + lengths.astype("<u8").tobytes()
    index = [(len(p), zlib.crc32(p), zlib.crc32(b.astype("<u4").tobytes())) for p, b in zip(packed, blocks, strict=True)]
    head += np.array(index, "<u4").reshape(-1, 3).tobytes() + held
    return b"".join([head, struct.pack("<I", zlib.crc32(head)), *packed])


def opened(data: bytes) -> tuple[np.ndarray, np.ndarray, list[bytes], list[int]]:
    """Lengths of the documents, CRC-32 of the blocks' ids, their bytes and numbers of ids; raises if anything is damaged."""
    magic, version, block, docs, blocks, ids, held = FRAME.unpack_from(data)
    if (magic, version) != (MAGIC, VERSION):
        raise ValueError("not a frame of this format")
    end = FRAME.size + 8 * docs + 12 * blocks + held
    if end + 4 > len(data) or zlib.crc32(data[:end]) != struct.unpack_from("<I", data, end)[0]:
        raise ValueError("a frame's header is damaged")
    lengths = np.frombuffer(data, "<u8", docs, FRAME.size)
    index = np.frombuffer(data, "<u4", 3 * blocks, FRAME.size + 8 * docs).reshape(-1, 3)
    ends = end + 4 + np.cumsum(index[:, 0], dtype=np.int64)
    packed = [data[e - n : e] for e, n in zip(ends.tolist(), index[:, 0].tolist(), strict=True)]
    if [zlib.crc32(p) for p in packed] != index[:, 1].tolist():
        raise ValueError("a block's bytes are damaged")
    return lengths, index[:, 2], packed, [min(block, ids - i * block) for i in range(blocks)]


def model_of(data: bytes) -> Model:
    """The model of a frame that ``opened`` has found whole."""
    _, _, _, docs, blocks, _, held = FRAME.unpack_from(data)
    start = FRAME.size + 8 * docs + 12 * blocks
    return Model.load(data[start : start + held])


def write(docs: DataFrame, path: str, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the ids of all texts, each followed by ``END``, in ascending order of key."""
    spark = docs.sparkSession
    held = bpe.Tokenizer(spark, tokenizer or bpe.default_path())
    value, digest = held.held, held.digest
    largest = max([*value.value["ids"].values(), *value.value["special"].values()])
    if largest >= 1 << 16:
        raise ValueError(f"ids up to {largest}: this format holds ids below 65,536")
    docs = documents(docs, id_col, text_col)
    kind = docs.schema["doc_id"].dataType
    arrow = to_arrow_type(kind)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    dealt = docs.repartitionByRange(max(1, -(-size // PART)), "doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seq = batch_bpe.BatchEncoder(bpe.worker_encoder(digest, value)), TaskContext.get().partitionId(), 0
        keys: list = []
        texts: list[np.ndarray] = []
        waiting = 0

        def close() -> pa.RecordBatch:
            nonlocal seq, waiting, keys, texts
            lengths = np.array([len(t) + 1 for t in texts])
            ids = np.full(lengths.sum(), END, np.uint16)
            last = np.zeros(len(ids), bool)
            last[np.cumsum(lengths) - 1] = True
            ids[~last] = np.concatenate(texts)
            data = frame(lengths, ids)
            columns = [pa.array([part], pa.int32()), pa.array([seq], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([keys], pa.list_(arrow)), pa.array([data], pa.binary())]
            seq, waiting, keys, texts = seq + 1, 0, [], []
            return pa.RecordBatch.from_arrays(columns, ["part", "seq", "n_ids", "keys", "data"])

        for batch in batches:
            for some in slices(batch, ROWS):
                for key, ids in zip(some.column(0).to_pylist(), encoder.encode(some.column(1).to_pylist()), strict=True):
                    keys.append(key)
                    texts.append(ids.astype(np.uint16))
                    waiting += len(ids) + 1
                    if waiting >= FRAME_IDS:
                        yield close()
        if keys:
            yield close()
        release()

    dealt.mapInArrow(run, f"part int, seq long, n_ids long, keys array<{kind.simpleString()}>, data binary").write.option("compression", "none").parquet(path)


def read(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """``doc_id``, ``start`` (ids of all documents before), ``n_tokens``, ``ids_crc32`` of each document of the files, and its ``ids`` if asked for."""
    frames = spark.read.parquet(path)
    key = frames.schema["keys"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data in enumerate(batch.column(3)):
                data = data.as_py()
                lengths, checks, packed, sizes = opened(data)
                blocks = unpack_with(packed, sizes, model_of(data))
                for block, check in zip(blocks, checks.tolist(), strict=True):
                    if zlib.crc32(block.astype("<u4").tobytes()) != check:
                        raise ValueError("a block is damaged")
                ids = np.concatenate(blocks).astype("<u4") if blocks else np.zeros(0, "<u4")
                ends = np.cumsum(lengths.astype(np.int64))
                parts = [ids[e - n : e] for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                n = len(parts)
                columns = [pa.array([batch.column(0)[row].as_py()] * n, pa.int32()), pa.array([batch.column(1)[row].as_py()] * n, pa.int64())]
                columns += [batch.column(2)[row].values, pa.array(ends - lengths.astype(np.int64)), pa.array(lengths.astype(np.int64))]
                columns.append(pa.array([zlib.crc32(p.tobytes()) for p in parts], pa.int64()))
                names = ["part", "seq", "doc_id", "within", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array([p.astype(np.int64) for p in parts], pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"part int, seq long, doc_id {key}, within long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    rows = frames.select("part", "seq", "keys", "data").mapInArrow(run, schema)
    counts = frames.select("part", "seq", "n_ids")
    parts = counts.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    parts = parts.select("part", F.coalesce(before, F.lit(0)).alias("part_start"))
    inside = F.sum("n_ids").over(W.partitionBy("part").orderBy("seq").rowsBetween(W.unboundedPreceding, -1))
    starts = counts.select("part", "seq", F.coalesce(inside, F.lit(0)).alias("frame_start")).join(parts, "part")
    rows = rows.join(starts, ["part", "seq"]).withColumn("start", F.col("part_start") + F.col("frame_start") + F.col("within"))
    return rows.select("doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids)


def op8_idfiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "idfiles")
    write(table(spark, sf_dir, "documents"), path)
    return read(spark, path)


QUERIES = {"op8_idfiles": op8_idfiles}
ORACLE: dict[str, str] = {}
