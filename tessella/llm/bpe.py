"""Operator 5: byte-pair encoding and decoding with a given vocabulary.

Method: the symbols of a pre-token form a doubly linked list; every adjacent
pair that has a merge rank sits in a priority queue. The lowest rank (leftmost on
a tie) is merged, its neighbours queue their new pairs, and entries whose symbols
have changed since are skipped when they surface. Decoding concatenates the
vocabulary strings, with the separator that the file's decoder asks for.

The vocabulary file is a parameter; the driver reads it and broadcasts its
merges, whose number the file fixes. It holds 48,894 merges here, whatever the
number of documents.

Defined cases: a null or empty text has no ids (the digests are those of the
empty string); the strings of special tokens in a text become their ids; a
pre-token of any length is encoded whole in O(n log n); repeated rows are kept.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import struct
import unicodedata
from array import array
from collections.abc import Sequence
from functools import cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from tessella.llm.batches import broadcast, documents, map_batches, release
from tessella.sources import table

#: Encoded chunks that a worker remembers; beyond it the memory starts anew. The second is for a worker that does nothing else.
REMEMBERED, REMEMBERED_ALONE = 120_000, 250_000
#: Chunks longer than this are not remembered.
LONGEST_REMEMBERED = 64


@cache
def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in kept]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(rest)}


def vocabulary(path: str) -> dict:
    """What encoding needs of a tokenizer file whose pieces are those of ``word_bpe_49k.json``."""
    with open(path, encoding="utf-8") as file:
        found = json.load(file)
    model = found["model"]
    kinds = [n["type"] for n in (found["normalizer"] or {}).get("normalizers", [])]
    split, level = found["pre_tokenizer"]["pretokenizers"]
    if kinds != ["NFC", "Replace", "Lowercase"] or split["type"] != "Split" or level["type"] != "ByteLevel" or found["decoder"]:
        raise ValueError(f"{path}: this kind of tokenizer is not supported")
    ids = model["vocab"]
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    special = {t["content"]: t["id"] for t in found["added_tokens"]}
    return {
        "pattern": split["pattern"]["Regex"],
        "suffix": model["end_of_word_suffix"] or "",
        "ids": ids,
        "merges": merges,
        "special": special,
    }


class Encoder:
    """Encodes texts; remembers the chunks between ASCII white space, which no pre-token spans."""

    def __init__(self, vocab: dict, remembered: int = REMEMBERED):
        self.remembered = remembered
        ids, suffix = vocab["ids"], vocab["suffix"]
        self.pattern = regex.compile(vocab["pattern"])
        self.special = vocab["special"]
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.strings = {i: s for s, i in [*ids.items(), *self.special.items()]}
        symbols = byte_symbols()
        self.inner = [ids[symbols[b]] for b in range(256)]
        self.last = [ids[symbols[b] + suffix] for b in range(256)]
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(vocab["merges"]):
            self.ranks.setdefault((ids[a], ids[b]), (rank, ids[a + b]))
        self.decimals = {i: str(i) for i in self.strings}
        self.special_ids = {x: struct.pack("<I", i) for x, i in self.special.items()}
        self.chunks: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def merged(self, data: bytes) -> list[int]:
        """Ids of one pre-token."""
        symbols = [self.inner[b] for b in data]
        symbols[-1] = self.last[data[-1]]
        n = len(symbols)
        if n == 1:
            return symbols
        ranks = self.ranks
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        queue = [(*found, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (found := ranks.get((symbols[i], symbols[i + 1])))]
        queue = [(rank, i, new, a, b) for rank, new, i, a, b in queue]
        heapq.heapify(queue)
        while queue:
            _, i, new, a, b = heapq.heappop(queue)
            j = right[i]
            if symbols[i] != a or j >= n or symbols[j] != b:
                continue  # one of its symbols has been merged since
            symbols[i], symbols[j] = new, -1
            k = right[i] = right[j]
            if k < n:
                left[k] = i
                if found := ranks.get((new, symbols[k])):
                    heapq.heappush(queue, (found[0], i, found[1], new, symbols[k]))
            h = left[i]
            if h >= 0 and (found := ranks.get((symbols[h], new))):
                heapq.heappush(queue, (found[0], h, found[1], symbols[h], new))
        return [s for s in symbols if s >= 0]

    def word(self, word: str) -> bytes:
        found = self.words.get(word)
        if found is None:
            ids = self.merged(word.encode())
            found = struct.pack(f"<{len(ids)}I", *ids)
            if len(word) <= LONGEST_REMEMBERED:
                if len(self.words) >= self.remembered:
                    self.words.clear()
                self.words[word] = found
        return found

    def plain(self, text: str) -> bytes:
        """Ids of a stretch without special tokens."""
        return b"".join(map(self.word, self.pattern.findall(self.normal(text))))

    @staticmethod
    def normal(text: str) -> str:
        if not text.isascii():
            # each character on its own: a final sigma stays an ordinary one
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return text.lower()

    def chunk(self, chunk: str) -> bytes:
        if chunk.isascii() and chunk.isalpha():
            found = self.word(chunk.lower())
        elif self.cut is not None and "<" in chunk:
            found = b"".join([self.special_ids[x] if x in self.special else self.plain(x) for x in self.cut.split(chunk)])
        else:
            found = self.plain(chunk)
        if len(chunk) <= LONGEST_REMEMBERED:
            if len(self.chunks) >= self.remembered:
                self.chunks.clear()
            self.chunks[chunk] = found
        return found

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers: all that is remembered of a chunk, since strings of ids take several times as much."""
        out, known = [], self.chunks.get
        for x in ascii_split(text or ""):
            found = known(x)
            out.append(self.chunk(x) if found is None else found)
        return b"".join(out)

    def decode(self, ids: Sequence[int]) -> str:
        """The vocabulary strings of ``ids`` in one string; this file names no decoder, so one space joins them."""
        return " ".join(map(self.strings.__getitem__, ids))

    def decimal(self, ids: Sequence[int]) -> str:
        return " ".join(map(self.decimals.__getitem__, ids))


#: str.split() also splits at these, which are no white space of the pattern.
ODD = ("\x1c", "\x1d", "\x1e", "\x1f")


def ascii_split(text: str) -> list[str]:
    """Chunks between runs of white space. NFC composes nothing across them, and no pre-token holds one."""
    if text.isascii() and not any(c in text for c in ODD):
        return text.split()
    return [str(c, "utf-8") for c in text.encode().split()]


class Tokenizer:
    """A vocabulary, broadcast once; workers build one encoder each and keep it."""

    def __init__(self, spark: SparkSession, path: str):
        with open(path, "rb") as file:
            self.digest = hashlib.sha256(file.read()).hexdigest()
        self.path, self.held = path, broadcast(spark, vocabulary(path))


_WORKER: dict[tuple[str, int], Encoder] = {}


def worker_encoder(digest: str, held, remembered: int = REMEMBERED) -> Encoder:
    if (digest, remembered) not in _WORKER:
        _WORKER.clear()
        release()  # workers are used again: what stages before have left
        _WORKER[digest, remembered] = Encoder(held.value, remembered)
        vars(held).pop("_value", None)  # read again if it is asked for again
        release()
    return _WORKER[digest, remembered]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``ids`` (array of int) and ``n_tokens`` of each row of ``docs``; no shuffle."""
    tokenizer = Tokenizer(docs.sparkSession, path or default_path())
    held, digest = tokenizer.held, tokenizer.digest

    def make():
        encoder = worker_encoder(digest, held)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            coded = [encoder.encode(t) for t in batch.column(1).to_pylist()]
            ends = [0]
            for c in coded:
                ends.append(ends[-1] + len(c) // 4)
            values = pa.Array.from_buffers(pa.int32(), ends[-1], [None, pa.py_buffer(b"".join(coded))])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
            n = pa.array([len(c) // 4 for c in coded], pa.int64())
            return pa.RecordBatch.from_arrays([batch.column(0), lists, n], ["doc_id", "ids", "n_tokens"])

        return step

    docs = documents(docs, id_col, text_col)
    return map_batches(docs, make, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>, n_tokens long")


def decode(coded: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id`` and ``decoded`` of rows with ``doc_id`` and ``ids``; null ids decode to the empty text."""
    tokenizer = Tokenizer(coded.sparkSession, path or default_path())
    held, digest = tokenizer.held, tokenizer.digest

    def make():
        encoder = worker_encoder(digest, held)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [encoder.decode(ids or []) for ids in batch.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "decoded"])

        return step

    coded = coded.select("doc_id", "ids")
    return map_batches(coded, make, f"doc_id {coded.schema['doc_id'].dataType.simpleString()}, decoded string")


def round_trip(
    docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, remembered: int = REMEMBERED
) -> DataFrame:
    """Encode and decode each text in one pass and return the digests of both.

    Columns: ``doc_id``, ``n_tokens``, ``ids_sha256`` (of the decimal ids joined by one
    space), ``decoded_sha256`` (of the decoded text), and ``ids`` if asked for.
    """
    tokenizer = Tokenizer(docs.sparkSession, path or default_path())
    held, digest = tokenizer.held, tokenizer.digest

    def make():
        encoder = worker_encoder(digest, held, remembered)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            counts, ids_sha, text_sha, coded, ends = [], [], [], [], [0]
            for text in batch.column(1).to_pylist():
                packed = encoder.encode(text)
                ids = array("I", packed)
                counts.append(len(ids))
                ids_sha.append(hashlib.sha256(encoder.decimal(ids).encode()).hexdigest())
                text_sha.append(hashlib.sha256(encoder.decode(ids).encode()).hexdigest())
                if with_ids:
                    coded.append(packed)
                    ends.append(ends[-1] + len(ids))
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha), pa.array(text_sha)]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                values = pa.Array.from_buffers(pa.int32(), ends[-1], [None, pa.py_buffer(b"".join(coded))])
                columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values))
                names.append("ids")
            return pa.RecordBatch.from_arrays(columns, names)

        return step

    docs = documents(docs, id_col, text_col)
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_batches(docs, make, schema + ", ids array<int>" * with_ids)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), remembered=REMEMBERED_ALONE)


QUERIES = {"op5_bpe": op5_bpe}
ORACLE: dict[str, str] = {}
