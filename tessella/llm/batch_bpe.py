"""Byte-pair encoding of many texts at a time, in arrays; ids are those of ``bpe.Encoder``.

Method: pre-tokens are cut by kinds of characters, equal ones are found by hash (and compared, character by
character), and distinct ones of one length in bytes are merged in step: each round the pair of least rank that comes
first in each, as the queue takes them. Texts with a special token in them, and vocabularies of another pattern,
go to ``bpe.Encoder``.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import cache

import numpy as np
import regex

from tessella.llm.bpe import Encoder

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
TAILS = ("s", "t", "re", "ve", "m", "ll", "d")
SPACE, LETTER, NUMBER, OTHER = range(4)
#: Bytes of pre-tokens that are merged in step; longer ones have a queue each.
IN_STEP = 32
#: Characters of texts that are held as arrays; longer texts, and those with special tokens, are encoded alone.
LONGEST = 8_000_000
#: The rank of two symbols that are never merged.
NEVER = (1 << 22) - 1


@cache
def kinds() -> np.ndarray:
    """The kind of each character, as the pattern has them."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    found = np.full(len(every), OTHER, np.uint8)
    for kind, pattern in ((SPACE, r"\s+"), (LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for m in regex.finditer(pattern, every):
            found[m.start() : m.end()] = kind
    return np.concatenate([found[:0xD800], np.full(0x800, OTHER, np.uint8), found[0xD800:]])


class Pairs:
    """Ranks of pairs of ids, in an open hash table of ``pair << 22 | rank``, and the id that each rank makes."""

    def __init__(self, ranks: dict[tuple[int, int], tuple[int, int]]):
        self.bits = max(4, (4 * len(ranks)).bit_length())
        self.table = np.full(1 << self.bits, ~np.uint64(0))
        self.new = np.zeros(max([rank for rank, _ in ranks.values()], default=0) + 1, np.int32)
        mask = (1 << self.bits) - 1
        slots = self._slots(np.array([a << 21 | b for a, b in ranks], np.uint64)).tolist()
        taken: dict[int, int] = {}
        for slot, ((a, b), (rank, new)) in zip(slots, ranks.items(), strict=True):
            while slot in taken:
                slot = (slot + 1) & mask
            taken[slot] = (a << 21 | b) << 22 | rank
            self.new[rank] = new
        self.table[list(taken)] = np.array(list(taken.values()), np.uint64)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a.astype(np.uint64) << np.uint64(21) | b.astype(np.uint64)
        slot = self._slots(keys)
        held = self.table[slot]
        out = (held & np.uint64(NEVER)).astype(np.int32)
        some = np.flatnonzero((held >> np.uint64(22)) != keys)
        slot, held = slot[some], held[some]
        out[some] = NEVER
        while True:
            going = held != ~np.uint64(0)
            some, slot = some[going], (slot[going] + 1) & (len(self.table) - 1)
            if not len(some):
                return out
            held = self.table[slot]
            mine = (held >> np.uint64(22)) == keys[some]
            out[some[mine]] = (held[mine] & np.uint64(NEVER)).astype(np.int32)
            some, slot, held = some[~mine], slot[~mine], held[~mine]


class BatchEncoder:
    """An ``Encoder`` for many texts at a time."""

    def __init__(self, encoder: Encoder):
        self.encoder = encoder
        self.known = encoder.pattern.pattern == PATTERN and max(map(max, encoder.ranks), default=0) < 1 << 21 and len(encoder.ranks) < NEVER
        self.pairs = Pairs(encoder.ranks) if self.known else None
        self.inner, self.last = np.array(encoder.inner, np.int32), np.array(encoder.last, np.int32)
        random = np.random.default_rng(11)
        self.values = random.integers(1, 1 << 63, 1 << 16, np.uint64) * np.uint64(2) + np.uint64(1)
        self.steps = random.integers(1, 1 << 63, 1 << 8, np.uint64) * np.uint64(2) + np.uint64(1)

    def one(self, text: str | None) -> np.ndarray:
        return np.frombuffer(self.encoder.encode(text), "<u4").astype(np.int32)

    def encode(self, texts: Sequence[str | None]) -> list[np.ndarray]:
        """Ids of each text."""
        cut = self.encoder.cut
        plain = [self.known and (t is None or len(t) <= LONGEST and (cut is None or "<" not in t or not cut.search(t))) for t in texts]
        found = self._plain([self.encoder.normal(t) if p and t else "" for t, p in zip(texts, plain, strict=True)])
        return [f if p else self.one(t) for f, p, t in zip(found, plain, texts, strict=True)]

    def _opens(self, chars: np.ndarray, ends: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where pre-tokens begin, and how many characters they have."""
        kind = kinds()[chars]
        inside = kind != SPACE
        opens = inside.copy()
        opens[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
        heads = (ends - size)[size > 0]
        opens[heads] = inside[heads]
        at = np.flatnonzero(opens & (chars == ord("'")))
        end = ends[np.searchsorted(ends, at, side="right")]
        for tail in TAILS:
            fits = at + len(tail) < end
            mine, its_end = at[fits], end[fits]
            for k, x in enumerate(tail, 1):
                same = chars[mine + k] == ord(x)
                mine, its_end = mine[same], its_end[same]
            opens[mine + 1] = False
            after = (mine + 1 + len(tail))[mine + 1 + len(tail) < its_end]
            opens[after] = inside[after]
        stops = np.flatnonzero(opens | ~inside)
        first = opens[stops]
        start = stops[first]
        return start, np.r_[stops[1:], len(chars)][: len(stops)][first] - start

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        ends, whole = np.cumsum(size), "".join(texts)
        chars = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        start, length = self._opens(chars, ends, size) if len(chars) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        if not len(start):
            return [np.zeros(0, np.int32)] * len(texts)
        base = np.cumsum(length) - length
        step = np.arange(length.sum()) - np.repeat(base, length)
        chars = chars[np.repeat(start, length) + step]
        with np.errstate(over="ignore"):
            hashed = np.add.reduceat(self.values[chars & 0xFFFF] * self.steps[step & 0xFF], base)
        order = np.argsort(hashed)
        new = np.r_[True, hashed[order][1:] != hashed[order][:-1]]
        group = np.empty(len(start), np.int64)
        group[order] = np.cumsum(new) - 1
        first = order[new]
        like = first[group]
        if (length[like] != length).any() or (chars[np.repeat(base[like], length) + step] != chars).any():
            return [self.one(t) for t in texts]  # two pre-tokens of one hash
        most = np.maximum.reduceat(chars, base)[first]
        of, many = self._merged([base[first], length[first]], chars, [i if m > 127 else -1 for i, m in zip(start[first].tolist(), most.tolist(), strict=True)], whole)
        offset = np.cumsum(many) - many
        count = many[group]
        total = np.cumsum(np.r_[0, count])
        flat = of[np.repeat(offset[group] - total[:-1], count) + np.arange(total[-1])]
        bounds = total[np.searchsorted(start, np.r_[0, ends])].tolist()
        return [flat[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]

    def _merged(self, place: list[np.ndarray], chars: np.ndarray, wide: list[int], whole: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pre-tokens, and how many each has; those at ``wide`` places of ``whole`` are not ASCII."""
        at, size = place[0].copy(), place[1].copy()
        data, more, n = chars.astype(np.uint8), [], len(chars)
        for i in np.flatnonzero(np.array(wide) >= 0).tolist():
            coded = whole[wide[i] : wide[i] + size[i]].encode()
            more.append(coded)
            at[i], size[i] = n, len(coded)
            n += len(coded)
        data = np.concatenate([data, np.frombuffer(b"".join(more), np.uint8)])
        many, pieces = np.zeros(len(at), np.int64), []
        for length in np.unique(size).tolist():
            mine = np.flatnonzero(size == length)
            if length > IN_STEP:
                for i in mine.tolist():
                    ids = np.array(self.encoder.merged(data[at[i] : at[i] + length].tobytes()), np.int32)
                    pieces.append((np.array([i]), ids[None, :]))
                continue
            text = data[at[mine][:, None] + np.arange(length)]
            symbols = self.inner[text]
            symbols[:, -1] = self.last[text[:, -1]]
            pieces += self._rounds(mine, symbols)
        for mine, symbols in pieces:
            many[mine] = symbols.shape[1]
        offset, out = np.cumsum(many) - many, np.zeros(int(many.sum()), np.int32)
        for mine, symbols in pieces:
            out[offset[mine][:, None] + np.arange(symbols.shape[1])] = symbols
        return out, many

    def _rounds(self, mine: np.ndarray, symbols: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        out = []
        ranks = self.pairs.ranks(symbols[:, :-1].ravel(), symbols[:, 1:].ravel()).reshape(len(mine), -1)
        while len(mine):
            n = symbols.shape[1]
            if n == 1:
                return [*out, (mine, symbols)]
            at = ranks.argmin(axis=1)
            best = ranks[np.arange(len(mine)), at]
            ended = best == NEVER
            if ended.any():
                out.append((mine[ended], symbols[ended]))
                going = ~ended
                mine, symbols, ranks, at, best = mine[going], symbols[going], ranks[going], at[going], best[going]
            rows = np.arange(len(mine))
            kept = np.arange(n - 1) <= at[:, None]
            symbols = np.where(kept, symbols[:, :-1], symbols[:, 1:])
            symbols[rows, at] = self.pairs.new[best]
            ranks = np.where(kept[:, :-1], ranks[:, :-1], ranks[:, 1:])
            left, right = np.flatnonzero(at > 0), np.flatnonzero(at < n - 2)
            before, here = at[left], at[right]
            # a merge's left neighbour pairs with the new symbol, and so does its right one
            ranks[left, before - 1] = self.pairs.ranks(symbols[left, before - 1], symbols[left, before])
            ranks[right, here] = self.pairs.ranks(symbols[right, here], symbols[right, here + 1])
        return out
