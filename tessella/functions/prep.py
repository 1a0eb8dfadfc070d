"""Cleaning of raw texts, step by step; each step is a Column function, so a chain is one projection."""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.text import let

SOFT_HYPHEN, NBSP = "­", " "
#: Latin letters that look like Cyrillic ones, and those they stand for. Fixed values.
LOOKALIKE = ("aceopxyABCEHKMOPTX", "асеорхуАВСЕНКМОРТХ")


def nfc(text: Column) -> Column:
    """Unicode NFC, which Spark has no function for; texts in ASCII pass as they are."""
    return F.udf(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t), "string", useArrow=True)(text)


def unified(text: Column) -> Column:
    """No soft hyphens, plain spaces and quotes, single blanks, two line ends at most."""
    text = F.regexp_replace(text, SOFT_HYPHEN, "")
    text = F.translate(text, NBSP + "“”„«»‘’", " " + '"""""' + "''")
    return F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r"\n{3,}", "\n\n")


def repaired_lookalikes(text: Column) -> Column:
    """One or two Latin look-alikes between Cyrillic letters become Cyrillic."""
    latin, other = LOOKALIKE
    one = rf"(?<=[а-яёА-ЯЁ])[{latin}]{{1,2}}(?=[а-яёА-ЯЁ])"
    # each such run is replaced by its translation; other runs of the letters stay
    pieces = F.split(F.regexp_replace(text, f"({one})", "\u0001$1\u0001"), "\u0001")
    return F.array_join(F.transform(pieces, lambda p, i: F.when(i % 2 == 1, F.translate(p, latin, other)).otherwise(p)), "")


def joined_hyphens(text: Column, known: Column) -> Column:
    """Words cut at a line end are joined if ``known`` (an array of lower-case words) has the whole."""
    parts = F.regexp_extract_all(text, F.lit(r"(\p{L}+)-\n(\p{L}+)"), 0)

    def joined(done: Column, found: Column) -> Column:
        whole = F.regexp_replace(found, "-\n", "")
        return F.when(F.array_contains(known, F.lower(whole)), F.replace(done, found, whole)).otherwise(done)

    return F.aggregate(F.array_distinct(parts), text, joined)


def without_wrapper(text: Column) -> Column:
    """Drops a first paragraph of 300 characters at most that a rule line follows."""
    return F.regexp_replace(text, r"\A[^\n]{1,300}\n+(?:-{3,}|\*{3,}|_{3,})\n+", "")


def without_comments(text: Column, marker: str = r"(?i)\n(?:comments?|replies)[: ]?[0-9]*\n", reply: str = r"(?i)\breply\b") -> Column:
    """Cuts at the last marker line before two or more replies."""

    def cut(marks: Column) -> Column:
        size = F.length(F.element_at(marks, -1))
        return F.when((F.size(marks) > 1) & (F.regexp_count(F.element_at(marks, -1), F.lit(reply)) >= 2), F.substring(text, F.lit(1), F.length(text) - size)).otherwise(text)

    return F.regexp_replace(let(F.split(text, f"(?={marker})"), cut), r"\n+\z", "")


def without_counters(text: Column) -> Column:
    """Drops lines that are a number with a unit of attention only."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda x: ~F.lower(F.trim(x)).rlike(r"^[0-9][0-9., ]*(?:views?|likes?|shares?|comments?)?$")), "\n")


def inline_counts(text: Column) -> Column:
    """How many links, bold and italic spans and code spans there are."""
    count = lambda p: F.regexp_count(text, F.lit(p)).cast("long")
    return F.struct(
        count(r"\[[^\]\n]+\]\([^)\n]+\)").alias("links"), count(r"\*\*[^*\n]+\*\*").alias("bold"),
        count(r"(?<!\*)\*[^*\n]+\*(?!\*)").alias("italic"), count(r"`[^`\n]+`").alias("code"),
    )


def without_inline(text: Column) -> Column:
    for pattern, kept in ((r"\[([^\]\n]+)\]\([^)\n]+\)", "$1"), (r"\*\*([^*\n]+)\*\*", "$1"), (r"(?<!\*)\*([^*\n]+)\*(?!\*)", "$1"), (r"`([^`\n]+)`", "$1")):
        text = F.regexp_replace(text, pattern, kept)
    return text


def cut_blocks(text: str | None) -> list[dict[str, str]]:
    """Blocks of a text, with their kind: code, rule, heading, list, table or paragraph. Without blank lines, each line is a paragraph."""
    lines = (text or "").split("\n")
    lines_stand_alone = not any(not x.strip() for x in lines[:-1])
    blocks: list[dict[str, str]] = []
    open_fence = False
    joinable = False
    for line in lines:
        bare = line.strip()
        if bare.startswith("```"):
            open_fence = not open_fence
            if open_fence:
                blocks.append({"kind": "code", "content": ""})
            joinable = False
            continue
        if open_fence:
            blocks[-1]["content"] += ("\n" if blocks[-1]["content"] else "") + line
            continue
        if not bare:
            joinable = False
            continue
        hashes = len(bare) - len(bare.lstrip("#"))
        if len(bare) >= 3 and set(bare) <= {"-"} or len(bare) >= 3 and set(bare) <= {"*"}:
            kind = "rule"
        elif 1 <= hashes <= 6 and bare[hashes : hashes + 1] == " ":
            kind, bare = "heading", bare[hashes:].strip()
        elif bare.startswith("|") and bare.endswith("|") or " | " in bare:
            kind = "table"
        elif bare[:2] in ("- ", "* ", "+ ") or bare.split(" ")[0].rstrip(".)").isdigit() and bare.split(" ")[0][-1] in ".)":
            kind = "list"
        else:
            kind = "paragraph"
        same = joinable and blocks and blocks[-1]["kind"] == kind and kind in ("paragraph", "table", "list")
        if same and not (kind == "paragraph" and lines_stand_alone):
            blocks[-1]["content"] += ("\n" if kind != "paragraph" else " ") + bare
        else:
            blocks.append({"kind": kind, "content": bare})
        joinable = True
    return blocks


def blocks(text: Column) -> Column:
    return F.udf(cut_blocks, "array<struct<kind:string,content:string>>", useArrow=True)(text)


def rendered(found: Column, profile: str) -> Column:
    """``prose``: paragraphs; ``full``: all but code and rules."""
    keep = F.filter(found, lambda b: b["kind"] == "paragraph") if profile == "prose" else F.filter(found, lambda b: ~b["kind"].isin("code", "rule"))
    return F.array_join(F.transform(keep, lambda b: b["content"]), "\n\n")


def _one_way(before: list[int], threshold: float) -> float | None:
    """Mean length of runs of words; ``before``: for each word the place of the last one like it, -1 if there is none."""
    factors, start, types = 0.0, 0, 0
    for i, last in enumerate(before, 1):
        if last < start:
            types += 1
        if types / (i - start) <= threshold:
            factors, start, types = factors + 1, i, 0
    left = len(before) - start
    factors += (1 - types / left) / (1 - threshold) if left else 0.0
    return len(before) / factors if factors > 0 else None


def diversities(texts: pa.Array, threshold: float) -> pa.Array:
    """``mtld`` of lists of words. A word is new to a run if the last one like it is before the run: no run's words are looked through."""
    size = pc.fill_null(pc.list_value_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(size)
    words = pc.fill_null(pc.dictionary_encode(texts.flatten()).indices, -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    key = np.repeat(np.arange(len(size)), size) * (int(words.max(initial=0)) + 1) + words
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    before, after = np.full(len(key), -1), np.full(len(key), len(key))
    before[order[1:][same]], after[order[:-1][same]] = order[:-1][same], order[1:][same]
    out = []
    for end, n in zip(ends.tolist(), size.tolist(), strict=True):
        both = [_one_way(way.tolist(), threshold) for way in (before[end - n : end] - (end - n), end - 1 - after[end - n : end][::-1])]
        out.append(None if None in both else sum(both) / 2)
    return pa.array(out, pa.float64())


def mtld(words: Column, threshold: float = 0.72) -> Column:
    """Lexical diversity: mean length of runs that stay above ``threshold``, forwards and backwards; null without words."""

    @F.arrow_udf("double")
    def found(texts: pa.Array) -> pa.Array:
        return diversities(texts, threshold)

    return found(words)


def _line(a: int, b: int, prime: int):
    return lambda x: F.pmod(F.lit(a) * x + F.lit(b), F.lit(prime))


def minhash(hashes: Column, coefficients: list[tuple[int, int]]) -> Column:
    """Least of ``(a x + b) mod (2^31 - 1)`` over the 32-bit hashes, for each pair of coefficients; null for no hashes."""
    prime = (1 << 31) - 1
    each = [F.array_min(F.transform(hashes, _line(a, b, prime))) for a, b in coefficients]
    return F.when(F.size(hashes) > 0, F.array(*each))


def score_status(response: Column, low: int = 0, high: int = 10) -> tuple[Column, Column]:
    """Status (refusal, invalid_json, out_of_range, ok) and whole-number score of a JSON answer."""
    parsed = F.from_json(response, "score string", {"mode": "PERMISSIVE"})["score"]
    score = F.when(parsed.rlike(r"^-?[0-9]{1,9}$"), parsed.cast("int"))
    status = (
        F.when(F.trim(F.coalesce(response, F.lit(""))) == "", "refusal")
        .when(score.isNull(), "invalid_json")
        .when(~score.between(low, high), "out_of_range")
        .otherwise("ok")
    )
    return status, F.when(score.between(low, high), score)


def spline(x: Column, knots: tuple[float, float, float]) -> Column:
    """The second basis function of a restricted cubic spline with three knots."""
    a, b, c = (F.pow(F.greatest(x - k, F.lit(0.0)), F.lit(3)) for k in knots)
    k1, k2, k3 = knots
    return (a - b * (k3 - k1) / (k3 - k2) + c * (k2 - k1) / (k3 - k2)) / (k3 - k1) ** 2


def one_hot(x: Column, levels: list[str]) -> list[Column]:
    """An unseen level has zeros."""
    return [F.coalesce((x == level).cast("int"), F.lit(0)).alias(f"is_{level}") for level in levels]
