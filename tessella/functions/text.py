"""Text as Column functions: segmentation, normal forms, shingles, counters and perturbations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns of the surface counters, per name.
SURFACE = {
    "numbers": r"[0-9]+",
    "urls": r"https?://[^ \n]+",
    "quotes": r"[\"«»“”]",
    "dashes": r"[—–]",
    "colons": r":",
    "emails": r"[A-Za-z0-9._]+@[A-Za-z0-9.]+",
}

#: Lines that platforms add; a line goes if all of it fits one.
PLATFORM_LINES = r"(?:share this|read more|sign in|subscribe|advertisement|cookie policy|all rights reserved\.?)"


def empty(kind: str = "string") -> Column:
    return F.array().cast(f"array<{kind}>")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, where a lambda would compute it for each element."""
    return F.transform(F.array(value), use)[0]


def words(text: Column) -> Column:
    """Runs without ASCII white space."""
    return F.filter(F.split(text, r"[ \t\n\x0B\f\r]+"), lambda w: w != "")


def normalised(text: Column) -> Column:
    """Lower case, ASCII punctuation as space, spaces squeezed."""
    lowered = F.lower(text)
    return F.trim(F.regexp_replace(F.regexp_replace(lowered, r"[!-/:-@\[-`{-~]+", " "), r"[ \t\n\x0B\f\r]+", " "))


def sentences(text: Column, at_least: int = 0) -> Column:
    """Lines, cut after ``.``, ``!`` or ``?`` before white space, trimmed; those of fewer characters dropped."""
    parts = F.split(F.regexp_replace(text, r"([.!?])[ \t\n\x0B\f\r]+", "$1\n"), r"\n+")
    return F.filter(F.transform(parts, lambda s: F.btrim(s, F.lit(" \t\r"))), lambda s: (s != "") & (F.length(s) >= at_least))


def shingles(of: Column, n: int) -> Column:
    """Runs of ``n`` words joined by spaces; a shorter text is one run, an empty one none."""

    def of_words(w: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "))
        return F.when(F.size(w) == 0, empty()).when(F.size(w) < n, F.array(F.array_join(w, " "))).otherwise(runs)

    return let(of, of_words)


def jaccard(a: Column, b: Column) -> Column:
    """Of sets given as arrays; null if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union)


def overlap(a: Column, b: Column) -> Column:
    """Intersection over the smaller set; null if one is empty."""
    least = F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least)


def mattr(of: Column, window: int = 50) -> Column:
    """Mean share of distinct words in windows of ``window`` words; the whole text's share if it is shorter."""

    def of_words(w: Column) -> Column:
        sizes = F.transform(F.sequence(F.lit(1), F.size(w) - window + 1), lambda i: F.size(F.array_distinct(F.slice(w, i, window))))
        total = F.aggregate(sizes, F.lit(0).cast("long"), lambda a, x: a + x)
        short = F.size(F.array_distinct(w)) / F.size(w)
        return F.when(F.size(w) == 0, None).when(F.size(w) < window, short).otherwise(total / ((F.size(w) - window + 1) * window))

    return let(of, of_words)


def letter_share(text: Column, pattern: str) -> Column:
    """Share of the letters that fit ``pattern``; null without letters."""
    letters = F.regexp_count(text, F.lit(r"\p{L}"))
    return F.when(letters > 0, F.regexp_count(text, F.lit(pattern)) / letters)


def without_lines(text: Column, pattern: str) -> Column:
    """Drops the lines that, trimmed of blanks and bars, fit ``pattern`` whole."""
    keep = F.filter(F.split(text, "\n"), lambda x: ~F.lower(F.btrim(x, F.lit(" \t·|—–-"))).rlike(f"^{pattern}$"))
    return F.array_join(keep, "\n")


# perturbations: order-preserving and deterministic


def dashes_to_commas(text: Column) -> Column:
    return F.regexp_replace(text, " [—–-] ", ", ")


def without_markdown(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\*\*([^*\n]+)\*\*", "$1"), r"(?m)^#{1,6} +", "")


def without_headings(text: Column) -> Column:
    return F.array_join(F.filter(F.split(text, "\n"), lambda x: ~x.rlike(r"^#{1,6} ")), "\n")


def plain_punctuation(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"[!]+", "."), r"[;]", ",")


def shortened(text: Column, every: int = 4) -> Column:
    """Without each ``every``-th sentence."""
    return F.array_join(F.filter(sentences(text), lambda s, i: F.pmod(i + 1, F.lit(every)) != 0), " ")


def expanded(text: Column, every: int = 4, added: str = "That is worth noting.") -> Column:
    """``added`` after each ``every``-th sentence."""
    grown = F.transform(sentences(text), lambda s, i: F.when(F.pmod(i + 1, F.lit(every)) == 0, F.concat(s, F.lit(" " + added))).otherwise(s))
    return F.array_join(grown, " ")
