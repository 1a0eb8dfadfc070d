"""Operator 3: quality rules as weak supervision.

Method: each rule looks at a few measures of a text and votes good, bad or
abstains. How often each rule casts each vote on good and on bad texts (hence its
accuracy) and the share of bad texts are estimated by expectation-maximisation,
without labels. A text's posterior probability of being good replaces a filter
that all rules must pass.

Everything that touches rows is DataFrame functions. Votes make at most
3 ** the number of rules patterns; their counts, which combine before the shuffle, are all
that EM reads, on the driver, and the fitted weights come back as literals. So
the fit covers every document at any size, and scoring needs no join.

Defined cases: null is the empty text: no words, base failed, not kept. Very long
texts cost O(n log n). An empty table is fitted to the prior alone. Repeated rows
are judged alike; other columns stay behind.

Windows are compared by 64-bit hash within one text.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.batches import row_key, without_rows
from tessella.session import written
from tessella.sources import table

BLANK = r"[\x20\x09-\x0D]+"
WINDOW = 5

#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in is that it for on with as was be by this are at from or an have not which you "
    "le la les de des du un une et est que qui dans pour sur au en il elle par ne pas ce plus "
    "der die das und ist nicht ein eine zu den von mit auf für im dem sich es auch als an "
    "el los las una y del se por con no su para al lo como pero más esta"
).split()


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), use)[0]


def repeated(words: Column) -> Column:
    """Words that lie in windows found twice or more in their text; ``words`` are their hashes."""

    def covered(positions: Column) -> Column:
        step = F.transform(positions, lambda p, i: F.least(F.coalesce(F.get(positions, i + 1) - p, F.lit(WINDOW)), F.lit(WINDOW)))
        return F.aggregate(step, F.lit(0).cast("long"), lambda a, x: a + x)

    def again(ordered: Column) -> Column:
        h = lambda i: F.get(ordered, i)["h"]
        twice = F.filter(
            F.transform(ordered, lambda x, i: F.when((x["h"] == h(i - 1)) | (x["h"] == h(i + 1)), x["p"])), lambda p: p.isNotNull()
        )
        return let(F.sort_array(twice), covered)

    def of(hashes: Column) -> Column:
        pairs = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p")))
        heavy = let(F.sort_array(pairs), again)
        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), heavy).otherwise(F.lit(0).cast("long"))

    hashes = F.transform(F.arrays_zip(*window_columns(words, WINDOW)), lambda w: F.xxhash64(w))
    return F.when(F.size(words) > WINDOW, let(hashes, of)).otherwise(F.lit(0).cast("long"))


def window_columns(of: Column, n: int) -> list[Column]:
    """For each window of ``n`` elements its first one, its second one, and so on: arrays of the same length, made without a lambda."""
    size = F.greatest(F.size(of) - (n - 1), F.lit(0))
    return [F.slice(of, i + 1, size) for i in range(n)]


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and the counts that the rules read; no shuffle."""
    df = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    df = df.withColumn("words", F.array_remove(F.split("text", BLANK), ""))
    df = df.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumn("lines", lines)
    size = lambda x: F.size(x).cast("long")
    count = lambda p: F.regexp_count("text", F.lit(p)).cast("long")
    left = lambda p: F.length(F.regexp_replace("text", p, "")).cast("long")  # noqa: E731  counts by what remains: cheaper than an array of matches
    stops = F.array(*map(F.lit, STOP_WORDS))
    return df.select(
        "doc_id",
        size("words").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        count(r"[#*$%&|<>]").alias("n_symbols"),
        size("lines").alias("n_lines"),
        (size("lines") - size(F.array_distinct("lines"))).alias("n_dup_lines"),
        repeated(F.col("hashes")).alias("n_repeat_words"),
        size(F.array_intersect(F.col("words"), stops)).alias("n_stops"),
        left(r"[^\p{L}\p{N}]+").alias("n_letters"),
        count(r"\p{L}\p{Lu}").alias("n_shouted"),
        count(r"[!?]{2}").alias("n_bangs"),
        count(r"[.!?…]['\"»”)]?[\x20\x09-\x0D]*(?:\n|$)").alias("n_ended"),
    )


def _share(a: str, b: str) -> Column:
    return F.col(a) / F.greatest(F.col(b), F.lit(1))


def rules() -> dict[str, Column]:
    """Votes: 1 good, -1 bad, 0 abstains."""
    long_enough = F.col("n_words") >= 30
    symbols, upper = _share("n_symbols", "n_words"), _share("n_shouted", "n_letters")
    mean = _share("word_chars", "n_words")
    ended, doubled = _share("n_ended", "n_lines"), _share("n_dup_lines", "n_lines")
    again, bangs, letters = _share("n_repeat_words", "n_words"), _share("n_bangs", "n_words"), _share("n_letters", "word_chars")

    def vote(good: Column, bad: Column) -> Column:
        return F.when(bad, -1).when(good, 1).otherwise(0)

    return {
        "symbols": vote(symbols < 0.02, symbols > 0.1),
        "letters": vote(letters > 0.88, letters < 0.75),
        "capitals": vote(F.lit(False), upper > 0.2),
        "word_length": vote(mean.between(3.0, 9.0), (mean < 2.0) | (mean > 14.0)),
        "stop_words": vote(F.col("n_stops") >= 4, long_enough & (F.col("n_stops") < 2)),
        "sentence_ends": vote(ended >= 0.4, long_enough & (ended < 0.05)),
        "exclamations": vote(F.lit(False), bangs > 0.1),
        "repeated_lines": vote(F.lit(False), doubled > 0.3),
        "repeated_words": vote(F.lit(False), again > 0.12),
    }


#: Votes of a rule seen before, as prior: (bad, none, good) on bad texts and on good ones, and texts (bad, good).
SEEN = ((3.0, 6.0, 1.0), (0.3, 5.0, 5.0))
TEXTS = (2.0, 18.0)
ROUNDS = 200


def fit(patterns: list[tuple[tuple[int, ...], int]], names: list[str]) -> dict:
    """EM over vote patterns and their counts.

    ``chance[y][j][v + 1]`` is how likely rule j casts vote v on a bad (y = 0) or good
    (y = 1) text: abstaining carries its own weight, so that a rule made for one kind
    of bad text is not held against the others. ``accuracy`` is its share of right votes.
    """
    chance = [[[x / sum(seen) for x in seen] for _ in names] for seen in SEEN]
    share = TEXTS[1] / sum(TEXTS)
    for _ in range(ROUNDS):
        votes = [[list(seen) for _ in names] for seen in SEEN]
        texts = list(TEXTS)
        for pattern, n in patterns:
            good = posterior(pattern, chance, share)
            for y, p in ((0, n * (1 - good)), (1, n * good)):
                texts[y] += p
                for j, v in enumerate(pattern):
                    votes[y][j][v + 1] += p
        before, share = share, texts[1] / sum(texts)
        chance = [[[x / sum(v) for x in v] for v in of] for of in votes]
        if abs(share - before) < 1e-10:
            break
    right = [(votes[0][j][0] + votes[1][j][2]) / sum(votes[y][j][v] for y in (0, 1) for v in (0, 2)) for j in range(len(names))]
    return {"names": names, "chance": chance, "share": share, "accuracy": dict(zip(names, right, strict=True))}


def weights(chance: list, j: int) -> list[float]:
    """What each vote of rule j (bad, none, good) adds to the log-odds of a good text."""
    return [math.log(g / b) for b, g in zip(chance[0][j], chance[1][j], strict=True)]


def posterior(pattern: tuple[int, ...], chance: list, share: float) -> float:
    odds = math.log(share / (1 - share)) + sum(math.log(chance[1][j][v + 1] / chance[0][j][v + 1]) for j, v in enumerate(pattern))
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))


def model(measured: DataFrame) -> dict:
    names = list(rules())
    found = measured.select(*[v.cast("int").alias(f"v_{k}") for k, v in rules().items()])
    found = found.groupBy(*found.columns).agg(F.count("*").alias("n"))  # 3 ** len(names) rows at most
    return fit(sorted((tuple(r)[:-1], r.n) for r in found.collect()), names)


def scored(measured: DataFrame, fitted: dict) -> DataFrame:
    """``measured`` with ``quality`` (posterior of being good), ``base_failed`` and ``kept``."""
    odds = F.lit(math.log(fitted["share"] / (1 - fitted["share"])))
    for j, vote in enumerate(rules().values()):
        down, none, up = weights(fitted["chance"], j)
        odds = odds + F.when(vote > 0, up).when(vote < 0, down).otherwise(none)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    df = measured.withColumn("quality", 1 / (1 + F.exp(-odds))).withColumn("base_failed", failed)
    return df.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= 0.5))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, posterior and verdict of each row. The measures are computed once and held as a small written table."""
    measured = written(measures(docs, id_col, text_col), "quality")
    return scored(measured, model(measured))


def accepted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept."""
    found = judge(docs.select(row_key(id_col, text_col).alias("key"), F.col(text_col).alias("text")), "key", "text")
    return without_rows(docs, found.filter(~F.col("kept")).select("doc_id"), id_col, text_col)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judge(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality"
    )


QUERIES = {"op3_quality": op3_quality}
ORACLE: dict[str, str] = {}
