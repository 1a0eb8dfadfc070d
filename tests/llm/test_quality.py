import random
import re

from pyspark.sql import functions as F

from tessella.llm import quality

SF = "/root/testdata/sf0.01"


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = {}
    for w in windows:
        seen[w] = seen.get(w, 0) + 1
    hit = {i + j for i, w in enumerate(windows) if seen[w] > 1 for j in range(5)}
    failed = len(words) < 10 or 100 * len(hit) > 20 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), failed)


COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def check(rows, got):
    assert len(got) == len(rows)
    want = {i: plain(t) for i, t in rows}
    for r in got:
        assert tuple(r[c] for c in COLUMNS) == want[r.doc_id], r.doc_id
        assert r.kept == (not r.base_failed and r.quality >= 0.5)


def test_odd_texts(spark):
    rng = random.Random(2)
    texts = [None, "", " \n ", "a a a a a a a", "x", "\n\n a b\n a b\n\ta b\n", "a\x0bb\x0cc\rd e", " z é\U0001f600 # | <b> ", "p q r s t u p q r s t"]
    texts += [" ".join(rng.choices("abc", k=n)) for n in (5, 6, 9, 40, 3000)]
    texts += ["a b c d e", "a b c d", " ".join(map(str, range(30000)))]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, words string, n_words int")
    check(rows, quality.judge(docs).collect())


def test_empty_table(spark):
    assert quality.judge(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_whole_table_and_labels(spark):
    """Labels take no part in the fit; the verdicts agree with them."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = quality.op3_quality(spark, SF)
    check([(r.doc_id, r.text) for r in docs.collect()], got.collect())
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", F.col("quality").alias("good"))
    judged = got.filter("not base_failed").join(labels, "doc_id").groupBy("good", "kept").count().collect()
    n = {(r.good, r.kept): r["count"] for r in judged}
    assert n[1, True] >= 0.98 * (n[1, True] + n.get((1, False), 0))
    assert n[0, False] >= 0.9 * (n[0, False] + n.get((0, True), 0))


def test_main_path_has_no_python(spark):
    plan = quality.op3_quality(spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_em_finds_accuracies():
    rng = random.Random(4)
    names, patterns = ["a", "b", "c", "d"], {}
    for _ in range(4000):
        bad = rng.random() < 0.2
        votes = tuple(0 if rng.random() < 0.3 else (1 if (rng.random() < q) != bad else -1) for q in (0.95, 0.9, 0.9, 0.7))
        patterns[votes] = patterns.get(votes, 0) + 1
    found = quality.fit(sorted(patterns.items()), names)
    assert abs(found["share"] - 0.8) < 0.04
    for name, q in zip(names, (0.95, 0.9, 0.9, 0.7), strict=True):
        assert abs(found["accuracy"][name] - q) < 0.04
