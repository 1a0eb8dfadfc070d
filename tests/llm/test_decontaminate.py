import random
import re

import pytest

from tessella.llm import decontaminate as dec
from tests.oracle import compare


def cut(text):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain(text, items):
    words, hit, ids = cut(text), set(), set()
    for item, body in items:
        w = cut(body)
        n = min(13, len(w))
        for p in range(len(w) - n + 1) if n else ():
            for q in range(len(words) - n + 1):
                if words[q : q + n] == w[p : p + n]:
                    hit |= set(range(q, q + n))
                    ids.add(str(item))
    return len(words), len(hit), sorted(ids)


@pytest.mark.parametrize("shingle", [5, 3])
def test_equals_brute_force(spark, shingle):
    rng = random.Random(9)
    vocabulary = "alpha beta gamma delta is the Éa 7".split()
    items = [(i, " ".join(rng.choices(vocabulary, k=n))) for i, n in enumerate([30, 13, 14, 12, 3, 1, 45, 45])]
    items += [(20, items[0][1]), (21, None), (22, ""), (23, "--- !"), (24, "zeta " * 40)]
    texts = [None, "", "?!", "zeta " * 30, items[0][1].upper(), items[1][1].replace(" ", "-"), "one " + items[4][1] + " two"]
    for _ in range(40):
        parts = [" ".join(rng.choices(vocabulary, k=rng.randrange(1, 60)))]
        parts += [rng.choice(items)[1] or "" for _ in range(rng.randrange(3))]
        texts.append(" ".join(rng.sample(parts, len(parts))))
    rows = list(enumerate(texts)) + [(4, items[0][1].upper()), (3, "other text"), (None, texts[5])]
    docs = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "doc_id long, text string, hash string, window int")
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, length string")
    got = dec.hits(docs, bench, shingle=shingle).collect()
    assert len(got) == len(rows)
    want = sorted([(i is None, i or 0, *plain(t, items)) for i, t in rows], key=repr)
    assert sorted([(r.doc_id is None, r.doc_id or 0, r.n_words, r.n_hit, r["items"]) for r in got], key=repr) == want
    kept = dec.clean(docs, bench)
    bad = [20 * h >= n and h > 0 for _, _, n, h, _ in want]
    assert kept.count() == bad.count(False) and kept.columns == docs.columns


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert [(r.n_words, r.n_hit) for r in dec.hits(docs, bench).collect()] == [(2, 0)]
    assert dec.hits(docs.limit(0), bench).collect() == []


def test_whole_table_equals_sql(spark):
    compare(spark, "/root/testdata/sf0.01", dec.op9_decontaminate, dec.SQL)
