import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import lm

SF = "/root/testdata/sf0.001"


def cut(text):
    return (text or "").encode().lower().split() + [b""]


def plain(rows, order, strength):
    """By recursion over dictionaries of counts."""
    grams, train = Counter(), [cut(t) for _, t, held in rows if not held]
    total = Counter(w for x in train for w in x)
    for x in train:
        x = [b"\n", *x]
        for i in range(1, len(x)):
            for k in range(2, order + 1):
                if i - k + 1 >= 0:
                    grams[tuple(x[i - k + 1 : i + 1])] += 1
    n, v = sum(total.values()), len(total)
    total[b"\n"] = len(train)
    history = lambda h: total[h[0]] if len(h) == 1 else grams[h]
    base = lambda w: ((total[w] if w != b"\n" else 0) + 0.1) / (n + 0.1 * (v + 1))

    def p(h, w):
        return (grams[(*h, w)] + strength * p(h[1:], w)) / (history(h) + strength) if h else base(w)

    out = {}
    for i, text, held in rows:
        x = [b"\n", *cut(text)]
        out[i] = (
            held,
            len(x) - 1,
            sum(total[w] > 0 for w in x[1:]),
            n,
            sum(math.log10(base(w)) for w in x[1:]),
            sum(math.log10(p(tuple(x[max(0, j - order + 1) : j]), x[j])) for j in range(1, len(x))),
        )
    return out


@pytest.mark.parametrize(("order", "block"), [(2, 700), (2, 10**9), (3, 900), (1, 500)])
def test_equals_recursion(spark, order, block):
    rng = random.Random(order)
    vocabulary = ["the", "The", "of", "é", "x.", "rare1", "rare2", "<s>", "</s>"] + [f"w{i}" for i in range(30)]
    texts = [None, "", " \t\n", "the", "unseen words", " the of " * 300] + [" ".join(rng.choices(vocabulary, k=rng.randrange(40))) for _ in range(60)]
    texts += [texts[-1]] * 3
    rows = [(i, t, i % 4 == 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, held boolean, block int")
    got = lm.score(docs, F.col("held"), order=order, strength=7.0, block_bytes=block).collect()
    want = plain(rows, order, 7.0)
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r)[1:5] == want[r.doc_id][:4]
        assert np.allclose(tuple(r)[5:], want[r.doc_id][4:], atol=1e-6)


def test_packed_hashes():
    for n in (0, 1, 1000):
        x = np.sort(np.random.default_rng(n).integers(0, 2**64, n, dtype=np.uint64))
        assert lm.unpacked(lm.packed(x)).tolist() == x.tolist()


def test_distribution():
    """Next-word probabilities of a history, the unknown word included, add up to one."""
    texts = ["a b a c a b", "b c", "a b unknown"]
    grams = lm.Grams(texts, 3)
    counts = grams.counts(np.array([True, True, False]))
    total, distinct = int(counts[1].sum()), int((counts[1] > 0).sum())
    auto = lm.Automaton(grams, counts, total, distinct, 2.0)
    words = [i for i in range(grams.size) if counts[1][i] > 0] + [int(np.flatnonzero(counts[1] == 0)[-1])]
    reached = auto.nexts[auto.keys % auto.size != lm.END]
    for state in {0, 1 + lm.BEGIN, *reached.tolist()}:
        mass = 0.0
        for w in words:
            s, weight = state, 0.0
            while not len(hit := np.flatnonzero(auto.keys == s * auto.size + w)):
                weight, s = weight + auto.loss[s], auto.fail[s]
            mass += 10 ** (weight + auto.weights[hit[0]])
        assert abs(mass - 1) < 1e-9


def test_query(spark):
    got = lm.op1_lm(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = plain([(r.doc_id, r.text, zlib.crc32(str(r.doc_id).encode()) % 10 == 0) for r in docs], lm.ORDER, lm.STRENGTH)
    assert len(got) == len(docs)
    for r in got:
        assert tuple(r)[1:5] == want[r.doc_id][:4]
        assert np.allclose(tuple(r)[5:], want[r.doc_id][4:])


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert lm.score(docs, F.lit(False)).collect() == []
    one = spark.createDataFrame([(None, "a b")], "doc_id long, text string")
    r = lm.score(one, F.lit(True)).first()
    assert (r.train_tokens, r.n_known, r.n_tokens) == (0, 0, 3) and math.isclose(r.score, 0.0) and math.isclose(r.base_score, 0.0)


def test_counts_and_hashes_travel_small():
    """A small count takes one byte, and hashes of a shard differ by little, however many shards there are."""
    for n in ([], [0, 1, 255], [3, 256], [70_000, 0], [1 << 40, 5]):
        n = np.array(n, np.int64)
        assert (lm.grown(lm.small(n)) == n).all() and lm.grown(lm.small(n)).dtype == np.int64
    assert len(lm.small(np.ones(1000, np.int64))) == 1001
    grams = lm.Grams([" ".join(f"w{i}" for i in range(50_000))], 2)
    order, ends = grams.dealt(2, 100)
    assert len(ends) == 101 and ends[0] == 0 and ends[-1] == len(order) and (np.diff(ends) > 300).all()
    for a, b in zip(ends, ends[1:], strict=False):
        hashes = grams.hashes[2][order[a:b]]
        assert (lm.unpacked(lm.packed(hashes)) == hashes).all()
        steps = np.diff(hashes)
        assert int(np.median(steps)) < 1 << 50


def test_rows_travel_small(spark):
    """What a task has for a block is one piece, smaller than its texts; all rows come back, whatever their keys."""
    import datetime

    import pyarrow as pa

    rng = random.Random(3)
    texts = [None, "", "x" * 5000] + [" ".join(rng.choices(["lorem", "ipsum", "dolor", "sit"], k=200)) for _ in range(300)]
    keys = {pa.int64(): lambda i: None if i == 7 else i, pa.string(): str, pa.date32(): lambda i: datetime.date(2020, 1, 1) + datetime.timedelta(i)}
    for kind, key in keys.items():
        want = [(key(i), t, i % 3 == 0) for i, t in enumerate(texts)]
        rows = lm.Rows(kind)
        columns = [pa.array(c, t) for c, t in zip(zip(*want, strict=True), rows.schema.types, strict=True)]
        batch = pa.RecordBatch.from_arrays([*columns, pa.array([i % 5 for i in range(len(want))])], [*rows.schema.names, "block"])
        (sent,) = rows.dealt(iter([batch.slice(0, 100), batch.slice(100)]))
        assert sent.column("block").to_pylist() == [0, 1, 2, 3, 4]
        assert sum(map(len, sent.column("rows").to_pylist())) < sum(len(t or "") for t in texts) / 3
        for i in range(5):
            got = rows.unpack(pa.Table.from_batches([sent.slice(i, 1)]))
            assert [tuple(r.values()) for r in got.to_pylist()] == want[i::5]
    days = [(datetime.date(2020, 1, 1 + i), "a b c") for i in range(9)]
    got = lm.score(spark.createDataFrame(days, "doc_id date, text string"), F.lit(False), block_bytes=10).collect()
    assert sorted(r.doc_id for r in got) == [d for d, _ in days] and {r.n_known for r in got} == {4}
