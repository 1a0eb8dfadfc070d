import random

import numpy as np
import pytest
import xxhash

from tessella.llm import simhash
from tests.test_graph import brute


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [b" ".join(words)] * bool(words)
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_golay_keys_meet_within_two_errors():
    rng = np.random.default_rng(3)
    words = rng.integers(0, 1 << 23, 300)
    row, key = simhash.codeword_keys(words)
    counts = np.bincount(row)
    assert set(counts) == {1, 6}
    for _ in range(200):
        i, (a, b) = rng.integers(0, 300), rng.integers(0, 23, 2)
        other = np.array([words[i] ^ (1 << a) ^ (1 << b if a != b else 0)])
        assert set(key[row == i]) & set(simhash.codeword_keys(other)[1])


@pytest.mark.parametrize("bucket", [simhash.BUCKET, 1])
def test_links_equal_all_pairs(spark, bucket):
    rng = random.Random(5)
    found = [rng.getrandbits(64) for _ in range(30)] + [0, (1 << 64) - 1]
    for x in list(found):
        for _ in range(6):
            x ^= 1 << rng.randrange(64)
            if rng.random() < 0.6:
                x ^= 1 << rng.randrange(64)
            if rng.random() < 0.2:
                x ^= 1 << rng.randrange(64)
            found.append(x)
    found = sorted({simhash._signed(x) for x in found})
    want = brute([(a, b) for i, a in enumerate(found) for b in found[i + 1 :] if ((a ^ b) & (2**64 - 1)).bit_count() <= 2])
    got = simhash.links(spark.createDataFrame([(x,) for x in found], "fp long"), bucket=bucket).collect()
    assert all(((r.src ^ r.dst) & (2**64 - 1)).bit_count() <= 2 for r in got)
    assert brute([(r.src, r.dst) for r in got]) == want


def test_documents(spark):
    rng = random.Random(1)
    words = ["w%d" % i for i in range(400)]
    texts = [None, "", " \t", "One", "one two", "A b c", "a B c", " ".join(words * 20)]
    base = " ".join(rng.choices(words, k=600))
    texts += [base, base.upper(), base + " tail", "\n".join(base.split()), base]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, base, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    prints = {i: plain_fingerprint(t) for i, t, _ in rows}
    classes = brute([(i, j) for i in range(len(texts)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2])
    for r in got:
        assert r.fp & (2**64 - 1) == prints[r.doc_id]
        if r.doc_id is not None:
            assert r.component_id == classes.get(r.doc_id, r.doc_id)
    kept = [r.doc_id for r in simhash.keep_one(docs).collect()]
    assert sorted(x for x in kept if x is not None) == sorted(i for i in range(len(texts)) if classes.get(i, i) == i)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).collect() == []
