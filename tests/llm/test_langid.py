import zlib

import numpy as np
from pyspark.sql import functions as F

from tessella.llm import langid

SF = "/root/testdata/sf0.01"


def test_tables_equal_plain_convolution():
    network = langid.Network(["a", "b", "c"])
    x = np.concatenate([langid.windows("Grüße, the word".encode() * 30), langid.windows(b"z")])
    e, pooled = network.weights["embedding"][x], []
    for w in langid.WIDTHS:
        places = [sum(e[:, p + j] @ network.weights[f"filter{w}"][j] for j in range(w)) for p in range(langid.LENGTH - w + 1)]
        pooled.append(np.max(places, axis=0))
    hidden = np.maximum(np.concatenate(pooled, axis=1) + network.weights["bias"], 0)
    want = langid.softmax(hidden @ network.weights["out"] + network.weights["out_bias"])
    assert np.allclose(network.predict(x), want, atol=1e-5)


def test_gradients_equal_differences():
    network = langid.Network(["a", "b"])
    network.weights = {k: v.astype(np.float64) for k, v in network.weights.items()}
    x, y = langid.windows(b"some words of a text " * 40), np.array([0, 1, 1, 0])
    x = x[:4]
    found = network.gradients(x, y[: len(x)])

    def loss():
        network.tables()
        p = network.forward(x)
        return -np.log(p[np.arange(len(x)), y[: len(x)]]).mean()

    for name, at in (("out", (3, 1)), ("filter3", (1, 2, 5)), ("embedding", (19, 2)), ("bias", (7,))):
        w = network.weights[name]
        keep, h = w[at], 1e-5
        w[at] = keep + h
        up = loss()
        w[at] = keep - h
        down = loss()
        w[at] = keep
        assert abs((up - down) / (2 * h) - found[name][at]) < 1e-4


def test_odd_texts(spark):
    network = langid.train([("en", "the cat and the dog " * 20), ("de", "der hund und die katze " * 20)] * 20)
    texts = [None, "", " 12 !", "THE DOG and the cat", "Der Hund und", "é", "the dog and " * 40000, "the dog and " * 40000]
    docs = spark.createDataFrame([(i, t, "fr", "x") for i, t in enumerate(texts)], "doc_id long, text string, lang string, score string")
    got = {r.doc_id: r for r in langid.predict(docs, network).collect()}
    assert [got[i].lang_pred for i in range(5)] == ["und", "und", "und", "en", "de"]
    assert got[6].lang_pred == got[7].lang_pred == "en" and got[6].score == got[7].score
    assert all(0 <= r.score <= 1 for r in got.values())
    assert {r.lang_pred for r in langid.predict(docs, langid.train([])).collect()} == {"und"}
    assert langid.predict(docs.limit(0), network).collect() == []
    assert langid.sample(docs, "doc_id", "text", "lang", 3, 5)[0][0] == "fr"


def test_held_out_accuracy(spark):
    got = langid.op4_langid(spark, SF)
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = got.join(truth, "doc_id").collect()
    assert len(rows) == truth.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r.lang == r.lang_pred for r in rows if r.held_out]
    assert sum(held) / len(held) > 0.97


def test_sample_has_every_language_and_its_bounds(spark):
    rows = [(i, "abc " * 600, "en") for i in range(3000)] + [(5000 + i, f"text {i}", f"l{i % 30:02d}") for i in range(90)] + [(None, "x y", "nul"), (9, "abc", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = langid.sample(docs, "doc_id", "text", "lang", 40)
    counts = {}
    for lang, text in found:
        counts[lang] = counts.get(lang, 0) + 1
        assert len(text) <= langid.HEAD
    assert set(counts) == {"en", "nul", *(f"l{i:02d}" for i in range(30))} and counts["en"] == 40 and counts["l07"] == 3
    assert len(langid.sample(docs, "doc_id", "text", "lang", 40, 64)) == 63
    assert found == langid.sample(docs.repartition(7), "doc_id", "text", "lang", 40)
