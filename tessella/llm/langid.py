"""Operator 4: language identification by a byte convolutional network.

Method: a text's UTF-8 bytes, in classes (letters without case, each byte beyond
ASCII, and one class for all else), are cut into windows of a fixed length.
Embedded classes pass filters of several widths, a maximum over the window's
places and a softmax over the languages. A text's probabilities are the mean over
all of its windows, weighted by their letters. Training and inference are numpy;
a maximum passes its gradient to one place only, which makes training cheap.

The fit reads ``per_language`` texts of each language at most, and of all languages
``TEXTS`` at most, but one of each at least: those of least hash of their key, and of
each ``HEAD`` characters from a place that the hash picks. Rows beyond a hash that the
language's count sets go before any are ranked, so no task holds a language.
Inference reads every byte of every text in batches of fixed size, without a shuffle.

Defined cases: null texts, and texts without a letter, are ``und`` with score 0;
without labelled rows all are ``und``; with one language all others are it;
repeated rows are judged alike; a null key counts as the empty key.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessella.llm.batches import broadcast, documents, map_batches
from tessella.sources import table

LENGTH = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBEDDED = 8
CLASSES = 1 + 26 + 128
SEED = 11
EPOCHS = 5
BATCH = 64
RATE = 0.01
#: Bounds of the sample that the fit reads.
PER_LANGUAGE, TEXTS, HEAD = 800, 160_000, 1024
#: Times the rows wanted that are ranked.
SPARE = 2
#: Windows that pass the network at a time.
AT_ONCE = 64

LETTER = regex.compile(r"\p{L}")
#: Class of each byte.
CLASS = np.zeros(256, np.uint8)
CLASS[97:123] = CLASS[65:91] = np.arange(1, 27)
CLASS[128:] = np.arange(27, 27 + 128)


def windows(data: bytes) -> np.ndarray:
    """Classes of the windows of a text, the last one filled up with class 0."""
    n = -(-len(data) // LENGTH)
    out = np.zeros(n * LENGTH, np.uint8)
    out[: len(data)] = CLASS[np.frombuffer(data, np.uint8)]
    return out.reshape(n, LENGTH)


class Network:
    def __init__(self, labels: list[str], weights: dict[str, np.ndarray] | None = None):
        self.labels = labels
        if weights is None:
            rng = np.random.default_rng(SEED)
            weights = {"embedding": rng.normal(0, 0.5, (CLASSES, EMBEDDED))}
            weights |= {f"filter{w}": rng.normal(0, 0.5 / w**0.5, (w, EMBEDDED, FILTERS)) for w in WIDTHS}
            weights |= {"bias": np.zeros(len(WIDTHS) * FILTERS), "out": rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(labels))), "out_bias": np.zeros(len(labels))}
        self.weights = {k: v.astype(np.float32) for k, v in weights.items()}
        self.pairs = None

    def tables(self, two: bool = True) -> None:
        """Products of each class with each filter row; summed for pairs of classes, to cover two places at a time, if many windows follow."""
        e, self.pairs = self.weights["embedding"], {}
        for w in WIDTHS:
            f = self.weights[f"filter{w}"]
            single = [e @ f[j] for j in range(w)]
            if not two:
                self.pairs[w] = list(enumerate(single))
                continue
            self.pairs[w] = [(j, (single[j][:, None] + single[j + 1][None]).reshape(-1, FILTERS)) for j in range(0, w - 1, 2)]
            if w % 2:
                self.pairs[w].append((w - 1, single[w - 1]))

    def filtered(self, x: np.ndarray) -> list[np.ndarray]:
        """Value of each filter at each place of a window, by width."""
        wide = x.astype(np.int32)
        pair = wide[:, :-1] * CLASSES + wide[:, 1:]
        out = []
        for w in WIDTHS:
            places = LENGTH - w + 1
            total = None
            for j, t in self.pairs[w]:
                part = np.take(t, (pair if len(t) > CLASSES else wide)[:, j : j + places], axis=0)
                total = part if total is None else np.add(total, part, out=total)
            out.append(total)
        return out

    def forward(self, x: np.ndarray) -> np.ndarray:
        pooled = np.concatenate([f.max(axis=1) for f in self.filtered(x)], axis=1)
        hidden = np.maximum(pooled + self.weights["bias"], 0)
        return softmax(hidden @ self.weights["out"] + self.weights["out_bias"])

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.pairs is None:
            self.tables()
        found = [self.forward(x[i : i + AT_ONCE]) for i in range(0, len(x), AT_ONCE)]
        return np.concatenate(found) if found else np.zeros((0, len(self.labels)), np.float32)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        self.tables(two=False)
        best = self.filtered(x)
        at = [b.argmax(axis=1) for b in best]
        hidden = np.concatenate([b.max(axis=1) for b in best], axis=1) + self.weights["bias"]
        active = hidden > 0
        hidden = np.where(active, hidden, 0)
        wrong = softmax(hidden @ self.weights["out"] + self.weights["out_bias"])
        wrong[np.arange(len(y)), y] -= 1
        wrong /= len(y)
        back = (wrong @ self.weights["out"].T) * active
        out = {"out": hidden.T @ wrong, "out_bias": wrong.sum(0), "bias": back.sum(0), "embedding": np.zeros_like(self.weights["embedding"])}
        rows = np.arange(len(x))[:, None]
        for k, w in enumerate(WIDTHS):
            g = back[:, k * FILTERS : (k + 1) * FILTERS]
            f = self.weights[f"filter{w}"]
            d = np.zeros_like(f)
            for j in range(w):
                seen = x[rows, at[k] + j]
                d[j] = np.einsum("bf,bfe->ef", g, self.weights["embedding"][seen])
                np.add.at(out["embedding"], seen, g[..., None] * f[j].T[None])
            out[f"filter{w}"] = d
        return out


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(rows: list[tuple[str, str]]) -> Network | None:
    """A network for (language, text) rows, by Adam over whole and shortened windows; None without rows."""
    labels = sorted({lang for lang, _ in rows})
    if not labels:
        return None
    network = Network(labels)
    if len(labels) == 1:
        return network
    rng = np.random.default_rng(SEED)
    x, y = [], []
    for lang, text in rows:
        for w in windows(text.encode()[: HEAD * 4]):
            cut = w.copy()
            cut[rng.integers(8, LENGTH) :] = 0
            for one in (w, cut):
                if one.any():
                    x.append(one)
                    y.append(labels.index(lang))
    x, y = np.array(x), np.array(y)
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in network.weights.items()}
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for i in range(0, len(x), BATCH):
            step += 1
            take = order[i : i + BATCH]
            for k, g in network.gradients(x[take], y[take]).items():
                m, v = moments[k]
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                network.weights[k] -= (RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    network.pairs = None
    return network


def remainder(key: Column) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 4


def sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int = PER_LANGUAGE, texts: int = TEXTS) -> list[tuple[str, str]]:
    """(language, characters) of the rows that the fit reads."""
    text = F.col(text_col).cast("string")
    df = docs.select(F.col(id_col).cast("string").alias("id"), F.col(lang_col).alias("lang"), text.alias("text"))
    df = df.filter("lang is not null and text is not null and text <> ''").withColumn("h", F.xxhash64("id", "text"))
    counts = df.groupBy("lang").agg(F.count("*").alias("n"))
    counts = counts.withColumn("wanted", F.least(F.lit(per_language), F.greatest(F.lit(1), F.floor(F.lit(texts) / F.count("*").over(W.partitionBy())))))
    counts = counts.withColumn("share", F.least(F.lit(1.0), (SPARE * F.col("wanted") + 50) / F.col("n")))  # 50: enough of a rare language
    near = df.join(counts, "lang").filter(F.pmod("h", F.lit(1 << 30)) < F.col("share") * (1 << 30))
    start = F.pmod("h", F.greatest(F.length("text") - HEAD + 1, F.lit(1))).cast("int") + 1
    near = near.select("lang", "id", "h", "wanted", F.substring("text", start, F.lit(HEAD)).alias("text"))
    nth = F.row_number().over(W.partitionBy("lang").orderBy("h", "id", "text"))
    rows = near.withColumn("nth", nth).filter("nth <= wanted").orderBy("lang", "h", "id", "text").limit(max(texts, per_language))
    return [(r.lang, r.text) for r in rows.collect()]


def predict(docs: DataFrame, network: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``lang_pred`` and ``score`` (probability of the prediction) of each row; no shuffle."""
    held = broadcast(docs.sparkSession, network and (network.labels, network.weights))

    def make():
        model = held.value and Network(*held.value)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column(1).to_pylist()
            cuts = [windows(t.encode()) if model and t and LETTER.search(t) else None for t in texts]
            langs, scores = [], []
            for probabilities in judged(model, cuts):
                if probabilities is None:
                    langs.append("und")
                    scores.append(0.0)
                else:
                    best = int(probabilities.argmax())
                    langs.append(model.labels[best])
                    scores.append(min(1.0, float(probabilities[best])))
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

        return step

    docs = documents(docs, id_col, text_col)
    return map_batches(docs, make, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def judged(model: Network, cuts: list[np.ndarray | None]):
    """Mean probabilities of each text, by its windows' letters; all windows of a batch pass the network together."""
    some = [c for c in cuts if c is not None]
    if some:
        x = np.concatenate(some)
        weight = (x > 0).sum(axis=1, keepdims=True) + 1e-9
        p = model.predict(x) * weight
    at = 0
    for c in cuts:
        if c is None:
            yield None
        else:
            n = len(c)
            yield p[at : at + n].sum(axis=0) / weight[at : at + n].sum()
            at += n


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    known = docs.filter(remainder(F.col("doc_id")) != 2)
    network = train(sample(known, "doc_id", "text", "lang"))
    found = predict(docs, network)
    return found.select("doc_id", (remainder(F.col("doc_id")) == 2).alias("held_out"), "lang_pred", "score")


QUERIES = {"op4_langid": op4_langid}
ORACLE: dict[str, str] = {}
