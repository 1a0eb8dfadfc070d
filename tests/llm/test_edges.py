"""Odd tables for every operator and pipeline stage: extra columns change nothing, keys of any type, nulls, repeats and empty tables have defined results."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessella.llm import bpe, decontaminate, idfiles, langid, lm, passages, quality, simhash, urls

WORDS = [f"word{i}" for i in range(400)]
#: Names that the operators use themselves.
CLASHING = "__key __spans __copy __row key block shard fp component_id hash hashes words n_words hit item_id window part start ids pos spans kept quality row tag id host url kind".split()


def rows():
    rng = random.Random(7)
    new = lambda n: " ".join(rng.choices(WORDS, k=n))
    shared = new(70)
    texts = [None, "", " \t\n ", "x", "word1 " * 3000, new(5000), new(40), f"{new(30)} {shared} {new(30)}", f"{new(20)} {shared}", "é\U0001f600 \x00 b"]
    found = [(i, t, ("en", "es", None)[i % 3], "site", len(t or "")) for i, t in enumerate(texts)]
    found += [found[6], (6, texts[7], "en", None, None), (None, texts[6], None, None, None), (None, None, None, None, None)]
    return found


def documents(spark, kind, extra=False, empty=False):
    docs = spark.createDataFrame([] if empty else rows(), "doc_id long, text string, lang string, source string, n_chars int")
    docs = docs.withColumn("doc_id", F.col("doc_id").cast(kind))
    return docs.select("*", *[F.lit("9").alias(c) for c in CLASHING]) if extra else docs


def items(spark, empty=False):
    found = [] if empty else [(0, rows()[7][1], "a"), (1, None, "b"), (2, "", "c"), (2, "x", None)]
    return spark.createDataFrame(found, "item_id long, text string, name string")


def identified(docs):
    return langid.predict(docs, langid.train(langid.sample(docs, "doc_id", "text", "lang")))


OPERATORS = {
    "lm": lambda d: lm.score(d, lm.remainder(F.col("doc_id")) == 0, block_bytes=4000),
    "quality": quality.judge,
    "langid": identified,
    "bpe": bpe.round_trip,
    "decontaminate": lambda d: decontaminate.hits(d, items(d.sparkSession)),
    "simhash": simhash.near_duplicates,
}


def listed(df, columns=None):
    return sorted(map(repr, df.select(*(columns or df.columns)).collect()))


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_each_and_extra_columns_change_nothing(spark, name):
    plain = OPERATORS[name](documents(spark, "string"))
    assert plain.schema["doc_id"].dataType.simpleString() == "string"
    want = listed(plain)
    assert len(want) == len(rows())
    assert listed(OPERATORS[name](documents(spark, "string", extra=True)), plain.columns) == want
    assert OPERATORS[name](documents(spark, "long", empty=True)).collect() == []


@pytest.mark.parametrize("kind", ["string", "smallint"])
def test_passages(spark, kind):
    want = listed(passages.passages(documents(spark, kind)))
    assert want
    assert listed(passages.passages(documents(spark, kind, extra=True))) == want
    assert passages.passages(documents(spark, kind, empty=True)).collect() == []


@pytest.mark.parametrize("kind", ["string"])
def test_id_files(spark, tmp_path, kind):
    for name, extra, empty in (("plain", False, False), ("extra", True, False), ("empty", False, True)):
        idfiles.write(documents(spark, kind, extra, empty), f"{tmp_path}/{name}")
    want = listed(idfiles.read(spark, f"{tmp_path}/plain"))
    assert len(want) == len(rows())
    assert listed(idfiles.read(spark, f"{tmp_path}/extra")) == want
    assert idfiles.read(spark, f"{tmp_path}/empty").collect() == []


def test_urls(spark):
    pages = spark.createDataFrame([(0, None), (1, ""), (None, "http://a.com/en/"), (2, "x"), (2, "http://EXAMPLE.com/en/" + "q" * 2000), (3, "://")], "page_id long, url string")
    names = [F.lit("9").alias(c) for c in CLASHING if c != "url"]
    want = listed(urls.judge(pages))
    assert len(want) == 6
    assert listed(urls.judge(pages.select("*", *names)), urls.judge(pages).columns) == want
    assert urls.judge(pages.limit(0)).collect() == []


@pytest.mark.parametrize("kind", ["string"])
@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages(spark, stage, kind):
    folder = "/root/testdata/sf0.001"
    docs = documents(spark, kind)
    plain = stage(spark, docs, folder)
    want = listed(plain)
    assert len(want) <= len(rows())
    more = stage(spark, documents(spark, kind, extra=True), folder)
    assert listed(more, plain.columns) == want
    if stage is not corpus_pipeline.token_ids:
        assert plain.schema.simpleString() == docs.schema.simpleString()
        assert more.columns == documents(spark, kind, extra=True).columns
    assert stage(spark, documents(spark, kind, empty=True), folder).collect() == []
