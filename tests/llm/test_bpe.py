import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer as Library

from tessella.llm import batch_bpe, bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    None,
    "",
    " \n\t ",
    "Hello<|endoftext|> worLd's ΑΣ x\x1cy café z \x85q <|startoftext|>x ​ab İ ﬁ 123 a\x00b",
    "a" * 5000,
    "the the the",
    "<|endoftext|><|endoftext|>",
    "<|endof text|> < <|",
    "\U0001f600 éè   x　y",
]


@pytest.fixture(scope="module")
def library():
    return Library.from_file(PATH)


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.vocabulary(PATH))


def ids_of(encoder, text):
    import numpy as np

    return np.frombuffer(encoder.encode(text), "<u4").tolist()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("thean'srev d<|>\né́Σ"), st.characters(max_codepoint=0x2FFF, exclude_categories=["Cs", "Cn"]))))
def test_any_text_equals_the_library(encoder, library, text):
    assert ids_of(encoder, text) == library.encode(text, add_special_tokens=False).ids


def test_query_rows(spark, library):
    rows = [(i, t, i) for i, t in enumerate(ODD)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = {r.doc_id: r for r in bpe.round_trip(docs, PATH, with_ids=True).collect()}
    for i, text, _ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert got[i].ids == ids
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    coded = bpe.encode(docs, PATH)
    assert {r.doc_id: r.ids for r in coded.collect()} == {i: r.ids for i, r in got.items()}
    decoded = {r.doc_id: r.decoded for r in bpe.decode(coded, PATH).collect()}
    assert all(decoded[i] == library.decode(got[i].ids, skip_special_tokens=False) for i in decoded)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.round_trip(docs, PATH).collect() == []


def test_memory_of_any_size_gives_the_same_ids():
    """What a worker remembers decides on time alone, and each worker has its own size."""
    vocab = bpe.vocabulary(bpe.default_path())
    text = "one two three two <x> one four five six seven two one"
    encoders = [bpe.Encoder(vocab, n) for n in (1, 3, 1_000)]
    assert len({e.encode(text) for e in encoders}) == 1
    assert len(encoders[0].chunks) == 1 and len(encoders[2].chunks) > 3


def test_a_worker_remembers_ids_only():
    """Chunks are remembered as their ids: four bytes an id and no strings made of them, by which a worker of the pipeline took too much memory."""
    encoder = bpe.Encoder(bpe.vocabulary(PATH))
    encoder.encode("one Two three, <|endoftext|> four")
    assert len(encoder.chunks) == 5 and all(type(ids) is bytes and len(ids) % 4 == 0 for c in (encoder.chunks, encoder.words) for ids in c.values())


def test_encoder_releases_the_broadcast_value(spark):
    held = bpe.Tokenizer(spark, PATH).held
    held.__dict__.pop("_value", None)
    bpe.worker_encoder("test", held)
    assert "_value" not in vars(held) and held.value["merges"]
    bpe._WORKER.clear()


def test_words_of_a_batch_are_merged_together(library):
    rng = random.Random(9)
    letters = "aeinorstthehe'0.,#é漢Σİ́ﬁ"
    texts = ["".join(rng.choice(letters + " \n\x1c\x85") for _ in range(rng.randrange(400))) for _ in range(60)]
    texts += [None, "", "a" * 33, "the " * 3000, "x" * 5000, "Ab <|endoftext|>cd<|endoftext|> THE", "\x1d\x1eone\x1ftwo it's 'LL"]
    encoder = batch_bpe.BatchEncoder(bpe.Encoder(bpe.vocabulary(PATH)))
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    texts += ["it's'll 're've", "'", "a'", "'s", "d 'r", "e''s'sabc 't1'd23'mé"]
    want += [library.encode(t, add_special_tokens=False).ids for t in texts[len(want) :]]
    for n in (1, 7, len(texts)):
        got = [x for i in range(0, len(texts), n) for x in encoder.encode(texts[i : i + n])]
        assert [x.tolist() for x in got] == want
