import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from tessella.operators import similarity as S
from tessella.plans import text as T
from tests.oracle import compare


def made(folder):
    """Texts with a line that all share, near and exact copies, copies in another order of sentences, short and empty ones."""
    draw = random.Random(5)
    common = "this line is in every text of the table without any change"
    texts = []
    for _ in range(40):
        words = [f"w{draw.randrange(4000)}" for _ in range(draw.randrange(8, 90))]
        texts += [" ".join([*words, common]) for _ in range(2)]
        for _ in range(3):
            near = list(words)
            for _ in range(draw.randrange(1, 4)):
                near[draw.randrange(len(near))] = "other"
            texts.append(" ".join([common, *near]))
    texts += ["!!!", "???", "", None, "a b", "A, b!", "a", common, common.upper()]
    pq.write_table(pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": texts}), folder / "documents.parquet")
    return str(folder)


def test_join_and_clusters_of_odd_texts(spark, tmp_path):
    """Texts without words are in no pair, and so in no cluster."""
    where = made(tmp_path)
    compare(spark, where, T.q_similarity_join, T.SQL_SIMILARITY)
    compare(spark, where, T.q_duplicate_clusters, T.SQL_CLUSTERS)


def test_join_takes_any_order_of_shingles(spark, tmp_path, monkeypatch):
    """Counts that are not known, and parts of a few shingles, change no pair."""
    where = made(tmp_path)
    for known, counted in ((1, 100), (1_000, 500)):
        monkeypatch.setattr(S, "KNOWN", known)
        monkeypatch.setattr(S, "COUNTED", counted)
        compare(spark, where, T.q_similarity_join, T.SQL_SIMILARITY)


def test_frequent_shingles_come_last(spark, tmp_path):
    """A line that all texts share makes no bucket of all texts."""
    texts = [(i, " ".join(f"w{i}x{j}" for j in range(60)) + " one two three four five six") for i in range(300)]
    sets = S.shingle_sets(spark.createDataFrame(texts, "id int, t string"), "id", "t")
    most = S.prefixes(sets, 0.8).groupBy("hash").count().selectExpr("max(count)").first()[0]
    assert most == 1


def test_sets_of_a_group_are_sent_once(spark, tmp_path, monkeypatch):
    """A group of near copies ships each set once to each cell, not once a pair; in parts, as many times as there are parts."""
    draw = random.Random(6)
    words = [f"w{i}" for i in range(160)]
    texts = []
    for i in range(60):
        near = list(words)
        near[draw.randrange(160)] = f"other{i}"
        texts.append((i, " ".join(near)))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    sent = []
    old = S.compared
    monkeypatch.setattr(S, "compared", lambda placed, *more: (sent.append(placed), old(placed, *more))[1])
    want = sorted(tuple(r) for r in S.jaccard_join(docs, "doc_id", "text").select("left_id", "right_id").collect())
    assert len(want) == 60 * 59 // 2
    rows = lambda df: df.selectExpr("g", "i", "j", "explode(array(a, b)) AS d").distinct().count()
    assert rows(sent[0]) == 60
    some = S.jaccard_join(docs, "doc_id", "text", forest=True).count()
    assert some == 59  # clusters need no more
    monkeypatch.setattr(S, "A_CELL", 2_000)
    monkeypatch.setattr(S, "A_SET", 1)
    assert sorted(tuple(r) for r in S.jaccard_join(docs, "doc_id", "text").select("left_id", "right_id").collect()) == want
    assert sent[2].select("i", "j").distinct().count() > 1 and rows(sent[2]) <= 60 * 6


def test_forest_has_the_same_components(spark, tmp_path):
    """Clusters need no pair of each two near copies: a cell's links are fewer than its sets."""
    where = made(tmp_path)
    docs = spark.read.parquet(f"{where}/documents.parquet")
    every = S.jaccard_join(docs, "doc_id", "text").collect()
    some = S.jaccard_join(docs, "doc_id", "text", forest=True).collect()
    assert len(some) < len(every) and {tuple(r) for r in some} <= {tuple(r) for r in every}


def test_shingles_of_one_mark_lose_no_pair(spark, tmp_path, monkeypatch):
    """Prefixes are of half hashes; where many are alike, pairs are the same."""
    where = made(tmp_path)
    old = S._packed
    monkeypatch.setattr(S, "_packed", lambda found: old(np.sort((found >> 32) % 50 << 32)))
    compare(spark, where, T.q_similarity_join, T.SQL_SIMILARITY)
