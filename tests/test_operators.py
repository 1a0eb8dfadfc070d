import pytest
from pyspark.sql import functions as F

from tessella.functions import html
from tessella.functions import text as T
from tessella.operators import gates, matrix, metrics, splits
from tessella.operators.ranks import strict_percentile
from tessella.operators.repeats import repeat_scan
from tessella.sources import files, sinks
from tessella.streaming import events as E


def test_strict_percentile_ties_and_missing(spark):
    df = spark.createDataFrame([("seo", 1.0), ("seo", 2.0), ("seo", 3.0), ("news", 9.0), ("tie", 5.0), ("tie", 5.0), ("tie", 7.0), ("gap", None), ("gap", 1.0), ("gap", 2.0)], "g string, v double")
    got = sorted((r.g, r.v or 0, None if r.p is None else round(r.p, 4)) for r in strict_percentile(df, "v", ["g"], "p").collect())
    assert got == [("gap", 0, None), ("gap", 1.0, 0.0), ("gap", 2.0, 0.5), ("news", 9.0, 0.0), ("seo", 1.0, 0.0), ("seo", 2.0, 0.3333), ("seo", 3.0, 0.6667), ("tie", 5.0, 0.0), ("tie", 5.0, 0.0), ("tie", 7.0, 0.6667)]


def test_repeat_scan_counts(spark):
    a, b = "This sentence is long enough to be counted here.", "Another sentence that is also long enough to count."
    rows = [(1, f"{a} {a} {b}"), (2, f"{a} {a} {a} {b}"), (3, f"{a} {a} {b} {b}"), (4, f"{a} {b} {a}"), (5, "Short. X.Y")]
    got = {r.doc: r for r in repeat_scan(spark.createDataFrame(rows, "doc long, text string"), "doc", "text").collect()}
    assert [round(got[i].repeat_share, 4) for i in (1, 2, 3)] == [0.6667, 0.75, 1.0]
    assert (got[2].most_copies, got[2].n_kinds, got[3].n_kinds) == (3, 1, 2)
    assert (got[2].longest_run, got[2].n_adjacent, got[4].longest_run, got[4].n_adjacent) == (3, 2, 1, 0)
    assert 5 not in got


def test_calibration_by_hand(spark):
    df = spark.createDataFrame([(0.1, 0)] * 2 + [(p / 100, 0) for p in range(20, 28)], "p double, y int").withColumn("g", F.lit(1))
    bins = {(round(r.mean_score, 2), r.n): r.bin for r in metrics.tie_safe_bins(df, ["g"], "p", "y", 10).collect()}
    assert bins[0.1, 2] in (0, 1) and len(bins) == 9
    zeros = spark.createDataFrame([(0.0, 0)] * 8 + [(0.0, 1)] * 2, "p double, y int").withColumn("g", F.lit(1))
    r = metrics.calibration(zeros, ["g"], "p", "y", 2).first()
    assert (round(r.ece, 6), round(r.mce, 6)) == (0.2, 0.2)
    brier = spark.createDataFrame([(0.5, 1), (0.5, 0)], "p double, y int").withColumn("g", F.lit(1))
    assert metrics.calibration(brier, ["g"], "p", "y", 2).first().brier == 0.25


def test_risk_coverage_by_hand(spark):
    df = spark.createDataFrame([(0.99, 1), (0.98, 1), (0.51, 0), (0.52, 0)], "p double, y int").withColumn("g", F.lit(1))
    got = {r.target: r for r in metrics.risk_coverage(df, ["g"], "p", "y", [1.0, 0.5]).collect()}
    assert (got[1.0].risk, got[0.5].risk) == (0.5, 0.0)
    ties = spark.createDataFrame([(0.9, 1)] + [(0.6, 1)] * 3, "p double, y int").withColumn("g", F.lit(1))
    r = metrics.risk_coverage(ties, ["g"], "p", "y", [0.5]).first()
    assert r.n_kept == 4 and r.coverage > 0.5


def test_one_class_has_no_rates(spark):
    df = spark.createDataFrame([(0.9, 0)] * 3, "p double, y int").withColumn("g", F.lit(1))
    r = metrics.confusion(df, ["g"], "p", "y").first()
    assert (r.fpr, r.tpr, r.mcc, r.balanced_accuracy) == (1.0, None, None, None)
    assert metrics.auroc(df, ["g"], "p", "y").first().auroc is None


def test_patch_touches_only_what_differs(spark):
    cells = spark.createDataFrame([("a", "f", "1"), ("a", "g", "2"), ("b", "f", "3")], "document_id string, feature_id string, v string")
    fixes = spark.createDataFrame([("a", "f", "9"), ("b", "f", "3")], cells.schema)
    out, log = matrix.patch(cells, fixes, "v")
    assert sorted(map(tuple, out.collect())) == [("a", "f", "9"), ("a", "g", "2"), ("b", "f", "3")]
    assert [tuple(r) for r in log.collect()] == [("a", "f", "1", "9")]


def test_cell_value_keeps_zero(spark):
    df = spark.createDataFrame([("0", "5"), ("", "5"), ("", "")], "b string, a string")
    assert [r[0] for r in df.select(matrix.cell_value("b", "a")).collect()] == [0.0, 5.0, None]


def test_gates_raise(spark):
    df = spark.createDataFrame([(1, "x", 0.2), (1, "", 1.4), (2, "z", 0.5)], "k int, v string, p double")
    with pytest.raises(gates.GateError, match="required:v: 1 rows"):
        gates.gate(gates.required(df, "k", ["v"]), gates.unique(df, ["k"]), gates.holds(df, "k", "probability", F.col("p").between(0, 1), F.col("p")))
    gates.gate(gates.allowed(df, "k", "k", [1, 2]), gates.grid(df, {"k": [1, 2]}))
    with pytest.raises(gates.GateError, match="grid"):
        gates.gate(gates.grid(df, {"k": [1, 2, 3]}))


def test_folds_and_values():
    assert splits.greedy_folds([("a", 5), ("b", 4), ("c", 3), ("d", 3)], 2) == {"a": 0, "b": 1, "c": 1, "d": 0}
    assert splits.held_values([("big", 90), ("s", 4), ("t", 8)], 0.1) == ["s", "t"]


def test_page_text_skips_noise():
    page = "<html><head><title> A  T </title></head><nav>menu</nav><p>One &amp; two<p>One &amp; two<div>three<script>x</script></div>"
    assert html.read(page) == {"title": "A T", "blocks": ["One & two", "three"]}
    assert html.read(None) == {"title": None, "blocks": []}


def test_files(spark, tmp_path):
    (tmp_path / "j.jsonl").write_text('{"k": 1, "v": "a", "n": 1}\nbroken\n{"k": 1, "v": "b", "n": 2}\n{"k": 2, "v": "c", "n": 1}\n')
    got = files.journal(spark, f"{tmp_path}/j.jsonl", "k int, v string, n int", ["k"], "n").collect()
    assert sorted((r.k, r.v) for r in got if r.k is not None) == [(1, "b"), (2, "c")]
    (tmp_path / "lex.txt").write_text("! note\ngood, pos\nbad, neg\ngood, adj\n")
    assert {r.term: r.tags for r in files.lexicon(spark, f"{tmp_path}/lex.txt").collect()} == {"good": ["adj", "pos"], "bad": ["neg"]}
    (tmp_path / "t.md").write_text("# x\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n| c | d |\n|---|---|\n| 3 | 4 |\n| 5 | 6 |\n")
    assert [r.cells for r in files.markdown_table(spark, f"{tmp_path}/t.md", "c").orderBy("row").collect()] == [["3", "4"], ["5", "6"]]
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "one.txt").write_text("text\nof one")
    assert [tuple(r) for r in files.texts(spark, f"{tmp_path}/d").collect()] == [("one", "text\nof one")]
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    sinks.write_csv(df, f"{tmp_path}/c")
    assert sorted(files.csv(spark, f"{tmp_path}/c", "k int, v string").collect()) == sorted(df.collect())
    df.write.parquet(f"{tmp_path}/p")
    sinks.append_new(spark.createDataFrame([(2, "z"), (3, "n"), (3, "n")], df.schema), f"{tmp_path}/p", "k")
    assert sorted(r.k for r in spark.read.parquet(f"{tmp_path}/p").collect()) == [1, 2, 3]
    a, b = sinks.manifest(df, "t").first(), sinks.manifest(df.orderBy(F.desc("k")).repartition(2), "t").first()
    assert a == b and a.n_rows == 2


def test_streams(spark, tmp_path):
    rows = spark.sql("SELECT id, timestamp_seconds(id * 60) AS ts, id % 3 AS key FROM range(90)")
    rows.repartition(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")

    def run(df, mode):
        q = df.writeStream.format("memory").queryName("out").outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table("out").collect()

    assert sum(r.n for r in run(E.windowed_counts(stream, "ts", ["key"], "30 minutes"), "complete")) == 90
    assert len(run(E.first_seen(stream, "ts", ["key"]), "append")) == 3
    sink = E.resumable(f"{tmp_path}/journal", ["id"])
    for _ in range(2):
        sink(rows, 0)
    assert spark.read.parquet(f"{tmp_path}/journal").count() == 90


def test_text_functions(spark):
    df = spark.createDataFrame([("One  two. Three!\nFour",), ("",)], "t string")
    got = df.select(T.sentences(F.col("t")).alias("s"), T.shingles(T.words(F.col("t")), 5).alias("x"), T.shingles(T.words(F.col("t")), 3).alias("y")).collect()
    assert got[0].s == ["One  two.", "Three!", "Four"] and got[0].x == ["One two. Three! Four"] and len(got[0].y) == 2
    assert got[1].s == [] and got[1].x == []
    row = spark.range(1).select(T.jaccard(F.array(F.lit(1), F.lit(2)), F.array(F.lit(2), F.lit(3))), T.overlap(F.array(F.lit(1), F.lit(2)), F.array(F.lit(2)))).first()
    assert round(row[0], 6) == 0.333333 and row[1] == 1.0
    assert spark.createDataFrame([("keep\n | Read more —\nx",)], "t string").select(T.without_lines(F.col("t"), T.PLATFORM_LINES)).first()[0] == "keep\nx"
