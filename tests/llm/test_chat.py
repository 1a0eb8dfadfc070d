import random

from tessella.llm import chat
from tests.oracle import compare

SF = "/root/testdata/sf0.01"


def plain(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, set()).add((turn or 0, role or "", text or ""))
    convs = {c: sorted(x) for c, x in convs.items()}
    kept = {}
    for c, x in sorted(convs.items()):
        cuts = [k for k in range(1, len(x) + 1)]
        longer = any(y[: len(x)] == x and len(y) > len(x) and y[len(x)][0] > x[-1][0] for y in convs.values())
        if not longer and x not in kept.values() and cuts:
            kept[c] = x
    return {c: "".join(f"<|{r}|>\n{t}<|end|>\n" for _, r, t in x) for c, x in kept.items()}


def test_equals_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    rows = []
    for c in range(60):
        base = rng.randrange(4)
        n = rng.randrange(1, 9)
        rows += [(c, i, "user" if i % 2 == 0 else "assistant", f"text {base} {i}" if rng.random() < 0.97 else f"other {c}") for i in range(n)]
    rows += [(100, None, None, None), (101, 0, "", ""), (102, 0, "user", "long " * 30000), (None, 0, "user", "x"), rows[0], rows[0]]
    rows += [(103, 0, "a", "x"), (103, 0, "b", "y"), (104, 0, "a", "x")]
    rows += [(200, i, "user", "same") for i in range(50)] + [(201, i, "user", "same") for i in range(49)]
    df = spark.createDataFrame([(*r, 1, 1) for r in rows], "conv_id long, turn long, role string, text string, n int, run int")
    want = plain(rows)
    for run in (chat.RUN, 3):
        monkeypatch.setattr(chat, "RUN", run)
        got = chat.render(chat.collapse(df)).collect()
        assert {r.conv_id: r.rendered for r in got} == want and len(got) == len(want)
    assert chat.render(chat.collapse(df.limit(0))).collect() == []


def test_whole_table_equals_sql(spark):
    compare(spark, SF, chat.op2_chat, chat.SQL)
