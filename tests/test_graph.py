import random

from tessella.operators.graph import connected_components


def brute(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def test_components_equal_union_find(spark):
    rng = random.Random(7)
    for edges in (
        [(i, i + 1) for i in range(40)],
        [(rng.randrange(80), rng.randrange(80)) for _ in range(60)],
        [(0, i) for i in range(1, 50)] + [(100, 99), (99, 98), (98, 100)],
    ):
        edges = [e for e in edges if e[0] != e[1]]
        df = spark.createDataFrame(edges + edges[:3], "src long, dst long")
        got = {r.node: r.component for r in connected_components(df).collect()}
        assert got == brute(edges)


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([(1, 1), (None, 2)], "src long, dst long")).collect() == []
