import random

import pytest

from factloom.operators import graphs
from factloom.operators.graphs import connected_components, lookup


@pytest.mark.parametrize("few, hot", [(100_000, 1000), (10, 20)])
def test_components_match_union_find(spark, monkeypatch, few, hot):
    monkeypatch.setattr(graphs, "FEW_EDGES", few)
    monkeypatch.setattr(graphs, "HOT", hot)
    rng = random.Random(4)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(500 + i, 501 + i) for i in range(40)] + [(900, 900), (900, 900)] + [(1000, 1001 + i) for i in range(60)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = {r[0]: r[1] for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {x: root(x) for x in parent}


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "a string, b string"), "a", "b").count() == 0
    assert connected_components(spark.createDataFrame([("x", None)], "a string, b string"), "a", "b").count() <= 1


def test_lookup_keeps_every_row(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(3000)] + [(9999, None)], "i long, k string")
    table = spark.createDataFrame([("hot", 1), ("k0", 2)], "k string, v long")
    got = {r["i"]: r["v"] for r in lookup(rows, table, "k").collect()}
    assert len(got) == 3001 and got[1] == 1 and got[0] == 2 and got[3] is None and got[9999] is None
