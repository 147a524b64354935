import random

import pytest

from wirelattice.operators.components import connected_components


def union_find(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("edges", [
    [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 30)], [(random.Random(1).randrange(60), random.Random(i).randrange(60)) for i in range(50)], [(5, 5), (7, 3), (7, 3)], [],
])
def test_against_union_find(spark, edges):
    df = spark.createDataFrame(edges, "src long, dst long")
    assert {r["node"]: r["component"] for r in connected_components(df).collect()} == union_find(edges)


def test_null_ends_are_left_out(spark):
    df = spark.createDataFrame([(1, None), (2, 1)], "src long, dst long")
    assert connected_components(df).count() == 2


@pytest.mark.parametrize("edges", [
    [(i, i + 1) for i in range(600)], [(i, i + d) for i in range(500) for d in (1, 2, 3)], [(i, i + d) for i in range(1000) for d in range(1, 6)],
], ids=["path", "next 3", "next 5"])
def test_long_ascending_chains(spark, edges):
    df = spark.createDataFrame(edges, "src long, dst long")
    assert {r["node"]: r["component"] for r in connected_components(df).collect()} == union_find(edges)
