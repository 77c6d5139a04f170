"""Components of long paths, random graphs and stars against plain union-find; rounds stay logarithmic."""

import random

import pytest

from marketloom.operators import graph


def plain(edges):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    return {x: find(x) for x in up}


def components(spark, edges):
    df = spark.createDataFrame(edges, "a long, b long")
    return {r["node"]: r["component"] for r in graph.connected_components(df).collect()}


def counted(monkeypatch):
    made = []

    def written(df, what, real=graph.written):
        made.append(what)
        return real(df, what)

    monkeypatch.setattr(graph, "written", written)
    return made


def test_rising_path(spark, monkeypatch):
    made = counted(monkeypatch)
    edges = [(k, k + 1) for k in range(9_999)]
    assert components(spark, edges) == {k: 0 for k in range(10_000)}
    assert len(made) <= 28  # 2 log2 n


@pytest.mark.parametrize("seed", [1, 2])
def test_random_graphs(spark, seed, monkeypatch):
    made = counted(monkeypatch)
    rng = random.Random(seed)
    names = rng.sample(range(10**9), 2_000)
    edges = [(names[k], names[k + 1]) for k in range(700)] + [(rng.choice(names), rng.choice(names)) for _ in range(600)] + [(names[0], n) for n in names[1_500:1_800]] + [(5, 5)]
    rng.shuffle(edges)
    assert components(spark, edges) == plain(edges)
    assert made.count("hops") <= 11


def test_no_edges(spark):
    assert components(spark, [(3, 3)]) == {}
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).collect() == []
