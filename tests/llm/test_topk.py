import math

import numpy as np

from marketloom.llm import topk_search as K
from pyspark.sql import functions as F


def brute(rows, queries, k):
    q = {i: [math.floor(256 * x) for x in v] for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for i in sorted(set(queries) & q.keys()):
        best = sorted(((-sum(a * b for a, b in zip(q[i], v)), j) for j, v in q.items() if j != i and len(v) == len(q[i])))[:k]
        out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    return out


def test_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(k, rng.normal(size=8).tolist()) for k in range(300)]
    rows += [(1000 + k, rows[3][1]) for k in range(40)]  # ties
    rows += [(2000, None), (2001, [1.0] * 7 + [None]), (2002, [float("nan")] + [0.0] * 7), (2003, [float("inf")] * 8), (None, [1.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").select(F.col("vec_id").alias("id"), K.quantised().alias("v"))
    queries = [i for i, _ in rows if i is not None and i % 20 == 0]
    want = sorted(brute(rows, queries, 5))
    for sizes in ({}, {"group_bytes": 200, "part_bytes": 900}):  # one task for all, and one for a tile or so
        got = K.exact_top_k(df.where("id % 20 = 0"), df, k=5, block_rows=32, fan_in=3, **sizes).collect()
        assert sorted(map(tuple, got)) == want


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1, 2]), (20, [3, 4]), (20, [3, 4])], "id long, v array<long>")
    got = sorted(map(tuple, K.exact_top_k(df.where("id = 0"), df).collect()))
    assert got == [(0, 1, 20, 11), (0, 2, 20, 11)]
    other = spark.createDataFrame([(0, [1, 2]), (5, [1, 2, 3]), (6, [4]), (7, [])], "id long, v array<long>")
    assert sorted(map(tuple, K.exact_top_k(other, other.unionByName(df)).collect())) == [(0, 1, 20, 11), (0, 2, 20, 11)]
    assert K.exact_top_k(df.limit(0), df).collect() == []
    assert K.exact_top_k(df, df.limit(0)).collect() == []


def test_beyond_double_precision():
    big = np.array([[2**30, 2**30]], dtype=np.int64)
    assert K.tile_scores(big, big)[0, 0] == 2**61
    assert K.tile_scores(big * 2**3, big * 2**3)[0, 0] == 2**63 - 1
