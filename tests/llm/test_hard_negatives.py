"""Hard negatives against all scores, and the pruning of a tile."""

import numpy as np
import pytest

from marketloom.llm import hard_negatives as H


def plain(rows, anchors, positives=5, negatives=3, low=50, high=95):
    rows = [r for r in rows if None not in r]
    own = {}
    for i, label, v in (a for a in anchors if None not in a):
        own[i] = min(own.get(i, (label, v)), (label, v))
    out = []
    for i, (label, v) in own.items():
        scored = sorted((-sum(x * y for x, y in zip(v, w)), j, of) for j, of, w in rows if j != i and len(w) == len(v))
        best = [(-s, j) for s, j, of in scored if of == label][:positives]
        for p, j in best:
            inside = [(-s, n) for s, n, of in scored if of != label and low * p <= -100 * s <= high * p][:negatives]
            out += [(i, j, r + 1, n, p, s) for r, (s, n) in enumerate(inside)]
    return sorted(out)


def run(spark, rows, anchors, **how):
    schema = "id long, label int, v array<bigint>"
    df = spark.createDataFrame(rows, schema).repartition(3)
    got = H.hard_negatives(df, spark.createDataFrame(anchors, schema), **how)
    return sorted(tuple(r) for r in got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


@pytest.mark.parametrize("seed,spread,labels", [(1, 3, 3), (2, 90, 4), (3, 1, 2)])
def test_against_all_scores(spark, seed, spread, labels):
    rng = np.random.default_rng(seed)
    centres = rng.integers(-60, 60, (5, 19))
    rows = [(k, int(rng.integers(labels)), (centres[rng.integers(5)] + rng.integers(-spread, spread + 1, 19)).tolist()) for k in range(300)]
    rows += [(300 + k, k % labels, rows[7][2]) for k in range(80)]  # copies of one vector, ties
    rows += [(400, None, rows[0][2]), (401, 1, None), (None, 0, rows[0][2]), (402, 0, [1, 2]), (403, 1, [2, 2]), (404, 0, [0] * 19), (405, 9, rows[3][2])]
    anchors = [r for r in rows if r[0] is not None and r[0] % 25 == 0] + [(405, 9, rows[3][2]), (404, 0, [0] * 19), (402, 0, [1, 2])]
    assert run(spark, rows, anchors, shard_rows=64) == plain(rows, anchors)


def test_repeated_ids_and_nothing(spark):
    rows = [(1, 0, [3, 4]), (1, 0, [3, 4]), (2, 0, [5, 1]), (3, 1, [2, 2]), (3, 1, [2, 2]), (4, 1, [-9, -9])]
    assert run(spark, rows, [rows[0], rows[1], rows[2]]) == plain(rows, [rows[0], rows[2]])
    assert run(spark, [], []) == []
    assert run(spark, rows, [(8, 5, [1, 1])]) == []


def test_no_candidate_is_missing():
    rng = np.random.default_rng(8)
    for scale in (1, 50, 3000):
        c = rng.normal(0, scale, (400, 40)) * np.linspace(0.1, 3, 40)
        c, q = np.round(c).astype(np.int64), np.round(c[:6] * 0.9).astype(np.int64)
        scores = q @ c.T
        for share in (0.9, 0.5, 0.1, -1.0):
            least = np.round((q * q).sum(axis=1) * share).astype(np.int64)
            found = H.candidates(q, least, c)
            must = np.flatnonzero((scores >= least[:, None]).any(axis=0))
            assert set(must) <= set(found.tolist())
            if share == 0.9:
                assert len(found) <= 100  # of 400
