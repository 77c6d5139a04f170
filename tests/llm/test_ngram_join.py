import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from marketloom.llm import ngram_join as J
from marketloom.llm.textkernels import shingle_sets, text_buffer, word_hashes


def words(t):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def shingles(t, n=5):
    w = words(t)
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(rows, num=80, den=100):
    sets = [shingles(t) for _, t in rows]
    parent = {i: i for i, _ in rows if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            i, j = rows[a][0], rows[b][0]
            if i is None or j is None or not sets[a] or not sets[b]:
                continue
            o = len(sets[a] & sets[b])
            if den * o >= num * len(sets[a] | sets[b]):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return [(i, len(s), None if i is None else find(i)) for (i, _), s in zip(rows, sets)]


def corpus(seed, n=160):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)] + ["Ünï", "ça,", "A.b"]
    base = [[rng.choice(vocabulary) for _ in range(rng.choice([3, 5, 8, 40, 120, 300]))] for _ in range(n // 4)]
    common = [rng.choice(vocabulary) for _ in range(30)]
    rows = []
    for k in range(n):
        t = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 4, 8])):
            if t:
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
        if rng.random() < 0.2:
            t = t + common
        rows.append((k * 3 + 1, rng.choice([" ", "\n", " \t "]).join(t)))
    t = rows[5][1].split() + ["x"] * 5
    rows += [(9000 + k, " ".join(t[:k] + ["y"] + t[k:])) for k in range(25)]  # a group of near copies
    return rows + [(7, "again " * 9), (7, rows[9][1]), (None, rows[3][1]), (500, None), (501, ""), (502, " \n"), (503, "one two"), (504, "ONE\ttwo"), (505, rows[0][1].upper())]


def rowsort(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


@pytest.mark.parametrize(
    ("seed", "tile_rows", "dense", "sample", "hot"),
    [(1, 2048, J.DENSE, 20_000, J.HOT_ROWS), (2, 6, J.DENSE, 20_000, 4), (3, 6, 0, 1, 4), (4, 2048, 0, 20_000, 6), (5, 12, 4, 40, 2)],
)
def test_against_brute_force(spark, monkeypatch, seed, tile_rows, dense, sample, hot):
    """As shipped, and with bounds so low that tiles are cut, settled on the spot and hot elements dealt to parts."""
    monkeypatch.setattr(J, "DENSE", dense)
    monkeypatch.setattr(J, "HOT_ROWS", hot)
    rows = corpus(seed)
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, n int, component_id string")
    got = J.ngram_jaccard_components(df, tile_rows=tile_rows, sample_rows=sample).collect()
    assert rowsort(map(tuple, got)) == rowsort(brute(rows))


def test_repeated_identifiers_keep_all_their_classes(spark):
    a, b = [f"a{k}" for k in range(60)], [f"b{k}" for k in range(60)]
    rows = [(3, " ".join(b)), (5, " ".join(a)), (5, " ".join(b)), (7, " ".join([*a, "more"]))]
    rng = random.Random(6)
    rows += [(rng.randrange(1000, 1100), t) for _, t in corpus(6) if t]
    got = J.ngram_jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert rowsort(map(tuple, got)) == rowsort(brute(rows))
    assert {r["component_id"] for r in got if r["doc_id"] in (3, 5, 7)} == {3}


def test_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert J.ngram_jaccard_components(df).collect() == []


def test_bound_holds():
    rng = np.random.default_rng(5)
    for _ in range(50):
        a = np.unique(rng.integers(0, 400, rng.integers(1, 200)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        b = np.unique(rng.integers(0, 400, rng.integers(1, 200)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        x, y = (np.frombuffer(J.signature(s), np.uint64) for s in (a, b))
        least = min(len(x), len(y))
        assert J._overlap_bound(J._folded(x, least), J._folded(y, least), len(a), len(b)) >= len(np.intersect1d(a, b))


def test_kernels_follow_words():
    texts = ["The the  THE\n", "", None, "é é É", "x" * 3_000_000 + " y", " a\x0bb ", "Aé"]
    raw, s, e = text_buffer(pa.array(texts))
    for t, got in zip(texts, shingle_sets(raw, s, e), strict=True):
        assert len(got) == len(shingles(t))
    seen = defaultdict(set)
    for t in texts:
        buf = np.frombuffer((t or "").encode(), np.uint8)
        for a, b, h in zip(*word_hashes(buf)):
            seen[int(h)].add(bytes(buf[a:b]).lower())
    assert all(len(v) == 1 for v in seen.values())


def test_a_chain_of_versions(spark):
    """Two hundred versions of one document, each close to the next and with rising identifiers, are one component."""
    rng = random.Random(12)
    words = [f"w{rng.randrange(10**6)}" for _ in range(80 + 2 * 200)]
    rows = [(k, " ".join(words[2 * k : 2 * k + 80])) for k in range(200)]
    got = {r["doc_id"]: r["component_id"] for r in J.ngram_jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: 0 for k in range(200)}
    assert {c for _, _, c in brute(rows)} == {0}
