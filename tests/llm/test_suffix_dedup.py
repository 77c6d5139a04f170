"""Repeated strings against a plain count of all strings."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from marketloom.llm import suffix_dedup as S
from marketloom.llm.textkernels import text_buffer


def plain(texts, length):
    """(n_bytes, n_removed, n_spans, kept_sha256) of each text."""
    bodies = [(t or "").encode() for t in texts]
    times = Counter(b[i : i + length] for b in bodies for i in range(len(b) - length + 1))
    out = []
    for b in bodies:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if times[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out


def run(spark, texts, length, ids=None):
    ids = ids or list(range(len(texts)))
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in zip(ids, texts)], "doc_id long, text string, code string, doc int").repartition(3)
    rows = S.remove_repeats(df, length).collect()
    return sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows)


def mixed(seed, letters, pieces):
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice(letters) for _ in range(n))
    stock = [word(rng.randrange(3, 60)) for _ in range(pieces)]
    texts = ["".join(rng.choice(stock) if rng.random() < 0.4 else word(rng.randrange(1, 25)) for _ in range(rng.randrange(0, 12))) for _ in range(50)]
    return texts + texts[:5] + [None, "", "a" * 70, "ab" * 40, "é" * 30]


@pytest.mark.parametrize("length,letters,seed", [(12, "ab", 1), (20, "abcdefgh ", 2), (31, "aé€ x", 3), (8, "abcd", 4)])
def test_against_all_strings(spark, length, letters, seed):
    texts = mixed(seed, letters, 12)
    want = sorted((i, *x) for i, x in enumerate(plain(texts, length)))
    assert run(spark, texts, length) == want


def test_production_length(spark):
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("etaoin shrdlu.\n") for _ in range(n))
    passage, base = word(420), word(3000)
    near = base[:1000] + "X" + base[1001:2000] + base[2150:]
    texts = [word(800) + passage + word(300), passage[13:], base, near, base[:199], passage[:200] + word(50), word(90) + passage[50:249] + word(90), word(199), *[word(150) + passage for _ in range(40)]]
    assert run(spark, texts, 200) == sorted((i, *x) for i, x in enumerate(plain(texts, 200)))


def test_repeated_and_null_rows(spark):
    t = "the same row, some times over; " * 9
    texts, ids = [t, t, t[:120] + "?", None, t[40:], "z"], [7, 7, 7, None, None, None]
    got = S.remove_repeats(spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string"), 40)
    want = sorted((i if i is not None else -1, *x) for i, x in zip(ids, plain(texts, 40)))
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()) == want
    assert S.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_sites_cover_every_start(monkeypatch):
    monkeypatch.setattr(S, "_SEGMENT", 64)
    rng = random.Random(5)
    texts = ["".join(rng.choice("abc") for _ in range(n)) for n in (0, 11, 12, 13, 200, 500)]
    text, first, n, back, gram, _ = S.sites(*text_buffer(pa.array(texts)), 12)
    seen = Counter((int(t), int(f) + k) for t, f, m in zip(text, first, n) for k in range(int(m)))
    assert seen == Counter((i, s) for i, t in enumerate(texts) for s in range(len(t) - 11))
    of = {}
    for t, f, m, b, g in zip(text, first, n, back, gram):
        for k in range(int(m)):  # equal strings have one gram at one distance
            assert of.setdefault(texts[t][f + k : f + k + 12], (int(g), int(b) - k)) == (int(g), int(b) - k)


def test_very_long_text(spark):
    rng = np.random.default_rng(3)
    body = rng.integers(97, 123, 1_300_000).astype(np.uint8).tobytes().decode()
    texts = [body, "q" + body[700_000:700_500] + "q", body[1_299_700:]]
    got = run(spark, texts, 200)
    assert [(g[1], g[2], g[3]) for g in got] == [(1_300_000, 800, 2), (502, 500, 1), (300, 300, 1)]
