"""Phrases and their scores against plain counts, with fingerprints that collide and a full bitmap too."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketloom.llm import collocations as C

TO_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counts(rows, longest):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(TO_LOWER)):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    return f, n


def plain(rows, longest=3, least=10, first=2000):
    f, n = counts(rows, longest)
    out = []
    for lang in n:
        own = {p: a for (of, p), a in f.items() if of == lang and len(p) > 1 and a >= least}
        found = []
        for p, a in own.items():
            if any(len(q) > len(p) and 100 * b >= 50 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in own.items()):
                continue
            score, _, left, right = min((1_000_000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, k + 1, p.decode(), -a, left, right, n[lang], -s) for k, (s, a, p, left, right) in enumerate(sorted(found)[:first])]
    return sorted(out)


def run(spark, rows, **how):
    df = spark.createDataFrame(rows, "lang string, text string").selectExpr("*", "1 AS doc", "2 AS code", "3 AS size").repartition(3)
    return sorted(tuple(r) for r in C.collocations(df, **how).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def rows_of(seed):
    rng = random.Random(seed)
    words = ["New", "york", "city", "über", "日本", "a", "the", "of", "x" * 40, "xx" * 20 + "y", "3.14", "hot", "dog"]
    fixed = ["new york city", "Hot Dog", "of the", "日本 über"]
    make = lambda: "".join(rng.choice([rng.choice(words), rng.choice(fixed)]) + rng.choice([" ", " ", "  ", "\t", ", ", ".\n", "!"]) for _ in range(rng.randrange(60)))
    rows = [(rng.choice(["en", "de", "und", None]), make()) for _ in range(90)]
    return rows + rows[:20] * 2 + [("en", None), ("en", ""), (None, " , "), ("fr", "one")]


@pytest.mark.parametrize("longest,least", [(3, 10), (2, 3), (4, 6)])
def test_against_plain_counts(spark, longest, least):
    rows = rows_of(longest)
    want = plain(rows, longest, least, 15)
    assert len(want) > 20
    assert run(spark, rows, longest=longest, least=least, first=15) == want


def test_small_slices_and_full_bitmap(spark):
    assert run(spark, rows_of(7), bits=8, slice_bytes=300) == plain(rows_of(7))


def test_words_of_one_hash_are_told_apart():
    text = b"alpha beta alphb beta alpha beta gamma alpha"
    buf = np.frombuffer(text, dtype=np.uint8)
    at = [m.span() for m in re.finditer(b"[^ ]+", text)]
    starts, ends = (np.array(x) for x in zip(*at))
    kinds = np.array([k % 3 == 0 for k in range(len(at))], dtype=np.uint64)
    ids = C.word_ids(buf, starts, ends, np.zeros(len(at), dtype=np.uint64), kinds)
    words = [(text[a:b], int(k)) for (a, b), k in zip(at, kinds)]
    assert all((ids[i] == ids[j]) == (words[i] == words[j]) for i in range(len(at)) for j in range(len(at)))


def test_what_stands_in_the_texts_decides(spark):
    """Pointers of all phrases at once, as if they had one fingerprint."""
    rows = [("en", "a b. c d. a b") for _ in range(12)] + [("en", "c d")]
    df = spark.createDataFrame(rows, "lang string, text string")
    docs = df.selectExpr("lang", "text", "xxhash64(lang, text) AS doc", "crc32(text) AS code")
    marks = C._frequent(C._counts(docs, 2, None, 3), 1).selectExpr("doc", "code", "at", "2 AS size", "times")
    marks = marks.groupBy("doc", "code", "at", "size").sum("times").withColumnRenamed("sum(times)", "times")
    got = {r["phrase"]: r["times"] for r in C._texts(docs, marks).collect()}
    assert got == {"a b": 24, "c d": 13}


def test_nothing(spark):
    assert C.collocations(spark.createDataFrame([], "lang string, text string")).collect() == []


def test_scores_are_exact_beyond_64_bits(spark):
    rows = [(10**14 - 3, 10**14 - 1, 10**14 + 7), (999_999_999_999_999, 999_999_999_999_999, 999_999_999_999_999), (10, 10, 10), (3_037_000_500, 3_037_000_501, 3_037_000_507), (10, 999_999_999_999_999, 999_999_999_999_998)]
    got = spark.createDataFrame(rows, "a long, l long, r long").withColumn("s", C.exact_score(F.col("a"), F.col("l"), F.col("r"))).collect()
    assert [r["s"] for r in got] == [1_000_000 * a * a // (x * y) for a, x, y in rows]


def test_workers_give_memory_back(spark):
    import numpy as np

    from marketloom.llm.common import lean

    def resident():
        return int(open("/proc/self/statm").read().split()[1]) * 4096

    def run(batches):
        for _ in batches:
            small = [bytes(1000) for _ in range(300_000)]  # too small to be given back one by one
            yield np.array([len(small)])

    for _ in range(2):
        before = resident()
        assert [int(x[0]) for x in lean(run)([1])] == [300_000]
        assert resident() - before < 100e6
