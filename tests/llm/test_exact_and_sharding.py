import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from marketloom.llm.exact_dedup import content_sort_dedup
from marketloom.llm.sharding import MULTIPLIER, shard_rows


def expected_dedup(rows, keep, norm=lambda t: t or ""):
    groups = defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append(i)
    out = []
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        best = (min if keep == "smallest" else max)(known) if known else None
        code = hashlib.sha256(t.encode()).hexdigest()
        kept = False
        for i in ids:
            mine = not kept and i == best
            kept = kept or mine
            out.append((i, best, len(ids), mine, code))
    return out


ROWS = [(1, "a"), (2, "b"), (3, "a"), (3, "a"), (None, "a"), (None, None), (None, ""), (7, None), (8, "é " * 5000), (9, "é " * 5000), (10, " A  b"), (11, "a B")]
key = lambda r: tuple((x is not None, x) for x in r)


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_cases(spark, keep):
    df = spark.createDataFrame([(*r, 0, "x") for r in ROWS], "doc_id long, text string, keep_id int, block string")
    got = content_sort_dedup(df, keep=keep).collect()
    assert sorted(map(tuple, got), key=key) == sorted(expected_dedup(ROWS, keep), key=key)
    assert content_sort_dedup(df.limit(0), keep=keep).collect() == []


def test_normalised(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    got = content_sort_dedup(df, normalise="case_space").collect()
    assert sorted(map(tuple, got), key=key) == sorted(expected_dedup(ROWS, "smallest", lambda t: " ".join((t or "").split()).lower()), key=key)


def test_hot_group(spark):
    rng = random.Random(1)
    rows = [(k, "hot" if k % 3 == 0 else f"text {rng.randrange(1500)}") for k in range(3000)]
    got = content_sort_dedup(spark.createDataFrame(rows, "doc_id long, text string"), keep="largest").collect()
    assert sorted(map(tuple, got)) == sorted(expected_dedup(rows, "largest"))


def jump(k, n):
    b, j, k = -1, 0, k % 2**64
    while j < n:
        b = j
        k = (k * MULTIPLIER + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((k >> 33) + 1)))
    return b


def test_shards(spark):
    rng = random.Random(2)
    rows = [(rng.choice([k, -k, rng.getrandbits(62)]), rng.choice([None, "", "é", "abc" * k])) for k in range(400)] + [(5, "same")] * 40 + [(None, "x")]
    got = shard_rows(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, shard int"), shards=5, buckets=4).collect()
    assert len(got) == len(rows)
    slots = defaultdict(list)
    for r in got:
        assert r["shard"] == jump(r["doc_id"] or 0, 5) and r["grown_shard"] == jump(r["doc_id"] or 0, 6)
        assert r["grown_shard"] in (r["shard"], 5) and r["law"] == "key"
        slots[r["shard"]].append(r["slot"])
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    want = sorted((i is not None, i or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in got) == want


def test_shards_of_nothing(spark):
    assert shard_rows(spark.createDataFrame([], "doc_id long, text string")).collect() == []
