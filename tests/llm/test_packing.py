import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from marketloom.llm import packing as P
from marketloom.llm.bpe_ids import PackedEncoder, tokenizer
from marketloom.llm.stretches import StretchCache

PATH = public_tokenizers.path("byte_bpe_50k.json")


def bins_of(plan):
    bins = defaultdict(dict)
    seen = Counter()
    for length, a, b, sequence, each, at in plan:
        for r in range(a, b):
            s, o = sequence + (r - a) // each, at + (r - a) % each * length
            assert o not in bins[s]
            bins[s][o] = length
            seen[length] += 1
    return bins, seen


def best(lengths, capacity):
    """The least number of bins, by trying everything."""
    lengths = sorted(lengths, reverse=True)
    for n in range(1, len(lengths) + 1):
        def fits(k, rooms):
            if k == len(lengths):
                return True
            return any(fits(k + 1, rooms[:j] + [r - lengths[k]] + rooms[j + 1 :]) for j, r in enumerate(rooms) if r >= lengths[k] and r not in rooms[:j])

        if fits(0, [capacity] * n):
            return n
    return 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 11), max_size=8))
def test_plan_is_whole_and_near_the_least(lengths):
    bins, seen = bins_of(P.plan(dict(Counter(lengths)), 12))
    assert seen == Counter(lengths)
    for b in bins.values():
        at = 0
        for o in sorted(b):
            assert o == at
            at += b[o]
        assert at <= 12
    assert len(bins) <= best(lengths, 12) * 11 / 9 + 1


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 11), max_size=7))
def test_reduction_costs_nothing(lengths):
    rest = dict(Counter(lengths))
    fixed = P.dominance_reduction(rest, 12)
    left = [x for x, c in rest.items() for _ in range(c)]
    assert sum(t for _, t in fixed) + best(left, 12) == best(lengths, 12)


def test_large_counts():
    bins, seen = bins_of(P.plan({100: 3000, 924: 2999, 700: 10, 324: 7, 5: 4000}, 1024))
    total = sum(k * v for k, v in seen.items())
    assert len(bins) <= -(-total // 1024) + 30


TRICKY = ["  a", "a  ", "a   b", "a \n b", " ", "", "a\n\nb", "don't  stop", "<|endoftext|> a", "é  ü ", "a \n\n b", "a b", "x \t y", "a\x1c b", "日本 語"]


SPECIAL = ["hello <|endoftext|> world", "end<|endoftext|>next", "<|endoftext|>", "a <|endoftext|>  <|endoftext|> b", "<|endoftext|", "x<|endoftext|>\n\n y"]


def library_ids(texts):
    """The ids of the library itself, with the file as it is."""
    return [np.asarray(e.ids, "<u4").tobytes() for e in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]


def test_ids_are_those_of_the_library(spark):
    texts = TRICKY + SPECIAL + [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    want = library_ids(texts)
    e = PackedEncoder(PATH)
    assert e.encode(texts) == want
    assert e.encode(texts) == want  # from what was kept


def test_ids_of_odd_strings():
    rng = random.Random(8)
    alphabet = ["a", "Bc", " ", " ", "'s", "'", "7", "12", "\n", "\t", "\u00a0", "\u3000", "\x1c", "\x85", "é", "日", "!", "Ġ", "<|endoftext|>", "\u200b", "🙂"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(12))) for _ in range(20_000)]
    assert PackedEncoder(PATH).encode(texts) == library_ids(texts)


def test_what_is_kept_is_bounded():
    c = StretchCache(lambda words: [w.encode() for w in words], keep=3, longest=4)
    assert c.packed(["a bb ccccc", "", "dd a ee ff"]) == [b"abbccccc", b"", b"ddaeeff"]
    assert len(c.known) == 3 and all(len(k) <= 4 for k in c.known)


def test_documents(spark):
    rows = [(k, t) for k, t in enumerate(TRICKY + SPECIAL)] + [(50, None), (51, "the cat " * 3000), (51, "the cat " * 3000), (None, "x y")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, length int")
    got = P.pack_documents(df, PATH, capacity=64, buckets=3).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 64
    for i, t in rows:
        ids = tokenizer(PATH).encode(t or "", add_special_tokens=False).ids + [2]
        packed = np.asarray(ids, "<u4").tobytes()
        mine = by_doc[i]
        copies = sum(1 for j, _ in rows if j == i)
        assert sum(r["length"] for r in mine) == len(ids) * copies
        for r in mine:
            assert r["ids_crc32"] == zlib.crc32(packed[4 * r["start"] : 4 * (r["start"] + r["length"])])
            assert r["length"] == 64 or r["piece"] == 0
    assert P.pack_documents(df.limit(0), PATH).collect() == []
