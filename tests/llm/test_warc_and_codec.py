import hashlib
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest

from marketloom.llm import sentencepiece_codec as S
from marketloom.llm import warc as W
from marketloom.llm.common import scratch_path

ROWS = [(1, "http://www.Example.com:80/a b#x", "<p>1</p>"), (2, "http://b.example.com/", "<p>1</p>"), (2, "http://b.example.com/", "<p>1</p>"), (3, None, None), (None, "https://x.org:8443/q?a=1", "<p>1</p>"), (None, None, ""), (9, "http://[bad", "é"), (10, "", "x" * 300_000), (11, "http://b.example.com/", "2")]


def test_surt():
    assert W.surt("https://user@WWW2.Blog.example.com/p?q=1#f") == "com,example,blog)/p?q=1"
    assert W.surt(None) == "-" and W.surt("http://x.org:81") == "org,x:81)/"


@pytest.mark.parametrize(("block", "size"), [(1, 1 << 30), (3, 200)])
def test_round_trip(spark, block, size):
    df = spark.createDataFrame([(*r, 1) for r in ROWS], "page_id long, url string, html string, payload int")
    folder = scratch_path(spark, "test-warc")
    index = W.write_index(W.write_archives(df, folder, file_bytes=size), folder, block_entries=block)
    got = W.read_captures(df, index, folder).collect()
    assert len(got) == len(ROWS)
    by_id = {r["page_id"]: r for r in got if r["page_id"] is not None}
    for i, url, html in ROWS:
        if i is None:
            continue
        body = (html or "").encode()
        r = by_id[i]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(body), W.digest32(body))
        if r["record_type"] == "response":
            assert bytes(r["payload"]) == body and r["refers_to"] is None
    assert by_id[2]["record_type"] == "revisit" and by_id[2]["refers_to"] == 1
    assert sorted((r["record_type"], r["refers_to"]) for r in got if r["page_id"] is None) == [("revisit", 1), ("revisit", 3)]
    one = spark.createDataFrame([(11, "http://b.example.com/"), (11, "http://b.example.com/"), (77, "http://no.org/")], "page_id long, url string")
    assert [r["page_id"] for r in W.read_captures(one, index, folder).collect()] == [11]


def test_least_bytes_and_nothing(spark):
    df = spark.createDataFrame([(1, "http://a.org", "xy"), (2, "http://b.org", "xy")], "page_id long, url string, html string")
    folder = scratch_path(spark, "test-warc")
    got = W.read_captures(df, W.write_index(W.write_archives(df, folder, least_bytes=3), folder), folder).collect()
    assert {r["record_type"] for r in got} == {"response"}
    none = df.limit(0)
    assert W.read_captures(none, W.write_index(W.write_archives(none, folder), folder), folder).collect() == []


# ---- SentencePiece


def varint(n):
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def message(*fields):
    out = b""
    for number, value in fields:
        if isinstance(value, float):
            out += varint(number << 3 | 5) + struct.pack("<f", value)
        elif isinstance(value, int):
            out += varint(number << 3) + varint(value)
        else:
            out += varint(number << 3 | 2) + varint(len(value)) + value
    return out


def unigram_model(fallback=True, extra=False):
    """A small hand-made unigram model."""
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)]
    pieces += [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)] if fallback else []
    words = ["▁the", "▁cat", "▁c", "at", "▁", "he", "th", "s", "▁on", "n", "o", "t", "a", "c", "h", "e", "▁▁"]
    pieces += [(w, -1.0 - 0.37 * k, 1) for k, w in enumerate(words)]
    body = b"".join(message((1, message((1, p.encode()), (2, s), (3, k)))) for p, s, k in pieces)
    return body + message((2, message((3, 1), (35, int(fallback)))), (3, message((1, b"identity"), (3, 1), (4, int(extra)), (5, 1))))


TEXTS = ["", " ", "the cat", " the  cats on", "on the\ncat", "日本 the", "tttthhhh", "x" * 50, "cat▁the", "the cat " * 500]


@pytest.mark.parametrize(("fallback", "extra"), [(True, False), (True, True), (False, False)])
def test_unigram_parity(fallback, extra):
    import sentencepiece

    data = unigram_model(fallback, extra)
    original = sentencepiece.SentencePieceProcessor(model_proto=data)
    c = S.Codec(data)
    assert c.model.kind == S.UNIGRAM and c.model.byte_fallback == fallback and c.model.remove_extra_whitespaces == extra
    for t in TEXTS:
        want = original.encode(t)
        packed = c.encode([t])[0]
        assert np.frombuffer(packed, "<u4").tolist() == want, t
        assert c.decode([packed])[0] == original.decode(want)


def test_bpe_parity(spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    original, c = sentencepiece.SentencePieceProcessor(model_file=path), S.codec(path)
    texts = TEXTS + ["<s> <unk> <0x0A>", "\t\tx", "==== ----", "á", "\U0001f600 é", " a ", "a   b"] + [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    packed = c.encode(texts)
    assert [np.frombuffer(p, "<u4").tolist() for p in packed] == original.encode(texts)
    assert c.decode(packed) == [original.decode(x) for x in original.encode(texts)]
    assert [c.tokenizer.encode(t, add_special_tokens=False).ids for t in texts] == original.encode(texts)


def test_jobs(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    df = spark.createDataFrame([(1, "the cat", 5), (1, "the cat", 5), (2, None, 5), (None, "", 5), (3, "é " * 100_000, 5)], "doc_id long, text string, n_tokens int")
    out = S.encoded(df, path)
    rows = out.collect()
    assert len(rows) == 5 and all(r["parity"] and r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in rows)
    assert all(r["ids_crc32"] == zlib.crc32(np.asarray(r["ids"], "<u4").tobytes()) for r in rows)
    back = {r["doc_id"]: r["text"] for r in S.decoded(out, path).collect()}
    assert back[1] == "the cat" and back[2] == "" and hashlib.md5(back[3].encode()).digest() == hashlib.md5(("é " * 100_000).encode()).digest()
    assert S.encoded(df.limit(0), path).collect() == []
