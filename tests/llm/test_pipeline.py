"""The pipeline's stages against plain versions of them, on a small fixture."""

import random
import re

import public_tokenizers
import pyarrow.parquet as pq
from test_ngram_join import brute

import corpus_pipeline as C
from marketloom.llm import pii
from marketloom.llm.bpe_ids import tokenizer
from marketloom.sources import scratch

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def fixture():
    rng = random.Random(4)
    en, de = "the and of with from this that was her their".split(), "der die und nicht mit ein ist auf für zu".split()
    rows = []
    for k in range(60):
        words = en if k % 3 else de
        rows.append((k, " ".join(rng.choice(words) + rng.choice(["", "n", "er", "ly"]) for _ in range(rng.choice([6, 60, 200]))), "en" if k % 3 else "de"))
    rows += [(100 + k, rows[k][1], rows[k][2]) for k in range(0, 60, 5)]
    rows += [(200 + k, rows[k][1] + " extra", rows[k][2]) for k in range(0, 60, 7)]
    rows += [(300, "1234 !!", "en"), (301, None, "en"), (302, rows[1][1] + " mail me at ab@cd.com or +1 (644) 555-7859", "en"), (5, rows[5][1], "en")]
    return [(i, t, lang, "s", None if t is None else len(t)) for i, t, lang in rows]


def test_stages(spark):
    rows = fixture()
    docs = spark.createDataFrame(rows, SCHEMA)
    key = lambda r: (r[0], r[1] or "")

    kept = [r for r in rows if re.search(r"[^\W\d_]", r[1] or "")]
    out = C.language_stage(spark, docs, "")
    assert out.columns == docs.columns
    assert sorted(map(tuple, out.collect()), key=key) == sorted(kept, key=key)

    last = {}
    for r in kept:
        if r[1] not in last or last[r[1]][0] <= r[0]:
            last[r[1]] = r
    exact = list(last.values())
    out = C.exact_stage(spark, spark.createDataFrame(kept, SCHEMA), "")
    assert sorted(map(tuple, out.collect()), key=key) == sorted(exact, key=key)

    groups = {i: c for i, _, c in brute([r[:2] for r in exact])}
    near = [r for r in exact if groups[r[0]] == r[0]]
    assert len(near) < len(exact)
    out = C.near_stage(spark, spark.createDataFrame(exact, SCHEMA), "")
    assert sorted(map(tuple, out.collect()), key=key) == sorted(near, key=key)

    private = [(i, pii.replace(t, pii.DEMO_KEY, {})[0], *rest) for i, t, *rest in near]
    private = [(i, t, lang, s, len(t)) for i, t, lang, s, _ in private]
    out = C.private_stage(spark, spark.createDataFrame(near, SCHEMA), "")
    assert sorted(map(tuple, out.collect()), key=key) == sorted(private, key=key)
    assert not any("ab@cd.com" in r[1] for r in private)

    pieces = C.packing_stage(spark, spark.createDataFrame(private, SCHEMA), "").collect()
    t = tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    want = {r[0]: len(t.encode(r[1], add_special_tokens=False).ids) + 1 for r in private}
    got = {}
    for p in pieces:
        got[p["doc_id"]] = got.get(p["doc_id"], 0) + p["length"]
    assert got == want


def test_run_leaves_only_its_result(spark, tmp_path, monkeypatch):
    """Extra columns with clashing names and a long text go through, and nothing in clear stays in the shared folder."""
    rows = [(i, t, lang, s, n, "kept?", 1) for i, t, lang, s, n in fixture()]
    rows.append((400, "and the others " * 60_000 + "Mr. Adam Quux", "en", "s", None, "x", 2))
    spark.createDataFrame(rows, SCHEMA + ", kept string, component_id int").write.parquet(f"{tmp_path}/in/documents.parquet")
    (tmp_path / "shared").mkdir()
    monkeypatch.setattr(scratch, "shared_dir", lambda _: f"{tmp_path}/shared")
    out = C.run(spark, f"{tmp_path}/in")
    assert 400 in {r["doc_id"] for r in out.collect()}
    left = [f for f in (tmp_path / "shared").rglob("*.parquet") if f.is_file()]
    assert left and all("best-fit-packing" in str(f) for f in left)
    assert all("text" not in pq.read_schema(f).names for f in left)

    monkeypatch.setattr(C, "STAGES", [*C.STAGES[:3], ("fails", lambda *_: 1 / 0)])
    try:
        C.run(spark, f"{tmp_path}/in")
    except ZeroDivisionError:
        pass
    assert [f for f in (tmp_path / "shared").rglob("*.parquet") if f.is_file() and "best-fit" not in str(f)] == []


def test_stages_of_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    for _, stage in C.STAGES:
        assert stage(spark, empty, "").collect() == []


def test_odd_rows(spark):
    docs = spark.createDataFrame([(None, "the cat sat on the mat", "en", None, None), (None, "the cat sat on the mat", "en", None, None), (1, "the dog", None, "x", 7), (1, "the dog", None, "x", 7), (1, "the dogs", None, "x", 8)], SCHEMA)
    for _, stage in C.STAGES[:-1]:
        docs = stage(spark, docs, "")
    assert sorted((r["doc_id"] or 0, r["text"]) for r in docs.collect()) == [(0, "the cat sat on the mat"), (1, "the dog"), (1, "the dogs")]


def test_oracles(spark):
    from compare import same_rows

    from marketloom import llm

    for name, sql in llm.oracle_sql().items():
        assert same_rows(llm.queries()[name](spark, "/root/testdata/sf0.001"), "/root/testdata/sf0.001", sql) is None, name
