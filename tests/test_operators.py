"""Worked cases of single operators, and greedy ones against plain loops."""

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketloom.functions import names, parsing, scoring
from marketloom.operators import browse, evidence, graph, merge, pages, prices, ranking, resolve, vectors
from marketloom.plans import resolve as resolve_plans
from marketloom.sources import catalogs


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(columns)]).first()


@pytest.mark.parametrize(
    ("old", "new", "was", "now", "kind", "delta"),
    [(50000, 45000, True, True, "PRICE_DROP", -5000), (50000, 50000.5, True, True, "UNCHANGED", 0), (50000, 50000, True, False, "OUT_OF_STOCK", 0), (50000, 52000, False, True, "RESTOCKED", 2000), (50000, None, True, False, "OUT_OF_STOCK", 0), (50000, None, True, True, "UNCHANGED", 0)],
)
def test_transitions(spark, old, new, was, now, kind, delta):
    t = prices.transition(F.lit(float(old)), F.lit(new).cast("double"), F.lit(was), F.lit(now))
    r = one(spark, t["change_type"], t["price_delta"])
    assert (r[0], r[1]) == (kind, delta)


def heads(spark, rows):
    return spark.createDataFrame([(1, s, float(p), i, p >= 5000) for s, p, i in rows], "item_id long, store string, price double, in_stock boolean, is_valid boolean")


def test_rollups(spark):
    r = prices.item_rollup(heads(spark, [("a", 55000, True), ("b", 52000, True), ("c", 49000, False)])).first()
    assert (r["min_price"], r["max_price"], r["price_spread"], r["cheapest_store"], r["in_stock"], r["stores"]) == (52000, 55000, 3000, "b", True, ["a", "b"])
    r = prices.item_rollup(heads(spark, [("a", 55000, False), ("b", 52000, False)])).first()
    assert (r["min_price"], r["in_stock"], r["stores"]) == (52000, False, [])
    r = prices.item_rollup(heads(spark, [("a", 10, True), ("b", 9, False)])).first()
    assert (r["min_price"], r["cheapest_store"], r["in_stock"]) == (10, "a", True)


def series(spark, rows):
    day = lambda k: dt.datetime(2024, 1, 1) + dt.timedelta(days=k)
    return spark.createDataFrame([(1, "a", day(d), float(p), True, k, 0, 0.0, 0.0) for k, (d, p) in enumerate(rows)], "item_id long, store string, recorded_at timestamp_ntz, price double, in_stock boolean, order_key long, line_no int, qty double, disc double")


def test_history(spark):
    s = series(spark, [(0, 45000), (1, 45000), (2, 45000), (3, 44000), (4, 44000), (5, 45000)])
    assert [r["price"] for r in prices.collapsed(s).orderBy("recorded_at").collect()] == [45000, 44000, 45000]
    c = prices.clipped(series(spark, [(0, 50000), (20, 47000), (60, 45000), (110, 43000)]), F.lit("2024-02-15 00:00:00").cast("timestamp_ntz")).orderBy("recorded_at").collect()
    assert [(r["price"], r["is_anchor"]) for r in c] == [(47000, True), (45000, False), (43000, False)]
    r = prices.series_stats(series(spark, [(0, 50000), (9, 42000)])).first()
    assert (r["price_change"], r["price_change_pct"]) == (-8000, -16.0)
    assert prices.trusted(series(spark, [(0, 1.0)])).count() == 0


def test_scores(spark):
    h = scoring.composite(F.lit(85.0), F.lit(85.0), F.lit(80.0), F.lit(80.0), F.lit(32.0))
    r = one(spark, h, scoring.value_ratio(F.lit(85.0), F.lit(50000.0)), scoring.value_power(F.lit(85.0), F.lit(50000.0)))
    assert (round(r[0], 2), r[1], r[2]) == (85.0, 80.49, 100.0)
    r = one(spark, scoring.power_tier(F.lit(75.0), F.lit(100.0), F.lit(False)), scoring.power_utilisation(F.lit(75.0), F.lit(115.0)), scoring.power_tier(F.lit(45.0), F.lit(115.0), F.lit(False)), scoring.power_utilisation(F.lit(45.0), F.lit(140.0)))
    assert tuple(r) == ("MODERATELY_CAPPED_GPU", 65, "HEAVILY_CAPPED_GPU", 32)
    r = one(spark, scoring.with_warning(F.array(F.lit("w")), F.lit("w")), scoring.with_warning(F.array(F.lit("v")), F.lit("w")), scoring.port_count(F.array(F.lit("2 x USB"), F.lit("HDMI"))))
    assert (r[0], r[1], r[2]) == (["w"], ["w", "v"], 3)


def test_ranking(spark):
    df = spark.createDataFrame([("a", 90, 90, 50000), ("b", 50, 50, 20000), ("c", 85, 85, 25000)], "id string, x int, y int, p int")
    crit = [ranking.Criterion("x", 0.4), ranking.Criterion("y", 0.4), ranking.Criterion("p", 0.2, False)]
    got = {r["id"]: r["score"] for r in ranking.topsis(df, crit).collect()}
    assert got == {"a": 62.65, "b": 37.35, "c": 86.3}
    assert ranking.topsis(df.limit(1), crit).first()["score"] == 100 and ranking.topsis(df.limit(0), crit).count() == 0
    assert all(abs(sum(w) - 1) < 1e-9 and len(w) == len(ranking.CRITERIA) for w in ranking.PERSONAS.values())
    g = ranking.PERSONA_GATES["gaming"]
    assert not g.relaxed_for(29_000).discrete_gpu and g.relaxed_for(34_000).discrete_gpu


def test_cursor(spark):
    assert browse.Cursor(45000.0, "abc").encode() == "NDUwMDAuMDphYmM"
    assert browse.Cursor.decode("NDUwMDAuMDphYmM") == browse.Cursor(45000.0, "abc")
    assert one(spark, browse.cursor_token(F.lit(45000.0), F.lit("abc")))[0] == "NDUwMDAuMDphYmM"
    for bad in ("", "!!", "bmFuOmE", "MTIz"):
        with pytest.raises(ValueError):
            browse.Cursor.decode(bad)


def test_part_numbers(spark):
    got = one(spark, *[names.part_number(F.lit(x)) for x in ("83DV01HSED#ABV", "90NR0MC1-M008A0", "LAPTOP-1234", "123")])
    assert list(got) == ["83DV01HSED", "90NR0MC1M008A0", None, None]


def test_names(spark):
    got = one(spark, names.slug(F.lit(" Lenovo® Legion-5 ")), names.chassis_key(F.lit("HP"), F.lit("Omen"), F.lit("16-XF0")), names.clonable(F.lit("hp:omen:16")), names.clonable(F.lit("hp:generic:16")), names.key_values(F.lit("• RAM: 16 GB\nnoise\nRAM: 8\nCPU： i7")))
    assert tuple(got) == ("lenovo_legion_5", "hp:omen:16", True, False, {"RAM": "16 GB", "CPU": "i7"})


def test_parsing(spark):
    texts = ["EGP 45,999.50", "81.500,00 ج.م", "45.999,50 EGP", "1,234,567", "no price", "0", "12,5", "45 999", "45.999", "1.2.3", "٦١,٩٩٩", "", None, "81,500.00 L.E"]
    got = list(one(spark, *[parsing.money(F.lit(t)) for t in texts]))
    assert got == [45999.5, 81500.0, 45999.5, 1234567.0, None, None, 125.0, 45999.0, 45.999, None, 61999.0, None, None, 81500.0]
    got = one(spark, *[parsing.shown_money(F.lit(t)) for t in ("54,999.00 EGP", "EGP 54,999", "54.999 ج.م", "جنيه ٦١,٩٩٩", " call ", "", None, ",,")])
    assert [tuple(g) for g in got] == [(54999.0, "54,999.00 EGP"), (54999.0, "54,999.00 EGP"), (54.99, "54.99 EGP"), (61999.0, "61,999.00 EGP"), (None, "call"), (None, None), (None, None), (None, ",,")]
    r = one(spark, parsing.validated("ram_gb", F.lit("16")), parsing.validated("weight_kg", F.lit(9)), parsing.hdr_flag(F.lit("No HDR")), parsing.dimensions(F.array(F.lit(35.9), F.lit(2.1), F.lit(25.4))), parsing.dimensions(F.array(F.lit(350.0), F.lit(2.1), F.lit(250.0))))
    assert r[0]["ok"] and not r[1]["ok"] and r[2] is False and r[3] == pytest.approx([359, 254, 21]) and r[4] is None


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(k, k + 1) for k in range(1000, 1060)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    got = {r["node"]: r["component"] for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for n in parent if any(n in e for e in edges if e[0] != e[1])}


def test_guarded_clusters(spark):
    x = resolve_plans.clusters_guarded(spark, "/root/testdata/sf0.001").collect()
    part = {r["p_partkey"]: r for r in spark.read.parquet("/root/testdata/sf0.001/part.parquet").collect()}
    blocks, want = {}, {}
    for k in sorted(part):
        clusters = blocks.setdefault((part[k]["p_brand"], part[k]["p_size"]), [])
        me = {"p_type": part[k]["p_type"], "hz": k % 7 * 6}
        home = next((c for c in clusters if all(resolve_plans.accepts(me, {"p_type": part[m]["p_type"], "hz": m % 7 * 6}) for m in c)), None)
        if home is None:
            clusters.append(home := [])
        home.append(k)
        want[k] = home[0]
    assert {r["node"]: r["cluster"] for r in x} == want


def test_refresh_rates_split_clusters(spark):
    rows = [(1, "a", 144), (2, "a", 0), (3, "a", 240)]
    df = spark.createDataFrame([(i, t, h, "k") for i, t, h in rows], "id long, p_type string, hz int, block string")
    got = {r["node"]: r["cluster"] for r in resolve.guarded_clusters(df, "id", "block", ["id"], resolve_plans.accepts).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_near_duplicates(spark):
    a = "The screen of this machine is bright and very sharp in every kind of room"
    rows = [(0, a), (1, a.replace(" is ", "  is ") + " "), (2, a.replace("room", "rooms")), (3, "Its fans are loud under load and the palm rest becomes warm after a while"), (4, "short"), (5, None)]
    df = spark.createDataFrame([(1, k, t) for k, t in rows], "g long, k long, t string")
    got = {r["k"]: r["fate"] for r in evidence.near_duplicates(df, ["g"], ["k"], "t", ["k"]).collect()}
    assert got == {0: "kept", 1: "exact", 2: "near", 3: "kept", 4: "short", 5: "short"}


def test_bullets_and_chunks(spark):
    b = F.array(*map(F.lit, ["battery lasts very long", "the battery lasts very long", "too short", "display is bright and sharp"]))
    assert one(spark, evidence.merged_bullets(b))[0] == ["battery lasts very long", "display is bright and sharp"]
    text = " ".join(f"word{k}" for k in range(80)) + ". tiny. " + "A sentence that is long enough."
    got = one(spark, evidence.sentence_chunks(F.lit(text)))[0]
    assert [len(c.split()) for c in got] == [35, 35, 10, 6]


def test_rollups_gather_distinct_values_only(spark):
    from marketloom.operators import reviews

    df = spark.createDataFrame([("a", k, None if k == 0 else f"t{9 - k % 3}", float(k), k % 2) for k in range(3000)] + [("b", 5000, None, None, 1)], "g string, k long, t string, s double, m int")
    longest = {}
    for name, out in (("record", reviews.record(df, "g", "s", "t", ["k"])), ("rollup", resolve.target_rollup(df, "g", ["k"], ["t"], "m"))):
        longest[name] = {r["g"]: r for r in out.collect()}
        # Rows are combined by (key, value) before any list is collected.
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        gathered = [x for x in plan.splitlines() if "collect_list" in x]
        assert gathered and all("k#" not in x.split("collect_list", 1)[1] for x in gathered), plan
    assert (longest["record"]["a"]["document"], longest["record"]["a"]["score"]) == ("t8 | t7 | t9", 1499.5)
    assert (longest["record"]["b"]["document"], longest["record"]["b"]["score"]) == ("", None)
    r = longest["rollup"]["a"]
    assert (r["t_list"], r["variant_count"], r["modal_m"], longest["rollup"]["b"]["t_list"]) == ("t8,t7,t9", 3000, 0, "")


def test_candidate_dedupe_against_loop(spark):
    def loop(rows):  # (block, position, keys)
        seen, out = set(), set()
        for b, p, keys in sorted(rows, key=lambda r: r[1]):
            mine = {(b, k, v) for k, v in enumerate(keys) if v is not None}
            if not mine & seen:
                seen |= mine
                out.add(p)
        return out

    rng = np.random.default_rng(3)
    rows = [(None if k % 3 == 0 else int(k % 3), k, None if rng.random() < 0.1 else f"s{rng.integers(30)}", None if rng.random() < 0.1 else int(rng.integers(40))) for k in range(400)]
    df = spark.createDataFrame(rows, "b int, id long, x string, y int")
    got = [r["id"] for r in resolve.first_of_any_key(df, "b", ["id"], ["x", "y"]).collect()]
    assert sorted(got) == sorted(loop([(b, i, (x, y)) for b, i, x, y in rows]))
    c = spark.read.parquet("/root/testdata/sf0.01/customer.parquet").select("c_nationkey", "c_custkey", "c_mktsegment", F.floor(F.col("c_acctbal") / 100).alias("bal")).collect()
    got = [r["c_custkey"] for r in resolve_plans.candidate_dedupe(spark, "/root/testdata/sf0.01").collect()]
    assert sorted(got) == sorted(loop([(r[0], r[1], (r[2], r[3])) for r in c]))


def test_dense_dedupe_compares_whole_labels(spark):
    from marketloom.plans import vectors as vector_plans

    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "label", "embedding")
    # A copy of each vector far behind it: all copies must go.
    far = e.unionByName(e.withColumn("vec_id", F.col("vec_id") + 1_000_000))
    wanted = set()
    for label in {r["label"] for r in e.select("label").distinct().collect()}:
        kept = []
        for r in sorted((r for r in far.where(F.col("label") == label).collect()), key=lambda r: r["vec_id"]):
            v = np.array(r["embedding"], dtype=float)
            v /= max(np.linalg.norm(v), 1e-12)
            if not any(v @ k >= 0.88 for k in kept):
                kept.append(v)
                wanted.add((label, r["vec_id"]))
    for block_rows in (16, 1024):
        got = [tuple(r) for r in vectors.dense_dedup(far, "label", "vec_id", "embedding", block_rows=block_rows).collect()]
        assert len(got) == len(wanted) and set(got) == wanted
    plan = [tuple(r) for r in vector_plans.dense_dedupe(spark, "/root/testdata/sf0.001").collect()]
    assert set(plan) == wanted


def test_dense_dedup(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(30, 6))
    v[10] = v[3] + 0.01
    df = spark.createDataFrame([(k % 2, k, x.tolist()) for k, x in enumerate(v)], "g int, k long, v array<double>")
    kept = {0: [], 1: []}
    for k, x in enumerate(v):
        u = x / np.linalg.norm(x)
        if all(u @ w < 0.88 for _, w in kept[k % 2]):
            kept[k % 2].append((k, u))
    got = sorted(r["k"] for r in vectors.dense_dedup(df, "g", "k", "v").collect())
    assert got == sorted(k for g in kept.values() for k, _ in g)


def test_merge(spark):
    old = spark.createDataFrame([(1, 5.0), (2, 6.0), (3, 7.0)], "k long, v double")
    new = spark.createDataFrame([(2, 6.0), (3, 8.0), (4, None)], "k long, v double")
    got = {r["k"]: (r["v"], r["action"]) for r in merge.snapshot(old, new, ["k"], ["v"]).collect()}
    assert got == {1: (5.0, "kept"), 2: (6.0, "touched"), 3: (8.0, "updated"), 4: (None, "inserted")}


def test_pages(spark):
    html = '<title> A b </title><a class="x" href="/p">p</a><script type="application/ld+json">{"offers": {"price": "12.5", "availability": "OutOfStock"}}</script><table><tr><td>RAM</td><td>16 GB</td></tr></table>'
    r = one(spark, pages.title(F.lit(html)), pages.links(F.lit(html)), pages.offer(F.lit(html)), pages.table_rows(F.lit(html)))
    assert r[0] == "A b" and r[1] == ["/p"] and (r[2]["price"], r[2]["in_stock"]) == (12.5, False) and [tuple(x) for x in r[3]] == [("RAM", "16 GB")]


def test_catalog_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"store_key": "a", "structured_products": [{"title": "t1", "price": 5.0}], "products": [{"title": "t2"}], "latest_pointers": []}))
    (tmp_path / "b.json").write_text(json.dumps({"store_key": "b", "products": [{"title": f"p{k}"} for k in range(5)], "latest_pointers": ["x"]}))
    (tmp_path / "c.json").write_text("{broken")
    c = catalogs.read_catalogs(spark, [str(tmp_path)])
    assert sorted((r["store_key"], r["title"]) for r in catalogs.catalog_products(c).collect()) == [("a", "t1")] + [("b", f"p{k}") for k in range(5)]
    assert {r["store_key"]: r["pointers"] for r in catalogs.catalog_pointers(c).collect()} == {"a": ["t1"], "b": ["x"]}


def test_breaker(spark):
    rows = [(1, k, k in (3, 4)) for k in range(1, 9)] + [(2, k, False) for k in range(1, 9)]
    got = prices.tripped(spark.createDataFrame(rows, "s int, k int, bad boolean"), ["k"], "bad", by=["s"]).collect()
    assert [(r["s"], r["k"], r["failures"]) for r in got] == [(1, 5, 2)]


def test_metrics_of_two_machines(spark):
    """A gaming and an office machine, scored by hand from the rules."""
    from marketloom.operators import metrics as M

    gaming = {"integrated": False, "cpu_benchmark": 84.0, "memory_type": "DDR5", "memory_layout": "2 x 8 GB", "memory_mhz": 5600, "gpu_benchmark": 57.0, "gpu_full_w": 115.0, "gpu_w": 140.0, "adapter_w": 240.0, "cpu_w": 55.0, "hz": 165, "adaptive_sync": True, "slots": 2, "ram_gb": 16, "m2_slots": 2, "ssds": 1}
    office = {"integrated": True, "npu_tops": 47.0, "panel": "OLED", "inches": 14.0, "width": 2880, "height": 1800, "hz": 120, "battery_wh": 75.0, "weight_kg": 1.2, "cpu_w": 17.0, "soldered": True, "memory_type": "LPDDR5X", "ir_camera": True, "shutter": True, "speakers": 4, "thunderbolt": "4", "ports": ["2 x Thunderbolt 4", "HDMI"]}
    names = sorted({*gaming, *office})
    kinds = {c: k for k, cs in M.SHEET.items() for c in cs}
    df = spark.createDataFrame([[r.get(c) for c in names] for r in (gaming, office)], ", ".join(f"{c} {kinds[c]}" for c in names))
    g, o = M.item_metrics(df.withColumn("any_price", F.lit(40000.0))).orderBy("integrated").collect()
    assert g["cpu_score"] == 88.2 and g["gpu_score"] == pytest.approx(57 * round(1.2174 ** 0.32, 3), abs=0.2) and g["dual_channel"]
    assert g["spare_w"] == 240 - (55 + 140 + 25 - 20) and g["power_score"] == 88 + 25 * 0.2 and g["power_status"] == "UNCONSTRAINED_HEADROOM"
    assert g["longevity_tier"] == "MAXIMUM_UPGRADEABLE" and g["price_status"] == "OUT_OF_STOCK_RECENT" and not g["copilot_pc"]
    assert o["mobility_tier"] == "ULTRAPORTABLE" and o["battery_hours"] == 10.0 and o["mobility_score"] >= 80
    assert o["gamut_tier"].startswith("100% DCI-P3") and o["display_score"] == pytest.approx(87.25, abs=0.02) and o["copilot_pc"] and o["ai_tops"] == 47
    assert o["longevity_tier"] == "LOCKED_APPLIANCE" and 0 <= o["value_score"] <= 100
    blank = M.item_metrics(spark.createDataFrame([(1,)], "id int")).collect()[0]
    assert blank["price_status"] == "COMING_SOON_UNPRICED" and blank["value_score"] == 50 and blank["cpu_score"] == 47.2


def test_routed_batches_replace_themselves(spark, tmp_path):
    from marketloom.streaming import jobs

    sink = jobs.batch_sink(str(tmp_path / "t"))
    rows = spark.range(5)
    for number in (0, 1, 1):
        sink(rows, number)
    assert spark.read.parquet(str(tmp_path / "t")).count() == 10


def test_fallback_wishes(spark):
    """Each wish holds as long as some row is left."""
    rows = [(1, 100.0, "a", True), (2, 50.0, "b", False), (3, 70.0, "a", False), (4, 60.0, "c", True)]
    df = spark.createDataFrame(rows, "id int, price double, brand string, discrete boolean")
    of = lambda *wishes: [r["id"] for r in ranking.scoped(df, ranking.Scope(F.lit(False), F.lit(True), 10.0, fallback=F.lit(True), preferences=wishes), "price", ["id"]).orderBy("price").collect()]
    assert of() == [2, 4, 3]
    assert of(F.col("brand") == "a") == [3, 1]
    assert of(F.col("brand") == "a", F.col("discrete")) == [1]
    assert of(F.col("brand") == "z", F.col("discrete")) == [4, 1]


def test_picks_pass_over_what_is_alike(spark):
    from marketloom.operators import vectors

    rows = [("x", "con", 0.9, 1, [1.0, 0.0]), ("x", "con", 0.8, 2, [1.0, 0.01]), ("x", "con", 0.7, 3, [0.0, 1.0]), ("x", "pro", 0.6, 4, [0.7, 0.7]), ("x", "pro", 0.5, 5, [-1.0, 0.0]), ("y", "pro", 0.1, 6, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "g string, aspect string, score double, id int, v array<double>")
    got = vectors.per_aspect(df, "g", "aspect", "score", "id", "v", 1, 3, 0.95)
    assert sorted(r["id"] for r in got.collect()) == [1, 3, 4, 6]


def test_longest_match_looks_equal_texts_up_once(spark):
    """Stretches are made of different texts only; rows of one key keep their own texts, null ones match nothing."""
    from marketloom.operators import resolve

    rows = spark.createDataFrame([(k, ("Big Ring", "big ring x", "none")[k % 3]) for k in range(30)] + [(99, None), (100, ""), (None, "ring")], "k int, t string")
    names = spark.createDataFrame([("ring", 1), ("Big Ring", 2), ("ring x", 3)], "p string, v int")
    found = resolve.longest_match(rows, "t", ["k"], names, "p", "v")
    got = {r["k"]: (r["matched"], r["v"]) for r in found.collect()}
    assert got == {k: (("Big Ring", 2), ("Big Ring", 2), (None, None))[k % 3] for k in range(30)} | {99: (None, None), 100: (None, None), None: ("ring", 1)}
