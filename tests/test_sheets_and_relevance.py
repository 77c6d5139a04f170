"""Odd inputs of specification sheets and review relevance; the worked cases are the registered queries'."""

import pytest
from pyspark.sql import functions as F

from marketloom.operators import relevance as R
from marketloom.operators import sheets as S

ROWS = "array<struct<section:string,key:string,value:string>>"


def sheet(spark, title, rows):
    df = spark.createDataFrame([(1, title, rows, "x", 2)], f"id long, title string, rows {ROWS}, bucket string, part int")
    return {r["field"]: (r["value"], r["source"]) for r in S.sheet_values(S.spec_sheets(df, "id"), "id").collect()}


def test_buckets(spark):
    keys = {
        "Package Weight": "package_dimensions", "Cloud Storage": "unrouted", "Weight:": "weight", "Best value you can get!": "unrouted", "Max Storage Capacity": "max_storage", "M.2 Slots": "storage_slots", "Hard  Drive": "storage", "Graphics Memory": "gpu_vram", "GPU Power (TGP)": "gpu_power",
        "Maximum Memory": "max_memory", "RAM Slots": "memory_slots", "Dedicated GPU": "gpu", "System Memory": "memory", "CPU": "cpu", "Battery": "power", "Power Supply": "power", "OS": "os", "Refresh Rate": "display", "Dimensions (W x D x H)": "dimensions", "USB Ports": "ports", "Webcam": "camera", "Built-in speakers": "audio",
        "TPM Chip": "security", "WiFi": "connectivity", "SD Card": "card_reader", "Colour of the box": "unrouted",
    }
    got = spark.createDataFrame([(k,) for k in keys], "k string").select("k", S.bucket(F.col("k")).alias("b")).collect()
    assert {r["k"]: r["b"] for r in got} == keys


def test_sheets_of_odd_tables(spark):
    got = sheet(spark, "Dell", [(None, None, "loose"), ("S", "RAM", "8 GB DDR4"), ("S", "ram", "8 gb ddr4"), ("S", "Battery", ""), ("S", "GPU", None), ("S", "Screen|size", "14 inch | IPS 60 Hz")])
    assert got["memory.capacity_gb"] == ("8", "table")
    assert got["memory.raw_spec"][0] == "RAM: 8 GB DDR4"
    assert got["display.raw_spec"][0] == "Screen/size: 14 inch/IPS 60 Hz"
    assert got["power_battery.battery_wh"] == ("envelope", "missing_key")
    assert got["identity.brand"] == ("Dell", "title")
    assert all(v[0] in ("envelope", "false") for v in sheet(spark, None, None).values())
    assert all(v[0] in ("envelope", "false") for v in sheet(spark, "", []).values())


@pytest.fixture(scope="module")
def targets(spark):
    rows = [(1, "ASUS", "TUF", "TUF A16 FA608PM", 16.0), (2, "Lenovo", "LOQ", "LOQ 15", 15.6), (3, None, None, None, None), (4, "HP", "Victus", "Victus 15-fa2082wm", None)]
    return spark.createDataFrame(rows, "target_id long, brand string, family string, model string, screen double")


def reasons(spark, targets, rows):
    schema = "source_id long, target_id long, kind string, platform string, title string, url string, body string, post_number int"
    df = spark.createDataFrame(rows, schema).withColumn("brand", F.lit("clash")).withColumn("reason", F.lit(1))
    return {r["source_id"]: r["reason"] for r in R.source_verdicts(df, targets).collect()}


def test_sources_of_odd_rows(spark, targets):
    rows = [
        (1, 1, "community", None, None, None, None, None), (2, None, "community", "reddit", "anything", None, None, None), (3, 99, "video", "youtube", "anything", None, None, None), (4, 3, "entry", None, "anything", None, None, None), (5, 2, "editorial", "blog", "Lenovo LOQ 15 tested", "https://b.org/%D9%84", "x" * 100_000, None),
        (6, 1, "video", "youtube", "ASUS TUF FA608PM review", "not an address", None, None), (7, 4, "community", "reddit", "HP Victus 15 FA2082 review", "https://www.reddit.com/x", "", None),
    ]
    want = {1: "empty_post", 2: "identity_missing_fail_open", 3: "identity_missing_fail_open", 4: "identity_missing_fail_open", 5: "ok", 6: "ok", 7: "ok"}
    assert reasons(spark, targets, rows) == want
    assert reasons(spark, targets, []) == {}


def test_texts_meet_targets(spark, targets):
    rows = [(1, "ASUS TUF FA608PM measured", "fans"), (2, "Lenovo LOQ 15 against others", None), (3, "Lenovo Legion and LOQ", "x"), (4, "Should I buy the Lenovo LOQ", ""), (5, None, None), (6, "ASUS TUF A16 gaming laptop", "of 16 inch"), (7, "TUF A15 laptop of ASUS", "a 15 inch laptop"), (1, "ASUS TUF FA608PM measured", "fans")]
    got = R.target_matches(spark.createDataFrame(rows, "text_id long, title string, body string"), targets)
    assert sorted(map(tuple, got.collect())) == [(1, 1, "code"), (2, 2, "family"), (6, 1, "family")]


def test_one_kind_of_texts_and_targets_is_judged_once_and_written_in_blocks(spark):
    n, m = 3 * R.BLOCK, 40
    texts = spark.range(n).selectExpr("id AS text_id", "'Lenovo LOQ thermals' AS title", "CAST(NULL AS STRING) AS body")
    targets = spark.range(m).selectExpr("id AS target_id", "'Lenovo' AS brand", "'LOQ' AS family", "'LOQ 15' AS model", "15.6D AS screen")
    got = R.target_matches(texts, targets)
    assert got.distinct().count() == got.count() == n * m
    tasks = [r["n"] for r in got.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert max(tasks) < n * m  # one kind's pairs are dealt to several tasks


def test_matches_are_written_out_by_blocks_of_both_sides(spark):
    n = 2 * R.BLOCK + 3
    texts = spark.range(n).selectExpr("id AS text_id", "if(id % 2 = 0, 'Lenovo LOQ thermals', 'ASUS TUF FA608PM measured') AS title", "CAST(NULL AS STRING) AS body")
    named = spark.range(n).selectExpr("id AS target_id", "'Lenovo' AS brand", "'LOQ' AS family", "'LOQ 15' AS model", "15.6D AS screen")
    other = spark.createDataFrame([(0, "ASUS", "TUF", "TUF A16 FA608PM", 16.0), (0, "ASUS", "TUF", "TUF A16 FA608PM", 16.0), (1, None, "", None, None)], "target_id long, brand string, family string, model string, screen double")  # one target's name stands for two machines
    got = R.target_matches(texts, named.union(other))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan  # small files of very many texts would be sent whole
    for noisy in (line for line in plan.split("\n") if "mega ?thread" in line):
        assert "Filter" not in noisy.split("(")[0]  # equal texts are asked once whether they are noise
    counts = {(r["by"], r["even"]): (r["n"], r["d"]) for r in got.groupBy("by", (F.col("text_id") % 2 == 0).alias("even")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("text_id", "target_id").alias("d")).collect()}
    assert counts == {("family", True): ((n + 1) // 2 * n, (n + 1) // 2 * n), ("code", False): (n // 2 * 2, n // 2)}


def test_listings_of_one_content_get_their_own_rows(spark):
    rows = [(k, "Dell", [("S", "RAM", "8 GB DDR4")] if k % 2 else None) for k in range(6)] + [(None, None, None), (0, "Dell", None)]
    df = spark.createDataFrame(rows, f"id long, title string, rows {ROWS}")
    got = {(r["id"], r["memory"]["raw_spec"]) for r in S.spec_sheets(df, "id").collect()}
    assert got == {(k, "RAM: 8 GB DDR4" if k and k % 2 else None) for k in [*range(6), None]}


def test_listings_are_not_sent_to_the_driver_with_their_tables(spark):
    from marketloom.plans import sheets

    rows = [(k, "Dell", [("S", "RAM", "8 GB DDR4")] if k % 2 else None) for k in range(6)] + [(None, None, None), (None, "Dell", []), (0, "Dell", None), (0, "Dell", None)]
    df = spark.createDataFrame(rows, f"id long, title string, rows {ROWS}")
    values = S.spec_values(df, "id")
    assert sorted(map(str, values.collect())) == sorted(map(str, S.sheet_values(S.spec_sheets(df, "id"), "id").collect()))
    plan = sheets.spec_sheets(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan
    assert len(plan) < 1_000_000  # fields are written out once


def test_keys_of_one_content_are_handed_out_in_blocks(spark):
    n = 200 * S.BLOCK
    parts, contents = S._parts(spark.range(n).selectExpr("id", "'Dell' AS title", f"CAST(NULL AS {ROWS}) AS rows"), "id", "title", "rows")
    assert contents.count() == 1
    got = parts.agg(F.max(F.size("__keys")).alias("most"), F.sum(F.size("__keys")).alias("all")).first()
    assert (got["most"], got["all"]) == (S.BLOCK, n)
    assert parts.select(F.explode("__keys.__key").alias("k")).distinct().count() == n


def test_a_small_file_of_many_listings_is_many_tasks(spark):
    from marketloom.plans import forms, relevance, sheets, specs

    sf = "/root/testdata/sf0.001"
    assert min(df.rdd.getNumPartitions() for df in (sheets.listings(spark, sf), specs.listings(spark, sf), specs.routed_tables(spark, sf), forms.validated_names(spark, sf), forms.validated_numbers(spark, sf), relevance.sources_and_targets(spark, sf)[0])) >= 8
