"""Raw pages by store and day, bodies by content."""

from marketloom.sources import raw_pages as R

SCHEMA = "store string, url string, html string, scraped_at string, price double"


def test_saved_again_and_looked_up(spark, tmp_path):
    root = f"file://{tmp_path}/raw"
    rows = [("Store A!", "u1", "<b>1</b>", "2024-03-01 10:00:00", 5.0), ("Store A!", "u2", "<b>1</b>", "2024-03-01 11:00:00", None), ("Store A!", "u1", "", "2024-03-02 10:00:00", 6.0), ("b", "u3", None, "2024-03-01 10:00:00", 7.0)]
    for _ in range(2):
        R.save(spark.createDataFrame(rows, SCHEMA), root)
    R.save(spark.createDataFrame([("Store A!", "u9", "<b>1</b>", "2024-03-02 12:00:00", 8.0)], SCHEMA), root)
    got = lambda *at: sorted((r["store_key"], r["day"], r["url"], r["html"], r["price"]) for r in R.load_pages(spark, root, *at).collect())
    assert got("Store A!", "2024-03-01") == [("store_a_", "2024-03-01", "u1", "<b>1</b>", 5.0), ("store_a_", "2024-03-01", "u2", "<b>1</b>", None)]
    assert got("Store A!", "2024-03-02") == [("store_a_", "2024-03-02", "u9", "<b>1</b>", 8.0)] and got("b") == [("b", "2024-03-01", "u3", "", 7.0)]
    assert len(got()) == 4 and got("c") == []
    assert spark.read.parquet(f"{root}/bodies").count() == 2
    # The scan of the facts reads one partition.
    facts = spark.read.parquet(f"{root}/facts")
    assert facts.select("store_key", "day").distinct().count() == 3
    plan = R.load_pages(spark, root, "Store A!", "2024-03-01")._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    filters = next(line for line in plan.splitlines() if line.startswith("PartitionFilters") and "store_key" in line)
    assert "= store_a_)" in filters and "= 2024-03-01)" in filters


def test_store_names_that_look_like_numbers(spark, tmp_path):
    root = f"file://{tmp_path}/raw"
    R.save(spark.createDataFrame([("007", "u", "x", "2024-03-01 10:00:00", 1.0), (None, "v", "y", None, 2.0)], SCHEMA), root)
    assert [(r["store_key"], r["url"]) for r in R.load_pages(spark, root, "007").collect()] == [("007", "u")]
    assert {(r["store_key"], r["html"]) for r in R.load_pages(spark, root).collect()} == {("007", "x"), (None, "y")}
