"""Write-path queries: matching and merging batches, outbox and inbox states."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.operators import merge as M
from marketloom.registry import query
from marketloom.sources.tables import HEAD_SQL, OBS_SQL, head_state, load, observations

SPLIT = "1999-01-01 00:00:00"


def _part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").select(F.col("p_partkey").alias("part_id"), F.col("p_name").alias("title"), F.col("p_brand").alias("brand"), F.col("p_size").alias("size"))


@query(
    """WITH b AS (SELECT o_orderkey AS row_id, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey END AS part_id, 'Brand#' || (o_orderkey % 25) AS brand, CAST(o_orderkey % 50 AS INT) + 1 AS size FROM orders),
k2 AS (SELECT p_brand, p_size, min(p_partkey) AS id2 FROM part GROUP BY 1, 2)
SELECT row_id, coalesce(p_partkey, id2) AS matched_id, CAST(CASE WHEN p_partkey IS NOT NULL THEN 1 WHEN id2 IS NOT NULL THEN 2 ELSE 0 END AS INT) AS match_rule
FROM b LEFT JOIN part ON p_partkey = part_id LEFT JOIN k2 ON k2.p_brand = brand AND k2.p_size = size"""
)
def upsert_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch matched by identifier, else by brand and size."""
    k = F.col("o_orderkey")
    batch = load(spark, sf_dir, "orders").select(k.alias("row_id"), F.when(k % 3 == 0, F.col("o_custkey")).alias("part_id"), F.concat(F.lit("Brand#"), (k % 25).cast("string")).alias("brand"), ((k % 50).cast("int") + 1).alias("size"))
    return M.matched(batch, _part(spark, sf_dir).withColumn("id", F.col("part_id")), [["part_id"], ["brand", "size"]], "id", ["id"]).select("row_id", "matched_id", "match_rule")


OLD_NEW_SQL = (
    OBS_SQL
    + f""", o_ AS (SELECT item_id, store, arg_max(price, (recorded_at, order_key, line_no, price)) AS price, max(recorded_at) AS at FROM obs WHERE recorded_at < TIMESTAMP '{SPLIT}' GROUP BY 1, 2),
n_ AS (SELECT item_id, store, arg_max(price, (recorded_at, order_key, line_no, price)) AS price, max(recorded_at) AS at FROM obs WHERE recorded_at >= TIMESTAMP '{SPLIT}' GROUP BY 1, 2)"""
)


def _old_new(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    obs, split = observations(spark, sf_dir), F.lit(SPLIT).cast("timestamp_ntz")
    state = lambda d: d.groupBy("item_id", "store").agg(F.max(F.struct("recorded_at", "order_key", "line_no", "price")).alias("m")).select("item_id", "store", F.col("m.price").alias("price"))
    return state(obs.where(F.col("recorded_at") < split)), state(obs.where(F.col("recorded_at") >= split))


@query(
    f"""WITH {OLD_NEW_SQL} SELECT item_id, store, coalesce(n_.price, o_.price) AS price,
CASE WHEN o_.price IS NULL THEN 'inserted' WHEN n_.price IS NULL THEN 'kept' WHEN n_.price <> o_.price THEN 'updated' ELSE 'touched' END AS action FROM o_ FULL JOIN n_ USING (item_id, store)"""
)
def snapshot_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _old_new(spark, sf_dir)
    return M.snapshot(old, new, ["item_id", "store"], ["price"])


@query(f"WITH {OLD_NEW_SQL} SELECT CASE WHEN o_.price IS NULL THEN 'inserted' WHEN n_.price IS NULL THEN 'kept' WHEN n_.price <> o_.price THEN 'updated' ELSE 'touched' END AS action, count(*) AS n FROM o_ FULL JOIN n_ USING (item_id, store) GROUP BY 1")
def merge_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _old_new(spark, sf_dir)
    return M.snapshot(old, new, ["item_id", "store"], ["price"]).groupBy("action").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH {OLD_NEW_SQL}, a AS (SELECT store, max(item_id) AS pointer, count(*) AS n FROM o_ WHERE item_id % 2 = 0 GROUP BY 1), b AS (SELECT store, CASE WHEN store = 'ASIA' THEN NULL ELSE max(item_id) END AS pointer, count(*) AS n FROM n_ GROUP BY 1)
SELECT store, coalesce(b.pointer, a.pointer) AS pointer, coalesce(b.n, a.n) AS n FROM a FULL JOIN b USING (store)"""
)
def pointer_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insert or update by store; an empty new pointer keeps the old one."""
    old, new = _old_new(spark, sf_dir)
    a = old.where("item_id % 2 = 0").groupBy("store").agg(F.max("item_id").alias("pointer"), F.count(F.lit(1)).alias("n"))
    b = new.groupBy("store").agg(F.max("item_id").alias("pointer"), F.count(F.lit(1)).alias("n")).withColumn("pointer", F.when(F.col("store") != "ASIA", F.col("pointer")))
    return M.snapshot(a, b, ["store"], ["pointer", "n"]).drop("action")


MESSAGE_SQL = """m AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'O' THEN 'PENDING' WHEN 'P' THEN 'PUBLISHING' ELSE 'DISPATCHED' END AS status, CAST(substr(o_orderpriority, 1, 1) AS INT) AS retries,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderdate END AS lease, o_orderdate AS created_at FROM orders)"""


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("o_orderstatus")
    return load(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.when(s == "O", "PENDING").when(s == "P", "PUBLISHING").otherwise("DISPATCHED").alias("status"), F.substring("o_orderpriority", 1, 1).cast("int").alias("retries"),
        F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderdate")).alias("lease"), F.col("o_orderdate").alias("created_at"),
    )


@query(
    f"""WITH {MESSAGE_SQL} SELECT id, status, status = 'PUBLISHING' AS reclaimed, CAST(retries + CASE WHEN status = 'PUBLISHING' THEN 1 ELSE 0 END AS INT) AS retries FROM m
WHERE retries < 5 AND (status = 'PENDING' OR (status = 'PUBLISHING' AND (lease IS NULL OR lease < TIMESTAMP '2000-01-01'))) ORDER BY created_at, id LIMIT 500"""
)
def outbox_eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    fit = M.eligible(_messages(spark, sf_dir), "status", "retries", "lease", F.lit("2000-01-01 00:00:00").cast("timestamp_ntz"))
    return fit.orderBy("created_at", "id").limit(500).select("id", "status", "reclaimed", "retries")


@query(
    f"""WITH {MESSAGE_SQL}, t AS (SELECT *, id % 3 <> 0 AS ok FROM m WHERE status = 'PUBLISHING'), u AS (SELECT *, CASE WHEN ok THEN retries ELSE retries + 1 END AS r FROM t)
SELECT id, CASE WHEN ok THEN 'DISPATCHED' WHEN r >= 5 THEN 'FAILED' ELSE 'PENDING' END AS new_status, CAST(r AS INT) AS new_retries FROM u"""
)
def outbox_transition(spark: SparkSession, sf_dir: str) -> DataFrame:
    sent = _messages(spark, sf_dir).where("status = 'PUBLISHING'")
    return M.settled(sent, "status", "retries", F.col("id") % 3 != 0).select("id", "new_status", "new_retries")


@query(
    """WITH seen AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'signup'), f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_type <> 'signup') WHERE n = 1)
SELECT event_id, user_id FROM f WHERE user_id NOT IN (SELECT user_id FROM seen)
UNION ALL SELECT -1, count(*) FROM seen"""
)
def inbox_unseen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of users not processed before, each user's first; and how many were processed."""
    e = load(spark, sf_dir, "events")
    seen = e.where("event_type = 'signup'")
    new = M.unseen(e.where("event_type != 'signup'"), seen, "user_id", ["ts", "event_id"]).select("event_id", "user_id")
    return new.unionByName(seen.agg(F.count_distinct("user_id").alias("user_id")).select(F.lit(-1).cast("long").alias("event_id"), "user_id"))


@query(
    f"""WITH {HEAD_SQL}, r AS (SELECT item_id, store FROM obs WHERE recorded_at >= TIMESTAMP '2001-06-01' GROUP BY 1, 2)
SELECT h.item_id, h.store, CASE WHEN r.item_id IS NOT NULL THEN 'checked' ELSE 'stale' END AS state FROM head h LEFT JOIN r USING (item_id, store)"""
)
def touch_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = observations(spark, sf_dir)
    heads = head_state(obs).select("item_id", "store", F.lit("stale").alias("state"))
    return M.touched(heads, obs.where("recorded_at >= timestamp_ntz '2001-06-01 00:00:00'"), ["item_id", "store"], "state", F.lit("checked"))


@query(
    """WITH s AS (SELECT c_custkey, c_nationkey, c_mktsegment, c_acctbal, c_acctbal > 5000 AS has FROM customer),
d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS n FROM s WHERE has) WHERE n = 1)
SELECT s.c_custkey, d.c_custkey AS donor_c_custkey, d.c_mktsegment AS donor_c_mktsegment FROM s JOIN d USING (c_nationkey) WHERE NOT s.has"""
)
def sibling_donors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence taken over from the best sibling of the same group."""
    c = load(spark, sf_dir, "customer").withColumn("has_evidence", F.col("c_acctbal") > 5000)
    return M.donors(c, "c_nationkey", [-F.col("c_acctbal"), F.col("c_custkey")], ["c_custkey", "c_mktsegment"]).select("c_custkey", "donor_c_custkey", "donor_c_mktsegment")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def unmatched_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known items that nothing in a batch matched."""
    done = load(spark, sf_dir, "orders").where("o_orderstatus = 'P'")
    return load(spark, sf_dir, "customer").join(done, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")
