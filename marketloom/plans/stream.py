"""Streaming queries, each run to the end of what there is."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.registry import query
from marketloom.sources.scratch import scratch_path
from marketloom.streaming import jobs as J


@query("SELECT DISTINCT event_id, event_type FROM events")
def inbox_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event stream read twice over: every message arrives two times and passes once."""
    s = J.events(spark, f"{sf_dir}/events.parquet")
    return J.to_table(J.inbox(s.union(J.events(spark, f"{sf_dir}/events.parquet")), "event_id", "ts").select("event_id", "event_type"), "inbox")


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE event_type IN ('click', 'purchase', 'error') GROUP BY 1")
def event_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events to the handlers of their types, each of which appends to its own table."""
    base = scratch_path(spark, "routed")
    kinds = ["click", "purchase", "error"]
    handlers = {k: J.batch_sink(f"{base}/event_type={k}") for k in kinds}
    J.routed(J.events(spark, f"{sf_dir}/events.parquet").select("event_id", "value", "event_type"), handlers, "event_type", scratch_path(spark, "routed-checkpoint")).awaitTermination()
    out = spark.read.parquet(base)
    return out.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(
    """WITH o AS (SELECT user_id, arg_max(value, (ts, event_id)) AS price, arg_max(event_type, (ts, event_id)) <> 'error' AS in_stock FROM events WHERE ts < TIMESTAMP '2024-01-15' GROUP BY 1),
n AS (SELECT user_id, arg_max(value, (ts, event_id)) AS np, arg_max(event_type, (ts, event_id)) <> 'error' AS ns FROM events WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY 1)
SELECT user_id, coalesce(np, price) AS price, coalesce(ns, in_stock) AS in_stock, CASE WHEN price IS NULL THEN 'NEW' WHEN ns IS NULL THEN 'UNCHECKED' WHEN ns <> in_stock AND ns THEN 'RESTOCKED' WHEN ns <> in_stock THEN 'OUT_OF_STOCK'
 WHEN abs(round(np - price, 2)) >= 1 THEN CASE WHEN np < price THEN 'PRICE_DROP' ELSE 'PRICE_HIKE' END ELSE 'UNCHANGED' END AS change_type FROM o FULL JOIN n USING (user_id)"""
)
def apply_price_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heads as of mid-month, then the rest of the month applied as one batch."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "ts", "event_id", F.col("value").alias("price"), (F.col("event_type") != "error").alias("in_stock"))
    split = F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    head = e.where(F.col("ts") < split).groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "price", "in_stock")).alias("m")).select("user_id", "m.price", "m.in_stock")
    return J.apply_batch(head, e.where(F.col("ts") >= split), ["user_id"], ["ts", "event_id"])
