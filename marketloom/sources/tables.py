"""Tables by name, and the catalog's concepts as views of them.

An *observation* is what one store asked for one item at one time; the *head*
is a (item, store) pair's latest observation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Prices below this are taken for scraping errors.
LEAST_PRICE = 5000.0


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tasks(spark: SparkSession) -> int:
    """More tasks than there are cores, and as many as shuffles have."""
    return max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(df: DataFrame, *by: str) -> DataFrame:
    """Rows dealt evenly (or by columns) over more tasks than there are cores, before work that is heavy per row: a small file holds very many short rows and is one task."""
    return df.repartition(tasks(df.sparkSession), *by)


def moment(column: str | Column) -> Column:
    """A time as text with microseconds, the same whatever the reader's time zone."""
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, store, recorded_at, price, in_stock, is_valid, order_key, line_no, qty, disc."""
    lines = load(spark, sf_dir, "lineitem")
    where = load(spark, sf_dir, "supplier").join(load(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(load(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return lines.join(where.select("s_suppkey", "r_name"), F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.col("l_partkey").alias("item_id"),
        F.col("r_name").alias("store"),
        F.col("l_shipdate").alias("recorded_at"),
        F.col("l_extendedprice").alias("price"),
        (F.col("l_returnflag") != "R").alias("in_stock"),
        (F.col("l_extendedprice") >= LEAST_PRICE).alias("is_valid"),
        F.col("l_orderkey").alias("order_key"),
        F.col("l_linenumber").alias("line_no"),
        F.col("l_quantity").alias("qty"),
        F.col("l_discount").alias("disc"),
    )


#: The order of a pair's observations; the long tail makes it total.
TIMELINE = ("recorded_at", "order_key", "line_no", "price", "qty", "disc")


def head_state(obs: DataFrame) -> DataFrame:
    """The latest observation of every (item, store): one hash aggregate, no sort of the history."""
    latest = F.max(F.struct(*TIMELINE, "in_stock", "is_valid")).alias("last")
    return obs.groupBy("item_id", "store").agg(latest).select("item_id", "store", "last.*")


def timeline(*keys: str) -> Window:
    return Window.partitionBy(*keys).orderBy(*TIMELINE)


OBS_SQL = """obs AS (
  SELECT l_partkey AS item_id, r_name AS store, l_shipdate AS recorded_at, l_extendedprice AS price, l_returnflag <> 'R' AS in_stock,
         l_extendedprice >= 5000 AS is_valid, l_orderkey AS order_key, l_linenumber AS line_no, l_quantity AS qty, l_discount AS disc
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

HEAD_SQL = (
    OBS_SQL
    + """, head AS (
  SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY item_id, store ORDER BY recorded_at DESC, order_key DESC, line_no DESC, price DESC, qty DESC, disc DESC, in_stock DESC) AS rn FROM obs) WHERE rn = 1)"""
)
