"""Browse, look-up and freshness queries over items (parts with their price roll-ups)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.operators import browse as B
from marketloom.plans.price import ROLLUP_SQL, rollups
from marketloom.registry import query
from marketloom.sources.tables import HEAD_SQL, OBS_SQL, head_state, load, moment, observations

ITEMS_SQL = (
    ROLLUP_SQL
    + """, items AS (SELECT p_partkey AS item_id, p_name AS name, p_brand AS brand, p_type AS family, p_size AS size, p_retailprice AS list_price,
  n_offers, min_price, max_price, price_spread, cheapest_store, in_stock, stores FROM part LEFT JOIN rollup_ ON p_partkey = item_id)"""
)
#: Quality figures of items, for gates and rankings.
METRICS_SQL = OBS_SQL + ", metrics AS (SELECT item_id, count(*) AS n_obs, round(avg(qty), 4) AS avg_qty, round(avg(disc), 6) AS avg_disc FROM obs GROUP BY 1)"


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("family"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("list_price"))
    return part.join(rollups(spark, sf_dir).withColumn("stores", F.array_join("stores", ",")), "item_id", "left")


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations(spark, sf_dir).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_obs"), F.round(F.avg("qty"), 4).alias("avg_qty"), F.round(F.avg("disc"), 6).alias("avg_disc"))


@query("SELECT p_partkey, p_name, p_brand, p_type FROM part WHERE lower(p_name) LIKE '%red%' OR lower(p_brand) LIKE '%red%' OR lower(p_type) LIKE '%red%'")
def browse_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").where(B.contains_term(["p_name", "p_brand", "p_type"], "  RED ")).select("p_partkey", "p_name", "p_brand", "p_type")


@query(f"WITH {ITEMS_SQL} SELECT item_id, brand, min_price FROM items WHERE min_price BETWEEN 8000 AND 30000 AND lower(trim(brand)) IN ('brand#1', 'brand#2', 'brand#3') AND in_stock AND min_price > 0")
def browse_price_brand_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).where(B.between("min_price", 8000, 30000) & B.one_of("brand", ["Brand#1", " brand#2", "BRAND#3"]) & B.purchasable()).select("item_id", "brand", "min_price")


@query(f"WITH {METRICS_SQL} SELECT p_partkey AS item_id, p_name AS name FROM part JOIN metrics ON item_id = p_partkey WHERE n_obs >= 25 AND avg_qty >= 25")
def browse_metric_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("name"))
    return B.metric_gates(part, metrics(spark, sf_dir), "item_id", {"n_obs": 25, "avg_qty": 25}).select("item_id", "name")


PAGE_COLUMNS = "item_id, min_price, position, has_next, has_previous"


@query(
    f"""WITH {ITEMS_SQL}, f AS (SELECT * FROM items WHERE min_price > 12000 OR (min_price = 12000 AND item_id > 0) ORDER BY min_price, item_id LIMIT 21),
n AS (SELECT *, CAST(row_number() OVER (ORDER BY min_price, item_id) AS INT) AS position, count(*) OVER () > 20 AS has_next, TRUE AS has_previous FROM f) SELECT {PAGE_COLUMNS} FROM n WHERE position <= 20"""
)
def browse_page_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.keyset_page(items(spark, sf_dir), "min_price", "item_id", 20, after=(12000.0, 0)).select(*PAGE_COLUMNS.split(", "))


@query(
    f"""WITH {ITEMS_SQL}, f AS (SELECT * FROM items WHERE min_price < 12000 OR (min_price = 12000 AND item_id < 0) ORDER BY min_price DESC, item_id DESC LIMIT 21),
n AS (SELECT *, row_number() OVER (ORDER BY min_price DESC, item_id DESC) AS r, count(*) OVER () AS c FROM f)
SELECT item_id, min_price, CAST(least(c, 20) - r + 1 AS INT) AS position, TRUE AS has_next, c > 20 AS has_previous FROM n WHERE r <= 20"""
)
def browse_page_prev(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.keyset_page(items(spark, sf_dir), "min_price", "item_id", 20, before=(12000.0, 0)).select(*PAGE_COLUMNS.split(", "))


@query(f"WITH {ITEMS_SQL} SELECT count(*) AS total FROM items WHERE in_stock AND min_price > 0 AND min_price >= 8000")
def browse_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).where(B.purchasable() & B.between("min_price", 8000)).agg(F.count(F.lit(1)).alias("total"))


@query("SELECT p_partkey, rtrim(replace(replace(to_base64(encode(CAST(p_retailprice AS VARCHAR) || ':' || p_partkey)), '+', '-'), '/', '_'), '=') AS token FROM part")
def cursor_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").select("p_partkey", B.cursor_token(F.col("p_retailprice"), F.col("p_partkey")).alias("token"))


@query(f"WITH {ITEMS_SQL} SELECT item_id, name, brand, min_price FROM items WHERE lower(CAST(item_id AS VARCHAR)) = '17' OR lower(name) = '17' ORDER BY item_id LIMIT 1")
def item_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.lookup(items(spark, sf_dir), " 17 ", ["item_id", "name"], ["item_id"]).select("item_id", "name", "brand", "min_price")


@query(f"WITH {ITEMS_SQL} SELECT item_id, min_price FROM items WHERE min_price BETWEEN 6000 AND 40000 ORDER BY min_price, item_id LIMIT 50 OFFSET 100")
def browse_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.offset_page(items(spark, sf_dir).where(B.between("min_price", 6000, 40000)), [F.col("min_price"), F.col("item_id")], 50, 100).select("item_id", "min_price")


@query(
    f"""WITH {ITEMS_SQL} SELECT item_id, coalesce(nullif(brand, ''), 'Generic') AS brand, coalesce(nullif(family, ''), 'Item') AS family, CAST(coalesce(nullif(size, 0), 16) AS INT) AS size, coalesce(nullif(min_price, 0), list_price) AS price,
coalesce(in_stock, FALSE) AS in_stock, coalesce(cheapest_store, 'none') AS store FROM items"""
)
def item_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards with defaults; as in the source system an empty or zero value also gives way to its default."""
    c = F.col
    return items(spark, sf_dir).select(
        "item_id", F.coalesce(F.nullif(c("brand"), F.lit("")), F.lit("Generic")).alias("brand"), F.coalesce(F.nullif(c("family"), F.lit("")), F.lit("Item")).alias("family"), F.coalesce(F.nullif(c("size"), F.lit(0)), F.lit(16)).alias("size"),
        F.coalesce(F.nullif(c("min_price"), F.lit(0.0)), c("list_price")).alias("price"), F.coalesce("in_stock", F.lit(False)).alias("in_stock"), F.coalesce("cheapest_store", F.lit("none")).alias("store"),
    )


@query(
    f"""WITH {HEAD_SQL}, v AS (SELECT * FROM head WHERE is_valid) SELECT item_id, string_agg(store || '=' || CAST(CAST(price AS DECIMAL(12, 2)) AS VARCHAR), ';' ORDER BY store) AS prices_by_store, arg_min(store, (price, store)) AS cheapest, count(*) AS offers FROM v GROUP BY 1"""
)
def item_detail_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices by store as a map (here flattened to text), over valid offers; stores are unique, so no entry is lost."""
    v = head_state(observations(spark, sf_dir)).where("is_valid")
    g = v.groupBy("item_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("store", F.col("price").cast("decimal(12,2)").alias("p"))))).alias("m"), F.min(F.struct("price", "store"))["store"].alias("cheapest"), F.count(F.lit(1)).alias("offers"))
    return g.select("item_id", F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ";").alias("prices_by_store"), "cheapest", "offers")


@query(f"WITH {HEAD_SQL} SELECT p_partkey AS item_id, coalesce(string_agg(store || ':' || in_stock, ',' ORDER BY store), '') AS offers, CAST(count(store) AS INT) AS n FROM part LEFT JOIN head ON item_id = p_partkey GROUP BY 1")
def items_with_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item with its offers as one nested collection."""
    part = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id"))
    nested = B.with_children(part, head_state(observations(spark, sf_dir)), "item_id", "offers", ["store", "in_stock"])
    return nested.select("item_id", F.array_join(F.transform("offers", lambda o: F.concat_ws(":", o["store"], o["in_stock"].cast("string"))), ",").alias("offers"), F.size("offers").alias("n"))


@query(f"WITH {HEAD_SQL} SELECT item_id, store, price FROM head WHERE is_valid ORDER BY recorded_at ASC NULLS FIRST, item_id, store LIMIT 100")
def stale_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.stale(head_state(observations(spark, sf_dir)), "recorded_at", ["item_id", "store"], 100).select("item_id", "store", "price")


@query(f"WITH {HEAD_SQL}, s AS (SELECT * FROM head WHERE is_valid ORDER BY recorded_at ASC NULLS FIRST, item_id, store LIMIT 100) SELECT store, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS item_ids FROM s GROUP BY store")
def stale_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    stale = B.stale(head_state(observations(spark, sf_dir)), "recorded_at", ["item_id", "store"], 100)
    return stale.groupBy("store").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list("item_id")), ",").alias("item_ids"))


@query(
    f"""WITH {HEAD_SQL} SELECT o.item_id, o.store, o.order_key, o.line_no, o.price, h.price AS head_price, p_name AS name, strftime(o.recorded_at, '%Y-%m-%d %H:%M:%S.%f') AS recorded_at
FROM obs o JOIN head h USING (item_id, store) JOIN part ON p_partkey = o.item_id WHERE o.recorded_at >= TIMESTAMP '2001-06-01' ORDER BY o.recorded_at DESC, o.item_id, o.store, o.order_key, o.line_no LIMIT 200"""
)
def change_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = observations(spark, sf_dir)
    heads = head_state(obs).select("item_id", "store", F.col("price").alias("head_price"))
    part = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("name"))
    feed = B.change_feed(obs, heads, part, F.lit("2001-06-01 00:00:00").cast("timestamp_ntz"), 200)
    return feed.select("item_id", "store", "order_key", "line_no", "price", "head_price", "name", moment("recorded_at").alias("recorded_at"))


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'F' AND (o_orderkey % 4 = 0 OR o_orderdate <= TIMESTAMP '2001-07-25')")
def review_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Not reviewed yet, and never checked or not within the 7 days before a given time."""
    now = F.lit("2001-08-01 00:00:00").cast("timestamp_ntz")
    checked = F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderdate"))
    due = checked.isNull() | (checked <= now - F.expr("INTERVAL 7 DAYS"))
    return load(spark, sf_dir, "orders").where((F.col("o_orderstatus") != "F") & due).select("o_orderkey", "o_orderstatus")


@query(
    f"""WITH {OBS_SQL}, d AS (SELECT store, p_name, min((recorded_at, order_key, line_no, item_id)) AS seen FROM obs JOIN part ON p_partkey = item_id GROUP BY 1, 2),
n AS (SELECT *, row_number() OVER (PARTITION BY store ORDER BY seen) AS rn FROM d),
c AS (SELECT store, count(*) AS active_offers FROM obs WHERE in_stock GROUP BY 1)
SELECT store, active_offers, string_agg(p_name, '|' ORDER BY seen) AS pointers FROM n JOIN c USING (store) WHERE rn <= 10 GROUP BY 1, 2"""
)
def pointer_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per store: active offers, and its first ten distinct names in order of observation."""
    from pyspark.sql import Window

    named = observations(spark, sf_dir).join(load(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id"), "p_name"), "item_id")
    firsts = named.groupBy("store", "p_name").agg(F.min(F.struct("recorded_at", "order_key", "line_no", "item_id")).alias("at"))
    ten = firsts.withColumn("rn", F.row_number().over(Window.partitionBy("store").orderBy("at"))).where("rn <= 10")
    lists = ten.groupBy("store").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "p_name"))), lambda x: x["p_name"]), "|").alias("pointers"))
    return lists.join(named.where("in_stock").groupBy("store").agg(F.count(F.lit(1)).alias("active_offers")), "store").select("store", "active_offers", "pointers")


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey LIMIT 25")
def recent_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").where("o_orderstatus = 'F'").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(25).select("o_orderkey", "o_orderpriority")


@query(
    f"""WITH {OBS_SQL}, l AS (SELECT store, item_id, row_number() OVER (PARTITION BY store ORDER BY recorded_at DESC, order_key DESC, line_no DESC, item_id DESC, price DESC) AS position FROM obs),
s AS (SELECT store, min(position) AS stop FROM l WHERE item_id % 97 = 0 GROUP BY 1)
SELECT l.store, l.item_id, l.position FROM l LEFT JOIN s USING (store) WHERE stop IS NULL OR l.position < stop"""
)
def take_until_pointer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each store listed since the last item already known."""
    newest = ["recorded_at", "order_key", "line_no", "item_id", "price"]
    return B.taken_until(observations(spark, sf_dir), ["store"], newest, F.col("item_id") % 97 == 0).select("store", "item_id", "position")


@query(
    f"""WITH {ITEMS_SQL}, c AS (SELECT * FROM items WHERE item_id IN (3, 17, 42, 99)),
u AS (SELECT item_id, 'min_price' AS metric, CAST(min_price AS DOUBLE) AS value, -1 AS s FROM c UNION ALL SELECT item_id, 'size', size, 1 FROM c UNION ALL SELECT item_id, 'price_spread', price_spread, -1 FROM c UNION ALL SELECT item_id, 'n_offers', n_offers, 1 FROM c)
SELECT metric, count(DISTINCT value) AS distinct_values, arg_min(item_id, (-value * s, item_id)) AS winner, arg_min(value, (-value * s, item_id)) AS best_value FROM u WHERE value IS NOT NULL GROUP BY 1 HAVING count(DISTINCT value) > 1"""
)
def compare_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = items(spark, sf_dir).where(F.col("item_id").isin(3, 17, 42, 99))
    return B.compare(chosen, "item_id", {"min_price": "min", "size": "max", "price_spread": "min", "n_offers": "max"}).select("metric", "distinct_values", "winner", "best_value")
