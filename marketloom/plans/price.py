"""Price analytics: heads, roll-ups, transitions and histories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.operators import prices as P
from marketloom.registry import query
from marketloom.sources.tables import HEAD_SQL, OBS_SQL, head_state, load, moment, observations, timeline

W_SQL = "PARTITION BY item_id, store ORDER BY recorded_at, order_key, line_no, price, qty, disc"
CUTOFF = "2000-01-01 00:00:00"
M = "strftime({0}, '%Y-%m-%d %H:%M:%S.%f') AS recorded_at"

ROLLUP_SQL = (
    HEAD_SQL
    + """, ranked AS (SELECT *, CASE WHEN is_valid AND in_stock THEN 3 WHEN is_valid THEN 2 WHEN in_stock THEN 1 ELSE 0 END AS r FROM head),
pool AS (SELECT * FROM (SELECT *, max(r) OVER (PARTITION BY item_id) AS best, count(*) OVER (PARTITION BY item_id) AS n_offers FROM ranked) WHERE r = best),
rollup_ AS (
  SELECT item_id, any_value(n_offers) AS n_offers, min(price) AS min_price, max(price) AS max_price, round(max(price) - min(price), 2) AS price_spread,
         arg_min(store, (price, store)) AS cheapest_store, any_value(best) IN (1, 3) AS in_stock,
         CASE WHEN any_value(best) IN (1, 3) THEN string_agg(DISTINCT store, ',' ORDER BY store) ELSE '' END AS stores
  FROM pool GROUP BY item_id)"""
)


def _heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return head_state(observations(spark, sf_dir))


def rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.item_rollup(_heads(spark, sf_dir))


@query(f"WITH {HEAD_SQL} SELECT item_id, store, price, in_stock, is_valid, order_key, {M.format('recorded_at')} FROM head")
def offer_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _heads(spark, sf_dir).select("item_id", "store", "price", "in_stock", "is_valid", "order_key", moment("recorded_at").alias("recorded_at"))


@query(f"WITH {ROLLUP_SQL} SELECT * FROM rollup_")
def item_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups(spark, sf_dir).withColumn("stores", F.array_join("stores", ","))


@query(
    f"""WITH {OBS_SQL}, x AS (SELECT *, CASE WHEN is_valid AND in_stock THEN 0 WHEN is_valid THEN 1 ELSE 2 END AS r FROM obs),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id, store ORDER BY r, CASE WHEN r < 2 THEN price ELSE 0 END, recorded_at, order_key, line_no, price, qty, disc, in_stock) AS rn FROM x) WHERE rn = 1)
SELECT item_id, min(price) AS min_price, max(price) AS max_price, round(max(price) - min(price), 2) AS price_spread, arg_min(store, (price, store)) AS cheapest_store,
       count(*) AS stores_count, CAST(count(*) FILTER (in_stock) AS BIGINT) AS stores_in_stock FROM b GROUP BY item_id"""
)
def multi_store_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.overall(P.store_best(observations(spark, sf_dir)))


@query(
    f"""WITH {OBS_SQL}, p AS (SELECT item_id, count(*) AS raw, count(DISTINCT store) AS stores FROM obs GROUP BY 1)
SELECT CAST(sum(raw) AS BIGINT) AS raw_items, count(*) AS unique_items, CAST(count(*) FILTER (stores > 1) AS BIGINT) AS multi_store_items, round(count(*) FILTER (stores > 1) * 100.0 / count(*), 2) AS overlap_pct FROM p"""
)
def overlap_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.overlap(observations(spark, sf_dir))


STEP_SQL = (
    OBS_SQL
    + f""", l AS (SELECT *, lag(price) OVER w AS old_price, lag(in_stock) OVER w AS was FROM obs WINDOW w AS ({W_SQL})),
step AS (SELECT *, was <> in_stock AS is_stock_change, round(price - old_price, 2) AS d, abs(round(price - old_price, 2)) >= 1 AS moved FROM l WHERE old_price IS NOT NULL),
kind AS (SELECT *, CASE WHEN is_stock_change AND in_stock THEN 'RESTOCKED' WHEN is_stock_change THEN 'OUT_OF_STOCK' WHEN moved AND d < 0 THEN 'PRICE_DROP' WHEN moved THEN 'PRICE_HIKE' ELSE 'UNCHANGED' END AS change_type,
  CASE WHEN is_stock_change OR moved THEN d ELSE 0 END AS price_delta, moved AND d < 0 AS is_drop, moved AND d > 0 AS is_hike FROM step)"""
)


@query(f"WITH {STEP_SQL} SELECT item_id, store, order_key, line_no, old_price, price, change_type, round(price_delta, 2) AS price_delta, is_drop, is_hike, is_stock_change, {M.format('recorded_at')} FROM kind")
def price_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.price_steps(observations(spark, sf_dir)).select("item_id", "store", "order_key", "line_no", "old_price", "price", "change_type", F.round("price_delta", 2).alias("price_delta"), "is_drop", "is_hike", "is_stock_change", moment("recorded_at").alias("recorded_at"))


@query(
    f"""WITH {STEP_SQL} SELECT store, count(*) AS checked, CAST(count(*) FILTER (change_type <> 'UNCHANGED') AS BIGINT) AS changed, CAST(count(*) FILTER (is_drop) AS BIGINT) AS drops, CAST(count(*) FILTER (is_hike) AS BIGINT) AS hikes,
CAST(count(*) FILTER (change_type = 'OUT_OF_STOCK') AS BIGINT) AS out_of_stock, CAST(count(*) FILTER (change_type = 'RESTOCKED') AS BIGINT) AS restocked FROM kind GROUP BY store"""
)
def transition_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("change_type")
    return P.price_steps(observations(spark, sf_dir)).groupBy("store").agg(
        F.count(F.lit(1)).alias("checked"), F.count_if(t != "UNCHANGED").alias("changed"), F.count_if("is_drop").alias("drops"), F.count_if("is_hike").alias("hikes"), F.count_if(t == "OUT_OF_STOCK").alias("out_of_stock"), F.count_if(t == "RESTOCKED").alias("restocked")
    )


COLLAPSED_SQL = (
    OBS_SQL
    + f""", t AS (SELECT * FROM obs WHERE price >= 5000), k AS (SELECT *, lag(price) OVER w AS p0, lag(in_stock) OVER w AS s0 FROM t WINDOW w AS ({W_SQL})),
points AS (SELECT * EXCLUDE (p0, s0) FROM k WHERE NOT coalesce(abs(p0 - price) < 0.01 AND s0 = in_stock, FALSE))"""
)


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.collapsed(P.trusted(observations(spark, sf_dir)))


@query(f"WITH {COLLAPSED_SQL} SELECT item_id, store, order_key, line_no, price, in_stock, {M.format('recorded_at')} FROM points")
def history_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).select("item_id", "store", "order_key", "line_no", "price", "in_stock", moment("recorded_at").alias("recorded_at"))


CLIP_SQL = (
    COLLAPSED_SQL
    + f""", clip AS (SELECT item_id, store, recorded_at, price, in_stock, FALSE AS is_anchor FROM points WHERE recorded_at >= TIMESTAMP '{CUTOFF}'
UNION ALL SELECT item_id, store, TIMESTAMP '{CUTOFF}', price, in_stock, TRUE FROM (SELECT *, row_number() OVER (PARTITION BY item_id, store ORDER BY recorded_at DESC, order_key DESC, line_no DESC, price DESC, qty DESC, disc DESC, in_stock DESC) AS rn FROM points WHERE recorded_at < TIMESTAMP '{CUTOFF}') WHERE rn = 1)"""
)


def _clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.clipped(points(spark, sf_dir), F.lit(CUTOFF).cast("timestamp_ntz"))


@query(f"WITH {CLIP_SQL} SELECT item_id, store, price, in_stock, is_anchor, {M.format('recorded_at')} FROM clip")
def history_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clip(spark, sf_dir).withColumn("recorded_at", moment("recorded_at"))


@query(
    f"""WITH {CLIP_SQL}, h AS (SELECT item_id, store, count(*) AS n_points, min(price) AS min_price, max(price) AS max_price, arg_min(price, (recorded_at, price)) AS first_price, arg_max(price, (recorded_at, price)) AS last_price FROM clip GROUP BY 1, 2)
SELECT *, round(last_price - first_price, 2) AS price_change, CASE WHEN first_price <> 0 THEN round(round(last_price - first_price, 2) / first_price * 100, 2) ELSE 0 END AS price_change_pct FROM h"""
)
def history_series_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.series_stats(_clip(spark, sf_dir))


def _checked_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heads over all observations, checked a month after the last one."""
    return _heads(spark, sf_dir).withColumn("last_checked_at", F.col("recorded_at") + F.expr("INTERVAL 30 DAYS"))


EDGE_SQL = (
    COLLAPSED_SQL
    + """, last_point AS (SELECT item_id, store, arg_max(price, (recorded_at, price)) AS price, max(recorded_at) AS at FROM points GROUP BY 1, 2)"""
)


@query(
    f"""WITH {EDGE_SQL}, head AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id, store ORDER BY recorded_at DESC, order_key DESC, line_no DESC, price DESC, qty DESC, disc DESC, in_stock DESC) AS rn FROM obs) WHERE rn = 1)
SELECT h.item_id, h.store, CASE WHEN h.price >= 5000 THEN h.price ELSE coalesce(l.price, h.price) END AS price, h.in_stock, strftime(h.recorded_at + INTERVAL 30 DAY, '%Y-%m-%d %H:%M:%S.%f') AS recorded_at
FROM head h LEFT JOIN last_point l USING (item_id, store) WHERE l.at IS NULL OR h.recorded_at + INTERVAL 30 DAY > l.at"""
)
def history_live_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.live_edge(points(spark, sf_dir), _checked_heads(spark, sf_dir)).withColumn("recorded_at", moment("recorded_at"))


@query(
    f"""WITH {HEAD_SQL}, prev AS (SELECT *, lag(price) OVER ({W_SQL}) AS previous_price, first_value(recorded_at) OVER ({W_SQL}) AS created_at FROM obs),
state AS (SELECT h.*, p.previous_price, p.created_at FROM head h JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id, store ORDER BY recorded_at DESC, order_key DESC, line_no DESC, price DESC, qty DESC, disc DESC, in_stock DESC) AS rn FROM prev) WHERE rn = 1) p USING (item_id, store)),
bare AS (SELECT * FROM state s WHERE NOT EXISTS (SELECT 1 FROM obs o WHERE o.item_id = s.item_id AND o.store = s.store AND o.price >= 5000))
SELECT item_id, store, in_stock, CASE WHEN previous_price >= 5000 THEN previous_price ELSE price END AS price, strftime(created_at, '%Y-%m-%d %H:%M:%S.%f') AS recorded_at FROM bare
UNION ALL SELECT item_id, store, in_stock, price, strftime(recorded_at, '%Y-%m-%d %H:%M:%S.%f') FROM bare WHERE recorded_at > created_at"""
)
def history_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = observations(spark, sf_dir)
    w = timeline("item_id", "store")
    state = obs.withColumns({"previous_price": F.lag("price").over(w), "created_at": F.first("recorded_at").over(w)})
    latest = F.max(F.struct("recorded_at", "order_key", "line_no", "price", "qty", "disc", "in_stock", "previous_price", "created_at")).alias("l")
    head = state.groupBy("item_id", "store").agg(latest).select("item_id", "store", "l.price", "l.in_stock", "l.previous_price", "l.created_at", F.col("l.recorded_at").alias("price_updated_at"))
    return P.baseline(head, obs).withColumn("recorded_at", moment("recorded_at"))


@query(
    f"""WITH {CLIP_SQL}, s AS (SELECT item_id, store, min(price) AS min_price, max(price) AS max_price, arg_max(price, (recorded_at, price)) AS cur, arg_max(in_stock, (recorded_at, price)) AS in_stock FROM clip GROUP BY 1, 2)
SELECT item_id, min(min_price) AS lowest_ever, arg_min(store, (min_price, store)) AS lowest_store, max(max_price) AS highest_ever,
       coalesce(min(cur) FILTER (in_stock), min(cur)) AS current_best, coalesce(arg_min(store, (cur, store)) FILTER (in_stock), arg_min(store, (cur, store))) AS cheapest_store, string_agg(store, ',' ORDER BY NOT in_stock, cur, store) AS store_order
FROM s GROUP BY item_id"""
)
def history_extrema(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = F.max(F.struct("recorded_at", "price", "in_stock")).alias("l")
    series = _clip(spark, sf_dir).groupBy("item_id", "store").agg(F.min("price").alias("min_price"), F.max("price").alias("max_price"), last).select("item_id", "store", "min_price", "max_price", F.col("l.price").alias("current_price"), F.col("l.in_stock").alias("in_stock"))
    return P.cross_store(series)


@query(f"WITH {OBS_SQL}, l AS (SELECT *, lag(price) OVER w AS old_price, lag(in_stock) OVER w AS was FROM obs WINDOW w AS ({W_SQL})) SELECT item_id, store, order_key, line_no, price, in_stock, old_price, {M.format('recorded_at')} FROM l WHERE old_price IS NULL OR was <> in_stock OR abs(round(price - old_price, 2)) >= 1")
def meaningful_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.significant_events(observations(spark, sf_dir)).select("item_id", "store", "order_key", "line_no", "price", "in_stock", "old_price", moment("recorded_at").alias("recorded_at"))


CHECK_SQL = "SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN 404 WHEN 'F' THEN 500 ELSE 200 END AS status, o_totalprice AS old_price, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE round(o_totalprice + (o_orderkey % 5) - 2, 2) END AS new_price, o_orderkey % 3 = 0 AS was, o_orderkey % 4 <> 0 AS now_ FROM orders"


@query(
    f"""WITH c AS ({CHECK_SQL}), k AS (SELECT *, CASE WHEN status = 404 THEN CASE WHEN was THEN 'OUT_OF_STOCK' ELSE 'UNCHANGED' END WHEN status <> 200 THEN 'ERROR' WHEN new_price IS NULL AND was = now_ THEN 'ERROR'
 WHEN was <> now_ AND now_ THEN 'RESTOCKED' WHEN was <> now_ THEN 'OUT_OF_STOCK' WHEN abs(round(new_price - old_price, 2)) >= 1 THEN CASE WHEN new_price < old_price THEN 'PRICE_DROP' ELSE 'PRICE_HIKE' END ELSE 'UNCHANGED' END AS outcome FROM c)
SELECT outcome, count(*) AS n FROM k GROUP BY 1"""
)
def check_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price checks with their page status: gone, failed and unreadable pages beside transitions."""
    o, k = load(spark, sf_dir, "orders"), F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "P", 404).when(F.col("o_orderstatus") == "F", 500).otherwise(200)
    old = F.col("o_totalprice")
    new = F.when(k % 7 != 0, F.round(old + (k % 5) - 2, 2))
    return o.select(P.check_outcome(status, old, new, k % 3 == 0, k % 4 != 0).alias("outcome")).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH e AS (SELECT user_id, ts, event_id, CAST(event_type = 'error' AS INT) AS bad FROM events),
r AS (SELECT *, count(*) OVER w AS attempted, sum(bad) OVER w AS failures, sum(1 - bad) OVER w AS ok FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(bad) OVER (PARTITION BY user_id, ok ORDER BY ts, event_id) AS in_a_row FROM r)
SELECT user_id, event_id, CAST(attempted AS BIGINT) AS attempted, CAST(failures AS BIGINT) AS failures FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY attempted) AS rn FROM s WHERE (attempted >= 5 AND failures * 100.0 / attempted > 20) OR in_a_row >= 10) WHERE rn = 1"""
)
def breaker_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user's stream of events, the first at which its breaker opens."""
    e = load(spark, sf_dir, "events").withColumn("bad", F.col("event_type") == "error")
    return P.tripped(e, ["ts", "event_id"], "bad", by=["user_id"]).select("user_id", "event_id", "attempted", "failures")
