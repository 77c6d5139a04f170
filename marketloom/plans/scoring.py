"""Scores, coercions and validators over parts, orders and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.functions import parsing as N
from marketloom.functions import scoring as S
from marketloom.registry import query
from marketloom.sources.tables import load

#: Data sheets of items, derived from the parts' columns.
SHEET_SQL = """sheet AS (SELECT p_partkey AS id, p_retailprice AS price, p_size, p_type, CAST(4 + p_size % 13 AS DOUBLE) AS cores, CAST(8 + p_size % 25 AS DOUBLE) AS threads, 3 + (p_partkey % 25) / 10.0 AS boost, CAST(p_size AS DOUBLE) AS cache,
  CAST(35 + p_partkey % 140 AS DOUBLE) AS watts, CAST(20 + p_partkey % 80 AS DOUBLE) AS gref, p_type = 'SMALL' AS igpu, CAST(8 * (1 + p_partkey % 8) AS DOUBLE) AS ram FROM part)"""


def sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size")
    return load(spark, sf_dir, "part").select(
        k.alias("id"), F.col("p_retailprice").alias("price"), "p_size", "p_type", (4 + s % 13).cast("double").alias("cores"), (8 + s % 25).cast("double").alias("threads"), (3 + (k % 25) / 10.0).alias("boost"), s.cast("double").alias("cache"),
        (35 + k % 140).cast("double").alias("watts"), (20 + k % 80).cast("double").alias("gref"), (F.col("p_type") == "SMALL").alias("igpu"), (8 * (1 + k % 8)).cast("double").alias("ram"),
    )


@query("SELECT p_partkey, round(greatest(15, least(98, p_size * 2.5)), 2) AS score FROM part")
def clamp_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").select("p_partkey", S.clamp(F.col("p_size") * 2.5, 15, 98).alias("score"))


LADDER = "CASE WHEN {c} >= 40 THEN 25 WHEN {c} >= 25 THEN 16 WHEN {c} >= 10 THEN 9 ELSE 4 END"


@query(f"SELECT p_partkey, CAST({LADDER.format(c='p_size')} + CASE p_type WHEN 'PROMO' THEN 40 WHEN 'ECONOMY' THEN 20 WHEN 'LARGE' THEN 30 ELSE 10 END AS DOUBLE) AS score FROM part")
def ladder_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = S.ladder(F.col("p_size"), [(40, 25.0), (25, 16.0), (10, 9.0)], 4.0) + S.choice(F.col("p_type"), {"PROMO": 40.0, "ECONOMY": 20.0, "LARGE": 30.0}, 10.0)
    return load(spark, sf_dir, "part").select("p_partkey", score.alias("score"))


@query(
    f"""WITH {SHEET_SQL}, h AS (SELECT id, price * 40 AS cost, greatest(ram, 8) AS h FROM (SELECT id, price, 0.28 * gref + 0.32 * gref + 0.15 * p_size + 0.10 * least(100.0, ram / 32.0 * 100.0) + 0.15 * cache AS ram FROM sheet)),
v AS (SELECT id, round(greatest(15, least(100, (round(pow(h, 1.35) / (greatest(1, cost) / 10000.0), 2) - 18.0) / 40.0 * 100.0)), 4) AS score FROM h)
SELECT id, score, CASE WHEN score >= 75 THEN 'GREAT_DEAL' WHEN score >= 60 THEN 'GOOD_VALUE' WHEN score >= 45 THEN 'FAIR_VALUE' ELSE 'POOR_VALUE' END AS tier FROM v"""
)
def value_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.greatest(S.composite("gref", "gref", F.col("p_size"), "cache", "ram"), F.lit(8.0))
    score = S.value_power(h, F.col("price") * 40, digits=4)
    return sheet(spark, sf_dir).select("id", score.alias("score"), S.deal_tier(score).alias("tier"))


@query(f"WITH {SHEET_SQL}, h AS (SELECT id, price * 40 AS cost, 0.28 * gref + 0.32 * gref + 0.15 * p_size + 0.10 * least(100.0, ram / 32.0 * 100.0) + 0.15 * cache AS h FROM sheet) SELECT id, round(15.0 + 82.5 / (1.0 + exp(-(pow(h, 1.35) / (cost / 10000.0) - 38.0) / 12.0)), 2) AS score FROM h")
def value_logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sheet(spark, sf_dir).select("id", S.value_logistic(S.composite("gref", "gref", F.col("p_size"), "cache", "ram"), F.col("price") * 40).alias("score"))


@query(
    f"""WITH {SHEET_SQL} SELECT id, CASE WHEN igpu THEN 'INTEGRATED_SOC' WHEN watts <= 0 THEN 'UNKNOWN_TGP_DGPU' WHEN watts / 115.0 >= 0.9 THEN 'FULL_POWER_GPU' WHEN watts / 115.0 >= 0.7 THEN 'MODERATELY_CAPPED_GPU' ELSE 'HEAVILY_CAPPED_GPU' END AS tier,
CAST(least(100, round_even(watts / 140.0 * 100, 0)) AS INT) AS utilisation FROM sheet"""
)
def power_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sheet(spark, sf_dir).select("id", S.power_tier("watts", F.lit(115.0), "igpu").alias("tier"), S.power_utilisation("watts", F.lit(140.0)).alias("utilisation"))


@query(
    f"""WITH {SHEET_SQL}, a AS (SELECT id, round(greatest(42, least(96, 75.0 + (gref - 75.0) * 1.25)), 1) AS t, round(greatest(42, least(96, 75.0 + (watts - 75.0) * 1.25)), 1) AS n, cache / 5 AS hours, igpu, cores, watts FROM sheet),
b AS (SELECT *, 38.0 + (hours - 2.5) * 7.2 AS raw FROM a),
c AS (SELECT *, round(greatest(45, least(95, CASE WHEN NOT igpu AND (cores >= 55 OR watts >= 115) THEN least(raw, 61.5) WHEN igpu AND hours >= 7 THEN greatest(raw, 86.5) ELSE raw END)), 1) AS battery FROM b)
SELECT id, battery, round(0.30 * t + 0.15 * n + 0.25 * t + 0.15 * n + 0.15 * battery, 4) AS community FROM c"""
)
def aspect_recalibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    battery = S.battery_anchor(F.col("cache") / 5, "igpu", "cores", "watts")
    t, n = S.stretched("gref"), S.stretched("watts")
    return sheet(spark, sf_dir).select("id", battery.alias("battery"), S.community_score({"thermals": t, "acoustics": n, "build": t, "keyboard": n, "battery": battery}, 4).alias("community"))


@query(
    f"""WITH {SHEET_SQL}, w AS (SELECT id, unnest([{{'n': 'light', 'd': 60.0}}, {{'n': 'esports', 'd': 100.0}}, {{'n': 'open_world', 'd': 180.0}}, {{'n': 'path_traced', 'd': 260.0}}]) AS u, gref, cores FROM sheet)
SELECT id, u.n AS workload, least(400.0, round(least(gref * 1.6, cores * 10 * 2.2) * 100.0 / u.d, 1)) AS fps FROM w"""
)
def workload_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    titles = {"light": 60.0, "esports": 100.0, "open_world": 180.0, "path_traced": 260.0}
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("workload"), S.workload_fps("gref", F.col("cores") * 10, d).alias("fps")) for n, d in titles.items()]))
    return sheet(spark, sf_dir).select("id", rows.alias("u")).select("id", "u.*")


@query("SELECT event_type, round(avg(value), 2) AS avg_value, count(*) AS processed, CAST(count(*) FILTER (value > 40) AS BIGINT) AS skipped FROM events GROUP BY 1")
def metrics_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.avg("value"), 2).alias("avg_value"), F.count(F.lit(1)).alias("processed"), F.count_if(F.col("value") > 40).alias("skipped"))


@query(
    """SELECT event_id, TRY_CAST(nullif(regexp_extract(props, '(-?\\d+(?:\\.\\d+)?)', 1), '') AS DOUBLE) AS k, lower(event_type) IN ('true', 'yes', '1', 'y', 'on') AS flag, substr(event_type, 1, 4) AS short,
CAST(len(list_filter(string_split(event_type || ', ,x', ','), lambda x: trim(x) <> '')) AS INT) AS parts FROM events"""
)
def coercions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("event_type")
    return load(spark, sf_dir, "events").select("event_id", N.first_number(F.col("props")).alias("k"), N.truthy(t).alias("flag"), N.shortened(t, 4).alias("short"), F.size(N.listed(F.concat(t, F.lit(", ,x")))).alias("parts"))


@query(
    """WITH v AS (SELECT p_partkey, p_size % 70 AS ram, p_size / 2.0 AS inches FROM part)
SELECT p_partkey, ram IN (4, 8, 12, 16, 20, 24, 32, 36, 40, 48, 64, 96, 128, 192) AS ram_ok, inches BETWEEN 10 AND 18.5 AS inches_ok, CASE WHEN NOT (inches BETWEEN 10 AND 18.5) THEN 'outside 10..18.5' END AS reason FROM v"""
)
def validators(spark: SparkSession, sf_dir: str) -> DataFrame:
    ram, inches = N.validated("ram_gb", F.col("p_size") % 70), N.validated("display_inches", F.col("p_size") / 2.0)
    return load(spark, sf_dir, "part").select("p_partkey", ram["ok"].alias("ram_ok"), inches["ok"].alias("inches_ok"), inches["reason"].alias("reason"))


@query(
    """WITH e AS (SELECT event_id, event_type, value, event_id % 7 = 0 AS unseen, event_id % 5 = 0 AS bad FROM events)
SELECT cause, count(*) AS n FROM (SELECT CASE WHEN event_type = 'view' THEN 'present' WHEN unseen THEN 'not_in_source' WHEN value < 10 THEN 'not_extracted' WHEN bad THEN 'rejected_by_validator' WHEN event_type <> 'click' THEN 'not_enriched' ELSE 'unknown' END AS cause FROM e) GROUP BY 1"""
)
def missing_field_causes(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, t = F.col("event_id"), F.col("event_type")
    cause = N.missing_cause(F.when(t == "view", 1), i % 7 != 0, F.when(F.col("value") >= 10, 1), i % 5 == 0, t == "click")
    return load(spark, sf_dir, "events").select(cause.alias("cause")).groupBy("cause").agg(F.count(F.lit(1)).alias("n"))
