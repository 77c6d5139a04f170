"""Review documents: conversations stand for them, users' turns as posts, assistants' as transcripts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.operators import evidence as E
from marketloom.operators import reviews as R
from marketloom.registry import query
from marketloom.sources.tables import load


def nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, posts, transcripts, comments): arrays of structs in order of turns."""
    c = load(spark, sf_dir, "conversations")
    entry = F.struct("turn", "text", F.col("turn").alias("likes"))
    of = lambda cond: F.array_sort(F.collect_list(F.when(cond, entry)))
    return c.groupBy("conv_id").agg(of(F.col("role") == "user").alias("posts"), of(F.col("role") == "assistant").alias("transcripts"), of((F.col("role") == "user") & (F.col("turn") > 2)).alias("comments"))


CHUNK_SQL = """c AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn, text) - 1 AS p FROM conversations WHERE role IN ('user', 'assistant')),
m AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) - 1 AS p FROM conversations WHERE role = 'user' AND turn > 2),
x AS (SELECT conv_id, CASE role WHEN 'user' THEN 'post' ELSE 'transcript' END AS source, p AS position, trim(text) AS text, CASE role WHEN 'user' THEN 1.0 ELSE 1.15 END AS weight FROM c WHERE p < CASE role WHEN 'user' THEN 25 ELSE 65 END
  UNION ALL SELECT conv_id, 'comment', p, trim(text), 0.95 + least(0.2, turn * 0.01) FROM m WHERE p < 5)"""


@query(f"WITH {CHUNK_SQL} SELECT conv_id, source, CAST(position AS INT) AS position, md5(text) AS digest, CAST(round(weight, 4) AS DOUBLE) AS weight FROM x WHERE text <> ''")
def review_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = R.chunks(nested(spark, sf_dir), "conv_id", {"post": "posts", "transcript": "transcripts", "comment": "comments"})
    return rows.select("conv_id", "source", "position", F.md5("text").alias("digest"), F.round("weight", 4).alias("weight"))


@query("SELECT CAST(count(*) FILTER (role = 'user') AS BIGINT) AS posts, CAST(count(*) FILTER (role = 'assistant') AS BIGINT) AS transcripts, CAST(count(*) FILTER (role = 'user' AND turn > 2) AS BIGINT) AS comments FROM conversations")
def review_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.summary(nested(spark, sf_dir), ["posts", "transcripts", "comments"])


@query("WITH p AS (SELECT s_suppkey, s_nationkey, s_acctbal, unnest([s_suppkey % 40, s_suppkey % 30 + 10]) AS id FROM supplier) SELECT id, arg_max(s_acctbal, (s_suppkey, s_acctbal)) AS s_acctbal, arg_max(s_nationkey, (s_suppkey, s_acctbal)) AS s_nationkey FROM p GROUP BY 1")
def profile_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles spread over all ids they match; the last profile of an id counts."""
    k = F.col("s_suppkey")
    s = load(spark, sf_dir, "supplier").withColumn("ids", F.array(k % 40, k % 30 + 10))
    return R.fanned_out(s, "ids", "s_suppkey", ["s_acctbal", "s_nationkey"])


@query("WITH d AS (SELECT p_type, p_name, min(p_partkey) AS seen FROM part GROUP BY 1, 2) SELECT p_type, (SELECT round(avg(p_retailprice), 2) FROM part p WHERE p.p_type = d.p_type) AS score, string_agg(p_name, ' | ' ORDER BY seen) AS document FROM d GROUP BY 1")
def vector_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged records: mean score and distinct texts."""
    return R.record(load(spark, sf_dir, "part"), "p_type", "p_retailprice", "p_name", ["p_partkey"])


@query(
    """WITH r AS (SELECT o_orderkey AS rank_key, o_custkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice END AS remote FROM orders)
SELECT r.id, rank_key, coalesce(remote, c_acctbal, 75.0) AS score, coalesce(c_mktsegment, 'unknown') AS segment FROM r LEFT JOIN customer ON c_custkey = r.id AND c_acctbal > 0"""
)
def hydrate_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Remote results with local facts: the remote score first, then the local one, then the neutral one."""
    o = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("rank_key"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice")).alias("remote"))
    c = load(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("id"), "c_acctbal", "c_mktsegment")
    return R.hydrated(o, c, "id", {"rank_key": F.col("r.rank_key"), "score": F.coalesce("r.remote", "l.c_acctbal", F.lit(75.0)), "segment": F.coalesce("l.c_mktsegment", F.lit("unknown"))})


@query("SELECT event_id, array_to_string(list_filter([CASE WHEN value < 2 THEN 'low' END, CASE WHEN event_type = 'error' THEN 'failed' END], lambda x: x IS NOT NULL), ',') AS errors FROM events WHERE value < 2 OR event_type = 'error'")
def quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows set aside, with what is wrong with them."""
    _, bad = R.quarantined(load(spark, sf_dir, "events"), {"low": F.col("value") < 2, "failed": F.col("event_type") == "error"})
    return bad.select("event_id", F.array_join("errors", ",").alias("errors"))


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS cost, CAST(count(*) FILTER (CAST(json_extract(props, '$.k') AS INT) > 50) AS BIGINT) AS fallbacks FROM events GROUP BY 1")
def path_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which path how many rows took, and what they cost."""
    return load(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("cost"), F.count_if(F.get_json_object("props", "$.k").cast("int") > 50).alias("fallbacks"))


@query(
    """WITH x AS (SELECT p_partkey, p_size, lower(p_brand) AS b, [lower(p_name), lower(p_brand)] AS a, [upper(p_name), p_type, lower(p_type)] AS c FROM part),
m AS (SELECT *, [a[1]] || CASE WHEN a[2] = a[1] THEN [] ELSE [a[2]] END || CASE WHEN lower(c[2]) IN (a[1], a[2]) THEN [] ELSE [c[2]] END AS merged FROM x)
SELECT p_partkey, array_to_string(CASE WHEN p_size % 4 > 0 AND len(merged) > p_size % 4 THEN merged[1 : p_size % 4] ELSE merged END, ',') AS aligned FROM m"""
)
def bilingual_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bullets merged without repeats; the longer first list is cut to the second one's length."""
    en = R.list_merge(F.array(F.lower("p_name"), F.lower("p_brand")), F.array(F.upper("p_name"), F.col("p_type"), F.lower("p_type")))
    ar = F.slice(F.array(*map(F.lit, "xyz")), 1, F.col("p_size") % 4)
    return load(spark, sf_dir, "part").select("p_partkey", F.array_join(R.aligned(en, ar), ",").alias("aligned"))


ASPECT_WORDS = {"thermals": (["the"], ["der"]), "acoustics": (["und"], ["die"]), "build": (["sta"], ["men"]), "keyboard": (["and"], ["osl"]), "battery": (["tio"], ["ver"])}


@query(
    """WITH e AS (SELECT conv_id, lower(coalesce(text, '')) AS t, turn, a.aspect, ((turn * 7 + conv_id + a.k * 3) % 11) / 16.0 AS pro, ((turn * 5 + conv_id * 3 + a.k) % 13) / 32.0 AS con, a.yes, a.no
  FROM conversations, (VALUES (0, 'thermals', 'the', 'der'), (1, 'acoustics', 'und', 'die'), (2, 'build', 'sta', 'men'), (3, 'keyboard', 'and', 'osl'), (4, 'battery', 'tio', 'ver')) a(k, aspect, yes, no) WHERE conv_id % 5 <> 4),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, aspect ORDER BY pro DESC) AS p, row_number() OVER (PARTITION BY conv_id, aspect ORDER BY con DESC) AS c FROM e),
g AS (SELECT conv_id, aspect, count(*) AS n, avg(pro) FILTER (p <= 5) - avg(con) FILTER (c <= 5) AS diff, sum(CAST(contains(t, yes) AS INT)) - sum(CAST(contains(t, no) AS INT)) AS said FROM r GROUP BY 1, 2),
i AS (SELECT DISTINCT conv_id, conv_id % 3 = 0 AS gaming, conv_id % 4 < 2 AS metal, CASE conv_id % 6 WHEN 0 THEN 50 WHEN 1 THEN 70 WHEN 2 THEN 60 WHEN 3 THEN 70 WHEN 4 THEN 56 ELSE 66 END AS wh FROM conversations),
b AS (SELECT conv_id, aspect, CASE aspect WHEN 'thermals' THEN CASE WHEN gaming THEN 73 ELSE 76 END WHEN 'acoustics' THEN CASE WHEN gaming THEN 66 ELSE 76 END WHEN 'build' THEN CASE WHEN metal THEN 82 ELSE 73 END WHEN 'keyboard' THEN CASE WHEN metal THEN 76 ELSE 74 END
  ELSE CASE WHEN NOT gaming AND wh >= 65 THEN 77 WHEN gaming AND wh <= 58 THEN 62 ELSE 70 END END AS prior FROM i, (VALUES ('thermals'), ('acoustics'), ('build'), ('keyboard'), ('battery')) a(aspect))
SELECT b.conv_id, b.aspect, CAST(round(CASE WHEN n IS NULL THEN prior ELSE greatest(35, least(95, prior + (diff * 155 + said * 3.2) * least(1, greatest(0.35, n / 14.0)))) END, 1) AS DOUBLE) AS score FROM b LEFT JOIN g USING (conv_id, aspect)"""
)
def aspect_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every conversation's product without a language model; every fifth has no evidence."""
    c, k = load(spark, sf_dir, "conversations"), F.col("conv_id")
    pick = lambda values, n: F.get(F.array(*[F.lit(v) for v in values]), (k % n).cast("int"))
    items = c.select("conv_id").distinct().select("conv_id", pick(["Gaming", None, "Office"], 3).alias("category"), pick(["GTX 1650", "Iris Xe", None], 3).alias("gpu"), pick([50.0, 70.0, 60.0, 0.0, None, 66.0], 6).alias("battery_whr"), pick([True, None, False, False], 4).alias("verified_metal"), pick([None, "Aluminum", "plastic", None], 4).alias("material"))
    sim = lambda at: F.named_struct(F.lit("pro"), F.pmod(F.col("turn") * 7 + k + at * 3, F.lit(11)) / 16.0, F.lit("con"), F.pmod(F.col("turn") * 5 + k * 3 + at, F.lit(13)) / 32.0)
    sims = F.create_map(*[x for at, a in enumerate(ASPECT_WORDS) for x in (F.lit(a), sim(at))])
    return E.aspect_scores(items, c.where("conv_id % 5 != 4").select("conv_id", "text", sims.alias("sims")), "conv_id", ASPECT_WORDS)
