"""Vector evidence over embeddings: label parity stands for polarity, labels for items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.operators import vectors as V
from marketloom.registry import query
from marketloom.sources.tables import load

SIM_SQL = """q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0),
s AS (SELECT vec_id, label, CASE WHEN vec_id % 2 = 0 THEN 'pro' ELSE 'con' END AS polarity, greatest(0, list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[]))) AS similarity FROM embeddings, q)"""


def sims(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "embeddings")
    s = V.similarity(e, "embedding", e.where("vec_id = 0"))
    return s.withColumn("polarity", F.when(F.col("vec_id") % 2 == 0, "pro").otherwise("con"))


@query(f"WITH {SIM_SQL} SELECT vec_id, polarity, round(similarity, 6) AS similarity FROM s")
def dual_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sims(spark, sf_dir).select("vec_id", "polarity", F.round("similarity", 6).alias("similarity"))


ADJUSTED_SQL = SIM_SQL + """, g AS (SELECT label, coalesce(max(similarity) FILTER (polarity = 'pro'), 0) AS pro, coalesce(max(similarity) FILTER (polarity = 'con'), 0) AS con FROM s GROUP BY 1), n AS (SELECT *, pro - 0.75 * con AS net, greatest(35, least(98, 75 + 32 * (pro - 0.75 * con))) AS score FROM g)"""


@query(f"WITH {ADJUSTED_SQL} SELECT label, round(pro, 5) AS pro, round(con, 5) AS con, round(net, 5) AS net, round(score, 4) AS score FROM n")
def adjusted_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = V.adjusted(sims(spark, sf_dir), "label")
    return a.select("label", *[F.round(c, 5).alias(c) for c in ("pro", "con", "net")], F.round("score", 4).alias("score"))


@query(
    f"""WITH {ADJUSTED_SQL}, r AS (SELECT net, row_number() OVER (ORDER BY net DESC) AS k, count(*) OVER () AS c FROM n),
d AS (SELECT CASE WHEN any_value(c) > 5 THEN avg(net) FILTER (k <= 5) - median(net) FILTER (k > 5) ELSE max(net) - median(net) END AS spread FROM r)
SELECT round(greatest(0, spread), 5) AS spread, round(0.10 + greatest(0, least(1, (greatest(0, spread) - 0.08) / 0.18)) * 0.15, 5) AS weight FROM d"""
)
def dynamic_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = V.dynamic_weight(V.adjusted(sims(spark, sf_dir), "label"), "net")
    return d.select(F.round("spread", 5).alias("spread"), F.round("weight", 5).alias("weight"))


@query(f"WITH {SIM_SQL}, b AS (SELECT label, max(similarity) AS m FROM s WHERE vec_id <> 0 GROUP BY 1) SELECT label, CASE WHEN m >= 0.2 THEN round((m - 0.45) * 0.35, 3) ELSE 0 END::DOUBLE AS boost FROM b")
def weight_boosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sims(spark, sf_dir).where("vec_id != 0").groupBy("label").agg(F.max("similarity").alias("m")).select("label", V.boost(F.col("m"), 0.2).alias("boost"))


MEAN_SQL = """x AS (SELECT label, CAST(generate_subscripts(embedding, 1) AS INT) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings), a AS (SELECT label AS anchor, list(m ORDER BY i) AS mean FROM (SELECT label, i, avg(x) AS m FROM x GROUP BY 1, 2) GROUP BY 1)"""


@query(f"WITH {MEAN_SQL}, s AS (SELECT vec_id, anchor, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), mean), 9) AS s FROM embeddings, a) SELECT vec_id, arg_min(anchor, (-s, anchor)) AS anchor, round(max(s), 6) AS similarity FROM s GROUP BY 1")
def anchor_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector's nearest label centre."""
    e = load(spark, sf_dir, "embeddings")
    anchors = V.means(e, "label", "embedding").withColumnRenamed("label", "anchor")  # as many rows as labels
    return V.anchored(e, "vec_id", "embedding", anchors, "anchor", "mean").select("vec_id", "anchor", F.round("similarity", 6).alias("similarity"))


@query("SELECT vec_id, CASE WHEN vec_id % 4 = 0 THEN 'new' ELSE 'old' END AS version, label FROM embeddings UNION ALL SELECT vec_id + 1000000, 'new', label FROM embeddings WHERE vec_id % 4 = 0")
def vector_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New versions of some vectors and some new vectors, merged into the table by id."""
    from marketloom.sources.catalogs import replace_keyed

    e = load(spark, sf_dir, "embeddings").select("vec_id", "label")
    some = e.where("vec_id % 4 = 0")
    new = some.unionByName(some.withColumn("vec_id", F.col("vec_id") + 1_000_000)).select("vec_id", F.lit("new").alias("version"), "label")
    return replace_keyed(e.select("vec_id", F.lit("old").alias("version"), "label"), new, ["vec_id"])


@query(
    """WITH RECURSIVE e AS MATERIALIZED (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k FROM embeddings),
near AS (SELECT b.vec_id, list(a.vec_id) AS alike FROM e a JOIN e b ON a.label = b.label AND a.vec_id < b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.88 GROUP BY 1),
x AS MATERIALIZED (SELECT e.vec_id, label, k, coalesce(alike, []) AS alike FROM e LEFT JOIN near USING (vec_id)),
r AS (SELECT label, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS vec_id, FALSE AS stays, CAST([] AS BIGINT[]) AS kept FROM x WHERE k = 1
  UNION ALL SELECT x.label, x.k, x.vec_id, NOT list_has_any(alike, kept), CASE WHEN list_has_any(alike, kept) THEN kept ELSE list_append(kept, CAST(x.vec_id AS BIGINT)) END FROM r JOIN x ON x.label = r.label AND x.k = r.k + 1)
SELECT label, vec_id FROM r WHERE stays"""
)
def dense_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of each label without those nearly equal to an earlier kept one."""
    return V.dense_dedup(load(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding")


def _picks_sql(rounds: int, each: int, veto: float) -> str:
    steps = ["l0 AS MATERIALIZED (SELECT s.vec_id, label, polarity, round(similarity, 6) AS sim, CAST(embedding AS DOUBLE[]) AS e, 0 AS n FROM s JOIN (SELECT vec_id, embedding FROM embeddings) USING (vec_id))"]
    for k in range(rounds):
        steps.append(f"p{k} AS MATERIALIZED (SELECT * EXCLUDE (o) FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY CAST(n >= {each} AS INT), CASE WHEN n < {each} THEN polarity ELSE '' END, sim DESC, vec_id) AS o FROM l{k}) WHERE o = 1)")
        steps.append(f"l{k + 1} AS MATERIALIZED (SELECT l.vec_id, l.label, l.polarity, l.sim, l.e, l.n + CAST(l.polarity = p.polarity AS INT) AS n FROM l{k} l JOIN p{k} p USING (label) WHERE l.vec_id <> p.vec_id AND list_cosine_similarity(l.e, p.e) <= {veto})")
    return f"WITH {SIM_SQL}, {', '.join(steps)} " + " UNION ALL ".join(f"SELECT vec_id, label, polarity FROM p{k}" for k in range(rounds))


@query(_picks_sql(6, 2, 0.35))
def aspect_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two vectors of each polarity and then the best, six a label, none too like another (these vectors are far apart, so the bound is low)."""
    s = sims(spark, sf_dir).withColumn("similarity", F.round("similarity", 6))
    return V.per_aspect(s, "label", "polarity", "similarity", "vec_id", "embedding", 2, 6, 0.35).select("vec_id", "label", "polarity")
