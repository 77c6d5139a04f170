"""Review profiles of parts taken in by batches: states and outbox in one commit, a batch repeated."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.operators import ingest as I
from marketloom.registry import query
from marketloom.sources.commits import current, table
from marketloom.sources.scratch import scratch_path
from marketloom.sources.tables import load

#: Entries over k, the part's number, in SQL that Spark and DuckDB read alike; each names its own id and the next one.
SCORE, EVIDENCE, SOURCES = "CASE k % 4 WHEN 0 THEN NULL ELSE CAST(p_size AS DOUBLE) + 30 END", "CASE k % 5 WHEN 0 THEN 0 WHEN 1 THEN NULL ELSE k % 9 END", "k % 3"
REAL, RAW, SCRAPED, FILLED, CHUNKS = "CASE k % 11 WHEN 0 THEN FALSE WHEN 1 THEN TRUE END", "k % 6 = 0", "CASE k % 7 WHEN 0 THEN 0 WHEN 1 THEN 2 END", "k % 8 = 1", "k % 10"


def _batch(which: str) -> str:
    """Entries of a batch with their states: nested profiles where k % 2 = 1."""
    nested = "CASE WHEN real IS FALSE OR (evidence = 0 AND n = 0) OR (raw AND n = 0) THEN {'s': 75.0::DOUBLE, 'e': 0::BIGINT, 'n': 0::BIGINT, 'r': FALSE} ELSE {'s': score, 'e': evidence::BIGINT, 'n': n, 'r': TRUE} END"
    flat = "CASE WHEN real IS FALSE OR (n = 0 AND (coalesce(evidence = 0, FALSE) OR (coalesce(scraped = 0, FALSE) AND evidence IS NULL))) THEN {'s': 75.0::DOUBLE, 'e': 0::BIGINT, 'n': 0::BIGINT, 'r': FALSE} WHEN NOT filled AND score IS NULL THEN CASE WHEN n > 0 THEN {'s': 75.0::DOUBLE, 'e': 0::BIGINT, 'n': 0::BIGINT, 'r': FALSE} END ELSE {'s': score, 'e': coalesce(evidence, chunks)::BIGINT, 'n': n, 'r': TRUE} END"
    return f"""SELECT id, arg_max(s, k) AS s FROM (SELECT unnest([k, k + 1]) AS id, k, CASE WHEN k % 2 = 1 THEN {nested} ELSE {flat} END AS s FROM
(SELECT k, {SCORE} AS score, {EVIDENCE} AS evidence, CAST({SOURCES} AS BIGINT) AS n, {REAL} AS real, {RAW} AS raw, {SCRAPED} AS scraped, {FILLED} AS filled, {CHUNKS} AS chunks FROM (SELECT *, p_partkey AS k FROM part) WHERE {which})) WHERE s IS NOT NULL AND id IN (SELECT p_partkey FROM part WHERE p_partkey % 13 > 0) GROUP BY 1"""


@query(
    f"""WITH a AS ({_batch('k % 3 = 0')}), b AS ({_batch('k % 4 < 3 AND k % 3 > 0')}), m AS (SELECT id, s FROM b UNION ALL SELECT id, s FROM a WHERE id NOT IN (SELECT id FROM b))
SELECT CAST(id AS VARCHAR) AS id, s.s AS score, s.e AS evidence, s.n AS sources, s.r AS reviewed, (SELECT count(*) FROM a WHERE a.id = m.id) + (SELECT count(*) FROM b WHERE b.id = m.id) AS events FROM m"""
)
def review_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of every id after two batches, the second of them twice, and its events."""
    root = scratch_path(spark, "store")
    x = load(spark, sf_dir, "part").withColumn("k", F.col("p_partkey")).select("k", *[F.expr(e).alias(c) for c, e in {"score": SCORE, "evidence": EVIDENCE, "sources": SOURCES, "real": REAL, "raw": RAW, "scraped_docs": SCRAPED, "filled": FILLED, "chunks": CHUNKS}.items()])
    odd = F.col("k") % 2 == 1
    nested = F.when(odd, F.struct("score", F.col("evidence").cast("long").alias("evidence"), "real"))
    entries = x.withColumns({"profile": nested, "ids": F.array(F.col("k").cast("string"), (F.col("k") + 1).cast("string")), "position": F.col("k")})
    known = x.where("k % 13 > 0").select(F.col("k").cast("string").alias("id"))
    I.ingest(spark, root, "a", entries.where("k % 3 = 0"), known)
    for _ in range(2):
        I.ingest(spark, root, "b", entries.where("k % 4 < 3 AND k % 3 > 0"), known)
    at = current(spark, root)
    events = table(spark, root, "outbox", I.OUTBOX, at).groupBy(F.get_json_object("payload", "$.id").alias("id")).agg(F.count_distinct("message_id").alias("events"))
    return table(spark, root, "states", I.STATE, at).join(events, "id", "left")
