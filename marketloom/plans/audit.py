"""The audit of review evidence: turns of conversations as sources of every kind, a product each; every seventh product of the catalog has none."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.operators import audit as A
from marketloom.plans.text import ASPECTS, CONS, FEATURE_SQL, HIT, NORM, PROS, _aspect_sql
from marketloom.registry import query
from marketloom.sources.tables import load

CRITICAL = ["thermals", "build", "battery", "display"]
KIND = "CASE turn % 5 WHEN 0 THEN 'editorial' WHEN 1 THEN 'discussion' WHEN 2 THEN 'transcript' WHEN 3 THEN 'comment' ELSE 'profile' END"
#: Turn 5 repeats the name of turn 0, and turn 6 that of turn 1.
NAME = "CASE WHEN turn = 7 THEN NULL ELSE concat('d', CAST(turn % 5 AS STRING)) END"
SAID = "CASE WHEN turn % 5 IN (0, 4) THEN {0} END"
PRO, CON = SAID.format("substr(text, 1, 90)"), SAID.format("substr(text, 91, 90)")
BODY = "CASE WHEN turn % 5 = 2 AND conv_id % 4 = 0 THEN concat('[Synthesized from] ', text) WHEN turn % 5 = 3 AND conv_id % 3 = 0 THEN 'short' WHEN turn % 5 = 0 AND conv_id % 2 = 0 THEN substr(text, 1, 90) ELSE text END"

_SENTENCES = "list_filter(list_transform(string_split_regex(trim(body), '[.!؟\\n]\\s+'), lambda x: trim(x)), lambda x: length(x) >= 20)"
_CUT = f"flatten(list_transform({_SENTENCES}, lambda x: CASE WHEN len(string_split(x, ' ')) > 45 THEN list_transform(range(0, (len(string_split(x, ' ')) - 1) // 35 + 1), lambda i: array_to_string(string_split(x, ' ')[i * 35 + 1 : i * 35 + 35], ' ')) ELSE [x] END))"
_SCORE = f"(len({_aspect_sql(NORM.format('c'))}) * 3 + {HIT(NORM.format('c'), CONS + PROS)})"
_SAID = lambda x, p: f"{{'text': {x}, 'explicit': '{p}'}}"
_PLAIN = lambda xs: f"list_transform({xs}, lambda t: {{'text': t, 'explicit': CAST(NULL AS VARCHAR)}})"
CHUNKS = f"""src AS (SELECT conv_id, turn, {KIND} AS kind, {NAME} AS doc, {PRO} AS pro, {CON} AS con, {BODY} AS body FROM conversations),
real AS (SELECT * FROM src WHERE NOT (kind = 'transcript' AND starts_with(trim(body), '[Synthesized from'))),
once AS (SELECT *, {_CUT} AS all_ FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, kind, coalesce(doc, '#' || turn) ORDER BY turn) AS rn FROM real) WHERE rn = 1),
picked AS (SELECT *, list_transform(list_sort(list_transform(list_sort(list_transform(all_, lambda c, i: {{'s': -{_SCORE}, 'i': i, 'c': c}}))[1:3], lambda x: {{'i': x.i, 'c': x.c}})), lambda x: x.c) AS best FROM once),
arrs AS (SELECT conv_id, turn AS pos, kind, CASE kind WHEN 'editorial' THEN [{_SAID('pro', 'pro')}, {_SAID('con', 'con')}] || CASE WHEN trim(body) <> '' THEN {_PLAIN('[trim(body)]')} ELSE [] END
  WHEN 'profile' THEN [{_SAID('pro', 'pro')}, {_SAID('con', 'con')}] WHEN 'discussion' THEN {_PLAIN('all_[1:5]')} WHEN 'transcript' THEN {_PLAIN('best')} ELSE CASE WHEN length(trim(body)) >= 20 THEN {_PLAIN('[trim(body)]')} ELSE [] END END AS c FROM picked),
chunks AS MATERIALIZED (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY pos, n) AS turn, pos, kind, e.text AS text, e.explicit AS explicit FROM (SELECT conv_id, pos, kind, unnest(c) AS e, unnest(range(len(c))) AS n FROM arrs)),
{FEATURE_SQL.replace('FROM conversations', 'FROM chunks')}, c AS (SELECT conv_id, turn, {NORM.format('text')} AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM chunks),
near AS (SELECT b.conv_id, b.turn, list(a.turn) AS alike FROM (SELECT a.conv_id, a.turn AS x, b.turn AS y, sum(a.n * b.n) AS dot FROM f a JOIN f b ON a.conv_id = b.conv_id AND a.turn < b.turn AND b.feature = a.feature GROUP BY 1, 2, 3) d
  JOIN m a ON a.conv_id = d.conv_id AND a.turn = x JOIN m b ON b.conv_id = d.conv_id AND b.turn = y WHERE dot / (a.norm * b.norm) > 0.90 GROUP BY 1, 2),
e AS MATERIALIZED (SELECT c.conv_id, c.turn, k, length(t) < 8 AS short, coalesce(alike, []) AS alike, row_number() OVER (PARTITION BY c.conv_id, t ORDER BY c.turn) > 1 AS again FROM c LEFT JOIN near USING (conv_id, turn)),
r AS (SELECT conv_id, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS turn, '' AS fate, CAST([] AS BIGINT[]) AS kept FROM e WHERE k = 1
  UNION ALL SELECT e.conv_id, e.k, e.turn, CASE WHEN short THEN 'short' WHEN again THEN 'exact' WHEN list_has_any(alike, kept) THEN 'near' ELSE 'kept' END, CASE WHEN short OR again OR list_has_any(alike, kept) THEN kept ELSE list_append(kept, CAST(e.turn AS BIGINT)) END
  FROM r JOIN e ON e.conv_id = r.conv_id AND e.k = r.k + 1),
tagged AS MATERIALIZED (SELECT x.*, fate, coalesce(explicit, CASE WHEN {HIT(NORM.format('text'), CONS)} > {HIT(NORM.format('text'), PROS)} THEN 'con' ELSE 'pro' END) AS p, {_aspect_sql(NORM.format('text'))} AS a FROM chunks x JOIN r USING (conv_id, turn) WHERE k > 0)"""
_COVER = lambda f: f"coalesce(list_sort(list_distinct(flatten(list(a) FILTER (fate = 'kept'{f})))), [])"
PER = f"""dc AS (SELECT conv_id, count(*) FILTER (kind = 'editorial') AS ed, count(*) FILTER (kind = 'discussion') AS di, count(*) FILTER (kind = 'transcript' AND EXISTS (SELECT 1 FROM chunks h WHERE h.conv_id = o.conv_id AND h.pos = o.turn)) AS tr FROM once o GROUP BY 1),
tc AS (SELECT conv_id, count(*) FILTER (kind = 'comment') AS comments, count(*) FILTER (fate = 'kept') AS kept, count(*) FILTER (fate = 'exact') AS exact, count(*) FILTER (fate = 'near') AS near, count(*) FILTER (fate = 'kept' AND p = 'pro') AS pros, count(*) FILTER (fate = 'kept' AND p = 'con') AS cons,
  count(*) FILTER (fate = 'kept' AND p = 'pro' AND kind <> 'profile') AS sp, count(*) FILTER (fate = 'kept' AND p = 'con' AND kind <> 'profile') AS sc, {_COVER('')} AS covered, {_COVER(" AND kind <> 'profile'")} AS scraped FROM tagged GROUP BY 1),
cat AS (SELECT c_custkey AS conv_id FROM customer WHERE c_custkey % 7 = 0 UNION SELECT conv_id FROM dc),
z AS (SELECT conv_id AS chassis, dc.conv_id IS NOT NULL AS reviewed, coalesce(ed, 0) + coalesce(di, 0) + coalesce(tr, 0) AS docs, coalesce(comments, 0) AS comments, coalesce(kept, 0) AS kept, coalesce(exact, 0) AS exact, coalesce(near, 0) AS near, coalesce(pros, 0) AS pros, coalesce(cons, 0) AS cons, coalesce(sp, 0) AS sp, coalesce(sc, 0) AS sc,
  coalesce(covered, []) AS covered, list_filter(['thermals', 'build', 'battery', 'display'], lambda x: NOT list_contains(coalesce(covered, []), x)) AS missing, list_filter(['thermals', 'build', 'battery', 'display'], lambda x: NOT list_contains(coalesce(scraped, []), x)) AS lacking FROM cat LEFT JOIN dc USING (conv_id) LEFT JOIN tc USING (conv_id)),
g AS (SELECT *, list_filter([CASE WHEN sp = 0 AND pros < 2 THEN 'Pros' WHEN docs > 0 AND sp = 0 THEN 'Scraped Pros' END, CASE WHEN sc = 0 AND cons < 2 THEN 'Cons' WHEN docs > 0 AND sc = 0 THEN 'Scraped Cons' WHEN cons < 2 THEN 'Cons (<2)' END], lambda x: x IS NOT NULL) AS gaps FROM z),
per AS (SELECT *, CASE WHEN docs <= 1 THEN 'High Priority' WHEN len(gaps) + len(missing) + len(lacking) > 0 THEN 'Medium Priority' ELSE 'OK' END AS priority FROM g)"""


def audit(spark: SparkSession, sf_dir: str) -> A.Audit:
    t = load(spark, sf_dir, "conversations")
    said = lambda e: F.when(F.expr(e).isNotNull(), F.array(F.expr(e)))
    docs = t.select(F.col("conv_id").alias("chassis"), F.col("turn").alias("position"), F.expr(KIND).alias("kind"), F.expr(NAME).alias("doc"), said(PRO).alias("pros"), said(CON).alias("cons"), F.expr(BODY).alias("body"))
    catalog = load(spark, sf_dir, "customer").where("c_custkey % 7 = 0").select(F.col("c_custkey").alias("chassis"))
    return A.audited(docs, catalog, ASPECTS, PROS, CONS, CRITICAL, most_transcript=3)


@query(f"WITH RECURSIVE {CHUNKS}, {PER} SELECT chassis, reviewed, docs, comments, kept, exact, near, pros, cons, array_to_string(covered, ',') AS covered, array_to_string(missing, ',') AS missing, array_to_string(lacking, ',') AS missing_scraped, array_to_string(gaps, ',') AS gaps, priority FROM per")
def review_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every product with its evidence by polarity, what covers which aspect, gaps and priority."""
    text = lambda c: F.array_join(c, ",").alias(c)
    return audit(spark, sf_dir).chassis.select("chassis", "reviewed", "docs", "comments", "kept", "exact", "near", "pros", "cons", text("covered"), text("missing"), text("missing_scraped"), text("gaps"), "priority")


@query(
    f"""WITH RECURSIVE {CHUNKS}, {PER} SELECT unnest(['chassis', 'unmatched', 'no_doc', 'one_doc', 'high', 'medium', 'complete', 'missing_display', 'missing_scraped_thermals', 'input_chunks', 'kept_chunks', 'exact_removed', 'near_removed', 'explicit_chunks', 'synthesized_stripped']) AS name, unnest([count(*), count(*) FILTER (NOT reviewed), count(*) FILTER (docs = 0), count(*) FILTER (docs = 1), count(*) FILTER (priority = 'High Priority'), count(*) FILTER (priority = 'Medium Priority'), count(*) FILTER (priority = 'OK'), count(*) FILTER (list_contains(missing, 'display')), count(*) FILTER (list_contains(lacking, 'thermals')),
(SELECT count(*) FROM tagged), (SELECT count(*) FROM tagged WHERE fate = 'kept'), (SELECT count(*) FROM tagged WHERE fate = 'exact'), (SELECT count(*) FROM tagged WHERE fate = 'near'), (SELECT count(*) FROM tagged WHERE fate = 'kept' AND explicit IS NOT NULL), (SELECT count(*) FROM src) - (SELECT count(*) FROM real)]) AS n FROM per"""
)
def review_audit_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the run counted while it wrote its tables."""
    names = ["chassis", "unmatched", "no_doc", "one_doc", "high", "medium", "complete", "missing_display", "missing_scraped_thermals", "input_chunks", "kept_chunks", "exact_removed", "near_removed", "explicit_chunks", "synthesized_stripped"]
    totals = audit(spark, sf_dir).totals
    return spark.createDataFrame([(n, totals[n]) for n in names], "name string, n long")
