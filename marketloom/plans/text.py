"""Text evidence over documents, conversations and their labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.operators import evidence as E
from marketloom.registry import query
from marketloom.sources.tables import load

#: Frequent words of these texts, in the place of real aspect and signal words.
ASPECTS = {"thermals": ["then", "der"], "build": ["stand", "ment"], "battery": ["tion", "ver"], "display": ["queue", "über"], "keyboard": ["ando", "osla"]}
PROS, CONS = ["the", "la ", "und"], ["not", "zu ", "que"]
NORM = "lower(trim(regexp_replace({0}, '\\s+', ' ', 'g')))"
HIT = lambda c, ws: " + ".join(f"CAST(contains({c}, '{w}') AS INT)" for w in ws)


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents")


@query(f"SELECT doc_id, md5({NORM.format('text')}) AS digest, length({NORM.format('text')}) AS n FROM documents")
def normalise_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = E.normalised(F.col("text"))
    return docs(spark, sf_dir).select("doc_id", F.md5(n).alias("digest"), F.length(n).cast("long").alias("n"))


@query(
    """WITH s AS (SELECT conv_id, turn, list_filter(list_transform(string_split_regex(text, '[.!؟\\n]\\s+'), lambda x: trim(x)), lambda x: length(x) >= 20) AS s FROM conversations),
c AS (SELECT conv_id, turn, flatten(list_transform(s, lambda x: CASE WHEN len(string_split(x, ' ')) > 45 THEN list_transform(range(0, (len(string_split(x, ' ')) - 1) // 35 + 1), lambda i: array_to_string(string_split(x, ' ')[i * 35 + 1 : i * 35 + 35], ' ')) ELSE [x] END))[1:8] AS c FROM s)
SELECT conv_id, turn, CAST(len(c) AS INT) AS n_chunks, coalesce(md5(array_to_string(c, '|')), '') AS digest FROM c"""
)
def sentence_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = E.sentence_chunks(F.col("text"))
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(c).alias("n_chunks"), F.md5(F.array_join(c, "|")).alias("digest"))


def _aspect_sql(col: str) -> str:
    return "list_filter([" + ", ".join("CASE WHEN " + " OR ".join(f"contains({col}, '{w}')" for w in ws) + f" THEN '{a}' END" for a, ws in ASPECTS.items()) + "], lambda x: x IS NOT NULL)"


@query(f"SELECT doc_id, array_to_string({_aspect_sql('lower(text)')}, ',') AS aspects, CASE WHEN {HIT('lower(text)', CONS)} > {HIT('lower(text)', PROS)} THEN 'con' ELSE 'pro' END AS polarity FROM documents")
def aspect_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.lower("text")
    return docs(spark, sf_dir).select("doc_id", F.array_join(E.aspects(t, ASPECTS), ",").alias("aspects"), E.polarity(t, PROS, CONS).alias("polarity"))


@query(f"SELECT role, CASE WHEN turn = 0 THEN 'pro' WHEN {HIT('lower(text)', CONS)} > {HIT('lower(text)', PROS)} THEN 'con' ELSE 'pro' END AS polarity, count(*) AS n FROM conversations GROUP BY 1, 2")
def polarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = E.polarity(F.lower("text"), PROS, CONS, F.when(F.col("turn") == 0, "pro"))
    return load(spark, sf_dir, "conversations").select("role", p.alias("polarity")).groupBy("role", "polarity").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source, {NORM.format('text')} ORDER BY doc_id) AS n FROM documents WHERE length({NORM.format('text')}) >= 8) WHERE n = 1")
def exact_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.exact_duplicates(docs(spark, sf_dir), ["source"], "text", ["doc_id"]).select("doc_id", "source")


FEATURE_SQL = f"""t AS (SELECT conv_id, turn, ' ' || trim(regexp_replace({NORM.format('text')}, '[^\\p{{L}}\\p{{N}}_\\x{{0600}}-\\x{{06FF}}]+', ' ', 'g')) || ' ' AS t FROM conversations),
f AS MATERIALIZED (SELECT conv_id, turn, feature, count(*) AS n FROM (SELECT conv_id, turn, unnest(list_transform(list_filter(string_split(trim(t), ' '), lambda w: w <> ''), lambda w: 'w:' || w)) AS feature FROM t
  UNION ALL SELECT conv_id, turn, unnest(list_transform(range(1, length(t) - 1), lambda k: 'c:' || substr(t, k, 3))) FROM t WHERE length(t) >= 3 UNION ALL SELECT conv_id, turn, unnest(list_transform(range(1, length(t) - 2), lambda k: 'c:' || substr(t, k, 4))) FROM t WHERE length(t) >= 4) GROUP BY 1, 2, 3),
m AS MATERIALIZED (SELECT conv_id, turn, sqrt(sum(n * n)) AS norm FROM f GROUP BY 1, 2)"""


@query(f"WITH {FEATURE_SQL} SELECT conv_id, turn, count(*) AS features, CAST(sum(n) AS BIGINT) AS total, CAST(max(n) AS BIGINT) AS most FROM f GROUP BY 1, 2")
def feature_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", E.feature_sizes(F.col("text")).alias("f")).select("conv_id", "turn", "f.*")


@query(
    f"""WITH {FEATURE_SQL}, d AS (SELECT a.conv_id, a.turn, sum(a.n * b.n) AS dot FROM f a JOIN f b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 AND b.feature = a.feature GROUP BY 1, 2)
SELECT x.conv_id, x.turn, round(coalesce(dot / (x.norm * y.norm), 0), 6) AS cosine FROM m x JOIN m y ON y.conv_id = x.conv_id AND y.turn = x.turn + 1 LEFT JOIN d ON d.conv_id = x.conv_id AND d.turn = x.turn"""
)
def sparse_cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How alike each turn is to the next one of its conversation."""
    return E.next_cosines(load(spark, sf_dir, "conversations"), "conv_id", "turn", "text").withColumn("cosine", F.round("cosine", 6))


@query(
    f"""WITH RECURSIVE {FEATURE_SQL}, c AS (SELECT conv_id, turn, {NORM.format('text')} AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
near AS (SELECT b.conv_id, b.turn, list(a.turn) AS alike FROM (SELECT a.conv_id, a.turn AS x, b.turn AS y, sum(a.n * b.n) AS dot FROM f a JOIN f b ON a.conv_id = b.conv_id AND a.turn < b.turn AND b.feature = a.feature GROUP BY 1, 2, 3) d
  JOIN m a ON a.conv_id = d.conv_id AND a.turn = x JOIN m b ON b.conv_id = d.conv_id AND b.turn = y WHERE dot / (a.norm * b.norm) > 0.90 GROUP BY 1, 2),
e AS MATERIALIZED (SELECT c.conv_id, c.turn, k, length(t) < 8 AS short, coalesce(alike, []) AS alike, row_number() OVER (PARTITION BY c.conv_id, t ORDER BY c.turn) > 1 AS again FROM c LEFT JOIN near USING (conv_id, turn)),
r AS (SELECT conv_id, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS turn, '' AS fate, CAST([] AS BIGINT[]) AS kept FROM e WHERE k = 1
  UNION ALL SELECT e.conv_id, e.k, e.turn, CASE WHEN short THEN 'short' WHEN again THEN 'exact' WHEN list_has_any(alike, kept) THEN 'near' ELSE 'kept' END, CASE WHEN short OR again OR list_has_any(alike, kept) THEN kept ELSE list_append(kept, CAST(e.turn AS BIGINT)) END
  FROM r JOIN e ON e.conv_id = r.conv_id AND e.k = r.k + 1)
SELECT conv_id, CAST(turn AS INT) AS turn, fate FROM r WHERE k > 0"""
)
def near_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of each conversation without (nearly) repeated ones."""
    return E.near_duplicates(load(spark, sf_dir, "conversations"), ["conv_id"], ["conv_id", "turn"], "text", ["turn"])


CHUNK_SQL = f"c AS (SELECT conv_id, turn, CAST(3 * len({_aspect_sql('lower(text)')}) + {HIT('lower(text)', PROS)} AS INT) AS score FROM conversations)"


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.lower("text")
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", (3 * F.size(E.aspects(t, ASPECTS)) + E.hits(t, PROS)).alias("score"))


@query(f"WITH {CHUNK_SQL} SELECT conv_id, turn, score FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, turn) AS n FROM c) WHERE n <= 3")
def chunk_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.best_chunks(_chunks(spark, sf_dir), ["conv_id"], F.col("score"), "turn", 3)


@query(
    f"""WITH {CHUNK_SQL}, b AS (SELECT *, CASE WHEN n * 3 <= s THEN 0 WHEN n * 3 <= s * 2 THEN 1 ELSE 2 END AS bucket FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, count(*) OVER (PARTITION BY conv_id) AS s FROM c)),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, bucket ORDER BY score DESC, turn) AS r FROM b)
SELECT conv_id, turn, CAST(bucket AS INT) AS bucket FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY CAST(r > 1 AS INT), score DESC, turn) AS f FROM r) WHERE f <= 4"""
)
def diversity_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.diverse(_chunks(spark, sf_dir), ["conv_id"], "turn", "score", 1, 4).select("conv_id", "turn", "bucket")


AUDIT_SQL = f"""d AS (SELECT source, {_aspect_sql('lower(text)')} AS a, CASE WHEN {HIT('lower(text)', CONS)} > {HIT('lower(text)', PROS)} THEN 'con' ELSE 'pro' END AS p FROM documents),
u AS (SELECT DISTINCT source, unnest(a) AS aspect FROM d)"""


@query(
    f"""WITH {AUDIT_SQL} SELECT source, count(*) AS docs, CAST(count(*) FILTER (p = 'pro') AS BIGINT) AS pros, CAST(count(*) FILTER (p = 'con') AS BIGINT) AS cons, coalesce((SELECT string_agg(aspect, ',' ORDER BY aspect) FROM u WHERE u.source = d.source), '') AS covered,
CAST(5 - (SELECT count(*) FROM u WHERE u.source = d.source) AS INT) AS missing FROM d GROUP BY source"""
)
def audit_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source: evidence by polarity, aspects covered and how many are missing."""
    t = F.lower("text")
    d = docs(spark, sf_dir).select("source", E.aspects(t, ASPECTS).alias("a"), E.polarity(t, PROS, CONS).alias("p"))
    # Aspects as flags: the aggregate is of fixed size, whatever a source's share of the rows.
    flags = [F.max(F.array_contains("a", x)).alias(f"_{x}") for x in ASPECTS]
    g = d.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.count_if(F.col("p") == "pro").alias("pros"), F.count_if(F.col("p") == "con").alias("cons"), *flags)
    covered = F.array_sort(F.filter(F.array(*[F.when(F.col(f"_{x}"), F.lit(x)) for x in ASPECTS]), lambda x: x.isNotNull()))
    return g.select("source", "docs", "pros", "cons", F.array_join(covered, ",").alias("covered"), (len(ASPECTS) - F.size(covered)).alias("missing"))


@query(f"WITH {AUDIT_SQL} SELECT aspect, count(*) AS docs FROM (SELECT unnest(a) AS aspect FROM d) GROUP BY 1")
def audit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select(F.explode(E.aspects(F.lower("text"), ASPECTS)).alias("aspect")).groupBy("aspect").agg(F.count(F.lit(1)).alias("docs"))


@query("WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents) SELECT doc_id, rank, CAST((rank - 1) % 3 AS INT) AS worker FROM r")
def backlog_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The backlog, longest first, dealt to three workers."""
    return E.round_robin(docs(spark, sf_dir).select("doc_id", "n_chars"), [F.desc("n_chars"), F.col("doc_id")]).select("doc_id", "rank", "worker")


@query("SELECT doc_id, doc_id % 3 = 0 AS unchanged FROM documents")
def delta_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of a batch the cache has already, by content hash; here the cache has every third document as it is, and older versions of the others."""
    d = docs(spark, sf_dir)
    old = d.withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise(F.concat("text", F.lit(" (old)"))))
    cache = old.select("doc_id", F.sha2(F.to_json(F.struct("text", "lang")), 256).alias("hash"))
    return E.delta_keys(d, "doc_id", ["text", "lang"], cache).select("doc_id", "unchanged")


@query(
    """WITH RECURSIVE c AS (SELECT conv_id, turn, list_filter(list_transform(string_split_regex(text, '[.!؟\\n]\\s+'), lambda x: trim(x)), lambda x: length(x) >= 20) AS s FROM conversations),
d AS (SELECT conv_id, turn, flatten(list_transform(s, lambda x: CASE WHEN len(string_split(x, ' ')) > 45 THEN list_transform(range(0, (len(string_split(x, ' ')) - 1) // 35 + 1), lambda i: array_to_string(string_split(x, ' ')[i * 35 + 1 : i * 35 + 35], ' ')) ELSE [x] END))[1:8] AS b FROM c),
r AS (SELECT conv_id, turn, b, 1 AS k, CAST([] AS VARCHAR[]) AS kept FROM d
  UNION ALL SELECT conv_id, turn, b, k + 1, CASE WHEN length(b[k]) < 12 OR len(kept) >= 5 OR coalesce(list_bool_or(list_transform(kept, lambda x: len(list_intersect(list_distinct(string_split_regex(lower(x), '\\s+')), list_distinct(string_split_regex(lower(b[k]), '\\s+')))) / len(list_distinct(string_split_regex(lower(x), '\\s+') || string_split_regex(lower(b[k]), '\\s+'))) > 0.55)), FALSE) THEN kept ELSE list_append(kept, b[k]) END FROM r WHERE k <= len(b))
SELECT conv_id, turn, CAST(len(kept) AS INT) AS n, array_to_string(kept, ' | ') AS bullets FROM r WHERE k = len(b) + 1"""
)
def bullet_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of each turn as bullets, without alike ones."""
    b = E.merged_bullets(E.sentence_chunks(F.col("text")))
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(b).alias("n"), F.array_join(b, " | ").alias("bullets"))
