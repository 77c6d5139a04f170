"""Normal forms and entity resolution over parts, suppliers and customers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.functions import names as N
from marketloom.operators import resolve as R
from marketloom.registry import query
from marketloom.sources.tables import load

SLUG = "regexp_replace(regexp_replace(lower(trim({0})), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"


def part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part")


@query(f"SELECT p_partkey, {SLUG.format('p_brand')} AS brand, {SLUG.format('p_name')} AS name FROM part")
def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part(spark, sf_dir).select("p_partkey", N.slug(F.col("p_brand")).alias("brand"), N.slug(F.col("p_name")).alias("name"))


MPN = "CASE WHEN c_custkey % 9 = 0 THEN 'LAPTOP-1234' WHEN c_custkey % 7 = 0 THEN '12 3' WHEN c_custkey % 5 = 0 THEN '15IRX10-83JE' || lpad(CAST(c_custkey AS STRING), 6, '0') ELSE c_name || '-' || c_mktsegment || '#ABV' END"


@query(f"WITH m AS (SELECT c_custkey, upper(regexp_replace(regexp_extract(trim({MPN}), '^([^#/]*)', 1), '[\\s\\-_.]', '', 'g')) AS t FROM customer), v AS (SELECT c_custkey, CASE WHEN length(t) > 10 AND regexp_matches(t, '[82][0-9A-Z]{{9}}$') THEN t[-10:] ELSE t END AS t FROM m) SELECT c_custkey, CASE WHEN length(t) >= 5 AND t NOT IN ('NONE', 'N/A', 'NA', 'UNKNOWN', 'LAPTOP', 'MODEL', 'NOTEBOOK', 'GAMING', 'BLACK', 'GREY', 'SILVER', 'DOS', 'WIN11') AND NOT starts_with(t, 'LAPTOP') AND NOT starts_with(t, 'NOTEBOOK') THEN t END AS mpn FROM v")
def part_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "customer").select("c_custkey", N.part_number(F.expr(MPN)).alias("mpn"))


PRINT = f"{SLUG.format('p_brand')} || '|' || {SLUG.format('p_type')} || '|' || p_size || '|' || CASE WHEN p_partkey % 4 = 0 THEN 'na' ELSE {SLUG.format('p_name')} END"


@query(f"SELECT p_partkey, {PRINT} AS fingerprint FROM part")
def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("p_partkey") % 4 != 0, F.col("p_name"))
    return part(spark, sf_dir).select("p_partkey", N.fingerprint([F.col("p_brand"), F.col("p_type"), F.col("p_size"), name]).alias("fingerprint"))


@query(f"""WITH b AS (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN {SLUG.format('p_brand')} || '_mpn' || (p_partkey % 50) ELSE {SLUG.format('p_brand')} || '_' || {SLUG.format('p_type')} || '_' || p_size END AS id FROM part), n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY p_partkey) AS n, p_partkey % 4 * 30 AS hz FROM b),
w AS (SELECT p_partkey, CASE WHEN n > 1 AND hz > 0 THEN id || '_' || hz || 'hz' ELSE id END AS id, n > 1 AS late FROM n), x AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY late, p_partkey) AS m FROM w) SELECT p_partkey, CASE WHEN m = 1 THEN id ELSE id || '_v' || m END AS unique_id FROM x""")
def canonical_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    mpn = F.when(k % 5 == 0, F.concat(F.lit("MPN"), (k % 50).cast("string")))
    named = part(spark, sf_dir).withColumn("id", N.canonical_id(F.col("p_brand"), mpn, [F.col("p_type"), F.col("p_size")]))
    return R.numbered_ids(named.withColumn("hz", k % 4 * 30), "id", ["p_partkey"], hz="hz").select("p_partkey", "unique_id")


@query(
    """WITH x AS (SELECT min(p_partkey) AS id, count(*) AS members, p_brand, p_size, p_type, CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE p_partkey % 20 END AS hz FROM part GROUP BY ALL)
SELECT a.id AS first, b.id AS second, a.members AS first_members, b.members AS second_members FROM x a JOIN x b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.id < b.id
WHERE a.p_type = b.p_type AND (a.hz IS NULL OR b.hz IS NULL OR a.hz = 0 OR b.hz = 0 OR abs(a.hz - b.hz) <= 10)"""
)
def compatible_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    x = part(spark, sf_dir).select(k.alias("id"), "p_brand", "p_size", "p_type", F.when(k % 6 != 0, k % 20).alias("hz"))
    return R.candidate_pairs(x, ["p_brand", "p_size"], "id", ["p_type"], {"hz": 10})


@query(
    """WITH RECURSIVE e AS MATERIALIZED (SELECT a.p_partkey AS a, b.p_partkey AS b FROM part a JOIN part b ON a.p_size = b.p_size AND (a.p_brand = b.p_brand OR (a.p_name = b.p_name AND a.p_partkey % 3 = 0 AND b.p_partkey % 3 = 0))),
r AS (SELECT p_partkey AS a, p_partkey AS b FROM part UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT a AS p_partkey, min(b) AS component FROM r GROUP BY 1"""
)
def clusters_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that share size and brand or (a third of them) size and name, through any chain."""
    named = F.when(F.col("p_partkey") % 3 == 0, F.col("p_name"))
    x = part(spark, sf_dir).select("p_partkey", "p_brand", "p_size", named.alias("alt"))
    return R.key_components(x, "p_partkey", [["p_size", "p_brand"], ["p_size", "alt"]])


def accepts(a, b) -> bool:
    """Same type, and refresh rates (where known) within 10."""
    near = a["hz"] == 0 or b["hz"] == 0 or abs(a["hz"] - b["hz"]) <= 10
    return a["p_type"] == b["p_type"] and near


@query(
    """WITH RECURSIVE x AS MATERIALIZED (SELECT p_partkey AS id, p_brand || '|' || p_size AS block, p_type, p_partkey % 7 * 6 AS hz, row_number() OVER (PARTITION BY p_brand, p_size ORDER BY p_partkey) AS k FROM part),
r AS (SELECT block, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS node, CAST(NULL AS BIGINT) AS cluster, CAST([] AS STRUCT(head BIGINT, t VARCHAR, lo BIGINT, hi BIGINT)[]) AS cs FROM x WHERE k = 1
  UNION ALL SELECT block, k, id, CASE WHEN home IS NULL THEN id ELSE cs[home].head END, CASE WHEN home IS NULL THEN list_append(cs, {'head': id, 't': p_type, 'lo': nullif(hz, 0), 'hi': nullif(hz, 0)}) ELSE list_transform(cs, lambda c, i: CASE WHEN i = home AND hz <> 0 THEN {'head': c.head, 't': c.t, 'lo': least(coalesce(c.lo, hz), hz), 'hi': greatest(coalesce(c.hi, hz), hz)} ELSE c END) END
  FROM (SELECT x.*, r.cs, list_position(list_transform(r.cs, lambda c: c.t = x.p_type AND (x.hz = 0 OR c.lo IS NULL OR (x.hz - c.lo <= 10 AND c.hi - x.hz <= 10))), TRUE) AS home FROM r JOIN x ON x.block = r.block AND x.k = r.k + 1))
SELECT node, cluster FROM r WHERE k > 0"""
)
def clusters_guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy clusters in blocks of one brand and size; a member that disagrees keeps a row out."""
    k = F.col("p_partkey")
    x = part(spark, sf_dir).select(k.alias("id"), "p_brand", "p_type", (k % 7 * 6).alias("hz"), F.concat_ws("|", "p_brand", F.col("p_size").cast("string")).alias("block"))
    return R.guarded_clusters(x, "id", "block", ["p_brand", "id"], accepts)


@query(
    """WITH RECURSIVE x AS MATERIALIZED (SELECT c_custkey, c_mktsegment, CAST(floor(c_acctbal / 100) AS BIGINT) AS bal, c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS k FROM customer),
r AS (SELECT c_nationkey, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS c_custkey, '' AS c_mktsegment, CAST(NULL AS BIGINT) AS bal, FALSE AS stays, CAST([] AS VARCHAR[]) AS segments, CAST([] AS BIGINT[]) AS bals FROM x WHERE k = 1
  UNION ALL SELECT c_nationkey, k, c_custkey, c_mktsegment, bal, fresh, CASE WHEN fresh THEN list_append(segments, c_mktsegment) ELSE segments END, CASE WHEN fresh THEN list_append(bals, bal) ELSE bals END
  FROM (SELECT x.*, segments, bals, NOT coalesce(list_contains(segments, x.c_mktsegment), FALSE) AND NOT coalesce(list_contains(bals, x.bal), FALSE) AS fresh FROM r JOIN x ON x.c_nationkey = r.c_nationkey AND x.k = r.k + 1))
SELECT c_custkey, c_mktsegment, bal FROM r WHERE stays"""
)
def candidate_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of a nation whose segment and rounded balance were not seen before in it."""
    c = load(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", F.floor(F.col("c_acctbal") / 100).alias("bal"), F.col("c_nationkey").alias("block"))
    return R.first_of_any_key(c, "block", ["c_custkey"], ["c_mktsegment", "bal"]).select("c_custkey", "c_mktsegment", "bal")


@query("SELECT page_id, url FROM (SELECT *, row_number() OVER (PARTITION BY rtrim(lower(regexp_replace(url, '[?#].*$', '')), '/') ORDER BY page_id) AS n FROM pages) WHERE n = 1")
def first_wins_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.rtrim(F.lower(F.regexp_replace("url", "[?#].*$", "")), F.lit("/"))
    return R.first_per_key(load(spark, sf_dir, "pages"), key, ["page_id"]).select("page_id", "url")


@query(
    """WITH d AS (SELECT DISTINCT p_name AS pattern FROM part UNION SELECT DISTINCT split_part(p_name, ' ', 1) FROM part), v AS (SELECT pattern, length(pattern) * 2 AS points FROM d),
t AS (SELECT c_custkey, 'item ' || (SELECT p_name FROM part WHERE p_partkey = c_custkey % 1000) || ' ' || c_mktsegment AS title FROM customer),
h AS (SELECT c_custkey, pattern, points, row_number() OVER (PARTITION BY c_custkey ORDER BY length(pattern) DESC, pattern DESC) AS n FROM t LEFT JOIN v ON contains(lower(title), lower(pattern)))
SELECT c_custkey, pattern AS matched, CAST(points AS INT) AS points FROM h WHERE n = 1"""
)
def dimension_longest_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles looked up in a dimension of names: the longest name they contain."""
    p = part(spark, sf_dir)
    patterns = p.select(F.col("p_name").alias("pattern")).union(p.select(F.split("p_name", " ")[0])).distinct().withColumn("points", F.length("pattern") * 2)
    c = load(spark, sf_dir, "customer").withColumn("k", F.col("c_custkey") % 1000)
    titles = c.join(p.select(F.col("p_partkey").alias("k"), "p_name"), "k", "left").select("c_custkey", F.concat(F.lit("item "), "p_name", F.lit(" "), "c_mktsegment").alias("title"))
    return R.longest_match(titles, "title", ["c_custkey"], patterns, "pattern", "points")


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, CASE WHEN p_size > 25 AND l_quantity > 25 AND l_discount > 0.05 THEN 'EXACT' WHEN p_size > 25 THEN 'VARIANT' ELSE 'NO_MATCH' END AS verdict FROM lineitem JOIN part ON p_partkey = l_partkey"""
)
def spec_match_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = load(spark, sf_dir, "lineitem").join(part(spark, sf_dir), F.col("l_partkey") == F.col("p_partkey"))
    must = F.col("p_size") > 25
    return lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", R.verdict([must, F.col("l_quantity") > 25, F.col("l_discount") > 0.05], [must]).alias("verdict"))


@query(
    """WITH v AS (SELECT p_brand, p_partkey, CASE WHEN p_partkey % 3 = 0 THEN NULL WHEN p_partkey % 2 = 0 THEN p_name || ' ' || p_size ELSE p_name END AS v FROM part)
SELECT p_brand, arg_min(v, (NOT regexp_matches(v, '[0-9]'), -length(v), p_partkey)) AS model, arg_min(t, (NOT regexp_matches(t, 'ring|gear'), -length(t), t)) AS title FROM (SELECT *, v || ' edition' AS t FROM v) WHERE v IS NOT NULL GROUP BY 1"""
)
def field_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per brand the most specific model text and the best title of all its parts."""
    k = F.col("p_partkey")
    v = F.when(k % 3 == 0, None).when(k % 2 == 0, F.concat("p_name", F.lit(" "), F.col("p_size").cast("string"))).otherwise(F.col("p_name"))
    x = part(spark, sf_dir).select("p_brand", "p_partkey", v.alias("v")).withColumn("t", F.concat("v", F.lit(" edition")))
    return x.groupBy("p_brand").agg(R.fused("v", ["p_partkey"]).alias("model"), R.best_title("t", "ring|gear").alias("title"))


@query(
    """WITH f AS (SELECT p_type, p_size, count(*) AS c, min(p_partkey) AS seen FROM part GROUP BY 1, 2), m AS (SELECT p_type, arg_min(p_size, (-c, seen)) AS modal_p_size FROM f GROUP BY 1),
b AS (SELECT p_type, p_brand, min(p_partkey) AS seen FROM part GROUP BY 1, 2)
SELECT p_type, string_agg(p_brand, ',' ORDER BY seen) AS p_brand_list, (SELECT count(*) FROM part p WHERE p.p_type = b.p_type) AS variant_count, any_value(modal_p_size) AS modal_p_size FROM b JOIN m USING (p_type) GROUP BY 1"""
)
def target_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.target_rollup(part(spark, sf_dir), "p_type", ["p_partkey"], ["p_brand"], "p_size").select("p_type", "p_brand_list", "variant_count", "modal_p_size")


CHASSIS = "CASE p_partkey % 4 WHEN 0 THEN 'Model ' || (10 + p_size) || 'X' WHEN 1 THEN 'no digits' WHEN 2 THEN 'ab-' || p_size || 'cd 99' ELSE '' END"
FAMILY = "CASE p_partkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 'Zen Book' ELSE 'unknown' END"


@query(
    f"""WITH x AS (SELECT p_partkey, {SLUG.format('p_brand')} AS brand, {SLUG.format(FAMILY)} AS family, lower(regexp_extract(upper({CHASSIS}), '([A-Z]*[0-9]+[A-Z]*)', 1)) AS root FROM part),
k AS (SELECT p_partkey, coalesce(nullif(brand, ''), 'generic') AS b, coalesce(nullif(family, ''), 'generic') AS f, coalesce(nullif(root, ''), 'generic') AS r FROM x)
SELECT p_partkey, b || ':' || f || ':' || r AS chassis_key, b NOT IN ('generic', 'unknown') AND f NOT IN ('generic', 'unknown') AND r NOT IN ('generic', 'unknown') AS clonable FROM k"""
)
def chassis_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of cases from brand, family and model; those with a part missing can't be cloned."""
    key = N.chassis_key(F.col("p_brand"), F.expr(FAMILY), F.expr(CHASSIS))
    return part(spark, sf_dir).select("p_partkey", key.alias("chassis_key"), N.clonable(key).alias("clonable"))
