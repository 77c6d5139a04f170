"""The combined catalog: parts as listings of four stores, ten of them at a time from one range of machines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.operators import combine as C
from marketloom.registry import query
from marketloom.sources.tables import load

#: Expressions over k, the part's number, in SQL that Spark and DuckDB read alike.  Stores are taken one after the other.
LISTING = {
    "pos": "k % 4 * 1000000000000 + k",
    "store": "concat('store', CAST(k % 4 AS STRING))",
    "block": "CAST(floor(k / 10) AS BIGINT)",
    "mpn": "CASE k % 3 WHEN 0 THEN concat('M', CAST(CAST(floor(k / 10) AS BIGINT) AS STRING), '-', CAST(p_size % 2 AS STRING)) WHEN 1 THEN '' END",
    "fingerprint": "concat(CAST(CAST(floor(k / 10) AS BIGINT) AS STRING), '|', CAST(p_size % 3 AS STRING))",
    "ram_gb": "CASE k % 7 WHEN 0 THEN 0 WHEN 1 THEN 32 ELSE 16 END",
    "storage_gb": "CASE k % 5 WHEN 0 THEN 1000 WHEN 1 THEN 0 ELSE 1024 END",
    "vram_gb": "CASE k % 11 WHEN 0 THEN 6 WHEN 1 THEN 8 END",
    "hz": "CASE p_size % 5 WHEN 0 THEN 60 WHEN 1 THEN 68 WHEN 2 THEN 76 WHEN 3 THEN 0 END",
    "resolution": "CASE k % 9 WHEN 0 THEN '1920x1080' WHEN 1 THEN ' 1920X1080' WHEN 2 THEN '2560x1600' END",
    "panel": "CASE k % 8 WHEN 0 THEN 'OLED' WHEN 1 THEN 'ips' END",
    "touch": "CASE k % 13 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END",
    "cpu": "CASE p_size % 4 WHEN 0 THEN 'Core i5-1235U' WHEN 1 THEN 'i5-1235U' WHEN 2 THEN 'Core i7-1255U' END",
    "gpu": "CASE k % 6 WHEN 0 THEN 'RTX 4050' WHEN 1 THEN 'GeForce RTX 4050' WHEN 2 THEN 'RTX 4060' END",
    "price": "CASE k % 17 WHEN 0 THEN 1.0 ELSE p_retailprice + 200 END",
    "in_stock": "CASE k % 6 WHEN 0 THEN FALSE WHEN 1 THEN NULL ELSE TRUE END",
}
_SLUG = lambda c: f"regexp_replace(regexp_replace(lower(trim(coalesce({c}, ''))), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"
_BOTH = lambda c, same: f"(coalesce(m.{c}, 0) = 0 OR coalesce(x.{c}, 0) = 0 OR {same})"
_TEXTS = lambda c, same: f"(coalesce(m.{c}, '') = '' OR coalesce(x.{c}, '') = '' OR {same})"
#: Of these listings' processors i5 and i7, of their graphics 4050 and 4060 contradict each other.
_OTHER = lambda c, a, b: f"((contains(m.{c}, '{a}') AND contains(x.{c}, '{b}')) OR (contains(m.{c}, '{b}') AND contains(x.{c}, '{a}')))"
AGREE = f"""{_BOTH('ram_gb', 'm.ram_gb = x.ram_gb')} AND {_BOTH('storage_gb', 'abs(m.storage_gb - x.storage_gb) <= 64')} AND {_BOTH('vram_gb', 'm.vram_gb = x.vram_gb')} AND NOT (m.store = x.store AND coalesce(m.mpn <> x.mpn, FALSE))
AND (coalesce(m.mpn = x.mpn, FALSE) OR ({_BOTH('hz', 'abs(m.hz - x.hz) <= 10')} AND {_TEXTS('resolution', 'lower(trim(m.resolution)) = lower(trim(x.resolution))')} AND {_TEXTS('panel', 'lower(m.panel) = lower(x.panel)')} AND coalesce(m.touch = x.touch, TRUE))) AND NOT {_OTHER('c', 'i5', 'i7')} AND NOT {_OTHER('g', '4050', '4060')}"""
_X = {**LISTING, "mpn": f"nullif({LISTING['mpn']}, '')", "c": _SLUG(LISTING["cpu"]), "g": _SLUG(LISTING["gpu"])}
_FIELDS = ("pos", "store", "mpn", "fingerprint", "ram_gb", "storage_gb", "vram_gb", "hz", "resolution", "panel", "touch", "c", "g")
_ROW = lambda cluster: "{" + ", ".join(f"'{f}': x.{f}" for f in _FIELDS) + f", 'cl': {cluster}}}"
_RELABELLED = "{" + ", ".join(f"'{f}': m.{f}" for f in _FIELDS) + ", 'cl': CASE WHEN m.cl = gone THEN home ELSE m.cl END}"
#: Listings of a block one after the other; what was seen is a list with each one's cluster.
CLUSTERED = f"""x AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY block ORDER BY pos) AS n FROM (SELECT k, {', '.join(f'{e} AS {c}' for c, e in _X.items())} FROM (SELECT *, p_partkey AS k FROM part))),
r AS (SELECT block, n, list_value({_ROW('x.pos')}) AS seen FROM x WHERE n = 1
  UNION ALL SELECT x.block, x.n, list_append(list_transform(seen, lambda m: {_RELABELLED}), {_ROW('home')})
  FROM (SELECT x, block, n, seen, coalesce(least(a, b), x.pos) AS home, CASE WHEN a <> b THEN greatest(a, b) END AS gone
    FROM (SELECT x, x.block AS block, x.n AS n, seen, list_filter(seen, lambda m: coalesce(m.mpn = x.mpn, FALSE) AND NOT list_contains(bad, m.cl))[1].cl AS a, list_filter(seen, lambda m: m.fingerprint = x.fingerprint AND NOT list_contains(bad, m.cl))[1].cl AS b
      FROM (SELECT x, r.seen, list_transform(list_filter(r.seen, lambda m: NOT ({AGREE})), lambda m: m.cl) AS bad FROM r JOIN x ON x.block = r.block AND x.n = r.n + 1))) AS s),
last AS (SELECT block, arg_max(seen, n) AS seen FROM r GROUP BY 1), cl AS (SELECT m.pos AS pos, m.cl AS cluster FROM (SELECT unnest(seen) AS m FROM last))"""


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").withColumn("k", F.col("p_partkey")).select("k", *[F.expr(e).alias(c) for c, e in LISTING.items()])


@query(f"WITH RECURSIVE {CLUSTERED} SELECT pos AS node, cluster FROM cl")
def two_tier_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings, store by store, joined by part number, then by fingerprint, unless a member of the cluster contradicts."""
    return C.two_tier_clusters(listings(spark, sf_dir), "pos")


@query(
    f"""WITH RECURSIVE {CLUSTERED}, l AS (SELECT x.*, cluster, price > 1000 AS ok, coalesce(in_stock, TRUE) AS stocked FROM x JOIN cl USING (pos)),
p AS (SELECT cluster, count(*) AS listings, count(DISTINCT store) AS stores_count, arg_min(mpn, pos) FILTER (mpn <> '') AS mpn, arg_min(hz, pos) FILTER (hz > 0) AS hz, arg_min(ram_gb, pos) FILTER (ram_gb > 0) AS ram_gb, max(price) FILTER (ok) AS max_price,
  arg_min(price, (NOT stocked, price, pos)) FILTER (ok) AS min_price, arg_min(store, (NOT stocked, price, pos)) FILTER (ok) AS cheapest_store FROM l GROUP BY 1)
SELECT cluster, listings, stores_count, mpn, hz, ram_gb, min_price, max_price, cheapest_store, coalesce(round(max_price - min_price, 2), 0) AS price_spread FROM p"""
)
def combined_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Machines of all stores: known values of their listings in order, stores and prices rolled up."""
    x = listings(spark, sf_dir)
    homes = C.two_tier_clusters(x, "pos").withColumnRenamed("node", "pos")
    return C.machines(x.join(homes.hint("merge"), "pos"), "cluster", "pos", ["mpn", "hz", "ram_gb"])
