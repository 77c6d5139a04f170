"""Normal forms, validators, listing compatibility and catalog files, over texts and values put together from the parts' columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.functions import names as N
from marketloom.functions import parsing as P
from marketloom.functions import scoring as S
from marketloom.operators import evidence as E
from marketloom.operators import pages as G
from marketloom.operators import resolve as R
from marketloom.operators import reviews as V
from marketloom.registry import query
from marketloom.sources import catalogs as C
from marketloom.sources.scratch import scratch_path
from marketloom.sources.tables import load, spread

#: Expressions over k (the part's number) and its columns, in SQL that Spark and DuckDB read alike.
TITLE = "concat('New ', p_brand, '  [Official] (', p_name, ') X', CAST(k % 90 AS STRING), 'A-', CAST(k AS STRING), ' | warranty')"
DIRTY = "concat('a b®', p_type, '–c[', CAST(k % 20 AS STRING), ']  (', CAST(k % 9 AS STRING), ')')"
ARABIC = "CASE k % 3 WHEN 0 THEN 'أحمد إلى مكتبة ٣٤' WHEN 1 THEN 'قُرْآن ۵۶' ELSE 'plain' END"
CELL = "CASE k % 7 WHEN 0 THEN ' N/A ' WHEN 1 THEN '--' WHEN 2 THEN 'Unknown' WHEN 3 THEN NULL WHEN 4 THEN '' ELSE p_type END"
MARKUP = "concat('<b>', p_name, '</b> `x` https://a.b/', CAST(k AS STRING), ' ```y``` end')"
HDR = "CASE k % 6 WHEN 0 THEN 'No HDR' WHEN 1 THEN 'HDR10' WHEN 2 THEN 'non-HDR' WHEN 3 THEN NULL WHEN 4 THEN ' N/A ' ELSE 'DisplayHDR 400' END"
WHEN = "CASE k % 5 WHEN 0 THEN '2024-03-01T10:20:30Z' WHEN 1 THEN '2024-03-01' WHEN 2 THEN 'yesterday' WHEN 3 THEN '2024-02-30' ELSE '2024-03-01 10:20:30' END"


def part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(load(spark, sf_dir, "part")).withColumn("k", F.col("p_partkey"))


P_SQL = "p AS (SELECT *, p_partkey AS k FROM part)"


@query(
    f"""WITH {P_SQL} SELECT k, trim(regexp_replace(regexp_replace(regexp_replace({TITLE}, '(?i)\\b(new|original|official|warranty|free shipping|best price|offer)\\b', ' ', 'g'), '[\\[\\]()|]', ' ', 'g'), '\\s+', ' ', 'g')) AS title,
'X' || (k % 90) || 'A-' || k AS token, 'a b ' || p_type || '-c' AS clean, CASE k % 3 WHEN 0 THEN 'احمد الي مكتبه 34' WHEN 1 THEN 'قران 56' ELSE 'plain' END AS folded, k % 7 < 5 AS blank, p_name || ' end' AS stripped,
CASE k % 3 WHEN 0 THEN 14 WHEN 1 THEN 8 ELSE 0 END::INT AS letters, CASE k % 6 WHEN 0 THEN FALSE WHEN 1 THEN TRUE WHEN 2 THEN FALSE WHEN 4 THEN FALSE WHEN 5 THEN TRUE END AS hdr, lower(replace(p_brand, ' ', '')) || k AS comparable, regexp_matches(upper(p_type), '^(RTX|GTX|RX|CORE|RYZEN|DDR|SSD|NVME)') AS component FROM p"""
)
def text_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles, tokens, cells and labels in the forms in which they are compared."""
    title = F.expr(TITLE)
    return part(spark, sf_dir).select(
        "k", N.clean_title(title).alias("title"), F.element_at(N.model_tokens(title), -1).alias("token"), N.sanitised(F.expr(DIRTY)).alias("clean"), N.western_digits(N.folded_arabic(F.expr(ARABIC))).alias("folded"), N.is_placeholder(F.expr(CELL)).alias("blank"), E.stripped(F.expr(MARKUP)).alias("stripped"),
        V.arabic_letters(F.expr(ARABIC)).alias("letters"), P.hdr_flag(F.expr(HDR)).alias("hdr"), N.comparable(F.concat("p_brand", F.lit("-_"), "k")).alias("comparable"), N.is_component(F.col("p_type")).alias("component"),
    )


@query(f"WITH {P_SQL} SELECT k, CASE k % 5 WHEN 0 THEN '2024-03-01 10:20:30' WHEN 1 THEN '2024-03-01 00:00:00' WHEN 4 THEN '2024-03-01 10:20:30' END AS read, CASE k % 5 WHEN 1 THEN '2024-03-01 00:00:00' WHEN 4 THEN '2024-03-01 10:20:30' END AS stored FROM p")
def iso_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times as text, where Z is read and where it isn't."""
    show = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return part(spark, sf_dir).select("k", show(P.moment(F.expr(WHEN))).alias("read"), show(P.moment(F.expr(WHEN), zone=False)).alias("stored"))


#: Values for every numeric validator: a number as text, a number with a fraction, one that isn't one, or nothing.
NUMBER = "CASE WHEN k % 11 = 0 THEN 'x' WHEN k % 13 = 0 THEN NULL WHEN k % 17 = 0 THEN '16.504' ELSE CAST({0} AS STRING) END"
_OF = {"display_inches": "CAST(k % 250 AS DOUBLE) / 10", "battery_wh": "CAST(k % 1200 AS DOUBLE) / 10", "weight_kg": "CAST(k % 700 AS DOUBLE) / 100", "response_ms": "CAST(k % 400 AS DOUBLE) / 10", "npu_tops": "CAST(k % 1700 AS DOUBLE) / 10", "gpu_boost_mhz": "k % 4000", "nits": "k % 3500", "refresh_hz": "k % 600", "adapter_w": "k % 600", "gpu_w": "k % 300"}
_OF |= {"ram_gb": "k % 200", "vram_gb": "k % 30", "speakers": "k % 12", "warranty_years": "k % 12", "memory_slots": "k % 12", "storage_slots": "k % 12"}
_LENGTH = {"height_mm": "CAST(k % 700 AS DOUBLE) / 10", "width_mm": "k % 600", "depth_mm": "k % 500"}
_WHOLE = lambda e: f"TRY_CAST(CASE WHEN contains(t, '.') THEN NULL ELSE t END AS DOUBLE) AS v FROM (SELECT k, {NUMBER.format(e)} AS t FROM p)"
_ROUND = lambda e, digits: f"round(TRY_CAST(t AS DOUBLE), {digits}) AS v FROM (SELECT k, {NUMBER.format(e)} AS t FROM p)"


@query(
    f"""WITH {P_SQL}, c AS (
SELECT *, v BETWEEN 10 AND 18.5 AS fine, 'outside 10..18.5' AS why FROM (SELECT k, 'display_inches' AS kind, {_ROUND(_OF['display_inches'], 1)})
UNION ALL SELECT *, v BETWEEN 60 AND 480, 'outside 60..480' FROM (SELECT k, 'refresh_hz', {_WHOLE(_OF['refresh_hz'])})
UNION ALL SELECT *, v BETWEEN 25 AND 99.9, 'outside 25..99.9' FROM (SELECT k, 'battery_wh', {_ROUND(_OF['battery_wh'], 1)})
UNION ALL SELECT *, v BETWEEN 30 AND 500, 'outside 30..500' FROM (SELECT k, 'adapter_w', {_WHOLE(_OF['adapter_w'])})
UNION ALL SELECT *, v BETWEEN 0.7 AND 5.5, 'outside 0.7..5.5' FROM (SELECT k, 'weight_kg', {_ROUND(_OF['weight_kg'], 2)})
UNION ALL SELECT *, v BETWEEN 1 AND 8, 'outside 1..8' FROM (SELECT k, 'speakers', {_WHOLE(_OF['speakers'])})
UNION ALL SELECT *, v BETWEEN 150 AND 3000, 'outside 150..3000' FROM (SELECT k, 'nits', {_WHOLE(_OF['nits'])})
UNION ALL SELECT *, v BETWEEN 0.1 AND 35, 'outside 0.1..35' FROM (SELECT k, 'response_ms', {_ROUND(_OF['response_ms'], 2)})
UNION ALL SELECT *, v BETWEEN 5 AND 150, 'outside 5..150' FROM (SELECT k, 'npu_tops', {_ROUND(_OF['npu_tops'], 1)})
UNION ALL SELECT *, v BETWEEN 500 AND 3200, 'outside 500..3200' FROM (SELECT k, 'gpu_boost_mhz', {_WHOLE(_OF['gpu_boost_mhz'])})
UNION ALL SELECT *, v BETWEEN 20 AND 250, 'outside 20..250' FROM (SELECT k, 'gpu_w', {_WHOLE(_OF['gpu_w'])})
UNION ALL SELECT *, v BETWEEN 1 AND 5, 'outside 1..5' FROM (SELECT k, 'warranty_years', {_WHOLE(_OF['warranty_years'])})
UNION ALL SELECT *, v BETWEEN 0 AND 8, 'outside 0..8' FROM (SELECT k, 'memory_slots', {_WHOLE(_OF['memory_slots'])})
UNION ALL SELECT *, v BETWEEN 1 AND 6, 'outside 1..6' FROM (SELECT k, 'storage_slots', {_WHOLE(_OF['storage_slots'])})
UNION ALL SELECT *, v IN (4, 8, 12, 16, 20, 24, 32, 36, 40, 48, 64, 96, 128, 192), 'not a memory size' FROM (SELECT k, 'ram_gb', {_WHOLE(_OF['ram_gb'])})
UNION ALL SELECT *, v IN (2, 4, 6, 8, 10, 12, 16, 24), 'not a memory size' FROM (SELECT k, 'vram_gb', {_WHOLE(_OF['vram_gb'])})),
x AS (SELECT k, 'height_mm' AS kind, {NUMBER.format(_LENGTH['height_mm'])} AS t, 0.5 AS a, 6 AS b, 6 AS lo, 60 AS hi FROM p UNION ALL SELECT k, 'width_mm', {NUMBER.format(_LENGTH['width_mm'])}, 15, 60, 180, 500 FROM p UNION ALL SELECT k, 'depth_mm', {NUMBER.format(_LENGTH['depth_mm'])}, 10, 45, 140, 400 FROM p),
l AS (SELECT *, round(CASE WHEN TRY_CAST(t AS DOUBLE) >= a AND TRY_CAST(t AS DOUBLE) < b THEN TRY_CAST(t AS DOUBLE) * 10 ELSE TRY_CAST(t AS DOUBLE) END, 2) AS v FROM x)
SELECT k, kind, coalesce(fine, FALSE) AS ok, CASE WHEN fine THEN v END AS value, CASE WHEN v IS NULL THEN 'type_error' WHEN NOT fine THEN why END AS reason FROM c
UNION ALL SELECT k, kind, t IS NULL OR coalesce(v BETWEEN lo AND hi, FALSE), CASE WHEN v BETWEEN lo AND hi THEN v END, CASE WHEN t IS NULL THEN NULL WHEN v IS NULL THEN 'type_error' WHEN NOT v BETWEEN lo AND hi THEN 'outside ' || lo || '..' || hi END FROM l"""
)
def validated_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every quantity that has a validator, for every part."""
    of = {k: NUMBER.format(e) for k, e in (_OF | _LENGTH).items()}
    rows = F.explode(F.array(*[F.struct(F.lit(kind).alias("kind"), P.validated(kind, F.expr(e)).alias("r")) for kind, e in of.items()]))
    return part(spark, sf_dir).select("k", rows.alias("x")).select("k", "x.kind", "x.r.ok", "x.r.value", "x.r.reason")


#: (text, value or None, reason) of texts for every validator of names.
TEXTS = {
    "memory_type": [("ddr 5", "DDR5", None), ("LPDDR5x", "LPDDR5X", None), ("SDRAM", None, "unknown type"), ("unified", "Unified Memory", None), ("DDR4", None, "not for this processor")],
    "mpn": [(" 83DV01 ", "83DV01", None), ("16GB RAM", None, "a specification"), ("notebook", None, "a generic word"), ("ab", None, "length"), ("", None, "type_error")],
    "family": [("zen book", "Zen Book", None), ("rtx thing", None, "a specification"), ("N/A", None, "a generic word"), ("LOQ", "Loq", None), ("", None, "type_error")],
    "microphone": [("yes", "Built-in microphone", None), ("dual array mic", "dual array mic", None), ("Stereo speakers, dual mic", "dual mic", None), ("Realtek, 2W x 2", None, "about speakers"), ("", None, "type_error")],
    "panel": [("15 ips-level", "IPS", None), ("Mini LED", "Mini-LED", None), ("amoled touch", "AMOLED", None), ("glass", None, "unknown panel"), ("WVA", "WVA", None)],
    "webcam": [("1080p", "1080p", None), ("FHD + IR", "FHD + IR", None), ("5 MP", "5 MP", None), ("none", None, "unknown resolution"), ("", None, "type_error")],
    "bluetooth": [("BT 5.3", "Bluetooth 5.3", None), ("v5", "Bluetooth 5.0", None), ("Bluetooth", None, "unknown version"), ("yes", None, "unknown version"), ("", None, "type_error")],
    "gamut": [("100% sRGB", "100% sRGB", None), ("Eclipse Gray", None, "a colour of the case"), ("62.5%", "62.5%", None), ("vivid", None, "no standard"), ("black 45% NTSC", "black 45% NTSC", None)],
    "storage_form": [("M.2 2280", "M.2 2280", None), ("eMMC", "eMMC", None), ("disk", None, "unknown form"), ('2.5"', '2.5"', None), ("", None, "type_error")],
}
_LIT = lambda x: "NULL" if x is None else f"'{x}'"


def _case(kind: str, at: int) -> str:
    return "CASE k % 5 " + " ".join(f"WHEN {n} THEN {_LIT(t[at])}" for n, t in enumerate(TEXTS[kind])) + " END"


@query(f"WITH {P_SQL} " + " UNION ALL ".join(f"SELECT k, '{kind}' AS kind, {_case(kind, 1)} IS NOT NULL AS ok, {_case(kind, 1)} AS value, {_case(kind, 2)} AS reason FROM p" for kind in TEXTS))
def validated_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every named property that has a validator, for every part; what must come out is written beside the texts."""
    supported = F.array(F.lit("DDR5"), F.lit("LPDDR5X"))
    rows = F.explode(F.array(*[F.struct(F.lit(kind).alias("kind"), P.validated_text(kind, F.expr(_case(kind, 0)), supported if kind == "memory_type" else None).alias("r")) for kind in TEXTS]))
    return part(spark, sf_dir).select("k", rows.alias("x")).select("k", "x.kind", "x.r.ok", "x.r.value", "x.r.reason")


@query(f"WITH {P_SQL}, x AS (SELECT k, 200 + k % 300 AS w, 100 + k % 250 AS d, 5 + k % 40 AS h FROM p) SELECT k, CASE WHEN w BETWEEN 250 AND 460 AND d BETWEEN 170 AND 320 AND h BETWEEN 8 AND 40 AND d <= w THEN w || 'x' || d || 'x' || h WHEN d > w AND d BETWEEN 250 AND 460 AND w BETWEEN 170 AND 320 AND h BETWEEN 8 AND 40 THEN d || 'x' || w || 'x' || h END AS size FROM x")
def case_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Width, depth and height, given in any order, every third in centimetres."""
    w, d, h = (F.expr(e).cast("double") for e in ("200 + k % 300", "100 + k % 250", "5 + k % 40"))
    values = F.when((F.col("k") % 3 == 0) & (h < 45), F.array(h / 10, w / 10, d / 10)).otherwise(F.array(d, h, w))
    return part(spark, sf_dir).select("k", F.array_join(F.transform(P.dimensions(values), lambda x: x.cast("int").cast("string")), "x").alias("size"))


#: Listings by part number: what same_hardware compares.
LISTING = {
    "ram_gb": "CASE k % 4 WHEN 0 THEN 0 WHEN 1 THEN 16 ELSE 8 END", "storage_gb": "CASE k % 3 WHEN 0 THEN 512 WHEN 1 THEN 500 ELSE 1000 END", "vram_gb": "CASE k % 5 WHEN 0 THEN 6 END", "store": "CASE k % 2 WHEN 0 THEN 'a' ELSE 'b' END", "mpn": "CASE k % 7 WHEN 0 THEN 'M1' WHEN 1 THEN 'M2' END",
    "hz": "CASE k % 6 WHEN 0 THEN 60 WHEN 1 THEN 144 WHEN 2 THEN 65 ELSE 0 END", "resolution": "CASE k % 9 WHEN 0 THEN '1920x1080' WHEN 1 THEN ' 1920X1080' WHEN 2 THEN '2560x1600' END", "panel": "CASE k % 8 WHEN 0 THEN 'OLED' WHEN 1 THEN 'ips' END", "touch": "CASE k % 10 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END",
    "cpu": "CASE k % 11 WHEN 0 THEN 'Core i5-1235U' WHEN 1 THEN 'Core i7-1255U' WHEN 2 THEN 'i7-1255U' END", "gpu": "CASE k % 13 WHEN 0 THEN 'RTX 4050' WHEN 1 THEN 'RTX 4060' WHEN 2 THEN 'GeForce RTX 4060' END",
}
_BOTH = lambda c, same: f"(coalesce(a.{c}, 0) = 0 OR coalesce(b.{c}, 0) = 0 OR {same})"
_TEXTS = lambda c, same: f"(coalesce(a.{c}, '') = '' OR coalesce(b.{c}, '') = '' OR {same})"
_SLUG = lambda c: f"regexp_replace(regexp_replace(lower(trim(coalesce({c}, ''))), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"


def _clash(c: str, tokens: tuple[str, ...]) -> str:
    x, y = _SLUG(f"a.{c}"), _SLUG(f"b.{c}")
    pairs = " OR ".join(f"(contains({x}, '{t}') AND (" + " OR ".join(f"contains({y}, '{u}')" for u in tokens if u != t) + "))" for t in tokens)
    return f"({x} <> '' AND {y} <> '' AND NOT contains({x}, {y}) AND NOT contains({y}, {x}) AND ({pairs}))"


@query(
    f"""WITH {P_SQL}, x AS (SELECT k, {', '.join(f'{e} AS {c}' for c, e in LISTING.items())} FROM p)
SELECT a.k AS first, b.k AS second FROM x a JOIN x b ON b.k BETWEEN a.k + 1 AND a.k + 5
WHERE {_BOTH('ram_gb', 'a.ram_gb = b.ram_gb')} AND {_BOTH('storage_gb', 'abs(a.storage_gb - b.storage_gb) <= 64')} AND {_BOTH('vram_gb', 'a.vram_gb = b.vram_gb')} AND NOT (a.store = b.store AND coalesce(a.mpn, '') <> '' AND coalesce(b.mpn, '') <> '' AND a.mpn <> b.mpn)
AND (coalesce(a.mpn = b.mpn, FALSE) OR ({_BOTH('hz', 'abs(a.hz - b.hz) <= 10')} AND {_TEXTS('resolution', 'lower(trim(a.resolution)) = lower(trim(b.resolution))')} AND {_TEXTS('panel', "contains(lower(a.panel), 'oled') = contains(lower(b.panel), 'oled')")} AND coalesce(a.touch = b.touch, TRUE)))
AND NOT {_clash('cpu', R.CPU_TIERS)} AND NOT {_clash('gpu', R.GPU_NUMBERS)}"""
)
def compatible_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of the next five listings may be the same machine as each one."""
    x = part(spark, sf_dir).select("k", *[F.expr(e).alias(c) for c, e in LISTING.items()])
    near = x.select(F.explode(F.sequence(F.col("k") + 1, F.col("k") + 5)).alias("_at"), *[F.col(c) for c in x.columns])
    pairs = near.alias("a").join(x.alias("b"), F.col("a._at") == F.col("b.k")).where(R.same_hardware("a", "b"))
    return pairs.select(F.col("a.k").alias("first"), F.col("b.k").alias("second"))


@query(
    """WITH x AS (SELECT p_brand, p_partkey, CASE WHEN p_partkey % 3 > 0 THEN p_name END AS title, CASE WHEN p_partkey % 4 > 0 THEN p_type ELSE '' END AS model, CASE WHEN p_partkey % 5 = 0 THEN p_size END AS size, CASE WHEN p_partkey % 2 = 0 THEN p_name END AS mpn FROM part),
r AS (SELECT p_brand, arg_min(p_partkey, (-CAST(title IS NOT NULL AS INT), -length(model), -CAST(size IS NOT NULL AS INT), -CAST(mpn IS NOT NULL AS INT), p_partkey)) AS p_partkey, coalesce(arg_min(size, (-CAST(title IS NOT NULL AS INT), -length(model), -CAST(size IS NOT NULL AS INT), -CAST(mpn IS NOT NULL AS INT), p_partkey)) , arg_min(size, p_partkey) FILTER (size IS NOT NULL)) AS ignored FROM x GROUP BY 1),
s AS (SELECT p_brand, arg_min(size, p_partkey) FILTER (size IS NOT NULL) AS first_size FROM x GROUP BY 1), m AS (SELECT p_brand, string_agg(mpn, '|' ORDER BY seen) AS mpns FROM (SELECT p_brand, mpn, min(p_partkey) AS seen FROM x WHERE mpn IS NOT NULL GROUP BY 1, 2) GROUP BY 1)
SELECT r.p_brand, r.p_partkey, x.title, x.model, coalesce(x.size, first_size) AS size, mpns FROM r JOIN x USING (p_brand, p_partkey) JOIN s USING (p_brand) LEFT JOIN m USING (p_brand)"""
)
def consolidated_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per brand its richest part with all part numbers and the first known size."""
    k = F.col("p_partkey")
    x = load(spark, sf_dir, "part").select("p_brand", "p_partkey", F.when(k % 3 > 0, F.col("p_name")).alias("title"), F.when(k % 4 > 0, F.col("p_type")).otherwise("").alias("model"), F.when(k % 5 == 0, F.col("p_size")).alias("size"), F.when(k % 2 == 0, F.col("p_name")).alias("mpn"))
    rich = [F.col("title").isNotNull(), F.length("model"), F.col("size").isNotNull(), F.col("mpn").isNotNull()]
    return R.consolidated(x, "p_brand", rich, ["p_partkey"], ["mpn"], ["size"]).select("p_brand", "p_partkey", "title", "model", "size", F.array_join("mpn", "|").alias("mpns"))


def _catalog_files(spark: SparkSession, sf_dir: str) -> list[str]:
    """Catalogs of a hundred parts and a store each, as lines of JSON, and a broken line."""
    made = scratch_path(spark, "catalogs")
    product = F.struct(F.col("p_name").alias("title"), F.concat(F.lit("https://s/"), F.col("p_partkey").cast("string")).alias("url"), F.col("p_partkey").cast("string").alias("mpn"), F.col("p_retailprice").alias("price"), (F.col("p_partkey") % 3 > 0).alias("in_stock"))
    rows = load(spark, sf_dir, "part").withColumn("store_key", F.concat(F.lit("store"), (F.col("p_partkey") % 5).cast("string"), F.lit("_"), F.floor(F.col("p_partkey") / 100).cast("string")))
    docs = rows.groupBy("store_key").agg(F.array_sort(F.collect_list(F.struct(F.col("p_partkey").alias("k"), product.alias("p")))).alias("a")).withColumn("a", F.transform("a", lambda x: x["p"]))
    odd = F.col("store_key").rlike("^store[13]_")
    docs = docs.select("store_key", F.when(odd, F.array().cast(docs.schema["a"].dataType)).otherwise(F.col("a")).alias("structured_products"), F.when(odd, F.col("a")).alias("products"), F.when(F.col("store_key").startswith("store0_"), F.array(F.lit("p1"), F.lit("p2"))).alias("latest_pointers"))
    docs.select(F.to_json(F.struct("*")).alias("value")).unionByName(spark.createDataFrame([("{broken",)], "value string")).repartition(6, "value").write.text(made)
    return [made]


@query("SELECT 'store' || (p_partkey % 5) || '_' || (p_partkey // 100) AS store_key, CAST(row_number() OVER (PARTITION BY p_partkey % 5, p_partkey // 100 ORDER BY p_partkey) - 1 AS INT) AS position, p_name AS title, CAST(p_partkey AS VARCHAR) AS mpn, p_retailprice AS price FROM part")
def catalog_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products of catalogs: structured ones where there are any."""
    return C.catalog_products(C.read_catalogs(spark, _catalog_files(spark, sf_dir), multi_line=False)).select("store_key", "position", "title", "mpn", "price")


@query("SELECT 'store' || s || '_' || g AS store_key, CASE WHEN s = 0 THEN 'p1|p2' ELSE string_agg(p_name, '|' ORDER BY p_partkey) FILTER (n <= 3) END AS pointers FROM (SELECT *, p_partkey % 5 AS s, p_partkey // 100 AS g, row_number() OVER (PARTITION BY p_partkey % 5, p_partkey // 100 ORDER BY p_partkey) AS n FROM part) GROUP BY s, g")
def catalog_pointers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each store's crawl goes on: its own pointers, or its first titles."""
    return C.catalog_pointers(C.read_catalogs(spark, _catalog_files(spark, sf_dir), multi_line=False)).select("store_key", F.array_join("pointers", "|").alias("pointers"))


@query("SELECT p_partkey, p_name, p_size, p_retailprice FROM part WHERE p_size >= 10 ORDER BY p_retailprice, p_partkey LIMIT 25")
def fallback_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page from the file source that stands in for a store which can't be opened; rows without a known score fail its gate."""
    from marketloom.operators import browse as B

    parts = load(spark, sf_dir, "part")
    source = C.first_available(spark, [scratch_path(spark, "no-such-table"), f"{sf_dir}/part.parquet"], parts.schema)
    return B.gated(source, {"p_size": 10}).orderBy("p_retailprice", "p_partkey").limit(25).select("p_partkey", "p_name", "p_size", "p_retailprice")


@query("SELECT event_type, count(*) * 2 AS lines, count(DISTINCT event_id) AS events FROM events GROUP BY 1")
def trace_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events appended twice to a JSON-lines trace, and what is in it then."""
    path = scratch_path(spark, "trace")
    e = load(spark, sf_dir, "events").select("event_id", "event_type")
    for _ in range(2):
        C.append_json(e, path)
    return spark.read.schema("event_id long, event_type string").json(path).groupBy("event_type").agg(F.count(F.lit(1)).alias("lines"), F.countDistinct("event_id").alias("events"))


_EN = "CASE k % 4 WHEN 0 THEN 'good keyboard|runs quite cool' WHEN 1 THEN 'good keyboard' WHEN 2 THEN 'good keyboard|short' ELSE 'a very long day|b very long day| |c very long day' END"
_AR = "CASE k % 3 WHEN 0 THEN 'لوحة مفاتيح ممتازة|هادئ جدا في العمل' WHEN 1 THEN 'keyboard لوحة|هادئ جدا في العمل' ELSE NULL END"


@query(
    f"""WITH {P_SQL}, e AS (SELECT k, [CASE WHEN NOT (k % 80 + 25) BETWEEN 35 AND 98 THEN 'thermals' END, CASE WHEN k % 9 = 0 THEN 'battery' END, CASE k % 4 WHEN 1 THEN 'pros_en: number' WHEN 2 THEN 'pros_en: too short' END, CASE k % 3 WHEN 1 THEN 'pros_ar: too short' WHEN 2 THEN 'pros_ar: number' END] AS e FROM p)
SELECT k, array_to_string(list_filter(e, lambda x: x IS NOT NULL), ', ') AS errors FROM e"""
)
def profile_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with each review profile."""
    k = F.col("k")
    scores = {"thermals": (k % 80 + 25).cast("double"), "battery": F.when(k % 9 > 0, 75.0)}
    return part(spark, sf_dir).select("k", F.array_join(S.profile_errors(scores, {"pros_en": F.split(F.expr(_EN), "[|]"), "pros_ar": F.split(F.expr(_AR), "[|]")}), ", ").alias("errors"))


@query(
    """WITH c AS (SELECT doc_id, list_filter(list_transform(string_split_regex(trim(regexp_replace(text, '[ \\t\\r]+', ' ', 'g')), '\\n+'), lambda x: trim(x)), lambda x: x <> '') AS lines FROM documents),
s AS (SELECT doc_id, list_filter(list_transform(flatten(list_transform(lines, lambda x: string_split(regexp_replace(x, '([.!?؟])\\s+', '\\1' || chr(10), 'g'), chr(10)))), lambda x: trim(x)), lambda x: len(string_split_regex(x, '\\s+')) >= 6) AS s FROM c),
w AS (SELECT doc_id, flatten(list_transform(s, lambda x: CASE WHEN len(string_split_regex(x, '\\s+')) > 45 THEN list_transform(range(0, (len(string_split_regex(x, '\\s+')) - 1) // 32 + 1), lambda i: array_to_string(string_split_regex(x, '\\s+')[i * 32 + 1 : i * 32 + 32], ' ')) ELSE [x] END)) AS w FROM s),
k AS (SELECT doc_id, list_transform(list_filter(w, lambda x: length(x) >= 25 AND len(string_split(x, ' ')) >= 6), lambda x: substr(x, 1, 360)) AS k FROM w)
SELECT doc_id, CAST(len(k) AS INT) AS n_chunks, md5(array_to_string(k, '|')) AS digest FROM k"""
)
def phrase_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences and windows of words of every document."""
    c = E.phrase_chunks(F.regexp_replace("text", r"[ \t\r]+", " "))
    return load(spark, sf_dir, "documents").select("doc_id", F.size(c).alias("n_chunks"), F.md5(F.array_join(c, "|")).alias("digest"))


@query(
    """WITH x AS (SELECT page_id, rtrim(lower(url), '/') AS key, CASE WHEN contains(url, 'news') THEN 'editorial' WHEN page_id % 3 = 0 THEN 'youtube' WHEN page_id % 3 = 1 THEN 'community' ELSE 'other' END AS kind, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title, length(html) AS views FROM pages),
u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY page_id) AS n FROM x WHERE title <> '' AND key <> '') WHERE n = 1)
SELECT page_id, kind, CAST(row_number() OVER (PARTITION BY regexp_extract(key, '^https?://([^/]*)', 1) ORDER BY CASE kind WHEN 'editorial' THEN 0 WHEN 'youtube' THEN 1 WHEN 'community' THEN 2 ELSE 3 END, -views, title, page_id) AS INT) AS rank FROM u"""
)
def review_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complete sources, one a URL, in the order in which each host's are shown."""
    html = F.col("html")
    kind = F.when(F.col("url").contains("news"), "editorial").when(F.col("page_id") % 3 == 0, "youtube").when(F.col("page_id") % 3 == 1, "community").otherwise("other")
    x = load(spark, sf_dir, "pages").select("page_id", "url", kind.alias("kind"), G.title(html).alias("title"), F.length(html).alias("views"))
    return V.ordered_sources(x, F.regexp_extract(F.lower("url"), "^https?://([^/]*)", 1), "page_id").select("page_id", "kind", "rank")


@query("WITH c AS (SELECT conv_id, role, count(*) AS n FROM conversations GROUP BY 1, 2) SELECT d.doc_id, coalesce((SELECT n FROM c WHERE c.conv_id = d.doc_id AND role = 'user'), 0) AS user_posts, coalesce((SELECT n FROM c WHERE c.conv_id = d.doc_id AND role = 'assistant'), 0) AS assistant_posts FROM documents d")
def platform_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every target with what each platform has for it, nothing included."""
    posts = load(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), "role")
    return V.by_platform(load(spark, sf_dir, "documents").select("doc_id"), posts, "doc_id", "role", ["user", "assistant"]).select("doc_id", F.col("user").alias("user_posts"), F.col("assistant").alias("assistant_posts"))


@query("SELECT conv_id, CASE WHEN count(*) FILTER (role = 'user') > 2 THEN 'B2' WHEN count(*) FILTER (role = 'user') > 1 THEN 'B1' WHEN count(*) FILTER (role = 'assistant') > 0 THEN 'A' ELSE 'unknown' END AS format, CAST(count(*) FILTER (role = 'user' AND length(trim(text)) < 60 AND ends_with(trim(text), '?')) AS BIGINT) AS questions FROM conversations GROUP BY 1")
def review_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The format of each review document, by what it holds, and how many short questions are among its posts."""
    c = load(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count_if(F.col("role") == "user").alias("u"), F.count_if(F.col("role") == "assistant").alias("a"), F.count_if((F.col("role") == "user") & V.short_question(F.trim("text"))).alias("questions"))
    held = c.withColumns({"deduplicated_chunks": F.when(F.col("u") > 2, 1), "nlp_review_profile": F.when(F.col("u") > 1, 1), "videos": F.when(F.col("a") > 0, 1)})
    return held.select("conv_id", V.format_of(held.columns).alias("format"), "questions")
