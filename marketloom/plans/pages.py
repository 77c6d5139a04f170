"""Extraction from raw pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.functions.parsing import shown_money
from marketloom.operators import pages as P
from marketloom.registry import query
from marketloom.sources import raw_pages as W
from marketloom.sources.scratch import scratch_path
from marketloom.sources.tables import load


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "pages")


@query(
    """SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title, CAST(len(regexp_extract_all(html, '(?i)<a\\s+[^>]*href="([^"]*)"', 1)) AS INT) AS n_links,
array_to_string(regexp_extract_all(html, '(?i)<a\\s+[^>]*href="([^"]*)"', 1)[1:3], ' ') AS first_links FROM pages"""
)
def page_title_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = P.links(F.col("html"))
    return pages(spark, sf_dir).select("page_id", P.title(F.col("html")).alias("title"), F.size(links).alias("n_links"), F.array_join(F.slice(links, 1, 3), " ").alias("first_links"))


#: Price texts in the ways that stores write them, in SQL that Spark and DuckDB read alike.
PRICE_TEXT = """CASE page_id % 8 WHEN 0 THEN concat('EGP 1,', CAST(100 + page_id % 900 AS STRING), '.50') WHEN 1 THEN concat('81.', CAST(100 + page_id % 900 AS STRING), ',25 ج.م') WHEN 2 THEN concat(CAST(20 + page_id % 70 AS STRING), ' ', CAST(100 + page_id % 900 AS STRING), ' L.E.')
WHEN 3 THEN concat('45.', CAST(100 + page_id % 900 AS STRING)) WHEN 4 THEN concat('جنيه ٦', CAST(page_id % 10 AS STRING), ',٩٩٩') WHEN 5 THEN 'call us' WHEN 6 THEN concat('12,5', CAST(page_id % 10 AS STRING), ' EGP') ELSE concat('1.2.', CAST(page_id AS STRING)) END"""
WESTERN = f"translate({PRICE_TEXT}, '٠١٢٣٤٥٦٧٨٩', '0123456789')"
MONEY_SQL = f"""x AS (SELECT page_id, html, {PRICE_TEXT} AS t, replace(regexp_extract({WESTERN}, '([0-9][0-9,. ]*)', 1), ' ', '') AS run, regexp_extract({WESTERN}, '([0-9,]+(\\.[0-9]{{2}})?)', 1) AS simple FROM pages),
y AS (SELECT *, CASE WHEN NOT contains(run, ',') THEN run WHEN NOT contains(run, '.') THEN replace(run, ',', '') WHEN regexp_matches(run, '\\.[^,]*$') THEN replace(run, ',', '') ELSE replace(replace(run, '.', ''), ',', '.') END AS plain FROM x),
z AS (SELECT *, CASE WHEN TRY_CAST(plain AS DOUBLE) > 0 THEN TRY_CAST(plain AS DOUBLE) END AS price FROM y)"""


@query(f"WITH {MONEY_SQL} SELECT page_id, price, NOT contains(lower(html || CASE WHEN page_id % 4 = 0 THEN 'Out of Stock' ELSE '' END), 'out of stock') AS in_stock FROM z")
def page_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices and stock of pages (with a price element appended, as these pages have none)."""
    extra = F.concat("html", F.lit('<span class="price">'), F.expr(PRICE_TEXT), F.lit("</span>"), F.when(F.col("page_id") % 4 == 0, "Out of Stock").otherwise(""))
    return pages(spark, sf_dir).select("page_id", P.offer(extra).alias("o")).select("page_id", "o.price", "o.in_stock")


@query(f"WITH {MONEY_SQL} SELECT page_id, TRY_CAST(replace(simple, ',', '') AS DOUBLE) AS value, CASE WHEN TRY_CAST(replace(simple, ',', '') AS DOUBLE) IS NULL THEN t ELSE format('{{:,.2f}} EGP', TRY_CAST(replace(simple, ',', '') AS DOUBLE)) END AS shown FROM z")
def shown_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price texts as numbers and in the form in which they are shown."""
    return pages(spark, sf_dir).select("page_id", shown_money(F.expr(PRICE_TEXT)).alias("m")).select("page_id", "m.value", "m.shown")


VETOES = [("script", "track\\(1\\d*\\)"), ("foreign", 'lang="(de|fr)"'), ("advert", "<!-- ad [0-4] -->")]


@query("SELECT reason, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(url, 'page=2') THEN 'ok' WHEN regexp_matches(html, 'track\\(1\\d*\\)') THEN 'script' WHEN regexp_matches(html, 'lang=\"(de|fr)\"') THEN 'foreign' WHEN regexp_matches(html, '<!-- ad [0-4] -->') THEN 'advert' ELSE 'ok' END AS reason FROM pages) GROUP BY 1")
def page_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages kept and skipped, by the first reason against them."""
    reason = F.when(F.col("url").rlike("page=2"), "ok").otherwise(P.gate(F.col("html"), VETOES))
    return pages(spark, sf_dir).select(reason.alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT regexp_extract(html, '<html lang=\"([a-z]+)\"', 1) AS lang, count(*) AS pages, CAST(sum(length(html)) AS BIGINT) AS chars FROM pages GROUP BY 1")
def page_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).groupBy(F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("lang")).agg(F.count(F.lit(1)).alias("pages"), F.sum(F.length("html")).cast("long").alias("chars"))


#: Streamed payloads by page: nested and escaped ones, one in which a nearer object closes before the price, broken ones, and none.
PAYLOADS = [
    '{"a":[{"offer":{"sku":"P-@","price":"1@.5","priceCurrency":"EGP","note":"a } in \\"quotes\\" {","availability":"https://schema.org/InStock"}}]}',
    '{"x":{"y":{"z":1}},"price":7@,"sku":"Q@","in_stock":false}',
    '{"open":{"broken":[1,2},"price":3}',
    '{"deep":{"brand":{"name":"n{"},"price":"call us","priceCurrency":"USD","availability":"OutOfStock"},"tail":"never closed',
    "no payload at all",
    '{"cut":"text with \\"price\\" inside a string","price":9',
]


@query(
    """SELECT page_id, CASE page_id % 6 WHEN 0 THEN 10 * pow(10, length(CAST(page_id % 90 AS VARCHAR)) - 1) + page_id % 90 + 0.5 WHEN 1 THEN 7 * pow(10, length(CAST(page_id % 90 AS VARCHAR))) + page_id % 90 END AS price,
CASE page_id % 6 WHEN 0 THEN 'EGP' WHEN 3 THEN 'USD' END AS currency, CASE page_id % 6 WHEN 0 THEN 'P-' || page_id % 90 WHEN 1 THEN 'Q' || page_id % 90 END AS sku, CASE page_id % 6 WHEN 0 THEN TRUE WHEN 1 THEN FALSE WHEN 3 THEN FALSE END AS in_stock FROM pages"""
)
def streamed_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices out of payloads that pages stream after their markup."""
    k = F.col("page_id")
    payload = F.replace(F.get(F.array(*map(F.lit, PAYLOADS)), (k % 6).cast("int")), F.lit("@"), (k % 90).cast("string"))
    text = F.concat(F.coalesce("html", F.lit("")), F.lit("<script>push(["), payload, F.lit("])</script>"))
    return pages(spark, sf_dir).select("page_id", P.streamed_offer(text).alias("o")).select("page_id", "o.price", "o.currency", "o.sku", "o.in_stock")


STORE, DAY = "CASE page_id % 3 WHEN 0 THEN 'Shop #1' WHEN 1 THEN '007' ELSE 'b-c' END", "concat('2024-03-0', CAST(page_id % 4 + 1 AS STRING))"


@query(f"SELECT page_id, lower(regexp_replace({STORE}, '[^a-zA-Z0-9_-]', '_', 'g')) AS store_key, {DAY} AS day, substr(sha256(url), 1, 12) AS url_key, md5(CASE WHEN page_id % 5 = 0 THEN '' ELSE coalesce(html, '') END) AS body FROM pages")
def raw_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages saved by store and day, all of them twice, and read back."""
    root = scratch_path(spark, "raw")
    html = F.when(F.col("page_id") % 5 == 0, F.lit(None)).otherwise(F.col("html"))
    fetched = pages(spark, sf_dir).select("page_id", "url", F.expr(STORE).alias("store"), F.expr(DAY).alias("scraped_at"), html.alias("html"))
    for _ in range(2):
        W.save(fetched, root)
    return W.load_pages(spark, root).select("page_id", "store_key", "day", "url_key", F.md5("html").alias("body"))
