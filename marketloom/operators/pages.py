"""Page extraction: titles, links, prices, product gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.functions.parsing import bound, money


def title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r'(?i)<a\s+[^>]*href="([^"]*)"'), 1)


def meta(html: Column, name: str) -> Column:
    return F.regexp_extract(html, rf'(?i)<meta[^>]*(?:name|property)="{name}"[^>]*content="([^"]*)"', 1)


def json_ld(html: Column) -> Column:
    """The first block of linked data, as text; null if there is none."""
    return F.nullif(F.regexp_extract(html, r'(?is)<script[^>]*type="application/ld\+json"[^>]*>(.*?)</script>', 1), F.lit(""))


def offer(html: Column) -> Column:
    """struct(price, in_stock) of a product page: linked data first, then a price element; stock unless said otherwise."""

    def read(page: Column) -> Column:
        data = json_ld(page)
        price = F.coalesce(F.get_json_object(data, "$.offers.price").try_cast("double"), money(F.nullif(F.regexp_extract(page, r'(?is)class="price"[^>]*>([^<]+)<', 1), F.lit(""))))
        said = F.coalesce(F.get_json_object(data, "$.offers.availability"), F.lit(""))
        return F.struct(price.alias("price"), (~(said.contains("OutOfStock") | F.lower(page).contains("out of stock"))).alias("in_stock"))

    return bound(html, read)


def table_rows(html: Column) -> Column:
    """Cells of table rows with exactly two: [(key, value)], markup removed."""
    rows = F.regexp_extract_all(html, F.lit(r"(?is)<tr[^>]*>\s*<t[hd][^>]*>([^<]*)</t[hd]>\s*<td[^>]*>[^<]*</td>\s*</tr>"), 0)
    cell = lambda r, k: F.trim(F.regexp_extract(r, r"(?is)<t[hd][^>]*>([^<]*)</t[hd]>\s*<td[^>]*>([^<]*)</td>", k))
    return F.filter(F.transform(rows, lambda r: F.struct(cell(r, 1).alias("key"), cell(r, 2).alias("value"))), lambda s: F.length(s["key"]).between(1, 50) & (F.length(s["value"]) < 250))


def gate(text: Column, vetoes: list[tuple[str, str]], exceptions: str | None = None) -> Column:
    """The reason of the first pattern that speaks against a product, ``ok`` if none does; exceptions overrule."""
    out = F.lit("ok")
    for reason, pattern in reversed(vetoes):
        out = F.when(text.rlike(pattern), reason).otherwise(out)
    return out if exceptions is None else F.when(text.rlike(exceptions), "ok").otherwise(out)


def split(df: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """What passes a gate, and the log of what doesn't."""
    marked = df.withColumn("reason", reason)
    return marked.where("reason = 'ok'").drop("reason"), marked.where("reason != 'ok'")


#: A JSON text's tokens as far as brackets go: whole strings (an unclosed one takes the rest), brackets, and what lies between.
_TOKENS = r'("[^"\\]*+(?:\\.[^"\\]*+)*+"|"[\s\S]*|[{}]|[^{}"]+)'


def balanced(text: Column) -> Column:
    """The object that a text begins with, up to the bracket that closes it; brackets and quotes inside strings don't count.  Null if it is never closed or is no JSON."""

    def step(s: Column, token: Column) -> Column:
        depth = s["depth"] + F.when(token == "{", 1).when(token == "}", -1).otherwise(0)
        at = s["at"] + F.length(token)
        return F.struct(depth.alias("depth"), at.alias("at"), F.when(s["end"] > 0, s["end"]).when((depth == 0) & (token == "}"), at).otherwise(0).alias("end"))

    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(0).alias("end"))
    end = F.aggregate(F.regexp_extract_all(text, F.lit(_TOKENS)), start, step)["end"]
    found = bound(end, lambda n: F.when(n > 0, F.substring(text, F.lit(1), n)))
    return bound(found, lambda x: F.when(F.try_parse_json(x).isNotNull(), x))


def json_around(text: Column, anchor: str, attempts: int = 32) -> Column:
    """The innermost JSON object around the first ``anchor`` in a text (a streamed payload, say), as text.

    Opening brackets before the anchor are tried from the nearest one on, at
    most ``attempts`` of them; the first whose object is whole, is JSON and
    reaches past the anchor counts.  Null without an anchor or such an object,
    and for null texts.
    """

    def around(text: Column, at: Column, before: Column) -> Column:
        gaps = F.slice(F.reverse(F.split(before, r"\{")), 1, attempts)  # from the anchor backwards, what follows each bracket
        count = F.least(F.size(F.split(before, r"\{")) - 1, F.lit(attempts))

        def place(gaps: Column) -> Column:
            at_bracket = lambda j: F.length(before) - F.aggregate(F.slice(gaps, F.lit(1), j), F.lit(0), lambda s, g: s + F.length(g)) - j + 1
            return bound(count, lambda n: F.when(n > 0, F.transform(F.sequence(F.lit(1), n), at_bracket)).otherwise(F.array().cast("array<int>")))

        def attempt(p: Column) -> Column:
            return bound(balanced(F.substring(text, p, F.length(text))), lambda found: F.when(p + F.length(found) - 1 >= at, found))

        return F.aggregate(bound(gaps, place), F.lit(None).cast("string"), lambda found, p: F.coalesce(found, attempt(p)))

    def inside(text: Column) -> Column:
        return bound(F.locate(anchor, text), lambda at: F.when(at > 0, bound(F.substring(text, F.lit(1), at - 1), lambda before: around(text, at, before))))

    return bound(text, inside)


def streamed_offer(text: Column, anchor: str = '"price"') -> Column:
    """struct(price, currency, sku, in_stock) of the object around a streamed payload's first price; all null if there is none."""
    fields = "price string, priceCurrency string, sku string, availability string, in_stock boolean"

    def read(data: Column) -> Column:
        stock = F.coalesce(data["in_stock"], ~data["availability"].contains("OutOfStock"))
        return F.struct(data["price"].try_cast("double").alias("price"), data["priceCurrency"].alias("currency"), data["sku"].alias("sku"), stock.alias("in_stock"))

    return bound(F.from_json(json_around(text, anchor), fields), read)
