"""Normal forms of titles, part numbers and hardware, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def slug(text: Column) -> Column:
    """Lower case, letters and digits, everything else one underscore; none at the ends."""
    t = F.regexp_replace(F.lower(F.trim(text)), "[®™©'\"‎‏‪-‮]", "")
    return F.regexp_replace(F.regexp_replace(t, "[^a-z0-9]+", "_"), "^_+|_+$", "")


#: Tokens that stand where a part number is missing.
NO_PART_NUMBERS = ("NONE", "N/A", "NA", "UNKNOWN", "LAPTOP", "MODEL", "NOTEBOOK", "GAMING", "BLACK", "GREY", "SILVER", "DOS", "WIN11")


def part_number(text: Column) -> Column:
    """Up to ``#`` or ``/``, without separators, upper case; of a longer one the vendor's own ten characters at its end; null for short ones and stand-ins."""
    head = F.regexp_extract(F.trim(text), "^([^#/]*)", 1)
    t = F.upper(F.regexp_replace(head, r"[\s\-_.]", ""))
    t = F.when(F.length(t) > 10, F.coalesce(F.nullif(F.regexp_extract(t, "([82][0-9A-Z]{9})$", 1), F.lit("")), t)).otherwise(t)
    return F.when((F.length(t) >= 5) & ~t.isin(*NO_PART_NUMBERS) & ~t.startswith("LAPTOP") & ~t.startswith("NOTEBOOK"), t)


def fingerprint(parts: list[Column]) -> Column:
    """The slugs of all parts, unknown ones as ``na``, joined by a bar."""
    return F.concat_ws("|", *[F.coalesce(F.nullif(slug(p.cast("string")), F.lit("")), F.lit("na")) for p in parts])


def canonical_id(brand: Column, mpn: Column, hardware: list[Column]) -> Column:
    """By part number where there is one, else by hardware."""
    by_hardware = F.concat_ws("_", slug(brand), *[slug(h.cast("string")) for h in hardware])
    return F.when(mpn.isNotNull(), F.concat_ws("_", slug(brand), F.lower(mpn))).otherwise(by_hardware)


def clean_title(text: Column) -> Column:
    """Without marketing words, brackets and doubled blanks."""
    t = F.regexp_replace(text, r"(?i)\b(new|original|official|warranty|free shipping|best price|offer)\b", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"[\[\]()|]", " "), r"\s+", " "))


def western_digits(text: Column) -> Column:
    return F.translate(text, "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹", "01234567890123456789")


def sanitised(text: Column) -> Column:
    """Zero-width and odd blanks, trademark signs, dashes of all kinds, footnote marks: plain text on one line."""
    t = F.regexp_replace(text, "[​-‏﻿ ]", " ")
    t = F.regexp_replace(t, "[®™©]", " ")
    t = F.regexp_replace(t, "[‐-―−]", "-")
    t = F.regexp_replace(t, r"\[\d+\]|\(\d\)", "")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


#: What stands for an empty cell.
PLACEHOLDERS = ("", "-", "--", "n/a", "na", "none", "null", "unknown", "not specified", "tbd")


def is_placeholder(text: Column) -> Column:
    return text.isNull() | F.lower(F.trim(text)).isin(*PLACEHOLDERS)


def folded_arabic(text: Column) -> Column:
    """Arabic letters that readers take for one another as one; vowel signs dropped."""
    return F.regexp_replace(F.translate(text, "أإآٱىةؤئ", "ااااي" + "هوي"), "[ً-ْـ]", "")


def model_tokens(text: Column) -> Column:
    """Tokens of letters and digits mixed, at least four long, upper case."""
    return F.filter(F.split(F.upper(text), "[^A-Z0-9-]+"), lambda x: x.rlike("[A-Z]") & x.rlike("[0-9]") & (F.length(x) >= 4))


def comparable(token: Column) -> Column:
    """A token for comparison: no blanks, dashes or underscores, lower case; empty for null."""
    return F.coalesce(F.lower(F.regexp_replace(token, r"[\s\-_]+", "")), F.lit(""))


#: How tokens of components begin.
COMPONENTS = ("RTX", "GTX", "RX", "CORE", "RYZEN", "DDR", "SSD", "NVME")


def is_component(token: Column) -> Column:
    return F.exists(F.array(*map(F.lit, COMPONENTS)), lambda p: F.startswith(F.upper(token), p))


def chassis_key(brand: Column, family: Column, model: Column) -> Column:
    """brand:family:model root; parts that are missing are ``generic``."""
    root = F.regexp_extract(F.upper(model), "([A-Z]*[0-9]+[A-Z]*)", 1)
    part = lambda c: F.coalesce(F.nullif(slug(c), F.lit("")), F.lit("generic"))
    return F.concat_ws(":", part(brand), part(family), part(root))


def clonable(key: Column) -> Column:
    parts = F.split(key, ":")
    return (F.size(parts) >= 3) & ~F.exists(parts, lambda p: p.isin("generic", "unknown", ""))


def key_values(text: Column) -> Column:
    """``Key: value`` lines of a text as a map; bullets dropped, keys up to 60 characters, the first of a key counts."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(F.trim(x), r"^[•*\-•]\s*", ""))
    pairs = F.transform(F.filter(lines, lambda x: x.rlike(r"^[^:：]{1,60}[:：].+")), lambda x: F.struct(F.trim(F.regexp_extract(x, r"^([^:：]+)[:：]", 1)).alias("key"), F.trim(F.regexp_extract(x, r"^[^:：]+[:：](.*)$", 1)).alias("value")))
    first = F.filter(pairs, lambda p, i: F.array_position(F.transform(pairs, lambda q: q["key"]), p["key"]) == i + 1)
    return F.map_from_entries(first)
