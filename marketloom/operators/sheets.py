"""Specification sheets: twelve categories of fields out of a title and a table in sections.

Rows (section, key, value) are routed to buckets by their keys.  Each field has
stages: rows of its buckets, the section that is about its category, the title,
and what follows from other fields.  The first stage that gives a value wins and
is named beside it; required fields that no stage resolves are kept as
envelopes with the text in which they were looked for.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.functions import details as D
from marketloom.functions import specs as S
from marketloom.sources.tables import spread, tasks

#: How far a stage is trusted.
CONFIDENCE = {"table": 1.0, "section": 0.8, "title": 0.6, "derived": 0.5}

#: Labels of rows by bucket; a key that is one of them needs no rule.
LABELS = {
    "display_brightness": ["brightness", "display brightness"], "display_gamut": ["color gamut", "color coverage", "display color gamut"], "display_response_time": ["response time"], "display_surface": ["surface treatment", "display surface"], "display_hdr": ["hdr", "display hdr"],
    "memory_speed": ["memory speed", "ram speed"], "memory_type": ["memory type", "ram type"], "gpu_boost": ["gpu boost clock", "boost clock"], "ai_npu": ["npu", "ai acceleration", "system ai accelerator"], "ai_performance": ["ai performance"], "storage_interface": ["storage interface", "ssd interface"],
    "weight": ["weight", "product weight"], "color": ["color", "product color", "case color"], "materials": ["material", "case material", "chassis material"], "warranty": ["warranty"], "condition": ["condition"], "brand": ["brand", "manufacturer"], "model": ["model", "model name", "laptop model"],
    "keyboard": ["keyboard", "keyboard backlight", "input device"], "pointing_device": ["touchpad", "pointing device"], "connectivity_and_ports": ["connectivity & ports"], "camera_and_audio": ["camera & audio"],
}

#: Buckets of other keys: the first rule whose words the key has.
RULES = [
    ("package_dimensions", r"package weight|packaging weight|weight in packaging"), ("unrouted", r"cloud service|dropbox|cloud storage"), ("", ""), ("unrouted", r"^(?=.*[.!]$)\S+(?:\s+\S+){2,}$"),
    ("max_storage", r"max storage|maximum storage|storage support|storage capability"), ("storage_slots", r"storage slot|m\.2 slot|expansion slot"), ("storage", r"\b(?:storage|ssd|hdd|hard\s+disk|hard\s+drive|rom)\b"),
    ("gpu_vram", r"graphics memory|video memory|gpu memory|vram|gddr"), ("gpu_power", r"gpu power|graphics power|tgp|\bpower\b.*\b(?:gpu|rtx|gtx|graphics|geforce|radeon)\b|\b(?:gpu|rtx|gtx|graphics|geforce|radeon)\b.*\bpower\b"), ("max_memory", r"max memory|maximum memory|max ram"), ("memory_slots", r"memory slot|ram slot"),
    ("gpu", r"\b(?:graphics?|gpu|vga|video)\b"), ("memory", r"\b(?:ram|memory)\b"), ("cpu", r"\b(?:cpu|processor)\b"), ("power", r"\b(?:battery|adapter|charging|charger|power)\b"), ("os", r"\b(?:operating\s+system|os)\b"),
    ("display", r"\b(?:display|screen|resolution|refresh\s+rate|panel|aspect\s+ratio|touchscreen|oled|amoled|ips)\b"), ("dimensions", r"\bdimensions?\b"), ("ports", r"usb|hdmi|thunderbolt|rj-?45|ethernet port|combo audio jack|headphone|audio jacks|\bports?\b"), ("camera", r"\b(?:webcam|camera)\b"), ("audio", r"microphone|speakers|nahimic|smart amp"),
    ("security", r"tpm|biometric|finger ?print|windows hello|kensington|\bsecurity\b"), ("connectivity", r"wi-?fi|bluetooth|wireless|wired networking"), ("card_reader", r"card reader|microsd|sd card"),
]

#: Buckets that also count as others.
ALSO = {
    "display": ["display_brightness", "display_gamut", "display_response_time", "display_surface", "display_hdr"], "memory": ["memory_speed", "memory_type"], "gpu": ["gpu_vram", "gpu_power", "gpu_boost"], "cpu": ["ai_npu", "ai_performance"], "physical": ["materials", "dimensions", "weight"], "connectivity": ["card_reader", "ports", "connectivity_and_ports"],
    "identity": ["warranty", "condition", "brand", "model", "color"], "camera": ["camera_and_audio"], "audio": ["camera_and_audio"], "ports": ["connectivity_and_ports"],
}


def normal_key(key: Column) -> Column:
    """Lower case, colons and white space as one space, marks gone, Arabic letters folded."""
    k = F.trim(F.regexp_replace(F.lower(key), r"[:\s]+", " "))
    k = F.regexp_replace(F.regexp_replace(k, "[®™©‎‏​ ]", ""), "[إأآ]", "ا")
    return F.trim(F.regexp_replace(F.regexp_replace(k, "ة", "ه"), "[ً-ٟ]", ""))


def bucket(key: Column) -> Column:
    """The bucket of a row's key: packaging and cloud rows first, then labels, then rules in order."""
    return F.get(F.transform(F.array(normal_key(key)), _bucket_of), F.lit(0))  # the normal key is worked out once, not once a rule


def _bucket_of(k: Column) -> Column:
    out = F.lit("unrouted")
    for name, pattern in reversed(RULES):
        if name:
            out = F.when(k.rlike(pattern), name).otherwise(out)
        else:
            for label, words in LABELS.items():
                out = F.when(k.isin(words), label).otherwise(out)
    return out


@dataclass(frozen=True)
class Category:
    """Rows of ``buckets`` (or, if there are none, with a key that has one of ``keys``), the section about it (a name with one of ``sections``), and buckets that count for its raw_spec only, or (``aside``) for its fields only."""

    buckets: tuple[str, ...]
    keys: str
    sections: str
    more: tuple[str, ...] = ()
    aside: tuple[str, ...] = ()


CATEGORIES = {
    "identity": Category(("identity",), r"brand|manufacturer", r"^$"),
    "cpu": Category(("cpu",), r"processor|cpu", r"^$"),
    "gpu": Category(("gpu",), r"gpu|graphic|vga|video", r"graphics|gpu|vga|video"),
    "memory": Category(("memory",), r"ram\b|memory", r"memory|\bram\b", ("max_memory", "memory_slots")),
    "storage": Category(("storage", "storage_interface"), r"storage|ssd|hdd|disk", r"storage|ssd|hard drive|hdd", ("max_storage", "storage_slots")),
    "display": Category(("display",), r"display|screen|panel", r"display|screen"),
    "power_battery": Category(("power",), r"battery|power|adapter", r"battery|power|adapter"),
    "physical": Category(("physical",), r"dimension|weight", r"dimension|weight|physical", ("package_dimensions",), ("materials",)),
    "connectivity": Category(("connectivity", "ports"), r"wireless|network|ports|i/o", r"connectivity|network|port|wireless"),
    "operating_system": Category(("os",), r"^os$|operating system", r"connectivity|network|port|wireless"),
    "build_security": Category(("keyboard", "security", "pointing_device", "materials"), r"keyboard|security|fingerprint|touchpad|material", r"security|keyboard|touchpad|pointing|fingerprint", (), ("materials",)),
    "audio_webcam": Category(("camera", "audio"), r"camera|webcam|speaker|audio|microphone", r"audio|sound|speaker|webcam|camera|microphone"),
}


def _in(buckets: tuple[str, ...]) -> list[str]:
    return [x for b in buckets for x in (b, *ALSO.get(b, []))]


def _values(rows: Column, keep: Callable[[Column], Column], keyed: bool = False) -> Column:
    """Values of the rows that are kept, one a line; null if there are none."""
    kept = F.transform(F.filter(rows, keep), lambda r: F.concat(r["key"], F.lit(": "), r["value"]) if keyed else r["value"])
    return F.nullif(F.array_join(kept, "\n"), F.lit(""))


def _by_bucket(rows: Column, keyed: bool) -> Column:
    """bucket -> its rows' values (or ``key: value``), one a line."""
    line = lambda r: F.concat(r["key"], F.lit(": "), r["value"]) if keyed else r["value"]
    of = lambda b: F.array_join(F.transform(F.filter(rows, lambda r: r["bucket"] == b), line), "\n")
    return F.map_from_entries(F.transform(F.array_distinct(rows["bucket"]), lambda b: F.struct(b.alias("key"), of(b).alias("value"))))


def of_bucket(*buckets: str, keyed: bool = False) -> Column:
    """Values of the rows of buckets, those that also count as them after their own; null if there are none."""
    texts = [F.col("__keyed" if keyed else "__plain")[b] for b in _in(buckets)]
    return texts[0] if len(texts) == 1 else F.nullif(F.concat_ws("\n", *texts), F.lit(""))


def of_key(pattern: str, veto: str = r"^\b$", keyed: bool = False) -> Column:
    return _values(F.col("rows"), lambda r: D.says(r["key"], pattern) & ~D.says(r["key"], veto), keyed)


def of_section(pattern: str) -> Column:
    """The rows of the first section whose name has the pattern."""
    first = F.get(F.filter("__sections", lambda s: D.says(s, pattern)), F.lit(0))
    kept = F.transform(F.array(first), lambda f: _values(F.col("rows"), lambda r: r["section"] == f, keyed=True))  # the section is looked for once, not once a row
    return F.get(kept, F.lit(0))


def routed(df: DataFrame, title: str = "title", table: str = "rows") -> DataFrame:
    """``df`` with its rows' buckets and, for every category, t_<name> (its rows' values) and s_<name> (the first section about it, else rows whose key names it)."""
    rows = F.transform(F.coalesce(F.col(table), F.array().cast("array<struct<section:string,key:string,value:string>>")), lambda r: F.struct(r["section"].alias("section"), F.trim(r["key"]).alias("key"), F.trim(r["value"]).alias("value"), bucket(r["key"]).alias("bucket")))
    df = df.withColumns({"title": F.coalesce(F.col(title), F.lit("")), "rows": F.filter(rows, lambda r: F.coalesce(r["value"], F.lit("")) != "")})
    df = df.withColumns({"__plain": _by_bucket(F.col("rows"), False), "__keyed": _by_bucket(F.col("rows"), True), "__sections": F.array_distinct(F.col("rows")["section"])})
    max_rows = r"max(?:imum)? (?:storage|memory)|storage support"
    texts: dict[str, Column] = {}
    for name, c in CATEGORIES.items():
        own = of_bucket(*c.buckets)
        texts[f"t_{name}"] = F.coalesce(own, of_key(c.keys, r"max|support|slot|optane|cache|rom\b" if name in ("memory", "storage") else r"^\b$"))
        texts[f"s_{name}"] = F.coalesce(of_section(c.sections), of_key(c.sections, max_rows, keyed=True))
    return df.withColumns(texts)


def raw(category: str, fallback: Column) -> Column:
    """Rows of a category as ``Key: Value`` joined by bars, equal ones (in any case) once, bars inside written as slashes; without rows the fallback."""
    bar = lambda c: F.regexp_replace(c, r" ?\| ?", "/")
    c = CATEGORIES[category]
    names = [b for b in _in(c.buckets + c.more) if b not in c.aside]
    mine = F.transform(F.filter("rows", lambda r: r["bucket"].isin(names)), lambda r: F.concat(bar(r["key"]), F.lit(": "), bar(r["value"])))
    both = F.transform(F.array(F.transform(mine, lambda y: F.struct(y.alias("text"), F.lower(y).alias("low")))), lambda m: F.struct(m.alias("m"), m["low"].alias("low")))
    firsts = F.transform(both, lambda b: F.transform(F.filter(b["m"], lambda x, i: F.array_position(b["low"], x["low"]) == i + 1), lambda x: x["text"]))
    first = F.get(firsts, F.lit(0))  # each row's text is put together once, not once for every row beside it
    title = F.concat(F.lit("Title: "), F.nullif(F.trim("title"), F.lit("")))
    if category == "identity":
        return F.nullif(F.concat_ws(" | ", bar(title), F.nullif(F.array_join(first, " | "), F.lit(""))), F.lit(""))
    return F.coalesce(F.nullif(F.array_join(first, " | "), F.lit("")), bar(fallback))


Stage = tuple[str, Column]


def _texts(category: str, title: bool = True) -> list[Stage]:
    return [("table", F.col(f"t_{category}")), ("section", F.col(f"s_{category}")), *([("title", F.col("title"))] if title else [])]


def _by(function: Callable[[Column], Column], stages: list[Stage]) -> list[Stage]:
    return [(name, function(text)) for name, text in stages]


def fields() -> dict[str, dict[str, list[Stage]]]:
    """Stages of every field whose value comes out of texts, in order."""
    name = D.listing_name(F.col("title"))
    mem, slots = of_bucket("memory", "memory_slots"), of_bucket("memory_slots")
    gpu = _texts("gpu")
    own = lambda category: _texts(category, title=False)
    return {
        "identity": {
            "brand": _by(D.brand, [("table", of_bucket("brand")), ("title", name), ("title", F.col("title"))]),
            "retailer_sku": _by(D.tidy, [("table", of_key(r"^(?:sku|retailer sku|item number|product code)$"))]),
            "part_number": [
                *_by(D.tidy, [("table", of_key(r"^(?:part number|product number|mpn)$"))]), *_by(D.part_form, [("table", of_key(r"^(?:model|sku|retailer sku|model number|product code)$"))]),
                ("title", D.found(F.col("title"), r"\b(8[0-3][A-Z0-9]{8})\b")), *_by(D.part_in_title, [("title", name), ("title", F.col("title"))]), *_by(D.tidy, [("table", of_key(r"part n|machine type|base unit", r"processor|cpu|gpu|graphic|video"))]),
            ],
            "family": [*_by(D.tidy, [("table", of_key(r"series|family", r"processor|cpu|gpu|graphic|video|model"))]), ("title", D.family(name, D.FAMILIES))],
            "model": [*_by(D.tidy, [("table", of_key(r"^(?:model name|laptop model|model / series|product model)$"))]), ("table", F.when(D.part_form(of_key(r"^model$")).isNull(), D.tidy(of_key(r"^model$"))))],
            "color": [*_by(D.colour, [("table", of_bucket("color"))]), ("title", D.colour_in_title(F.col("title")))],
            "warranty": _by(D.tidy, [("table", of_key(r"warranty", r"activate|note"))]),
            "warranty_years": _by(D.warranty_years, [("table", of_key(r"warranty", r"activate|note"))]),
            "condition": _by(D.condition, [("table", of_key(r"condition"))]) + [("title", D.told(F.col("title"), ("refurbished", "Refurbished"), ("open box", "Open Box")))],
        },
        "cpu": {"model": _by(S.cpu_model, _texts("cpu")), "npu_tops": _by(D.npu_tops, [("table", of_bucket("cpu"))]), "base_power_w": _by(D.base_power, [("table", of_bucket("cpu"))])},
        "gpu": {
            "model": _by(D.graphics, gpu), "vram_gb": [*_by(lambda t: D.number(t, r"(\d+)\s*gb?\b", 1, 24), [("table", of_bucket("gpu_vram"))]), *_by(S.vram_gb, gpu)],
            "power_w": _by(D.gpu_watts, [("table", of_bucket("gpu_power")), ("table", F.col("t_gpu"))]), "boost_mhz": _by(D.boost_mhz, [("table", of_bucket("gpu_boost")), ("table", F.col("t_gpu"))]), "ai_tops": _by(D.gpu_tops, [("table", of_bucket("ai_performance")), ("table", F.col("t_gpu"))]),
        },
        "memory": {
            "capacity_gb": _by(lambda t: F.coalesce(D.memory_gb(t), S.ram_gb(t)), _texts("memory")), "memory_type": _by(S.ram_type, _texts("memory")), "speed_mhz": _by(S.ram_mhz, own("memory")), "slot_count": _by(D.memory_slots, [("table", slots)]) + [("table", D.number(of_bucket("memory"), r"\(\s*(\d+)\s*x\s*\d+\s*(?:gb|g)?\s*\)", 1, 4))],
            "max_gb": _by(D.gigabytes, [("table", of_bucket("max_memory"))]), "soldered": _by(D.soldered, [("table", mem)]),
        },
        "storage": {
            "capacity_gb": _by(S.storage_gb, _texts("storage")), "kind": _by(S.storage_kind, _texts("storage")), "interface": _by(D.drive_interface, own("storage")), "form_factor": _by(D.form_factor, own("storage")), "slot_count": _by(D.drive_slots, [("table", of_bucket("storage_slots")), ("table", of_bucket("max_storage"))]),
            "max_gb": _by(D.gigabytes, [("table", of_bucket("max_storage"))]),
        },
        "display": {
            "inches": _by(S.display_inches, _texts("display")), "refresh_hz": _by(S.refresh_hz, _texts("display")), "resolution": _by(S.resolution, _texts("display")), "aspect_ratio": _by(D.ratio, own("display")), "panel": _by(S.panel, _texts("display")), "nits": _by(S.nits, own("display")), "gamut": _by(D.gamut, own("display")),
            "response_ms": _by(D.response_ms, own("display")), "surface": _by(D.surface, own("display")), "hdr": _by(D.hdr, own("display")), "touch": [("table", D.touch_row(of_key(r"touch", "pad"))), *[(source, F.when(t.isNotNull() & S.touch(t), True)) for source, t in _texts("display")]],
        },
        "power_battery": {"battery_wh": _by(S.battery_wh, own("power_battery")), "adapter_w": [("table", D.number(of_key(r"adapter|charger|power supply"), r"\b(\d{2,3})\s*w\b", 30, 500)), *_by(S.adapter_w, own("power_battery"))], "cells": _by(D.cells, own("power_battery")), "fast_charging": _by(D.fast_charge, [("table", of_key(r"(?:fast|rapid) charg", keyed=True)), *own("power_battery")])},
        "physical": {"weight_kg": _by(S.weight_kg, [("table", of_bucket("weight")), ("section", F.col("s_physical"))]), "size_mm": _by(D.sizes_mm, [("table", of_bucket("dimensions")), ("section", F.col("s_physical"))])},
        "connectivity": {
            "wifi": _by(S.wifi, own("connectivity")), "bluetooth": _by(D.bluetooth, own("connectivity")), "ports": _by(D.port_list, [("table", of_bucket("ports")), ("table", of_key(r"external i/o|\bports\b"))]), "ethernet": _by(D.tidy, [("table", of_key(r"ethernet|rj-?45|\blan\b", r"wlan|wireless"))]),
            "thunderbolt": _by(D.thunderbolt, own("connectivity")), "card_reader": _by(D.card_reader, [("table", of_bucket("card_reader"))]), "card_reader_kind": _by(D.card_kind, [("table", of_bucket("card_reader"))]),
        },
        "operating_system": {"name": _by(D.system, [("table", F.col("t_operating_system")), ("title", F.col("title")), ("section", F.col("s_operating_system"))])},
        "build_security": {
            "backlight": _by(D.backlight, [("table", of_bucket("keyboard", keyed=True)), ("title", F.col("title"))]), "numpad": _by(D.numpad, [("table", of_bucket("keyboard")), ("title", F.col("title"))]), "fingerprint": _by(D.fingerprint, [("table", of_bucket("security", keyed=True))]), "pointing_device": _by(D.tidy, [("table", of_bucket("pointing_device"))]),
            "material": _by(D.material, [("table", of_bucket("materials"))]), "security": _by(D.security_list, [("table", of_bucket("security"))]),
        },
        "audio_webcam": {
            "webcam": _by(D.webcam, [("table", of_bucket("camera"))]), "shutter": _by(D.shutter, own("audio_webcam")), "infrared": _by(D.infrared, own("audio_webcam")), "microphone": _by(D.microphone, [("table", of_bucket("audio", keyed=True))]), "speakers": _by(D.speaker_count, [("table", of_bucket("audio"))]),
        },
    }


#: Fields whose absence is kept as an envelope.
REQUIRED = [("identity", "family"), ("identity", "model"), ("identity", "part_number"), ("gpu", "model"), ("gpu", "vram_gb"), ("memory", "capacity_gb"), ("memory", "memory_type"), ("storage", "capacity_gb"), ("display", "inches"), ("display", "refresh_hz"), ("display", "panel"), ("power_battery", "battery_wh"), ("physical", "weight_kg")]

#: A required field that is named in its unit but out of bounds has failed its check.
NAMED = {"battery_wh": r"\d\s*w(?:att)?-?h", "weight_kg": r"\d\s*kg", "capacity_gb": r"\d\s*[gt]b", "vram_gb": r"\d\s*gb?\s*(?:vram|gddr)", "refresh_hz": r"\d\s*hz", "inches": r"\d\s*(?:inch|\")"}


def _resolved(stages: list[Stage]) -> Column:
    kinds = [F.when(value.isNotNull(), F.struct(value.alias("value"), F.lit(source).alias("source"), F.lit(CONFIDENCE[source]).alias("confidence"))) for source, value in stages]
    return F.coalesce(*kinds)


def _derived(of: str, value: Column) -> Column:
    """``of`` if resolved, else a value that follows from other fields."""
    return F.coalesce(F.col(of), _resolved([("derived", value)]))


def spec_sheets(df: DataFrame, key: str, title: str = "title", table: str = "rows") -> DataFrame:
    """One row per listing: ``key``, twelve structs, ``envelopes``.

    ``table`` is an array of (section, key, value).  Each struct has raw_spec
    and its fields, each of them null or (value, source, confidence).  Null or
    empty titles and tables resolve nothing and give envelopes only; repeated
    rows of a table count once in raw_spec; other columns don't take part.
    Listings of one title and table (a machine in many stores) are worked out
    once.
    """
    parts, contents = _parts(df, key, title, table)
    return _handed_out(parts, _sheets(contents), key)


def spec_values(df: DataFrame, key: str, title: str = "title", table: str = "rows") -> DataFrame:
    """``sheet_values`` of ``spec_sheets``, the values too put together once for all listings of one title and table."""
    parts, contents = _parts(df, key, title, table)
    sheets = _sheets(contents)
    values = _handed_out(parts, sheets.select("__of", "__parts", _cells(sheets).alias("__cells")), key)
    return values.select(key, F.explode_outer("__cells").alias("x")).where("x IS NOT NULL").select(key, "x.*")  # explode() would have Spark ask for the cells' number below the join, and write all fields out once more


def _parts(df: DataFrame, key: str, title: str, table: str) -> tuple[DataFrame, DataFrame]:
    """(__of, __part, __keys): the keys of a content's listings, in parts by their hash and at most ``BLOCK`` a row, since what is made of one row is held at once; (__of, __parts): each content once, with the parts that it has."""
    listings = df.select(F.col(key).alias("__key"), F.struct(F.col(title).alias("title"), F.col(table).alias("rows")).alias("__of"))
    listings = listings.withColumn("__part", F.pmod(F.xxhash64("__key"), F.lit(tasks(df.sparkSession))))
    parts = listings.groupBy("__of", "__part").agg(F.collect_list(F.struct("__key")).alias("__all"))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size("__all") - 1) / BLOCK).cast("int")), lambda b: F.slice("__all", b * BLOCK + 1, BLOCK))
    return parts.select("__of", "__part", F.explode(blocks).alias("__keys")), listings.groupBy("__of").agg(F.collect_set("__part").alias("__parts"))


#: Listings of one content whose rows are written out together.
BLOCK = 512


def _handed_out(parts: DataFrame, sheets: DataFrame, key: str) -> DataFrame:
    """``sheets`` (__of, __parts, others) for each listing; a merge join by hint, since listings are small as a file and would be broadcast with all their tables."""
    each = sheets.withColumn("__part", F.explode("__parts")).drop("__parts")
    mine = parts.hint("merge").join(each, ["__of", "__part"])
    return mine.select(F.explode("__keys").alias("__listing"), *[c for c in each.columns if c not in ("__of", "__part")]).withColumn("__listing", F.col("__listing.__key")).withColumnRenamed("__listing", key)


def _sheets(contents: DataFrame) -> DataFrame:
    """``contents`` (__of, __parts) with twelve structs and ``envelopes``."""
    base = routed(spread(contents).select("__of", "__parts", "__of.title", "__of.rows"))
    spec = fields()
    stages = {f"{c}__{f}__{k}": value for c, of in spec.items() for f, ways in of.items() for k, (_, value) in enumerate(ways)}
    out = base.withColumns(stages)
    out = out.withColumns({f"{c}__{f}": _resolved([(source, F.col(f"{c}__{f}__{k}")) for k, (source, _) in enumerate(ways)]) for c, of in spec.items() for f, ways in of.items()})
    v = lambda c, f: F.col(f"{c}__{f}")["value"]
    source = lambda c, f: F.col(f"{c}__{f}")["source"]
    qualifier = F.concat_ws(" ", v("identity", "family"), D.found(D.listing_name(F.col("title")), r"(?:^|\s)(\d{1,2}(?:\.\d)?|pro\s*\d{1,2}|hx|max|plus|ultra|go)$"))
    integrated, maker = D.graphics_built_in(v("gpu", "model")), D.graphics_maker(v("gpu", "model"))
    size = v("physical", "size_mm")
    same = lambda c, f, value: F.when(value.isNotNull(), F.struct(value.alias("value"), source(c, f).alias("source"), F.col(f"{c}__{f}")["confidence"].alias("confidence")))
    out = out.withColumns(
        {
            "identity__model": _derived("identity__model", F.when(v("identity", "family").isNotNull(), qualifier)), "identity__is_bundle": _resolved([("table", F.when(of_key(r"bundle|gift").isNotNull() & ~D.denied(of_key(r"bundle|gift")), True)), ("title", D.bundle(F.col("title")))]), "cpu__vendor": _resolved([("derived", S.cpu_vendor(v("cpu", "model")))]),
            "gpu__integrated": same("gpu", "model", integrated), "gpu__maker": same("gpu", "model", maker), "memory__soldered": _derived("memory__soldered", F.when(v("memory", "slot_count") > 0, False)), "display__aspect_ratio": _derived("display__aspect_ratio", S.aspect_ratio(v("display", "resolution"))),
            "physical__width_mm": same("physical", "size_mm", size["w"]), "physical__depth_mm": same("physical", "size_mm", size["d"]), "physical__height_mm": same("physical", "size_mm", size["h"]), "build_security__backlit": same("build_security", "backlight", v("build_security", "backlight") != "none"),
            "connectivity__ethernet": _derived("connectivity__ethernet", F.get(F.filter(v("connectivity", "ports"), lambda p: D.says(p, r"\b(?:rj-?45|ethernet|lan)\b")), F.lit(0))), "connectivity__card_reader": _derived("connectivity__card_reader", F.when(F.exists(v("connectivity", "ports"), lambda p: D.says(p, r"card reader|microsd|sd card")), True)),
        }
    )
    late = {"identity": ["is_bundle"], "cpu": ["vendor"], "gpu": ["integrated", "maker"], "physical": ["width_mm", "depth_mm", "height_mm"], "build_security": ["backlit"]}
    missing = []
    for c, f in REQUIRED:
        text = F.concat_ws("\n", *([F.col(f"t_{c}"), F.col(f"s_{c}")] if c != "identity" else [D.listing_name(F.col("title"))]))
        gone = F.col(f"{c}__{f}").isNull() & (F.coalesce(~F.col("gpu__integrated")["value"], F.lit(False)) if f == "vram_gb" else F.lit(True))
        named = D.says(text, NAMED[f]) if f in NAMED else F.lit(False)
        why = F.when(named, "validation_failed").otherwise("missing_key")
        if f == "weight_kg":  # only a weight that fails its check is asked for again
            gone = gone & named
        missing.append(F.when(gone, F.struct(F.lit(f"{c}.{f}").alias("field"), F.coalesce(F.nullif(text, F.lit("")), F.col("title")).alias("context"), why.alias("reason"))))
    fallback = lambda c: F.coalesce(F.col(f"s_{c}"), F.concat(F.lit("Title: "), F.nullif(F.trim(F.col("title")), F.lit(""))) if c == "cpu" else F.lit(None).cast("string"))
    structs = [F.struct(raw(c, fallback(c)).alias("raw_spec"), *[F.col(f"{c}__{f}").alias(f) for f in [*of, *late.get(c, [])] if f != "size_mm"]).alias(c) for c, of in spec.items()]
    return out.select("__of", "__parts", *structs, F.filter(F.array(*missing), lambda e: e.isNotNull()).alias("envelopes"))


def sheet_values(sheets: DataFrame, key: str) -> DataFrame:
    """(key, field, value, source): a row for each resolved field and each envelope (with its reason for a source), values as text."""
    return sheets.select(key, F.explode(_cells(sheets)).alias("x")).select(key, "x.*")


def _cells(sheets: DataFrame) -> Column:
    text = lambda f, kind: F.array_join(f, "; ") if kind.startswith("array") else f.cast("string")
    cells = []
    for c in CATEGORIES:
        for f in sheets.schema[c].dataType.fields:
            if f.name == "raw_spec":
                cells.append(F.struct(F.lit(f"{c}.raw_spec").alias("field"), F.col(f"{c}.raw_spec").alias("value"), F.lit("rows").alias("source")))
            else:
                x = F.col(f"{c}.{f.name}")
                cells.append(F.struct(F.lit(f"{c}.{f.name}").alias("field"), text(x["value"], f.dataType["value"].dataType.simpleString()).alias("value"), x["source"].alias("source")))
    gone = F.transform("envelopes", lambda e: F.struct(e["field"].alias("field"), F.lit("envelope").alias("value"), e["reason"].alias("source")))
    return F.concat(F.filter(F.array(*cells), lambda c: c["value"].isNotNull()), gone)
