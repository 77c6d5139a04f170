"""Coercions and validators of scraped values, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"(-?\d+(?:\.\d+)?)"


def first_number(text: Column) -> Column:
    return F.regexp_extract(text, NUMBER, 1).try_cast("double")


def first_integer(text: Column) -> Column:
    return F.floor(first_number(text)).try_cast("int")


def truthy(text: Column) -> Column:
    return F.lower(F.trim(text)).isin("true", "yes", "1", "y", "on")


def shortened(text: Column, most: int) -> Column:
    t = F.trim(text)
    return F.when(F.length(t) > 0, F.substring(t, 1, most))


def listed(text: Column) -> Column:
    """The non-empty parts of a comma-separated text."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: F.length(x) > 0)


def hdr_flag(label: Column) -> Column:
    """Whether an HDR label says yes: negative words and prefixes say no, any other text yes."""
    t = F.lower(F.trim(label))
    negative = t.isin("", "no", "none", "false", "n/a", "0", "not supported") | t.startswith("no ") | t.startswith("non-") | t.startswith("without ")
    return F.when(label.isNotNull(), ~negative)


def finite(v: Column) -> Column:
    x = v.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def _western(text: Column) -> Column:
    return F.translate(text, "٠١٢٣٤٥٦٧٨٩", "0123456789")


def money(text: Column) -> Column:
    """A positive price out of a text: Eastern Arabic digits, currency words left out, blanks within the number too.

    With both marks the last one is decimal; commas alone separate thousands,
    and a point alone is decimal.
    """
    t = F.regexp_replace(_western(text), r"(?iU)\b(?:egp|le|l\.e|جنيه|ج\.م)\b", "")

    def plain(run: Column) -> Column:
        european = run.rlike(r"\..*,[^.]*$")  # both marks, the comma last
        return F.when(european, F.translate(F.translate(run, ".", ""), ",", ".")).otherwise(F.translate(run, ",", ""))

    def value(number: Column) -> Column:
        return F.when(number.rlike(r"^\d+\.?\d*$") & (number.try_cast("double") > 0), number.try_cast("double"))

    return bound(bound(F.translate(F.regexp_extract(t, r"(\d[\d,. ]*)", 1), " ", ""), plain), value)


def shown_money(text: Column) -> Column:
    """struct(value, shown) of a price text: the first run of digits and commas, with two decimals if a point and two digits follow; ``shown`` is the text itself if there is none."""
    run = F.translate(F.regexp_extract(_western(text), r"([\d,]+(?:\.\d{2})?)", 1), ",", "")
    value = F.when(F.length(text) > 0, run.try_cast("double"))
    shown = F.when(value.isNotNull(), F.concat(F.format_number(value, 2), F.lit(" EGP"))).when(F.length(text) > 0, F.trim(text))
    return F.struct(value.alias("value"), shown.alias("shown"))


#: What the validators accept.
RAM_SIZES = (4, 8, 12, 16, 20, 24, 32, 36, 40, 48, 64, 96, 128, 192)
VRAM_SIZES = (2, 4, 6, 8, 10, 12, 16, 24)
#: Least and greatest value, and to how many digits it is kept (0: whole numbers).
BOUNDS = {
    "display_inches": (10, 18.5, 1), "refresh_hz": (60, 480, 0), "battery_wh": (25, 99.9, 1), "adapter_w": (30, 500, 0), "weight_kg": (0.7, 5.5, 2), "speakers": (1, 8, 0), "nits": (150, 3000, 0), "response_ms": (0.1, 35, 2), "npu_tops": (5, 150, 1),
    "gpu_boost_mhz": (500, 3200, 0), "gpu_w": (20, 250, 0), "warranty_years": (1, 5, 0), "memory_slots": (0, 8, 0), "storage_slots": (1, 6, 0),
}
#: Lengths in millimetres: what is taken for centimetres, and the bounds.
LENGTHS = {"height_mm": ((0.5, 6), (6, 60)), "width_mm": ((15, 60), (180, 500)), "depth_mm": ((10, 45), (140, 400))}
#: Names of memory families and of panels.
MEMORY_TYPES = {"DDR4": "DDR4", "DDR 4": "DDR4", "DDR5": "DDR5", "DDR 5": "DDR5", "LPDDR4": "LPDDR4", "LPDDR4X": "LPDDR4X", "LPDDR5": "LPDDR5", "LPDDR5X": "LPDDR5X", "UNIFIED MEMORY": "Unified Memory", "UNIFIED": "Unified Memory"}
PANELS = {"IPS": "IPS", "OLED": "OLED", "AMOLED": "AMOLED", "TN": "TN", "VA": "VA", "WVA": "WVA", "MINI-LED": "Mini-LED", "MINI LED": "Mini-LED", "MINILED": "Mini-LED"}
#: Words that don't belong into a field, or must be in it.
SPEC_WORDS = ("RAM", "SSD", "HDD", "RTX", "GTX", "GEFORCE", "INTEL", "RYZEN", "WINDOWS", "FREEDOS")
FAMILY_WORDS = ("RAM", "SSD", "RTX", "GTX", "INTEL", "RYZEN")
GENERIC_WORDS = ("NONE", "N/A", "LAPTOP", "GAMING LAPTOP")
PAINTS = ("silver", "grey", "gray", "black", "blue", "white", "gold", "mica", "eclipse", "cosmos", "shadow", "luna", "platinum", "dark ash")
SPEAKER_WORDS = ("speaker", "speakers", "2w x 2", "2w × 2", "4w total", "realtek", "woofer", "tweeter", "dts audio", "hi-res audio", "dolby atmos")
SPEAKERS = r"(?i)\b(?:" + "|".join(w.replace(" x ", r"\s*x\s*").replace(" × ", r"\s*×\s*").replace(" ", r"\s+") for w in SPEAKER_WORDS) + r")\b"


def _verdict(value: Column, known: Column, fine: Column, why: Column | str) -> Column:
    ok = known & F.coalesce(fine, F.lit(False))
    reason = F.lit(why) if isinstance(why, str) else why
    return F.struct(ok.alias("ok"), F.when(ok, value).alias("value"), F.when(~known, "type_error").when(~ok, reason).alias("reason"))


def validated(kind: str, value: Column, most: Column | None = None, least: Column | None = None) -> Column:
    """struct(ok, value, reason) of a physical quantity; ``most`` and ``least`` are what the processor allows or needs, if known."""
    return bound(value, lambda v: _validated(kind, v, most, least))


def _validated(kind: str, value: Column, most: Column | None, least: Column | None) -> Column:
    v = value.try_cast("double")
    if kind in LENGTHS:
        (low, high), bounds = LENGTHS[kind]
        mm = F.round(F.when((v >= low) & (v < high), v * 10).otherwise(v), 2)
        return F.when(value.isNull(), F.struct(F.lit(True).alias("ok"), F.lit(None).cast("double").alias("value"), F.lit(None).cast("string").alias("reason"))).otherwise(_verdict(mm, v.isNotNull(), mm.between(*bounds), f"outside {bounds[0]}..{bounds[1]}"))
    digits = BOUNDS[kind][2] if kind in BOUNDS else 0
    if not digits:  # whole numbers: a text that is none is of a wrong type, a number is cut
        v = F.when((F.typeof(value) != "string") | value.cast("string").rlike(r"^\s*[+-]?\d+\s*$"), F.floor(v).cast("double"))
    if kind in ("ram_gb", "vram_gb"):
        fine, why = v.isin(*[float(x) for x in (RAM_SIZES if kind == "ram_gb" else VRAM_SIZES)]), F.lit("not a memory size")
    else:
        low, high, _ = BOUNDS[kind]
        exact = kind in ("response_ms", "npu_tops")  # checked as they are, rounded then
        fine, why = (v if exact or not digits else F.round(v, digits)).between(low, high), F.lit(f"outside {low}..{high}")
        v = F.round(v, digits) if digits else v
    if most is not None:
        why = F.when(fine, "more than the processor takes").otherwise(why)
        fine = fine & ~F.coalesce(v > most, F.lit(False))
    if least is not None:
        why = F.when(fine, "less than the processor needs").otherwise(why)
        fine = fine & ~F.coalesce(v < least, F.lit(False))
    return _verdict(v, v.isNotNull(), fine, why)


def validated_text(kind: str, value: Column, supported: Column | None = None) -> Column:
    """struct(ok, value, reason) of a named property; ``supported`` lists the processor's memory families."""
    t = F.trim(value)
    up, low, known = F.upper(t), F.lower(t), value.isNotNull() & (value != "")
    has = lambda text, words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))
    if kind == "memory_type":
        name = F.lit(None).cast("string")
        for said, canonical in MEMORY_TYPES.items():
            name = F.when(up == said, canonical).otherwise(name)
        fits = F.lit(True) if supported is None else F.coalesce(F.size(supported) <= 0, F.lit(True)) | F.exists(supported, lambda s: F.contains(F.upper(name), F.upper(s)) | F.contains(F.upper(s), F.upper(name))) | (name == "Unified Memory")
        return _verdict(name, known, name.isNotNull() & F.coalesce(fits, F.lit(True)), F.when(name.isNull(), "unknown type").otherwise("not for this processor"))
    if kind in ("mpn", "family"):
        words, generic = (SPEC_WORDS, (*GENERIC_WORDS, "NOTEBOOK")) if kind == "mpn" else (FAMILY_WORDS, GENERIC_WORDS)
        length = F.length(t).between(3, 40) if kind == "mpn" else F.lit(True)
        return _verdict(F.initcap(t) if kind == "family" else t, known, ~has(up, words) & ~up.isin(*generic) & length, F.when(has(up, words), "a specification").when(up.isin(*generic), "a generic word").otherwise("length"))
    if kind == "microphone":
        named = F.trim(F.regexp_extract(t, r"(?i)\b([^,;]*(?:microphone|mic)[^,;]*)\b", 1))
        yes = low.isin("true", "yes")
        clean = F.when(yes, "Built-in microphone").when(~t.rlike(SPEAKERS), t).when((named != "") & ~named.rlike(SPEAKERS), named)
        return _verdict(clean, known, clean.isNotNull(), "about speakers")
    if kind == "panel":
        name = F.lit(None).cast("string")
        for said, canonical in reversed(PANELS.items()):
            name = F.when(up.rlike(rf"\b{said}\b"), canonical).otherwise(name)
        return _verdict(name, known, name.isNotNull(), "unknown panel")
    if kind == "webcam":
        return _verdict(t, known, t.rlike(r"(?i)\b(\d{3,4}\s*p|HD|FHD|QHD|\d+(?:\.\d+)?\s*(?:MP|M\b))\b"), "unknown resolution")
    if kind == "bluetooth":
        version = F.regexp_extract(t, r"(?i)\b(?:Bluetooth|BT)?\s*v?([4-6](?:\.[0-4])?)\b", 1)
        return _verdict(F.concat(F.lit("Bluetooth "), version, F.when(version.contains("."), "").otherwise(".0")), known, version != "", "unknown version")
    if kind == "gamut":
        standard = has(low, ("srgb", "ntsc", "dci-p3", "adobe rgb"))
        paint = has(low, PAINTS) & ~standard
        return _verdict(t, known, ~paint & (standard | low.contains("color gamut") | t.contains("%")), F.when(paint, "a colour of the case").otherwise("no standard"))
    if kind == "storage_form":
        return _verdict(t, known, has(low, ("m.2", "2280", "2242", "2230", "2.5-inch", '2.5"', "emmc", "ufs")), "unknown form")
    raise ValueError(f"no validator for {kind}")


def dimensions(values: Column) -> Column:
    """Width, depth and height in millimetres, longest first; centimetres are recognised by their size; null if there aren't three or they are out of bounds."""
    cm = F.forall(values, lambda x: x < 60) & (F.array_min(values) < 4.5)
    ordered = F.reverse(F.array_sort(F.when(cm, F.transform(values, lambda x: x * 10)).otherwise(values)))
    fine = (F.size(values) == 3) & F.get(ordered, 0).between(250, 460) & F.get(ordered, 1).between(170, 320) & F.get(ordered, 2).between(8, 40)
    return F.when(fine, F.transform(ordered, lambda x: F.round(x, 1)))


def moment(text: Column, zone: bool = True) -> Column:
    """A time in ISO form, in UTC; one that ends in Z is read only if ``zone`` is on."""
    t = F.when(text.endswith("Z") & F.lit(not zone), None).otherwise(text)
    return F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:\d{2})?)?$"), F.try_to_timestamp(t))


def missing_cause(value: Column, seen: Column, candidate: Column, rejected: Column, enriched: Column) -> Column:
    """Why a field is empty: the first cause that applies."""
    return (
        F.when(value.isNotNull(), "present").when(~seen, "not_in_source").when(candidate.isNull(), "not_extracted").when(rejected, "rejected_by_validator").when(~enriched, "not_enriched").otherwise("unknown")
    )
