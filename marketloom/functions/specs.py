"""Structured specifications out of free text and key-value tables, as column expressions.

Every function takes a text column and gives null where the text says nothing.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _group(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def _first(*options: Column) -> Column:
    return F.coalesce(*options)


def _named(text: Column, ladder: list[tuple[str, str]]) -> Column:
    """The name of the first pattern of the ladder that the text matches."""
    out = F.lit(None).cast("string")
    for pattern, name in reversed(ladder):
        out = F.when(text.rlike(pattern), name).otherwise(out)
    return out


# Routing of table keys to fields

#: Canonical fields by the words that head their rows.
ROUTES = {
    "cpu": ["processor", "cpu", "chipset", "المعالج"], "gpu": ["graphics", "gpu", "video card", "كارت الشاشة"], "memory": ["memory", "ram", "الرام"], "storage": ["storage", "ssd", "hdd", "hard drive", "التخزين"], "display": ["display", "screen", "panel", "resolution", "الشاشة"],
    "power": ["battery", "adapter", "power", "البطارية"], "physical": ["weight", "dimensions", "الوزن"], "connectivity": ["wireless", "wi-fi", "wifi", "bluetooth", "ports", "ethernet", "usb"], "os": ["operating system", "os", "windows"], "build": ["keyboard", "chassis", "fingerprint", "touchpad"],
    "audio": ["audio", "speakers", "camera", "webcam", "microphone"], "identity": ["brand", "model", "part number", "sku", "series", "color", "warranty"],
}


def route(key: Column) -> Column:
    """The field that a table key belongs to: by exact word first, then by the first word it contains."""
    k = F.lower(F.trim(F.regexp_replace(key, "[:*]+$", "")))
    exact, inside = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, words in reversed(ROUTES.items()):
        exact = F.when(k.isin(words), name).otherwise(exact)
        hit = F.lit(False)
        for w in words:
            hit = hit | k.contains(w)
        inside = F.when(hit, name).otherwise(inside)
    return F.coalesce(exact, inside)


def aggregated(table: Column, field: str) -> Column:
    """The rows of a field as ``Key: Value`` joined by bars, repeats dropped, bars in values escaped."""
    rows = F.filter(F.map_entries(table), lambda e: route(e["key"]) == field)
    return F.array_join(F.array_distinct(F.transform(rows, lambda e: F.concat(e["key"], F.lit(": "), F.regexp_replace(e["value"], r"\|", "\\\\\\\\|")))), " | ")


# Fields

def cpu_model(text: Column) -> Column:
    return _first(
        _group(text, r"(?i)\b(core\s+ultra\s+[579]\s+\d{3}[a-z]{0,2})\b"), _group(text, r"(?i)\b((?:core\s+)?i[3579][-\s]\d{4,5}[a-z]{0,2}\d?)\b"), _group(text, r"(?i)\b(ryzen\s+(?:ai\s+)?[3579]\s+(?:pro\s+)?\d{3,4}[a-z]{0,2})\b"),
        _group(text, r"(?i)\b(snapdragon\s+x\s+\w+)\b"), _group(text, r"(?i)\b(m[1-5](?:\s+(?:pro|max|ultra))?)\b"), _group(text, r"(?i)\b((?:celeron|pentium|athlon)\s+\w+)\b"),
    )


def cpu_vendor(model: Column) -> Column:
    return _named(F.lower(model), [("core|celeron|pentium|^i[3579]", "intel"), ("ryzen|athlon", "amd"), ("snapdragon", "qualcomm"), (r"^m\d", "apple")])


def gpu_model(text: Column) -> Column:
    """A discrete chip if one is named, else an integrated one, else what the processor's vendor builds in."""
    named = _first(
        _group(text, r"(?i)\b(rtx\s*(?:pro\s*)?a?\d{4}(?:\s*ti)?)\b"), _group(text, r"(?i)\b(gtx\s*\d{3,4}(?:\s*ti)?)\b"), _group(text, r"(?i)\b(mx\s*\d{3})\b"), _group(text, r"(?i)\b(rx\s*\d{4}[a-z]{0,2})\b"), _group(text, r"(?i)\b(arc\s+[ab]?\d{3}[a-z]{0,2})\b"),
        _group(text, r"(?i)\b(iris\s+xe|uhd\s+graphics|radeon\s+\d{3}m|radeon\s+graphics|adreno)\b"),
    )
    built_in = F.when(cpu_vendor(cpu_model(text)) == "intel", "intel graphics").when(cpu_vendor(cpu_model(text)) == "amd", "radeon graphics")
    return F.coalesce(F.lower(F.regexp_replace(named, r"\s+", " ")), built_in)


def gpu_integrated(model: Column) -> Column:
    return ~F.lower(model).rlike(r"rtx|gtx|\bmx|\brx|arc [ab]")


def nvidia(model: Column, integrated: Column, title: Column) -> Column:
    """Whether the graphics are NVIDIA's; integrated ones never are."""
    return ~F.coalesce(integrated, F.lit(False)) & F.lower(F.concat_ws(" ", model, title)).rlike(r"nvidia|geforce|rtx|gtx|\bmx ?\d{3}")


#: Sizes of graphics memory that exist.
VRAM_SIZES = (2, 4, 6, 8, 10, 12, 16, 24)


def vram_gb(text: Column) -> Column:
    """Memory named right after a graphics chip, or as VRAM or GDDR."""
    v = _first(_group(text, r"(?i)(?:rtx|gtx|rx|mx)\s*\d{3,4}(?:\s*ti)?\s*[-/(]?\s*(\d{1,2})\s*gb"), _group(text, r"(?i)(\d{1,2})\s*gb\s*(?:vram|gddr\d)")).cast("int")
    return F.when(v.isin(*VRAM_SIZES), v)


def tgp_watts(text: Column, low: int = 20, high: int = 200) -> Column:
    """Power of the graphics chip, without what dynamic boost adds; null outside the bounds."""
    t = F.regexp_replace(text, r"(?i)\+\s*\d+\s*w(?:\s*dynamic boost)?", "")
    w = _first(_group(t, r"(?i)(\d{2,3})\s*w\s*(?:tgp|tdp|max(?:imum)? graphics power)"), _group(t, r"(?i)(?:tgp|graphics power)\s*[:=]?\s*(?:up to\s*)?(\d{2,3})\s*w")).cast("int")
    return F.when(w.between(low, high), w)


def ram_gb(text: Column) -> Column:
    """Memory size: onboard and module together, then n x m, then a size next to a memory word; not graphics memory or storage."""
    t = F.regexp_replace(text, r"(?i)(?:rtx|gtx|rx|mx)\s*\d{3,4}(?:\s*ti)?\s*[-/(]?\s*\d{1,2}\s*gb|\d{1,2}\s*gb\s*(?:vram|gddr\d)|\d+\s*[gt]b\s*(?:ssd|hdd|nvme|m\.2|emmc)", " ")
    hybrid = _group(t, r"(?i)(\d{1,3})\s*gb\s*(?:onboard|soldered)\s*\+\s*\d{1,3}\s*gb").cast("int") + _group(t, r"(?i)\d{1,3}\s*gb\s*(?:onboard|soldered)\s*\+\s*(\d{1,3})\s*gb").cast("int")
    product = _group(t, r"(?i)\b(\d)\s*x\s*\d{1,3}\s*gb").cast("int") * _group(t, r"(?i)\b\d\s*x\s*(\d{1,3})\s*gb").cast("int")
    plain = _first(_group(t, r"(?i)(\d{1,3})\s*gb\s*(?:lp)?(?:ddr\d\w*|ram|memory|unified)"), _group(t, r"(?i)(?:ram|memory)\s*[:=]?\s*(\d{1,3})\s*gb"), _group(t, r"(?i)\b(\d{1,3})\s*gb\b")).cast("int")
    v = _first(hybrid, product, plain)
    return F.when(v.isin(4, 8, 12, 16, 20, 24, 32, 36, 40, 48, 64, 96, 128, 192), v)


def ram_type(text: Column) -> Column:
    return F.upper(_group(text, r"(?i)\b((?:lp)?ddr\dx?)\b"))


def ram_mhz(text: Column) -> Column:
    v = _first(_group(text, r"(?i)(\d{4})\s*(?:mhz|mt/s)").cast("int"), (_group(text, r"(?i)(\d{1,2}(?:\.\d)?)\s*gt/s").cast("double") * 1000).cast("int"))
    return F.when(v.between(1600, 10000), v)


def storage_gb(text: Column) -> Column:
    """Storage size, without what a machine takes at most; terabytes of 1024."""
    t = F.regexp_replace(text, r"(?i)up to\s*\d+(?:\.\d+)?\s*[tg]b", " ")
    tb = _group(t, r"(?i)\b([1-4])\s*tb\b").cast("int") * 1024
    gb = _group(t, r"(?i)\b(128|256|512)\s*gb\b").cast("int")
    return F.coalesce(tb, gb)


def storage_kind(text: Column) -> Column:
    return _named(F.lower(text), [(r"nvme|pcie|m\.2|ssd", "SSD"), ("emmc", "eMMC"), ("hdd|hard dis[kc]", "HDD")])


def storage_interface(text: Column) -> Column:
    return F.concat(F.lit("PCIe "), _group(text, r"(?i)(?:pcie?|gen)\s*(?:gen\s*)?([345])"))


def display_inches(text: Column) -> Column:
    v = _group(text, r"(?i)\b(1\d(?:\.\d{1,2})?)\s*(?:-?\s*inch|\"|”|in\b|بوصة)").cast("double")
    return F.when(v.between(10, 18.5), v)


def refresh_hz(text: Column) -> Column:
    v = _group(text, r"(?i)\b(\d{2,3})\s*hz").cast("int")
    return F.when(v.between(60, 480), v)


#: Pixels by their names.
RESOLUTIONS = [("4k|uhd\\b|2160p", "3840x2160"), ("3k|2880", "2880x1800"), ("wqxga|2\\.5k|2560 ?[x×] ?1600", "2560x1600"), ("qhd|2k|1440p|2560 ?[x×] ?1440", "2560x1440"), ("wuxga|fhd\\+|1920 ?[x×] ?1200", "1920x1200"), ("fhd|full ?hd|1080p|1920 ?[x×] ?1080", "1920x1080"), ("\\bhd\\b|1366 ?[x×] ?768", "1366x768")]


def resolution(text: Column) -> Column:
    said = F.regexp_replace(_group(text, r"(\d{4}\s*[x×]\s*\d{3,4})"), r"\s*[x×]\s*", "x")
    return F.coalesce(said, _named(F.lower(text), RESOLUTIONS))


def aspect_ratio(resolution_: Column) -> Column:
    r = F.split(resolution_, "x")[0].try_cast("double") / F.split(resolution_, "x")[1].try_cast("double")
    return F.when(F.abs(r - 16 / 10) <= 0.03, "16:10").when(F.abs(r - 16 / 9) <= 0.03, "16:9").when(F.abs(r - 3 / 2) <= 0.03, "3:2")


def panel(text: Column) -> Column:
    return _named(F.lower(text), [("oled|amoled", "OLED"), ("mini.?led", "Mini-LED"), (r"\bips\b", "IPS"), (r"\bva\b", "VA"), (r"\btn\b", "TN")])


def nits(text: Column) -> Column:
    return _group(text, r"(?i)(\d{3,4})\s*(?:nits|cd/m)").cast("int")


def gamut_pct(text: Column) -> Column:
    return _group(text, r"(?i)(\d{2,3})\s*%\s*(?:srgb|dci-?p3|ntsc|adobe)").cast("int")


def touch(text: Column) -> Column:
    """A touch screen is named, pads and bars aside."""
    return F.regexp_replace(F.lower(text), r"touch\s?(?:pad|bar|id)|non[- ]?touch|without touch", "").rlike(r"touch|x360|2-in-1|لمس")


def battery_wh(text: Column) -> Column:
    v = _group(text, r"(?i)(\d{2,3}(?:\.\d{1,2})?)\s*w(?:att)?\s*-?h").cast("double")
    return F.when(v.between(25, 99.9), v)


def adapter_w(text: Column) -> Column:
    v = _first(_group(text, r"(?i)(\d{2,3})\s*w\s*(?:ac\s*)?(?:adapter|charger|power supply)"), _group(text, r"(?i)(?:adapter|charger)\s*[:=]?\s*(\d{2,3})\s*w")).cast("int")
    return F.when(v.between(30, 500), v)


def weight_kg(text: Column) -> Column:
    """Weight of the machine; rows about packages don't count; grams and pounds are converted."""
    t = F.regexp_replace(text, r"(?i)(?:package|shipping|gross)\s*weight[^|;\n]*", " ")
    v = _first(_group(t, r"(?i)(\d(?:\.\d{1,3})?)\s*kg").cast("double"), _group(t, r"(?i)\b(\d{3,4})\s*g\b").cast("double") / 1000, F.round(_group(t, r"(?i)(\d(?:\.\d{1,2})?)\s*(?:lbs?|pounds)").cast("double") * 0.45359237, 2))
    return F.when(v.between(0.7, 5.5), v)


def wifi(text: Column) -> Column:
    return _named(F.lower(text), [(r"wi-?fi\s*7|802\.11be", "Wi-Fi 7"), (r"wi-?fi\s*6e", "Wi-Fi 6E"), (r"wi-?fi\s*6|802\.11ax", "Wi-Fi 6"), (r"wi-?fi\s*5|802\.11ac", "Wi-Fi 5")])


def bluetooth(text: Column) -> Column:
    return _group(text, r"(?i)bluetooth\s*v?(\d(?:\.\d)?)").cast("double")


def ports(text: Column) -> Column:
    """Entries between semicolons, or commas outside brackets; what names no port is left out."""
    entries = F.transform(F.split(F.when(text.contains(";"), text).otherwise(F.regexp_replace(text, r",(?![^(]*\))", ";")), ";"), lambda p: F.trim(p))
    return F.filter(entries, lambda p: F.lower(p).rlike(r"usb|hdmi|thunderbolt|displayport|rj-?45|ethernet|jack|audio|sd card|card reader") & (F.length(p) <= 80))


def operating_system(text: Column) -> Column:
    """By name, after sentences in which a vendor recommends one are cut."""
    t = F.regexp_replace(F.lower(text), r"[^.|\n]*recommends[^.|\n]*", " ")
    return _named(t, [(r"windows\s*11\s*pro", "Windows 11 Pro"), (r"windows\s*11|win\s*11", "Windows 11"), (r"windows\s*10", "Windows 10"), ("macos|mac os", "macOS"), ("chrome ?os", "ChromeOS"), ("ubuntu|linux", "Linux"), (r"free ?dos|\bdos\b|no os", "FreeDOS")])


def backlight(text: Column) -> Column:
    return _named(F.lower(text), [(r"non[- ]?backlit|no backlight|without backlight", "none"), ("per-?key rgb", "per-key RGB"), ("rgb", "RGB"), ("backlit|backlight", "single colour")])


def chassis(text: Column) -> Column:
    return _named(F.lower(text), [("magnesium", "magnesium"), ("alumin[iu]+m|metal", "aluminium"), ("carbon", "carbon"), ("plastic|polycarbonate|abs", "plastic")])


def webcam(text: Column) -> Column:
    return _first(_group(F.lower(text), r"(\d{3,4}p)"), F.concat(_group(text, r"(?i)(\d(?:\.\d)?)\s*mp\b"), F.lit("MP")), _named(F.lower(text), [("fhd|full hd", "1080p"), (r"\bhd\b", "720p")]))


def speakers(text: Column) -> Column:
    t = F.lower(text)
    pair = _group(t, r"(\d)\s*x?\s*woofers?").cast("int") + _group(t, r"(\d)\s*x?\s*tweeters?").cast("int")
    return _first(pair, _group(t, r"(\d)\s*x?\s*speakers").cast("int"), F.when(t.contains("quad speaker"), 4).when(t.rlike("dual speaker|stereo"), 2))


def brand(text: Column, brands: list[str]) -> Column:
    t = F.lower(text)
    out = F.lit(None).cast("string")
    for b in reversed(brands):
        out = F.when(t.rlike(rf"(^|[^a-z0-9]){b.lower()}($|[^a-z0-9])"), b).otherwise(out)
    return out


def warranty_years(text: Column) -> Column:
    return F.coalesce(_group(text, r"(?i)(\d)\s*(?:-\s*)?years?").cast("double"), _group(text, r"(?i)(\d{1,2})\s*months").cast("double") / 12)


FIELDS = {
    "cpu": cpu_model, "gpu": gpu_model, "vram_gb": vram_gb, "ram_gb": ram_gb, "ram_type": ram_type, "ram_mhz": ram_mhz, "storage_gb": storage_gb, "storage_kind": storage_kind, "display_inches": display_inches, "refresh_hz": refresh_hz, "resolution": resolution, "panel": panel, "nits": nits, "touch": touch, "battery_wh": battery_wh,
    "adapter_w": adapter_w, "weight_kg": weight_kg, "wifi": wifi, "bluetooth": bluetooth, "os": operating_system, "backlight": backlight, "webcam": webcam, "speakers": speakers,
}


def extracted(text: Column) -> list[Column]:
    """All fields of a text, one column each."""
    return [f(text).alias(name) for name, f in FIELDS.items()]


#: Vetoes of the product gate, in order, with the reason each gives.
VETOES = [("bundle", r"(?i)\bbundle\b|\+ ?(?:mouse|bag|headset)"), ("used", r"(?i)\b(?:used|refurbished|open box|renewed)\b|مستعمل"), ("non_laptop:desktop", r"(?i)\b(?:desktop|tower|all[- ]in[- ]one|mini pc)\b"), ("non_laptop:monitor", r"(?i)\bmonitor\b"), ("non_laptop:tablet", r"(?i)\b(?:ipad|tablet)\b"), ("accessory", r"(?i)\b(?:bag|sleeve|charger for|adapter for|stand|cooling pad|keyboard cover)\b")]


def product_gate(title: Column) -> Column:
    """``ok``, or the reason of the first veto; a named processor overrules the accessory veto."""
    out = F.when(cpu_model(title).isNotNull() | F.lower(title).contains("laptop"), "ok").otherwise("accessory")
    for reason, pattern in reversed(VETOES):
        hit = title.rlike(pattern)
        out = F.when(hit & ~((F.lit(reason) == "accessory") & cpu_model(title).isNotNull()), reason).otherwise(out)
    return out
