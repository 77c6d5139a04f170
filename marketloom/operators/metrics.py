"""Hardware metrics of items from their data sheets.

A data sheet is a row of columns, any of which may be null (``SHEET`` names
them); each step adds its scores, and ``item_metrics`` takes them in order.
Everything is column expressions over one row, so the whole model is one
projection of the scan that it stands on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.functions.scoring import calibrated_value, deal_tier, ladder, or_default, port_count, power_tier

#: Columns of a data sheet, beside identifiers.
SHEET = {
    "double": "cpu_benchmark cores threads boost_ghz cache_mb npu_tops gpu_benchmark gpu_full_w gpu_w gpu_tops adapter_w cpu_w inches response_ms battery_wh weight_kg front_mm rear_mm thick_mm".split(),
    "int": "memory_mhz ram_gb width height hz nits slots max_ram_gb m2_slots ssds speakers release_year".split(),
    "boolean": "integrated gddr7 adaptive_sync hdr usb_power fast_charge soldered so_dimm ir_camera shutter backlit numpad copilot_key fingerprint displayport usb4 ethernet card_reader archived".split(),
    "string": "memory_type memory_layout memory_channels panel gamut aspect storage_interface chassis family webcam backlight pointing audio wifi antenna thunderbolt ethernet_speed".split(),
    "array<string>": ["ports"],
}


def half_up(v: Column, digits: int) -> Column:
    """Rounded, after the noise of binary fractions is rounded away."""
    return F.round(F.round(v, 9), digits)


def bounded(v: Column, low: float = 0.0, high: float = 100.0) -> Column:
    return half_up(F.greatest(F.lit(low), F.least(F.lit(high), v)), 2)


def _has(text: Column, *words: str) -> Column:
    t = F.lower(F.coalesce(text, F.lit("")))
    out = F.lit(False)
    for w in words:
        out = out | t.contains(w)
    return out


def _is(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def _points(condition: Column, yes: float, no: float = 0.0) -> Column:
    return F.when(condition, F.lit(yes)).otherwise(F.lit(no))



def _integrated() -> Column:
    return F.coalesce(F.col("integrated"), F.lit(True))


def _by_kind(name: str, integrated: float, discrete: float) -> Column:
    """The value, or a default by kind of graphics in place of null and zero."""
    return F.coalesce(F.nullif(F.col(name).cast("double"), F.lit(0.0)), F.when(_integrated(), F.lit(integrated)).otherwise(F.lit(discrete)))


def silicon(df: DataFrame) -> DataFrame:
    """cpu_score, gpu_score, silicon_index, ai_tops, copilot_pc, gpu_tier."""
    kind = F.upper(or_default("memory_type", "DDR5"))
    mhz = F.coalesce(F.nullif(F.col("memory_mhz"), F.lit(0)), F.when(kind.contains("LPDDR5"), 6400).when(kind.contains("DDR5"), 5200).otherwise(3200))
    dual = _has(F.col("memory_channels"), "dual") | F.coalesce(F.lower("memory_layout").startswith("2 x"), F.lit(False)) | kind.contains("LPDDR5") | (or_default("ram_gb", 16) >= 32)
    estimate = bounded(or_default("cores", 8.0) * 2.5 + or_default("threads", 12.0) * 0.8 + (or_default("boost_ghz", 4.5) - 3.0) * 8.0 + or_default("cache_mb", 16.0) * 0.35, 15.0, 98.0)
    df = df.withColumns({"dual_channel": dual, "_memory": F.when(dual & (mhz >= 5200), 1.05).when(dual, 1.02).otherwise(1.0)})
    reference = F.coalesce("gpu_benchmark", F.when(_integrated(), F.lit(18.0)).otherwise(F.lit(45.0)))
    full = F.coalesce("gpu_full_w", F.when(_integrated(), F.lit(0.0)).otherwise(F.lit(95.0)))
    watts = F.coalesce("gpu_w", F.lit(0.0))
    share = F.greatest(F.lit(0.4), F.least(F.lit(1.35), watts / F.nullif(full, F.lit(0.0))))
    scale = half_up(F.greatest(F.lit(0.72), F.least(F.lit(1.10), F.pow(share, F.lit(0.32)))), 3)
    shared = _integrated() | (full <= 0)
    df = df.withColumns(
        {
            "cpu_score": bounded(F.coalesce("cpu_benchmark", estimate) * F.col("_memory"), 10.0),
            "gpu_score": F.when(shared, bounded(reference * F.col("_memory"), 5.0)).otherwise(bounded(reference * scale + _points(_is("gddr7"), 2.5), 15.0)),
            "gpu_tier": power_tier(watts, full, _integrated()),
            "ai_tops": half_up(F.coalesce("npu_tops", F.lit(0.0)) + F.coalesce("gpu_tops", F.lit(0.0)), 1),
            "copilot_pc": F.coalesce("npu_tops", F.lit(0.0)) >= 40.0,
        }
    )
    return df.withColumn("silicon_index", bounded(0.45 * F.col("cpu_score") + 0.55 * F.col("gpu_score"))).drop("_memory")


def power(df: DataFrame) -> DataFrame:
    """spare_w, power_status, power_score: what the adapter leaves under simultaneous load, power shared between the chips counted once."""
    watts, cpu = F.coalesce("gpu_w", F.lit(0.0)), or_default("cpu_w", 28.0)
    strong = cpu >= 55.0
    boost = F.when(_integrated(), 0.0).when(watts >= 95.0, _points(strong, 20.0, 15.0)).when(watts >= 65.0, _points(strong, 15.0, 10.0)).otherwise(5.0)
    spare = half_up(_by_kind("adapter_w", 65.0, 170.0) - (cpu + watts + _points(_integrated(), 15.0, 25.0) - boost), 1)
    df = df.withColumn("spare_w", spare)
    s = F.col("spare_w")
    score = F.when(s >= 15.0, bounded(88.0 + F.least(F.lit(12.0), (s - 15.0) * 0.2))).when(s >= -5.0, bounded(80.0 + (s + 5.0) * 0.4)).otherwise(bounded(65.0 + s * 1.2, 30.0, 75.0))
    return df.withColumns({"power_status": F.when(s >= -5.0, "UNCONSTRAINED_HEADROOM").otherwise("DEFICIT_THROTTLED"), "power_score": score})


def display(df: DataFrame) -> DataFrame:
    """ppi, gamut_tier, display_score."""
    inches, wide, high = or_default("inches", 15.6), or_default("width", 1920), or_default("height", 1080)
    panel, gamut = F.upper(or_default("panel", "IPS")), F.col("gamut")
    hz = F.coalesce(F.nullif(F.col("hz"), F.lit(0)), F.when(_integrated(), 60).otherwise(144))
    aspect = F.coalesce(F.nullif(F.col("aspect"), F.lit("")), F.when(high.isin(1200, 1600, 1800, 2400), "16:10").otherwise("16:9"))
    rich = panel.contains("OLED") | panel.contains("MINI-LED")
    df = df.withColumns({"ppi": half_up(F.hypot(wide.cast("double"), high.cast("double")) / inches, 1)})
    tier = (
        F.when(_has(gamut, "dci-p3") | rich, "100% DCI-P3 (Cinema / Pro Creator)")
        .when(_has(gamut, "100% srgb", "72% ntsc") | (wide >= 2560), "100% sRGB (Creator / Gaming Ready)")
        .when(_has(gamut, "62.5%"), "62.5% sRGB (Standard)")
        .otherwise("45% NTSC (Basic)")
    )
    nits = F.coalesce(F.col("nits"), F.when(rich, 450).when((wide >= 2560) | (hz >= 165), 350).when(~_integrated() | _has(gamut, "100% srgb"), 300).otherwise(250))
    points = (
        bounded((F.col("ppi") - 110.0) / 170.0 * 25.0, 6.0, 25.0)
        + ladder(hz, [(240, 20.0), (165, 17.5), (144, 15.0), (120, 13.0), (90, 10.0)], 6.0)
        + F.when(tier.startswith("100% DCI"), 25.0).when(tier.startswith("100% sRGB"), 21.0).when(tier.startswith("62.5%"), 13.0).otherwise(10.0)
        + F.when(rich, 15.0).when(panel.contains("IPS"), 11.5).when(panel.contains("VA"), 8.5).otherwise(5.0)
        + bounded((nits - 200.0) / 400.0 * 10.0, 2.0, 10.0)
        + _points(aspect.isin("16:10", "3:2"), 5.0, 3.0)
        + _points(_is("adaptive_sync"), 3.5)
        + _points(_is("hdr") | panel.contains("OLED"), 3.5)
        + _points(F.coalesce(F.col("response_ms") <= 3.0, F.lit(False)), 1.5)
    )
    return df.withColumns({"gamut_tier": tier, "display_score": bounded(points, 15.0)})


def mobility(df: DataFrame) -> DataFrame:
    """battery_hours, mobility_score, mobility_tier."""
    charge, weight, cpu = _by_kind("battery_wh", 50.0, 70.0), _by_kind("weight_kg", 1.65, 2.3), or_default("cpu_w", 28.0)
    both = F.col("front_mm").isNotNull() & F.col("rear_mm").isNotNull()
    thick = F.when(both, half_up((F.col("front_mm") + F.col("rear_mm")) / 2.0, 1)).otherwise(_by_kind("thick_mm", 18.5, 23.5))
    idle = F.when(cpu <= 28, 6.5).when(cpu <= 45, 9.5).otherwise(13.0) + _points(~_integrated(), 1.5) + _points(or_default("width", 1920) >= 2560, 1.0)
    fast = F.coalesce(F.col("fast_charge"), charge >= 60.0)
    df = df.withColumn("battery_hours", half_up(charge / idle, 1))
    hours = F.col("battery_hours")
    points = bounded((hours - 2.5) / 8.0 * 35.0, 5.0, 35.0) + bounded((3.2 - weight) / 2.1 * 35.0, 3.0, 35.0) + bounded((30.0 - thick) / 16.5 * 15.0, 2.0, 15.0) + _points(_is("usb_power"), 10.0) + _points(fast, 5.0)
    tier = F.when((weight <= 1.65) & (hours >= 6.5), "ULTRAPORTABLE").when(weight <= 2.45, "BALANCED").otherwise("DESK_BOUND")
    return df.withColumns({"mobility_score": bounded(points, 15.0), "mobility_tier": tier})


#: Product families by the solidity of their cases.
METAL_FAMILIES = ("zenbook", "proart", "zephyrus", "aorus", "aero", "legion", "omen", "alienware", "prestige", "thinkpad", "envy")
TOUGH_FAMILIES = ("tuf", "loq", "victus", "nitro", "katana", "cyborg", "probook", "expertbook", "latitude")


def longevity(df: DataFrame) -> DataFrame:
    """longevity_score, longevity_tier, chassis_tier: memory 45, storage 40, case 15."""
    soldered, ram = _is("soldered"), or_default("ram_gb", 16)
    slots = F.coalesce(F.col("slots"), F.when(soldered, 0).otherwise(2))
    most = F.coalesce(F.nullif(F.col("max_ram_gb"), F.lit(0)), F.greatest(ram, F.when(slots >= 2, 32).otherwise(ram)))
    open_ram = (slots >= 1) & (~soldered | _is("so_dimm"))
    grow = F.when((slots >= 2) & ~soldered, 30.0).when(open_ram, 20.0).when(ram >= 32, 12.0).when(ram >= 16, 6.0).otherwise(0.0)
    memory = F.least(F.lit(45.0), grow + ladder(most, [(64, 10.0), (32, 7.0), (16, 4.0)], 1.0) + _points(or_default("memory_type", "DDR5").contains("5"), 5.0, 2.0))
    m2 = F.least(F.lit(3), F.coalesce(F.nullif(F.col("m2_slots"), F.lit(0)), F.when(_integrated(), 1).otherwise(2)))
    interface = or_default("storage_interface", "PCIe 4.0 NVMe")
    storage = F.least(F.lit(40.0), _points(m2 >= 2, 22.0, 10.0) + _points(m2 - or_default("ssds", 1) >= 1, 10.0, 3.0) + F.when(interface.contains("5.0"), 8.0).when(interface.contains("4.0"), 6.5).otherwise(3.5))
    case = F.when(_has(F.col("chassis"), "alumin", "magnesium", "metal", "carbon") | _has(F.col("family"), *METAL_FAMILIES), "Metal / Reinforced Alloy").when(_has(F.col("chassis"), "abs") | _has(F.col("family"), *TOUGH_FAMILIES), "MIL-STD / High-Grade PC-ABS").otherwise("Standard Polycarbonate")
    tier = F.when(open_ram & (m2 >= 2), "MAXIMUM_UPGRADEABLE").when(open_ram | (m2 >= 2), "MODERATE_EXPANSION").otherwise("LOCKED_APPLIANCE")
    df = df.withColumns({"chassis_tier": case, "longevity_tier": tier})
    points = F.when(F.col("chassis_tier").startswith("Metal"), 14.0).when(F.col("chassis_tier").startswith("MIL"), 10.5).otherwise(7.5)
    return df.withColumn("longevity_score", bounded(memory + storage + points, 15.0))


def ergonomics(df: DataFrame) -> DataFrame:
    """ergonomics_score: camera 35, keyboard 35, sound and biometrics 30."""
    camera = F.lower(F.coalesce(F.nullif(F.col("webcam"), F.lit("")), F.when(or_default("release_year", 2025) >= 2025, "1080p").otherwise("720p")))
    seen = F.least(F.lit(35.0), F.when(camera.contains("5 mp") | camera.contains("9 mp"), 18.0).when(camera.contains("1080"), 14.0).otherwise(8.0) + _points(_is("ir_camera"), 9.0) + _points(_is("shutter"), 8.0))
    lit = F.coalesce(F.col("backlit"), F.lit(True))
    keys = F.when(~lit, 5.0).when(_has(F.col("backlight"), "per-key", "4-zone", "rgb"), 18.0).otherwise(15.0)
    pad = F.coalesce(F.col("numpad"), or_default("inches", 15.6) >= 15.6)
    typed = F.least(F.lit(35.0), keys + _points(pad, 7.0, 3.0) + _points(_is("copilot_key"), 5.0) + _points(_has(F.col("pointing"), "numberpad", "dialpad", "ultranav"), 5.0, 3.0))
    heard = F.least(F.lit(30.0), _points(_is("fingerprint") | _is("ir_camera"), 12.0, 4.0) + _points(or_default("speakers", 2) >= 4, 10.0, 7.0) + _points(F.length(F.coalesce("audio", F.lit(""))) > 0, 8.0, 4.0))
    return df.withColumn("ergonomics_score", bounded(seen + typed + heard, 20.0))


def connectivity(df: DataFrame) -> DataFrame:
    """connectivity_score."""
    wifi, bus = F.upper(or_default("wifi", "Wi-Fi 6")), F.coalesce(F.col("thunderbolt"), F.lit(""))
    ports = F.coalesce(F.col("ports"), F.array().cast("array<string>"))
    listed = F.array_join(ports, " ")
    usb4 = _is("usb4") | _has(listed, "usb4")
    lan = F.coalesce(F.col("ethernet"), _has(listed, "rj-45", "ethernet") | ~_integrated())
    speed = F.coalesce(F.nullif(F.col("ethernet_speed"), F.lit("")), F.when(lan, "1 Gbps").otherwise("None"))
    count = F.coalesce(F.nullif(port_count(ports), F.lit(0)), F.lit(5))
    points = (
        F.when(wifi.contains("WI-FI 7"), 20.0).when(wifi.contains("6E"), 17.0).when(wifi.contains("WI-FI 6"), 14.0).otherwise(8.0)
        + _points(or_default("antenna", "2x2").contains("2x2"), 5.0, 2.5)
        + F.when(bus.contains("5"), 30.0).when(bus.contains("4") | usb4, 26.0).when(_is("displayport") | (F.length(bus) > 0), 20.0).otherwise(10.0)
        + F.when(speed.contains("2.5"), 15.0).when(lan, 12.0).otherwise(3.0)
        + _points(_is("usb_power"), 10.0, 2.0)
        + F.least(F.lit(13.0), count * 2.0)
        + _points(_is("card_reader"), 7.0)
    )
    return df.withColumn("connectivity_score", bounded(points, 20.0))


def economics(df: DataFrame) -> DataFrame:
    """price_status, effective_price, value_ratio, value_score and deal from stock_price and any_price (least valid prices, in stock and at all) and shown_price."""
    status = F.when(_is("archived"), "LEGACY_ARCHIVED_OUT_OF_STOCK").when(F.col("stock_price").isNotNull(), "IN_STOCK_ACTIVE").when(F.col("any_price").isNotNull(), "OUT_OF_STOCK_RECENT").otherwise("COMING_SOON_UNPRICED")
    df = df.withColumns({"price_status": status, "effective_price": F.when(_is("archived"), F.col("shown_price")).otherwise(F.coalesce("stock_price", "any_price"))})
    ram = or_default("ram_gb", 16)
    hardware = 0.28 * F.col("cpu_score") + 0.32 * F.col("gpu_score") + 0.15 * F.col("display_score") + 0.10 * F.when(ram <= 32, ram / 32.0 * 100.0).otherwise(100.0) + 0.15 * F.col("longevity_score")
    ratio = F.when(F.col("effective_price") >= 10000, half_up(F.pow(hardware, F.lit(1.35)) / (F.col("effective_price") / 10000.0), 2))
    df = df.withColumns({"recommendable": F.col("price_status").isin("IN_STOCK_ACTIVE", "OUT_OF_STOCK_RECENT"), "value_ratio": ratio})
    df = df.withColumn("value_score", F.when(F.col("value_ratio").isNotNull(), bounded((F.col("value_ratio") - 18.0) / 40.0 * 100.0, 15.0)).otherwise(50.0))
    return df.withColumn("deal", deal_tier(F.col("value_score")))


def item_metrics(sheets: DataFrame) -> DataFrame:
    """All metrics of data sheets; columns that a sheet lacks count as null."""
    missing = {c: F.lit(None).cast(kind) for kind, names in SHEET.items() for c in names if c not in sheets.columns}
    missing |= {c: F.lit(None).cast("double") for c in ("stock_price", "any_price", "shown_price") if c not in sheets.columns}
    df = sheets.withColumns(missing) if missing else sheets
    for step in (silicon, power, display, mobility, longevity, ergonomics, connectivity, economics):
        df = step(df)
    return df


def verified() -> Column:
    """Whether a sheet says enough to be scored: processor, graphics, memory and storage."""
    return (F.length(F.coalesce("cpu", F.lit(""))) > 0) & (F.length(F.coalesce("gpu", F.lit(""))) > 0) & (F.coalesce("ram_gb", F.lit(0)) != 0) & (F.coalesce("storage_gb", F.lit(0)) != 0)


def rescued(df: DataFrame) -> DataFrame:
    """Graphics that memory (vram_gb), power or the title (names_discrete) show to be discrete count as discrete."""
    shown = (F.coalesce("vram_gb", F.lit(0)) >= 4) | (F.coalesce("gpu_w", F.lit(0.0)) >= 35.0) | F.coalesce("names_discrete", F.lit(False))
    return df.withColumn("integrated", _integrated() & ~shown)


def advisor_metrics(sheets: DataFrame) -> DataFrame:
    """``item_metrics`` and the finer scores that recommendations use.

    vram_score; gaming_score and creator_score of the display; battery_score and
    portability_score; upgrade_score and build_score (material and, if there is
    one, the reviews' review_build, half each); advisor_value, the value for
    money of a composite that has mobility in the place of integrated graphics.
    Discrete graphics of unknown power count as at 85 % of their full one.
    """
    df = rescued(sheets)
    full = F.coalesce("gpu_full_w", F.when(_integrated(), F.lit(0.0)).otherwise(F.lit(95.0)))
    df = df.withColumns({"_said_w": F.col("gpu_w"), "gpu_w": F.when(~_integrated() & (F.coalesce("gpu_w", F.lit(0.0)) <= 0), full * 0.85).otherwise(F.col("gpu_w"))})
    scored = silicon(df).withColumn("gpu_w", F.col("_said_w")).drop("_said_w")
    for step in (power, display, mobility, longevity, ergonomics, connectivity, economics):
        scored = step(scored)
    vram = F.coalesce("vram_gb", F.lit(0))
    hz = F.coalesce(F.nullif(F.col("hz"), F.lit(0)), F.when(_integrated(), 60).otherwise(144))
    panel = F.upper(or_default("panel", "IPS"))
    rich, wide, high = panel.contains("OLED") | panel.contains("MINI-LED"), or_default("width", 1920), or_default("height", 1080)
    nits = F.coalesce(F.col("nits"), F.when(rich, 450).when((wide >= 2560) | (hz >= 165), 350).when(~_integrated() | _has(F.col("gamut"), "100% srgb"), 300).otherwise(250))
    aspect = F.coalesce(F.nullif(F.col("aspect"), F.lit("")), F.when(high.isin(1200, 1600, 1800, 2400), "16:10").otherwise("16:9"))
    tier = F.col("gamut_tier")
    weight = _by_kind("weight_kg", 1.65, 2.3)
    charge = _by_kind("battery_wh", 50.0, 70.0)
    both = F.col("front_mm").isNotNull() & F.col("rear_mm").isNotNull()
    thick = F.when(both, half_up((F.col("front_mm") + F.col("rear_mm")) / 2.0, 1)).otherwise(_by_kind("thick_mm", 18.5, 23.5))
    material = F.when(F.col("chassis_tier").startswith("Metal"), 90.0).when(F.col("chassis_tier").startswith("MIL"), 70.0).otherwise(50.0)
    scored = scored.withColumns(
        {
            "vram_score": F.when(_integrated() | (vram < 4), 15.0).otherwise(ladder(vram, [(16, 100.0), (12, 88.0), (8, 74.0), (6, 58.0)], 40.0)),
            "gaming_score": bounded(ladder(hz, [(240, 55.0), (165, 48.0), (144, 42.0), (120, 34.0), (90, 22.0)], 10.0) + _points(F.coalesce(F.col("response_ms") <= 3.0, F.lit(False)), 15.0, 5.0) + _points(_is("adaptive_sync"), 15.0) + F.when(panel.contains("OLED"), 15.0).when(panel.contains("IPS"), 10.0).otherwise(5.0), 10.0),
            "creator_score": bounded(
                F.when(tier.startswith("100% DCI"), 40.0).when(tier.startswith("100% sRGB"), 30.0).when(tier.startswith("62.5%"), 16.0).otherwise(10.0)
                + F.when(rich, 20.0).when(panel.contains("IPS"), 14.0).when(panel.contains("VA"), 9.0).otherwise(4.0)
                + bounded(5.0 + (nits - 200.0) / 400.0 * 15.0, 5.0, 20.0) + bounded(5.0 + (F.col("ppi") - 110.0) / 170.0 * 10.0, 5.0, 15.0) + _points(aspect.isin("16:10", "3:2"), 5.0),
                15.0,
            ),
            "battery_score": bounded(bounded(15.0 + (F.col("battery_hours") - 2.5) / 8.0 * 60.0, 15.0, 75.0) + _points(_is("usb_power"), 15.0) + _points(F.coalesce(F.col("fast_charge"), charge >= 60.0), 10.0), 15.0),
            "portability_score": bounded(bounded(10.0 + (3.2 - weight) / 2.1 * 60.0, 10.0, 70.0) + bounded(5.0 + (30.0 - thick) / 16.5 * 25.0, 5.0, 30.0), 15.0),
            "build_score": bounded(F.coalesce(0.5 * material + 0.5 * F.col("review_build"), material), 15.0),
        }
    )
    ram = or_default("ram_gb", 16)
    memory = 0.10 * F.when(ram <= 32, ram / 32.0 * 100.0).otherwise(100.0)
    own = 0.28 * F.col("cpu_score") + 0.32 * F.col("gpu_score") + 0.15 * F.col("display_score") + memory + 0.15 * F.col("longevity_score")
    shared = 0.28 * F.col("cpu_score") + 0.30 * F.col("mobility_score") + 0.22 * F.col("display_score") + memory + 0.10 * F.col("build_score")
    return scored.withColumn("advisor_value", calibrated_value(F.when(_integrated(), shared).otherwise(own), F.col("effective_price")))
