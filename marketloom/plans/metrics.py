"""The hardware metrics of all parts, with data sheets and prices derived from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.operators import metrics as M
from marketloom.registry import query
from marketloom.sources.tables import HEAD_SQL, head_state, load, observations

#: Data sheets by part number k and size s, in SQL that Spark and DuckDB read alike; gaps are meant.
SHEET = {
    "integrated": "k % 5 < 2",
    "cpu_benchmark": "CASE WHEN k % 4 > 0 THEN CAST(15 + k * 7 % 84 AS DOUBLE) + 0.5 END",
    "cores": "CASE WHEN k % 11 > 0 THEN CAST(4 + s % 13 AS DOUBLE) END",
    "threads": "CAST(8 + s % 25 AS DOUBLE)",
    "boost_ghz": "CASE WHEN k % 13 > 0 THEN 3 + CAST(k % 25 AS DOUBLE) / 10 END",
    "cache_mb": "CAST(s AS DOUBLE)",
    "npu_tops": "CASE WHEN k % 3 = 0 THEN CAST(k % 60 AS DOUBLE) END",
    "gpu_tops": "CASE WHEN k % 2 = 0 THEN CAST(k % 700 AS DOUBLE) + 0.25 END",
    "gpu_benchmark": "CASE WHEN k % 7 > 0 THEN CAST(10 + k * 3 % 90 AS DOUBLE) END",
    "gpu_full_w": "CASE WHEN k % 7 > 0 THEN CASE WHEN k % 5 < 2 THEN 0.0 ELSE CAST(65 + k % 4 * 30 AS DOUBLE) END END",
    "gpu_w": "CASE WHEN k % 6 > 0 THEN CAST(35 + k % 140 AS DOUBLE) END",
    "gddr7": "k % 8 = 1",
    "memory_type": "CASE k % 5 WHEN 0 THEN 'DDR4' WHEN 1 THEN 'ddr5' WHEN 2 THEN 'LPDDR5X' WHEN 3 THEN '' END",
    "memory_layout": "CASE k % 6 WHEN 0 THEN '2 x 8 GB' WHEN 1 THEN '1 x 16 GB' END",
    "memory_channels": "CASE k % 9 WHEN 0 THEN 'Dual-channel' WHEN 1 THEN 'single' END",
    "memory_mhz": "CASE k % 4 WHEN 0 THEN 3200 WHEN 1 THEN 5600 WHEN 2 THEN 0 END",
    "ram_gb": "CASE WHEN k % 10 > 0 THEN CAST(8 * (1 + k % 8) AS INT) END",
    "adapter_w": "CASE WHEN k % 9 > 0 THEN CAST(45 + s * 6 AS DOUBLE) END",
    "cpu_w": "CASE WHEN k % 8 > 0 THEN CAST(15 + k % 7 * 10 AS DOUBLE) END",
    "inches": "CASE WHEN k % 12 > 0 THEN 13 + CAST(s AS DOUBLE) / 10 END",
    "width": "CASE k % 4 WHEN 0 THEN 1920 WHEN 1 THEN 2560 WHEN 2 THEN 2880 END",
    "height": "CASE k % 4 WHEN 0 THEN 1200 WHEN 1 THEN 1440 WHEN 2 THEN 1800 END",
    "hz": "CASE k % 7 WHEN 0 THEN 60 WHEN 1 THEN 90 WHEN 2 THEN 120 WHEN 3 THEN 144 WHEN 4 THEN 165 WHEN 5 THEN 240 END",
    "panel": "CASE k % 6 WHEN 0 THEN 'OLED' WHEN 1 THEN 'Mini-LED' WHEN 2 THEN 'ips' WHEN 3 THEN 'VA' WHEN 4 THEN 'TN' END",
    "gamut": "CASE k % 5 WHEN 0 THEN '100% DCI-P3' WHEN 1 THEN '100% sRGB' WHEN 2 THEN '62.5% sRGB' WHEN 3 THEN '72% NTSC' END",
    "aspect": "CASE k % 3 WHEN 0 THEN '16:10' WHEN 1 THEN '16:9' END",
    "nits": "CASE WHEN k % 3 > 0 THEN CAST(200 + k % 50 * 10 AS INT) END",
    "adaptive_sync": "k % 4 = 1",
    "hdr": "CASE k % 4 WHEN 1 THEN TRUE WHEN 2 THEN FALSE END",
    "response_ms": "CASE WHEN k % 3 = 0 THEN CAST(k % 9 AS DOUBLE) END",
    "battery_wh": "CASE WHEN k % 7 > 0 THEN CAST(40 + s AS DOUBLE) END",
    "weight_kg": "CASE WHEN k % 9 > 0 THEN 0.9 + CAST(k % 24 AS DOUBLE) / 10 END",
    "front_mm": "CASE WHEN k % 2 = 0 THEN CAST(12 + k % 9 AS DOUBLE) END",
    "rear_mm": "CASE WHEN k % 4 = 0 THEN CAST(15 + k % 11 AS DOUBLE) + 0.3 END",
    "thick_mm": "CASE WHEN k % 3 = 0 THEN CAST(14 + k % 16 AS DOUBLE) END",
    "usb_power": "CASE k % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END",
    "fast_charge": "CASE k % 5 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END",
    "soldered": "k % 3 = 0",
    "so_dimm": "k % 6 = 0",
    "slots": "CASE WHEN k % 4 > 0 THEN CAST(k % 4 - 1 AS INT) END",
    "max_ram_gb": "CASE k % 5 WHEN 0 THEN 64 WHEN 1 THEN 32 WHEN 2 THEN 8 END",
    "m2_slots": "CASE k % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 4 END",
    "ssds": "CASE WHEN k % 6 > 0 THEN CAST(1 + k % 2 AS INT) END",
    "storage_interface": "CASE k % 4 WHEN 0 THEN 'PCIe 5.0' WHEN 1 THEN 'PCIe 4.0 NVMe' WHEN 2 THEN 'SATA' END",
    "chassis": "CASE k % 5 WHEN 0 THEN 'Aluminium' WHEN 1 THEN 'PC-ABS' WHEN 2 THEN 'plastic' END",
    "family": "CASE k % 7 WHEN 0 THEN 'Legion 5' WHEN 1 THEN 'Victus 15' WHEN 2 THEN 'Plain' END",
    "release_year": "CASE WHEN k % 3 > 0 THEN CAST(2022 + k % 5 AS INT) END",
    "webcam": "CASE k % 5 WHEN 0 THEN '5 MP' WHEN 1 THEN '1080p FHD' WHEN 2 THEN '720p' END",
    "ir_camera": "k % 4 = 2",
    "shutter": "k % 3 = 1",
    "backlit": "CASE k % 6 WHEN 0 THEN FALSE WHEN 1 THEN TRUE END",
    "backlight": "CASE k % 4 WHEN 0 THEN '4-zone RGB' WHEN 1 THEN 'White' END",
    "numpad": "CASE k % 5 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END",
    "copilot_key": "k % 7 = 0",
    "pointing": "CASE k % 8 WHEN 0 THEN 'UltraNav' WHEN 1 THEN 'Touchpad' END",
    "fingerprint": "k % 5 = 3",
    "speakers": "CASE k % 3 WHEN 0 THEN 4 WHEN 1 THEN 2 END",
    "audio": "CASE k % 4 WHEN 0 THEN 'Dolby Atmos' WHEN 1 THEN '' END",
    "wifi": "CASE k % 5 WHEN 0 THEN 'Wi-Fi 7' WHEN 1 THEN 'wi-fi 6E' WHEN 2 THEN 'Wi-Fi 6' WHEN 3 THEN 'Wi-Fi 5' END",
    "antenna": "CASE k % 3 WHEN 0 THEN '1x1' WHEN 1 THEN '2x2' END",
    "thunderbolt": "CASE k % 6 WHEN 0 THEN 'Thunderbolt 5' WHEN 1 THEN 'Thunderbolt 4' WHEN 2 THEN 'Thunderbolt 3' END",
    "ports_text": "CASE k % 5 WHEN 0 THEN '2 x USB-C|1 x HDMI 2.1|RJ-45' WHEN 1 THEN '1 x USB4|3 X USB-A' WHEN 2 THEN 'HDMI' WHEN 3 THEN '2 x Ethernet|9 x USB' END",
    "usb4": "k % 13 = 0",
    "displayport": "k % 3 = 0",
    "ethernet": "CASE k % 7 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END",
    "ethernet_speed": "CASE k % 6 WHEN 0 THEN '2.5 Gbps' WHEN 1 THEN '1 Gbps' END",
    "card_reader": "k % 4 = 3",
    "storage_gb": "CASE WHEN k % 9 > 0 THEN CAST(256 * (1 + k % 6) AS INT) END",
    "touch": "k % 4 = 0",
    "vram_gb": "CASE k % 9 WHEN 0 THEN 4 WHEN 1 THEN 6 WHEN 2 THEN 8 WHEN 3 THEN 12 WHEN 4 THEN 16 WHEN 5 THEN 2 END",
    "names_discrete": "k % 17 = 0",
    "review_build": "CASE WHEN k % 3 = 0 THEN CAST(40 + k % 50 AS DOUBLE) END",
    "cpu": "CASE WHEN k % 10 > 0 THEN 'cpu' END",
    "gpu": "CASE k % 8 WHEN 0 THEN '' ELSE 'gpu' END",
    "brand": "CASE k % 6 WHEN 0 THEN 'Asus' WHEN 1 THEN ' HP' WHEN 2 THEN 'Dell' WHEN 3 THEN 'lenovo' WHEN 4 THEN 'Acer' END",
    "archived": "k % 50 = 7",
    "shown_price": "price * 60",
}

_SHEET_SQL = f"sheet AS (SELECT id, {', '.join(f'{e} AS {c}' for c, e in SHEET.items())} FROM (SELECT p_partkey AS id, p_partkey AS k, p_size AS s, p_retailprice AS price FROM part))"


def _r(x: str, digits: int) -> str:
    return f"CAST(round(CAST({x} AS DECIMAL(28, 9)), {digits}) AS DOUBLE)"


def _c(x: str, low: float, high: float = 100) -> str:
    return _r(f"greatest({low}, least({high}, {x}))", 2)


def _any(text: str, *words: str) -> str:
    return "(" + " OR ".join(f"contains(lower(coalesce({text}, '')), '{w}')" for w in words) + ")"


_OR = lambda c, d: f"coalesce(nullif({c}, {repr(d) if isinstance(d, str) and d else 0}), {d!r})" if not isinstance(d, str) else f"coalesce(nullif({c}, ''), '{d}')"
_KIND = lambda c, shared, own: f"coalesce(nullif({c}, 0), CASE WHEN integrated THEN {shared} ELSE {own} END)"
_W, _CPU_W, _RAM, _WIDE = "coalesce(gpu_w, 0)", _OR("cpu_w", 28.0), _OR("ram_gb", 16), _OR("width", 1920)
_PANEL, _MEM, _HZ = f"upper({_OR('panel', 'IPS')})", f"upper({_OR('memory_type', 'DDR5')})", _KIND("hz", 60, 144)
_RICH = f"(contains({_PANEL}, 'OLED') OR contains({_PANEL}, 'MINI-LED'))"
_BAT, _KG = _KIND("battery_wh", 50.0, 70.0), _KIND("weight_kg", 1.65, 2.3)
_SLOTS, _M2 = "coalesce(slots, CASE WHEN soldered THEN 0 ELSE 2 END)", f"least(3, {_KIND('m2_slots', 1, 2)})"
_OPEN = f"({_SLOTS} >= 1 AND (NOT soldered OR so_dimm))"
_PORTS = "coalesce(string_split(ports_text, '|'), [])"
_LISTED = "lower(coalesce(replace(ports_text, '|', ' '), ''))"
_LAN = f"coalesce(ethernet, contains({_LISTED}, 'rj-45') OR contains({_LISTED}, 'ethernet') OR NOT integrated)"
_FAST = f"coalesce(fast_charge, {_BAT} >= 60)"

METRICS_SQL = f"""{HEAD_SQL}, {_SHEET_SQL},
offers AS (SELECT item_id, min(price) FILTER (is_valid AND in_stock) AS stock_price, min(price) FILTER (is_valid) AS any_price FROM head GROUP BY 1),
a AS (SELECT sheet.*, stock_price, any_price,
  (contains(lower(coalesce(memory_channels, '')), 'dual') OR starts_with(lower(coalesce(memory_layout, '')), '2 x') OR contains({_MEM}, 'LPDDR5') OR {_RAM} >= 32) AS dual_channel,
  coalesce(nullif(memory_mhz, 0), CASE WHEN contains({_MEM}, 'LPDDR5') THEN 6400 WHEN contains({_MEM}, 'DDR5') THEN 5200 ELSE 3200 END) AS mhz,
  coalesce(gpu_full_w, CASE WHEN integrated THEN 0 ELSE 95 END) AS full_w, coalesce(gpu_benchmark, CASE WHEN integrated THEN 18 ELSE 45 END) AS gpu_ref
  FROM sheet LEFT JOIN offers ON item_id = id),
b AS (SELECT *, CASE WHEN dual_channel AND mhz >= 5200 THEN 1.05 WHEN dual_channel THEN 1.02 ELSE 1.0 END AS mult FROM a),
c AS (SELECT *,
  {_c(f"coalesce(cpu_benchmark, {_c(f'{_OR("cores", 8.0)} * 2.5 + {_OR("threads", 12.0)} * 0.8 + ({_OR("boost_ghz", 4.5)} - 3) * 8 + {_OR("cache_mb", 16.0)} * 0.35', 15, 98)}) * mult", 10)} AS cpu_score,
  CASE WHEN integrated OR full_w <= 0 THEN {_c("gpu_ref * mult", 5)} ELSE {_c(f"gpu_ref * {_r(f'greatest(0.72, least(1.10, pow(greatest(0.4, least(1.35, {_W} / full_w)), 0.32)))', 3)} + CASE WHEN gddr7 THEN 2.5 ELSE 0 END", 15)} END AS gpu_score,
  CASE WHEN integrated THEN 'INTEGRATED_SOC' WHEN {_W} <= 0 THEN 'UNKNOWN_TGP_DGPU' WHEN full_w <= 0 THEN 'DISCRETE_EXPLICIT_TGP' WHEN {_W} / full_w >= 0.9 THEN 'FULL_POWER_GPU' WHEN {_W} / full_w >= 0.7 THEN 'MODERATELY_CAPPED_GPU' ELSE 'HEAVILY_CAPPED_GPU' END AS gpu_tier,
  {_r("coalesce(npu_tops, 0) + coalesce(gpu_tops, 0)", 1)} AS ai_tops, coalesce(npu_tops, 0) >= 40 AS copilot_pc,
  {_r(f'''{_KIND("adapter_w", 65, 170)} - ({_CPU_W} + {_W} + CASE WHEN integrated THEN 15 ELSE 25 END - CASE WHEN integrated THEN 0 WHEN {_W} >= 95 THEN CASE WHEN {_CPU_W} >= 55 THEN 20 ELSE 15 END WHEN {_W} >= 65 THEN CASE WHEN {_CPU_W} >= 55 THEN 15 ELSE 10 END ELSE 5 END)''', 1)} AS spare_w,
  {_r(f"sqrt({_WIDE} * {_WIDE} + {_OR('height', 1080)} * {_OR('height', 1080)}) / {_OR('inches', 15.6)}", 1)} AS ppi,
  CASE WHEN {_any("gamut", "dci-p3")} OR {_RICH} THEN '100% DCI-P3 (Cinema / Pro Creator)' WHEN {_any("gamut", "100% srgb", "72% ntsc")} OR {_WIDE} >= 2560 THEN '100% sRGB (Creator / Gaming Ready)' WHEN {_any("gamut", "62.5%")} THEN '62.5% sRGB (Standard)' ELSE '45% NTSC (Basic)' END AS gamut_tier,
  coalesce(nits, CASE WHEN {_RICH} THEN 450 WHEN {_WIDE} >= 2560 OR {_HZ} >= 165 THEN 350 WHEN NOT integrated OR {_any("gamut", "100% srgb")} THEN 300 ELSE 250 END) AS lit,
  {_r(f"{_BAT} / (CASE WHEN {_CPU_W} <= 28 THEN 6.5 WHEN {_CPU_W} <= 45 THEN 9.5 ELSE 13.0 END + CASE WHEN integrated THEN 0 ELSE 1.5 END + CASE WHEN {_WIDE} >= 2560 THEN 1 ELSE 0 END)", 1)} AS battery_hours,
  CASE WHEN front_mm IS NOT NULL AND rear_mm IS NOT NULL THEN {_r("(front_mm + rear_mm) / 2", 1)} ELSE {_KIND("thick_mm", 18.5, 23.5)} END AS thick,
  CASE WHEN {_any("chassis", "alumin", "magnesium", "metal", "carbon")} OR {_any("family", *M.METAL_FAMILIES)} THEN 14.0 WHEN {_any("chassis", "abs")} OR {_any("family", *M.TOUGH_FAMILIES)} THEN 10.5 ELSE 7.5 END AS chassis_pts,
  CASE WHEN archived THEN 'LEGACY_ARCHIVED_OUT_OF_STOCK' WHEN stock_price IS NOT NULL THEN 'IN_STOCK_ACTIVE' WHEN any_price IS NOT NULL THEN 'OUT_OF_STOCK_RECENT' ELSE 'COMING_SOON_UNPRICED' END AS price_status,
  CASE WHEN archived THEN shown_price ELSE coalesce(stock_price, any_price) END AS effective_price
  FROM b),
d AS (SELECT *, {_c("0.45 * cpu_score + 0.55 * gpu_score", 0)} AS silicon_index,
  CASE WHEN spare_w >= 15 THEN {_c("88 + least(12, (spare_w - 15) * 0.2)", 0)} WHEN spare_w >= -5 THEN {_c("80 + (spare_w + 5) * 0.4", 0)} ELSE {_c("65 + spare_w * 1.2", 30, 75)} END AS power_score,
  {_c(f'''{_c("(ppi - 110) / 170 * 25", 6, 25)} + CASE WHEN {_HZ} >= 240 THEN 20 WHEN {_HZ} >= 165 THEN 17.5 WHEN {_HZ} >= 144 THEN 15 WHEN {_HZ} >= 120 THEN 13 WHEN {_HZ} >= 90 THEN 10 ELSE 6 END
    + CASE gamut_tier[1:8] WHEN '100% DCI' THEN 25 WHEN '100% sRG' THEN 21 WHEN '62.5% sR' THEN 13 ELSE 10 END + CASE WHEN {_RICH} THEN 15 WHEN contains({_PANEL}, 'IPS') THEN 11.5 WHEN contains({_PANEL}, 'VA') THEN 8.5 ELSE 5 END + {_c("(lit - 200) / 400.0 * 10", 2, 10)}
    + CASE WHEN coalesce(aspect, CASE WHEN {_OR("height", 1080)} IN (1200, 1600, 1800, 2400) THEN '16:10' ELSE '16:9' END) IN ('16:10', '3:2') THEN 5 ELSE 3 END + CASE WHEN adaptive_sync THEN 3.5 ELSE 0 END + CASE WHEN coalesce(hdr, FALSE) OR contains({_PANEL}, 'OLED') THEN 3.5 ELSE 0 END + CASE WHEN response_ms <= 3 THEN 1.5 ELSE 0 END''', 15)} AS display_score,
  {_c(f'''{_c("(battery_hours - 2.5) / 8 * 35", 5, 35)} + {_c(f"(3.2 - {_KG}) / 2.1 * 35", 3, 35)} + {_c("(30 - thick) / 16.5 * 15", 2, 15)} + CASE WHEN usb_power THEN 10 ELSE 0 END + CASE WHEN {_FAST} THEN 5 ELSE 0 END''', 15)} AS mobility_score,
  CASE WHEN {_KG} <= 1.65 AND battery_hours >= 6.5 THEN 'ULTRAPORTABLE' WHEN {_KG} <= 2.45 THEN 'BALANCED' ELSE 'DESK_BOUND' END AS mobility_tier,
  {_c(f'''least(45, CASE WHEN {_SLOTS} >= 2 AND NOT soldered THEN 30 WHEN {_OPEN} THEN 20 WHEN {_RAM} >= 32 THEN 12 WHEN {_RAM} >= 16 THEN 6 ELSE 0 END
    + CASE WHEN coalesce(max_ram_gb, greatest({_RAM}, CASE WHEN {_SLOTS} >= 2 THEN 32 ELSE {_RAM} END)) >= 64 THEN 10 WHEN coalesce(max_ram_gb, greatest({_RAM}, CASE WHEN {_SLOTS} >= 2 THEN 32 ELSE {_RAM} END)) >= 32 THEN 7 WHEN coalesce(max_ram_gb, greatest({_RAM}, CASE WHEN {_SLOTS} >= 2 THEN 32 ELSE {_RAM} END)) >= 16 THEN 4 ELSE 1 END
    + CASE WHEN contains({_MEM}, '5') THEN 5 ELSE 2 END)
    + least(40, CASE WHEN {_M2} >= 2 THEN 22 ELSE 10 END + CASE WHEN {_M2} - {_OR("ssds", 1)} >= 1 THEN 10 ELSE 3 END + CASE WHEN contains({_OR("storage_interface", "PCIe 4.0 NVMe")}, '5.0') THEN 8 WHEN contains({_OR("storage_interface", "PCIe 4.0 NVMe")}, '4.0') THEN 6.5 ELSE 3.5 END) + chassis_pts''', 15)} AS longevity_score,
  CASE WHEN {_OPEN} AND {_M2} >= 2 THEN 'MAXIMUM_UPGRADEABLE' WHEN {_OPEN} OR {_M2} >= 2 THEN 'MODERATE_EXPANSION' ELSE 'LOCKED_APPLIANCE' END AS longevity_tier,
  {_c(f'''least(35, CASE WHEN contains(lower(webcam), '5 mp') THEN 18 WHEN contains(coalesce(webcam, CASE WHEN {_OR("release_year", 2025)} >= 2025 THEN '1080p' ELSE '720p' END), '1080') THEN 14 ELSE 8 END + CASE WHEN ir_camera THEN 9 ELSE 0 END + CASE WHEN shutter THEN 8 ELSE 0 END)
    + least(35, CASE WHEN NOT coalesce(backlit, TRUE) THEN 5 WHEN {_any("backlight", "per-key", "4-zone", "rgb")} THEN 18 ELSE 15 END + CASE WHEN coalesce(numpad, {_OR("inches", 15.6)} >= 15.6) THEN 7 ELSE 3 END + CASE WHEN copilot_key THEN 5 ELSE 0 END + CASE WHEN {_any("pointing", "numberpad", "dialpad", "ultranav")} THEN 5 ELSE 3 END)
    + least(30, CASE WHEN fingerprint OR ir_camera THEN 12 ELSE 4 END + CASE WHEN coalesce(speakers, 2) >= 4 THEN 10 ELSE 7 END + CASE WHEN coalesce(audio, '') <> '' THEN 8 ELSE 4 END)''', 20)} AS ergonomics_score,
  {_c(f'''CASE WHEN contains(upper({_OR("wifi", "Wi-Fi 6")}), 'WI-FI 7') THEN 20 WHEN contains(upper({_OR("wifi", "Wi-Fi 6")}), '6E') THEN 17 WHEN contains(upper({_OR("wifi", "Wi-Fi 6")}), 'WI-FI 6') THEN 14 ELSE 8 END + CASE WHEN coalesce(antenna, '2x2') = '2x2' THEN 5 ELSE 2.5 END
    + CASE WHEN contains(thunderbolt, '5') THEN 30 WHEN contains(thunderbolt, '4') OR usb4 OR contains({_LISTED}, 'usb4') THEN 26 WHEN displayport OR coalesce(thunderbolt, '') <> '' THEN 20 ELSE 10 END
    + CASE WHEN contains(coalesce(ethernet_speed, CASE WHEN {_LAN} THEN '1 Gbps' ELSE 'None' END), '2.5') THEN 15 WHEN {_LAN} THEN 12 ELSE 3 END + CASE WHEN usb_power THEN 10 ELSE 2 END
    + least(13, 2 * coalesce(nullif(list_sum(list_transform({_PORTS}, lambda p: coalesce(TRY_CAST(nullif(regexp_extract(p, '^\\s*(\\d+)\\s*[xX]', 1), '') AS INT), 1))), 0), 5)) + CASE WHEN card_reader THEN 7 ELSE 0 END''', 20)} AS connectivity_score
  FROM c),
e AS (SELECT *, CASE WHEN effective_price >= 10000 THEN {_r(f"pow(0.28 * cpu_score + 0.32 * gpu_score + 0.15 * display_score + 0.10 * CASE WHEN {_RAM} <= 32 THEN {_RAM} / 32.0 * 100 ELSE 100 END + 0.15 * longevity_score, 1.35) / (effective_price / 10000)", 2)} END AS value_ratio FROM d),
metrics AS (SELECT *, CASE WHEN value_ratio IS NULL THEN 50 ELSE {_c("(value_ratio - 18) / 40 * 100", 15)} END AS value_score FROM (SELECT * FROM e))"""

_COLUMNS = "cpu_score gpu_score gpu_tier silicon_index ai_tops copilot_pc spare_w power_score ppi gamut_tier display_score battery_hours mobility_score mobility_tier longevity_score longevity_tier ergonomics_score connectivity_score price_status effective_price value_ratio value_score".split()


def sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("k"), F.col("p_size").alias("s"), F.col("p_retailprice").alias("price"))
    return base.select("id", *[F.expr(e).alias(c) for c, e in SHEET.items()]).withColumn("ports", F.split("ports_text", "[|]"))


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = head_state(observations(spark, sf_dir)).where("is_valid")
    offers = heads.groupBy("item_id").agg(F.min(F.when(F.col("in_stock"), F.col("price"))).alias("stock_price"), F.min("price").alias("any_price"))
    return M.item_metrics(sheets(spark, sf_dir).join(offers, F.col("id") == F.col("item_id"), "left"))


@query(f"WITH {METRICS_SQL} SELECT id, {', '.join(_COLUMNS)} FROM metrics")
def item_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All metrics of all items."""
    return metrics(spark, sf_dir).select("id", *_COLUMNS)


@query(f"WITH {METRICS_SQL} SELECT id, cpu_score AS score FROM metrics")
def cpu_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.silicon(sheets(spark, sf_dir)).select("id", F.col("cpu_score").alias("score"))


@query(f"WITH {METRICS_SQL} SELECT id, gpu_score AS score FROM metrics")
def gpu_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.silicon(sheets(spark, sf_dir)).select("id", F.col("gpu_score").alias("score"))


@query(f"WITH {METRICS_SQL} SELECT id, power_score AS score FROM metrics")
def power_headroom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.power(sheets(spark, sf_dir)).select("id", F.col("power_score").alias("score"))


@query(f"WITH {METRICS_SQL} SELECT price_status, longevity_tier, count(*) AS items, CAST(round(avg(value_score), 4) AS DOUBLE) AS value FROM metrics GROUP BY 1, 2")
def metrics_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items and their mean value for money by price status and room to upgrade."""
    return metrics(spark, sf_dir).groupBy("price_status", "longevity_tier").agg(F.count(F.lit(1)).alias("items"), F.round(F.avg("value_score"), 4).alias("value"))


@query(f"WITH {_SHEET_SQL} SELECT id, coalesce(cpu, '') <> '' AND coalesce(gpu, '') <> '' AND coalesce(ram_gb, 0) <> 0 AND coalesce(storage_gb, 0) <> 0 AS verified FROM sheet")
def verified_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sheets(spark, sf_dir).select("id", M.verified().alias("verified"))


_RESCUED_SQL = _SHEET_SQL.replace("sheet AS (SELECT id,", "sheet AS (SELECT * REPLACE (integrated AND NOT (coalesce(vram_gb, 0) >= 4 OR coalesce(gpu_w, 0) >= 35 OR names_discrete) AS integrated) FROM (SELECT id,", 1) + ")"
_ADVISOR = "gpu_score vram_score gaming_score creator_score battery_score portability_score build_score advisor_value".split()
_HIGH = _OR("height", 1080)


def _advisor_sql() -> str:
    share = f"greatest(0.4, least(1.35, CASE WHEN {_W} > 0 THEN {_W} ELSE full_w * 0.85 END / full_w))"
    aspect = f"coalesce(aspect, CASE WHEN {_HIGH} IN (1200, 1600, 1800, 2400) THEN '16:10' ELSE '16:9' END)"
    return f"""WITH {METRICS_SQL.replace(_SHEET_SQL, _RESCUED_SQL)},
x AS (SELECT * REPLACE (CASE WHEN integrated OR full_w <= 0 THEN {_c("gpu_ref * mult", 5)} ELSE {_c(f"gpu_ref * {_r(f'greatest(0.72, least(1.10, pow({share}, 0.32)))', 3)} + CASE WHEN gddr7 THEN 2.5 ELSE 0 END", 15)} END AS gpu_score),
  CAST(CASE WHEN integrated OR coalesce(vram_gb, 0) < 4 THEN 15 WHEN vram_gb >= 16 THEN 100 WHEN vram_gb >= 12 THEN 88 WHEN vram_gb >= 8 THEN 74 WHEN vram_gb >= 6 THEN 58 ELSE 40 END AS DOUBLE) AS vram_score,
  {_c(f"CASE WHEN {_HZ} >= 240 THEN 55 WHEN {_HZ} >= 165 THEN 48 WHEN {_HZ} >= 144 THEN 42 WHEN {_HZ} >= 120 THEN 34 WHEN {_HZ} >= 90 THEN 22 ELSE 10 END + CASE WHEN response_ms <= 3 THEN 15 ELSE 5 END + CASE WHEN adaptive_sync THEN 15 ELSE 0 END + CASE WHEN contains({_PANEL}, 'OLED') THEN 15 WHEN contains({_PANEL}, 'IPS') THEN 10 ELSE 5 END", 10)} AS gaming_score,
  {_c(f"CASE gamut_tier[1:8] WHEN '100% DCI' THEN 40 WHEN '100% sRG' THEN 30 WHEN '62.5% sR' THEN 16 ELSE 10 END + CASE WHEN {_RICH} THEN 20 WHEN contains({_PANEL}, 'IPS') THEN 14 WHEN contains({_PANEL}, 'VA') THEN 9 ELSE 4 END + {_c('5 + (lit - 200) / 400.0 * 15', 5, 20)} + {_c('5 + (ppi - 110) / 170 * 10', 5, 15)} + CASE WHEN {aspect} IN ('16:10', '3:2') THEN 5 ELSE 0 END", 15)} AS creator_score,
  {_c(f"{_c('15 + (battery_hours - 2.5) / 8 * 60', 15, 75)} + CASE WHEN usb_power THEN 15 ELSE 0 END + CASE WHEN {_FAST} THEN 10 ELSE 0 END", 15)} AS battery_score,
  {_c(f"{_c(f'10 + (3.2 - {_KG}) / 2.1 * 60', 10, 70)} + {_c('5 + (30 - thick) / 16.5 * 25', 5, 30)}", 15)} AS portability_score,
  {_c("coalesce(0.5 * review_build + 0.5 * CASE chassis_pts WHEN 14 THEN 90 WHEN 10.5 THEN 70 ELSE 50 END, CASE chassis_pts WHEN 14 THEN 90 WHEN 10.5 THEN 70 ELSE 50 END)", 15)} AS build_score FROM metrics),
y AS (SELECT *, 0.28 * cpu_score + 0.10 * CASE WHEN {_RAM} <= 32 THEN {_RAM} / 32.0 * 100 ELSE 100 END + CASE WHEN integrated THEN 0.30 * mobility_score + 0.22 * display_score + 0.10 * build_score ELSE 0.32 * gpu_score + 0.15 * display_score + 0.15 * longevity_score END AS hw FROM x)
SELECT id, * EXCLUDE (id) FROM (SELECT id, {', '.join(_ADVISOR[:-1])}, CASE WHEN effective_price >= 10000 THEN round(15.0 + 82.5 / (1.0 + exp(greatest(-60.0, least(60.0, -2.5 * (hw / (effective_price / 1000.0) - 0.92))))), 2) ELSE 50 END AS advisor_value FROM y)"""


@query(_advisor_sql())
def advisor_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The finer scores of recommendations, with graphics rescued from a wrong label."""
    heads = head_state(observations(spark, sf_dir)).where("is_valid")
    offers = heads.groupBy("item_id").agg(F.min(F.when(F.col("in_stock"), F.col("price"))).alias("stock_price"), F.min("price").alias("any_price"))
    return M.advisor_metrics(sheets(spark, sf_dir).join(offers, F.col("id") == F.col("item_id"), "left")).select("id", *_ADVISOR)
