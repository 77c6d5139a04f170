"""Specifications read back from listing texts that are put together from the parts' columns.

The expected values are therefore the columns themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.functions import names as N
from marketloom.functions import specs as S
from marketloom.registry import query
from marketloom.sources.tables import load, spread


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(p_partkey, text): a listing's text with sizes that follow from the key."""
    k = F.col("p_partkey")
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int"))
    text = F.concat_ws(
        " | ", F.concat(pick(["Core i7-13620H", "Ryzen 7 7840HS", "Core Ultra 7 155H"]), F.lit(" processor")), F.concat(pick(["RTX 4060 8GB", "Iris Xe", "RX 7600M"]), F.lit(" graphics")), F.concat((F.lit(8) * F.pow(F.lit(2), k % 3)).cast("int").cast("string"), F.lit("GB DDR5 4800MHz RAM")),
        F.concat(pick(["512GB", "1TB", "2TB"]), F.lit(" NVMe SSD up to 4TB")), F.concat(pick(["14", "15.6", "16"]), F.lit('" '), pick(["FHD", "WQXGA", "4K"]), F.lit(" "), pick(["IPS", "OLED"]), F.lit(" "), (F.lit(60) * (1 + k % 4)).cast("string"), F.lit("Hz 400 nits")),
        F.concat((40 + k % 50).cast("string"), F.lit("Wh battery, 100W adapter")), F.concat((1 + (k % 20) / 10.0).cast("decimal(3,1)").cast("string"), F.lit(" kg")), F.concat(F.lit("Wi-Fi "), pick(["6", "6E", "7"]), F.lit(", Bluetooth 5.3")), pick(["Windows 11 Pro", "FreeDOS"]),
        F.concat(pick(["RGB backlit", "non-backlit"]), F.lit(" keyboard, 720p webcam, "), pick(["2", "4"]), F.lit(" speakers")),
    )
    return spread(load(spark, sf_dir, "part").select("p_partkey")).select("p_partkey", text.alias("text"))


@query(
    """SELECT p_partkey, ['Core i7-13620H', 'Ryzen 7 7840HS', 'Core Ultra 7 155H'][p_partkey % 3 + 1] AS cpu, ['rtx 4060', 'iris xe', 'rx 7600m'][p_partkey % 3 + 1] AS gpu, CASE WHEN p_partkey % 3 = 0 THEN 8 END::INT AS vram_gb, CAST(8 * pow(2, p_partkey % 3) AS INT) AS ram_gb, 'DDR5' AS ram_type, 4800 AS ram_mhz,
[512, 1024, 2048][p_partkey % 3 + 1]::INT AS storage_gb, 'SSD' AS storage_kind, [14, 15.6, 16][p_partkey % 3 + 1]::DOUBLE AS display_inches, CAST(60 * (1 + p_partkey % 4) AS INT) AS refresh_hz, ['1920x1080', '2560x1600', '3840x2160'][p_partkey % 3 + 1] AS resolution, ['IPS', 'OLED'][p_partkey % 2 + 1] AS panel, 400 AS nits, FALSE AS touch,
CAST(40 + p_partkey % 50 AS DOUBLE) AS battery_wh, 100 AS adapter_w, 1 + (p_partkey % 20) / 10.0 AS weight_kg, ['Wi-Fi 6', 'Wi-Fi 6E', 'Wi-Fi 7'][p_partkey % 3 + 1] AS wifi, 5.3 AS bluetooth, ['Windows 11 Pro', 'FreeDOS'][p_partkey % 2 + 1] AS os,
['RGB', 'none'][p_partkey % 2 + 1] AS backlight, '720p' AS webcam, [2, 4][p_partkey % 2 + 1]::INT AS speakers FROM part"""
)
def spec_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All fields of every listing."""
    text = F.col("text")
    return listings(spark, sf_dir).select("p_partkey", *S.extracted(text))


@query("SELECT p_type, CASE p_type WHEN 'PROMO' THEN 'bundle' WHEN 'ECONOMY' THEN 'used' WHEN 'LARGE' THEN 'non_laptop:desktop' WHEN 'SMALL' THEN 'accessory' ELSE 'ok' END AS reason, count(*) AS n FROM part GROUP BY 1, 2")
def product_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles by the reason they are kept out of the catalog."""
    t = F.col("p_type")
    title = F.concat("p_name", F.when(t == "PROMO", " laptop bundle").when(t == "ECONOMY", " laptop refurbished").when(t == "LARGE", " desktop i7-13700").when(t == "SMALL", " sleeve").otherwise(" laptop i5-1235U with bag"))
    return spread(load(spark, sf_dir, "part").select("p_type", "p_name")).select("p_type", S.product_gate(title).alias("reason")).groupBy("p_type", "reason").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey, 'memory' AS first_field, 'Memory: ' || p_size || ' GB | RAM slots: 2' AS memory_text FROM part")
def routed_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key-value texts parsed, routed to fields and put together again by field."""
    text = F.concat(F.lit("• Memory: "), F.col("p_size").cast("string"), F.lit(" GB\n- Screen size: 15.6\nRAM slots: 2\nplain line"))
    table = N.key_values(text)
    return spread(load(spark, sf_dir, "part").select("p_partkey", "p_size")).select("p_partkey", S.route(F.map_keys(table)[0]).alias("first_field"), S.aggregated(table, "memory").alias("memory_text"))
