"""Sharding by jump consistent hashing [native].

A key's shard follows from the key and the number of shards alone: no ring
table, and appending a shard moves rows only into the new one, the necessary
1/(n+1) of them.  The generator is the published 64-bit linear congruential one
(Lamping and Veach, 2014); as a Spark column its product modulo 2**64 is put
together from 16-bit limbs, so nothing overflows under ANSI arithmetic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ranked, table, text_or_empty, written

# Fixed value: the multiplier of the published generator.
MULTIPLIER = 2862933555777941757

_LIMBS = [(MULTIPLIER >> (16 * i)) & 0xFFFF for i in range(4)]


def _next_key(key: Column) -> Column:
    """key * MULTIPLIER + 1 modulo 2**64."""
    a = [F.shiftrightunsigned(key, 16 * i).bitwiseAND(F.lit(0xFFFF)) for i in range(4)]
    s = F.lit(1).cast("long")
    limbs = []
    for i in range(4):
        for j in range(i + 1):
            s = s + a[j] * F.lit(_LIMBS[i - j])
        limbs.append(s.bitwiseAND(F.lit(0xFFFF)))
        s = F.shiftright(s, 16)
    return limbs[0].bitwiseOR(F.shiftleft(limbs[1], 16)).bitwiseOR(F.shiftleft(limbs[2], 32)).bitwiseOR(F.shiftleft(limbs[3], 48))


def jump_shard(key: Column, shards: int) -> Column:
    """The shard, 0 to ``shards`` - 1, of a long key; null keys go to shard 0.

    The jump moves on at least one shard a step, so ``shards`` steps suffice.
    """
    if shards < 1:
        raise ValueError("shards is at least 1")
    start = F.struct(F.coalesce(key.cast("long"), F.lit(0)).alias("key"), F.lit(-1).cast("long").alias("at"), F.lit(0).cast("long").alias("next"))

    def step(state: Column, _: Column) -> Column:
        going = state["next"] < shards
        moved = F.when(going, _next_key(state["key"])).otherwise(state["key"])
        at = F.when(going, state["next"]).otherwise(state["at"])
        draw = F.shiftrightunsigned(moved, 33).cast("double") + 1.0
        ahead = F.floor((at + 1).cast("double") * (F.lit(float(1 << 31)) / draw)).cast("long")
        return F.struct(moved.alias("key"), at.alias("at"), F.when(going, ahead).otherwise(state["next"]).alias("next"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, step, lambda s: s["at"].cast("int"))


def shard_rows(df: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", buckets: int = 256) -> DataFrame:
    """Every row with its shard and its slot there.

    Columns: ``id_col``, size (UTF-8 bytes of the text, null: none, plus 1),
    text_crc32 (null text: of no bytes), law (``key``), shard, slot (gapless
    from 0 in each shard), grown_shard (with one shard more).  A null key counts
    as key 0.  Repeated rows are counted before they are shuffled and get a
    slot each; equal texts with different keys may part, as the key alone
    decides.  An empty table gives no rows.  Other columns don't take part.
    """
    text = text_or_empty(text_col)
    rows = df.select(F.col(id_col).alias("id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    counted = rows.groupBy("id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("copies"))
    placed = counted.withColumns({"shard": jump_shard(F.col("id"), shards), "grown_shard": jump_shard(F.col("id"), shards + 1)})
    numbered = ranked(written(placed, "shards"), ["shard"], ["id", "size", "text_crc32"], "first", buckets, "copies")
    slots = numbered.withColumn("slot", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("copies") - 1)))
    return slots.select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op5_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(table(spark, sf_dir, "documents"))


ORACLE: dict[str, str] = {}
