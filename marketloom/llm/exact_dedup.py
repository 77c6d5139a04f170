"""Exact dedup by content sort [native].

Sampled splitters range-partition the rows by their normalised bytes, an
external sort places equal texts side by side, and neighbouring rows are
compared in full.  Only DataFrame functions are used.

Splitters are sampled on a bounded key: the first 64 characters of the content
and a hash of the whole; both are functions of the content, so equal contents
share a partition while the sample that reaches the driver stays small even
for very long texts.  Contents of which one copy group holds a large share of
all rows are found by an exact count and sorted in blocks, each block on its
own (as many blocks as partitions, 64 at least); block winners are then merged.
At most ``4 x partitions`` contents can be that frequent, so their table has a
proven bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

PREFIX = 64
LEAST_BLOCKS = 64


def normalised(text: Column, how: str = "none") -> Column:
    """``none``: the text as it is; ``space``: trimmed, white space runs as one
    space; ``case_space``: that, in lower case.  Null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    if how == "none":
        return text
    text = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.lower(text) if how == "case_space" else text


def content_sort_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise: str = "none", keep: str = "smallest") -> DataFrame:
    """One row per input row: ``id_col``, keep_id, group_size, kept, text_sha256.

    ``keep`` is ``smallest`` or ``largest`` identifier.  Null texts count as
    empty and form one group.  Null identifiers lose against any other; a group
    that has no other keeps one of them, with keep_id null.  Of repeated rows
    with the winning identifier exactly one is kept.  Other columns of ``df``
    don't take part and may have any names.  An empty table gives no rows.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    spark = df.sparkSession
    base = df.select(F.col(id_col).alias("id"), normalised(F.col(text_col), normalise).alias("content"))
    base = base.withColumns({"head": F.substring("content", 1, PREFIX), "code": F.xxhash64("content")})

    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = base.groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("all"))
    hot = counts.where(F.col("n") > 256).crossJoin(F.broadcast(total)).where(F.col("n") * (4 * partitions) > F.col("all")).select("code", F.lit(True).alias("hot"))
    block = F.when(F.col("hot"), F.pmod(F.xxhash64("id"), F.lit(max(LEAST_BLOCKS, partitions)))).otherwise(F.lit(-1)).cast("int")
    keyed = base.join(F.broadcast(hot), "code", "left").withColumn("block", block).drop("hot")

    side_by_side = keyed.repartitionByRange("head", "code", "block")
    run = Window.partitionBy("head", "code", "block", "content")
    best = F.col("id").asc_nulls_last() if keep == "smallest" else F.col("id").desc_nulls_last()
    extreme = F.min("id") if keep == "smallest" else F.max("id")
    compared = side_by_side.select(
        "id", "block", F.row_number().over(run.orderBy(best)).alias("place"), extreme.over(run).alias("block_keep"), F.count(F.lit(1)).over(run).alias("block_size"), F.sha2("content", 256).alias("text_sha256")
    )
    rows = written(compared, "content-sort")

    merged = extreme_of("block_keep", keep)
    blocks = rows.where((F.col("block") >= 0) & (F.col("place") == 1)).groupBy("text_sha256").agg(merged.alias("group_keep"), F.sum("block_size").alias("size"))
    out = rows.join(F.broadcast(blocks), "text_sha256", "left")
    whole = F.col("block") < 0
    keep_id = F.when(whole, F.col("block_keep")).otherwise(F.col("group_keep"))
    first_block = F.col("id").eqNullSafe(F.col("keep_id"))
    return (
        out.withColumn("keep_id", keep_id)
        .withColumn("group_size", F.when(whole, F.col("block_size")).otherwise(F.col("size")))
        .withColumn("kept", (F.col("place") == 1) & first_block)
        .select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", "text_sha256")
    )


def extreme_of(name: str, keep: str) -> Column:
    return F.min(name) if keep == "smallest" else F.max(name)


def op2_content_sort_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content_sort_dedup(table(spark, sf_dir, "documents"), keep="largest")


ORACLE = {
    "op2_content_sort_dedup": """
SELECT doc_id,
       max(doc_id) OVER w AS keep_id,
       count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
}
