"""What the operators share: tables, shared scratch tables, input hygiene."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketloom.sources.scratch import discard, only_results, scratch_path, shared_dir, written

__all__ = ["discard", "is_empty", "lean", "only_results", "ranked", "scratch_path", "shared_dir", "spare_name", "table", "text_or_empty", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read by Spark so that any store it can open will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` for mapInArrow or mapInPandas, at whose end the task's memory goes back to the system: workers live on, and what they keep counts against their executor."""

    def task(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def give_back() -> None:
    """Return memory that was freed, but is kept for later, to the system; nothing where the C library can't."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def spare_name(df: DataFrame, stem: str) -> str:
    """``stem``, with underscores added until no column of ``df`` has the name."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem = f"_{stem}"
    return stem


def is_empty(df: DataFrame) -> bool:
    return not df.take(1)


def ranked(df: DataFrame, group: list[str], order: list[str], into: str, buckets: int = 256, count: str | None = None) -> DataFrame:
    """Number the rows of each group from 0 without gaps, with no task per group.

    Rows are dealt to ``buckets`` hashed sub-groups of their group; each task
    numbers sub-groups, and a table of at most groups x ``buckets`` sub-totals
    carries the numbers on.  ``order`` decides the order inside a sub-group.
    ``count`` names a column of multiplicities, if a row stands for several.
    Use only where the number of groups is bounded: the sub-totals are joined
    by Spark's own size check.
    """
    one = F.col(count) if count else F.lit(1)
    bucket, total, base = (spare_name(df, x) for x in ("bucket", "bucket_total", "bucket_base"))
    dealt = df.withColumn(bucket, F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    totals = dealt.groupBy(*group, bucket).agg(F.sum(one).cast("long").alias(total))
    w = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(*group, bucket, F.coalesce(F.sum(total).over(w), F.lit(0)).alias(base))
    inner = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.withColumn(into, F.coalesce(F.sum(one).over(inner), F.lit(0)).cast("long"))
    joined = out.alias("l").join(
        bases.select(*[F.col(c).alias(f"__g{i}") for i, c in enumerate(group)], F.col(bucket).alias("__gb"), F.col(base)),
        _all([F.col(f"l.{c}").eqNullSafe(F.col(f"__g{i}")) for i, c in enumerate(group)] + [F.col(f"l.{bucket}") == F.col("__gb")]),
        "left",
    )
    return joined.withColumn(into, F.col(into) + F.col(base)).drop(bucket, base, "__gb", *[f"__g{i}" for i in range(len(group))])


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out
