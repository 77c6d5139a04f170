"""Pages as they were fetched: facts by store and day, bodies once each by their content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BODIES = T.StructType().add("digest", "string").add("html", "string").add("head", "string")


def store_key(store: Column) -> Column:
    """A store's name as a folder's: lower case, all but letters, digits, ``_`` and ``-`` as ``_``."""
    return F.regexp_replace(F.lower(store), "[^a-z0-9_-]", "_")


def save(pages: DataFrame, root: str) -> None:
    """Add ``pages`` (store, url, html, scraped_at and more) to the raw store at ``root``.

    What is saved for a store and day takes the place of what was there, so a
    crawl may be saved again; other stores and days stay.  A body is written
    once, under its SHA-256, before the facts that point to it.  A null body
    counts as empty.  Pages without store or time go to a partition of their own.
    """
    spark = pages.sparkSession
    digest = F.sha2(F.coalesce("html", F.lit("")), 256)
    keyed = pages.withColumns({"digest": digest, "url_key": F.substring(F.sha2("url", 256), 1, 12), "store_key": store_key(F.col("store")), "day": F.date_format("scraped_at", "yyyy-MM-dd")})
    new = keyed.groupBy("digest").agg(F.first(F.coalesce("html", F.lit(""))).alias("html")).withColumn("head", F.substring("digest", 1, 2))
    new = new.join(_bodies(spark, root).select("head", "digest"), ["head", "digest"], "left_anti")
    new.select(*BODIES.names).write.mode("append").partitionBy("head").parquet(f"{root}/bodies")
    keyed.drop("html").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("store_key", "day").parquet(f"{root}/facts")


def load_pages(spark: SparkSession, root: str, store: str | None = None, day: str | None = None) -> DataFrame:
    """Pages of a store and day (null: all) with their bodies; only partitions of that store and day are read.

    A root to which no page was saved is refused, since nothing tells its columns.
    """
    found = spark.read.parquet(f"{root}/facts").schema
    texts = T.StructType([T.StructField(f.name, T.StringType()) if f.name in ("store_key", "day") else f for f in found])  # not numbers or dates by the look of their values
    facts = spark.read.schema(texts).parquet(f"{root}/facts")
    if store is not None:
        facts = facts.where(F.col("store_key") == store_key(F.lit(store)))
    if day is not None:
        facts = facts.where(F.col("day") == day)
    facts = facts.withColumn("head", F.substring("digest", 1, 2))
    return facts.join(_bodies(spark, root).dropDuplicates(["head", "digest"]), ["head", "digest"], "left").drop("head").withColumn("html", F.coalesce("html", F.lit("")))


def _bodies(spark: SparkSession, root: str) -> DataFrame:
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(BODIES).parquet(f"{root}/bodies")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], BODIES)
