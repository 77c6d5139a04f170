"""Catalog documents: nested JSON files in, tables out, and the engine's sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PRODUCT = T.StructType(
    [
        T.StructField("title", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("mpn", T.StringType()),
        T.StructField("price", T.DoubleType()),
        T.StructField("in_stock", T.BooleanType()),
        T.StructField("specs", T.MapType(T.StringType(), T.StringType())),
    ]
)
CATALOG = T.StructType(
    [
        T.StructField("store_key", T.StringType()),
        T.StructField("structured_products", T.ArrayType(PRODUCT)),
        T.StructField("products", T.ArrayType(PRODUCT)),
        T.StructField("latest_pointers", T.ArrayType(T.StringType())),
        T.StructField("_corrupt_record", T.StringType()),
    ]
)


def read_catalogs(spark: SparkSession, paths: list[str], multi_line: bool = True) -> DataFrame:
    """One row per catalog (a file, or a line if ``multi_line`` is off); what is no JSON is left out, missing files are no error."""
    raw = spark.read.option("ignoreMissingFiles", True).schema(CATALOG).option("multiLine", multi_line).option("mode", "PERMISSIVE").json(paths)
    return raw.where("_corrupt_record IS NULL").drop("_corrupt_record")


def catalog_products(catalogs: DataFrame) -> DataFrame:
    """One row per product: structured products if the catalog has any, else the plain ones."""
    some = F.when(F.size("structured_products") > 0, F.col("structured_products")).otherwise(F.col("products"))
    return catalogs.select("store_key", F.posexplode(some).alias("position", "p")).select("store_key", "position", "p.*")


def catalog_pointers(catalogs: DataFrame, first: int = 3) -> DataFrame:
    """A store's crawl pointers: its own, or the titles of its first products."""
    some = F.when(F.size("structured_products") > 0, F.col("structured_products")).otherwise(F.col("products"))
    titles = F.transform(F.slice(some, 1, first), lambda p: p["title"])
    return catalogs.select("store_key", F.when(F.size("latest_pointers") > 0, F.col("latest_pointers")).otherwise(titles).alias("pointers"))


def append_json(df: DataFrame, path: str) -> None:
    """Add rows to a JSON-lines sink."""
    df.write.mode("append").json(path)


def replace_keyed(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The table with rows of ``new`` in place of those that share their keys."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def first_available(spark: SparkSession, paths: list[str], schema: T.StructType) -> DataFrame:
    """The first Parquet source that can be opened and has rows; an empty table of ``schema`` if none."""
    from pyspark.errors import AnalysisException

    for path in paths:
        try:
            df = spark.read.schema(schema).parquet(path)
            if df.take(1):
                return df
        except AnalysisException:
            continue
    return spark.createDataFrame([], schema)
