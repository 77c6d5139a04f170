"""Event flows as Structured Streaming jobs: inbox, routing, price batches.

Leases, retries and acknowledgements of a broker are what a streaming
checkpoint does; a job here is a source, a transformation and a sink.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from marketloom.operators.prices import transition
from marketloom.sources.scratch import scratch_path


def events(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of the files of a table (one file or a folder), with the schema they have now.

    The path is given as a pattern, since the file source takes a plain path for
    a folder.
    """
    pattern = f"{path[:-1]}[{path[-1]}]"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(pattern)


def inbox(stream: DataFrame, key: str, time: str, within: str = "24 hours") -> DataFrame:
    """Each message once: repeats within the given time are dropped, and older state with them.

    A message that is late by more than ``within`` against the latest one seen is taken for a repeat and dropped.
    """
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, within).dropDuplicatesWithinWatermark([key])


def to_table(df: DataFrame, what: str, mode: str = "append") -> DataFrame:
    """Run what there is to the end, into a Parquet table in the shared folder, and read it."""
    spark = df.sparkSession
    path, checkpoint = scratch_path(spark, what), scratch_path(spark, f"{what}-checkpoint")
    q = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(path)


def routed(stream: DataFrame, routes: dict[str, Callable[[DataFrame, int], None]], routing_key: str, checkpoint: str) -> StreamingQuery:
    """Every micro-batch's rows, with the batch's number, to the handler of their routing key; rows of unknown keys are left.

    A batch may come again after a failure, so handlers must give the same state when called twice with one number.
    """

    def each(batch: DataFrame, number: int) -> None:
        for key, handler in routes.items():
            handler(batch.where(F.col(routing_key) == key), number)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def batch_sink(path: str) -> Callable[[DataFrame, int], None]:
    """A handler that writes each batch to a folder of its own number, so a batch that comes again replaces itself."""
    return lambda rows, number: rows.write.mode("overwrite").parquet(f"{path}/batch={number}")


def windowed_counts(stream: DataFrame, time: str, key: str, length: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Events by window and key; a window is final once the watermark has passed it."""
    timed = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return timed.groupBy(F.window(time, length).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))


def apply_batch(state: DataFrame, batch: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Heads after a batch of checks, with the kind of change; of several checks of a key the last counts.

    ``state`` and ``batch`` have keys, price and in_stock.
    """
    last = batch.groupBy(*keys).agg(F.max_by(F.struct("price", "in_stock"), F.struct(*order)).alias("m"))
    new = last.select(*keys, F.col("m.price").alias("new_price"), F.col("m.in_stock").alias("now_in_stock"))
    both = state.join(new, keys, "full_outer")
    now: Column = F.coalesce("now_in_stock", "in_stock")
    step = transition(F.col("price"), F.col("new_price"), F.col("in_stock"), now)
    kind = F.when(F.col("price").isNull(), "NEW").when(F.col("now_in_stock").isNull(), "UNCHECKED").otherwise(step["change_type"])
    return both.select(*keys, F.coalesce("new_price", "price").alias("price"), now.alias("in_stock"), kind.alias("change_type"))
