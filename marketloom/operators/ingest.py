"""Review profiles taken into the catalog, and the events that tell of it, in one commit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketloom.sources.catalogs import replace_keyed
from marketloom.sources.commits import commit, current, table

#: The score of an item that nobody has reviewed, tries of an event.
NEUTRAL, MAX_RETRIES = 75.0, 5
STATE = T.StructType().add("id", "string").add("score", "double").add("evidence", "long").add("sources", "long").add("reviewed", "boolean")
OUTBOX = T.StructType().add("message_id", "string").add("event_id", "string").add("event_type", "string").add("routing_key", "string").add("payload", "string").add("status", "string").add("retry_count", "integer").add("max_retries", "integer")


def profile_state() -> Column:
    """(score, evidence, sources, reviewed) of an entry, null if it has no profile at all.

    Entries have either ``profile`` (score, evidence, real) or the flat columns
    score, evidence, real, scraped_docs, filled (any list, aspect scores or
    bilingual text) and chunks; sources is how many there are, raw whether it
    has lists of raw sources.  Without real evidence an entry counts as not reviewed.
    """
    no = lambda c: F.coalesce(c == F.lit(0), F.lit(False))
    false = lambda c: F.coalesce(~c, F.lit(False))
    n, p = F.coalesce("sources", F.lit(0)).cast("long"), F.col("profile")
    out = lambda score, evidence, sources, reviewed: F.struct(score.cast("double").alias("score"), evidence.cast("long").alias("evidence"), sources.alias("sources"), F.lit(reviewed).alias("reviewed"))
    unseen = out(F.lit(NEUTRAL), F.lit(0), F.lit(0).cast("long"), False)
    nested = F.when(false(p["real"]) | (no(p["evidence"]) & (n == 0)) | (F.coalesce("raw", F.lit(False)) & (n == 0)), unseen).otherwise(out(p["score"], p["evidence"], n, True))
    empty = ~F.coalesce("filled", F.lit(False)) & F.col("score").isNull()
    flat = (
        F.when(false(F.col("real")) | ((n == 0) & (no(F.col("evidence")) | (no(F.col("scraped_docs")) & F.col("evidence").isNull()))), unseen)
        .when(empty, F.when(n > 0, unseen))
        .otherwise(out(F.col("score"), F.coalesce("evidence", "chunks", F.lit(0)), n, True))
    )
    return F.when(p.isNotNull(), nested).otherwise(flat)


def outbox_rows(events: DataFrame, batch: str) -> DataFrame:
    """Pending messages of ``events`` (event_type, routing_key, payload as JSON): the payload's own event_id counts, else the message's.

    A message's id follows from batch, type and payload, so a batch that is written again makes the same ones.
    """
    made = F.sha2(F.concat_ws("\x1f", F.lit(batch), "event_type", "routing_key", "payload"), 256)
    own = F.get_json_object("payload", "$.event_id")
    return events.select(made.alias("message_id"), F.coalesce(F.when(own != "", own), made).alias("event_id"), "event_type", "routing_key", "payload", F.lit("PENDING").alias("status"), F.lit(0).alias("retry_count"), F.lit(MAX_RETRIES).alias("max_retries"))


def ingest(spark: SparkSession, root: str, batch: str, entries: DataFrame, known: DataFrame) -> bool:
    """Profiles of ``entries`` (ids, position, and what ``profile_state`` reads) become the state of all their ids that ``known`` (id) has.

    Of several entries with one id the last by position counts.  States and one
    event for each updated id are committed together; False if the batch is in already.
    """
    base = current(spark, root)
    if batch in base["batches"]:
        return False
    named = entries.withColumn("_s", profile_state()).where("_s IS NOT NULL").select(F.explode("ids").alias("id"), "position", "_s")
    new = named.groupBy("id").agg(F.max_by("_s", "position").alias("s")).join(known.select("id").distinct(), "id", "left_semi").select("id", "s.*")
    payload = F.to_json(F.struct(F.concat_ws(":", F.lit(batch), "id").alias("event_id"), "id", "score"))
    events = new.select(F.lit("review.profile.updated").alias("event_type"), F.lit("reviews.updated").alias("routing_key"), payload.alias("payload"))
    states = replace_keyed(table(spark, root, "states", STATE, base), new, ["id"])
    return commit(spark, root, batch, add={"outbox": outbox_rows(events, batch)}, replace={"states": states}, base=base)
