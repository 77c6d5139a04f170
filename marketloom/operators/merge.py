"""Merging batches into tables: matching, functional updates, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def matched(batch: DataFrame, known: DataFrame, keys: list[list[str]], known_id: str, order: list[str]) -> DataFrame:
    """``batch`` with the identity each row gets: ``matched_id`` and ``match_rule`` (1 for the first key list, 0 for none).

    Key lists are tried in order; a key with a null part matches nothing.  Of
    known rows that share a key the first in ``order`` counts.
    """
    out = batch
    found: list[Column] = []
    for n, key in enumerate(keys, 1):
        first = known.dropna(subset=key).groupBy(*key).agg(F.min(F.struct(*dict.fromkeys([*order, known_id]))).alias("_m")).select(*[F.col(c).alias(f"_{n}_{c}") for c in key], F.col(f"_m.{known_id}").alias(f"_id{n}"))
        condition = F.lit(True)
        for c in key:
            condition = condition & (out[c] == first[f"_{n}_{c}"])
        out = out.join(first, condition, "left").drop(*[f"_{n}_{c}" for c in key])
        found.append(F.col(f"_id{n}"))
    rule = F.lit(0)
    for n in range(len(keys), 0, -1):
        rule = F.when(found[n - 1].isNotNull(), n).otherwise(rule)
    return out.withColumns({"matched_id": F.coalesce(*found), "match_rule": rule}).drop(*[f"_id{n}" for n in range(1, len(keys) + 1)])


def first_wins(df: DataFrame, key: list[str | Column], order: list[str | Column]) -> DataFrame:
    """One row per key, the first in order: what a later row of a batch sees of earlier ones.

    An aggregate, so that a key's rows are reduced before they are shuffled.
    """
    first = F.min_by(F.struct(*[F.col(f"`{c}`") for c in df.columns]), F.struct(*order)).alias("_first")
    return df.groupBy(*key).agg(first).select("_first.*")


def snapshot(old: DataFrame, new: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """The merged table and what happened to each row: ``inserted``, ``updated``, ``touched`` or ``kept``.

    A new value that is null leaves the old one.
    """
    o = old.select(*keys, *[F.col(v).alias(f"_o_{v}") for v in values], F.lit(True).alias("_old"))
    n = new.select(*keys, *[F.col(v).alias(f"_n_{v}") for v in values], F.lit(True).alias("_new"))
    both = o.join(n, keys, "full_outer")
    merged = {v: F.coalesce(f"_n_{v}", f"_o_{v}") for v in values}
    changed = F.lit(False)
    for v in values:
        changed = changed | ~merged[v].eqNullSafe(F.col(f"_o_{v}"))
    action = F.when(F.col("_old").isNull(), "inserted").when(F.col("_new").isNull(), "kept").when(changed, "updated").otherwise("touched")
    return both.select(*keys, *[merged[v].alias(v) for v in values], action.alias("action"))


def eligible(messages: DataFrame, status: str, retries: str, lease: str, now: Column, most: int = 5) -> DataFrame:
    """Messages to send: pending ones, and those in flight whose lease is over; ``reclaimed`` tells the latter, whose retry count goes up."""
    over = F.col(lease).isNull() | (F.col(lease) < now)
    zombie = (F.col(status) == "PUBLISHING") & over
    fit = (F.col(retries) < most) & ((F.col(status) == "PENDING") | zombie)
    return messages.where(fit).withColumns({"reclaimed": zombie, retries: F.col(retries) + zombie.cast("int")})


def settled(messages: DataFrame, status: str, retries: str, ok: Column, most: int = 5) -> DataFrame:
    """Messages after an attempt: dispatched, failed for good at ``most`` retries, else pending again."""
    tries = F.when(ok, F.col(retries)).otherwise(F.col(retries) + 1)
    return messages.withColumns({"new_status": F.when(ok, "DISPATCHED").when(tries >= most, "FAILED").otherwise("PENDING"), "new_retries": tries})


def unseen(messages: DataFrame, seen: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Messages whose key was never processed, each once."""
    return first_wins(messages, [key], order).join(seen.select(key).distinct(), key, "left_anti")


def touched(df: DataFrame, keys: DataFrame, on: list[str], column: str, value: Column) -> DataFrame:
    """``column`` set to ``value`` in the rows that ``keys`` name."""
    hit = keys.select(*on).distinct().withColumn("_hit", F.lit(True))
    return df.join(hit, on, "left").withColumn(column, F.when(F.col("_hit"), value).otherwise(F.col(column))).drop("_hit")


def donors(df: DataFrame, key: str, order: list[Column], columns: list[str]) -> DataFrame:
    """For every row that lacks evidence, the columns of its key's best row that has some."""
    best = first_wins(df.where("has_evidence"), [key], order).select(key, *[F.col(c).alias(f"donor_{c}") for c in columns])
    return df.where("NOT has_evidence").join(best, key)
