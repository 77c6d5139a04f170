"""Dense vectors as arrays: cosine searches, anchors, score adjustments."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.sources.scratch import written


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def similarity(df: DataFrame, vector: str, query: DataFrame, into: str = "similarity") -> DataFrame:
    """Each row's similarity to one query vector (a table of one row), never below 0."""
    q = query.limit(1).select(F.col(vector).alias("_q"))
    return df.crossJoin(F.broadcast(q)).withColumn(into, F.greatest(F.lit(0.0), cosine(F.col(vector), F.col("_q")))).drop("_q")


def adjusted(sims: DataFrame, key: str, base: float = 75.0, con_weight: float = 0.75, gain: float = 32.0) -> DataFrame:
    """Per key the net of its best pro and con similarity, and the score adjusted by it, 35 to 98."""
    g = sims.groupBy(key).agg(F.coalesce(F.max(F.when(F.col("polarity") == "pro", F.col("similarity"))), F.lit(0.0)).alias("pro"), F.coalesce(F.max(F.when(F.col("polarity") == "con", F.col("similarity"))), F.lit(0.0)).alias("con"))
    net = F.col("pro") - con_weight * F.col("con")
    return g.withColumns({"net": net, "score": F.greatest(F.lit(35.0), F.least(F.lit(98.0), base + gain * net))})


def dynamic_weight(scores: DataFrame, value: str, top: int = 5, low: tuple[float, float] = (0.08, 0.10), high: tuple[float, float] = (0.26, 0.25)) -> DataFrame:
    """A weight from the spread of values (one row per key): mean of the top against the median of the rest.

    With no more than ``top`` values: the largest against the median.  The
    spread is at least 0, mapped linearly between the two points and clamped.
    Without values there is no spread.  The top is a sorted limit, and the rest's median comes
    from an aggregate over the values without it, so none is gathered.
    """
    v = scores.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v"))
    best = v.orderBy(F.desc("v")).limit(top).agg(F.avg("v").alias("mean"), F.max("v").alias("most"), F.min("v").alias("least"), F.collect_list("v").alias("taken"))
    all_of = v.crossJoin(F.broadcast(best))  # a row of ``top`` values
    counted = all_of.agg(F.count(F.lit(1)).alias("n"), F.first("mean").alias("mean"), F.first("most").alias("most"), F.percentile("v", 0.5).alias("middle"), F.first("least").alias("least"), F.first("taken").alias("taken"))
    # Of values equal to the least taken one, as many belong to the top as were taken of them.
    ties = F.size(F.filter("taken", lambda x: x == F.col("least")))
    rest = v.crossJoin(F.broadcast(counted.select("least", ties.alias("ties")))).groupBy("v", "least", "ties").agg(F.count(F.lit(1)).alias("c")).where("v <= least")
    rest = rest.select("v", (F.col("c") - F.when(F.col("v") == F.col("least"), F.col("ties")).otherwise(0)).alias("c")).where("c > 0")
    below = rest.agg(F.expr("percentile(v, 0.5, c)").alias("below"))
    spread = F.when(F.col("n") > top, F.col("mean") - F.col("below")).otherwise(F.col("most") - F.col("middle"))
    s = counted.crossJoin(F.broadcast(below)).select(F.greatest(F.lit(0.0), spread).alias("spread"))
    t = (F.col("spread") - low[0]) / (high[0] - low[0])
    return s.withColumn("weight", low[1] + F.greatest(F.lit(0.0), F.least(F.lit(1.0), t)) * (high[1] - low[1]))


def boost(similarity: Column, least: float = 0.48) -> Column:
    return F.when(similarity >= least, F.round((similarity - 0.45) * 0.35, 3)).otherwise(0.0)


def means(df: DataFrame, key: str, vector: str, digits: int | None = None) -> DataFrame:
    """The mean vector of each key's rows, component by component."""
    long = df.select(key, F.posexplode(vector).alias("i", "x")).groupBy(key, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    m = F.col("m") if digits is None else F.round("m", digits)
    return long.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", m.alias("m")))), lambda s: s["m"]).alias("mean"))


def anchored(df: DataFrame, key: str, vector: str, anchors: DataFrame, name: str, anchor: str, most: int = 10_000) -> DataFrame:
    """Each row's most similar anchor (ties by name) and the similarity.

    Anchors are sent to all tasks, so more than ``most`` of them are refused.
    """
    anchors = written(anchors, "anchors")
    if anchors.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} anchors")
    sims = df.crossJoin(F.broadcast(anchors)).select(key, name, cosine(F.col(vector), F.col(anchor)).alias("s"))
    return sims.groupBy(key).agg(F.min(F.struct((-F.round("s", 9)).alias("o"), name, "s")).alias("b")).select(key, F.col(f"b.{name}").alias(name), F.col("b.s").alias("similarity"))


def near_pairs(df: DataFrame, by: str, key: str, vector: str, alike: float, block_rows: int = 1024) -> DataFrame:
    """(by, first, second) of rows of a group at least ``alike``, first < second: products of blocks, each pair of blocks a tile."""
    sizes = df.groupBy(by).agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("_cells"))
    rows = df.select(by, key, vector).join(sizes, by).withColumn("_cell", F.pmod(F.xxhash64(key), "_cells").cast("int"))
    tiles = rows.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_cells") - 1))).withColumns({"_x": F.least("_cell", "_o"), "_y": F.greatest("_cell", "_o")})

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key, kind="stable").reset_index(drop=True)
        m = np.array(pdf[vector].tolist(), dtype=np.float64)
        m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
        # Pairs inside a block are found in its own tile only.
        cell, apart = pdf["_cell"].to_numpy(), bool(pdf["_x"].iloc[0] != pdf["_y"].iloc[0])
        a, b = np.nonzero(np.triu(m @ m.T >= alike, 1))
        if apart:
            a, b = a[cell[a] != cell[b]], b[cell[a] != cell[b]]
        return pd.DataFrame({by: pdf[by].iloc[a].to_numpy(), "first": pdf[key].iloc[a].to_numpy(), "second": pdf[key].iloc[b].to_numpy()})

    kind = df.schema[key].dataType.simpleString()
    return tiles.groupBy(by, "_x", "_y").applyInPandas(run, f"{by} {df.schema[by].dataType.simpleString()}, first {kind}, second {kind}")


def dense_dedup(df: DataFrame, by: str, key: str, vector: str, alike: float = 0.88, block_rows: int = 1024) -> DataFrame:
    """Greedy in key order inside each group: rows at least ``alike`` to a kept one go.  Keys are unique in a group.

    Decided in rounds: an undecided row without undecided earlier neighbours
    stays, and its neighbours go, so no group is gathered in one task.
    """
    # Of equal vectors only the first can stay, so the others make no pairs; those of length 0 are like nothing.
    solid = F.coalesce(norm(F.col(vector)) > 1e-9, F.lit(False))
    single = df.where(solid).groupBy(by, vector).agg(F.min(key).alias(key)).select(by, key, vector).unionByName(df.where(~solid).select(by, key, vector))
    single = written(single, "single")
    pairs = written(near_pairs(single, by, key, vector, alike, block_rows), "pairs")
    rows = single.select(by, key)
    while pairs.take(1):
        kept = pairs.select(by, "first").distinct().join(pairs.select(by, F.col("second").alias("first")), [by, "first"], "left_anti")
        gone = written(pairs.join(kept, [by, "first"], "left_semi").select(by, "second").distinct(), "gone")
        rows = rows.join(gone.withColumnRenamed("second", key), [by, key], "left_anti")
        left = pairs.join(gone, [by, "second"], "left_anti").join(gone.withColumnRenamed("second", "first"), [by, "first"], "left_anti")
        pairs = written(left.select(by, "first", "second"), "pairs")
    return rows


def per_aspect(df: DataFrame, by: str, aspect: str, score: str, key: str, vector: str, each: int = 2, most: int = 8, veto: float = 0.88) -> DataFrame:
    """Up to ``each`` rows of every aspect in turn, then the best of all, ``most`` per group; rows more alike to a pick than ``veto`` are passed over.

    One pick a group and round, so there are ``most`` rounds, and of a group
    only its pick is joined back.
    """
    left = written(df.withColumn("_n", F.lit(0)), "candidates")
    picks = None
    for _ in range(most):
        open_ = F.col("_n") < each
        rank = F.struct((~open_).cast("int").alias("phase"), F.when(open_, F.col(aspect).cast("string")).otherwise("").alias("turn"), (-F.col(score)).alias("s"), F.col(key).alias("k"))
        best = written(left.groupBy(by).agg(F.min_by(F.struct(key, aspect, vector), rank).alias("p")).select(by, *[F.col(f"p.{c}").alias(f"_{c}") for c in (key, aspect, vector)]), "picks")
        picks = best if picks is None else picks.unionByName(best)
        met = left.join(best, by)
        met = met.where((F.col(key) != F.col(f"_{key}")) & (cosine(F.col(vector), F.col(f"_{vector}")) <= veto))
        left = written(met.withColumn("_n", F.col("_n") + (F.col(aspect) == F.col(f"_{aspect}")).cast("int")).select(*left.columns), "candidates")
        if not left.take(1):
            break
    chosen = picks.select(F.col(by).alias("_by"), F.col(f"_{key}").alias("_key"))
    return df.join(chosen, (F.col(by) == F.col("_by")) & (F.col(key) == F.col("_key")), "left_semi")
