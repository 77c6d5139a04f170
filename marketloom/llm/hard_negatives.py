"""Hard negatives by threshold joins in the manner of L2AP.

An *ask* is an anchor with windows of scores; a threshold join finds the best
rows of every window.  Rows are packed where they are read into shards of one
label.  A task holds a group of asks and lets a part of the shards stream past;
in a tile of asks and a shard

* dimensions are put in order of their energy, weakest first, and a row's first
  dimensions are left out of the index as long as their norm, times any ask's,
  stays below every threshold: such a row can't be found by them alone;
* partial scores are added up over the indexed dimensions, strongest first, and
  a row is dropped as soon as its partial score and the product of the norms of
  what remains (left-out dimensions included) is below the threshold for every
  ask;
* what is left is scored in full, in integers, and each window keeps its best.

Thresholds start high and are lowered for those asks only whose windows haven't
filled, until they have or the window ends.  Positives are asked for first
(rows of the anchor's label), then one window for each positive.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import is_empty, only_results, table, written
from .topk_search import narrow, quantised, tile_scores

_SHARD = "label int, ids binary, vectors binary, dim int"
_FOUND = "anchor long, slot int, id long, score long"
_LEAST, _MOST = -(2**63), 2**63 - 1
#: Dimensions that are added up between two rounds of pruning.
_STEP = 8


def _shards(rows: DataFrame, most: int) -> DataFrame:
    """(id, label, v) packed by each task into blocks of at most ``most`` rows of one label and dimension."""

    def pack(batches: Iterator[pa.RecordBatch]):
        held: dict[tuple[int, int], tuple[list, list]] = {}

        def block(key: tuple[int, int]):
            ids, parts = (np.concatenate(x) for x in held.pop(key))
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([ids.tobytes()]), pa.array([narrow(parts).tobytes()]), pa.array([key[1]], pa.int32())], names=["label", "ids", "vectors", "dim"])

        for batch in batches:
            ids, labels = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            size = batch.column(2).value_lengths().to_numpy()
            flat, ends = batch.column(2).flatten().to_numpy(), np.cumsum(size)
            for label, dim in np.unique(np.stack((labels, size), axis=1), axis=0).tolist():
                at = np.flatnonzero((labels == label) & (size == dim))
                m = flat[(ends[at] - dim)[:, None] + np.arange(dim)].reshape(len(at), dim)
                for lo in range(0, len(at), most):
                    mine = held.setdefault((label, dim), ([], []))
                    mine[0].append(ids[at[lo : lo + most]])
                    mine[1].append(m[lo : lo + most])
                    if sum(map(len, mine[0])) >= most:
                        yield block((label, dim))
        for key in list(held):
            yield block(key)

    return rows.select("id", "label", "v").mapInArrow(pack, _SHARD)


def candidates(q: np.ndarray, least: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Places of rows of ``c`` whose inner product with some row of ``q`` may reach that row's ``least``; none that does is missing."""
    order = np.argsort((c.astype(np.float64) ** 2).sum(axis=0), kind="stable")
    q, c = q[:, order].astype(np.float64), c[:, order].astype(np.float64)
    norms = lambda m: np.sqrt(np.concatenate((np.zeros((len(m), 1)), np.cumsum(m * m, axis=1)), axis=1))
    qn, cn = norms(q), norms(c)
    # Rounding of sums of this size stays below the slack.
    slack = 1.0 + 1e-9 * (qn[:, -1].max(initial=0) * cn[:, -1].max(initial=0))
    low = least.astype(np.float64) - slack
    with np.errstate(divide="ignore", invalid="ignore"):
        lowest = np.where(qn[:, -1] > 0, low / qn[:, -1], np.where(low <= 0, -np.inf, np.inf)).min(initial=np.inf)
    skipped = (cn[:, 1:] < lowest).sum(axis=1)  # leading dimensions left out of the index
    rows = np.flatnonzero(skipped < c.shape[1]) if c.shape[1] else np.arange(len(c)) if (low <= 0).any() else np.zeros(0, np.int64)
    partial = np.zeros((len(q), len(rows)))
    for stop in range(c.shape[1], 0, -_STEP):
        start = max(0, stop - _STEP)
        indexed = np.where(np.arange(start, stop) >= skipped[rows, None], c[rows, start:stop], 0.0)
        partial += q[:, start:stop] @ indexed.T
        rest = np.maximum(start, skipped[rows])  # dimensions before this one are still to come
        bound = np.take(qn, rest, axis=1) * cn[rows, rest]
        alive = (partial + bound >= low[:, None]).any(axis=0)
        if not alive.all():
            rows, partial = rows[alive], partial[:, alive]
        if not len(rows) or (skipped[rows] >= start).all():
            break
    return rows


def window_best(scores: np.ndarray, ids: np.ndarray, low: int, high: int, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores from low to high, ties to smaller ids."""
    at = np.flatnonzero((scores >= low) & (scores <= high))
    if len(at) > 4 * k:
        at = at[scores[at] >= np.partition(scores[at], len(at) - k)[len(at) - k]]
    return at[np.lexsort((ids[at], ~scores[at]))][:k]


def threshold_join(asks: DataFrame, shards: DataFrame, k: int, same: bool, group_bytes: int = 64 << 20, part_bytes: int = 512 << 20) -> DataFrame:
    """(anchor, slot, place, id, score): the ``k`` best rows of every window, place from 1.

    ``asks`` has (anchor, label, v, windows: array of (slot, low, high)).  Rows
    of the anchor's label are met if ``same`` is set, else those of others;
    never one with the anchor's own identifier.  ``shards`` is a written table.
    """
    spark = asks.sparkSession
    asks = written(asks, "asks")
    held, there = asks.agg(F.coalesce(F.sum(8 * F.size("v") + 24 * F.size("windows") + 64), F.lit(0))).first()[0], shards.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("vectors") + F.length("ids")), F.lit(0)).alias("size")).first()
    groups = max(1, math.ceil(held / group_bytes))
    parts = max(1, math.ceil(there["size"] / part_bytes), min(there["n"], spark.sparkContext.defaultParallelism))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    none = lambda kind: F.lit(None).cast(kind)
    left = asks.select(F.pmod(F.xxhash64("anchor"), F.lit(groups)).cast("int").alias("group"), every(parts).alias("part"), F.lit(0).alias("kind"), "label", "anchor", "v", "windows", none("binary").alias("ids"), none("binary").alias("vectors"), none("int").alias("dim"))
    right = shards.select(F.pmod(F.xxhash64("ids"), F.lit(parts)).cast("int").alias("part"), every(groups).alias("group"), F.lit(1).alias("kind"), "label", none("long").alias("anchor"), none("array<long>").alias("v"), none(asks.schema["windows"].dataType).alias("windows"), "ids", "vectors", "dim")
    met = left.unionByName(right).repartition("group", "part").sortWithinPartitions("group", "part", "kind")

    def select(batches: Iterator[pa.RecordBatch]):
        here, held, best = None, [], {}

        def lists():
            rows = [(anchor, slot, i, s) for (anchor, slot), found in best.items() for i, s in found]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["anchor", "slot", "id", "score"])

        for batch in batches:
            column = dict(zip(batch.schema.names, batch.columns, strict=True))
            for row in range(batch.num_rows):
                group, part, kind, label = (column[c][row].as_py() for c in ("group", "part", "kind", "label"))
                if (group, part) != here:
                    yield from lists()
                    here, held, best, blocks = (group, part), [], {}, None
                if kind == 0:
                    held.append((label, column["anchor"][row].as_py(), column["v"][row].values.to_numpy(), [(w["slot"], w["low"], w["high"]) for w in column["windows"][row].as_py()]))
                    continue
                if blocks is None:
                    blocks = _ask_blocks(held)
                ids, dim = np.frombuffer(column["ids"][row].as_py(), np.int64), column["dim"][row].as_py()
                raw = column["vectors"][row].as_py()
                c = np.frombuffer(raw, f"i{len(raw) // max(1, len(ids) * dim) or 8}").reshape(len(ids), dim)
                for (of, size), mine in blocks.items():
                    if size == dim and (of == label) == same:
                        for q, least, who in mine:
                            _tile(q, least, who, c, ids, k, best)
        yield from lists()

    found = met.mapInArrow(select, _FOUND)
    order = Window.partitionBy("anchor", "slot").orderBy(F.col("score").desc(), "id")
    return written(found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k), "window-best")


def _ask_blocks(held: list) -> dict:
    """By (label, dimension): blocks of at most 256 asks of like thresholds (vectors, least score wanted, whose windows)."""
    out: dict[tuple[int, int], list] = {}
    for x in held:
        out.setdefault((x[0], len(x[2])), []).append(x)
    for key, asks in out.items():
        m = np.array([a[2] for a in asks], dtype=np.int64).reshape(len(asks), key[1])
        least = np.array([min(w[1] for w in a[3]) for a in asks], dtype=np.int64)
        order = np.argsort(least / np.maximum(np.sqrt((m.astype(np.float64) ** 2).sum(axis=1)), 1e-9), kind="stable")
        out[key] = [(m[at], least[at], [asks[a] for a in at]) for at in (order[lo : lo + 256] for lo in range(0, len(asks), 256))]
    return out


def _tile(q: np.ndarray, least: np.ndarray, who: list, c: np.ndarray, ids: np.ndarray, k: int, best: dict) -> None:
    at = candidates(q, least, c)
    if not len(at):
        return
    scores, ids = tile_scores(q, c[at].astype(np.int64)), ids[at]
    for row, (_, anchor, _, windows) in enumerate(who):
        others = ids != anchor
        s, i = (scores[row], ids) if others.all() else (scores[row][others], ids[others])
        for slot, low, high in windows:
            found = window_best(s, i, low, high, k)
            if len(found):
                have = best.get((anchor, slot), [])
                best[anchor, slot] = sorted(have + list(zip(i[found].tolist(), s[found].tolist(), strict=True)), key=lambda x: (-x[1], x[0]))[:k]


def _positives(anchors: DataFrame, shards: DataFrame, k: int, steps: tuple[float, ...]) -> DataFrame:
    """(anchor, place, id, score): the ``k`` best other rows of each anchor's label."""
    norm2 = F.aggregate("v", F.lit(0).cast("double"), lambda s, x: s + x.cast("double") * x)
    todo, out = anchors, None
    for step in (*steps, None):
        low = F.lit(_LEAST) if step is None else F.ceil(norm2 * step)
        asks = todo.select("anchor", "label", "v", F.array(F.struct(F.lit(0).alias("slot"), low.cast("long").alias("low"), F.lit(_MOST).alias("high"))).alias("windows"))
        found = threshold_join(asks, shards, k, same=True)
        full = found.where(F.col("place") == k).select("anchor")
        done = found if step is None else found.join(full, "anchor", "left_semi")
        out = done if out is None else out.unionByName(done)
        if step is None:
            break
        todo = written(todo.join(full, "anchor", "left_anti"), "asks-left")
        if is_empty(todo):
            break
    return out.select("anchor", "place", "id", "score")


def hard_negatives(
    rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, shard_rows: int = 4096, positive_steps: tuple[float, ...] = (0.8, 0.5, 0.2), window_steps: tuple[int, ...] = (80, 65)
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows`` and ``anchors`` have (id long, label int, v array<long>).  An
    anchor's positives are the ``positives`` best other rows of its label (all,
    if fewer); for each, the ``negatives`` best rows of other labels whose score
    lies between ``low`` and ``high`` percent of the positive's (all, if fewer).
    Higher scores come first, ties by smaller id.  Rows with a null id, label or
    vector take no part, and only vectors of one dimension are compared.  Of
    repeated ids each row counts as a candidate; a repeated anchor is answered
    once, for the least (label, vector).  A negative positive score has an empty
    window.  Empty tables give no rows.  ``positive_steps`` (shares of the
    anchor's squared norm) and ``window_steps`` (percent of the positive's score)
    are the thresholds on the way down; they change the work, never the result.
    """
    fine = F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()
    with only_results(rows.sparkSession) as keep:
        shards = written(_shards(rows.where(fine), shard_rows), "shards")
        picked = written(anchors.where(fine).groupBy(F.col("id").alias("anchor")).agg(F.min(F.struct("label", "v")).alias("x")).select("anchor", "x.label", "x.v"), "anchors")
        found = _positives(picked, shards, positives, positive_steps)
        found = written(found.select("anchor", F.col("place").alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

        p = F.col("positive_score").cast("decimal(24,0)")
        end = F.ceil(p * low / 100).cast("long")
        todo = found.where("positive_score >= 0").select("anchor", "slot", p.alias("p"), end.alias("end"), F.floor(p * high / 100).cast("long").alias("high")).where("end <= high")
        out = None
        for step in (*window_steps, None):
            now = F.col("end") if step is None else F.least("high", F.greatest("end", F.ceil(F.col("p") * step / 100).cast("long")))
            asked = todo.withColumn("low", now)
            windows = asked.groupBy("anchor").agg(F.collect_list(F.struct("slot", "low", "high")).alias("windows"))
            best = threshold_join(picked.join(windows, "anchor").select("anchor", "label", "v", "windows"), shards, negatives, same=False)
            full = best.where(F.col("place") == negatives).select("anchor", "slot")
            over = asked.where("low = end").select("anchor", "slot")  # nothing lower is wanted
            done = best if step is None else best.join(full.union(over).distinct(), ["anchor", "slot"], "left_semi")
            out = done if out is None else out.unionByName(done)
            if step is None:
                break
            todo = written(asked.where("low > end").join(full, ["anchor", "slot"], "left_anti").drop("low"), "windows-left")
            if is_empty(todo):
                break
        result = written(
            out.join(found, ["anchor", "slot"]).select(F.col("anchor").alias("anchor_id"), "positive_id", F.col("place").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "negatives"
        )
        keep.append(result)
    return result


def op13_l2ap_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).cast("int").alias("label"), quantised().alias("v"))
    return hard_negatives(rows, rows.where(F.col("id") % 50 == 0))


ORACLE = {
    "op13_l2ap_negatives": """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS alike, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT * FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (
  SELECT p.anchor_id, p.id AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id) AS INT) AS rank,
         s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.alike AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT * FROM n WHERE rank <= 3
"""
}
