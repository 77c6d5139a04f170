"""Exact top-k search.

Vectors are packed into blocks where they are read: query blocks and candidate
shards.  A tile is one matrix product of a query block and a shard, of which
each query's ``k`` best are kept by partial selection.  A task gets a group of
query blocks, holds it, and lets one part of the shards stream past, so what is
shuffled is shards x groups and query blocks x parts, in the narrowest integers
that hold them; groups and parts have a bounded size.  The parts' lists are
merged ``fan_in`` at a time in a tree until each query has one.  Nothing is
broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

_BLOCK = "block long, ids binary, vectors binary, dim int"
_LIST = "qblock long, node int, query_id long, vec_id long, score long"
_GROUP_BYTES, _PART_BYTES = 64 << 20, 512 << 20


def quantised(name: str = "embedding", scale: int = 256) -> Column:
    """floor(scale * x) of every component, x as double; null unless all are finite."""
    x = F.transform(F.col(name), lambda v: v.cast("double"))
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    return F.when(F.col(name).isNotNull() & fine, F.transform(x, lambda v: F.floor(F.lit(float(scale)) * v).cast("long")))


def _blocks(vectors: DataFrame, rows: int) -> DataFrame:
    """(id, v) rows packed by each task into blocks of at most ``rows`` of one dimension; ids ascend in each."""

    def pack(batches: Iterator[pa.RecordBatch]):
        held: dict[int, tuple[list, list]] = {}
        made = 0

        def block(dim: int):
            nonlocal made
            ids, parts = held.pop(dim)
            ids, m = np.concatenate(ids), np.concatenate(parts)
            order = np.argsort(ids, kind="stable")
            number = TaskContext.get().partitionId() << 32 | made
            made += 1
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([ids[order].tobytes()], pa.binary()), pa.array([narrow(m[order]).tobytes()], pa.binary()), pa.array([dim], pa.int32())], names=["block", "ids", "vectors", "dim"])

        for batch in batches:
            ids = batch.column(0).to_numpy()
            size = batch.column(1).value_lengths().to_numpy()
            flat, ends = batch.column(1).flatten().to_numpy(), np.cumsum(size)
            for dim in np.unique(size).tolist():
                at = np.flatnonzero(size == dim)
                m = flat[(ends[at] - dim)[:, None] + np.arange(dim)].reshape(len(at), dim)
                for lo in range(0, len(at), rows):
                    mine = held.setdefault(dim, ([], []))
                    mine[0].append(ids[at[lo : lo + rows]])
                    mine[1].append(m[lo : lo + rows])
                    if sum(map(len, mine[0])) >= rows:
                        yield block(dim)
        for dim in list(held):
            yield block(dim)

    return vectors.mapInArrow(pack, _BLOCK)


def narrow(m: np.ndarray) -> np.ndarray:
    """The same integers in the narrowest type that holds them."""
    low, high = m.min(initial=0), m.max(initial=0)
    return m.astype(next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max))


def _unpacked(ids: bytes, vectors: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    i = np.frombuffer(ids, np.int64)
    width = len(vectors) // max(1, len(i) * dim) or 8
    return i, np.frombuffer(vectors, f"i{width}").reshape(len(i), dim).astype(np.int64)


def tile_scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Integer inner products; by double precision where that is exact."""
    dim = q.shape[1]
    bound = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(dim, 1)
    if bound < 2.0**53:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    if bound < 2.0**63:
        return q @ c.T
    exact = q.astype(object) @ c.astype(object).T
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)


def tile_best(scores: np.ndarray, q_ids: np.ndarray, c_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, candidate) places of each query's k highest scores, ties to smaller ids (which ascend), none with the query's own id."""
    left, right = np.searchsorted(c_ids, q_ids, "left"), np.searchsorted(c_ids, q_ids, "right")
    own = np.flatnonzero(right > left)
    if len(own):
        scores = scores.copy()
    for q in own.tolist():
        scores[q, left[q] : right[q]] = np.iinfo(np.int64).min
    n = scores.shape[1]
    keep = np.ones(scores.shape, dtype=bool)
    if n > k:
        keep = scores >= np.partition(scores, n - k, axis=1)[:, n - k, None]
    for q in own.tolist():
        keep[q, left[q] : right[q]] = False
    return first_k(*np.nonzero(keep), scores, k)


def first_k(q: np.ndarray, c: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((c, ~scores[q, c], q))
    q, c = q[order], c[order]
    fine = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[fine], c[fine]


def exact_top_k(queries: DataFrame, candidates: DataFrame, k: int = 5, block_rows: int = 4096, fan_in: int = 8, group_bytes: int = _GROUP_BYTES, part_bytes: int = _PART_BYTES) -> DataFrame:
    """For every query its ``k`` best candidates: query_id, rank, vec_id, score.

    Both tables have (id long, v array<long>).  A candidate with the query's own
    id takes no part.  Ties go to the smaller id.  A query with fewer candidates
    gets all of them; rows with null ids or vectors take no part, and only
    vectors of one dimension are compared.  Of repeated ids, each row counts as
    a candidate, and a repeated query is answered once, for the least of its
    vectors.  Scores beyond 64 bits are cut to that range.  Empty tables give no
    rows.  A task holds ``group_bytes`` of queries and one shard.
    """
    fine = F.col("id").isNotNull() & F.col("v").isNotNull()
    shards = written(_blocks(candidates.where(fine).select("id", "v"), block_rows), "shards")
    asked = written(_blocks(queries.where(fine).groupBy("id").agg(F.min("v").alias("v")), block_rows), "queries")
    sizes = [df.agg(F.coalesce(F.sum(F.length("vectors") + F.length("ids")), F.lit(0))).first()[0] for df in (asked, shards)]
    schema = "query_id long, rank int, vec_id long, score long"
    if not all(sizes):
        return queries.sparkSession.createDataFrame([], schema)
    groups, parts = (max(1, math.ceil(size / most)) for size, most in zip(sizes, (group_bytes, part_bytes), strict=True))

    def dealt(df: DataFrame, kind: int, own: str, n: int, other: str, m: int) -> DataFrame:
        place = F.pmod(F.xxhash64("block"), F.lit(n)).cast("int")
        return df.withColumn(own, place).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1)))).select("group", "part", F.lit(kind).alias("kind"), *df.columns)

    met = dealt(asked, 0, "group", groups, "part", parts).unionByName(dealt(shards, 1, "part", parts, "group", groups))
    met = met.repartition("group", "part").sortWithinPartitions("group", "part", "kind", "block")

    def select(batches: Iterator[pa.RecordBatch]):
        here, blocks, best = None, [], []

        def lists():
            for (number, ids, _), (q, c, s) in zip(blocks, best, strict=True):
                if len(q):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(q), number)), pa.array(np.full(len(q), here[1], np.int32)), pa.array(ids[q]), pa.array(c), pa.array(s)], names=["qblock", "node", "query_id", "vec_id", "score"])

        for batch in batches:
            for k_row in range(batch.num_rows):
                group, part, kind, number, ids, vectors, dim = (batch.column(c)[k_row].as_py() for c in range(7))
                if (group, part) != here:
                    yield from lists()
                    here, blocks, best = (group, part), [], []
                i, m = _unpacked(ids, vectors, dim)
                if kind == 0:
                    blocks.append((number, i, m))
                    best.append((np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)))
                    continue
                for at, (_, q_ids, q) in enumerate(blocks):
                    if q.shape[1] != dim:
                        continue
                    found = [best[at]]
                    for lo in range(0, len(q_ids), 512):
                        scores = tile_scores(q[lo : lo + 512], m)
                        r, c = tile_best(scores, q_ids[lo : lo + 512], i, k)
                        found.append((r + lo, i[c], scores[r, c]))
                    r, c, s = map(np.concatenate, zip(*found, strict=True))
                    order = np.lexsort((c, ~s, r))
                    r, c, s = r[order], c[order], s[order]
                    keep = np.arange(len(r)) - np.searchsorted(r, r) < k
                    best[at] = (r[keep], c[keep], s[keep])
        yield from lists()

    lists = met.mapInArrow(select, _LIST)

    def merge(pdf):
        pdf = pdf.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True], kind="stable")
        return pdf[pdf.groupby("query_id").cumcount() < k]

    while parts > fan_in:
        parts = math.ceil(parts / fan_in)
        lists = lists.withColumn("node", F.floor(F.col("node") / fan_in).cast("int")).groupBy("qblock", "node").applyInPandas(merge, _LIST)

    def order(pdf):
        pdf = merge(pdf)
        pdf["rank"] = pdf.groupby("query_id").cumcount().astype("int32") + 1
        return pdf[["query_id", "rank", "vec_id", "score"]]

    return lists.groupBy("qblock").applyInPandas(order, schema)


def op3_tiled_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), quantised().alias("v"))
    return exact_top_k(rows.where(F.col("id") % 50 == 0), rows)


ORACLE = {
    "op3_tiled_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
}
