"""Best-fit packing of token sequences, after Martello-Toth dominance reduction.

Documents become pieces of at most ``capacity`` tokens.  What the packing needs
of them is how many there are of each length, ``capacity`` numbers whatever the
size of the corpus; on these the driver fixes dominating sets, packs the rest by
best fit decreasing, and gets a list of *layouts* with how often each is used.
The pieces of a length are then numbered without gaps by tasks that each number
a part, and a piece's number says which layout it goes to and where.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe_ids import encoder
from .common import lean, ranked, table, written

Layout = list[tuple[int, int]]
_PIECE = pa.schema([("id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
_CHUNK_CHARS = 1 << 20


def dominance_reduction(counts: dict[int, int], capacity: int) -> list[tuple[Layout, int]]:
    """Fix sets that dominate every other set with their largest piece; ``counts`` keeps the rest.

    A piece alone, if no other fits beside it; with one that fills the sequence
    exactly; or with the largest that fits, if no two others fit.  Martello and
    Toth (1990) show that some optimal packing has all such sets.
    """
    fixed: list[tuple[Layout, int]] = []

    def take(layout: Layout, times: int) -> None:
        fixed.append((layout, times))
        for length, k in layout:
            counts[length] -= k * times
            if not counts[length]:
                del counts[length]

    changed = True
    while changed:
        changed = False
        for length in sorted(counts, reverse=True):
            while counts.get(length):
                n, room = counts[length], capacity - length
                others = sorted(x for x, c in counts.items() if c - (x == length) > 0)
                if not others or others[0] > room:
                    take([(length, 1)], n if length * 2 > capacity else 1)
                elif counts.get(room, 0) > (room == length):
                    if room == length:
                        take([(length, 2)], n // 2)
                    else:
                        take([(length, 1), (room, 1)], min(n, counts[room]))
                else:
                    least = others[0]
                    second = least if counts[least] - (least == length) > 1 else (others[1] if len(others) > 1 else capacity + 1)
                    if least + second <= room:
                        break
                    mate = max(x for x in others if x <= room)
                    if mate == length:
                        take([(length, 2)], 1)
                    else:
                        # repeated for as long as neither runs out: what is least can only grow
                        take([(length, 1), (mate, 1)], min(n, counts[mate]) if length > mate else 1)
                changed = True
    return fixed


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Layout, int]]:
    """Best fit decreasing, over equal sequences at once."""
    open_at: dict[int, list[tuple[Layout, int]]] = {}

    def put(layout: Layout, times: int, room: int) -> None:
        if times:
            open_at.setdefault(room, []).append((layout, times))

    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            room = min((r for r in open_at if r >= length), default=None)
            if room is None:
                each = capacity // length
                put([(length, each)], n // each, capacity - each * length)
                put([(length, n % each)], min(1, n % each), capacity - n % each * length)
                n = 0
                continue
            layout, times = open_at[room].pop()
            if not open_at[room]:
                del open_at[room]
            each = room // length
            filled = min(times, n // each)
            put([*layout, (length, each)], filled, room - each * length)
            n -= filled * each
            if filled < times:
                part = min(n, each)
                if part:
                    put([*layout, (length, part)], 1, room - part * length)
                    n -= part
                put(layout, times - filled - (part > 0), room)
    return [x for groups in open_at.values() for x in groups]


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """(length, from, to, first sequence, pieces of the length in a sequence, offset) for numbered pieces."""
    rest = dict(counts)
    layouts = dominance_reduction(rest, capacity) + best_fit(rest, capacity)
    used = dict.fromkeys(counts, 0)
    out, sequence = [], 0
    for layout, times in layouts:
        at = 0
        for length, each in layout:
            out.append((length, used[length], used[length] + each * times, sequence, each, at))
            used[length] += each * times
            at += each * length
        sequence += times
    return out


def cut(tokens: int, capacity: int) -> Iterable[tuple[int, int]]:
    """(start, length) of a document's pieces; all but the first are full."""
    first = tokens % capacity or min(tokens, capacity)
    yield 0, first
    for at in range(first, tokens, capacity):
        yield at, capacity


def pieces(df: DataFrame, tokenizer_path: str, capacity: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """Rows (id, piece, start, length, ids_crc32)."""
    end = end_id.to_bytes(4, "little")

    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks have the cores
        enc = encoder(tokenizer_path)

        def rows(ids: list, texts: list[str]):
            cols: list[list] = [[], [], [], [], []]
            for i, packed in zip(ids, enc.encode(texts), strict=True):
                packed += end
                for k, (at, size) in enumerate(cut(len(packed) // 4, capacity)):
                    for c, v in zip(cols, (i, k, at, size, zlib.crc32(packed[4 * at : 4 * (at + size)])), strict=True):
                        c.append(v)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _PIECE, strict=True)], schema=_PIECE)

        for batch in batches:
            ids, texts, size = [], [], 0
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                t = t.as_py() or ""
                ids.append(i)
                texts.append(t)
                size += len(t)
                if size >= _CHUNK_CHARS:
                    yield rows(ids, texts)
                    ids, texts, size = [], [], 0
            if ids:
                yield rows(ids, texts)
        enc.forget()

    read = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return read.mapInArrow(lean(run), "id long, piece int, start long, length long, ids_crc32 long")


def pack_documents(df: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", buckets: int = 64) -> DataFrame:
    """One row per piece: ``id_col``, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and ``end_id``; null and empty texts are that one id.
    A document of more than ``capacity`` ids is cut into full pieces, with the
    short one first.  Every sequence's pieces lie from offset 0 without gaps.
    Repeated rows and rows with a null identifier are documents of their own.
    Full pieces are sequences by themselves, with negative sequence ids.  An
    empty table gives no rows.  Other columns don't take part.
    """
    spark = df.sparkSession
    cuts = written(pieces(df, tokenizer_path, capacity, end_id, id_col, text_col), "pieces")
    full = cuts.where(F.col("length") == capacity).select("*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    short = cuts.where(F.col("length") < capacity)
    counts = {r["length"]: r["count"] for r in short.groupBy("length").count().collect()}  # at most ``capacity`` rows
    segments = spark.createDataFrame(plan(counts, capacity), "length long, begin long, stop long, sequence long, each long, at long")
    numbered = ranked(short, ["length"], ["id", "piece", "ids_crc32"], "number", buckets)
    s = numbered.alias("p").join(F.broadcast(segments).alias("s"), (F.col("p.length") == F.col("s.length")) & (F.col("number") >= F.col("begin")) & (F.col("number") < F.col("stop")))
    within = F.col("number") - F.col("begin")
    placed = s.select("p.id", "piece", "start", "p.length", "ids_crc32", (F.col("sequence") + F.floor(within / F.col("each")).cast("long")).alias("sequence_id"), (F.col("at") + within % F.col("each") * F.col("p.length")).alias("offset"))
    return full.unionByName(placed).withColumnRenamed("id", id_col)


def op8_dominance_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


ORACLE: dict[str, str] = {}
