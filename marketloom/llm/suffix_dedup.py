"""Removal of long repeated byte strings by distributed prefix doubling.

Every byte covered by a string of ``length`` bytes that also starts elsewhere
goes.  Doubling over every byte would sort each position, with its pair of
ranks, once a round; here only sampled positions are sorted, and only those
that are not unique go on, at growing lengths:

1. Of the starts of all strings of ``length`` bytes, those whose smallest hashed
   gram (of ``gram`` bytes, 73 of 200) lies in one place are one *site*: about
   one row in 65 bytes.  The choice looks at nothing but the string, so equal
   strings always lie in sites of one gram, at one distance from it.
2. Sites are ranked by their gram.  Grams that occur once are unique: their
   strings are too.  Sites whose whole neighbourhood is that of another one are
   past the threshold: all their strings repeat.
3. The rest double up.  A round cuts each site's starts into quarters; all
   strings of a quarter share a longer gram, whose rank follows from the pair
   (rank so far, added piece).  Pairs are sorted and ranked again: quarters with
   a unique gram end, those whose whole neighbourhood is shared are decided, all
   others are cut again, until a quarter is one string of ``length`` bytes.
   Sites that are decided stay as long as undecided ones may meet them, one of
   each content.
4. Documents meet their decided stretches, which are united and cut out.

Ranks are names (hashes of the pair), not numbers: only equality is asked for.
Counts are aggregates with map-side combine, so the members of a frequent gram
never meet in one task.  They are joined with their counts, both read from
written tables and the result written, which is where Spark's skew join splits
the members of one key over tasks.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, only_results, table, written
from .textkernels import _power_tables, mix, text_buffer

#: Starts hashed at a time; below 2**20, as places within it take 20 bits.
_SEGMENT = 1 << 19
_LOW = np.uint64((1 << 20) - 1)


def window_of(length: int) -> int:
    """Gram places in a string of ``length`` bytes: a power of two, at most two thirds of it."""
    return 1 << max(0, (2 * length // 3).bit_length() - 1)


def sites(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(text, first start, number of starts, distance of the gram from the first, gram's hash, neighbourhood's hash) of all sites of texts laid end to end."""
    w = window_of(length)
    gram = length - w + 1
    found = [[] for _ in range(6)]
    base = int(starts[0]) if len(starts) else 0
    stop = int(ends[-1]) if len(ends) else 0
    for lo in range(base, stop - length + 1, _SEGMENT):
        hi = min(lo + _SEGMENT, stop - length + 1)
        m = hi - lo + length - 1
        power, inverse = _power_tables(m + 1)
        sums = np.zeros(m + 1, dtype=np.uint64)
        np.cumsum((raw[lo : lo + m].astype(np.uint64) + np.uint64(1)) * power[:m], out=sums[1:])
        grams = mix((sums[gram:] - sums[:-gram]) * inverse[: m - gram + 1])
        key = (grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64)
        at = (_sliding_min(key, w)[: hi - lo] & _LOW).astype(np.int64)

        text = np.searchsorted(ends, np.arange(lo, hi), "right")
        fine = np.minimum(text, len(ends) - 1)
        fine = (np.arange(lo, hi) + length <= ends[fine]) & (np.arange(lo, hi) >= starts[fine])
        new = np.flatnonzero(fine & np.concatenate(([True], (at[1:] != at[:-1]) | (text[1:] != text[:-1]) | ~fine[:-1])))
        if not len(new):
            continue
        cut = np.flatnonzero(np.concatenate((fine[:-1] & (~fine[1:] | (at[1:] != at[:-1]) | (text[1:] != text[:-1])), [fine[-1]])))
        n = cut - new + 1
        back = at[new] - new
        around = mix((sums[new + n - 1 + length] - sums[new]) * inverse[new]) ^ mix((n * 65536 + back).astype(np.uint64))
        for into, what in zip(found, (text[new], new + lo - starts[text[new]], n, back, grams[at[new]], mix(around)), strict=True):
            into.append(what)
    return tuple(np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in found)


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of x[s : s + w] for every s."""
    n = len(x)
    padded = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = x
    rows = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    before = np.minimum.accumulate(rows, axis=1).reshape(-1)
    return np.minimum(ahead[: n - w + 1], before[w - 1 : n])


def _sites_of(docs: DataFrame, length: int) -> DataFrame:
    """(gram, around, doc, code, first, n, back) of every site; a document is known by its identifier and its text's hash."""

    def run(batches):
        for batch in batches:
            text, first, n, back, gram, around = sites(*text_buffer(batch.column(2)), length)
            at = pa.array(text)
            yield pa.RecordBatch.from_arrays(
                [pa.array(gram.view(np.int64)), pa.array(around.view(np.int64)), batch.column(0).take(at), batch.column(1).take(at), pa.array(first.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(back.astype(np.int32))],
                names=["gram", "around", "doc", "code", "first", "n", "back"],
            )

    return docs.mapInArrow(run, f"gram long, around long, doc {docs.schema['doc'].dataType.simpleString()}, code long, first int, n int, back int")


def _at_document(left: str, right: str) -> Column:
    return F.col(f"{left}.doc").eqNullSafe(F.col(f"{right}.doc")) & (F.col(f"{left}.code") == F.col(f"{right}.code"))


#: Stands for a row where one of equals is chosen; of two rows with one hash, both are.
_SELF = F.xxhash64


def _shared(found: DataFrame) -> DataFrame:
    """Sites whose gram occurs more than once, with ``twins`` (how many have their neighbourhood as well), ``leads`` (one of these) and ``open`` (the gram has undecided sites)."""
    grams = written(found.groupBy("gram").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("gram"), "grams")
    kept = written(found.join(grams, "gram", "left_semi"), "sites-shared")
    groups = written(kept.groupBy("gram", "around").agg(F.count(F.lit(1)).alias("twins"), F.min(_SELF("doc", "code", "first")).alias("head")), "twins")
    undecided = written(groups.where("twins = 1").select("gram").distinct().withColumn("open", F.lit(True)), "grams-open")
    told = written(groups.join(undecided, "gram", "left"), "twins-open")
    out = written(kept.join(told, ["gram", "around"]).withColumn("leads", _SELF("doc", "code", "first") == F.col("head")).drop("head"), "sites-twins")
    for t in (grams, kept, groups, undecided, told):
        discard(t)
    return out


def _neighbourhoods(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """Wanted sites with their bytes: from the first start to the end of the last string."""
    lists = written(wanted.groupBy("doc", "code").agg(F.collect_list(F.struct("gram", "twins", "first", "n", "back")).alias("sites")), "sites-asked")
    met = docs.alias("d").join(lists.alias("s"), _at_document("d", "s")).select("d.doc", "d.code", F.col("d.text").cast("binary").alias("body"), "sites")
    kind = lists.schema["doc"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            rows, pieces = [], []
            for k in range(batch.num_rows):
                body, mine = batch.column(2)[k].as_py(), batch.column(3)[k].as_py()
                rows.append(np.full(len(mine), k))
                pieces.extend((s["gram"], s["twins"], s["first"], s["n"], s["back"], body[s["first"] : s["first"] + s["n"] - 1 + length]) for s in mine)
            at = pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64), pa.int64())
            columns = list(zip(*pieces, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), *[pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()), strict=True)]],
                names=["doc", "code", "gram", "twins", "first", "n", "back", "body"],
            )

    return met.mapInArrow(run, f"doc {kind}, code long, gram long, twins long, first int, n int, back int, body binary")


def _round(state: DataFrame, width: int, length: int) -> DataFrame:
    """The state's sites cut into parts of ``width`` distances, each with what the part's ranks say: ``same`` (rows with its bytes), ``like`` (with its longer gram), ``open`` (undecided ones among these) and whether it leads its equals.

    ``far`` and ``near`` are the distances of a row's first and last start from its gram.
    """
    part = F.explode(F.sequence(F.floor(F.col("near") / width), F.floor(F.col("far") / width)))
    cut = state.select("*", part.alias("part")).withColumns({"top": F.least("far", (F.col("part") + 1) * width - 1).cast("int"), "low": F.greatest("near", F.col("part") * width).cast("int")})
    piece = lambda at, size: F.substring("body", at.cast("int") + 1, size.cast("int"))
    cut = cut.withColumns(
        {
            "rank": F.xxhash64("rank", "part", piece(F.col("far") - F.col("part") * width, F.lit(length - width + 1))),
            "body": piece(F.col("far") - F.col("top"), F.col("top") - F.col("low") + length),
            "first": (F.col("first") + F.col("far") - F.col("top")).cast("int"),
        }
    ).select("doc", "code", "first", "weight", "undecided", "rank", F.col("top").alias("far"), F.col("low").alias("near"), "body", F.unhex(F.md5("body")).alias("name"))
    cut = written(cut, "parts")
    equals = written(cut.groupBy("rank", "name").agg(F.sum("weight").alias("same"), F.max("undecided").alias("asks"), F.min(_SELF("doc", "code", "first")).alias("head")), "equals")
    ranks = written(equals.groupBy("rank").agg(F.sum("same").alias("like"), F.max(F.col("asks") & (F.col("same") == 1)).alias("open")).where("like > 1"), "ranks")
    told = written(equals.drop("asks").join(ranks, "rank"), "equals-ranks")
    out = written(cut.join(told, ["rank", "name"]).withColumn("leads", _SELF("doc", "code", "first") == F.col("head")).drop("head", "name"), "ranked")
    for t in (cut, equals, ranks, told):
        discard(t)
    return out


def repeated_stretches(docs: DataFrame, length: int) -> DataFrame:
    """(doc, code, start, end): stretches of ``docs`` (doc, code, text) made of strings of ``length`` bytes that start elsewhere too; they may overlap."""
    found = written(_sites_of(docs, length), "sites")
    shared = _shared(found)
    discard(found)
    reach = lambda df, n: df.select("doc", "code", F.col("first").alias("start"), (F.col("first") + n - 1 + length).alias("end"))
    decided = [reach(shared.where("twins > 1"), F.col("n"))]

    # A repeated row brings its sites twice; they are twins, so undecided sites have one row each and one leader stands for each content.
    asked = shared.where("open AND (twins = 1 OR leads)").dropDuplicates(["doc", "code", "first"])
    state = _neighbourhoods(docs, asked, length).select(
        "doc", "code", "first", F.col("twins").alias("weight"), (F.col("twins") == 1).alias("undecided"), F.col("gram").alias("rank"), F.col("back").alias("far"), (F.col("back") - F.col("n") + 1).alias("near"), "body"
    )
    width = window_of(length)
    while width > 1:
        width = max(1, width // 4)
        ranked = _round(state, width, length)
        decided.append(reach(ranked.where("undecided AND same > 1"), F.col("far") - F.col("near") + 1))
        state = ranked.where("open AND ((undecided AND same = 1) OR leads)").select("doc", "code", "first", F.col("same").alias("weight"), (F.col("undecided") & (F.col("same") == 1)).alias("undecided"), "rank", "far", "near", "body")
    out = decided[0]
    for more in decided[1:]:
        out = out.unionByName(more)
    return out.distinct()


def cut_out(body: bytes, stretches: np.ndarray) -> tuple[bytes, int, int]:
    """(what remains, bytes removed, maximal removed runs); stretches are rows of (start, end)."""
    if not len(stretches):
        return body, 0, 0
    s = stretches[np.argsort(stretches[:, 0], kind="stable")]
    reach = np.maximum.accumulate(s[:, 1])
    new = np.concatenate(([True], s[1:, 0] > reach[:-1]))
    begins, ends = s[new, 0], reach[np.concatenate((new[1:], [True]))]
    kept = b"".join(body[a:b] for a, b in zip([0, *ends.tolist()], [*begins.tolist(), len(body)], strict=True))
    return kept, len(body) - len(kept), len(begins)


def remove_repeats(df: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col``, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes).

    Texts are UTF-8 bytes, null ones empty; matches never cross documents, and
    an end of a removed stretch may fall inside a character, so ``kept`` is
    binary.  Strings are judged on the input.  Rows that repeat an identifier or
    a whole row are documents of their own; null identifiers are allowed.  Texts
    shorter than ``length`` lose nothing.  Other columns don't take part and may
    have any names.  An empty table gives no rows.
    """
    if length < 2:
        raise ValueError("length is 2 at least")
    docs = df.select(F.col(id_col).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("code", F.xxhash64("text")).select("doc", "code", "text")
    with only_results(df.sparkSession) as keep:
        lists = written(repeated_stretches(docs, length).groupBy("doc", "code").agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends")), "stretches")
        keep.append(lists)
    met = docs.alias("d").join(lists.alias("s"), _at_document("d", "s"), "left").select("d.doc", F.col("d.text").cast("binary").alias("body"), "starts", "ends")

    def run(batches):
        for batch in batches:
            out = []
            for k in range(batch.num_rows):
                body, starts, ends = (batch.column(c)[k] for c in (1, 2, 3))
                where = np.stack((starts.values.to_numpy(), ends.values.to_numpy()), axis=1) if starts.is_valid else np.zeros((0, 2), np.int64)
                kept, gone, runs = cut_out(whole := body.as_py(), where)
                out.append((len(whole), gone, runs, hashlib.sha256(kept).hexdigest(), kept))
            columns = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True)]], names=["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    done = met.mapInArrow(run, f"doc {docs.schema['doc'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return done.withColumnRenamed("doc", id_col)


def op11_prefix_doubling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


ORACLE: dict[str, str] = {}
