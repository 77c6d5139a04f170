"""Language identification: multinomial naive Bayes over hashed character n-grams.

N-grams of 1 to 4 characters (code points) of the lower-cased text, with a space
before and after it, are hashed into a fixed number of buckets.  Counting is one
pass over all labelled rows: each task emits what it has counted by language and
bucket, and Spark sums that.  The log-probabilities are one matrix, buckets x
languages; it is broadcast, and a text's score is its sparse row of counts times
the matrix, in numpy.  Long texts are counted in stretches, so a task holds one
stretch and one row of counts whatever the text's length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, table

_STRETCH = 1 << 20
_HELD = 64
#: Texts that are scored at once.
_AT_ONCE = 32
UNKNOWN = "und"


def gram_counts(text: str, orders: tuple[int, ...], bits: int) -> tuple[np.ndarray, int]:
    """(how many n-grams of the orders fall in each bucket, characters) of one text."""
    counts = np.zeros(1 << bits, dtype=np.int64)
    most, total = max(orders), 0
    padded = f" {text.lower()} "
    for at in range(0, len(padded), _STRETCH):
        # The grams that start in this stretch; they may end in the next one.
        chars = np.frombuffer(padded[at : at + _STRETCH + most - 1].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        starts = min(_STRETCH, len(padded) - at)
        total += starts
        h, found = np.full(len(chars), 0x811C9DC5, dtype=np.uint32), []
        for order in range(1, min(most, len(chars)) + 1):
            h = h[: len(chars) - order + 1] * np.uint32(0x01000193) ^ chars[order - 1 :]
            if order in orders:
                x = h[:starts] ^ np.uint32(order * 0x9E3779B1 & 0xFFFFFFFF)
                x = (x ^ (x >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
                x = (x ^ (x >> np.uint32(12))) * np.uint32(0x297A2D39)
                found.append(x >> np.uint32(32 - bits))
        if found:
            counts += np.bincount(np.concatenate(found), minlength=1 << bits)
    return counts, total


def learn(labelled: DataFrame, text_col: str, lang_col: str, orders: tuple[int, ...], bits: int, smoothing: float, max_matrix_bytes: int = 1 << 28) -> tuple[list[str], np.ndarray]:
    """Languages in alphabetical order and the log-probability matrix; its last row holds the priors."""

    def count(batches):
        held: dict[str, np.ndarray] = {}

        def emit():
            for lang, s in held.items():
                at = np.flatnonzero(s)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(s[at], pa.int64())], names=["lang", "bucket", "n"])
            held.clear()

        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                if lang not in held and len(held) == _HELD:  # whatever the number of labels, a task holds so many
                    yield from emit()
                sums = held.setdefault(lang, np.zeros((1 << bits) + 1, dtype=np.int64))
                sums[-1] += 1
                sums[:-1] += gram_counts(text.as_py() or "", orders, bits)[0]
        yield from emit()

    rows = labelled.where(F.col(lang_col).isNotNull()).select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    langs = sorted(r["lang"] for r in rows.select("lang").distinct().limit(max_matrix_bytes // (4 << bits) + 1).collect())
    if len(langs) * (4 << bits) > max_matrix_bytes:
        raise ValueError(f"more labels than a matrix of {max_matrix_bytes} bytes has room for; raise max_matrix_bytes or lower bits")
    found = rows.mapInArrow(lean(count), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()  # at most the matrix's own size
    counts = np.zeros(((1 << bits) + 1, len(langs)))
    counts[found["bucket"], np.searchsorted(langs, found["lang"])] = found["n"]
    matrix = np.empty_like(counts)
    grams = counts[:-1] + smoothing
    matrix[:-1] = np.log(grams / grams.sum(axis=0, keepdims=True))
    matrix[-1] = np.log(np.maximum(counts[-1], 1) / max(1.0, counts[-1].sum()))
    return langs, matrix.astype(np.float32)


def sparse_counts(texts: list[str], orders: tuple[int, ...], bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, count) of what occurs in the texts, rows ascending, and the texts' characters: a batch hashed at once, long texts in stretches."""
    padded = [f" {t.lower()} " for t in texts]
    sizes = np.array([len(t) for t in padded], dtype=np.int64)
    small = np.flatnonzero(sizes <= _STRETCH)
    chars = np.frombuffer("".join(padded[k] for k in small.tolist()).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    owner = np.repeat(small, sizes[small])
    h, codes = np.full(len(chars), 0x811C9DC5, dtype=np.uint32), []
    for order in range(1, min(max(orders), len(chars)) + 1):
        h = h[: len(chars) - order + 1] * np.uint32(0x01000193) ^ chars[order - 1 :]
        if order in orders:
            x = h ^ np.uint32(order * 0x9E3779B1 & 0xFFFFFFFF)
            x = (x ^ (x >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            x = (x ^ (x >> np.uint32(12))) * np.uint32(0x297A2D39)
            inside = owner[: len(h)] == owner[order - 1 :]
            codes.append((owner[: len(h)] << bits | (x >> np.uint32(32 - bits)).astype(np.int64))[inside])
    counts = np.bincount(np.concatenate(codes) if codes else np.zeros(0, np.int64), minlength=len(texts) << bits)
    for k in np.flatnonzero(sizes > _STRETCH).tolist():
        counts[k << bits : (k + 1) << bits] = gram_counts(texts[k], orders, bits)[0]
    at = np.flatnonzero(counts)
    return at >> bits, at & ((1 << bits) - 1), counts[at], sizes


def batch_scores(texts: list[str], matrix: np.ndarray, orders: tuple[int, ...], bits: int) -> np.ndarray:
    """Log-posteriors of the languages up to a constant, evidence tempered, a row a text: the batch's sparse counts times the matrix."""
    row, bucket, n, length = sparse_counts(texts, orders, bits)
    evidence = np.zeros((len(texts), matrix.shape[1]))
    there = np.unique(row)
    if len(there):
        evidence[there] = np.add.reduceat(n.astype(np.float32)[:, None] * matrix[bucket], np.searchsorted(row, there), axis=0, dtype=np.float64)
    # An n-gram's neighbours share its characters: the evidence of a text counts as that of so many separate n-grams.
    return evidence / (len(orders) * max(orders) / 2 * np.maximum(1.0, length / 256) ** 0.5)[:, None] + matrix[-1]


def predict(df: DataFrame, text_col: str, langs: list[str], matrix: np.ndarray, orders: tuple[int, ...], bits: int, keep: list[str]) -> DataFrame:
    """Columns ``keep``, lang_pred and score of every row."""
    shared = df.sparkSession.sparkContext.broadcast(matrix)

    def run(batches):
        m = shared.value
        for batch in batches:
            pred, score = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows)
            told = np.flatnonzero(batch.column(1).to_numpy(zero_copy_only=False))
            for at in (told[lo : lo + _AT_ONCE] for lo in range(0, len(told), _AT_ONCE)):
                s = batch_scores(batch.column(0).take(pa.array(at)).to_pylist(), m, orders, bits)
                best = s.argmax(axis=1)
                score[at] = 1 / np.exp(s - s.max(axis=1, keepdims=True)).sum(axis=1)
                for k, b in zip(at.tolist(), best.tolist(), strict=True):
                    pred[k] = langs[b]
            out = [batch.column(at) for at in places]
            yield pa.RecordBatch.from_arrays([*out, pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=[f"k{k}" for k in range(len(keep))] + ["lang_pred", "score"])

    text = F.col(text_col)
    has_letter = F.coalesce(text.cast("string").rlike(r"\p{L}"), F.lit(False))
    # The text goes to Python once, whether kept or not.
    others = [k for k, c in enumerate(keep) if c != text_col or df.schema[c].dataType.simpleString() != "string"]
    places = [2 + others.index(k) if k in others else 0 for k in range(len(keep))]
    read = df.select(text.cast("string").alias("t"), has_letter.alias("f"), *[F.col(keep[k]).alias(f"k{k}") for k in others])
    kinds = ", ".join(f"k{k} {df.schema[c].dataType.simpleString()}" for k, c in enumerate(keep))
    if not langs:
        blank = df.select(*[F.col(c).alias(f"k{k}") for k, c in enumerate(keep)]).withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0)})
    else:
        blank = read.mapInArrow(lean(run), f"{kinds}, lang_pred string, score double")
    return blank.select(*[F.col(f"k{k}").alias(c) for k, c in enumerate(keep)], "lang_pred", "score")


def identify_languages(
    df: DataFrame,
    learn_from: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    orders: tuple[int, ...] = (1, 2, 3, 4),
    bits: int = 15,
    smoothing: float = 0.5,
    keep: list[str] | None = None,
) -> DataFrame:
    """Every row of ``df`` with lang_pred and score, learned from the rows where ``learn_from`` holds.

    lang_pred is a label of the learning rows (of labels with equal scores the
    first by name), or ``und``, with score 0, if the text is null or has no
    letter, or if nothing could be learned.  score is the posterior of the
    predicted label, with the evidence tempered for overlapping n-grams.
    Null labels teach nothing, null texts count for the priors alone, null
    identifiers and repeated rows are rows like others, and an empty table gives
    no rows.  More labels than a matrix of 256 MB has room for (2048) are
    refused.  ``keep`` names the columns to return beside these, ``id_col``
    alone by default.
    """
    langs, matrix = learn(df.where(learn_from), text_col, lang_col, orders, bits, smoothing)
    return predict(df, text_col, langs, matrix, orders, bits, keep or [id_col])


def remainder(id_col: str, of: int) -> Column:
    """crc32 of the identifier as text, modulo ``of``; -1 for a null one."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % of, F.lit(-1))


def op7_hashed_gram_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify_languages(docs, remainder("doc_id", 4) != 2)
    return found.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


ORACLE: dict[str, str] = {}
