"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages.  Every passage of the whole text is described
by hashed counts of its words and character trigrams and by some shares of
character classes and repeats, embedded by a learned matrix, and weighted by
gated attention; the document's score comes from the weighted mean of its
passages' embeddings.  Embedding, attention and classifier are learned together
from document labels alone (Ilse, Tomczak and Welling, 2018), in numpy, on a
bounded sample of labelled rows.  The model goes to the tasks with their code.

A passage is up to 64 words of a stretch; stretches are whole texts, or of
longer ones about 1 MB each, cut at white space, so a task holds one stretch.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table
from .langid import remainder
from .textkernels import SEPARATORS, spaced, text_buffer, word_hashes

_CHUNK = 1 << 20
PASSAGE_WORDS = 64
_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[65:91] += 32

_CLASSES = np.zeros(256, dtype=np.uint8)
_CLASSES[65:91] = 1  # capitals
_CLASSES[48:58] = 2  # digits
for _k, _chars in ((3, b"!?"), (4, b"#$%&*@~^_=+<>{}[]\\/"), (5, b"|"), (6, b".,;:"), (7, b"\n")):
    _CLASSES[list(_chars)] = _k
_CLASSES[128:192] = 8  # all but the first byte of longer characters
N_SHAPES = 16
#: Buckets of hashed words and character trigrams.
N_HASHED = 1024
N_FEATURES = N_SHAPES + N_HASHED
_AT_ONCE = 2048


def stretches(raw: np.ndarray, start: int, end: int) -> list[tuple[int, int]]:
    """(from, to) of a text's stretches of about ``_CHUNK`` bytes; cut behind white space, or anywhere in a word that is longer."""
    out = []
    while end - start > 2 * _CHUNK:
        gaps = np.flatnonzero(SEPARATORS[raw[start + _CHUNK : start + 2 * _CHUNK]])
        cut = start + _CHUNK + (int(gaps[0]) + 1 if len(gaps) else 0)
        out.append((start, cut))
        start = cut
    return [*out, (start, end)]


def trigram_buckets(buf: np.ndarray) -> np.ndarray:
    """Bucket of the three bytes (A-Z lower-cased) that start at each place."""
    c = _FOLD[buf]
    h = ((c[:-2] * np.uint32(0x01000193) ^ c[1:-1]) * np.uint32(0x01000193) ^ c[2:]) * np.uint32(0x9E3779B1)
    return (h ^ (h >> np.uint32(15))) % np.uint32(N_HASHED)


class Passages:
    """What is counted of the passages of some stretches; a stretch without words has one empty passage."""

    def __init__(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        buf, begin = spaced(raw, starts, ends)
        at, to, h = word_hashes(buf)
        bound = np.searchsorted(at, begin)
        n_pass = np.maximum(1, -(-np.diff(bound) // PASSAGE_WORDS))
        self.first = np.concatenate(([0], np.cumsum(n_pass)))
        row = np.repeat(np.arange(len(starts)), n_pass)
        w0 = bound[row] + (np.arange(self.first[-1]) - self.first[row]) * PASSAGE_WORDS
        w1 = np.minimum(w0 + PASSAGE_WORDS, bound[row + 1])
        self.shapes = _shapes(buf, at, to, h, w0, w1)
        self.w0, self.w1, self.words = w0, w1, h % np.uint64(N_HASHED)
        has = w1 > w0
        self.b0 = np.where(has, at[np.minimum(w0, len(at) - 1)], 0) if len(at) else np.zeros(len(w0), dtype=np.int64)
        self.b1 = np.where(has, to[np.maximum(w1 - 1, 0)], 0) if len(at) else self.b0
        self.grams = trigram_buckets(buf)

    def counted(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """Shapes and hashed counts (65 535 at most) of the passages from ``lo`` to ``hi``."""
        n, parts = np.arange(hi - lo), []
        for begin, size, buckets in ((self.w0[lo:hi], (self.w1 - self.w0)[lo:hi], self.words), (self.b0[lo:hi], np.maximum(0, self.b1 - self.b0 - 2)[lo:hi], self.grams)):
            place = np.arange(size.sum()) + np.repeat(begin - (np.cumsum(size) - size), size)
            parts.append(np.repeat(n * N_HASHED, size) + buckets[place].astype(np.int64))
        counts = np.bincount(np.concatenate(parts), minlength=(hi - lo) * N_HASHED).reshape(hi - lo, N_HASHED)
        return self.shapes[lo:hi].astype(np.float32), np.minimum(counts, 65535).astype(np.uint16)


def features(shapes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """What the model reads of passages: shapes, and roots of the shares of their counts."""
    share = counts / np.maximum(1, counts.sum(axis=1, keepdims=True, dtype=np.float32))
    return np.concatenate((shapes, np.sqrt(share, dtype=np.float32)), axis=1)


def _shapes(buf: np.ndarray, at: np.ndarray, to: np.ndarray, h: np.ndarray, w0: np.ndarray, w1: np.ndarray) -> np.ndarray:
    """Shares of character classes, word lengths and repeats of the passages of words w0 to w1."""
    words = (w1 - w0).astype(np.float64)
    has = words > 0
    some = np.maximum(words, 1)

    def over_words(v: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(v, dtype=np.float64)))
        return sums[w1] - sums[w0]

    out = np.zeros((len(w0), N_SHAPES))
    if len(at):
        b0 = np.where(has, at[np.minimum(w0, len(at) - 1)], 0)
        b1 = np.where(has, to[np.maximum(w1 - 1, 0)], 0)
        size = np.maximum(b1 - b0, 1)
        kinds = _CLASSES[buf]
        for k in range(1, 9):
            places = np.flatnonzero(kinds == k)
            n = np.searchsorted(places, b1) - np.searchsorted(places, b0)
            out[:, k - 1] = np.where(has, n / (some if k in (3, 5, 6, 7) else size), 0)
        lengths = (to - at).astype(np.float64)
        out[:, 8] = over_words(lengths) / some / 10
        out[:, 9] = np.sqrt(np.maximum(0, over_words(lengths**2) / some - (over_words(lengths) / some) ** 2)) / 10
        owner = np.searchsorted(w0, np.arange(len(at)), "right") - 1
        for k, lag in enumerate((1, 2, 3)):
            same = np.zeros(len(at))
            if len(at) > lag:
                same[lag:] = (h[lag:] == h[:-lag]) & (owner[lag:] == owner[:-lag])
            out[:, 10 + k] = over_words(same) / some
        order = np.lexsort((h, owner))
        fresh = np.ones(len(at))
        fresh[1:] = (h[order][1:] != h[order][:-1]) | (owner[order][1:] != owner[order][:-1])
        out[:, 13] = np.bincount(owner, weights=fresh[np.argsort(order, kind="stable")], minlength=len(w0)) / some
    out[:, 14] = words / PASSAGE_WORDS
    out[:, 15] = ~has
    return out


class AttentionModel:
    """Encoder, gated attention and classifier; ``score`` is the probability of label 1."""

    def __init__(self, hidden: int = 24, attention: int = 12, seed: int = 3):
        rng = np.random.default_rng(seed)
        shape = {"W": (N_FEATURES, hidden), "V": (hidden, attention), "U": (hidden, attention)}
        self.p = {k: rng.normal(0, 1 / np.sqrt(s[0]), s) for k, s in shape.items()}
        self.p |= {"b": np.zeros(hidden), "vb": np.zeros(attention), "ub": np.zeros(attention), "a": rng.normal(0, 0.3, attention), "c": rng.normal(0, 0.3, hidden), "d": np.zeros(1)}
        self.mean, self.scale = np.zeros(N_FEATURES), np.ones(N_FEATURES)
        self.constant: float | None = None

    def _forward(self, x: np.ndarray, first: np.ndarray) -> dict:
        return self._attend(np.tanh(x @ self.p["W"] + self.p["b"]), first)

    def _attend(self, e: np.ndarray, first: np.ndarray) -> dict:
        p = self.p
        t, s = np.tanh(e @ p["V"] + p["vb"]), 1 / (1 + np.exp(-(e @ p["U"] + p["ub"])))
        logit = (t * s) @ p["a"]
        row = np.repeat(np.arange(len(first) - 1), np.diff(first))
        weight = np.exp(logit - np.maximum.reduceat(logit, first[:-1])[row])
        weight /= np.add.reduceat(weight, first[:-1])[row]
        z = np.add.reduceat(weight[:, None] * e, first[:-1], axis=0)
        y = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"], -30, 30)))
        return {"e": e, "t": t, "s": s, "row": row, "w": weight, "z": z, "y": y}

    def embed(self, x: np.ndarray) -> np.ndarray:
        w = self.p["W"] / self.scale[:, None]
        return np.tanh(x @ w.astype(np.float32) + (self.p["b"] - self.mean @ w))

    def score(self, e: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Probabilities of label 1 from the embedded passages of documents, each one's from first[k] to first[k + 1]."""
        return np.full(len(first) - 1, self.constant) if self.constant is not None else self._attend(e, first)["y"]

    def _gradient(self, x: np.ndarray, first: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        p, f = self.p, self._forward(x, first)
        dy = (f["y"] - label) / len(label)
        dz = dy[:, None] * p["c"]
        dz_row = dz[f["row"]]
        dw = (dz_row * f["e"]).sum(axis=1)
        mean = np.add.reduceat(f["w"] * dw, first[:-1])
        dl = f["w"] * (dw - mean[f["row"]])
        dt, ds = dl[:, None] * p["a"] * f["s"] * (1 - f["t"] ** 2), dl[:, None] * p["a"] * f["t"] * f["s"] * (1 - f["s"])
        de = (f["w"][:, None] * dz_row + dt @ p["V"].T + ds @ p["U"].T) * (1 - f["e"] ** 2)
        return {
            "c": f["z"].T @ dy, "d": np.array([dy.sum()]), "a": (f["t"] * f["s"]).T @ dl, "V": f["e"].T @ dt, "vb": dt.sum(0), "U": f["e"].T @ ds, "ub": ds.sum(0), "W": x.T @ de, "b": de.sum(0),
        }

    def fit(self, bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 20, batch: int = 64, rate: float = 0.005, decay: float = 1e-3, seed: int = 5) -> AttentionModel:
        """Adam over shuffled batches of documents; ``bags`` are shapes and counts of their passages."""
        labels = np.asarray(labels, dtype=np.float64)
        if len(labels) == 0 or labels.min() == labels.max():
            self.constant = float(labels.mean()) if len(labels) else 0.5
            return self
        n = sum(len(x) for x, _ in bags)
        for x in (features(*bag) for bag in bags):
            self.mean = self.mean + x.sum(axis=0, dtype=np.float64) / n
        square = sum(((features(*bag) - self.mean) ** 2).sum(axis=0) for bag in bags) / n
        self.mean, self.scale = self.mean.astype(np.float32), (np.sqrt(square) + 1e-2).astype(np.float32)
        rng, m, v, step = np.random.default_rng(seed), {k: 0.0 for k in self.p}, {k: 0.0 for k in self.p}, 0
        for epoch in range(epochs):
            order = rng.permutation(len(bags))
            for lo in range(0, len(order), batch):
                pick = order[lo : lo + batch]
                first = np.concatenate(([0], np.cumsum([len(bags[k][0]) for k in pick])))
                g, step = self._gradient((features(*map(np.concatenate, zip(*[bags[k] for k in pick], strict=True))) - self.mean) / self.scale, first, labels[pick]), step + 1
                now = rate * (1 - epoch / epochs)
                for k in self.p:
                    d = g[k] + decay * self.p[k]
                    m[k] = 0.9 * m[k] + 0.1 * d
                    v[k] = 0.999 * v[k] + 0.001 * d * d
                    self.p[k] = self.p[k] - now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return self


def _groups(column: pa.Array):
    """(rows of the stretches, their passages) in groups of about ``_CHUNK`` bytes."""
    raw, starts, ends = text_buffer(column)
    rows, spans, total = [], [], 0
    for k in range(len(starts)):
        for a, b in stretches(raw, int(starts[k]), int(ends[k])):
            rows.append(k)
            spans.append((a, b))
            total += b - a
            if total >= _CHUNK or len(rows) >= _AT_ONCE:
                yield np.array(rows), Passages(raw, *np.array(spans).T)
                rows, spans, total = [], [], 0
    if rows:
        yield np.array(rows), Passages(raw, *np.array(spans).T)


def train(docs: DataFrame, labels: DataFrame, eligible: Column, id_col: str, text_col: str, label_col: str, train_rows: int, train_bytes: int) -> AttentionModel:
    """Fit on all passages of at most ``train_rows`` labelled documents with at most ``train_bytes`` of text in all: those with the smallest hashed identifiers, as long as there is room."""
    marked = labels.where(eligible & F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("i")).agg(F.min(F.col(label_col).cast("int")).alias("y"))
    picked = marked.orderBy(F.xxhash64("i"), "i").limit(train_rows)

    def bags(batches):
        for batch in batches:
            for one in range(batch.num_rows):
                part = batch.slice(one, 1)
                x = [p.counted(0, int(p.first[-1])) for _, p in _groups(part.column(1))]
                packed = zlib.compress(b"".join(np.concatenate(c).tobytes() for c in zip(*x, strict=True)), 1)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([packed], pa.binary()), part.column(2)], names=["i", "x", "y"])

    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t"))
    sizes = texts.join(F.broadcast(picked), "i").groupBy("i", "y").agg(F.max(F.coalesce(F.octet_length("t"), F.lit(0)) + 1).alias("size")).where(F.col("size") <= train_bytes)  # train_rows rows at most
    room = F.sum("size").over(Window.orderBy(F.xxhash64("i"), "i"))
    texts = texts.join(F.broadcast(sizes.withColumn("room", room).where(F.col("room") <= train_bytes)), "i").select("i", "t", "y")
    # One row an identifier, the same one whatever the order of rows.
    rows = texts.mapInArrow(bags, f"i {kind}, x binary, y int").groupBy("i").agg(F.min("x").alias("x"), F.min("y").alias("y")).toPandas().sort_values("i")

    def unpacked(x: bytes) -> tuple[np.ndarray, np.ndarray]:
        raw = zlib.decompress(x)
        n = len(raw) // (4 * N_SHAPES + 2 * N_HASHED)
        return np.frombuffer(raw, np.float32, n * N_SHAPES).reshape(n, N_SHAPES), np.frombuffer(raw, np.uint16, n * N_HASHED, 4 * n * N_SHAPES).reshape(n, N_HASHED)

    return AttentionModel().fit([unpacked(x) for x in rows["x"]], rows["y"].to_numpy())


def quality_scores(docs: DataFrame, labels: DataFrame, eligible: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", train_rows: int = 6000, threshold: float = 0.3, train_bytes: int = 32 << 20) -> DataFrame:
    """``id_col``, score (0 to 1) and predicted (1 if score >= ``threshold``) of every row of ``docs``.

    Only labels of rows where ``eligible`` (an expression on ``id_col``) holds
    are learned, of at most ``train_rows`` documents with ``train_bytes`` of text
    in all, every passage of each; scores are of all passages.  Of a document's repeated
    labels the least counts, of rows that repeat an identifier one teaches, and
    null labels and labels without a document teach nothing.  Null and empty
    texts have one empty passage.  Without labels of both kinds the score is
    their mean (0.5 if there are none).  Repeated rows and null identifiers are
    scored like others; an empty table gives no rows.
    """
    model = train(docs, labels, eligible, id_col, text_col, label_col, train_rows, train_bytes)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            embedded, owner = [], []
            for rows, p in _groups(batch.column(1)):
                n = int(p.first[-1])
                embedded += [model.embed(features(*p.counted(lo, min(n, lo + _AT_ONCE)))) for lo in range(0, n, _AT_ONCE)]
                owner.append(np.repeat(rows, np.diff(p.first)))
            first = np.searchsorted(np.concatenate(owner), np.arange(batch.num_rows + 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(np.concatenate(embedded), first), pa.float64())], names=["i", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    scored = docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, f"i {kind}, score double")
    return scored.select(F.col("i").alias(id_col), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op10_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), remainder("doc_id", 5) != 0)
    return scored.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


ORACLE: dict[str, str] = {}
