"""N-gram Jaccard join: every link between documents whose shingle sets are alike.

Sets are of 64-bit shingle hashes; on these the join is exact.  Steps:

1. One pass makes each document's set of hashed shingles and keeps its size, a
   digest, a hashed bitmap signature (four bits to an element, rounded up to a
   power of two) and the set's *prefix*: two sets with Jaccard similarity t
   share one of the first ``n - ceil(t n) + 1`` elements of either
   under any one order of all shingles.  The order is by hash, with shingles
   known to be frequent last; that knowledge comes from a bounded sample and
   only decides how much work there is, never the result.
2. Documents with equal sets are one class; its smallest id stands for it.
3. Representatives meet at shared prefix elements.  Neighbours in size order
   and each member with the first are compared; links are contracted into
   components.  Members of an element that the sample shows to be in very many
   documents are dealt to parts, about as many as a part has members, and the
   parts' firsts meet in the same way, so no task gets all members.
4. What is left are elements whose members lie in several components.  Their
   members form size-banded tiles (bands by the factor 1/t, large bands cut by
   hash), in which bit counts of the signatures bound each pair's overlap from
   above.  Pairs of one component are passed over: of an element with many
   members those of its largest component are only brought to the others.
5. Pairs that the bound lets through are verified by intersecting their sorted
   arrays, and components are formed again.  A tile with many such pairs (a
   large group of near copies) doesn't emit them: it gets its members' arrays
   and verifies pairs, likeliest first, only until its members are connected.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketloom.operators.graph import connected_components

from .common import is_empty, lean, table, written
from .textkernels import mix, shingle_sets, text_buffer

_HEAD = pa.schema([("id", pa.int64()), ("n", pa.int32()), ("digest", pa.binary()), ("bits", pa.binary()), ("prefix", pa.list_(pa.int64())), ("hot", pa.list_(pa.int64())), ("parts", pa.list_(pa.int32()))])
#: An element with more members than this is dealt to parts.
HOT_ROWS = 512
#: Rows of a class of many copies are joined in so many parts.
_PARTS = 32
_CHUNK = 1 << 20


def _by_bytes(column: pa.Array):
    """(from, to) row ranges of about ``_CHUNK`` bytes of text each."""
    _, starts, ends = text_buffer(column)
    total, lo = 0, 0
    for k in range(len(starts)):
        total += int(ends[k] - starts[k])
        if total >= _CHUNK:
            yield lo, k + 1
            total, lo = 0, k + 1
    if lo < len(starts):
        yield lo, len(starts)


def _sets(batch: pa.RecordBatch, words: int):
    """(ids, sets) in slices of the batch; columns are id and text."""
    for lo, hi in _by_bytes(batch.column(1)):
        part = batch.slice(lo, hi - lo)
        yield part.column(0), shingle_sets(*text_buffer(part.column(1)), words)


def signature(s: np.ndarray) -> bytes:
    """A bitmap of four to eight bits to an element (64 at least), a power of two."""
    width = max(64, 4 << (len(s) - 1).bit_length())
    bits = np.zeros(width, dtype=np.uint8)
    bits[(mix(s) & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def prefix_of(s: np.ndarray, frequent: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """The first elements of a set under (frequent last, hash) that must meet a similar set's: those not in ``frequent``, and places in it of those that are."""
    n = len(s)
    take = n - -(-num * n // den) + 1
    if not len(frequent):
        return s[:take], np.zeros(0, dtype=np.int64)
    at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
    late = frequent[at] == s
    own = s[~late][:take]
    return own, at[late][: take - len(own)]


def _heads(docs: DataFrame, words: int, num: int, den: int, frequent: np.ndarray, parts: np.ndarray) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast((frequent, parts))

    def run(batches):
        late, deal = shared.value
        for batch in batches:
            for ids, sets in _sets(batch, words):
                full = [len(s) > 0 for s in sets]
                own, hot, of = [], [], []
                for s in sets:
                    first, at = prefix_of(s, late, num, den)
                    large = deal[at] > 1
                    own.append(np.concatenate((first, late[at[~large]])).view(np.int64))
                    hot.append(late[at[large]].view(np.int64))
                    of.append(deal[at[large]])
                yield pa.RecordBatch.from_arrays(
                    [
                        ids,
                        pa.array([len(s) for s in sets], pa.int32()),
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if f else None for s, f in zip(sets, full, strict=True)], pa.binary()),
                        pa.array([signature(s) if f else None for s, f in zip(sets, full, strict=True)], pa.binary()),
                        *[pa.array([x if f else None for x, f in zip(c, full, strict=True)], pa.list_(kind)) for c, kind in ((own, pa.int64()), (hot, pa.int64()), (of, pa.int32()))],
                    ],
                    schema=_HEAD,
                )

    return docs.mapInArrow(lean(run), "id long, n int, digest binary, bits binary, prefix array<long>, hot array<long>, parts array<int>")


def frequent_shingles(docs: DataFrame, words: int, sample_rows: int, least: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Sorted shingles that at least ``least`` documents of a sample have, and to how many parts each one's members are dealt.

    The sample has about ``sample_rows`` rows, so the list is bounded; it sets
    the order of elements and the number of parts (see the module's text) and
    leaves results alone.
    """
    rows = docs.count()
    if rows == 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int32)
    picked = docs if rows <= sample_rows else docs.sample(sample_rows / rows, seed=7)

    def run(batches):
        for batch in batches:
            for _, sets in _sets(batch, words):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64) if sets else [], pa.int64())], names=["s"])

    counted = picked.mapInArrow(lean(run), "s long").groupBy("s").count().where(F.col("count") >= least)
    found = counted.toPandas()
    keys = found["s"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    members = found["count"].to_numpy(np.float64)[order] * max(1.0, rows / sample_rows)
    return keys[order], np.where(members > HOT_ROWS, np.ceil(np.sqrt(members)), 1).astype(np.int32)


def _overlap_bound(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Upper bounds of |A and B| from signatures of one width, row by row of ``a`` and ``b``."""
    more = np.bitwise_count(a & ~b).sum(axis=-1, dtype=np.int64)
    less = np.bitwise_count(b & ~a).sum(axis=-1, dtype=np.int64)
    return np.minimum(na - more, nb - less)


def _folded(m: np.ndarray, words: int) -> np.ndarray:
    while m.shape[-1] > words:
        half = m.shape[-1] // 2
        m = m[..., :half] | m[..., half:]
    return m


def _alike(o: np.ndarray, na: np.ndarray, nb: np.ndarray, num: int, den: int) -> np.ndarray:
    return den * o >= num * (na + nb - o)


def _blocks(n: np.ndarray, bits: list[bytes], num: int, den: int):
    """Blocks (x, y, bounds) of a tile whose rows ascend by ``n``: slices of rows of near size and bounds of their overlaps."""
    width = np.array([len(b) // 8 for b in bits])
    spans, lo = [], 0
    while lo < len(n):
        hi = int(np.searchsorted(width[lo:], width[lo], "right")) + lo
        spans.append((lo, hi, np.frombuffer(b"".join(bits[lo:hi]), dtype=np.uint64).reshape(hi - lo, -1)))
        lo = hi
    for i, (a0, a1, m) in enumerate(spans):
        for b0, b1, other in spans[i : i + 2]:
            b = _folded(other, m.shape[1])
            step = max(1, (1 << 19) // max(1, m.shape[1] * len(b)))
            for r in range(a0, a1, step):
                s = min(a1, r + step)
                top = int(np.searchsorted(n[b0:b1], n[s - 1] * den // num, "right"))
                first = max(0, r - b0) if b0 == a0 else 0
                if top > first:
                    x, y = slice(r, s), slice(b0 + first, b0 + top)
                    yield x, y, _overlap_bound(m[r - a0 : s - a0, None, :], b[None, first:top, :], n[x, None], n[None, y])


def tile_pairs(node: np.ndarray, label: np.ndarray, n: np.ndarray, bits: list[bytes], num: int, den: int) -> np.ndarray | None:
    """Pairs of a tile in different components that size and signatures don't rule out; None if they outnumber its rows by far."""
    order = np.argsort(n, kind="stable")
    node, label, n = node[order], label[order], n[order].astype(np.int64)
    found, count = [], 0
    for x, y, bound in _blocks(n, [bits[k] for k in order], num, den):
        p, q = np.nonzero(_alike(bound, n[x, None], n[None, y], num, den) & (label[x, None] != label[None, y]) & (bound > 0))
        if len(p):
            u, v = node[x][p], node[y][q]
            found.append(np.stack((np.minimum(u, v), np.maximum(u, v))))
            count += len(p)
            if count > DENSE * len(node):
                return None
    return np.unique(np.concatenate(found, axis=1), axis=1) if found else np.zeros((2, 0), dtype=np.int64)


def tile_links(node: np.ndarray, label: np.ndarray, items: list[bytes], num: int, den: int) -> list[tuple[int, int]]:
    """Links that connect what a tile can connect: pairs are verified likeliest first, and passed over once connected."""
    sets = [np.frombuffer(x, np.uint64) for x in items]
    order = np.argsort([len(s) for s in sets], kind="stable")
    sets, node, label = [sets[k] for k in order], node[order], label[order]
    n = np.array([len(s) for s in sets], dtype=np.int64)
    root = np.unique(label, return_inverse=True)[1]
    links = []
    for x, y, bound in _blocks(n, [signature(s) for s in sets], num, den):
        p, q = np.nonzero(_alike(bound, n[x, None], n[None, y], num, den) & (root[x, None] != root[None, y]) & (bound > 0))
        best = np.argsort(-bound[p, q] / np.maximum(n[x][p], n[y][q]), kind="stable")
        for i, j in zip((p[best] + x.start).tolist(), (q[best] + y.start).tolist(), strict=True):
            if root[i] != root[j]:
                at = np.minimum(np.searchsorted(sets[j], sets[i]), n[j] - 1)
                if _alike(int((sets[j][at] == sets[i]).sum()), int(n[i]), int(n[j]), num, den):
                    links.append((int(min(node[i], node[j])), int(max(node[i], node[j]))))
                    root[root == root[j]] = root[i]
    return links


#: A tile with more candidate pairs than this to a row is settled by itself instead of emitting them.
DENSE = 4


def _by_tile(batches, work):
    """Feed ``work`` batches that hold whole tiles, from batches sorted by tile; only a tile that goes on is copied."""
    held: list[pa.RecordBatch] = []

    def last():
        whole = pa.Table.from_batches(held).combine_chunks().to_batches()
        held.clear()
        return work(whole[0])

    for batch in batches:
        if not batch.num_rows:
            continue
        tile = batch.column(batch.schema.get_field_index("tile")).to_numpy()
        cuts = np.flatnonzero(tile[1:] != tile[:-1]) + 1
        if held:
            known = held[0].column(held[0].schema.get_field_index("tile"))[0].as_py()
            if tile[0] == known:
                first = int(cuts[0]) if len(cuts) else len(tile)
                held.append(batch.slice(0, first))
                batch, cuts = batch.slice(first), cuts[1:] - first
                if not batch.num_rows:
                    continue
            yield from last()
        end = int(cuts[-1]) if len(cuts) else 0
        if end:
            yield from work(batch.slice(0, end))
        held.append(batch.slice(end))
    if held:
        yield from last()


def _spans(t: pa.RecordBatch):
    tile = t.column("tile").to_numpy()
    cut = np.concatenate(([0], np.flatnonzero(tile[1:] != tile[:-1]) + 1, [len(tile)]))
    return [(int(i), int(j)) for i, j in zip(cut[:-1], cut[1:], strict=True) if j - i > 1]


def _tile_candidates(tiles: DataFrame, num: int, den: int) -> DataFrame:
    """(tile, node, label, n, bits) rows, each tile's together, to candidate pairs (tile, a, b), or (tile, a, null) for each row of a dense tile."""

    def work(t: pa.RecordBatch):
        node, label, n, tile = (t.column(c).to_numpy() for c in ("node", "label", "n", "tile"))
        for i, j in _spans(t):
            pairs = tile_pairs(node[i:j], label[i:j], n[i:j], t.column("bits").slice(i, j - i).to_pylist(), num, den)
            a, b = (np.unique(node[i:j]), None) if pairs is None else pairs
            if len(a):
                ids = pa.array(np.full(len(a), tile[i]), pa.int64())
                yield pa.RecordBatch.from_arrays([ids, pa.array(a, pa.int64()), pa.nulls(len(a), pa.int64()) if b is None else pa.array(b, pa.int64())], names=["tile", "a", "b"])

    return tiles.select("tile", "node", "label", "n", "bits").mapInArrow(lean(lambda batches: _by_tile(batches, work)), "tile long, a long, b long")


def _dense_links(rows: DataFrame, num: int, den: int) -> DataFrame:
    """(tile, node, label, items) rows of dense tiles, each tile's together, to links (a, b)."""

    def work(t: pa.RecordBatch):
        node, label = t.column("node").to_numpy(), t.column("label").to_numpy()
        for i, j in _spans(t):
            links = tile_links(node[i:j], label[i:j], t.column("items").slice(i, j - i).to_pylist(), num, den)
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links, strict=True)], names=["a", "b"])

    return rows.select("tile", "node", "label", "items").mapInArrow(lean(lambda batches: _by_tile(batches, work)), "a long, b long")


def _tiles(open_rows: DataFrame, tile_rows: int, num: int, den: int) -> DataFrame:
    """Rows (key, part, parts, node, label, n) dealt to tiles of about ``tile_rows`` rows, so that every pair of near size and different label meets.

    A key with few rows is one tile.  Of others, rows of the commonest label
    ("many") and the rest ("few") of each size band are cut by hash into cells,
    and a tile is two cells of one band or of neighbouring ones, not both of the
    many.  What is known of a large key is joined by key and part.
    """
    # A tile is bounded by its rows and by the elements of their sets.
    load = lambda rows, n: F.greatest(F.sum(rows), F.ceil(F.sum(rows * n) / 512)).cast("long")
    small = lambda df: df.select(F.xxhash64("key").alias("tile"), "node", "label", "n")
    sizes = open_rows.groupBy("key", "label").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("all_n"), F.max("parts").alias("parts"))
    large = sizes.groupBy("key").agg(F.greatest(F.sum("c"), F.ceil(F.sum("all_n") / 512)).alias("load"), F.max("parts").alias("parts"), F.max(F.struct("c", "label"))["label"].alias("many"))
    large = written(large.where(F.col("load") > tile_rows).select("key", "parts", "many"), "large")
    if is_empty(large):
        return small(open_rows)

    def by_part(df: DataFrame) -> DataFrame:
        return df.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")

    rows = written(open_rows.drop("parts").join(by_part(large), ["key", "part"], "left"), "dealt")
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(den / num)) + 1e-9).cast("int")
    cut = rows.where("many IS NOT NULL").select("key", "part", "node", "label", "n", band.alias("band"), (F.col("label") == F.col("many")).alias("of_many"))
    one = lambda many: F.when(F.col("of_many") == many, F.lit(1)).otherwise(0)
    cells = cut.groupBy("key", "band").agg(*[F.ceil(load(one(m), F.col("n")) / F.lit(tile_rows)).cast("int").alias(c) for m, c in ((True, "m"), (False, "f"))])
    around = cells.withColumnsRenamed({"m": "m0", "f": "f0"})
    for d, name in ((-1, "up"), (1, "down")):
        around = around.join(cells.select("key", (F.col("band") + d).alias("band"), F.col("m").alias(f"m_{name}"), F.col("f").alias(f"f_{name}")), ["key", "band"], "left")
    around = around.na.fill(0).join(large.select("key", "parts"), "key")
    cut = cut.join(by_part(around), ["key", "band", "part"])
    cut = cut.withColumn("cell", F.pmod(F.xxhash64("node"), F.when(F.col("of_many"), F.col("m0")).otherwise(F.col("f0"))).cast("int"))

    def tiles(count: str, name) -> Column:
        return F.transform(F.when(F.col(count) > 0, F.sequence(F.lit(0), F.col(count) - 1)).otherwise(F.array().cast("array<int>")), name)

    b, c = F.col("band"), F.col("cell")
    # A cell is called by its band, its kind and its number; a tile by its key and two cells, the lower band first.
    tile = lambda *cells: F.xxhash64(F.col("key"), *[F.lit(x) if isinstance(x, str) else x for x in cells])
    of_many = F.concat(
        tiles("f0", lambda j: tile(b, "m", c, b, "f", j)),
        tiles("f_up", lambda j: tile(b, "m", c, b + 1, "f", j)),
        tiles("f_down", lambda j: tile(b - 1, "f", j, b, "m", c)),
    )
    of_few = F.concat(
        tiles("m0", lambda i: tile(b, "m", i, b, "f", c)),
        tiles("f0", lambda j: tile(b, "f", F.least(c, j), b, "f", F.greatest(c, j))),
        tiles("m_up", lambda i: tile(b, "f", c, b + 1, "m", i)),
        tiles("f_up", lambda j: tile(b, "f", c, b + 1, "f", j)),
        tiles("m_down", lambda i: tile(b - 1, "m", i, b, "f", c)),
        tiles("f_down", lambda j: tile(b - 1, "f", j, b, "f", c)),
    )
    return small(rows.where("many IS NULL")).unionByName(cut.select(F.explode(F.when(F.col("of_many"), of_many).otherwise(of_few)).alias("tile"), "node", "label", "n"))


def _items(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(id, items) of the documents in ``wanted`` (id): their sets, packed."""

    def arrays(batches):
        for batch in batches:
            for ids, sets in _sets(batch, words):
                yield pa.RecordBatch.from_arrays([ids, pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "items"])

    # As a table, its size is known before the join, and texts are only shuffled if it is too large to be sent to them.
    wanted = written(wanted.distinct(), "wanted")
    return written(docs.join(wanted, "id", "left_semi").select("id", "text").mapInArrow(lean(arrays), "id long, items binary"), "sets")


def _links(docs: DataFrame, heads: DataFrame, pairs: DataFrame, words: int, num: int, den: int, bounded: bool) -> DataFrame:
    """Those of the pairs (a, b) that link, by signature bound and then exact intersection."""
    if not bounded:
        for side in ("a", "b"):
            pairs = pairs.join(heads.select(F.col("id").alias(side), F.col("n").alias(f"n{side}"), F.col("bits").alias(f"bits{side}")), side)

        def bound(batches):
            for batch in batches:
                t = pa.Table.from_batches([batch])
                na, nb = t.column("na").to_numpy().astype(np.int64), t.column("nb").to_numpy().astype(np.int64)
                keep = np.zeros(len(na), dtype=bool)
                for k, (x, y) in enumerate(zip(t.column("bitsa").to_pylist(), t.column("bitsb").to_pylist(), strict=True)):
                    p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                    least = min(len(p), len(q))
                    keep[k] = _alike(_overlap_bound(_folded(p, least), _folded(q, least), na[k], nb[k]), na[k], nb[k], num, den)
                out = t.select(["a", "b"]).filter(pa.array(keep))
                yield from out.combine_chunks().to_batches()

        pairs = pairs.select("a", "b", "na", "nb", "bitsa", "bitsb").mapInArrow(lean(bound), "a long, b long").distinct()
    pairs = written(pairs, "pairs")
    if is_empty(pairs):
        return pairs

    items = _items(docs, pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))), words)
    both = pairs.join(items.select(F.col("id").alias("a"), F.col("items").alias("x")), "a").join(items.select(F.col("id").alias("b"), F.col("items").alias("y")), "b")

    def exact(batches):
        for batch in (b.slice(lo, 256) for b in batches for lo in range(0, b.num_rows, 256)):
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                at = np.searchsorted(q, p)
                o = int((q[np.minimum(at, len(q) - 1)] == p).sum()) if len(q) else 0
                keep.append(bool(o) and den * o >= num * (len(p) + len(q) - o))
            t = pa.Table.from_batches([batch]).select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
            yield from t.combine_chunks().to_batches()

    return written(both.select("a", "b", "x", "y").mapInArrow(lean(exact), "a long, b long"), "links")


def _members(rows: DataFrame) -> DataFrame:
    """(id, digest, rep) of rows (id, digest): the smallest id of those with the digest.  Classes of many rows are joined in parts."""
    classes = written(rows.groupBy("digest").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("c")), "classes")
    part = F.pmod(F.xxhash64("id"), F.lit(_PARTS)).cast("int")
    large = classes.where(F.col("c") > HOT_ROWS).select("digest", F.col("rep").alias("large_rep"), F.explode(F.sequence(F.lit(0), F.lit(_PARTS - 1))).alias("part"))
    marked = written(rows.withColumn("part", part).join(large, ["digest", "part"], "left").select("id", "digest", "large_rep"), "marked")
    few = marked.where("large_rep IS NULL").select("id", "digest").join(classes.where(F.col("c") <= HOT_ROWS).select("digest", "rep"), "digest")
    return few.select("id", "digest", "rep").unionByName(marked.where("large_rep IS NOT NULL").select("id", "digest", F.col("large_rep").alias("rep")))


def ngram_jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, num: int = 80, den: int = 100, sample_rows: int = 20_000, tile_rows: int = 2048) -> DataFrame:
    """One row per input row: ``id_col``, n_shingles, component_id.

    Two documents link when ``den`` * |intersection| >= ``num`` * |union| of
    their sets of ``words``-word shingles; component_id is the smallest
    identifier reachable by links, the row's own included.  Texts of fewer words
    are one shingle; null texts and texts without words have none and link with
    nothing.  Rows that repeat an identifier are one document with the links of
    all its rows.  A null identifier takes no part: component_id is null.  An
    empty table gives no rows; other columns are left out and may have any name.
    """
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    heads = written(_heads(docs, words, num, den, *frequent_shingles(docs, words, sample_rows)), "heads")

    full = heads.where("n > 0 AND id IS NOT NULL")
    members = written(_members(full.select("id", "digest")), "members")
    # By row, not by identifier: one that is a copy in a class may stand for another class.
    copies = members.where("id != rep").select("id", "digest").distinct()
    reps = full.join(copies, ["id", "digest"], "left_anti")

    posting = F.concat(F.transform("prefix", lambda k: F.struct(k.alias("key"), F.lit(1).alias("parts"))), F.transform(F.arrays_zip("hot", "parts"), lambda z: F.struct(z["hot"].alias("key"), z["parts"].alias("parts"))))
    posted = reps.select(F.explode(posting).alias("p"), F.col("id").alias("node"), "n").select("p.key", "p.parts", "node", "n")
    posted = posted.withColumn("part", F.when(F.col("parts") > 1, F.pmod(F.xxhash64("node"), F.col("parts"))).otherwise(0).cast("int"))

    def met(df: DataFrame, *by: str) -> DataFrame:
        w = Window.partitionBy(*by).orderBy("n", "node")
        return df.select("*", *[f(c).over(w).alias(f"{name}_{c}") for name, f in (("before", F.lag), ("after", F.lead), ("first", F.first)) for c in (("node", "n") if name != "after" else ("node",))])

    def star(df: DataFrame) -> DataFrame:
        near = F.array(F.struct(F.col("before_node").alias("a"), F.col("before_n").alias("n")), F.struct(F.col("first_node").alias("a"), F.col("first_n").alias("n")))
        pairs = df.where("before_node IS NOT NULL").select("node", F.col("n").alias("nb"), F.explode(near).alias("p"))
        pairs = pairs.where((F.col("p.a") != F.col("node")) & (F.col("p.n") * den >= F.col("nb") * num))
        return pairs.select(F.least("p.a", "node").alias("a"), F.greatest("p.a", "node").alias("b"))

    alone = "before_node IS NULL AND after_node IS NULL AND parts = 1"
    shared = written(met(posted, "key", "part").where(f"NOT ({alone})").select("key", "part", "parts", "node", "n", "before_node", "before_n", "first_node", "first_n"), "shared")
    firsts = met(shared.where("parts > 1 AND before_node IS NULL").select("key", "node", "n"), "key")
    links = _links(docs, full, star(shared).union(star(firsts)).distinct(), words, num, den, False)

    # A document whose rows fall into several classes links those.
    twice = members.groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a != b")
    edges = links.unionByName(members.join(twice.select("id", "a"), "id").select("a", F.col("rep").alias("b")))
    labels = connected_components(edges)

    labelled = shared.join(labels, "node", "left").select("key", "part", "parts", "node", "n", F.coalesce("component", "node").alias("label"))
    # Of three members or fewer that met all pairs have been compared.
    unfinished = labelled.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.max("parts").alias("parts"), F.min("label").alias("x"), F.max("label").alias("y")).where("(c > 3 OR parts > 1) AND x != y")
    unfinished = unfinished.select("key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    open_rows = written(labelled.join(unfinished, ["key", "part"], "left_semi"), "open")
    if not is_empty(open_rows):
        tiles = _tiles(open_rows, tile_rows, num, den).join(reps.select(F.col("id").alias("node"), "n", "bits"), ["node", "n"])
        found = written(_tile_candidates(tiles.repartition("tile").sortWithinPartitions("tile"), num, den), "candidates")
        more = _links(docs, full, found.where("b IS NOT NULL").select("a", "b").distinct(), words, num, den, True)
        dense = found.where("b IS NULL").select("tile", F.col("a").alias("node"))
        if not is_empty(dense):
            items = _items(docs, dense.select(F.col("node").alias("id")), words)
            rows = dense.join(items.withColumnRenamed("id", "node"), "node").join(labels, "node", "left").withColumn("label", F.coalesce("component", "node"))
            more = more.unionByName(written(_dense_links(rows.repartition("tile").sortWithinPartitions("tile"), num, den).distinct(), "dense"))
        if not is_empty(more):
            labels = connected_components(edges.unionByName(more))

    named = members.join(labels.withColumnRenamed("node", "rep"), "rep", "left").groupBy("id").agg(F.min(F.coalesce("component", "rep")).alias("component_id"))
    out = heads.select("id", "n").join(named, "id", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


def op6_banded_bitmap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_components(table(spark, sf_dir, "documents"))


ORACLE = {
    "op6_banded_bitmap_join": r"""
WITH RECURSIVE w AS MATERIALIZED (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS t
  FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(t) = 0 THEN [] WHEN len(t) < 5 THEN [array_to_string(t, ' ')]
    ELSE list_transform(range(1, len(t) - 3), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2] || ' ' || t[i + 3] || ' ' || t[i + 4]) END) AS g
  FROM w),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS MATERIALIZED (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 80 * (x.n + y.n - o)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1) m USING (doc_id)
"""
}
