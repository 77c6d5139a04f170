"""Frequent word sequences and how strongly they stick together.

Sizes are counted one after the other.  A task lays some texts end to end, hashes
words by a prefix polynomial over bytes and n-grams by one over word hashes
(Rabin-Karp fingerprints), counts their n-grams, and sends of each its
fingerprint, a second one of 32 bits, count and a pointer to one occurrence,
packed by parts of the fingerprints' range.  In a slice words are told apart by
their bytes and n-grams by their words, so a count never mixes two phrases.  The
shuffle adds up counts by both fingerprints; of the frequent ones a pointer is
followed into the text, and what stands there is the phrase.  Two phrases of one
fingerprint are told apart by the second one and verified by their texts, and
only frequent phrases are ever text.

A phrase of s words can only be frequent if both of its parts of s - 1 words
are.  Fingerprints of the size before set bits in a bitmap of fixed size, and
n-grams with a part whose bit isn't set are left out where they are read; a
full bitmap lets more through and changes no result.

Fingerprints are of (language, words), so one frequent word is sent once a slice (3 MB of text).
"""

from __future__ import annotations

import hashlib
import re
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lean, only_results, table, written
from .textkernels import _power_tables, mix, text_buffer, word_hashes

#: Bits of the map of frequent fingerprints: 8 MB.
BITS = 26
#: Bytes of text that a task counts at a time.
SLICE_BYTES = 3 << 20

#: Bytes of text whose n-grams one part holds.
PART_BYTES = 4 << 20
#: Bytes of rows that go to a Python worker at a time.
_BATCH_BYTES = 8 << 20

#: Tasks that a language's phrases are dealt to before they are ranked.
_DEAL = 64

_BREAK, _GAP = b".,;:!?\x0a\x0b\x0c\x0d", b" \x09"
_FORM = np.arange(256, dtype=np.uint8)
_FORM[65:91] += 32
_FORM[list(_BREAK)] = 0x0A
_FORM[list(_GAP)] = 0x20  # bytes above 127 are parts of letters
_WORD = re.compile(b"[^ \x09.,;:!?\x0a-\x0d]+")
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def laid_out(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All texts in lower case with a break after each, gaps and breaks as one byte value each; and where each text begins."""
    begin = np.concatenate(([0], np.cumsum(ends - starts + 1)))
    out = np.full(int(begin[-1]), 0x0A, dtype=np.uint8)
    for k in range(len(starts)):
        out[begin[k] : begin[k + 1] - 1] = _FORM[raw[starts[k] : ends[k]]]
    return out, begin


def _same_bytes(buf: np.ndarray, a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether the ``sizes`` bytes at a and at b are the same, eight at a time; ``buf`` has eight bytes more than needed."""
    eight = np.ndarray(len(buf) - 7, dtype="<u8", buffer=buf, strides=(1,))
    same = np.ones(len(a), dtype=bool)
    for at in range(0, int(sizes.max(initial=0)), 8):
        left = np.flatnonzero(same & (sizes > at))
        rest = np.minimum(sizes[left] - at, 8).astype(np.uint64)
        differ = eight[a[left] + at] ^ eight[b[left] + at]
        same[left] = (differ << (np.uint64(64) - rest * np.uint64(8))) == 0
    return same


def word_ids(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Numbers of words: equal exactly where bytes and kinds are, whatever the hashes."""
    padded = np.concatenate((buf, np.zeros(8, dtype=np.uint8)))
    ids = np.zeros(len(starts), dtype=np.int64)
    todo, made = np.arange(len(starts)), 0
    while len(todo):
        _, first, of = np.unique(hashes[todo] ^ kinds[todo], return_index=True, return_inverse=True)
        head = todo[first[of]]
        sizes = ends[todo] - starts[todo]
        same = (kinds[todo] == kinds[head]) & (sizes == ends[head] - starts[head]) & _same_bytes(padded, starts[todo], starts[head], np.minimum(sizes, ends[head] - starts[head]))
        ids[todo[same]] = of[same] + made
        made += len(first)
        todo = todo[~same]
    return ids


def fingerprints(hashes: np.ndarray, at: np.ndarray, size: int, seed: np.ndarray, base: int = 1) -> np.ndarray:
    """Of the ``size`` words from each place in ``at``, under that place's ``seed``: a polynomial in the ``base``-th power."""
    total = np.zeros(len(at), dtype=np.uint64)
    power, _ = _power_tables(base * size + 1)
    for k in range(size):
        total += hashes[at + k] * power[base * (k + 1)]
    return mix(mix(total + np.uint64(size)) ^ seed)


def _known(marks: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    low = marks & np.uint64(8 * len(bitmap) - 1)
    return (bitmap[(low >> np.uint64(3)).astype(np.int64)] >> (low & np.uint64(7)).astype(np.uint8)) & 1 > 0


def counted(buf: np.ndarray, begin: np.ndarray, seeds: np.ndarray, size: int, bitmap: np.ndarray | None) -> tuple[np.ndarray, ...]:
    """(fingerprint, second fingerprint, count, text, byte) of every n-gram of ``size`` words whose parts are in ``bitmap`` (of the size before; None lets all through)."""
    starts, ends, hashes = word_hashes(buf)
    text = np.searchsorted(begin, starts, "right") - 1
    at = np.arange(max(0, len(starts) - size + 1))
    if size > 1:
        piece = np.cumsum(np.bincount(np.searchsorted(starts, np.flatnonzero(buf == 0x0A)), minlength=len(starts) + 1))[: len(starts)]
        at = at[piece[at] == piece[at + size - 1]]
        if bitmap is not None:
            part = np.unique(np.concatenate((at, at + 1)))
            known = np.zeros(len(starts), dtype=bool)
            known[part] = _known(fingerprints(hashes, part, size - 1, seeds[text[part]]), bitmap)
            at = at[known[at] & known[at + 1]]
    if not len(at):
        return (*[np.zeros(0, dtype=np.uint64)] * 2, *[np.zeros(0, dtype=np.int64)] * 3)
    words = np.unique(np.concatenate([at + k for k in range(size)])) if size > 1 else at
    # Words of two languages have two numbers, so phrases have, too.
    ids = np.zeros(len(starts), dtype=np.int64)
    ids[words] = word_ids(buf, starts[words], ends[words], hashes[words], seeds[text[words]])
    many, key = int(ids.max()) + 1, ids[at]
    for k in range(1, size):
        key = np.unique(key, return_inverse=True)[1] * many + ids[at + k]
    _, first, times = np.unique(key, return_index=True, return_counts=True)
    head = at[first]
    mark, check = (fingerprints(hashes, head, size, seeds[text[head]], base) for base in (1, 3))
    return mark, check, times, text[head], starts[head] - begin[text[head]]


def _slices(column: pa.Array, most: int):
    """(from, to) rows of about ``most`` bytes of text."""
    _, starts, ends = text_buffer(column)
    total, lo = 0, 0
    for k, n in enumerate((ends - starts).tolist()):
        total += n
        if total >= most:
            yield lo, k + 1
            total, lo = 0, k + 1
    if lo < len(column):
        yield lo, len(column)


def _counts(docs: DataFrame, size: int, bitmap: np.ndarray | None, parts: int, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """The n-grams of each slice of a batch, packed in a row for each of ``parts`` by fingerprint: marks, checks, times, who (place in doc and code) and at (byte)."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches):
        for batch in (b.slice(lo, hi - lo) for b in batches for lo, hi in _slices(b.column(3), slice_bytes)):
            langs = batch.column(2).dictionary_encode()
            seed = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in langs.dictionary.to_pylist()], dtype=np.uint64)
            buf, begin = laid_out(*text_buffer(batch.column(3)))
            mark, check, times, text, at = counted(buf, begin, seed[langs.indices.to_numpy()], size, shared.value)
            if not len(mark):
                continue
            part = ((mark >> np.uint64(24)) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            cuts = np.flatnonzero(np.diff(part[order])) + 1
            doc, code = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            rows = []
            for mine in np.split(order, cuts):
                docs_, who = np.unique(text[mine], return_inverse=True)
                rows.append((int(part[mine[0]]), mark[mine].tobytes(), check[mine].astype(np.uint32).tobytes(), times[mine].astype(np.uint32).tobytes(), who.astype(np.uint32).tobytes(), at[mine].astype(np.uint32).tobytes(), doc[docs_].tobytes(), code[docs_].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if k == 0 else pa.binary()) for k, c in enumerate(zip(*rows, strict=True))], names=["part", "marks", "checks", "times", "who", "at", "doc", "code"])

    return docs.select("doc", "code", "lang", "text").mapInArrow(lean(run), "part int, marks binary, checks binary, times binary, who binary, at binary, doc binary, code binary")


def _frequent(packed: DataFrame, least: int) -> DataFrame:
    """(mark, times, doc, code, at): fingerprints (both) whose counts reach ``least`` together, with a pointer to one occurrence.

    A task adds up one part at a time, which holds about as many n-grams as 4 MB of text have.
    """

    def run(batches):
        here, held = None, []

        def added():
            mark, check, times, doc, code, at = (np.concatenate(c) for c in zip(*held, strict=True))
            order = np.lexsort((check, mark))
            m, c = mark[order], check[order]
            first = np.flatnonzero(np.concatenate(([True], (m[1:] != m[:-1]) | (c[1:] != c[:-1]))))
            total = np.add.reduceat(times[order], first)
            fine = total >= least
            keep = order[first[fine]]
            if len(keep):
                yield pa.RecordBatch.from_arrays([pa.array(mark[keep].view(np.int64)), pa.array(total[fine]), *[pa.array(x[keep]) for x in (doc, code, at)]], names=["mark", "times", "doc", "code", "at"])

        for batch in batches:
            for k in range(batch.num_rows):
                part, raw = batch.column(0)[k].as_py(), [batch.column(c)[k].as_buffer() for c in range(1, 8)]
                if part != here and held:
                    yield from added()
                    held = []
                here = part
                mark, check, times, who, at, doc, code = (np.frombuffer(x, t) for x, t in zip(raw, (np.uint64, np.uint32, np.uint32, np.uint32, np.uint32, np.int64, np.int64), strict=True))
                held.append((mark, check, times.astype(np.int64), doc[who], code[who], at.astype(np.int64)))
        if held:
            yield from added()

    return packed.repartition("part").sortWithinPartitions("part").mapInArrow(lean(run), "mark long, times long, doc long, code long, at long")


def _bitmap(frequent: DataFrame, bits: int) -> np.ndarray:
    """Bits of the fingerprints' low ends: 2**bits of them reach the driver, 4 KB a row, whatever the table's size."""
    at = F.col("mark").bitwiseAND((1 << bits) - 1) + 1
    rows = frequent.select(F.bitmap_bucket_number(at).alias("bucket"), F.bitmap_bit_position(at).alias("bit")).groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("set")).collect()
    out = np.zeros(max(1 << bits, 1 << 15) // 8, dtype=np.uint8)
    for r in rows:
        out[(r["bucket"] - 1) << 12 : r["bucket"] << 12] = np.frombuffer(r["set"], dtype=np.uint8)
    return out[: (1 << bits) // 8]


def _texts(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """(lang, size, phrase, times): pointers followed into the texts, counts added up by what stands there."""
    lists = marks.groupBy("doc", "code").agg(F.collect_list(F.struct("at", "size", "times")).alias("found"))
    once = docs.dropDuplicates(["doc", "code"])
    met = once.join(lists, ["doc", "code"]).select("lang", F.col("text").cast("binary").alias("body"), "found")

    def run(batches):
        for batch in batches:
            row, size, phrase, times = [], [], [], []
            for k in range(batch.num_rows):
                body, found = batch.column(1)[k].as_py(), batch.column(2)[k].values
                for at, n, t in zip(*(found.field(c).to_pylist() for c in ("at", "size", "times")), strict=True):
                    words, stop = [], at
                    while len(words) < n:
                        m = _WORD.search(body, stop)
                        words.append(m[0])
                        stop = m.end()
                    row.append(k)
                    size.append(n)
                    phrase.append(b" ".join(words).translate(_LOWER))
                    times.append(t)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(size, pa.int32()), pa.array(phrase, pa.binary()).cast(pa.string()), pa.array(times, pa.int64())], names=["lang", "size", "phrase", "times"])

    told = met.mapInArrow(lean(run), "lang string, size int, phrase string, times long")
    return told.groupBy("lang", "size", "phrase").agg(F.sum("times").alias("times"))


@contextmanager
def _small_batches(spark: SparkSession):
    """At most 1000 rows and 8 MB in an Arrow batch, so that long texts and packed rows take less memory; the jobs inside are done when it ends."""
    name, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    before, large = spark.conf.get(name), spark.conf.get(size, None)
    spark.conf.set(name, str(min(int(before), 1000) if int(before) > 0 else 1000))
    spark.conf.set(size, str(_BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(name, before)
        spark.conf.unset(size) if large is None else spark.conf.set(size, large)


def frequent_phrases(df: DataFrame, longest: int = 3, least: int = 10, text_col: str = "text", lang_col: str = "lang", bits: int = BITS, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """(lang, size, phrase, times) of all phrases of up to ``longest`` words that occur at least ``least`` times in texts of a language.

    Texts are lower-cased (A to Z) and cut at ``[.,;:!?\\x0A-\\x0D]``; a phrase
    lies within a piece, and its words are joined by one space.  Null texts are
    empty, null languages are ``und``; repeated rows count each.  Other columns
    don't take part and may have any names.  An empty table gives no rows.
    """
    if longest < 1 or least < 1:
        raise ValueError("longest and least are 1 at least")
    docs = df.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # Rows of one language and text are alike; 96 bits tell others apart.
    docs = docs.withColumns({"doc": F.xxhash64("lang", "text"), "code": F.crc32("text")})
    with only_results(df.sparkSession) as keep, _small_batches(df.sparkSession):
        sizes, bitmap = [], None
        parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // PART_BYTES)
        for size in range(1, longest + 1):
            marks = written(_frequent(_counts(docs, size, bitmap, parts, slice_bytes), least), f"marks-{size}")
            sizes.append(marks.withColumn("size", F.lit(size)))
            if size < longest:
                bitmap = _bitmap(marks, bits)
        marks = sizes[0]
        for more in sizes[1:]:
            marks = marks.unionByName(more)
        # Rows of one text give one pointer each time.
        pointers = marks.groupBy("doc", "code", "at", "size").agg(F.sum("times").alias("times"))
        out = written(_texts(docs, pointers).where(F.col("times") >= least), "phrases")
        keep.append(out)
    return out


def word_totals(df: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, n): word occurrences of each language."""
    words = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(r"[^ \t.,;:!?\n\x0B\f\r]+"))
    return df.groupBy(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang")).agg(F.sum(words.cast("long")).alias("n"))


def exact_score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a a / (left right)) for counts below 10**15; the products are decimals of up to 38 digits."""
    big = lambda c: c.cast("decimal(15,0)")
    return F.call_function("div", (big(a) * big(a)) * F.lit(1000000).cast("decimal(7,0)"), big(left) * big(right))


def collocations(df: DataFrame, longest: int = 3, least: int = 10, share: int = 50, first: int = 2000, text_col: str = "text", lang_col: str = "lang", bits: int = BITS, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Each language's ``first`` phrases of 2 to ``longest`` words: lang, rank, phrase, a, l, r, n, score.

    Of a phrase that occurs ``a`` times, every cut after its first k words gives
    floor(1000000 a a / (l r)) with l and r occurrences of both parts; the
    lowest counts, ties to the smallest k.  A phrase goes if a longer one of at
    least ``share`` percent of its occurrences contains it.  Arithmetic is in
    decimals, so no product overflows.  ``bits`` (6 at least) and ``slice_bytes``
    size the bitmap and what a task counts at a time; they change no result.  Rows are as for ``frequent_phrases``; a
    language without phrases has no rows.
    """
    found = frequent_phrases(df, longest, least, text_col, lang_col, bits, slice_bytes)
    known = found.select("lang", "phrase", F.col("times").alias("a"), "size")
    cuts = known.where("size > 1").withColumn("words", F.split("phrase", " ")).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    part = lambda words: F.concat_ws(" ", words)
    cuts = cuts.withColumns({"left": part(F.slice("words", 1, F.col("k"))), "right": part(F.slice("words", F.col("k") + 1, F.col("size") - F.col("k")))})
    times = lambda name, into: known.select(F.col("lang"), F.col("phrase").alias(name), F.col("a").alias(into))
    scored = cuts.join(times("left", "l"), ["lang", "left"]).join(times("right", "r"), ["lang", "right"])
    scored = scored.withColumn("score", exact_score(F.col("a"), F.col("l"), F.col("r")))
    best = scored.groupBy("lang", "phrase", "a", "size").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    inside = known.where("size > 2").withColumn("words", F.split("phrase", " "))
    pairs = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("size") - n + 1), lambda at: part(F.slice("words", at, n)))))
    covers = inside.select("lang", F.explode(pairs).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = best.join(covers, ["lang", "phrase"], "left").where(F.coalesce(F.col("longer"), F.lit(0)) * 100 < F.col("a") * share)

    # A language's phrases are dealt to tasks, of which each passes on its own first ones.
    best_first = (F.col("cut.score").desc(), F.col("a").desc(), "phrase")
    place = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*best_first))
    dealt = kept.withColumn("deal", F.pmod(F.xxhash64("phrase"), F.lit(_DEAL)).cast("int"))
    ranked = dealt.withColumn("place", place("lang", "deal")).where(F.col("place") <= first).withColumn("rank", place("lang")).where(F.col("rank") <= first)
    return ranked.join(word_totals(df, text_col, lang_col), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", F.col("cut.score").alias("score"))


def op12_fingerprinted_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


ORACLE = {
    "op12_fingerprinted_collocations": r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces),
grams AS (
  SELECT lang, 1 AS size, unnest(w) AS phrase FROM words
  UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM words
  UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM words),
f AS (SELECT lang, size, phrase, count(*) AS a FROM grams GROUP BY ALL),
n AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE size = 1 GROUP BY lang),
c AS (SELECT lang, phrase, a, size, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND a >= 10),
cuts AS (SELECT *, array_to_string(w[1:k], ' ') AS x, array_to_string(w[k + 1:size], ' ') AS y FROM (SELECT *, unnest(range(1, size)) AS k FROM c)),
scored AS (
  SELECT cuts.lang, cuts.phrase, cuts.a, k, fx.a AS l, fy.a AS r,
         CAST(CAST(1000000 AS HUGEINT) * cuts.a * cuts.a // (CAST(fx.a AS HUGEINT) * fy.a) AS BIGINT) AS score
  FROM cuts JOIN f fx ON fx.lang = cuts.lang AND fx.phrase = x JOIN f fy ON fy.lang = cuts.lang AND fy.phrase = y),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (
  SELECT lang, phrase, max(a) AS a FROM (
    SELECT lang, w[1] || ' ' || w[2] AS phrase, a FROM c WHERE size = 3 UNION ALL SELECT lang, w[2] || ' ' || w[3], a FROM c WHERE size = 3) GROUP BY ALL),
kept AS (SELECT best.* FROM best LEFT JOIN longer USING (lang, phrase) WHERE coalesce(longer.a, 0) * 100 < best.a * 50),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""
}
