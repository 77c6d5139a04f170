"""SentencePiece encoding and decoding on the tokenizers library.

The model protobuf is read field by field; its normaliser, metaspace marker,
scores and byte fallback are rebuilt as a ``tokenizers`` pipeline.  Unigram
models keep their scores; for BPE models the merges are those pairs of pieces
that make a piece, in the order of its score.  Batches are encoded with the
library's threads, and every row can be compared with the original library.
"""

from __future__ import annotations

import os
import struct
import zlib
from array import array
from dataclasses import dataclass, field
from functools import cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .stretches import StretchCache, slices

# The format's numbers of model and piece types.
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
SPACE = "▁"


def _fields(data: bytes):
    """(number, value) of a protobuf message: int, or bytes for longer ones."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 0x7F) << shift
            if b < 0x80:
                return out
            shift += 7

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            value: int | bytes = varint()
        elif kind == 2:
            n = varint()
            value, at = data[at : at + n], at + n
        elif kind in (1, 5):
            n = 8 if kind == 1 else 4
            value, at = data[at : at + n], at + n
        else:
            raise ValueError(f"wire type {kind} isn't part of the format")
        yield tag >> 3, value


@dataclass
class Model:
    """What a model file says, with the format's defaults."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    add_dummy_prefix: bool = True
    remove_extra_whitespaces: bool = True
    escape_whitespaces: bool = True
    space_as_suffix: bool = False

    @property
    def unknown(self) -> int:
        return next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)


def parse_model(data: bytes) -> Model:
    m = Model()
    for number, value in _fields(data):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for n, v in _fields(value):
                if n == 1:
                    piece = v.decode()
                elif n == 2:
                    score = struct.unpack("<f", v)[0]
                elif n == 3:
                    kind = v
            m.pieces.append((piece, score, kind))
        elif number == 2:
            for n, v in _fields(value):
                if n == 3:
                    m.kind = v
                elif n == 24:
                    m.space_as_suffix = bool(v)
                elif n == 35:
                    m.byte_fallback = bool(v)
        elif number == 3:
            for n, v in _fields(value):
                if n == 2:
                    m.charsmap = v
                elif n in (3, 4, 5):
                    setattr(m, {3: "add_dummy_prefix", 4: "remove_extra_whitespaces", 5: "escape_whitespaces"}[n], bool(v))
    if m.kind not in (UNIGRAM, BPE):
        raise ValueError("only unigram and BPE models are rebuilt")
    if m.space_as_suffix or not m.escape_whitespaces:
        raise ValueError("models with suffix or unescaped spaces aren't rebuilt")
    return m


def _merges(m: Model) -> list[tuple[str, str]]:
    """Pairs of pieces that join to a piece, best score first, then by the cut's place."""
    usable = {p: s for p, s, kind in m.pieces if kind in (NORMAL, USER_DEFINED)}
    found = []
    for i, (p, s, kind) in enumerate(m.pieces):
        if kind in (NORMAL, USER_DEFINED) and len(p) > 1:
            found += [(-s, i, k, p[:k], p[k:]) for k in range(1, len(p)) if p[:k] in usable and p[k:] in usable]
    return [(a, b) for *_, a, b in sorted(found)]


def separable(m: Model) -> bool:
    """Whether no piece has a space marker behind another character, so words never merge."""
    return not m.charsmap and not any(SPACE in p.lstrip(SPACE) for p, _, kind in m.pieces if kind in (NORMAL, USER_DEFINED))


def build_tokenizer(m: Model):
    """A ``tokenizers.Tokenizer`` with the model's ids."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    names = [p for p, _, _ in m.pieces]
    if m.kind == UNIGRAM:
        low = min((s for _, s, kind in m.pieces if kind == NORMAL), default=0.0)
        # what text can't contain scores so low that it is never chosen
        scored = [(p, s if kind in (NORMAL, USER_DEFINED) else low - 1e6) for p, s, kind in m.pieces]
        t = Tokenizer(models.Unigram(scored, unk_id=m.unknown, byte_fallback=m.byte_fallback))
    else:
        t = Tokenizer(models.BPE({p: i for i, p in enumerate(names)}, _merges(m), unk_token=names[m.unknown], fuse_unk=True, byte_fallback=m.byte_fallback))
    steps = [normalizers.Precompiled(m.charsmap)] if m.charsmap else []
    if m.remove_extra_whitespaces:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if m.add_dummy_prefix:
        steps.append(normalizers.Prepend(" "))
    steps.append(normalizers.Replace(" ", SPACE))
    t.normalizer = normalizers.Sequence(steps)
    if m.kind == BPE and separable(m):
        t.pre_tokenizer = pre_tokenizers.Split(Regex(f"{SPACE}*[^{SPACE}]+|{SPACE}+"), "isolated")
    own = [AddedToken(p, normalized=False, special=False) for p, _, kind in m.pieces if kind == USER_DEFINED]
    if own:
        t.add_tokens(own)
    end = [decoders.Strip(" ", 1, 0)] if m.add_dummy_prefix else []
    t.decoder = decoders.Sequence([decoders.Replace(SPACE, " "), decoders.ByteFallback(), decoders.Fuse(), *end])
    return t


class Codec:
    """Encodes and decodes batches with the library's threads; kept by each worker."""

    def __init__(self, data: bytes, threads: int = 2):
        from tokenizers import Tokenizer, decoders, models

        m = self.model = parse_model(data)
        self.threads = threads
        self.tokenizer = build_tokenizer(m)
        self.by_word = separable(m) and not m.remove_extra_whitespaces and m.add_dummy_prefix
        ids = {p: i for i, (p, _, _) in enumerate(m.pieces)}
        plain = m.kind == BPE and not any(kind == USER_DEFINED for *_, kind in m.pieces)
        #: The id of a space as a byte, which no word's ids have; it ends words that are encoded many at once.
        self.end_id = ids.get("<0x20>") if plain and m.byte_fallback and not any(" " in p for p in ids) else None
        if self.end_id is not None:
            self.bare = Tokenizer(models.BPE(ids, _merges(m), unk_token=m.pieces[m.unknown][0], fuse_unk=True, byte_fallback=True, cache_capacity=0))
            self.bare.decoder = decoders.Sequence([decoders.Replace(SPACE, " "), decoders.ByteFallback(), decoders.Fuse()])
        self.cache = StretchCache(self._words)
        self.decoded: dict[bytes, bytes] = {}
        self.spaces = np.array([p.count(SPACE) + p.count(" ") + (p == "<0x20>") for p, *_ in m.pieces], dtype=np.int64)
        self.opens = np.array([p.startswith(SPACE) for p, *_ in m.pieces], dtype=bool)
        self.silent = np.array([kind if kind in (CONTROL, UNKNOWN) else 0 for *_, kind in m.pieces], dtype=np.int8)

    def _packed(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of each word with its marker."""
        if self.end_id is None:
            return self._packed(words)
        step = max(1, -(-len(words) // self.threads))
        parts = [words[lo : lo + step] for lo in range(0, len(words), step)]
        out: list[bytes] = []
        for part, e in zip(parts, self.bare.encode_batch_fast([[f"{SPACE}{w} " for w in part] for part in parts], is_pretokenized=True, add_special_tokens=False), strict=True):
            ids = np.asarray(e.ids, dtype="<u4")
            ends = np.flatnonzero(ids == self.end_id)
            if len(ends) != len(part):
                raise ValueError("a word has the space byte among its ids")
            raw = ids.tobytes()
            out += [raw[a:b] for a, b in zip([0, *(ends[:-1] * 4 + 4).tolist()], (ends * 4).tolist(), strict=True)]
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed little-endian 32-bit ids.

        Where words never merge, each distinct word is encoded once and kept;
        texts with runs of spaces or markers of their own are encoded whole.
        """
        whole = [not self.by_word or not t or "  " in t or SPACE in t or t[0] == " " or t[-1] == " " for t in texts]
        made = [iter(f([t for t, w in zip(texts, whole, strict=True) if w == k])) for k, f in ((False, self.cache.packed), (True, self._packed))]
        return [next(made[w]) for w in whole]

    def decode(self, packed: list[bytes]) -> list[str]:
        """Texts of packed ids; bytes that are no UTF-8 become replacement characters.

        Control pieces are left out and unknown ones shown as the original does:
        a text with unknown pieces is decoded in stretches between them.
        """
        runs, owner, odd = [], [], False
        for k, p in enumerate(packed):
            ids = np.frombuffer(p, dtype="<u4")
            kind = self.silent[ids]
            if kind.any():
                odd, ids = True, ids[kind != CONTROL]
                cut = np.flatnonzero(ids == self.model.unknown)
                runs += [x.tolist() for x in np.split(np.delete(ids, cut), cut - np.arange(len(cut)))]
                owner += [k] * (len(cut) + 1)
            else:
                runs.append(ids.tolist() if odd or self.end_id is None else ids)
                owner.append(k)
        if not odd and self.end_id is not None and self.by_word:
            return self._by_word(packed)
        texts = self.tokenizer.decode_batch([list(map(int, r)) for r in runs], skip_special_tokens=False)
        out: list[str | None] = [None] * len(packed)
        strip = self.model.add_dummy_prefix
        for k, r, t in zip(owner, runs, texts, strict=True):
            if out[k] is None:
                out[k] = t
            else:  # only the beginning of a text loses its space
                out[k] += " \u2047 " + (" " * (strip and self.model.pieces[r[0]][0].startswith(SPACE)) if r else "") + t
        return out

    def _new_texts(self, words: list[bytes]) -> list[bytes]:
        """The text of each word's ids.  Words with one space, in front, are decoded many at once and cut apart at it."""
        ids = np.frombuffer(b"".join(words), dtype="<u4")
        starts = np.concatenate(([0], np.cumsum([len(w) // 4 for w in words])))
        plain = np.add.reduceat(self.spaces[ids], starts[:-1]) == 1
        plain &= self.opens[ids[starts[:-1]]]
        out: list[bytes | None] = [None] * len(words)
        at = np.flatnonzero(plain).tolist()
        parts = [at[lo : lo + 2000] for lo in range(0, len(at), 2000)]
        joined = self.bare.decode_batch([np.frombuffer(b"".join(words[k] for k in part), dtype="<u4").tolist() for part in parts], skip_special_tokens=False)
        for part, t in zip(parts, joined, strict=True):
            _, *found = t.encode().split(b" ")
            if len(found) == len(part):
                for k, w in zip(part, found, strict=True):
                    out[k] = b" " + w
        left = [k for k, t in enumerate(out) if t is None]
        for k, t in zip(left, self.bare.decode_batch([np.frombuffer(words[k], dtype="<u4").tolist() for k in left], skip_special_tokens=False), strict=True):
            out[k] = t.encode()
        return out

    def _by_word(self, packed: list[bytes]) -> list[str]:
        """Texts of ids without silent ones: each distinct word's ids (from one marker to the next) are decoded once and kept."""
        raw = b"".join(packed)
        ids = np.frombuffer(raw, dtype="<u4")
        bounds = np.concatenate(([0], np.cumsum([len(p) // 4 for p in packed]))).astype(np.int64)
        opens = np.append(self.opens[ids], True)
        opens[bounds] = True
        at = np.flatnonzero(opens)
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer((at * 4).astype(np.int64)), pa.py_buffer(raw)]).dictionary_encode()
        keys = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        texts = list(map(self.decoded.get, keys))
        if None in texts:
            new = [k for k, t in enumerate(texts) if t is None]
            for k, t in zip(new, self._new_texts([keys[k] for k in new]), strict=True):
                texts[k] = t
            short = ((keys[k], texts[k]) for k in new if len(keys[k]) <= 4 * self.cache.longest)
            self.decoded.update(islice(short, max(0, self.cache.keep - len(self.decoded))))
        column = pa.array(texts, pa.large_binary()).take(words.indices)
        return [str(t, "utf-8").removeprefix(" ") for t in slices(column, np.searchsorted(at, bounds))]


@cache
def codec(path: str) -> Codec:
    with open(path, "rb") as f:
        return Codec(f.read())


@cache
def _original(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


_CHUNK_CHARS = 1 << 22


def encoded(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", parity: bool = True, threads: int = 2, ids: bool = True) -> DataFrame:
    """Each row's ids: ``id_col``, n_tokens, ids_crc32, round_trip, parity and (unless left out) ids.

    round_trip says that decoding gives the text back (as the model's normaliser
    leaves it: compared where that changes nothing).  parity says that the
    original library gives the same ids, null if not asked.  Null texts have no
    ids and are their own round trip.  The file at ``model_path`` is read by
    every worker.  Repeated rows and null identifiers are rows like others; an
    empty table gives no rows.
    """
    kinds = "i long, n_tokens int, ids_crc32 long, round_trip boolean, parity boolean" + ", ids array<int>" * ids

    def run(batches):
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        c = codec(model_path)

        def rows(keys: list, texts: list[str]):
            packed = c.encode(texts)
            back = c.decode(packed)
            plain = not c.model.charsmap and not c.model.remove_extra_whitespaces
            fine = [t == b if plain else t.split() == b.split() for t, b in zip(texts, back, strict=True)]
            same = [None] * len(texts)
            if parity:
                same = [array("I", x).tobytes() == p for x, p in zip(_original(model_path).encode(texts, num_threads=1), packed, strict=True)]
            cols = [pa.array(keys, pa.int64()), pa.array([len(p) // 4 for p in packed], pa.int32()), pa.array([zlib.crc32(p) for p in packed], pa.int64()), pa.array(fine, pa.bool_()), pa.array(same, pa.bool_())]
            names = ["i", "n_tokens", "ids_crc32", "round_trip", "parity"]
            if ids:
                cols.append(pa.array([np.frombuffer(p, dtype="<i4") for p in packed], pa.list_(pa.int32())))
                names.append("ids")
            return pa.RecordBatch.from_arrays(cols, names=names)

        for batch in batches:
            keys, texts, size = [], [], 0
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                keys.append(k)
                texts.append(t.as_py() or "")
                size += len(texts[-1])
                if size >= _CHUNK_CHARS:
                    yield rows(keys, texts)
                    keys, texts, size = [], [], 0
            if keys:
                yield rows(keys, texts)

    read = df.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t"))
    return read.mapInArrow(run, kinds).withColumnRenamed("i", id_col)


def decoded(df: DataFrame, model_path: str, ids_col: str = "ids", into: str = "text") -> DataFrame:
    """``df`` with the text of each row's ids in ``into``; null ids give null."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def text(ids):
        c = codec(model_path)
        return ids.map(lambda x: None if x is None else c.decode([np.asarray(x, dtype="<u4").tobytes()])[0])

    return df.withColumn(into, text(F.col(ids_col)))


def op1_rebuilt_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encoded(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), ids=False)


ORACLE: dict[str, str] = {}
