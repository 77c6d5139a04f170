"""Vectorised word and shingle hashing over UTF-8 buffers (numpy only).

A batch of texts is laid end to end in one byte buffer.  Words are the maximal
runs of bytes other than 0x20 and 0x09-0x0D, lower-cased for A-Z; in UTF-8 these
bytes never occur inside a longer character, so byte-level cutting is exact.
A word's hash is its polynomial sum over bytes taken from one running sum, then
mixed; a shingle's hash combines the mixed hashes of its words in order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_SEGMENT = 1 << 20

SEPARATORS = np.zeros(256, dtype=bool)
SEPARATORS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint64) + np.uint64(1)
_LOWER[65:91] += np.uint64(32)

_powers: list[np.ndarray] = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B**i and B**-i modulo 2**64 for i < n, kept and grown per worker."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            table = np.full(size, base & _MASK, dtype=np.uint64)
            table[0] = 1
            _powers[k] = np.multiply.accumulate(table)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends) of a string or binary Arrow array; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    off = off.astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    starts, ends = off[:-1], off[1:]
    if column.null_count:
        ends = np.where(np.asarray(column.is_null()), starts, ends)
    return raw, starts, ends


def _segment_words(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word starts, ends and hashes of one stretch of bytes."""
    gap = SEPARATORS[raw]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], gap, [True])).view(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    up, down = _power_tables(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_LOWER[raw] * up[: len(raw)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts]
    return starts, ends, mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))


def word_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of all words, working in stretches that end at a separator."""
    parts, at, n = [], 0, len(raw)
    while at < n:
        end = min(n, at + _SEGMENT)
        if end < n:
            back = np.flatnonzero(SEPARATORS[raw[at:end]])
            if len(back):
                end = at + int(back[-1]) + 1
            else:
                ahead, step = end, _SEGMENT
                while ahead < n and not SEPARATORS[raw[ahead : ahead + step]].any():
                    ahead += step
                end = n if ahead >= n else ahead + int(np.flatnonzero(SEPARATORS[raw[ahead : ahead + step]])[0]) + 1
        s, e, h = _segment_words(raw[at:end])
        parts.append((s + at, e + at, h))
        at = end
    if not parts:
        z = np.zeros(0, dtype=np.int64)
        return z, z, np.zeros(0, dtype=np.uint64)
    return tuple(np.concatenate(x) for x in zip(*parts))  # type: ignore[return-value]


def spaced(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows' bytes with one space after each row, and where each row begins."""
    sizes = ends - starts
    begin = np.concatenate(([0], np.cumsum(sizes + 1)))
    out = np.full(int(begin[-1]), 0x20, dtype=np.uint8)
    for k in range(len(starts)):
        out[begin[k] : begin[k] + sizes[k]] = raw[starts[k] : ends[k]]
    return out, begin


_ORDER = [0x8CB92BA72F3D8DD7, 0xAAAAAAAAAAAAAAAB, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53]


def shingle_sets(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, words: int = 5) -> list[np.ndarray]:
    """For each row the sorted distinct 64-bit hashes of its shingles.

    A row of fewer words than ``words`` (but at least one) has its whole
    sequence as its one shingle; a row without words has the empty set.
    """
    buf, begin = spaced(raw, starts, ends)
    at, _, h = word_hashes(buf)
    bound = np.searchsorted(at, begin)
    keys = [np.uint64(_ORDER[j % 8] ^ (j // 8)) for j in range(words)]
    n = len(h)
    if n >= words:
        acc = h[: n - words + 1] * keys[0]
        for j in range(1, words):
            acc += h[j : n - words + 1 + j] * keys[j]
        rolled = mix(acc + np.uint64(words))
    out = []
    for k in range(len(starts)):
        lo, hi = int(bound[k]), int(bound[k + 1])
        if hi - lo >= words:
            s = np.sort(rolled[lo : hi - words + 1])
            keep = np.ones(len(s), dtype=bool)
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            out.append(s[keep])
        elif hi > lo:
            total = np.uint64(hi - lo)
            for j in range(hi - lo):
                total = total + h[lo + j : lo + j + 1] * keys[j]
            out.append(mix(np.atleast_1d(total)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out
