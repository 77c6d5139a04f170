"""Ids of texts put together from the stretches between their spaces."""

from __future__ import annotations

from collections.abc import Callable
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def slices(column: pa.Array, bounds: np.ndarray) -> list[memoryview]:
    """The bytes of runs of rows of a large_binary array, from row bounds[k] to bounds[k + 1]."""
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[column.offset :][bounds].tolist()
    raw = memoryview(data if data is not None else b"")
    return [raw[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


class StretchCache:
    """Encodes each distinct stretch of a batch once, and keeps short ones for later batches.

    ``encode`` gives the packed ids of a list of stretches.  At most ``keep``
    stretches of at most ``longest`` characters are kept, so memory is bounded;
    those that came first stay, for frequent ones come early.
    """

    def __init__(self, encode: Callable[[list[str]], list[bytes]], keep: int = 300_000, longest: int = 48):
        self.encode, self.keep, self.longest = encode, keep, longest
        self.known: dict[str, bytes] = {}

    def packed(self, texts: list[str]) -> list[bytes]:
        """For each text the ids of its stretches, end to end."""
        if not texts:
            return []
        words = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        coded = words.flatten().dictionary_encode()
        keys = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids = list(map(self.known.get, keys))
        if None in ids:
            new = [k for k, v in enumerate(ids) if v is None]
            for k, v in zip(new, self.encode([keys[k] for k in new]), strict=True):
                ids[k] = v
            short = ((keys[k], ids[k]) for k in new if len(keys[k]) <= self.longest)
            self.known.update(islice(short, max(0, self.keep - len(self.known))))
        column = pa.array(ids, pa.large_binary()).take(coded.indices)
        return list(map(bytes, slices(column, np.asarray(words.offsets))))
