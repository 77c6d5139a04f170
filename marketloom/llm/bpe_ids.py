"""Byte-level BPE ids of whole texts, fast enough for large tables.

Ids come from ``tokenizers`` with the given file as it is.  A byte-level
pre-tokenizer always cuts before a space that stands alone between other
characters, so a text's ids are those of its stretches, laid end to end;
stretches recur, and each is encoded once and kept as packed little-endian
32-bit ids.  Texts with runs of white space where that cutting isn't certain,
and texts that contain one of the file's added tokens, are encoded whole, and
so are all texts if the file is of another kind.
"""

from __future__ import annotations

import json
import re
import sys
from array import array
from functools import cache

import numpy as np

from .stretches import StretchCache

_UNSURE = re.compile(r"\s{3}|\s\s$")
#: A text without any of these has no two white-space characters in a row.
_HINTS = ("  ", "\n\n", " \n", "\n ", *"\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000", *map(chr, range(0x2000, 0x200B)))
#: The stand-in for a space at the beginning of byte-level tokens.
_SPACE = "Ġ"
#: So many new stretches are encoded as one text.
_JOINED = 1000


@cache
def tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _packed(ids: list[int]) -> bytes:
    return array("I", ids).tobytes() if sys.byteorder == "little" else np.asarray(ids, dtype="<u4").tobytes()


class PackedEncoder:
    """text -> bytes of its ids, 4 to an id."""

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        self.by_stretch = spec.get("normalizer") is None and model.get("type") == "BPE" and not model.get("dropout") and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        if self.by_stretch:
            self.opens = np.zeros(max(model["vocab"].values()) + 1, dtype=bool)
            self.opens[[i for t, i in model["vocab"].items() if t.startswith(_SPACE)]] = True
        self.forget()

    def forget(self) -> None:
        """Drop what was kept; workers live on after a job, and others need the memory."""
        self.cache = StretchCache(self._after_space)

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [_packed(e.ids) for e in tokenizer(self.path).encode_batch_fast(texts, add_special_tokens=False)]

    def _after_space(self, stretches: list[str]) -> list[bytes]:
        """Ids of each stretch with a space before it.

        Many go through the library as one text: only a token with a space in
        front begins a stretch, as long as none begins or ends with white space.
        """
        out: list[bytes | None] = [None] * len(stretches)
        plain = [k for k, s in enumerate(stretches) if s and not s[0].isspace() and not s[-1].isspace()]
        parts = [plain[lo : lo + _JOINED] for lo in range(0, len(plain), _JOINED)]
        joined = tokenizer(self.path).encode_batch_fast(["".join(" " + stretches[k] for k in part) for part in parts], add_special_tokens=False)
        for part, e in zip(parts, joined, strict=True):
            ids = np.asarray(e.ids, dtype="<u4")
            at = np.flatnonzero(self.opens[ids])
            if len(at) == len(part):
                raw, ends = ids.tobytes(), [*(at[1:] * 4).tolist(), len(ids) * 4]
                for k, a, b in zip(part, (at * 4).tolist(), ends, strict=True):
                    out[k] = raw[a:b]
        left = [k for k, v in enumerate(out) if v is None]
        for k, v in zip(left, self._whole([" " + stretches[k] for k in left]), strict=True):
            out[k] = v
        return out

    def _sure(self, t: str) -> bool:
        return self.by_stretch and not any(a in t for a in self.added) and not (any(map(t.__contains__, _HINTS)) and _UNSURE.search(t))

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [t.partition(" ") if self._sure(t) else (t, "", "") for t in texts]
        starts = self._whole([c[0] for c in cut])
        more = [k for k, c in enumerate(cut) if c[1]]
        for k, v in zip(more, self.cache.packed([cut[k][2] for k in more]), strict=True):
            starts[k] += v
        return starts


@cache
def encoder(path: str) -> PackedEncoder:
    return PackedEncoder(path)
