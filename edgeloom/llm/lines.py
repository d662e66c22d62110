"""Lines of texts as arrays: places, words and hashes, for the operators that work on lines."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash

from .common import codes, sums, text_bytes

#: ASCII white space, which parts words, and the fold of letters in normalised lines (fixed values).
SPACE_BYTES = b" \t\n\x0b\x0c\r"
FOLD = {a: a + 32 for a in range(ord("A"), ord("Z") + 1)}
_space = np.zeros(256, bool)
_space[list(SPACE_BYTES)] = True
_split = re.compile("[ \t\n\x0b\x0c\r]+")


def normalised(line: str) -> str:
    """A-Z folded, runs of ASCII white space as one space, none at the ends."""
    return " ".join(x for x in _split.split(line.translate(FOLD)) if x)


def digest(line: str, seed: int = 0) -> int:
    """Signed 64-bit hash of a normalised line."""
    h = xxhash.xxh64_intdigest(line.encode(), seed)
    return h - (1 << 64) if h >= 1 << 63 else h


class Lines:
    """All lines of a column of texts. doc, start, end (bytes), words: one entry a line."""

    def __init__(self, column: pa.Array):
        self.buf, self.offs = buf, offs = text_bytes(column)
        n = len(offs) - 1
        breaks = np.flatnonzero(buf == 10)
        doc = np.concatenate([np.arange(n), np.searchsorted(offs, breaks, side="right") - 1])
        start = np.concatenate([offs[:-1], breaks + 1])
        order = np.lexsort((start, doc))
        self.doc, self.start = doc[order], start[order]
        last = np.ones(len(start), bool)
        last[:-1] = self.doc[1:] != self.doc[:-1]
        self.end = np.where(last, offs[1:][self.doc], np.concatenate([self.start[1:], [0]]) - 1)
        self.first = np.searchsorted(self.doc, np.arange(n + 1))  # of each text's lines
        self.inside = ~_space[buf]
        begins = self.inside.copy()
        begins[1:] &= ~self.inside[:-1]
        fresh = self.start[self.start < len(buf)]
        begins[fresh] = self.inside[fresh]
        self.begins = begins
        total = np.concatenate([[0], np.cumsum(begins)])
        self.words = total[self.end] - total[self.start]

    def strings(self) -> pa.Array:
        """The lines as strings, without their line breaks."""
        keep = self.buf != 10
        before = np.concatenate([[0], np.cumsum(~keep)])
        places = np.concatenate([self.start - before[self.start], [int(keep.sum())]])
        return pa.StringArray.from_buffers(len(self.start), pa.py_buffer(places.astype(np.int32)), pa.py_buffer(self.buf[keep]))

    def chars(self) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of each line in characters of its text."""
        total = np.concatenate([[0], np.cumsum((self.buf & 0xC0) != 0x80)])
        base = total[self.offs[:-1]][self.doc]
        return total[self.start] - base, total[self.end] - base

    def per_text(self, values: np.ndarray) -> np.ndarray:
        return sums(values, self.first)

    def hashes(self, *seeds: int) -> tuple[np.ndarray, ...]:
        """64-bit hashes of the normalised lines, one array a seed."""
        which, distinct = codes(self.strings())
        plain = [normalised(x) for x in distinct.to_pylist()]
        return tuple(np.array([digest(x, s) for x in plain], np.int64)[which] if len(plain) else np.zeros(0, np.int64) for s in seeds)

    def lists(self, keep: np.ndarray, **fields: np.ndarray) -> pa.ListArray:
        """One list of structs a text, of the lines that are kept."""
        ends = np.concatenate([[0], np.cumsum(keep)])[self.first]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(v[keep]) for v in fields.values()], list(fields)))
