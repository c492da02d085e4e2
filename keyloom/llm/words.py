"""Vectorised word scanning over Arrow string columns.

Words are maximal runs of bytes other than space and ``\\x09``-``\\x0D``.  UTF-8
never uses those bytes inside a longer sequence, so the scan works on the raw
buffer: no Python string is made.  A span is hashed eight bytes at a time: each chunk
goes through a 64-bit finaliser with a key of its place, and the mixed chunks are summed,
so no algebra of the bytes survives and equal hashes mean equal spans but for chance.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MASK = np.array([(1 << 8 * k) - 1 for k in range(1, 9)], np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of ``texts`` with about ``most`` bytes each; a longer text stands alone."""
    off = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4).astype(np.int64)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
        yield at, to
        at = to


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A string column with nulls as empty strings."""
    col = batch.column(batch.schema.get_field_index(name)).cast(pa.string())
    return col.fill_null("") if col.null_count else col


@dataclass
class Scan:
    """Word positions of a run of texts, as byte positions in ``raw``."""

    raw: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    lower: bool

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of each byte span that is not empty; equal spans of any two scans hash alike."""
        if not len(start):
            return np.zeros(0, np.uint64)
        padded = np.zeros(len(self.raw) + 8, np.uint8)
        padded[:-8] = _LOWER[self.raw] if self.lower else self.raw
        eights = np.ndarray(len(self.raw) + 1, np.dtype("<u8"), padded, strides=(1,))
        size = end - start
        chunks = (size + 7) >> 3
        first = np.cumsum(chunks) - chunks
        place = np.arange(first[-1] + chunks[-1]) - np.repeat(first, chunks)
        value = eights[np.repeat(start, chunks) + 8 * place] & _MASK[np.minimum(np.repeat(size, chunks) - 8 * place, 8) - 1]
        sums = np.add.reduceat(mix(value ^ mix((place + 1).astype(np.uint64) * _GOLDEN)), first)
        return mix(sums + size.astype(np.uint64) * _GOLDEN)

    def word_hash(self) -> np.ndarray:
        return self.span_hash(self.start, self.end)

    def words_per_doc(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=self.rows)

    def per_doc(self, flags: np.ndarray) -> np.ndarray:
        """Sum of per-byte flags over each text."""
        total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return total[self.offsets[1:]] - total[self.offsets[:-1]]


def scan(texts: pa.Array, lower: bool = False) -> Scan:
    """Scan a null-free string array; ``lower`` folds A-Z before hashing."""
    off = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4).astype(np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    off = off - off[0]
    n = len(raw)
    full = ~_SPACE[raw]
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = full[:-1], full[1:]
    before[off[:-1][off[:-1] < n]] = False
    after[off[1:][off[1:] > 0] - 1] = False
    start, end = np.flatnonzero(full & ~before), np.flatnonzero(full & ~after) + 1
    return Scan(raw, off, start, end, np.searchsorted(off, start, "right") - 1, lower)


def shingles(words: np.ndarray, doc: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``size`` words inside one text, and the window's first word."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(doc[:n] == doc[size - 1 :])
    out = np.zeros(len(at), np.uint64)
    for k in range(size):
        out += words[at + k] * np.uint64(0xA0761D6478BD642F * 0xD1342543DE82EF95**k % (1 << 64))
    return mix(out), at
