"""Words of whole Arrow columns as 64-bit hashes, in numpy.

A word is a run of bytes other than space and 0x09 to 0x0D, which in UTF-8 is the word
rule on characters. Work goes in pieces of a bounded number of bytes, so memory does not
follow the length of a text or batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 4 << 20
BLOCK = 1 << 16
BASE = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (one to one)."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Powers:
    """Powers of the hash base and of its inverse modulo 2^64, as far as needed."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            n = max(n, 4 * BLOCK)
            cls.up, cls.down = _powers(BASE, n), _powers(pow(BASE, -1, 1 << 64), n)
        return cls.up, cls.down


@dataclass
class Words:
    """Words of several texts: byte positions, hash, and the text each belongs to."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(np.searchsorted(self.starts, self.offsets))

    @property
    def text(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts)


def pieces(batch: pa.RecordBatch, column: str, most: int = PIECE) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most so many bytes of text, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    first, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield batch.slice(first, i - first)
            first, total = i, 0
        total += int(n)
    if first < len(sizes):
        yield batch.slice(first)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and where each starts (one more entry than texts)."""
    column = column.cast(pa.large_string())
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + len(column) + 1]
    held = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return held[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(column: pa.Array) -> Words:
    """Words in order; NULL and empty texts have none."""
    data, offsets = text_bytes(column)
    inside = (data != 0x20) & (data - np.uint8(0x09) > 4)
    full = offsets[:-1][np.diff(offsets) > 0]
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    begins[full] = inside[full]
    stops[:-1] &= ~inside[1:]
    last = offsets[1:][np.diff(offsets) > 0] - 1
    stops[last] = inside[last]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return Words(data, offsets, starts, ends, _hashes(data, starts, ends))


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hash of each word modulo 2^64, scrambled."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + BLOCK)))
        base, end = int(starts[i]), int(ends[j - 1])
        up, down = _Powers.upto(end - base + 1)
        sums = np.zeros(end - base + 1, np.uint64)
        np.cumsum((data[base:end].astype(np.uint64) + np.uint64(1)) * up[: end - base], out=sums[1:])
        s, e = starts[i:j] - base, ends[i:j] - base
        out[i:j] = (sums[e] - sums[s]) * down[s]
        i = j
    return mix(out)


def shingles(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of size words, and the text it belongs to; shorter texts with a
    word have one shingle of all their words."""
    counts = w.counts
    firsts = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64)
    n = np.where(counts > 0, np.maximum(counts - size + 1, 1), 0)
    text = np.repeat(np.arange(len(counts)), n)
    start = np.repeat(firsts - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
    length = np.minimum(counts, size)[text]
    out = np.zeros(len(start), np.uint64)
    last = len(w.hashes) - 1
    for k in range(size):
        here = w.hashes[np.minimum(start + k, last)] if last >= 0 else out
        step = mix(out * np.uint64(BASE) + here)
        out = step if k == 0 else np.where(length > k, step, out)
    return out, text
