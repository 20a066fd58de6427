"""Words and shingles of whole texts, hashed a slice of an Arrow column at a time.

A word is a run of bytes other than space and U+0009 to U+000D; UTF-8 never uses those
bytes inside a character, so the bytes can be scanned as they are. Null texts have no
words. Hashes are 64-bit and depend on nothing but the word (or the sequence of words),
so they agree between tasks, executors and runs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES, SLICE_ROWS = 2_000_000, 4_096
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_SAME = np.arange(256, dtype=np.uint8)
LOWER = _SAME.copy()
LOWER[65:91] += 32
_RNG = np.random.default_rng(20_240_229)
_BYTE = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
_STEP = np.uint64(int(_RNG.integers(2**62, 2**63)) | 1)
PLACE = _RNG.integers(0, 2**64, 64, dtype=np.uint64) | np.uint64(1)
_power = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    global _power
    if len(_power) <= n:
        steps = np.full(max(n + 1, 2 * len(_power)), _STEP)
        steps[0] = 1
        _power = np.cumprod(steps, dtype=np.uint64)
    return _power


@dataclass
class Words:
    """Words of a few texts: `first[t]:first[t + 1]` are those of text t, bytes `start:end` of `data`."""

    data: np.ndarray
    first: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)

    def shingles(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of `width` words in a row, and where each text's begin.

        A text with fewer words, but one at least, has its whole sequence as its one shingle.
        """
        count = self.count
        n = np.where(count >= width, count - width + 1, np.minimum(count, 1))
        first = np.concatenate([[0], np.cumsum(n)])
        at = np.arange(first[-1]) + np.repeat(self.first[:-1] - first[:-1], n)
        out = np.zeros(len(at), np.uint64)
        padded = np.concatenate([self.hash, np.zeros(width, np.uint64)])
        for k in range(width):
            out += padded[at + k] * PLACE[k]
        few = np.flatnonzero((count > 0) & (count < width))
        for t in few:
            own = self.hash[self.first[t]:self.first[t + 1]]
            out[first[t]] = np.uint64(len(own)) + (own * PLACE[:len(own)]).sum(dtype=np.uint64)
        return mix(out), first


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 of a string column without copying it, and where each text begins; null as empty."""
    texts = pc.fill_null(texts, "")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], kind)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(texts: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES, rows: int = SLICE_ROWS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from, to, bytes, offsets) of runs of up to `rows` texts and about `limit` bytes; a longer text comes alone."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if isinstance(texts, pa.ChunkedArray):
        texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.string())
    if not len(texts):
        return
    data, offsets = text_bytes(texts)
    at = 0
    while at < len(texts):
        to = max(at + 1, min(at + rows, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1))
        yield at, to, data[offsets[at]:offsets[to]], offsets[at:to + 1] - offsets[at]
        at = to


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = False, space: np.ndarray = SPACE) -> Words:
    """The words between the bytes that `space` marks; `lower` takes A-Z as a-z in their hashes."""
    inside = ~space[data]
    after = np.zeros(len(data) + 1, bool)
    after[1:] = inside
    after[offsets] = False
    start = np.flatnonzero(inside & ~after[:-1])
    before = np.zeros(len(data) + 1, bool)
    before[:-1] = inside
    before[offsets] = False
    end = np.flatnonzero(inside & ~before[1:]) + 1
    first = np.searchsorted(start, offsets).astype(np.int64)
    length = end - start
    begin = np.cumsum(length) - length
    if len(start):
        rel = np.arange(begin[-1] + length[-1], dtype=np.int64) - np.repeat(begin, length)
        terms = _BYTE[(LOWER if lower else _SAME)[data[inside]]]
        terms *= _powers(int(length.max()))[rel]
        hashed = mix(np.add.reduceat(terms, begin) + length.astype(np.uint64) * PLACE[-1])
    else:
        hashed = np.zeros(0, np.uint64)
    return Words(data, first, start, end, hashed)
