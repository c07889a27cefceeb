"""Vectorised hashes of words, sentences and shingles over the raw bytes of a block of texts.

All functions work on one block of whole texts at a time (about ``BLOCK`` bytes, or one longer text), so memory is
bounded by the longest text.
"""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 19
U64 = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ U64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> U64(33))) * U64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U64(33))) * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


BYTE_VALUES = mixed(np.arange(1, 257, dtype=U64), 1)


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, as many as were needed so far."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, U64)

    def take(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = max(n, 2 * len(self.up))
            grown = [np.full(size, U64(b)) for b in (self.base, self.inverse)]
            for g in grown:
                g[0] = 1
            self.up, self.down = (np.cumprod(g, dtype=U64) for g in grown)
        return self.up[:n], self.down[:n]


POWERS = {seed: Powers(base) for seed, base in ((1, 0x5851F42D4C957F2D), (2, 0x14057B7EF767814F | 1))}


class Sums:
    """Prefix sums of values times powers, from which the hash of any range is a difference."""

    def __init__(self, values: np.ndarray, seed: int = 1):
        up, self.down = POWERS[seed].take(len(values) + 1)
        self.seed, self.sums = seed, np.zeros(len(values) + 1, U64)
        np.cumsum(values * up[:-1], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(U64), self.seed)


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 1) -> np.ndarray:
    """A hash of ``values[start:end]`` for every range."""
    return Sums(values, seed).of(starts, ends)


def ranges(sizes: list[int], size: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive sizes, each of which comes to about ``size``."""
    start, held = 0, 0
    for i, own in enumerate(sizes):
        if held and held + own > size:
            yield start, i
            start, held = i, 0
        held += own + 1
    if start < len(sizes):
        yield start, len(sizes)


def blocks(texts: list[bytes], size: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts that together hold about ``size`` bytes."""
    return ranges([len(t) for t in texts], size)


def text_blocks(column: pa.Array, size: int = BLOCK) -> Iterator[tuple[int, int, list[bytes]]]:
    """The ranges of ``blocks`` with their texts. No more than one range is taken out of the column at a time."""
    for a, b in ranges(pc.binary_length(column).fill_null(0).to_pylist(), size):
        yield a, b, texts_of(column.slice(a, b - a))


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the texts with a newline after each, and where each text begins (one more at the end)."""
    body = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=offsets[1:])
    return body, offsets


def word_ranges(body: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word of the block; the block ends with a space."""
    blank = np.empty(len(body) + 1, bool)
    blank[0] = True
    blank[1:] = SPACE[body]
    turns = np.flatnonzero(blank[1:] != blank[:-1])
    return turns[0::2], turns[1::2]


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, and for every text where its words begin (one more at the end)."""
    body, offsets = joined(texts)
    starts, ends = word_ranges(body)
    return range_hashes(BYTE_VALUES[body], starts, ends), np.searchsorted(starts, offsets)


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words; a shorter text is one run, an empty one has none."""
    if len(words) == 0:
        return words
    size = min(size, len(words))
    starts = np.arange(len(words) - size + 1)
    return range_hashes(mixed(words), starts, starts + size)


def texts_of(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """The texts as UTF-8, null ones as empty."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches. After the last one, what they left free goes back to the system: a worker is kept for later tasks
    and would hold it beside all that the executor does without Python."""
    yield from batches
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)):
        trim(0)
