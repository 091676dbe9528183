"""Words and five-word shingles of Arrow text columns as numpy hashes, a bounded block of bytes at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WIDTH = 5
BLOCK_BYTES = 4 << 20
GAPS = np.zeros(256, dtype=bool)
GAPS[[9, 10, 11, 12, 13, 32]] = True
PRIME, STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int, base: np.uint64 = PRIME) -> np.ndarray:
    out = np.full(max(n, 1), base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text column; nulls are empty."""
    column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"").cast(
        pa.large_binary())
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64, count=len(column) + 1, offset=8 * column.offset)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def blocks(column: pa.Array, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of consecutive rows with at most `most` bytes, or one row."""
    data, offsets = text_bytes(column)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1)
        yield lo, hi, data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
        lo = hi


def words(data: np.ndarray, offsets: np.ndarray, gaps: np.ndarray = GAPS) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, number of words per row); words are runs of bytes that are no gaps."""
    rows = len(offsets) - 1
    solid = ~gaps[data]
    if not solid.any():
        return np.zeros(0, np.uint64), np.zeros(rows, np.int64)
    begin = solid.copy()
    begin[1:] &= ~solid[:-1]
    firsts = offsets[:-1][offsets[:-1] < len(data)]
    begin[firsts] = solid[firsts]
    starts = np.nonzero(begin)[0]
    in_words = np.nonzero(solid)[0]
    first = np.searchsorted(in_words, starts)
    sizes = np.diff(np.append(first, len(in_words)))
    place = np.arange(len(in_words)) - np.repeat(first, sizes)
    value = (data[in_words].astype(np.uint64) + np.uint64(1)) * powers(int(sizes.max()))[place]
    return mix(np.add.reduceat(value, first)), np.diff(np.searchsorted(starts, offsets))


def shingles(word: np.ndarray, counts: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every shingle in text order, shingles per row); a row of fewer words has one shingle of all of them."""
    sizes = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    total = int(sizes.sum())
    if not total:
        return np.zeros(0, np.uint64), sizes
    row_start = np.cumsum(counts) - counts
    place = np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(row_start, sizes)
    left = np.repeat(row_start + counts, sizes) - place  # words from here to the row's end
    out = np.zeros(total, dtype=np.uint64)
    for k, p in enumerate(powers(width, STEP)):
        at = np.minimum(place + k, len(word) - 1)
        out += np.where(left > k, word[at] * p, np.uint64(0))
    return mix(out + np.minimum(left, width).astype(np.uint64)), sizes


def numbered(shingle: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Occurrence-labelled shingles: the n-th equal shingle of a row gets a value of its own, so all differ in a row."""
    if not len(shingle):
        return shingle
    row = np.repeat(np.arange(len(sizes), dtype=np.uint64), sizes)
    key = shingle ^ mix(row * PRIME + np.uint64(1))
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    new = np.ones(len(key), dtype=bool)
    new[1:] = ranked[1:] != ranked[:-1]
    if new.all():
        return shingle
    at = np.arange(len(key))
    nth = np.empty(len(key), dtype=np.uint64)
    nth[order] = (at - np.maximum.accumulate(np.where(new, at, 0))).astype(np.uint64)
    return np.where(nth > 0, mix(shingle + nth * STEP), shingle)
