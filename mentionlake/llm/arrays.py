"""Texts of an Arrow batch as flat numpy arrays: words, their places and hashes.

All Python operators of this package work on whole batches at once; a batch is cut into
slices of bounded size first, so that memory follows the slice, not the batch. Only a
single text larger than a slice makes a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

# The bytes of [\x20\x09-\x0D]; none of them occurs inside a UTF-8 sequence.
SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_A = np.uint64(0x9E3779B97F4A7C15)
_B = np.uint64(0xBF58476D1CE4E5B9)
_C = np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the splitmix64 finalizer)."""
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def seeded(n: int, seed: int) -> np.ndarray:
    """``n`` odd multipliers, the same in every task."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=np.uint64) * _A + np.uint64(seed) * _C) | np.uint64(1)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts and the offsets of each; a null text is empty."""
    if pa.types.is_large_string(texts.type) or texts.null_count:
        texts = texts.fill_null("").cast(pa.large_string())
        kind = np.int64
    else:
        kind = np.int32
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, where, what = texts.buffers()
    offsets = np.frombuffer(where, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(what, np.uint8) if what is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """``batch`` in consecutive parts of about ``size`` bytes of ``column``."""
    if not batch.num_rows:
        return
    _, offsets = text_bytes(batch.column(column))
    start = 0
    while start < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[start] + size, side="right")) - 1
        end = min(max(end, start + 1), batch.num_rows)
        yield batch.slice(start, end - start)
        start = end


def byte_hashes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A hash of each run of bytes; equal runs have equal hashes, others with a chance of 2^-64.

    Runs are read eight bytes at a time, all first eights together, then all second ones
    of those that have any, and so on.
    """
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eights = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    with np.errstate(over="ignore"):
        hashes = lengths.astype(np.uint64) * _C
        live, k = np.flatnonzero(lengths > 0), 0
        while len(live):
            rest = lengths[live] - 8 * k
            unused = (8 * np.maximum(8 - rest, 0)).astype(np.uint64)
            value = (eights[starts[live] + 8 * k] << unused) >> unused
            hashes[live] = mix((hashes[live] ^ value) * _A + np.uint64(k))
            live, k = live[rest > 8], k + 1
    return hashes


@dataclass
class Words:
    """Words of some texts, in order: byte places in ``data``, hashes, word offsets per text."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    offsets: np.ndarray
    hashes: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    @property
    def rows(self) -> np.ndarray:
        """The number of the text of each word."""
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts)


def split_words(texts: pa.Array, lower: bool = False, separators: np.ndarray = SPACES) -> Words:
    """Maximal runs of bytes that are no separators; A-Z lower-cased on request.

    """
    data, offsets = text_bytes(texts)
    if lower:
        data = LOWER[data]
    inside = ~separators[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    full = np.flatnonzero(np.diff(offsets) > 0)
    heads, tails = offsets[full], offsets[full + 1] - 1
    first[heads] = inside[heads]
    last[tails] = inside[tails]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    hashes = byte_hashes(data, starts, ends - starts)
    return Words(data, starts, ends, np.searchsorted(starts, offsets), hashes)


def windows(hashes: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """A hash of each ``size`` consecutive words, one per start (across texts too)."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        total = np.zeros(n, np.uint64)
        for k, factor in enumerate(seeded(size, seed)):
            total += hashes[k : k + n] * factor
        return mix(total)


def shingles(words: Words, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of every shingle of ``size`` words.

    A text with fewer words, but some, has its whole sequence as its only shingle.
    """
    counts = words.counts
    each = np.where(counts >= size, counts - size + 1, 0)
    rows = np.repeat(np.arange(len(counts)), each)
    at = np.arange(len(rows)) - np.repeat(np.cumsum(each) - each, each) + words.offsets[:-1][rows]
    values = windows(words.hashes, size)[at] if len(at) else np.zeros(0, np.uint64)
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        whole = np.zeros(len(short), np.uint64)
        factors = seeded(size, 0)
        with np.errstate(over="ignore"):
            for k in range(size - 1):
                has = counts[short] > k
                whole[has] += words.hashes[words.offsets[short[has]] + k] * factors[k]
            whole = mix(whole + counts[short].astype(np.uint64) * _A)
        rows, values = np.concatenate([rows, short]), np.concatenate([values, whole])
    return rows, values


def distinct_pairs(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted, without repeats, by (row, value)."""
    order = np.lexsort((values, rows))
    rows, values = rows[order], values[order]
    keep = np.ones(len(rows), bool)
    keep[1:] = (rows[1:] != rows[:-1]) | (values[1:] != values[:-1])
    return rows[keep], values[keep]


def lists(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list column from flat values and offsets."""
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))
