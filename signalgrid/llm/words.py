"""Words of whole texts as 64-bit keys, a block of an Arrow batch at a time.

A key is a polynomial hash of the word's bytes modulo 2**64, mixed afterwards, so it
is the same in every task and run. Text with no valid value counts as empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
BASE = U(0x9E3779B97F4A7C15)
BASE_INVERSE = U(pow(int(BASE), -1, 2**64))
BLOCK_BYTES = 1_000_000

# What separates words: blank, tab, line feed, vertical tab, form feed, carriage return.
_SEPARATES = np.zeros(256, bool)
_SEPARATES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32


@dataclass
class Block:
    """Rows ``first`` to ``last`` of a batch; document i has words starts[i] to starts[i + 1]."""

    first: int
    last: int
    keys: np.ndarray
    starts: np.ndarray

    def documents(self) -> Iterator[tuple[int, np.ndarray]]:
        for i in range(self.last - self.first):
            yield self.first + i, self.keys[self.starts[i]:self.starts[i + 1]]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread all bits over all bits; a bijection on 64-bit values."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x = x * U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, U)
    out[0] = U(1)
    return np.multiply.accumulate(out)


# Powers of the base and its inverse; words are hashed in stretches of at most this many bytes, so
# what a worker keeps does not grow with the longest text.
STRETCH = 1 << 18
_UP, _DOWN = _powers(BASE, STRETCH + 1), _powers(BASE_INVERSE, STRETCH + 1)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null rows become empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), at


def row_ranges(at: np.ndarray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``most`` bytes; a longer text is a run of its own."""
    first, n = 0, len(at) - 1
    while first < n:
        last = int(np.searchsorted(at, at[first] + most, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def blocks(texts: pa.Array, lower: bool = True, most: int = BLOCK_BYTES) -> Iterator[Block]:
    """Word keys of a string column, block by block."""
    data, at = buffers(texts)
    for first, last in row_ranges(at, most):
        low = int(at[first])
        raw = data[low:int(at[last])]
        word_starts, word_ends = word_spans(raw, at[first:last + 1] - low)
        keys = span_keys(_LOWER[raw] if lower else raw, word_starts, word_ends)
        yield Block(first, last, keys, np.searchsorted(word_starts, at[first:last + 1] - low))


def word_spans(raw: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin and end; ``cuts`` are document borders, which end a word as well."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~_SEPARATES[raw]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edge = cuts[(cuts > 0) & (cuts < len(raw))]
    begins[edge] |= inside[edge]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    ends[edge - 1] |= inside[edge - 1]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def span_keys(raw: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Keys of the words in [begins, ends); neighbouring words share a stretch of the sums."""
    out = np.zeros(len(begins), U)
    i = 0
    while i < len(begins):
        low = int(begins[i])
        j = int(np.searchsorted(ends, low + STRETCH, "right"))
        if j <= i:  # one word longer than a stretch
            out[i] = _long_key(raw[low:int(ends[i])])
            i += 1
            continue
        part = raw[low:int(ends[j - 1])]
        total = np.zeros(len(part) + 1, U)
        np.cumsum((part.astype(U) + U(1)) * _UP[:len(part)], out=total[1:])
        first, last = begins[i:j] - low, ends[i:j] - low
        out[i:j] = mix((total[last] - total[first]) * _DOWN[first] + (last - first).astype(U))
        i = j
    return out


def _long_key(word: np.ndarray) -> np.uint64:
    total, power = 0, 1
    for a in range(0, len(word), STRETCH):
        part = word[a:a + STRETCH]
        total += power * int(((part.astype(U) + U(1)) * _UP[:len(part)]).sum(dtype=U))
        power = power * int(_UP[STRETCH]) % 2**64
    return mix(np.array([(total + len(word)) % 2**64], U))[0]


def shingles(keys: np.ndarray, k: int) -> np.ndarray:
    """Keys of all runs of k words; of the whole sequence if it is shorter and not empty."""
    if not len(keys):
        return keys
    k = min(k, len(keys))
    n = len(keys) - k + 1
    out = np.full(n, U(k))
    for i in range(k):
        out = mix(out * BASE + keys[i:i + n])
    return out
