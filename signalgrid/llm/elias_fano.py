"""Elias-Fano coded monotone sequences in flat 64-bit words, searched many values at a time."""

from __future__ import annotations

import numpy as np

U = np.uint64
_ONE = U(1)


def _packed(bits: np.ndarray) -> np.ndarray:
    """Booleans as 64-bit words, the first in the lowest bit."""
    raw = np.packbits(bits, bitorder="little")
    out = np.zeros(-(-len(raw) // 8) * 8, np.uint8)
    out[:len(raw)] = raw
    return out.view(U)


def encode(values: np.ndarray) -> np.ndarray:
    """Sorted values below 2**63 as words: count, width of low parts, sizes, low parts, high parts, and
    the number of set bits before each word of the high parts."""
    values = values.astype(U)
    n = len(values)
    top = int(values[-1]) if n else 0
    width = max(0, (top // max(n, 1)).bit_length() - 1)
    low = np.zeros(n * width // 64 + 2, U)
    if width and n:
        part = values & U((1 << width) - 1)
        at = np.arange(n, dtype=U) * U(width)
        word, shift = (at >> U(6)).astype(np.int64), at & U(63)
        np.bitwise_or.at(low, word, part << shift)
        over = shift + U(width) > U(64)
        np.bitwise_or.at(low, word[over] + 1, part[over] >> (U(64) - shift[over]))
    high = values >> U(width)
    bits = np.zeros(n + (int(high[-1]) if n else 0) + 1, bool)
    bits[high.astype(np.int64) + np.arange(n)] = True
    words = _packed(bits)
    before = np.zeros(len(words) + 1, U)
    np.cumsum(np.bitwise_count(words), dtype=U, out=before[1:])
    head = np.array([n, width, len(low), len(words), len(bits)], U)
    return np.concatenate((head, low, words, before))


class Sequence:
    """A coded sequence over words that may lie in a mapped file."""

    def __init__(self, words: np.ndarray):
        n, width, lows, highs, bits = (int(x) for x in words[:5])
        self.n, self.width, self.buckets = n, width, bits - n
        self.low = words[5:5 + lows]
        self.high = words[5 + lows:5 + lows + highs]
        self.ones = words[5 + lows + highs:5 + lows + 2 * highs + 1]
        self.zeros = np.arange(highs + 1, dtype=U) * U(64) - self.ones
        self.size = 5 + lows + 2 * highs + 1

    def _select(self, k: np.ndarray, set_bits: bool) -> np.ndarray:
        """Place of the k-th (from 0) set or clear bit of the high parts."""
        before = self.ones if set_bits else self.zeros
        word = np.searchsorted(before, k, "right") - 1
        rest, x = k - before[word], self.high[word]
        if not set_bits:
            x = ~x
        place = word.astype(U) << U(6)
        for half in (32, 16, 8, 4, 2, 1):
            count = np.bitwise_count(x & U((1 << half) - 1)).astype(U)
            on = rest >= count
            rest = np.where(on, rest - count, rest)
            step = np.where(on, U(half), U(0))
            x = x >> step
            place += step
        return place

    def _lows(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), U)
        at = i.astype(U) * U(self.width)
        word, shift = (at >> U(6)).astype(np.int64), at & U(63)
        # A shift by 64 is none in numpy, so the second part is moved in two steps.
        both = self.low[word] >> shift | self.low[word + 1] << (U(63) - shift) << _ONE
        return both & U((1 << self.width) - 1)

    def at(self, i: np.ndarray) -> np.ndarray:
        """Values at places i."""
        i = i.astype(U)
        return (self._select(i, True) - i) << U(self.width) | self._lows(i)

    def successor(self, x: np.ndarray, first: np.ndarray | None = None,
                  last: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """For each x the first place in [first, last) with a value of at least x, and whether it is x."""
        x = x.astype(U)
        first = np.zeros(len(x), np.int64) if first is None else first
        last = np.full(len(x), self.n, np.int64) if last is None else last
        bucket = x >> U(self.width)
        inside = np.minimum(bucket, U(max(self.buckets - 1, 0)))
        above = (self._select(inside, False) - inside).astype(np.int64)
        previous = np.maximum(inside, _ONE) - _ONE
        below = np.where(inside > 0, (self._select(previous, False) - previous).astype(np.int64), 0)
        beyond = bucket > inside
        a = np.clip(np.where(beyond, self.n, below), first, last)
        b = np.clip(np.where(beyond, self.n, above), first, last)
        low = x & U((1 << self.width) - 1)
        end = b.copy()
        while True:  # lower bound by halving, in all buckets at once
            open_ = a < b
            if not open_.any():
                break
            middle = (a + b) >> 1
            less = open_ & (self._lows(np.minimum(middle, max(self.n - 1, 0))) < low)
            a = np.where(less, middle + 1, a)
            b = np.where(open_ & ~less, middle, b)
        hit = (a < end) & ~beyond
        if hit.any():
            hit[hit] = self._lows(a[hit]) == low[hit]
        return a, hit
