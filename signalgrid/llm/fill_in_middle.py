"""Fill-in-middle: cuts are found by ranks in a wavelet matrix over character classes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from signalgrid.llm.common import lean
from signalgrid.llm.words import buffers, row_ranges

# Sentinels before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = "1"
PERCENT_CUT, PERCENT_SUFFIX_FIRST = 90, 20
CHUNK_BYTES = 1 << 20
LEVELS = 3

# The class of a byte has a bit for each kind of unit that begins there.
BEGINS = {"lines": 1, "words": 2, "chars": 4}
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


class Bits:
    """A packed row of bits with counts of ones before each byte."""

    def __init__(self, bits: np.ndarray) -> None:
        self.packed = np.append(np.packbits(bits, bitorder="little"), np.uint8(0))
        self.before = np.zeros(len(self.packed), np.int32)
        np.cumsum(np.bitwise_count(self.packed[:-1]), out=self.before[1:])
        self.ones = int(self.before[-1])
        self.zeros = len(bits) - self.ones

    def rank1(self, at: np.ndarray) -> np.ndarray:
        byte = at >> 3
        low = (np.left_shift(1, at & 7) - 1).astype(np.uint8)
        return self.before[byte] + np.bitwise_count(self.packed[byte] & low)


class WaveletMatrix:
    """Counts of any class before any place, by one rank a level."""

    def __init__(self, codes: np.ndarray, levels: int = LEVELS) -> None:
        self.size, self.rows = len(codes), []
        for shift in range(levels - 1, -1, -1):
            bits = (codes >> shift) & 1 == 1
            self.rows.append((shift, Bits(bits)))
            codes = np.concatenate((codes[~bits], codes[bits]))
        self.begins = {c: int(self._path(c, np.zeros(1, np.int64))[0]) for c in range(1 << levels)}

    def _path(self, code: int, at: np.ndarray) -> np.ndarray:
        for shift, bits in self.rows:
            ones = bits.rank1(at)
            at = bits.zeros + ones if (code >> shift) & 1 else at - ones
        return at

    def rank(self, code: int, at: np.ndarray) -> np.ndarray:
        """How often a class stands before each place."""
        return self._path(code, at) - self.begins[code]

    def borders(self, kind: int, at: np.ndarray) -> np.ndarray:
        """How many units begin before each place: the ranks of all classes with that bit, added."""
        return sum(self.rank(c, at) for c in self.begins if c & kind)

    def locate(self, kind: int, nth: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The place of the nth border (from 1, counted from 0), by bisection on ranks in [low, high)."""
        low, high = low.copy(), high.copy()
        while (open_ := low < high).any():
            middle = (low + high) >> 1
            enough = self.borders(kind, middle + 1) >= nth
            high = np.where(open_ & enough, middle, high)
            low = np.where(open_ & ~enough, middle + 1, low)
        return low


def classes(data: np.ndarray, low: int, high: int, starts: np.ndarray) -> np.ndarray:
    """Classes of the bytes in [low, high); ``starts`` are places in there at which a text begins."""
    raw = data[low:high]
    before = np.empty(len(raw), np.uint8)
    before[1:] = raw[:-1]
    before[:1] = data[low - 1] if low else 10
    before[starts[starts < high] - low] = 10
    lead = (raw & 0xC0) != 0x80
    word = lead & ~_BLANK[raw] & _BLANK[before]
    line = lead & (before == 10)
    return (lead * np.uint8(4) + word * np.uint8(2) + line * np.uint8(1)).astype(np.uint8)


class Cutter:
    """Numbers of units, and places of cuts, in texts that lie one after another in a buffer."""

    def __init__(self, data: np.ndarray, at: np.ndarray, unit: str) -> None:
        self.data, self.at, self.kind = data, at, BEGINS[unit]
        low, high = int(at[0]), int(at[-1])
        # One chunk for many short texts, many for a long one; only one matrix is held at a time.
        self.chunks = [(a, min(a + CHUNK_BYTES, high)) for a in range(low, high, CHUNK_BYTES)]
        self.held: tuple[int, WaveletMatrix] | None = None
        self.totals = np.zeros(len(self.chunks) + 1, np.int64)
        for i in range(len(self.chunks)):
            whole = self._matrix(i)
            self.totals[i + 1] = self.totals[i] + whole.borders(self.kind, np.array([whole.size]))[0]

    def _matrix(self, i: int) -> WaveletMatrix:
        if self.held is None or self.held[0] != i:
            low, high = self.chunks[i]
            starts = self.at[(self.at >= low) & (self.at < high)]
            self.held = (i, WaveletMatrix(classes(self.data, low, high, starts)))
        return self.held[1]

    def before(self, places: np.ndarray) -> np.ndarray:
        """Units that begin in the buffer before each place."""
        out = np.zeros(len(places), np.int64)
        chunk = (places - self.at[0]) // CHUNK_BYTES
        for i in np.unique(chunk):
            mine = chunk == i
            if i == len(self.chunks):
                out[mine] = self.totals[-1]
            else:
                out[mine] = self.totals[i] + self._matrix(int(i)).borders(self.kind, places[mine] - self.chunks[i][0])
        return out

    def place(self, nth: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The place in [low, high) of the nth unit (from 1) of the buffer."""
        out = np.zeros(len(nth), np.int64)
        chunk = np.searchsorted(self.totals, nth, "left") - 1
        for i in np.unique(chunk):
            mine, (first, last) = chunk == i, self.chunks[i]
            matrix = self._matrix(int(i))
            out[mine] = first + matrix.locate(self.kind, nth[mine] - self.totals[i], np.maximum(low[mine], first) - first,
                                              np.minimum(high[mine], last) - first)
        return out


def cuts(data: np.ndarray, at: np.ndarray, draws: np.ndarray, unit: str = "chars") -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of texts (first, last) with, per text: its number of units, and units and places before both cuts.

    A text of n units is cut after draw % (n + 1) of them, for both draws. A unit ends where the next
    begins; what stands before the first belongs to it.
    """
    for first, last in row_ranges(at, CHUNK_BYTES):
        own = at[first:last + 1]
        cutter = Cutter(data, own, unit)
        seen = cutter.before(own)
        n = np.diff(seen)
        after = np.sort(draws[first:last] % (n[:, None] + 1), axis=1)
        low, high = (np.repeat(x[:, None], 2, 1) for x in (own[:-1], own[1:]))
        places = np.where(after == 0, low, high)
        inner = (after > 0) & (after < n[:, None])
        nth = (seen[:-1, None] + after + 1)[inner]
        places[inner] = cutter.place(nth, low[inner], high[inner])
        yield first, last, n, after, places


def arranged(batches: Iterable[pa.RecordBatch], unit: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, at = buffers(batch["text"])
        draws = np.stack([batch["draw_1"].to_numpy(zero_copy_only=False), batch["draw_2"].to_numpy(zero_copy_only=False)], 1)
        forms = batch["form"].to_pylist()
        for first, last, n, after, places in cuts(data, at, draws, unit):
            outputs, plain = [], np.zeros(last - first, bool)
            for i in range(last - first):
                a, b, c, d = (int(x) for x in (at[first + i], *places[i], at[first + i + 1]))
                form = forms[first + i]
                plain[i] = form == "plain"
                prefix, middle, suffix = (data[x:y].tobytes() for x, y in ((a, b), (b, c), (c, d)))
                if plain[i]:
                    outputs.append(prefix + middle + suffix)
                elif form == "psm":
                    outputs.append(b"".join((PREFIX.encode(), prefix, SUFFIX.encode(), suffix, MIDDLE.encode(), middle)))
                else:
                    outputs.append(b"".join((SUFFIX.encode(), suffix, PREFIX.encode(), prefix, MIDDLE.encode(), middle)))
            yield pa.record_batch([
                batch["doc_id"].slice(first, last - first), pa.array(n), batch["form"].slice(first, last - first),
                pa.array(after[:, 0], mask=plain), pa.array(after[:, 1] - after[:, 0], mask=plain),
                pa.array(outputs, pa.binary()).cast(pa.string()),
            ], ["doc_id", "n", "form", "prefix_units", "middle_units", "output"])


def fill_in_middle(documents: DataFrame, unit: str = "chars", seed: str = SEED, percent_cut: int = PERCENT_CUT,
                   percent_suffix_first: int = PERCENT_SUFFIX_FIRST) -> DataFrame:
    """Per document: doc_id, n, form, prefix_units, middle_units, output.

    ``unit`` is chars (code points), words or lines; n counts the units of the text. The first four
    groups of 8 hex digits of sha256(seed:doc_id) are draws: two for the cuts, one for the share of
    texts that are cut, one for the share that puts the suffix first. A text that is empty or holds a
    sentinel is plain, so an output can always be read back (``restored``).

    A byte's class has a bit for each kind of unit that begins there. A wavelet matrix over the classes
    answers how many units begin before a place, as a sum of ranks; the cut after k units is
    found by bisection on that sum. Texts are worked on in chunks, so that a long one takes no more
    than itself, its output and one matrix.

    Null text is empty. A null doc_id draws as an empty id; rows with the same id and text have the same
    output. Empty tables give no rows; other columns are ignored.
    """
    if unit not in BEGINS:
        raise ValueError(f"unit is one of {sorted(BEGINS)}")
    text = F.coalesce("text", F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit(""))), 256)
    draw = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]
    plain = (text == "") | text.contains(PREFIX) | text.contains(SUFFIX) | text.contains(MIDDLE)
    form = (F.when(plain | (draw[2] % 100 >= percent_cut), "plain")
            .when(draw[3] % 100 < percent_suffix_first, "spm").otherwise("psm"))
    rows = documents.select(F.col("doc_id").cast("long"), text.alias("text"), form.alias("form"),
                            draw[0].alias("draw_1"), draw[1].alias("draw_2"))

    @lean
    def task(batches):
        yield from arranged(batches, unit)

    return rows.mapInArrow(task, "doc_id long, n long, form string, prefix_units long, middle_units long, output string")


def restored(output: str | Column, form: str | Column) -> Column:
    """The text that an output was made of."""
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    one, two, three = (F.element_at(parts, i) for i in (2, 3, 4))
    return (F.when(form == "psm", F.concat(one, three, two)).when(form == "spm", F.concat(two, three, one))
            .otherwise(output))
