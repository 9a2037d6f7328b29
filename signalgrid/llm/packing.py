"""Packing documents into fixed windows by minimum bin slack over the histogram of lengths."""

from __future__ import annotations

import itertools
import json
import os
import string
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from signalgrid.llm.common import lean, modest_batches, stored
from signalgrid.llm.token_counts import byte_letters, vocabulary
from signalgrid.llm.words import buffers, mix, row_ranges

WINDOW = 2_048
END_ID = 1
CACHED, CACHED_IDS, CACHED_BYTES = 500_000, 4_000_000, 64
LONGEST_WORD = 32
WORDS_AT_ONCE, TEXT_BYTES = 4_096, 500_000
LEAST_ROWS_A_BLOCK, MOST_ROWS_A_BLOCK, BLOCKS = 256, 200_000, 1_024

BLANK, LETTER, SIGN, DIGIT, ODD = range(5)
# Keep so many first bytes of a word that is read as numbers of eight bytes.
_MASKS = np.tril(np.full((LONGEST_WORD + 1, LONGEST_WORD), 255, np.uint8), -1).view("<u8")


def byte_kinds(special: list[str]) -> np.ndarray:
    """What a byte of UTF-8 is in a run of plain or western letters, signs and digits; all else is odd.

    Apostrophes are odd, since some letters after them go with them, and so is what a special string begins with.
    """
    kind = np.full(256, ODD, np.uint8)
    kind[list(b" \t\n\v\f\r")] = BLANK
    kind[list(string.ascii_letters.encode())] = LETTER
    kind[0xC3], kind[0x80:0xC0] = LETTER, LETTER  # after another byte than C3 the run is odd
    kind[[0x97, 0xB7]] = ODD  # the signs of multiplication and division
    kind[list(string.punctuation.encode())] = SIGN
    kind[list(string.digits.encode())] = DIGIT
    kind[[ord("'"), *(s.encode()[0] for s in special)]] = ODD
    return kind


def byte_folds() -> np.ndarray:
    """Bytes of runs that are not odd, in lower case."""
    fold = np.arange(256, dtype=np.uint8)
    fold[ord("A"):ord("Z") + 1] += 32
    fold[0x80:0x9F] += 32
    return fold


def stretches(data: np.ndarray, kinds: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Cut a text at blanks into parts of about ``most`` bytes; what has no blank stays whole."""
    first, at = 0, most
    while at < len(data):
        blanks = np.flatnonzero(kinds[data[at:at + most]] == BLANK)
        if len(blanks):
            at += int(blanks[0])
            yield data[first:at]
            first = at
        at += most
    yield data[first:]


class WordIds:
    """Token ids of texts, the same as the tokenizers library gives.

    No token of this vocabulary crosses white space, nor a border between letters, signs and
    digits. Texts are cut there, a block at a time, and each word is encoded once and looked up after
    that by its bytes. Merges of new words are applied to many words at a time; long words and
    runs with odd bytes, which are not cut, are encoded by the library itself.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker for each core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        vocab, letters, end = model["vocab"], byte_letters(), model["end_of_word_suffix"]
        self.inner = np.array([vocab[c] for c in letters], np.int32)
        self.final = np.array([vocab[c + end] for c in letters], np.int32)
        pairs = np.array([vocab[a] << 32 | vocab[b] for a, b in model["merges"]], np.int64)
        made = np.array([vocab[a + b] for a, b in model["merges"]], np.int32)
        order = np.argsort(pairs, kind="stable")
        self.pairs, self.rank, self.made = pairs[order], order.astype(np.int32), made
        # When two bytes merge, inside a word and at its end.
        self.inside, self.at_end = (
            self._ranks(np.repeat(self.inner, 256), np.tile(second, 256)) for second in (self.inner, self.final))
        self.kinds, self.folds = byte_kinds([t["content"] for t in spec["added_tokens"]]), byte_folds()
        self._forget()

    def _forget(self) -> None:
        """What has been learned: row i has ids[starts[i]:starts[i] + counts[i]]; hashes are sorted, with their rows."""
        self.ids, self.keys = np.zeros(0, np.uint32), [np.zeros(0, np.uint64)] * _MASKS.shape[1]
        self.starts, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.hashes, self.rows = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.long: dict[bytes, int] = {}

    def texts(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Blocks of rows: the first row, ids of all of them, and where those of each begin and the last ones end.

        There are no added special tokens; special strings in texts are handled as by default.
        """
        texts.validate(full=True)
        data, at = buffers(texts)
        for first, last in row_ranges(at, TEXT_BYTES):
            if at[last] - at[first] <= 2 * TEXT_BYTES:
                yield first, *self._block(data[at[first]:at[last]], at[first:last + 1] - at[first])
            else:  # one long text
                parts = stretches(data[at[first]:at[last]], self.kinds, TEXT_BYTES)
                ids = np.concatenate([self._block(p, np.array([0, len(p)]))[0] for p in parts])
                yield first, ids, np.array([0, len(ids)])

    def _block(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(self.counts) >= CACHED or len(self.ids) >= CACHED_IDS:
            self._forget()
        kind = self._kinds_by_run(data, at)
        change = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
        inner = at[(at > 0) & (at < len(data))]
        change[inner - 1] = True
        edge = kind != BLANK
        edge[1:] &= change
        begin = np.flatnonzero(edge)
        edge = kind != BLANK
        edge[:-1] &= change
        size = np.flatnonzero(edge) + 1 - begin
        # Numbers cannot tell a word that ends in zero bytes from one without them.
        long = (size > LONGEST_WORD) | (data[begin + size - 1] == 0)
        row = np.empty(len(begin), np.int64)
        if long.any():
            row[~long] = self._short(data, kind, begin[~long], size[~long])
            row[long] = self._long(data, begin[long], size[long])
        else:
            row[:] = self._short(data, kind, begin, size)
        count = self.counts[row]
        ends = np.zeros(len(row) + 1, np.int64)
        np.cumsum(count, out=ends[1:])
        ids = self.ids[np.repeat(self.starts[row] - ends[:-1], count) + np.arange(ends[-1])]
        return ids, ends[np.searchsorted(begin, at)]

    def _kinds_by_run(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Kinds of bytes; all of a run between blanks is odd if one byte is."""
        kind = self.kinds[data]
        if (kind == ODD).any():
            begins = np.zeros(len(data), bool)  # of rows, blanks and what follows a blank
            begins[at[at < len(data)]] = True
            blank = kind == BLANK
            begins |= blank
            begins[1:] |= blank[:-1]
            runs = np.flatnonzero(begins)
            odd = np.maximum.reduceat(kind, runs) == ODD
            kind[np.repeat(odd, np.diff(runs, append=len(data)))] = ODD
        return kind

    def _short(self, data: np.ndarray, kind: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Rows of words; those of equal hashes are told apart by their bytes."""
        if not len(begin):
            return np.zeros(0, np.int64)
        folded = np.zeros(len(data) + LONGEST_WORD, np.uint8)
        np.take(self.folds, data, out=folded[:len(data)])
        np.copyto(folded[:len(data)], data, where=kind == ODD)
        bytes_of = np.lib.stride_tricks.sliding_window_view(folded, LONGEST_WORD)
        keys = [np.ascontiguousarray(k) for k in (bytes_of[begin].view("<u8") & _MASKS[size]).T]
        hashes, more = keys[0].copy(), np.flatnonzero(size > 8)
        rest = np.zeros(len(more), np.uint64)
        for k in reversed(keys[1:]):
            rest = mix(k[more] + rest)
        hashes[more] += rest
        order = np.argsort(hashes)
        new = np.zeros(len(order), bool)
        new[0] = True
        for k in keys:
            k = k[order]
            new[1:] |= k[1:] != k[:-1]
        first, word = order[new], np.empty(len(order), np.int64)
        word[order] = np.cumsum(new) - 1
        hashes, keys = hashes[first], [k[first] for k in keys]
        row = np.full(len(first), -1, np.int64)
        if len(self.rows):
            place = np.minimum(np.searchsorted(self.hashes, hashes), len(self.rows) - 1)
            seen = self.rows[place]
            known = np.logical_and.reduce([own[seen] == k for own, k in zip(self.keys, keys)])
            row[known] = seen[known]
        missing = np.flatnonzero(row < 0)
        if len(missing):
            hashes, keys = hashes[missing], [k[missing] for k in keys]
            begin, size = begin[first[missing]], size[first[missing]]
            odd = kind[begin] == ODD
            if odd.any():
                got = self._encode([data[a:a + n].tobytes() for a, n in zip(begin[odd].tolist(), size[odd].tolist())])
                row[missing[odd]] = self._add(*got, [k[odd] for k in keys])
            if not odd.all():
                own = [k[~odd] for k in keys]
                row[missing[~odd]] = self._add(*self._merge(np.stack(own, 1).view(np.uint8), size[~odd]), own)
            place = np.searchsorted(self.hashes, hashes)
            self.hashes = np.insert(self.hashes, place, hashes)
            self.rows = np.insert(self.rows, place, row[missing].astype(np.int32))
        return row[word]

    def _long(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Rows of long words and runs; the longest are not kept for later blocks."""
        runs = [data[a:a + n].tobytes() for a, n in zip(begin.tolist(), size.tolist())]
        rows = {r: self.long[r] for r in set(runs) if r in self.long}
        new = list(set(runs).difference(rows))
        if new:
            added = self._add(*self._encode(new), [np.zeros(len(new), np.uint64)] * len(self.keys)).tolist()
            rows.update(zip(new, added))
            self.long.update((r, i) for r, i in zip(new, added) if len(r) <= CACHED_BYTES)
        return np.array([rows[r] for r in runs], np.int64)

    def _encode(self, runs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids as the library gives them, where those of each run begin and how many they are."""
        got = [e.ids for e in self.library.encode_batch([r.decode() for r in runs], add_special_tokens=False)]
        counts = np.array([len(x) for x in got], np.int64)
        return np.fromiter(itertools.chain.from_iterable(got), np.uint32), np.cumsum(counts) - counts, counts

    def _add(self, ids: np.ndarray, starts: np.ndarray, counts: np.ndarray, keys: list[np.ndarray]) -> np.ndarray:
        first = len(self.counts)
        self.starts = np.concatenate((self.starts, starts + len(self.ids)))
        self.counts = np.concatenate((self.counts, counts))
        self.ids = np.concatenate((self.ids, ids))
        self.keys = [np.concatenate(k) for k in zip(self.keys, keys)]
        return np.arange(first, len(self.counts))

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """When each pair merges; len(pairs) if never."""
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.rank[at], np.int32(len(self.pairs)))

    def _merge(self, words: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of words, rows of bytes, where those of each begin and how many they are."""
        order, parts, counts = np.argsort(size, kind="stable"), [], np.empty(len(size), np.int64)
        for i in range(0, len(order), WORDS_AT_ONCE):
            some = order[i:i + WORDS_AT_ONCE]
            out = self._merge_some(words[some], size[some])
            counts[some] = (out >= 0).sum(axis=1)
            parts.append(out[out >= 0].astype(np.uint32))
        starts = np.empty(len(size), np.int64)
        starts[order] = np.cumsum(counts[order]) - counts[order]
        return np.concatenate(parts), starts, counts

    def _merge_some(self, words: np.ndarray, size: np.ndarray) -> np.ndarray:
        wide = int(size.max()) + 1
        grid = np.zeros((len(words), wide), np.uint8)
        grid[:, :wide - 1] = words[:, :wide - 1]
        rows, columns = np.arange(len(grid)), np.arange(wide)
        ids = np.where(columns < size[:, None], self.inner[grid], np.int32(-1))
        ids[rows, size - 1] = self.final[grid[rows, size - 1]]
        never = len(self.pairs)
        rank = np.full(ids.shape, never, np.int32)  # of the pair that begins here
        both = grid[:, :-1].astype(np.int64) << 8 | grid[:, 1:]
        rank[:, :-1] = np.where(columns[:-1] < size[:, None] - 2, self.inside[both], never)
        two = rows[size > 1]
        rank[two, size[two] - 2] = self.at_end[both[two, size[two] - 2]]
        live, out = rows, ids.copy()
        while len(live):
            at = rank.argmin(axis=1)
            best = rank[rows[:len(live)], at]
            done = best == never
            if done.any():
                out[live[done]] = ids[done]
                live, ids, rank, at, best = live[~done], ids[~done], rank[~done], at[~done], best[~done]
            if not len(live):
                break
            # The first of the earliest pairs becomes one token; what follows moves up.
            row = rows[:len(live)]
            ids[row, at] = self.made[best]
            source = np.minimum(columns + (columns > at[:, None]), wide - 1)
            ids = np.take_along_axis(ids, source, 1)
            rank = np.take_along_axis(rank, np.minimum(columns + (columns >= at[:, None]), wide - 1), 1)
            right = ids[row, np.minimum(at + 1, wide - 1)]
            rank[row, at] = np.where(right >= 0, self._ranks(ids[row, at], np.maximum(right, 0)), never)
            before = np.maximum(at - 1, 0)
            fresh = self._ranks(ids[row, before], ids[row, at])
            rank[row, before] = np.where(at > 0, fresh, rank[row, before])
        return out


PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(documents: DataFrame, name: str = "word_bpe_49k.json", window: int = WINDOW,
           keep_ids: bool = False) -> DataFrame:
    """Each document's ids, its end id included, cut at multiples of the window.

    Null text is empty and has the end id alone. With ``keep_ids`` the ids are a column too.
    """
    modest_batches(documents.sparkSession)
    rows = documents.select(F.col("doc_id").cast("long"), "text")
    kinds = {"doc_id": pa.int64(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(),
             "doc_tokens": pa.int64()} | ({"ids": pa.list_(pa.uint32())} if keep_ids else {})

    @lean
    def task(batches):
        # Loading takes a fifth of a second; a worker that kept it would hold it during other work.
        yield from cut(WordIds(vocabulary(name)), batches)

    def cut(own, batches):
        for batch in batches:
            docs = batch["doc_id"].to_pylist()
            for first, ids, at in own.texts(batch["text"]):
                made: list[tuple] = []
                ids = np.insert(ids, at[1:], np.uint32(END_ID)).astype("<u4", copy=False)
                at = (at + np.arange(len(at))).tolist()
                for doc, start, stop in zip(docs[first:], at, at[1:]):
                    for a in range(start, stop, window):
                        piece = ids[a:min(a + window, stop)]
                        row = (doc, a - start, len(piece), zlib.crc32(piece), stop - start)
                        made.append((*row, piece) if keep_ids else row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), k) for c, k in zip(zip(*made), kinds.values())], names=list(kinds))

    schema = PIECE + (", ids array<long>" if keep_ids else "")
    if keep_ids:
        kinds["ids"] = pa.list_(pa.int64())
    return rows.mapInArrow(task, schema)


def fill(counts: dict[int, int], window: int) -> dict[int, int]:
    """How often to take each length so that the sum comes closest to the window.

    The longest length is always taken. Bit s of a set says that a sum of s can be reached with
    the lengths so far; a length's copies are added in doublings. Walking back over the
    sets from the highest bit gives the number of each length.
    """
    lengths = sorted((n for n, c in counts.items() if c), reverse=True)
    longest = lengths[0]
    room = window - longest
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for n in lengths:
        have = min(counts[n] - (n == longest), room // n)
        step = 1
        while have > 0 and not reach >> room & 1:
            take = min(step, have)
            steps.append((n, take, reach))
            reach = (reach | reach << n * take) & mask
            have -= take
            step *= 2
        if reach >> room & 1:
            break
    taken, left = {longest: 1}, reach.bit_length() - 1
    for n, take, before in reversed(steps):
        if not before >> left & 1:
            taken[n] = taken.get(n, 0) + take
            left -= n * take
    return taken


def plan(counts: dict[int, int], window: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, ranks, a window's share, first window, offset).

    A filling is used for as many windows as its lengths last, so the work hangs on
    the number of different lengths and not on that of documents.
    """
    left, used, rows, window_id = dict(counts), dict.fromkeys(counts, 0), [], 0
    while left:
        taken = fill(left, window)
        times = min(left[n] // k for n, k in taken.items())
        offset = 0
        for n, k in sorted(taken.items(), reverse=True):
            rows.append((n, used[n], times * k, k, window_id, offset))
            used[n] += times * k
            left[n] -= times * k
            offset += n * k
            if not left[n]:
                del left[n]
        window_id += times
    return rows


def pack(cut: DataFrame, window: int = WINDOW) -> DataFrame:
    """Adds sequence_id and offset to pieces of at most ``window`` ids.

    The driver sees only the histogram of lengths, at most ``window`` rows. A piece's rank among
    those of its length leads to its place; ranks are counted in blocks of a thousandth of all
    rows, within limits, so a length that most pieces have is spread over tasks. A sequence holds each
    place once and has no gap from offset 0 on.
    """
    spark = cut.sparkSession
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places = plan(histogram, window)
    rows = min(max(sum(histogram.values()) // BLOCKS, LEAST_ROWS_A_BLOCK), MOST_ROWS_A_BLOCK)
    blocks = spark.createDataFrame(
        [(n, -(-c // rows)) for n, c in histogram.items()], "length long, blocks long")
    dealt = cut.join(F.broadcast(blocks), "length").withColumn(
        "block", F.pmod(F.xxhash64("doc_id", "start"), F.col("blocks"))).drop("blocks")
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("length", "block").agg(F.count("*").alias("n")).select(
        "length", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("below"))
    own = Window.partitionBy("length", "block").orderBy("doc_id", "start", "ids_crc32")
    ranked = dealt.withColumn("rank", F.row_number().over(own).cast("long") - 1).join(
        starts, ["length", "block"]).withColumn("rank", F.col("rank") + F.col("below")).drop("below", "block")
    table = np.array(sorted(places), np.int64).reshape(-1, 6)
    held = spark.sparkContext.broadcast(table)
    kept = cut.columns
    names = [*kept, "sequence_id", "offset"]

    @lean
    def task(batches):
        place = held.value
        keys = (place[:, 0] << 44) + place[:, 1]
        for batch in batches:
            length, rank = batch["length"].to_numpy(), batch["rank"].to_numpy()
            at = place[np.searchsorted(keys, (length << 44) + rank, "right") - 1]
            nth = rank - at[:, 1]
            columns = {c: batch[c] for c in kept}
            columns["sequence_id"] = pa.array(at[:, 4] + nth // at[:, 3])
            columns["offset"] = pa.array(at[:, 5] + nth % at[:, 3] * length)
            yield pa.RecordBatch.from_pydict(columns)

    schema = ", ".join(f"`{c}` {k}" for c, k in cut.dtypes) + ", sequence_id long, offset long"
    return ranked.mapInArrow(task, schema).select(names)


def packed(documents: DataFrame, name: str = "word_bpe_49k.json", window: int = WINDOW,
           keep_ids: bool = False) -> DataFrame:
    """Documents as pieces of sequences of at most ``window`` ids with little padding.

    One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset,
    and ids if asked for. Null text is empty and still has its end id; a repeated or null
    doc_id is a document of its own; other columns are ignored; no documents give no rows.
    """
    return pack(stored(pieces(documents, name, window, keep_ids), "pieces"), window)
