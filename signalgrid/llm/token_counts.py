"""Exact token counts at every prefix of a text, by dynamic programming over byte-pair merges."""

from __future__ import annotations

import functools
import json
import sys
from array import array

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from signalgrid.llm.common import lean

LIMIT = 1_024
CACHED = 500_000
LONGEST_CACHED = 48

_PIECES = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_BLANKS = regex.compile(r" (?=\s)")
_RUN = regex.compile(r"\s+")


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: itself if it shows, else one from U+0100 on."""
    shows = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shows)]
    place = {b: chr(b) for b in shows} | {b: chr(0x100 + i) for i, b in enumerate(hidden)}
    return [place[b] for b in range(256)]


class PrefixCounter:
    """Counts of one vocabulary.

    In byte-pair encoding a token sequence is the encoding of its bytes exactly if each
    two neighbours are the encoding of theirs. So the last token at each byte of a piece is the
    only one that ends there and goes with the last token where it begins; the count is one more
    than there. Pieces are what the vocabulary's pattern cuts a text into; no merge crosses them.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        back = {letter: b for b, letter in enumerate(byte_letters())}

        def raw(token: str) -> bytes:
            return bytes(back[c] for c in token)

        vocab = spec["model"]["vocab"]
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.ids = {raw(t): i for t, i in vocab.items() if t not in self.special}
        self.tokens = ahocorasick.Automaton()
        for token, i in self.ids.items():
            self.tokens.add_word(token.decode("latin-1"), (len(token), i))
        self.tokens.make_automaton()
        self.order: dict[tuple[int, int], int] = {}  # when two tokens merge
        self.parts: dict[int, tuple[int, int]] = {}
        self.when: dict[int, int] = {i: -1 for t, i in self.ids.items() if len(t) == 1}
        for k, (left, right) in enumerate(spec["model"]["merges"]):
            a, b, both = vocab[left], vocab[right], vocab[left + right]
            self.order[a, b] = k
            self.parts.setdefault(both, (a, b))
            self.when.setdefault(both, k)
        self.split = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.fits: dict[tuple[int, int], bool] = {}
        self.pieces: dict[str, bytes] = {}
        self.chunks: dict[str, int] = {}

    def forget(self) -> None:
        """Give back what a task has learned of pieces; Python workers live on with other work."""
        self.pieces, self.chunks = {}, {}

    def neighbours(self, a: int, b: int) -> bool:
        """Whether merging the bytes of a and b leaves the border between them.

        Undo merges, the latest first, on either side of the border: at any time the two
        tokens at it must not merge before those that are still to be made there.
        """
        left, right, before, ok = a, b, sys.maxsize, True
        while True:
            k = self.order.get((left, right))
            # Of merges at equal rank, the one further left goes first.
            if k is not None and k < before:
                ok = False
                break
            wl, wr = self.when[left], self.when[right]
            if wl < 0 and wr < 0:
                break
            if wl > wr:
                before, left = wl, self.parts[left][1]
            else:
                before, right = wr + 1, self.parts[right][0]
        if len(self.fits) > CACHED:
            self.fits.clear()
        self.fits[a, b] = ok
        return ok

    def piece(self, text: str) -> np.ndarray | bytes:
        """Counts at each byte of a piece, from the first byte on."""
        known = self.pieces.get(text)
        if known is not None:
            return known
        data = text.encode()
        n = len(data)
        fits = self.fits.get
        if n > LONGEST_CACHED:
            last, count = array("i", bytes(4 * n + 4)), array("i", bytes(4 * n + 4))
        else:
            last, count = [0] * (n + 1), [0] * (n + 1)
        # All tokens that end at each byte, found in one pass of the automaton.
        for place, (size, token) in self.tokens.iter(data.decode("latin-1")):
            end = place + 1
            if count[end]:
                continue
            begin = end - size
            if begin:
                ok = fits((last[begin], token))
                if not ok and (ok is False or not self.neighbours(last[begin], token)):
                    continue
            last[end], count[end] = token, count[begin] + 1
        if n > LONGEST_CACHED:
            return np.frombuffer(count, np.int32)[1:]
        out = bytes(count[1:])
        if len(self.pieces) >= CACHED // 2:
            self.pieces.clear()
        self.pieces[text] = out
        return out

    def plain(self, text: str) -> int:
        """Count of a text without special strings."""
        return sum(int(self.piece(p)[-1]) for p in _PIECES.findall(text))

    def count(self, text: str) -> int:
        """Count of a whole text; special strings in it are one token each."""
        if self.split is not None and any(s in text for s in self.special):
            parts = self.split.split(text)
            return sum(map(self.segment, parts)) + len(parts) - 1
        return self.segment(text)

    def segment(self, text: str) -> int:
        """A blank before a character that is not blank begins a piece, so runs between such
        blanks are counted once and looked up after that."""
        if _BLANKS.search(text):
            return self.plain(text)
        head, *rest = text.split(" ")
        total = self.plain(head)
        chunks = self.chunks
        try:
            return total + sum(map(chunks.__getitem__, rest))
        except KeyError:
            if len(chunks) >= CACHED:
                chunks.clear()
        for c in rest:
            n = chunks.get(c)
            if n is None:
                n = self.plain(" " + c)
                if len(c) <= LONGEST_CACHED:
                    chunks[c] = n
            total += n
        return total

    def prefixes(self, text: str) -> np.ndarray:
        """Count of each prefix: entry k is that of the first k characters, in time linear in the text.

        No prefix is encoded anew: each entry is read from the counts of the piece that it cuts.
        """
        out = np.zeros(len(text) + 1, np.uint32)
        at = 0
        marks = list(self.split.finditer(text)) if self.split is not None else []
        for mark in marks:
            # A part of a special string is plain text yet; the whole of it is one token.
            self._prefixes(text[at:mark.end() - 1], out[at:mark.end()])
            out[mark.end()] = out[mark.start()] + 1
            at = mark.end()
        self._prefixes(text[at:], out[at:])
        return out

    def _prefixes(self, text: str, out: np.ndarray) -> None:
        """Fill the counts behind the first, which is there already.

        A cut piece is a piece as well, with two exceptions. A run of blanks gives its last one away
        only to what follows, so a prefix that ends in the run has all of it as one piece. And what is
        left of a contraction, a mark and one letter, is two pieces.
        """
        done, told = int(out[0]), 0  # count of the whole pieces so far; entries up to here are known
        for m in _PIECES.finditer(text):
            begin, end = m.span()
            run = _RUN.match(text, begin)
            if run and run.end() >= end and begin >= told:
                stop = run.end()
                counts = self.ends(run[0])
                out[begin + 1:stop + 1] = done + counts
                told = stop
                done += int(counts[end - begin - 1])
                continue
            piece = m[0]
            counts = self.ends(piece)
            fresh = max(begin, told)
            out[fresh + 1:end + 1] = done + counts[fresh - begin:]
            if piece[0] == "'" and len(piece) == 3 and piece[1].isalpha():
                out[begin + 2] = done + self.plain(piece[:2])
            done += int(counts[-1])
            told = max(told, end)

    def ends(self, text: str) -> np.ndarray:
        """Counts of a piece at the end of each of its characters."""
        counts = self.piece(text)
        counts = np.frombuffer(counts, np.uint8) if isinstance(counts, bytes) else counts
        if len(counts) == len(text):
            return counts.astype(np.int64)
        data = np.frombuffer(text.encode(), np.uint8)
        last = np.append((data[1:] & 0xC0) != 0x80, True)  # the next byte begins a character
        return counts[last].astype(np.int64)

    def longest_prefix(self, text: str, budget: int) -> str:
        """The longest prefix of at most ``budget`` tokens; empty if the budget is not positive."""
        if budget <= 0:
            return ""
        return text[:int(np.flatnonzero(self.prefixes(text) <= budget)[-1])]


@functools.cache
def counter(path: str) -> PrefixCounter:
    """One counter a Python worker and vocabulary."""
    return PrefixCounter(path)


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def token_counts(documents: DataFrame, name: str = "byte_bpe_50k.json", limit: int = LIMIT,
                 prefixes: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of each whole text; null text is empty.

    With ``prefixes`` also ``prefix_counts``, the count at every prefix, from which any cut
    or budget is answered by look-up. Rows are counted one by one, repeated ones as well;
    other columns are ignored. There is no shuffle.
    """
    rows = documents.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    more = ", prefix_counts array<int>" if prefixes else ""

    @lean
    def task(batches):
        own = counter(vocabulary(name))
        try:
            yield from counted(own, batches)
        finally:
            own.forget()

    def counted(own, batches):
        for batch in batches:
            texts = batch["text"].to_pylist()
            n = [own.count(t) for t in texts]
            columns = {
                "doc_id": batch["doc_id"],
                "n_bytes": pa.compute.binary_length(batch["text"]).cast(pa.int64()),
                "n_tokens": pa.array(n, pa.int64()),
                "over_limit": pa.array([x > limit for x in n], pa.bool_())}
            if prefixes:
                columns["prefix_counts"] = pa.array([own.prefixes(t).astype(np.int32) for t in texts], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(columns)

    return rows.mapInArrow(task, "doc_id long, n_bytes long, n_tokens long, over_limit boolean" + more)


def truncated(documents: DataFrame, budget: int, name: str = "byte_bpe_50k.json") -> DataFrame:
    """doc_id and the longest prefix of each text within ``budget`` tokens; null text is empty.

    A budget of zero or less leaves empty texts. Rows are cut one by one, repeated ones as well.
    """
    rows = documents.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))

    @lean
    def task(batches):
        own = counter(vocabulary(name))
        try:
            for batch in batches:
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"], pa.array([own.longest_prefix(t, budget) for t in batch["text"].to_pylist()], pa.string())],
                    names=["doc_id", "text"])
        finally:
            own.forget()

    return rows.mapInArrow(task, "doc_id long, text string")
