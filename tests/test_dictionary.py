"""Large dictionaries as a trie against a search for every entry in every text."""

import random
import re

import pytest
from pyspark.sql import functions as F

from signalgrid.operators import keywords
from signalgrid.session import local_table


def found(text, entries):
    hits = [p for _, p, w in entries if text and re.search(rf"(?<![A-Za-z0-9_])(?i:{re.escape(w)})(?![A-Za-z0-9_])", text, re.ASCII)]
    return min(hits, default=None)


@pytest.mark.parametrize("small", [True, False])
def test_phrases_of_any_depth(spark, monkeypatch, small):
    monkeypatch.setattr(keywords, "fits_broadcast", lambda df: small)
    pick = random.Random(4)
    vocabulary = ["new", "york", "city", "hall", "a1", "_x", "the"]
    phrases = sorted({" ".join(pick.choices(vocabulary, k=pick.randrange(1, 6))) for _ in range(40)})
    entries = [(f"c{i % 9}", i % 9, w) for i, w in enumerate(phrases)]
    breaks = [" ", " ", " ", " ", "  ", ", ", "\n", "é", "-"]
    texts = [(i, "".join(pick.choice(vocabulary + ["zz", "New", "YORK"]) + pick.choice(breaks) for _ in range(pick.randrange(12))))
             for i in range(200)]
    texts += [(200, None), (201, ""), (202, "NEW YORK"), (202, "nothing")]
    got = keywords.attribute_dictionary(
        local_table(spark, texts, "id int, text string"), F.col("text"), "id",
        local_table(spark, entries, "code string, priority int, word string")).collect()
    wanted = {}
    for i, text in texts:
        best = found(text, entries)
        old = wanted.get(i)
        wanted[i] = best if old is None else old if best is None else min(old, best)
    assert len(got) == len(wanted)
    assert {r.id: r.code for r in got} == {i: None if p is None else f"c{p}" for i, p in wanted.items()}


def test_an_empty_dictionary(spark):
    texts = local_table(spark, [(1, "a b")], "id int, text string")
    empty = local_table(spark, [], "code string, priority int, word string")
    assert [tuple(r) for r in keywords.attribute_dictionary(texts, F.col("text"), "id", empty).collect()] == [(1, None)]


def test_beginnings_shared_by_many_phrases_are_one_row(spark):
    entries = [("x", 1, f"new york {i}") for i in range(50)] + [("y", 0, "new")]
    rows = {r.prefix: (r.priority, r.deeper) for r in keywords.dictionary_trie(
        local_table(spark, entries, "code string, priority int, word string")).collect()}
    assert len(rows) == 52 and rows["new"] == (0, True) and rows["new york"] == (None, True) and rows["new york 7"] == (1, False)
