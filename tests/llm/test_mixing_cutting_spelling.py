"""Source mixing, fill-in-middle and spelling variants against plain versions, with odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from signalgrid.llm import curriculum, fill_in_middle as fim, spelling

DOCS = "doc_id long, text string, source string, none string, name string, size string, part string, n string, word string, form string, draw_1 string"
LONG = " ".join(f"Wörter{i % 977}" for i in range(300_000))
ODD = [(1, None, "a"), (2, "", "a"), (3, " \n\t", "b"), (4, "one two", "b"), (5, LONG, "b"), (4, "one two", "b"),
       (None, "x y z", None), (None, "x y z", None), (6, "müßig x", ""), (7, "\x0b w \x0c\r", "é"), (8, "w " * 50, "\U0001f600"),
       (9, None, None)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, *["x"] * 8) for r in rows], DOCS)


# Mixing

def plain_targets(sizes, areas, budget, most):
    """Deal the budget by area; full sources drop out; what they leave is dealt again."""
    left, open_, out = budget * sum(sizes.values()), set(sizes), {}
    while open_:
        weight = sum(areas[s] for s in open_)
        full = {s for s in open_ if left * areas[s] / weight > most * sizes[s]}
        if not full:
            return {**out, **{s: left * areas[s] / weight for s in open_}}
        for s in full:
            out[s] = most * sizes[s]
            left -= out[s]
        open_ -= full
    return out


def check_mix(rows, got, schedules=curriculum.SCHEDULES, budget=1.5, most=2):
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len(re.findall("[^\x20\x09-\x0D]+", text or ""))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    areas = {s: curriculum.segments(schedules[i % len(schedules)])[-1][3] for i, s in enumerate(names)}
    wanted = plain_targets(sizes, areas, budget, most)
    assert len(got) == len(rows)
    for s in names:
        mine = [r for r in got if r.source == s]
        assert all(r.source_size == sizes[s] and r.target == pytest.approx(wanted[s], abs=1e-6) for r in mine)
        assert all(0 <= r.taken <= most * r.size and r.taken == sum(c.words for c in r.copies) for r in mine)
        assert abs(sum(r.taken for r in mine) - wanted[s]) <= 0.5 + 1e-6
        # Copies in the order of their positions stand where the schedule has asked for the words before them.
        copies = sorted(((c.position, c.words) for r in mine for c in r.copies))
        at = np.cumsum([0] + [w for _, w in copies])
        knots = schedules[names.index(s) % len(schedules)]
        x = np.linspace(0, 1, 20_001)
        rate = np.interp(x, *zip(*knots))
        area = np.r_[0, np.cumsum((rate[1:] + rate[:-1]) / 2 * np.diff(x))]
        for (position, _), done in zip(copies, at):
            assert 0 <= position <= 1
            assert np.interp(position, x, area) / area[-1] * wanted[s] == pytest.approx(done, abs=1e-3 * wanted[s] + 1e-6)


def test_mix_with_odd_rows(spark):
    got = curriculum.mixed(frame(spark, ODD)).collect()
    check_mix(ODD, got)
    assert sorted((r.doc_id or 0, r.size, r.taken) for r in got) == sorted(
        (r.doc_id or 0, r.size, r.taken) for r in curriculum.mixed(frame(spark, ODD[::-1]).repartition(5)).collect())


def test_mix_of_a_hot_source_and_uneven_ones(spark):
    rng = random.Random(3)
    rows = [(i, "w " * rng.randrange(40), rng.choice(["hot"] * 9 + ["b", "c", "d", "e", None])) for i in range(600)]
    rows += [(i, "big " * 700, "z") for i in range(600, 640)]
    check_mix(rows, curriculum.mixed(frame(spark, rows)).collect())
    schedules = (((0, 0), (0.25, 3), (0.5, 0), (1, 1)), ((0, 1), (1, 0)))
    got = curriculum.mixed(frame(spark, rows), schedules, budget=2.5, most=3).collect()
    check_mix(rows, got, schedules, 2.5, 3)
    check_mix(rows, curriculum.mixed(frame(spark, rows), budget=2.0).collect(), budget=2.0)


def test_training_order_follows_positions_and_carries_columns(spark):
    mix = curriculum.mixed(frame(spark, ODD), carry=["text", "none", "doc_id"])
    rows = curriculum.training_order(mix).collect()
    assert rows and [r.position for r in rows] == sorted(r.position for r in rows)
    assert sum(r.words for r in rows) == sum(r.taken for r in mix.collect())
    assert all(r.carried.none == "x" and r.carried.doc_id == r.doc_id for r in rows)


def test_mix_of_nothing(spark):
    assert curriculum.mixed(frame(spark, [])).count() == 0
    got = curriculum.mixed(frame(spark, [(1, "", "a"), (2, None, None)])).collect()
    assert {(r.doc_id, r.size, r.source_size, r.target, r.taken) for r in got} == {(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)}
    for bad in (((0, 1),), ((0, 1), (0.5, 1)), ((0, 0), (1, 0)), ((0, -1), (1, 2)), ((0, 1), (0, 1), (1, 1))):
        with pytest.raises(ValueError):
            curriculum.segments(bad)


def test_word_count(spark):
    rows = frame(spark, ODD).select("text", curriculum.word_count("text").alias("k")).collect()
    assert all(r.k == len(re.findall("[^\x20\x09-\x0D]+", r.text or "")) for r in rows)


def test_prefix_sums_over_parts(spark):
    rows = spark.range(1000).select((F.col("id") * 37 % 1000).alias("k")).repartition(7)
    got = curriculum.prefix_sums(rows, ["k"], {"s": F.col("k"), "i": F.lit(1)}).collect()
    assert all(r.i == r.k and r.s == r.k * (r.k - 1) // 2 for r in got) and len(got) == 1000


# Fill-in-middle

def borders(text, unit):
    if unit == "chars":
        return list(range(len(text)))
    if unit == "words":
        return [m.start() for m in re.finditer("[^\x20\x09-\x0D]+", text)]
    return [i for i in range(len(text)) if i == 0 or text[i - 1] == "\n"]


def plain_fim(doc_id, text, unit="chars"):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i:i + 8], 16) for i in (0, 8, 16, 24))
    at = borders(text, unit)
    n = len(at)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    x, y = (0 if k == 0 else len(text) if k == n else at[k] for k in (a, b))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = text[:x], text[x:y], text[y:]
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("unit", ["chars", "words", "lines"])
def test_cuts_against_plain_version(spark, unit):
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab é日😀\n\r\t .<P") for _ in range(rng.randrange(60))) for _ in range(300)]
    rows = ODD + [(100 + i, t, "s") for i, t in enumerate(texts)]
    # Longer than a chunk, with borders of chunks inside letters.
    rows += [(500 + i, ("日本 x\n" * 400_000)[i:], "s") for i in range(3)] + [(510, " " * 3_000_000, "s"), (511, "a<P>b", "s")]
    made = fim.fill_in_middle(frame(spark, rows), unit)
    got = Counter(tuple(r)[1:] for r in made.withColumn("back", fim.restored("output", "form")).select(
        "doc_id", "n", "form", "prefix_units", "middle_units", "output", "back").collect())
    assert got == Counter((*plain_fim(i, t, unit)[:4], plain_fim(i, t, unit)[4], t or "") for i, t, _ in rows)


def test_ranks_of_all_classes():
    rng = np.random.default_rng(0)
    for size in (0, 1, 7, 8, 9, 4097):
        codes = rng.integers(0, 8, size).astype(np.uint8)
        matrix = fim.WaveletMatrix(codes)
        for code in range(8):
            assert (matrix.rank(code, np.arange(size + 1)) == np.r_[0, np.cumsum(codes == code)]).all()


def test_cutting_nothing(spark):
    assert fim.fill_in_middle(frame(spark, [])).count() == 0
    with pytest.raises(ValueError):
        fim.fill_in_middle(frame(spark, []), "pages")


# Spelling

def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_variants(rows, least_length, least_count, every, factor):
    count = Counter()
    for doc_id, text, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % every == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            count[run] += 1
    words = {w: n for w, n in count.items() if len(w) >= least_length and n >= least_count}
    forms, out = {}, {}
    for w, n in words.items():
        others = [(-words[o], o) for o in words if near(w, o)]
        best = min(others, default=None)
        forms[w] = best[1] if best and -best[0] >= factor * n else None
        out[w] = (n, len(others), -best[0] if forms[w] else None)
    ends = {}
    for w in words:
        end = w
        while forms[end]:
            end = forms[end]
        ends[w] = end
    return {(w, forms[w], ends[w], *out[w]) for w in words}


def found_variants(spark, rows, *args, **more):
    got = spelling.spelling_variants(frame(spark, rows), *args, **more)
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in got.collect()}


@pytest.mark.parametrize("group_words", [4096, 5])
def test_variants_against_all_pairs(spark, monkeypatch, group_words):
    """Small groups are split down to known places; all pairs must still be found."""
    monkeypatch.setattr(spelling, "SMALLEST_LIMIT", group_words)
    rng = random.Random(6)
    base = ["".join(rng.choice("abcé") for _ in range(rng.randrange(7, 12))) for _ in range(25)]

    def edited(word):
        i, c = rng.randrange(len(word) + 1), rng.choice("abcéÀ")
        return rng.choice([word[:i] + c + word[i:], word[:i] + word[i + 1:], word[:i] + c + word[i + 1:]])

    pool = base * 12 + [edited(w) for w in base for _ in range(12)] + [edited(edited(w)) for w in base for _ in range(6)]
    pool += ["abababab", "babababab", "aaaaaaaa", "aaaaaaaaa", "aaaaaaab"] * 3
    rows = ODD + [(i, " ".join(rng.choices(pool, k=60)).title(), "s") for i in range(40)]
    rows += [(90, "x" * 5000 + " " + "x" * 4999, "s")] * 2
    for args in ((7, 2, 31, 10), (7, 1, 2, 3), (3, 1, 3, 1.5)):
        if args[0] == 7:
            assert found_variants(spark, rows, *args, group_words=group_words) == plain_variants(rows, *args)


def test_chains_ties_and_nothing(spark):
    rows = [(1, "zzzzzzz " * 2 + "zzzzzzy " * 20 + "zzzzzxy " * 200 + "kkkkkkk " * 2 + "kkkkkka kkkkkkb " * 20, "s")]
    got = {w: (f, r) for w, f, r, *_ in found_variants(spark, rows, drop_every=10**9)}
    assert got["zzzzzzz"] == ("zzzzzzy", "zzzzzxy") and got["zzzzzxy"] == (None, "zzzzzxy")
    assert got["kkkkkkk"] == ("kkkkkka", "kkkkkka")
    assert found_variants(spark, []) == set() and found_variants(spark, [(1, None, "s"), (None, "", None)]) == set()


def test_scan_of_many_groups():
    rng = random.Random(1)
    for _ in range(150):
        rows = sorted({(k, "".join(rng.choice("abé") for _ in range(rng.randrange(6)))) for k in range(4) for _ in range(rng.randrange(30))})
        if not rows:
            continue
        i, j = spelling.near_in_groups(np.array([k for k, _ in rows]), pa.array([w for _, w in rows]))
        pairs = list(zip(i.tolist(), j.tolist()))
        assert len(pairs) == len(set(pairs))
        assert set(pairs) == {(a, b) for a, (k, w) in enumerate(rows) for b, (m, x) in enumerate(rows) if k == m and near(w, x)}
