"""One key holds a third of all rows, with copies: results stay whole and exact."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from signalgrid.operators import arcs, freshness, keyed, keywords, pressure, ranking, timeline
from signalgrid.session import local_table

N = 6000


@pytest.fixture(scope="module")
def skewed(spark):
    i = F.col("id")
    return spark.range(N).select(
        "id", F.when(i % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), i % 997)).alias("key"),
        F.pmod(F.xxhash64("id"), F.lit(50)).alias("count"),
        (F.pmod(F.xxhash64("id"), F.lit(7)) / 7.0).alias("severity"),
        F.timestamp_seconds(1704067200 + F.pmod(i * 7919, F.lit(100000))).alias("at"),
        (i % 4 != 0).alias("ok")).repartition(16)


@pytest.fixture(scope="module")
def rows(skewed):
    return skewed.collect()


def test_top_k(skewed, rows):
    order = [F.desc("severity"), F.asc("id")]
    wanted = defaultdict(list)
    for r in sorted(rows, key=lambda r: (-r.severity, r.id)):
        if len(wanted[r.key]) < 9:
            wanted[r.key].append(r.id)
    for spread in (None, ["id"]):
        got = defaultdict(list)
        best = ranking.top_k_per_group(skewed, ["key"], order, 9, spread=spread)
        for r in sorted(best.collect(), key=lambda r: r["rank"]):
            got[r.key].append(r.id)
        assert got == wanted


def test_hottest_takes_the_first_of_many_ties(skewed, rows):
    got = {r.key: r.id for r in ranking.hottest(
        skewed, ["key"], ["id"], [-F.col("id")]).collect()}
    wanted = {}
    for r in sorted(rows, key=lambda r: (-r.severity, r.id)):
        wanted.setdefault(r.key, r.id)
    assert got == wanted


def test_tally(skewed, rows):
    got = {r.key: (r.events, round(r.severity_sum, 6))
           for r in pressure.tally(skewed, ["key"]).collect()}
    counts, sums = Counter(), Counter()
    for r in rows:
        counts[r.key] += 1
        sums[r.key] += r.severity
    assert got == {k: (counts[k], round(sums[k], 6)) for k in counts}
    assert counts["hot"] == N // 3


def test_insert_if_absent(spark, skewed, rows):
    existing = local_table(spark, [("k1",), ("k2",), ("elsewhere",)], "key string")
    added = keyed.insert_if_absent(existing, skewed, "key", ["severity", "id"])
    wanted = {}
    for r in sorted(rows, key=lambda r: (r.severity, r.id)):
        wanted.setdefault(r.key, r.id)
    got = {r.key: r.id for r in added.collect()}
    assert got == {k: v for k, v in wanted.items() if k not in ("k1", "k2")}


def test_grouping_stays_ahead_of_the_key_lookup(spark, skewed, capsys):
    added = keyed.insert_if_absent(
        local_table(spark, [("k1",)], "key string"), skewed, "key", ["id"])
    added.explain()
    text = capsys.readouterr().out
    assert text.index("Join") < text.index("partial_min_by")


def test_last_known_good(skewed, rows):
    got = {r.id: r.last_good for r in freshness.last_known_good(
        skewed, "key", "at", F.col("ok")).collect()}
    good = defaultdict(list)
    for r in rows:
        if r.ok:
            good[r.key].append(r["at"])
    assert len(got) == N
    for r in rows:
        earlier = [t for t in good[r.key] if t <= r["at"]]
        assert got[r.id] == (max(earlier) if earlier else None)


def test_timeline(skewed, rows):
    series = timeline.timeline(skewed, "at", "key", "severity").collect()
    assert sum(r["count"] for r in series) == N
    wanted = Counter((r["at"].date(), r.key) for r in rows)
    assert {(r.t.date(), r.subject): r["count"] for r in series} == dict(wanted)


def test_dictionary_with_a_word_in_every_text(spark):
    texts = spark.range(300).select(
        "id", F.concat(F.repeat(F.lit("the "), 500), F.when(F.col("id") % 3 == 0, F.lit("Kyiv!")),
                       F.lit("")).alias("a"),
        F.concat(F.repeat(F.lit("The "), 500), F.when(F.col("id") % 3 == 0, F.lit("kyiv"))
                 .otherwise(F.lit("é"))).alias("text"))
    words = local_table(
        spark, [("UA", 0, "kyiv"), ("XX", 1, "the")], "code string, priority int, word string")
    got = keywords.attribute_dictionary(texts, F.col("text"), "id", words)
    assert Counter(r.code for r in got.collect()) == {"UA": 100, "XX": 200}


def test_dictionary_keeps_every_text_and_finds_phrases(spark):
    rows = [(1, "The Tel Aviv port"), (2, "Tel, Aviv"), (3, "tel  aviv"), (4, None), (5, ""),
            (6, "Kyiv and tel aviv"), (7, "xtel aviv"), (8, "TelAviv")]
    texts = local_table(spark, rows, "id int, text string")
    words = local_table(
        spark, [("UA", 1, "kyiv"), ("IL", 0, "tel aviv")], "code string, priority int, word string")
    got = {r.id: r.code for r in keywords.attribute_dictionary(texts, F.col("text"), "id", words).collect()}
    assert got == {1: "IL", 2: None, 3: None, 4: None, 5: None, 6: "IL", 7: None, 8: None}


def test_arcs_do_not_multiply(spark, skewed):
    hot = ranking.hottest(
        skewed.select(F.lit("t").alias("theater"), F.lit("IR").alias("code"), "id", "severity",
                      F.lit(50.0).alias("lon"), F.lit(30.0).alias("lat")),
        ["theater", "code"], ["lon", "lat"], [-F.col("id")])
    pairs = local_table(
        spark, [("t", 0, "IR", "IL", "Iran", "Israel", 51.0, 35.0, 35.0, 31.0)],
        "theater string, position int, code string, adversary string, name string, "
        "adversary_name string, capital_lon double, capital_lat double, to_lon double, "
        "to_lat double")
    assert arcs.tension_arcs(pairs, hot).count() == 1
