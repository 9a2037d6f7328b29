"""Freshness, keyed tables, fallback rows and timelines."""

import random

import pytest
from pyspark.sql import functions as F

from signalgrid import dims
from signalgrid.operators import freshness, keyed, merge, timeline
from signalgrid.session import local_table

LOG = "key string, id int, at string, ok boolean, n_rows int"


def fetch_log(spark, rows):
    return local_table(spark, rows, LOG).withColumn("at", F.col("at").cast("timestamp"))


def at(seconds):
    return f"2024-01-01 00:{seconds // 60:02d}:{seconds % 60:02d}"


def moment(seconds):
    return F.lit(at(seconds)).cast("timestamp")


def status(spark, log, seconds, **options):
    state = freshness.feed_state(
        log, ["key"], "at", F.col("ok"), "n_rows", moment(seconds), 60, ["id"], **options)
    return {r.key: (r.status, r.last_ok and (r.last_ok.minute * 60 + r.last_ok.second))
            for r in state.collect()}


def test_status_follows_the_last_good_answer(spark):
    log = fetch_log(spark, [
        ("a", 1, at(0), True, 5), ("a", 2, at(61), False, 0),
        ("b", 3, at(0), False, 0),
        ("c", 4, at(0), True, 5), ("c", 5, at(10), True, 0)])
    assert status(spark, log, 60) == {"a": ("ok", 0), "b": ("offline", None), "c": ("offline", 10)}
    assert status(spark, log, 61)["a"] == ("degraded", 0)
    assert status(spark, log, 61, otherwise="degraded")["b"] == ("degraded", None)


def test_freshness_bound_is_inclusive(spark):
    log = fetch_log(spark, [("a", 1, at(0), True, 5), ("b", 2, at(0), False, 0)])
    for seconds, wanted in ((60, True), (61, False)):
        rows = freshness.freshness(log, "key", "at", F.col("ok"), moment(seconds), 60).collect()
        assert {r.key: r.fresh for r in rows} == {"a": wanted, "b": False}


@pytest.mark.parametrize("bucket", ["minute", "hour", "day"])
def test_last_known_good_equals_brute_force(spark, bucket):
    pick = random.Random(7)
    rows = [(pick.choice("abc") if pick.random() < 0.5 else "hot", i,
             at(pick.randrange(3600)), pick.random() < 0.3, 1) for i in range(600)]
    served = freshness.last_known_good(fetch_log(spark, rows), "key", "at", F.col("ok"), bucket)
    got = {r.id: r.last_good and r.last_good.strftime("%H:%M:%S") for r in served.collect()}
    assert len(got) == len(rows)
    for key, i, when, _, _ in rows:
        good = [w for k, _, w, ok, _ in rows if k == key and ok and w <= when]
        assert got[i] == (max(good)[-8:] if good else None)


def test_fetches_without_a_time_are_kept(spark):
    log = fetch_log(spark, [("a", 1, None, True, 1), ("a", 2, at(5), True, 1)])
    served = freshness.last_known_good(log, "key", "at", F.col("ok")).collect()
    assert {r.id: r.last_good is None for r in served} == {1: True, 2: False}


def test_missing_keys(spark):
    expected = local_table(spark, [("a", 1), ("a", 2), ("b", 1)], "k string, d int")
    arrived = local_table(spark, [("a", 1), ("a", 1), ("c", 9)], "k string, d int")
    rows = freshness.missing_keys(expected, arrived, ["k", "d"]).collect()
    assert sorted(map(tuple, rows)) == [("a", 2), ("b", 1)]


def test_insert_if_absent_is_idempotent(spark):
    schema = "id int, seq int, role string"
    existing = local_table(spark, [(1, 0, "admin"), (2, 0, "viewer")], schema)
    incoming = local_table(
        spark, [(2, 1, "x"), (3, 3, "late"), (3, 2, None)], schema)
    ready = keyed.apply_defaults(incoming, {"role": F.lit("viewer")})
    added = keyed.insert_if_absent(existing, ready, "id", ["seq"])
    assert [tuple(r) for r in added.collect()] == [(3, 2, "viewer")]
    again = keyed.insert_if_absent(existing.unionByName(added), ready, "id", ["seq"])
    assert again.count() == 0


def test_domain_check_names_the_first_broken_rule(spark):
    rows = local_table(
        spark, [(1, "viewer", "a@x"), (2, "boss", "a@x"), (3, None, None), (4, None, "a@x")],
        "id int, role string, email string")
    checked = keyed.check_domain(rows, [
        ("email", F.col("email").isNotNull()),
        ("role", F.col("role").isin("viewer", "analyst", "admin"))])
    assert {r.id: r.reason for r in checked.collect()} == {1: None, 2: "role", 3: "email", 4: "role"}
    accepted, rejected = keyed.split_by_reason(checked)
    assert ([r.id for r in accepted.collect()], rejected.count()) == ([1], 3)


@pytest.mark.parametrize("fill", [merge.with_fallback, merge.with_fallback_capped])
def test_fallback_only_for_silent_theaters(spark, fill):
    live = local_table(
        spark, [("global", "x1", 50.0, 30.0)], "theater string, id string, lat double, lon double")
    rows = fill(
        live, merge.seed_signals(spark), dims.dim_theater(spark), "theater").collect()
    count = {}
    for r in rows:
        count.setdefault((r.theater, r.live), []).append(r.id)
    assert {k: len(v) for k, v in count.items()} == {
        ("global", True): 1, ("middle-east", False): 22, ("eastern-europe", False): 22}


def test_union_keeps_equal_rows(spark):
    one = local_table(spark, [(1, "a")], "i int, s string")
    other = one.select("s", "i")
    assert merge.union_sources(one, other, one).count() == 3


def test_timeline_shares_sum_to_one(spark):
    rows = local_table(
        spark, [("2024-01-01 01:00:00", "a", 1.0), ("2024-01-01 23:59:59", "b", 2.0),
                ("2024-01-01 05:00:00", "b", 4.0), ("2024-01-02 00:00:00", "a", 8.0)],
        "t string, s string, tone double").withColumn("t", F.col("t").cast("timestamp"))
    series = timeline.timeline(rows, "t", "s", "tone").orderBy("t", "subject").collect()
    assert [(r.t.day, r.subject, r["count"], r.tone) for r in series] == [
        (1, "a", 1, 1.0), (1, "b", 2, 3.0), (2, "a", 1, 8.0)]
    assert [r.volume for r in series] == pytest.approx([1 / 3, 2 / 3, 1.0])
