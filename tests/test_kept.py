"""Answers kept up to date batch by batch, against their batch forms and brute force."""

import datetime as dt
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from signalgrid import dims
from signalgrid.operators import freshness, pressure, ranking
from signalgrid.session import local_table
from signalgrid.streaming import feeds as streams, ingest, parts

SIGNALS = ("id string, theaters array<string>, source string, count bigint, told bigint, severity double, code string, "
           "nation string, source_rank int, subject_priority int, pos bigint, observed_at timestamp")


def signals(spark, first, last, scale=1):
    pick = random.Random(first)
    rows = []
    for i in range(first, last):
        geo = pick.random() < 0.7
        count = pick.randrange(-2, 40) * scale
        rows.append((f"s{i}", pick.sample(["global", "middle-east", "eastern-europe"], pick.randrange(3)),
                     "gdelt" if geo else "acled", count, count if geo else None, None if geo else pick.choice([0.45, 0.6, 0.9]),
                     pick.choice(["IR", "UA", None]), "IR", int(geo), 0, i,
                     dt.datetime(2024, 1, 1 + pick.randrange(6), pick.randrange(24))))
    return spark.createDataFrame(rows, SIGNALS)


def top_of_all(df, k):
    told = F.col("told").cast("double")
    peak = df.agg(F.coalesce(F.max(F.when(told > 0, told)), F.lit(1.0)).alias("p")).first().p
    scored = df.withColumn("severity", F.when(told.isNull(), F.col("severity")).otherwise(
        F.least(F.lit(1.0), F.sqrt(F.greatest(told, F.lit(0.0)) / peak))))
    best = ranking.top_k_per_group(scored.withColumn("theater", F.explode("theaters")), ["theater"], [F.desc("severity"), *map(F.asc, parts.ORDER)], k)
    return sorted((r.theater, r.rank, r.id, round(r.severity, 9)) for r in best.collect())


def test_top_and_pressure_after_every_batch(spark, tmp_path):
    folder, seen = str(tmp_path / "in"), None
    members = dims.theater_subject(spark)
    jobs = {"top": lambda rows: parts.strongest(rows, F.col("told"), 7), "pressure": parts.pressure_parts}
    # The second batch raises the peak, so severities of the first change.
    for first, last, scale in ((0, 150, 1), (150, 260, 5), (260, 300, 1), (300, 301, 0)):
        new = signals(spark, first, last, scale)
        new.coalesce(1).write.mode("append").parquet(folder)
        seen = new if seen is None else seen.unionByName(new)
        for name, make in jobs.items():
            stream = ingest.file_stream(spark, folder, SIGNALS)
            parts.start_parts(stream, make, str(tmp_path / name), str(tmp_path / f"{name}-state")).awaitTermination()
        kept = {name: parts.read_parts(spark, str(tmp_path / name)) for name in jobs}
        got = sorted((r.theater, r.rank, r.id, round(r.severity, 9)) for r in parts.strongest_now(kept["top"], 7).collect())
        assert got == top_of_all(seen, 7)
        assert scores(parts.pressure_now(kept["pressure"], members)) == scores(pressure_of(seen, members))
    # A look-back is a choice of days; days that leave it can go.
    recent = seen.filter("observed_at >= '2024-01-04' AND observed_at < '2024-01-06'")
    two = parts.read_parts(spark, str(tmp_path / "top"), "2024-01-04", "2024-01-05")
    assert sorted((r.theater, r.rank, r.id, round(r.severity, 9)) for r in parts.strongest_now(two, 7).collect()) == top_of_all(recent, 7)
    assert opened_days(two) == [("2024-01-04", "2024-01-05")]
    assert parts.drop_days(spark, str(tmp_path / "pressure"), "2024-01-04") == [f"2024-01-0{d}" for d in (1, 2, 3)]
    late = seen.filter("observed_at >= '2024-01-04'")
    assert scores(parts.pressure_now(parts.read_parts(spark, str(tmp_path / "pressure")), members)) == scores(pressure_of(late, members))
    assert parts.drop_days(spark, str(tmp_path / "nowhere"), "2024-01-04") == []


def opened_days(df):
    """First and last day to which each scan of a table's folders is cut."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    filters = re.findall(r"PartitionFilters: \[(.*?)\], PushedFilters", plan)
    return [tuple(sorted(re.findall(r"dt#\d+ [<>]= (\d{4}-\d\d-\d\d)", f))) for f in filters]


def scores(df):
    return sorted((r.theater, r.code, r.events, round(r.score, 9), r.threat) for r in df.collect())


def pressure_of(df, members):
    scored = pressure.add_share_severity(df.drop("severity"))
    placed = scored.filter("code IS NOT NULL").withColumn("theater", F.explode("theaters"))
    return pressure.pressure_index(pressure.tally(placed, ["theater", "code"]), members)


def test_a_batch_written_again_replaces_its_parts(spark, tmp_path):
    table = str(tmp_path / "t")
    rows = signals(spark, 0, 40)
    for batch, some in ((0, rows), (1, rows), (1, rows)):
        made = parts.pressure_parts(some).withColumn("batch", F.lit(batch))
        ingest.replace_folders(made, table, "dt", "batch")
    assert parts.read_parts(spark, table).count() == 2 * parts.pressure_parts(rows).count()


# Status

def statuses(log, ttl, until, second):
    """What a reader at a second sees, from the whole log."""
    mine = [(t, good) for t, good in log if t <= second]
    if not mine or second > until:
        return None
    good = [t for t, ok in mine if ok]
    return "offline" if not good else "ok" if second <= max(good) + ttl else "degraded"


def at(second):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=second)


@pytest.mark.parametrize("form", ["log", "parts"])
def test_status_intervals_against_every_second(spark, tmp_path, form):
    pick, ttl, until = random.Random(9), 60, 1500
    logs = {k: sorted((pick.randrange(1700), pick.random() < share) for _ in range(n))
            for k, share, n in (("a", 0.5, 40), ("b", 0.05, 30), ("c", 0.0, 5), ("d", 1.0, 120))}
    logs["e"] = [(0, True), (60, True), (121, True), (1500, True)]
    logs["f"] = [(1600, True)]
    logs["g"] = [(1500, True), (1500, False)]
    rows = [(k, at(t), good) for k, log in logs.items() for t, good in log] + [("a", None, True), ("a", at(3), None)]
    log = spark.createDataFrame(rows, "k string, at timestamp, good boolean")
    end = F.lit(str(at(until))).cast("timestamp")
    if form == "log":
        made = freshness.status_intervals(log, ["k"], "at", F.col("good"), ttl, end)
    else:
        for i, some in enumerate((log.filter("second(at) % 2 = 0"), log.filter("second(at) % 2 = 1"))):
            spans = parts.status_parts(some.filter(F.col("at") <= end), ["k"], "at", F.col("good"), ttl)
            ingest.replace_folders(spans.withColumn("batch", F.lit(i)), str(tmp_path / "t"), "dt", "batch")
        made = freshness.status_of_spans(parts.read_parts(spark, str(tmp_path / "t")), ["k"], ttl, end)
    got = {}
    for r in made.collect():
        got.setdefault(r.k, []).append(((r.since - at(0)).total_seconds(), (r.till - at(0)).total_seconds(), r.status))
    logs["a"] = sorted(logs["a"] + [(3, False)])
    assert "f" not in got and got["g"] == [(1500, 1500, "ok")]
    for k in "abcde":
        found = sorted(got[k])
        assert found[0][0] == logs[k][0][0] and found[-1][1] == until
        assert all(x[1] == y[0] for x, y in zip(found, found[1:]))
        for second in range(int(found[0][0]), until):
            holds = [s for a, b, s in found if a <= second < b or (s == "ok" and second == b)]
            wanted = statuses(logs[k], ttl, until, second)
            # The moment at which an answer's time is up is still ok.
            assert (holds[0] if len(holds) == 1 else "ok") == wanted, (k, second, holds)


# Repeats

RECORDS = "id bigint, at timestamp, tone double"


def records(spark, ids, day):
    return spark.createDataFrame([(i, dt.datetime(2024, 1, 1) + dt.timedelta(days=day, hours=i % 24), float(i)) for i in ids], RECORDS)


def test_sixty_days_of_overlapping_polls_without_state(spark, tmp_path):
    folder, table, state = (str(tmp_path / n) for n in ("in", "t", "state"))
    wanted, came = set(), 0
    polls = [(0, range(0, 40), 3), (1, range(20, 60), 2), (30, range(100, 140), 1), (59, range(200, 230), 4),
             (2, range(50, 70), 1), (59, range(200, 235), 2)]
    for n, (day, ids, copies) in enumerate(polls):
        # Each poll has yesterday's records again, and some records several times.
        new = records(spark, ids, day)
        for other in [records(spark, list(ids)[:3], day)] * copies:
            new = new.unionByName(other)
        new.coalesce(2).write.mode("append").parquet(folder)
        came += len(ids) + 3 * copies
        wanted |= {(i, day) for i in ids}
        ingest.start_unique(ingest.file_stream(spark, folder, RECORDS), ["id"], "at", table, state).awaitTermination()
        got = spark.read.parquet(f"{table}/rows")
        assert sorted((r.id, (r.dt - dt.date(2024, 1, 1)).days) for r in got.collect()) == sorted(wanted)
    told = {r.batch: (r.came, r.added, r.late) for r in ingest.polls(spark, table).collect()}
    assert sum(r[0] for r in told.values()) == came and sum(r[1] for r in told.values()) == len(wanted)
    assert told[4] == (23, 20, 20) and told[5] == (41, 5, 0)
    assert not list((tmp_path / "state").glob("state/*"))


def test_records_without_key_or_time(spark, tmp_path):
    folder, table, state = (str(tmp_path / n) for n in ("in", "t", "state"))
    for _ in range(2):
        spark.createDataFrame([(None, None, 1.0), (None, None, 1.0), (7, None, 2.0), (7, None, 2.0)], RECORDS).coalesce(
            1).write.mode("append").parquet(folder)
        ingest.start_unique(ingest.file_stream(spark, folder, RECORDS), ["id"], "at", table, state).awaitTermination()
    assert sorted((r.id or 0) for r in spark.read.parquet(f"{table}/rows").collect()) == [0, 0, 0, 0, 7]


# Feeds

def test_feeds_into_folders_by_source_and_day(spark, tmp_path):
    table, files = str(tmp_path / "t"), tmp_path / "files"

    def poll(feed, **folders_of):
        for name, (place, body) in folders_of.items():
            (files / feed / place).mkdir(parents=True, exist_ok=True)
            (files / feed / place / f"{name}.json").write_text(body if isinstance(body, str) else json.dumps(body))
        bodies = streams.landing_stream(spark, feed, str(files / feed))
        streams.start_feed(bodies, feed, table, str(tmp_path / f"state-{feed}"), "2024-01-20 00:00:00").awaitTermination()

    def article(title, seen=None):
        return {"url": "https://a/1", "title": title, **({"seendate": seen} if seen else {})}

    poll("articles", one=("at=2024-01-15 09:00:00", {"articles": [article("x", "20240110T000000Z"), article("y")]}))
    poll("articles", two=("at=2024-01-16 09:00:00", {"articles": [article("z", "20240115T120000Z")]}),
         bad=("at=2024-01-16 09:00:00", "<html>"), three=("other=1", {"articles": [article("w")]}))
    rows = {(r.title, str(r.seen), str(r.dt)) for r in streams.read_feed(spark, table, "articles").collect()}
    assert rows == {("x", "2024-01-10 00:00:00", "2024-01-10"), ("y", "2024-01-15 09:00:00", "2024-01-15"),
                    ("z", "2024-01-15 12:00:00", "2024-01-15"), ("w", "2024-01-20 00:00:00", "2024-01-20")}
    recent = streams.read_feed(spark, table, "articles", "2024-01-16 00:00:00", 2)
    assert {r.title for r in recent.collect()} == {"y", "z"}
    assert opened_days(recent) == [("2024-01-14", "2024-01-16")]
    assert [r.reason for r in streams.read_aside(spark, table, "articles").collect()] == ["markup"]
    series = {"timeline": [{"data": [{"date": "20240101", "value": 2}, {"value": "x"}]}]}
    poll("timelines", one=("subject=UA/metric=tone/at=2024-01-15 09%3A00%3A00", series), two=("subject=IR/metric=volume", series))
    assert {(r.subject, r.metric, r.v, str(r.dt)) for r in streams.read_feed(spark, table, "timelines").collect()} == {
        ("UA", "tone", 2.0, "2024-01-01"), ("UA", "tone", 0.0, "2024-01-15"),
        ("IR", "volume", 2.0, "2024-01-01"), ("IR", "volume", 0.0, "2024-01-20")}
    poll("geo", one=("at=2024-01-15 09:00:00", {"features": [{"geometry": {"coordinates": [51.4, 35.7]}}]}))
    assert [(r.nation, str(r.dt)) for r in streams.read_feed(spark, table, "geo").collect()] == [("IR", "2024-01-15")]
