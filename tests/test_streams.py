import json

import pytest
from pyspark.sql import functions as F

from signalgrid.operators import freshness
from signalgrid.schemas import GEO_DOCUMENT
from signalgrid.sources import feeds
from signalgrid.streaming import ingest, views

SCHEMA = "id bigint, at timestamp, subject string, ok boolean, tone double"


def rows(spark, first, last):
    """Ten records per hour for subjects of uneven size."""
    i = F.col("id")
    return spark.range(first, last).select(
        "id", F.timestamp_seconds(1704067200 + i * 360).alias("at"),
        F.when(i % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), i % 7)).alias("subject"),
        (i % 5 != 0).alias("ok"), (i % 11).cast("double").alias("tone"))


@pytest.fixture
def landing(spark, tmp_path):
    """A folder to which polls add files; polls overlap as look-backs do."""
    folder = str(tmp_path / "landing")

    def poll(first, last):
        rows(spark, first, last).coalesce(2).write.mode("append").parquet(folder)

    return folder, poll


def test_repeats_are_dropped_across_restarts(spark, tmp_path, landing):
    folder, poll = landing
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    for first, last in ((0, 300), (200, 500), (450, 600)):
        poll(first, last)
        stream = ingest.file_stream(spark, folder, SCHEMA, files_per_trigger=1)
        unique = ingest.unique_within(stream, ["id"], "at", "30 days")
        ingest.start_append(unique, out, state).awaitTermination()
    table = spark.read.parquet(out)
    assert table.count() == 600
    assert table.exceptAll(rows(spark, 0, 600)).count() == 0


def test_copies_spread_over_files_are_dropped(spark, tmp_path):
    folder, out, state = (str(tmp_path / n) for n in ("landing", "out", "state"))
    for _ in range(4):
        copies = rows(spark, 0, 50).unionByName(rows(spark, 7, 8)).unionByName(rows(spark, 7, 8))
        copies.coalesce(1).write.mode("append").parquet(folder)
        stream = ingest.file_stream(spark, folder, SCHEMA, files_per_trigger=1).select(
            "*", F.col("_metadata.file_path").alias("file"))
        unique = ingest.unique_within(stream, ["id"], "at", "30 days", spread=F.col("file"))
        ingest.start_append(unique, out, state).awaitTermination()
    table = spark.read.parquet(out).drop("file")
    assert table.count() == 50
    assert table.exceptAll(rows(spark, 0, 50)).count() == 0


def test_volume_after_upsert_equals_batch(spark, tmp_path, landing):
    folder, poll = landing
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    for first, last in ((0, 333), (333, 700)):
        poll(first, last)
        stream = ingest.file_stream(spark, folder, SCHEMA, files_per_trigger=1)
        counts = views.volume_stream(stream, "at", "subject", "tone", "1 day", "30 days")
        ingest.start_upsert(counts, out, state).awaitTermination()
    got = ingest.latest(spark, out, ["t", "subject"]).select("t", "subject", "count", "tone_sum")
    wanted = rows(spark, 0, 700).groupBy(
        F.window("at", "1 day")["start"].alias("t"), "subject").agg(
        F.count("*").alias("count"), F.sum("tone").alias("tone_sum"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, wanted.collect()))


def test_failures_never_erase_the_last_success(spark, tmp_path, landing):
    folder, poll = landing
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    for first, last in ((0, 100), (100, 150)):
        poll(first, last)
        stream = ingest.file_stream(spark, folder, SCHEMA)
        fetches = views.fetch_state_stream(stream, "subject", "at", F.col("ok"))
        ingest.start_upsert(fetches, out, state).awaitTermination()
    got = {r.subject: r.last_ok for r in ingest.latest(spark, out, ["subject"]).collect()}
    as_of = F.lit("2024-01-03 00:00:00").cast("timestamp")
    wanted = freshness.freshness(rows(spark, 0, 150), "subject", "at", F.col("ok"), as_of, 60)
    assert got == {r.subject: r.last_ok for r in wanted.collect()}


def test_landing_files_become_signals_poll_by_poll(spark, tmp_path):
    files = tmp_path / "files"
    files.mkdir()
    out, aside, state = (str(tmp_path / n) for n in ("out", "aside", "state"))

    def poll(**bodies):
        for name, body in bodies.items():
            (files / f"{name}.json").write_text(body)
        ingest.start_landing(
            ingest.body_stream(spark, str(files)), GEO_DOCUMENT, feeds.geo_signals,
            out, aside, state).awaitTermination()

    def document(*names):
        return json.dumps({"features": [
            {"geometry": {"coordinates": [51.4, 35.7]}, "properties": {"name": n, "count": 1}}
            for n in names]}, indent=1)

    poll(one=document("a", "b"), bad="<html>busy</html>")
    poll(two=document("c"), cut='{"features": [')
    assert sorted(r.name for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]
    reasons = {r.origin: r.reason for r in spark.read.parquet(aside).collect()}
    place = (tmp_path / "files").as_uri()
    assert reasons == {f"{place}/bad.json": "markup", f"{place}/cut.json": "malformed"}


def test_writing_a_version_again_replaces_it(spark, tmp_path):
    out = str(tmp_path / "out")
    write = ingest._write_version(out)
    batch = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    write(batch, 0)
    write(batch, 0)
    write(spark.createDataFrame([("a", 7)], "k string, v int"), 1)
    assert spark.read.parquet(out).count() == 3
    got = ingest.latest(spark, out, ["k"]).collect()
    assert sorted(map(tuple, got)) == [("a", 7), ("b", 2)]
    ingest.compact(spark, out, ["k"], str(tmp_path / "compact"))
    table = spark.read.parquet(str(tmp_path / "compact"))
    assert sorted((r.k, r.v) for r in table.collect()) == [("a", 7), ("b", 2)]
