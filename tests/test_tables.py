"""Published versions and bucketed tables."""

import pytest
from pyspark.sql import functions as F

from signalgrid.operators import keyed
from signalgrid.session import local_table
from signalgrid.sources import sinks

SCHEMA = "theater string, status string"


def document(spark, *rows):
    return local_table(spark, rows, SCHEMA)


def now(spark, path, **which):
    return {r.theater: r.status for r in sinks.read_published(spark, path, SCHEMA, **which).collect()}


def test_a_failed_rewrite_leaves_the_old_document(spark, tmp_path):
    path = str(tmp_path / "p")
    with pytest.raises(ValueError, match="nothing"):
        sinks.read_published(spark, path, SCHEMA)
    assert sinks.publish(document(spark, ("a", "ok"), ("b", "ok")), path, "theater") == 1
    reader = sinks.read_published(spark, path, SCHEMA)
    bad = document(spark, ("a", "new"), ("b", "new")).withColumn(
        "status", F.when(F.col("theater") == "b", F.raise_error(F.lit("lost"))).otherwise(F.col("status")))
    with pytest.raises(Exception, match="lost"):
        sinks.publish(bad, path, "theater")
    assert now(spark, path) == {"a": "ok", "b": "ok"}
    # A rewrite does not take away what a reader has begun to read.
    assert sinks.publish(document(spark, ("a", "late")), path, "theater") == 2
    assert {r.theater for r in reader.collect()} == {"a", "b"}
    assert now(spark, path) == {"a": "late"} and now(spark, path, number=1) == {"a": "ok", "b": "ok"}


def test_versions_that_nothing_names_are_pruned(spark, tmp_path):
    path = str(tmp_path / "p")
    for status in ("1", "2", "3"):
        sinks.publish(document(spark, ("a", status)), path, "theater")
    sinks.write_payload(document(spark, ("a", "half")), f"{path}/versions/unnamed", "theater")
    assert len(sinks.prune_versions(spark, path)) == 2
    assert now(spark, path) == {"a": "3"} and now(spark, path, number=2) == {"a": "2"}
    assert sinks.publish(document(spark, ("a", "4")), path, "theater") == 4


def test_another_writer_first(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "p")
    sinks.publish(document(spark, ("a", "1")), path, "theater")
    monkeypatch.setattr(sinks, "_numbers", lambda *args: [])
    assert sinks.publish(document(spark, ("a", "2")), path, "theater") == 2


@pytest.fixture
def profiles(spark):
    spark.sql("DROP TABLE IF EXISTS profiles_test")
    keyed.store_keyed(spark.range(0, 2000, 2).selectExpr("id", "'old' AS role"), "profiles_test", "id", 4)
    yield "profiles_test"
    spark.sql("DROP TABLE IF EXISTS profiles_test")


def test_keys_on_file_are_not_shuffled(spark, profiles, capsys):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        incoming = spark.range(0, 3000).selectExpr("id", "id AS n", "'new' AS role")
        keyed.insert_if_absent(spark.table(profiles), incoming, "id", ["n"]).explain("formatted")
        text = capsys.readouterr().out
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Bucketed: true" in text and "SelectedBucketsCount: 4 out of 4" in text
    # One shuffle, of what comes in.
    assert text.split("===== Subqueries")[0].count("\nExchange") + text.count(") Exchange\n") <= 1


def test_appending_is_idempotent(spark, profiles):
    incoming = local_table(spark, [(1, "x"), (1, "a"), (2, "never"), (None, "never")], "id bigint, role string")
    for _ in range(2):
        keyed.append_if_absent(spark, profiles, incoming, "id", ["role"], 4)
    rows = spark.table(profiles)
    assert rows.count() == 1001
    assert [r.role for r in rows.filter("id IN (1, 2)").orderBy("id").collect()] == ["a", "old"]
