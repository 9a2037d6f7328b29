"""Every query against its SQL on the smallest tables, and plan checks."""

import pytest

import __spark_entry__ as spark_entry
from check_oracle import compare
from signalgrid.plans import catalog, feed_catalog

ALL = [*catalog.QUERIES, *feed_catalog.QUERIES]


@pytest.mark.parametrize("name", ALL)
def test_query_equals_sql(spark, sf_dir, name):
    good, note = compare(spark, sf_dir, name)
    assert good, note


def test_every_query_has_sql():
    assert set(ALL) <= set(spark_entry.oracle_sql())


def test_entry(spark):
    assert spark_entry.entry(spark).count() == 25


def plan(frame, capsys):
    frame.explain("formatted")
    return capsys.readouterr().out


def test_landing_ids_write_in_the_input_partitions(spark, sf_dir, monkeypatch, tmp_path):
    bodies = catalog._geo_bodies
    monkeypatch.setattr(catalog, "_geo_bodies", lambda *args: bodies(*args).repartition(8, "body"))
    monkeypatch.setattr(catalog, "work_folder", lambda *args: str(tmp_path / "bodies"))
    row = catalog.landing_ids(spark, sf_dir).first()
    names = [{f.name for f in (tmp_path / "bodies" / f"half={h}").glob("part-*")} for h in (0, 1)]
    assert row.signals == row.ids > 0
    assert len(names[0] | names[1]) > 2 and names[0] & names[1]


ROW_WISE = ["severity_share", "severity_log", "bbox_clip", "geofence", "keyword_attribution",
            "url_domain", "compact_ts", "tone_gauge", "domain_check", "lookback"]


@pytest.mark.parametrize("name", ROW_WISE)
def test_row_wise_queries_do_not_shuffle(spark, sf_dir, capsys, name):
    text = plan(spark_entry.queries()[name](spark, sf_dir), capsys)
    main = text.split("===== Subqueries =====")[0]
    assert "Exchange" not in main
    assert "NestedLoop" not in text and "Cartesian" not in text


@pytest.mark.parametrize("name", ALL)
def test_no_query_crosses_or_uses_python(spark, sf_dir, capsys, name):
    text = plan(spark_entry.queries()[name](spark, sf_dir), capsys)
    for banned in ("NestedLoop", "Cartesian", "ArrowEvalPython", "BatchEvalPython", "MapInPandas"):
        assert banned not in text


def test_filters_and_columns_reach_the_scan(spark, sf_dir, capsys):
    text = plan(catalog.lookback(spark, sf_dir), capsys)
    assert "GreaterThanOrEqual(ts," in text
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,event_type:string>" in text
    text = plan(catalog.conflict_lookback(spark, sf_dir), capsys)
    assert "GreaterThanOrEqual(o_orderdate,2001-07-01T00:00)" in text
    assert "EqualTo(o_orderstatus,O)" in text


def test_top_k_is_cut_before_the_shuffle(spark, sf_dir, capsys):
    assert "WindowGroupLimit" in plan(catalog.top_signals(spark, sf_dir), capsys)
    assert "TakeOrderedAndProject" in plan(catalog.strongest_signals(spark, sf_dir), capsys)
