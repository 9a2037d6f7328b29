import json

import pytest
from pyspark.sql import functions as F

from signalgrid import dims, fixed_values as fv
from signalgrid.functions.clock import iso_text
from signalgrid.operators import freshness
from signalgrid.schemas import (
    ARTICLE_DOCUMENT, BOUNDARY_DOCUMENT, CONFLICT_DOCUMENT, GEO_DOCUMENT,
    REPORT_DOCUMENT, TIMELINE_DOCUMENT,
)
from signalgrid.session import local_table
from signalgrid.sources import boundaries, feeds, landing, sinks

AS_OF = "2024-02-01 00:00:00"
AS_OF_ISO = "2024-02-01T00:00:00Z"


def documents(spark, schema, *bodies, **extra):
    rows = [(f"b{i}", json.dumps(b)) for i, b in enumerate(bodies)]
    frame = local_table(spark, rows, "origin string, body string")
    parsed = landing.parse_bodies(frame, schema)
    for name, value in extra.items():
        parsed = parsed.withColumn(name, F.lit(value))
    return landing.good_documents(parsed)


def feature(coordinates=(36.2, 49.9), **properties):
    geometry = {"type": "Point", "coordinates": list(coordinates)} if coordinates else None
    return {"geometry": geometry, "properties": properties}


def test_geo_document(spark):
    docs = documents(spark, GEO_DOCUMENT, {"features": [
        feature(name="A", count=100),
        feature(None, name="no geometry", count=400),
        feature((1.0,), name="one number", count=4),
        feature(count=25),
        feature(name="no count"),
        {"geometry": {"type": "Point", "coordinates": [51.4, 35.7]}},
        feature((10.0, 10.0), name="nowhere", count=400),
    ]}, {"features": [feature(count=9)]}, {"features": []}, {},
        {"features": [feature(count=1e300, name="huge")]})
    rows = feeds.geo_signals(docs).collect()
    first = {r.pos: r for r in rows if r.origin == "b0"}
    assert sorted(first) == [0, 3, 4, 5, 6]
    assert [first[p].severity for p in (0, 3, 4, 6)] == [0.5, 0.25, 0.0, 1.0]
    assert (first[3].name, first[4]["count"], first[5].name) == ("Unknown", 0, "Unknown")
    assert [first[p].nation for p in (0, 5, 6)] == ["UA", "IR", None]
    assert [r.severity for r in rows if r.origin == "b1"] == [1.0]
    assert [(r.severity, r["count"]) for r in rows if r.origin == "b4"] == [(1.0, None)]
    assert len({r.id for r in rows}) == len(rows)
    assert {r.source for r in rows} == {fv.SOURCE_GEO}


def test_conflict_document(spark):
    def record(**values):
        return {"latitude": "50.45", "longitude": "30.52", **values}

    docs = documents(spark, CONFLICT_DOCUMENT, {"data": [
        record(event_type="Battles", sub_event_type="Armed clash", location="Kyiv", fatalities="9"),
        record(event_type="Battles", fatalities=""),
        record(latitude=""), record(latitude="abc"), record(longitude=None),
        record(longitude="NaN"), record(longitude="Infinity"),
        record(latitude=" 50.45 ", fatalities="many", location=""),
        record(fatalities="-5", event_date="2024-01-20"),
        record(latitude="50d"), record(latitude="+5.045e1", fatalities="2f"),
    ]}, asked="Ukraine")
    rows = {r.pos: r for r in feeds.conflict_signals(docs).collect()}
    assert sorted(rows) == [0, 1, 7, 8, 10]
    assert [rows[p].name for p in sorted(rows)] == [
        "Armed clash — Kyiv", "Battles — Ukraine", "Event — ", "Event — Ukraine",
        "Event — Ukraine"]
    assert [rows[p]["count"] for p in sorted(rows)] == [10, 1, 1, 1, 1]
    assert [rows[p].severity for p in sorted(rows)] == pytest.approx([0.95] + [0.45] * 4)
    assert {r.nation for r in rows.values()} == {"UA"}
    assert str(rows[8].event_date) == "2024-01-20"


def test_article_document(spark):
    docs = documents(spark, ARTICLE_DOCUMENT, {"articles": [
        {"url": "https://a.example/x", "title": "T1", "seendate": "20240115T093000Z",
         "domain": "d.example", "sourcecountry": "Iran"},
        {"url": "https://a.example/x", "title": ""},
        {"url": "", "title": "no url"}, {"title": "null url"},
        {"url": "https://b.example:81/y?z", "title": "T2", "seendate": "20241345"},
        {"url": "https://b.example/y", "title": "T3", "domain": "", "sourcecountry": ""},
        {"url": "not a url", "title": "T4"},
    ]})
    rows = feeds.article_items(docs, AS_OF).withColumn("iso", iso_text(F.col("seen"))).collect()
    got = {r.title: r for r in rows}
    assert sorted(got) == ["T1", "T2", "T3", "T4"]
    assert (got["T1"].domain, got["T1"].country, got["T1"].iso) == (
        "d.example", "Iran", "2024-01-15T09:30:00Z")
    assert (got["T2"].domain, got["T2"].iso, got["T2"].seen_ok) == (
        "b.example", AS_OF_ISO, False)
    assert (got["T3"].domain, got["T3"].country, got["T2"].country) == ("", "", "—")
    assert got["T4"].domain is None


def test_report_document(spark):
    def report(**fields):
        return {"fields": fields}

    docs = documents(spark, REPORT_DOCUMENT, {"data": [
        report(title="R1", url="https://r/1", source=[{"shortname": "UN"}, {"shortname": "X"}],
               date={"created": "2024-01-15T09:30:00+02:00"}, country=[{"name": "Sudan"}]),
        report(title="R2", url="https://r/2", source=[], country=[]),
        report(title="R3", url="https://r/3", source=[{"name": "long"}]),
        report(title="", url="https://r/4"), report(title="R5"), {},
    ]}, asked="Ukraine", nation="UA")
    rows = feeds.report_items(docs, AS_OF).withColumn("iso", iso_text(F.col("seen"))).collect()
    got = {r.title: r for r in rows}
    assert sorted(got) == ["R1", "R2", "R3"]
    assert (got["R1"].domain, got["R1"].country, got["R1"].iso) == (
        "UN", "Sudan", "2024-01-15T07:30:00Z")
    assert (got["R2"].domain, got["R2"].country, got["R2"].iso) == (
        fv.DEFAULT_REPORT_DOMAIN, "Ukraine", AS_OF_ISO)
    assert got["R3"].domain == fv.DEFAULT_REPORT_DOMAIN
    assert {r.nation for r in rows} == {"UA"}


def test_timeline_document_uses_the_first_series(spark):
    docs = documents(spark, TIMELINE_DOCUMENT, {"timeline": [
        {"data": [{"date": "20240115T000000Z", "value": 1.5}, {"date": "20240114T000000Z"},
                  {"value": -2.0}]},
        {"data": [{"date": "20240101T000000Z", "value": 99}]},
    ]}, {"timeline": []}, {}, subject="IR", metric="tone")
    rows = feeds.timeline_points(docs, AS_OF).withColumn("iso", iso_text(F.col("t")))
    got = [(r.pos, r.iso, r.v) for r in rows.orderBy("pos").collect()]
    assert got == [(0, "2024-01-15T00:00:00Z", 1.5), (1, "2024-01-14T00:00:00Z", 0.0),
                   (2, AS_OF_ISO, -2.0)]


def test_bad_files_are_set_aside_and_the_rest_goes_on(spark, tmp_path):
    good = {"features": [feature(count=1)]}
    (tmp_path / "good.json").write_text(json.dumps(good, indent=2))
    (tmp_path / "page.json").write_text("\n <html>\n<body>busy</body></html>")
    (tmp_path / "blank.json").write_text("  \n")
    (tmp_path / "cut.json").write_text('{"features": [')
    (tmp_path / "zero.json").write_text("")
    parsed = landing.parse_bodies(landing.read_bodies(spark, str(tmp_path)), GEO_DOCUMENT)
    assert feeds.geo_signals(landing.good_documents(parsed)).count() == 1
    reasons = {r.origin: r.reason for r in landing.quarantined(parsed).collect()}
    place = tmp_path.as_uri()
    assert reasons == {f"{place}/page.json": "markup", f"{place}/blank.json": "empty",
                       f"{place}/cut.json": "malformed"}
    names = ["good.json", "page.json", "blank.json", "cut.json", "zero.json"]
    expected = local_table(spark, [(f"{place}/{n}",) for n in names], "origin string")
    missing = freshness.missing_keys(expected, parsed, ["origin"])
    assert [r.origin for r in missing.collect()] == [f"{place}/zero.json"]


def test_text_behind_a_document_makes_it_malformed(spark):
    one = json.dumps({"features": [feature(count=1)]})
    bodies = [one + one, one + " trailing", one + "," + one, f" {one}\n", "[]", "null", "5"]
    frame = local_table(spark, [(str(i), b) for i, b in enumerate(bodies)], "origin string, body string")
    parsed = landing.parse_bodies(frame, GEO_DOCUMENT)
    assert {r.origin: r.reason for r in landing.quarantined(parsed).collect()} == dict.fromkeys(
        "012456", "malformed")
    assert feeds.geo_signals(landing.good_documents(parsed)).count() == 1


def test_an_odd_feature_costs_only_itself(spark):
    polygon = {"geometry": {"type": "Polygon", "coordinates": [[[30, 50], [31, 50]]]}, "properties": {"count": 9}}
    body = {"features": [polygon, feature(count="4"), None, 7, "x", feature(count="many"), feature(count=1)]}
    rows = feeds.geo_signals(documents(spark, GEO_DOCUMENT, body)).orderBy("pos").collect()
    assert [(r.pos, r["count"]) for r in rows] == [(1, 4), (5, 0), (6, 1)]
    assert rows[0].severity == pytest.approx((4 / 9) ** 0.5)


def test_a_point_that_is_no_number_is_zero(spark):
    body = {"timeline": [{"data": [{"date": "20240115", "value": "abc"}, {"date": "20240116", "value": 2.5}]}]}
    docs = documents(spark, TIMELINE_DOCUMENT, body, subject="UA", metric="tone")
    assert [r.v for r in feeds.timeline_points(docs, AS_OF).orderBy("pos").collect()] == [0.0, 2.5]


def test_one_body_per_line(spark, tmp_path):
    lines = [json.dumps({"features": [feature(count=i)]}) for i in range(1, 6)]
    (tmp_path / "many.jsonl").write_text("\n".join([*lines, "<p>", ""]))
    bodies = landing.read_bodies(spark, str(tmp_path), per_file=False)
    parsed = landing.parse_bodies(bodies, GEO_DOCUMENT)
    assert feeds.geo_signals(landing.good_documents(parsed)).count() == 5
    assert [r.reason for r in landing.quarantined(parsed).collect()] == ["markup"]


def test_boundaries(spark, tmp_path):
    ring = [[[30.5, 50.0], [31, 50.25], [30.5, 50.0]]]
    body = {"features": [
        {"id": "804", "properties": {"name": "Ukraine", "pop": 1},
         "geometry": {"type": "Polygon", "coordinates": ring}},
        {"id": 364, "properties": {"name": "Iran"},
         "geometry": {"type": "MultiPolygon", "coordinates": [ring]}},
        {"id": "250", "properties": {"name": "France"}, "geometry": None},
        {"properties": {"name": "none"}},
    ]}
    kept = boundaries.boundary_features(
        documents(spark, BOUNDARY_DOCUMENT, body), dims.boundary_ids(spark))
    assert sorted((r.code, r.name) for r in kept.collect()) == [("IR", "Iran"), ("UA", "Ukraine")]
    collection = json.loads(boundaries.feature_collection(kept).first().value)
    assert collection["type"] == "FeatureCollection"
    by_code = {f["properties"]["code"]: f for f in collection["features"]}
    assert by_code["UA"] == {
        "type": "Feature", "properties": {"code": "UA", "name": "Ukraine"},
        "geometry": {"type": "Polygon", "coordinates": ring}}
    assert by_code["IR"]["geometry"]["coordinates"] == [ring]
    lines = [json.loads(r.value) for r in boundaries.feature_json(kept).collect()]
    assert sorted(f["properties"]["code"] for f in lines) == ["IR", "UA"]


def test_landing_table_is_pruned_by_source_and_day(spark, tmp_path, capsys):
    docs = documents(spark, GEO_DOCUMENT, {"features": [feature(count=1), feature(count=2)]})
    day = F.when(F.col("pos") == 0, F.lit("2024-01-15 09:00:00")).otherwise(
        F.lit("2024-01-16 00:00:00")).cast("timestamp")
    signals = feeds.geo_signals(docs).withColumn("observed_at", day)
    path = str(tmp_path / "signals")
    sinks.write_landing(signals, path, "source", stamp="observed_at")
    sinks.write_landing(signals.limit(0), path, "source", stamp="observed_at")
    back = spark.read.parquet(path)
    assert back.count() == 2
    assert back.filter(F.col("source") == fv.SOURCE_SEED).count() == 0
    recent = back.filter((F.col("source") == fv.SOURCE_GEO) & (F.col("dt") >= "2024-01-16"))
    assert recent.count() == 1
    recent.explain("formatted")
    text = capsys.readouterr().out
    assert "PartitionFilters: [isnotnull(source" in text and "dt" in text
