"""Schemas of the landing documents and of the canonical tables."""

# Features come in many shapes; one of an odd shape must not cost its neighbours.
GEO_DOCUMENT = "features array<variant>"
ARTICLE_DOCUMENT = (
    "articles array<struct<url:string,title:string,seendate:string,"
    "domain:string,sourcecountry:string>>"
)
TIMELINE_DOCUMENT = (
    "timeline array<struct<data:array<struct<date:string,value:string>>>>"
)
CONFLICT_DOCUMENT = (
    "data array<struct<latitude:string,longitude:string,event_type:string,"
    "sub_event_type:string,location:string,fatalities:string,event_date:string>>"
)
REPORT_DOCUMENT = (
    "data array<struct<fields:struct<title:string,url:string,"
    "source:array<struct<shortname:string,name:string>>,"
    "date:struct<created:string>,country:array<struct<name:string>>>>>"
)
BOUNDARY_DOCUMENT = (
    "features array<struct<id:string,properties:struct<name:string>,geometry:variant>>"
)
CORRUPT = "_corrupt_record"

SIGNAL_COLUMNS = (
    "id", "lat", "lon", "name", "count", "nation", "severity", "source",
    "source_rank", "subject_priority", "pos", "observed_at",
)
FEED_COLUMNS = (
    "id", "title", "url", "domain", "country", "seen", "seen_ok", "nation",
)

# Schemas of the given tables; naming them spares a footer scan per read.
TABLES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
                "c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, "
              "o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
                "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
                "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
              "value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "pages": "page_id bigint, url string, html string",
}
