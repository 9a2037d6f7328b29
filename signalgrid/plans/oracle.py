"""The catalogue's results as SQL, written independently of the operators."""

from __future__ import annotations

from signalgrid import fixed_values as fv


def _values(rows) -> str:
    def cell(v):
        if isinstance(v, float):
            return f"CAST({v!r} AS DOUBLE)"
        return str(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'"

    return ", ".join("(" + ", ".join(cell(v) for v in row) + ")" for row in rows)


ISO = "'%Y-%m-%dT%H:%M:%SZ'"
AS_OF = "TIMESTAMP '2024-01-30 00:00:00'"

SUBJ = (
    "subj(code, name, capital_lon, capital_lat, west, south, east, north, adversary, priority)"
    " AS (VALUES "
    + _values((r[0], r[1], *r[4:10], r[10], i) for i, r in enumerate(fv.SUBJECTS)) + ")"
)
THEATER = (
    "theater_dim(theater, west, south, east, north) AS (VALUES "
    + _values((r[0], *r[4:8]) for r in fv.THEATERS) + ")"
)
MEMBER = (
    "member(theater, code, position) AS (VALUES "
    + _values((r[0], c, i) for r in fv.THEATERS for i, c in enumerate(r[3])) + ")"
)
SEED = (
    "seed_raw(pos, name, lat, lon, weight) AS (VALUES "
    + _values((i, *r) for i, r in enumerate(fv.SEEDS)) + "),\n"
    "seed AS (SELECT r.pos, any_value(r.name) AS name, any_value(r.weight) AS severity, "
    "any_value(r.lon) AS lon, any_value(r.lat) AS lat, arg_min(s.code, s.priority) AS nation "
    "FROM seed_raw r LEFT JOIN subj s ON r.lon BETWEEN s.west AND s.east "
    "AND r.lat BETWEEN s.south AND s.north GROUP BY r.pos)"
)

POINTS = """points AS (
  SELECT event_id, ts, user_id, event_type, value, CAST(trunc(value) AS BIGINT) AS count,
         21e0 + ((event_id * 7919) % 4900) / 1e2 AS lon,
         24e0 + ((event_id * 104729) % 4650) / 1e2 AS lat
  FROM events)"""
SCORED = POINTS + """,
scored AS (
  SELECT *, least(1e0, sqrt(greatest(count, 0)::DOUBLE /
         (SELECT coalesce(max(CASE WHEN count > 0 THEN count::DOUBLE END), 1e0) FROM points)))
         AS severity
  FROM points)"""
CODED = """hit AS (
  SELECT p.event_id, arg_min(s.code, s.priority) AS code
  FROM points p JOIN subj s ON p.lon BETWEEN s.west AND s.east
                           AND p.lat BETWEEN s.south AND s.north
  GROUP BY p.event_id)"""
BANDS = """CASE WHEN {x} >= 0.92 THEN 'critical' WHEN {x} >= 0.75 THEN 'severe'
     WHEN {x} >= 0.55 THEN 'high' WHEN {x} >= 0.38 THEN 'elevated'
     WHEN {x} >= 0.2 THEN 'guarded' ELSE 'low' END"""

PRESSURE = f"""WITH f AS (SELECT * FROM orders),
s AS (
  SELECT c_nationkey AS nationkey,
         least(1e0, sqrt(o_totalprice / (SELECT max(o_totalprice) FROM f))) AS severity
  FROM f JOIN customer ON o_custkey = c_custkey),
t AS (SELECT nationkey, count(*) AS n, avg(severity) AS mean FROM s GROUP BY 1),
j AS (
  SELECT r_name AS theater, n_name AS code, coalesce(n, 0) AS events, coalesce(mean, 0e0) AS mean
  FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN t ON nationkey = n_nationkey),
p AS (
  SELECT *, least(1e0, 0.55e0 * events / greatest(1, max(events) OVER (PARTITION BY theater))
                       + 0.45e0 * mean) AS score FROM j)
"""

# Both sources as theater signals, in ranking order.
SIGNALS = f"""{SUBJ}, {THEATER}, {MEMBER}, {SCORED}, {CODED},
geo AS (
  SELECT 'gd-' || event_id AS id, lat, lon, event_type AS name, count, code AS nation, severity,
         'gdelt' AS source, 1 AS source_rank, 0 AS subject_priority, event_id AS pos, ts AS observed_at
  FROM scored LEFT JOIN hit USING (event_id)),
order_points AS (
  SELECT o_orderkey, o_orderdate, CAST(floor(o_totalprice / 100000) AS BIGINT) AS toll,
         21e0 + ((o_orderkey * 7919) % 4900) / 1e2 AS lon,
         24e0 + ((o_orderkey * 104729) % 4650) / 1e2 AS lat
  FROM orders),
order_hit AS (
  SELECT o_orderkey, arg_min(code, priority) AS code, min(priority) AS priority
  FROM order_points JOIN subj ON lon BETWEEN west AND east AND lat BETWEEN south AND north
  GROUP BY 1),
conflict AS (
  SELECT 'acled-' || o_orderkey AS id, lat, lon, 'Event' AS name, 1 + toll AS count,
         code AS nation, least(1e0, 0.45e0 + log10(1e0 + toll) / 2) AS severity,
         'acled' AS source, 0 AS source_rank, coalesce(priority, 4) AS subject_priority,
         o_orderkey AS pos, o_orderdate AS observed_at
  FROM order_points LEFT JOIN order_hit USING (o_orderkey)),
placed AS (
  SELECT t.theater, g.* FROM geo g JOIN theater_dim t
    ON g.lon BETWEEN t.west AND t.east AND g.lat BETWEEN t.south AND t.north
  UNION ALL
  SELECT m.theater, c.* FROM conflict c JOIN member m ON c.nation = m.code),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY theater
    ORDER BY severity DESC, source_rank, subject_priority, pos, id) AS rank FROM placed)"""
# Only what was observed by the moment of the answer.
KNOWN = SIGNALS.replace("AS rank FROM placed", f"AS rank FROM placed WHERE observed_at <= {AS_OF}")

HOT = f"""{SUBJ}, {THEATER}, {MEMBER}, {SCORED}, {CODED},
hot AS (
  SELECT theater, code, event_id, lon, lat, severity FROM (
    SELECT t.theater, h.code, s.*, row_number() OVER (
             PARTITION BY t.theater, h.code ORDER BY s.severity DESC, s.event_id) AS rn
    FROM scored s JOIN hit h USING (event_id) JOIN theater_dim t
      ON s.lon BETWEEN t.west AND t.east AND s.lat BETWEEN t.south AND t.north)
  WHERE rn = 1),
arc AS (
  SELECT m.theater, m.position, 'arc-' || a.code || '-' || b.code AS arc_id, a.code,
         b.code AS adversary, coalesce(h.lon, a.capital_lon) AS from_lon,
         coalesce(h.lat, a.capital_lat) AS from_lat, b.capital_lon AS to_lon,
         b.capital_lat AS to_lat, a.name || ' → ' || b.name AS label,
         coalesce(h.severity, 0.4e0) AS intensity
  FROM member m JOIN subj a ON a.code = m.code JOIN subj b ON b.code = a.adversary
  JOIN member mb ON mb.theater = m.theater AND mb.code = b.code
  LEFT JOIN hot h ON h.theater = m.theater AND h.code = m.code)"""

WORDS = """CASE WHEN regexp_matches({t}, '(?i)\\b(der|die)\\b') THEN 'A'
     WHEN regexp_matches({t}, '(?i)\\b(que|de)\\b') THEN 'B'
     WHEN regexp_matches({t}, '(?i)\\b(with|was)\\b') THEN 'C'
     WHEN regexp_matches({t}, '(?i)\\b(le|la)\\b') THEN 'D' END"""

TONE = "(10e0 - value / 10)"
DAILY = f"""daily AS (
  SELECT date_trunc('day', ts) AS t, event_type AS subject, count(*) AS count,
         avg{TONE} AS tone FROM events {{where}} GROUP BY 1, 2),
shared AS (
  SELECT *, count::DOUBLE / sum(count) OVER (PARTITION BY t) AS volume FROM daily)"""

SITUATION = """a AS (
  SELECT r_name AS theater, n_name AS nation, n_nationkey, o_orderkey AS id, o_orderdate AS seen,
         row_number() OVER (PARTITION BY n_name ORDER BY o_orderdate DESC, o_orderkey) AS r1
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey
  JOIN region ON r_regionkey = n_regionkey),
b AS (
  SELECT *, row_number() OVER (PARTITION BY theater ORDER BY seen DESC, n_nationkey, id) AS rank
  FROM a WHERE r1 <= 12)"""

ITEMS = """items AS (
  SELECT lpad(CAST(doc_id AS VARCHAR), 12, '0') AS id, text AS title, source AS domain,
         lang AS country, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id % 64800) AS seen
  FROM documents)"""

# Fetches of theaters: fresh ones, old ones, and one theater whose fetches all fail.
THEATER_STATE = f"""theater_log AS (
  SELECT CASE event_type WHEN 'click' THEN 'middle-east' WHEN 'view' THEN 'eastern-europe' ELSE 'global' END AS theater,
         CASE WHEN event_type = 'click' THEN {AS_OF} - to_seconds(event_id % 40) ELSE ts END AS ts, event_id,
         CAST(trunc(value) AS BIGINT) AS n
  FROM events WHERE event_type IN ('click', 'view')),
theater_last AS (
  SELECT theater, ts, n FROM (SELECT *, row_number() OVER (
    PARTITION BY theater ORDER BY ts DESC, event_id DESC) AS rn FROM theater_log WHERE ts <= {AS_OF}) WHERE rn = 1),
theater_state AS (
  SELECT d.theater, CASE WHEN n > 0 AND {AS_OF} <= ts + INTERVAL {{ttl}} SECOND THEN 'ok'
                         WHEN n > 0 THEN 'degraded' ELSE '{{otherwise}}' END AS status
  FROM theater_dim d LEFT JOIN theater_last USING (theater))"""
EVENTS_STATE = THEATER_STATE.format(ttl=60, otherwise="degraded")
FEED_STATE = THEATER_STATE.format(ttl=45, otherwise="offline")

HAVERSTEP = f"""WITH {HOT},
v AS (
  SELECT *, cos(radians(from_lat)) * cos(radians(from_lon)) AS ax,
         cos(radians(from_lat)) * sin(radians(from_lon)) AS ay, sin(radians(from_lat)) AS az,
         cos(radians(to_lat)) * cos(radians(to_lon)) AS bx,
         cos(radians(to_lat)) * sin(radians(to_lon)) AS by_, sin(radians(to_lat)) AS bz FROM arc),
o AS (SELECT *, acos(least(1e0, greatest(-1e0, ax * bx + ay * by_ + az * bz))) AS om FROM v),
p AS (SELECT o.*, g.step FROM o, generate_series(0, 64) AS g(step)),
w AS (
  SELECT *, sin((1 - step / 64e0) * om) / sin(om) AS wa, sin(step / 64e0 * om) / sin(om) AS wb
  FROM p)
SELECT theater, arc_id, step,
  round(CASE step WHEN 0 THEN from_lon WHEN 64 THEN to_lon
        ELSE degrees(atan2(wa * ay + wb * by_, wa * ax + wb * bx)) END, 6) AS lon,
  round(CASE step WHEN 0 THEN from_lat WHEN 64 THEN to_lat
        ELSE degrees(asin(wa * az + wb * bz)) END, 6) AS lat
FROM w"""

NUMBERED = """CAST(floor({k} / 50) AS BIGINT) AS origin,
  row_number() OVER (PARTITION BY floor({k} / 50) ORDER BY {k}) - 1 AS pos"""

GEO_PAGES = f"""{SUBJ}, {POINTS}, {CODED},
n AS (SELECT *, {NUMBERED.format(k='event_id')},
  CASE WHEN event_type <> 'click' THEN count ELSE 0 END AS c FROM points),
m AS (SELECT *, coalesce(max(CASE WHEN c > 0 THEN c END) OVER (PARTITION BY origin), 1) AS peak FROM n),
geo_rows AS (
  SELECT origin, pos, CASE WHEN event_type = 'view' THEN 'Unknown' ELSE event_type END AS name,
    c AS count, code AS nation, round(least(1e0, sqrt(c::DOUBLE / peak)), 6) AS severity
  FROM m LEFT JOIN hit USING (event_id) WHERE event_type NOT IN ('error', 'signup'))"""

ORACLE: dict[str, str] = {
    "pressure_index": PRESSURE
    + f"SELECT theater, code, events, round(score, 6) AS score, {BANDS.format(x='score')} AS threat FROM p",
    "watchlist_report": PRESSURE
    + "SELECT theater, code, upper(code) AS title, events, "
      "round(round(score, 6) * 100, 0) AS score_pct, "
      "round(greatest(4e0, score * 100), 4) AS bar, "
    + BANDS.format(x="score") + " AS threat FROM p",
    "severity_share": f"WITH {SCORED} SELECT event_id, count, round(severity, 6) AS severity FROM scored",
    "severity_log": """SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_quantity,
  round(least(1e0, 0.45e0 + log10(1e0 + l_quantity) / 2), 6) AS severity FROM lineitem""",
    "threat_bands": f"""WITH {SCORED}
SELECT {BANDS.format(x='severity')} AS threat, count(*) AS events,
  round(min(severity), 6) AS low, round(max(severity), 6) AS high FROM scored GROUP BY 1""",
    "bbox_clip": f"""WITH {THEATER}, {POINTS}
SELECT event_id, theater, lon, lat FROM points JOIN theater_dim
  ON lon BETWEEN west AND east AND lat BETWEEN south AND north""",
    "geofence": f"""WITH {SUBJ}, {POINTS}, {CODED}
SELECT event_id, lon, lat, code FROM points LEFT JOIN hit USING (event_id)""",
    "geofence_bucketed": f"""WITH {SUBJ}, {POINTS}, {CODED}
SELECT event_id, lon, lat, code FROM points LEFT JOIN hit USING (event_id)""",
    "geofence_zone_table": f"""WITH {POINTS},
c AS (SELECT s_name, s_suppkey, 21e0 + ((s_suppkey * 7919) % 4900) / 1e2 AS clon,
  24e0 + ((s_suppkey * 104729) % 4650) / 1e2 AS clat, 0.25e0 + s_nationkey / 8e0 AS half
  FROM supplier),
z AS (SELECT s_name, s_suppkey, clon - half AS west, clat - half AS south, clon + half AS east,
  clat + half AS north FROM c),
h AS (SELECT event_id, arg_min(s_name, s_suppkey) AS code FROM points JOIN z
  ON lon BETWEEN west AND east AND lat BETWEEN south AND north GROUP BY 1)
SELECT event_id, code FROM points LEFT JOIN h USING (event_id)""",
    "heat_grid": f"""WITH {POINTS}
SELECT CAST(floor(lon) AS BIGINT) AS cell_x, CAST(floor(lat) AS BIGINT) AS cell_y,
  CAST(sum(count) AS BIGINT) AS weight, count(*) AS points FROM points GROUP BY 1, 2""",
    "heat_kernel": f"""WITH {POINTS},
g AS (SELECT CAST(floor(lon) AS BIGINT) AS x, CAST(floor(lat) AS BIGINT) AS y,
  sum(count) AS w FROM points GROUP BY 1, 2),
k(dx, dy, share) AS (VALUES (-1, -1, 1), (0, -1, 2), (1, -1, 1), (-1, 0, 2), (0, 0, 4), (1, 0, 2),
  (-1, 1, 1), (0, 1, 2), (1, 1, 1))
SELECT x + dx AS cell_x, y + dy AS cell_y, CAST(sum(w * share) AS DOUBLE) / 16 AS density
FROM g, k GROUP BY 1, 2""",
    "heat_grid_dense": f"""WITH {THEATER}, {POINTS},
g AS (SELECT CAST(floor(lon / 5e0) AS BIGINT) AS cell_x, CAST(floor(lat / 5e0) AS BIGINT) AS cell_y,
  sum(count) AS weight, count(*) AS points FROM points GROUP BY 1, 2),
xs AS (SELECT theater, south, north, unnest(generate_series(CAST(floor(west / 5) AS BIGINT),
  CAST(floor(east / 5) AS BIGINT))) AS cell_x FROM theater_dim),
cells AS (SELECT theater, cell_x, unnest(generate_series(CAST(floor(south / 5) AS BIGINT),
  CAST(floor(north / 5) AS BIGINT))) AS cell_y FROM xs)
SELECT theater, cell_x, cell_y, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
  coalesce(points, 0) AS points FROM cells LEFT JOIN g USING (cell_x, cell_y)""",
    "source_union": f"""WITH {SIGNALS}
SELECT id, source, count, nation, round(severity, 6) AS severity, lon, lat FROM conflict
UNION ALL SELECT id, source, count, nation, round(severity, 6), lon, lat FROM geo""",
    "top_signals": f"""WITH {SIGNALS}
SELECT theater, rank, id, source, count, nation, round(severity, 6) AS severity
FROM ranked WHERE rank <= 250""",
    "strongest_signals": f"""WITH {SIGNALS}, u AS (SELECT * FROM conflict UNION ALL SELECT * FROM geo)
SELECT id, source, count, nation, round(severity, 6) AS severity FROM u
ORDER BY u.severity DESC, source_rank, subject_priority, pos, id LIMIT 250""",
    "seed_fallback": f"""WITH {SUBJ}, {THEATER}, {SEED}, {SCORED}, {CODED},
watched AS (SELECT * FROM theater_dim UNION ALL SELECT 'southern-ocean', -60e0, -70e0, 0e0, -50e0),
live AS (SELECT t.theater, s.event_id, h.code, s.severity FROM scored s LEFT JOIN hit h USING (event_id)
  JOIN watched t ON s.lon BETWEEN t.west AND t.east AND s.lat BETWEEN t.south AND t.north)
SELECT theater, 'gd-' || event_id AS id, 'gdelt' AS source, code AS nation,
  round(severity, 6) AS severity, true AS live FROM live
UNION ALL
SELECT t.theater, 'seed-' || pos, 'seed', nation, round(severity, 6), false
FROM watched t, seed WHERE t.theater NOT IN (SELECT theater FROM live)""",
    "hottest_per_subject": f"""WITH {HOT}
SELECT theater, code, event_id, lon, lat, round(severity, 6) AS severity FROM hot""",
    "tension_arcs": f"""WITH {HOT}
SELECT theater, arc_id, code, adversary, from_lon, from_lat, to_lon, to_lat, label,
  round(intensity, 6) AS intensity FROM arc""",
    "arc_rails": HAVERSTEP,
    "keyword_filter": "SELECT doc_id, lang FROM documents "
                      "WHERE regexp_matches(text, '(?i)\\b(der|que)\\b')",
    "keyword_attribution": f"SELECT doc_id, {WORDS.format(t='text')} AS code FROM documents",
    "keyword_dictionary": "SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)\\b(de la|in the)\\b') "
                          f"THEN 'P' ELSE {WORDS.format(t='text')} END AS code FROM documents",
    "url_domain": "SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) AS domain "
                  "FROM pages",
    "compact_ts": f"""WITH raw AS (SELECT o_orderkey, CASE o_orderkey % 7
    WHEN 0 THEN strftime(o_orderdate, '%Y%m%dT%H%M%SZ') WHEN 1 THEN strftime(o_orderdate, '%Y%m%d')
    WHEN 2 THEN strftime(o_orderdate, '%Y%m%d%H%M%S') || '99'
    WHEN 3 THEN strftime(o_orderdate, '%Y') || '1345' WHEN 4 THEN 'x'
    WHEN 5 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS raw FROM orders),
d AS (SELECT o_orderkey, regexp_replace(raw, '[^0-9]', '', 'g') AS d FROM raw),
s AS (SELECT o_orderkey, CASE WHEN length(d) >= 8
    THEN try_strptime(rpad(left(d, 14), 14, '0'), '%Y%m%d%H%M%S') END AS s FROM d)
SELECT o_orderkey, strftime(coalesce(s, {AS_OF}), {ISO}) AS seen, s IS NOT NULL AS parse_ok FROM s""",
    "situation_feed": f"""WITH {SITUATION}
SELECT theater, rank, id, nation, strftime(seen, {ISO}) AS seen FROM b WHERE rank <= 24""",
    "ticker_report": f"""WITH {ITEMS}
SELECT id, upper(domain) AS domain,
  CASE WHEN length(title) > 90 THEN substr(title, 1, 90) || '…' ELSE title END AS title,
  {WORDS.format(t="(country || ' ' || title)")} AS code
FROM items ORDER BY seen DESC, items.id LIMIT 24""",
    "event_dossier": f"""WITH {SIGNALS}, g AS (SELECT * FROM geo)
SELECT id, coalesce(s.name, '—') AS subject, count AS mentions,
  round(greatest(5e0, severity * 100), 4) AS bar, round(lat, 3) AS lat, round(lon, 3) AS lon
FROM g LEFT JOIN subj s ON s.code = g.nation""",
    "subject_dossier": f"""WITH {SUBJ}, {THEATER}, {MEMBER}, {SCORED}, {CODED},
plate(code, callsign, capital) AS (VALUES ('IR', 'PERSIA', 'TEHRAN'), ('IL', 'SHIELD', 'JERUSALEM'),
  ('UA', 'TRIDENT', 'KYIV'), ('RU', 'BEAR', 'MOSCOW')),
t AS (SELECT d.theater, h.code, count(*) AS n, avg(s.severity) AS mean FROM scored s
  JOIN hit h USING (event_id) JOIN theater_dim d
    ON s.lon BETWEEN d.west AND d.east AND s.lat BETWEEN d.south AND d.north GROUP BY 1, 2),
j AS (SELECT m.theater, m.code, coalesce(n, 0) AS events, coalesce(mean, 0e0) AS mean
  FROM member m LEFT JOIN t ON t.theater = m.theater AND t.code = m.code),
p AS (SELECT *, least(1e0, 0.55e0 * events / greatest(1, max(events) OVER (PARTITION BY theater))
  + 0.45e0 * mean) AS score FROM j)
SELECT theater, p.code, s.name, callsign, plate.capital, events, round(score, 6) AS score,
  round(greatest(4e0, score * 100), 4) AS bar, {BANDS.format(x='score')} AS threat
FROM p JOIN subj s ON s.code = p.code JOIN plate ON plate.code = p.code""",
    "lookback": f"""SELECT event_id, event_type, ts >= {AS_OF} - INTERVAL 1 DAY AS in_events,
  ts >= {AS_OF} - INTERVAL 2 DAY AS in_articles
FROM events WHERE ts BETWEEN {AS_OF} - INTERVAL 14 DAY AND {AS_OF}""",
    "conflict_lookback": f"""SELECT o_orderkey, strftime(o_orderdate, {ISO}) AS day FROM orders
WHERE CAST(o_orderdate AS DATE) >= DATE '2001-07-15' - INTERVAL 14 DAY
  AND o_orderdate <= TIMESTAMP '2001-07-15 00:00:00' AND o_orderstatus = 'O'""",
    "conflict_recent": f"""WITH {SIGNALS}, r AS (
  SELECT c.nation, c.id, 'Event — ' || c.nation AS name, o.o_orderdate AS d, row_number() OVER (
    PARTITION BY c.nation ORDER BY o.o_orderdate DESC, c.pos) AS rank
  FROM conflict c JOIN orders o ON o.o_orderkey = c.pos
  WHERE c.nation IS NOT NULL AND o.o_orderdate BETWEEN TIMESTAMP '2001-07-01 00:00:00'
    AND TIMESTAMP '2001-07-15 00:00:00')
SELECT nation, rank, id, name, strftime(d, {ISO}) AS day FROM r WHERE rank <= 400""",
    "timeline_volume": f"""WITH {DAILY.format(where='')}
SELECT strftime(t, {ISO}) AS t, subject, count, round(volume, 6) AS volume FROM shared""",
    "timeline_tone": f"""WITH {DAILY.format(where='')}
SELECT strftime(t, {ISO}) AS t, strftime(t, '%m-%d') AS label, subject, round(tone, 6) AS tone
FROM shared""",
    "timeline_stats": f"""WITH {DAILY.format(where='')}
SELECT subject, count(*) AS points, min(count) AS low, max(count) AS high FROM shared GROUP BY 1""",
    "tone_now": f"""SELECT event_type, round({TONE}, 6) AS tone_now FROM (
  SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS rn FROM events)
WHERE rn = 1""",
    "tone_gauge": f"""WITH c AS (SELECT event_id, greatest(-10e0, least(10e0, {TONE})) AS c FROM events)
SELECT event_id, round(c, 6) AS level, round((c + 10) / 20 * 100, 6) AS percent,
  CASE WHEN c < -3 THEN 'danger' WHEN c < 1 THEN 'warning' ELSE 'success' END AS band FROM c""",
    "fetch_freshness": f"""WITH l AS (
  SELECT user_id, max(CASE WHEN event_type <> 'error' AND ts <= {AS_OF} THEN ts END) AS last_ok
  FROM events GROUP BY 1)
SELECT user_id, strftime(last_ok, {ISO}) AS last_ok,
  coalesce({AS_OF} <= last_ok + INTERVAL 6 HOUR, false) AS fresh FROM l""",
    "last_known_good": f"""SELECT event_id, strftime(max(CASE WHEN event_type <> 'error' THEN ts END)
  OVER (PARTITION BY user_id ORDER BY ts), {ISO}) AS last_good FROM events""",
    "feed_status": f"""WITH good AS (
  SELECT user_id, ts, CAST(trunc(value) AS BIGINT) AS n, row_number() OVER (
    PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn
  FROM events WHERE event_type <> 'error' AND ts <= {AS_OF}),
k AS (SELECT user_id, count(*) FILTER (event_type = 'error' AND ts <= {AS_OF}) AS failures
  FROM events GROUP BY 1)
SELECT k.user_id, strftime(ts, {ISO}) AS last_ok, n AS rows_on_hand, failures,
  CASE WHEN n > 0 AND {AS_OF} <= ts + INTERVAL 6 HOUR THEN 'ok'
       WHEN n > 0 THEN 'degraded' ELSE 'offline' END AS status
FROM k LEFT JOIN good ON good.user_id = k.user_id AND rn = 1""",
    "missing_keys": """WITH span AS (SELECT CAST(min(o_orderdate) AS DATE) AS a,
  CAST(max(o_orderdate) AS DATE) AS b FROM orders),
d AS (SELECT unnest(generate_series(a, b, INTERVAL 1 DAY)) AS day FROM span),
got AS (SELECT DISTINCT n_name, CAST(o_orderdate AS DATE) AS day FROM orders
  JOIN customer ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey)
SELECT n.n_name, strftime(d.day, '%Y-%m-%d') AS day FROM nation n, d
WHERE NOT EXISTS (SELECT 1 FROM got WHERE got.n_name = n.n_name AND got.day = CAST(d.day AS DATE))""",
    "insert_if_absent": f"""WITH i AS (
  SELECT o_custkey AS id, o_orderkey,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'admin' WHEN '2-HIGH' THEN 'analyst'
         ELSE 'viewer' END AS role,
    CASE WHEN o_orderstatus <> 'P' THEN o_orderdate ELSE {AS_OF} END AS created_at FROM orders),
f AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY created_at, o_orderkey) AS rn FROM i)
SELECT id, o_orderkey, role, strftime(created_at, {ISO}) AS created_at FROM f
WHERE rn = 1 AND id NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""",
    "domain_check": """WITH r AS (SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN c_name END AS email,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'viewer' WHEN 'MACHINERY' THEN 'analyst'
    WHEN 'HOUSEHOLD' THEN 'admin' WHEN 'FURNITURE' THEN 'furniture' END AS role FROM customer)
SELECT c_custkey, role, CASE WHEN email IS NULL THEN 'email is null'
  WHEN role IS NULL THEN 'role is null'
  WHEN role NOT IN ('viewer', 'analyst', 'admin') THEN 'role not allowed' END AS reason FROM r""",
    "stream_signals": "SELECT DISTINCT event_id, event_type, value FROM events",
    "stream_volume": f"""SELECT strftime(date_trunc('day', ts), {ISO}) AS t, event_type AS subject,
  count(*) AS count, round(sum(value) / count(*), 6) AS mean FROM events GROUP BY 1, 2""",
    "stream_fetch_state": f"""SELECT user_id,
  strftime(max(ts) FILTER (event_type <> 'error'), {ISO}) AS last_ok,
  count(*) FILTER (event_type = 'error') AS failures FROM events GROUP BY 1""",
    "geo_scan": f"""WITH {GEO_PAGES}
SELECT origin, pos, sha256('gdelt|' || origin || '|' || pos) AS id, name, count, nation, severity
FROM geo_rows""",
    "stream_landing": f"""WITH {GEO_PAGES}
SELECT 'signal' AS part, name, count, nation, severity FROM geo_rows
UNION ALL SELECT 'aside', CASE WHEN NOT regexp_matches(html, '\\S') THEN 'empty'
  WHEN regexp_matches(html, '^\\s*<') THEN 'markup' ELSE 'malformed' END, NULL, NULL, NULL
FROM pages""",
    "landing_ids": f"""WITH {GEO_PAGES}
SELECT count(*) AS signals, count(*) AS ids FROM geo_rows""",
    "conflict_scan": f"""WITH {SUBJ},
p AS (SELECT *, {NUMBERED.format(k='o_orderkey')}, o_orderpriority = '5-LOW' AS low,
  21e0 + ((o_orderkey * 7919) % 4900) / 1e2 AS lon,
  24e0 + ((o_orderkey * 104729) % 4650) / 1e2 AS lat,
  CASE WHEN o_orderpriority = '5-LOW' THEN 0
       ELSE CAST(floor(o_totalprice / 100000) AS BIGINT) END AS toll FROM orders),
h AS (SELECT o_orderkey, arg_min(code, priority) AS code FROM p JOIN subj
  ON lon BETWEEN west AND east AND lat BETWEEN south AND north GROUP BY 1)
SELECT origin, pos,
  (CASE WHEN o_orderpriority = '1-URGENT' THEN 'Shelling' WHEN low THEN 'Event' ELSE 'Battle' END)
  || ' — ' || (CASE WHEN o_orderstatus = 'F' THEN o_orderpriority ELSE 'Ukraine' END) AS name,
  1 + toll AS count, code AS nation,
  round(least(1e0, 0.45e0 + log10(1e0 + toll) / 2), 6) AS severity,
  strftime(o_orderdate, '%Y-%m-%d') AS event_date
FROM p LEFT JOIN h USING (o_orderkey) WHERE o_orderstatus <> 'P'""",
    "article_scan": f"""WITH p AS (SELECT *, {NUMBERED.format(k='page_id')}, page_id % 5 AS kind,
  regexp_extract(html, '<title>([^<]*)</title>', 1) AS title,
  regexp_extract(html, '<html lang="([a-z]*)"', 1) AS lang FROM pages)
SELECT origin, pos, title, url,
  CASE kind WHEN 2 THEN '' WHEN 4 THEN 'wire.example'
    ELSE regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) END AS domain,
  CASE WHEN lang <> 'en' THEN lang ELSE '—' END AS country,
  CASE WHEN kind <> 1 THEN '2024-01-15T09:30:' || lpad(CAST(page_id % 60 AS VARCHAR), 2, '0') || 'Z'
    ELSE strftime({AS_OF}, {ISO}) END AS seen, kind <> 1 AS seen_ok
FROM p WHERE kind <> 3 AND title <> '' AND url <> ''""",
    "report_scan": f"""WITH p AS (SELECT *, {NUMBERED.format(k='doc_id')} FROM documents)
SELECT origin, pos, text AS title, 'https://r.example.org/' || doc_id AS url,
  CASE WHEN lang = 'fr' THEN 'ReliefWeb' ELSE source END AS domain,
  CASE WHEN source <> 'src1' THEN lang ELSE 'Ukraine' END AS country,
  lang <> 'de' AS seen_ok, 'UA' AS nation
FROM p WHERE lang <> 'es' AND text <> ''""",
    "timeline_scan": f"""WITH {DAILY.format(where='')}
SELECT subject, row_number() OVER (PARTITION BY subject ORDER BY t) - 1 AS pos,
  strftime(t, {ISO}) AS t, round(CASE WHEN count >= 2 THEN tone ELSE 0 END, 6) AS v FROM daily""",
    "quarantine": """SELECT 'page-' || page_id AS origin, CASE WHEN NOT regexp_matches(html, '\\S') THEN 'empty'
  WHEN regexp_matches(html, '^\\s*<') THEN 'markup' ELSE 'malformed' END AS reason FROM pages
UNION ALL SELECT 'doc-' || doc_id, CASE WHEN NOT regexp_matches(text, '\\S') THEN 'empty'
  WHEN regexp_matches(text, '^\\s*<') THEN 'markup' ELSE 'malformed' END FROM documents""",
    "boundary_subset": """SELECT n_name AS code, s_name AS name, 'LineString' AS kind,
  CAST(s_suppkey AS DOUBLE) AS lon
FROM supplier JOIN nation ON s_suppkey = n_nationkey""",
    "resolved_requests": f"""WITH r AS (
  SELECT event_id, ['middle-east', 'eastern-europe', 'global', 'atlantis', NULL][event_id % 5 + 1] AS theater,
    ['IR', 'IL', 'UA', 'RU', 'XX', 'ir', NULL][event_id % 7 + 1] AS subject FROM events),
t(theater_id, theater_label) AS (VALUES ('middle-east', 'MIDDLE EAST // IRAN — ISRAEL'),
  ('eastern-europe', 'EASTERN EUROPE // RUSSIA — UKRAINE'), ('global', 'GLOBAL THEATER // ALL FRONTS')),
{SUBJ}
SELECT event_id, t.theater_id, theater_label, s.name AS subject_name,
  CASE WHEN s.name IS NULL THEN 'unknown subject' END AS refused
FROM r JOIN t ON t.theater_id = CASE WHEN theater IN ('middle-east', 'eastern-europe', 'global') THEN theater ELSE 'middle-east' END
LEFT JOIN subj s ON s.code = subject""",
    "payload_events": f"""WITH {KNOWN}, {EVENTS_STATE},
top AS (SELECT * FROM ranked WHERE rank <= 250),
hot AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY theater, nation ORDER BY rank) AS rn
  FROM top WHERE nation IS NOT NULL) WHERE rn = 1),
arcs AS (
  SELECT m.theater, m.position, 'arc-' || a.code || '-' || b.code AS key,
         coalesce(h.severity, 0.4e0) AS value, a.name || ' → ' || b.name AS word
  FROM member m JOIN subj a ON a.code = m.code JOIN subj b ON b.code = a.adversary
  JOIN member mb ON mb.theater = m.theater AND mb.code = b.code
  LEFT JOIN hot h ON h.theater = m.theater AND h.nation = m.code),
t AS (SELECT theater, nation, count(*) AS n, avg(severity) AS mean FROM top GROUP BY 1, 2),
j AS (SELECT m.theater, m.position, m.code, coalesce(n, 0) AS n, coalesce(mean, 0e0) AS mean
  FROM member m LEFT JOIN t ON t.theater = m.theater AND t.nation = m.code),
score AS (SELECT *, least(1e0, 0.55e0 * n / greatest(1, max(n) OVER (PARTITION BY theater))
  + 0.45e0 * mean) AS score FROM j),
rows_ AS (
  SELECT theater, 'event' AS part, rank - 1 AS pos, id AS key, severity AS value, nation AS word FROM top
  UNION ALL
  SELECT theater, 'arc', row_number() OVER (PARTITION BY theater ORDER BY position) - 1, key, value, word
  FROM arcs
  UNION ALL
  SELECT theater, 'nation', position, code, score, {BANDS.format(x='score')} FROM score)
SELECT r.theater, coalesce(s.status, 'degraded') AS status, strftime({AS_OF}, {ISO}) AS updated_at,
  part, CAST(pos AS BIGINT) AS pos, key, round(value, 6) AS value, word
FROM rows_ r LEFT JOIN theater_state s USING (theater)""",
    "payload_sink": f"""WITH {KNOWN}, {EVENTS_STATE}
SELECT r.theater, coalesce(any_value(s.status), 'degraded') AS status, count(*) AS events,
  CAST(CASE r.theater WHEN 'global' THEN 4 ELSE 2 END AS BIGINT) AS arcs,
  CAST(CASE r.theater WHEN 'global' THEN 4 ELSE 2 END AS BIGINT) AS nations,
  round(sum(severity), 6) AS severity_sum
FROM ranked r LEFT JOIN theater_state s USING (theater) WHERE rank <= 250 GROUP BY r.theater""",
    "payload_feed": f"""WITH {ITEMS}, {THEATER}, {FEED_STATE},
routed AS (
  SELECT 'middle-east' AS theater, * FROM items WHERE regexp_matches(title, '(?i)\\b(der|la)\\b')
  UNION ALL SELECT 'eastern-europe', * FROM items WHERE regexp_matches(title, '(?i)\\b(the|que)\\b')
  UNION ALL SELECT 'global', * FROM items WHERE regexp_matches(title, '(?i)\\b(der|la|the|que)\\b')),
r AS (SELECT *, row_number() OVER (PARTITION BY theater ORDER BY seen DESC, id) AS rank
  FROM routed WHERE seen <= {AS_OF})
SELECT r.theater, coalesce(s.status, 'degraded') AS status, rank - 1 AS pos, id, title,
  {WORDS.format(t="(country || ' ' || title)")} AS nation, strftime(seen, {ISO}) AS seen
FROM r LEFT JOIN theater_state s USING (theater) WHERE rank <= 60""",
    "payload_situation": f"""WITH {SITUATION},
region_log AS (
  SELECT event_id % 4 AS r_regionkey, event_id % 4 <> 2 AS ok, event_id,
    {AS_OF} - to_seconds(CASE event_id % 4 WHEN 1 THEN 400 ELSE 0 END + event_id % 250) AS ts,
    CASE WHEN event_id % 4 = 3 THEN 0 ELSE 1 + abs(CAST(trunc(value) AS BIGINT)) END AS n FROM events),
region_last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY r_regionkey ORDER BY ts DESC, event_id DESC) AS rn
  FROM region_log WHERE ok AND ts <= {AS_OF}) WHERE rn = 1),
region_state AS (
  SELECT r_name AS theater, CASE WHEN n > 0 AND {AS_OF} <= ts + INTERVAL 300 SECOND THEN 'ok'
    WHEN n > 0 THEN 'degraded' WHEN r.r_regionkey < 4 THEN 'offline' ELSE 'degraded' END AS status
  FROM region r LEFT JOIN region_last l ON l.r_regionkey = r.r_regionkey)
SELECT theater, status, rank - 1 AS pos, id, nation FROM b JOIN region_state USING (theater) WHERE rank <= 24""",
    "payload_pulse": f"""WITH {DAILY.format(where=f"WHERE ts BETWEEN {AS_OF} - INTERVAL 14 DAY AND {AS_OF}")},
pulse_log AS (SELECT event_type AS subject, event_id, CAST(trunc(value) AS BIGINT) AS n,
  CASE WHEN event_type = 'click' THEN {AS_OF} - to_seconds(event_id % 100) ELSE ts END AS ts FROM events),
last_log AS (SELECT subject, ts, n, row_number() OVER (
  PARTITION BY subject ORDER BY ts DESC, event_id DESC) AS rn FROM pulse_log WHERE ts <= {AS_OF} AND subject <> 'error'),
state AS (SELECT subject, CASE WHEN n > 0 AND {AS_OF} <= ts + INTERVAL 120 SECOND THEN 'ok'
  WHEN n > 0 THEN 'degraded' ELSE 'offline' END AS status
  FROM (SELECT DISTINCT subject FROM pulse_log) LEFT JOIN (SELECT * FROM last_log WHERE rn = 1) USING (subject)),
s AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY t) - 1 AS pos,
  last_value(tone) OVER (PARTITION BY subject ORDER BY t
    ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS tone_now FROM shared),
u AS (SELECT subject, pos, t, tone_now, 'volume' AS metric, volume AS v FROM s
  UNION ALL SELECT subject, pos, t, tone_now, 'tone', tone FROM s)
SELECT u.subject, status, round(tone_now, 6) AS tone_now, metric, pos, strftime(t, {ISO}) AS t,
  round(v, 6) AS v FROM u JOIN state USING (subject)""",
}
ORACLE["insert_bucketed"] = ORACLE["insert_if_absent"]
