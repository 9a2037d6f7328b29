"""The results of the feed queries as SQL, written independently of the operators."""

from __future__ import annotations

from signalgrid.plans.oracle import (
    AS_OF, BANDS, CODED, DAILY, ISO, MEMBER, NUMBERED, ORACLE as FIRST, POINTS, SCORED, SEED, SUBJ, THEATER,
)

# Fetches as they came: pages of up to 50 entries, some markup, half a document or missing.
POLLS = f"""{SUBJ}, {POINTS}, {CODED},
geo_at AS (
  SELECT *, ['middle-east', 'eastern-europe', 'global'][event_id % 3 + 1] AS key, event_id // 150 AS page,
    date_trunc('day', ts) + to_hours((hour(ts) // 6) * 6 + 6) AS fetched
  FROM points LEFT JOIN hit USING (event_id)),
geo AS (
  SELECT 'gdelt' AS source, key, fetched, page, event_id AS k, lon, lat, event_type AS name, count, code AS nation,
    least(1e0, sqrt(greatest(count, 0)::DOUBLE / coalesce(max(CASE WHEN count > 0 THEN count END) OVER p, 1))) AS severity,
    row_number() OVER (p ORDER BY event_id) - 1 AS pos, true AS usable, fetched AS observed_at,
    CASE WHEN key = 'eastern-europe' OR (key = 'middle-east' AND hour(fetched) = 12) THEN 'markup'
         WHEN key = 'middle-east' AND hour(fetched) = 18 AND day(fetched) % 2 = 0 THEN 'malformed'
         WHEN key = 'global' AND hour(fetched) = 0 THEN 'missing' END AS reason
  FROM geo_at WINDOW p AS (PARTITION BY key, fetched, page)),
conflict_at AS (
  SELECT o_orderkey, o_orderpriority, o_orderstatus <> 'P' AS usable, ['IR', 'IL', 'UA', 'RU'][o_orderkey % 4 + 1] AS key,
    DATE '2024-01-10' + CAST(o_orderkey % 25 AS INTEGER) AS day, o_orderkey // 200 AS page,
    CAST(floor(o_totalprice / 100000) AS BIGINT) AS toll, 21e0 + ((o_orderkey * 7919) % 4900) / 1e2 AS lon,
    24e0 + ((o_orderkey * 104729) % 4650) / 1e2 AS lat FROM orders),
conflict_hit AS (
  SELECT o_orderkey, arg_min(code, priority) AS code FROM conflict_at JOIN subj
    ON lon BETWEEN west AND east AND lat BETWEEN south AND north GROUP BY 1),
conflict AS (
  SELECT 'acled' AS source, key, CAST(day + 1 AS TIMESTAMP) AS fetched, page, o_orderkey AS k, lon, lat,
    o_orderpriority || ' — ' || name AS name, 1 + toll AS count, h.code AS nation,
    least(1e0, 0.45e0 + log10(1e0 + toll) / 2) AS severity,
    row_number() OVER (PARTITION BY key, day, page ORDER BY o_orderkey) - 1 AS pos, usable,
    CAST(day AS TIMESTAMP) AS observed_at,
    CASE WHEN key = 'IL' AND day(day + 1) % 2 = 0 THEN 'markup' WHEN key IN ('UA', 'RU') THEN 'missing' END AS reason
  FROM conflict_at LEFT JOIN conflict_hit h USING (o_orderkey) JOIN subj ON subj.code = key),
polled AS (SELECT * FROM geo UNION ALL SELECT * FROM conflict),
log AS (
  SELECT source, key, fetched, count(*) FILTER (reason IS NOT NULL) = 0 AS ok, count(DISTINCT page) AS n_bodies,
    count(*) FILTER (usable AND reason IS NULL) AS n_rows, min(reason) AS reason
  FROM polled GROUP BY source, key, fetched)"""

LIVE = f"""{POLLS}, {THEATER}, {MEMBER}, {SEED},
anchors AS (SELECT source, key, max(fetched) AS anchor FROM log WHERE ok AND fetched <= {AS_OF} GROUP BY ALL),
reached AS (
  SELECT p.*, anchor, sha256(p.source || '|' || p.source || '/' || key || '/' || strftime(fetched, '%Y%m%d%H') || '/' || page || '|' || pos) AS id
  FROM polled p JOIN anchors USING (source, key)
  WHERE usable AND reason IS NULL AND fetched <= anchor
    AND CASE p.source WHEN 'gdelt' THEN fetched > anchor - INTERVAL 1 DAY
        ELSE observed_at BETWEEN anchor - INTERVAL 14 DAY AND anchor AND fetched >= anchor - INTERVAL 14 DAY END),
newest AS (
  SELECT *, row_number() OVER (PARTITION BY source, key ORDER BY observed_at DESC, pos, id) AS recent FROM reached),
placed AS (
  SELECT t.theater, n.*, 1 AS source_rank, 0 AS subject_priority FROM newest n JOIN theater_dim t ON t.theater = n.key
    AND lon BETWEEN west AND east AND lat BETWEEN south AND north WHERE source = 'gdelt'
  UNION ALL
  SELECT m.theater, n.*, 0, m.position FROM newest n JOIN member m ON m.code = n.key WHERE source = 'acled' AND recent <= 400),
ranked AS (
  SELECT theater, id, lon, lat, nation, severity, row_number() OVER (PARTITION BY theater
    ORDER BY severity DESC, source_rank, subject_priority, pos, id) AS rank FROM placed),
top AS (
  SELECT * FROM ranked WHERE rank <= 250
  UNION ALL
  SELECT t.theater, 'seed-' || pos, s.lon, s.lat, s.nation, s.severity, pos + 1 FROM theater_dim t, seed s
  WHERE t.theater NOT IN (SELECT theater FROM placed)),
state AS (
  SELECT t.theater, CASE WHEN t.theater IN (SELECT theater FROM placed) AND l.n_rows > 0
    AND {AS_OF} <= l.fetched + INTERVAL 60 SECOND THEN 'ok' ELSE 'degraded' END AS status
  FROM theater_dim t LEFT JOIN anchors a ON a.key = t.theater LEFT JOIN log l ON l.key = a.key AND l.fetched = a.anchor)"""

STATUS = f"""WITH e AS (SELECT user_id, ts, event_type <> 'error' AS good FROM events WHERE ts <= {AS_OF}),
first_at AS (SELECT user_id, min(ts) AS first, min(ts) FILTER (good) AS first_good FROM e GROUP BY 1),
g AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS prior FROM e WHERE good),
n AS (SELECT *, sum(CASE WHEN ts <= prior + INTERVAL 6 HOUR THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts
  ROWS UNBOUNDED PRECEDING) AS run FROM g),
r AS (SELECT user_id, run, min(ts) AS a, max(ts) + INTERVAL 6 HOUR AS b FROM n GROUP BY 1, 2),
f AS (SELECT *, coalesce(lead(a) OVER (PARTITION BY user_id ORDER BY a), {AS_OF}) AS c FROM r),
i AS (
  SELECT user_id, 'ok' AS status, a AS since, least(b, {AS_OF}) AS till FROM f
  UNION ALL SELECT user_id, 'degraded', b, c FROM f WHERE b < c
  UNION ALL SELECT user_id, 'offline', first, coalesce(first_good, {AS_OF}) FROM first_at
    WHERE first < coalesce(first_good, {AS_OF}))
SELECT user_id, status, strftime(since, {ISO}) AS since, strftime(till, {ISO}) AS till FROM i"""

FEED_ZONES = f"""WITH {POLLS},
areas AS (SELECT s_name, s_suppkey, 21e0 + ((s_suppkey * 7919) % 4900) / 1e2 AS mid_x,
  24e0 + ((s_suppkey * 104729) % 4650) / 1e2 AS mid_y, 0.25e0 + s_nationkey / 8e0 AS half FROM supplier),
told AS (SELECT source, key, fetched, page, pos, name, count, lon, lat,
    sha256(source || '|' || source || '/' || key || '/' || strftime(fetched, '%Y%m%d%H') || '/' || page || '|' || pos) AS id
  FROM polled WHERE usable AND reason IS NULL),
won AS (SELECT id, arg_min(s_name, s_suppkey) AS zone FROM told JOIN areas
  ON lon BETWEEN mid_x - half AND mid_x + half AND lat BETWEEN mid_y - half AND mid_y + half GROUP BY 1)
SELECT source, key, pos, id, name, count, zone AS nation FROM told LEFT JOIN won USING (id)"""

ORACLE = {
    "feed_zone_table": FEED_ZONES,
    "fetch_log": f"""WITH {POLLS}
SELECT source, key, strftime(fetched, {ISO}) AS "at", ok, n_bodies, n_rows, reason FROM log""",
    "landing_to_events": f"""WITH {LIVE},
hot AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY theater, nation ORDER BY severity DESC, rank) AS rn
  FROM top WHERE nation IS NOT NULL) WHERE rn = 1),
arcs AS (
  SELECT m.theater, m.position, 'arc-' || a.code || '-' || b.code AS key, coalesce(h.severity, 0.4e0) AS value,
         a.name || ' → ' || b.name AS word
  FROM member m JOIN subj a ON a.code = m.code JOIN subj b ON b.code = a.adversary
  JOIN member mb ON mb.theater = m.theater AND mb.code = b.code
  LEFT JOIN hot h ON h.theater = m.theater AND h.nation = m.code),
t AS (SELECT theater, nation, count(*) AS n, avg(severity) AS mean FROM top GROUP BY 1, 2),
j AS (SELECT m.theater, m.position, m.code, coalesce(n, 0) AS n, coalesce(mean, 0e0) AS mean
  FROM member m LEFT JOIN t ON t.theater = m.theater AND t.nation = m.code),
score AS (SELECT *, least(1e0, 0.55e0 * n / greatest(1, max(n) OVER (PARTITION BY theater)) + 0.45e0 * mean) AS score FROM j),
rows_ AS (
  SELECT theater, 'event' AS part, rank - 1 AS pos, id AS key, severity AS value, nation AS word FROM top
  UNION ALL SELECT theater, 'arc', row_number() OVER (PARTITION BY theater ORDER BY position) - 1, key, value, word FROM arcs
  UNION ALL SELECT theater, 'nation', position, code, score, {BANDS.format(x='score')} FROM score)
SELECT r.theater, s.status, strftime({AS_OF}, {ISO}) AS updated_at, part, CAST(pos AS BIGINT) AS pos, key,
  round(value, 6) AS value, word FROM rows_ r JOIN state s USING (theater)""",
    "last_good_answer": f"""WITH e AS (
  SELECT 'k' || (user_id % 40) AS key, date_trunc('day', ts)::TIMESTAMP AS fetched, event_id, user_id % 40 + day(ts) AS turn FROM events),
good AS (SELECT DISTINCT key, fetched FROM e WHERE turn % 7 <> 0 AND turn % 4 <> 1),
asks AS (SELECT key, unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-02-02', INTERVAL 1 DAY)) AS as_of
  FROM (SELECT DISTINCT key FROM e)),
served AS (SELECT a.key, a.as_of, max(g.fetched) AS fetched FROM asks a JOIN good g ON g.key = a.key AND g.fetched <= a.as_of GROUP BY ALL)
SELECT key, strftime(as_of, {ISO}) AS as_of, strftime(fetched, {ISO}) AS last_good, event_id FROM served JOIN e USING (key, fetched)""",
    "stream_articles": f"SELECT title, url, domain, country, seen, seen_ok FROM ({FIRST['article_scan']})",
    "stream_conflict": f"""WITH {SUBJ},
p AS (SELECT *, CAST(floor(o_orderkey / 50) AS BIGINT) AS origin, o_orderpriority = '5-LOW' AS low,
  21e0 + ((o_orderkey * 7919) % 4900) / 1e2 AS lon, 24e0 + ((o_orderkey * 104729) % 4650) / 1e2 AS lat,
  CASE WHEN o_orderpriority = '5-LOW' THEN 0 ELSE CAST(floor(o_totalprice / 100000) AS BIGINT) END AS toll FROM orders),
h AS (SELECT o_orderkey, arg_min(code, priority) AS code FROM p JOIN subj
  ON lon BETWEEN west AND east AND lat BETWEEN south AND north GROUP BY 1)
SELECT (CASE WHEN o_orderpriority = '1-URGENT' THEN 'Shelling' WHEN low THEN 'Event' ELSE 'Battle' END) || ' — ' ||
    (CASE WHEN o_orderstatus = 'F' THEN o_orderpriority WHEN origin % 2 = 0 THEN 'Ukraine' ELSE 'Iran & Iraq+' END) AS name,
  1 + toll AS count, code AS nation, round(least(1e0, 0.45e0 + log10(1e0 + toll) / 2), 6) AS severity,
  strftime(DATE '2024-01-10' + CAST(o_orderkey % 25 AS INTEGER), '%Y-%m-%d') AS event_date
FROM p LEFT JOIN h USING (o_orderkey) WHERE o_orderstatus <> 'P'""",
    "stream_reports": f"""WITH p AS (SELECT *, {NUMBERED.format(k='doc_id')} FROM documents)
SELECT text AS title, 'https://r.example.org/' || doc_id AS url,
  CASE WHEN lang = 'fr' THEN 'ReliefWeb' ELSE source END AS domain,
  CASE WHEN source <> 'src1' THEN lang WHEN origin % 2 = 0 THEN 'Ukraine' ELSE 'Iran' END AS country, lang <> 'de' AS seen_ok,
  CASE WHEN origin % 2 = 0 THEN 'UA' ELSE 'IR' END AS nation,
  CASE WHEN lang <> 'de' THEN '2024-01-15T09:30:00Z' ELSE '2024-01-30T00:00:00Z' END AS seen
FROM p WHERE lang <> 'es' AND text <> ''""",
    "stream_timelines": f"SELECT subject, 'tone' AS metric, pos, t, v FROM ({FIRST['timeline_scan']})",
    "stream_top_signals": FIRST["top_signals"],
    "stream_pressure": f"""WITH {SUBJ}, {THEATER}, {MEMBER}, {SCORED}, {CODED},
t AS (SELECT d.theater, h.code, count(*) AS n, avg(s.severity) AS mean FROM scored s JOIN hit h USING (event_id)
  JOIN theater_dim d ON s.lon BETWEEN d.west AND d.east AND s.lat BETWEEN d.south AND d.north GROUP BY 1, 2),
j AS (SELECT m.theater, m.code, coalesce(n, 0) AS events, coalesce(mean, 0e0) AS mean
  FROM member m LEFT JOIN t ON t.theater = m.theater AND t.code = m.code),
p AS (SELECT *, least(1e0, 0.55e0 * events / greatest(1, max(events) OVER (PARTITION BY theater)) + 0.45e0 * mean) AS score FROM j)
SELECT theater, code, events, round(score, 6) AS score, {BANDS.format(x='score')} AS threat FROM p""",
    "status_intervals": STATUS,
    "stream_status": STATUS,
}
