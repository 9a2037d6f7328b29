"""The queries' results as SQL, where SQL can express them at a bearable cost."""

from __future__ import annotations

from signalgrid.llm.license_scan import templates

OP1 = """
WITH RECURSIVE e AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
), ok AS (
  SELECT * FROM e
  WHERE label IS NOT NULL AND v IS NOT NULL AND len(v) > 0
    AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(v, v) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b
    ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= 0.98
), reach AS (
  SELECT a AS id, a AS c FROM links UNION SELECT b.a, r.c FROM reach r JOIN links b ON b.b = r.id
), found AS (SELECT id, min(c) AS c FROM reach GROUP BY id),
n AS (SELECT a AS id, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links,
       coalesce(f.c, e.vec_id)::BIGINT AS component_id, coalesce(f.c, e.vec_id) = e.vec_id AS kept
FROM e LEFT JOIN found f ON f.id = e.vec_id LEFT JOIN n ON n.id = e.vec_id
"""

# The template doubles backslashes and puts one inside every control string.
_ESCAPED = """replace(replace(replace(replace(replace(replace(replace(replace({0}, '\\', '\\\\'),
  '<|', '<\\|'), '<s>', '<\\s>'), '</s>', '<\\/s>'), '[INST]', '[\\INST]'), '[/INST]', '[\\/INST]'),
  '<<SYS>>', '<\\<SYS>>'), '<</SYS>>', '<\\</SYS>>')"""

OP3 = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn), '')) AS loss_sha256,
       sum(length('<|turn|><|text|><|end|>') + 1 + length({_ESCAPED.format("role")})
           + length({_ESCAPED.format("text")}))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""

OP5 = """
WITH p AS (
  SELECT page_id, sha1(coalesce(html, '')) AS digest, strlen(coalesce(html, ''))::BIGINT AS size FROM pages
), t AS (SELECT digest, size, max(page_id) AS target FROM p WHERE size >= 1000 GROUP BY ALL)
SELECT p.page_id, p.size AS payload_bytes, p.digest AS payload_digest,
       CASE WHEN p.page_id < t.target THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN p.page_id < t.target THEN t.target END AS refers_to
FROM p LEFT JOIN t USING (digest, size)
"""

OP6 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s FROM w
), n AS (SELECT doc_id, len(s) AS n FROM s),
x AS (SELECT doc_id, unnest(s) AS g FROM s),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM common JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 75 * (p.n + q.n - c)
), reach AS (SELECT a AS id, a AS c FROM links UNION SELECT l.a, r.c FROM reach r JOIN links l ON l.b = r.id),
found AS (SELECT id, min(c) AS c FROM reach GROUP BY id)
SELECT n.doc_id, n.n::BIGINT AS n_shingles, coalesce(f.c, n.doc_id)::BIGINT AS component_id,
       coalesce(f.c, n.doc_id) = n.doc_id AS kept
FROM n LEFT JOIN found f ON f.id = n.doc_id
"""

_TEMPLATES = ", ".join(f"('{label}', {base}, {words})" for label, base, words in templates())

OP9 = f"""
WITH w AS (
  SELECT row_number() OVER () AS key, doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM documents
), t(label, base, t) AS (VALUES {_TEMPLATES}),
g AS (SELECT label, base, t, unnest(range(1, len(t) - 2)) AS q FROM t WHERE NOT base
      UNION ALL SELECT label, base, t, 1 FROM t WHERE base),
p AS (SELECT key, w, unnest(range(1, len(w) + 1)) AS p FROM w),
texts AS (SELECT key, w, label, t, p, q FROM p JOIN g ON w[p] = t[q] AND w[p + 1] = t[q + 1]
          WHERE NOT base AND w[p:p + 3] = t[q:q + 3]),
places AS (
  SELECT DISTINCT key, label, len(t) AS size, p - q AS d, q + i AS place
  FROM texts, range(-4, 8) r(i) WHERE q + i >= 1 AND p + i >= 1 AND w[p + i] = t[q + i]
), o AS (
  SELECT *, CASE WHEN d - lag(d) OVER (PARTITION BY key, label ORDER BY d) <= 3 THEN 0 ELSE 1 END AS new
  FROM (SELECT DISTINCT key, label, d FROM places)
), s AS (SELECT *, sum(new) OVER (PARTITION BY key, label ORDER BY d) AS span FROM o),
f AS (
  SELECT key, label, NULL AS at, count(DISTINCT place) / size AS share, false AS base
  FROM places JOIN s USING (key, label, d) GROUP BY key, label, size, span
  HAVING count(DISTINCT place) >= 0.5 * size AND max(d + place) - min(d + place) + 1 <= 2 * size
  UNION ALL
  SELECT key, label, p - 1, 1, true FROM p JOIN g ON w[p] = t[1] AND w[p + 1] = t[2]
  WHERE base AND w[p:p + len(t) - 1] = t
)
SELECT w.doc_id, len(any_value(w.w))::BIGINT AS n_words, count(*) FILTER (f.base)::BIGINT AS n_base,
       (min(f.at) FILTER (f.base))::BIGINT AS first_word, (max(f.at) FILTER (f.base))::BIGINT AS last_word,
       coalesce(array_to_string(list_sort(list(DISTINCT f.label) FILTER (f.base)), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list(DISTINCT f.label) FILTER (f.label IS NOT NULL)), ','), '') AS labels,
       coalesce(max(f.share), 0)::DOUBLE AS score
FROM w LEFT JOIN f ON f.key = w.key GROUP BY w.key, w.doc_id
"""

OP11 = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS turn FROM documents
), o AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY turn, size ROWS BETWEEN UNBOUNDED PRECEDING
    AND 1 PRECEDING), 0)::BIGINT AS done FROM d
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS kind
  FROM d GROUP BY source
), w AS (
  SELECT *, [5.0, 2.0, 1.0][kind + 1]::DOUBLE AS area, [7.5, 2.0, 0.5][kind + 1]::DOUBLE AS w0,
         [-5.0, 0.0, 1.0][kind + 1]::DOUBLE AS slope FROM s
), f AS (
  SELECT *, 2 * source_size / area AS fills_at, 1.5::DOUBLE * sum(source_size) OVER () AS budget, sum(area) OVER () AS weight,
         coalesce(sum(2 * source_size) OVER p, 0) AS limits, coalesce(sum(area) OVER p, 0) AS areas
  FROM w WINDOW p AS (ORDER BY 2 * source_size / area, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), l AS (
  SELECT max((budget - limits) / (weight - areas)) AS level FROM f WHERE (budget - limits) / (weight - areas) < fills_at
), t AS (
  SELECT f.*, CASE WHEN level IS NULL THEN 2 * source_size ELSE least(2 * source_size, area * level) END::DOUBLE AS target FROM f, l
), c AS (
  SELECT o.*, t.source_size, t.target, t.area, t.w0, t.slope, floor(t.target + 0.5)::BIGINT AS quota
  FROM o JOIN t ON o.source IS NOT DISTINCT FROM t.source
), x AS (
  SELECT *, greatest(0, least(size, quota - done)) AS first, greatest(0, least(size, quota - done - source_size)) AS again,
         CASE WHEN target > 0 THEN done / target * area END AS u, CASE WHEN target > 0 THEN (done + source_size) / target * area END AS v
  FROM c
), y AS (
  SELECT *, CASE WHEN u > 0 THEN 2.0::DOUBLE * u / (w0 + sqrt(greatest(0, w0 * w0 + 2.0::DOUBLE * slope * u))) ELSE 0 END AS p,
         CASE WHEN v > 0 THEN 2.0::DOUBLE * v / (w0 + sqrt(greatest(0, w0 * w0 + 2.0::DOUBLE * slope * v))) ELSE 0 END AS q FROM x
)
SELECT doc_id, source, size, source_size, target, (first + again)::BIGINT AS taken,
       CASE WHEN first > 0 THEN p WHEN again > 0 THEN q END::DOUBLE AS position,
       CASE WHEN first > 0 AND again > 0 THEN q END::DOUBLE AS position_again
FROM y
"""

OP12 = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, ''))::BIGINT AS n,
         sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), r AS (SELECT *, list_transform([1, 9, 17, 25], lambda i: ('0x' || substr(h, i, 8))::BIGINT) AS r FROM d),
c AS (
  SELECT *, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR r[3] % 100 >= 90
    THEN 'plain' WHEN r[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
    least(r[1] % (n + 1), r[2] % (n + 1)) AS a, greatest(r[1] % (n + 1), r[2] % (n + 1)) AS b FROM r
), p AS (SELECT *, substr(text, 1, a) AS prefix, substr(text, a + 1, b - a) AS middle, substr(text, b + 1) AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
         ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""

# SQL has no crc32: the table of its 256 remainders is worked out bit by bit, then a word's bytes go through it.
OP13 = """
WITH RECURSIVE crc AS MATERIALIZED (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS rest
), runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]{7,}')),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents
), own AS (SELECT id, run, count(*) AS k FROM runs GROUP BY ALL),
drawn AS (
  SELECT run, k, xor(list_reduce([4294967295] || list_transform(regexp_extract_all(hex(encode(id || ':' || run)), '..'),
    lambda x: ('0x' || x)::BIGINT), lambda c, x: xor(c >> 8, rest[xor(c, x) % 256 + 1])), 4294967295) AS h
  FROM own, crc
), words AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, k
  FROM drawn
), v AS (SELECT word, sum(k)::BIGINT AS n FROM words WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
cut AS (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)
), near AS (
  SELECT a.word, a.n, b.word AS other, b.n AS m FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, a.n, v.word, v.n FROM cut a JOIN v ON a.rest = v.word
  UNION SELECT v.word, v.n, a.word, a.n FROM cut a JOIN v ON a.rest = v.word
), best AS (SELECT word, n, count(*) AS n_near, first(other ORDER BY m DESC, other) AS other, max(m) AS m FROM near GROUP BY ALL),
form AS (SELECT word, other AS form, m AS form_n FROM best WHERE m >= 10 * n),
walk AS (
  SELECT word, form AS root, 1 AS steps FROM form
  UNION ALL SELECT w.word, f.form, steps + 1 FROM walk w JOIN form f ON f.word = w.root
), ends AS (SELECT word, arg_max(root, steps) AS root FROM walk GROUP BY word)
SELECT v.word, f.form, coalesce(e.root, v.word) AS root, v.n, coalesce(b.n_near, 0)::BIGINT AS n_near, f.form_n::BIGINT AS form_n
FROM v LEFT JOIN best b USING (word) LEFT JOIN form f USING (word) LEFT JOIN ends e USING (word)
"""

ORACLE = {
    "op1_embedding_dedup": OP1, "op3_chat_formatting": OP3, "op5_warc": OP5, "op6_minhash_dedup": OP6,
    "op9_license_scan": OP9, "op11_source_mixing": OP11, "op12_fill_in_middle": OP12, "op13_spelling_variants": OP13,
}
