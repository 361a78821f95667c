"""DuckDB SQL for the queries of this subpackage that SQL can express over whole tables."""

from __future__ import annotations

ORACLE_SQL: dict[str, str] = {
    "op2_suffix_dedup": r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
part AS (SELECT k, unnest(range(0, len(x) // 2, 200)) AS lo, x FROM d),
s AS (SELECT k, lo, substr(x, 2 * lo + 1, 798) AS x FROM part),
o AS (SELECT k, lo, x, unnest(range(0, least(200, len(x) // 2))) AS off FROM s),
w AS (SELECT k, lo + off AS j, substr(x, 2 * off + 1, 2) AS byte,
             CASE WHEN 2 * off + 400 <= len(x) THEN md5(substr(x, 2 * off + 1, 400)) END AS win FROM o),
m AS (SELECT k, j, byte, win IS NOT NULL AND count(*) OVER (PARTITION BY win) > 1 AS again FROM w),
c AS (SELECT k, j, byte, bool_or(again) OVER (PARTITION BY k ORDER BY j ROWS 199 PRECEDING) AS gone FROM m),
e AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY k ORDER BY j), false) AS first FROM c),
r AS (SELECT k, count(*) FILTER (gone) AS n_removed, count(*) FILTER (first) AS n_spans,
             coalesce(string_agg(byte, '' ORDER BY j) FILTER (NOT gone), '') AS kept FROM e GROUP BY k)
SELECT doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(kept, x))) AS kept_sha256
FROM d LEFT JOIN r ON d.k = r.k""",
    "op6_decontamination": r"""
WITH i AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
l AS (SELECT item, w, least(13, len(w)) AS size FROM i WHERE len(w) > 0),
p AS (SELECT item, size, w, unnest(range(1, len(w) - size + 2)) AS j FROM l),
q AS (SELECT DISTINCT item, size, array_to_string(w[j:j + size - 1], ' ') AS phrase FROM p),
d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
s AS (SELECT k, size, w, unnest(range(1, len(w) - size + 2)) AS j FROM d, (SELECT DISTINCT size FROM l) WHERE len(w) >= size),
h AS (SELECT s.k, s.j, s.size, q.item FROM s JOIN q ON q.size = s.size AND q.phrase = array_to_string(s.w[s.j:s.j + s.size - 1], ' ')),
n AS (SELECT k, count(DISTINCT pos) AS n_hit FROM (SELECT k, unnest(range(j, j + size)) AS pos FROM h) GROUP BY k),
g AS (SELECT k, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT k, item FROM h) GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM d LEFT JOIN n ON d.k = n.k LEFT JOIN g ON d.k = g.k""",
    "op7_warc_fixity": """
WITH r AS (
  SELECT page_id, left(md5(url), 2) AS d, row_number() OVER () AS k,
         'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '')
           || chr(13) || chr(10) || 'Content-Length: ' AS head,
         coalesce(html, '') AS body, chr(13) || chr(10) || chr(13) || chr(10) AS gap
  FROM pages),
t AS (SELECT page_id, d, head || strlen(body) || gap || body || gap AS rec,
             head || (strlen(body) + 1) || gap || body || chr(0) || gap AS bad, head || '0' || gap || gap AS ghost FROM r),
o AS (SELECT *, sha256(rec) AS leaf, CAST(coalesce(sum(strlen(rec)) OVER (
        ORDER BY page_id, sha256(rec) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM t)
SELECT page_id, 'corrupt' AS status, leaf AS expected, sha256(bad) AS found, "offset", strlen(rec) AS length FROM o WHERE d = '00'
UNION ALL SELECT page_id, 'missing', leaf, NULL, "offset", strlen(rec) FROM o WHERE d = '01'
UNION ALL SELECT page_id, 'extra', NULL, sha256(ghost), NULL, NULL FROM o WHERE d = '02'""",
    "op8_substring_dedup": r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
p AS (SELECT k, doc_id, w, unnest(range(1, len(w) + 1)) AS j FROM d),
m AS (SELECT k, j, w[j] AS word, j <= len(w) - 19 AND row_number() OVER (
               PARTITION BY j <= len(w) - 19, array_to_string(w[j:j + 19], ' ') ORDER BY doc_id, k, j) > 1 AS again FROM p),
c AS (SELECT k, j, word, bool_or(again) OVER (PARTITION BY k ORDER BY j ROWS 19 PRECEDING) AS gone FROM m),
r AS (SELECT k, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY j) FILTER (NOT gone), '') AS kept
      FROM c GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN r ON d.k = r.k""",
    "op12_periodic_runs": r"""
WITH RECURSIVE z AS (
  SELECT DISTINCT doc_id, coalesce(CAST(doc_id AS VARCHAR), '') AS s, 0 AS bit, CAST(4294967295 AS BIGINT) AS c FROM documents
  UNION ALL
  SELECT doc_id, s, bit + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM (
    SELECT doc_id, s, bit, CASE WHEN bit % 8 = 0 THEN xor(c, CAST(ascii(s[bit // 8 + 1]) AS BIGINT)) ELSE c END AS v
    FROM z WHERE bit < 8 * len(s))),
hash AS (SELECT doc_id, xor(c, 4294967295) AS h FROM z WHERE bit = 8 * len(s)),
t AS (SELECT row_number() OVER () AS k, d.doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w,
             coalesce(h, 1) AS h, coalesce(h, 1) // 10 AS g FROM documents d LEFT JOIN hash ON d.doc_id = hash.doc_id),
a AS (SELECT *, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN g % len(w) ELSE len(w) END AS a0 FROM t),
p AS (SELECT *, 1 + (len(w) - a0) // (3 + g % 8) AS lap, unnest(range(0, len(w))) AS i FROM a),
v AS (SELECT k, i, len(w) AS n, w[CASE WHEN i < a0 THEN i ELSE a0 + (i - a0) % lap END + 1] AS word FROM p),
e AS (SELECT x.k, x.i, y.i - x.i AS q FROM v x JOIN v y ON x.k = y.k AND x.word = y.word AND y.i > x.i AND 3 * (y.i - x.i) <= x.n),
f AS (SELECT k, q, i, i - row_number() OVER (PARTITION BY k, q ORDER BY i) AS island FROM e),
o AS (SELECT k, q, min(i) AS start, count(*) + q AS length FROM f GROUP BY k, q, island HAVING count(*) + q >= greatest(24, 3 * q)),
r AS (SELECT * FROM o WHERE NOT EXISTS (SELECT 1 FROM o s WHERE s.k = o.k AND s.q < o.q AND o.q % s.q = 0
                                       AND s.start <= o.start AND s.start + s.length >= o.start + o.length)),
u AS (SELECT k, count(*) AS n_runs, string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS runs FROM r GROUP BY k),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY CAST(length AS DOUBLE) / q DESC, start, q) AS place FROM r)
         WHERE place = 1),
gone AS (SELECT DISTINCT k, unnest(range(start + q, start + length)) AS i FROM r),
kept AS (SELECT v.k, string_agg(word, ' ' ORDER BY v.i) AS words FROM v LEFT JOIN gone ON v.k = gone.k AND v.i = gone.i
         WHERE gone.i IS NULL GROUP BY v.k)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.start, best.length, best.q AS period,
       CAST(1000 * best.length // best.q AS BIGINT) AS exponent_milli, sha256(coalesce(runs, '')) AS runs_sha256,
       sha256(coalesce(words, '')) AS collapsed_sha256
FROM t LEFT JOIN u ON t.k = u.k LEFT JOIN best ON t.k = best.k LEFT JOIN kept ON t.k = kept.k""",
    "op13_source_mixing": r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || md5(text)) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
             row_number() OVER (ORDER BY source IS NULL, source) - 1 AS no FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][no % 3 + 1] AS weight, 2 * source_size AS cap FROM s),
f AS (SELECT *, CAST(sum(source_size) OVER () AS DOUBLE) * 1.5e0 AS budget, CAST(cap AS DOUBLE) / weight AS full_at FROM w),
v AS (SELECT *, (budget - CAST(coalesce(sum(cap) OVER (ORDER BY full_at, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
                  / CAST(sum(weight) OVER (ORDER BY full_at, no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM f),
t AS (SELECT source, no, source_size, budget,
             least(CAST(cap AS DOUBLE), weight * max(CASE WHEN level <= full_at THEN level END) OVER ()) AS target FROM v),
q AS (SELECT row_number() OVER () AS row, d.*, t.no, t.source_size, t.target, t.budget,
             CAST(sum(size) OVER (PARTITION BY t.no ORDER BY key, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS queued
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source WHERE size > 0),
i AS (SELECT *, queued + turn * source_size AS ends FROM q, (VALUES (0), (1)) AS r(turn)),
m AS (SELECT *, sum(size) OVER (ORDER BY ends / target, no, ends ROWS UNBOUNDED PRECEDING) AS upto FROM i)
SELECT doc_id, size, source_size, target, CAST(sum(CASE WHEN upto <= budget THEN size ELSE 0 END) AS BIGINT) AS taken
FROM m GROUP BY row, doc_id, size, source_size, target
UNION ALL
SELECT doc_id, size, source_size, target, 0 FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source WHERE size = 0""",
}
