"""SQL of the operators that SQL can express."""

from __future__ import annotations

_LOWER = "TRANSLATE({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_KEY = _LOWER.format("TRIM(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")

LINE_DEDUP = f"""
WITH split AS (SELECT doc_id, STRING_SPLIT(COALESCE(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, UNNEST(ls) AS line, UNNEST(RANGE(LEN(ls))) AS i FROM split),
keyed AS (SELECT doc_id, i, line, {_KEY} AS key FROM lines),
frequent AS (SELECT key, MAX(doc_id) AS last FROM keyed WHERE LENGTH(key) >= 40 GROUP BY key HAVING COUNT(DISTINCT doc_id) >= 5),
judged AS (SELECT k.doc_id, k.i, k.line, f.key IS NOT NULL AND f.last <> k.doc_id AS gone FROM keyed k LEFT JOIN frequent f ON f.key = k.key)
SELECT doc_id, COUNT(*) AS n_lines, COUNT(*) FILTER (gone) AS n_dropped, SHA256(COALESCE(STRING_AGG(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

_WORDS = "REGEXP_EXTRACT_ALL(" + _LOWER.format("COALESCE(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
windows AS (SELECT item, LEAST(13, LEN(w)) AS n, UNNEST(LIST_TRANSFORM(RANGE(1, LEN(w) - LEAST(13, LEN(w)) + 2), lambda i: ARRAY_TO_STRING(w[i:i + LEAST(13, LEN(w)) - 1], ' '))) AS s FROM b WHERE LEN(w) > 0),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (SELECT doc_id, n, UNNEST(RANGE(1, LEN(w) - n + 2)) AS p, UNNEST(LIST_TRANSFORM(RANGE(1, LEN(w) - n + 2), lambda i: ARRAY_TO_STRING(w[i:i + n - 1], ' '))) AS s FROM d, sizes WHERE LEN(w) >= n),
found AS (SELECT DISTINCT p.doc_id, p.p, p.n, x.item FROM places p JOIN windows x ON x.n = p.n AND x.s = p.s),
hit AS (SELECT doc_id, COUNT(DISTINCT q) AS n_hit FROM (SELECT doc_id, UNNEST(RANGE(p, p + n)) AS q FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, COUNT(*) AS n_items, STRING_AGG(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(LEN(w) AS BIGINT) AS n_words, COALESCE(n_hit, 0) AS n_hit, COALESCE(n_items, 0) AS n_items, SHA256(COALESCE(names, '')) AS items_sha256, COALESCE(n_hit, 0) > 0 AND 20 * COALESCE(n_hit, 0) >= LEN(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

FILTER_AUDIT = r"""
WITH RECURSIVE d AS (SELECT doc_id, COALESCE(lang, '') AS part, COALESCE(text, '') AS t, REGEXP_EXTRACT_ALL(COALESCE(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, BOOL_OR(COALESCE(quality = 1, FALSE)) AS good, BOOL_OR(COALESCE(toxic = 1, FALSE)) AS toxic FROM labels GROUP BY doc_id),
failed AS (
  SELECT part, COALESCE(good, FALSE) AS good, COALESCE(toxic, FALSE) AS toxic,
    CASE WHEN LEN(w) < 100 THEN 'A' ELSE '' END || CASE WHEN 100 * LEN(LIST_DISTINCT(w)) < 80 * LEN(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * LEN(REGEXP_EXTRACT_ALL(t, '[A-Z]')) > 10 * LENGTH(t) THEN 'C' ELSE '' END || CASE WHEN REGEXP_MATCHES(t, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN doc_id > MIN(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS f
  FROM d LEFT JOIN l USING (doc_id)),
orders AS (SELECT '' AS o UNION ALL SELECT o || x FROM orders, (SELECT UNNEST(['A', 'B', 'C', 'D', 'E']) AS x) WHERE NOT CONTAINS(o, x)),
steps AS (SELECT o, CAST(UNNEST([1, 2, 3, 4, 5]) AS INT) AS step FROM orders WHERE LENGTH(o) = 5),
walked AS (
  SELECT part, o, step, o[step] AS x, f, good, toxic, CONTAINS(f, o[step]) AS fails, LENGTH(TRANSLATE(f, LEFT(o, step - 1), '')) < LENGTH(f) AS earlier FROM failed, steps),
counted AS (
  SELECT part, o AS filter_order, step, x, COUNT(*) FILTER (NOT fails AND NOT earlier) AS kept, COUNT(*) FILTER (fails AND NOT earlier) AS removed, COUNT(*) FILTER (fails AND earlier) AS redundant,
    COUNT(*) FILTER (f = x) AS unique_fails, COUNT(*) FILTER (fails AND NOT earlier AND good) AS good_lost, COUNT(*) FILTER (fails AND NOT earlier AND toxic) AS toxic_lost
  FROM walked GROUP BY ALL)
SELECT * EXCLUDE (x), CAST(SUM(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley FROM counted
"""

#: CRC-32 with the table of bytes made by rule: ``crc`` has 256 entries.
_CRC_TABLE = "SELECT LIST(LIST_REDUCE(RANGE(8), lambda a, k: CASE WHEN a & 1 = 1 THEN XOR(a >> 1, 3988292384) ELSE a >> 1 END, CAST(b AS BIGINT)) ORDER BY b) AS crc FROM RANGE(256) AS r(b)"
_BYTES = "LIST_TRANSFORM(REGEXP_EXTRACT_ALL(HEX(ENCODE({})), '..'), lambda x: CAST('0x' || x AS BIGINT))"
_CRC = "XOR(LIST_REDUCE({}, lambda a, x: XOR(a >> 8, crc[1 + (XOR(a, x) & 255)]), CAST(4294967295 AS BIGINT)), 4294967295)"

RENDEZVOUS = f"""
WITH t AS ({_CRC_TABLE}),
d AS (SELECT doc_id, COALESCE(text, '') AS text, {_BYTES.format("COALESCE(text, '')")} AS b FROM documents),
drawn AS (SELECT d.*, LIST_TRANSFORM(RANGE(9), lambda k: -LN((CAST('0x' || LEFT(MD5(COALESCE(CAST(doc_id AS VARCHAR), '') || ':' || k), 13) AS BIGINT) + 0.5) / 4503599627370496)) AS draws FROM d),
sized AS (
  SELECT doc_id, CAST(LEN(b) + 1 AS BIGINT) AS size, {_CRC.format("b")} AS text_crc32,
    CAST(LIST_POSITION(draws, LIST_MIN(draws[1:8])) - 1 AS INT) AS shard, CAST(LIST_POSITION(draws, LIST_MIN(draws)) - 1 AS INT) AS grown_shard
  FROM drawn, t)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, ROW_NUMBER() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, grown_shard FROM sized
"""

_BLANKS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

REPAIR = f"""
WITH RECURSIVE t AS ({_CRC_TABLE}),
c AS (SELECT conv_id, turn, COALESCE(role, ' ') AS role, COALESCE(text, ' ') AS text, {_BYTES.format("COALESCE(CAST(conv_id AS VARCHAR), ' ') || ':' || COALESCE(CAST(turn AS VARCHAR), ' ')")} AS b FROM conversations),
f AS (SELECT c.*, {_CRC.format("b")} % 20 AS fault FROM c, t),
damaged AS (
  SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
    CASE fault WHEN 1 THEN '' WHEN 2 THEN TRANSLATE(text, '.!?', '') ELSE text END AS text, UNNEST(CASE WHEN fault = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM f WHERE fault <> 0),
placed AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n, RTRIM(text, {_BLANKS}) AS bare FROM damaged),
judged AS (
  SELECT *, LEFT(role, 1) AS x, LAG(LEFT(role, 1)) OVER (PARTITION BY conv_id ORDER BY n) || LEFT(role, 1) AS pair,
    CASE WHEN bare = '' THEN 'blank' WHEN ROW_NUMBER() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 'duplicate'
      WHEN RIGHT(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
  FROM placed),
states(state, wanted) AS (VALUES (0, 'u'), (1, 'u'), (2, 'a'), (3, 'u')),
-- Insertions before a turn that stays: none, or one.
opened AS (
  SELECT state AS begun, state, wanted, 0 AS cost, '' AS letters, '' AS written FROM states
  UNION ALL SELECT s.state, z.state, z.wanted, 5, 'I', chr(10) || CASE s.wanted WHEN 'u' THEN 'user:' ELSE 'assistant:' END FROM states s JOIN states z ON z.state = CASE s.wanted WHEN 'u' THEN 2 ELSE 3 END),
walk AS (
  SELECT DISTINCT conv_id, 0 AS n, 0 AS state, {{'cost': 0, 'audit': '', 'written': ''}} AS best FROM conversations
  UNION ALL
  SELECT conv_id, n, state, MIN(best) FROM (
    SELECT w.conv_id, j.n, m.state, {{'cost': (w.best).cost + m.cost, 'audit': (w.best).audit || m.letters, 'written': (w.best).written || m.written}} AS best
    FROM walk w JOIN judged j ON j.conv_id IS NOT DISTINCT FROM w.conv_id AND j.n = w.n + 1,
    LATERAL (
      SELECT w.state AS state, 2 AS cost, 'D' AS letters, '' AS written
      UNION ALL SELECT CASE o.wanted WHEN 'u' THEN 2 ELSE 3 END, o.cost + 1 + CASE j.fault WHEN 'truncated' THEN 5 ELSE 0 END, o.letters || 'R', o.written || chr(10) || CASE o.wanted WHEN 'u' THEN 'user:' ELSE 'assistant:' END || j.text
        FROM opened o WHERE o.begun = w.state AND j.fault NOT IN ('blank', 'duplicate')
      UNION ALL SELECT CASE j.x WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END, o.cost + CASE j.fault WHEN 'truncated' THEN 5 ELSE 0 END, o.letters || 'K', o.written || chr(10) || j.role || ':' || j.text
        FROM opened o WHERE o.begun = w.state AND j.fault NOT IN ('blank', 'duplicate') AND (j.x = o.wanted OR j.x = 's' AND o.state = 0)) m)
  GROUP BY conv_id, n, state),
lengths AS (SELECT conv_id, MAX(n) AS n FROM walk GROUP BY conv_id),
ended AS (
  SELECT conv_id, MIN({{'cost': (best).cost + CASE state WHEN 1 THEN 10 WHEN 2 THEN 5 ELSE 0 END, 'audit': (best).audit || CASE state WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END,
    'written': (best).written || CASE state WHEN 1 THEN chr(10) || 'user:' || chr(10) || 'assistant:' WHEN 2 THEN chr(10) || 'assistant:' ELSE '' END}}) AS best
  FROM walk w WHERE n = (SELECT n FROM lengths l WHERE l.conv_id IS NOT DISTINCT FROM w.conv_id) GROUP BY conv_id),
counts AS (
  SELECT conv_id, COALESCE(MAX(turn) - MIN(turn) + 1 - COUNT(DISTINCT turn), 0) AS gaps, COUNT(*) FILTER (fault = 'blank') AS blank, COUNT(*) FILTER (fault = 'duplicate') AS duplicate,
    COUNT(*) FILTER (fault = 'truncated') AS truncated, COUNT(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM judged GROUP BY conv_id)
SELECT e.conv_id, COALESCE(gaps, 0) AS gaps, COALESCE(blank, 0) AS blank, COALESCE(duplicate, 0) AS duplicate, COALESCE(truncated, 0) AS truncated, COALESCE(illegal, 0) AS illegal,
  CAST((best).cost AS BIGINT) AS cost, (best).audit AS audit, SHA256(SUBSTR((best).written, 2)) AS repaired_sha256
FROM ended e LEFT JOIN counts k ON k.conv_id IS NOT DISTINCT FROM e.conv_id
"""
