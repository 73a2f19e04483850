"""DuckDB statements for the queries of this package that SQL can express."""

from __future__ import annotations


TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS vector
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.vector, c.vector) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.vector) = len(c.vector)
  WHERE q.vec_id % 100 = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS "rank" FROM scored
)
SELECT query_id, "rank", vec_id, score FROM ranked WHERE "rank" <= 10
"""

LINE_DEDUP = r"""
WITH split AS (
  SELECT doc_id, coalesce(source, chr(0)) AS site, string_split(text, chr(10)) AS lines FROM documents
), line AS (
  SELECT doc_id, site, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM split
), spread AS (
  SELECT trim(line) AS line, min((doc_id, pos)) AS first
  FROM line WHERE regexp_matches(trim(line), '^\S+\s+\S+\s+\S+')
  GROUP BY 1 HAVING count(DISTINCT site) >= 3
), judged AS (
  SELECT l.doc_id, l.pos, l.line, s.line IS NOT NULL AND (l.doc_id, l.pos) <> s.first AS gone
  FROM line l LEFT JOIN spread s ON trim(l.line) = s.line
), cleaned AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
         coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS text
  FROM judged GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed,
       CAST(length(c.text) AS BIGINT) AS n_chars, md5(c.text) AS text_md5
FROM documents d LEFT JOIN cleaned c USING (doc_id)
"""

DECONTAMINATION = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM benchmark
), b_start AS (
  SELECT item_id, words, unnest(range(1, greatest(1, len(words) - 12) + 1)) AS i FROM b WHERE len(words) > 0
), win AS (
  SELECT DISTINCT item_id, words[i:i + 12] AS terms FROM b_start
), lengths AS (
  SELECT DISTINCT len(terms) AS n FROM win
), d_start AS (
  SELECT doc_id, n, words, unnest(range(1, len(words) - n + 2)) AS i FROM d, lengths WHERE len(words) >= n
), hit AS (
  SELECT s.doc_id, s.i, s.n, w.item_id FROM d_start s JOIN win w ON s.words[s.i:s.i + s.n - 1] = w.terms
), covered AS (
  SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS pos FROM hit) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(DISTINCT CAST(item_id AS VARCHAR)) AS n_items,
         string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items
  FROM hit GROUP BY doc_id
)
SELECT d.doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""

JACCARD_JOIN = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents
), starts AS (
  SELECT doc_id, words, unnest(range(1, greatest(1, len(words) - 2) + 1)) AS i FROM w WHERE len(words) > 0
), shingle AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + 2], ' ') AS s FROM starts
), size AS MATERIALIZED (
  SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id
), link AS MATERIALIZED (
  SELECT c.x, c.y
  FROM (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM shingle a JOIN shingle b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2) c
  JOIN size p ON p.doc_id = c.x JOIN size q ON q.doc_id = c.y
  WHERE 100 * common >= 90 * (p.n + q.n - common)
), reach AS (
  SELECT doc_id, doc_id AS other FROM w
  UNION
  SELECT r.doc_id, l.y FROM reach r JOIN link l ON l.x = r.other
)
SELECT r.doc_id, coalesce(max(size.n), 0) AS n_shingles, min(other) AS component_id
FROM reach r LEFT JOIN size USING (doc_id) GROUP BY r.doc_id
"""

CONVERSATION_REPAIR = r"""
WITH RECURSIVE crc_table AS (
  SELECT n, list_reduce([n] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS value
  FROM (SELECT unnest(range(256)) AS n)
), raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key
  FROM conversations
), crc AS (
  SELECT DISTINCT key, 0 AS i, CAST(4294967295 AS BIGINT) AS c FROM raw
  UNION ALL
  SELECT key, i + 1, xor(c >> 8, value) FROM crc JOIN crc_table ON n = xor(c & 255, CAST(ascii(key[i + 1]) AS BIGINT)) WHERE i < length(key)
), draw AS MATERIALIZED (
  SELECT key, xor(c, 4294967295) % 20 AS d FROM crc WHERE i = length(key)
), damaged AS (
  SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role,
         CASE d WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(range(CASE WHEN d = 3 THEN 2 ELSE 1 END)) AS copy
  FROM raw JOIN draw USING (key) WHERE d <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS pos,
         right(rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS last
  FROM damaged
), judged AS MATERIALIZED (
  SELECT *, left(role, 1) AS initial,
         CASE WHEN last = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate'
              WHEN last NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'none' END AS fault,
         coalesce(lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) || left(role, 1) NOT IN ('su', 'ua', 'au'), false) AS illegal
  FROM placed
), counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
         count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE illegal) AS illegal, count(*) AS n_rows
  FROM judged GROUP BY conv_id
), inserted (a, b, added, audit, texts) AS (
  VALUES (0, 0, 0, '', []), (1, 1, 0, '', []), (2, 2, 0, '', []), (3, 3, 0, '', []),
         (0, 2, 3, 'I', ['user:']), (1, 2, 3, 'I', ['user:']), (3, 2, 3, 'I', ['user:']), (2, 3, 3, 'I', ['assistant:']),
         (0, 3, 6, 'II', ['user:', 'assistant:']), (1, 3, 6, 'II', ['user:', 'assistant:'])
), edits (a, b, edit, initial, role) AS (
  VALUES (0, 0, 'D', NULL, NULL), (1, 1, 'D', NULL, NULL), (2, 2, 'D', NULL, NULL), (3, 3, 'D', NULL, NULL),
         (0, 2, 'R', NULL, 'user'), (1, 2, 'R', NULL, 'user'), (3, 2, 'R', NULL, 'user'), (2, 3, 'R', NULL, 'assistant'),
         (0, 1, 'K', 's', NULL), (0, 2, 'K', 'u', NULL), (1, 2, 'K', 'u', NULL), (3, 2, 'K', 'u', NULL), (2, 3, 'K', 'a', NULL)
), way AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS pos, 0 AS state, {'cost': 0, 'audit': '', 'texts': CAST([] AS VARCHAR[])} AS best FROM counted
  UNION ALL
  SELECT w.conv_id, j.pos, e.b, min({
    'cost': w.best.cost + i.added + CASE e.edit WHEN 'D' THEN 4 WHEN 'R' THEN 3 ELSE 0 END + CASE WHEN e.edit <> 'D' AND j.fault = 'truncated' THEN 3 ELSE 0 END,
    'audit': w.best.audit || i.audit || e.edit,
    'texts': w.best.texts || CAST(i.texts AS VARCHAR[]) || CASE WHEN e.edit = 'D' THEN CAST([] AS VARCHAR[]) ELSE [coalesce(e.role, j.role) || ':' || j.text] END
  })
  FROM way w
  JOIN judged j ON j.conv_id IS NOT DISTINCT FROM w.conv_id AND j.pos = w.pos + 1
  JOIN inserted i ON i.a = w.state
  JOIN edits e ON e.a = i.b AND (e.edit = 'D' OR j.fault IN ('none', 'truncated') AND (e.initial IS NULL OR e.initial = j.initial))
  GROUP BY w.conv_id, j.pos, e.b
), ended AS (
  SELECT w.conv_id, min({'cost': w.best.cost + i.added, 'audit': w.best.audit || i.audit, 'texts': w.best.texts || CAST(i.texts AS VARCHAR[])}) AS best
  FROM way w JOIN counted c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.n_rows = w.pos
  JOIN inserted i ON i.a = w.state AND i.b IN (0, 3)
  GROUP BY w.conv_id
)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, CAST(coalesce(best.cost, 0) AS BIGINT) AS cost, coalesce(best.audit, '') AS audit,
       sha256(coalesce(array_to_string(best.texts, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM o.conv_id
"""


def statements() -> dict[str, str]:
    return {"op9_jaccard_join": JACCARD_JOIN, "op2_decontamination": DECONTAMINATION, "op6_line_dedup": LINE_DEDUP, "op8_exact_topk": TOP_K, "op11_conversation_repair": CONVERSATION_REPAIR}
