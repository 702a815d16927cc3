"""SQL for DuckDB of the corpus queries that SQL can express over whole tables."""

from __future__ import annotations

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

OP3 = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) END AS s
  FROM words
), parts AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM parts a JOIN parts b ON a.x = b.x AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), pairs AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach(doc_id, root) AS (
  SELECT doc_id, doc_id FROM sets
  UNION SELECT e.b, r.root FROM reach r JOIN pairs e ON e.a = r.doc_id WHERE r.root < e.b
)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, min(r.root) AS component_id, s.doc_id = min(r.root) AS kept
FROM sets s JOIN reach r ON r.doc_id = s.doc_id GROUP BY s.doc_id, s.s
"""

OP4 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

OP9 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents
), places AS (SELECT doc_id, unnest(range(0, n - 199)) AS i, h FROM d WHERE n >= 200
), keyed AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 400)) AS k FROM places
), often AS (SELECT k FROM keyed GROUP BY k HAVING count(*) > 1
), hits AS (SELECT doc_id, i FROM keyed SEMI JOIN often USING (k)
), marked AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 200 THEN 0 ELSE 1 END AS new FROM hits
), runs AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM marked
), spans AS (SELECT doc_id, run, min(i) AS s, max(i) + 200 AS e FROM runs GROUP BY doc_id, run
), gaps AS (
  SELECT doc_id, s, e, lag(e, 1, 0) OVER (PARTITION BY doc_id ORDER BY s) AS before, lead(s) OVER (PARTITION BY doc_id ORDER BY s) AS next FROM spans
), kept AS (
  SELECT g.doc_id, sum(e - s) AS removed, count(*) AS n_spans,
    string_agg(substr(h, 2 * before + 1, 2 * (s - before)) || CASE WHEN next IS NULL THEN substr(h, 2 * e + 1) ELSE '' END, '' ORDER BY s) AS rest
  FROM gaps g JOIN d ON d.doc_id = g.doc_id GROUP BY g.doc_id
)
SELECT d.doc_id, CAST(d.n AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(rest, h))) AS kept_sha256
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id
"""

_NIBBLES = "".join(f"{i:04b}" for i in range(16))
_DIGIT = " + ".join(f"{16 >> k} * CAST(substr(bits, 5 * i + {k + 1}, 1) AS INTEGER)" for k in range(5))

OP10 = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS data FROM pages
), h AS (SELECT page_id, data, sha1(data) AS x, min(page_id) OVER (PARTITION BY data) AS first FROM p
), b AS (SELECT *, array_to_string(list_transform(range(1, 41), lambda i: substr('{_NIBBLES}', 4 * strpos('0123456789abcdef', substr(x, i, 1)) - 3, 4)), '') AS bits FROM h
)
SELECT page_id, CAST(octet_length(data) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('{_UPPER}234567', 1 + {_DIGIT}, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM b
"""
