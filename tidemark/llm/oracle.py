"""DuckDB counterparts of the training-data queries that SQL can express."""

from __future__ import annotations

OP3 = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \x09-\x0D]+') AS w FROM documents
), shingle AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) AS i FROM words)
), size AS (
  SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id
), link AS (
  SELECT x, y FROM (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL) p
  JOIN size m ON m.doc_id = x JOIN size n ON n.doc_id = y WHERE 100 * c >= 85 * (m.n + n.n - c)
), reach(node, other) AS (
  SELECT x, y FROM link UNION SELECT reach.node, link.y FROM reach JOIN link ON link.x = reach.other
)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, least(d.doc_id, coalesce(r.low, d.doc_id)) AS component_id, d.doc_id <= coalesce(r.low, d.doc_id) AS kept
FROM documents d LEFT JOIN size s ON s.doc_id = d.doc_id LEFT JOIN (SELECT node, min(other) AS low FROM reach GROUP BY node) r ON r.node = d.doc_id
"""

OP11 = r"""
WITH cut AS (
  SELECT doc_id, text, len(t) AS n, t, least(h[1] % (len(t) + 1), h[2] % (len(t) + 1)) AS a, greatest(h[1] % (len(t) + 1), h[2] % (len(t) + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 50 THEN 'plain' WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[ \x09-\x0D]*[^ \x09-\x0D]+|[ \x09-\x0D]+') AS t,
          list_transform(range(4), lambda k: ('0x' || substr(sha256('42:' || coalesce(doc_id::VARCHAR, '')), 8 * k + 1, 8))::BIGINT) AS h FROM documents)
), part AS (
  SELECT *, array_to_string(t[1:a], '') AS p, array_to_string(t[a + 1:b], '') AS m, array_to_string(t[b + 1:], '') AS s FROM cut
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256
FROM part
"""

OP12 = r"""
WITH doc AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), word AS (
  SELECT d, lang, source, unnest(w) AS term FROM doc
), kept AS (
  SELECT lang, term FROM word GROUP BY lang, term HAVING count(DISTINCT d) >= 3
), size AS (
  SELECT lang, count(*) AS v FROM kept GROUP BY lang
), found AS (
  SELECT lang, source, term, count(*) AS c FROM word SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term
), grp AS (
  SELECT g.lang, g.source, coalesce(n, 0) AS n FROM (SELECT DISTINCT lang, source FROM doc) g LEFT JOIN (SELECT lang, source, sum(c) AS n FROM found GROUP BY lang, source) f USING (lang, source)
), p AS (
  SELECT g.lang, g.source, k.term, coalesce(f.c, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(f.c, 0) + 1)) // (g.n + s.v)::HUGEINT AS p
  FROM grp g JOIN kept k USING (lang) JOIN size s USING (lang) LEFT JOIN found f ON f.lang = g.lang AND f.source = g.source AND f.term = k.term
), q AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (t.c + 1)) // (n + v)::HUGEINT AS q
  FROM (SELECT lang, term, sum(c)::HUGEINT AS c FROM found GROUP BY lang, term) t JOIN (SELECT lang, sum(n)::HUGEINT AS n FROM grp GROUP BY lang) USING (lang) JOIN size USING (lang)
), pair AS (
  SELECT g.lang, g.source, h.source AS item, coalesce(f.value, 0) AS value FROM grp g JOIN grp h ON h.lang = g.lang AND h.source <> g.source
  LEFT JOIN (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY ALL) f
    ON f.lang = g.lang AND f.source = g.source AND f.item = h.source
), own AS (
  SELECT p.lang, p.source, p.term AS item, (p - q) * (p - q) // q AS value FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q
), ranked AS (
  SELECT *, 'pair' AS part, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, encode(item)) AS rank FROM pair
  UNION ALL SELECT *, 'term', row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, encode(item)) FROM own
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""
