"""DuckDB SQL of the queries that it can express, in their plain forms."""

from __future__ import annotations

#: All lines, those sharing a half compared in pairs.
LINE_DEDUP = r"""
WITH raw AS (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
    FROM documents WHERE text IS NOT NULL),
lines AS (
    SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS n FROM raw),
firsts AS (
    SELECT n, row_number() OVER (ORDER BY doc_id, pos) AS turn, doc_id, pos FROM (
        SELECT *, row_number() OVER (PARTITION BY n ORDER BY doc_id, pos) AS rn FROM lines WHERE n <> '') WHERE rn = 1),
halves AS (
    SELECT DISTINCT n, turn, side, half FROM (
        SELECT n, turn, unnest([1, 1, 2, 2]) AS side, unnest([substr(n, 1, length(n) // 2), substr(n, 1, (length(n) + 1) // 2),
            substr(n, (length(n) + 1) // 2 + 1), substr(n, length(n) // 2 + 1)]) AS half
        FROM firsts WHERE length(n) >= 20)),
losers AS (
    SELECT DISTINCT y.n FROM halves x JOIN halves y ON x.side = y.side AND x.half = y.half AND x.turn < y.turn
    WHERE abs(length(x.n) - length(y.n)) <= 1 AND levenshtein(x.n, y.n) <= 1),
stay AS (SELECT doc_id, pos FROM firsts WHERE n NOT IN (SELECT n FROM losers) UNION ALL SELECT doc_id, pos FROM lines WHERE n = '')
SELECT d.doc_id, coalesce(max(c.n_lines), 0) AS n_lines, coalesce(max(c.n_lines), 0) - count(l.pos) AS n_removed,
    sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.pos), '')) AS kept_sha256
FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n_lines FROM lines GROUP BY 1) c USING (doc_id)
LEFT JOIN (SELECT * FROM lines SEMI JOIN stay USING (doc_id, pos)) l USING (doc_id) GROUP BY 1"""

#: Every window of 100 bytes, numbered by its earliest place.
PASSAGES = r"""
WITH d AS (
    SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
starts AS (SELECT doc_id, h, unnest(range(n - 99)) AS s FROM d WHERE n >= 100),
again AS (
    SELECT doc_id, s FROM (
        SELECT doc_id, s, row_number() OVER (PARTITION BY b ORDER BY doc_id, s) AS rn
        FROM (SELECT doc_id, s, md5(substr(h, 2 * s + 1, 200)) AS b FROM starts)) WHERE rn > 1),
numbered AS (
    SELECT doc_id, s, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s) AS span FROM (
        SELECT doc_id, s, CASE WHEN s - lag(s) OVER (PARTITION BY doc_id ORDER BY s) <= 100 THEN 0 ELSE 1 END AS fresh
        FROM again)),
spans AS (SELECT doc_id, span, min(s) AS a, max(s) + 100 AS b FROM numbered GROUP BY 1, 2),
pieces AS (
    SELECT p.doc_id, p.a, substr(d.h, 2 * p.a + 1, 2 * (p.b - p.a)) AS piece FROM (
        SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS a, a AS b FROM spans
        UNION ALL SELECT d.doc_id, coalesce(max(b), 0), any_value(n) FROM d LEFT JOIN spans USING (doc_id) GROUP BY 1) p
    JOIN d USING (doc_id))
SELECT d.doc_id, any_value(d.n) AS n_bytes, any_value(coalesce(g.gone, 0)) AS n_removed, any_value(coalesce(g.k, 0)) AS n_spans,
    sha256(unhex(string_agg(piece, '' ORDER BY a))) AS kept_sha256
FROM d LEFT JOIN (SELECT doc_id, CAST(sum(b - a) AS BIGINT) AS gone, count(*) AS k FROM spans GROUP BY 1) g USING (doc_id)
JOIN pieces p USING (doc_id) GROUP BY 1"""

#: Every anchor against every row.
NEGATIVES = r"""
WITH e AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
    FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
        AND coalesce(list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))), true)),
met AS (
    SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
        CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
    FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (
    SELECT anchor_id, id AS positive_id, score AS positive_score FROM met WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN met USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) QUALIFY row_number() OVER w <= 10"""

ORACLES: dict[str, str] = {"op4_line_dedup": LINE_DEDUP, "op7_suffix_array_dedup": PASSAGES, "op11_hard_negatives": NEGATIVES}
