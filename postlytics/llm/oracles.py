"""DuckDB twins of the operators that SQL can express."""

from __future__ import annotations

OP9_MIXING = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight,
    2.0::DOUBLE * source_size AS cap FROM s
), f AS (
  SELECT *, cap / weight AS filled, 1.5::DOUBLE * sum(source_size) OVER () AS total, sum(weight) OVER () AS weights,
    sum(cap) OVER o - cap AS caps_before, sum(weight) OVER o - weight AS weights_before
  FROM w WINDOW o AS (ORDER BY cap / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)
), l AS (
  SELECT *, (total - caps_before) / (weights - weights_before) AS level FROM f
), t AS (
  SELECT source, source_size,
    least(cap, coalesce(weight * (SELECT min_by(level, filled) FROM l WHERE level <= filled), cap)) AS target FROM l
), r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS each,
    row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id) - 1 AS place,
    ('0x' || substr(md5('mix' || coalesce(d.source, '')), 1, 8))::UBIGINT::DOUBLE / 4294967296.0 AS off
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  (least(floor((place + 1) * each + off) - floor(place * each + off), 2) * size)::BIGINT AS taken
FROM r
"""

_NEXT = ", ".join(f"lead(word, {k}) OVER o" for k in range(20))

OP4_SUBSTRINGS = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), words AS MATERIALIZED (
  SELECT doc_id, len(w) AS size, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d
), windows AS (
  SELECT doc_id, p, size, concat_ws(' ', {_NEXT}) AS said FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY p)
), ranked AS (
  SELECT doc_id, p, row_number() OVER (PARTITION BY said ORDER BY doc_id, p) AS n FROM windows WHERE p <= size - 19
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS p FROM ranked WHERE n > 1
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text, count(*) AS n
  FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed,
  sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

OP5_EMBEDDINGS = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
    AND len(list_filter(embedding, lambda e: e <> 0)) > 0
), links AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
  ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= 0.95
), reached AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a
)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(least_id, vec_id)) AS component_id,
  vec_id = least(vec_id, coalesce(least_id, vec_id)) AS kept
FROM embeddings
LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a) USING (vec_id)
LEFT JOIN (SELECT a AS vec_id, min(b) AS least_id FROM reached GROUP BY a) USING (vec_id)
"""

OP11_PHRASES = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), p AS MATERIALIZED (
  SELECT lang, w, len(w) AS size FROM (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM d) WHERE len(w) > 0
), f1 AS MATERIALIZED (
  SELECT lang, w1, count(*) AS f FROM (SELECT lang, unnest(w) AS w1 FROM p) GROUP BY ALL
), f2 AS MATERIALIZED (
  SELECT lang, w[i] AS w1, w[i + 1] AS w2, count(*) AS f
  FROM (SELECT lang, w, unnest(range(1, size)) AS i FROM p) GROUP BY ALL
), f3 AS MATERIALIZED (
  SELECT lang, w[i] AS w1, w[i + 1] AS w2, w[i + 2] AS w3, count(*) AS f
  FROM (SELECT lang, w, unnest(range(1, size - 1)) AS i FROM p) GROUP BY ALL HAVING count(*) >= 10
), c2 AS (
  SELECT f2.lang, f2.w1 || ' ' || f2.w2 AS phrase, f2.f AS a, l.f AS l, r.f AS r,
    (1000000::HUGEINT * f2.f * f2.f) // (l.f::HUGEINT * r.f) AS score
  FROM f2 JOIN f1 l ON l.lang = f2.lang AND l.w1 = f2.w1 JOIN f1 r ON r.lang = f2.lang AND r.w1 = f2.w2
  WHERE f2.f >= 10
    AND NOT EXISTS (FROM f3 WHERE f3.lang = f2.lang AND f3.w1 = f2.w1 AND f3.w2 = f2.w2 AND 100 * f3.f >= 50 * f2.f)
    AND NOT EXISTS (FROM f3 WHERE f3.lang = f2.lang AND f3.w2 = f2.w1 AND f3.w3 = f2.w2 AND 100 * f3.f >= 50 * f2.f)
), c3 AS (
  SELECT f3.lang, f3.w1 || ' ' || f3.w2 || ' ' || f3.w3 AS phrase, f3.f AS a, x.f AS l1, y.f AS r1, u.f AS l2, v.f AS r2,
    (1000000::HUGEINT * f3.f * f3.f) // (x.f::HUGEINT * y.f) AS s1, (1000000::HUGEINT * f3.f * f3.f) // (u.f::HUGEINT * v.f) AS s2
  FROM f3 JOIN f1 x ON x.lang = f3.lang AND x.w1 = f3.w1
  JOIN f2 y ON y.lang = f3.lang AND y.w1 = f3.w2 AND y.w2 = f3.w3
  JOIN f2 u ON u.lang = f3.lang AND u.w1 = f3.w1 AND u.w2 = f3.w2
  JOIN f1 v ON v.lang = f3.lang AND v.w1 = f3.w3
), c AS (
  SELECT lang, phrase, a, l, r, score FROM c2 UNION ALL
  SELECT lang, phrase, a, CASE WHEN s2 < s1 THEN l2 ELSE l1 END, CASE WHEN s2 < s1 THEN r2 ELSE r1 END, least(s1, s2) FROM c3
), n AS (
  SELECT lang, sum(f)::BIGINT AS n FROM f1 GROUP BY lang
)
SELECT lang, row_number() OVER w AS rank, phrase, a, l, r, n, score::BIGINT AS score FROM c JOIN n USING (lang)
WINDOW w AS (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)
QUALIFY row_number() OVER w <= 2000
"""

_FINITE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0"

OP12_NEGATIVES = f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda e: floor(256 * e::DOUBLE)) AS x
  FROM embeddings WHERE label IS NOT NULL AND {_FINITE}
), s AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, b.vec_id AS vec_id, a.label = b.label AS same, list_inner_product(a.x, b.x)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, row_number() OVER w AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 3
"""

OP13_TOPK = f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda e: floor(64 * e::DOUBLE)) AS x FROM embeddings WHERE {_FINITE}
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, row_number() OVER w AS rank, vec_id, score FROM s
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 20
"""

ORACLES: dict[str, str] = {
    "op4_substrings": OP4_SUBSTRINGS,
    "op5_embeddings": OP5_EMBEDDINGS,
    "op9_mixing": OP9_MIXING,
    "op11_phrases": OP11_PHRASES,
    "op12_negatives": OP12_NEGATIVES,
    "op13_topk": OP13_TOPK,
}
