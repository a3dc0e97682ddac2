"""SQL texts for operators whose result follows from word shingles or cosines alone."""

_WORDS = r"list_filter(regexp_split_to_array(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_SHINGLES = """CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END"""

LINE_DEDUP = f"""
WITH cut AS (
  SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents
), placed AS (
  SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS pos FROM cut WHERE parts IS NOT NULL
), worded AS (
  SELECT doc_id, pos, {_WORDS.format("line")} AS w FROM placed
), sets AS (
  SELECT doc_id, pos, list_sort({_SHINGLES}) AS tokens FROM worded WHERE len(w) > 0
), firsts AS (
  SELECT tokens, min((doc_id, pos)) AS place, len(tokens) AS n, row_number() OVER () AS id FROM sets GROUP BY tokens
), single AS (
  SELECT id, place, n, unnest(tokens) AS token FROM firsts
), gone AS (
  SELECT DISTINCT id FROM (
    SELECT x.id, x.n, y.n AS m, count(*) AS common FROM single x JOIN single y ON x.token = y.token AND y.place < x.place
    WHERE 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n) GROUP BY x.id, y.id, x.n, y.n
  ) WHERE 100 * common >= 80 * (n + m - common)
), removed AS (
  SELECT s.doc_id, count(*) AS n_removed, string_agg(CAST(s.pos AS VARCHAR), ',' ORDER BY s.pos) AS removed_lines
  FROM sets s JOIN firsts f ON s.tokens = f.tokens
  WHERE f.id IN (SELECT id FROM gone) OR f.place <> (s.doc_id, s.pos) GROUP BY s.doc_id
)
SELECT c.doc_id, CAST(coalesce(len(c.parts), 0) AS BIGINT) AS n_lines,
  CAST(coalesce(r.n_removed, 0) AS BIGINT) AS n_removed, coalesce(r.removed_lines, '') AS removed_lines
FROM cut c LEFT JOIN removed r ON c.doc_id = r.doc_id
"""

NGRAM_JOIN = f"""
WITH RECURSIVE worded AS (
  SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents
), sets AS (
  SELECT doc_id, {_SHINGLES} AS tokens FROM worded
), single AS (
  SELECT doc_id, len(tokens) AS n, unnest(tokens) AS token FROM sets
), links AS (
  SELECT a, b FROM (
    SELECT x.doc_id AS a, y.doc_id AS b, x.n, y.n AS m, count(*) AS common
    FROM single x JOIN single y ON x.token = y.token AND x.doc_id <> y.doc_id
    WHERE 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n) GROUP BY x.doc_id, y.doc_id, x.n, y.n
  ) WHERE 100 * common >= 80 * (n + m - common)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), least_of AS (
  SELECT a, min(b) AS component_id FROM reach GROUP BY a
), counted AS (
  SELECT a, count(*) AS n_links FROM links GROUP BY a
)
SELECT s.doc_id, CAST(len(s.tokens) AS BIGINT) AS n_shingles, CAST(coalesce(c.n_links, 0) AS BIGINT) AS n_links, l.component_id
FROM sets s LEFT JOIN least_of l ON l.a = s.doc_id LEFT JOIN counted c ON c.a = s.doc_id
"""

EMBEDDING_DEDUP = """
WITH RECURSIVE vectors AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
), sound AS (
  SELECT vec_id, v, len(v) AS dim, sqrt(list_inner_product(v, v)) AS size FROM vectors
  WHERE len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0
), links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM sound x JOIN sound y ON x.dim = y.dim AND x.vec_id <> y.vec_id
  WHERE list_inner_product(x.v, y.v) >= 0.9 * x.size * y.size
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), least_of AS (
  SELECT a, min(b) AS component_id FROM reach GROUP BY a
), counted AS (
  SELECT a, count(*) AS n_links FROM links GROUP BY a
)
SELECT e.vec_id, CAST(coalesce(c.n_links, 0) AS BIGINT) AS n_links, l.component_id, e.vec_id = l.component_id AS kept
FROM embeddings e JOIN least_of l ON l.a = e.vec_id LEFT JOIN counted c ON c.a = e.vec_id
"""
