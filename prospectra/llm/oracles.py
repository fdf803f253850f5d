"""SQL whose rows the registered queries must return, for another engine."""

from __future__ import annotations

SQL: dict[str, str] = {}

SQL["op8_chat_formatting"] = """
WITH m AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role,
         replace(replace(coalesce(text, ''), '<|im_start|>', '<|\\im_start|>'), '<|im_end|>', '<|\\im_end|>') AS said
  FROM conversations),
s AS (SELECT DISTINCT conv_id, role AS speaker FROM m WHERE role <> 'system'),
r AS (
  SELECT m.conv_id, s.speaker, m.turn, m.role = s.speaker AS own, m.said,
         '<|im_start|>' || CASE WHEN m.role = 'system' THEN 'system' WHEN m.role = s.speaker THEN 'assistant'
           ELSE 'user name=' || replace(url_encode(m.role), '%20', '+') END || chr(10) || m.said || '<|im_end|>' || chr(10) AS piece
  FROM m JOIN s ON m.conv_id = s.conv_id),
e AS (SELECT *, CAST(sum(length(piece)) OVER (PARTITION BY conv_id, speaker ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto FROM r)
SELECT conv_id, speaker, CAST(0 AS BIGINT) AS part, count(*) AS n_messages,
       CAST(sum(CASE WHEN own THEN 1 ELSE 0 END) AS BIGINT) AS n_own, string_agg(piece, '' ORDER BY turn) AS rendered,
       coalesce(string_agg(CASE WHEN own THEN (upto - length(said) - 11) || ':' || (upto - 1) END, ',' ORDER BY turn), '') AS spans,
       CAST(sum(CASE WHEN own THEN length(said) + 10 ELSE 0 END) AS BIGINT) AS n_learned
FROM e GROUP BY conv_id, speaker
"""

SQL["op10_mixing"] = """
WITH d AS (
  SELECT doc_id, source, md5('0:' || CAST(doc_id AS VARCHAR)) AS k,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight
  FROM d GROUP BY source),
f AS (
  SELECT *, (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / CAST(sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS rate
  FROM s),
t AS (
  SELECT source, source_size, weight,
         least(CAST(3 * source_size AS DOUBLE),
               (SELECT rate FROM f WHERE rate * weight < 3 * source_size ORDER BY source_size / weight, source NULLS LAST LIMIT 1) * weight) AS target
  FROM f),
q AS (
  SELECT d.doc_id, d.size, t.source_size, t.weight, t.target,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id ROWS UNBOUNDED PRECEDING) AS upto
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (
  SELECT doc_id, size, (CAST(turn AS BIGINT) * source_size + upto) / CAST(weight AS DOUBLE) AS finish
  FROM q, (SELECT unnest([0, 1, 2]) AS turn) WHERE size > 0),
r AS (SELECT doc_id, size, sum(size) OVER (ORDER BY finish RANGE UNBOUNDED PRECEDING) AS total FROM c),
n AS (SELECT doc_id, CAST(sum(size) AS BIGINT) AS taken FROM r WHERE total <= (SELECT sum(source_size) FROM t) GROUP BY doc_id)
SELECT q.doc_id, q.size, q.source_size, q.target, coalesce(n.taken, 0) AS taken FROM q LEFT JOIN n ON q.doc_id = n.doc_id
"""

SQL["op1_ngram_jaccard_join"] = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words
  FROM documents),
g AS (
  SELECT DISTINCT doc_id, CASE WHEN len(words) < 4 THEN array_to_string(words, ' ') ELSE array_to_string(list_slice(words, i, i + 3), ' ') END AS s
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 1) + 1)) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (
  SELECT x, y FROM p JOIN n u ON u.doc_id = x JOIN n v ON v.doc_id = y WHERE 100 * k >= 85 * (u.n + v.n - k)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.y FROM r JOIN e ON e.x = r.b)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) c ON c.a = d.doc_id
"""

SQL["op7_embedding_near_dedup"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL),
u AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS norm FROM v),
l AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.95),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.y FROM r JOIN l ON l.x = r.b),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT x AS vec_id, count(*) AS n FROM l GROUP BY x)
SELECT c.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, c.component_id, c.vec_id = c.component_id AS kept
FROM c LEFT JOIN n ON n.vec_id = c.vec_id
"""


def _codes(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """Lloyd rounds on integers, one pair of tables each."""
    head = f"""
WITH v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len([c FOR c IN embedding IF c IS NULL OR NOT isfinite(c)]) = 0),
x AS MATERIALIZED (
  SELECT vec_id, label, p, [CAST(floor({scale} * c) AS BIGINT) FOR c IN e[p * len(e) // {parts} + 1:(p + 1) * len(e) // {parts}]] AS x
  FROM v, (SELECT unnest(range({parts})) AS p)),
b0 AS MATERIALIZED (SELECT p, k, x FROM (SELECT p, x, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS k FROM x) WHERE k < {entries})"""
    step = """,
a{r} AS MATERIALIZED (
  SELECT vec_id, label, p, x, min({{'d': d, 'k': k}}) AS best FROM (
    SELECT x.vec_id, x.label, x.p, x.x, b.k, CAST(list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip(x.x, b.x)]) AS BIGINT) AS d
    FROM x JOIN b{r} b ON x.p = b.p) GROUP BY vec_id, label, p, x)"""
    move = """,
m{s} AS (
  SELECT p, k, list((s - ((s % n) + n) % n) // n ORDER BY i) AS x FROM (
    SELECT p, best.k AS k, i, CAST(sum(c) AS BIGINT) AS s, count(*) AS n FROM (SELECT p, best, unnest(x) AS c, unnest(range(1, len(x) + 1)) AS i FROM a{r}) GROUP BY 1, 2, 3)
  GROUP BY p, k),
b{s} AS MATERIALIZED (SELECT b.p, b.k, coalesce(m.x, b.x) AS x FROM b{r} b LEFT JOIN m{s} m ON m.p = b.p AND m.k = b.k)"""
    body = "".join(step.format(r=r) + move.format(r=r, s=r + 1) for r in range(rounds)) + step.format(r=rounds)
    return head + body + f""",
c AS (SELECT vec_id, label, string_agg(lower(printf('%02x', best.k)), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id, label),
l AS (SELECT label, CAST(sum(error) AS BIGINT) AS label_error FROM c GROUP BY label),
t AS (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY p, k, i)) AS codebooks_sha256 FROM (SELECT p, k, unnest(x) AS v, unnest(range(1, len(x) + 1)) AS i FROM b{rounds}))
SELECT c.vec_id, c.code, c.error, l.label_error, t.codebooks_sha256 FROM c JOIN l ON l.label IS NOT DISTINCT FROM c.label, t
"""


SQL["op11_vector_codes"] = _codes()
