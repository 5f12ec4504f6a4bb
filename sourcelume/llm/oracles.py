"""SQL for those queries of this package that SQL can state over whole tables, by comparing everything with everything."""

USABLE = (
    "embedding IS NOT NULL AND len(embedding) = 128 AND NOT list_contains(list_transform(embedding, lambda x: isnan(x)), true)"
    " AND list_contains(list_transform(embedding, lambda x: x <> 0), true)"
)
ENTRY = "'''((?:[^'']|'''')+)'':([0-9]+[A-D]?(?:,[0-9]+[A-D]?)*)'"
P2 = "SELECT DISTINCT id AS chunk_id FROM chunks WHERE length(content) > 2000"
P3 = f"""WITH u AS MATERIALIZED (SELECT id, CAST(embedding AS DOUBLE[]) AS e, ts FROM chunks WHERE {USABLE} AND ts IS NOT NULL),
w AS (SELECT query_id, unnest(list_distinct(string_split(query_text, ' '))) AS word FROM search_queries),
t AS (SELECT id, unnest(regexp_extract_all(ts, {ENTRY}, 1)) AS word, unnest(regexp_extract_all(ts, {ENTRY}, 2)) AS p FROM u),
h AS (SELECT w.query_id, t.id, sum(len(string_split(t.p, ','))) AS n FROM t JOIN w ON w.word = t.word GROUP BY 1, 2),
s AS (SELECT q.query_id, u.id, round(list_cosine_similarity(u.e, CAST(q.query_embedding AS DOUBLE[])), 9) AS c, coalesce(h.n, 0) AS n
  FROM search_queries q JOIN u ON true LEFT JOIN h ON h.query_id = q.query_id AND h.id = u.id),
r AS (SELECT *, rank() OVER (PARTITION BY query_id ORDER BY c DESC) AS pc, rank() OVER (PARTITION BY query_id ORDER BY n DESC) AS pn FROM s)
SELECT query_id, id AS chunk_id FROM r QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY greatest(pc, pn), least(pc, pn), id) <= 5"""
P5 = f"""WITH u AS MATERIALIZED (SELECT id, CAST(embedding AS DOUBLE[]) AS e FROM chunks WHERE {USABLE}),
p AS (SELECT a.id AS a, b.id AS b, round(list_cosine_similarity(a.e, b.e), 9) AS c FROM u a JOIN u b ON a.id <> b.id)
SELECT a AS chunk_id, b AS neighbour_id FROM p WHERE c >= 0.8 QUALIFY row_number() OVER (PARTITION BY a ORDER BY c DESC, b) <= 5"""
PAIRS = """d AS (SELECT content_sha AS sha, min(content) AS content FROM files WHERE content IS NOT NULL GROUP BY 1),
w AS (SELECT sha, regexp_extract_all(content, '[A-Za-z0-9_]+') AS w FROM d),
g AS (SELECT DISTINCT sha, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))) AS g FROM w WHERE len(w) >= 50),
n AS (SELECT sha, count(*) AS n FROM g GROUP BY 1),
c AS (SELECT a.sha AS a, b.sha AS b, count(*) AS k FROM g a JOIN g b ON a.g = b.g AND a.sha < b.sha GROUP BY 1, 2),
p AS (SELECT a, b FROM c JOIN n x ON x.sha = a JOIN n y ON y.sha = b WHERE k >= 0.7 * (x.n + y.n - k))"""
P7 = f"""WITH {PAIRS}
SELECT DISTINCT least(x.id, y.id) AS file_id_a, greatest(x.id, y.id) AS file_id_b FROM p JOIN files x ON x.content_sha = p.a JOIN files y ON y.content_sha = p.b
WHERE x.content IS NOT NULL AND y.content IS NOT NULL"""

P7_GROUPS = f"""WITH RECURSIVE {PAIRS},
f AS (SELECT DISTINCT id, content_sha AS sha, content IS NULL AS lost FROM files),
rep AS (SELECT sha, min(id) AS id FROM f WHERE NOT lost GROUP BY 1),
dir AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
links AS (SELECT a AS sha, count(*) AS n FROM dir GROUP BY 1),
e AS (SELECT x.id AS a, y.id AS b FROM dir JOIN rep x ON x.sha = dir.a JOIN rep y ON y.sha = dir.b),
r AS (SELECT id, id AS root FROM rep UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id),
cc AS (SELECT id, min(root) AS root FROM r GROUP BY 1)
SELECT f.id AS file_id, CAST(CASE WHEN f.lost THEN f.id ELSE cc.root END AS BIGINT) AS class_id, CAST(CASE WHEN f.lost THEN 0 ELSE coalesce(l.n, 0) END AS INTEGER) AS links
FROM f LEFT JOIN rep ON rep.sha = f.sha LEFT JOIN cc ON cc.id = rep.id LEFT JOIN links l ON l.sha = f.sha"""


P3_RANKING = P3[: P3.index("SELECT query_id, id AS chunk_id FROM r")] + """, k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY greatest(pc, pn), least(pc, pn), id) AS rank FROM r)
SELECT query_id, id AS chunk_id, CAST(n AS BIGINT) AS hits, round(c, 6) AS cosine, pc AS place_cosine, pn AS place_hits, rank FROM k WHERE rank <= 5"""
# What must hold of results that SQL cannot compute itself: the same rows as the input has, and no violations among them.
P2_REJOINED = "SELECT DISTINCT id AS chunk_id, content, true AS within_limit, true AS numbered, true AS overlapping FROM chunks"
P4_SAFE = "SELECT DISTINCT id AS file_id, true AS same_length, true AS same_lines, true AS nothing_left, true AS parses_as_before FROM files WHERE content IS NOT NULL"
P8_CHECKS = "SELECT b.name, b.capacity_tokens, count(DISTINCT d.doc_id) AS documents, 0 AS overfull, 0 AS split_in_vain, 0 AS in_pieces_that_do_not_meet FROM token_budgets b, documents d WHERE d.text IS NOT NULL GROUP BY 1, 2"
P9_CHECKS = "SELECT source, 0 AS used_too_often, 0 AS misnumbered, 0 AS of_another_source FROM mix_targets"


def oracle_sql() -> dict[str, str]:
    more = {"p2_rejoined": P2_REJOINED, "p3_ranking": P3_RANKING, "p4_safe": P4_SAFE, "p8_checks": P8_CHECKS, "p9_checks": P9_CHECKS}
    return {**more, "p2_found": P2, "p3_found": P3, "p5_found": P5, "p7_found": P7, "p7_groups": P7_GROUPS}
