"""SQL for the queries of this subpackage that SQL can express."""

_ITEMS = """
WITH item AS (
  SELECT *, coalesce(token_count, code_tokens + header_tokens) AS size FROM (
    SELECT lower(trim(query_id)) AS q, lower(trim(candidate_id)) AS c, packed_items.*,
           row_number() OVER (PARTITION BY lower(trim(query_id)), lower(trim(candidate_id)) ORDER BY packed_at DESC) AS rn
    FROM packed_items) WHERE rn = 1),
cap AS (
  SELECT config_id, greatest(0, max_context_tokens - coalesce(reserved_system_tokens, 0) - coalesce(reserved_query_tokens, 0)
    - coalesce(reserved_output_tokens, 0) - coalesce(safety_margin_tokens, 0)) AS capacity FROM budget_configs)
"""

_RANKS = """
WITH raw AS (
  SELECT lower(trim(query_id)) AS query_id, lower(trim(chunk_id)) AS chunk_id, retrieved_at,
    CASE WHEN isfinite(bm25_score) THEN bm25_score END AS b, CASE WHEN isfinite(vector_score) THEN vector_score END AS v, CASE WHEN isfinite(graph_score) THEN graph_score END AS g
  FROM retrieval_results),
one AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY retrieved_at DESC, b DESC NULLS LAST, v DESC NULLS LAST, g DESC NULLS LAST) AS rn FROM raw) WHERE rn = 1),
r AS (
  SELECT *, count(*) OVER (PARTITION BY query_id) AS n,
    rank() OVER (PARTITION BY query_id ORDER BY b DESC NULLS LAST) + (count(*) OVER (PARTITION BY query_id, b) - 1) / 2.0 AS rb,
    rank() OVER (PARTITION BY query_id ORDER BY v DESC NULLS LAST) + (count(*) OVER (PARTITION BY query_id, v) - 1) / 2.0 AS rv,
    rank() OVER (PARTITION BY query_id ORDER BY g DESC NULLS LAST) + (count(*) OVER (PARTITION BY query_id, g) - 1) / 2.0 AS rg
  FROM one),
f AS (SELECT *, CASE WHEN n = 1 THEN 1.0 ELSE (3.0 * n - rb - rv - rg) / ((n - 1) * 3.0) END::DOUBLE AS fused FROM r),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, chunk_id) AS fr FROM f)
"""

_SPANS = """
WITH cut AS (
  SELECT doc_id, i, substr(text, i, 300) AS s FROM (SELECT doc_id, text, unnest(range(1, length(text) - 298)) AS i FROM documents WHERE length(text) >= 300)),
g AS (SELECT DISTINCT doc_id, s FROM cut),
m AS (SELECT s FROM (SELECT s, count(*) AS n FROM g GROUP BY 1) WHERE n > 1)
"""

SQL = {
    "p2_found": _ITEMS + "SELECT DISTINCT q AS query_id, c AS candidate_id FROM item JOIN cap USING (config_id) WHERE size > capacity",
    "p2_invariants": _ITEMS
    + """, x AS (SELECT q, size, CASE WHEN size >= 0 AND capacity IS NOT NULL AND NOT (size > capacity AND capacity = 0) THEN size END AS put FROM item LEFT JOIN cap USING (config_id))
SELECT q AS query_id, count(*) AS n_items, count(*) - count(put) AS n_unplaced, sum(size)::BIGINT AS tokens, sum(put)::BIGINT AS placed, 0::BIGINT AS n_over FROM x GROUP BY 1""",
    "p3_found": _RANKS + "SELECT query_id, chunk_id FROM ranked WHERE rb = 1 AND rv = 1 AND rg = 1 AND b IS NOT NULL AND v IS NOT NULL AND g IS NOT NULL",
    "p3_ranking": _RANKS
    + """SELECT query_id, chunk_id, rb::DOUBLE AS bm25_score_rank, rv::DOUBLE AS vector_score_rank, rg::DOUBLE AS graph_score_rank,
  round(fused, 9) AS fused_score, fr AS fused_rank FROM ranked""",
    "p3_ndcg": _RANKS
    + """, j AS (SELECT lower(trim(query_id)) AS query_id, lower(trim(chunk_id)) AS chunk_id, max(grade) AS grade FROM judgments GROUP BY 1, 2),
best AS (SELECT query_id, sum(grade / log2(place + 1)) AS ideal FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, chunk_id) AS place FROM j) WHERE place <= 10 GROUP BY 1),
got AS (SELECT query_id, sum(grade / log2(fr + 1)) AS got FROM ranked JOIN j USING (query_id, chunk_id) WHERE fr <= 10 GROUP BY 1)
SELECT query_id, round(coalesce(CASE WHEN ideal > 0 THEN got / ideal END, 0.0), 6)::DOUBLE AS ndcg FROM best LEFT JOIN got USING (query_id)""",
    "p8_found": """
WITH w AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents),
iw AS (SELECT item_id AS id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM eval_items),
d AS (SELECT DISTINCT id AS doc_id, array_to_string(w[i:i+12], ' ') AS g FROM (SELECT id, w, unnest(range(1, len(w) - 11)) AS i FROM w WHERE len(w) >= 13)),
e AS (SELECT DISTINCT id AS item_id, array_to_string(w[i:i+12], ' ') AS g FROM (SELECT id, w, unnest(range(1, len(w) - 11)) AS i FROM iw WHERE len(w) >= 13))
SELECT DISTINCT doc_id, item_id FROM d JOIN e USING (g)""",
    "p9_found": """
WITH t AS (SELECT lower(trim(source)) AS source, max(target_share) AS share, max(max_repeats) AS reps FROM mix_targets GROUP BY 1),
d AS (SELECT lower(trim(source)) AS source, sum(coalesce(length(text), 0)) AS size FROM documents GROUP BY 1),
x AS (SELECT t.source, share, reps, coalesce(size, 0) AS size FROM t LEFT JOIN d USING (source))
SELECT source FROM x WHERE size * reps < share * (SELECT sum(size) FROM x)""",
    "p9_char_plan": """
WITH t AS (SELECT lower(trim(source)) AS source, max(target_share) AS share, max(max_repeats) AS reps FROM mix_targets GROUP BY 1),
d AS (SELECT lower(trim(source)) AS source, count(*) AS n, sum(coalesce(length(text), 0)) AS size FROM documents GROUP BY 1),
x AS (SELECT t.source, share, reps, coalesce(n, 0) AS n, coalesce(size, 0) AS size, (sum(coalesce(size, 0)) OVER ())::DOUBLE AS total FROM t LEFT JOIN d USING (source))
SELECT source, n AS documents, size::BIGINT AS tokens, share AS target_share, reps::BIGINT AS max_repeats,
  (CASE WHEN size * reps < share * total THEN size * reps ELSE round_even(share * total, 0) END)::BIGINT AS budget, size * reps < share * total AS short FROM x""",
    "p10_found": _SPANS + "SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM g a JOIN m USING (s) JOIN g b ON b.s = a.s AND a.doc_id < b.doc_id",
    "p10_shares": _SPANS
    + """, t AS (SELECT DISTINCT doc_id, text FROM documents WHERE length(text) >= 300),
c AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS class_id, length(text) AS n_chars, count(*) OVER (PARTITION BY text) AS n_copies FROM t),
hit AS (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS j FROM cut JOIN m USING (s)),
cov AS (SELECT doc_id, sum(least(300, coalesce(j - i, 300)))::BIGINT AS chars FROM hit GROUP BY 1)
SELECT doc_id, class_id, n_chars, n_copies, coalesce(chars, 0) AS shared_chars, round(coalesce(chars, 0) / n_chars, 6) AS shared_share FROM c LEFT JOIN cov USING (doc_id)""",
}
