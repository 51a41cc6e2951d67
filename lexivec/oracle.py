"""DuckDB SQL that gives the same rows as the catalog's queries of the same names."""

from __future__ import annotations

from lexivec.functions.text import RERANK_INSTRUCTION, RERANK_PROMPT

_QUESTION = "ening thand with, oneres"
_TOKENS = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')"

#: (id, dl, term, tf) of all documents, statistics, and the question's scores.
_INDEX = rf"""
    parsed AS (SELECT doc_id AS id, source AS path, text, {_TOKENS} AS w FROM documents),
    sized AS (SELECT id, path, len(w) AS dl, w FROM parsed),
    postings AS (SELECT id, dl, term, count(*) AS tf FROM (SELECT id, dl, unnest(w) AS term FROM sized) GROUP BY ALL),
    terms AS (SELECT term, count(*) AS df, sum(tf)::BIGINT AS total_tf FROM postings GROUP BY term),
    corpus AS (SELECT count(*) AS n, coalesce(sum(dl), 0)::BIGINT AS total, sum(dl) / count(*) AS avgdl FROM sized)"""
_PART = """ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))"""
_LEX = rf"""{_INDEX},
    lex AS (SELECT id, sum({_PART}) AS score FROM postings JOIN terms USING (term), corpus
            WHERE term IN ('ening', 'thand', 'with', 'oneres') GROUP BY id)"""
_VEC = """
    q AS (SELECT embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id = 0),
    vec AS (SELECT vec_id AS id, label, list_cosine_similarity(embedding::DOUBLE[], qv) AS score FROM embeddings, q
            WHERE embedding IS NOT NULL)"""
_ORDER = "ORDER BY round(score, 9) DESC, id"
_LEGS = rf"""{_LEX}, {_VEC},
    lists AS (SELECT 'lex' AS source, 0 AS o, 0.75 AS w, id, row_number() OVER ({_ORDER}) AS rank FROM lex
              UNION ALL SELECT 'vec', 1, 0.60, id, row_number() OVER ({_ORDER}) FROM vec),
    cut AS (SELECT source, o, w AS weight, id, rank, w / (60 + rank) AS rrf_value,
                   CASE rank WHEN 1 THEN 0.05 WHEN 2 THEN 0.02 WHEN 3 THEN 0.02 ELSE 0 END AS bonus
            FROM lists WHERE rank <= 20),
    fused AS (SELECT id, sum(rrf_value + bonus)::DOUBLE AS score, sum(bonus)::DOUBLE AS total_bonus, count(*) AS sources
              FROM cut GROUP BY id)"""
#: The same over vectors that have a document, as chunks with their own vectors give.
_OWN_LEGS = _LEGS.replace("WHERE embedding IS NOT NULL", "WHERE embedding IS NOT NULL AND vec_id IN (SELECT doc_id FROM documents)")
_FUSED_ORDER = "ORDER BY round(score, 12) DESC, id"
_OVERLAP = rf"""len(list_intersect(list_distinct({_TOKENS}),
                    ['ening', 'thand', 'with', 'oneres'])) / 4.0"""
_EMBEDDED = """c AS (SELECT d.doc_id AS id, d.text, e.embedding FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id)"""
_STORED = """
    stored AS (SELECT source || '/' || doc_id AS path, sha256(text) AS content_hash FROM documents WHERE lang IN ('en', 'de')),
    disk AS (SELECT source || '/' || doc_id AS path,
                    sha256(CASE WHEN source = 'src3' THEN text || '!' ELSE text END) AS content_hash
             FROM documents WHERE lang IN ('en', 'fr')),
    diff AS (SELECT path, CASE WHEN s.path IS NULL THEN 'add' WHEN d.path IS NULL THEN 'remove'
                               WHEN d.content_hash = s.content_hash THEN 'skip' ELSE 'replace' END AS action
             FROM disk d FULL JOIN stored s USING (path))"""
_HEAD, _REST = RERANK_PROMPT.replace("{instruction}", RERANK_INSTRUCTION).split("{query}")
_MIDDLE, _TAIL = _REST.split("{document}")


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


SQL = {
    "analyze_tokens": f"WITH {_INDEX} SELECT id, len(w) AS n_tokens, len(list_distinct(w)) AS n_terms FROM sized",
    "term_df": f"WITH {_INDEX} SELECT * FROM terms",
    "corpus_stats": f"WITH {_INDEX} SELECT n, total, round(avgdl, 6) AS avgdl FROM corpus",
    "approx_tokens": "SELECT doc_id AS id, ((length(coalesce(text, '')) + 3) // 4)::BIGINT AS tokens FROM documents",
    "preview_line": r"""
        WITH x AS (SELECT doc_id AS id, array_to_string(list_filter(list_transform(
                       regexp_split_to_array(coalesce(text, ''), '\r?\n'),
                       lambda s: regexp_replace(s, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')), lambda s: s <> ''), ' ') AS flat
                   FROM documents)
        SELECT id, CASE WHEN length(flat) > 80 THEN left(flat, 80) || '…' ELSE flat END AS preview FROM x""",
    "content_hash": "SELECT doc_id AS id, sha256(text) AS content_hash FROM documents",
    "chunk_id": r"""
        WITH x AS (SELECT doc_id AS id, 'default' AS c, sha256(text) AS h,
                          'lexivec://default/' || source || '/' || doc_id AS uri,
                          lpad(hex(doc_id), 8, '0') AS b FROM documents),
             y AS (SELECT id, uri, sha256(encode(uri) || unhex('00') || encode(h) ||
                          unhex(substr(b, 7, 2) || substr(b, 5, 2) || substr(b, 3, 2) || substr(b, 1, 2))) AS chunk_id FROM x)
        SELECT id, uri, chunk_id, left(chunk_id, 12) AS short_id FROM y""",
    "bm25_topk": f"WITH {_LEX} SELECT id, round(score, 6) AS score FROM lex {_ORDER} LIMIT 10",
    "bm25_indexed_topk": f"WITH {_LEX} SELECT id, round(score, 6) AS score FROM lex {_ORDER} LIMIT 10",
    "bm25_all": f"WITH {_LEX} SELECT id, round(score, 6) AS score FROM lex",
    "bm25_min_score": f"WITH {_LEX} SELECT id, round(score, 6) AS score FROM lex WHERE score >= 2.0",
    "bm25_blank_query": "SELECT doc_id AS id, 0.0::DOUBLE AS score FROM documents WHERE false",
    "bm25_files": f"""
        WITH {_LEX}, hits AS (SELECT id, row_number() OVER ({_ORDER}) AS rank FROM lex QUALIFY rank <= 50)
        SELECT path, min(rank) AS rank FROM hits JOIN sized USING (id) GROUP BY path""",
    "bm25_batch_topk": rf"""
        WITH {_INDEX},
             asked AS (SELECT DISTINCT item_id AS query_id, unnest({_TOKENS}) AS term FROM benchmark),
             s AS (SELECT query_id, id, sum({_PART}) AS score
                   FROM asked JOIN terms USING (term) JOIN postings USING (term), corpus GROUP BY ALL)
        SELECT query_id, id, round(score, 6) AS score,
               row_number() OVER (PARTITION BY query_id {_ORDER}) AS rank FROM s QUALIFY rank <= 3""",
    "vector_topk": f"WITH {_VEC} SELECT id, round(score, 6) AS score FROM vec {_ORDER} LIMIT 10",
    "vector_min_score": f"WITH {_VEC} SELECT id, round(score, 6) AS score FROM vec WHERE score >= 0.2",
    "vector_distance": f"""
        WITH {_VEC} SELECT id, round(score, 6) AS score, round(1 - score, 6) AS _distance FROM vec {_ORDER} LIMIT 10""",
    "vector_filtered_topk": f"WITH {_VEC} SELECT id, round(score, 6) AS score FROM vec WHERE label = 1 {_ORDER} LIMIT 10",
    "vector_batch_topk": f"""
        WITH s AS (SELECT a.vec_id AS query_id, b.vec_id AS id,
                          list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score
                   FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0)
        SELECT query_id, id, round(score, 6) AS score,
               row_number() OVER (PARTITION BY query_id {_ORDER}) AS rank FROM s QUALIFY rank <= 5""",
    "embedding_slice": """
        SELECT vec_id AS id, len(embedding) AS dim, round(embedding[1]::DOUBLE, 6) AS e1, round(embedding[2]::DOUBLE, 6) AS e2,
               round(embedding[3]::DOUBLE, 6) AS e3,
               round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm,
               len(list_filter(embedding, lambda x: isnan(x) OR isinf(x))) = 0 AS finite
        FROM embeddings""",
    "rrf_fuse": f"""
        WITH {_LEGS} SELECT id, round(score, 9) AS final_score, round(total_bonus, 9) AS total_bonus, sources FROM fused""",
    "rrf_contributions": f"""
        WITH {_LEGS} SELECT id, source, rank, weight::DOUBLE AS weight, round(rrf_value::DOUBLE, 9) AS rrf_value,
                            bonus::DOUBLE AS bonus FROM cut""",
    "hybrid_topk": f"WITH {_LEGS} SELECT id, round(score, 9) AS score FROM fused {_FUSED_ORDER} LIMIT 10",
    "hybrid_explain": f"""
        WITH {_OWN_LEGS}, best AS (SELECT id, score, row_number() OVER ({_ORDER}) AS rank FROM
                                   (SELECT * FROM fused {_FUSED_ORDER} LIMIT 10))
        SELECT id, best.rank AS rank, round(score, 9) AS score, source, cut.rank AS source_rank,
               round(rrf_value::DOUBLE, 9) AS rrf_value, bonus::DOUBLE AS bonus FROM best JOIN cut USING (id)""",
    "hybrid_rerank_topk": rf"""
        WITH {_OWN_LEGS}, pool AS (SELECT id, row_number() OVER ({_FUSED_ORDER}) AS pos FROM fused),
             scored AS (SELECT id, source AS path, {_OVERLAP} AS score FROM pool JOIN documents ON doc_id = id WHERE pos <= 64)
        SELECT id, path, round(score::DOUBLE, 6) AS score FROM scored {_ORDER} LIMIT 10""",
    "hybrid_alpha_blend": f"""
        WITH {_LEX}, {_VEC},
             a AS (SELECT id, score / max(score) OVER () * 0.7 AS part FROM (SELECT * FROM lex {_ORDER} LIMIT 20)),
             b AS (SELECT id, score / max(score) OVER () * 0.3 AS part FROM (SELECT id, score FROM vec {_ORDER} LIMIT 20)),
             s AS (SELECT id, sum(part)::DOUBLE AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY id)
        SELECT id, round(score, 6) AS score FROM s {_ORDER} LIMIT 10""",
    "yes_no_softmax": """
        SELECT p_partkey, round(1 / (1 + exp(p_retailprice::DOUBLE / 100 - p_size)), 6) AS p_yes FROM part""",
    "rerank_order": """
        WITH x AS (SELECT c_custkey, c_nationkey, floor(c_acctbal / 1000)::DOUBLE AS rerank_score FROM customer)
        SELECT c_nationkey, c_custkey, rerank_score,
               row_number() OVER (PARTITION BY c_nationkey ORDER BY rerank_score DESC, c_custkey) AS rank
        FROM x QUALIFY rank <= 3""",
    "rerank_passthrough": rf"""
        WITH s AS (SELECT item_id, {_OVERLAP} AS score FROM benchmark)
        SELECT item_id::VARCHAR AS id, 'kept' AS extra, round(score::DOUBLE, 6) AS rerank_score,
               row_number() OVER (ORDER BY score DESC, item_id) AS rank FROM s QUALIFY rank <= 5""",
    "prompt_render": f"""
        SELECT item_id, sha256({_quoted(_HEAD)} || {_quoted(_QUESTION)} || {_quoted(_MIDDLE)} || text || {_quoted(_TAIL)})
               AS prompt_sha256 FROM benchmark""",
    "candidate_validation": """
        WITH x AS (SELECT conv_id * 1000 + turn AS pos, CASE WHEN role = 'assistant' THEN '' ELSE role END AS id,
                          CASE WHEN length(text) >= 20 THEN text END AS text FROM conversations WHERE turn IS NOT NULL)
        SELECT pos, CASE WHEN coalesce(id, '') = '' THEN 'id' ELSE 'text' END AS field FROM x
        WHERE coalesce(id, '') = '' OR coalesce(text, '') = '' ORDER BY pos LIMIT 1""",
    "incremental_diff": f"WITH {_STORED} SELECT path, action FROM diff",
    "incremental_diff_subroot": f"""
        WITH {_STORED} SELECT path, action FROM diff WHERE path LIKE 'src1/%'""",
    "index_report": f"""
        WITH {_STORED} SELECT count(*) FILTER (WHERE action IN ('add', 'replace')) AS files,
               count(*) FILTER (WHERE action = 'skip') AS skipped, count(*) FILTER (WHERE action = 'remove') AS removed,
               count(*) FILTER (WHERE action = 'failed') AS failed FROM diff""",
    "apply_diff": f"WITH {_STORED} SELECT path, content_hash FROM disk",
    "file_hashes": "SELECT DISTINCT source AS path, left(sha256(text), 2) AS content_hash FROM documents",
    "delete_by_path": "SELECT source AS path, count(*) AS rows FROM documents WHERE source <> 'src0' GROUP BY source",
    "merge_embeddings": f"WITH {_EMBEDDED} SELECT id, coalesce(len(embedding), 0) AS dim FROM c",
    "unembedded_scan": f"WITH {_EMBEDDED} SELECT id FROM c WHERE embedding IS NULL",
    "longest_unembedded": f"""
        WITH {_EMBEDDED} SELECT id, length(text) AS chars FROM c WHERE embedding IS NULL ORDER BY chars DESC, id LIMIT 10""",
    "group_count": """
        SELECT lang, source AS path, count(*) AS rows, sum(length(text))::BIGINT AS chars FROM documents GROUP BY ALL""",
    "context_longest_prefix": """
        WITH p AS (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS uri FROM pages)
        SELECT page_id, CASE WHEN split_part(uri, '/', 2) = 'en' THEN 'english' ELSE 'host' END AS context FROM p""",
}
