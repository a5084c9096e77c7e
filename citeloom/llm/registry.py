"""Queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from citeloom.llm import byte_bpe, collocations, embedding_dedup, exact_dedup, fill_in_middle, flac, language_id, packing, quality, simhash, suffix_dedup, token_files, toxicity


def queries() -> dict:
    return {
        "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
        "op2_byte_bpe": byte_bpe.op2_byte_bpe,
        "op3_embedding_dedup": embedding_dedup.op3_embedding_dedup,
        "op4_toxicity": toxicity.op4_toxicity,
        "op5_token_files": token_files.op5_token_files,
        "op6_flac": flac.op6_flac,
        "op7_quality": quality.op7_quality,
        "op8_language_id": language_id.op8_language_id,
        "op9_simhash": simhash.op9_simhash,
        "op10_packing": packing.op10_packing,
        "op11_exact_dedup": exact_dedup.op11_exact_dedup,
        "op12_fill_in_middle": fill_in_middle.op12_fill_in_middle,
        "op13_collocations": collocations.op13_collocations,
    }


#: Links are compared pair by pair and followed to their ends.
EMBEDDING_DEDUP = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a), m AS (SELECT a, min(b) AS least FROM r GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(least, vec_id)) AS component_id, vec_id <= coalesce(least, vec_id) AS kept
FROM embeddings LEFT JOIN n ON vec_id = n.a LEFT JOIN m ON vec_id = m.a
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_embedding_dedup": EMBEDDING_DEDUP, "op11_exact_dedup": exact_dedup.SQL, "op12_fill_in_middle": fill_in_middle.SQL, "op13_collocations": collocations.SQL}
