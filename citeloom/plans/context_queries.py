"""Queries over citations in whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from citeloom.operators import contexts
from citeloom.plans.tables import table


def citation_contexts(spark, sf_dir):
    """Sentence and window around the citation that each document is given in its middle, for the works that nations wrote."""
    d = F.col("doc_id")
    plain = F.translate(F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\t\n -~]", "x"), "0123456789", "abcdefghij")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", F.translate(F.initcap("n_name"), "_0123456789", "xabcdefghij").alias("name"))
    docs = table(spark, sf_dir, "documents").select("doc_id", plain.alias("t")).join(nation, d % 25 == F.col("n_nationkey"))
    year = (F.lit(1900) + d % 50).cast("string")
    cited = F.when(d % 3 == 0, F.concat("name", F.lit(" ("), year, F.lit(")"))).when(d % 3 == 1, F.concat("name", F.lit(" "), year, F.lit(" "))).otherwise(F.concat(F.lit("("), "name", F.lit(", "), year, F.lit(")")))
    half = F.floor(F.length("t") / 2).cast("int")
    texts = docs.select("doc_id", F.concat(F.substr("t", F.lit(1), half), F.lit(" "), cited, F.substr("t", half + 1)).alias("text"))
    works = nation.select(F.col("n_nationkey").cast("long").alias("work"), "name", (F.lit(1900) + F.col("n_nationkey")).cast("string").alias("year")).select("work", F.concat(F.lit("Ada "), "name").alias("author"), "year", F.lit(None).cast("string").alias("coauthor"))
    found = contexts.citation_contexts(texts, works, ["doc_id"])
    digest = lambda c: F.sha2(F.encode(c, "utf-8"), 256)
    return found.select("doc_id", "work", F.col("position").cast("long").alias("position"), "citation_text", digest("sentence").alias("sentence_sha256"), digest("context").alias("context_sha256"))


CITATION_CONTEXTS = r"""
WITH n AS (SELECT n_nationkey, translate(upper(substr(n_name, 1, 1)) || lower(substr(n_name, 2)), '_0123456789', 'xabcdefghij') AS name FROM nation),
p AS (SELECT doc_id, n_nationkey::BIGINT AS work, name, CAST(1900 + doc_id % 50 AS VARCHAR) AS year, translate(regexp_replace(coalesce(text, ''), '[^\t\n -~]', 'x', 'g'), '0123456789', 'abcdefghij') AS t FROM documents JOIN n ON doc_id % 25 = n_nationkey WHERE doc_id % 50 < 25),
c AS (SELECT doc_id, work, CASE doc_id % 3 WHEN 0 THEN name || ' (' || year || ')' WHEN 1 THEN name || ' ' || year ELSE '(' || name || ', ' || year || ')' END AS cited, substr(t, 1, length(t) // 2) || ' ' AS l, CASE WHEN doc_id % 3 = 1 THEN ' ' ELSE '' END || substr(t, length(t) // 2 + 1) AS r FROM p),
w AS (SELECT *, l || cited || r AS t, length(l) AS pos, length(l) + length(cited) AS til FROM c),
e AS (SELECT *, greatest(0, pos - 500) AS a, least(length(t), til + 500) AS b FROM w),
f AS (SELECT *, CASE WHEN a > 0 AND contains(substr(t, 1, a), ' ') THEN a - strpos(reverse(substr(t, 1, a)), ' ') + 1 ELSE a END AS begin, CASE WHEN b < length(t) AND contains(substr(t, b + 1), ' ') THEN b + strpos(substr(t, b + 1), ' ') - 1 ELSE b END AS stop FROM e)
SELECT doc_id, work, pos::BIGINT AS position, cited AS citation_text, sha256(trim(substr(t, begin + 1, stop - begin), chr(9) || chr(10) || ' ')) AS context_sha256,
  sha256(trim(CASE WHEN regexp_matches(l, '[.!?]\s+') THEN regexp_extract(l, '(?s)^.*[.!?]\s+(.*)$', 1) ELSE l END || cited || CASE WHEN regexp_matches(r, '[.!?]\s') THEN regexp_extract(r, '(?s)^(.*?[.!?]\s+)', 1) ELSE substr(r, 1, 200) END, chr(9) || chr(10) || ' ')) AS sentence_sha256
FROM f
"""

QUERIES = {"citation_contexts": (citation_contexts, CITATION_CONTEXTS)}
