"""Reviews put together from documents as their sections."""

from __future__ import annotations

from pyspark.sql import functions as F

from citeloom.operators import assembly
from citeloom.plans.tables import table

#: Documents in a review.
SECTIONS = 20


def assembled_parts(spark, sf_dir):
    """Places and contents of all parts of reviews whose sections are whole documents; every seventh section is empty."""
    d, review = F.col("doc_id"), F.floor(F.col("doc_id") / SECTIONS)
    front = F.when(d % 3 == 0, F.lit("---\na: b\n---\n\n")).otherwise(F.lit(""))
    content = F.when(d % 7 == 0, F.lit(" \n")).otherwise(F.concat(front, F.lit("| "), F.coalesce("text", F.lit("")), F.lit(" |\n\n")))
    docs = table(spark, sf_dir, "documents").select(review.alias("review"), F.concat(F.lit("Section-"), d % SECTIONS).alias("name"), content.alias("content"))
    reviews = docs.select("review").distinct().select("review", F.concat(F.lit("Review "), "review").alias("title"), F.lit(None).cast("string").alias("date"), F.when(F.col("review") % 2 == 0, "no 1").alias("subfield"))
    p = assembly.parts(docs, reviews)
    return p.select("review", "part", "name", "start", "bytes", F.sha2(F.encode("content", "utf-8"), 256).alias("content_sha256"), F.array_join("warnings", "|").alias("warnings"))


ASSEMBLED_PARTS = f"""
WITH d AS (SELECT CAST(floor(doc_id / {SECTIONS}) AS BIGINT) AS review, doc_id % {SECTIONS} AS n, doc_id % 7 = 0 AS lost, '| ' || coalesce(text, '') || ' |' AS content FROM documents),
p AS (
  SELECT review, -1 AS n, NULL AS name, '---' || chr(10) || 'title: Review ' || review || chr(10) || '---' AS content,
    array_to_string(list_concat(CASE WHEN review % 2 = 0 THEN ['invalid subfield dropped from front matter (4 characters)'] ELSE [] END, list_sort(coalesce(list('empty section: Section-' || n) FILTER (lost), []))), '|') AS warnings
  FROM d GROUP BY review
  UNION ALL SELECT review, n, 'Section-' || n, content, '' FROM d WHERE NOT lost
)
SELECT review, CAST(row_number() OVER w - 1 AS INTEGER) AS part, name, CAST(coalesce(sum(strlen(content) + 2) OVER (PARTITION BY review ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start,
  CAST(strlen(content) AS BIGINT) AS bytes, sha256(content) AS content_sha256, warnings FROM p WINDOW w AS (PARTITION BY review ORDER BY n)
"""

QUERIES = {"assembled_parts": (assembled_parts, ASSEMBLED_PARTS)}
