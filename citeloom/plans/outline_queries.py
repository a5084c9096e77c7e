"""Queries over pages that Spark makes of whole documents, read as articles and as reviews."""

from __future__ import annotations

from pyspark.sql import functions as F

from citeloom.plans.tables import table
from citeloom.sources import outlines


def _escaped(c):
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(char), F.lit(name))
    return c


def _articles(spark, sf_dir):
    """Documents as articles: sections of three levels, paragraphs left open, a bibliography for four of five."""
    d = F.col("doc_id")
    text = F.concat(F.lit("| "), _escaped(F.coalesce("text", F.lit(""))), F.lit(" |"))
    listed = F.when(d % 5 > 0, F.concat(F.lit("<h2>Works Cited</h2><div>no</div><ul><li>Lee, C., "), F.lit(1900) + d % 100, F.lit(", <i>On "), F.coalesce("lang", F.lit("und")), F.lit("</i>, Press.<li>See the entry</ul>"))).otherwise(F.lit(""))
    deep = F.when(d % 2 == 0, F.lit("<h4>Deep</h4><blockquote><p>quoted</blockquote><p>d")).otherwise(F.lit(""))
    page = F.concat(F.lit("<div class='entry-content'><p>opening<p>"), text, F.lit("<h2>First</h2><p>"), text, F.lit("<h3>Inner</h3><p>a</p><p>b"), deep, F.lit("<h3>Empty</h3><h2>Last</h2><p>"), text, listed, F.lit("</div>"))
    return outlines.outlines(table(spark, sf_dir, "documents").select("doc_id", page.alias("html")))


def article_sections(spark, sf_dir):
    """The section tree of articles made of documents, with each section's subtree."""
    s = outlines.sections(_articles(spark, sf_dir), "doc_id")
    return s.select("doc_id", "section", "level", "parent", "last", "title", F.sha2(F.encode("content", "utf-8"), 256).alias("content_sha256"))


_TEXT = "'| ' || coalesce(text, '') || ' |'"
ARTICLE_SECTIONS = f"""
WITH d AS (SELECT doc_id, doc_id % 2 = 0 AS deep, CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END AS k, {_TEXT} AS t FROM documents),
s AS (
  SELECT doc_id, 1 AS section, 2 AS level, NULL AS parent, 3 + k AS last, 'First' AS title, t AS content FROM d
  UNION ALL SELECT doc_id, 2, 3, 1, 2 + k, 'Inner', 'a b' FROM d
  UNION ALL SELECT doc_id, 3, 4, 2, 3, 'Deep', 'd' FROM d WHERE deep
  UNION ALL SELECT doc_id, 3 + k, 3, 1, 3 + k, 'Empty', '' FROM d
  UNION ALL SELECT doc_id, 4 + k, 2, NULL, 4 + k, 'Last', t FROM d
)
SELECT doc_id, CAST(section AS INTEGER) AS section, CAST(level AS INTEGER) AS level, CAST(parent AS INTEGER) AS parent, CAST(last AS INTEGER) AS last, title, sha256(content) AS content_sha256 FROM s
"""


def article_lines(spark, sf_dir):
    """Bibliography lines of articles made of documents, as they are read, beside the articles' preambles."""
    read = _articles(spark, sf_dir)
    opened = outlines.with_parts(read).select("doc_id", F.sha2(F.encode("preamble", "utf-8"), 256).alias("preamble_sha256"))
    lines = outlines.bibliography_lines(read, "doc_id")
    return opened.join(lines, "doc_id", "left").select("doc_id", "preamble_sha256", "line_no", "raw", "parsed.confidence", "parsed.year", "parsed.title")


ARTICLE_LINES = f"""
WITH d AS (SELECT doc_id, CAST(1900 + doc_id % 100 AS VARCHAR) AS y, coalesce(lang, 'und') AS lang, sha256('opening ' || {_TEXT}) AS preamble_sha256 FROM documents)
SELECT doc_id, preamble_sha256, CAST(NULL AS INTEGER) AS line_no, NULL AS raw, NULL AS confidence, NULL AS year, NULL AS title FROM d WHERE doc_id % 5 = 0
UNION ALL SELECT doc_id, preamble_sha256, 1, 'Lee, C., ' || y || ', On ' || lang || ' , Press.', 'high', y, 'On ' || lang FROM d WHERE doc_id % 5 > 0
UNION ALL SELECT doc_id, preamble_sha256, 2, 'See the entry', 'unparseable', NULL, NULL FROM d WHERE doc_id % 5 > 0
"""


def review_summaries(spark, sf_dir):
    """Summaries of reviews whose paragraphs are the lines of documents, some of them in brackets."""
    d = F.col("doc_id")
    before, after = (F.element_at(F.array(*map(F.lit, marks)), (d % 5 + 1).cast("int")) for marks in ("[((qq", "]).qq"))
    body = F.concat_ws("", F.transform(F.split(_escaped(F.coalesce("text", F.lit(""))), "\n"), lambda line: F.concat(F.lit("<p>"), before, line, after)))
    page = F.concat(F.lit("<meta name='author' content='R"), d, F.lit("'><time datetime='2020-01-01'></time><p>outside</p><div class='review-content'>"), body, F.lit("</div>"))
    read = outlines.reviews(outlines.outlines(table(spark, sf_dir, "documents").select("doc_id", page.alias("html"))))
    return read.select("doc_id", "reviewer", "review_date", F.col("paragraph_count").cast("long").alias("paragraph_count"), F.sha2(F.encode("summary_text", "utf-8"), 256).alias("summary_sha256"))


REVIEW_SUMMARIES = """
WITH p AS (
  SELECT doc_id, CASE WHEN doc_id % 5 IN (0, 1) THEN [] ELSE list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: (CASE WHEN doc_id % 5 = 2 THEN '(' ELSE 'q' END) || x || (CASE WHEN doc_id % 5 = 2 THEN '.' ELSE 'q' END)), lambda x: length(x) >= 50)[1:8] END AS p
  FROM documents)
SELECT doc_id, 'R' || doc_id AS reviewer, '2020-01-01' AS review_date, len(p) AS paragraph_count, sha256(coalesce(array_to_string(p, chr(10) || chr(10)), '')) AS summary_sha256 FROM p
"""

QUERIES = {"article_sections": (article_sections, ARTICLE_SECTIONS), "article_lines": (article_lines, ARTICLE_LINES), "review_summaries": (review_summaries, REVIEW_SUMMARIES)}
