"""Queries over bibliography files that Spark writes from the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from citeloom.plans.tables import bib_safe, table
from citeloom.session import shared_dir
from citeloom.sources import bibtex

#: Documents in a file.
FILE = 500


def _raw(text):
    """The text of an entry for a document: values with inner braces, in quotes, bare, and joined."""
    d = F.col("doc_id")
    safe = bib_safe(text)
    opening = F.when(d % 4 == 0, "@Article(").when(d % 4 == 1, "@book{").otherwise("@misc {")
    abstract = F.when(d % 3 == 0, F.concat(F.lit('"A {B {"C"}} '), safe, F.lit(' |"'))).otherwise(F.concat(F.lit("{A {B {C}} "), safe, F.lit(" |}")))
    return F.concat(
        opening, F.lit("k"), d, F.lit(",\n  year = "), F.lit(1900) + d % 100, F.lit(",\n  publisher = pub # {, } # \""), F.col("lang"), F.lit('" ,\n  abstract='), abstract,
        F.lit(",\n  Note = {first}, note = {last}\n"), F.when(d % 4 == 0, ")").otherwise("}"), F.lit("\n\n"),
    )


def _written(spark, sf_dir):
    """Documents as files of entries, written to the shared folder and read again as whole files."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    rows = docs.select(F.concat(F.lit("docs "), F.floor(F.col("doc_id") / FILE), F.lit(".bib")).alias("bib_file"), "doc_id", _raw(F.col("text")).alias("raw"))
    listed = F.array_sort(F.collect_list(F.struct("doc_id", "raw")))  # of at most FILE documents
    files = rows.groupBy("bib_file").agg(F.concat(F.lit('@string{pub = "Press"}\n'), F.array_join(F.transform(listed, lambda r: r["raw"]), "")).alias("content"))
    path = f"{shared_dir(spark)}/bib-{uuid.uuid4().hex}"
    bibtex.write_texts(files, path)
    return bibtex.parse(bibtex.read_texts(spark, [path]))


def bib_entries(spark, sf_dir):
    """What the scanner reads in entries made of whole documents."""
    e = _written(spark, sf_dir).filter("key IS NOT NULL")
    field = lambda name: F.try_element_at("fields", F.lit(name))
    return e.select(
        F.expr("cast(substr(key, 2) AS bigint)").alias("doc_id"), "entry_type", field("year").alias("year"), field("publisher").alias("publisher"), field("note").alias("note"),
        F.sha2(F.encode(field("abstract"), "utf-8"), 256).alias("abstract_sha256"), F.size("places").cast("long").alias("n_fields"), F.coalesce("error", F.lit("")).alias("error"),
    )


_SAFE = """translate(coalesce(text, ''), '{}@"', '()a''')"""
BIB_ENTRIES = f"""
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'article' WHEN 1 THEN 'book' ELSE 'misc' END AS entry_type, CAST(1900 + doc_id % 100 AS VARCHAR) AS year, 'Press, ' || lang AS publisher, 'last' AS note,
  sha256(CASE WHEN doc_id % 3 = 0 THEN 'A {{B {{"C"}}}} ' ELSE 'A {{B {{C}}}} ' END || {_SAFE} || ' |') AS abstract_sha256, 5::BIGINT AS n_fields, '' AS error
FROM documents
"""


def bib_splice(spark, sf_dir):
    """The raw entries after edits: a year set and a field taken out, or one added; every third is left alone."""
    e = _written(spark, sf_dir).filter("key IS NOT NULL")
    d = F.expr("cast(substr(key, 2) AS bigint)")
    none = F.lit(None).cast("string")
    edits = F.when(d % 3 == 1, F.create_map(F.lit("year"), F.lit("2000"), F.lit("publisher"), none)).when(d % 3 == 2, F.create_map(F.lit("doi"), F.lit("10.1/{x}")))
    done = bibtex.spliced(e.select(d.alias("doc_id"), "raw", edits.alias("edits"), none.alias("new_type")))
    return done.select("doc_id", F.sha2(F.encode("raw", "utf-8"), 256).alias("raw_sha256"), F.coalesce("refusal", F.lit("")).alias("refusal"))


BIB_SPLICE = f"""
WITH t AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '@Article(' WHEN 1 THEN '@book{{' ELSE '@misc {{' END || 'k' || doc_id || ',' AS head, CAST(1900 + doc_id % 100 AS VARCHAR) AS year,
  'pub # {{, }} # "' || lang || '" ,' AS publisher, CASE WHEN doc_id % 3 = 0 THEN '"A {{B {{"C"}}}} ' || {_SAFE} || ' |"' ELSE '{{A {{B {{C}}}} ' || {_SAFE} || ' |}}' END AS abstract, CASE WHEN doc_id % 4 = 0 THEN ')' ELSE '}}' END AS tail FROM documents),
r AS (SELECT doc_id, head || CASE WHEN doc_id % 3 = 2 THEN chr(10) || '  doi = {{10.1/{{x}}}},' ELSE '' END || chr(10) || '  year = ' || CASE WHEN doc_id % 3 = 1 THEN '{{2000}}' ELSE year END || ','
  || CASE WHEN doc_id % 3 = 1 THEN '' ELSE chr(10) || '  publisher = ' || publisher END || chr(10) || '  abstract=' || abstract || ',' || chr(10) || '  Note = {{first}}, note = {{last}}' || chr(10) || tail || chr(10) || chr(10) AS raw FROM t)
SELECT doc_id, sha256(raw) AS raw_sha256, '' AS refusal FROM r
"""

QUERIES = {"bib_entries": (bib_entries, BIB_ENTRIES), "bib_splice": (bib_splice, BIB_SPLICE)}
