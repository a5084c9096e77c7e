"""Queries over bibliographies that take abstracts from answers, in two runs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from citeloom.operators import enrichment
from citeloom.plans.tables import bib_safe, table
from citeloom.session import shared_dir

#: Documents in a file.
FILE = 200


def _abstract(text):
    """A document's text as an abstract whose braces are balanced."""
    return F.concat(F.lit("A "), bib_safe(text), F.lit(" |"))


def _texts(docs):
    """Documents as entries of bibliographies; every seventh has an abstract already, every third no DOI."""
    d = F.col("doc_id")
    line = lambda name, v: F.concat(F.lit(f"  {name} = {{"), v, F.lit("},\n"))
    raw = F.concat(
        F.when(d % 4 == 0, "@book{k").otherwise("@article{k"), d, F.lit(",\n"), line("title", F.concat(d, F.lit(" Studies of reasons"))), line("author", F.concat(F.lit("Name"), d % 10, F.lit(", A. and Other, B."))),
        F.when(d % 3 != 0, line("doi", F.concat(F.lit("https://doi.org/10.7/X"), d))).otherwise(""), F.when(d % 7 == 0, F.concat(line("abstract", _abstract(F.col("text"))), line("abstract_source", F.lit("web")))).otherwise(""),
        line("keywords", F.when(d % 5 == 0, "topic, INCOMPLETE").otherwise("topic")), F.lit("}\n\n"),
    )
    rows = docs.select(F.concat(F.lit("domain-"), F.floor(d / FILE), F.lit(".bib")).alias("bib_file"), "doc_id", raw.alias("raw"))
    listed = F.array_sort(F.collect_list(F.struct("doc_id", "raw")))  # of at most FILE documents
    return rows.groupBy("bib_file").agg(F.array_join(F.transform(listed, lambda r: r["raw"]), "").alias("content")).select("bib_file", F.lit(0).alias("file_ord"), "content")


def _answers(docs, sources):
    """s2 knows even documents, openalex every odd one by DOI; core finds those with a remainder below 6 modulo 8 by title or DOI."""
    d = F.col("doc_id")
    doi, title, surname = F.concat(F.lit("10.7/x"), d), F.concat(d, F.lit(" studies of reasons")), F.concat(F.lit("name"), d % 10)
    row = lambda source, abstract: F.struct(F.lit(source).alias("source"), doi.alias("doi"), title.alias("title"), surname.alias("surname"), abstract.alias("abstract"), d.alias("ord"))
    own = _abstract(F.col("text"))
    rows = {"s2": (d % 2 == 0, own), "openalex": (d % 2 == 1, F.concat(own, F.lit(" from openalex"))), "core": (d % 8 < 6, F.concat(own, F.lit(" found by a search in the archive that holds it")))}
    out = None
    for source in sources:
        known, abstract = rows[source]
        part = docs.filter(known).select(row(source, abstract).alias("r")).select("r.*")
        out = part if out is None else out.unionByName(part)
    return out


def enrichment_runs(spark, sf_dir):
    """The ledger after two runs over the same bibliographies: s2 and openalex answer in the first, core too in the second."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = f"{shared_dir(spark)}/enriched-{uuid.uuid4().hex}"
    enrichment.enrich_files(_texts(docs), _answers(docs, ["s2", "openalex"]), out)
    enrichment.enrich_files(enrichment.current(spark, out)[0], _answers(docs, ["s2", "openalex", "core"]), out)
    return enrichment.current_ledger(spark, out).select(F.expr("cast(substr(key, 2) AS bigint)").alias("doc_id"), "bib_file", "abstract_source", "abstract_sha256")


_TEXT = """'A ' || translate(coalesce(text, ''), '{}@"', '()a''') || ' |'"""
ENRICHMENT_RUNS = f"""
WITH d AS (SELECT doc_id, {_TEXT} AS own FROM documents),
t AS (
  SELECT doc_id, own, doc_id % 7 = 0 AND length(own) > 10 AS held,
    CASE WHEN doc_id % 3 <> 0 AND doc_id % 2 = 0 THEN 's2' WHEN doc_id % 3 <> 0 THEN 'openalex' WHEN doc_id % 8 < 6 THEN 'core' END AS source
  FROM d),
a AS (SELECT *, CASE source WHEN 's2' THEN own WHEN 'openalex' THEN own || ' from openalex' ELSE own || ' found by a search in the archive that holds it' END AS abstract FROM t WHERE source IS NOT NULL)
SELECT doc_id, 'domain-' || CAST(floor(doc_id / {FILE}) AS BIGINT) || '.bib' AS bib_file, source AS abstract_source, sha256(trim(regexp_replace(replace(abstract, '\\', ''), '\\s+', ' ', 'g'))) AS abstract_sha256
FROM a WHERE NOT held OR source = 's2'
"""

QUERIES = {"enrichment_runs": (enrichment_runs, ENRICHMENT_RUNS)}
