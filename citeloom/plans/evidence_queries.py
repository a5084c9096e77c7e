"""Queries over attestations of entries and of what merged from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from citeloom.functions import keys
from citeloom.operators import cleaning, dedupe, licence
from citeloom.plans.tables import table


def _entries(spark, sf_dir):
    """Documents as entries, with an attestation for each that has labels; some of them no longer fit the entry."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    d, text = F.col("doc_id"), F.coalesce("text", F.lit(""))
    fields = F.create_map(
        F.lit("abstract"), text,
        F.lit("abstract_source"), F.when(d % 5 == 0, " S2").when(d % 5 == 1, "openalex").otherwise("web"),
        F.lit("doi"), F.concat(F.lit("https://doi.org/10.5/X"), d % 6),
        F.lit("publisher"), F.concat(F.lit(" Press "), d % 4),
        F.lit("sep_context"), F.when(d % 11 == 0, "said  there").otherwise(""),
        F.lit("url"), F.concat(F.lit("https://Site.org/a/"), d % 9),
    )
    vouched = F.struct(
        F.when(F.col("quality") == 1, "s2").otherwise("openalex").alias("abstract_source"),
        F.when(F.col("toxic") == 0, keys.abstract_hash(text)).otherwise("other").alias("abstract_sha256"),
        F.when(d % 2 == 0, "sep_context").alias("context_field"), F.sha2(F.lit("said there"), 256).alias("context_sha256"),
        (F.col("lang") == "de").alias("web_passed"), F.concat(F.lit("https://site.org/a/"), d % 8).alias("web_url"),
        (F.col("n_chars") > 500).alias("api_matched"), (d % 13 == 0).alias("breaker_tripped"),
        F.when(d % 2 == 0, "doi").otherwise("publisher").alias("identifier"), F.when(d % 2 == 0, F.concat(F.lit("10.5/x"), d % 5)).otherwise(F.concat(F.lit("press "), d % 3)).alias("identifier_value"),
    )
    kind = F.when(d % 3 == 0, "Book").otherwise("article")
    entries = docs.select(d.alias("key"), kind.alias("entry_type"), fields.alias("fields"), F.md5(text).alias("h"))
    return entries, docs.join(labels, "doc_id").select(d.alias("key"), vouched.alias("attestation"))


#: Both queries: v has the values of entries, a what is vouched for them; the tier's rank of values v under a.
_PREPARED = r"""
v AS (SELECT doc_id AS key, md5(coalesce(text, '')) AS h, sha256(trim(regexp_replace(replace(coalesce(text, ''), '\', ''), '\s+', ' ', 'g'))) AS abstract, coalesce(text, '') <> '' AS has_abstract,
  CASE doc_id % 5 WHEN 0 THEN 's2' WHEN 1 THEN 'openalex' ELSE 'web' END AS source, '10.5/x' || doc_id % 6 AS doi, CASE WHEN doc_id % 3 = 0 THEN 'press ' || doc_id % 4 END AS publisher, doc_id % 11 = 0 AS sep, 'https://site.org/a/' || doc_id % 9 AS url FROM documents),
a AS (SELECT d.doc_id AS key, CASE WHEN quality = 1 THEN 's2' ELSE 'openalex' END AS source, CASE WHEN toxic = 0 THEN sha256(trim(regexp_replace(replace(coalesce(text, ''), '\', ''), '\s+', ' ', 'g'))) ELSE 'other' END AS abstract,
  d.doc_id % 2 = 0 AS context, coalesce(lang = 'de', false) AS web, 'https://site.org/a/' || d.doc_id % 8 AS url, n_chars > 500 AND d.doc_id % 13 <> 0 AS matched,
  CASE WHEN d.doc_id % 2 = 0 THEN '10.5/x' || d.doc_id % 5 ELSE 'press ' || d.doc_id % 3 END AS identifier FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""
_RANK = """CASE WHEN v.has_abstract AND v.source IN ('s2', 'openalex', 'core', 'ndpr') AND v.source = a.source AND v.abstract = a.abstract THEN 4 WHEN v.sep AND a.context THEN 3
  WHEN a.web AND v.url = a.url THEN 2 WHEN a.matched AND a.identifier = CASE WHEN a.context THEN v.doi ELSE v.publisher END THEN 1 ELSE 0 END"""
_TIERS = "['NONE', 'EXISTENCE', 'WEB', 'CONTEXT', 'ABSTRACT']"


def tier_licence(spark, sf_dir):
    """The tier of every entry by its own attestation."""
    entries, vouched = _entries(spark, sf_dir)
    return licence.stamped(entries, vouched, ["key"]).select(F.col("key").alias("doc_id"), "tier")


TIER_LICENCE = f"WITH {_PREPARED} SELECT v.key AS doc_id, {_TIERS}[{_RANK} + 1] AS tier FROM v LEFT JOIN a ON v.key = a.key"


def tier_restamp(spark, sf_dir):
    """Equal texts merge into the entry with the least key: its tier under the attestations of all of them."""
    entries, vouched = _entries(spark, sf_dir)
    least = entries.groupBy("h").agg(F.min("key").alias("least"))
    lineage = entries.select("h", F.col("key").alias("member")).join(least, "h").select(F.col("least").alias("key"), "member")
    survivors = entries.join(least.select(F.col("least").alias("key")), "key", "left_semi").drop("h")
    return licence.restamped(survivors, lineage, vouched.withColumnRenamed("key", "member")).select(F.col("key").alias("doc_id"), "tier")


TIER_RESTAMP = f"""
WITH {_PREPARED}, g AS (SELECT min(key) OVER (PARTITION BY h) AS least, key AS member FROM v)
SELECT least AS doc_id, {_TIERS}[coalesce(max({_RANK}), 0) + 1] AS tier FROM g JOIN v ON v.key = least LEFT JOIN a ON a.key = member GROUP BY least
"""

def entry_fold(spark, sf_dir):
    """Documents of a source, as entries, folded in groups of equal remainders."""
    d, docs = F.col("doc_id"), table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    fields = F.create_map(F.lit("abstract"), F.when(F.col("quality") == 1, F.md5("text")).otherwise(""), F.lit("journal"), F.when(d % 4 == 0, F.concat(F.lit("j"), d)).otherwise(""), F.lit("pages"), F.concat(F.lit("p"), d), F.lit("note"), F.concat(F.lit("n"), d))
    words = F.concat(F.lit("k, "), F.when(d % 7 == 0, "High").when(d % 3 == 0, "Medium").otherwise("Low"))
    removed = F.when(d % 29 == 0, F.array(F.lit("pages"))).otherwise(F.array().cast("array<string>"))
    entries = docs.select(d.alias("ord"), d.cast("string").alias("key"), fields.alias("fields"), words.alias("keywords"), removed.alias("removed"), F.concat_ws("-", "source", d % 37).alias("g"))
    folded = dedupe.fold_groups(entries, "g", with_lineage=False, with_group=True)
    members = dedupe.fold_lineage(entries, "g", folded).groupBy("key").agg(F.count(F.lit(1)).alias("members"))
    value = lambda k: F.coalesce(F.try_element_at("fields", F.lit(k)), F.lit(""))
    return folded.join(members, "key").select("key", F.col("ord").alias("first_doc"), value("journal").alias("journal"), value("pages").alias("pages"), value("note").alias("note"), "keywords", "members")


#: The fold as it is defined, one entry after the other.
ENTRY_FOLD = """
WITH RECURSIVE e AS (SELECT d.doc_id, concat_ws('-', source, d.doc_id % 37) AS g, coalesce(quality = 1, false) AS has, CASE WHEN d.doc_id % 7 = 0 THEN 2 WHEN d.doc_id % 3 = 0 THEN 1 ELSE 0 END AS imp,
  CASE WHEN d.doc_id % 4 = 0 THEN 'j' || d.doc_id END AS journal, d.doc_id % 29 = 0 AS gone, row_number() OVER (PARTITION BY concat_ws('-', source, d.doc_id % 37) ORDER BY d.doc_id) AS rn FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
f AS (SELECT g, rn, doc_id, has, imp, journal, gone, doc_id AS first_doc FROM e WHERE rn = 1
  UNION ALL SELECT g, rn, CASE WHEN later THEN new_doc ELSE doc_id END, has, imp, CASE WHEN later THEN coalesce(new_journal, journal) ELSE coalesce(journal, new_journal) END, gone, first_doc
  FROM (SELECT f.g, e.rn, f.doc_id, e.doc_id AS new_doc, f.journal, e.journal AS new_journal, f.first_doc, f.has OR e.has AS has, greatest(f.imp, e.imp) AS imp, f.gone OR e.gone AS gone, CASE WHEN e.has <> f.has THEN e.has ELSE e.imp > f.imp END AS later FROM f JOIN e ON e.g = f.g AND e.rn = f.rn + 1))
SELECT CAST(doc_id AS VARCHAR) AS key, first_doc, coalesce(journal, '') AS journal, CASE WHEN gone AND rn > 1 THEN '' ELSE 'p' || doc_id END AS pages, 'n' || doc_id AS note, 'k, ' || ['Low', 'Medium', 'High'][imp + 1] AS keywords, rn AS members
FROM (SELECT *, max(rn) OVER (PARTITION BY g) AS last FROM f) WHERE rn = last
"""

def clean_entries(spark, sf_dir):
    """Documents as entries of seven files; two of three have a record of their own, some of which lack the volume."""
    docs, d = table(spark, sf_dir, "documents"), F.col("doc_id")
    no = F.lit(None).cast("string")
    fields = F.create_map(F.lit("doi"), F.concat(F.lit("https://doi.org/10.1/D"), d), F.lit("volume"), d.cast("string"), F.lit("year"), F.lit("2001"), F.lit("title"), F.concat(F.lit("t"), d))
    entries = docs.select(F.concat(F.lit("b"), d % 7).alias("bib_file"), d.alias("entry_ord"), F.concat(F.lit("k"), d).alias("key"), F.when(d % 11 == 0, "book").otherwise("article").alias("entry_type"), fields.alias("fields"))
    records = docs.filter(d % 3 != 0).select(
        F.concat(F.lit("f"), d).alias("file"), F.lit("crossref").alias("producer"), F.lit(0).alias("rec_ord"), (d % 5 != 0).alias("entry_scoped"), F.lit("").alias("title"), no.alias("container_title"),
        F.when((d % 4 != 0) & (d % 7 != 3), d.cast("string")).alias("volume"), no.alias("issue"), no.alias("pages"), no.alias("publisher"), F.lit("2002").alias("year"),
        F.when(d % 2 == 0, "print").alias("year_basis"), no.alias("suggested_type"), F.concat(F.lit("10.1/d"), d).alias("doi"),
    )
    plan = cleaning.cleaned(entries, records)
    value = lambda k: F.coalesce(F.try_element_at("new_fields", F.lit(k)), F.lit(""))
    return plan.select(F.col("entry_ord").alias("doc_id"), "outcome", F.array_join("removed", ",").alias("removed"), "tripped", "new_type", "year_verdict", value("year").alias("new_year"), value("volume").alias("volume"), value("keywords").alias("keywords"), F.coalesce("identifier_value", F.lit("")).alias("identifier"))


CLEAN_ENTRIES = """
WITH e AS (SELECT doc_id, doc_id % 7 AS f, doc_id % 3 <> 0 AS matched, doc_id % 3 <> 0 AND (doc_id % 4 = 0 OR doc_id % 7 = 3) AS hit, doc_id % 11 = 0 AS book FROM documents),
t AS (SELECT *, count(*) FILTER (hit) OVER w >= 5 AND count(*) FILTER (hit) OVER w * 100 > count(*) OVER w * 30 AS tripped FROM e WINDOW w AS (PARTITION BY f)),
v AS (SELECT *, hit AND NOT tripped AS gone, CASE WHEN tripped THEN 'tripped' WHEN NOT matched THEN 'unmatched' WHEN doc_id % 5 = 0 THEN 'unscoped' WHEN doc_id % 2 <> 0 THEN 'no-version-of-record-date' WHEN book THEN 'book-year-moved-later' ELSE 'yes' END AS year_verdict FROM t)
SELECT doc_id, CASE WHEN matched THEN 'doi' ELSE 'unmatched' END AS outcome, CASE WHEN gone THEN 'volume' ELSE '' END AS removed, tripped, CASE WHEN book AND gone THEN 'misc' WHEN book THEN 'book' ELSE 'article' END AS new_type, year_verdict,
  CASE WHEN year_verdict = 'yes' THEN '2002' ELSE '2001' END AS new_year, CASE WHEN gone THEN '' ELSE CAST(doc_id AS VARCHAR) END AS volume,
  CASE WHEN gone OR year_verdict = 'yes' THEN 'METADATA_CLEANED: ' || concat_ws(', ', CASE WHEN gone THEN 'volume' END, CASE WHEN year_verdict = 'yes' THEN 'year:2001->2002' END) ELSE '' END AS keywords,
  CASE WHEN matched THEN '10.1/d' || doc_id ELSE '' END AS identifier FROM v
"""

QUERIES = {
    "clean_entries": (clean_entries, CLEAN_ENTRIES),
    "entry_fold": (entry_fold, ENTRY_FOLD),
    "tier_licence": (tier_licence, TIER_LICENCE),
    "tier_restamp": (tier_restamp, TIER_RESTAMP),
}
