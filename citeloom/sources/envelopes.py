"""API result envelopes (JSON text) as canonical records."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Parts of a source or file name, in the order in which they are tried, and the producer they tell.
PRODUCERS = (("semantic_scholar", "s2"), ("s2", "s2"), ("openalex", "openalex"), ("crossref", "crossref"), ("verify", "crossref"), ("arxiv", "arxiv"), ("philpapers", "philpapers"), ("core", "core"))
RECORD = "title string, container_title string, volume string, issue string, pages string, publisher string, year string, year_basis string, suggested_type string, doi string"


@F.pandas_udf(T.StringType())
def salvaged(texts: pd.Series) -> pd.Series:
    """The first JSON object with `results` in a text that may hold log lines before and after it."""
    decoder = json.JSONDecoder()

    def find(text):
        at = text.find("{") if isinstance(text, str) else -1
        while at >= 0:
            try:
                value, end = decoder.raw_decode(text, at)
                if isinstance(value, dict) and "results" in value:
                    return text[at:end]
            except ValueError:
                pass
            at = text.find("{", at + 1)
        return None

    return texts.map(find)


def producer(source: Column, file: Column) -> Column:
    """Which service an envelope is from: by its source, else by its file name."""
    out = None
    for name in (F.lower(F.coalesce(source, F.lit(""))), F.lower(F.coalesce(file, F.lit("")))):
        for part, kind in PRODUCERS:
            out = F.when(F.contains(name, F.lit(part)), kind) if out is None else out.when(F.contains(name, F.lit(part)), kind)
    return out.otherwise("unknown")


def pool(texts: DataFrame) -> DataFrame:
    """file, status (read, salvaged, skipped), producer, body (variant) of files (file, content); a path counts once."""
    once = texts.dropDuplicates(["file"])
    read = once.withColumn("direct", F.expr("try_parse_json(content)"))
    # Only files that do not parse go through Python.
    broken = read.filter("direct IS NULL").withColumn("content", salvaged("content"))
    bad = broken.select("file", F.expr("try_parse_json(content)").alias("body"), F.lit("salvaged").alias("status"))
    good = read.filter("direct IS NOT NULL").select("file", F.col("direct").alias("body"), F.lit("read").alias("status"))
    both = good.unionByName(bad)
    status = F.when(F.col("body").isNull(), "skipped").otherwise(F.col("status"))
    return both.select("file", status.alias("status"), producer(F.expr("try_variant_get(body, '$.source', 'string')"), F.col("file")).alias("producer"), "body")


def _get(path: str, kind: str = "string") -> Column:
    return F.expr(f"try_variant_get(r, '$.{path}', '{kind}')")


def _pages(first: Column, last: Column) -> Column:
    return F.when(F.coalesce(first, F.lit("")) == "", F.lit(None).cast("string")).when((F.coalesce(last, F.lit("")) == "") | (first == last), first).otherwise(F.concat(first, F.lit("-"), last))


def records(pooled: DataFrame) -> DataFrame:
    """One canonical record for each result of the pool; entry_scoped marks the only result of a crossref file."""
    each = pooled.filter("body IS NOT NULL").select("file", "producer", F.expr("cast(try_variant_get(body, '$.results', 'array<variant>') AS array<variant>)").alias("results"))
    each = each.select("file", "producer", F.size("results").alias("n"), F.posexplode("results").alias("rec_ord", "r"))
    by = lambda **kinds: F.coalesce(*[F.when(F.col("producer") == k, v) for k, v in kinds.items() if k != "rest"], kinds.get("rest", F.lit(None).cast("string")))
    venue = F.coalesce(F.when(F.expr("schema_of_variant(variant_get(r, '$.journal'))").startswith("OBJECT"), _get("journal.name")), _get("journal"), _get("venue"))
    journal_part = lambda k: F.coalesce(_get(f"journal.{k}"))
    no = F.lit(None).cast("string")
    return each.select(
        "file",
        "producer",
        "rec_ord",
        ((F.col("producer") == "crossref") & (F.col("n") == 1)).alias("entry_scoped"),
        _get("title").alias("title"),
        by(openalex=_get("source.name"), crossref=_get("container_title"), arxiv=_get("journal_ref"), philpapers=F.coalesce(_get("journal"), _get("source")), core=_get("journal"), rest=venue).alias("container_title"),
        by(openalex=_get("biblio.volume"), crossref=_get("volume"), rest=journal_part("volume")).alias("volume"),
        by(openalex=_get("biblio.issue"), crossref=_get("issue")).alias("issue"),
        by(openalex=_pages(_get("biblio.first_page"), _get("biblio.last_page")), crossref=_get("page"), rest=journal_part("pages")).alias("pages"),
        by(openalex=_get("source.publisher"), crossref=_get("publisher"), core=_get("publisher")).alias("publisher"),
        by(openalex=_get("publication_year"), arxiv=F.expr("cast(try_cast(substr(try_variant_get(r, '$.published', 'string'), 1, 4) AS int) AS string)"), rest=_get("year")).alias("year"),
        by(crossref=_get("year_basis")).alias("year_basis"),
        by(crossref=_get("suggested_bibtex_type")).alias("suggested_type"),
        F.when(F.col("producer") == "philpapers", no).otherwise(_get("doi")).alias("doi"),
    )


def envelope(source: str, query: Column, results: Column, errors: Column) -> Column:
    """The uniform JSON answer: status, source, query, results, count, errors."""
    status = F.when(F.size(errors) == 0, "success").when(F.size(results) > 0, "partial").otherwise("error")
    return F.to_json(F.struct(status.alias("status"), F.lit(source).alias("source"), query.alias("query"), results.alias("results"), F.size(results).alias("count"), errors.alias("errors")))


#: States that a ledger may have, and identifiers it may have verified.
LEDGER_VERSION, IDENTIFIERS = 1, ("doi", "publisher")


def ledger_state(texts: DataFrame, expected: DataFrame) -> DataFrame:
    """bib_file, state: present, missing or malformed, for the files expected (bib_file) given ledgers (bib_file, content)."""
    v = F.expr("try_parse_json(content)")
    shape = F.expr("schema_of_variant(variant_get(v, '$.entries'))")
    ok = (F.expr("try_variant_get(v, '$.schema_version', 'int')") == LEDGER_VERSION) & (F.expr("try_variant_get(v, '$.bib_file', 'string')") == F.col("bib_file")) & shape.startswith("OBJECT")
    state = F.when(F.col("content").isNull(), "missing").when(F.coalesce(ok, F.lit(False)), "present").otherwise("malformed")
    return expected.select("bib_file").join(texts, "bib_file", "left").withColumn("v", v).select("bib_file", state.alias("state"))
