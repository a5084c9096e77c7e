"""Cleaning of entries by evidence, and the fate of entries that share a citation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.functions import keys
from citeloom.operators import checks, matching
from citeloom.operators.evidence import overwritable_year, with_breaker
from citeloom.session import written
from citeloom.sources.bibtex import REQUIRED

#: Fields that may be removed when nothing verifies them.
CLEANABLE = ("journal", "booktitle", "volume", "number", "pages", "publisher", "doi")


def cleaning_plan(entries: DataFrame, verified: DataFrame) -> DataFrame:
    """entries (bib_file, key, entry_type, fields, matched, doi_matched) with removed, kept, new_type and tripped.

    verified: bib_file, key, field. Only matched entries lose fields. An entry
    that then lacks a required field becomes misc, but for an article whose
    surviving DOI matched. Where a file's breaker trips nothing is applied.
    """
    proof = verified.groupBy("bib_file", "key").agg(F.collect_set("field").alias("proof"))
    joined = entries.join(proof, ["bib_file", "key"], "left")
    cleanable = F.array_intersect(F.map_keys("fields"), F.array(*map(F.lit, CLEANABLE)))
    removed = F.when(F.coalesce("matched", F.lit(False)), F.array_except(cleanable, F.coalesce("proof", F.array().cast("array<string>")))).otherwise(F.array().cast("array<string>"))
    planned = with_breaker(joined.withColumn("removed", F.array_sort(removed)).withColumn("__hit", F.size("removed") > 0), "__hit", ["bib_file"])
    planned = planned.withColumn("removed", F.when(F.col("tripped"), F.array().cast("array<string>")).otherwise(F.col("removed")))
    planned = planned.withColumn("kept", F.map_filter("fields", lambda k, v: ~F.array_contains("removed", k)))
    required = F.create_map(*[x for kind, names in REQUIRED.items() for x in (F.lit(kind), F.array(*map(F.lit, names)))])
    lacks = F.size(F.array_except(F.coalesce(F.try_element_at(required, F.col("entry_type")), F.array().cast("array<string>")), F.map_keys("kept"))) > 0
    spared = (F.col("entry_type") == "article") & F.coalesce("doi_matched", F.lit(False)) & F.map_contains_key("kept", "doi")
    new_type = F.when((F.size("removed") > 0) & lacks & ~spared, "misc").otherwise(F.col("entry_type"))
    return planned.withColumn("new_type", new_type).drop("proof", "__hit")


def with_marker(keywords: Column, removed: Column, year_change: Column) -> Column:
    """Keywords with one cleaning marker at the end, in the place of any older one; without news they stay."""
    old = F.trim(F.regexp_replace(keywords, r",?\s*METADATA\\*_CLEANED:.*$", ""))
    news = F.concat_ws(", ", F.when(F.size(removed) > 0, F.array_join(removed, ", ")), F.when(year_change.isNotNull(), F.concat(F.lit("year:"), year_change)))
    marker = F.concat(F.lit("METADATA_CLEANED: "), news)
    return F.when(news == "", keywords).otherwise(F.concat_ws(", ", F.nullif(old, F.lit("")), marker))


def collision_fate(groups: DataFrame) -> DataFrame:
    """members of collision groups with kept and reason.

    groups: group, member, supported, sighted (its letter), mentioned (its
    title), and for the group first_supported, first_any, unmatched_letter,
    rejected_mention, second_only. Members go only on positive evidence.
    """
    own = F.col("sighted") | F.col("mentioned")
    clear = F.col("first_supported") & ~F.col("unmatched_letter") & ~F.col("rejected_mention")
    unclear = F.col("first_any") | F.col("unmatched_letter") | F.col("rejected_mention")
    reason = F.when(clear, "first").when(unclear, "ambiguous").when(F.col("second_only"), "second").otherwise("nothing")
    kept = F.when(reason == "first", F.col("supported") | own).when(reason == "second", own).otherwise(True)
    return groups.withColumn("reason", reason).withColumn("kept", kept)


def collision_groups(entries: DataFrame) -> DataFrame:
    """entry, group for entries (entry, surname, year) that share year and any spelling of the surname with another."""
    from citeloom.functions.keys import name_variants
    from citeloom.operators.components import connected_components

    spelled = entries.select("entry", "year", F.explode(name_variants(F.col("surname"))).alias("v"))
    first = spelled.groupBy("year", "v").agg(F.min("entry").alias("least"), F.count_distinct("entry").alias("n")).filter("n > 1")
    edges = spelled.join(first, ["year", "v"]).select(F.col("entry").alias("a"), F.col("least").alias("b"))
    return connected_components(edges).select(F.col("node").alias("entry"), F.col("label").alias("group"))


#: Where a record has the value of an entry's field.
OF_RECORD = {"journal": "container_title", "booktitle": "container_title", "volume": "volume", "number": "issue", "pages": "pages", "publisher": "publisher", "doi": "doi"}


def same_value(name: Column, value: Column, own: Column) -> Column:
    """Whether the value of the field called name is that of the entry's own record; empty values confirm nothing."""
    equal = lambda form: F.nullif(form(value), F.lit("")) == form(own)
    test = (
        F.when(name.isin("journal", "booktitle"), F.coalesce(equal(keys.venue_key), F.lit(False)) | equal(keys.journal_key))
        .when(name == "pages", equal(keys.page_key))
        .when(name == "publisher", equal(keys.publisher_key))
        .when(name == "doi", equal(keys.doi_key))
        .otherwise(equal(lambda c: F.trim(keys.text_of(c))))
    )
    return F.coalesce(test, F.lit(False))


def cleaned(entries: DataFrame, records: DataFrame) -> DataFrame:
    """What cleaning makes of entries (bib_file, entry_ord, key, entry_type, fields), by the records of the pool.

    entries with outcome (how the own record was found, or why not), removed,
    tripped, new_type, new_fields (with a marker of what changed), year_verdict,
    and the identifier that the own record confirms, with its value: this is
    what a later tier is bound to. A field stays if any record of the pool has
    its value, or the own one. Years change only by the own record, found by
    DOI. Nothing changes in a file whose breaker trips.
    """
    value = lambda name: F.coalesce(F.try_element_at("fields", F.lit(name)), F.lit(""))
    known = records.select(
        keys.doi_key("doi").alias("doi"), keys.title_key("title").alias("title"), keys.year_key("year").alias("year"), F.col("entry_scoped").alias("scoped"), F.struct("file", "rec_ord").alias("ord"),
        keys.supplied_fields().alias("filled"), F.struct(*[c for c in dict.fromkeys([*OF_RECORD.values(), "year", "year_basis", "entry_scoped"])]).alias("record"),
    )
    asked = entries.select("bib_file", "entry_ord", keys.doi_key(value("doi")).alias("doi"), keys.title_key(keys.latex_text(value("title"))).alias("title"), keys.year_key(value("year")).alias("year"))
    found = matching.resolve(asked, known).select("bib_file", "entry_ord", "outcome", "record")
    held = records.select(F.explode(F.map_entries(F.map_filter(F.create_map(*[x for name, c in OF_RECORD.items() for x in (F.lit(name), F.col(c))]), lambda k, v: v != ""))).alias("e")).select("e.key", "e.value")
    each = entries.select("bib_file", "entry_ord", F.explode(F.map_filter("fields", lambda k, v: k.isin(*CLEANABLE))).alias("field", "value"))
    by_pool = checks.verifiable(each, held.select(F.col("key").alias("field"), "value")).filter("verifiable").select("bib_file", "entry_ord", "field")
    joined = written(entries.join(found, ["bib_file", "entry_ord"]), "matched")  # read four times below
    of_record = F.create_map(*[x for name, c in OF_RECORD.items() for x in (F.lit(name), F.col("record")[c])])
    own = joined.filter("record IS NOT NULL").select("bib_file", "entry_ord", of_record.alias("own"), F.explode(F.map_filter("fields", lambda k, v: k.isin(*CLEANABLE))).alias("field", "value"))
    proof = by_pool.unionByName(own.filter(same_value(F.col("field"), F.col("value"), F.col("own")[F.col("field")])).select("bib_file", "entry_ord", "field"))
    by_doi = F.col("outcome").isin("doi", "swapped")
    place = F.col("entry_ord").cast("string")
    plan = cleaning_plan(
        joined.select("*", F.col("key").alias("citekey")).withColumn("key", place).withColumn("matched", F.col("record").isNotNull()).withColumn("doi_matched", by_doi),
        proof.select("bib_file", place.alias("key"), "field"),
    )
    verdict = F.when(by_doi, overwritable_year(value("year"), F.col("entry_type"), F.coalesce(F.col("record.year"), F.lit("")), F.col("record.year_basis"), F.col("record.entry_scoped"))).otherwise("unmatched")
    plan = plan.withColumn("key", F.col("citekey")).withColumn("year_verdict", F.when(F.col("tripped"), "tripped").otherwise(verdict))
    change = F.when(F.col("year_verdict") == "yes", F.concat(value("year"), F.lit("->"), F.col("record.year")))
    words = with_marker(value("keywords"), F.col("removed"), change)
    over = F.map_filter(F.create_map(F.lit("keywords"), F.nullif(words, F.lit("")), F.lit("year"), F.when(F.col("year_verdict") == "yes", F.col("record.year"))), lambda k, v: v.isNotNull())
    fields = F.map_concat(F.map_filter("kept", lambda k, v: ~F.map_contains_key(over, k)), over)
    touched = (F.size("removed") > 0) | change.isNotNull()
    confirms = lambda name, form: F.nullif(form(value(name)), F.lit("")) == form(F.col("record")[name])
    identifier = F.when(confirms("doi", keys.doi_key), "doi").when(confirms("publisher", keys.publisher_key) & F.lower("entry_type").isin("book", "incollection", "inbook"), "publisher")
    bound = F.when(identifier == "doi", keys.doi_key(value("doi"))).when(identifier == "publisher", keys.publisher_key(value("publisher")))
    return plan.select(*entries.columns, "outcome", "removed", "tripped", "new_type", F.when(touched, fields).otherwise(F.col("fields")).alias("new_fields"), touched.alias("touched"), "year_verdict", identifier.alias("identifier"), bound.alias("identifier_value"))


def clean_files(texts: DataFrame, pool_files: DataFrame, out: str) -> DataFrame:
    """Bibliography texts (bib_file, file_ord, content) cleaned by API answers (file, content): files to files.

    The plan is written once and cuts the lineage. Ledger and new texts are the
    parts of one version under out, which holds from the moment its pointer is
    moved (sources/versions.py): a job that dies leaves the old version whole.
    Edits replace or take out single fields; all else, and every file without
    an edit, is written byte for byte. Returns the ledger: bib_file, key,
    outcome, matched, abstained, removed, year_verdict, identifier,
    identifier_value, breaker_tripped.
    """
    from citeloom.sources import bibtex, envelopes, versions

    spark = texts.sparkSession
    parsed = written(bibtex.parse(texts), "entries")
    records = written(envelopes.records(envelopes.pool(pool_files)), "records")
    plan = written(cleaned(parsed.filter("key IS NOT NULL").select("bib_file", "entry_ord", "key", "entry_type", "fields"), records), "plan")
    ledger = plan.select(
        "bib_file", "key", "outcome", F.col("outcome").isin("doi", "swapped", "title").alias("matched"), F.col("outcome").isin("scoped_year_disagreement", "pooled_year_conflict").alias("abstained"),
        "removed", "year_verdict", "identifier", "identifier_value", F.col("tripped").alias("breaker_tripped"),
    )
    set_ = F.map_filter("new_fields", lambda k, v: ~F.coalesce(F.try_element_at("fields", k) == v, F.lit(False)))
    gone = F.filter(F.map_keys("fields"), lambda k: ~F.map_contains_key("new_fields", k))
    edits = F.map_concat(set_, F.map_from_arrays(gone, F.transform(gone, lambda k: F.lit(None).cast("string"))))
    touched = plan.filter("touched").select("bib_file", "entry_ord", edits.alias("edits"), "new_type")
    own = parsed.select("bib_file", "entry_ord", "raw", "entry_type", "key", "fields")
    new = bibtex.spliced(own.join(touched, ["bib_file", "entry_ord"]))
    same = own.join(touched, ["bib_file", "entry_ord"], "left_anti").withColumn("refusal", F.lit(None).cast("string"))
    whole = same.unionByName(new)
    folder = versions.commit(spark, out, None, {"ledger": lambda path: ledger.write.json(path), "bib": lambda path: bibtex.write_texts(bibtex.to_text(whole), path)})
    return spark.read.schema(ledger.schema).json(f"{folder}/ledger")
