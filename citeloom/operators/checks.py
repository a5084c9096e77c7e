"""Checks of texts and files: encodings, LaTeX escapes, manifests, verbs beside weak evidence, nearest names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.operators.matching import names_with_years

#: Forms of verbs that report a position, and forms that credit it with success.
ATTRIBUTION = ("argue", "argues", "argued", "assert", "asserts", "asserted", "claim", "claims", "claimed", "concede", "concedes", "conceded", "contend", "contends", "contended", "defend", "defends", "defended", "deny", "denies", "denied", "endorse", "endorses", "endorsed", "hold", "holds", "maintain", "maintains", "maintained", "objected", "press", "presses", "pressed", "propose", "proposes", "proposed", "reject", "rejects", "rejected", "reply", "replies", "replied", "respond", "responds", "responded")
SUCCESS = ("challenged", "conclude", "concludes", "concluded", "demonstrate", "demonstrates", "demonstrated", "develop", "develops", "developed", "establish", "establishes", "find", "finds", "found", "identify", "identifies", "identified", "occupy", "occupies", "occupied", "prove", "proves", "proved", "show", "shows", "showed", "shown", "trace", "traces", "traced")
#: Tiers under which such a verb is worth a look.
WEAK = ("EXISTENCE", "NONE")
REACH = 60


def valid_utf8(files: DataFrame) -> DataFrame:
    """files (path, content as bytes) with valid."""
    return files.withColumn("valid", F.is_valid_utf8(F.col("content").cast("string")))


def latex_escapes(lines: DataFrame) -> DataFrame:
    """Lines (bib_file, line_no, line) with a LaTeX accent, the entry key they are in, and the plain text."""
    from citeloom.functions.keys import latex_text
    from citeloom.sources.bibtex import HEADER

    w = Window.partitionBy("bib_file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    key = F.last(F.nullif(F.regexp_extract("line", HEADER, 2), F.lit("")), ignorenulls=True).over(w)
    found = lines.withColumn("key", key).withColumn("escapes", F.regexp_extract_all("line", F.lit(r"(\{?\\[\"'`^~]\{?[A-Za-z]\}?\}?|\{?\\c\{[cC]\}\}?|\{?\\ss\}?)"), F.lit(1)))
    return found.filter(F.size("escapes") > 0).select("bib_file", "key", "line_no", "escapes", F.transform("escapes", latex_text).alias("plain"))


def slug_manifest(files: DataFrame) -> DataFrame:
    """file, state (present, empty, missing or malformed), slugs: manifests (file, content) whose slugs are all well formed."""
    v = F.expr("try_parse_json(content)")
    get = lambda k: F.coalesce(F.expr(f"try_variant_get(v, '$.{k}', 'array<string>')"), F.array().cast("array<string>"))
    slugs = F.array_sort(F.array_union(get("sep_entries"), get("iep_entries")))
    good = F.forall(slugs, lambda s: F.coalesce(s.rlike("^[a-z0-9][a-z0-9-]*$"), F.lit(False)))
    shape = F.expr("schema_of_variant(v)").startswith("OBJECT")
    state = F.when(F.col("content").isNull(), "missing").when(~F.coalesce(shape & good, F.lit(False)), "malformed").when(F.size(slugs) == 0, "empty").otherwise("present")
    return files.withColumn("v", v).select("file", state.alias("state"), F.when(state == "present", slugs).alias("slugs"))


def reporting_verbs(docs: DataFrame, cited: DataFrame) -> DataFrame:
    """Sentences that name a weakly evidenced work (surname, year, tier or null) and hold a verb of the lists, each once."""
    verbs = r"(?i)\b(?:" + "|".join(ATTRIBUTION + SUCCESS) + r")\b"
    sentences = docs.select("doc_id", F.posexplode(F.split(F.regexp_replace("text", r"\s+", " "), r"(?<=[.!?])\s")).alias("place", "sentence")).filter(F.col("sentence").rlike(verbs))
    weak = cited.select("surname", "year", "tier").filter(F.col("tier").isNull() | F.col("tier").isin(*WEAK))
    hit = names_with_years(sentences, ["doc_id", "place"], "sentence", weak)
    return hit.select("doc_id", "surname", "year", F.coalesce("tier", F.lit("unstamped")).alias("tier"), "sentence").distinct()


def nearest_names(names: DataFrame, years: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Each year position (doc, year, year_pos) with the nearest name (doc, surname, name_pos) within REACH characters.

    The first name among equally near ones.
    """
    from citeloom.operators.matching import within

    near = within(names, years, doc, "name_pos", "year_pos", REACH)
    best = F.min_by(F.struct("surname", "name_pos"), F.struct(F.abs(F.col("name_pos") - F.col("year_pos")).alias("d"), "name_pos"))
    return near.groupBy(doc, "year", "year_pos").agg(best.alias("b")).select(doc, "year", "year_pos", "b.surname", "b.name_pos")


def healed(current: DataFrame, fetched: DataFrame, ledger: DataFrame) -> DataFrame:
    """key, abstract, outcome: a lost abstract (null in current) comes back only if what was fetched has the ledger's hash."""
    from citeloom.functions.keys import abstract_hash

    both = current.join(fetched.withColumnRenamed("abstract", "new"), "key", "left").join(ledger.select("key", "abstract_sha256"), "key", "left")
    same = F.coalesce(abstract_hash("new") == F.col("abstract_sha256"), F.lit(False)) & F.col("new").isNotNull()
    outcome = F.when(F.col("abstract").isNotNull(), "kept").when(same, "healed").otherwise("lost")
    return both.select("key", F.when(outcome == "healed", F.col("new")).otherwise(F.col("abstract")).alias("abstract"), outcome.alias("outcome"))


def verifiable(entries: DataFrame, pool: DataFrame) -> DataFrame:
    """entries (key, field, value) with verifiable: whether the value stands anywhere in the pool (field, value) under its key."""
    from citeloom.functions import keys

    def canonical(df: DataFrame) -> Column:
        f = F.col("field")
        return F.when(f.isin("journal", "booktitle"), keys.venue_key("value")).when(f == "pages", keys.page_key("value")).when(f == "doi", keys.doi_key("value")).when(f == "publisher", keys.publisher_key("value")).otherwise(F.trim("value"))

    known = pool.select("field", canonical(pool).alias("k")).filter("k != ''").distinct().withColumn("verifiable", F.lit(True))
    own = entries.withColumn("k", canonical(entries))
    return own.join(known, ["field", "k"], "left").select(*entries.columns, F.coalesce("verifiable", F.lit(False)).alias("verifiable"))


def importance_flags(keywords: Column, abstract: Column) -> Column:
    """What an entry's keywords and abstract say: importance, and whether it is incomplete."""
    level = F.when(F.contains(keywords, F.lit("High")), "High").when(F.contains(keywords, F.lit("Medium")), "Medium").otherwise("Low")
    return F.struct(level.alias("importance"), (F.contains(keywords, F.lit("INCOMPLETE")) | (F.length(F.coalesce(abstract, F.lit(""))) <= 10)).alias("incomplete"))
