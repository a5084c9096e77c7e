"""Which evidence tier an entry may carry: attestations hold for values, not for entries.

An attestation (a struct, see ATTESTATION) says what ledgers and gates vouched
for. It licenses a tier only while the entry still has the value it was given
for, so that a merge or a later edit cannot carry a tier to another value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.functions import keys
from citeloom.operators.evidence import TIERS, tier, tier_rank

#: Sources whose abstracts can be attested, and entry types that their publisher identifies.
ATTESTED_SOURCES = ("s2", "openalex", "core", "ndpr")
CONTAINERS = ("book", "incollection", "inbook")
#: What is vouched for an entry.
ATTESTATION = (
    "abstract_source string, abstract_sha256 string, context_field string, context_sha256 string, web_passed boolean, web_url string, "
    "api_matched boolean, breaker_tripped boolean, identifier string, identifier_value string"
)


def field(fields: Column, name: str) -> Column:
    """A field's value, empty if it lacks."""
    return F.coalesce(F.try_element_at(fields, F.lit(name)), F.lit(""))


def bound_values(entry_type: Column, fields: Column) -> Column:
    """All of an entry that attestations are compared with, as a narrow struct without texts."""
    hashed = lambda name: F.when(field(fields, name) != "", keys.abstract_hash(field(fields, name)))
    return F.struct(
        publisher_key_of(entry_type, fields).alias("publisher"),
        F.nullif(keys.doi_key(field(fields, "doi")), F.lit("")).alias("doi"),
        hashed("abstract").alias("abstract"),
        F.lower(F.trim(field(fields, "abstract_source"))).alias("source"),
        hashed("sep_context").alias("sep_context"),
        hashed("iep_context").alias("iep_context"),
        # The address is found once: its key reads it so often that the compiled code would pass the JVM's limit of a method.
        keys.let(keys.first_url(field(fields, "url"), field(fields, "howpublished")), lambda u: F.nullif(keys.url_key(u), F.lit(""))).alias("url"),
    )


def publisher_key_of(entry_type: Column, fields: Column) -> Column:
    """The publisher of a book or a part of one; null for other types."""
    return F.when(F.lower(entry_type).isin(*CONTAINERS), F.nullif(keys.publisher_key(field(fields, "publisher")), F.lit("")))


def licensed_tier(values: Column, attestation: Column) -> Column:
    """The best tier that an attestation allows for bound_values; NONE where it is null.

    ABSTRACT: the source is of the list and the ledger's, and the hash is the
    ledger's. CONTEXT: the hash of the named context field is. WEB: the address
    is the one whose gate was passed, and of no excluded host. EXISTENCE: a
    producer matched, no breaker tripped, and the identifier has the value that
    was confirmed.
    """
    a, v = attestation, values
    abstract = v["source"].isin(*ATTESTED_SOURCES) & (v["source"] == F.lower(F.trim(a["abstract_source"]))) & (v["abstract"] == a["abstract_sha256"])
    context = ((a["context_field"] == "sep_context") & (v["sep_context"] == a["context_sha256"])) | ((a["context_field"] == "iep_context") & (v["iep_context"] == a["context_sha256"]))
    web = a["web_passed"] & (v["url"] == a["web_url"]) & keys.excluded_host(keys.url_host(a["web_url"])).isNull()
    identified = ((a["identifier"] == "doi") & (v["doi"] == a["identifier_value"])) | ((a["identifier"] == "publisher") & (v["publisher"] == a["identifier_value"]))
    return tier(abstract, context, web, a["api_matched"] & ~F.coalesce(a["breaker_tripped"], F.lit(False)) & identified)


def stamped(entries: DataFrame, attestations: DataFrame, key: list[str]) -> DataFrame:
    """entries (key, entry_type, fields) with tier by their own attestation (key, attestation); without one NONE."""
    joined = entries.join(attestations.select(*key, F.col("attestation").alias("__a")), key, "left")
    return joined.withColumn("tier", licensed_tier(bound_values(F.col("entry_type"), F.col("fields")), F.col("__a"))).drop("__a")


def restamped(survivors: DataFrame, lineage: DataFrame, attestations: DataFrame) -> DataFrame:
    """survivors (key, entry_type, fields) with tier: the best that any entry they absorbed licenses for the merged values.

    lineage: key, member (a survivor is a member of itself, listed or not);
    attestations: member, attestation. Only hashes and keys of the survivors
    meet their members, and the maximum is taken before the last join, so that
    a survivor of very many members costs neither texts nor one task.
    """
    values = survivors.select("key", bound_values(F.col("entry_type"), F.col("fields")).alias("__v"))
    members = lineage.select("key", "member").unionByName(survivors.select("key", F.col("key").alias("member")))
    rank = tier_rank(licensed_tier(F.col("__v"), F.col("attestation")))
    best = members.join(attestations.select("member", "attestation"), "member").join(values, "key").groupBy("key").agg(F.max(rank).alias("__r"))
    named = F.element_at(F.array(*map(F.lit, TIERS)), (F.coalesce("__r", F.lit(0)) + 1).cast("int"))
    return survivors.join(best, "key", "left").withColumn("tier", named).drop("__r")
