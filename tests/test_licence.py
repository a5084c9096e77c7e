"""Evidence tiers: a value that changed loses what was attested for another."""

from __future__ import annotations

import hashlib

from citeloom.operators import licence

SHA = hashlib.sha256(b"an abstract").hexdigest()
CONTEXT = hashlib.sha256(b"a passage").hexdigest()
NO = dict.fromkeys(["abstract_source", "abstract_sha256", "context_field", "context_sha256", "web_passed", "web_url", "api_matched", "breaker_tripped", "identifier", "identifier_value"])


def tiers(spark, rows):
    """rows: entry_type, fields, attestation (as a dict, or None)."""
    data = [(i, kind, fields, None if a is None else {**NO, **a}) for i, (kind, fields, a) in enumerate(rows)]
    entries = spark.createDataFrame([d[:3] for d in data], "key int, entry_type string, fields map<string,string>")
    attested = spark.createDataFrame([(d[0], d[3]) for d in data if d[3] is not None], f"key int, attestation struct<{licence.ATTESTATION.replace(' string', ':string').replace(' boolean', ':boolean')}>")
    return [r.tier for r in licence.stamped(entries, attested, ["key"]).orderBy("key").collect()]


def test_licences(spark):
    abstract = {"abstract_source": " S2", "abstract_sha256": SHA}
    doi = {"api_matched": True, "identifier": "doi", "identifier_value": "10.1/x"}
    press = {"api_matched": True, "identifier": "publisher", "identifier_value": "press"}
    web = {"web_passed": True, "web_url": "https://a.org/x"}
    rows = [
        ("article", {"abstract": "an \\ abstract ", "abstract_source": "s2"}, abstract),  # escapes and spaces do not count
        ("article", {"abstract": "another", "abstract_source": "s2"}, {**abstract, **doi}),
        ("article", {"abstract": "an abstract", "abstract_source": "core", "doi": "https://doi.org/10.1/X"}, {**abstract, **doi}),
        ("article", {"abstract": "an abstract", "abstract_source": "web"}, {"abstract_source": "web", "abstract_sha256": SHA}),
        ("article", {"iep_context": "a passage"}, {"context_field": "iep_context", "context_sha256": CONTEXT}),
        ("article", {"sep_context": "a passage"}, {"context_field": "iep_context", "context_sha256": CONTEXT}),
        ("misc", {"url": "https://A.org:443/x/"}, web),
        ("misc", {"url": "https://a.org/y"}, web),
        ("misc", {"url": "https://plato.stanford.edu/x"}, {"web_passed": True, "web_url": "https://plato.stanford.edu/x"}),
        ("article", {"doi": "10.1/x"}, {**doi, "breaker_tripped": True}),
        ("InBook", {"publisher": " Press"}, press),
        ("article", {"publisher": "Press"}, press),
        ("article", {}, {"api_matched": True, "identifier": "doi", "identifier_value": ""}),
        ("article", {"doi": "10.1/x"}, None),
        ("article", None, doi),
    ]
    assert tiers(spark, rows) == ["ABSTRACT", "NONE", "EXISTENCE", "NONE", "CONTEXT", "NONE", "WEB", "NONE", "NONE", "NONE", "EXISTENCE", "NONE", "NONE", "NONE", "NONE"]


def test_a_merge_cannot_launder(spark):
    attestation = f"struct<{licence.ATTESTATION.replace(' string', ':string').replace(' boolean', ':boolean')}>"
    survivors = spark.createDataFrame([("a", "article", {"abstract": "an abstract", "abstract_source": "s2", "doi": "10.1/x"}), ("b", "article", {"doi": "10.2/y"}), ("c", "article", {})], "key string, entry_type string, fields map<string,string>")
    lineage = spark.createDataFrame([("a", "a2"), ("a", "a3"), ("b", "b2"), ("a", "a2")], "key string, member string")
    told = [
        ("a", {**NO, "abstract_source": "s2", "abstract_sha256": "of another text"}),
        ("a3", {**NO, "abstract_source": "s2", "abstract_sha256": SHA}),  # the text came from a3, by whatever chain
        ("b2", {**NO, "api_matched": True, "identifier": "doi", "identifier_value": "10.9/z"}),
    ]
    found = licence.restamped(survivors, lineage, spark.createDataFrame(told, f"member string, attestation {attestation}")).collect()
    assert {r.key: r.tier for r in found} == {"a": "ABSTRACT", "b": "NONE", "c": "NONE"} and len(found) == 3
