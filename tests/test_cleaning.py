"""Cleaning plans and collisions."""

from pyspark.sql import functions as F

from citeloom.operators import cleaning

ENTRY = "bib_file string, key string, entry_type string, fields map<string,string>, matched boolean, doi_matched boolean"


def test_plan(spark):
    full = {"author": "A", "title": "T", "journal": "J", "year": "1", "doi": "d", "note": "n"}
    rows = [("x", "a", "article", full, True, True), ("x", "b", "article", full, True, False), ("x", "c", "article", full, None, None), ("x", "d", "book", {"title": "T"}, True, None)]
    verified = spark.createDataFrame([("x", "a", "doi"), ("x", "b", "journal")], "bib_file string, key string, field string")
    got = {r.key: r for r in cleaning.cleaning_plan(spark.createDataFrame(rows, ENTRY), verified).collect()}
    assert (got["a"].removed, got["a"].new_type) == (["journal"], "article") and "note" in got["a"].kept
    assert (got["b"].removed, got["b"].new_type) == (["doi"], "article")
    assert (got["c"].removed, got["c"].new_type, got["d"].new_type) == ([], "article", "book")
    many = [("y", str(i), "article", full, True, False) for i in range(6)] + [("y", "z", "misc", {"title": "T"}, True, None)]
    assert all(r.tripped and r.removed == [] and r.kept == r.fields for r in cleaning.cleaning_plan(spark.createDataFrame(many, ENTRY), verified).collect())


def test_markers_are_replaced(spark):
    k = F.lit("a, High, METADATA\\_CLEANED: doi")
    show = lambda *x: spark.range(1).select(cleaning.with_marker(*x).alias("v")).first().v
    none = F.array().cast("array<string>")
    once = show(k, F.array(F.lit("pages")), F.lit("1->2"))
    assert once == "a, High, METADATA_CLEANED: pages, year:1->2" and show(F.lit(once), F.array(F.lit("pages")), F.lit("1->2")) == once
    assert show(k, none, F.lit(None).cast("string")) == "a, High, METADATA\\_CLEANED: doi"


def test_collisions(spark):
    entries = spark.createDataFrame([(1, "Müller", "2001"), (2, "Mueller", "2001"), (3, "Muller", "2001"), (4, "Muller", "2002"), (5, "Smith", "2001")], "entry int, surname string, year string")
    assert {r.entry: r.group for r in cleaning.collision_groups(entries).collect()} == {1: 1, 2: 1, 3: 1}
    flags = "group int, member int, supported boolean, sighted boolean, mentioned boolean, first_supported boolean, first_any boolean, unmatched_letter boolean, rejected_mention boolean, second_only boolean"
    rows = [
        (1, 1, True, False, False, True, True, False, False, False), (1, 2, False, True, False, True, True, False, False, False), (1, 3, False, False, False, True, True, False, False, False),
        (2, 4, False, False, False, True, True, True, False, False), (3, 5, True, False, False, False, False, False, False, True), (3, 6, False, False, True, False, False, False, False, True),
        (4, 7, False, False, False, False, False, False, False, False),
    ]
    got = {r.member: (r.kept, r.reason) for r in cleaning.collision_fate(spark.createDataFrame(rows, flags)).collect()}
    assert got == {1: (True, "first"), 2: (True, "first"), 3: (False, "first"), 4: (True, "ambiguous"), 5: (False, "second"), 6: (True, "second"), 7: (True, "nothing")}


def test_files_to_files(spark, tmp_path):
    import json

    bib = """@comment{stays}

@article{a2001,
  author = {A B}, title = {On {X}},
  journal = {Mind}, volume = {7}, doi = {10.1/A}, year = {2001}, keywords = {High}
}

@article{same, author = "C", title = "Y", journal = {Noûs}, year = 1999}

@book{b, author = {D}, title = {Z}, publisher = {Press}, year = {1990}}
"""
    lookup = {"source": "crossref", "results": [{"title": "On X", "container_title": "MIND", "publisher": "OUP", "year": "2002", "year_basis": "print", "doi": "10.1/a"}]}
    dump = {"source": "s2", "results": [{"title": "Z", "year": "1990", "venue": "V"}, {"title": "Q", "year": "1980"}]}
    texts = spark.createDataFrame([("x.bib", 0, bib), ("empty.bib", 1, "")], "bib_file string, file_ord int, content string")
    files = spark.createDataFrame([("verify_1.json", json.dumps(lookup)), ("s2.json", "log line " + json.dumps(dump)), ("bad.json", "{"), ("none.json", None)], "file string, content string")
    from citeloom.sources import versions

    assert cleaning.clean_files(texts, files, str(tmp_path)).count() == 3
    folder = versions.current(spark, str(tmp_path))
    ledger = {r.key: r for r in spark.read.schema("key string, outcome string, matched boolean, removed array<string>, year_verdict string, identifier string, identifier_value string, breaker_tripped boolean").json(f"{folder}/ledger").collect()}
    a, same, b = ledger["a2001"], ledger["same"], ledger["b"]
    assert (a.outcome, a.removed, a.year_verdict, a.identifier, a.identifier_value) == ("doi", ["volume"], "yes", "doi", "10.1/a")
    assert (same.outcome, same.matched, same.removed, same.identifier) == ("unmatched", False, [], None)
    assert (b.outcome, b.removed, b.identifier, b.breaker_tripped) == ("title", ["publisher"], None, False)
    rows = spark.read.option("wholetext", True).text(f"{folder}/bib").filter("bib_file = 'x.bib'").collect()
    out = "".join(r.value for r in rows)
    assert "@comment{stays}" in out and '@article{same, author = "C", title = "Y", journal = {Noûs}, year = 1999}' in out
    assert "volume" not in out.replace("METADATA_CLEANED: volume", "") and "year = {2002}" in out and "keywords = {High, METADATA_CLEANED: volume, year:2001->2002}" in out
    assert "@misc{b" in out and out.index("a2001") < out.index("@article{same") < out.index("@misc{b")
    assert "keywords = {High, METADATA_CLEANED: volume, year:2001->2002}}" in out and "  author = {A B}, title = {On {X}},  journal" in out  # all else stays as it was


def test_a_file_without_edits_comes_back_byte_for_byte(spark, tmp_path):
    from citeloom.sources import versions

    bib = "\ufeff% head\n\n@comment{a}\n\n\n@article{x, title = {T},\n   year=1999}   \n\n@misc(y, note = \"{q}\" # jan)\n\n"
    texts = spark.createDataFrame([("a b.bib", 0, bib), ("c.bib", 1, bib.rstrip())], "bib_file string, file_ord int, content string")
    cleaning.clean_files(texts, spark.createDataFrame([], "file string, content string"), str(tmp_path))
    back = {r.bib_file: r.value for r in spark.read.text(f"{versions.current(spark, str(tmp_path))}/bib", wholetext=True).collect()}
    assert back == {"a b.bib": bib, "c.bib": bib.rstrip()}
