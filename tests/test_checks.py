"""Checks of texts and files."""

from pyspark.sql import functions as F

from citeloom.operators import checks


def test_files(spark):
    files = spark.createDataFrame([("a", bytearray("é".encode())), ("b", bytearray(b"\xff\xfe"))], "path string, content binary")
    assert {r.path: r.valid for r in checks.valid_utf8(files).collect()} == {"a": True, "b": False}
    lines = spark.createDataFrame([("x.bib", 1, "@article{k1,"), ("x.bib", 2, "author = {M{\\\"u}ller},"), ("x.bib", 3, "title = {plain}")], "bib_file string, line_no int, line string")
    got = checks.latex_escapes(lines).collect()
    assert [(r.key, r.line_no, r.escapes) for r in got] == [("k1", 2, ["{\\\"u}"])]
    manifests = [("a", '{"sep_entries": ["b", "a"], "iep_entries": ["a"]}'), ("b", '{"sep_entries": []}'), ("c", None), ("d", "["), ("e", '{"sep_entries": ["No"]}')]
    rows = checks.slug_manifest(spark.createDataFrame(manifests, "file string, content string")).collect()
    assert {r.file: (r.state, r.slugs) for r in rows} == {"a": ("present", ["a", "b"]), "b": ("empty", None), "c": ("missing", None), "d": ("malformed", None), "e": ("malformed", None)}


def test_verbs_and_names(spark):
    docs = spark.createDataFrame([(1, "Smith (2001) argues that x. Smith (2001) is long. Jones (1999) shows y. Lee 12001 argues.")], "doc_id int, text string")
    cited = spark.createDataFrame([("Smith", "2001", None), ("Jones", "1999", "ABSTRACT"), ("Lee", "2001", "NONE")], "surname string, year string, tier string")
    assert [(r.surname, r.tier, r.sentence) for r in checks.reporting_verbs(docs, cited).collect()] == [("Smith", "unstamped", "Smith (2001) argues that x.")]
    names = spark.createDataFrame([(1, "A", 0), (1, "B", 50), (1, "C", 300)], "doc_id int, surname string, name_pos int")
    years = spark.createDataFrame([(1, "2001", 25), (1, "2002", 55), (1, "2003", 200)], "doc_id int, year string, year_pos int")
    assert sorted((r.year, r.surname) for r in checks.nearest_names(names, years).collect()) == [("2001", "A"), ("2002", "B")]


def test_healing_and_verification(spark):
    current = spark.createDataFrame([("a", "x"), ("b", None), ("c", None)], "key string, abstract string")
    fetched = spark.createDataFrame([("b", "same  text"), ("c", "other")], "key string, abstract string")
    ledger = spark.createDataFrame([("b", "same text"), ("c", "text")], "key string, t string").select("key", F.sha2("t", 256).alias("abstract_sha256"))
    assert {r.key: r.outcome for r in checks.healed(current, fetched, ledger).collect()} == {"a": "kept", "b": "healed", "c": "lost"}
    entries = spark.createDataFrame([("k", "pages", "1--2"), ("k", "volume", "4"), ("k", "volume", "")], "key string, field string, value string")
    pool = spark.createDataFrame([("pages", "1-2"), ("volume", " 4 "), ("number", "5"), ("volume", "")], "field string, value string")
    assert [r.verifiable for r in checks.verifiable(entries, pool).orderBy("field", F.desc("value")).collect()] == [True, True, False]
    flags = spark.range(1).select(checks.importance_flags(F.lit("x, Highly, INCOMPLETE"), F.lit(None)).alias("f")).first().f
    assert (flags.importance, flags.incomplete) == ("High", True)
