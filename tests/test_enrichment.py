"""Abstracts from answers: questions, outcomes, edits, files in several runs."""

import hashlib

import pytest
from pyspark.sql import functions as F

from citeloom.operators import enrichment as e
from citeloom.sources import versions

LONG = "a text that is long enough to be taken from a search of an archive"
ANSWERS = "source string, doi string, title string, surname string, abstract string, ord int"
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def test_questions(spark):
    rows = [
        ("openalex", "10.1/a", None, None, "of openalex", 1), ("s2", "https://doi.org/10.1/A", None, None, "second of s2", 3), ("s2", "10.1/a", None, None, "of s2", 2),
        ("s2", "10.1/b", None, None, None, 1), ("core", "10.1/b", "The Whole Title: a part", "x", LONG, 1), ("core", "10.1/c", "Another one", "x", LONG, 1),
        ("core", "", "Title without number", "lee", LONG + " lee", 2), ("core", None, "Title without number", "kim", LONG + " kim", 1), ("core", None, "Too short", "kim", "short", 1), ("web", "10.1/d", "x", "x", LONG, 1),
    ]
    asked = [("10.1/a", "", ""), ("10.1/a", "", ""), ("10.1/b", "the whole title", ""), ("10.1/c", "no such", ""), ("", "Title without number", "lee"), ("", "title without number", ""), ("", "Title without number", "poe"), ("", "Too short", "kim"), ("10.1/d", "x", ""), ("", "", "lee")]
    df = spark.createDataFrame(asked, "doi string, title string, surname string")
    got = {(r.doi, r.title, r.surname): (r.source, r.abstract) for r in e.answered(df, spark.createDataFrame(rows, ANSWERS)).collect()}
    assert got == {
        ("10.1/a", "", ""): ("s2", "of s2"), ("10.1/b", "the whole title", ""): ("core", LONG), ("", "Title without number", "lee"): ("core", LONG + " lee"), ("", "title without number", ""): ("core", LONG + " kim"),
    }


def test_marks_and_names(spark):
    df = spark.createDataFrame([(None,), ("",), ("topic",), ("topic, INCOMPLETE, no-abstract",), ("INCOMPLETE",)], "k string")
    assert [r.m for r in df.select(e.with_marks(F.col("k")).alias("m")).collect()] == ["INCOMPLETE, no-abstract", "INCOMPLETE, no-abstract", "topic, INCOMPLETE, no-abstract", "topic, INCOMPLETE, no-abstract", "INCOMPLETE, no-abstract"]
    assert [r.m for r in df.select(e.without_marks(F.col("k")).alias("m")).collect()] == [None, None, "topic", "topic", None]
    names = spark.createDataFrame([("Smith, A. and B C",), ("Ann von Lee and X",), ("",), (None,)], "a string")
    assert [r.s for r in names.select(e.first_surname(F.col("a")).alias("s")).collect()] == ["smith", "lee", "", ""]


ENTRIES = [
    ("f", 0, "known", "article", {"doi": "10.1/a", "abstract": "an  abstract that stood", "abstract_source": "S2 "}),
    ("f", 1, "mine", "article", {"doi": "10.1/b", "abstract": "typed by hand,\nas it is", "abstract_source": "web"}),
    ("f", 2, "other", "article", {"doi": "10.1/b", "abstract": "typed by hand but not so"}),
    ("f", 3, "new", "article", {"doi": "10.1/b", "title": "x", "abstract": "too short"}),
    ("f", 4, "none", "article", {"doi": "10.1/zz", "keywords": "a, no-abstract"}),
    ("f", 5, "book", "Book", {"title": "Free will and action", "author": "Jo Smith", "keywords": "High, INCOMPLETE"}),
    ("f", 6, "low", "book", {"title": "Free will and action", "author": "Jo Smith", "keywords": "Highly, Low"}),
    ("f", 7, "bare", "misc", {}),
    ("g", 0, "known", "article", {"doi": "10.1/a", "abstract": "an abstract that stood", "abstract_source": "s2"}),
]


def test_plan(spark):
    entries = spark.createDataFrame(ENTRIES, "bib_file string, entry_ord int, key string, entry_type string, fields map<string,string>").withColumn("source", F.lit("clash"))
    answers = spark.createDataFrame([("s2", "10.1/b", "x", "y", "typed by hand, as it is", 1)], ANSWERS)
    ledger = spark.createDataFrame([("f", "known", "s2", sha("an abstract that stood"))], e.LEDGER)
    reviews = spark.createDataFrame([("free-will-action", 1, LONG)], "slug string, ord int, summary_text string")
    got = {(r.bib_file, r.key): (r.outcome, r.abstract_source, r.abstract_sha256, r.edits) for r in e.plan(entries, answers, ledger, reviews).collect()}
    hand = sha("typed by hand, as it is")
    assert got == {
        ("f", "known"): ("attested", None, None, {}), ("g", "known"): ("prefilled_unverified", None, None, {}),
        ("f", "mine"): ("prefilled_attested", "s2", hand, {"abstract_source": "s2"}), ("f", "other"): ("prefilled_unverified", None, None, {}),
        ("f", "new"): ("enriched", "s2", hand, {"abstract": "typed by hand, as it is", "abstract_source": "s2"}), ("f", "none"): ("incomplete", None, None, {"keywords": "a, no-abstract, INCOMPLETE"}),
        ("f", "book"): ("enriched", "ndpr", sha(LONG), {"abstract": LONG, "abstract_source": "ndpr", "keywords": "High"}), ("f", "low"): ("incomplete", None, None, {"keywords": "Highly, Low, INCOMPLETE, no-abstract"}),
        ("f", "bare"): ("incomplete", None, None, {"keywords": "INCOMPLETE, no-abstract"}),
    }
    assert e.plan(entries.limit(0), answers.limit(0), ledger.limit(0)).count() == 0


def test_one_question_for_many_entries(spark):
    entries = spark.range(3000).select(F.lit("f").alias("bib_file"), F.col("id").cast("int").alias("entry_ord"), F.concat(F.lit("k"), "id").alias("key"), F.lit("misc").alias("entry_type"), F.create_map(F.lit("doi"), F.lit("10.1/b")).alias("fields"))
    answers = spark.range(3000).select(F.lit("core").alias("source"), F.lit("10.1/b").alias("doi"), F.concat(F.lit("t"), "id").alias("title"), F.lit("").alias("surname"), F.concat(F.lit(LONG), "id").alias("abstract"), F.col("id").cast("int").alias("ord"))
    got = e.plan(entries, answers, spark.createDataFrame([], e.LEDGER)).groupBy("outcome", "abstract_sha256").count().collect()
    assert [(r.outcome, r["count"]) for r in got] == [("enriched", 3000)] and got[0].abstract_sha256 == sha(LONG + "0")


def test_files_in_runs(spark, tmp_path, monkeypatch):
    out = str(tmp_path / "out")
    good = "% head\n@article{a,\n  title = {T},\n  doi = {10.1/a},\n}\n\n@comment{x}\n@misc{b,\n  doi = {10.1/b}\n}\n@misc{c, doi={10.1/c}}"
    texts = spark.createDataFrame([("01", 0, good), ("broken.bib", 1, "@misc{d, doi={10.1/a}, note = {open\n"), ("no.bib", 2, "no entry at all"), ("none.bib", 3, "")], "bib_file string, file_ord int, content string")
    answers = spark.createDataFrame([("s2", "10.1/a", "T", "", "an abstract of a", 1), ("s2", "10.1/c", "", "", "not { balanced", 1)], ANSWERS)
    counts = {r.bib_file: r for r in e.enrich_files(texts, answers, out).collect()}
    assert {k: r.state for k, r in counts.items()} == {"01": "done", "broken.bib": "broken", "no.bib": "unread", "none.bib": "empty"}
    assert (counts["01"].total, counts["01"].enriched, counts["01"].s2, counts["01"].incomplete, counts["01"].refused, counts["01"].had_abstract) == (3, 1, 1, 1, 1, 0)
    now, ledger = e.current(spark, out)
    content = {r.bib_file: r.content for r in now.collect()}
    assert content["01"] == good.replace("@article{a,", "@article{a,\n  abstract = {an abstract of a},\n  abstract_source = {s2},").replace("@misc{b,", "@misc{b,\n  keywords = {INCOMPLETE, no-abstract},")
    assert content["broken.bib"] == "@misc{d, doi={10.1/a}, note = {open\n" and content["no.bib"] == "no entry at all"
    assert [(r.bib_file, r.key, r.abstract_source, r.abstract_sha256) for r in ledger.collect()] == [("01", "a", "s2", sha("an abstract of a"))]
    # A second run asks only about the others; nothing that it does not know is lost.
    other = spark.createDataFrame([("openalex", "10.1/b", "", "", "an abstract of b", 1)], ANSWERS)
    again = {r.bib_file: r for r in e.enrich_files(now, other, out).collect()}["01"]
    assert (again.attested, again.enriched, again.openalex, again.incomplete) == (1, 1, 1, 1)
    before = e.current(spark, out)
    assert {(r.key, r.abstract_source) for r in before[1].collect()} == {("a", "s2"), ("b", "openalex")}
    # A run that dies before the pointer leaves text and ledger as they were.
    held = {r.bib_file: r.content for r in before[0].collect()}
    monkeypatch.setattr(versions, "_step", lambda name, write: write() if name != "pointer" else (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError):
        e.enrich_files(before[0].filter("bib_file = '01'"), answers, out)
    assert {r.bib_file: r.content for r in e.current(spark, out)[0].collect()} == held
    monkeypatch.undo()
    # An entry that is gone loses its ledger row.
    short = spark.createDataFrame([("01", 0, "@misc{b, doi={10.1/b}, abstract={an abstract of b}, abstract_source={openalex}}")], "bib_file string, file_ord int, content string")
    assert e.enrich_files(short, other, out).first().attested == 1
    assert [(r.key, r.abstract_source) for r in e.current(spark, out)[1].collect()] == [("b", "openalex")]


def test_answers_are_read_twice_at_most(spark):
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = [("s2", "10.1/a", "", "", "of s2", 1), ("openalex", "10.1/b", "", "", "of openalex", 2), ("core", "", "A title", "lee", LONG, 3), ("core", "10.1/c", "C title", "kim", LONG + " c", 4)]
    answers = spark.createDataFrame(rows, ANSWERS).mapInArrow(run, ANSWERS)
    asked = spark.createDataFrame([("10.1/a", "", ""), ("10.1/b", "", ""), ("", "A title", "lee"), ("", "a title", ""), ("10.1/c", "C title", "")], "doi string, title string, surname string")
    assert sorted(r.abstract for r in e.answered(asked, answers).collect()) == sorted(["of s2", "of openalex", LONG, LONG, LONG + " c"])
    assert seen.value <= 2 * len(rows)


def test_characters_of_the_files(spark):
    from citeloom.plans.tables import bib_safe

    df = spark.createDataFrame([(None,), ("",), ("plain é",), ('a{b}c@d"e{{}}',), ("}",), ('"',), ("@",)], "t string")
    assert all(r.a == r.b for r in df.select(bib_safe(F.col("t")).alias("a"), F.translate(F.coalesce("t", F.lit("")), '{}@"', "()a'").alias("b")).collect())
