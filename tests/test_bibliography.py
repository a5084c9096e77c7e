"""Bibliography lines."""

import time

from pyspark.sql import functions as F

from citeloom.operators import bibliography as b


def test_lines(spark):
    cases = [
        ("Smith, A. and Jones, B., 1999, 'On Minds', Oxford: OUP.", ("high", ["Smith, A.", "Jones, B."], "1999", "On Minds", "Oxford: OUP")),
        ("Orwell, G., 1949, 1984, London, Secker.", ("high", ["Orwell, G., 1949"], "1984", "London", "Secker")),
        ("Lee, C., forthcoming, Title, Press.", ("high", ["Lee, C."], "forthcoming", "Title", "Press")),
        ("Plato, 1997 edition", ("low", ["Plato"], "1997", "Plato, 1997 edition", None)),
        ("Kant, I. 1781. Critique", ("unparseable", None, None, None, None)),
        ("See the entry on free will, 1999, x, y.", ("unparseable", None, None, None, None)),
        ("Smith, A., 1999, , Press.", ("unparseable", None, None, None, None)),
        ("no year at all, here, or there.", ("unparseable", None, None, None, None)),
        ("x" * 2001, ("unparseable", None, None, None, None)),
        (None, ("unparseable", None, None, None, None)),
        ("", ("unparseable", None, None, None, None)),
    ]
    df = spark.createDataFrame([(c[0],) for c in cases], "raw string")
    got = [(r.p.confidence, r.p.authors, r.p.year, r.p.title, r.p.publisher) for r in df.select(b.parsed_line(F.col("raw")).alias("p")).collect()]
    assert got == [c[1] for c in cases]


def test_many_commas_take_no_longer(spark):
    df = spark.createDataFrame([(", ".join(["A. Name"] * n),) for n in (10, 22, 40, 200)] * 50, "raw string")
    began = time.perf_counter()
    assert df.select(b.parsed_line(F.col("raw")).alias("p")).filter("p.confidence = 'unparseable'").count() == 200
    assert time.perf_counter() - began < 30


def test_dashes_and_entries(spark):
    lines = spark.createDataFrame([("s", 1, "Smith, A., 1999, Minds and bodies in motion, OUP."), ("s", 2, "–––, 2001, Later minds and words, CUP."), ("t", 1, "Smith, A., 1999, Minds and bodies again, OUP."), ("t", 2, "Smith, A., 1999, Bodies and minds again, OUP.")], "article_id string, line_no int, raw string")
    whole = b.with_carried_authors(lines)
    assert whole.filter("article_id = 's' AND line_no = 2").first().raw == "Smith, A., 2001, Later minds and words, CUP."
    entries = spark.createDataFrame([(1, "Smith", "1999", "Minds and Bodies"), (2, "Smith", "2001", "Later Minds"), (3, "Smi", "1999", "Minds and Bodies")], "entry int, surname string, year string, title string")
    found = b.entry_lines(entries, whole)
    assert sorted((r.entry, r.article_id, r.matches) for r in found.collect()) == [(1, "s", 1), (1, "t", 2), (2, "s", 1)]
    assert sorted((r.entry, r.article_id) for r in b.first_article(found).collect()) == [(1, "s"), (2, "s")]


def test_names_meet_years(spark):
    from citeloom.operators.matching import name_anchor, names_with_years

    names = spark.createDataFrame([("van der Waals",), ("Müller",), ("李",), ("",), (None,), ("-",), ("O'Neill-Smith",)], "s string")
    assert [r.a for r in names.select(name_anchor(F.col("s")).alias("a")).collect()] == ["Waals", "ller", "李", None, None, None, "Smith" if "Smith" > "Neill" else "Neill"]
    texts = spark.createDataFrame([(1, "Müller 1999, van der Waals (1999) and Lee 2001, 1999"), (1, "Lee 2002"), (2, "Leeds 2001; x_Lee 2001"), (5, "Lee 12001"), (3, None), (4, "Lee.2001")], "k int, t string")
    works = spark.createDataFrame([("Müller", "1999"), ("van der Waals", "1999"), ("Lee", "2001"), ("Lee", "2002"), ("", "2001"), (None, "2001"), ("Lee", None)], "surname string, year string")
    got = sorted((r.k, r.surname, r.year) for r in names_with_years(texts, ["k"], "t", works).collect())
    assert got == [(1, "Lee", "2001"), (1, "Lee", "2002"), (1, "Müller", "1999"), (1, "van der Waals", "1999"), (4, "Lee", "2001")]
