"""Reviews from sections."""

import pytest
from pyspark.sql import functions as F

from citeloom.operators import assembly as a


def heads(spark, *rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "review int, title string, date string, subfield string")


def test_front_matter(spark):
    rows = [
        ("Free Will", "2024-02-29", "Philosophy of Mind"), (" Café: a\t", None, None), ("x" * 161, "2023-02-29", "1st"), ("a​b", "2024-1-1", "A" * 61), (None, "2024-01-01\n", None),
        ("It's: so", "2024-01-01", None), ("yes", None, None), ("x: y", None, "Logic/Sets & more"), ("A: b # c", None, None), ("1984", None, ""),
    ]
    got = [(r.block[4:-4], r.warnings) for r in a.front_matters(heads(spark, *rows)).orderBy("review").collect()]
    dropped = lambda name, n: f"invalid {name} dropped from front matter ({n} characters)"
    assert got == [
        ("title: Free Will\ndate: '2024-02-29'\nsubfield: Philosophy of Mind", []), ("title: 'Café: a'", []), ("", [dropped("title", 161), dropped("date", 10), dropped("subfield", 3)]),
        ("", [dropped("title", 3), dropped("date", 8), dropped("subfield", 61)]), ("", [dropped("title", 0), dropped("date", 11)]), ("title: 'It''s: so'\ndate: '2024-01-01'", []), ("title: 'yes'", []),
        ("title: 'x: y'\nsubfield: Logic/Sets & more", []), ("title: 'A: b # c'", []), ("title: '1984'", [dropped("subfield", 0)]),
    ]


@pytest.mark.parametrize("text, rest", [("---\na: b\n---\n\nText", "Text"), ("---\na: b\n---", ""), ("---\nopen", "---\nopen"), ("x\n---\n", "x\n---\n"), ("---\n---\nText", "---\n---\nText"), ("", "")])
def test_without_front_matter(spark, text, rest):
    assert spark.createDataFrame([(text,)], "t string").select(a.without_front_matter(F.col("t"))).first()[0] == rest


def test_files_and_places(spark):
    sections = [(0, "section-10.md", "Ten \n\n"), (0, "Section-2.md", "---\nx: y\n---\nTwo é"), (0, "section-3.md", " \n"), (0, "section-4.md", None), (0, "section-1.md", "One\n\ninner"), (1, "s.md", ""), (7, "s.md", "of no review")]
    placed = a.parts(spark.createDataFrame(sections, "review int, name string, content string"), heads(spark, ("T", None, None), ("U", None, None)))
    whole = {r.review: r.content for r in a.files(placed).collect()}
    assert whole == {0: "---\ntitle: T\n---\n\nOne\n\ninner\n\nTwo é\n\nTen\n", 1: "---\ntitle: U\n---\n"}
    rows = placed.orderBy("review", "part").collect()
    assert [(r.review, r.part, r.name) for r in rows] == [(0, 0, None), (0, 1, "section-1.md"), (0, 2, "Section-2.md"), (0, 3, "section-10.md"), (1, 0, None)]
    assert all(whole[r.review].encode()[r.start : r.start + r.bytes].decode() == r.content for r in rows)
    assert rows[0].warnings == ["empty section: section-3.md", "empty section: section-4.md"] and rows[4].warnings == ["empty section: s.md"]
    assert a.files(a.parts(placed.limit(0).select("review", "name", "content"), heads(spark, ("T", None, None)).limit(0))).count() == 0
