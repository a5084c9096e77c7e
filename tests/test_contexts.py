"""Contexts of many works in many texts against a search of each work in each text."""

import random
import re

from citeloom.operators import contexts
from citeloom.sources import html

NAMES = ["Frankfurt", "frankfurt", "Ravizza", "O'Connor", "Smith-Jones", "van Inwagen", "King Jr.", "É. Gilson", "Jones"]


def name(author):
    if author is None:
        return ""
    author = author.strip()
    return (author.split(",")[0] if "," in author else (author.split() or [""])[-1]).lower().strip()


def slow(texts, works, width):
    out = []
    for key, text in texts:
        for work, author, year, co in works:
            if not name(author) or not year:
                continue
            seen = {}
            for p in contexts.forms(name(author), year.strip().lower(), name(co) or None):
                for m in p.finditer(text or ""):
                    seen.setdefault(m.start(), m)
            for at, m in seen.items():
                ends = [e.end() for e in re.finditer(r"[.!?]\s+", text[:at])]
                stop = re.search(r"[.!?]\s+", text[m.end() :])
                sentence = text[ends[-1] if ends else 0 : m.end() + stop.end() if stop else m.end() + 200].strip()
                a, b = max(0, at - width), min(len(text), m.end() + width)
                if a > 0 and text.rfind(" ", 0, a) >= 0:
                    a = text.rfind(" ", 0, a) + 1
                if b < len(text) and text.find(" ", b) >= 0:
                    b = text.find(" ", b)
                out.append((key, work, at, m[0], sentence, text[a:b].strip()))
    return sorted(out)


def test_every_work_in_every_text(spark):
    rng = random.Random(6)
    years = ["1971", "1971a", "1998", "forthcoming", "n.d."]
    gaps = [" ", "  ", "\n", ", ", " (", "(", " [", " ( ", ""]
    texts = [(0, None), (1, ""), (2, "Frankfurt"), (3, "1971"), (4, "word" * 50_000 + " Frankfurt (1971)" + " " * 50_000 + "x" * 1000)]
    for i in range(60):
        parts = []
        for _ in range(rng.randint(1, 25)):
            who = rng.choice(NAMES)
            parts.append(rng.choice(["", "", "(", "Mc", "see "]) + who + rng.choice(["", "", f" and {rng.choice(NAMES)}", f" & {rng.choice(NAMES)}", "&" + rng.choice(NAMES)]) + rng.choice(gaps) + rng.choice(years) + rng.choice([")", "]", " )", "", ";"]))
            parts.append(rng.choice([" argues that all is one. ", "! ", "? \n", ", ", " text e.g. more ", "."]))
        texts.append((5 + i, "".join(parts)))
    works = [(1, "Frankfurt, Harry", "1971", None), (2, "Harry Frankfurt", "1971a", "Mark Ravizza"), (3, "van Inwagen, Peter", "1998", "Jones, A."), (4, "O'Connor", " 1971 ", ""), (5, "Jones", "forthcoming", None), (6, "Smith-Jones", "n.d.", "King Jr., M."), (7, "King Jr., M.", "1998", None), (8, None, "1971", None), (9, "Jones", None, "X"), (10, "Frankfurt", "1998", "Frankfurt"), (11, "Gilson", "1971", None), (1, "Frankfurt, Harry", "1971", None)]
    docs = spark.createDataFrame([(*t, "w") for t in texts], "doc long, text string, work string").repartition(3)
    asked = spark.createDataFrame(works, "work int, author string, year string, coauthor string")
    for width in (5, 40):
        got = contexts.citation_contexts(docs, asked, ["doc"], width=width).collect()
        expected = sorted(set(slow(texts, works, width)))
        assert len(expected) > 100 and sorted(map(tuple, got)) == expected


def test_articles_are_asked_by_section(spark):
    page = """<div id="preamble"><p>As Frankfurt (1971) argues that the will has a certain structure of its own.</p></div>
    <div id="main-text"><h2>1. One</h2><p>Nothing. Then (Fischer and Ravizza 1998) came.</p><h2>2. Two</h2><p>None.</p></div>"""
    parts = html.article_parts(spark.createDataFrame([("free-will", page), ("other", "<p>x")], "entry string, html string"))
    works = spark.createDataFrame([("f", "Frankfurt", "1971", None), ("fr", "Fischer, J.", "1998", "Ravizza")], "work string, author string, year string, coauthor string")
    rows = sorted(contexts.citation_query(parts, works, "entry").collect())
    assert [(r.entry, r.section, r.section_title, r.work, r.citation_text) for r in rows] == [
        ("free-will", "1", "One", "fr", "(Fischer and Ravizza 1998)"), ("free-will", "1", "One", "fr", "Fischer and Ravizza 1998"), ("free-will", "preamble", "Preamble", "f", "Frankfurt (1971)"),
    ]
    assert rows[0].sentence == "Then (Fischer and Ravizza 1998) came." and rows[2].claims == ["the will has a certain structure of its own"]
