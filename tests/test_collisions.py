"""Groups of works with one author and year, decided by the prose alone."""

from citeloom.operators import collisions

ENTRY = "doc_id int, entry string, surname string, given string, second string, n_authors int, year string, letter string, title string, doi string"
ONE, TWO, MANY = ("m1", "Muldoon", "Ryan", None, 1), ("m2", "Muldoon", "Ryan", "Gordon", 2), ("m3", "Muldoon", "Ann", "Li", 3)


def case(doc, prose, works, kept, reason):
    rows = [(doc, f"{doc}-{w[0]}", *w[1:5], "2023", w[5] if len(w) > 5 else None, w[6] if len(w) > 6 else f"Title {w[0]}", w[7] if len(w) > 7 else None) for w in works]
    return (doc, prose), rows, {f"{doc}-{w[0]}": (w[0] in kept, reason) for w in works}


A, B = ("a", "Menary", "R.", None, 1, "a"), ("b", "Menary", "R.", None, 1, "b")
CASES = [
    ("Muldoon (2023) argues.", [ONE, TWO, MANY], {"m1"}, "first"),
    ("Muldoon and Gordon (2023) and Muldoon et al. (2023).", [ONE, TWO, MANY], {"m2", "m3"}, "first"),
    ("Muldoon and Nobody (2023).", [ONE, TWO], {"m1", "m2"}, "ambiguous"),
    ("Nothing here.", [ONE, TWO], {"m1", "m2"}, "nothing"),
    ("Bloggs and Muldoon (2023).", [ONE, TWO, ("x", "Bloggs", "J.", "Muldoon", 2)], None, "second"),
    ("Bloggs and Muldoon (2023).", [ONE, TWO], {"m1", "m2"}, "nothing"),
    ("Menary (2023a) says.", [A, B], {"a"}, "first"),
    ("Menary (2023a) says; see 2023b there.", [A, B], {"a", "b"}, "first"),
    ("Menary (2023a, b) says.", [A, B], {"a", "b"}, "first"),
    ("Menary (2023c) says.", [A, B], {"a", "b"}, "ambiguous"),
    ("Menary (2023a) says. See Clark, Menary (2023), and Sutton.", [A, B], {"a", "b"}, "ambiguous"),
    ("Ryan Muldoon (2023).", [ONE, ("o", "Muldoon", "Zed", None, 1)], {"m1"}, "first"),
    ("As Muldoon (2023) says.", [ONE, ("o", "Muldoon", "Zed", None, 1)], {"m1", "o"}, "first"),
    ('Muldoon (2023), and the "A Theory of Many Things" too.', [ONE, (*TWO, None, "A {Theory} of Many Things")], {"m1", "m2"}, "first"),
    ('Muldoon (2023) is *not*a theory of many things*however* here.', [ONE, (*TWO, None, "A Theory of Many Things")], {"m1"}, "first"),
    ("Menary (2023a) says.", [(*A, "T", "10.1/x"), (*B, "T", "https://doi.org/10.1/X")], {"a", "b"}, "first"),
    (None, [ONE, TWO], {"m1", "m2"}, "nothing"),
    ("Mueller (2023).", [("u", "Müller", "A", None, 1), ("v", "Muller", "B", "C", 2), ("w", "Mueller", "B", "C", 3)], {"u"}, "first"),
]


def test_cases(spark):
    texts, entries, expected = [], [], {}
    for i, (prose, works, kept, reason) in enumerate(CASES):
        text, rows, out = case(i, prose, works, kept or set(), reason)
        texts.append(text)
        entries += rows
        expected |= {k: v for k, v in out.items() if not k.endswith("-x")}
    docs = spark.createDataFrame(texts, "doc_id int, text string").repartition(3)
    got = {r.member: (r.kept, r.reason) for r in collisions.resolved(docs, spark.createDataFrame(entries + entries[:2], ENTRY).repartition(3)).collect()}
    wrong = {k: (got.get(k), v) for k, v in expected.items() if got.get(k) != v}
    assert not wrong and set(got) == set(expected), wrong
    assert collisions.resolved(docs.limit(0), spark.createDataFrame(entries, ENTRY)).filter("NOT kept").count() == 0


def test_title_spans(spark):
    texts = ['The "A Theory of Justice" and “On What Matters Now”, *Reasons and Persons Again* and " padded title of four " and x"abutted title of four words" or "too\nlong over lines".', None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    assert sorted(r.title for r in collisions.title_spans(docs).collect()) == ["a theory of justice", "on what matters now", "reasons and persons again"]
