"""Decision tables of the operators, branch by branch."""

import random

import pytest
from pyspark.sql import functions as F

from citeloom.operators import components, dedupe, evidence, matching, prose, search
from citeloom.streaming import freshness


def test_components_with_hub_chain_and_odd_edges(spark):
    edges = [(0, i) for i in range(1, 50)] + [(100 + i, 101 + i) for i in range(40)] + [(7, 7), (None, 3), (200, 201), (201, 200), (200, 201)]
    got = {r.node: r.label for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(50)) and all(got[100 + i] == 100 for i in range(41)) and got[201] == 200
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


ENTRY = "doi string, title string, year string, entry int"
RECORD = "doi string, title string, year string, scoped boolean, ord int, filled array<string>, record string"


@pytest.mark.parametrize(
    ("records", "want"),
    [
        ([("d", "t", "2001", True, 1, ["a"], "r1"), ("d", "t", "2002", True, 2, ["a"], "r2")], ("scoped_year_disagreement", None)),
        ([("d", "t", "", True, 1, ["a"], "r1"), ("d", "t", "2002", True, 2, ["a", "b"], "r2")], ("swapped", "r2")),
        ([("d", "t", "", True, 1, ["a", "c"], "r1"), ("d", "t", "2002", True, 2, ["a", "b"], "r2")], ("doi", "r1")),
        ([("d", "t", "2001", False, 1, [], "r1"), ("d", "t", "2002", False, 2, [], "r2")], ("pooled_year_conflict", None)),
        ([("d", "t", "2001", False, 1, [], "r1"), ("d", "t", "2005", True, 2, [], "r2")], ("doi", "r2")),
        ([("e", "t", "2001", False, 3, [], "r1"), ("f", "t", "2001", False, 2, [], "r2")], ("title", "r2")),
        ([("e", "t", "1999", False, 1, [], "r1"), ("", "", "", False, 2, [], "r2")], ("unmatched", None)),
    ],
)
def test_resolution(spark, records, want):
    got = matching.resolve(spark.createDataFrame([("d", "t", "2001", 1)], ENTRY), spark.createDataFrame(records, RECORD)).first()
    assert (got.outcome, got.record) == want


def test_breaker_at_its_bounds(spark):
    rows = [("a", i < 6) for i in range(20)] + [("b", i < 7) for i in range(20)] + [("c", i < 4) for i in range(5)]
    plan = spark.createDataFrame(rows, "bib string, stripped boolean")
    got = {r.bib: r.tripped for r in evidence.with_breaker(plan, "stripped", ["bib"]).collect()}
    assert got == {"a": False, "b": True, "c": False}


def test_gate_reasons_in_order(spark):
    text = "The careful argument about free will continues for many pages. " * 5
    span = "careful argument about free will continues"
    rows = [
        (True, None, None, 200, None, "t", ["x"], "no_capture"),
        (True, "boom", None, 200, None, "t", ["x"], "fetch_error"),
        (None, None, None, 200, text, "t", ["x"], "url_mismatch"),
        (True, None, "script", None, text, "t", ["x"], "bad_status"),
        (True, None, None, 200, "Just a moment" + text, "t", ["x"], "boilerplate"),
        (True, None, "agent", None, "short", "t", ["x"], "thin"),
        (True, None, None, 200, text, "zebra crossing", [span], "title_mismatch"),
        (True, None, None, 200, text, "free", [], "span_malformed"),
        (True, None, None, 200, text, "argument", ["too short"], "span_malformed"),
        (True, None, None, 200, text, "argument", ["one two three four five six seven"], "span_unverified"),
        (True, None, None, 204, text, "argument", [span.upper()], "ok"),
    ]
    df = spark.createDataFrame(rows, "bound boolean, error string, prov string, status int, text string, title string, spans array<string>, want string")
    reason = evidence.capture_gate(*[F.col(c) for c in ("bound", "error", "prov", "status", "text")], F.lit(None).cast("string"), F.col("title"), F.col("spans"))
    assert [(r.want, r.got) for r in df.select("want", reason.alias("got")).collect() if r.want != r.got] == []


def test_unknown_never_flags_nor_holds(spark):
    df = spark.createDataFrame([(True, False, False, 3, 10), (True, None, False, 3, None), (None, False, False, 3, -1), (True, False, False, None, 604_800)], "r boolean, c boolean, d boolean, h int, age int")
    got = df.select(evidence.flagged(F.col("r"), F.col("c"), F.col("d"), F.col("h")).alias("f"), evidence.fresh(F.col("age")).alias("k")).collect()
    assert [(r.f, r.k) for r in got] == [(True, True), (False, False), (False, False), (False, False)]


def test_captures_and_ledgers(spark):
    old = spark.createDataFrame([("a", "good", None), ("b", None, "err"), ("c", "x", None)], "k string, text string, error string")
    new = spark.createDataFrame([("a", None, "down"), ("b", "now", None), ("d", None, "err")], "k string, text string, error string")
    got = {r.k: (r.text, r.error) for r in evidence.keep_good(old, new, "k", "error").collect()}
    assert got == {"a": ("good", None), "b": ("now", None), "c": ("x", None), "d": (None, "err")}
    current = spark.createDataFrame([("a",), ("d",)], "k string")
    assert {r.k: r.error for r in evidence.ledger_merge(old, new, current, "k").collect()} == {"a": "down", "d": "err"}


def test_fold_in_order(spark):
    schema = "ord int, key string, fields map<string,string>, keywords string, removed array<string>, lineage array<string>, g string"
    rows = [
        (2, "b", {"title": "T", "abstract": "long enough abstract", "doi": "10.1"}, "x, Low", [], ["b"], "g"),
        (1, "a", {"title": "T", "journal": "J", "doi": "10.9"}, "x, High", ["doi"], ["a"], "g"),
        (3, "c", {"title": "U"}, "y", [], ["c"], None),
    ]
    got = {r.key: r for r in dedupe.fold_groups(spark.createDataFrame(rows, schema), "g").collect()}
    b = got["b"]
    assert set(got) == {"b", "c"} and b.ord == 1 and b.keywords == "x, High" and sorted(b.lineage) == ["a", "b"]
    assert b.fields == {"title": "T", "abstract": "long enough abstract", "journal": "J"}


def test_fold_of_aggregates_equals_the_fold_in_order(spark):
    rng = random.Random(5)
    rows = []
    for i in range(600):
        fields = {k: rng.choice(["", None, f"{k}{i}"]) for k in rng.sample(["abstract", "journal", "pages", "doi", "note", "title"], 4)}
        if fields.get("abstract"):
            fields["abstract"] = rng.choice(["short", f"an abstract {i}"])
        fields = {k: v for k, v in fields.items() if v or k == "journal" and v == ""}
        words = rng.choice([None, "", "a", "Low, a", "a, Medium", "High", "Highly"])
        rows.append((i, f"k{i}", fields, words, rng.choice([[], [], [], ["pages"], ["doi", "pages"]]), [f"k{i}"], f"g{rng.randrange(90)}"))
    entries = spark.createDataFrame(rows, "ord int, key string, fields map<string,string>, keywords string, removed array<string>, lineage array<string>, g string")
    columns = entries.columns[:-1]
    listed = entries.groupBy("g").agg(F.collect_list(F.struct(*columns)).alias("all"))
    ordered = listed.withColumn("all", F.array_sort("all", lambda a, b: a["ord"] - b["ord"]))
    folded = ordered.select(F.aggregate(F.slice("all", F.lit(2), F.greatest(F.size("all") - 1, F.lit(1))), F.element_at("all", 1), dedupe.merge_pair).alias("f"), F.element_at("all", 1).alias("one"), F.size("all").alias("n"))
    expected = folded.select(F.when(F.col("n") == 1, F.col("one")).otherwise(F.col("f")).alias("e")).select("e.*").collect()
    found = dedupe.fold_groups(entries, "g")
    plain = lambda r: (r.ord, r.key, {k: v for k, v in r.fields.items() if v}, r.keywords, sorted(r.removed), list(r.lineage))
    assert sorted(map(plain, found.collect()), key=str) == sorted(map(plain, expected), key=str)
    members = dedupe.fold_lineage(entries, "g", found).collect()
    assert sorted((r.key, r.member) for r in members) == sorted((r.key, m) for r in expected for m in r.lineage)


def test_cascade_clusters_and_letters(spark):
    rows = spark.createDataFrame([(1, "x", "p"), (2, "x", "q"), (3, "", "q"), (4, None, None), (5, "z", "p")], "id int, k1 string, k2 string")
    # 3 meets 1 by the second key of 2, which 1 has absorbed.
    assert {r.id: (r.survivor, r.passes) for r in dedupe.cascade(rows, ["k1", "k2"], "id").collect()} == {1: (1, 0), 2: (1, 1), 3: (1, 1), 4: (4, 0), 5: (1, 1)}
    bridge = spark.createDataFrame([(1, "x", "p"), (2, "x", "q"), (3, "y", "r"), (4, "y", "q"), (5, "z", "r")], "id int, k1 string, k2 string")
    assert {r.id: r.survivor for r in dedupe.cascade(bridge, ["k1", "k2"], "id").collect()} == dict.fromkeys(range(1, 6), 1)
    works = spark.createDataFrame([(1, "d1", "t"), (2, "", "t"), (3, "d1", "u"), (4, "d2", "v"), (5, "d3", "v"), (6, "", "v")], "id int, doi string, title string")
    got = {r.id: (r.cluster, r.tainted) for r in dedupe.work_clusters(works).collect()}
    assert got == {1: (1, False), 2: (1, False), 3: (1, False), 4: (4, False), 5: (5, False), 6: (6, True)}
    many = spark.createDataFrame([("a", i, False) for i in range(27)] + [("b", i, False) for i in range(2)] + [("c", 0, False), ("d", 0, True), ("d", 1, False)], "g string, i int, bad boolean")
    letters = {(r.g, r.i): r.letter for r in dedupe.letters(many, ["g"], ["i"], "bad").collect()}
    assert letters["a", 0] is None and (letters["b", 0], letters["b", 1]) == ("a", "b") and letters["c", 0] is None and letters["d", 1] is None


def test_work_clusters_are_components(spark):
    chain = [(1, "", "B"), (2, "X", "A"), (3, "X", "B")]
    works = [*chain, (4, "", "A"), (11, "P", "c"), (12, "P", "d"), (13, "Q", "d"), (14, "", "d"), (15, "Q", "e"), (16, "", "e"), (20, "", ""), (21, "", "")]
    expected = {1: (1, False), 2: (1, False), 3: (1, False), 4: (1, False), 11: (11, False), 12: (11, False), 13: (13, False), 14: (14, True), 15: (13, False), 16: (13, False), 20: (20, False), 21: (21, False)}
    for rows in (works, works[::-1]):
        got = dedupe.work_clusters(spark.createDataFrame(rows, "id int, doi string, title string")).collect()
        assert {r.id: (r.cluster, r.tainted) for r in got} == expected and len(got) == len(works)


def test_range_join_equals_all_pairs(spark):
    a = spark.createDataFrame([(i % 2, p, p) for i, p in enumerate([0, 5, 59, 60, 61, 119, 300, -3])], "g int, x long, a long")
    b = spark.createDataFrame([(i % 2, p, p) for i, p in enumerate([0, 60, 120, 121, 240, -60, 3])], "g int, y long, b long")
    got = sorted((r.a, r.b) for r in matching.within(a, b, "g", "x", "y", 60).collect())
    assert got == sorted((r.a, s.b) for r in a.collect() for s in b.collect() if r.g == s.g and abs(r.x - s.y) <= 60)


def test_slug_scores(spark):
    df = spark.createDataFrame([("free will and action", "free-will-action", ""), ("mind", "mind", ""), ("mind", "smith-mind", "Smith"), ("free will", "other-book", "")], "t string, s string, a string")
    assert [r.v for r in df.select(matching.slug_score(F.col("t"), F.col("s"), F.col("a")).alias("v")).collect()] == [1.0, 0.0, 0.65, 0.0]


def test_years_that_may_be_rewritten(spark):
    rows = [("2001", "article", "2003", "print", True, "yes"), ("2001", "book", "2003", "print", True, "book-year-moved-later"), ("2001", "book", "1999", "print", True, "yes"), ("2001", "article", "2003", "created", True, "no-version-of-record-date"), ("2001", "article", "2003", "print", None, "unscoped"), ("2001", "article", "2001", "print", True, "no-change"), ("n.d.", "book", "1999", "print", True, "book-year-direction-unknown"), ("2001", "article", "-5", "print", True, "no-change")]
    df = spark.createDataFrame(rows, "y string, t string, r string, b string, s boolean, want string")
    got = df.select("want", evidence.overwritable_year(*[F.col(c) for c in "ytrbs"]).alias("got")).collect()
    assert [r for r in got if r.want != r.got] == []


def test_prose(spark):
    text = "# A\n## Introduction\nx\n## First\n### Sub\n```\n## not\n```\n### More\n## Second\n### Sub\n## References\nold"
    docs = spark.createDataFrame([(1, text)], "doc_id int, text string")
    numbers = [r.number for r in prose.renumbered(prose.text_lines(docs)).orderBy("line_no").collect() if r.number]
    assert numbers == ["1", "1.1", "1.2", "2", "2.1"]
    refs = spark.createDataFrame([(1, "Zed", "2001", 1, "Z."), (1, "abel", "2002", 2, "A.")], "doc_id int, surname string, year string, ord int, text string")
    out = prose.spliced_references(docs, refs).first().text
    assert out.endswith("## References\n\nA.\n\nZ.\n") and "old" not in out
    cited = spark.createDataFrame([(1, "Müller and Li (2001a) and Adams et al. 1999; see Kant (1781).")], "doc_id int, text string")
    got = {(r.surname, r.second, r.form, r.year, r.letter) for r in prose.citations(cited).collect()}
    assert got == {("Müller", "Li", "pair", "2001", "a"), ("Adams", None, "etal", "1999", None), ("Kant", None, "solo", "1781", None)}
    known = spark.createDataFrame([("Mueller", "2001"), ("Adams", "2000")], "surname string, year string")
    assert {r.surname for r in prose.unresolved(prose.citations(cited), known).collect()} == {"Adams", "Kant"}
    people = F.array(*[F.struct(F.lit(f"F{i}").alias("family"), F.lit(f"G{i}").alias("given")) for i in range(11)])
    no = F.lit(None).cast("string")
    show = lambda n: spark.range(1).select(prose.reference_text(F.slice(people, 1, n), F.lit("2001"), F.lit("T."), F.lit("J"), F.lit("4"), no).alias("r")).first().r
    assert show(1) == "F0, G0. 2001. “T.” J 4." and show(2) == "F0, G0, and G1 F1. 2001. “T.” J 4." and show(11).startswith("F0, G0, G1 F1, G2 F2") and "et al" in show(11)
    words = spark.createDataFrame([("a, EVIDENCE-WEB, High",)], "k string")
    once = words.select(prose.without_tiers(F.col("k")).alias("k"))
    assert once.first().k == "a, High" and once.select(prose.without_tiers(F.col("k")).alias("k")).first().k == "a, High"
    said = spark.createDataFrame([("He argues that the mind is not what the brain does. She claims x.",)], "t string")
    assert said.select(prose.claims(F.col("t")).alias("c")).first().c == ["the mind is not what the brain does"]


CITED = [
    ("Menary (2006, 2010, 2013) and Wiens (2015a; 2015b)", [("Menary", None, "2006", None, False), ("Menary", None, "2010", None, True), ("Menary", None, "2013", None, True), ("Wiens", None, "2015", "a", False), ("Wiens", None, "2015", "b", True)], []),
    ("Menary (2010a, b) said", [("Menary", None, "2010", "a", False), ("Menary", None, "2010", "b", True)], []),
    ("Menary (2010), 2011 saw; Smith 2010a, a view", [("Menary", None, "2010", None, False), ("Smith", None, "2010", "a", False)], []),
    ("Moore's (1903) and Smith and de Sousa's (1990)", [("Moore", None, "1903", None, False), ("Smith", "de Sousa", "1990", None, False)], []),
    ("However, Clark and Menary (2010)", [("Clark", "Menary", "2010", None, False)], []),
    ("Thus, Menary (2010)", [("Menary", None, "2010", None, False)], []),
    ("See Clark, Menary (2010, 2011b), and Sutton", [], [("Clark", "2010"), ("Menary", "2010")]),
    ("Clark & Menary (2010)", [], [("Clark", "2010"), ("Menary", "2010")]),
    ("Muldoon, Wu, and Li (2023)", [], [("Muldoon", "2023"), ("Wu", "2023"), ("Li", "2023")]),
    ("Clark and Menary et al. (2010)", [], [("Clark", "2010"), ("Menary", "2010")]),
    ("in the 1990s, Ayer 12345 and A 1599", [], []),
    ("", [], []),
    (None, [], []),
]


def test_citations_in_lists(spark):
    docs = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CITED)], "doc_id int, text string")
    found, left = prose.citations(docs).collect(), prose.rejected_mentions(docs).collect()
    for i, (text, expected, rejected) in enumerate(CITED):
        assert sorted(((r.surname, r.second, r.year, r.letter, r.continuation) for r in found if r.doc_id == i), key=str) == sorted(expected, key=str), text
        assert sorted((r.surname, r.year) for r in left if r.doc_id == i) == sorted(rejected), text


def test_conflicts_and_overlap(spark):
    rows = spark.createDataFrame([("d", "1", "x"), ("d", "2", "y"), ("d", "2", "x"), ("e", "1", "x"), ("e", "", "y")], "k string, v string, s string")
    assert {(r.k, r.v, tuple(r.sources)) for r in matching.conflicts(rows, "k", "v", "s").collect()} == {("d", "1", ("x",)), ("d", "2", ("x", "y"))}
    items = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["a"])], "item int, tokens array<string>")
    targets = spark.createDataFrame([(8, ["a", "b"]), (7, ["b", "a", "z"]), (9, ["c"])], "target int, tokens array<string>")
    assert [(r.item, r.target) for r in matching.overlap_best(items, targets).collect()] == [(1, 7)]


def test_ledger_versions(spark, tmp_path):
    folder, schema = str(tmp_path / "ledger"), "k string, v int"
    current = spark.createDataFrame([("a",), ("b",)], "k string")
    for version, batch in enumerate([[("a", 1), ("z", 1)], [("b", 2)], [("a", 3)]]):
        for _ in range(2):  # a batch that runs again changes nothing
            freshness.merge_into_ledger(spark.createDataFrame(batch, schema), folder, version, "k", current)
    assert {r.k: r.v for r in spark.read.parquet(f"{folder}/v2").collect()} == {"a": 3, "b": 2}


def test_mentions_of_any_length_and_overlap_equal_brute_force(spark):
    import random

    rng = random.Random(6)
    words = ["a", "b", "c", "d"]
    docs = [(i, rng.choice(["", " ", "\n"]).join([" ".join(rng.choices(words, k=rng.randint(0, 30)))])) for i in range(60)] + [(99, None), (98, "")]
    items = [(i, " ".join(rng.choices(words, k=n))) for i, n in enumerate([1, 2, 2, 5, 7, 8, 9, 12] * 2)] + [(50, ""), (51, None), (52, docs[3][1]), (53, docs[4][1].upper())]
    spaced = lambda t: " " + " ".join((t or "").lower().split()) + " "
    expected = {(d, i) for d, t in docs for i, p in items if spaced(p).strip() and spaced(p) in spaced(t)}
    found = matching.mentions(spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(items, "item_id int, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in found} == expected and len(found) == len(expected)
    sets = [(i, rng.sample("abcdefgh", rng.randint(0, 6))) for i in range(80)]
    best = {}
    for i, own in sets:
        scores = [(len(set(own) & set(o)) / max(1, len(own)), -t) for t, o in sets if len(set(own) & set(o)) >= max(2, 0.5 * len(own))]
        if scores:
            best[i] = max(scores)
    df = spark.createDataFrame(sets, "item int, tokens array<string>")
    got = {r.item: (r.score, -r.target) for r in matching.overlap_best(df, df.withColumnRenamed("item", "target")).collect()}
    assert got == best


def test_places_of_large_groups_and_recommendations(spark):
    rows = [(g, i * 7 % 101, i) for g in (None, 1, 2) for i in range(100 if g == 1 else 3)]
    df = spark.createDataFrame(rows, "g int, x int, i int").repartition(7)
    got = {(r.g, r.i): r.place for r in prose.ordered_places(df, "g", ["x", "i"]).collect()}
    expected = {}
    for g in (None, 1, 2):
        for place, (_, x, i) in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: r[1:]), 1):
            expected[g, i] = place
    assert got == expected
    vectors = spark.createDataFrame([(1, 10, [1, 0]), (1, 11, [0, 2]), (1, 12, [3, 3]), (2, 20, [1, 1])], "label int, vec_id int, e array<long>")
    examples = spark.createDataFrame([(1, [2, 0], 1), (1, [0, 1], -1)], "label int, e array<long>, sign int")
    assert [(r.vec_id, r.score, r.place) for r in search.recommended(vectors, examples, "label", "vec_id", 2).orderBy("place").collect()] == [(12, 3, 1), (10, 2, 2)]


def test_lineage_where_orders_repeat(spark):
    """Two files number their entries alike; each group keeps its own members."""
    rows = [(0, "a", {}, "", [], "g1"), (0, "b", {}, "", [], "g2"), (1, "c", {"abstract": "a long abstract"}, "", [], "g1"), (0, "d", {}, "", [], None)]
    entries = spark.createDataFrame(rows, "ord int, key string, fields map<string,string>, keywords string, removed array<string>, g string")
    for with_group in (True, False):
        folded = dedupe.fold_groups(entries, "g", with_lineage=False, with_group=with_group)
        got = sorted(map(tuple, dedupe.fold_lineage(entries, "g", folded).collect()))
        assert got == [("b", "b"), ("c", "a"), ("c", "c"), ("d", "d")]


def test_runs_of_names_take_time_in_proportion(spark):
    import time

    seconds = []
    for n in (25_000, 100_000):
        texts = ["Smith, " * n, "Smith and " * n, "Smith, " * n + "Kant (1781a, b; 1790)", "Kant and " + "the " * n, "Kant" + " " * n + "x", "Kant (1781" + ", 1790" * n + ")", "Smith, Jones and the " * n, "SmithÉ’s-" * n]
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        began = time.perf_counter()
        found = prose.citations(docs).groupBy("doc_id").count().collect()
        named = prose.rejected_mentions(docs).collect()
        seconds.append(time.perf_counter() - began)
        assert {r.doc_id: r["count"] for r in found} == {5: n + 1}
        assert {(r.doc_id, r.surname, r.year) for r in named} == {(2, "Smith", "1790"), (2, "Kant", "1790")}
    assert seconds[1] < 8 * seconds[0] + 2
