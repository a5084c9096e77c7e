"""Lookups and searches."""

from pyspark.sql import functions as F

from citeloom.operators import search


def test_search_filters_orders_and_limits(spark):
    rows = [("Free will", 2001, 5, "a", True, 1, 0.5), ("Will power", 2005, 9, "b", False, 2, 0.9), ("Mind", 1990, 0, "a", True, 3, None), ("free WILL", None, 7, "a", True, 4, 0.5)]
    df = spark.createDataFrame(rows, "title string, year int, citations int, kind string, is_open boolean, ord int, score double")
    ords = lambda **k: [r.ord for r in search.search(df, **k).collect()]
    assert ords() == [2, 1, 4, 3] and ords(terms="will free") == [1, 4] and ords(years=(1995, 2004)) == [1]
    assert ords(least_citations=5, kind="a") == [1, 4] and ords(open_only=True, limit=1) == [1]


def test_edges_limit_before_influence(spark):
    edges = spark.createDataFrame([("p", "a", False, 1), ("p", "b", True, 2), ("c", "p", True, 3)], "source string, target string, influential boolean, ord int")
    got = search.edges_of(edges, "p", influential_only=True, limit=1).collect()
    assert [(r.direction, r.paper) for r in got] == [("citations", "c")]


def test_reviews(spark):
    books = spark.createDataFrame([(1, "free will and action", "Smith"), (2, "mind", ""), (3, "unrelated thing", "X")], "book int, title string, author string")
    slugs = spark.createDataFrame([("free-will-action", 1), ("action-free-will", 0), ("mind", 2)], "slug string, ord int")
    assert [(r.book, r.slug) for r in search.best_review(books, slugs).collect()] == [(1, "action-free-will")]


def test_metadata_matches(spark):
    rows = [
        ("a", "smith", 2001, 40.0, "John Smith", [2010, 2002], 1), ("a", "smith", 2001, 35.0, "John Smith", [2001], 2),
        ("b", "", 2001, 45.0, "x", [2001], 1), ("c", "lee", 2001, 60.0, "Kim", [2001], 1),
        ("d", "", 2001, 60.0, "x", [1990, 2005], 1), ("e", "", 2001, 60.0, "x", [], 1),
    ]
    df = spark.createDataFrame(rows, "query string, author string, year int, score double, authors string, years array<int>, ord int")
    assert sorted(r["query"] for r in search.metadata_match(df).collect()) == ["a", "e"]


def test_titles_and_terms(spark):
    df = spark.createDataFrame([("The nature of free action", "Nature and action"), ("The nature of free action", "Other book"), ("of a", "x")], "a string, b string")
    assert [r.v for r in df.select(search.title_agrees(F.col("a"), F.col("b")).alias("v")).collect()] == [True, False, False]
    venues = spark.createDataFrame([("Mind",), ("mind",), ("Nous",), ("",)], "v string")
    assert [(r.key, r.raw) for r in search.sampled_terms(venues, F.lower("v"), "v", 1).collect()] == [("mind", "Mind")]


def test_reviews_equal_a_scan(spark):
    import random

    from citeloom.operators.matching import slug_score

    rng = random.Random(3)
    words = ["mind", "will", "free", "action", "reason", "nature", "virtue", "truth", "being", "time"]
    titles = [" ".join(rng.choices(words, k=rng.randint(1, 6))) for _ in range(80)] + ["", None]
    books = spark.createDataFrame([(i, t, rng.choice(["smith", "Lee", "", None])) for i, t in enumerate(titles)] + [(500, titles[0], "smith")], "book int, title string, author string")
    slugs = spark.createDataFrame([("-".join(rng.choices(words, k=rng.randint(1, 6)) + rng.choice([[], ["smith"], ["lee"]])), i) for i in range(120)], "slug string, ord int")
    author = F.coalesce("author", F.lit(""))
    sure = (author != "") & F.contains(F.replace("slug", F.lit("-"), F.lit(" ")), F.lower(author))
    every = books.crossJoin(slugs).withColumn("score", slug_score(F.coalesce("title", F.lit("")), F.col("slug"), author)).filter((F.col("score") >= 0.75) | (sure & (F.col("score") >= 0.6)))
    want = every.groupBy("book").agg(F.max(F.struct("score", (-F.col("ord")).alias("o"), "slug")).alias("b")).select("book", "b.slug", "b.score")
    got = search.best_review(books, slugs)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 20
