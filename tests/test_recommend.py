"""Recommendations against a scan of all vectors."""

import math
import random

import pytest

from citeloom.operators import recommend as r

SCHEMA = "key int, e array<float>, year int, request string"


def test_requests():
    assert r.request(["a", " b ", ""], ["c"]) == [("a", 1), ("b", 1), ("c", -1)] and r.request(for_paper="p") == [("p", 1)]
    for bad in ({}, {"positive": ["a"], "for_paper": "b"}, {"for_paper": "b", "negative": ["c"]}, {"positive": ["a"], "limit": 501}, {"positive": ["a"], "limit": 0}):
        with pytest.raises(ValueError):
            r.request(**bad)


def brute(vectors, examples, limit, pool=lambda v: True):
    out = []
    good = {k: e for k, e, _, _ in vectors if e and all(x is not None and math.isfinite(x) for x in e) and any(e)}
    for name in {x[0] for x in examples}:
        mean = {}
        for sign in (1, -1):
            own = [good[k] for q, k, s in set(examples) if q == name and s == sign and k in good]
            mean[sign] = [sum(c) / len(own) for c in zip(*own, strict=True)] if own else None
        if not mean[1]:
            continue
        d = [a - b for a, b in zip(mean[1], mean[-1] or [0] * len(mean[1]), strict=True)]
        if not any(d):
            continue
        norm = lambda v: math.sqrt(sum(x * x for x in v))
        own = {k for q, k, _ in examples if q == name}
        rows = [(-round(sum(x * y for x, y in zip(good[k], d, strict=True)) / norm(good[k]) / norm(d), 6), k) for k, e, y, _ in vectors if k in good and len(e) == len(d) and k not in own and pool(y)]
        out += [(name, k, -s + 0.0, i + 1) for i, (s, k) in enumerate(sorted(rows)[:limit])]
    return sorted(out)


def test_equals_a_scan(spark):
    rng = random.Random(5)
    vectors = [(i, [float(rng.randint(-3, 3)) for _ in range(4)], 1990 + i % 30, "clash") for i in range(400)]
    vectors += [(1000 + i, [1.0, 2.0, 0.0, 1.0], 2000, "copy") for i in range(300)]
    vectors += [(2000, None, 2000, ""), (2001, [0.0] * 4, 2000, ""), (2002, [1.0, None, 1.0, 1.0], 2000, ""), (2003, [1.0, float("nan"), 1.0, 1.0], 2000, ""), (2004, [float("inf")] * 4, 2000, ""), (2005, [1.0, 2.0], 2000, ""), (2006, [], 2000, "")]
    examples = [("many", i, 1) for i in range(50)] + [("many", i, -1) for i in range(50, 60)] + [("many", 0, 1), ("one", 1000, 1), ("no", 2003, 1), ("none", 1000, 1), ("none", 1001, -1), ("unknown", 77777, 1), ("only not", 5, -1), ("short", 2005, 1)]
    df = spark.createDataFrame(vectors, SCHEMA).repartition(5)
    asked = spark.createDataFrame(examples, "request string, key int, sign int")
    got = sorted(tuple(x) for x in r.recommendations(df, asked, 20).collect())
    assert [(q, k, p) for q, k, _, p in got] == [(q, k, p) for q, k, _, p in brute(vectors, examples, 20)]
    assert all(abs(a[2] - b[2]) < 1e-9 for a, b in zip(got, brute(vectors, examples, 20), strict=True))
    assert {x[0] for x in got} == {"many", "one"}  # the short one has no other vector of its length
    recent = sorted((x.request, x.key, x.place) for x in r.recommendations(df, asked, 7, df.year >= 2010).collect())
    assert recent == [(q, k, p) for q, k, _, p in brute(vectors, examples, 7, lambda y: y >= 2010)]
    assert sorted((x.request, x.key) for x in r.missing(df, asked).collect()) == [("no", 2003), ("unknown", 77777)]
    assert r.recommendations(df.limit(0), asked).count() == 0 and r.recommendations(df, asked.limit(0)).count() == 0


def test_all_are_examples(spark):
    df = spark.createDataFrame([(i, [1.0, float(i)], 2000, "") for i in range(900)], SCHEMA)
    asked = spark.createDataFrame([("q", i, 1) for i in range(890)], "request string, key int, sign int")
    assert [x.key for x in r.recommendations(df, asked, 500).orderBy("place").collect()] == list(range(890, 900))
