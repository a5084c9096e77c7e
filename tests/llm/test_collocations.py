"""The sort against plain counts, collocations against brute force and SQL."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from citeloom.llm import collocations as co
from citeloom.llm import registry
from citeloom.llm.arrow import utf8_bytes


def split(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [re.findall(r"[^\x20\x09]+", piece) for piece in re.split(r"[.,;:!?\x0A-\x0D]", low)]


def phrases(texts, depth):
    f = Counter()
    for t in texts:
        for w in split(t):
            for n in range(1, depth + 1):
                f.update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    return f


def slow(rows, depth=3, least=10, nested=50, top=2000):
    out = []
    for lang in {lang or "und" for lang, _ in rows}:
        f = phrases([t for own, t in rows if (own or "und") == lang], depth)
        total = sum(n for p, n in f.items() if len(p) == 1)
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in found.items():
            score, _, left, right = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            inside = any(len(q) > len(p) and 100 * b >= nested * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in found.items())
            if not inside:
                kept.append((-score, -a, " ".join(p).encode(), left, right))
        for i, (s, a, p, left, right) in enumerate(sorted(kept)[:top]):
            out.append((lang, i + 1, p.decode(), -a, left, right, total, -s))
    return sorted(out)


def texts(n, seed):
    rng = random.Random(seed)
    pool = ["a", "B", "b", "the", "The", "é", "É", "x\xa0y", "\x1c", "z9", "w1", "w2", "w3", "w4", "😀"]
    weights = [20, 3, 3, 15, 5, *[2] * 10]
    gaps = [" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\r\n", "!? ", "\x0b", ":"]
    own = []
    for _ in range(n):
        t = "".join(rng.choices(pool, weights)[0] + rng.choice(gaps) for _ in range(rng.randint(0, 30)))
        own.append(t + rng.choice(["", "new york city", "kick the bucket. ", "of the"]))
    return own


@pytest.mark.parametrize("depth", [2, 3, 4])
def test_equal_parts_are_counts(depth):
    own = texts(200, depth)
    words = co.Words(co.LOWER[utf8_bytes(pa.array(own))[0]], utf8_bytes(pa.array(own))[1], depth)
    name = [w.decode() for w in words.words.to_pylist()]
    pointer, size = co.by_lead(words.code)
    f = phrases(own, depth)
    for least in (1, 4, 10):
        got = Counter()
        for n, pointers, weights, _ in co.three_way(words.code, words.left, pointer, np.ones(len(pointer), np.int64), size, depth, least):
            for p, w in zip(pointers.tolist(), weights.tolist(), strict=True):
                phrase = tuple(name[c] for c in words.code[p : p + n])
                assert phrase not in got
                got[phrase] = w
        assert got == Counter({p: n for p, n in f.items() if n >= least and len(p) > 1})


@pytest.mark.parametrize("depth", [2, 3, 5])
def test_trees_hold_all_suffixes_in_order(depth):
    own = texts(150, depth)
    words = co.Words(co.LOWER[utf8_bytes(pa.array(own))[0]], utf8_bytes(pa.array(own))[1], depth)
    leads, weights, tails, _, _ = co.trees(words, np.zeros(len(words.code), np.int64), depth)
    back = co.Suffixes(*utf8_bytes(tails.cast(pa.string())), depth)
    first = [words.words[int(c)].as_py() for c in words.code[leads]]
    got = Counter()
    for i, w in enumerate(back.weight.tolist()):
        n = int(back.left[i * depth])
        got[(first[back.row[i]], *(back.words[int(c)].as_py() for c in back.code[i * depth + 1 : i * depth + n]))] += w
    expected = Counter()
    for t in own:
        for w in split(t):
            expected.update(tuple(x.encode() for x in w[i : i + depth]) for i in range(len(w)) if i + 1 < len(w))
    assert got == expected and weights.sum() == len(words.code) and len(back.weight) == len(expected)


@pytest.mark.parametrize(("depth", "mark", "block", "routed", "limits"), [(3, 8, 8 << 20, 1_000_000, (10, 50, 2000)), (3, 1, 500, 2_000, (3, 90, 7)), (4, 1, 2_000, 2_000, (10, 50, 2000))])
def test_against_brute_force(spark, monkeypatch, depth, mark, block, routed, limits):
    monkeypatch.setattr(co, "MARK", mark)
    monkeypatch.setattr(co, "BLOCK", block)
    monkeypatch.setattr(co, "ROUTED", routed)
    rng = random.Random(depth)
    rows = [(rng.choice(["en", "fr", None, "und"]), t) for t in texts(400, 9)] + [("de", None), ("de", ""), ("nl", "a b " * 60_000), ("nl", "one"), ("xx", "...")]
    docs = spark.createDataFrame([(i, *r, 1, "k") for i, r in enumerate(rows)], "doc_id long, lang string, text string, n int, phrase string").repartition(5)
    least, nested, top = limits
    got = co.collocations(docs, depth=depth, least=least, nested=nested, top=top).collect()
    assert sorted(map(tuple, got)) == slow(rows, depth, least, nested, top)
    if depth == 4:
        assert co.collocations(docs.limit(0)).count() == 0


def test_scores_are_exact_beyond_64_bits(spark):
    rows = []
    for i, (a, left, right) in enumerate([(10**14 - 1, 10**14 - 1, 10**14 - 1), (3 * 10**13, 10**14 + 7, 9 * 10**13 + 1), (10**13 + 3, 10**13 + 4, 10**13 + 3), (123_456_789_012, 99_999_999_999_999, 123_456_789_013)]):
        rows += [("en", f"a{i} b{i}", 2, a), ("en", f"a{i}", 1, left), ("en", f"b{i}", 1, right)]
    counted = spark.createDataFrame(rows, "lang string, phrase string, words int, n long")
    got = co.scored(counted).collect()
    assert len(got) == 4 and all(r.score == 10**6 * r.a * r.a // (r.l * r.r) for r in got)


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    answer = duck.execute(registry.oracle_sql()["op13_collocations"])
    columns = [d[0] for d in answer.description]
    df = registry.queries()["op13_collocations"](spark, sf)
    got = sorted(map(tuple, df.select(columns).collect()))
    assert got == sorted(answer.fetchall()) and len(got) > 100
