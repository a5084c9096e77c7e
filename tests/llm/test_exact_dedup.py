"""The cuckoo index against a dictionary, groups and changes against brute force."""

import hashlib
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from citeloom.llm import exact_dedup as ed
from citeloom.llm import registry


def digest(text):
    return hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", text or "").encode()).digest()


@pytest.mark.parametrize("same", [0, 10, 32])
def test_index_against_a_dictionary(same):
    """same: bytes that all digests share, so that fingerprints, then buckets, are equal."""
    rng, index, known = random.Random(same), ed.CuckooIndex(2), {}
    pool = [bytes(same) + rng.randbytes(32) for _ in range(3_000)]
    for step in range(20_000):
        d = rng.choice(pool)
        if rng.random() < 0.55 + 0.4 * (step < 4_000):
            first = (False, rng.randint(0, 99), step)
            n = rng.randint(1, 3)
            index.insert(d, first, n)
            old = known.get(d)
            known[d] = [d, min(old[1], first), old[2] + n] if old else [d, first, n]
        else:
            n = rng.randint(1, 3)
            assert index.delete(d, n) == (d in known)
            if d in known:
                known[d][2] -= n
                if known[d][2] <= 0:
                    del known[d]
        assert index.get(d) == known.get(d)
    assert index.size == len(known) and sorted(index.items()) == sorted(known.values())
    assert all((index.get(d) is not None) == (d in known) for d in pool)
    if not same:
        assert not index.aside and index.size > 0.1 * ed.SLOTS * index.buckets


def slow(rows):
    groups = {}
    for i, (doc_id, text) in enumerate(rows):
        groups.setdefault(digest(text), []).append((doc_id is None, doc_id or 0, i))
    out = []
    for i, (doc_id, text) in enumerate(rows):
        own = groups[digest(text)]
        first = min(own)
        out.append((doc_id, None if first[0] else first[1], len(own), digest(text).hex(), (doc_id is None, doc_id or 0) == first[:2]))
    return out


TEXTS = [None, "", " ", "\t\n\x0b\x0c\r ", "a  b", "a b", "a\tb", "a\xa0b", "a b ", "É\n\nx", "É x", "\x1cb", "x\x00", "x"]


@pytest.mark.parametrize("held", [3, 200_000])
def test_groups(spark, monkeypatch, held):
    monkeypatch.setattr(ed, "HELD", held)
    monkeypatch.setattr(ed, "SHARD", 5)
    rng = random.Random(1)
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(100 + i, rng.choice(TEXTS)) for i in range(60)]
    rows += [(None, "n"), (None, "n"), (None, "a b"), (3, "r"), (3, "r"), (7, "r"), (200, "long " * 400_000), (201, "long\n" * 400_000)]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(*r, "x", 5) for r in rows], "doc_id long, text string, kept string, n int").repartition(4)
    out = ed.marked(docs)
    assert out.columns == ["doc_id", "n", "keep_id", "group_size", "kept", "text_sha256"]
    got = out.collect()
    plain = slow(rows)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == sorted((x[:4] for x in plain), key=str)
    kept = sorted(r.text_sha256 for r in got if r.kept)
    assert kept == sorted({x[3] for x in plain})  # one row of each group, also where rows repeat
    may = {(x[0], x[3]) for x in plain if x[4]}
    assert all((r.doc_id, r.text_sha256) in may for r in got if r.kept)
    left = ed.deduplicated(docs).collect()
    assert sorted(digest(r.text).hex() for r in left) == kept and all((r.doc_id, digest(r.text).hex()) in may and r.n == 5 for r in left)
    assert ed.marked(docs.limit(0)).count() == 0


def test_changes_equal_a_rebuild(spark, monkeypatch):
    monkeypatch.setattr(ed, "SHARD", 20)
    rng = random.Random(3)
    row = iter(range(10**6))
    make = lambda n: [(hashlib.sha256(str(rng.randint(0, 60)).encode()).digest(), rng.choice([None, *range(50)]), next(row), 1) for _ in range(n)]
    frame = lambda x: spark.createDataFrame(x, ed.STATE)
    state = lambda df: sorted(map(tuple, df.select("digest", "id", "row", "n").collect()), key=str)
    live = make(300)
    index = ed.indexed(frame(live))
    for _ in range(3):
        new = make(40)
        heavy = rng.choice(live)[0]
        gone = rng.sample(live, 120) + [x for x in live if x[0] == heavy] + make(5) + live[:1] * 2  # a whole group, unknown rows, a repeat
        index = ed.changed(index, frame(live), frame(new), frame(gone))
        live = [x for x in live if x not in set(gone)] + new
        assert state(index) == state(ed.indexed(frame(live)))
    assert state(ed.changed(index, frame(live), frame([]), frame(live))) == []


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    answer = duck.execute(registry.oracle_sql()["op11_exact_dedup"])
    columns = [d[0] for d in answer.description]
    df = registry.queries()["op11_exact_dedup"](spark, sf)
    assert sorted(map(tuple, df.select(columns).collect())) == sorted(answer.fetchall())
    assert df.filter(F.col("group_size") > 1).count() > 0
