"""Repeat removal against a dictionary of all strings of 100 bytes."""

import random

import numpy as np
import pytest

from citeloom.llm import suffix_dedup as sd


def brute(rows):
    """rows: (order key, text) -> list of (n_bytes, n_removed, n_spans, kept)."""
    first = {}
    for key, text in sorted(rows, key=lambda r: r[0]):
        raw = (text or "").encode()
        for i in range(len(raw) - 99):
            first.setdefault(raw[i : i + 100], (key, i))
    out = []
    for key, text in rows:
        raw = (text or "").encode()
        gone = np.zeros(len(raw) + 1, bool)
        for i in range(len(raw) - 99):
            if first[raw[i : i + 100]] < (key, i):
                gone[i : i + 100] = True
        runs = int((gone[:-1] & ~np.append(False, gone[:-2])).sum()) if len(raw) else 0
        out.append((len(raw), int(gone.sum()), runs, bytes(np.frombuffer(raw, np.uint8)[~gone[:-1]])))
    return out


def corpus(seed, n=40):
    rng = random.Random(seed)
    words = ["the", "of", "ünd", "straße", "x", "na", "banana", "\n", "lorem"]
    fresh = lambda k: " ".join(rng.choice(words) + str(rng.randint(0, 99)) for _ in range(k))
    passages = [fresh(rng.randint(14, 60)) for _ in range(5)]
    texts = [None, "", "short", "a" * 99, "a" * 100, "a" * 350, "ab" * 200, "na" * 75 + "b", "\0" * 150, "x" * 120 + "\0" * 130, "x" * 120 + "\0" * 40]
    for _ in range(n):
        parts = [fresh(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 3)):
            passage = rng.choice(passages)
            cut = rng.randint(0, len(passage) // 2) if rng.random() < 0.4 else 0
            parts += [passage[cut:], fresh(rng.randint(0, 15))]
        texts.append(rng.choice(["", " "]).join(parts))
    for _ in range(10):
        base = list(rng.choice(texts[11:]))
        if base and rng.random() < 0.7:
            base[rng.randrange(len(base))] = "#"
        texts.append("".join(base))
    return texts


def run(spark, rows, extra=True):
    docs = spark.createDataFrame([(k, t, "c", 1) for k, t in rows], "doc_id long, text string, kept string, sid int").repartition(4)
    return docs, sd.remove_repeats(docs).collect()


@pytest.mark.parametrize("hot,held,merged", [(20_000, 500_000, 500_000), (3, 500_000, 500_000), (1, 7, 500_000), (20_000, 5, 12)])
def test_equals_brute_force(spark, monkeypatch, hot, held, merged):
    """Anchors of any size: whole, lengthened, in several parts of a task, and salted (MERGED sets that bound)."""
    monkeypatch.setattr(sd, "HOT", hot)
    monkeypatch.setattr(sd, "HELD", held)
    monkeypatch.setattr(sd, "MERGED", merged)
    monkeypatch.setattr(sd, "OFTEN", 1 if merged < 100 else 16)
    rows = [(i * 3, t) for i, t in enumerate(corpus(hot))]
    _, got = run(spark, rows)
    expected = {k: e for (k, _), e in zip(rows, brute(rows), strict=True)}
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got} == expected


def test_repeated_and_null_ids(spark):
    import hashlib

    texts = corpus(8, 12)
    ids = [None, 5, 5, 7] * 99
    rows = [(ids[i], t) for i, t in enumerate(texts)] + [(5, texts[-1]), (5, texts[-1]), (None, texts[-2])]
    key = lambda k, t: (k is not None, k or 0, hashlib.sha256((t or "").encode()).hexdigest())
    keyed = [(key(k, t), t) for k, t in rows]
    _, got = run(spark, rows)
    expected = sorted((str(k), *e) for (k, _), e in zip(rows, brute(keyed), strict=True))
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == expected


def test_empty_table_and_no_repeats(spark):
    docs, _ = run(spark, [(1, "a")])
    assert sd.remove_repeats(docs.limit(0)).count() == 0
    assert sd.remove_repeats(docs).collect()[0].n_removed == 0


def test_blocks_of_a_long_text(spark):
    rng = random.Random(2)
    piece = "".join(rng.choices("abcdefgh ", k=700))
    long = "".join(rng.choices("abcdefgh ", k=sd.BLOCK - 300)) + "1" + piece + "2" + "".join(rng.choices("abcdefgh ", k=sd.BLOCK)) + "3" + piece + "4"
    _, got = run(spark, [(1, piece), (2, long)])
    by = {r.doc_id: r for r in got}
    assert (by[1].n_removed, by[2].n_removed, by[2].n_spans) == (0, 1400, 2)


def test_groups_hold_all_occurrences():
    x, y = b"q" * 80, b"r" * 120
    contexts = [b"1" + x + y[:100], b"2" + x + y[:100], b"3" + b"k" * 75 + y[:100]]
    left = np.array([76, 76, 76])
    cut = [c[-176:] for c in contexts]
    cut[0], cut[1] = b"1" + cut[0][1:], b"2" + cut[1][1:]
    groups = list(sd.repeat_groups(np.zeros(3, np.int64), left, np.array([len(c) for c in cut]), np.frombuffer(b"".join(cut), np.uint8)))
    assert sorted((low, high, sorted(own.tolist())) for low, high, own in groups) == [(0, 100, [0, 1, 2]), (75, 100, [0, 1])]


def test_hot_grams_are_salted_and_known(spark):
    """A gram with many contexts goes to several groups, and each of its rows is known to be hot."""
    docs = spark.createDataFrame([(i, f"{i:04d}" * 20 + "the same passage of some thirty bytes" + f"{i:04d}" * 20) for i in range(40)], "sid long, text string")
    rows = sd._anchor_rows(docs.coalesce(1), 8).cache()
    salted = {r.gram for r in rows.filter("salt > 0").collect()}
    assert salted and salted == {r.gram for r in rows.filter("pos = -1").collect()}
    assert not salted & {r.gram for r in rows.filter("salt = 0 AND pos >= 0").collect()}
    kinds = {(r.b in salted, r.kind) for r in sd._repeated_leaves(rows, 100).filter("kind > 0").collect()}
    assert (True, 2) in kinds and (True, 1) not in kinds
    rows.unpersist()


def test_grams_with_one_hash_are_told_apart():
    """Contexts of different grams under one gram hash share nothing that is not equal byte by byte."""
    rng = random.Random(3)
    same = bytes(rng.choices(range(97, 123), k=176))
    cut = [bytes(rng.choices(range(97, 123), k=176)) for _ in range(5)] + [same, same[:150] + b"#" * 26]
    groups = list(sd.repeat_groups(np.zeros(7, np.int64), np.full(7, 76), np.full(7, 176), np.frombuffer(b"".join(cut), np.uint8)))
    assert [(low, high, sorted(own.tolist())) for low, high, own in groups] == [(76, 74, [5, 6])]
