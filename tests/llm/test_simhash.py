"""Fingerprints and components against brute force."""

import random

import numpy as np
import pytest
import xxhash

from citeloom.llm import simhash


def slow_fingerprint(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(rows, radius=4):
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= radius:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(i)
    out = [None] * len(rows)
    for members in groups.values():
        ids = [rows[i][0] for i in members if rows[i][0] is not None]
        for i in members:
            out[i] = min(ids, default=None)
    return out


TEXTS = [None, "", "\t \n", "one", "One", "a b c d", "A B C D", "a b c d e", "Ünï\x1ccode É word x y", "x\x0by\x0cz w v u"]


def test_fingerprint_and_components(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(50)]
    texts = list(TEXTS)
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.randint(30, 300))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 3)):
            base[rng.randrange(len(base))] = "z"
            texts.append(" ".join(base))
    rows = [(i if i != 4 else None, t, -1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id long").repartition(3)
    got = simhash.near_duplicates(docs).collect()
    fps = [(i, slow_fingerprint(t)) for i, t, _ in rows]
    expected = sorted(((i, fp, c) for (i, fp), c in zip(fps, slow_components(fps), strict=True)), key=str)
    assert sorted(((r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in got), key=str) == expected
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("part", [4, 8192])
@pytest.mark.parametrize("n", [10, 10_000_000])
def test_star_edges_connect_exactly_the_near_pairs(spark, monkeypatch, part, n):
    monkeypatch.setattr(simhash, "PART", part)
    rng = random.Random(part + n)
    fps = set()
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(12):
            fps.add(x)
            for b in rng.sample(range(64), rng.randint(1, 5)):
                x ^= 1 << b
    fps = sorted(fps)
    df = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp long")
    edges = simhash.star_edges(df, n).collect()
    rows = [(f, f) for f in fps]
    links = {}
    for e in edges:
        links.setdefault(e.a & (2**64 - 1), set()).add(e.b & (2**64 - 1))
        links.setdefault(e.b & (2**64 - 1), set()).add(e.a & (2**64 - 1))
    label = {}
    for f in fps:
        if f not in label:
            todo = [f]
            while todo:
                x = todo.pop()
                if x not in label:
                    label[x] = f
                    todo += links.get(x, ())
    assert [label[f] for f in fps] == slow_components(rows)


def test_a_bucket_of_several_blocks_of_rows_loses_no_union():
    """Trees of fingerprints, more than fit in one block of rows, against a plain union-find."""
    rng, fps = np.random.default_rng(5), []
    while len(fps) < 4_000:
        own = [int(rng.integers(0, 2**64, dtype=np.uint64))]
        while len(own) < 400:
            x = own[int(rng.integers(len(own)))]
            for b in rng.choice(64, 4, replace=False).tolist():
                x ^= 1 << b
            own.append(x)
        fps += own
    fp = rng.permutation(np.array(sorted(set(fps)), np.uint64))
    pivots = simhash.pivots_of()
    side = rng.integers(0, 2, len(fp))
    for parts in (None, side):
        parent = list(range(len(fp)))

        def find(x):
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        for i in range(len(fp)):
            near = np.bitwise_count(fp[:i] ^ fp[i]) <= simhash.RADIUS
            if parts is not None:
                near &= parts[:i] != parts[i]
            for j in np.flatnonzero(near).tolist():
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
        first = {}
        got = simhash.local_components(fp, parts, pivots).tolist()
        assert [first.setdefault(x, i) for i, x in enumerate(got)] == [find(x) for x in range(len(fp))]


def test_the_table_discards_most_pairs_and_no_link(spark):
    """In groups of equal blocks nearly all pairs fall to the pivots' coordinates, and every link survives them."""
    rng = np.random.default_rng(9)
    base = rng.integers(0, 2**64, 3_000, np.uint64)
    near = base[:500] ^ (np.uint64(1) << rng.integers(0, 64, 500).astype(np.uint64))
    fp = np.unique(np.concatenate([base, near]))
    tally = np.zeros(4, np.int64)
    simhash.local_components(fp, None, simhash.pivots_of(), tally=tally)
    pairs, in_range, survivors, links = tally.tolist()
    assert links == sum(int((np.bitwise_count(fp[:i] ^ fp[i]) <= simhash.RADIUS).sum()) for i in range(len(fp))) >= 500
    assert pairs == len(fp) * (len(fp) - 1) // 2 and in_range < 0.4 * pairs and survivors < 0.01 * pairs
    df = spark.createDataFrame([(int(x),) for x in fp.view(np.int64).tolist()], "fp long")
    use = simhash.table_use(df, len(fp)).first()
    assert use.links >= links and use.survivors < 0.5 * use.pairs


def test_columns_of_inner_names_pass_through(spark):
    docs = spark.createDataFrame([(1, "a b c d e", "x", 5, 7), (2, "a b c d e", "y", 6, 8), (3, "other words of a text", "z", 7, 9)], "doc_id long, text string, __label string, least long, label int")
    got = sorted(tuple(r) for r in simhash.near_duplicates(docs).select("doc_id", "component_id", "__label", "least", "label").collect())
    assert got == [(1, 1, "x", 5, 7), (2, 1, "y", 6, 8), (3, 3, "z", 7, 9)]
    assert len({r["__label"] for r in simhash.near_groups(docs).collect()}) == 2
