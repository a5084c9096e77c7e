"""Links and components of vectors against all pairs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from citeloom.llm import embedding_dedup as ed


def brute(rows, threshold=0.98):
    def ok(r):
        return r[0] is not None and r[2] is not None and r[1] is not None and len(r[1]) > 0 and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])

    n = len(rows)
    parent, links = list(range(n)), [0] * n

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(n):
        for j in range(i):
            if ok(rows[i]) and ok(rows[j]) and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
                if a @ b / math.sqrt(a @ a) / math.sqrt(b @ b) >= threshold:
                    links[i] += 1
                    links[j] += 1
                    parent[find(i)] = find(j)
    out = []
    for i, r in enumerate(rows):
        own = [rows[j][0] for j in range(n) if find(j) == find(i)]
        least = r[0] if r[0] is None else min(own)
        out.append((r[0], links[i], least, r[0] is not None and r[0] == least))
    return out


def vectors(seed, dim, n):
    rng = np.random.default_rng(seed)
    rows, k = [], 0
    for _ in range(n):
        base = rng.normal(size=dim)
        for _ in range(int(rng.integers(1, 6))):
            noise = base + rng.normal(size=dim) * rng.choice([0.0, 0.05, 0.15, 0.2])
            rows.append((k, noise.astype(np.float32).tolist(), int(rng.integers(0, 2))))
            k += 1
    return rows


@pytest.mark.parametrize(("dim", "part"), [(64, 4096), (64, 3), (5, 4096), (2, 7)])
def test_equals_all_pairs(spark, monkeypatch, dim, part):
    monkeypatch.setattr(ed, "PART", part)
    rows = vectors(dim, dim, 60)
    one = rows[0][1]
    rows += [(900, None, 1), (901, [], 1), (902, [0.0] * dim, 1), (903, [None, *one[1:]], 1), (904, [float("nan"), *one[1:]], 1), (905, [float("inf"), *one[1:]], 0), (906, one, None), (None, one, rows[0][2]), (907, one[:-1] or one, 1), (908, one, rows[0][2]), (909, [x * 1e-30 for x in one], rows[0][2]), (910, [-0.0] + [0.0] * (dim - 2) + [1.0], 1), (911, [0.0] * (dim - 1) + [1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 AS kept", "'x' AS cid").repartition(3)
    rows = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in ed.near_vectors(df).collect()), key=str)
    assert got == sorted(brute(rows), key=str)


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert ed.near_vectors(df).count() == 0


def beside(rng, x):
    """A vector that links with x, in a random direction from it."""
    aside = rng.normal(size=len(x))
    aside -= aside @ x * x
    return np.cos(0.19) * x + np.sin(0.19) * aside / np.sqrt(aside @ aside)


def check_bucket(points, cid):
    n = len(points)
    scheme = ed.Scheme(points[:1000], n, 0.98)
    assert len(scheme.slices) == 1
    links, label = ed.bucket_links(cid, np.ones(n, np.int64), np.ones(n, bool), points, 0, scheme, 0.98)
    parent, near = list(range(n)), np.argwhere(np.triu(points @ points.T >= 0.98, 1))

    def find(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for a, b in near.tolist():
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    assert label.tolist() == [find(x) for x in range(n)]
    assert links.tolist() == np.bincount(near.ravel(), minlength=n).tolist()
    return near.tolist()


def test_a_late_chunk_keeps_the_unions_of_earlier_ones():
    rng = np.random.default_rng(4)
    points = ed.unit(rng.normal(size=(1_600, 15)))
    z, v, w, p, i, y, j = 0, 1, 2, 3, 4, 600, 1_100
    points[y] = points[z]  # z moves
    for new, old in ((v, y), (w, y), (p, y), (i, p), (j, i), (z, j)):
        points[new] = beside(rng, points[old])
    cid = np.zeros(1_600, np.int64)
    cid[[w, y, p, z, j, i, v]] = [9, 8, 7, 6, 5, 4, 3]  # the larger one's chunk finds the link
    others = np.flatnonzero(cid == 0)
    cid[others] = 100 + rng.permutation(len(others))
    found = check_bucket(points, cid)
    assert set(map(tuple, found)) == {(p, i), (w, y), (z, j), (p, y), (v, y), (i, j)}


def test_trees_with_shuffled_ids_in_a_bucket_of_several_chunks():
    rng = np.random.default_rng(6)
    points = []
    for _ in range(20):
        tree = [ed.unit(rng.normal(size=(1, 15)))[0]]
        while len(tree) < 200:
            tree.append(beside(rng, tree[rng.integers(len(tree))]))
        points += tree
    check_bucket(rng.permutation(np.array(points)), rng.permutation(len(points)))


def test_classes_whose_numbers_collide_stay_apart(spark):
    """A number that two vectors share is given up for another."""
    rows = [(1, [1.0, 0.0], 5), (2, [0.0, 1.0], 5), (3, [1.0, 0.0], 5), (4, [1.0, 0.0], 6), (5, None, 5)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    poor = lambda label, vector, seed: ed.class_number(label, vector, seed) if seed > 2 else F.lit(7).cast("long")
    keyed, classes = ed.numbered(vectors, F.col("embedding"), poor)
    own = {r.vec_id: r["__cid"] for r in keyed.collect()}
    assert own[1] == own[3] != own[2] and own[4] != own[1] and own[5] is None
    assert sorted((r.least, r.weight) for r in classes.collect()) == [(1, 2), (2, 1), (4, 1)]


def test_columns_of_inner_names_pass_through(spark):
    rows = [(1, [1.0, 0.0], 1, 7, 8, 9), (2, [1.0, 0.0], 1, 7, 8, 9), (3, [0.0, 1.0], 1, 7, 8, 9)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, n int, component int, cid int")
    vectors = vectors.selectExpr("*", "1 AS weight", "2 AS links", "3 AS least", "4 AS node", "5 AS root")
    got = sorted(ed.near_vectors(vectors).select("vec_id", "n_links", "component_id", "n", "component", "cid", "weight", "links").collect())
    assert [tuple(r) for r in got] == [(1, 1, 1, 7, 8, 9, 1, 2), (2, 1, 1, 7, 8, 9, 1, 2), (3, 0, 3, 7, 8, 9, 1, 2)]
