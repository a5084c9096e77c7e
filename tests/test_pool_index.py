"""The index of the pool: updates against a full rebuild, folders that stay, a kill before the pointer."""

import json

import pytest
from pyspark.sql import functions as F

from citeloom.operators import pool_index
from citeloom.sources import envelopes, versions


def envelope(*records, source="crossref"):
    return json.dumps({"source": source, "results": list(records)})


A = {"title": "A", "container_title": "The Journal of Ends", "volume": "3", "issue": "1", "page": "1--9", "publisher": "Press ", "year": "2001", "doi": "https://doi.org/10.1/A"}
B = {"title": "B", "container_title": "Ends", "volume": "3", "doi": "10.1/a"}
C = {"title": "C", "container_title": "Means", "volume": " 12 ", "year": 1999}


def files(spark, **content):
    return spark.createDataFrame([(f"{n}.json", c) for n, c in content.items()], "file string, content string")


def rows(df):
    return sorted(map(tuple, df.select("kind", "key", "value", "file", "rec_ord").collect()))


def rebuilt(spark, out, pool):
    pool_index.update(pool, out, 16)
    return rows(pool_index.read(spark, out))


def test_updates_equal_a_rebuild_and_touch_their_buckets_only(spark, tmp_path):
    out = str(tmp_path / "index")
    assert rows(pool_index.read(spark, out)) == [] and pool_index.lookup(spark, out, [("volume", "3")]).count() == 0
    first = files(spark, a=envelope(A), b=envelope(B, C), broken="no envelope", empty=None)
    assert pool_index.update(first, out, 16) == {"read": 4, "gone": 0, "same": 0, "written": len({r.bucket for r in pool_index.read(spark, out).collect()})}
    before = json.loads(versions.get(spark, f"{out}/CURRENT"))
    assert pool_index.update(first.union(first), out) == {"read": 0, "gone": 0, "same": 4, "written": 0}
    D = {"title": "D", "volume": "77"}
    report = pool_index.update(first.union(files(spark, d=envelope(D))), out)
    after = json.loads(versions.get(spark, f"{out}/CURRENT"))
    assert report == {"read": 1, "gone": 0, "same": 4, "written": 1}
    assert sum(before["held"].get(b) != v for b, v in after["held"].items()) == 1
    last = files(spark, a=envelope(A | {"volume": "4"}), d=envelope(D), broken="log\n" + envelope(C) + "\nlog", empty=None)
    assert (r := pool_index.update(last, out))["read"] == 2 and r["gone"] == 1 and r["same"] == 2
    assert rows(pool_index.read(spark, out)) == rebuilt(spark, str(tmp_path / "other"), last)
    assert rows(pool_index.read(spark, out)) == rows(pool_index.postings(envelopes.records(envelopes.pool(last))))
    assert [(r.value, r.file) for r in pool_index.lookup(spark, out, [("volume", "4"), ("volume", "3"), ("volume", "77")]).orderBy("file").collect()] == [("4", "a.json"), ("77", "d.json")]


def test_everything_goes(spark, tmp_path):
    out = str(tmp_path / "index")
    pool_index.update(files(spark, a=envelope(A)), out, 4)
    assert pool_index.update(files(spark, a=None).limit(0), out)["gone"] == 1
    assert rows(pool_index.read(spark, out)) == []


def test_a_kill_before_the_pointer_leaves_the_old_index(spark, tmp_path, monkeypatch):
    out = str(tmp_path / "index")
    pool_index.update(files(spark, a=envelope(A)), out, 4)
    before = rows(pool_index.read(spark, out))

    def dies(name, write):
        raise RuntimeError(name)

    with monkeypatch.context() as m:
        m.setattr(versions, "_step", dies)
        with pytest.raises(RuntimeError, match="pointer"):
            pool_index.update(files(spark, a=envelope(B), c=envelope(C)), out)
    assert rows(pool_index.read(spark, out)) == before
    pool_index.update(files(spark, a=envelope(B), c=envelope(C)), out)
    assert {r[3] for r in rows(pool_index.read(spark, out))} == {"a.json", "c.json"}


def test_heavy_buckets_are_dealt(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(pool_index, "HEAVY", 5)
    pool = files(spark, **{f"f{i}": envelope(C) for i in range(30)})
    assert len(rebuilt(spark, str(tmp_path / "index"), pool)) == 30 * 4


def test_confirmed_and_last_file_of_a_doi(spark, tmp_path):
    out = str(tmp_path / "index")
    pool_index.update(files(spark, a=envelope(A), b=envelope(B, C)), out, 8)
    index = pool_index.read(spark, out)
    assert [tuple(r) for r in pool_index.doi_files(index).collect()] == [("10.1/a", "b.json")]
    asked = [("journal", "journal of ends"), ("booktitle", "Means"), ("volume", "12"), ("number", "1"), ("number", "3"), ("pages", "1-9"), ("publisher", "press"), ("doi", "doi:10.1/A"), ("doi", "10.1/b"), ("note", "any"), ("volume", None), ("volume", ""), ("volume", "12")]
    entries = spark.createDataFrame([(i, *a) for i, a in enumerate(asked)], "kind int, field string, value string")
    got = pool_index.confirmed(entries, index)
    assert got.columns == ["kind", "field", "value", "verifiable"]
    assert [r.verifiable for r in got.orderBy(F.col("kind")).collect()] == [True, True, True, True, False, True, True, True, False, True, False, False, True]
