"""Every registered query against its SQL in DuckDB, on the smallest tables; every other one for a stable result."""

import duckdb
import pytest

from citeloom.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(columns, data):
    order = [list(columns).index(k) for k in sorted(columns)]
    return sorted((tuple(r[i] for i in order) for r in data), key=str)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    answer = duck.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in answer.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(columns, answer.fetchall())


def test_queries_without_sql(spark):
    titles = registry.queries()["html_title_text"](spark, SF).collect()
    assert titles and all(r.title and r.characters > 0 for r in titles)
    reasons = {r.reason for r in registry.queries()["capture_gate"](spark, SF).collect()}
    assert "ok" in reasons and reasons <= {"no_capture", "fetch_error", "bad_status", "boilerplate", "thin", "title_mismatch", "span_malformed", "span_unverified", "ok"}
    assert set(registry.queries()) - set(registry.oracle_sql()) == {"html_title_text", "capture_gate"}


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
