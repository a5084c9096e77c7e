"""Cuts, forms and round trips against a plain version."""

import hashlib
import random
import re
import time

import duckdb
import pytest

from citeloom.llm import fill_in_middle as fim
from citeloom.llm import registry


def slow(doc_id, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    r = [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    a, b = sorted((r[0] % (n + 1), r[1] % (n + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or r[2] % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if r[3] % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def texts():
    rng = random.Random(2)
    own = [None, "", " ", "a", "\n", "a<P>b", "<S>", "x <M", "<", "<P", "P>", "S><", "é", "Ünï 😀😀 code\r\n\r\n", "$1 \\2 ${x}", "\x00a\x00", "a" * 50, "\u0085  z"]
    for _ in range(150):
        own.append("".join(rng.choice(["ab", "Q", " ", "\n", "<", ">", "é", "😀", "$", "\\", "1", "P", "S", "M"]) for _ in range(rng.randint(1, 60))))
    return own


@pytest.mark.parametrize("width", [1, 7, fim.SLICE])
def test_cuts_and_round_trip(spark, width):
    rows = [(None if i == 5 else i, t, i, "extra") for i, t in enumerate(texts())] + [(3, "a", 3, "extra")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int, form string").withColumn("other", docs_other())
    out = fim.fill_in_middle(docs, width=width)
    assert out.columns == ["doc_id", "text", "other", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = out.withColumn("back", fim.restored(out["output"], out["form"])).collect()
    assert all(r.back == r.text and r.other == 1 for r in got)
    expected = sorted((d, t or "", *slow(d, t)) for d, t, *_ in rows if d is not None)
    assert sorted((r.doc_id, r.text, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got if r.doc_id is not None) == expected
    assert [(r.n, r.form, r.output) for r in got if r.doc_id is None] == [(lambda x: (x[0], x[1], x[4]))(slow(None, texts()[5]))]
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(docs.limit(0)).count() == 0


def docs_other():
    from pyspark.sql import functions as F

    return F.lit(1)


def test_a_text_of_megabytes_needs_no_deep_stack_and_no_square_time(spark):
    seconds = []
    for size in (400_000, 1_600_000):
        rows = [(i, "a1" * size if i % 2 else "word " * size) for i in range(6)]
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        began = time.perf_counter()
        got = fim.fill_in_middle(docs, width=100_000).collect()
        seconds.append(time.perf_counter() - began)
        assert [(r.n, r.form, r.prefix_chars, r.middle_chars) for r in sorted(got)] == [slow(d, t)[:4] for d, t in rows]
    assert seconds[1] < 12 * seconds[0] + 2


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    answer = duck.execute(registry.oracle_sql()["op12_fill_in_middle"])
    columns = [d[0] for d in answer.description]
    df = registry.queries()["op12_fill_in_middle"](spark, sf)
    assert sorted(map(tuple, df.select(columns).collect())) == sorted(answer.fetchall())
