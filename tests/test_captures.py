"""Captures and cached verdicts: what they are made of, and which shapes are refused."""

import json

from pyspark.sql import functions as F

from citeloom.sources import captures as c


def test_responses(spark):
    page = "<title>Kafé</title><script>x()</script><p>Some té xt"
    rows = [
        ("utf8", "text/html", page.encode()), ("header", 'text/html; charset = "ISO-8859-1"', page.encode("latin-1")), ("meta", "text/html", b"<meta charset=iso-8859-1>" + page.encode("latin-1")), ("bad", None, b"<title>a\xff</title>b"),
        ("pdf", "Application/PDF", b"x"), ("pdf2", None, b"%PDF-1.4 x"), ("none", None, None), ("mojibake", None, b"<p>" + bytes(range(1, 9)) * 9 + b"a"),
    ]
    df = spark.createDataFrame([(u, u, "t", 200, k, bytearray(b) if b is not None else None, "mine") for u, k, b in rows], "url string, final_url string, retrieved_at string, http_status int, content_type string, body binary, title string")
    got = {r.url: (r.title, r.text, r.error) for r in c.fetched(df).collect()}
    for name in ("utf8", "header", "meta"):
        assert got[name] == ("Kafé", "Some té xt", None), name
    assert got["bad"] == ("a�", "b", None) and got["none"] == ("", "", None)
    assert got["pdf"] == got["pdf2"] == (None, None, "pdf-not-read") and got["mojibake"] == (None, None, "unreadable-text")
    large = spark.range(1).select(F.lit("u").alias("url"), F.lit("").alias("content_type"), F.repeat(F.lit("x"), c.MOST_BYTES + 1).cast("binary").alias("body"))
    assert c.fetched(large).first().error == f"response-too-large:{c.MOST_BYTES + 1}"


def test_supplied_and_loaded(spark):
    own = c.supplied(spark.createDataFrame([("http://x", "text", 5)], "url string, text string, extra int"), F.lit("2020")).first()
    assert (own.final_url, own.provenance, own.http_status, own.title, own.text, own.error, own.extra) == ("http://x", "agent", None, "", "text", None, 5)
    files = [("a", json.dumps({"url": "u", "http_status": 200, "text": "t", "more": [1]})), ("b", "[1]"), ("c", "{broken"), ("d", json.dumps({"url": 5, "http_status": True})), ("e", json.dumps({"http_status": "200"})), ("g", None)]
    keys = spark.createDataFrame([(k, "mine") for k in "abcdefg"], "key string, content string")
    got = {r.key: r.capture for r in c.loaded(keys, spark.createDataFrame(files, "key string, content string")).collect()}
    assert len(got) == 7 and all(got[k] is None for k in "bcfg")
    assert (got["a"].url, got["a"].http_status, got["a"].text, got["a"].error, got["a"].sound) == ("u", 200, "t", None, True)
    assert (got["d"].url, got["d"].http_status, got["d"].sound) == (None, None, False) and (got["e"].http_status, got["e"].sound) == (None, False)


def test_verdicts(spark):
    good = {"schema_version": 1, "resolved": True, "h_index": 3, "is_core": False, "is_in_doaj": False, "fetched_at": 100}
    cases = {
        "flag": (good, 0, ("ok", True, True)), "old flag": ({**good, "fetched_at": 10.5}, 0, ("ok", True, False)), "flag undated": ({**good, "fetched_at": True}, 0, ("ok", True, False)), "clear": ({**good, "h_index": 15}, 50, ("ok", False, True)),
        "clear old": ({**good, "h_index": None}, 51, ("ok", False, False)), "future": ({**good, "is_core": True}, -1, ("ok", False, False)), "bool h": ({**good, "h_index": True}, 0, ("h_index", False, False)), "text h": ({**good, "h_index": "3"}, 0, ("h_index", False, False)),
        "part h": ({**good, "h_index": 3.5}, 0, ("h_index", False, False)), "int core": ({**good, "is_core": 0}, 0, ("is_core", False, False)), "text doaj": ({**good, "is_in_doaj": "false"}, 0, ("is_in_doaj", False, False)),
        "unresolved": ({"schema_version": 1, "resolved": False, "h_index": "x"}, 0, ("ok", False, True)), "version": ({**good, "schema_version": 2}, 0, ("version", False, False)), "text version": ({**good, "schema_version": "1"}, 0, ("version", False, False)),
        "no version": ({"resolved": True}, 0, ("version", False, False)), "int resolved": ({**good, "resolved": 1}, 0, ("resolved", False, False)), "list": ([1], 0, ("no_object", False, False)),
    }
    df = spark.createDataFrame([(k, json.dumps(v), age) for k, (v, age, _) in cases.items()] + [("null", None, 0), ("broken", "{", 0)], "name string, content string, age int")
    got = {r.name: (r["shape"], r.flagged, r.usable) for r in c.verdicts(df, F.lit(130), 50, 40).collect()}
    assert got == {k: v[2] for k, v in cases.items()} | {"null": ("no_object", False, False), "broken": ("no_object", False, False)}


def test_statistics_and_values(spark):
    files = spark.sql("SELECT * FROM VALUES ('a', 10L, timestamp_seconds(100)), ('a', 5L, timestamp_seconds(160)), ('b', 1L, timestamp_seconds(150)) AS t(source, length, modificationTime)")
    one = c.cache_statistics(files, F.lit(200)).first()
    assert (one.entry_count, one.total_bytes, one.oldest_age, one.newest_age) == (3, 16, 100.0, 40.0)
    assert {r.source: (r.entry_count, r.oldest_age) for r in c.cache_statistics(files, F.lit(200), ["source"]).collect()} == {"a": (2, 100.0), "b": (1, 50.0)}
    none = c.cache_statistics(files.limit(0), F.lit(200)).first()
    assert (none.entry_count, none.total_bytes, none.oldest_age) == (0, 0, None)
    df = spark.createDataFrame([("free-will", " As {Smith}\n (2001)  says ")], "s string, p string")
    assert df.select(c.context_value(F.col("s"), F.col("p")).alias("v")).first().v == "Cited in 'free-will' entry: \"As Smith (2001) says\""
