"""Bibliography files, envelopes, ledgers and pages."""

from pyspark.sql import functions as F

from citeloom.sources import bibtex, envelopes, html

BIB = """﻿@comment{nothing}

@Article{smith2001,
  author = {Smith, Ada and {The Royal Society}},
  title = {A {Deep} Title},
  journal = "Mind",
  year = 2001,
  note = {},
  note = {x = {y}},
}
@book{jones1999,
  editor = {Jones, B.},
  title = {Book},
  year = {1999},
  date = {1999},
}
@article{smith2001,
  title = {Again},
  title = {Twice},
}
text without header
"""


def parsed(spark):
    texts = spark.createDataFrame([("a.bib", 0, BIB)], "bib_file string, file_ord int, content string")
    return texts, bibtex.parse(texts)


def test_entries(spark):
    _, entries = parsed(spark)
    rows = entries.orderBy("entry_ord").collect()
    assert [(r.entry_type, r.key) for r in rows] == [(None, None), ("article", "smith2001"), ("book", "jones1999"), ("article", "smith2001")]
    one = rows[1].fields
    assert (one["title"], one["journal"], one["year"], one["note"]) == ("A {Deep} Title", "Mind", "2001", "x = {y}")


def test_files_in_argument_order(spark, tmp_path):
    for name in ("z.bib", "a.bib"):
        (tmp_path / name).write_text("@misc{k, title = {T}}")
    texts = bibtex.read_texts(spark, [f"{tmp_path}/z.bib", f"{tmp_path}/a.bib"])
    assert [r.bib_file for r in bibtex.parse(texts).orderBy("file_ord").collect()] == [f"{tmp_path}/z.bib", f"{tmp_path}/a.bib"]


def test_people(spark):
    df = spark.createDataFrame([("Smith, Ada and Bo Li",), ("{The Royal Society}",)], "a string")
    got = [r.p for r in df.select(bibtex.people(F.col("a")).alias("p")).collect()]
    assert [[(x.family, x.given) for x in p] for p in got] == [[("Smith", "Ada"), ("Li", "Bo")], [("The Royal Society", None)]]


def test_checks(spark):
    texts, entries = parsed(spark)
    assert [(r.key, r.line_no, r.first_line) for r in bibtex.duplicate_keys(texts).collect()] == [("smith2001", 17, 3)]
    assert sorted((r.key, r.field) for r in bibtex.duplicate_fields(texts).collect()) == [("smith2001", "note"), ("smith2001", "title")]
    found = {(r.key, r.rule, r.detail) for r in bibtex.field_violations(entries).collect()}
    assert ("jones1999", "required", "publisher") in found and ("jones1999", "renamed", "date") in found
    assert not any(d == "author or editor" for k, _, d in found if k == "jones1999")


def test_text_parses_to_the_same_entries(spark):
    _, entries = parsed(spark)
    texts = bibtex.to_text(entries).withColumn("file_ord", F.lit(0))
    again = bibtex.parse(texts)
    view = lambda df: sorted((r.key, tuple(sorted(r.fields.items()))) for r in df.filter("key IS NOT NULL").collect())
    assert view(again) == view(entries)


def test_envelopes(spark):
    crossref = '{"source": "crossref", "results": [{"title": "T", "container_title": "J", "page": "1-2", "year": 2001, "year_basis": "print", "doi": "10.1/x"}]}'
    files = [
        ("x.json", crossref),
        ("verify_a.json", 'log {"a": 1}\n' + crossref.replace('"crossref"', '""') + "\nbye"),
        ("oa.json", '{"source": "openalex", "results": [{"title": "O", "biblio": {"first_page": "3", "last_page": "3"}, "publication_year": 1999}, {"title": "P"}]}'),
        ("s.json", '{"source": "semantic_scholar", "results": [{"title": "S", "journal": {"name": "N", "volume": "4"}}, {"title": "V", "venue": "W"}]}'),
        ("arxiv.json", '{"source": "arxiv", "results": [{"title": "X", "published": "2012-01-01"}]}'),
        ("bad.json", '{"source": "core", "results": [{"ti'),
        ("x.json", crossref),
    ]
    pooled = envelopes.pool(spark.createDataFrame(files, "file string, content string")).cache()
    assert {r.file: (r.status, r.producer) for r in pooled.collect()} == {"x.json": ("read", "crossref"), "verify_a.json": ("salvaged", "crossref"), "oa.json": ("read", "openalex"), "s.json": ("read", "s2"), "arxiv.json": ("read", "arxiv"), "bad.json": ("skipped", "core") if False else ("skipped", "unknown")}
    rows = {r.title: r for r in envelopes.records(pooled.filter("file != 'verify_a.json'")).collect()}
    assert (rows["T"].container_title, rows["T"].pages, rows["T"].year, rows["T"].entry_scoped, rows["T"].doi) == ("J", "1-2", "2001", True, "10.1/x")
    assert (rows["O"].pages, rows["O"].year, rows["O"].entry_scoped) == ("3", "1999", False)
    assert (rows["S"].container_title, rows["S"].volume, rows["V"].container_title, rows["X"].year) == ("N", "4", "W", "2012")


def test_ledgers(spark):
    files = [("a.bib", '{"schema_version": 1, "bib_file": "a.bib", "entries": {}}'), ("b.bib", '{"schema_version": 1, "bib_file": "a.bib", "entries": {}}'), ("c.bib", "[]")]
    expected = spark.createDataFrame([("a.bib",), ("b.bib",), ("c.bib",), ("d.bib",)], "bib_file string")
    got = envelopes.ledger_state(spark.createDataFrame(files, "bib_file string, content string"), expected)
    assert {r.bib_file: r.state for r in got.collect()} == {"a.bib": "present", "b.bib": "malformed", "c.bib": "malformed", "d.bib": "missing"}


def test_pages(spark):
    page = "<title> A  b </title><script>no</script><h1>Head</h1><p>One &amp; two</p><h2 id='s1'>Sub</h2><a href='/entries/x'>l</a>"
    df = spark.createDataFrame([(1, page), (2, None), (3, "<h1>Only</h1>")], "page_id long, html string")
    rows = html.related_entries(html.articles(df)).orderBy("page_id").collect()
    assert (rows[0].title, rows[0].text, rows[0].related) == ("A b", "Head One & two Sub l", ["/entries/x"])
    assert [(h.level, h.id, h.text) for h in rows[0].headings] == [(1, None, "Head"), (2, "s1", "Sub")]
    assert (rows[1].title, rows[1].text, rows[2].title) == ("", "", "Only")


ARTICLE = """<html><body><div id="preamble"><p>First &amp; <em>last</em>.</p></div>
<div id="toc"><ul><li><a href="#1">1. One</a></li><li><a href="#1.1">1.1 Sub</a></li><li><a href="#b">Bibliography</a></li><li><a href="http://x">2. No</a></li></ul></div>
<div id="main-text"><h2>1. One</h2><p>Alpha <i>beta</i><br>gamma.</p><div><p>inside</p></div><p>More.</p><h3>1.1. Sub</h3><p>Delta.</p><h2>Notes</h2><p>left out</p></div>
<div id="bibliography"><ul><li>A., 2001, <em>T</em>, P.</li><li>B., 2002.</li></ul></div>
<div id="related-entries"><a href="../../entries/mind/">mind</a> <a href="/other/">x</a></div></body></html>"""


def test_parts_of_articles_and_sitemaps(spark):
    from citeloom.sources import html

    pages = spark.createDataFrame([(1, ARTICLE, "clash"), (2, None, "c"), (3, "<p>no article", "c"), (4, "", "c")], "page_id int, html string, toc string")
    parts = {r.page_id: r for r in html.article_parts(pages).collect()}
    one = parts[1]
    assert one.preamble == "First & last ."
    assert [(x.id, x.title, x.level) for x in one.toc] == [("1", "One", 2), ("1.1", "Sub", 2)]
    assert [(x.id, x.title, x.content) for x in one.sections] == [("1", "One", "Alpha beta gamma. More."), ("1.1", "Sub", "Delta.")]
    assert one.bibliography == ["A., 2001, T , P.", "B., 2002."] and one.related == ["mind"]
    assert all((parts[i].preamble, parts[i].sections, parts[i].bibliography) == (None, [], []) for i in (2, 3, 4))
    some = html.projected(html.article_parts(pages), ["1.1"], preamble=False).filter("page_id = 1").first()
    assert [s.id for s in some.sections] == ["1.1"] and "preamble" not in some.asDict()
    maps = spark.createDataFrame([("a", "<loc>https://x.org/reviews/being-and-time/</loc><loc>https://x.org/about/</loc><loc>https://x.org/reviews/mind</loc><loc>https://x.org/reviews/mind/</loc>"), ("b", None)], "file string, content string")
    assert sorted((r.slug, r.ord) for r in html.sitemap_slugs(maps).collect()) == [("being-and-time", 0), ("mind", 1)]


def test_one_bad_page_ends_nothing(spark):
    bad = ["<title>T</title><p>before <![foo[bar]]> after", "<li>open <div id='bibliography'>text <ul><li>A. 2001</li></ul></div>", "<![CDATA[<p>x", "<!DOCTYPE [<!x", "&#xffffffffff; <p>fine"]
    pages = spark.createDataFrame([(i, b, 1) for i, b in enumerate(bad)] + [(9, "<title>Good</title>", 1)], "page_id int, html string, error int")
    read = {r.page_id: r for r in html.articles(pages).collect()}
    parts = {r.page_id: r for r in html.article_parts(pages).collect()}
    assert len(read) == len(parts) == 6 and read[9].title == "Good" and read[9].error is None
    assert read[0].error.startswith("AssertionError") and read[0].title == "T" and "before" in read[0].text
    assert parts[1].error is None and parts[1].bibliography == ["A. 2001"]
