"""Articles told by headings, reviews, and pages that are neither."""

from pyspark.sql import functions as F

from citeloom.sources import outlines as o

ARTICLE = """<html><head><title>Free Will | Site</title><meta name="author" content="Meta Name"></head><body>
<div class="toc-box"><a href="#a">One</a> <a href="/x">out</a> <a href="#b">Two</a></div>
<article><h1 class="entry-title">Free <i>Will</i></h1><p>First <b>part</b>.<p>Second.</p><div><p>not direct</p></div>
<ol class="myTOC"><li><a href="#a">One</a></ol><p>after the list</p>
<h2>1. Begin</h2><p>b1</p><blockquote><p>quoted</p></blockquote><p>b2</p>
<h3>a. Inner</h3><p>i1</p><h4>Deep</h4><h3>b. Inner</h3>
<h2>2. Next</h2><div><p>n1</p></div>
<h2>References and Further Reading</h2><p>short</p><p>A paragraph that is long enough.</p>
<ul><li>Smith, A., 1999, <i>Minds</i>, Oxford.<ul><li>nested</li></ul></li><li>   </li><li>odd line</li><li>Lee, C., 2001, 'On Minds', <b>Oxford: OUP</b>.</li></ul><p>After the list, a long paragraph.</p>
<h2>Author Information</h2><p>Ann Lee<br>Email: <a href="mailto:a">ann@uni.edu</a></p><h2>Empty</h2></article></body></html>"""
LONG = "This paragraph is long enough to count as one of substance"
REVIEW = f"""<meta property="article:published_time" content="2020-05-06T07:08"><main><p class="ByLine">Reviewed by Bo</p>
<div class="x Post-Content"><p>short</p><p>[{LONG}</p><p>({LONG})</p><p>({LONG}) and on</p>{"".join(f"<p>{LONG} {i}</p>" for i in range(9))}</div><p>{LONG} outside</p></main>"""


def read(spark, *pages):
    return o.outlines(spark.createDataFrame(list(enumerate(pages)), "page_id int, html string"))


def test_article(spark):
    r = read(spark, ARTICLE)
    p = o.with_parts(r).first()
    assert (p.title, p.preamble, p.author, p.email, p.error) == ("FreeWill", "First part . Second.", "Ann LeeEmail:ann@uni.edu", "ann@uni.edu", None)
    assert [tuple(x) for x in p.toc] == [("1", "One", 1), ("3", "Two", 1)]
    got = [tuple(x)[1:] for x in o.sections(r, "page_id").orderBy("section").collect()]
    assert got == [
        (1, 2, None, 4, "1. Begin", "b1 b2"), (2, 3, 1, 3, "a. Inner", "i1"), (3, 4, 2, 3, "Deep", ""), (4, 3, 1, 4, "b. Inner", ""), (5, 2, None, 5, "2. Next", "n1"),
        (6, 2, None, 6, "References and Further Reading", "short A paragraph that is long enough. After the list, a long paragraph."), (7, 2, None, 7, "Author Information", "Ann Lee Email: ann@uni.edu"),
    ]
    lines = o.bibliography_lines(r, "page_id").orderBy("line_no").collect()
    assert [x.raw for x in lines] == ["A paragraph that is long enough.", "Smith, A., 1999, Minds , Oxford. nested", "odd line", "Lee, C., 2001, 'On Minds', Oxford: OUP ."]
    assert [x.parsed.confidence for x in lines] == ["unparseable", "unparseable", "unparseable", "high"]


def test_review(spark):
    r = o.reviews(read(spark, REVIEW)).first()
    assert (r.reviewer, r.review_date, r.paragraph_count) == ("Reviewed by Bo", "2020-05-06", 8)
    assert r.paragraphs == [f"({LONG}) and on", *[f"{LONG} {i}" for i in range(7)]] and r.summary_text == "\n\n".join(r.paragraphs)
    dated = o.reviews(read(spark, '<time datetime="2001-01-02">x</time>', "<time>May 3</time>", "<article><p>" + LONG)).orderBy("page_id").collect()
    assert [(x.review_date, x.paragraph_count) for x in dated] == [("2001-01-02", 0), ("May 3", 0), (None, 1)]


def test_pages_that_are_neither(spark):
    r = read(spark, None, "", "plain", "<![foo[bar]]>", "<article>", "</p></li><li><p>a<li>b", "<article><h2>One</h2><p>x" + "<p>y" * 20000)
    parts = o.with_parts(r).orderBy("page_id").collect()
    assert [x.preamble for x in parts] == [None] * 7 and parts[0].title is None and [x.error is None for x in parts] == [True, True, True, False, True, True, True]
    assert [len(x.content) for x in o.sections(r, "page_id").collect()] == [40001] and o.bibliography_lines(r, "page_id").count() == 0
    assert all(x.paragraph_count == 0 for x in o.reviews(r).collect())


def test_clashing_columns_and_no_pages(spark):
    df = spark.createDataFrame([(1, ARTICLE, "own", "mine", 3)], "page_id int, html string, title string, toc string, extra int")
    got = o.with_parts(o.outlines(df))
    assert got.first().title == "FreeWill" and got.first().extra == 3 and got.columns.count("toc") == 1
    none = o.outlines(df.limit(0))
    assert o.with_parts(none).count() == o.sections(none, "page_id").count() == o.reviews(none).count() == 0
