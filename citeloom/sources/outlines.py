"""Articles whose sections are told by headings alone, and reviews.

A page is read once, into its blocks: headings, paragraphs, lists and their
items in the order in which they open, each with the number of its parent. An
element's subtree is the interval of numbers up to its end, so what lies in what
is a comparison of numbers. Sections, their tree, bibliography and reviews are
taken from blocks by Spark.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeloom.functions.keys import let
from citeloom.operators.bibliography import parsed_line
from citeloom.sources.html import VOID, _fed

HEADS = ("h2", "h3", "h4")
TAKEN = {"h1", *HEADS, "p", "ul", "ol", "li", "time"}
#: Elements that end an open paragraph.
ENDS_P = TAKEN - {"time"} | {"div", "section", "article", "main", "nav", "header", "footer", "aside", "blockquote", "table", "pre", "form", "dl", "figure", "address", "fieldset", "h5", "h6", "hr"}
#: Words of a heading over a bibliography; the least length of its paragraphs.
BIBLIOGRAPHY, LEAST_LINE = ("bibliography", "references", "works cited", "further reading"), 21
#: How many paragraphs a review's summary has, and the least length of one.
PARAGRAPHS, LEAST_PARAGRAPH = 8, 50
#: Bytes of pages that a task parses before it hands their blocks on.
SLICE = 4 << 20

BLOCK = T.StructType([T.StructField(n, T.IntegerType()) for n in ("no", "end", "parent", "place")] + [T.StructField(n, T.StringType()) for n in ("tag", "above", "mark", "text", "tight")])
ROOT = T.StructType([T.StructField(n, T.IntegerType()) for n in ("no", "end")])
NEW = {"title": T.StringType(), "blocks": T.ArrayType(BLOCK), "roots": T.MapType(T.StringType(), ROOT), "meta": T.MapType(T.StringType(), T.StringType()), "error": T.StringType()}
_BLOCK = pa.struct([(n, pa.int32()) for n in ("no", "end", "parent", "place")] + [(n, pa.string()) for n in ("tag", "above", "mark", "text", "tight")])
_NEW = {"title": pa.string(), "blocks": pa.list_(_BLOCK), "roots": pa.map_(pa.string(), pa.struct([("no", pa.int32()), ("end", pa.int32())])), "meta": pa.map_(pa.string(), pa.string()), "error": pa.string()}


def _roots(tag: str, classes: str) -> list[str]:
    """Names under which an element may be the one that holds an article, a review or the contents."""
    words, low = classes.split(), classes.lower()
    names = [tag] if tag in ("article", "main") else []
    if tag == "div":
        names += [n for n in ("entry-content", "content") if n in words]
        names += ["review"] if re.search("entry-content|review-content|post-content|article-content", low) else []
    return names + ([f"toc-{tag}"] if tag in ("div", "nav", "ol") and "toc" in low else [])


class _Blocks(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[list] = []  # number, tag, block or None, children so far
        self.count, self.hidden, self.top = 0, 0, 0
        self.blocks, self.parts, self.roots, self.meta, self.title = [], [], {}, {}, []
        self.open_roots: dict[int, list[str]] = {}
        self.open_blocks: list[int] = []
        self.places: dict[str, list[int]] = {}  # of a tag's open elements in the stack
        self.head_in_item = False

    def handle_starttag(self, tag, attrs):
        attrs = {k: v or "" for k, v in attrs}
        if tag == "meta":
            name = attrs.get("name") if attrs.get("name") == "author" else attrs.get("property")
            if name in ("author", "article:published_time") and "content" in attrs:
                self.meta.setdefault(name, attrs["content"])
        if tag in ENDS_P and (p := self._last("p")) is not None:
            self._close(p)
        if tag == "li" and (item := self._last("li")) is not None and item > max(self._last("ul") or -1, self._last("ol") or -1):
            self._close(item)
        if tag in HEADS and self.stack and self.stack[-1][1] in HEADS:
            self._close(len(self.stack) - 1)
        self.head_in_item = bool(self.places.get("li")) and (self.head_in_item or tag in HEADS)
        self.count += 1
        above = self.stack[-1] if self.stack else None
        place = above[3] if above else self.top
        if above:
            above[3] += 1
        else:
            self.top += 1
        if tag in VOID:
            return
        classes = attrs.get("class", "")
        names = [n for n in _roots(tag, classes) if n not in self.roots]
        for n in names:
            self.roots[n] = {"no": self.count, "end": None}
        if names:
            self.open_roots[self.count] = names
        taken = tag in TAKEN or (tag == "a" and any(n.startswith("toc-") for o in self.open_roots.values() for n in o))
        index = None
        if taken:
            index = len(self.blocks)
            mark = attrs.get("href", "") if tag == "a" else attrs.get("datetime", "") if tag == "time" else classes
            self.blocks.append({"no": self.count, "end": None, "parent": above[0] if above else 0, "place": place, "tag": tag, "above": above[1] if above else "", "mark": mark})
            self.parts.append([])
            # A list's text is its items', that of an item inside an item the outer one's: only where a heading
            # stands in the outer one can the inner list be a bibliography.
            if tag not in ("ul", "ol") and (tag != "li" or not self.places.get("li") or self.head_in_item):
                self.open_blocks.append(index)
        self.places.setdefault(tag, []).append(len(self.stack))
        self.stack.append([self.count, tag, index, 0])
        self.hidden += tag in ("script", "style")

    def _last(self, tag):
        places = self.places.get(tag)
        return places[-1] if places else None

    def _close(self, at):
        while len(self.stack) > at:
            no, tag, index, _ = self.stack.pop()
            self.places[tag].pop()
            self.hidden -= tag in ("script", "style")
            for n in self.open_roots.pop(no, ()):
                self.roots[n]["end"] = self.count
            if index is not None:
                self.blocks[index]["end"] = self.count
                if self.open_blocks and self.open_blocks[-1] == index:
                    self.open_blocks.pop()

    def handle_endtag(self, tag):
        at = self._last(tag)
        if at is not None:
            self._close(at)

    def handle_data(self, data):
        text = data.strip()
        if not text or self.hidden:
            return
        if self.stack and self.stack[-1][1] == "title":
            self.title.append(text)
        for i in self.open_blocks:
            self.parts[i].append(text)


def _outline(page: str | None) -> dict:
    reader = _Blocks()
    error = _fed(reader, page)
    reader._close(0)
    blocks = [b | {"text": " ".join(p), "tight": "".join(p) if len(p) > 1 else None} for b, p in zip(reader.blocks, reader.parts)]
    h1 = [(b["mark"].split(), b["tight"] or b["text"]) for b in blocks if b["tag"] == "h1"]
    title = next((t for marks, t in h1 if "entry-title" in marks), None) or next((t for _, t in h1), None) or "".join(reader.title) or None
    return {"title": title, "blocks": blocks, "roots": list(reader.roots.items()), "meta": list(reader.meta.items()), "error": error}


def _pieces(batch: pa.RecordBatch, column: str):
    """The batch in slices whose pages have about SLICE bytes; a longer page is a slice of its own."""
    lengths = pa.compute.binary_length(batch.column(column)).to_pylist()
    start = size = 0
    for i, n in enumerate(lengths):
        if i > start and size + (n or 0) > SLICE:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n or 0
    if len(lengths) > start:
        yield batch.slice(start)


def outlines(pages: DataFrame, column: str = "html") -> DataFrame:
    """pages without the html, with title, blocks, roots (elements that may hold the article), meta and error.

    Null and empty pages have no blocks and a null title. Columns of the same
    names as the new ones are replaced. error: what stopped the parser, null if
    nothing did; blocks then are those before that place.
    """
    keep = [c for c in pages.columns if c not in (column, *NEW)]
    schema = pages.select(*keep).schema
    for name, kind in NEW.items():
        schema = schema.add(name, kind)

    def run(batches):
        for batch in (part for whole in batches for part in _pieces(whole, column)):
            found = [_outline(x) for x in batch.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), *(pa.array([f[n] for f in found], kind) for n, kind in _NEW.items())], names=[*keep, *NEW])

    return pages.select(*keep, column).mapInArrow(run, schema)


def _tight(b: Column) -> Column:
    """A block's pieces of text without anything between them; kept apart only where there are several."""
    return F.coalesce(b["tight"], b["text"])


def _root(*names: str) -> Column:
    return F.coalesce(*[F.try_element_at("roots", F.lit(n)) for n in names])


def _in(root: Column, b: Column) -> Column:
    return (b["no"] > root["no"]) & (b["no"] <= root["end"])


def _first(blocks: Column, test) -> Column:
    return F.get(F.filter(blocks, test), F.lit(0))


def _after(heading: Column) -> Column:
    """The element next to a heading, if it is a block."""
    return _first(F.col("blocks"), lambda b: (b["parent"] == heading["parent"]) & (b["place"] == heading["place"] + 1))


def with_parts(read: DataFrame) -> DataFrame:
    """Outlines with preamble, toc (id, title, level), author and email of an article.

    The preamble is the paragraphs directly in the article before its first
    heading or list of contents, null if there are none. The article is the
    first `article`, else the first division `entry-content`.
    """
    root = _root("article", "entry-content")
    own = F.filter("blocks", lambda b: _in(root, b) & (b["parent"] == root["no"]))
    listed = lambda b: b["tag"].isin("ol", "ul") & F.contains(F.lower(b["mark"]), F.lit("toc"))
    ends = F.coalesce(_first(own, lambda b: b["tag"].isin(*HEADS) | listed(b))["no"], F.lit(2**31 - 1))
    before = let(ends, lambda end: F.filter(own, lambda b: (b["tag"] == "p") & (b["text"] != "") & (b["no"] < end)))
    contents = _root("toc-div", "toc-nav", "toc-ol")
    links = F.transform(F.filter("blocks", lambda b: (b["tag"] == "a") & _in(contents, b)), lambda b, i: F.struct((i + 1).cast("string").alias("id"), _tight(b).alias("title"), F.lit(1).alias("level"), b["mark"].alias("mark")))
    toc = F.transform(F.filter(links, lambda x: F.startswith(x["mark"], F.lit("#"))), lambda x: F.struct(x["id"].alias("id"), x["title"].alias("title"), x["level"].alias("level")))
    over = _first(F.col("blocks"), lambda b: b["tag"].isin(*HEADS) & F.contains(F.lower(_tight(b)), F.lit("author")))
    staged = read.withColumn("preamble", F.nullif(F.array_join(F.transform(before, lambda b: b["text"]), " "), F.lit(""))).withColumn("toc", toc)
    staged = staged.withColumn("__next", let(over, _after))
    said = F.when(F.col("__next.tag") == "p", _tight(F.col("__next")))
    email = F.nullif(F.regexp_extract(said, r"[\w.-]+@[\w.-]+\.\w+", 0), F.lit(""))
    return staged.withColumn("author", F.coalesce(said, F.try_element_at("meta", F.lit("author")))).withColumn("email", email).drop("__next")


def sections(read: DataFrame, key: str) -> DataFrame:
    """key, section (from 1), level, parent, last, title, content of every section of outlines with unique keys.

    A section reaches from its heading to the next one; parent is the nearest
    section before it of a higher level (null: none), last the last section
    inside it, so `section BETWEEN n AND last` is the subtree of n. Paragraphs
    inside paragraphs or quotations do not count twice; a last heading without
    any paragraph is no section.
    """
    root = _root("article", "entry-content")
    rows = read.select(key, F.explode(F.filter("blocks", lambda b: _in(root, b) & (b["tag"].isin(*HEADS) | ((b["tag"] == "p") & ~b["above"].isin("p", "blockquote") & (b["text"] != ""))))).alias("b")).select(key, "b.no", "b.tag", "b.text", _tight(F.col("b")).alias("tight"))
    head = F.col("tag").isin(*HEADS)
    w = Window.partitionBy(key).orderBy("no")
    numbered = rows.withColumn("section", F.sum(head.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).filter("section > 0")
    # Each section's parts, not the page's: a section is one row.
    parts = F.transform(F.array_sort(F.collect_list(F.when(~head, F.struct("no", "text")))), lambda p: p["text"])
    each = numbered.groupBy(key, "section").agg(F.max(F.when(head, F.substring("tag", 2, 1).cast("int"))).alias("level"), F.max(F.when(head, F.col("tight"))).alias("title"), F.trim(F.array_join(parts, " ")).alias("content"))
    by = Window.partitionBy(key).orderBy("section")  # one specification: one sort serves all that follows
    so_far, to_come, all_ = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(1, Window.unboundedFollowing), by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    up = lambda top: F.max(F.when(F.col("level") < top, F.col("section"))).over(so_far)
    down = lambda top: F.min(F.when(F.col("level") <= top, F.col("section"))).over(to_come)
    pick = lambda f: F.when(F.col("level") == 2, f(2)).when(F.col("level") == 3, f(3)).otherwise(f(4))
    total, full = F.max("section").over(all_), F.max(F.when(F.col("content") != "", F.col("section"))).over(all_)
    ends = each.select(key, "section", "level", pick(up).cast("int").alias("parent"), pick(down).alias("__next"), (total - F.coalesce((full < total).cast("int"), F.lit(1))).alias("__kept"), "title", "content")
    return ends.filter("section <= __kept").select(key, F.col("section").cast("int").alias("section"), "level", "parent", F.coalesce(F.col("__next") - 1, F.col("__kept")).cast("int").alias("last"), "title", "content")


def bibliography_lines(read: DataFrame, key: str) -> DataFrame:
    """key, line_no (from 1), raw, parsed of the bibliography of outlines.

    It stands beside the first heading that names one: paragraphs of over 20
    characters up to the next heading, and the items of the first bulleted list,
    which ends it. parsed: what operators/bibliography reads in the line, with
    its confidence.
    """
    heading = _first(F.col("blocks"), lambda b: b["tag"].isin(*HEADS) & F.exists(F.array(*map(F.lit, BIBLIOGRAPHY)), lambda k: F.contains(F.lower(_tight(b)), k)))

    def listed(h: Column) -> Column:
        beside = F.filter("blocks", lambda b: (b["parent"] == h["parent"]) & (b["no"] > h["no"]))
        stop = F.coalesce(_first(beside, lambda b: b["tag"].isin("ul", *HEADS)), F.struct(*[F.lit(2**31 - 1 if n == "no" else None).cast(BLOCK[n].dataType).alias(n) for n in BLOCK.names]))
        return let(stop, lambda s: F.transform(F.filter("blocks", lambda b: F.coalesce(line(h, s, b) | item(s, b), F.lit(False))), lambda b: b["text"]))

    line = lambda h, s, b: (b["parent"] == h["parent"]) & (b["no"] > h["no"]) & (b["tag"] == "p") & (F.length(b["text"]) >= LEAST_LINE) & (b["no"] < s["no"])
    item = lambda s, b: (s["tag"] == "ul") & (b["tag"] == "li") & (b["parent"] == s["no"]) & (b["text"] != "")
    staged = read.select(key, "blocks")
    found = let(heading, listed)
    each = staged.select(key, F.posexplode(found).alias("i", "raw"))
    return each.select(key, (F.col("i") + 1).alias("line_no"), "raw", parsed_line(F.col("raw")).alias("parsed"))


def reviews(read: DataFrame) -> DataFrame:
    """Outlines with reviewer, review_date, paragraphs (the first 8 of substance), paragraph_count and summary_text.

    A paragraph has substance if it has 50 characters or more, does not begin
    with a bracket and does not stand in round ones.
    """
    root = _root("review", "article", "content", "main")
    plain = lambda b: ~F.startswith(_tight(b), F.lit("[")) & ~(F.startswith(_tight(b), F.lit("(")) & F.endswith(_tight(b), F.lit(")")))
    kept = F.filter("blocks", lambda b: (b["tag"] == "p") & _in(root, b) & (F.length(_tight(b)) >= LEAST_PARAGRAPH) & plain(b))
    paragraphs = F.coalesce(F.slice(F.transform(kept, lambda b: _tight(b)), 1, PARAGRAPHS), F.array().cast("array<string>"))
    meta = lambda name: F.nullif(F.try_element_at("meta", F.lit(name)), F.lit(""))
    byline = _first(F.col("blocks"), lambda b: (b["tag"] == "p") & F.rlike(F.lower(b["mark"]), F.lit("byline|author|reviewer")))
    time = _first(F.col("blocks"), lambda b: b["tag"] == "time")
    dated = F.coalesce(F.substring(meta("article:published_time"), 1, 10), F.nullif(time["mark"], F.lit("")), _tight(time))
    out = read.withColumn("reviewer", F.coalesce(meta("author"), _tight(byline))).withColumn("review_date", dated).withColumn("paragraphs", paragraphs)
    return out.withColumn("paragraph_count", F.size("paragraphs")).withColumn("summary_text", F.array_join("paragraphs", "\n\n"))
