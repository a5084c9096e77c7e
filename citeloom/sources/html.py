"""Titles, text, headings and links of web pages."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

HIDDEN = {"script", "style", "noscript"}


class _Reader(HTMLParser):
    """Collects what Article needs while a page is read once."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.hidden, self.open, self.title, self.heads, self.text, self.links = 0, [], "", [], [], []

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in HIDDEN
        if tag in ("title", "h1", "h2", "h3", "h4"):
            self.open.append(tag)
            if tag != "title":
                self.heads.append([tag, dict(attrs).get("id"), ""])
        if tag == "a" and (href := dict(attrs).get("href")):
            self.links.append(href)

    def handle_endtag(self, tag):
        self.hidden = max(0, self.hidden - (tag in HIDDEN))
        if tag in self.open:
            self.open.remove(tag)

    def handle_data(self, data):
        if self.hidden:
            return
        if "title" in self.open:
            self.title += data
            return
        if self.open:
            self.heads[-1][2] += data
        self.text.append(data)


def _fed(reader: HTMLParser, page: str | None) -> str | None:
    """Feeds the page; what stopped the parser, if anything did: then the page is known up to there."""
    try:
        reader.feed(page or "")
        reader.close()
    except (AssertionError, IndexError, ValueError) as error:  # one bad page of a crawl must not end the job
        return f"{type(error).__name__}: {error}"[:200]
    return None


def _read(page: str | None) -> tuple[str, str, list[dict], list[str], str | None]:
    reader = _Reader()
    error = _fed(reader, page)
    clean = lambda s: " ".join(s.split())
    heads = [{"level": int(t[1]), "id": i, "text": clean(x)} for t, i, x in reader.heads]
    title = clean(reader.title) or next((h["text"] for h in heads if h["level"] == 1), "")
    return title, clean(" ".join(reader.text)), heads, reader.links, error


def articles(pages: DataFrame, column: str = "html") -> DataFrame:
    """pages without the html, with title (else the first h1), text, headings, links and error.

    error: what stopped the parser, null if nothing did; the rest then is what
    stands before that place.
    """
    keep = [c for c in pages.columns if c not in (column, "title", "text", "headings", "links", "error")]
    schema = pages.select(*keep).schema
    head = T.StructType().add("level", "integer").add("id", "string").add("text", "string")
    schema = schema.add("title", "string").add("text", "string").add("headings", T.ArrayType(head)).add("links", T.ArrayType(T.StringType())).add("error", "string")

    names = [*keep, "title", "text", "headings", "links", "error"]
    kinds = [pa.string(), pa.string(), pa.list_(pa.struct([("level", pa.int32()), ("id", pa.string()), ("text", pa.string())])), pa.list_(pa.string()), pa.string()]

    def run(batches):
        for batch in batches:
            found = [_read(x) for x in batch.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), *(pa.array([f[i] for f in found], kind) for i, kind in enumerate(kinds))], names=names)

    return pages.mapInArrow(run, schema)


HEADINGS, VOID = {"h2", "h3", "h4"}, {"br", "hr", "img", "input", "link", "meta", "wbr", "area", "col", "source"}


class _Parts(HTMLParser):
    """Preamble, contents, sections and bibliography of an encyclopedia's article."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, str | None]] = []
        self.preamble: list[str] | None = None
        self.toc, self.items, self.blocks, self.related = [], [], [], []

    def within(self, name: str) -> int | None:
        """How far in the stack the division with that id lies below the top, or None."""
        return next((len(self.stack) - 1 - i for i, (tag, own) in enumerate(self.stack) if tag == "div" and own == name), None)

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            return
        attrs = dict(attrs)
        main = self.within("main-text")
        self.stack.append((tag, attrs.get("id")))
        if main == 0 and (tag in HEADINGS or tag == "p"):
            self.blocks.append((tag, []))
        if tag == "a" and self.within("toc") and attrs.get("href", "").startswith("#"):
            self.toc.append([])
        if tag == "a" and self.within("related-entries") and "/entries/" in attrs.get("href", ""):
            self.related.append(attrs["href"].split("/entries/")[-1].strip("/"))
        if tag == "li" and self.within("bibliography"):
            self.items.append([])
        if tag == "div" and attrs.get("id") == "preamble" and self.preamble is None:
            self.preamble = []

    def handle_endtag(self, tag):
        at = next((i for i in range(len(self.stack) - 1, -1, -1) if self.stack[i][0] == tag), None)
        if at is not None:
            del self.stack[at:]

    def handle_data(self, data):
        text = data.strip()
        tags = [t for t, _ in self.stack]
        if not text or "script" in tags or "style" in tags:
            return
        if self.within("preamble") is not None and self.preamble is not None:
            self.preamble.append(text)
        if self.within("toc") is not None and "a" in tags and self.toc:
            self.toc[-1].append(text)
        if self.within("bibliography") is not None and "li" in tags and self.items:
            self.items[-1].append(text)
        main = self.within("main-text")
        if main and self.blocks and self.stack[len(self.stack) - main][0] == self.blocks[-1][0]:
            self.blocks[-1][1].append(text)


def _parts(page: str | None) -> dict:
    reader = _Parts()
    error = _fed(reader, page)
    squeezed = lambda parts: " ".join(" ".join(parts).split())
    toc, sections, now = [], {}, None
    for parts in reader.toc:
        text = "".join(parts)
        number = re.match(r"[0-9]+(\.[0-9]+)*", text)
        if number:
            toc.append({"id": number[0], "title": text[number.end() :].strip(". "), "level": text.count(".") + 1})
    for tag, parts in reader.blocks:
        if tag == "p":
            if now:
                sections[now]["content"].append(squeezed(parts))
            continue
        heading = re.match(r"([0-9]+(?:\.[0-9]+)*)\.\s*(.+)", "".join(parts))
        now = heading[1] if heading else None
        if heading:
            sections[now] = {"id": now, "title": heading[2], "content": []}
    found = [{**s, "content": " ".join(s["content"]).strip()} for s in sections.values()]
    return {"preamble": None if reader.preamble is None else squeezed(reader.preamble), "toc": toc, "sections": found, "bibliography": [squeezed(x) for x in reader.items], "related": list(dict.fromkeys(reader.related)), "error": error}


def article_parts(pages: DataFrame, column: str = "html") -> DataFrame:
    """pages without the html, with preamble, toc, sections, bibliography (lines), related (names of entries) and error.

    A section is a numbered heading directly in the main text with the
    paragraphs after it; an unnumbered heading ends it. Null and foreign pages
    have a null preamble and empty lists.
    """
    new = {
        "preamble": (T.StringType(), pa.string()),
        "toc": (T.ArrayType(T.StructType().add("id", "string").add("title", "string").add("level", "integer")), pa.list_(pa.struct([("id", pa.string()), ("title", pa.string()), ("level", pa.int32())]))),
        "sections": (T.ArrayType(T.StructType().add("id", "string").add("title", "string").add("content", "string")), pa.list_(pa.struct([("id", pa.string()), ("title", pa.string()), ("content", pa.string())]))),
        "bibliography": (T.ArrayType(T.StringType()), pa.list_(pa.string())),
        "related": (T.ArrayType(T.StringType()), pa.list_(pa.string())),
        "error": (T.StringType(), pa.string()),
    }
    keep = [c for c in pages.columns if c not in (column, *new)]
    schema = pages.select(*keep).schema
    for name, (kind, _) in new.items():
        schema = schema.add(name, kind)

    def run(batches):
        for batch in batches:
            found = [_parts(x) for x in batch.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), *(pa.array([f[n] for f in found], kind) for n, (_, kind) in new.items())], names=[*keep, *new])

    return pages.select(*keep, column).mapInArrow(run, schema)


def projected(parts: DataFrame, section_ids: list[str] | None = None, preamble: bool = True, bibliography: bool = True) -> DataFrame:
    """Article parts with only what is asked for: some sections, with or without preamble and bibliography."""
    out = parts if section_ids is None else parts.withColumn("sections", F.filter("sections", lambda s: s["id"].isin(*section_ids)))
    return out.drop(*([] if preamble else ["preamble"]), *([] if bibliography else ["bibliography"]))


def sitemap_slugs(files: DataFrame, folder: str = "reviews") -> DataFrame:
    """slug, ord of the addresses under a folder in sitemaps (file, content), each slug once at its first place."""
    found = F.regexp_extract_all("content", F.lit(rf"<loc>[^<]*/{folder}/([^/<\s]+)/?\s*</loc>"), F.lit(1))
    each = files.select("file", F.posexplode(found).alias("ord", "slug"))
    return each.groupBy("slug").agg(F.min(F.struct("file", "ord")).alias("at")).select("slug", "at.file", "at.ord")


def related_entries(read: DataFrame) -> DataFrame:
    """Links of articles that lead to other entries."""
    return read.withColumn("related", F.array_distinct(F.filter("links", lambda x: F.contains(x, F.lit("/entries/")))))
