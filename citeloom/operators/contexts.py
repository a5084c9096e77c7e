"""Where articles cite given works, with the sentence and a window of text around each place.

Many works are looked up in many articles at once. One pass over the texts gives
an index of places: the word before a year, the year, and where both stand.
Works join it by word and year, so that a text is read again only if a work may
be cited there, and then once, with all its places; no text is repeated for a
place. There the full forms are compared: `A (y)`, `A y`, `A [y]`, `(A y)`,
`(A, y)`, and for two authors `A and B (y)`, `A & B (y)`, `A and B y`, `(A and B
y)`, `(A & B y)`, without regard to case.

Defined results: null texts have no places; a work without author or year is
found nowhere; years are four digits, perhaps with a letter, or one of OTHER;
one place that two forms begin at counts once, as the first of them; places in
brackets count with their bracket and, where a form allows it, without.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW, TAIL = 500, 200
#: What may stand for a year.
OTHER = ("forthcoming", "n.d.")
_PLACE = re.compile(rf"(?<!\w)(\w+)[^\w\s]{{0,3}}?(?:\s*[(\[]\s*|\s*,\s*|\s+)(\d{{4}}[a-z]?(?!\w)|{'|'.join(map(re.escape, OTHER))})", re.IGNORECASE)
_END = re.compile(r"[.!?]\s+")


def author_name(author: Column) -> Column:
    """What stands before a comma, else the last word; lower case."""
    return F.lower(F.trim(F.when(F.contains(author, F.lit(",")), F.split_part(author, F.lit(","), F.lit(1))).otherwise(F.element_at(F.split(F.trim(author), r"\s+"), -1))))


def places(texts: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """key, word (lower case), year, at, to: every word before a year, from the word's begin to the year's end."""

    def run(batches):
        for batch in batches:
            for i, value in enumerate(batch.column(text).to_pylist()):
                found = [(m[1].lower(), m[2].lower(), m.start(), m.end()) for m in _PLACE.finditer(value or "")]
                if found:
                    own = pa.array([i] * len(found))
                    new = [pa.array(x, kind) for x, kind in zip(zip(*found, strict=True), (pa.string(), pa.string(), pa.int32(), pa.int32()), strict=True)]
                    yield pa.RecordBatch.from_arrays([*(batch.column(k).take(own) for k in key), *new], names=[*key, "word", "year", "at", "to"])

    schema = texts.select(*key).schema.add("word", "string").add("year", "string").add("at", "integer").add("to", "integer")
    return texts.select(*key, text).mapInArrow(run, schema)


def forms(author: str, year: str, coauthor: str | None) -> list[re.Pattern]:
    """The ways in which a work is cited."""
    a, y = re.escape(author), re.escape(year)
    own = [rf"\b{a}\s*\(\s*{y}\s*\)", rf"\b{a}\s+{y}\b", rf"\b{a}\s*\[\s*{y}\s*\]", rf"\(\s*{a}\s+{y}\s*\)", rf"\(\s*{a}\s*,\s*{y}\s*\)"]
    if coauthor:
        both = {"and": rf"{a}\s+and\s+{re.escape(coauthor)}", "&": rf"{a}\s*&\s*{re.escape(coauthor)}"}
        own += [rf"\b{both['and']}\s*\(\s*{y}\s*\)", rf"\b{both['&']}\s*\(\s*{y}\s*\)", rf"\b{both['and']}\s+{y}\b", rf"\(\s*{both['and']}\s+{y}\s*\)", rf"\(\s*{both['&']}\s+{y}\s*\)"]
    return [re.compile(p, re.IGNORECASE) for p in own]


def _around(text: str, at: int, to: int, letters: int) -> tuple[int, int]:
    """From so many characters that are no white space before `at` to the first one after `to`, and one more."""
    begin = at
    while begin and letters:
        begin -= 1
        letters -= not text[begin].isspace()
    end = to
    while end < len(text) and text[end].isspace():
        end += 1
    return begin, min(len(text), end + 2)


def matches(text: str, asked: list[tuple[str, str, str | None]], at: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(number of the work, begin, end) of works cited at the given places."""
    found = {}
    for number, (author, year, coauthor) in enumerate(asked):
        shapes = forms(author, year, coauthor)
        letters = len(author) + len(coauthor or "") + 8
        for one in at:
            begin, end = _around(text, *one, letters)
            for rank, shape in enumerate(shapes):
                for m in shape.finditer(text, begin, end):
                    old = found.get((number, m.start()))
                    if old is None or rank < old[0]:
                        found[number, m.start()] = (rank, m.end())
    return [(number, begin, end) for (number, begin), (_, end) in sorted(found.items())]


class Sentences:
    """Sentences and windows of one text."""

    def __init__(self, text: str):
        self.text = text
        ends = list(_END.finditer(text))
        self.begins, self.stops = [m.start() for m in ends], [m.end() for m in ends]

    def sentence(self, begin: int, end: int) -> str:
        """From the end of the sentence before to the end of this one, or 200 characters on if it has none."""
        i = bisect_right(self.stops, begin)
        j = bisect_right(self.begins, end - 1)
        stop = self.stops[j] if j < len(self.stops) else min(end + TAIL, len(self.text))
        return self.text[self.stops[i - 1] if i else 0 : stop].strip()

    def window(self, begin: int, end: int, width: int) -> str:
        """So many characters on both sides, widened to spaces."""
        start, stop = max(0, begin - width), min(len(self.text), end + width)
        if start > 0 and (space := self.text.rfind(" ", 0, start)) >= 0:
            start = space + 1
        if stop < len(self.text) and (space := self.text.find(" ", stop)) >= 0:
            stop = space
        return self.text[start:stop].strip()


def citation_contexts(texts: DataFrame, works: DataFrame, key: list[str], text: str = "text", width: int = WINDOW) -> DataFrame:
    """key, work, position (characters before it), citation_text, sentence, context of every place where a text cites a work.

    texts: key, text (a section or a whole article, one row each); works: work,
    author, year, coauthor.
    """
    from citeloom.session import written

    asked = works.select("work", author_name(F.col("author")).alias("__author"), F.lower(F.trim("year")).alias("__year"), F.nullif(author_name(F.col("coauthor")), F.lit("")).alias("__co")).filter("__author != '' AND __year != ''")
    words = F.array_distinct(F.array(*[F.regexp_extract(F.coalesce(c, F.lit("")), r"(?U)(\w+)[^\w\s]*$", 1) for c in (F.col("__author"), F.col("__co"))]))
    asked = asked.select("*", F.explode(F.filter(words, lambda w: w != "")).alias("word"))
    index = places(texts, key, text)
    met = index.join(asked, (index["word"] == asked["word"]) & (index["year"] == asked["__year"])).select(*key, "work", "__author", "__year", "__co", "at", "to")
    # All works that may be cited at one place, and all places of one text: what a text cites, not what it holds.
    per_text = met.groupBy(*key).agg(F.collect_set(F.struct("work", "__author", "__year", "__co")).alias("__works"), F.collect_set(F.struct("at", "to", "work")).alias("__at"))
    per_text = written(per_text, "places")
    same = None
    for k in key:
        one = texts[k].eqNullSafe(per_text[k])
        same = one if same is None else same & one
    whole = texts.join(per_text, same).select(*[texts[k] for k in key], texts[text].alias("__text"), "__works", "__at")
    kind = works.schema["work"].dataType
    schema = texts.select(*key).schema.add("work", kind).add("position", "integer").add("citation_text", "string").add("sentence", "string").add("context", "string")

    def run(batches):
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("__text", "__works", "__at")), strict=True)
            for i, (value, own, at) in enumerate(rows):
                around, out = Sentences(value), []
                for w in own:
                    spots = [(x["at"], x["to"]) for x in at if x["work"] == w["work"]]
                    for _, begin, end in matches(value, [(w["__author"], w["__year"], w["__co"])], spots):
                        out.append((w["work"], begin, value[begin:end], around.sentence(begin, end), around.window(begin, end, width)))
                for j in range(0, len(out), 2_000):
                    part = out[j : j + 2_000]
                    own_rows = pa.array([i] * len(part))
                    columns = [pa.array(x) for x in zip(*part, strict=True)]
                    columns[0] = columns[0].cast(batch.schema.field("__works").type.value_type.field("work").type)
                    columns[1] = columns[1].cast(pa.int32())
                    yield pa.RecordBatch.from_arrays([*(batch.column(k).take(own_rows) for k in key), *columns], names=[*key, "work", "position", "citation_text", "sentence", "context"])

    return whole.mapInArrow(run, schema)


def article_texts(parts: DataFrame, key: str) -> DataFrame:
    """key, section, section_title, text of the preamble and sections of articles (of html.article_parts)."""
    own = F.struct(F.lit("preamble").alias("id"), F.lit("Preamble").alias("title"), F.col("preamble").alias("content"))
    each = parts.select(key, F.explode(F.concat(F.array(own), "sections")).alias("s"))
    return each.select(key, F.col("s.id").alias("section"), F.col("s.title").alias("section_title"), F.col("s.content").alias("text")).filter("text != ''")


def citation_query(parts: DataFrame, works: DataFrame, key: str, width: int = WINDOW) -> DataFrame:
    """Contexts of works in articles, with section, its title and the claims of the sentence; an article without any has no row."""
    from citeloom.operators.prose import claims

    texts = article_texts(parts, key)
    found = citation_contexts(texts, works, [key, "section"], width=width)
    return found.join(texts.select(key, "section", "section_title"), [key, "section"]).withColumn("claims", claims(F.col("sentence")))
