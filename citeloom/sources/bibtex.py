"""Bibliography files as rows, and rows as bibliography text.

A file is cut where a line opens an entry (`@type{` or `@type(`); each chunk is
an entry or stays opaque, and all chunks together are the file, byte for byte.
One scanner reads an entry in a single pass over its characters: values in
braces or quotes of any depth, numbers, macros of @string and their joining by
`#`. It knows where every field stands, so an edit replaces only that field.
Order is data: file_ord and entry_ord. A file is one task's.

Defined results: a null content has no entries; an entry that cannot be read to
its end keeps the fields read so far and says why in `error`; of repeated
fields the last one holds; lines that open an entry end the one before, even
inside its braces.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

HEADER = r"^\s*@\s*([A-Za-z]+)\s*[{(]\s*([^,\s{}()]+)\s*,"
_OPENER = re.compile(r"^[ \t]*@[ \t]*[A-Za-z]+\s*[{(]", re.MULTILINE)
_KIND = re.compile(r"\s*@\s*([A-Za-z]+)\s*([{(])")
_KEY = re.compile(r"\s*([^,\s{}]+)\s*,")
_NAME = re.compile(r"([A-Za-z_][A-Za-z0-9_:.+-]*)\s*=\s*")
_BARE = re.compile(r"[^\s,#{}()\"=]+")
_GAP, _JOIN, _AHEAD = re.compile(r"[\s,]*"), re.compile(r"\s*#\s*"), re.compile(r"[,\n]")
_BRACE, _QUOTE = re.compile(r"[{}]"), re.compile(r'[{}"]')
#: Macros that every file may use.
MONTHS = {m[:3].lower(): m for m in "January February March April May June July August September October November December".split()}
OPAQUE = ("comment", "preamble", "string")


class Place(NamedTuple):
    """A field: where its name begins, where its value begins and ends, and on which line of the entry (from 0)."""

    name: str
    value: str
    head: int
    start: int
    end: int
    line: int


class Entry(NamedTuple):
    kind: str | None
    key: str | None
    places: list[Place]
    error: str | None
    body: int  # after the comma of the key


def _closed(text: str, at: int) -> int:
    """The end of the value that opens at `at` with a brace or quote; -1 if it has none."""
    depth, quoted = 0, text[at] == '"'
    for m in (_QUOTE if quoted else _BRACE).finditer(text, at + quoted):
        c = m[0]
        depth += (c == "{") - (c == "}")
        if (quoted and c == '"' and depth == 0) or (not quoted and depth == 0):
            return m.end()
        if depth < 0:
            return -1
    return -1


def _value(text: str, at: int, macros: dict[str, str]) -> tuple[str, int, str | None]:
    """A value, joined from its parts, its end, and what is wrong with it."""
    parts, wrong = [], None
    while True:
        if at < len(text) and text[at] in '{"':
            end = _closed(text, at)
            if end < 0:
                return "".join([*parts, text[at + 1 :]]), len(text), "unclosed value"
            parts.append(text[at + 1 : end - 1])
        else:
            bare = _BARE.match(text, at)
            if not bare:
                return "".join(parts), at, "value expected"
            end, word = bare.end(), bare[0]
            if word.isdigit() or word.lower() in macros:
                parts.append(macros.get(word.lower(), word))
            else:
                parts.append(word)
                wrong = f"unknown macro {word}"
        join = _JOIN.match(text, end)
        if not join:
            return "".join(parts).strip(), end, wrong
        at = join.end()


def _fields(text: str, at: int, closer: str, macros: dict[str, str]) -> tuple[list[Place], str | None]:
    places, error, counted, line = [], None, 0, 0
    while True:
        at = _GAP.match(text, at).end()
        if at >= len(text):
            return places, error or "unclosed entry"
        if text[at] == closer:
            return places, error
        name = _NAME.match(text, at)
        if not name:
            error = error or "field expected"
            ahead = _AHEAD.search(text, at + 1)
            close = text.find(closer, at, ahead.start() if ahead else len(text))
            if close >= 0:
                return places, error
            at = ahead.end() if ahead else len(text)
            continue
        value, end, wrong = _value(text, name.end(), macros)
        error = error or (wrong and f"{wrong} in {name[1].lower()}")
        line += text.count("\n", counted, at)
        counted = at
        places.append(Place(name[1].lower(), value, at, name.end(), end, line))
        at = max(end, name.end())


def scan(raw: str, macros: dict[str, str] = MONTHS) -> Entry:
    """One chunk of a file; comments, macros and chunks without a key have neither kind nor key."""
    at = 1 if raw.startswith("\ufeff") else 0
    kind = _KIND.match(raw, at)
    key = kind and kind[1].lower() not in OPAQUE and _KEY.match(raw, kind.end())
    if not key:
        lost = kind is not None and kind[1].lower() not in OPAQUE
        return Entry(None, None, [], "key expected" if lost else None, 0)
    places, error = _fields(raw, key.end(), "}" if kind[2] == "{" else ")", macros)
    return Entry(kind[1].lower(), key[1], places, error, key.end())


def chunks(content: str) -> list[str]:
    """The file cut where lines open entries; blank space before the first one is part of it."""
    starts = [m.start() for m in _OPENER.finditer(content, 1 if content.startswith("\ufeff") else 0)]
    if starts and not content[: starts[0]].strip("\ufeff \t\r\n"):
        starts[0] = 0
    edges = sorted({0, *starts, len(content)})
    return [content[a:b] for a, b in zip(edges, edges[1:], strict=False)]


def _macro(raw: str, macros: dict[str, str]) -> None:
    kind = _KIND.match(raw, 1 if raw.startswith("\ufeff") else 0)
    if kind and kind[1].lower() == "string":
        for p in _fields(raw, kind.end(), "}" if kind[2] == "{" else ")", macros)[0]:
            macros[p.name] = p.value


def read_texts(spark: SparkSession, paths: list[str]) -> DataFrame:
    """bib_file (its path), file_ord, content of whole files, in the order of the arguments.

    Files that a folder or pattern among the arguments leads to come after all
    others. A path given twice gives its file once.
    """
    plain = lambda c: F.regexp_replace(c, "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
    order = spark.createDataFrame([(p, i) for i, p in enumerate(paths)], "path string, file_ord int").select(plain(F.col("path")).alias("bib_file"), "file_ord")
    order = order.groupBy("bib_file").agg(F.min("file_ord").alias("file_ord"))
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    texts = spark.read.text(list(dict.fromkeys(paths)), wholetext=True).select(plain(path).alias("bib_file"), F.col("value").alias("content"))
    return texts.join(F.broadcast(order), "bib_file", "left").select("bib_file", F.coalesce("file_ord", F.lit(len(paths))).alias("file_ord"), "content")


#: Fixed value: characters of raw text after which Python hands its rows on.
SLICE = 1 << 21
PLACES = "array<struct<name:string,head:int,start:int,end:int,line:int>>"


def parse(texts: DataFrame) -> DataFrame:
    """bib_file, file_ord, entry_ord, entry_type, key, fields, raw, line, places, error of every chunk.

    Comments, macros and malformed headers have null type and key and no fields.
    line: on which line of the file the chunk begins (from 1); places: where
    its fields stand in raw. Macros hold from where they are defined on.
    """
    schema = f"bib_file string, file_ord int, entry_ord int, entry_type string, key string, fields map<string,string>, raw string, line int, places {PLACES}, error string"
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.string(), pa.int32()]
    kinds += [pa.list_(pa.struct([("name", pa.string()), *((x, pa.int32()) for x in ("head", "start", "end", "line"))])), pa.string()]
    names = [x.split()[0] for x in schema.split(", ")]

    def rows(name, order, content):
        macros, line = dict(MONTHS), 1
        for i, raw in enumerate(chunks(content)):
            e = scan(raw, macros)
            if not e.kind:
                _macro(raw, macros)
            fields = list({p.name: p.value for p in e.places}.items()) if e.kind else None
            yield name, order, i, e.kind, e.key, fields, raw, line, [{"name": p.name, "head": p.head, "start": p.start, "end": p.end, "line": line + p.line} for p in e.places], e.error
            line += raw.count("\n")

    def run(batches):
        for batch in batches:
            for name, order, content in zip(*(batch.column(c) for c in ("bib_file", "file_ord", "content")), strict=True):
                held, size = [], 0
                for row in rows(name.as_py(), order.as_py(), content.as_py() or ""):  # one file's text at a time
                    held.append(row)
                    size += len(row[6])
                    if size > SLICE or len(held) == 5_000:
                        yield _batch(held, kinds, names)
                        held, size = [], 0
                if held:
                    yield _batch(held, kinds, names)
                del content, held
            del batch  # before the next one is read

    return texts.select("bib_file", F.col("file_ord").cast("int").alias("file_ord"), "content").mapInArrow(run, schema)


def _batch(rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


# ---------------------------------------------------------------- persons


def _top_level(text: str, pattern: str) -> list[str]:
    """text cut at matches of pattern outside braces."""
    parts, depth, last = [], 0, 0
    for m in re.finditer(rf"[{{}}]|{pattern}", text):
        if m[0] in "{}":
            depth += 1 if m[0] == "{" else -1
        elif depth == 0:
            parts.append(text[last : m.start()])
            last = m.end()
    return [*parts, text[last:]]


def _small(word: str) -> bool:
    """Whether a word begins with a small letter: the first one outside braces, or that of a special character."""
    bare = re.sub(r"^\{\\[^A-Za-z{]*(?:[A-Za-z]+(?=[\s{\\]))?[\s{\\]*", "", word)
    letter = re.search(r"[^\W\d_]|\{", bare)
    return bool(letter) and letter[0].islower()


def person(name: str) -> dict:
    """given, von, family and jr of one name; a name all in braces is a family name."""
    commas = [p.strip() for p in _top_level(name.strip(), ",")]
    words = [w for w in _top_level(commas[0], r"[\s~]+") if w]
    small = [i for i, w in enumerate(words[:-1]) if _small(w)]
    if len(commas) == 1:
        begin, end = (small[0], small[-1] + 1) if small else (max(len(words) - 1, 0),) * 2
        given, jr = " ".join(words[:begin]), ""
    else:
        begin, end = 0, small[-1] + 1 if small and _small(words[0]) else 0
        given, jr = commas[-1], ", ".join(commas[1:-1])
    family = " ".join(words[end:])
    whole = re.fullmatch(r"\{([^{}]*)\}", family)
    return {"family": whole[1] if whole else family, "given": given or None, "von": " ".join(words[begin:end]) or None, "jr": jr or None}


_PERSON = T.ArrayType(T.StructType([T.StructField(x, T.StringType()) for x in ("family", "given", "von", "jr")]))


@F.pandas_udf(_PERSON)
def _people(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else [person(n) for n in _top_level(v, r"\s+and\s+") if n.strip()])


def people(value: Column) -> Column:
    """Names joined by ` and ` as structs of family, given, von (particles) and jr."""
    return _people(value)


# ---------------------------------------------------------------- edits


def _balanced(value: str) -> bool:
    depth = 0
    for m in _BRACE.finditer(value):
        depth += 1 if m[0] == "{" else -1
        if depth < 0:
            return False
    return depth == 0


def splice(raw: str, edits: dict[str, str | None], kind: str | None = None) -> tuple[str, str | None]:
    """raw with fields set (or, by None, taken out) and perhaps another type; all other bytes stay. And why not, if refused.

    Every occurrence of a field is set. A field that lacks is put after the
    key. The result is read again: it must have exactly the edited fields,
    else raw comes back.
    """
    now = scan(raw)
    if not now.kind:
        return raw, "no entry"
    if any(v is not None and not _balanced(v) for v in edits.values()):
        return raw, "unbalanced value"
    changes = []
    if kind and kind != now.kind:
        m = _KIND.match(raw, 1 if raw.startswith("\ufeff") else 0)
        changes.append((m.start(1), m.end(1), kind))
    there = {p.name for p in now.places}
    indent = "  "
    if now.places:
        before = raw[: now.places[0].head]
        blank = before[len(before.rstrip(" \t")) :]
        indent = blank if before.rstrip(" \t").endswith("\n") and blank else indent
    new = "".join(f"\n{indent}{k} = {{{v}}}," for k, v in edits.items() if v is not None and k not in there)
    if new:
        changes.append((now.body, now.body, new))
    for p in now.places:
        if p.name not in edits:
            continue
        if edits[p.name] is not None:
            changes.append((p.start, p.end, f"{{{edits[p.name]}}}"))
            continue
        begin = p.head
        while raw[begin - 1] in " \t" and begin > now.body:
            begin -= 1
        if raw[begin - 1] == "\n" and begin > now.body:
            begin -= 1
        comma = re.compile(r"[ \t]*,").match(raw, p.end)
        changes.append((begin, comma.end() if comma else p.end, ""))
    out, last = [], 0
    for begin, end, text in sorted(changes):
        out += [raw[last:begin], text]
        last = end
    text = "".join([*out, raw[last:]])
    expected = [(p.name, p.value) for p in now.places if p.name not in edits]
    after = scan(text)
    kept = [(p.name, p.value) for p in after.places if p.name not in edits]
    good = after.key == now.key and after.kind == (kind or now.kind) and kept == expected and after.error in (None, now.error)
    good = good and all({p.value for p in after.places if p.name == k} == ({v.strip()} if v is not None else set()) for k, v in edits.items())
    return (text, None) if good else (raw, "refused")


def spliced(entries: DataFrame) -> DataFrame:
    """entries (raw, edits: map of field to value or null, new_type) with the new raw and refusal (null if none), without edits and new_type.

    Rows whose edits and new_type are null stay as they are, unread.
    """
    keep = [c for c in entries.columns if c not in ("raw", "edits", "new_type", "refusal")]

    def part(batch, begin, done):
        texts = [pa.array(x, pa.string()) for x in zip(*done, strict=True)]
        return pa.RecordBatch.from_arrays([*(batch.column(k).slice(begin, len(done)) for k in keep), *texts], names=[*keep, "raw", "refusal"])

    def run(batches):
        for batch in batches:
            done, size, begin = [], 0, 0
            for raw, edits, kind in zip(*(batch.column(c) for c in ("raw", "edits", "new_type")), strict=True):  # one entry at a time
                raw, edits, kind = raw.as_py() or "", edits.as_py(), kind.as_py()
                done.append((raw, None) if edits is None and kind is None else splice(raw, dict(edits or []), kind))
                size += len(done[-1][0])
                if size > SLICE:
                    yield part(batch, begin, done)
                    done, size, begin = [], 0, begin + len(done)
            if done:
                yield part(batch, begin, done)
            del batch, done  # before the next one is read

    return entries.select(*keep, "raw", "edits", "new_type").mapInArrow(run, entries.select(*keep).schema.add("raw", "string").add("refusal", "string"))


def to_text(entries: DataFrame) -> DataFrame:
    """bib_file, content: the chunks of each file in order, as they stand in raw.

    Entries without raw are written anew, their fields in name order.
    """
    fields = F.array_join(F.transform(F.array_sort(F.map_entries("fields")), lambda e: F.concat(F.lit("  "), e["key"], F.lit(" = {"), e["value"], F.lit("}"))), ",\n")
    anew = F.concat(F.lit("@"), "entry_type", F.lit("{"), "key", F.lit(",\n"), fields, F.lit("\n}\n\n"))
    listed = F.array_sort(F.collect_list(F.struct("entry_ord", F.coalesce("raw", anew).alias("t"))))
    return entries.groupBy("bib_file").agg(F.array_join(F.transform(listed, lambda e: e["t"]), "").alias("content"))


def write_texts(texts: DataFrame, path: str) -> None:
    """Files of texts (bib_file, content), each in a folder of its name under path, byte for byte; empty ones have no file.

    Spark ends each text with a separator: here it is the text's own last character.
    Most end with a line, so these are written first, in the pass that counts the others.
    """
    rows = texts.filter("content != ''").select("bib_file", F.right("content", F.lit(1)).alias("last"), F.substr("content", F.lit(1), F.length("content") - 1).alias("value"))
    write = lambda rows, last: rows.filter(F.col("last") == last).select("value", "bib_file").write.mode("append").option("lineSep", last).partitionBy("bib_file").text(path)
    seen = Observation()
    write(rows.observe(seen, F.count_if(F.col("last") != "\n").alias("others")), "\n")
    if seen.get["others"]:
        for last in [r["last"] for r in rows.filter(F.col("last") != "\n").select("last").distinct().collect()]:  # as many as there are characters, at most
            write(rows, last)


# ---------------------------------------------------------------- checks of raw text


def lines(texts: DataFrame) -> DataFrame:
    """bib_file, line_no (from 1), line."""
    return texts.select("bib_file", F.posexplode(F.split("content", "\n")).alias("i", "line")).select("bib_file", (F.col("i") + 1).alias("line_no"), "line")


def duplicate_keys(texts: DataFrame) -> DataFrame:
    """Each repeat of a key, against the line of the first."""
    found = lines(texts).withColumn("key", F.regexp_extract("line", HEADER, 2)).filter("key != ''")
    return found.withColumn("first_line", F.min("line_no").over(Window.partitionBy("bib_file", "key"))).filter("line_no > first_line").select("bib_file", "key", "line_no", "first_line")


def duplicate_fields(texts: DataFrame) -> DataFrame:
    """bib_file, key, field, n, first_line: fields that one entry has more than once."""
    each = parse(texts).filter("key IS NOT NULL").select("bib_file", "entry_ord", "key", F.explode("places").alias("p"))
    return each.groupBy("bib_file", "entry_ord", "key", F.col("p.name").alias("field")).agg(F.count(F.lit(1)).alias("n"), F.min("p.line").alias("first_line")).filter("n > 1").drop("entry_ord")


def syntax_errors(entries: DataFrame) -> DataFrame:
    """bib_file, key, line, error of chunks that could not be read to their end."""
    return entries.filter("error IS NOT NULL").select("bib_file", "key", "line", "error")


#: Fields that entries of a type need.
REQUIRED = {
    "article": ("author", "title", "journal", "year"),
    "book": ("title", "publisher", "year"),
    "inproceedings": ("author", "title", "booktitle", "year"),
    "incollection": ("author", "title", "booktitle", "publisher", "year"),
    "phdthesis": ("author", "title", "school", "year"),
    "mastersthesis": ("author", "title", "school", "year"),
    "techreport": ("author", "title", "institution", "year"),
    "misc": ("author", "title", "year"),
}
#: Fields of another dialect, and what they are called here.
RENAMED = {"journaltitle": "journal", "date": "year", "location": "address"}


def field_violations(entries: DataFrame) -> DataFrame:
    """bib_file, key, rule, detail: required fields that lack, and fields of the other dialect."""
    required = F.create_map(*[x for kind, names in REQUIRED.items() for x in (F.lit(kind), F.array(*map(F.lit, names)))])
    real = entries.filter("key IS NOT NULL").withColumn("names", F.map_keys("fields"))
    lacking = F.array_except(F.coalesce(F.try_element_at(required, F.col("entry_type")), F.array().cast("array<string>")), F.col("names"))
    person = F.when((F.col("entry_type") == "book") & ~F.arrays_overlap("names", F.array(F.lit("author"), F.lit("editor"))), F.array(F.lit("author or editor"))).otherwise(F.array().cast("array<string>"))
    missing = real.select("bib_file", "key", F.lit("required").alias("rule"), F.explode(F.concat(lacking, person)).alias("detail"))
    other = real.select("bib_file", "key", F.lit("renamed").alias("rule"), F.explode(F.array_intersect("names", F.array(*map(F.lit, RENAMED)))).alias("detail"))
    return missing.unionByName(other)


def violations(texts: DataFrame) -> DataFrame:
    """bib_file, step, key, line, detail: all checks in order; what entries mean is asked only of files that can be read.

    Steps: 1 syntax, 2 repeated keys, 3 repeated fields, 4 required fields, 5 fields of the other dialect.
    """
    entries = parse(texts)
    broken = syntax_errors(entries)
    row = lambda df, step, line, detail: df.select("bib_file", F.lit(step).alias("step"), "key", line.cast("int").alias("line"), detail.alias("detail"))
    sound = field_violations(entries).join(broken.select("bib_file").distinct(), "bib_file", "left_anti")
    none = F.lit(None)
    found = row(broken, 1, F.col("line"), F.col("error"))
    found = found.unionByName(row(duplicate_keys(texts), 2, F.col("line_no"), F.concat(F.lit("first on line "), "first_line")))
    found = found.unionByName(row(duplicate_fields(texts), 3, F.col("first_line"), F.concat("field", F.lit(" x"), "n")))
    return found.unionByName(row(sound.filter("rule = 'required'"), 4, none, F.col("detail"))).unionByName(row(sound.filter("rule = 'renamed'"), 5, none, F.col("detail")))
