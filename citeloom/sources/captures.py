"""Captured web pages and cached verdicts as records whose shape is known.

A capture is made from a response or handed over by an agent; what cannot be
used is an error record, never a thin capture. Stored ones are JSON texts, one
for each key. JSON types are told apart by Spark's variants: a boolean is no
number, a number no text, a fraction no whole number.

Defined results: a text that is no JSON object is no capture (null); fields of
another type are null, and `sound` is false for a record with one. A body of
null is empty. Of several texts of a key the greatest counts. Further columns
stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.functions.keys import printable_share
from citeloom.sources.html import articles

#: The largest body, the least share of printable characters, how a PDF begins, the version of cached verdicts.
MOST_BYTES, LEAST_PRINTABLE, PDF, RECORD_VERSION = 20 * 1024 * 1024, 0.7, "%PDF-", 1
#: A capture: its fields and the JSON types that each may have, besides null.
WHOLE, FRACTION = r"BIGINT|DECIMAL\([0-9]+,0\)", r"BIGINT|DOUBLE|FLOAT|DECIMAL\([0-9]+,[0-9]+\)"
FIELDS = {"url": "STRING", "final_url": "STRING", "retrieved_at": "STRING", "http_status": WHOLE, "content_type": "STRING", "title": "STRING", "provenance": "STRING", "text": "STRING", "error": "STRING"}


def supplied(pages: DataFrame, retrieved_at: Column) -> DataFrame:
    """Captures of texts (url, text) that an agent handed over: no status, so none is asked for later."""
    null = lambda t: F.lit(None).cast(t)
    new = {
        "url": F.col("url"), "final_url": F.col("url"), "retrieved_at": retrieved_at, "http_status": null("int"), "content_type": null("string"),
        "title": F.lit(""), "provenance": F.lit("agent"), "text": F.col("text"), "error": null("string"),
    }
    return pages.withColumns(new)


def charset_of(content_type: Column) -> Column:
    """The declared charset, quoted or not, lower-cased; null if none is."""
    return F.nullif(F.lower(F.regexp_extract(content_type, r"(?i);\s*charset\s*=\s*[\"']?\s*([A-Za-z0-9._:-]+)", 1)), F.lit(""))


def decoded(body: Column, content_type: Column) -> Column:
    """The body as text: in its declared charset if that is one of Spark's, else in the one the page declares, else as UTF-8."""
    known = {"utf-8": "UTF-8", "utf8": "UTF-8", "us-ascii": "ISO-8859-1", "iso-8859-1": "ISO-8859-1", "latin1": "ISO-8859-1", "utf-16": "UTF-16", "utf-16le": "UTF-16LE", "utf-16be": "UTF-16BE", "utf-32": "UTF-32"}
    start = F.decode(F.substring(body, 1, 2048), "ISO-8859-1")
    meta = F.nullif(F.lower(F.regexp_extract(start, r"(?i)<meta[^>]{0,200}?charset\s*=\s*[\"']?\s*([A-Za-z0-9._:-]+)", 1)), F.lit(""))
    name = F.coalesce(charset_of(content_type), meta, F.lit("utf-8"))
    # Malformed bytes are replaced, never an error.
    out = F.make_valid_utf8(body.cast("string"))
    for told, charset in known.items():
        if charset != "UTF-8":
            out = F.when(name == told, F.decode(body, charset)).otherwise(out)
    return out


def fetched(responses: DataFrame) -> DataFrame:
    """Captures of responses (url, final_url, retrieved_at, http_status, content_type, body as bytes), further columns kept.

    Bodies over MOST_BYTES, PDFs (no reader for them here) and pages with too
    few printable characters are error records without title and text.
    """
    size = F.coalesce(F.octet_length("body"), F.lit(0))
    pdf = F.coalesce(F.contains(F.lower("content_type"), F.lit("application/pdf")), F.lit(False)) | (F.coalesce(F.decode(F.substring("body", 1, 5), "ISO-8859-1"), F.lit("")) == PDF)
    error = F.when(size > MOST_BYTES, F.concat(F.lit("response-too-large:"), size)).when(pdf, "pdf-not-read")
    keep = [c for c in responses.columns if c not in ("body", "title", "text", "error", "provenance")]
    staged = responses.select(*keep, error.alias("__error"), F.when(error.isNull(), decoded(F.col("body"), F.col("content_type"))).alias("__html"))
    read = articles(staged, "__html")
    thin = (F.col("text") != "") & (printable_share("text") < LEAST_PRINTABLE)
    why = F.coalesce("__error", F.when(F.col("error").isNotNull(), F.concat(F.lit("extract-failed:"), "error")), F.when(thin, "unreadable-text"))
    usable = lambda c: F.when(why.isNull(), F.col(c)).alias(c)
    return read.select(*keep, F.lit("script").alias("provenance"), usable("title"), usable("text"), why.alias("error"))


def _type(path: str, of: str = "v") -> Column:
    """The JSON type at a path; VOID for null and for what is not there."""
    return F.coalesce(F.expr(f"schema_of_variant(try_variant_get({of}, '$.{path}', 'variant'))"), F.lit("VOID"))


def loaded(keys: DataFrame, files: DataFrame, key: str = "key") -> DataFrame:
    """keys with capture, the stored record (FIELDS and sound) out of files (key, content); null where none can be read."""
    last = files.groupBy(F.col(key).alias("__k")).agg(F.max("content").alias("content")).withColumn("v", F.expr("try_parse_json(content)"))
    typed = {"http_status": "int"}
    fits = {name: _type(name).rlike(f"^({kinds}|VOID)$") for name, kinds in FIELDS.items()}
    sound = None
    for ok in fits.values():
        sound = ok if sound is None else sound & ok
    values = [F.when(fits[n], F.expr(f"try_variant_get(v, '$.{n}', '{typed.get(n, 'string')}')")).alias(n) for n in FIELDS]
    whole = F.coalesce(F.startswith(F.expr("schema_of_variant(v)"), F.lit("OBJECT")), F.lit(False))
    read = last.select("__k", F.when(whole, F.struct(*values, sound.alias("sound"))).alias("capture"))
    return keys.join(read, keys[key] == F.col("__k"), "left").drop("__k")


def verdicts(cached: DataFrame, now: Column, ttl: int, flagged_ttl: int, threshold: int = 15) -> DataFrame:
    """cached (content, age: seconds since it was written) with record, shape, flagged and usable.

    shape says what is wrong first (no_object, version, resolved, h_index,
    is_core, is_in_doaj) or ok; fields of unresolved records are not looked at.
    A verdict that flags a venue holds for flagged_ttl from its own fetched_at,
    and not at all if that is no number; any other one for ttl from its age.
    """
    v = cached.withColumn("v", F.expr("try_parse_json(content)"))
    get = lambda path, kind: F.expr(f"try_variant_get(v, '$.{path}', '{kind}')")
    is_a = lambda path, kinds: _type(path).rlike(f"^({kinds})$")
    whole = F.coalesce(F.startswith(F.expr("schema_of_variant(v)"), F.lit("OBJECT")), F.lit(False))
    resolved = get("resolved", "boolean")
    shape = (
        F.when(~whole, "no_object")
        .when(~(is_a("schema_version", FRACTION) & F.coalesce(get("schema_version", "double") == RECORD_VERSION, F.lit(False))), "version")
        .when(~is_a("resolved", "BOOLEAN"), "resolved")
        .when(~resolved, "ok")
        .when(~is_a("h_index", f"{WHOLE}|VOID"), "h_index")
        .when(~is_a("is_core", "BOOLEAN|VOID"), "is_core")
        .when(~is_a("is_in_doaj", "BOOLEAN|VOID"), "is_in_doaj")
        .otherwise("ok")
    )
    fields = {"h_index": ("bigint", WHOLE), "is_core": ("boolean", "BOOLEAN"), "is_in_doaj": ("boolean", "BOOLEAN"), "fetched_at": ("double", FRACTION)}
    record = F.struct(resolved.alias("resolved"), *[F.when(is_a(name, kinds), get(name, kind)).alias(name) for name, (kind, kinds) in fields.items()])
    told = v.withColumn("shape", shape).withColumn("record", F.when(F.col("shape") == "ok", record)).drop("v")
    r = F.col("record")
    flagged = F.coalesce(r["resolved"] & ~r["is_core"] & ~r["is_in_doaj"] & (r["h_index"] < threshold), F.lit(False))
    held = F.when(F.col("flagged"), F.coalesce(now - r["fetched_at"] <= flagged_ttl, F.lit(False))).otherwise(F.coalesce((F.col("age") >= 0) & (F.col("age") <= ttl), F.lit(False)))
    return told.withColumn("flagged", flagged).withColumn("usable", r.isNotNull() & held)


def cache_statistics(files: DataFrame, now: Column, group: list[str] | None = None) -> DataFrame:
    """entry_count, total_bytes, oldest_age and newest_age in seconds of cached files (length, modificationTime), for each group.

    Of Spark's binaryFile source only these columns are read, no content.
    Without files one row with zeros and null ages, unless groups are asked for.
    """
    age = lambda t: now - F.unix_micros(t) / 1e6
    sums = [F.count(F.lit(1)).alias("entry_count"), F.coalesce(F.sum("length"), F.lit(0)).alias("total_bytes"), age(F.min("modificationTime")).alias("oldest_age"), age(F.max("modificationTime")).alias("newest_age")]
    return files.groupBy(*group).agg(*sums) if group else files.agg(*sums)


def context_value(slug: Column, passage: Column) -> Column:
    """How an entry keeps the passage of an article that cites it: without braces, white space joined; null if either is null."""
    plain = F.trim(F.regexp_replace(F.translate(passage, "{}", ""), r"\s+", " "))
    return F.concat(F.lit("Cited in '"), slug, F.lit("' entry: \""), plain, F.lit('"'))
