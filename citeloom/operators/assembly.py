"""Reviews put together from their sections: order, front matter, places of the parts, warnings."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeloom.functions.keys import natural_key

#: The longest title, the caps of a front matter, and characters that no title may have.
TITLE, LINES, BYTES = 160, 50, 2048
FORBIDDEN = r"[\p{Cc}\p{Cf}\p{Cs}\p{Zl}\p{Zp}]"
#: Values that YAML reads as a string without quotes.
PLAIN = r"^[A-Za-z](?:[A-Za-z0-9()/&.'-]| (?! )|,(?= )|:(?=[^ ]))*(?<![ :])$"
WORDS = ("y", "n", "yes", "no", "true", "false", "on", "off", "null")


@F.pandas_udf(T.StringType())
def composed(texts: pd.Series) -> pd.Series:
    """NFC, without white space around; of titles only."""
    return texts.map(lambda t: unicodedata.normalize("NFC", t).strip() if isinstance(t, str) else None)


def _scalar(value: Column) -> Column:
    free = value.rlike(PLAIN) & ~F.lower(value).isin(*WORDS)
    return F.when(free, value).otherwise(F.concat(F.lit("'"), F.replace(value, F.lit("'"), F.lit("''")), F.lit("'")))


def front_matters(reviews: DataFrame) -> DataFrame:
    """reviews (review, title, date, subfield) with block and warnings.

    A value that is invalid is left out, with a warning that tells its length
    and never its text: titles of 1 to 160 characters after NFC without control
    or format characters, dates of the calendar, subfields of at most 60 letters,
    spaces, `/`, `&` and `-`. A null date or subfield is left out without a
    warning. Values are quoted where YAML needs it and never folded, so a block
    has at most five lines; one beyond the caps fails.
    """
    staged = reviews.select("review", composed(F.coalesce("title", F.lit(""))).alias("title"), F.col("date").cast("string").alias("date"), F.trim("subfield").alias("subfield"))
    size = F.length("title")
    title_ok = size.between(1, TITLE) & ~F.col("title").rlike(FORBIDDEN)
    date_ok = F.col("date").rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z") & F.expr("try_to_date(date, 'yyyy-MM-dd')").isNotNull()
    field_ok = F.col("subfield").rlike(r"^[A-Za-z][A-Za-z /&-]{0,59}\z")
    line = lambda ok, name: F.when(ok, F.concat(F.lit(f"{name}: "), F.concat(F.lit("'"), F.col(name), F.lit("'")) if name == "date" else _scalar(F.col(name))))
    block = F.concat_ws("\n", F.lit("---"), line(title_ok, "title"), line(date_ok, "date"), line(field_ok, "subfield"), F.lit("---"))
    said = lambda ok, name: F.when(~ok, F.concat(F.lit(f"invalid {name} dropped from front matter ("), F.length(name), F.lit(" characters)")))
    warnings = F.array_compact(F.array(said(title_ok, "title"), said(date_ok, "date"), said(field_ok, "subfield")))
    over = (F.octet_length("block") > BYTES) | (F.size(F.split("block", "\n")) > LINES)
    staged = staged.select("review", block.alias("block"), warnings.alias("warnings"))
    return staged.withColumn("block", F.when(over, F.raise_error(F.lit("front matter beyond its caps"))).otherwise(F.col("block")))


def without_front_matter(content: Column) -> Column:
    """A section's text without a block between `---` lines at its very beginning."""
    opened = F.startswith(content, F.lit("---\n"))
    # The closing line may be the one right after the opening's text; a block that is not closed is text.
    closed = F.regexp_instr(F.substr(content, F.lit(5)), F.lit(r"\n---(?:\n|\z)"))
    rest = F.regexp_replace(F.substr(content, closed + 9), r"\A\n+", "")
    return F.when(opened & (closed > 0), rest).otherwise(content)


def parts(sections: DataFrame, reviews: DataFrame) -> DataFrame:
    """The parts of every review's file: review, part (0: front matter), name, start, bytes, content; and warnings.

    sections: review, name, content. Parts follow in the natural order of names
    (2 before 10; equal ones by name and content), with an empty line between
    them. start counts bytes from the beginning of the file, so parts can be
    written apart. A section without text (null too) has no part but a warning,
    in the row of its review's front matter. Sections of reviews that are not
    given are left out.
    """
    heads = front_matters(reviews)
    own = sections.join(heads.select("review"), "review", "left_semi").select("review", "name", F.regexp_replace(without_front_matter(F.coalesce("content", F.lit(""))), r"\s++\z", "").alias("content"))
    # \s knows ASCII only; other white space counts as text, as do zero-width characters.
    empty = own.filter("content = ''").groupBy("review").agg(F.array_sort(F.collect_list(F.concat(F.lit("empty section: "), F.coalesce("name", F.lit(""))))).alias("lost"))
    first = heads.join(empty, "review", "left").select("review", F.lit(None).cast("string").alias("name"), F.col("block").alias("content"), F.concat("warnings", F.coalesce("lost", F.array().cast("array<string>"))).alias("warnings"))
    rest = own.filter("content != ''").withColumn("warnings", F.array().cast("array<string>"))
    both = first.withColumn("__front", F.lit(0)).unionByName(rest.withColumn("__front", F.lit(1)))
    w = Window.partitionBy("review").orderBy("__front", natural_key(F.coalesce("name", F.lit(""))), "name", "content")
    size = F.octet_length("content")
    before = F.coalesce(F.sum(size + 2).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    return both.select("review", (F.row_number().over(w) - 1).alias("part"), "name", before.alias("start"), size.cast("long").alias("bytes"), "content", "warnings")


def files(placed: DataFrame) -> DataFrame:
    """review, content of whole files from parts: one row for a review, as long as it is."""
    listed = F.array_sort(F.collect_list(F.struct("part", "content")))
    return placed.groupBy("review").agg(F.concat(F.array_join(F.transform(listed, lambda p: p["content"]), "\n\n"), F.lit("\n")).alias("content"))
