"""Lines of encyclopedia bibliographies, and the entries they are about.

Lines are split at commas and looked at field by field, so the time grows with
the length of a line and with nothing else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.functions.keys import let, title_key
from citeloom.operators.matching import names_with_years

LONGEST = 2000
YEAR = r"(?i)^([0-9]{4}|forthcoming)$"
#: How lines begin that are no references.
NO_REFERENCE = r"(?i)^(See the entry|For more on|Also see)|^\[.*\]$"


def parsed_line(raw: Column) -> Column:
    """Struct of authors, year, title, publisher, is_edited and confidence (high, low or unparseable).

    High: authors, a year field that no other year follows, a title, more, and
    a full stop. Low: a name and a year open the line, which is the title.
    """
    text = F.trim(raw)
    fields = F.transform(F.split(text, ","), lambda f: F.trim(f))
    none = F.lit(None).cast("string")

    def shaped(authors: Column, year: Column, title: Column, publisher: Column, edited: Column, confidence: str) -> Column:
        return F.struct(authors.alias("authors"), year.alias("year"), title.alias("title"), publisher.alias("publisher"), edited.alias("is_edited"), F.lit(confidence).alias("confidence"))

    def by_fields(f: Column) -> Column:
        places = F.filter(F.sequence(F.lit(1), F.size(f)), lambda i: F.element_at(f, i).rlike(YEAR) & ~F.coalesce(F.try_element_at(f, i + 1).rlike(YEAR), F.lit(False)))
        return let(F.coalesce(F.try_element_at(places, F.lit(1)), F.lit(0)), lambda at: parts(f, at))

    def parts(f: Column, at: Column) -> Column:
        authors = F.array_join(F.slice(f, F.lit(1), F.greatest(at - 1, F.lit(0))), ", ")
        title = F.regexp_replace(F.coalesce(F.try_element_at(f, F.greatest(at + 1, F.lit(1))), F.lit("")), "^['\"]+|['\"]+$", "")
        rest = F.slice(f, F.greatest(at + 2, F.lit(1)), F.greatest(F.size(f) - at - 1, F.lit(0)))
        publisher = F.trim(F.regexp_replace(F.array_join(rest, ", "), r"\.+$", ""))
        standard = (at > 1) & (at < F.size(f) - 1) & F.endswith(text, F.lit(".")) & (title != "")
        names = F.transform(F.split(authors, r"\s+and\s+"), lambda a: F.trim(a))
        high = shaped(names, F.try_element_at(f, F.greatest(at, F.lit(1))), title, publisher, authors.rlike(r"(?i)\(eds?\.?\)"), "high")
        return F.when(standard, high).otherwise(partial)

    before, year = (F.regexp_extract(text, r"^([^,]+),\s*([0-9]{4})", i) for i in (1, 2))
    unread = shaped(F.lit(None).cast("array<string>"), none, none, none, F.lit(None).cast("boolean"), "unparseable")
    partial = F.when(year != "", shaped(F.array(F.trim(before)), year, text, none, F.lit(None).cast("boolean"), "low")).otherwise(unread)
    skipped = text.isNull() | (text == "") | (F.length(text) > LONGEST) | text.rlike(NO_REFERENCE)
    return F.when(skipped, unread).otherwise(let(fields, by_fields))


def with_carried_authors(lines: DataFrame, article: str = "article_id") -> DataFrame:
    """lines (article, line_no, raw) with raw in which a leading dash stands for the last line's author."""
    w = Window.partitionBy(article).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    dash = F.col("raw").rlike(r"^\s*[-–—]+\s*,")
    own = F.when(~dash, F.regexp_extract("raw", r"^\s*(.+?),\s*(?:[0-9]{4}|forthcoming)", 1))
    marked = lines.withColumn("__author", F.last(F.nullif(own, F.lit("")), ignorenulls=True).over(w))
    return marked.withColumn("raw", F.when(dash & F.col("__author").isNotNull(), F.concat("__author", F.regexp_replace("raw", r"^\s*[-–—]+\s*", ""))).otherwise(F.col("raw"))).drop("__author")


def entry_lines(entries: DataFrame, lines: DataFrame, least: int = 2, coverage: float = 0.5) -> DataFrame:
    """entry, article_id, matches: entries (entry, surname, year, title) met by lines (article_id, line_no, raw) of surname, year and title words.

    Two title words and half of them must agree. More than one match is ambiguous.
    """
    words = lambda c: F.array_distinct(F.filter(F.split(title_key(c), " "), lambda w: F.length(w) >= 3))
    own = entries.select("entry", "surname", "year", words(F.col("title")).alias("w")).filter(F.size("w") >= least)
    met = names_with_years(lines.select("article_id", "line_no", "raw"), ["article_id", "line_no"], "raw", own)
    shared = F.size(F.array_intersect("w", words(F.col("raw"))))
    good = met.filter((shared >= least) & (shared >= coverage * F.size("w")))
    return good.groupBy("entry", "article_id").agg(F.count(F.lit(1)).alias("matches"))


def first_article(found: DataFrame) -> DataFrame:
    """entry, article_id: the first article (as text) with exactly one match; entry, null if all are ambiguous."""
    clear = F.min(F.when(F.col("matches") == 1, F.col("article_id")))
    return found.groupBy("entry").agg(clear.alias("article_id"))
