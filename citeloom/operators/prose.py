"""Prose: lines and their running state, citations, mentions, references, sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WINDOW = 60


def text_lines(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, line_no (from 1), line of every line of text."""
    return docs.select(key, F.posexplode(F.split("text", "\n")).alias("i", "line")).select(key, (F.col("i") + 1).alias("line_no"), "line")


def line_state(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """lines with in_fence (between ``` lines) and section: how many headings came so far outside fences."""
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    fence = F.startswith(F.ltrim("line"), F.lit("```")).cast("int")
    marked = lines.withColumn("in_fence", F.sum(fence).over(w) % 2 == 1)
    heading = (F.startswith("line", F.lit("#")) & ~F.col("in_fence")).cast("int")
    return marked.withColumn("section", F.sum(heading).over(w))


def renumbered(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """lines with number: n for ## and n.m for ### headings; introduction, conclusion and references have none."""
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    plain = F.lower(F.trim(F.regexp_replace("line", r"^#+\s*([0-9]+(\.[0-9]+)*\.?\s+)?", "")))
    outside = plain.isin("introduction", "conclusion", "references", "bibliography")
    state = line_state(lines, key)
    second = F.startswith("line", F.lit("## ")) & ~F.col("in_fence")
    third = F.startswith("line", F.lit("### ")) & ~F.col("in_fence")
    state = state.withColumn("__h2", (second & ~outside).cast("int")).withColumn("__any2", second.cast("int")).withColumn("__h3", third.cast("int"))
    state = state.withColumn("__n", F.sum("__h2").over(w)).withColumn("__s", F.sum("__any2").over(w))
    state = state.withColumn("__m", F.sum("__h3").over(Window.partitionBy(key, "__s").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)))
    number = F.when(F.col("__h2") == 1, F.col("__n").cast("string")).when(third, F.concat_ws(".", F.col("__n").cast("string"), F.col("__m").cast("string")))
    return state.withColumn("number", number).drop("__h2", "__any2", "__h3", "__n", "__s", "__m")


def positions(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, word, pos (characters before it) of every word between single spaces."""
    words = F.split(text, " ")
    each = docs.select(key, F.posexplode(words).alias("i", "word"))
    w = Window.partitionBy(key).orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    return each.withColumn("pos", F.coalesce(F.sum(F.length("word") + 1).over(w), F.lit(0)).cast("long")).select(key, "word", "pos")


#: A year, a name, and words before a comma that are no author of what follows.
YEAR = r"(?:1[6-9]|20)[0-9]{2}"
NAME = r"\p{Lu}[\w'’-]+"
LEAD_INS = (
    "However", "Moreover", "Nevertheless", "Nonetheless", "Furthermore", "Therefore", "Thus", "Hence", "Accordingly", "Consequently", "Instead", "Conversely", "Similarly", "Likewise",
    "Indeed", "Admittedly", "Arguably", "Notably", "Crucially", "Importantly", "Interestingly", "Strikingly", "Famously", "Relatedly", "Alternatively", "Meanwhile", "Overall", "Finally",
    "Ultimately", "First", "Second", "Third", "Fourth", "Fifth", "Recently", "Historically", "Traditionally", "Classically", "Typically", "Generally", "Specifically", "Broadly",
    "Roughly", "Strictly", "Formally", "Initially", "Subsequently", "Originally", "Again", "Still", "Yet", "Rather", "Otherwise", "Equally", "Correspondingly", "Unsurprisingly",
    "Surprisingly", "Curiously", "Tellingly", "Plainly", "Clearly", "Obviously", "Presumably",
)
#: A name with what joins it to the next one. Quantifiers are possessive all through: they loop, and never try again.
_LEAD = rf"{NAME}(?:,?\s+(?:and|&)\s++(?=\p{{Lu}}|[\p{{Ll}}'’-]+\s)|,\s++(?=\p{{Lu}}))"
#: Names that lead to another one, particles after `and`, a first name, the last surname, et al., and years with letters.
PLACE = (
    rf"((?:{_LEAD})*+)((?:(?<=\band\s{{1,4}})(?:[\p{{Ll}}'’-]+\s+)++)?)(?:(\p{{Lu}}[\w.]*+)\s++)?({NAME})"
    rf"(?:\s+(et al)\.?)?(?:['’]s)?[\s,]*+\(?\s*+({YEAR}[a-z]?\b(?:\s*[;,]\s*(?:{YEAR}[a-z]?\b|[a-z](?=\s*(?:[;,)]|$))))*+)"
)
#: A place, or else all leading names or one word: a run of names without a year is passed over at once.
CITATION = rf"(?U)(?:{PLACE}|(?:{_LEAD})++|\p{{Lu}}[\w.'’-]*+)"


def _scanned(docs: DataFrame, key: str) -> DataFrame:
    """Every place of an author-year citation: key, n, names (all before the last), last, surname, second, form, years, accepted.

    The names before the last surname decide. After `and` it is the second of a
    pair, if nothing stands between; a name that follows another one by comma,
    `and` or `&` is no first author, so that such a place is not accepted.
    """
    hits = F.filter(F.regexp_extract_all("text", F.lit(CITATION), F.lit(0)), lambda c: c.rlike(f"(?U)^{PLACE}$"))
    found = docs.select(key, F.posexplode(hits).alias("n", "c"))
    parts = F.split(F.regexp_replace("c", F.lit(f"(?U)^{PLACE}$"), F.lit("\x01".join(f"${i}" for i in range(1, 7)))), "\x01")  # no part can hold this byte
    part = lambda i: F.element_at("parts", i)
    found = found.select(key, "n", parts.alias("parts")).select(key, "n", *[part(i).alias(name) for i, name in enumerate(["leads", "particles", "first", "last", "etal", "list"], 1)])
    names = lambda c: F.regexp_extract_all(c, F.lit(f"(?U){NAME}"), F.lit(0))
    prior = F.regexp_replace("leads", rf"(?U){NAME},?\s+(?:(?:and|&)\s+)?$", "")
    free = lambda c: (c == "") | (c.rlike(r",\s+$") & ~c.rlike(r"\s(?:and|&)\s+$") & F.try_element_at(names(c), F.lit(-1)).isin(*LEAD_INS))
    own = lambda c: F.regexp_replace(c, "['’]s$", "")
    pair = F.rlike("leads", F.lit(r"\sand\s+$")) & (F.col("etal") == "") & (F.col("first") == "")
    # A letter alone belongs to the year before it: each year with the letters that follow.
    dated = F.regexp_extract_all("list", F.lit(r"[0-9]{4}[a-z]?(?:\s*[;,]\s*[a-z](?![0-9a-z]))*+"), F.lit(0))
    letter = lambda t: F.nullif(F.regexp_extract(t, "[a-z]$", 0), F.lit(""))
    years = F.flatten(F.transform(dated, lambda d: F.transform(F.split(d, r"\s*[;,]\s*"), lambda t: F.struct(F.substring(d, 1, 4).alias("year"), letter(t).alias("letter")))))
    return found.select(
        key,
        "n",
        F.transform(names("leads"), own).alias("names"),
        own(F.col("last")).alias("last"),
        own(F.when(pair, F.element_at(names("leads"), -1)).otherwise(F.col("last"))).alias("surname"),
        F.when(pair, own(F.concat("particles", "last"))).alias("second"),
        F.when(pair, "pair").when(F.col("etal") != "", "etal").otherwise("solo").alias("form"),
        F.nullif(F.col("first"), F.lit("")).alias("first"),
        years.alias("years"),
        F.when(pair, free(prior)).otherwise(free(F.col("leads"))).alias("accepted"),
    )


def citations(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, n, surname, second, form, first, year, letter, continuation of author-year citations in prose.

    Forms: solo `A (2001a)`, pair `A and B (2001)`, etal `A et al. (2001)`. A
    list of years, `A (2001a, b; 2003)`, gives a row for each: all but the
    first continue it, and a letter alone belongs to the year before. first:
    the word with a capital before a lone surname, perhaps a first name. Names
    within longer lists of authors are left to rejected_mentions.
    """
    found = _scanned(docs, key).filter("accepted").select(key, "n", "surname", "second", "form", "first", F.posexplode("years").alias("i", "y"))
    return found.select(key, "n", "surname", "second", "form", "first", "y.year", "y.letter", (F.col("i") > 0).alias("continuation"))


def rejected_mentions(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, surname, year: every name of a citation that citations leaves out, with its years that have no letter.

    Such a place may mean the works of any of its names, so each is protected.
    """
    found = _scanned(docs, key).filter("NOT accepted").select(key, F.explode(F.array_distinct(F.concat("names", F.array("last")))).alias("surname"), "years")
    return found.select(key, "surname", F.explode("years").alias("y")).filter("y.letter IS NULL").select(key, "surname", "y.year").distinct()


def unresolved(found: DataFrame, references: DataFrame) -> DataFrame:
    """Citations (surname, year) for which no reference (surname, year) shares year and any spelling of the name."""
    from citeloom.functions.keys import name_variants

    asked = found.select("year", "surname").distinct()
    variants = asked.select("year", "surname", F.explode(name_variants(F.col("surname"))).alias("v"))
    known = references.select("year", F.explode(name_variants(F.col("surname"))).alias("v")).distinct()
    good = variants.join(known, ["year", "v"], "left_semi").select(F.col("year").alias("__year"), F.col("surname").alias("__surname")).distinct()
    return found.join(good, found["year"].eqNullSafe(F.col("__year")) & found["surname"].eqNullSafe(F.col("__surname")), "left_anti")


def reference_text(authors: Column, year: Column, title: Column, container: Column, volume: Column, pages: Column) -> Column:
    """An author-date reference; up to ten authors are named, of more the first seven."""
    last = lambda a: F.concat_ws(", ", a["family"], a["given"])
    first = lambda a: F.concat_ws(" ", a["given"], a["family"])
    named = F.when(F.size(authors) > 10, F.slice(authors, 1, 7)).otherwise(authors)
    lead = last(F.element_at(named, 1))
    rest = F.transform(F.slice(named, F.lit(2), F.greatest(F.size(named) - 1, F.lit(0))), first)
    listed = (
        F.when(F.size(authors) > 10, F.concat(F.array_join(F.concat(F.array(lead), rest), ", "), F.lit(", et al.")))
        .when(F.size(authors) <= 1, lead)
        .otherwise(F.concat(F.array_join(F.concat(F.array(lead), F.slice(rest, F.lit(1), F.greatest(F.size(rest) - 1, F.lit(0)))), ", "), F.lit(", and "), F.element_at(rest, -1)))
    )
    place = F.concat(F.coalesce(F.concat(F.lit(" "), container), F.lit("")), F.coalesce(F.concat(F.lit(" "), volume), F.lit("")), F.coalesce(F.concat(F.lit(": "), pages), F.lit("")))
    return F.concat(F.regexp_replace(listed, r"\.$", ""), F.lit(". "), year, F.lit(". “"), F.regexp_replace(title, r"[.]$", ""), F.lit(".”"), place, F.when(place != "", ".").otherwise(""))


def ordered_places(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows with place: 1, 2, ... in the order given within each group, however large.

    Rows are sorted once over all tasks; a group's place is counted from the
    rows it has in the tasks before, of which each gives one number.
    """
    from citeloom.session import written

    ranged = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    numbered = written(ranged.withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id()), "sorted")
    parts = numbered.groupBy(group, "__p").agg(F.min("__i").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(group).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = parts.withColumn("__before", before).select(F.col(group).alias("__g"), F.col("__p").alias("__q"), "__first", "__before")
    met = numbered.join(base, numbered[group].eqNullSafe(F.col("__g")) & (F.col("__p") == F.col("__q")))
    return met.select(*rows.columns, (F.col("__i") - F.col("__first") + F.col("__before") + 1).alias("place"))


def spliced_references(docs: DataFrame, references: DataFrame, key: str = "doc_id") -> DataFrame:
    """docs with a references section: sorted by surname and year, in the place of the last one."""
    ordered = F.array_sort(F.collect_list(F.struct(F.lower("surname").alias("s"), "year", "ord", "text")))
    lists = references.groupBy(key).agg(F.array_join(F.transform(ordered, lambda r: r["text"]), "\n\n").alias("__refs"))
    head = r"(?s)\n## (?:References|Bibliography)\s*\n(?!.*\n## (?:References|Bibliography)\s*\n).*$"
    body = F.regexp_replace(F.rtrim("text"), head, "")
    return docs.join(lists, key, "left").withColumn("text", F.when(F.col("__refs").isNull(), F.col("text")).otherwise(F.concat(body, F.lit("\n\n## References\n\n"), "__refs", F.lit("\n")))).drop("__refs")


def without_tiers(keywords: Column) -> Column:
    """Keywords without evidence tokens."""
    return F.array_join(F.filter(F.split(keywords, r",\s*"), lambda t: ~t.rlike(r"^\s*EVIDENCE-[A-Z]+\s*$")), ", ")


def claims(text: Column, least: int = 15) -> Column:
    """Sentences that state a position: `argues that ...` and the like, 20 to 200 characters of it."""
    said = F.regexp_extract_all(text, F.lit(r"(?i)\b(?:argues?|claims?|holds?|maintains?|suggests?|contends?|defends?)\s+(?:that\s+)?([^.!?]{20,200}?)[.!?]"), F.lit(1))
    return F.filter(F.transform(said, lambda c: F.trim(c)), lambda c: F.length(c) > least)
