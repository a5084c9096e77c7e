"""Which of the works that share author and year a text cites: evidence from its prose, and what follows.

Works of one text that share year and any spelling of the first surname form a
group (components of the bipartite graph of works and spellings). Every citation
of such a surname and year has candidates among the group by its form: et al.
means three authors or more, a pair names the second one, a lone name means one
author, whose first name decides if the word before is one; a letter decides
where all works of the group have letters and are different works. A work goes
only if another one is clearly cited; all that is not clear keeps the group.

Defined results: works in no group have no row; null texts cite nothing, which
keeps all; rows that repeat an entry count once; a text's works are judged by
its own prose only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.functions import keys
from citeloom.functions.keys import name_variants
from citeloom.operators import cleaning, prose
from citeloom.session import written

#: Words that a title needs to be known by its name alone, and the delimiters of its mention.
TITLE_WORDS = 4
SPANS = (r'"([^"\n]{4,300})"', "“([^”\n]{4,300})”", r"\*([^*\n]{4,300})\*")
#: What entries are told by: a text's works, each with its authors.
ENTRY = "doc_id, entry, surname, given, second, n_authors, year, letter, title, doi"


def title_spans(texts: DataFrame) -> DataFrame:
    """doc_id, title: keys of quoted and italic spans that stand free of words on both sides."""
    found = None
    for span in SPANS:
        shape = rf"(?U)(\w?){span}(?=(\w?))"
        part = lambda i, shape=shape: F.regexp_extract_all("text", F.lit(shape), F.lit(i))
        own = texts.select("doc_id", F.explode(F.arrays_zip(part(1).alias("before"), part(2).alias("span"), part(3).alias("after"))).alias("s"))
        own = own.filter("s.before = '' AND s.after = ''").filter(~F.col("s.span").rlike(r"(?U)^\s|\s$")).select("doc_id", keys.title_key(F.col("s.span")).alias("title"))
        found = own if found is None else found.unionByName(own)
    return found.filter("title != ''").distinct()


def title_mentions(texts: DataFrame, entries: DataFrame) -> DataFrame:
    """doc_id, entry: entries whose title (of four words or more) a span of their text is, and whose author it names anywhere."""
    titled = entries.select("doc_id", "entry", keys.title_key(keys.latex_text(F.col("title"))).alias("title"), keys.title_key("surname").alias("name"))
    titled = titled.filter((F.size(F.split("title", " ")) >= TITLE_WORDS) & (F.col("name") != ""))
    met = written(titled.join(title_spans(texts), ["doc_id", "title"]).select("doc_id", "entry", "name"), "mentions")
    folded = texts.join(met.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", F.concat(F.lit(" "), keys.title_key("text"), F.lit(" ")).alias("__folded"))
    names = met.groupBy("doc_id").agg(F.collect_set("name").alias("names"))  # of the works that one text mentions
    named = folded.join(names, "doc_id").select("doc_id", F.explode(F.filter("names", lambda n: F.contains("__folded", F.concat(F.lit(" "), n, F.lit(" "))))).alias("name"))
    return met.join(named, ["doc_id", "name"], "left_semi").select("doc_id", "entry").distinct()


def sighted_letters(texts: DataFrame) -> DataFrame:
    """doc_id, year, letter of every year with a letter, and of letters listed after it."""
    shape = rf"(?<![0-9])({prose.YEAR}[a-z](?![\w])(?:\s*(?:[;,&]|and)\s*[a-z](?![\w]))*+)"
    each = texts.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(shape), F.lit(1))).alias("s"))
    letters = F.regexp_extract_all(F.substr("s", F.lit(5)), F.lit(r"(?<![\w])([a-z])(?![\w])|^([a-z])"), F.lit(0))
    return each.select("doc_id", F.substring("s", 1, 4).alias("year"), F.explode(letters).alias("letter")).distinct()


def _meets(a: Column, b: Column) -> Column:
    return F.coalesce(F.arrays_overlap(a, b), F.lit(False))


def evidence(texts: DataFrame, entries: DataFrame) -> DataFrame:
    """What collision_fate needs for every work in a group: doc_id, group, member, and its and its group's evidence.

    texts: doc_id, text. entries: doc_id, entry (unique), surname and given of
    the first author, second (surname of the second one), n_authors, year,
    letter, title, doi.
    """
    entries = entries.dropDuplicates(["entry"])
    scoped = entries.select("entry", "surname", F.concat_ws("\x01", "doc_id", "year").alias("year"))
    groups = written(cleaning.collision_groups(scoped), "groups")
    no_name = F.array().cast("array<string>")
    spelled = lambda c: F.coalesce(name_variants(F.col(c)), no_name)
    own = entries.join(groups, "entry").select(
        "doc_id", "group", F.col("entry").alias("member"), "year", F.nullif(F.col("letter"), F.lit("")).alias("letter"), "n_authors", spelled("surname").alias("v"), spelled("second").alias("v2"), spelled("given").alias("given"),
        F.nullif(keys.doi_key("doi"), F.lit("")).alias("doi"), F.concat_ws("\x01", keys.title_key(keys.latex_text(F.col("title"))), "year").alias("work"),
    )
    own = written(own, "members")
    n = F.count(F.lit(1))
    apart = lambda c: F.count(c) == F.count_distinct(c)
    whole = own.groupBy("group").agg(((F.count("letter") == n) & apart(F.col("letter")) & apart(F.col("doi")) & apart(F.col("work"))).alias("lettered"), F.flatten(F.collect_set("v")).alias("gv"))
    cited = prose.citations(texts).filter("year IS NOT NULL")
    cited = written(cited.withColumn("inst", F.monotonically_increasing_id()).withColumn("iv", spelled("surname")).withColumn("iv2", spelled("second")), "citations")
    # Citations meet members by year and spelling; each pair once.
    spelling = own.select("doc_id", "year", "group", "member", F.explode("v").alias("s"))
    met = cited.select("doc_id", "year", "inst", F.explode("iv").alias("s")).join(spelling, ["doc_id", "year", "s"]).select("inst", "group", "member").distinct()
    met = met.join(own.select("member", "n_authors", "v2", "given", F.col("letter").alias("own_letter")), "member").join(cited.select("inst", "form", "first", "letter", "continuation", "iv2"), "inst").join(whole.select("group", "lettered"), "group")
    first = F.lower("first")
    named = F.coalesce(_meets(name_variants(F.col("first")), F.col("given")) | F.exists(F.col("given"), lambda g: F.substring(g, 1, 1) == F.rtrim(first, F.lit("."))), F.lit(False))
    both = Window.partitionBy("inst", "group")
    met = met.withColumn("named", named).withColumn("telling", F.max("named").over(both))
    solo = (F.col("n_authors") == 1) & (F.col("first").isNull() | ~F.col("telling") | F.col("named"))
    fits = F.when(F.col("form") == "etal", F.col("n_authors") >= 3).when(F.col("form") == "pair", (F.col("n_authors") == 2) & _meets(F.col("iv2"), F.col("v2"))).otherwise(solo)
    by_letter = F.col("lettered") & F.col("letter").isNotNull()
    met = met.withColumn("fits", F.coalesce(fits, F.lit(False)) & (~by_letter | F.coalesce(F.col("own_letter") == F.col("letter"), F.lit(False))))
    met = met.withColumn("any_fits", F.max("fits").over(both)).withColumn("unmatched", by_letter & ~F.col("any_fits"))
    supported = met.filter("fits").select("member").distinct().withColumn("supported", F.lit(True))
    of_group = met.groupBy("group").agg(F.bool_or(F.col("fits") & ~F.col("continuation")).alias("first_supported"), F.lit(True).alias("first_any"), F.bool_or("unmatched").alias("unmatched_letter"))
    left = prose.rejected_mentions(texts).select("doc_id", "year", F.explode(name_variants(F.col("surname"))).alias("s"))
    rejected = left.join(spelling, ["doc_id", "year", "s"]).select("group").distinct().withColumn("rejected_mention", F.lit(True))
    # A second author of this group, cited after a first one of another, whose work the entries hold.
    pairs = cited.filter("form = 'pair' AND NOT continuation").select("doc_id", "year", "inst", "iv", F.explode("iv2").alias("s"))
    seconds = pairs.join(spelling.select("doc_id", "year", "s", "group").distinct(), ["doc_id", "year", "s"]).select("doc_id", "year", "inst", "iv", "group").distinct()
    seconds = seconds.join(whole.select("group", "gv"), "group").filter(~_meets(F.col("iv"), F.col("gv")))
    holders = entries.filter("n_authors >= 2").select("doc_id", "year", spelled("second").alias("h2"), F.explode(spelled("surname")).alias("s"))
    backed = seconds.select("doc_id", "year", "group", "gv", F.explode("iv").alias("s")).join(holders, ["doc_id", "year", "s"]).filter(_meets(F.col("h2"), F.col("gv")))
    second = backed.select("group").distinct().withColumn("second_only", F.lit(True))
    sighted = sighted_letters(texts).withColumn("sighted", F.lit(True))
    mentioned = title_mentions(texts, entries).select(F.col("entry").alias("member")).withColumn("mentioned", F.lit(True))
    out = own.select("doc_id", "group", "member", "year", "letter").join(supported, "member", "left").join(sighted, ["doc_id", "year", "letter"], "left").join(mentioned, "member", "left")
    for part in (of_group, rejected, second):
        out = out.join(part, "group", "left")
    flags = ["supported", "sighted", "mentioned", "first_supported", "first_any", "unmatched_letter", "rejected_mention", "second_only"]
    return out.select("doc_id", "group", "member", *[F.coalesce(f, F.lit(False)).alias(f) for f in flags])


def resolved(texts: DataFrame, entries: DataFrame) -> DataFrame:
    """doc_id, group, member, kept, reason of every work that shares author and year with another one of its text."""
    return cleaning.collision_fate(evidence(texts, entries)).select("doc_id", "group", "member", "kept", "reason")
