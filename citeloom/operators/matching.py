"""Joins of entries and evidence: priority, abstention, proximity, overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def priority_join(entries: DataFrame, records: DataFrame, key: str, scoped: str, order: list[str]) -> DataFrame:
    """Each entry with its best record of the same non-empty key: scoped ones first, else the first in order.

    The best record of a key is found by an aggregate, which combines before
    the shuffle, so one hot key does no harm.
    """
    rank = F.struct((~F.col(scoped)).cast("int").alias("p"), *order)
    rest = [c for c in records.columns if c != key]
    best = records.filter(F.col(key).isNotNull() & (F.col(key) != "")).groupBy(key).agg(F.min_by(F.struct(*rest), rank).alias("record"))
    return entries.join(best, key, "left")


def conflicts(values: DataFrame, key: str, value: str, source: str) -> DataFrame:
    """Keys with two different values or more: key, value, sources (sorted)."""
    each = values.filter(F.col(value).isNotNull() & (F.col(value) != "")).groupBy(key, value).agg(F.sort_array(F.collect_set(source)).alias("sources"))
    several = each.groupBy(key).agg(F.count(F.lit(1)).alias("n_values")).filter("n_values >= 2")
    return each.join(several, key)


def resolve(entries: DataFrame, records: DataFrame) -> DataFrame:
    """entries (entry, doi, title, year: keys) with outcome and record.

    records: doi, title, year, scoped, ord, filled (array of the fields they supply), record.
    First case that holds: scoped records of the DOI disagree about the year
    (abstain); a scoped record has the year that the best lacks and supplies
    no less; the best record; pooled records disagree and no scoped one has a
    year (abstain); title and year are equal; unmatched.
    """
    order = F.struct((~F.col("scoped")).cast("int").alias("p"), "ord")
    with_year = F.col("year") != ""
    by_doi = records.filter("doi != ''").groupBy("doi").agg(
        F.min_by(F.struct("record", "year", "scoped", "filled"), order).alias("best"),
        F.collect_set(F.when(F.col("scoped") & with_year, F.col("year"))).alias("scoped_years"),
        F.collect_set(F.when(with_year, F.col("year"))).alias("years"),
    )
    # Of dated records that supply the same fields the first is enough, so that a DOI has only as many as there are sets of fields.
    firsts = records.filter((F.col("doi") != "") & F.col("scoped") & with_year).groupBy("doi", F.array_sort("filled").alias("filled")).agg(F.min("ord").alias("ord"), F.min_by("record", "ord").alias("record"))
    dated = firsts.groupBy("doi").agg(F.array_sort(F.collect_list(F.struct("ord", "record", "filled"))).alias("dated"))
    by_doi = by_doi.join(dated, "doi", "left").withColumn("dated", F.coalesce("dated", F.array()))
    by_title = records.filter("title != '' AND year != ''").groupBy("title", "year").agg(F.min_by("record", "ord").alias("titled"))
    joined = entries.join(by_doi, "doi", "left").join(by_title, ["title", "year"], "left")
    best = F.col("best")
    fuller = F.filter("dated", lambda d: F.size(F.array_except(best["filled"], d["filled"])) == 0)
    lone = best["scoped"] & (best["year"] == "") & (F.size("scoped_years") == 1) & (F.size(fuller) > 0)
    outcome = (
        F.when(best.isNotNull() & best["scoped"] & (F.size("scoped_years") > 1), "scoped_year_disagreement")
        .when(best.isNotNull() & lone, "swapped")
        .when(best.isNotNull() & (F.size("scoped_years") == 0) & (F.size("years") >= 2), "pooled_year_conflict")
        .when(best.isNotNull(), "doi")
        .when(F.col("titled").isNotNull(), "title")
        .otherwise("unmatched")
    )
    joined = joined.withColumn("outcome", outcome)
    record = F.when(F.col("outcome") == "swapped", F.try_element_at(fuller, F.lit(1))["record"]).when(F.col("outcome") == "doi", best["record"]).when(F.col("outcome") == "title", F.col("titled"))
    return joined.select(*entries.columns, "outcome", record.alias("record"))


RUNS = r"[A-Za-z0-9_]+|[^\x00-\x7F]"


def name_anchor(name: Column) -> Column:
    """The longest run of ASCII word characters of a name, else its first other letter; null if it has neither.

    A text that holds the name at word bounds has this as one of its name_runs.
    """
    runs = F.regexp_extract_all(name, F.lit(RUNS), F.lit(0))
    best = F.array_max(F.transform(runs, lambda r: F.struct(F.rlike(r, F.lit("^[A-Za-z0-9_]")).alias("ascii"), F.length(r).alias("n"), r.alias("r"))))
    return best["r"]


def name_runs(text: Column) -> Column:
    """The different runs of a text that a name's anchor can be."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(RUNS), F.lit(0)))


def years_in(text: Column) -> Column:
    """The different numbers of exactly four digits."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?<![0-9])([0-9]{4})(?![0-9])"), F.lit(1)))


def names_with_years(texts: DataFrame, key: list[str], text: str, works: DataFrame) -> DataFrame:
    """texts (key, text) with each work (surname, year and more) whose name, at word bounds, and year they hold.

    Works and texts meet in year and name, not in years alone, and only keys
    are dealt for it: a year with a third of all rows brings no pairs together.
    A work without a name or year meets nothing.
    """
    own = works.withColumn("__run", name_anchor(F.col("surname"))).filter("__run IS NOT NULL AND year IS NOT NULL")
    wanted = own.select("year", "__run").distinct()
    dated = texts.select(*key, years_in(F.col(text)).alias("years"), F.col(text).alias("__t")).filter(F.size("years") > 0)
    each = dated.select(*key, F.explode("years").alias("year"), name_runs(F.col("__t")).alias("runs")).select(*key, "year", F.explode("runs").alias("__run"))
    places = each.join(wanted, ["year", "__run"]).distinct()
    held = texts.join(places, key).filter(F.array_contains(years_in(F.col(text)), F.col("year")))
    return held.join(own, ["year", "__run"]).filter(F.rlike(text, F.concat(F.lit(r"\b\Q"), "surname", F.lit(r"\E\b")))).drop("__run")


def within(a: DataFrame, b: DataFrame, group: str, pos_a: str, pos_b: str, width: int) -> DataFrame:
    """Rows of a and b of one group at most `width` apart: a range join by buckets of that width.

    Each row of a looks into its own bucket and both neighbours, so nothing
    but near rows meets.
    """
    left = a.withColumn("__bucket", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor(F.col(pos_a) / width) + d)))
    right = b.withColumn("__bucket", F.floor(F.col(pos_b) / width))
    near = F.abs(left[pos_a] - right[pos_b]) <= width
    return left.join(right, [group, "__bucket"]).filter(near).drop("__bucket")


def overlap_best(items: DataFrame, targets: DataFrame, least: int = 2, coverage: float = 0.5) -> DataFrame:
    """For each item (item, tokens) the target (target, tokens) that shares most of its tokens.

    At least `least` tokens and that share of the item's tokens; the smallest
    target among equals. Equal token sets are one class, and classes meet only
    in tokens that matter: an item of n tokens that must share m has one of its
    n - m + 1 rarest tokens in common with every such target. So the common
    tokens bring no pairs together.
    """
    as_set = F.array_sort(F.array_distinct("tokens"))
    own = items.select("item", as_set.alias("tokens"))
    sets = own.select("tokens").distinct()
    others = targets.groupBy(as_set.alias("theirs")).agg(F.min("target").alias("target"))
    frequency = targets.select(F.explode(F.array_distinct("tokens")).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    need = F.greatest(F.lit(least), F.ceil(F.size("tokens") * coverage)).cast("int")
    each = sets.select("tokens", F.explode("tokens").alias("token")).join(frequency, "token", "left")
    by_rarity = each.groupBy("tokens").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token"))).alias("r"))
    rare = by_rarity.filter(F.size("tokens") >= need).select("tokens", need.alias("need"), F.explode(F.slice(F.col("r.token"), F.lit(1), F.size("tokens") - need + 1)).alias("token"))
    pairs = rare.join(others.select("target", "theirs", F.explode("theirs").alias("token")), "token")
    shared = F.size(F.array_intersect("tokens", "theirs"))
    good = pairs.filter(shared >= F.col("need")).select("tokens", "target", (shared / F.size("tokens")).alias("score"))
    best = good.groupBy("tokens").agg(F.max(F.struct("score", (-F.col("target")).alias("t"))).alias("best"))
    return own.join(best, "tokens").select("item", (-F.col("best.t")).alias("target"), F.col("best.score").alias("score"))


GRAM = 8


def mentions(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id of documents (doc_id, text) that hold all words of an item (item_id, text) in a row.

    Words are lower-cased and apart by white space. An item is looked up by its
    first GRAM words, a shorter one by all it has; what is exploded and joined
    carries hashes and positions only, and the words of a document are fetched
    again for its hits. Items without words match nothing.
    """
    from citeloom.session import written

    words = lambda c: F.split(F.trim(F.regexp_replace(F.lower(c), r"\s+", " ")), " ")
    own = docs.select("doc_id", words("text").alias("w"))
    wanted = items.select("item_id", words("text").alias("v")).filter("v != array('')").withColumn("n", F.least(F.size("v"), F.lit(GRAM)))
    wanted = written(wanted.withColumn("g", F.xxhash64("n", F.slice("v", F.lit(1), F.col("n")))), "items")
    lengths = [r["n"] for r in wanted.select("n").distinct().orderBy("n").collect()]  # GRAM values at most
    if not lengths:
        return docs.select("doc_id").limit(0).join(items.select("item_id").limit(0), F.lit(True))
    none = F.array().cast("array<struct<g:bigint,i:int>>")

    def grams(n: int):
        at = F.sequence(F.lit(1), F.size("w") - (n - 1))
        return F.when(F.size("w") >= n, F.transform(at, lambda i: F.struct(F.xxhash64(F.lit(n), F.slice("w", i, n)).alias("g"), i.alias("i")))).otherwise(none)

    each = own.select("doc_id", F.explode(F.concat(*map(grams, lengths))).alias("x")).select("doc_id", "x.g", "x.i")
    hits = written(each.join(wanted.select("g", "item_id"), "g").select("doc_id", "item_id", "i"), "hits")
    found = own.join(hits, "doc_id").join(wanted.select("item_id", "v"), "item_id")
    return found.filter(F.slice("w", F.col("i"), F.size("v")) == F.col("v")).select("doc_id", "item_id").distinct()


def slug_score(title: Column, slug: Column, author: Column) -> Column:
    """Share of the title's tokens that a slug has, with a bonus of 0.15 for the author's name.

    A title of one token needs the author.
    """
    from citeloom.functions.keys import title_tokens

    words, text = title_tokens(title), F.replace(slug, F.lit("-"), F.lit(" "))
    share = F.size(F.array_intersect(words, title_tokens(text))) / F.size(words)
    confirmed = F.coalesce((author != "") & F.contains(text, F.lower(author)), F.lit(False))
    bonus = F.when(confirmed, 0.15).otherwise(0.0)
    single = F.when(confirmed, F.least(share * 0.5 + bonus, F.lit(1.0))).otherwise(0.0)
    return F.when((F.size(words) == 0) | (share == 0), 0.0).when(F.size(words) < 2, single).otherwise(F.least(share + bonus, F.lit(1.0)))
