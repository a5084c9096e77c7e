"""Lookups and searches over recorded results: what the services answer, as DataFrames.

A search has a conjunction of filters, an order and a limit; a lookup reports
what it did not find beside what it found; precedence takes the first source
that has a value.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Score floors of a metadata match with and without an author, and the share of title words that must agree.
FLOOR_WITH_AUTHOR, FLOOR_ALONE, TITLE_SHARE = 30, 50, 0.5
#: Acceptance of a review's slug, with its author confirmed and without, and what a confirmed author adds to its score.
SLUG_CONFIRMED, SLUG_ALONE, BONUS = 0.60, 0.75, 0.15


def search(records: DataFrame, terms: str = "", years: tuple[int | None, int | None] = (None, None), least_citations: int | None = None, kind: str | None = None, open_only: bool = False, order: str = "score", limit: int = 20) -> DataFrame:
    """records (title, year, citations, kind, is_open, ord and the order column) that meet all filters, best first.

    The filters reach the scan; order and limit become one bounded top-k.
    """
    tests = [F.contains(F.lower("title"), F.lit(word)) for word in terms.lower().split()]
    tests += [F.col("year") >= years[0]] if years[0] is not None else []
    tests += [F.col("year") <= years[1]] if years[1] is not None else []
    tests += [F.col("citations") >= least_citations] if least_citations is not None else []
    tests += [F.col("kind") == kind] if kind else []
    tests += [F.col("is_open")] if open_only else []
    found = records.filter(reduce(lambda a, b: a & b, tests)) if tests else records
    return found.orderBy(F.desc_nulls_last(order), "ord").limit(limit)


def batch_lookup(ids: DataFrame, records: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """What was found, in the order asked for (ord), and the ids that were not."""
    found = ids.join(records, key).orderBy("ord")
    return found, ids.join(records, key, "left_anti")


def edges_of(edges: DataFrame, node: str, directions: tuple[str, ...] = ("references", "citations"), influential_only: bool = False, limit: int = 1000) -> DataFrame:
    """One hop from a node, in one or both directions: at most `limit` edges each, of which only then the influential stay."""
    ends = {"references": ("source", "target"), "citations": ("target", "source")}
    out = None
    for direction in directions:
        own, other = ends[direction]
        part = edges.filter(F.col(own) == node).orderBy("ord").limit(limit).select(F.lit(direction).alias("direction"), F.col(other).alias("paper"), "influential")
        out = part if out is None else out.unionByName(part)
    return out.filter("influential") if influential_only else out


def degrees(edges: DataFrame) -> DataFrame:
    """node, n, influential, targets, direction: how many edges (source, target, influential) leave and reach each node."""
    out = None
    for direction, own, other in (("references", "source", "target"), ("citations", "target", "source")):
        part = edges.groupBy(F.col(own).alias("node")).agg(F.count(F.lit(1)).alias("n"), F.count_if("influential").alias("influential"), F.count_distinct(other).alias("targets")).withColumn("direction", F.lit(direction))
        out = part if out is None else out.unionByName(part)
    return out


def best_named(venues: DataFrame, name: str, order: str) -> DataFrame:
    """For each name the venue (name, h_index, order) with the largest h-index (unknown: 0), the first among equals."""
    best = venues.groupBy(name).agg(F.max(F.struct(F.coalesce("h_index", F.lit(0)).alias("h"), (-F.col(order)).alias("o"))).alias("b"))
    return best.select(name, (-F.col("b.o")).alias(order), F.col("b.h").alias("h_index"))


def recommended(vectors: DataFrame, examples: DataFrame, group: str, key: str, limit: int = 10) -> DataFrame:
    """group, key, score, place: the vectors (group, key, e: whole numbers) nearest to the sum of their group's examples.

    examples: group, e, sign (1 or -1 for what is not wanted). By inner product,
    so whole numbers give the same result in any order of additions.
    """
    each = examples.select(group, "sign", F.posexplode("e").alias("i", "x")).groupBy(group, "i").agg(F.sum(F.col("x") * F.col("sign")).alias("c"))
    centre = each.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "c"))), lambda s: s["c"]).alias("centre"))
    dot = F.aggregate(F.zip_with("e", "centre", lambda a, b: a * b), F.lit(0).cast("long"), lambda a, x: a + x)
    scored = vectors.join(centre, group).select(group, key, dot.alias("score"))
    w = Window.partitionBy(group).orderBy(F.desc("score"), key)
    return scored.withColumn("place", F.row_number().over(w).cast("long")).filter(F.col("place") <= limit)


def site_results(results: DataFrame, path: str, id_pattern: str) -> DataFrame:
    """Web results (url) under a path from which an id can be read; each id once, at its first place (ord)."""
    with_id = results.filter(F.contains("url", F.lit(path))).withColumn("id", F.regexp_extract("url", id_pattern, 1)).filter("id != ''")
    rest = [c for c in with_id.columns if c != "id"]
    return with_id.groupBy("id").agg(F.min_by(F.struct(*rest), "ord").alias("r")).select("id", "r.*")


def best_review(books: DataFrame, slugs: DataFrame) -> DataFrame:
    """book, slug, score: the best slug of each book (book, title, author) that is good enough; the first among equals.

    Equal books are looked up once. A title of n tokens whose slug must have m
    of them has one of its n - m + 1 rarest in common with every good slug: only
    such pairs are scored, so that common words bring none together.
    """
    from citeloom.functions.keys import title_tokens
    from citeloom.operators.matching import slug_score

    text = lambda c: F.coalesce(c, F.lit(""))
    asked = books.select("book", text("title").alias("title"), text("author").alias("author"))
    once = asked.select("title", "author").distinct()
    other = slugs.groupBy("slug").agg(F.min("ord").alias("ord")).withColumn("theirs", title_tokens(F.replace("slug", F.lit("-"), F.lit(" "))))
    each = other.select("slug", "ord", F.explode("theirs").alias("token"))
    frequency = each.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    # The least share that may do: a confirmed author adds BONUS.
    need = F.greatest(F.lit(1), F.ceil((SLUG_CONFIRMED - BONUS) * F.size("r") - 1e-6)).cast("int")
    by_rarity = once.select("title", "author", F.explode(title_tokens("title")).alias("token")).join(frequency, "token", "left").groupBy("title", "author").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token"))).alias("r"))
    rare = by_rarity.select("title", "author", F.explode(F.slice(F.col("r.token"), F.lit(1), F.size("r") - need + 1)).alias("token"))
    pairs = rare.join(each, "token").select("title", "author", "slug", "ord").distinct()
    confirmed = (F.col("author") != "") & F.contains(F.replace("slug", F.lit("-"), F.lit(" ")), F.lower("author"))
    scored = pairs.withColumn("score", slug_score(F.col("title"), F.col("slug"), F.col("author")))
    good = scored.filter((F.col("score") >= SLUG_ALONE) | (confirmed & (F.col("score") >= SLUG_CONFIRMED)))
    best = good.groupBy("title", "author").agg(F.max(F.struct("score", (-F.col("ord")).alias("o"), "slug")).alias("b"))
    return asked.join(best, ["title", "author"]).select("book", "b.slug", "b.score")


def metadata_match(candidates: DataFrame) -> DataFrame:
    """The best candidate of each query (query, author, year, score, authors, years, ord), if it is good enough.

    A year rejects only if every known date is more than one off.
    """
    floor = F.when(F.coalesce("author", F.lit("")) != "", FLOOR_WITH_AUTHOR).otherwise(FLOOR_ALONE)
    named = (F.coalesce("author", F.lit("")) == "") | F.contains(F.lower("authors"), F.lower("author"))
    dated = F.col("year").isNull() | (F.size("years") == 0) | F.exists("years", lambda y: F.abs(y - F.col("year")) <= 1)
    best = candidates.withColumn("__rn", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "ord"))).filter("__rn = 1").drop("__rn")
    return best.filter((F.col("score") >= floor) & F.coalesce(named, F.lit(False)) & F.coalesce(dated, F.lit(True)))


def title_agrees(asked: Column, found: Column) -> Column:
    """Whether half of the asked title's longer words are in the found one."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda w: F.length(w) > 3))
    a = words(asked)
    return F.size(F.array_intersect(a, words(found))) >= TITLE_SHARE * F.greatest(F.size(a), F.lit(1))


def first_source(sources: list[tuple[str, Column]]) -> Column:
    """The first value that is there, with the name of its source; null if none is."""
    return F.coalesce(*[F.when(F.coalesce(value, F.lit("")) != "", F.struct(value.alias("value"), F.lit(name).alias("source"))) for name, value in sources])


def admitted(work: DataFrame, cost: str, order: list[str], group: str, budget: float) -> DataFrame:
    """work with admitted: whether the costs of the group's earlier items left any of the budget."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return work.withColumn("admitted", F.coalesce(F.sum(cost).over(w), F.lit(0)) < budget)


def sampled_terms(values: DataFrame, key: Column, raw: str, limit: int = 80) -> DataFrame:
    """One lookup for each key: the smallest spelling stands for it; the first `limit` keys in order are looked up."""
    return values.select(key.alias("key"), F.col(raw).alias("raw")).filter("key != ''").groupBy("key").agg(F.min("raw").alias("raw")).orderBy("key").limit(limit)
