"""De-duplication of entries: ordered folds, vetoes, lineage, letters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.operators.components import connected_components
from citeloom.session import written

#: Fields that count as substance when entries are compared and merged.
SUBSTANCE = ("journal", "booktitle", "volume", "number", "pages", "publisher", "doi", "url", "abstract", "sep_context", "iep_context")
IMPORTANCE = ("Low", "Medium", "High")


def importance(keywords: Column) -> Column:
    """2, 1 or 0 for High, Medium and Low, found as parts of words; Low without any."""
    x = F.coalesce(keywords, F.lit(""))
    return F.when(F.contains(x, F.lit("High")), 2).when(F.contains(x, F.lit("Medium")), 1).otherwise(0)


def merged_fields(winner: Column, loser: Column, removed: Column) -> Column:
    """The winner's fields; gaps in its substance filled from the loser, but for removed ones."""
    filled = F.map_zip_with(winner, loser, lambda k, a, b: F.when(k.isin(*SUBSTANCE) & ~F.array_contains(removed, k), F.coalesce(F.nullif(a, F.lit("")), b)).otherwise(a))
    return F.map_filter(filled, lambda k, v: v.isNotNull())


def merge_pair(first: Column, second: Column) -> Column:
    """Structs ord, key, fields, keywords, removed, lineage: who survives, with what.

    An abstract beats none, then importance, else the first stays. The
    survivor takes the higher importance when an abstract decided, loses what
    the other's marker says was removed, and remembers all it absorbed.
    """
    has = lambda e: F.length(F.coalesce(F.try_element_at(e["fields"], F.lit("abstract")), F.lit(""))) > 10
    later = F.when(has(first) != has(second), has(second)).otherwise(importance(second["keywords"]) > importance(first["keywords"]))
    win = lambda f: F.when(later, second[f]).otherwise(first[f])
    lose = lambda f: F.when(later, first[f]).otherwise(second[f])
    removed = F.array_union(win("removed"), lose("removed"))
    level = F.greatest(importance(first["keywords"]), importance(second["keywords"]))
    words = F.array(*map(F.lit, IMPORTANCE))
    raised = F.when(importance(win("keywords")) < level, F.concat_ws(", ", F.filter(F.split(win("keywords"), r",\s*"), lambda w: ~w.isin(*IMPORTANCE)), F.element_at(words, level + 1))).otherwise(win("keywords"))
    fields = F.map_filter(merged_fields(win("fields"), lose("fields"), removed), lambda k, v: ~F.array_contains(removed, k))
    return F.struct(F.least(first["ord"], second["ord"]).alias("ord"), win("key").alias("key"), fields.alias("fields"), raised.alias("keywords"), removed.alias("removed"), F.array_union(first["lineage"], second["lineage"]).alias("lineage"))


def fold_groups(entries: DataFrame, group: str, with_lineage: bool = True, with_group: bool = False) -> DataFrame:
    """One survivor for each group of entries (ord, key, fields, keywords, removed, lineage), as merge_pair folds them in order.

    Rows without a group stay as they are, and so does a row alone in its
    group. Nothing is folded row by row: the survivor changes only at a group's
    first row with an abstract and at its first rows of a higher importance, so
    all follows from aggregates of a few rows each, however large a group is.
    A gap is filled from the latest of these leaders that has the field, else
    from the first row that has; blank values fill nothing, and an abstract is
    never among the removed fields. lineage is as long as its group: without it
    `fold_lineage` gives the same as rows. with_group: the group is a column of
    the result, too, under its own name.
    """
    columns = ["ord", "key", "fields", "keywords", "removed"] + (["lineage"] if with_lineage else [])
    own = entries.filter(F.col(group).isNotNull()).withColumn("__g", F.col(group))
    place = F.struct("ord", "key")
    has = F.length(F.coalesce(F.try_element_at("fields", F.lit("abstract")), F.lit(""))) > 10
    level = importance(F.col("keywords"))
    row = F.struct("ord", "key", "fields", "keywords", has.alias("has"))
    first = lambda test: F.min_by(row, F.when(test, place))
    leaders = {"__c0": F.lit(True), "__abs": has, "__i1": level >= 1, "__i2": level >= 2}
    heads = own.groupBy("__g").agg(*[first(test).alias(name) for name, test in leaders.items()], F.max(level).alias("__top"), F.count(F.lit(1)).alias("__n"), F.min_by("removed", place).alias("__own"))
    removed = own.select("__g", F.explode("removed").alias("k")).groupBy("__g").agg(F.array_sort(F.collect_set("k")).alias("__removed"))
    substance = F.array(*map(F.lit, SUBSTANCE))
    filling = own.select("__g", place.alias("__at"), F.explode(F.map_filter("fields", lambda k, v: k.isin(*SUBSTANCE) & (v != ""))).alias("k", "v"))
    fills = filling.groupBy("__g", "k").agg(F.min_by("v", "__at").alias("v")).groupBy("__g").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("__fill"))
    all_of = heads.join(removed, "__g", "left").join(fills, "__g", "left")
    # An entry of higher importance leads only if the first abstract is not before it, or it has one itself.
    later = lambda c: F.col(c)["ord"].isNotNull() & (F.col("__abs").isNull() | F.col(c)["has"] | (F.struct(F.col(c)["ord"], F.col(c)["key"]) < F.struct(F.col("__abs")["ord"], F.col("__abs")["key"])))
    chain = F.filter(F.array("__c0", "__abs", F.when(later("__i1"), F.col("__i1")), F.when(later("__i2"), F.col("__i2"))), lambda x: x.isNotNull())
    after = lambda a, b: F.struct(a["ord"], a["key"]) > F.struct(b["ord"], b["key"])
    all_of = all_of.withColumn("__chain", F.array_sort(chain, lambda a, b: after(b, a).cast("int") - after(a, b).cast("int"))).withColumn("__win", F.element_at("__chain", 1))
    gone = F.coalesce("__removed", F.array().cast("array<string>"))
    led = lambda k: F.try_element_at(F.filter(F.transform("__chain", lambda c: F.nullif(F.try_element_at(c["fields"], k), F.lit(""))), lambda v: v.isNotNull()), F.lit(1))
    filled = F.transform(substance, lambda k: F.struct(k.alias("k"), F.coalesce(led(k), F.try_element_at("__fill", k)).alias("v")))
    plain = F.map_filter(F.coalesce(F.col("__win.fields"), F.create_map().cast("map<string,string>")), lambda k, v: ~k.isin(*SUBSTANCE) & v.isNotNull())
    fields = F.map_filter(F.map_concat(plain, F.map_from_entries(F.filter(filled, lambda s: s["v"].isNotNull()))), lambda k, v: ~F.array_contains(gone, k))
    words = F.col("__win.keywords")
    raised = F.when(importance(words) < F.col("__top"), F.concat_ws(", ", F.filter(F.split(words, r",\s*"), lambda w: ~w.isin(*IMPORTANCE)), F.element_at(F.array(*map(F.lit, IMPORTANCE)), F.col("__top") + 1))).otherwise(words)
    alone = F.col("__n") == 1
    survivors = all_of.select("__g", F.col("__c0.ord").alias("ord"), F.col("__win.key").alias("key"), F.when(alone, F.col("__win.fields")).otherwise(fields).alias("fields"), raised.alias("keywords"), F.when(alone, F.col("__own")).otherwise(gone).alias("removed"))
    if with_lineage:
        listed = F.transform(F.array_sort(F.collect_list(F.struct("ord", "key", "lineage"))), lambda s: s["lineage"])
        survivors = survivors.join(own.groupBy("__g").agg(F.array_distinct(F.flatten(listed)).alias("lineage")), "__g")
    shown = [*columns, *([group] if with_group else [])]
    return survivors.withColumn(group, F.col("__g")).select(shown).unionByName(entries.filter(F.col(group).isNull()).select(shown))


def fold_lineage(entries: DataFrame, group: str, survivors: DataFrame) -> DataFrame:
    """key, member: every entry's own key under that of its group's survivor; a survivor is its own member.

    survivors: of fold_groups with its groups (with_group). Without them they
    are folded again here, as nothing else tells which group one comes from.
    """
    if group not in survivors.columns:
        survivors = fold_groups(entries, group, with_lineage=False, with_group=True)
    own = entries.filter(F.col(group).isNotNull()).select(F.col(group).alias("g"), F.col("key").alias("member"))
    led = survivors.filter(F.col(group).isNotNull()).select(F.col(group).alias("g"), "key")
    return own.join(led, "g").select("key", "member").unionByName(entries.filter(F.col(group).isNull()).select("key", F.col("key").alias("member")))


def cascade(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Survivor of each row after passes by one key after the other: order, survivor, passes (how many merged it).

    A pass joins survivors of the pass before that share a key, their own or
    that of a row they absorbed; the smallest order of a group survives. Empty
    and null keys group nothing.
    """
    # Every pass reads the keys twice: they are computed once and written, narrow as they are.
    now = written(rows.select(F.col(order).alias("__id"), *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]), "keys")
    now = now.withColumn("survivor", F.col("__id")).withColumn("passes", F.lit(0))
    for i in range(len(keys)):
        # The keys of all that a survivor has absorbed, as narrow rows.
        each = now.select("survivor", F.col(f"__k{i}").alias("k")).filter("k IS NOT NULL AND k != ''").distinct()
        now = now.join(_least_of(each, i > 0), "survivor", "left").withColumn("least", F.coalesce("least", "survivor"))
        now = now.withColumn("passes", F.col("passes") + (F.col("least") != F.col("survivor")).cast("int")).withColumn("survivor", F.col("least")).drop("least")
    return now.select(F.col("__id").alias(order), "survivor", "passes")


def _least_of(each: DataFrame, several_keys: bool) -> DataFrame:
    """survivor, least for the smallest survivor that shares a key (survivor, k), directly or through others."""
    star = each.groupBy("k").agg(F.min("survivor").alias("least"))
    edges = each.join(star, "k").select(F.col("survivor").alias("a"), F.col("least").alias("b"))
    several = edges.groupBy("a").agg(F.min("b").alias("low"), F.max("b").alias("high")).filter("low != high")
    if not several_keys or several.isEmpty():  # one step is enough, as long as nothing has two keys that lead to different rows
        return edges.groupBy(F.col("a").alias("survivor")).agg(F.min("b").alias("least"))
    return connected_components(edges).select(F.col("node").alias("survivor"), F.col("label").alias("least"))


def work_clusters(works: DataFrame) -> DataFrame:
    """id, cluster, tainted for works (id, doi, title): equal DOIs join; equal titles join unless their DOIs differ.

    Clusters are the components of both kinds of links, whatever the order of
    the works. A work without DOI under a title with several DOIs may be any
    of them: it is tainted.
    """
    title = works.filter("title != ''").groupBy("title").agg(F.count_distinct(F.nullif(F.col("doi"), F.lit(""))).alias("n_dois"))
    several = F.coalesce(F.col("n_dois") > 1, F.lit(False))
    # Nodes are DOIs and titles without veto; a work links its own two.
    by_doi = F.when(F.col("doi") != "", F.concat(F.lit("d"), "doi"))
    by_title = F.when((F.col("title") != "") & ~several, F.concat(F.lit("t"), "title"))
    keyed = works.join(title, "title", "left").select("id", (several & (F.col("doi") == "")).alias("tainted"), by_doi.alias("a"), by_title.alias("b"))
    labels = connected_components(keyed.select("a", "b"))
    named = keyed.withColumn("key", F.coalesce("a", "b")).join(labels, F.col("key") == F.col("node"), "left").withColumn("label", F.coalesce("label", "key"))
    least = named.filter("label IS NOT NULL").groupBy("label").agg(F.min("id").alias("least"))
    return named.join(least, "label", "left").select("id", F.coalesce("least", "id").alias("cluster"), "tainted")


def letters(works: DataFrame, group: list[str], order: list[str], taint: str | None = None) -> DataFrame:
    """works with letter: a to z in order within groups of 2 to 26 works; none in tainted groups."""
    w = Window.partitionBy(*group)
    out = works.withColumn("__n", F.count(F.lit(1)).over(w)).withColumn("__rn", F.row_number().over(w.orderBy(*order)))
    bad = F.max(F.col(taint).cast("int")).over(w) == 1 if taint else F.lit(False)
    out = out.withColumn("__bad", bad)
    return out.withColumn("letter", F.when(~F.col("__bad") & F.col("__n").between(2, 26), F.chr(F.lit(96) + F.col("__rn")))).drop("__n", "__rn", "__bad")


def marked_removed(keywords: Column) -> Column:
    """Names of the fields that a cleaning marker says were removed; changes of year or type are none."""
    listed = F.regexp_extract(F.coalesce(keywords, F.lit("")), r"METADATA\\*_CLEANED:\s*(.*)$", 1)
    return F.array_distinct(F.filter(F.transform(F.split(listed, ","), lambda x: F.lower(F.trim(x))), lambda x: (x != "") & ~F.contains(x, F.lit(":"))))


def cited_groups(entries: DataFrame) -> DataFrame:
    """key, group of cited entries (key, doi, work): equal DOIs are one work, and so are equal work keys unless their DOIs differ.

    Under a work key with several DOIs each DOI is a group of its own, and the
    entries without one are a group, too: nothing says whose copies they are.
    The order of the entries plays no part. Null and empty keys join nothing.
    """
    doi, work = F.nullif(F.col("doi"), F.lit("")), F.nullif(F.col("work"), F.lit(""))
    own = entries.select("key", doi.alias("doi"), work.alias("work"))
    dois = own.filter("work IS NOT NULL").groupBy("work").agg(F.min("doi").alias("low"), F.max("doi").alias("high"))
    sole = F.when(F.col("low") == F.col("high"), F.col("low"))
    met = own.join(dois.select("work", sole.alias("sole")), "work", "left")
    by_doi = F.concat(F.lit("doi "), F.coalesce("doi", "sole"))
    return met.select("key", F.coalesce(by_doi, F.concat(F.lit("work "), "work"), F.concat(F.lit("key "), "key")).alias("group"))


def cited_merge(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One survivor for each group of cited entries (key, doi, work, fields), and where every entry went.

    Survivors: key, fields, members, suffix_conflict. Redirects: key, survivor.
    The entry with most fields of substance survives, of equals the one with the
    least key. Its gaps are filled from the next best that has the field. What
    another entry's marker says was removed is taken out and named in the
    survivor's marker; what any marker names fills no gap. A year_suffix that
    lacks is taken over; if two differ, the survivor's stays and the conflict
    is told. A total order decides all, so the order of rows changes nothing,
    and a group of any size is aggregated before it meets in one row.
    """
    field = lambda name: F.coalesce(F.try_element_at("fields", F.lit(name)), F.lit(""))
    score = F.size(F.filter(F.array(*[field(f) for f in SUBSTANCE]), lambda v: F.trim(v) != ""))
    own = entries.join(cited_groups(entries), "key").select("group", "key", "fields", F.struct((-score).alias("s"), "key").alias("rank"), marked_removed(field("keywords")).alias("removed"))
    own = written(own, "cited")
    head = own.groupBy("group").agg(F.min_by(F.struct("key", "fields", "removed"), "rank").alias("w"), F.count(F.lit(1)).alias("members"))
    gone = own.select("group", "key", F.explode("removed").alias("k")).groupBy("group", "k").agg(F.min("key").alias("low"), F.max("key").alias("high"))
    gone = gone.join(head.select("group", "w.key"), "group")
    others = (F.col("low") != F.col("key")) | (F.col("high") != F.col("key"))
    gone = gone.groupBy("group").agg(F.array_sort(F.collect_set("k")).alias("blocked"), F.array_sort(F.collect_set(F.when(others, F.col("k")))).alias("verdicts"))  # names of fields: few
    given = own.select("group", "rank", F.explode(F.map_filter("fields", lambda k, v: (k.isin(*SUBSTANCE) | (k == "year_suffix")) & (F.trim(v) != ""))).alias("k", "v"))
    fill = given.groupBy("group", "k").agg(F.min_by("v", "rank").alias("v"), (F.min("v") != F.max("v")).alias("differ"))
    fill = fill.groupBy("group").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("fill"), F.bool_or((F.col("k") == "year_suffix") & F.col("differ")).alias("conflict"))
    none = F.array().cast("array<string>")
    met = head.join(gone, "group", "left").join(fill, "group", "left").withColumn("blocked", F.coalesce("blocked", none)).withColumn("verdicts", F.coalesce("verdicts", none))
    has = lambda k: F.trim(F.coalesce(F.try_element_at("w.fields", k), F.lit(""))) != ""
    filled = F.map_filter(F.coalesce("fill", F.create_map().cast("map<string,string>")), lambda k, v: ~has(k) & ~F.array_contains("blocked", k))
    kept = F.map_filter(F.coalesce("w.fields", F.create_map().cast("map<string,string>")), lambda k, v: ~F.array_contains("verdicts", k) & ~F.map_contains_key("filled", k) & (k != "keywords"))
    words = F.regexp_replace(F.coalesce(F.try_element_at("w.fields", F.lit("keywords")), F.lit("")), r"[\s,]+$", "")
    news = F.array_join(F.array_except("verdicts", F.col("w.removed")), ", ")
    marked = F.when(news == "", words).when(words.rlike(r"METADATA\\*_CLEANED:"), F.concat_ws(", ", words, news)).otherwise(F.concat_ws(", ", F.nullif(words, F.lit("")), F.concat(F.lit("METADATA_CLEANED: "), news)))
    keywords = F.map_filter(F.create_map(F.lit("keywords"), F.nullif(marked, F.lit(""))), lambda k, v: v.isNotNull())
    survivors = met.withColumn("filled", filled).select(F.col("w.key").alias("key"), F.map_concat(kept, "filled", keywords).alias("fields"), "members", F.coalesce("conflict", F.lit(False)).alias("suffix_conflict"))
    return survivors, own.join(head.select("group", F.col("w.key").alias("survivor")), "group").select("key", "survivor")
