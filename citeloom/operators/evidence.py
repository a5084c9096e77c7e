"""Evidence: cleaning plans behind a breaker, gates, tiers, freshness, merges of ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The least number of stripped entries and the share beyond which nothing is written.
BREAKER_LEAST, BREAKER_SHARE = 5, 0.30
#: Texts that only a blocked or empty page has.
BOILERPLATE = ("just a moment", "enable javascript", "checking your browser", "verify you are human", "accept all cookies", "attention required! | cloudflare")
LEAST_TEXT, LEAST_WORDS, MOST_WORDS, MOST_SPANS = 200, 6, 40, 2
#: Evidence tiers from none to best, ranks 0 to 4.
TIERS = ("NONE", "EXISTENCE", "WEB", "CONTEXT", "ABSTRACT")
DAY = 86_400
#: Seconds for which a result, a clear verdict and a flag hold.
TTL, CLEAR_TTL, FLAGGED_TTL = 7 * DAY, 180 * DAY, 45 * DAY


def with_breaker(plan: DataFrame, stripped: str, group: list[str]) -> DataFrame:
    """plan with tripped: whether its group would lose fields from too many entries (five or more, and over 0.30 of them)."""
    share = plan.groupBy(*group).agg(F.count(F.lit(1)).alias("__all"), F.count_if(F.col(stripped)).alias("__hit"))
    tripped = (F.col("__hit") >= BREAKER_LEAST) & (F.col("__hit") * 100 > F.col("__all") * int(100 * BREAKER_SHARE))
    return plan.join(share.select(*group, tripped.alias("tripped")), group)


def capture_gate(url_bound: Column, error: Column, provenance: Column, status: Column, text: Column, anchor: Column, title: Column, spans: Column) -> Column:
    """The first reason for which a web capture is no evidence, or `ok`. Unknown values never pass."""
    from citeloom.functions.keys import containment_text, let, title_key

    words = lambda x: F.filter(F.split(title_key(x), " "), lambda w: F.length(w) > 3)
    size = lambda s: F.size(F.split(s, " "))
    good_status = F.coalesce((F.coalesce(provenance, F.lit("script")) == "agent") | status.between(200, 299), F.lit(False))
    shared = let(words(title), lambda t: (F.size(t) > 0) & ~F.arrays_overlap(t, words(F.coalesce(anchor, F.substring(text, 1, 1000)))))

    def against(folded: Column, quoted: Column) -> Column:
        """The reasons that need the folded text and spans, which are computed once each."""
        return (
            F.when(F.exists(F.array(*map(F.lit, BOILERPLATE)), lambda sign: F.contains(folded, sign)), "boilerplate")
            .when(F.length(text) < LEAST_TEXT, "thin")
            .when(shared, "title_mismatch")
            .when((F.size(quoted) < 1) | (F.size(quoted) > MOST_SPANS) | F.exists(quoted, lambda s: ~size(s).between(LEAST_WORDS, MOST_WORDS)), "span_malformed")
            .when(F.exists(quoted, lambda s: ~F.contains(folded, s)), "span_unverified")
            .otherwise("ok")
        )

    return (
        F.when(text.isNull() & error.isNull(), "no_capture")
        .when(error.isNotNull(), "fetch_error")
        .when(~F.coalesce(url_bound, F.lit(False)), "url_mismatch")
        .when(~good_status, "bad_status")
        .otherwise(let(F.struct(containment_text(text).alias("t"), F.transform(spans, containment_text).alias("s")), lambda f: against(f["t"], f["s"])))
    )


def existence(status: Column, same_domain: Column, archived: Column) -> Column:
    """How a page is known to exist: direct, bot_block, archive or none."""
    return F.when(status.between(200, 299) & same_domain, "direct").when(status.isin(403, 429) & same_domain, "bot_block").when(archived, "archive").otherwise("none")


def tier(abstract: Column, context: Column, web: Column, exists: Column) -> Column:
    """The best tier whose licence holds; null counts as no."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    return F.when(yes(abstract), "ABSTRACT").when(yes(context), "CONTEXT").when(yes(web), "WEB").when(yes(exists), "EXISTENCE").otherwise("NONE")


def tier_rank(name: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, TIERS)), name) - 1


def flagged(resolved: Column, core: Column, doaj: Column, h_index: Column, threshold: int = 15) -> Column:
    """A venue is flagged only if it is resolved, in neither list, and has a small h-index; unknown never flags."""
    return F.coalesce(resolved & (core == F.lit(False)) & (doaj == F.lit(False)) & (h_index < threshold), F.lit(False))


def fresh(age: Column, verdict_flagged: Column | None = None) -> Column:
    """Whether something of that age in seconds still holds; an unknown or negative age does not."""
    limit = F.lit(TTL) if verdict_flagged is None else F.when(verdict_flagged, FLAGGED_TTL).otherwise(CLEAR_TTL)
    return F.coalesce((age >= 0) & (age < limit), F.lit(False))


def ledger_merge(old: DataFrame, new: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """New rows replace old ones by key; keys that are not current go."""
    columns = [c for c in old.columns if c != key]
    o, n = old.alias("o"), new.withColumn("__new", F.lit(True)).alias("n")
    both = o.join(n, key, "full").select(key, *[F.when(F.col("__new"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in columns])
    return both.join(current.select(key).distinct(), key, "left_semi")


def keep_good(old: DataFrame, new: DataFrame, key: str, error: str) -> DataFrame:
    """New captures replace old ones, but an error never replaces a good one."""
    columns = [c for c in old.columns if c != key]
    o, n = old.withColumn("__old", F.lit(True)).alias("o"), new.withColumn("__new", F.lit(True)).alias("n")
    stay = F.col("__new").isNull() | (F.col("__old") & F.col(f"n.{error}").isNotNull() & F.col(f"o.{error}").isNull())
    return o.join(n, key, "full").select(key, *[F.when(F.coalesce(stay, F.lit(False)), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c) for c in columns])


def overwritable_year(entry_year: Column, entry_type: Column, record_year: Column, basis: Column, scoped: Column) -> Column:
    """`yes`, or why a year stays."""
    same = entry_year == record_year
    book = entry_type.isin("book", "incollection", "inbook")
    return (
        F.when((record_year == "") | (entry_year == "") | same | ~record_year.rlike("^[0-9]{1,4}$"), "no-change")
        .when(~F.coalesce(scoped, F.lit(False)), "unscoped")
        .when(~F.coalesce(basis.isin("print", "published", "online"), F.lit(False)), "no-version-of-record-date")
        .when(book & ~entry_year.rlike("^[0-9]{1,4}$"), "book-year-direction-unknown")
        .when(book & (record_year.cast("int") > entry_year.try_cast("int")), "book-year-moved-later")
        .otherwise("yes")
    )
