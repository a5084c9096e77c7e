"""Queries over joins, de-duplication and evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from citeloom.functions import keys
from citeloom.operators import checks, dedupe, evidence, matching, prose, search
from citeloom.plans.tables import table
from citeloom.sources import envelopes


def dedupe_key_cascade(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("h"), keys.abstract_hash(F.lower("text")).alias("a"))
    return dedupe.cascade(docs, ["h", "a"], "doc_id").select("doc_id", "survivor")


DEDUPE_KEY_CASCADE = r"SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(trim(regexp_replace(replace(lower(text), '\', ''), '\s+', ' ', 'g')))) AS survivor FROM documents"


def ordered_fold_merge(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    joined = docs.select("doc_id", F.md5("text").alias("h"), "source", "lang").join(labels, "doc_id", "left")
    order = F.struct(F.col("quality").isNull().cast("int").alias("u"), (-F.coalesce("quality", F.lit(0))).alias("q"), "doc_id")
    survivor = joined.groupBy("h").agg(F.min_by(F.struct("doc_id", "source"), order).alias("s"), F.min_by("quality", F.when(F.col("quality").isNotNull(), F.col("doc_id"))).alias("quality"), F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("members"))
    return survivor.select("s.doc_id", "s.source", F.col("quality").cast("long").alias("quality"), "first_doc", "members")


ORDERED_FOLD_MERGE = """
WITH j AS (SELECT d.doc_id, md5(text) AS h, source, quality, row_number() OVER (PARTITION BY md5(text) ORDER BY quality IS NULL, -coalesce(quality, 0), d.doc_id) AS rn FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
SELECT max(CASE WHEN rn = 1 THEN doc_id END) AS doc_id, max(CASE WHEN rn = 1 THEN source END) AS source, CAST(arg_min(quality, doc_id) FILTER (quality IS NOT NULL) AS BIGINT) AS quality, min(doc_id) AS first_doc, count(*) AS members FROM j GROUP BY h
"""


def conflict_groups(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.year("o_orderdate").cast("string").alias("v"), "o_orderpriority")
    found = matching.conflicts(orders, "k", "v", "o_orderpriority")
    return found.select(F.col("k").alias("custkey"), F.col("v").alias("order_year"), F.array_join("sources", "|").alias("sources"), "n_values")


CONFLICT_GROUPS = """
WITH e AS (SELECT o_custkey AS custkey, CAST(year(o_orderdate) AS VARCHAR) AS order_year, string_agg(DISTINCT o_orderpriority, '|' ORDER BY o_orderpriority) AS sources FROM orders GROUP BY 1, 2)
SELECT custkey, order_year, sources, n_values FROM (SELECT *, count(*) OVER (PARTITION BY custkey) AS n_values FROM e) WHERE n_values >= 2
"""


def priority_join(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_custkey").cast("string").alias("k"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("k"), (F.col("o_orderstatus") == "F").alias("scoped"), "o_orderkey", "o_totalprice")
    found = matching.priority_join(customers, orders, "k", "scoped", ["o_orderkey"])
    return found.select("c_custkey", F.col("record.o_orderkey").alias("o_orderkey"), F.col("record.scoped").alias("scoped"))


PRIORITY_JOIN = """
SELECT c_custkey, o_orderkey, scoped FROM customer LEFT JOIN (SELECT o_custkey, o_orderkey, o_orderstatus = 'F' AS scoped, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus = 'F' DESC, o_orderkey) AS rn FROM orders) o ON c_custkey = o_custkey AND rn = 1
"""


def record_resolution(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_custkey").cast("string").alias("doi"), F.lit("").alias("title"), F.lit("").alias("year"))
    o = table(spark, sf_dir, "orders")
    status = F.col("o_orderstatus")
    records = o.select(
        F.col("o_custkey").cast("string").alias("doi"), F.lit("").alias("title"), F.when(status == "P", "").otherwise(F.year("o_orderdate").cast("string")).alias("year"),
        (F.col("o_orderpriority") == "1-URGENT").alias("scoped"), F.col("o_orderkey").alias("ord"), F.array(F.lit("year")).alias("filled"), F.col("o_orderkey").alias("record"),
    )
    return matching.resolve(customers, records).select("c_custkey", "outcome", "record")


RECORD_RESOLUTION = """
WITH r AS (SELECT CAST(o_custkey AS BIGINT) AS k, o_orderkey AS ord, o_orderpriority = '1-URGENT' AS scoped, CASE WHEN o_orderstatus = 'P' THEN '' ELSE CAST(year(o_orderdate) AS VARCHAR) END AS y FROM orders),
g AS (SELECT k, count(DISTINCT CASE WHEN scoped AND y <> '' THEN y END) AS ns, count(DISTINCT CASE WHEN y <> '' THEN y END) AS n, bool_or(scoped) AS anyscoped,
  arg_min(ord, CASE WHEN scoped THEN ord ELSE ord + 1000000000000 END) AS best, arg_min(y, CASE WHEN scoped THEN ord ELSE ord + 1000000000000 END) AS besty, min(CASE WHEN scoped AND y <> '' THEN ord END) AS dated FROM r GROUP BY k),
o AS (SELECT c_custkey, best, dated, CASE WHEN k IS NULL THEN 'unmatched' WHEN anyscoped AND ns > 1 THEN 'scoped_year_disagreement' WHEN anyscoped AND besty = '' AND ns = 1 THEN 'swapped' WHEN ns = 0 AND n >= 2 THEN 'pooled_year_conflict' ELSE 'doi' END AS outcome FROM customer LEFT JOIN g ON c_custkey = k)
SELECT c_custkey, outcome, CASE outcome WHEN 'swapped' THEN dated WHEN 'doi' THEN best END AS record FROM o
"""


def semi_verifiable(spark, sf_dir):
    """Orders whose number stands in the pool of large lines, by status."""
    field = lambda c: (F.lit("number").alias("field"), F.col(c).cast("string").alias("value"))
    pool = table(spark, sf_dir, "lineitem").filter(F.col("l_quantity") >= 49).select(*field("l_orderkey"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), "o_orderstatus", *field("o_orderkey"))
    return checks.verifiable(orders, pool).filter("verifiable").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


SEMI_VERIFIABLE = "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 49) GROUP BY 1"


def anti_unresolved(spark, sf_dir):
    customers, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").filter("o_totalprice > 100000")
    return customers.join(orders, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_mktsegment")


ANTI_UNRESOLVED = "SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000 AND o_custkey IS NOT NULL)"


def breaker(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_discount") >= 0.07).alias("hit"))
    plan = evidence.with_breaker(lines, "hit", ["l_suppkey"]).groupBy("l_suppkey", "tripped").agg(F.count(F.lit(1)).alias("n"), F.count_if("hit").alias("stripped"))
    return plan.withColumn("applied", F.when(F.col("tripped"), 0).otherwise(F.col("stripped")))


BREAKER = "SELECT l_suppkey, count(*) AS n, count(*) FILTER (l_discount >= 0.07) AS stripped, count(*) FILTER (l_discount >= 0.07) >= 5 AND count(*) FILTER (l_discount >= 0.07) * 100 > count(*) * 30 AS tripped, CASE WHEN count(*) FILTER (l_discount >= 0.07) >= 5 AND count(*) FILTER (l_discount >= 0.07) * 100 > count(*) * 30 THEN 0 ELSE count(*) FILTER (l_discount >= 0.07) END AS applied FROM lineitem GROUP BY 1"


def tier_case(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    j = docs.select("doc_id", F.md5("text").alias("h"), "n_chars", "lang").join(labels, "doc_id", "left")
    name = evidence.tier(F.col("quality") == 1, F.col("toxic") == 0, F.col("n_chars") > 3000, F.col("lang") != "en")
    ranked = j.select("doc_id", "h", name.alias("tier")).withColumn("r", evidence.tier_rank(F.col("tier")))
    best = ranked.groupBy("h").agg(F.max("r").alias("b"))
    return ranked.join(best, "h").select("doc_id", "tier", F.element_at(F.array(*map(F.lit, evidence.TIERS)), (F.col("b") + 1).cast("int")).alias("group_tier"))


TIER_CASE = """
WITH t AS (SELECT d.doc_id, md5(text) AS h, CASE WHEN quality = 1 THEN 4 WHEN toxic = 0 THEN 3 WHEN n_chars > 3000 THEN 2 WHEN lang <> 'en' THEN 1 ELSE 0 END AS r FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
m AS (SELECT doc_id, r, max(r) OVER (PARTITION BY h) AS b FROM t)
SELECT doc_id, ['NONE', 'EXISTENCE', 'WEB', 'CONTEXT', 'ABSTRACT'][r + 1] AS tier, ['NONE', 'EXISTENCE', 'WEB', 'CONTEXT', 'ABSTRACT'][b + 1] AS group_tier FROM m
"""


def capture_gate(spark, sf_dir):
    from citeloom.sources.html import articles

    pages = articles(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    spans = F.array(F.array_join(F.slice(F.split("text", " "), 12, 8), " "))
    status = F.when(F.col("page_id") % 11 == 0, 404).otherwise(200)
    error = F.when(F.col("page_id") % 13 == 0, "timeout")
    reason = evidence.capture_gate(keys.url_key("url") != "", error, F.lit("script"), status, F.col("text"), F.col("title"), F.col("title"), spans)
    return pages.select("page_id", reason.alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def existence_probe(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", (F.lit(200) + F.col("user_id") % 3 * 203).alias("status"), (F.col("value") > 10).alias("same"), (F.col("event_id") % 2 == 0).alias("archived"))
    return events.groupBy(evidence.existence(F.col("status"), F.col("same"), F.col("archived")).alias("existence")).agg(F.count(F.lit(1)).alias("n"))


EXISTENCE_PROBE = "SELECT CASE WHEN user_id % 3 = 0 AND value > 10 THEN 'direct' WHEN user_id % 3 = 1 AND value > 10 THEN 'bot_block' WHEN event_id % 2 = 0 THEN 'archive' ELSE 'none' END AS existence, count(*) AS n FROM events GROUP BY 1"


def proximity_join(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us")).withColumn("pos", F.floor(F.col("us") / 1_000_000))
    a = events.filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("a_id"), F.col("pos").alias("a_pos"))
    b = events.filter("event_type = 'click'").select("user_id", F.col("event_id").alias("b_id"), F.col("pos").alias("b_pos"))
    return matching.within(a, b, "user_id", "a_pos", "b_pos", 3600).groupBy("a_id").agg(F.count(F.lit(1)).alias("near"), F.min("b_id").alias("first_near"))


PROXIMITY_JOIN = """
WITH e AS (SELECT user_id, event_id, event_type, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS pos FROM events)
SELECT a.event_id AS a_id, count(*) AS near, min(b.event_id) AS first_near FROM e a JOIN e b ON a.user_id = b.user_id AND abs(a.pos - b.pos) <= 3600 WHERE a.event_type = 'purchase' AND b.event_type = 'click' GROUP BY 1
"""


def title_mentions(spark, sf_dir):
    """Benchmark passages that a document holds."""
    return matching.mentions(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


TITLE_MENTIONS = r"""
WITH d AS (SELECT doc_id, ' ' || trim(regexp_replace(lower(text), '\s+', ' ', 'g')) || ' ' AS t FROM documents),
b AS (SELECT item_id, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS p FROM benchmark)
SELECT doc_id, item_id FROM d JOIN b ON contains(d.t, ' ' || b.p || ' ') WHERE p <> ''
"""


def token_overlap(spark, sf_dir):
    token = lambda c: F.array_distinct(F.split(F.lower(c), r"[^a-z0-9]+"))
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item"), token(F.concat_ws(" ", "p_name", "p_type")).alias("tokens"))
    return matching.overlap_best(parts, parts.select(F.col("item").alias("target"), "tokens"))


TOKEN_OVERLAP = """
WITH t AS (SELECT DISTINCT p_partkey AS item, unnest(regexp_split_to_array(lower(p_name || ' ' || p_type), '[^a-z0-9]+')) AS token FROM part),
n AS (SELECT item, count(*) AS n FROM t GROUP BY item),
s AS (SELECT a.item, b.item AS target, count(*) AS shared FROM t a JOIN t b ON a.token = b.token GROUP BY 1, 2),
g AS (SELECT s.item, target, shared / n.n AS score FROM s JOIN n ON s.item = n.item WHERE shared >= 2 AND shared >= 0.5 * n.n)
SELECT item, target, score FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, target) AS rn FROM g) WHERE rn = 1
"""


def work_components(spark, sf_dir):
    """Works whose titles are the first lines of documents; every third has a DOI."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.md5("text").alias("h"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"))
    doi = F.when(F.col("id") % 3 == 0, F.col("h")).otherwise("")
    return dedupe.work_clusters(docs.select("id", doi.alias("doi"), "title"))


#: The closure of both kinds of links.
WORK_COMPONENTS = """
WITH RECURSIVE d AS (SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN md5(text) ELSE '' END AS doi, split_part(text, chr(10), 1) AS title FROM documents),
t AS (SELECT title, count(DISTINCT nullif(doi, '')) AS n FROM d WHERE title <> '' GROUP BY title),
k AS (SELECT id, 'd' || doi AS k FROM d WHERE doi <> '' UNION ALL SELECT id, 't' || d.title FROM d JOIN t ON d.title = t.title WHERE n <= 1),
l AS (SELECT DISTINCT a.id AS a, b.id AS b FROM k a JOIN k b ON a.k = b.k),
r AS (SELECT id AS a, id AS b FROM d UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
m AS (SELECT a, min(b) AS least FROM r GROUP BY a)
SELECT id, least AS cluster, coalesce(n > 1, false) AND doi = '' AS tainted FROM d JOIN m ON m.a = d.id LEFT JOIN t ON d.title = t.title
"""


def venue_rule(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    core = F.when(F.col("s_suppkey") % 5 == 0, None).otherwise(F.col("s_suppkey") % 3 == 0)
    flag = evidence.flagged(F.col("s_acctbal").isNotNull(), core, F.col("s_suppkey") % 7 == 0, F.when(F.col("s_suppkey") % 4 != 0, (F.col("s_suppkey") % 40).cast("int")))
    return s.select("s_suppkey", flag.alias("flagged"))


VENUE_RULE = "SELECT s_suppkey, coalesce(s_acctbal IS NOT NULL AND (CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE s_suppkey % 3 = 0 END) = false AND s_suppkey % 7 <> 0 AND (CASE WHEN s_suppkey % 4 <> 0 THEN s_suppkey % 40 END) < 15, false) AS flagged FROM supplier"


def best_venue(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey", F.when(F.col("s_suppkey") % 4 != 0, F.col("s_suppkey") % 17).alias("h_index"))
    return search.best_named(s, "s_nationkey", "s_suppkey")


BEST_VENUE = "SELECT s_nationkey, s_suppkey, h AS h_index FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY h DESC, s_suppkey) AS rn FROM (SELECT s_nationkey, s_suppkey, coalesce(CASE WHEN s_suppkey % 4 <> 0 THEN s_suppkey % 17 END, 0) AS h FROM supplier)) WHERE rn = 1"


def citation_graph(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return search.degrees(lines.select(F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("target"), (F.col("l_quantity") > 40).alias("influential")))


CITATION_GRAPH = """
SELECT l_suppkey AS node, count(*) AS n, count(*) FILTER (l_quantity > 40) AS influential, count(DISTINCT l_partkey) AS targets, 'references' AS direction FROM lineitem GROUP BY 1
UNION ALL SELECT l_partkey, count(*), count(*) FILTER (l_quantity > 40), count(DISTINCT l_suppkey), 'citations' FROM lineitem GROUP BY 1
"""


def similar_items(spark, sf_dir):
    """The ten vectors of each label nearest to its centre, by inner product on a fixed grid (so sums are exact)."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: F.round(x.cast("double") * 1000).cast("long")).alias("e"))
    return search.recommended(v, v.select("label", "e", F.lit(1).alias("sign")), "label", "vec_id")


SIMILAR_ITEMS = """
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(round(CAST(x AS DOUBLE) * 1000) AS BIGINT)) AS e FROM embeddings),
u AS (SELECT vec_id, label, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM v),
c AS (SELECT label, i, sum(x) AS c FROM u GROUP BY 1, 2),
s AS (SELECT u.label, vec_id, CAST(sum(x * c) AS BIGINT) AS score FROM u JOIN c ON u.label = c.label AND u.i = c.i GROUP BY 1, 2)
SELECT label, vec_id, score, place FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS place FROM s) WHERE place <= 10
"""


def ledger_merge(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    old = labels.filter("doc_id % 3 != 0").select("doc_id", F.lit(0).alias("quality"), "toxic")
    new = labels.filter("doc_id % 2 = 0").select("doc_id", "quality", "toxic")
    current = table(spark, sf_dir, "documents").filter("n_chars > 1000").select("doc_id")
    return evidence.ledger_merge(old, new, current, "doc_id")


LEDGER_MERGE = """
WITH o AS (SELECT doc_id, 0 AS quality, toxic FROM labels WHERE doc_id % 3 <> 0), n AS (SELECT doc_id, quality, toxic FROM labels WHERE doc_id % 2 = 0),
m AS (SELECT coalesce(n.doc_id, o.doc_id) AS doc_id, CASE WHEN n.doc_id IS NOT NULL THEN n.quality ELSE o.quality END AS quality, CASE WHEN n.doc_id IS NOT NULL THEN n.toxic ELSE o.toxic END AS toxic FROM o FULL JOIN n ON o.doc_id = n.doc_id)
SELECT doc_id, CAST(quality AS INTEGER) AS quality, CAST(toxic AS INTEGER) AS toxic FROM m WHERE doc_id IN (SELECT doc_id FROM documents WHERE n_chars > 1000)
"""


def json_pool(spark, sf_dir):
    """Properties of events as files of a pool, some of them cut off."""
    events = table(spark, sf_dir, "events").select(F.concat_ws("-", "event_type", "event_id").alias("file"), F.when(F.col("event_id") % 50 == 0, F.expr("left(props, length(props) - 1)")).otherwise(F.col("props")).alias("content"))
    read = envelopes.pool(events)
    return read.groupBy(F.split_part("file", F.lit("-"), F.lit(1)).alias("event_type")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "skipped").alias("malformed"), F.count(F.expr("try_variant_get(body, '$.k', 'int')")).alias("with_k"))


JSON_POOL = """
WITH e AS (SELECT event_type, CASE WHEN event_id % 50 = 0 THEN left(props, length(props) - 1) ELSE props END AS p FROM events)
SELECT event_type, count(*) AS n, count(*) FILTER (NOT json_valid(p)) AS malformed, count(CASE WHEN json_valid(p) THEN TRY_CAST(json_extract_string(p, '$.k') AS INTEGER) END) AS with_k FROM e GROUP BY 1
"""


def prose_citations(spark, sf_dir):
    """Citations in sentences made of suppliers and nations for which no nation has name and year."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", F.translate(F.initcap("n_name"), "_0123456789", "xabcdefghij").alias("surname"))
    texts = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("doc_id"), F.concat(F.lit("As "), "surname", F.lit(" and Other ("), (F.lit(1990) + F.col("s_suppkey") % 30).cast("string"), F.lit("b) say.")).alias("text"))
    references = nation.select("surname", (F.lit(1990) + F.col("n_nationkey")).cast("string").alias("year"))
    return prose.unresolved(prose.citations(texts), references).select("doc_id", "surname", "second", "form", "year", "letter")


PROSE_CITATIONS = """
SELECT s_suppkey AS doc_id, translate(upper(substr(n_name, 1, 1)) || lower(substr(n_name, 2)), '_0123456789', 'xabcdefghij') AS surname, 'Other' AS second, 'pair' AS form, CAST(1990 + s_suppkey % 30 AS VARCHAR) AS year, 'b' AS letter
FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 30 <> n_nationkey
"""


def citation_lists(spark, sf_dir):
    """Years that sentences made of customers cite, and those they name among authors of a longer list."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", F.translate(F.initcap("n_name"), "_0123456789", "xabcdefghij").alias("name"))
    year = (F.lit(1980) + F.col("c_custkey") % 20).cast("string")
    said = F.concat(F.lit("Thus, "), "name", F.lit(" and Other ("), year, F.lit("a, b; 2009) say. See Clark, "), "name", F.lit(" ("), year, F.lit("), and Sutton."))
    texts = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("doc_id"), said.alias("text"))
    cited = prose.citations(texts).select("doc_id", "surname", F.coalesce("second", F.lit("")).alias("second"), "year", F.coalesce("letter", F.lit("")).alias("letter"), F.when(F.col("continuation"), "continued").otherwise("cited").alias("how"))
    named = prose.rejected_mentions(texts).select("doc_id", "surname", F.lit("").alias("second"), "year", F.lit("").alias("letter"), F.lit("named").alias("how"))
    return cited.unionByName(named)


CITATION_LISTS = """
WITH c AS (SELECT c_custkey AS doc_id, translate(upper(substr(n_name, 1, 1)) || lower(substr(n_name, 2)), '_0123456789', 'xabcdefghij') AS name, CAST(1980 + c_custkey % 20 AS VARCHAR) AS year FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT doc_id, name AS surname, 'Other' AS second, year, 'a' AS letter, 'cited' AS how FROM c UNION ALL SELECT doc_id, name, 'Other', year, 'b', 'continued' FROM c UNION ALL SELECT doc_id, name, 'Other', '2009', '', 'continued' FROM c
UNION ALL SELECT doc_id, 'Clark', '', year, '', 'named' FROM c UNION ALL SELECT doc_id, name, '', year, '', 'named' FROM c
"""


QUERIES = {
    "citation_lists": (citation_lists, CITATION_LISTS),
    "dedupe_key_cascade": (dedupe_key_cascade, DEDUPE_KEY_CASCADE),
    "ordered_fold_merge": (ordered_fold_merge, ORDERED_FOLD_MERGE),
    "conflict_groups": (conflict_groups, CONFLICT_GROUPS),
    "priority_join": (priority_join, PRIORITY_JOIN),
    "record_resolution": (record_resolution, RECORD_RESOLUTION),
    "semi_verifiable": (semi_verifiable, SEMI_VERIFIABLE),
    "anti_unresolved": (anti_unresolved, ANTI_UNRESOLVED),
    "breaker": (breaker, BREAKER),
    "tier_case": (tier_case, TIER_CASE),
    "capture_gate": (capture_gate, None),
    "existence": (existence_probe, EXISTENCE_PROBE),
    "proximity_join": (proximity_join, PROXIMITY_JOIN),
    "title_mentions": (title_mentions, TITLE_MENTIONS),
    "token_overlap_topk": (token_overlap, TOKEN_OVERLAP),
    "work_components": (work_components, WORK_COMPONENTS),
    "venue_rule": (venue_rule, VENUE_RULE),
    "best_venue": (best_venue, BEST_VENUE),
    "citation_graph": (citation_graph, CITATION_GRAPH),
    "similar_items": (similar_items, SIMILAR_ITEMS),
    "ledger_merge": (ledger_merge, LEDGER_MERGE),
    "json_pool": (json_pool, JSON_POOL),
    "prose_citations": (prose_citations, PROSE_CITATIONS),
}
