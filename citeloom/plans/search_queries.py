"""Queries over lookups and searches."""

from __future__ import annotations

from pyspark.sql import functions as F

from citeloom.operators import search
from citeloom.plans.tables import table


def top_search(spark, sf_dir):
    """A search with filters, order and limit: its result is a top-k by design."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("title"), F.year("o_orderdate").alias("year"), F.col("o_totalprice").alias("score"), F.lit(0).alias("citations"), F.col("o_orderstatus").alias("kind"), F.lit(True).alias("is_open"), F.col("o_orderkey").alias("ord"))
    return search.search(orders, "urgent", (1994, None), kind="F", limit=50).select("o_orderkey", "score")


TOP_SEARCH = "SELECT o_orderkey, o_totalprice AS score FROM orders WHERE contains(lower(o_orderpriority), 'urgent') AND year(o_orderdate) >= 1994 AND o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 50"


def batch_lookup(spark, sf_dir):
    ids = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") * 3).alias("p_partkey")).distinct().withColumn("ord", F.col("p_partkey"))
    found, missed = search.batch_lookup(ids, table(spark, sf_dir, "part").select("p_partkey", "p_brand"), "p_partkey")
    return found.select("p_partkey", "p_brand", F.lit(True).alias("found")).unionByName(missed.select("p_partkey", F.lit(None).cast("string").alias("p_brand"), F.lit(False).alias("found")))


BATCH_LOOKUP = "SELECT i.k AS p_partkey, p_brand, p_partkey IS NOT NULL AS found FROM (SELECT DISTINCT l_partkey * 3 AS k FROM lineitem) i LEFT JOIN part ON k = p_partkey"


def abstract_precedence(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, F.concat(F.lit("q"), F.col("toxic"))).alias("a"))
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.md5("text").alias("b"))
    both = docs.join(labels, "doc_id", "left").join(items, "doc_id", "left")
    return both.select("doc_id", search.first_source([("labels", F.col("a")), ("benchmark", F.col("b")), ("source", F.when(F.col("lang") != "en", F.col("source")))]).alias("r")).select("doc_id", "r.value", "r.source")


ABSTRACT_PRECEDENCE = """
SELECT d.doc_id, CASE WHEN quality = 1 THEN 'q' || toxic WHEN b.text IS NOT NULL THEN md5(b.text) WHEN lang <> 'en' THEN d.source END AS value,
  CASE WHEN quality = 1 THEN 'labels' WHEN b.text IS NOT NULL THEN 'benchmark' WHEN lang <> 'en' THEN 'source' END AS source
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id LEFT JOIN benchmark b ON d.doc_id = b.item_id
"""


def deadline(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("long").alias("cost"))
    done = search.admitted(lines, "cost", ["l_linenumber", "l_partkey", "l_suppkey", "cost"], "l_orderkey", 60)
    return done.groupBy("l_orderkey").agg(F.count_if("admitted").alias("done"), F.count_if(~F.col("admitted")).alias("failed"))


DEADLINE = """
WITH l AS (SELECT l_orderkey, coalesce(sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 60 AS ok FROM lineitem)
SELECT l_orderkey, count(*) FILTER (ok) AS done, count(*) FILTER (NOT ok) AS failed FROM l GROUP BY 1
"""


def site_results(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("url", F.col("page_id").alias("ord"))
    return search.site_results(pages, "/en/", r"/en/([0-9]+)").select("id", "ord")


SITE_RESULTS = "SELECT regexp_extract(url, '/en/([0-9]+)', 1) AS id, min(page_id) AS ord FROM pages WHERE contains(url, '/en/') AND regexp_extract(url, '/en/([0-9]+)', 1) <> '' GROUP BY 1"

QUERIES = {
    "paper_search": (top_search, TOP_SEARCH),
    "batch_lookup": (batch_lookup, BATCH_LOOKUP),
    "abstract_precedence": (abstract_precedence, ABSTRACT_PRECEDENCE),
    "work_admission": (deadline, DEADLINE),
    "site_results": (site_results, SITE_RESULTS),
}
