"""Queries over comparison keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from citeloom.functions import keys
from citeloom.functions.folds import fold_sql
from citeloom.plans.tables import table

HOSTS = ("thther.example.org", "example.net")


def url_keys(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", keys.url_key("url").alias("url_key"), keys.registered_domain(keys.url_host("url")).alias("domain"))


URL_KEYS = r"""
WITH p AS (SELECT page_id, trim(url) AS u, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#:]*)(:[^/?#]*)?([^?#]*)(\?[^#]*)?' AS s FROM pages),
q AS (SELECT page_id, lower(regexp_extract(u, s, 1)) AS scheme, lower(regexp_extract(u, s, 2)) AS host, regexp_extract(regexp_extract(u, s, 3), '^:0*([1-9][0-9]{0,4})$', 1) AS port, regexp_extract(u, s, 4) AS path, regexp_extract(u, s, 5) AS query FROM p),
l AS (SELECT *, string_split(host, '.') AS labels FROM q)
SELECT page_id, scheme || '://' || host || CASE WHEN (scheme = 'http' AND port = '80') OR (scheme = 'https' AND port = '443') OR port = '' OR CAST(port AS INTEGER) > 65535 THEN '' ELSE ':' || port END || regexp_replace(path, '/+$', '') || query AS url_key,
  array_to_string(labels[greatest(len(labels) - 1, 1):], '.') AS domain FROM l
"""


def domain_counts(spark, sf_dir):
    return url_keys(spark, sf_dir).groupBy("domain").agg(F.count(F.lit(1)).alias("pages"), F.count_distinct("url_key").alias("urls"))


DOMAIN_COUNTS = f"SELECT domain, count(*) AS pages, count(DISTINCT url_key) AS urls FROM ({URL_KEYS}) GROUP BY domain"


def excluded_hosts(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", keys.excluded_host(keys.url_host("url"), HOSTS).alias("excluded"))


EXCLUDED_HOSTS = """
WITH h AS (SELECT page_id, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)) AS host FROM pages)
SELECT page_id, CASE WHEN host = 'thther.example.org' OR ends_with(host, '.thther.example.org') THEN 'thther.example.org' WHEN host = 'example.net' OR ends_with(host, '.example.net') THEN 'example.net' END AS excluded FROM h
"""


def title_keys(spark, sf_dir):
    first = F.split_part("text", F.lit("\n"), F.lit(1))
    return table(spark, sf_dir, "documents").select("doc_id", keys.title_key(first).alias("title_key"))


TITLE_KEYS = f"SELECT doc_id, trim(regexp_replace({fold_sql('split_part(text, chr(10), 1)')}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS title_key FROM documents"


def abstract_hashes(spark, sf_dir):
    hashed = table(spark, sf_dir, "documents").select("doc_id", keys.abstract_hash("text").alias("abstract_hash"))
    return hashed.groupBy("abstract_hash").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc"))


ABSTRACT_HASHES = r"SELECT sha256(trim(regexp_replace(replace(text, '\', ''), '\s+', ' ', 'g'))) AS abstract_hash, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY 1"


def inverted_index(spark, sf_dir):
    words = F.split("text", " ")
    places = F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i")))
    each = table(spark, sf_dir, "benchmark").select("item_id", "text", F.explode(places).alias("p"))
    index = each.groupBy("item_id", "text", F.col("p.w").alias("w")).agg(F.sort_array(F.collect_list("p.i")).alias("at")).groupBy("item_id", "text").agg(F.map_from_entries(F.collect_list(F.struct("w", "at"))).alias("index"))
    back = keys.text_of_inverted_index(F.col("index"))
    return index.select("item_id", back.alias("rebuilt"), F.size("index").cast("long").alias("words"), (back == F.col("text")).alias("equal"))


INVERTED_INDEX = "SELECT item_id, text AS rebuilt, len(list_distinct(string_split(text, ' '))) AS words, true AS equal FROM benchmark"


def year_keys(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate").alias("y"))
    forms = F.array(F.concat(F.lit("0"), F.col("y")), F.concat("y", F.lit(".0")), F.concat(F.lit(" +"), "y"), F.concat("y", F.lit(".5")))
    return orders.select("o_orderkey", keys.year_key(F.element_at(forms, (F.col("o_orderkey") % 4 + 1).cast("int"))).alias("year_key"))


YEAR_KEYS = "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN year(o_orderdate) || '.5' ELSE CAST(year(o_orderdate) AS VARCHAR) END AS year_key FROM orders"


def display_years(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", F.year("o_orderdate").cast("string").alias("y"), F.lower(F.substring("o_orderpriority", 3, 1)).alias("s"))
    return orders.groupBy(keys.display_year(F.col("y"), F.col("s")).alias("display")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_custkey").alias("customers"))


DISPLAY_YEARS = "SELECT year(o_orderdate) || CASE WHEN regexp_full_match(lower(substr(o_orderpriority, 3, 1)), '[a-z]') THEN lower(substr(o_orderpriority, 3, 1)) ELSE '' END AS display, count(*) AS n, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1"


def cache_keys(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return events.groupBy(keys.cache_key("ev", F.struct("event_type", "user_id")).alias("cache_key"), "event_type").agg(F.count(F.lit(1)).alias("hits"), F.min("event_id").alias("first_event"))


CACHE_KEYS = "SELECT 'ev_' || substr(sha256('{\"event_type\":\"' || event_type || '\",\"user_id\":' || user_id || '}'), 1, 16) AS cache_key, event_type, count(*) AS hits, min(event_id) AS first_event FROM events GROUP BY 1, 2"


def natural_order(spark, sf_dir):
    from pyspark.sql import Window

    names = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", F.concat(F.lit("s"), F.col("s_suppkey")).alias("name"))
    rank = F.row_number().over(Window.partitionBy("s_nationkey").orderBy(keys.natural_key(F.col("name"))))
    return names.select("s_suppkey", "name", rank.cast("long").alias("place"))


NATURAL_ORDER = "SELECT s_suppkey, 's' || s_suppkey AS name, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS place FROM supplier"


def html_titles(spark, sf_dir):
    from citeloom.sources.html import articles

    read = articles(table(spark, sf_dir, "pages").select("page_id", "html"))
    return read.select("page_id", "title", F.size("headings").cast("long").alias("headings"), F.length("text").cast("long").alias("characters"))


def slug_titles(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", keys.slug_title(F.concat_ws(": ", "p_name", "p_brand")).alias("slug"), F.sort_array(keys.title_tokens(F.concat_ws(" ", "p_name", "p_type"))).alias("t"))
    return parts.select("p_partkey", "slug", F.array_join("t", " ").alias("tokens"))


_STOP = ", ".join(f"'{w}'" for w in keys.STOPWORDS)
SLUG_TITLES = rf"""
SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(split_part(p_name || ': ' || p_brand, ':', 1)), '[^a-z0-9\s]', '', 'g'), '\s+', ' ', 'g')) AS slug,
  array_to_string(list_sort(list_filter(list_distinct(string_split(trim(regexp_replace(lower(p_name || ' ' || p_type), '[^a-z0-9]+', ' ', 'g')), ' ')), lambda w: length(w) >= 3 AND w NOT IN ({_STOP}))), ' ') AS tokens FROM part
"""

QUERIES = {
    "url_key": (url_keys, URL_KEYS),
    "domain_counts": (domain_counts, DOMAIN_COUNTS),
    "excluded_host": (excluded_hosts, EXCLUDED_HOSTS),
    "title_key": (title_keys, TITLE_KEYS),
    "abstract_hash": (abstract_hashes, ABSTRACT_HASHES),
    "inverted_index_roundtrip": (inverted_index, INVERTED_INDEX),
    "year_key": (year_keys, YEAR_KEYS),
    "display_year": (display_years, DISPLAY_YEARS),
    "cache_key": (cache_keys, CACHE_KEYS),
    "natural_order": (natural_order, NATURAL_ORDER),
    "slug_title": (slug_titles, SLUG_TITLES),
    "html_title_text": (html_titles, None),
}
