"""Queries over captures, cached verdicts, caches and recommendations that Spark makes from the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from citeloom.operators import recommend
from citeloom.plans.tables import table
from citeloom.session import shared_dir
from citeloom.sources import captures

TTL, FLAGGED_TTL, NOW = 5000, 40, 1000


def captures_loaded(spark, sf_dir):
    """Documents handed over as captures, stored as JSON, some of them damaged, and loaded again by key."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("https://site.org/"), "doc_id").alias("url"), "text")
    d = F.col("doc_id")
    own = captures.supplied(docs, F.lit("2020-01-01"))
    stored = F.to_json(F.struct(*captures.FIELDS))
    content = F.when(d % 7 == 3, F.concat(F.lit("["), stored, F.lit("]"))).when(d % 7 == 4, F.substring(stored, 2, 2_000_000_000)).when(d % 7 == 5, F.regexp_replace(stored, r'"provenance":"agent"', '"provenance":true')).otherwise(stored)
    files = own.filter(d % 7 != 6).select("doc_id", content.alias("content"))
    got = captures.loaded(docs.select("doc_id"), files, "doc_id")
    return got.select("doc_id", F.col("capture").isNotNull().alias("found"), "capture.sound", "capture.provenance", "capture.url", F.sha2(F.encode("capture.text", "utf-8"), 256).alias("text_sha256"))


CAPTURES_LOADED = """
WITH c AS (SELECT doc_id, text, doc_id % 7 AS m, doc_id % 7 NOT IN (3, 4, 6) AS found FROM documents)
SELECT doc_id, found, CASE WHEN found THEN m <> 5 END AS sound, CASE WHEN found AND m <> 5 THEN 'agent' END AS provenance, CASE WHEN found THEN 'https://site.org/' || doc_id END AS url, CASE WHEN found THEN sha256(text) END AS text_sha256 FROM c
"""


def record_shapes(spark, sf_dir):
    """Cached verdicts of many shapes, one for each document: what is wrong with them, and which still hold."""
    d = F.col("doc_id")
    pick = lambda modulo, *values: F.element_at(F.array(*map(F.lit, values)), (d % modulo + 1).cast("int"))
    content = F.concat(
        F.when(d % 29 == 0, "[").otherwise(""), F.lit('{"schema_version": '), pick(13, *["1"] * 11, "2", '"1"'), F.lit(', "resolved": '), pick(11, *["true"] * 7, "false", "false", "1", "null"), F.lit(', "h_index": '), pick(7, "3", "14", "15", "null", "true", '"3"', "3.5"),
        F.lit(', "is_core": '), pick(5, "false", "false", "false", "true", "0"), F.lit(', "is_in_doaj": '), pick(3, "false", "false", '"false"'), F.lit(', "fetched_at": '), F.when(d % 17 == 0, "true").otherwise((d % 100 + 900).cast("string")), F.lit("}"), F.when(d % 29 == 0, "]").otherwise(""),
    )
    cached = table(spark, sf_dir, "documents").select("doc_id", content.alias("content"), F.col("n_chars").alias("age"))
    done = captures.verdicts(cached, F.lit(NOW), TTL, FLAGGED_TTL)
    return done.select("doc_id", "shape", "record.h_index", "flagged", "usable")


RECORD_SHAPES = f"""
WITH s AS (SELECT doc_id, n_chars, CASE WHEN doc_id % 29 = 0 THEN 'no_object' WHEN doc_id % 13 > 10 THEN 'version' WHEN doc_id % 11 > 8 THEN 'resolved' WHEN doc_id % 11 > 6 THEN 'ok' WHEN doc_id % 7 > 3 THEN 'h_index' WHEN doc_id % 5 = 4 THEN 'is_core' WHEN doc_id % 3 = 2 THEN 'is_in_doaj' ELSE 'ok' END AS shape FROM documents),
f AS (SELECT *, CASE WHEN shape = 'ok' THEN CASE doc_id % 7 WHEN 0 THEN 3 WHEN 1 THEN 14 WHEN 2 THEN 15 END END AS h, shape = 'ok' AND doc_id % 11 < 7 AND doc_id % 7 < 2 AND doc_id % 5 < 3 AS flagged FROM s)
SELECT doc_id, shape, CAST(h AS BIGINT) AS h_index, flagged,
  shape = 'ok' AND CASE WHEN flagged THEN doc_id % 17 <> 0 AND {NOW} - (doc_id % 100 + 900) <= {FLAGGED_TTL} ELSE coalesce(n_chars BETWEEN 0 AND {TTL}, false) END AS usable FROM f
"""


def cache_statistics(spark, sf_dir):
    """Documents kept as one file for each language and source: files and bytes of each language, and whether ages are sound."""
    docs = table(spark, sf_dir, "documents").select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("source", F.lit("none")).alias("source"), F.regexp_replace(F.coalesce("text", F.lit("")), r"[\r\n]", " ").alias("value"))
    path = f"{shared_dir(spark)}/cache-{uuid.uuid4().hex}"
    docs.hint("rebalance", "lang", "source").write.partitionBy("lang", "source").text(path)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(path).select("path", "length", "modificationTime")
    named = files.withColumn("lang", F.regexp_extract("path", "/lang=([^/]*)/", 1))
    done = captures.cache_statistics(named, F.unix_micros(F.now()) / 1e6 + 1, ["lang"])
    return done.select("lang", (F.col("entry_count") > 0).alias("has_files"), "total_bytes", ((F.col("oldest_age") >= F.col("newest_age")) & (F.col("newest_age") >= 0)).alias("ages_sound"))


CACHE_STATISTICS = "SELECT coalesce(lang, 'und') AS lang, true AS has_files, CAST(sum(strlen(coalesce(text, '')) + 1) AS BIGINT) AS total_bytes, true AS ages_sound FROM documents GROUP BY 1"

#: Results of a request: a top-k by design.
BEST = 25


def recommendations(spark, sf_dir):
    """For each label the vectors nearest to its examples and away from those of the next label; half of all may be answers."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").alias("e"), F.col("label").cast("long").alias("label"))
    own = vectors.filter("label IS NOT NULL AND key % 20 < 3")
    wanted = own.filter("key % 20 < 2").select(F.col("label").alias("request"), "key", F.lit(1).alias("sign"))
    not_wanted = own.filter("key % 20 = 2").select(((F.col("label") + 9) % 10).alias("request"), "key", F.lit(-1).alias("sign"))
    done = recommend.recommendations(vectors, wanted.unionByName(not_wanted), BEST, F.col("key") % 2 == 0)
    return done.select("request", F.col("key").alias("vec_id"), "place", F.round(F.col("score") * 1e6).cast("long").alias("millionths"))


_USABLE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"
RECOMMENDATIONS = f"""
WITH v AS MATERIALIZED (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, CAST(label AS BIGINT) AS label FROM embeddings WHERE {_USABLE}),
x AS (SELECT label AS request, vec_id, 1 AS sign FROM v WHERE label IS NOT NULL AND vec_id % 20 < 2 UNION ALL SELECT (label + 9) % 10, vec_id, -1 FROM v WHERE label IS NOT NULL AND vec_id % 20 = 2),
c AS (SELECT request, i, avg(val) FILTER (sign > 0) AS p, avg(val) FILTER (sign < 0) AS n FROM (SELECT x.request, x.sign, unnest(v.e) AS val, unnest(range(1, len(v.e) + 1)) AS i FROM x JOIN v USING (vec_id)) GROUP BY 1, 2),
d AS (SELECT request, list(p - coalesce(n, 0) ORDER BY i) AS d FROM c GROUP BY 1 HAVING count(p) = count(*)),
s AS (SELECT request, vec_id, round(list_cosine_similarity(e, d), 6) AS score FROM v, d WHERE vec_id % 2 = 0 AND len(e) = len(d) AND NOT EXISTS (SELECT 1 FROM x WHERE x.request = d.request AND x.vec_id = v.vec_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY request ORDER BY score DESC, vec_id) AS place FROM s)
SELECT request, vec_id, place, CAST(round(score * 1e6) AS BIGINT) AS millionths FROM r WHERE place <= {BEST}
"""

QUERIES = {
    "captures_loaded": (captures_loaded, CAPTURES_LOADED),
    "record_shapes": (record_shapes, RECORD_SHAPES),
    "cache_statistics": (cache_statistics, CACHE_STATISTICS),
    "recommendations": (recommendations, RECOMMENDATIONS),
}
