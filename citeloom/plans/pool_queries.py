"""Queries over the maintained index of a pool that Spark makes from the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from citeloom.operators import pool_index
from citeloom.plans.tables import table
from citeloom.session import shared_dir

#: Documents in a file of the pool.
FILE = 100
#: Buckets of its index.
BUCKETS = 32


def _pool(docs, shift):
    """documents as files of crossref answers; volumes are moved by shift."""
    d = F.col("doc_id")
    result = F.struct(
        F.concat(F.lit("T"), d).alias("title"), F.concat(F.lit("The Journal of "), "source").alias("container_title"), ((d + shift) % 40).cast("string").alias("volume"), F.concat(d % 7, F.lit("--"), d % 9).alias("page"),
        F.concat(F.lit(" Press "), F.coalesce("lang", F.lit("und"))).alias("publisher"), (F.lit(1900) + d % 100).cast("string").alias("year"), F.concat(F.lit("https://doi.org/10.1/X"), F.floor(d / 2)).alias("doi"),
    )
    rows = docs.select(F.floor(d / FILE).alias("f"), "doc_id", result.alias("r"))
    listed = F.array_sort(F.collect_list(F.struct("doc_id", "r")))  # of at most FILE documents
    return rows.groupBy("f").agg(F.to_json(F.struct(F.lit("crossref").alias("source"), F.transform(listed, lambda x: x["r"]).alias("results"))).alias("content"))


def pool_index_updates(spark, sf_dir):
    """The index after two updates: a third of the files changed in the second, a third were new, and one vanished."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    named = lambda pool: pool.select(F.concat(F.lit("pool-"), "f", F.lit(".json")).alias("file"), "content")
    out = f"{shared_dir(spark)}/pool-{uuid.uuid4().hex}"
    first = named(_pool(docs, 0).filter("f % 3 = 0")).unionByName(named(_pool(docs, 5).filter("f % 3 = 1")))
    lost = named(_pool(docs, 1).filter("f = 0")).withColumn("file", F.lit("lost.json"))
    pool_index.update(first.unionByName(lost), out, BUCKETS)
    pool_index.update(named(_pool(docs, 0)), out)
    index = pool_index.read(spark, out)
    return index.groupBy("kind", "key").agg(F.count(F.lit(1)).alias("occurrences"), F.count_distinct("file").alias("files"), F.min("value").alias("least_value"), F.max("file").alias("last_file"))


POOL_INDEX_UPDATES = f"""
WITH d AS (SELECT doc_id, source, coalesce(lang, 'und') AS lang, 'pool-' || CAST(floor(doc_id / {FILE}) AS BIGINT) || '.json' AS file FROM documents),
p AS (
  SELECT 'journal' AS kind, 'journal of ' || lower(source) AS key, 'The Journal of ' || source AS value, file FROM d
  UNION ALL SELECT 'venue', 'journal of ' || lower(source), 'The Journal of ' || source, file FROM d
  UNION ALL SELECT 'volume', CAST(doc_id % 40 AS VARCHAR), CAST(doc_id % 40 AS VARCHAR), file FROM d
  UNION ALL SELECT 'pages', (doc_id % 7) || '-' || (doc_id % 9), (doc_id % 7) || '--' || (doc_id % 9), file FROM d
  UNION ALL SELECT 'publisher', lower('press ' || lang), ' Press ' || lang, file FROM d
  UNION ALL SELECT 'year', CAST(1900 + doc_id % 100 AS VARCHAR), CAST(1900 + doc_id % 100 AS VARCHAR), file FROM d
  UNION ALL SELECT 'doi', '10.1/x' || CAST(floor(doc_id / 2) AS BIGINT), 'https://doi.org/10.1/X' || CAST(floor(doc_id / 2) AS BIGINT), file FROM d
)
SELECT kind, key, count(*) AS occurrences, count(DISTINCT file) AS files, min(value) AS least_value, max(file) AS last_file FROM p WHERE key <> '' GROUP BY 1, 2
"""

QUERIES = {"pool_index_updates": (pool_index_updates, POOL_INDEX_UPDATES)}
