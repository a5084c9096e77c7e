"""From raw documents to packed sequences of ids, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept. All but the last return the columns of documents (COLUMNS); columns beyond
these are dropped by the first stage. A null doc_id is a document of its own to
every stage: it is judged like any other, and never the reason that one goes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.llm import language_id, packing, simhash, suffix_dedup, toxicity
from citeloom.session import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters (or text), or of no language the model can tell, go."""
    return language_id.accepted(language_id.identify(docs.select(COLUMNS), language_id.fit(docs))).select(COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score at the threshold or above go; those without doc_id are scored, but nothing is learnt from them."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = toxicity.score(docs.select(COLUMNS), toxicity.fit(docs, labels))
    return scored.filter(F.col("toxic_score") < toxicity.THRESHOLD).select(COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group stays; rows that repeat it are one.

    Different texts may share a doc_id: those of different groups are judged
    each in its own, and of those of one group the one with the least hash stays.
    A group in which no document has a doc_id has no smallest one and stays.
    """
    of_text = F.sha2(F.encode(F.coalesce("text", F.lit("")), "utf-8"), 256).alias("__hash")
    found = written(simhash.near_groups(docs.select("doc_id", "text", of_text)).select("doc_id", "__hash", "component_id", "__label"), "components")
    least = found.filter("doc_id = component_id").groupBy("__label", "doc_id", "__hash").count()
    kept = written(least.groupBy("__label").agg(F.min(F.struct("__hash", "doc_id", "count")).alias("k")).select("k.*"), "survivors")
    rows = docs.select(*COLUMNS, of_text).join(kept.select("doc_id", "__hash"), ["doc_id", "__hash"], "left_semi")
    if not kept.filter("count > 1").isEmpty():
        rows = rows.dropDuplicates(["doc_id", "__hash"])
    rows = rows.select(COLUMNS)
    if not found.filter("component_id IS NULL").isEmpty():
        named = simhash.near_duplicates(docs.select(COLUMNS).withColumn("__text", F.col("text")))
        lone = named.filter("component_id IS NULL").withColumn("text", F.col("__text"))
        rows = rows.unionByName(lone.select(COLUMNS))
    return rows.select(COLUMNS)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes that repeat go; a character that loses some of its bytes becomes U+FFFD, and a null text becomes empty.

    Documents without doc_id come first: theirs are the occurrences that stay.
    """
    left = suffix_dedup.remove_repeats(docs.select(COLUMNS))
    text = F.make_valid_utf8(F.col("kept").cast("string"))
    return left.withColumn("text", text).withColumn("n_chars", F.length(text).cast("long")).select(COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 ids; rows without doc_id or with one that repeats are packed each on its own."""
    import public_tokenizers

    return packing.packed_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language ID", identify_language),
    ("toxicity", drop_toxic),
    ("SimHash near-dedup", drop_near_duplicates),
    ("suffix-array dedup", drop_repeats),
    ("packing", pack),
]

#: Models and iterated joins are beyond SQL; tests/llm/test_pipeline.py checks the stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"stage{i}")
    return docs
