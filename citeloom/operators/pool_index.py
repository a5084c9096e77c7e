"""An index of what the pool's records say, kept up as files come, change and go.

One row for each occurrence of a value: kind, key (the value's canonical form),
value, file, rec_ord. Rows lie in folders by the hash of (kind, key). An update
compares digests of the files, reads the files that are new or changed, and
writes the buckets that these or vanished files touch; all other buckets stay
where earlier updates wrote them. A small pointer, moved last and in one step,
says which folder holds each bucket: a job that dies leaves the old index whole.
One update at a time; old folders stay until somebody removes them.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.functions import keys
from citeloom.session import written
from citeloom.sources import envelopes, versions

BUCKETS = 256
#: Rows of a bucket that one task writes; heavier buckets are dealt to several.
HEAVY = 2_000_000
SCHEMA = "kind string, key string, value string, file string, rec_ord int, version string, bucket int"
FILES = "file string, digest string, touched array<int>"

#: Kind of an occurrence, the record's column, and its canonical form.
KINDS = (
    ("journal", "container_title", keys.journal_key), ("venue", "container_title", keys.venue_key), ("volume", "volume", lambda c: F.trim(keys.text_of(c))), ("issue", "issue", lambda c: F.trim(keys.text_of(c))),
    ("pages", "pages", keys.page_key), ("publisher", "publisher", keys.publisher_key), ("year", "year", keys.year_key), ("doi", "doi", keys.doi_key),
)
#: Kinds that can confirm an entry's field.
CONFIRMS = {"journal": ("journal", "venue"), "booktitle": ("journal", "venue"), "volume": ("volume",), "number": ("issue",), "pages": ("pages",), "publisher": ("publisher",), "doi": ("doi",)}


def bucket_of(kind: Column, key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(kind, key), F.lit(buckets)).cast("int")


def postings(records: DataFrame) -> DataFrame:
    """kind, key, value, file, rec_ord of all values that records (file, rec_ord, ...) give; empty keys have no row."""
    each = F.array(*[F.struct(F.lit(kind).alias("kind"), form(column).alias("key"), F.col(column).alias("value")) for kind, column, form in KINDS])
    return records.select("file", F.col("rec_ord").cast("int").alias("rec_ord"), F.explode(each).alias("p")).filter("p.key != ''").select("p.kind", "p.key", "p.value", "file", "rec_ord")


def _state(spark: SparkSession, out: str) -> dict | None:
    text = versions.get(spark, f"{out.rstrip('/')}/{versions.POINTER}")
    return json.loads(text) if text else None


def _rows(spark: SparkSession, out: str, state: dict, buckets: list[int]) -> DataFrame:
    """Rows of some buckets; only their folders are listed and read."""
    data = f"{out.rstrip('/')}/data"
    held = [f"{data}/version={state['held'][str(b)]}/bucket={b}" for b in buckets if str(b) in state["held"]]
    if not held:
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).option("basePath", data).parquet(*held)


def update(files: DataFrame, out: str, buckets: int = BUCKETS) -> dict:
    """Makes the index under out that of files (file, content), the whole pool as it is now.

    A path counts once: of rows with one path the smallest content by digest
    counts. A null content, and one that is no envelope, gives no rows. Returns
    counts: read, gone, same (files), written (buckets). The number of buckets
    is that of the first update. What reaches the driver are bucket numbers.
    """
    spark = files.sparkSession
    state = _state(spark, out)
    buckets = state["buckets"] if state else buckets
    root = out.rstrip("/")
    old = spark.read.schema(FILES).parquet(f"{root}/files/{state['version']}") if state else spark.createDataFrame([], FILES)
    digest = F.sha2(F.encode(F.coalesce("content", F.lit("")), "utf-8"), 256)
    now = files.filter("file IS NOT NULL").select("file", digest.alias("now")).groupBy("file").agg(F.min("now").alias("now"))
    compared = written(now.join(old, "file", "full").select("file", "now", "digest", "touched", F.when(F.col("now").isNull(), "gone").when(F.coalesce(F.col("now") == F.col("digest"), F.lit(False)), "same").otherwise("read").alias("fate")), "compared")
    count = {r.fate: r["count"] for r in compared.groupBy("fate").count().collect()}
    report = {fate: count.get(fate, 0) for fate in ("read", "gone", "same")} | {"written": 0}
    if state and not report["read"] and not report["gone"]:
        return report
    fresh = files.select("file", "content", digest.alias("now")).join(compared.filter("fate = 'read'").select("file", "now"), ["file", "now"]).dropDuplicates(["file"])
    rows = postings(envelopes.records(envelopes.pool(fresh.select("file", "content"))))
    new = written(rows.withColumn("bucket", bucket_of(F.col("kind"), F.col("key"), buckets)), "postings")
    by_file = new.groupBy("file").agg(F.array_sort(F.collect_set("bucket")).alias("new_touched"))  # at most `buckets` numbers each
    left = compared.filter("fate != 'same'").select(F.explode("touched").alias("bucket"))
    dirty = sorted(r.bucket for r in left.union(new.select("bucket")).distinct().collect())
    stale = compared.filter("fate != 'same' AND digest IS NOT NULL").select("file")
    version = uuid.uuid4().hex
    held = dict(state["held"]) if state else {}
    if dirty:
        columns = ["kind", "key", "value", "file", "rec_ord", "bucket"]
        kept = _rows(spark, root, state, dirty).select(columns).join(stale, "file", "left_anti") if state else None
        whole = new.select(columns) if kept is None else kept.select(columns).unionByName(new.select(columns))
        whole = written(whole, "buckets")
        sizes = {r.bucket: r["count"] for r in whole.groupBy("bucket").count().collect()}
        parts = {b: -(-n // HEAVY) for b, n in sizes.items() if n > HEAVY}
        share = F.lit(0)
        if parts:
            of = F.create_map(*[F.lit(x) for pair in parts.items() for x in pair])
            share = F.pmod(F.xxhash64("file", "rec_ord"), F.coalesce(F.try_element_at(of, F.col("bucket")), F.lit(1)))
        dealt = whole.withColumn("__share", share).repartition(F.col("bucket"), F.col("__share")).drop("__share")
        # Sorted within files, so that a reader's filter on a key skips row groups.
        dealt.sortWithinPartitions("bucket", "kind", "key", "file", "rec_ord").write.partitionBy("bucket").parquet(f"{root}/data/version={version}")
        held = {b: v for b, v in held.items() if int(b) not in set(dirty)} | {str(b): version for b in sizes}
    listed = compared.filter("fate != 'gone'").join(by_file, "file", "left")
    touched = F.when(F.col("fate") == "same", F.col("touched")).otherwise(F.coalesce("new_touched", F.array().cast("array<int>")))
    listed.select("file", F.col("now").alias("digest"), touched.alias("touched")).write.parquet(f"{root}/files/{version}")
    versions._step("pointer", lambda: versions.put(spark, f"{root}/{versions.POINTER}", json.dumps({"version": version, "buckets": buckets, "held": held})))
    return report | {"written": len(dirty)}


def read(spark: SparkSession, out: str) -> DataFrame:
    """All rows of the index (kind, key, value, file, rec_ord, bucket); none before the first update."""
    state = _state(spark, out)
    return (_rows(spark, out, state, list(range(state["buckets"]))) if state else spark.createDataFrame([], SCHEMA)).drop("version")


def lookup(spark: SparkSession, out: str, asked: list[tuple[str, str]]) -> DataFrame:
    """Rows for a short list of (kind, key); only the buckets of these keys are read."""
    state = _state(spark, out)
    if not state or not asked:
        return spark.createDataFrame([], SCHEMA).drop("version")
    wanted = spark.createDataFrame([tuple(a) for a in asked], "kind string, key string").distinct()
    place = [r.b for r in wanted.select(bucket_of(F.col("kind"), F.col("key"), state["buckets"]).alias("b")).distinct().collect()]
    hit = F.lit(False)
    for kind, key in asked:
        hit = hit | ((F.col("kind") == kind) & (F.col("key") == key))
    return _rows(spark, out, state, sorted(place)).filter(hit).drop("version")


def doi_files(index: DataFrame) -> DataFrame:
    """key, file of every DOI: the last file that gives it."""
    return index.filter("kind = 'doi'").groupBy("key").agg(F.max("file").alias("file"))


def confirmed(entries: DataFrame, index: DataFrame) -> DataFrame:
    """entries (field, value, ...) with verifiable: whether the pool has the value; fields without a kind are taken to be.

    A name of a venue is confirmed as a journal or as a venue. Repeated entries
    keep their number: the index is reduced to its keys before the join.
    """
    forms = {kind: form for kind, _, form in KINDS}
    of = lambda kinds: F.array(*[F.struct(F.lit(k).alias("kind"), forms[k]("value").alias("key")) for k in kinds])
    asks = None
    for field, kinds in CONFIRMS.items():
        asks = F.when(F.col("field") == field, of(kinds)) if asks is None else asks.when(F.col("field") == field, of(kinds))
    known = index.select("kind", "key").distinct()
    pairs = entries.select("field", "value").distinct().select("field", "value", F.explode(asks).alias("a")).select("field", "value", F.col("a.kind").alias("kind"), F.col("a.key").alias("key"))
    found = pairs.filter("key != ''").join(known, ["kind", "key"], "left_semi").select("field", "value").distinct().withColumn("__found", F.lit(True))
    e, f = entries.alias("e"), found.alias("f")
    joined = e.join(f, F.col("e.field").eqNullSafe(F.col("f.field")) & F.col("e.value").eqNullSafe(F.col("f.value")), "left")
    names = [c for c in entries.columns if c != "verifiable"]
    free = ~F.coalesce(F.col("e.field").isin(*CONFIRMS), F.lit(False))
    return joined.select(*[F.col(f"e.`{c}`") for c in names], (free | F.coalesce(F.col("f.__found"), F.lit(False))).alias("verifiable"))
