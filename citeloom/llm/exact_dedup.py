"""Exact duplicates by sharded cuckoo-filter indexes of live digests.

A text's key is the SHA-256 digest of its normalised form. An index is a cuckoo
filter: every key has two buckets of four slots, and a slot holds a 16-bit
fingerprint. Beside each slot the bucket holds its content: the whole digest and
what is known of its live rows (the first row, and how many there are). A
fingerprint that is found is only a hit; it counts once the digest stored there
equals the one asked for. A full bucket moves a fingerprint to its other
bucket; when that does not end, the filter is doubled and filled again from the
stored keys. (Digests that share fingerprint and buckets however large the
filter gets are kept in a plain list beside it.) A deletion takes a digest out of its slot when its last row is gone.

On a cluster each task first runs its rows through an index of its own, which
sends one row per distinct digest and so takes the weight out of a large group
of copies. What is left is dealt to shards by the digest; a shard is a small
index in one task. The shards' contents are a table (digest, first row, rows):
`changed` loads them again and applies insertions and deletions, so an index
lives on from one batch to the next without its documents.

Defined results: a null text is empty; a null doc_id counts as a row, but names
a group only if no other row does (keep_id is then null); rows that repeat a
doc_id and a text are copies, and exactly one of them stays; an empty table
gives no rows; extra columns pass through `marked` unless they bear the name of
an output column, which replaces them.
"""

from __future__ import annotations

from array import array

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.llm.arrow import tidy
from citeloom.session import written

#: A filter with fewer keys than this share of its slots is not doubled for one that finds no place.
SPARSE = 1 / 8
#: White space that counts as one space.
BLANKS = r"[\x20\x09-\x0D]+"
SLOTS = 4
#: Fingerprints moved before a filter is doubled.
MOVES = 200
#: Distinct digests that a task's own index holds before it sends them on, and that a shard is planned for.
HELD, SHARD = 200_000, 100_000
OUTPUT = ["keep_id", "group_size", "kept", "text_sha256"]
#: A row of what an index knows: digest, its first row (null ids last), live rows.
STATE = "digest binary, id long, row long, n long"


class CuckooIndex:
    """Live digests, each with its first row and its number of rows."""

    def __init__(self, buckets: int = 1024):
        """buckets: a power of two."""
        self.size, self.aside = 0, {}
        self._room(buckets)

    def _room(self, buckets: int) -> None:
        self.buckets = buckets
        self.prints = array("H", bytes(2 * SLOTS * buckets))  # zero: the slot is free
        self.content: list[list | None] = [None] * (SLOTS * buckets)

    def _other(self, bucket: int, mark: int) -> int:
        return (bucket ^ mark * 0x5BD1E995) & (self.buckets - 1)

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        """Fingerprint and both buckets."""
        mark = int.from_bytes(digest[:2], "little") or 1
        bucket = int.from_bytes(digest[2:10], "little") & (self.buckets - 1)
        return mark, bucket, self._other(bucket, mark)

    def _slot(self, digest: bytes) -> int:
        """The slot that holds this very digest, or -1."""
        mark, *both = self._places(digest)
        for bucket in both:
            at = SLOTS * bucket
            if mark in self.prints[at : at + SLOTS]:
                for slot in range(at, at + SLOTS):
                    if self.prints[slot] == mark and self.content[slot][0] == digest:
                        return slot
        return -1

    def get(self, digest: bytes) -> list | None:
        """[digest, first row, rows] if the digest is live."""
        slot = self._slot(digest)
        return self.content[slot] if slot >= 0 else self.aside.get(digest)

    def insert(self, digest: bytes, first: tuple, n: int = 1) -> None:
        """n more rows of a digest; `first` is the first of them."""
        own = self.get(digest)
        if own:
            own[1], own[2] = min(own[1], first), own[2] + n
            return
        self.size += 1
        left = self._placed([digest, first, n])
        if left is None:
            return
        if self.size < SPARSE * SLOTS * self.buckets:
            self.aside[left[0]] = left
            return
        stored = [*(x for x in self.content if x is not None), left]
        while left is not None:
            self._room(2 * self.buckets)
            sparse = len(stored) < SPARSE * SLOTS * self.buckets
            for item in stored:
                left = self._placed(item)
                if left is not None and not sparse:
                    break
                if left is not None:
                    self.aside[left[0]], left = left, None

    def _placed(self, item: list) -> list | None:
        """Puts the item into one of its buckets, moving others; what found no place comes back."""
        mark, bucket, second = self._places(item[0])
        for b in (bucket, second):
            if self._put(b, mark, item):
                return None
        for move in range(MOVES):
            slot = SLOTS * bucket + move % SLOTS
            self.prints[slot], mark = mark, self.prints[slot]
            self.content[slot], item = item, self.content[slot]
            bucket = self._other(bucket, mark)
            if self._put(bucket, mark, item):
                return None
        return item

    def _put(self, bucket: int, mark: int, item: list) -> bool:
        at = SLOTS * bucket
        if 0 not in self.prints[at : at + SLOTS]:
            return False
        slot = self.prints.index(0, at)
        self.prints[slot], self.content[slot] = mark, item
        return True

    def delete(self, digest: bytes, n: int = 1) -> bool:
        """n rows of a digest less; with the last one its slot is free again. False if it is not live."""
        own = self.get(digest)
        if own is None:
            return False
        own[2] -= n
        if own[2] <= 0:
            self.size -= 1
            slot = self._slot(digest)
            if slot >= 0:
                self.prints[slot], self.content[slot] = 0, None
            else:
                del self.aside[digest]
        return True

    def items(self) -> list[list]:
        return [*(x for x in self.content if x is not None), *self.aside.values()]


def digest_of(text: Column) -> Column:
    """SHA-256 (hex) of a text whose runs of white space are one space each; null counts as empty."""
    return F.sha2(F.encode(F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, " "), "utf-8"), 256)


def keys_of(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without text, with __digest (binary) and __row (a number of its own for each row); written."""
    keep = [c for c in docs.columns if c not in (text, *OUTPUT)]
    return written(docs.select(*keep, F.unhex(digest_of(F.col(text))).alias("__digest"), F.monotonically_increasing_id().alias("__row")), "digests")


def _order(id_, row) -> tuple:
    return id_ is None, id_ or 0, row


def _batch(items: list[list], **more: pa.Array) -> pa.RecordBatch:
    firsts = [x[1] for x in items]
    columns = [pa.array([x[0] for x in items], pa.binary()), pa.array([None if f[0] else f[1] for f in firsts], pa.int64()), pa.array([f[2] for f in firsts], pa.int64()), pa.array([x[2] for x in items], pa.int64())]
    return pa.RecordBatch.from_arrays([*columns, *more.values()], names=["digest", "id", "row", "n", *more])


def _rows(batch: pa.RecordBatch):
    return zip(*(batch.column(c).to_pylist() for c in ("digest", "id", "row", "n")), strict=True)


def combined(states: DataFrame) -> DataFrame:
    """States (digest, id, row, n) after every task's own index: one for each of its distinct digests, by HELD at a time."""

    def run(batches):
        index = CuckooIndex()
        for batch in batches:
            for digest, id_, row, n in _rows(batch):
                index.insert(digest, _order(id_, row), n)
            if index.size >= HELD:
                yield _batch(index.items())
                index = CuckooIndex()
        yield _batch(index.items())

    return states.select("digest", "id", "row", "n").mapInArrow(tidy(run), STATE)


def _shards(states: DataFrame) -> int:
    return max(int(states.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-states.count() // SHARD))


def indexed(states: DataFrame) -> DataFrame:
    """The index of all states: one for each digest, with its first row and its rows."""
    own = written(combined(states), "states")  # counted, then dealt

    def run(batches):
        index = CuckooIndex()
        for batch in batches:
            for digest, id_, row, n in _rows(batch):
                index.insert(digest, _order(id_, row), n)
        items = index.items()
        for i in range(0, len(items), 20_000):
            yield _batch(items[i : i + 20_000])

    return own.repartition(_shards(own), "digest").mapInArrow(tidy(run), STATE)


def single(keys: DataFrame, key: str = "doc_id") -> DataFrame:
    """States of one row each from keys_of."""
    return keys.select(F.col("__digest").alias("digest"), F.col(key).cast("long").alias("id"), F.col("__row").alias("row"), F.lit(1).cast("long").alias("n"))


def changed(index: DataFrame, live: DataFrame, inserted: DataFrame, deleted: DataFrame) -> DataFrame:
    """The index after rows came and went: index is what indexed gave for the states live.

    inserted and deleted are states of one row each; a deleted one that is not
    live changes nothing. Only digests that lose their first row and keep
    others read live again.
    """
    gone = written(deleted.join(live.select("digest", "row"), ["digest", "row"], "left_semi").dropDuplicates(["row"]), "deleted")
    both = combined(gone).withColumn("kind", F.lit(1)).unionByName(combined(inserted).withColumn("kind", F.lit(2)))
    dealt = index.select("digest", "id", "row", "n").withColumn("kind", F.lit(0)).unionByName(both).repartition(_shards(index), "digest").sortWithinPartitions("kind")

    def run(batches):
        cuckoo, stale = CuckooIndex(), set()
        for batch in batches:
            for (digest, id_, row, n), kind in zip(_rows(batch), batch.column("kind").to_pylist(), strict=True):
                first = _order(id_, row)
                if kind != 1:
                    cuckoo.insert(digest, first, n)
                    continue
                own = cuckoo.get(digest)
                if own and own[1] == first:
                    stale.add(digest)
                cuckoo.delete(digest, n)
                if cuckoo.get(digest) is None:
                    stale.discard(digest)
        items = cuckoo.items()
        yield _batch(items, stale=pa.array([x[0] in stale for x in items], pa.bool_()))

    now = written(dealt.mapInArrow(tidy(run), f"{STATE}, stale boolean"), "index")
    stale = now.filter("stale").select("digest")
    rest = live.select("digest", "id", "row", "n").join(gone.select("row"), "row", "left_anti").select("digest", "id", "row", "n").unionByName(inserted.select("digest", "id", "row", "n"))
    return now.filter("NOT stale").drop("stale").unionByName(indexed(rest.join(stale, "digest", "left_semi")))


def marked(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without text, with keep_id, group_size, kept and text_sha256; of equal texts the row with the smallest key is kept."""
    keys = keys_of(docs, key, text)
    groups = written(indexed(single(keys, key)).filter("n > 1"), "groups")  # its files tell Spark whether it is small
    met = keys.join(groups.select(F.col("digest").alias("__digest"), F.col("id").alias("__id"), F.col("row").alias("__first"), F.col("n").alias("__n")), "__digest", "left")
    alone = F.col("__n").isNull()
    return met.select(
        *[c for c in keys.columns if c not in ("__digest", "__row")],
        F.when(alone, F.col(key)).otherwise(F.col("__id")).cast(docs.schema[key].dataType).alias("keep_id"),
        F.coalesce("__n", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("__row") == F.col("__first"))).alias("kept"),
        F.lower(F.hex("__digest")).alias("text_sha256"),
    )


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that stay, whole: only survivors of repeated texts are looked up."""
    drop = written(marked(docs.select(key, text), key, text).filter("NOT kept").select(F.col("text_sha256").alias("__h"), F.col("keep_id").alias("__k")).distinct(), "repeated")
    own = docs.withColumn("__h", digest_of(F.col(text)))
    lone = own.join(drop, "__h", "left_anti")
    firsts = own.join(drop, (own["__h"] == drop["__h"]) & own[key].eqNullSafe(drop["__k"]), "left_semi").dropDuplicates(["__h"])
    return lone.unionByName(firsts).drop("__h")


def op11_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document with the one that stays of its equals."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return marked(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


SQL = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id NULLS LAST) = 1 AS kept, text_sha256
FROM t WINDOW g AS (PARTITION BY text_sha256)
"""
