"""Packing of token ids into fixed sequences by minimum bin slack.

Documents are cut at multiples of the capacity; every piece then has a length
of 1 to capacity. A histogram of these lengths, which has at most `capacity`
entries whatever the corpus, goes to the driver. There a bitset subset-sum
program picks, window after window, the multiset of lengths that fills a
sequence closest to capacity; a multiset is used as often as the counts
allow. If slack stays, one more piece is cut to fill it. What is left at the
end goes to sequences whose lengths are powers of two, so nothing is padded.
The plan is a list of rank ranges of bounded size; executors join it to their
pieces by length and rank.

Defined results: a null text counts as empty and still has its end id; an
empty table gives no rows; rows that repeat a doc_id are packed each on its
own (a null doc_id too); extra columns are ignored.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citeloom.llm.arrow import binary_array, pieces, tidy
from citeloom.llm.word_tokens import forget, word_tokenizer
from citeloom.session import written

CAPACITY = 2048
#: Rows of a plan up to which it is broadcast (about 15 MB).
SMALL = 200_000


def best_fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of lengths with the largest sum up to capacity, as length: count.

    The largest length present is always in it. Bit s of a set says that sum s
    can be reached; the sets before each step are kept to walk back.
    """
    top = max(counts)
    room = capacity - top
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted(counts, reverse=True):
        spare = min(counts[length] - (length == top), room // length)
        take = 1
        while spare > 0:
            take = min(take, spare)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            spare -= take
            take *= 2
        if reach >> room & 1:
            break
    left, used = reach.bit_length() - 1, {top: 1}
    for length, take, before in reversed(steps):
        if not before >> left & 1:
            left -= length * take
            used[length] = used.get(length, 0) + take
    return used


class Pool:
    """Remaining pieces by length, as runs (origin, start, first rank, end rank)."""

    def __init__(self, counts: dict[int, int]):
        self.runs = {n: deque([(n, 0, 0, c)]) for n, c in counts.items() if c}
        self.counts = {n: c for n, c in counts.items() if c}

    def take(self, length: int, n: int):
        """n pieces of that length, as runs in order."""
        self.counts[length] -= n
        if not self.counts[length]:
            del self.counts[length]
        runs = self.runs[length]
        while n:
            origin, start, low, high = runs.popleft()
            if high - low > n:
                runs.appendleft((origin, start, low + n, high))
                high = low + n
            n -= high - low
            yield origin, start, low, high

    def put(self, run: tuple[int, int, int, int]) -> None:
        length = run[0] - run[1]
        self.runs.setdefault(length, deque()).append(run)
        self.counts[length] = self.counts.get(length, 0) + run[3] - run[2]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int, int, int, int]]:
    """Rows (origin, low, high, start, length, first, per, sequence, offset).

    The piece of length `origin` with rank low + t gives its ids from start on,
    length of them, as item first + t of its slot: to sequence + item // per,
    at offset + item % per * length.
    """
    pool, out, sequence = Pool(counts), [], 0

    def slot(length: int, n: int, times: int, offset: int) -> None:
        item = 0
        for origin, start, low, high in pool.take(length, n * times):
            out.append((origin, low, high, start, length, item, n, sequence, offset))
            item += high - low

    while pool.counts:
        used = best_fill(pool.counts, capacity)
        filled = sum(n * k for n, k in used.items())
        slack = capacity - filled
        more = [n for n in pool.counts if pool.counts[n] > used.get(n, 0)] if slack else []
        cut = max(more, default=0)
        if slack and not cut:
            break
        need = used | ({cut: used.get(cut, 0) + 1} if cut else {})
        times, offset = min(pool.counts[n] // k for n, k in need.items()), 0
        for length, n in used.items():
            slot(length, n, times, offset)
            offset += length * n
        if cut:
            item = 0
            for origin, start, low, high in list(pool.take(cut, times)):
                out.append((origin, low, high, start, slack, item, 1, sequence, offset))
                pool.put((origin, start + slack, low, high))
                item += high - low
        sequence += times
    rest = [(origin, start, rank, length) for length, n in sorted(pool.counts.items(), reverse=True) for origin, start, low, high in list(pool.take(length, n)) for rank in range(low, high)]
    total = sum(x[3] for x in rest)
    room = offset = 0
    for origin, start, rank, length in rest:
        while length:
            if not room:
                room, offset = 1 << (total.bit_length() - 1), 0
                sequence += 1
            n = min(length, room)
            out.append((origin, rank, rank + 1, start, n, 0, 1, sequence - 1, offset))
            start, length, room, offset, total = start + n, length - n, room - n, offset + n, total - n
    return out


def token_pieces(docs: DataFrame, path: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of at most capacity ids: doc_id, row_hash, start, length, doc_tokens, ids (binary)."""
    docs = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("row_hash"), "text")

    def run(batches):
        tokenizer = word_tokenizer(path)
        for batch in pieces(batches, "text", 8 << 20):
            ids, n = tokenizer.encode(batch.column("text"))
            tokens = n + 1
            whole = np.full(len(ids) + len(n), end_id, np.uint32)
            whole[np.arange(len(ids)) + np.repeat(np.arange(len(n)), n)] = ids
            parts = -(-tokens // capacity)
            row = np.repeat(np.arange(len(n)), parts)
            start = (np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)) * capacity
            length = np.minimum(capacity, tokens[row] - start)
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(take), batch.column("row_hash").take(take), pa.array(start), pa.array(length), pa.array(tokens[row]), binary_array(whole, 4 * length)],
                names=["doc_id", "row_hash", "start", "length", "doc_tokens", "ids"],
            )

    return docs.mapInArrow(tidy(run, forget), "doc_id long, row_hash long, start long, length long, doc_tokens long, ids binary")


def pack(pieces_df: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Places for pieces (doc_id, row_hash, start, length, ...), none longer than capacity.

    Adds sequence_id and offset; a piece that was cut appears once for each
    part, with `cut` true and its own start and length.
    """
    spark = pieces_df.sparkSession
    counts = {r["length"]: r["count"] for r in pieces_df.groupBy("length").count().collect()}
    salts = min(4096, max(16, sum(counts.values()) // 200_000))
    rows = plan(counts, capacity)
    places = spark.createDataFrame(rows or [(0,) * 9], "origin long, low long, high long, begin long, n long, first long, per long, sequence long, place long")
    salted = pieces_df.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "row_hash"), F.lit(salts)))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = salted.groupBy("length", "salt").count().select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "start", "row_hash")
    ranked = salted.withColumn("rank", F.row_number().over(order) - 1).join(base, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("base"))
    # Each multiset uses up a length, of which there are `capacity`, so places stays small; should it not, it is joined by shuffle.
    met = ranked.join(F.broadcast(places) if len(rows) <= SMALL else places, (F.col("length") == F.col("origin")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    item = F.col("first") + F.col("rank") - F.col("low")
    return met.select(
        *[c for c in pieces_df.columns if c not in ("start", "length")],
        (F.col("start") + F.col("begin")).alias("start"),
        F.col("n").alias("length"),
        (F.col("n") != F.col("length")).alias("cut"),
        (F.col("sequence") + F.floor(item / F.col("per"))).alias("sequence_id"),
        (F.col("place") + item % F.col("per") * F.col("n")).alias("offset"),
    )


def packed_ids(docs: DataFrame, placed: DataFrame, path: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of pack() with their ids: each document is encoded again and its pieces are cut from it."""
    return _cut_ids(docs, placed, path, end_id, capacity).select(*[c for c in placed.columns if c != "cut"], "ids")


def _cut_ids(docs: DataFrame, placed: DataFrame, path: str, end_id: int, capacity: int) -> DataFrame:
    grid = token_pieces(docs, path, end_id, capacity).select("doc_id", "row_hash", F.col("start").alias("from"), "ids").dropDuplicates(["doc_id", "row_hash", "from"])
    placed = placed.withColumn("from", F.col("start") - F.col("start") % capacity)
    same = placed["doc_id"].eqNullSafe(grid["doc_id"]) & (placed["row_hash"] == grid["row_hash"]) & (placed["from"] == grid["from"])
    ids = F.expr("substring(ids, cast((start - from) * 4 + 1 AS int), cast(length * 4 AS int))")
    return placed.join(grid.select("doc_id", "row_hash", "from", "ids"), same).select(*[placed[c] for c in placed.columns if c != "from"], placed["from"].alias("from"), grid["ids"]).withColumn("ids", ids).drop("from")


def packed_documents(docs: DataFrame, path: str, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece."""
    grid = token_pieces(docs, path, end_id, capacity).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    placed = written(pack(written(grid, "pieces"), capacity), "placed")
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    # Only pieces that were cut once more need their ids again.
    cut = placed.filter("cut").drop("ids_crc32")
    keys = written(cut.select("doc_id", "row_hash").distinct(), "cut")  # its files tell Spark whether it is small
    hashed = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("row_hash"))
    again = hashed.join(keys, hashed["doc_id"].eqNullSafe(keys["doc_id"]) & (hashed["row_hash"] == keys["row_hash"]), "left_semi")
    redone = _cut_ids(again, cut, path, end_id, capacity).withColumn("ids_crc32", F.crc32("ids"))
    return placed.filter("NOT cut").select(columns).unionByName(redone.select(columns))


def op10_packing(spark, sf_dir: str) -> DataFrame:
    """Every document's pieces in sequences of at most 2048 ids."""
    import public_tokenizers

    return packed_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
