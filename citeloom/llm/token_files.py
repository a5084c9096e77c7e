"""Token files: frequency-ranked ids, byte-aligned, with separate control bytes.

Ids are replaced by their rank in the corpus' frequency order (ties: smaller
id first), so that frequent ones take one byte. Four ids share a control byte
with two bits each: the number of data bytes less one. Control bytes and data
bytes lie apart; a reader looks lengths up in a table for all control bytes at
once and gathers the data with numpy.

A corpus is a folder with `blocks` (one binary file per row: `file`, ordered
by `part` and `block`) and `ranks` (rank, id). A block has a header, the
doc_ids, the number of ids of each document, control bytes and data bytes.
Blocks hold documents in ascending doc_id order.

Defined results: a null or empty text has its end id only; null doc_ids come
first; rows that repeat a doc_id are documents of their own, ordered by a hash
of their text; extra columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.llm.arrow import binary_array, blob, pieces, tidy
from citeloom.llm.word_tokens import forget, word_tokenizer
from citeloom.session import shared_dir, written

MAGIC = b"SVB1"
#: Ids of a block, about; a document is never split.
BLOCK_IDS = 1 << 20
#: Data bytes of four ids, and where each begins, for every control byte.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1
STARTS = np.cumsum(LENGTHS, axis=1) - LENGTHS
TOTALS = LENGTHS.sum(axis=1)


def encode_numbers(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Control and data bytes of unsigned 32-bit numbers; the last group is filled with zeros."""
    x = np.concatenate([x.astype("<u4"), np.zeros(-len(x) % 4, "<u4")])
    size = 1 + (x > 0xFF) + (x > 0xFFFF) + (x > 0xFFFFFF)
    code = (size - 1).astype(np.uint8).reshape(-1, 4)
    control = code[:, 0] | code[:, 1] << 2 | code[:, 2] << 4 | code[:, 3] << 6
    keep = np.arange(4) < size[:, None]
    return control, x.view(np.uint8).reshape(-1, 4)[keep]


def decode_numbers(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The first n numbers, by table lookup."""
    total = TOTALS[control]
    at = ((np.cumsum(total) - total)[:, None] + STARTS[control]).ravel()
    size = LENGTHS[control].ravel()
    padded = np.concatenate([data, np.zeros(4, np.uint8)]).astype(np.uint32)
    out = padded[at]
    for k in (1, 2, 3):
        more = size > k
        if more.any():
            out[more] |= padded[at[more] + k] << np.uint32(8 * k)
    return out[:n]


def pack_block(start: int, doc_ids: np.ndarray, null: np.ndarray, sizes: np.ndarray, ranks: np.ndarray) -> bytes:
    """A block file; start: ids of the same part before it."""
    control, data = encode_numbers(ranks)
    header = np.array([start, len(sizes), len(ranks), len(control), len(data)], "<i8")
    return b"".join([MAGIC, header.tobytes(), doc_ids.astype("<i8").tobytes(), null.astype(np.uint8).tobytes(), sizes.astype("<i8").tobytes(), control.tobytes(), data.tobytes()])


def unpack_block(file: bytes) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """start, doc_ids, null flags, sizes and ranks of a block file."""
    if file[:4] != MAGIC:
        raise ValueError("not a token block")
    start, docs, ids, controls, datas = np.frombuffer(file, "<i8", 5, 4).tolist()
    at = 44
    doc_ids = np.frombuffer(file, "<i8", docs, at)
    null = np.frombuffer(file, np.uint8, docs, at := at + 8 * docs)
    sizes = np.frombuffer(file, "<i8", docs, at := at + docs)
    control = np.frombuffer(file, np.uint8, controls, at := at + 8 * docs)
    data = np.frombuffer(file, np.uint8, datas, at + controls)
    return start, doc_ids, null, sizes, decode_numbers(control, data, ids)


def tokens(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """doc_id, row_hash, ids (little-endian uint16, as the vocabulary has under 65,536 ids)."""
    docs = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("row_hash"), "text")

    def run(batches):
        tokenizer = word_tokenizer(path)
        if max(tokenizer.most, end_id) > 0xFFFF:
            raise ValueError("ids of this vocabulary do not fit into 16 bits")
        for batch in pieces(batches, "text", 8 << 20):
            ids, n = tokenizer.encode(batch.column("text"))
            whole = np.full(len(ids) + len(n), end_id, "<u2")
            whole[np.arange(len(ids)) + np.repeat(np.arange(len(n)), n)] = ids
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row_hash"), binary_array(whole, 2 * (n + 1))], names=["doc_id", "row_hash", "ids"])

    return docs.mapInArrow(tidy(run, forget), "doc_id long, row_hash long, ids binary")


def frequencies(encoded: DataFrame, size: int = 1 << 16) -> DataFrame:
    """id, n over all ids: each task counts its own first."""

    def run(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(blob(batch.column("ids"))[0].view("<u2"), minlength=size)
        own = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(total[own])], names=["id", "n"])

    return encoded.select("ids").mapInArrow(tidy(run), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_corpus(docs: DataFrame, path: str, end_id: int, folder: str) -> None:
    """Encode docs (doc_id, text) and write the corpus to folder."""
    spark = docs.sparkSession
    encoded = written(tokens(docs, path, end_id), "tokens")
    # At most as many rows as the vocabulary has ids.
    order = [r["id"] for r in frequencies(encoded).orderBy(F.desc("n"), "id").collect()]
    spark.createDataFrame(list(enumerate(order)), "rank int, id int").coalesce(1).write.parquet(f"{folder}/ranks")
    rank = np.zeros(1 << 16, np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)

    def run(batches):
        start, block, held = 0, 0, []

        def close():
            doc_ids, null, sizes, ids = (np.concatenate(x) for x in zip(*held, strict=True))
            return pa.RecordBatch.from_arrays([pa.array([block]), pa.array([len(ids)]), pa.array([pack_block(start, doc_ids, null, sizes, rank[ids])])], names=["block", "n_ids", "file"])

        n = 0
        for batch in pieces(batches, "ids", 2 * BLOCK_IDS):
            raw, size = blob(batch.column("ids"))
            own = batch.column("doc_id")
            held.append((own.fill_null(0).to_numpy(), own.is_null().to_numpy(zero_copy_only=False), size // 2, raw.view("<u2")))
            n += len(raw) // 2
            if n >= BLOCK_IDS:
                yield close()
                start, block, held, n = start + n, block + 1, [], 0
        if n:
            yield close()

    ordered = encoded.repartitionByRange(F.col("doc_id").asc_nulls_first(), "row_hash").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "row_hash")
    blocks = ordered.select("doc_id", "ids").mapInArrow(tidy(run), "block long, n_ids long, file binary").withColumn("part", F.spark_partition_id())
    blocks.write.option("compression", "zstd").parquet(f"{folder}/blocks")


def read_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids (little-endian uint32) of every document in the corpus."""
    ranks = spark.read.schema("rank int, id int").parquet(f"{folder}/ranks").orderBy("rank").collect()
    ids = np.array([r["id"] for r in ranks], "<u4")
    blocks = spark.read.schema("block long, n_ids long, file binary, part int").parquet(f"{folder}/blocks")
    # One row for each part of the shuffle that wrote the corpus.
    before, parts = 0, []
    for r in blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect():
        parts.append((r["part"], before))
        before += r["n"]
    base = dict(parts)

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, file in zip(batch.column("part").to_pylist(), batch.column("file"), strict=True):
                start, doc_ids, null, sizes, ranked = unpack_block(file.as_py())
                first = base[part] + start + np.cumsum(sizes) - sizes
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, mask=null.astype(bool)), pa.array(first), pa.array(sizes), binary_array(ids[ranked], 4 * sizes)], names=["doc_id", "start", "n_tokens", "ids"])

    return blocks.select("part", "file").mapInArrow(tidy(run), "doc_id long, start long, n_tokens long, ids binary")


def op5_token_files(spark, sf_dir: str) -> DataFrame:
    """Place, size and checksum of every document in the corpus that is read back."""
    import public_tokenizers

    folder = f"{shared_dir(spark)}/corpus-{uuid.uuid4().hex}"
    write_corpus(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"), 2, folder)
    return read_corpus(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
