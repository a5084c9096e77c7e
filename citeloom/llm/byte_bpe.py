"""Byte-level BPE encoding and decoding of whole texts.

Texts longer than a chunk are cut into overlapping chunks, in one pass over
the text, that are pre-tokenised and encoded in parallel. A chunk reports the
pre-token boundaries in its overlaps, with the number of ids before each.
Neighbouring chunks are stitched at the first boundary that both report:
matching is memoryless, so from a shared boundary on both see the same
pre-tokens. A chunk keeps its ids between its two stitches; only the cut into
chunks and the final concatenation of ids see a whole long text.

Defined results: a null text is empty, an empty text has no ids; repeated
rows give repeated results; extra columns pass through unless they bear the
name of an output column, which replaces them.
"""

from __future__ import annotations

import base64
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeloom.llm.arrow import binary_array, pieces, tidy, with_columns
from citeloom.session import written

#: Characters of a chunk, and by how many a chunk reaches into the next.
CHUNK, OVERLAP = 65_536, 4_096
#: Characters at a chunk's end where a boundary may be an artefact of the cut.
UNSURE = 4
#: Pre-tokens that a worker remembers before it starts afresh.
REMEMBERED = 400_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Codec(dict):
    """Maps a pre-token to its ids as little-endian uint32 bytes."""

    def __init__(self, path: str, pattern: str):
        import regex
        import tiktoken

        super().__init__()
        ranks = load_ranks(path)
        self.pattern = regex.compile(pattern)
        self.one = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.token = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.token[rank] = token

    def __missing__(self, piece: str) -> bytes:
        ids = self[piece] = array("I", self.one(piece.encode())).tobytes()
        return ids

    def encode(self, piece_list: list[str]) -> bytes:
        if len(self) > REMEMBERED:
            self.clear()
        return b"".join(map(self.__getitem__, piece_list))

    def encode_chunk(self, chunk: str) -> tuple[bytes, np.ndarray, np.ndarray]:
        """The ids of a chunk, where each pre-token begins, and the number of ids before it."""
        if len(self) > REMEMBERED:
            self.clear()
        found = self.pattern.findall(chunk)
        each = [self[piece] for piece in found]
        size, ids = (np.fromiter(map(len, x), np.int64, len(x)) for x in (found, each))
        return b"".join(each), np.cumsum(size) - size, (np.cumsum(ids) - ids) // 4

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, memoryview(ids).cast("I").tolist()))


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One codec for each worker process."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(path, pattern)
    return _CODECS[path, pattern]


def forget() -> None:
    """Drop the ids that this worker remembers; what loading cost stays."""
    for own in _CODECS.values():
        own.clear()


def _schema(df: DataFrame, drop: set[str], **new: T.DataType) -> tuple[list[str], T.StructType]:
    keep = [f for f in df.schema.fields if f.name not in drop | set(new)]
    return [f.name for f in keep], T.StructType([*keep, *(T.StructField(k, v) for k, v in new.items())])


def _blobs(values: list[bytes]) -> pa.Array:
    return binary_array(np.frombuffer(b"".join(values), np.uint8), np.fromiter(map(len, values), np.int64, len(values)))


def encode_pieces(df: DataFrame, path: str, pattern: str, column: str = "text") -> DataFrame:
    """df without the text column, with ids (binary); the column's pre-tokens never cross its ends."""
    keep, schema = _schema(df, {column}, ids=T.BinaryType())

    def run(batches):
        c = codec(path, pattern)
        for batch in pieces(batches, column):
            texts = batch.column(column).to_pylist()
            yield with_columns(batch, keep, ids=_blobs([c.encode(c.pattern.findall(t or "")) for t in texts]))

    return df.mapInArrow(tidy(run, forget), schema)


def _chunks(df: DataFrame) -> DataFrame:
    """__row, __k, last, chunk of texts (__row, text), cut in one pass."""

    def run(batches):
        for batch in batches:
            for row, value in zip(batch.column("__row").to_pylist(), batch.column("text"), strict=True):
                text = value.as_py()
                for k, at in enumerate(range(0, len(text), CHUNK)):
                    yield pa.RecordBatch.from_arrays([pa.array([row]), pa.array([k], pa.int32()), pa.array([at + CHUNK >= len(text)]), pa.array([text[at : at + CHUNK + OVERLAP]])], names=["__row", "__k", "last", "chunk"])

    return df.select("__row", "text").mapInArrow(tidy(run), "__row string, __k int, last boolean, chunk string")


def joined_ids(df: DataFrame) -> DataFrame:
    """__row and ids of parts (__row, __k, ids), one after another."""
    listed = df.groupBy("__row").agg(F.array_sort(F.collect_list(F.struct("__k", "ids"))).alias("parts")).select("__row", F.col("parts.ids").alias("parts"))

    def run(batches):
        for batch in batches:
            whole = [b"".join(x.as_py()) for x in batch.column("parts")]
            yield pa.RecordBatch.from_arrays([batch.column("__row"), pa.array(whole, pa.binary())], names=["__row", "ids"])

    return listed.mapInArrow(tidy(run), "__row string, ids binary")


def _stitched(df: DataFrame, path: str, pattern: str) -> DataFrame:
    """Ids of long texts. df: __row, text."""
    pairs = "array<struct<at:int,ids:int>>"

    def run(batches):
        c = codec(path, pattern)
        kind = pa.list_(pa.struct([("at", pa.int32()), ("ids", pa.int32())]))
        for batch in pieces(batches, "chunk"):
            ids, early, late = [], [], []
            for chunk in batch.column("chunk").to_pylist():
                own, at, before = c.encode_chunk(chunk)
                first, second = at < OVERLAP, (at >= CHUNK) & (at <= len(chunk) - UNSURE)
                ids.append(own)
                early.append([{"at": a, "ids": n} for a, n in zip(at[first].tolist(), before[first].tolist(), strict=True)])
                late.append([{"at": a - CHUNK, "ids": n} for a, n in zip(at[second].tolist(), before[second].tolist(), strict=True)])
            yield with_columns(batch, ["__row", "__k", "last"], ids=_blobs(ids), early=pa.array(early, kind), late=pa.array(late, kind))

    dealt = _chunks(df).repartition("__row", "__k")
    done = written(dealt.mapInArrow(tidy(run, forget), f"__row string, __k int, last boolean, ids binary, early {pairs}, late {pairs}"), "chunks")
    # Every chunk but the last meets the next one's early boundaries; only these short lists are joined.
    ahead = done.select("__row", (F.col("__k") - 1).alias("__k"), "early")
    met = done.filter("NOT last").select("__row", "__k", "late").join(ahead, ["__row", "__k"])
    shared = F.array_min(F.array_intersect(F.col("late.at"), F.col("early.at")))
    number = lambda side: F.try_element_at(F.col(f"{side}.ids"), F.array_position(F.col(f"{side}.at"), F.col("at")).cast("int"))
    met = met.withColumn("at", shared).filter("at IS NOT NULL").select("__row", "__k", number("late").alias("stop"), number("early").alias("start"))
    cut = done.select("__row", "__k", "last", "ids").join(met.select("__row", "__k", "stop"), ["__row", "__k"], "left")
    cut = cut.join(met.select("__row", (F.col("__k") + 1).alias("__k"), "start"), ["__row", "__k"], "left")
    start = F.when(F.col("__k") == 0, 0).otherwise(F.col("start"))
    stop = F.when(F.col("last"), (F.octet_length("ids") / 4).cast("int")).otherwise(F.col("stop"))
    cut = cut.select("__row", "__k", start.alias("start"), stop.alias("stop"), "ids")
    part = F.expr("substring(ids, start * 4 + 1, greatest(stop - start, 0) * 4)")
    # A run without a shared boundary in some overlap: its text is encoded in one piece.
    torn = cut.filter("start IS NULL OR stop IS NULL").select("__row").distinct()
    whole = joined_ids(cut.join(torn, "__row", "left_anti").select("__row", "__k", part.alias("ids")))
    return whole.unionByName(encode_pieces(df.join(torn, "__row", "left_semi").select("__row", "text"), path, pattern))


def encode(df: DataFrame, path: str, pattern: str, column: str = "text") -> DataFrame:
    """df without the text column and with ids: the little-endian uint32 ids of the whole text."""
    size = F.length(F.col(column))
    short = df.filter(size.isNull() | (size <= CHUNK))
    long = df.filter(size > CHUNK)
    # Long texts with equal bytes share one encoding, keyed by two hashes and the length.
    key = F.concat_ws("-", F.sha2(F.encode(column, "utf-8"), 256), size)
    texts = long.select(key.alias("__row"), F.col(column).alias("text")).dropDuplicates(["__row"])
    ids = _stitched(texts, path, pattern)
    rest = [c for c in df.columns if c not in (column, "ids")]
    joined = long.withColumn("__row", key).select("__row", *rest).join(ids, "__row").select(*rest, "ids")
    return encode_pieces(short.drop("ids"), path, pattern, column).select(*rest, "ids").unionByName(joined)


def decode(df: DataFrame, path: str, pattern: str) -> DataFrame:
    """df with decoded: the raw bytes of all its ids, concatenated."""
    keep, schema = _schema(df, set(), decoded=T.BinaryType())

    def run(batches):
        c = codec(path, pattern)
        for batch in pieces(batches, "ids"):
            yield with_columns(batch, keep, decoded=_blobs([c.decode(x or b"") for x in batch.column("ids").to_pylist()]))

    return df.mapInArrow(tidy(run, forget), schema)


def op2_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """Digests of the ids of every document and of the bytes decoded from them."""
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return decode(encode(docs, path, pattern), path, pattern).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
