"""SimHash near-duplicates with pivot distance tables.

Every fingerprint gets its Hamming distances to fixed reference fingerprints
(the pivots): its row of the table. By the triangle inequality a pair within
the radius differs by no more than the radius in any coordinate; all other
pairs are discarded, and survivors are verified bit by bit. In a task the
members of a group are sorted by the first two coordinates and each looks up
the ranges within the radius in both, so pairs outside are never formed; the
other coordinates then thin what is left. Groups too large for a task are
dealt by the cells of the first coordinate, and a cell meets only itself and
its neighbour.

A coordinate of random fingerprints takes few values (its spread is 4, like
the radius), so pivots alone would keep a fixed share of all pairs of the
corpus. Fingerprints are therefore first grouped by equal blocks of bits: with
b blocks and at most r differing bits, b - r blocks agree. The number of blocks
follows the number of distinct fingerprints; any choice finds every link. A
group reports a spanning star for each of its local components, never its
pairs.

Defined results: null and empty texts have fingerprint zero and link with one
another and with other near fingerprints; rows may repeat; a null doc_id never
names a component unless no other row is in it (then component_id is null).
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm.arrow import key_groups, pieces, tidy
from citeloom.llm.unions import unite
from citeloom.operators.components import connected_components
from citeloom.session import written

WORDS, SEED, RADIUS, BITS = 4, 42, 4, 64
PIVOTS = 12
#: Members of a group that one task compares; larger groups are dealt by cells of the first pivot coordinate.
PART = 8_192
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: str, words: int = WORDS) -> int:
    """The SimHash of one text, as an unsigned integer."""
    import xxhash

    own = text.encode().translate(LOWER).split()
    if not own:
        return 0
    joined = b" ".join(own)
    if len(own) <= words:
        return xxhash.xxh64_intdigest(joined, SEED)
    size = np.fromiter(map(len, own), np.int64, len(own)) + 1
    start = np.cumsum(size) - size
    first, last = start[: 1 - words].tolist(), (start + size - 1)[words - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], SEED) for a, b in zip(first, last, strict=True)], np.uint64)
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(h), 1 << 16):
        part = h[i : i + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs without text and with fp: the fingerprint's 64 bits as a long."""
    keep = [c for c in docs.columns if c not in ("text", "fp")]

    def run(batches):
        for batch in pieces(batches, "text"):
            fp = np.array([fingerprint(t or "") for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(fp.view(np.int64))], names=[*keep, "fp"])

    schema = docs.select(*keep).schema.add("fp", "long")
    return docs.select(*keep, "text").mapInArrow(tidy(run), schema)


def block_choice(n: int, radius: int = RADIUS, bits: int = BITS) -> tuple[list[int], list[tuple[int, ...]]]:
    """Masks of the blocks and the sets of blocks to agree on, for n distinct fingerprints."""

    def cost(blocks: int) -> float:
        tables = len(list(combinations(range(blocks), blocks - radius)))
        key = bits * (blocks - radius) / blocks
        return tables * n * 2e-6 + tables * n * n / 2 ** (key + 1) * 8e-9

    blocks = min(range(radius + 1, radius + 8), key=cost)
    edges = np.linspace(0, bits, blocks + 1).round().astype(int).tolist()
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    return masks, list(combinations(range(blocks), blocks - radius))


def pivots_of(n: int = PIVOTS) -> np.ndarray:
    """The reference fingerprints: random, the same in every task."""
    return np.random.default_rng(7).integers(0, 2**64, n, np.uint64)


def pivot_table(fp: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Hamming distances, one row for each pivot."""
    return np.bitwise_count(fp[None, :] ^ pivots[:, None]).astype(np.int8)


def ranges(table: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by the first two coordinates; for each member in order the begins and ends of the runs it may meet.

    One run for each difference 0 to radius of the first coordinate: the later
    members whose second coordinate lies within the radius, too.
    """
    wide = 2 * (BITS + radius + 1)
    key = table[0].astype(np.int64) * wide + table[1]
    order = np.argsort(key, kind="stable")
    key = key[order]
    ahead = key[:, None] + np.arange(radius + 1) * wide
    begin, end = np.searchsorted(key, ahead - radius), np.searchsorted(key, ahead + radius, side="right")
    begin[:, 0] = np.arange(1, len(key) + 1)
    return order, begin, np.maximum(begin, end)


def local_components(fp: np.ndarray, side: np.ndarray | None, pivots: np.ndarray, radius: int = RADIUS, tally: np.ndarray | None = None) -> np.ndarray:
    """For each distinct fingerprint of a group the index of its local component's first member.

    side: parts to compare with one another only, or None for all pairs.
    tally: gets the numbers of pairs, of those in the range of two coordinates,
    of those that survive the whole table, and of links added to it.
    """
    table = pivot_table(fp, pivots)
    order, begin, end = ranges(table, radius)
    fp, table = fp[order], table[:, order]
    side = None if side is None else side[order]
    label = np.arange(len(fp))
    meets = np.cumsum((end - begin).sum(axis=1))
    at, formed, kept, links = 0, 0, 0, 0
    while at < len(fp):
        stop = max(at + 1, int(np.searchsorted(meets, (meets[at - 1] if at else 0) + 4_000_000, side="right")))
        size = (end[at:stop] - begin[at:stop]).ravel()
        i = np.repeat(np.repeat(np.arange(at, stop), radius + 1), size)
        j = np.repeat(begin[at:stop].ravel() - (np.cumsum(size) - size), size) + np.arange(len(i))
        at = stop
        if side is not None:
            apart = side[i] != side[j]
            i, j = i[apart], j[apart]
        formed += len(i)
        for row in table[2:]:
            if not len(i):
                break
            keep = np.abs(row[i] - row[j]) <= radius
            i, j = i[keep], j[keep]
        kept += len(i)
        keep = np.bitwise_count(fp[i] ^ fp[j]) <= radius
        i, j = i[keep], j[keep]
        links += len(i)
        label = unite(label, i, j)
    if tally is not None:
        sides = np.unique(side, return_counts=True)[1] if side is not None else np.zeros(0, np.int64)
        tally += (len(fp) * (len(fp) - 1) // 2 - int((sides * (sides - 1) // 2).sum()), formed, kept, links)
    out = np.empty(len(fp), np.int64)
    out[order] = order[label]
    return out


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def dealt_groups(distinct: DataFrame, n: int, radius: int = RADIUS) -> DataFrame:
    """t, key, pair, side, fp: fingerprints by equal blocks (t, key), large groups also by pairs of parts.

    A part is a cell of the first pivot coordinate, cells above PART dealt by
    a hash. Cells are a radius and one wide, so a part meets only parts of its
    own and of the next cell.
    """
    masks, sets = block_choice(n, radius)
    keys = [F.struct(F.lit(k).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(sum(masks[i] for i in own)))).alias("key")) for k, own in enumerate(sets)]
    cell = F.floor(F.bit_count(F.col("fp").bitwiseXOR(F.lit(signed(int(pivots_of(1)[0]))))) / (radius + 1)).cast("int")
    dealt = distinct.select("fp", cell.alias("cell"), F.explode(F.array(*keys)).alias("k")).select("fp", "cell", "k.t", "k.key")
    sizes = dealt.groupBy("t", "key", "cell").count()
    parts = F.map_from_entries(F.collect_list(F.struct("cell", F.ceil(F.col("count") / PART).cast("int"))))  # of the few cells
    large = written(sizes.groupBy("t", "key").agg(F.sum("count").alias("n"), parts.alias("parts")).filter(F.col("n") > PART), "large").drop("n")
    met = dealt.join(large, ["t", "key"], "left")  # by broadcast only where its files are small
    many = lambda c: F.coalesce(F.try_element_at("parts", c), F.lit(0))
    place = lambda c, q: c * F.lit(1 << 20) + q
    own = F.pmod(F.xxhash64("fp"), F.greatest(many(F.col("cell")), F.lit(1))).cast("int")
    side = F.when(F.col("parts").isNull(), 0).otherwise(place(F.col("cell"), own)).cast("long")
    parts_of = lambda c: F.transform(F.filter(F.sequence(F.lit(0), many(c)), lambda q: q < many(c)), lambda q: place(c, q).cast("long"))
    others = F.concat(*[parts_of(F.col("cell") + d) for d in (-1, 0, 1)])
    pairs = F.when(F.col("parts").isNull(), F.array(F.struct(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))))
    pairs = pairs.otherwise(F.transform(others, lambda q: F.struct(F.least("side", q).alias("a"), F.greatest("side", q).alias("b"))))
    met = met.withColumn("side", side)
    return met.select("t", "key", "side", F.explode(pairs).alias("p"), "fp").select("t", "key", F.shiftleft("p.a", 32).bitwiseOR(F.col("p.b")).alias("pair"), "side", "fp")


def star_edges(distinct: DataFrame, n: int, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) that connect all distinct fingerprints (fp) within the radius of one another."""
    dealt = dealt_groups(distinct, n, radius).repartition("t", "key", "pair").sortWithinPartitions("t", "key", "pair")
    pivots = pivots_of()

    def run(batches):
        a, b, size = [], [], 0
        for group in key_groups(batches, ["t", "key", "pair"]):
            if group.num_rows < 2:
                continue
            fp = group.column("fp").to_numpy().view(np.uint64)
            side = group.column("side").to_numpy()
            root = local_components(fp, side if side.min() != side.max() else None, pivots, radius)
            own = np.flatnonzero(root != np.arange(len(root)))
            if len(own):
                a.append(fp[own].view(np.int64))
                b.append(fp[root[own]].view(np.int64))
                size += len(own)
            if size > 100_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])
                a, b, size = [], [], 0
        if size:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    return dealt.mapInArrow(tidy(run), "a long, b long")


def table_use(distinct: DataFrame, n: int, radius: int = RADIUS) -> DataFrame:
    """One row: pairs that share a group, pairs within two coordinates, pairs that survive the table, links among them."""
    dealt = dealt_groups(distinct, n, radius).repartition("t", "key", "pair").sortWithinPartitions("t", "key", "pair")
    pivots = pivots_of()

    def run(batches):
        tally = np.zeros(4, np.int64)
        for group in key_groups(batches, ["t", "key", "pair"]):
            side = group.column("side").to_numpy()
            local_components(group.column("fp").to_numpy().view(np.uint64), side if side.min() != side.max() else None, pivots, radius, tally)
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in tally], names=["pairs", "in_range", "survivors", "links"])

    names = ["pairs", "in_range", "survivors", "links"]
    return dealt.mapInArrow(tidy(run), ", ".join(f"{c} long" for c in names)).agg(*[F.sum(c).alias(c) for c in names])


def _grouped(docs: DataFrame, radius: int) -> DataFrame:
    """docs' columns without text, with fp, component_id and __simhash_group: one value for each component."""
    hashed = written(fingerprints(docs), "fingerprints")
    distinct = written(hashed.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    labels = connected_components(star_edges(distinct.select("fp"), distinct.count(), radius))
    of = distinct.join(labels, distinct["fp"] == labels["node"], "left").select("fp", F.coalesce("label", "fp").alias("__simhash_group"), "least")
    named = of.groupBy("__simhash_group").agg(F.min("least").alias("component_id"))
    by_fp = of.join(named, "__simhash_group").select("fp", "component_id", "__simhash_group")
    own = [c for c in hashed.columns if c not in ("component_id", "__simhash_group")]
    return hashed.select(own).join(by_fp, "fp").select(*own, "component_id", "__simhash_group")


def near_groups(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """As near_duplicates, with __label: one value for each component, even where two have one component_id."""
    return _grouped(docs, radius).drop("__label").withColumnRenamed("__simhash_group", "__label")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """docs' columns without text, with fp and component_id (the smallest doc_id reachable)."""
    return _grouped(docs, radius).drop("__simhash_group")


def op9_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
