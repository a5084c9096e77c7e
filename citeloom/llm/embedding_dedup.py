"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors with cosine c lie sqrt(2 - 2 c) apart. They are rotated and
split into blocks of few dimensions; each block gets a share of the squared
distance in proportion to its variance. A pair within the whole budget is
within the share of at least one block, so a range join in each block, united,
finds all pairs. The range join lays a grid of cells, two ranges wide, over
the block's first coordinates: a vector lives in one cell and visits those its
range touches. Candidates are verified by their exact cosine where they meet,
and a pair counts in the first block that admits it only, so link counts add
up without listing pairs; each bucket reports a spanning star.

Equal vectors of a label are one class; classes are grouped by the vectors
themselves, and the number that stands for a class is checked to be its own.
The rotation is fitted on a bounded
sample (SAMPLE); it and the grid decide the cost, never the result. A bucket
with more than PART residents is dealt to several tasks.

Defined results: vectors that are null, zero or hold null or non-finite
components, have a null label or a null vec_id link with nothing and are their
own component; vectors of different lengths do not link; repeated rows are
equal vectors; extra columns pass through, but those with the names of output
columns.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm.arrow import key_groups, tidy
from citeloom.llm.unions import unite
from citeloom.operators.components import connected_components
from citeloom.session import written

THRESHOLD = 0.98
BLOCK_DIM, SAMPLE, PART = 8, 4_096, 4_096
#: Relative slack of the block budgets, for rounding.
SLACK = 1e-9


def rotation(sample: np.ndarray) -> tuple[np.ndarray, list[slice], np.ndarray]:
    """An orthogonal matrix (columns: new axes), the blocks, and each block's share of the variance.

    Principal axes are dealt to the blocks in turn, so that blocks have
    similar variance and their first coordinates have the most.
    """
    dim = sample.shape[1]
    _, _, axes = np.linalg.svd(sample.T @ sample)
    blocks = max(1, dim // BLOCK_DIM)
    dealt = [[i for i in range(dim) if i % blocks == b] for b in range(blocks)]
    turned = axes[[i for own in dealt for i in own]].T
    edges = np.cumsum([0, *map(len, dealt)]).tolist()
    slices = [slice(a, b) for a, b in zip(edges, edges[1:], strict=False)]
    energy = ((sample @ turned) ** 2).mean(axis=0)
    share = np.array([energy[s].sum() for s in slices]) + 1e-6
    return turned, slices, share / share.sum()


def turned(vectors: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """Rotated vectors; einsum keeps one order of additions whatever the number of rows."""
    return np.einsum("nd,de->ne", vectors, matrix)


def unit(values: np.ndarray) -> np.ndarray:
    values = values.astype(np.float64)
    values = values / np.abs(values).max(axis=1, keepdims=True)
    return values / np.sqrt((values * values).sum(axis=1, keepdims=True))


def grid_dims(n: int, blocks: int) -> int:
    """Coordinates of the grid: more of them make more copies of a row and smaller buckets."""
    return min(range(1, 5), key=lambda g: blocks * n * (1 + 2**g) * 3e-6 + blocks * float(n) ** 2 * (2 / 4) ** g * 3e-10)


class Scheme:
    """What a task needs to place and compare vectors of one length."""

    def __init__(self, sample: np.ndarray, n: int, threshold: float):
        self.matrix, self.slices, share = rotation(sample)
        self.budget = (2 - 2 * threshold) * share * (1 + SLACK) + 1e-12
        self.radius = np.sqrt(self.budget)
        self.dims = min(grid_dims(n, len(self.slices)), min(s.stop - s.start for s in self.slices))

    def places(self, vectors: np.ndarray):
        """For every block: home cells, and for every corner of the range another cell or -1; as 64-bit hashes."""
        mix = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)[: self.dims]
        spun = turned(vectors, self.matrix)
        for k, s in enumerate(self.slices):
            x, width = spun[:, s][:, : self.dims], 2 * self.radius[k]
            low, high, home = (np.floor(v / width).astype(np.int64) for v in (x - self.radius[k], x + self.radius[k], x))
            code = lambda cell: ((cell.view(np.uint64) + np.uint64(1 << 20)) * mix).sum(axis=1, dtype=np.uint64) * np.uint64(0xFF51AFD7ED558CCD) + np.uint64(k)  # noqa: B023, E731
            visits = []
            for corner in range(2**self.dims):
                bits = np.array([corner >> i & 1 for i in range(self.dims)], bool)
                cell = np.where(bits, high, low)
                fresh = ((cell != home).any(axis=1)) & ((low != high) | ~bits).all(axis=1)
                visits.append((code(cell).view(np.int64), fresh))
            yield k, code(home).view(np.int64), visits


def _valid() -> "F.Column":
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("embedding") > 0) & finite & F.exists("embedding", lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def bucket_links(cid: np.ndarray, weight: np.ndarray, home: np.ndarray, vectors: np.ndarray, block: int, scheme: Scheme, threshold: float):
    """Link counts of a bucket's members and, for each, the smallest member of its local component."""
    spun = turned(vectors, scheme.matrix)
    residents, visitors = np.flatnonzero(home), np.arange(len(cid))
    links, label = np.zeros(len(cid), np.int64), np.arange(len(cid))
    for a in range(0, len(visitors), 512):
        q = visitors[a : a + 512]
        for b in range(0, len(residents), 2048):
            r = residents[b : b + 2048]
            s = scheme.slices[block]
            x, y = spun[q][:, s], spun[r][:, s]
            rough = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * (x @ y.T)
            i, j = np.nonzero((rough <= scheme.budget[block] + 1e-9) & (cid[q][:, None] > cid[r][None, :]))
            i, j = q[i], r[j]
            if not len(i):
                continue
            apart = (spun[i] - spun[j]) ** 2
            inside = np.stack([apart[:, t].sum(axis=1) <= scheme.budget[k] for k, t in enumerate(scheme.slices[: block + 1])], axis=1)
            first = inside[:, block] & ~inside[:, :block].any(axis=1)
            i, j = i[first], j[first]
            near = (vectors[i] * vectors[j]).sum(axis=1) >= threshold
            i, j = i[near], j[near]
            np.add.at(links, i, weight[j])
            np.add.at(links, j, weight[i])
            label = unite(label, i, j)
    return links, label


def _links(classes: DataFrame, n: int, threshold: float) -> DataFrame:
    """cid, links, root: parts of link counts and star edges of classes (cid, label, embedding, weight) of one vector length."""
    rows = classes.orderBy("cid").limit(SAMPLE).select("embedding").toArrow()
    scheme = Scheme(unit(_matrix(rows["embedding"].combine_chunks())), n, threshold)

    def deal(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = unit(_matrix(batch.column("embedding")))
            salt = (batch.column("label").cast(pa.int64()).to_numpy() * np.int64(0x5851F42D4C957F2D)).astype(np.int64)
            for k, home, visits in scheme.places(vectors):
                for cell, which, lives in [(home, np.ones(len(home), bool), True), *((c, w, False) for c, w in visits)]:
                    own = np.flatnonzero(which)
                    if len(own):
                        part = batch.take(pa.array(own))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(own), k, np.int8)), pa.array(cell[own] ^ salt[own]), pa.array(np.full(len(own), lives)), *(part.column(c) for c in ("cid", "label", "weight", "embedding"))],
                            names=["block", "cell", "home", "cid", "label", "weight", "embedding"],
                        )

    kind = classes.schema["embedding"].dataType.simpleString()
    dealt = classes.select("cid", "label", "weight", "embedding").mapInArrow(tidy(deal), f"block byte, cell long, home boolean, cid long, label long, weight long, embedding {kind}")
    sizes = dealt.filter("home").groupBy("block", "cell").count().filter(F.col("count") > PART)
    large = written(sizes.select("block", "cell", F.ceil(F.col("count") / PART).cast("int").alias("parts")), "cells")
    dealt = dealt.join(large, ["block", "cell"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))  # by broadcast only where its files are small
    dealt = dealt.withColumn("own", F.pmod(F.col("cid"), F.col("parts")).cast("int"))
    # A resident lives in one part of its bucket and, like a visitor, visits the others.
    dealt = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).withColumn("home", F.col("home") & (F.col("own") == F.col("part"))).drop("parts", "own")
    dealt = dealt.repartition("block", "cell", "part").sortWithinPartitions("block", "cell", "part")

    def join(batches):
        out, size = [], 0
        for group in key_groups(batches, ["block", "cell", "part"]):
            home = group.column("home").to_numpy(zero_copy_only=False)
            if group.num_rows < 2 or not home.any():
                continue
            cid, label, weight = (group.column(c).to_numpy() for c in ("cid", "label", "weight"))
            vectors, block = unit(_matrix(group.column("embedding"))), group.column("block")[0].as_py()
            for value in np.unique(label):  # cells of two labels may share a hash
                at = np.flatnonzero(label == value)
                links, root = bucket_links(cid[at], weight[at], home[at], vectors[at], block, scheme, threshold)
                some = np.flatnonzero(links)
                out.append((cid[at][some], links[some], cid[at][root[some]]))
                size += len(some)
            if size > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["cid", "links", "root"])
                out, size = [], 0
        if size:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["cid", "links", "root"])

    return dealt.mapInArrow(tidy(join), "cid long, links long, root long")


def class_number(label, vector, seed: int) -> "F.Column":
    """A number for a label and vector; another one for each seed."""
    return F.xxhash64(F.lit(seed), label, vector)


def numbered(vectors: DataFrame, clean: "F.Column", number=class_number) -> tuple[DataFrame, DataFrame]:
    """vectors with __cid (null for those that link with nothing), and the classes (cid, label, embedding, least, weight).

    Rows are grouped by label and vector. Should two classes have one number,
    all get another, so that __cid always means one class.
    """
    label = F.col("label").cast("long")
    groups = vectors.filter(_valid()).groupBy(label.alias("label"), clean.alias("embedding")).agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("weight"))
    groups = written(groups, "groups")
    for seed in range(10):
        classes = groups.withColumn("cid", number(F.col("label"), F.col("embedding"), seed))
        if classes.groupBy("cid").count().filter("count > 1").isEmpty():
            return vectors.withColumn("__cid", F.when(_valid(), number(label, clean, seed))), classes
    raise RuntimeError("no numbers for the classes without a collision")


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vectors' columns with n_links, component_id and kept. vectors: vec_id, embedding, label."""
    names = ("n_links", "component_id", "kept")
    rest = [c for c in vectors.columns if c not in names]
    # Adding 0 turns -0 into 0, so that equal vectors have equal hashes.
    clean = F.transform("embedding", lambda x: x + F.lit(0).cast("float") if dict(vectors.dtypes)["embedding"] == "array<float>" else x + F.lit(0.0))
    keyed, classes = numbered(vectors.select(*rest), clean)
    found = None
    for dim, n in classes.groupBy(F.size("embedding").alias("dim")).count().orderBy("dim").collect():
        part = _links(classes.filter(F.size("embedding") == dim), n, threshold)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = vectors.sparkSession.createDataFrame([], "cid long, links long, root long")
    found = written(found, "links")
    labels = connected_components(found.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("cid").agg(F.sum("links").alias("links"))
    base = classes.select("cid", "least", "weight").join(counts, "cid", "left").join(labels, F.col("cid") == F.col("node"), "left").withColumn("label", F.coalesce("label", "cid"))
    named = base.groupBy("label").agg(F.min("least").alias("component"))
    by_class = base.join(named, "label").select(F.col("cid").alias("__cid"), (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("__links"), F.col("component").alias("__component"))
    return keyed.join(by_class, "__cid", "left").select(
        *rest,
        F.coalesce("__links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("__component", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("__component", "vec_id"), F.lit(False)).alias("kept"),
    )


def op3_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    """Links and component of every vector."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return near_vectors(vectors.select("vec_id", "embedding", "label")).select("vec_id", "n_links", "component_id", "kept")
