"""Recommendations from examples: the vectors nearest to what is wanted, away from what is not.

A request is one paper, or several wanted ones with others that are not wanted;
its direction is the mean of the first less the mean of the second. All vectors
are scored once for all requests, in blocks, by cosine in double precision.

Defined results: scores are rounded to DIGITS decimals before they are ranked,
so that the order of additions does not matter; equal ones go by key. A
request's own examples are never its answer. Vectors that are null, zero, of
another length or hold null or non-finite components are neither examples nor
answers. An example given twice counts once; a key on both sides is wanted no
more than unwanted. A request without one usable wanted example, or whose
direction is zero, has no answer. Of rows with one key the best counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: the most results of a request.
MOST_RESULTS = 500
#: A block of requests: their directions go to every task, its size is checked.
MOST_REQUESTS = 2000
DIGITS = 6


def request(positive: list[str] | None = None, negative: list[str] | None = None, for_paper: str | None = None, limit: int = 100) -> list[tuple[str, int]]:
    """(key, sign) of a request's examples. One paper or several wanted ones, not both; unwanted ones need wanted ones."""
    if not positive and for_paper is None:
        raise ValueError("either wanted papers or one paper")
    if positive and for_paper is not None:
        raise ValueError("wanted papers or one paper, not both")
    if negative and not positive:
        raise ValueError("unwanted papers need wanted ones")
    if not 0 < limit <= MOST_RESULTS:
        raise ValueError(f"a limit from 1 to {MOST_RESULTS}")
    clean = lambda keys: [k.strip() for k in keys or [] if k.strip()]
    wanted = clean(positive) if positive else [for_paper]
    return [(k, 1) for k in wanted] + [(k, -1) for k in clean(negative)]


def usable(vector: Column) -> Column:
    """Whether all components are finite and not all are zero."""
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def directions(vectors: DataFrame, examples: DataFrame) -> DataFrame:
    """request, direction (doubles): the mean of the wanted examples (request, key, sign) less that of the unwanted ones."""
    own = vectors.filter(usable(F.col("e"))).select("key", "e").join(examples.select("request", "key", "sign").distinct(), "key")
    each = own.groupBy("request", "key", "sign").agg(F.min("e").alias("e")).select("request", "sign", F.posexplode("e").alias("i", "x"))
    # Sums per component combine before the shuffle, so an example set of any size is no list of vectors.
    means = each.groupBy("request", "i").agg(F.avg(F.when(F.col("sign") > 0, F.col("x").cast("double"))).alias("p"), F.avg(F.when(F.col("sign") < 0, F.col("x").cast("double"))).alias("n"))
    at = F.struct("i", (F.col("p") - F.coalesce("n", F.lit(0.0))).alias("x"))
    listed = means.groupBy("request").agg(F.array_sort(F.collect_list(at)).alias("c"), F.count("p").alias("known"))  # as long as a vector
    out = listed.filter("known = size(c)").select("request", F.transform("c", lambda s: s["x"]).alias("direction"))
    return out.filter(F.exists("direction", lambda x: x != 0))


def missing(vectors: DataFrame, examples: DataFrame) -> DataFrame:
    """request, key of examples that no usable vector has."""
    return examples.select("request", "key").distinct().join(vectors.filter(usable(F.col("e"))).select("key"), "key", "left_anti")


def recommendations(vectors: DataFrame, examples: DataFrame, limit: int = 100, pool: Column | None = None) -> DataFrame:
    """request, key, score, place: the best `limit` of the vectors (key, e, and what pool asks for) for each request of examples.

    pool says which vectors may be answers; examples may be any.
    """
    if not 0 < limit <= MOST_RESULTS:
        raise ValueError(f"a limit from 1 to {MOST_RESULTS}")
    spark = vectors.sparkSession
    asked = directions(vectors, examples).limit(MOST_REQUESTS + 1).collect()
    if len(asked) > MOST_REQUESTS:
        raise ValueError(f"over {MOST_REQUESTS} requests: ask in several blocks")
    kinds = {f.name: f.dataType for f in examples.schema} | {f.name: f.dataType for f in vectors.schema}
    schema = f"n int, key {kinds['key'].simpleString()}, score double"
    requests = spark.createDataFrame([(i, r["request"]) for i, r in enumerate(asked)], f"n int, request {kinds['request'].simpleString()}")
    blocks: dict[int, list[int]] = {}
    for i, r in enumerate(asked):
        blocks.setdefault(len(r["direction"]), []).append(i)
    unit = {size: np.array([asked[i]["direction"] for i in at]) for size, at in blocks.items()}
    shared = spark.sparkContext.broadcast({size: (np.array(at), unit[size] / np.linalg.norm(unit[size], axis=1, keepdims=True)) for size, at in blocks.items()})
    # An example knows the requests that it belongs to: at most a block of them.
    own = examples.select("request", "key").distinct().join(requests, "request").groupBy("key").agg(F.array_sort(F.collect_set("n")).alias("own"))
    able = vectors.filter(usable(F.col("e")) & F.col("key").isNotNull() & (F.lit(True) if pool is None else F.coalesce(pool, F.lit(False)))).select("key", "e")

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The best `limit` of a task for each request."""
        held: dict[int, list[tuple[float, object]]] = {}
        kind = None
        for batch in batches:
            keys, lists, mine = (batch.column(c) for c in ("key", "e", "own"))
            kind, sizes = keys.type, lists.value_lengths().to_numpy()
            for size, (numbers, directions_) in shared.value.items():
                rows = np.flatnonzero(sizes == size)
                if not rows.size:
                    continue
                part = lists.take(pa.array(rows))
                matrix = part.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, size)
                scores = np.round(matrix @ directions_.T / np.linalg.norm(matrix, axis=1)[:, None], DIGITS) + 0.0
                names = keys.take(pa.array(rows)).to_pylist()
                for i, r in enumerate(mine.take(pa.array(rows)).to_pylist()):
                    scores[i, np.isin(numbers, r or [])] = -np.inf
                for j, n in enumerate(numbers):
                    column = scores[:, j]
                    # All that reach the score of the last place: ties are told apart by key below.
                    edge = -np.partition(-column, limit - 1)[limit - 1] if len(column) > limit else -np.inf
                    near = [(-column[i], names[i]) for i in np.flatnonzero((column >= edge) & (column > -np.inf))]
                    held[int(n)] = sorted(set(held.get(int(n), []) + near))[:limit]
        rows = [(n, key, -score) for n, kept in held.items() for score, key in kept]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), kind, pa.float64()), strict=True)], names=["n", "key", "score"])

    scored = able.join(own, "key", "left").mapInArrow(best, schema)
    once = scored.groupBy("n", "key").agg(F.max("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("n").orderBy(F.desc("score"), "key")).cast("long")
    return once.withColumn("place", place).filter(F.col("place") <= limit).join(requests, "n").select("request", "key", "score", "place")
