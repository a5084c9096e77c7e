"""Connected components by label propagation with shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.session import written


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, label) for every node of edges (a, b); label is the smallest node that can be reached.

    Each round takes the smallest label among the neighbours (an aggregate
    that combines before the shuffle, so hubs do no harm) and then the label
    of that label, which halves the remaining distance. Loops, repeated and
    reversed edges are fine; an edge with a null end is ignored.
    """
    edges = edges.select("a", "b").filter("a IS NOT NULL AND b IS NOT NULL AND a != b")
    both = written(edges.unionByName(edges.selectExpr("b AS a", "a AS b")).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), "labels")
    for _ in range(rounds):
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        best = labels.join(near, F.col("node") == F.col("a")).select("node", F.least("label", "near").alias("label"), F.col("label").alias("was"))
        of = labels.select(F.col("node").alias("via"), F.col("label").alias("further"))
        step = best.join(of, F.col("label") == F.col("via"), "left").select("node", F.least("label", "further").alias("label"), "was")
        step = written(step, "labels")
        labels = step.select("node", "label")
        if step.filter("label != was").isEmpty():
            return labels
    raise RuntimeError(f"components did not settle in {rounds} rounds")
