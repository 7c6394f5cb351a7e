"""Graphs as edge tables: components and levels of a dependency graph."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.operators.lineage import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of the undirected edges (a, b): each round takes the least label among a node's neighbours and jumps to that label's own."""
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")))
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("root").alias("m"))
        step = labels.join(near, labels["node"] == near["a"]).select("node", F.least("root", "m").alias("root"), F.col("root").alias("was"))
        jump = step.select(F.col("node").alias("k"), F.col("root").alias("far"))
        after = cut(step.join(jump, step["root"] == jump["k"]).select("node", F.least("root", "far").alias("root"), "was"))
        labels = after.select("node", "root")
        if after.where("root <> was").isEmpty():
            return labels


#: Nodes that a task holds to tell which edges join what is joined already.
FOREST_NODES = 500_000


def forest(edges: DataFrame) -> DataFrame:
    """Edges (a, b) that have the components of edges, from each partition fewer than it has nodes (but for self-loops): an edge within what earlier ones of the partition join is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict = {}

        def top(x):
            while (y := up.setdefault(x, x)) != x:
                up[x] = x = up.setdefault(y, y)
            return x

        for batch in batches:
            kept = []
            for a, b in zip(batch["a"].to_pylist(), batch["b"].to_pylist(), strict=True):
                loop = a == b and a not in up
                p, q = top(a), top(b)
                up[q] = p
                kept.append(loop or p != q)
            yield batch.filter(pa.array(kept, pa.bool_()))
            if len(up) > FOREST_NODES:
                up = {}

    return edges.select("a", "b").mapInArrow(run, edges.select("a", "b").schema)


def levels(tasks: DataFrame, edges: DataFrame) -> DataFrame:
    """(task, level) of the dependency edges (task, needs): 0 needs nothing, each other task one more than its deepest need. A cycle is an error."""
    n = tasks.count()
    level = cut(tasks.select("task", F.lit(0).alias("level")))
    for _ in range(n + 1):
        deepest = edges.join(level.withColumnRenamed("task", "needs"), "needs").groupBy("task").agg((F.max("level") + 1).alias("least"))
        after = cut(level.join(deepest, "task", "left").select("task", F.greatest("level", F.coalesce("least", F.lit(0))).alias("level"), F.col("level").alias("was")))
        level = after.select("task", "level")
        if after.where("level <> was").isEmpty():
            return level
    raise ValueError("the tasks depend on one another in a circle")


def reachable(edges: DataFrame) -> DataFrame:
    """(task, needs) with the needs of needs; paths double each round."""
    paths = cut(edges.select("task", "needs").distinct())
    while True:
        longer = paths.join(paths.select(F.col("task").alias("needs"), F.col("needs").alias("far")), "needs").select("task", F.col("far").alias("needs"))
        after = cut(paths.union(longer).distinct())
        if after.count() == paths.count():
            return after
        paths = after
