"""Connected components of an edge list, without leaving Spark."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basalt.llm.common import cut, in_batches

FEW = 500_000  #: edges that one task may join by union-find


def _union(batches):
    parent: dict[str, str] = {}

    def root(x: str) -> str:
        top = x
        while parent.setdefault(top, top) != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    for at in range(0, len(nodes), 50_000):
        some = nodes[at : at + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), pa.array([root(x) for x in some], pa.string())], names=["node", "label"])


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b); label is the component's least node.

    Up to ``FEW`` edges, counted first, are joined in one task.  For more, each round
    a node takes the least label around it and then its label's label, so a
    chain of n nodes takes about log n rounds.  Rounds are checkpointed.
    """
    edges = cut(edges.select("a", "b").distinct())
    if edges.count() <= FEW:
        return cut(in_batches(edges.coalesce(1), _union, "node string, label string", rows=10_000))
    both = cut(edges.select("a", "b").where("a <> b").union(edges.select("b", "a").where("a <> b")).distinct())
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label"))
    labels = cut(labels)
    while True:
        around = (
            both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        )
        near = labels.join(around, "node").select("node", F.least("label", "near").alias("near"), F.col("label").alias("old"))
        hop = labels.select(F.col("node").alias("near"), F.col("label").alias("far"))
        step = near.join(hop, "near", "left").select("node", F.least("near", "far").alias("label"), "old")
        step = cut(step)
        labels = step.select("node", "label")
        if step.where("label <> old").isEmpty():
            return labels
