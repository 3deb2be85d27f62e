"""Connected components over edges as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postaudit.session import materialise


def _flat(labels: DataFrame, folder: str | None) -> DataFrame:
    """Follow labels until each node's label is its own label."""
    while True:
        above = labels.select(F.col("node").alias("root"), F.col("root").alias("above"))
        jumped = materialise(labels.join(above, "root").select(
            "node", F.col("above").alias("root"), (F.col("above") != F.col("root")).alias("moved")), folder)
        labels = jumped.select("node", "root")
        if jumped.filter("moved").isEmpty():
            return labels


def components(edges: DataFrame, folder: str | None = None) -> DataFrame:
    """(node, root) of every node of `edges` (a, b; longs): the smallest node that it reaches.

    Each round hooks every tree to the smallest tree next to it and flattens, then goes on with the edges between
    different trees, which are fewer than half as many trees. Labels only fall, so there are no cycles. The
    tables of a round are written, so a lost executor costs one round at most.
    """
    edges = materialise(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                        .distinct(), folder)
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    labels = materialise(nodes.select("node", F.col("node").alias("root")), folder)
    while not edges.isEmpty():
        hooks = edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("lower"))
        labels = _flat(labels.join(hooks, "node", "left").select("node", F.coalesce("lower", "root").alias("root")), folder)
        ends = labels.withColumnsRenamed({"node": "a", "root": "root_a"})
        met = edges.join(ends, "a").join(ends.withColumnsRenamed({"a": "b", "root_a": "root_b"}), "b")
        edges = materialise(met.filter("root_a <> root_b").select(
            F.least("root_a", "root_b").alias("a"), F.greatest("root_a", "root_b").alias("b")).distinct(), folder)
    return labels
