"""Connected components of an edge table, by contraction with pointer jumping."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import cut
from .skew import hot_keys, salted_join

#: So many edges, once counted, are solved in one task; more are contracted first. The labels are the same.
FEW_EDGES = 200_000


def jump(pointers: DataFrame, heads: DataFrame) -> DataFrame:
    """(node, label) with each label replaced by the label's own in heads; popular labels are spread over salts."""
    hot = hot_keys(pointers.groupBy("label").agg(F.count("*").alias("n")), ["label"], "n")
    on = heads.select(F.col("node").alias("label"), F.col("label").alias("__up"))
    return salted_join(pointers, on, ["label"], hot, F.col("node"), "left").select("node", F.coalesce("__up", "label").alias("label"))


def _least_nodes(edges: pa.Table) -> pa.Table:
    """(node, label) of a few edges, by joining sets under their least node."""
    up: dict = {}

    def top(x):
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in zip(edges.column("a").to_pylist(), edges.column("b").to_pylist()):
        x, y = top(a), top(b)
        if x != y:
            up[max(x, y)] = min(x, y)
    kind = edges.schema.field("a").type
    return pa.table({"node": pa.array(list(up), kind), "label": pa.array([top(x) for x in up], kind)})


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label) for every end of an edge (a, b): the least node of its component. Nodes are not null.

    Each round every node points to the least of itself and its neighbours; pointer jumps lead it to the end of its
    chain; then the edges are drawn between what their ends point to, and loops and repeats go. Edges only get fewer, and
    rounds and jumps grow with the logarithm of the longest chain; once FEW_EDGES are left one task ends it. Every round is
    written to the shared folder.
    """
    edges = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    labels = None
    kind = dict(edges.dtypes)["a"]
    while n := edges.count():
        if n <= FEW_EDGES:
            pointers = cut(edges.withColumn("task", F.lit(0)).groupBy("task").applyInArrow(_least_nodes, f"node {kind}, label {kind}"))
            return pointers if labels is None else cut(jump(labels, pointers))
        ends = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other")))
        near = cut(ends.groupBy("node").agg(F.min("other").alias("__least"), F.count("*").alias("n")))
        pointers = near.select("node", F.least("node", "__least").alias("label"))
        moved = True
        while moved:
            further = cut(jump(pointers.select("node", "label"), pointers.select("node", "label")).join(pointers.withColumnRenamed("label", "before"), "node"))
            moved = not further.where("label != before").isEmpty()
            pointers = further.select("node", "label")
        labels = pointers if labels is None else cut(jump(labels, pointers))
        hubs = hot_keys(near.select("node", "n"), ["node"], "n")
        drawn = edges
        for end, other in (("a", "b"), ("b", "a")):
            at = drawn.withColumnRenamed(end, "node")
            drawn = salted_join(at, pointers, ["node"], hubs, F.col(other)).select(F.col("label").alias(end), other)
        edges = cut(drawn.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    return labels if labels is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
