"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flightops.llm.common import staged


def _targets(hooks: DataFrame) -> DataFrame:
    """Follow each node's hook to the end of its chain; lengths halve with every step."""
    while True:
        next_one = hooks.select(F.col("node").alias("target"), F.col("target").alias("further"))
        joined = hooks.join(next_one, "target", "left")
        hooks = staged(joined.select("node", F.coalesce("further", "target").alias("target"), F.col("further").isNotNull().alias("moved")), "jump")
        if not hooks.filter("moved").limit(1).count():
            return hooks.select("node", "target")
        hooks = hooks.select("node", "target")


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of an edge (a, b): the smallest node it can reach.

    Each round hooks every component to its smallest neighbour, follows the hooks, and keeps the
    edges between different components, so the number of rounds is logarithmic. Self loops, repeated
    edges and edges with a null end are left out; no edges give no rows.
    """
    edges = staged(edges.select("a", "b").filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = None
    while edges.limit(1).count():
        both = edges.union(edges.select("b", "a")).toDF("node", "other")
        smallest = both.groupBy("node").agg(F.min("other").alias("target"))
        hooks = _targets(staged(smallest.filter("target < node"), "hooks"))
        if labels is None:
            nodes = both.select("node").distinct()
            labels = nodes.join(hooks, "node", "left").select("node", F.coalesce("target", "node").alias("label"))
        else:
            by_label = hooks.toDF("label", "target")
            labels = labels.join(by_label, "label", "left").select("node", F.coalesce("target", "label").alias("label"))
        labels = staged(labels, "labels")
        for end in ("a", "b"):
            edges = edges.join(hooks.toDF(end, "target"), end, "left").withColumn(end, F.coalesce("target", end)).drop("target")
        edges = edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        edges = staged(edges.distinct(), "edges")
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labels
