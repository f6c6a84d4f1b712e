"""Connected components of an edge table by hooking to the smallest neighbour, pointer jumping and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratum.llm.common import looked_up
from stratum.runtime import discard, settle


def _jumped(parents: DataFrame, most: int) -> DataFrame:
    """Each node's root in a forest (node, parent) of at most ``most`` rows, in as many joins as the logarithm of its depth."""
    held = None
    while True:
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
        step = looked_up(parents, "parent", up, "parent").select("node", F.coalesce("above", "parent").alias("parent"), F.col("above").isNotNull().alias("moved"))
        step = settle(step, most=most)
        discard(held)
        held, parents = step, step.select("node", "parent")
        if step.where("moved").isEmpty():
            return step


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node in ``edges`` (a, b): component is the smallest node that can be reached.

    Null ends and self loops count for nothing; repeated edges count once; no edges give no rows.
    Work is on contracted edges, so each round holds fewer than the one before. Nothing is collected.
    A node that very many edges or nodes lead to is looked up without gathering them in one task.
    Tables are written in as many files as their rows need; the number of edges is counted, that of a written table from its files' ends.
    """
    labels, n_labels = None, 0
    given = edges.count() if hasattr(edges, "settled_path") else None
    rest = settle(edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b").distinct(), most=given)
    while n_edges := rest.count():
        both = rest.unionByName(rest.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("parent"))
        nodes = settle(least.select("node", F.least("node", "parent").alias("parent")), most=2 * n_edges)
        n_nodes = nodes.count()
        n_labels = n_labels or n_nodes
        roots = _jumped(nodes.where("parent < node"), n_nodes)
        known = roots.select("node", "parent")
        step = nodes.select("node").join(known, "node", "left").select("node", F.coalesce("parent", "node").alias("parent"))
        if labels is not None:
            up = step.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
            step = looked_up(labels, "parent", up, "parent").select("node", F.coalesce("above", "parent").alias("parent"))
        fresh = settle(step, most=n_labels)
        ends = looked_up(looked_up(rest, "a", known.toDF("n", "ra"), "n"), "b", known.toDF("n", "rb"), "n")
        contracted = settle(ends.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")).where("a <> b").distinct(), most=n_edges)
        discard(labels, rest, nodes, roots)
        labels, rest = fresh, contracted
    if labels is None:
        return rest.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels.select("node", F.col("parent").alias("component"))
