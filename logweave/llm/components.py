"""Distributed union-find: connected components by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, stash


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges(a long, b long) that has a neighbour; component is the smallest node.

    Each round hooks every node to its smallest neighbour, flattens the trees so made by pointer jumping, and maps
    the edges to their roots; at least half of the nodes that still have edges go in each
    round. Edges are kept distinct, so that a large star shrinks to nothing in one round. Everything stays in tables; self-loops and
    repeated edges do no harm, and no edges give no rows. A node that very many edges share makes a skewed join, which adaptive
    execution splits.
    """
    lo, hi = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    edges = stash(edges.where(F.col("a") != F.col("b")).select(lo, hi).distinct())
    rounds: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("to")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("to")))
        hooks = stash(both.groupBy("node").agg(F.min("to").alias("low")).select("node", F.least("node", "low").alias("root")))
        while True:
            up = hooks.select(F.col("node").alias("n2"), F.col("root").alias("r2"))
            # A root is a node too, and points to itself once its tree is flat.
            flat = stash(hooks.join(up, hooks["root"] == up["n2"]).select("node", F.col("r2").alias("root"), (F.col("r2") != F.col("root")).alias("moved")))
            discard(hooks)
            hooks = flat
            if flat.where("moved").isEmpty():
                break
        hooks = hooks.select("node", "root")
        rounds.append(hooks)
        ra, rb = hooks.select(F.col("node").alias("a"), F.col("root").alias("ra")), hooks.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        moved = edges.join(ra, "a").join(rb, "b").where(F.col("ra") != F.col("rb"))
        last, edges = edges, stash(moved.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
        discard(last)
    if not rounds:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    labels = rounds[0]
    for later in rounds[1:]:
        up = later.select(F.col("node").alias("n2"), F.col("root").alias("r2"))
        labels = labels.join(up, labels["root"] == up["n2"], "left").select("node", F.coalesce("r2", "root").alias("root"))
    # The root of a contracted tree is its smallest node, so it is the smallest of the component.
    out = stash(labels.select("node", F.col("root").alias("component")))
    discard(*rounds)
    return out


def shared_only(postings: DataFrame) -> DataFrame:
    """The postings(key, node, salt) whose key has another node, once each, with the smallest node of their key and salt as low.

    Those of salted, common keys all stay. One shuffle, by key and salt, serves the window and the removal of repeated rows.
    """
    dealt = Window.partitionBy("key", "salt")
    met = postings.repartition("key", "salt").withColumns({"low": F.min("node").over(dealt), "high": F.max("node").over(dealt)})
    return met.where((F.col("low") != F.col("high")) | (F.col("salt") > 0)).drop("high").distinct()


def group_edges(shared: DataFrame) -> DataFrame:
    """Edges (a, b) that connect the nodes of each key of shared_only()'s rows through its smallest node.

    One edge a posting at most. Keys that are known to be common come with salts of 1 and more: their postings are split by it, and
    only the smallest nodes of the parts meet; all others have salt 0.
    """
    inside = shared.where(F.col("node") != F.col("low")).select(F.col("node").alias("a"), F.col("low").alias("b"))
    heads = shared.where(F.col("salt") > 0).select("key", "low").distinct()
    across = heads.select(F.col("low").alias("a"), F.min("low").over(Window.partitionBy("key")).alias("b"))
    return inside.unionByName(across.where(F.col("a") != F.col("b")))
