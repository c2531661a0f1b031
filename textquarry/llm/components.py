"""Connected components by contraction: every node hooks to its smallest neighbour, then edges move to the hooks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from textquarry.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``label`` (the smallest node it reaches) of all nodes of the edges ``a``, ``b``.

    Every round at least all nodes that are not a local minimum leave the graph. A node with very many edges is
    combined in the tasks before the shuffle. No edges: no rows.
    """
    left = stored(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels: DataFrame | None = None
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("hook")), "hooks")
        if labels is None:
            labels = hooks.select("node", F.col("hook").alias("label"))
        else:
            h = hooks.select(F.col("node").alias("label"), "hook")
            labels = stored(labels.join(h, "label", "left").select("node", F.coalesce("hook", "label").alias("label")), "labels")
        a = hooks.select(F.col("node").alias("a"), F.col("hook").alias("ha"))
        b = hooks.select(F.col("node").alias("b"), F.col("hook").alias("hb"))
        moved = left.join(a, "a").join(b, "b").where("ha <> hb")
        left = stored(moved.select(F.least("ha", "hb").alias("a"), F.greatest("ha", "hb").alias("b")).distinct(), "edges")
    return labels if labels is not None else edges.select(F.col("a").alias("node"), F.col("a").alias("label")).limit(0)
