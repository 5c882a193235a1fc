"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rangeloom.shared import stored


def _flatten(parent: DataFrame) -> DataFrame:
    """``(node, parent)`` with each parent replaced by its own, until every parent is a root."""
    while True:
        up = parent.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
        jumped = stored(parent.join(up, "parent", "left").select("node", F.coalesce("above", "parent").alias("parent"), (F.coalesce("above", "parent") != F.col("parent")).alias("moved")), "jump")
        parent = jumped.select("node", "parent")
        if jumped.where("moved").isEmpty():
            return parent


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` of every end of ``links`` (``a, b``): the smallest node reachable.

    Each round hooks every node to its smallest neighbour, follows the hooks to their roots, and carries the
    links over to the roots; links inside a root vanish. Tables are written each round; nothing is collected.
    """
    links = stored(links.select("a", "b").where("a <> b").distinct(), "links")
    labels = None
    while not links.isEmpty():
        ends = links.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("other")))
        hooks = ends.groupBy("node").agg(F.min("other").alias("other"))
        parent = _flatten(stored(hooks.select("node", F.least("node", "other").alias("parent")), "hooks"))
        if labels is None:
            labels = parent.withColumnRenamed("parent", "component")
        else:
            up = parent.select(F.col("node").alias("component"), "parent")
            labels = stored(labels.join(up, "component", "left").select("node", F.coalesce("parent", "component").alias("component")), "labels")
        left = parent.select(F.col("node").alias("a"), F.col("parent").alias("root_a"))
        right = parent.select(F.col("node").alias("b"), F.col("parent").alias("root_b"))
        links = stored(links.join(left, "a").join(right, "b").where("root_a <> root_b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b")).distinct(), "links")
    return labels if labels is not None else links.select(F.col("a").alias("node"), F.col("b").alias("component"))
