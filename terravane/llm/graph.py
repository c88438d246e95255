"""Connected components of an edge table, by contraction: every step is a join or an aggregation on node ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravane.llm.shared import drop, stored


def _roots(parent: DataFrame) -> DataFrame:
    """Pointer jumping over (node, up) with up <= node, until every node points at a root."""
    while True:
        jumped = stored(
            parent.alias("p")
            .join(parent.select(F.col("node").alias("n2"), F.col("up").alias("up2")).hint("merge"), F.col("p.up") == F.col("n2"), "left")
            .select("node", F.coalesce("up2", "up").alias("up"), (F.coalesce("up2", "up") != F.col("up")).alias("moved")),
            "jump",
        )
        drop(parent)
        if jumped.where("moved").isEmpty():
            return _keep(jumped.drop("moved"), jumped)
        parent = _keep(jumped.drop("moved"), jumped)


def _keep(df: DataFrame, of: DataFrame) -> DataFrame:
    df._terravane_path = of._terravane_path
    return df


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b: long): component is the smallest node that can be reached.

    Rows with a = b, null ends and repeated rows change nothing. Hub nodes are safe: per-node minima are aggregated before
    the shuffle, and in the joins each node has one row on the other side. The number of rounds grows with the logarithm of
    the number of nodes; no edge reaches the driver.
    """
    edges = stored(edges.where("a <> b").select("a", "b"), "edges")
    labels = None
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        parent = both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("up"))
        roots = _roots(stored(parent, "parent"))
        if labels is None:
            labels = roots
        else:
            old = labels
            labels = stored(
                old.join(roots.select(F.col("node").alias("n2"), F.col("up").alias("up2")).hint("merge"), F.col("up") == F.col("n2"), "left").select("node", F.coalesce("up2", "up").alias("up")),
                "labels",
            )
            drop(old)
        left = roots.select(F.col("node").alias("a"), F.col("up").alias("ra")).hint("merge")
        right = roots.select(F.col("node").alias("b"), F.col("up").alias("rb")).hint("merge")
        rest = stored(edges.join(left, "a").join(right, "b").where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(), "edges")
        drop(edges)
        if roots is not labels:
            drop(roots)
        edges = rest
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return _keep(labels.select("node", F.col("up").alias("component")), labels)
