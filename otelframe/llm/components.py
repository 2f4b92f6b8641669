"""Connected components of an edge table, by hooking to the least neighbour and
pointer jumping; every round is written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from otelframe.llm.common import materialize


def connected_components(edges: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """node, label (the least node of the component) for all nodes of edges (a, b), and
    of ``known``, labels of an earlier call that the edges join further.

    Rounds alternate: each edge moves its larger end's root to the smaller root (a
    root keeps the least offer), then every node follows its root's root until nothing
    changes. The number of rounds grows with the logarithm of a path's length.
    """
    edges = edges.select("a", "b").where("a <> b")
    labels = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("label", F.col("node"))
    if known is not None:
        labels = known.unionByName(labels.join(known.select("node"), "node", "left_anti"))
    labels = materialize(labels)
    open_edges = edges
    while True:
        named = open_edges.join(labels.select(F.col("node").alias("a"), F.col("label").alias("x")), "a").join(labels.select(F.col("node").alias("b"), F.col("label").alias("y")), "b")
        open_edges = materialize(named.where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
        if open_edges.isEmpty():
            return labels
        offers = open_edges.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("to")).groupBy("node").agg(F.min("to").alias("to"))
        # roots point at smaller roots; jump until each offer ends at a root that got none
        while True:
            jumped = offers
            for _ in range(2):
                above = jumped.select(F.col("node").alias("to"), F.col("to").alias("further"))
                jumped = jumped.select("node", "to").join(above, "to", "left").select("node", F.coalesce("further", "to").alias("to"), F.col("further").isNotNull().alias("moved"))
            jumped = materialize(jumped)
            offers = jumped.select("node", "to")
            if jumped.where("moved").isEmpty():
                break
        new = offers.select(F.col("node").alias("label"), "to", F.xxhash64("node").alias("deal"))
        labels = materialize(labels.withColumn("deal", F.xxhash64("label")).join(new, ["deal", "label"], "left").select("node", F.coalesce("to", "label").alias("label")))
