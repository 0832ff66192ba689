"""Connected components of an edge table, with DataFrame joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.durable import materialise, shuffled


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``node, component`` (the smallest node of its component) for every node of the edges (a, b).

    Each round hooks the root of every node's tree under the smallest root among the neighbours and then shortens the
    trees, so that the number of rounds grows with the logarithm of the longest path.  Labels are written to the shared
    folder each round.  Empty edges give an empty table; loops and repeated edges are harmless.
    """
    both = materialise(
        edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-edges"
    )
    # The first round is one aggregation: every node under its smallest neighbour or itself.
    labels = materialise(
        both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("component")),
        f"{name}-0",
    )
    step = 0
    while True:
        step += 1
        near = shuffled(both).join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(
            F.min("component").alias("near")
        )
        hooks = (
            shuffled(labels).join(near, "node")
            .groupBy(F.col("component").alias("root"))
            .agg(F.min(F.least("component", "near")).alias("up"))
        )
        own = labels.select(F.col("node").alias("root"), F.col("component").alias("over"))
        # A root's new parent: the smallest root seen from its tree, or what it was hooked under before.
        hooks = materialise(
            shuffled(hooks).join(own, "root", "left").select("root", F.least("up", F.coalesce("over", "up")).alias("up")), f"{name}-hooks-{step}"
        )
        if hooks.where("up < root").isEmpty():
            return labels
        twice = shuffled(hooks).join(hooks.select(F.col("root").alias("up"), F.col("up").alias("top")), "up", "left").select(
            "root", F.least("up", F.coalesce("top", "up")).alias("top")
        )
        labels = materialise(
            shuffled(labels).join(twice, F.col("component") == F.col("root"), "left").select(
                "node", F.coalesce("top", "component").alias("component")
            ),
            f"{name}-{step}",
        )
