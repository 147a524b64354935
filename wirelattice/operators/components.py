"""Connected components of an edge list, by iterated minimum labels with pointer jumping.

No edge or label leaves the executors. Every round writes its labels to the shared checkpoint folder
(``materialise``), so lineage stays short and a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirelattice.sources.staging import discard, materialise


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Rows ``(node, component)`` for each endpoint of ``edges``; component is the smallest reachable node.

    Self-loops give singleton components, repeated edges count once, null endpoints are ignored and an
    empty input gives an empty result. Each round hooks every node and its current root to the smallest label
    among the node's neighbours (an aggregate with map-side combine, so hub nodes are pre-reduced), then
    replaces each label by the label's own label. Labels only fall, so the loop ends; it ends at the first round
    that changes none, when both ends of every edge agree. On a chain distances to the root double each round.
    """
    e = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null")
    both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = materialise(both, "cc-edges")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("component"))
    labels = materialise(labels, "cc-labels")
    while True:
        near = (
            both.join(labels.select(F.col("node").alias("b"), F.col("component").alias("l")), "b")
            .groupBy(F.col("a").alias("node")).agg(F.min("l").alias("near"))
        )
        seen = labels.join(near, "node").select("node", "component", F.least("component", "near").alias("low"))
        # the root's own row learns the smallest label any member has seen
        hook = seen.groupBy(F.col("component").alias("root")).agg(F.min("low").alias("up"))
        hooked = materialise(
            seen.join(hook, seen.node == hook.root, "left")
            .select("node", "component", F.least("low", "up").alias("parent")), "cc-hook",
        )
        above = hooked.select(F.col("node").alias("at"), F.col("parent").alias("next"))
        step = materialise(hooked.join(above, F.col("parent") == F.col("at")).select("node", "component", "next"), "cc-round")
        discard(hooked)
        if step.where("component <> next").isEmpty():
            return step.select("node", F.col("next").alias("component"))
        labels = step.select("node", F.col("next").alias("component"))
