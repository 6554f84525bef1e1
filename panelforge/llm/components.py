"""Connected components of an edge table, by smallest label and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import forget, written


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, label): label is the smallest node reachable, for every node of edges (a, b).

    Each round takes the smallest label among the neighbours (summed up before
    the shuffle, so that a node with very many edges is no hot key) and then
    the label of that label; rounds grow as the logarithm of a path's length.
    Tables go to the shared folder; the driver sees one count a round.
    """
    both = edges.select("a", "b").where("a <> b").dropDuplicates()
    both = written(both.union(both.select("b", "a")), "cc-edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "cc-labels")
    for _ in range(max_rounds):
        near = both.join(labels.hint("merge"), both.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near.hint("merge"), labels.node == near.a).select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        step = written(step, "cc-step")
        up = step.select(F.col("node").alias("up"), F.col("label").alias("top"))
        new = written(step.join(up.hint("merge"), step.label == up.up).select("node", "was", F.least("label", "top").alias("label")), "cc-labels")
        changed = new.where("label <> was").limit(1).count()
        forget(edges.sparkSession, step)
        forget(edges.sparkSession, labels)
        labels = new.select("node", "label")
        if not changed:
            break
    else:
        raise RuntimeError(f"labels still change after {max_rounds} rounds")
    return labels
