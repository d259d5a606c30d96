"""Connected components by least labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from massloom.llm.common import cut_lineage, settled


def components(edges: DataFrame, nodes: int) -> DataFrame:
    """From edges (a, b) among so many nodes: every node that has one, and the least node of its component.

    Each round takes the least label among neighbours and then the label of that label, so the
    rounds grow with the logarithm of the longest path in practice. Aggregation is partial
    before it is shuffled; nothing but a count of changes reaches the driver. A round is one
    checkpoint, whose files follow from the counted edges; those of the edges from the nodes.
    """
    edges = edges.where(F.col("a") != F.col("b"))
    both, seen = settled(edges.select("a", "b").union(edges.select("b", "a")).distinct(), nodes, n=F.count(F.lit(1)))
    rows = seen["n"]
    labels = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("label")), rows)
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, labels["node"] == near["a"]).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        to = step.select(F.col("node").alias("to"), F.col("label").alias("further"))
        jumped = step.join(to, step["label"] == to["to"]).select("node", "old", F.least("label", "further").alias("label"))
        jumped, seen = settled(jumped, rows, moved=F.count_if(F.col("label") != F.col("old")))
        labels = jumped.select("node", "label")
        if not seen["moved"]:
            return labels.withColumnRenamed("label", "component")
