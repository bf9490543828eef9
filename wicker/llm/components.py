"""Connected components of an edge table, in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wicker.session import stage_table


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b); the component is its least node.

    Each round gives a node the least label among its own and its neighbours', then
    the label that this node had, so long chains halve. Rounds are written to the
    shared folder and end when no label changes. Nodes without edges are not
    listed; loops and repeated edges do no harm.
    """
    ends = [("a", "b"), ("b", "a"), ("a", "a"), ("b", "b")]  # a node is its own neighbour
    both = edges.select(F.explode(F.array(*[F.struct(F.col(x).alias("a"), F.col(y).alias("b")) for x, y in ends])).alias("e")).select("e.*")
    both = stage_table(both.distinct(), "edges")
    labels = stage_table(both.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a")
        low = near.agg(F.min("component").alias("low"), F.max(F.when(F.col("a") == F.col("b"), F.col("component"))).alias("old"))
        jump = labels.select(F.col("node").alias("via"), F.col("component").alias("next"))
        label = F.least("low", "next")
        new = low.join(jump, low["low"] == jump["via"]).select(F.col("a").alias("node"), label.alias("component"), (label != F.col("old")).alias("changed"))
        new = stage_table(new, "labels")
        labels = new.select("node", "component")
        if not new.where("changed").limit(1).count():
            return labels
