"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.plans.scratch import cut, drop


def components(edges: DataFrame) -> DataFrame:
    """node, label: the least node of each node's component, for nodes that have an edge (a, b).

    Each round passes the least labels along edges and then to where they point, so a path of n edges takes about
    log n rounds. Every round is written to the shared folder: no lineage grows, and only whether a label moved reaches the driver.
    """
    both = cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = cut(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).select(F.col("a").alias("node"), "label"), "labels")
    while True:
        heard = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("heard"))
        low = labels.join(heard, F.col("node") == F.col("a"), "left").select("node", "label", F.least("label", "heard").alias("low"))
        ahead = labels.select(F.col("node").alias("at"), F.col("label").alias("far"))
        found = F.least("low", "far")
        step = cut(low.join(ahead, F.col("low") == F.col("at"), "left").select("node", found.alias("label"), (found != F.col("label")).alias("moved")), "labels")
        drop(labels)
        moved = step.where("moved").limit(1).count()
        labels = step.drop("moved")
        labels._corpuslab_path = step._corpuslab_path
        if not moved:
            return labels


def label_all(nodes: DataFrame, edges: DataFrame, node: str = "ord") -> DataFrame:
    """nodes with `component`: the least node of each one's component; a node without edges is its own."""
    found = components(edges).withColumnRenamed("node", "__node")
    return nodes.join(found, nodes[node] == F.col("__node"), "left").withColumn("component", F.coalesce("label" if "label" not in nodes.columns else found["label"], nodes[node])).drop("__node", found["label"])
