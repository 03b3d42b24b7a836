"""Connected components of an edge table by shrinking labels, one written table per round."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditweir.llm.scratch import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for the nodes of (a, b): label is the smallest node that is reachable.

    A round takes the smallest label around each node (combined before the shuffle, so a
    hub leaves a task as one row) and then the label of that label, which halves the way
    to go. It ends with a round that changes nothing; nodes without an edge are absent.
    """
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")))
    while True:
        around = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        nearer = labels.join(around, labels["node"] == around["a"]).select("node", "label", F.least("label", "near").alias("new"))
        jump = labels.select(F.col("node").alias("new"), F.col("label").alias("further"))
        moved = cut(
            nearer.join(jump, "new").select("node", F.least("new", "further").alias("label"), (F.least("new", "further") < F.col("label")).alias("moved"))
        )
        labels = moved.select("node", "label")
        if not moved.where("moved").limit(1).count():
            return labels
