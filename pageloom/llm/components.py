"""Connected components of links, by labels that go to the least neighbour and then jump."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.operators.storage import materialize


def component_labels(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and label, the least node of its component, of every node with a link.

    Each round takes the least label among the neighbours and then the label of
    that label, so chains shrink to less than half; each round is written to the
    checkpoint folder, so its plan does not grow. No links give no rows.
    """
    pairs = links.select(F.col(a).alias("x"), F.col(b).alias("y")).filter("x <> y")
    both = materialize(pairs.union(pairs.select("y", "x")).distinct())
    labels = materialize(both.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("m")).select("node", F.least("node", "m").alias("label")))
    while True:
        heard = both.join(labels, both["y"] == labels["node"]).groupBy(F.col("x").alias("node")).agg(F.min("label").alias("m"))
        nearer = labels.join(heard, "node").select("node", "label", F.least("label", "m").alias("new"))
        nearer = materialize(nearer)
        jump = nearer.select(F.col("node").alias("new"), F.col("new").alias("far"))
        step = materialize(nearer.join(jump, "new", "left").select("node", "label", F.least("new", F.coalesce("far", "new")).alias("new")))
        if not step.filter("label <> new").limit(1).count():
            return step.select("node", F.col("new").alias("label"))
        labels = step.select("node", F.col("new").alias("label"))
