"""Connected components of an edge table, by minimum label with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivec.session import discard, materialise


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node each node of ``edges`` (a, b) reaches.

    Each round takes the least label among the neighbours, then the label's own label, so chains
    halve. Rounds are written to the shared folder; only a count of changes reaches the driver.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = materialise(both.where("a <> b").distinct(), "edges")
    labels = materialise(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("m"))
        met = labels.join(near, labels["node"] == near["a"], "left").select(
            "node", F.col("component").alias("before"), F.least("component", "m").alias("mid")
        )
        before, met = labels, materialise(met, "labels")
        owner = met.select(F.col("node").alias("mid"), F.col("mid").alias("jump"))
        jumped = met.join(owner, "mid", "left").select("node", "before", F.least("mid", "jump").alias("component"))
        labels = materialise(jumped, "labels")
        discard(before, met)
        if labels.where("component <> before").isEmpty():
            discard(both)
            return labels.select("node", "component")
