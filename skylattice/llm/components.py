"""Connected components of a table of links, by minimum labels with shortcuts, on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def components(links: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, label): for each node of ``links`` the smallest node that links reach.

    Each round takes the smallest label among a node and its neighbours, then replaces a label by
    the label that its own node has, which halves the way left. Rounds end with the first that changes
    nothing; a Parquet table in the shared folder cuts the lineage of each. Hubs meet a map-side
    minimum first, so that a node with many links sends few rows. Null nodes link nothing.
    """
    links = links.select(F.col(a).alias("x"), F.col(b).alias("y")).filter("x IS NOT NULL AND y IS NOT NULL AND x <> y")
    both = stage(links.union(links.select("y", "x")).distinct(), "links")
    labels = stage(both.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.col("x")).alias("label")), "labels")
    for _ in range(most_rounds):
        near = both.join(labels, F.col("y") == F.col("node")).groupBy("x").agg(F.min("label").alias("seen"))
        spread = labels.join(near, F.col("node") == F.col("x"), "left").select(
            "node", F.col("label").alias("old"), F.least("label", "seen").alias("label")
        )
        of_label = labels.select(F.col("node").alias("at"), F.col("label").alias("then"))
        labels = stage(
            spread.join(of_label, F.col("label") == F.col("at"), "left").select(
                "node", "old", F.least("label", "then").alias("label")
            ),
            "labels",
        )
        if labels.filter("label <> old").isEmpty():
            return labels.select("node", "label")
        labels = labels.select("node", "label")
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
