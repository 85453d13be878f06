"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(links: DataFrame) -> DataFrame:
    """``node, label`` for every node of ``links`` (``a, b``); the label is the component's smallest node.

    Each round takes the smallest label of the neighbours, then the label's own label, so that
    long chains shrink fast. Labels are written in each round, which cuts the lineage; nothing
    but a count comes to the driver.
    """
    edges = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    labels = written(edges.select(F.col("a").alias("node")).distinct().select("node", F.col("node").alias("label"), F.lit(True).alias("moved")), "labels")
    while not labels.where("moved").isEmpty():
        heard = edges.join(labels.select(F.col("node").alias("b"), F.col("label").alias("said")), "b").groupBy("a").agg(F.min("said").alias("said"))
        nearest = labels.join(heard, labels.node == heard.a).select("node", F.col("label").alias("was"), F.least("label", "said").alias("label"))
        nearest = written(nearest, "labels-near")
        up = nearest.select(F.col("node").alias("label"), F.col("label").alias("up"))
        labels = written(nearest.join(up, "label").select("node", F.col("up").alias("label"), (F.col("up") != F.col("was")).alias("moved")), "labels")
    return labels.select("node", "label")
