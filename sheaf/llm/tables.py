"""Tables written to the shared folder, and connected components over tables of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.session import scratch_path


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: cuts lineage and computes it once."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(links: DataFrame) -> DataFrame:
    """Links (a, b) → (node, label): the smallest node of each node's component.

    Each round takes the least label among a node's neighbours and then that label's own label, so
    long chains take a logarithmic number of rounds.  Labels stay in tables throughout.
    """
    both = links.select("a", "b").union(links.select("b", "a")).distinct()
    both = written(both, "links")
    labels = written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = (
            both.join(labels.withColumnRenamed("node", "b"), "b")
            .groupBy("a").agg(F.min("label").alias("near"))
            .withColumnRenamed("a", "node")
        )
        better = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("mid"))
        hop = labels.select(F.col("node").alias("mid"), F.col("label").alias("hop"))
        step = written(better.join(hop, "mid", "left").select("node", "old", F.least("mid", F.coalesce("hop", "mid")).alias("label")), "labels")
        labels = step.select("node", "label")
        if step.filter(F.col("label") < F.col("old")).isEmpty():
            return labels
