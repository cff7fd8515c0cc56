"""Connected components by contraction, in joins: nothing but counts reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """node, component (its smallest node) of every node in ``links`` (a, b).

    In each round every node hooks onto its smallest neighbour, if that is smaller; links are then taken to the
    nodes hooked onto, twice (a hooked node may hook on itself), until none joins two nodes. A star is done in
    one round and a chain in about its logarithm. Tables of a round are written, and dropped when used.
    """
    links, old = scratch.save(links.where("a != b").select("a", "b").distinct())
    labels = None
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = both.groupBy("a").agg(F.min("b").alias("to")).where("to < a")
        hooks, _ = scratch.save(hooks.select(F.col("a").alias("node"), "to"))
        twice = hooks.select(F.col("node").alias("to"), F.col("to").alias("beyond"))
        jumped, _ = scratch.save(hooks.join(twice, "to", "left").select("node", F.coalesce("beyond", "to").alias("to")))

        def moved(df: DataFrame, col: str, jumped: DataFrame = jumped) -> DataFrame:
            to = jumped.select(F.col("node").alias(col), F.col("to").alias("_to"))
            return df.join(to, col, "left").withColumn(col, F.coalesce("_to", col)).drop("_to")

        if labels is None:
            every = both.select(F.col("a").alias("node")).distinct()
            labels = every.join(jumped, "node", "left").select("node", F.coalesce("to", "node").alias("component"))
        else:
            labels = moved(labels, "component")
        labels, _ = scratch.save(labels)
        links, new = scratch.save(moved(moved(links, "a"), "b").where("a != b").distinct())
        scratch.drop(old)
        old = new
    if labels is None:
        return links.select(F.col("a").alias("node"), F.col("a").alias("component"))
    return labels
