"""Connected components of a link table by alternating stars; links stay distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stageloom.scratch import materialise


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of ``links`` (a, b): the least node it is connected with.

    Each round hangs every node's greater neighbours on its least one, then every node and its lesser
    neighbours on the least of them, until nothing changes. A hub's links are combined before
    the shuffle and joined back, where skewed keys are split.
    """
    links = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = materialise(links, "links")
    before = None
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("least"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()
        links = materialise(large, "large-star")
        least = links.groupBy("a").agg(F.min("b").alias("least"))
        small = links.join(least, "a").where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
        links = materialise(small.unionByName(least.withColumnRenamed("least", "b")).distinct(), "small-star")
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = links.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("component"))
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
