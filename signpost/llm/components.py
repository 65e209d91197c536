"""Connected components of a link table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signpost.session import materialize


def components(links: DataFrame) -> DataFrame:
    """``node``, ``root`` (the smallest node reachable) for every node of ``a``-``b`` links.

    Each turn points the larger neighbours of every node at its smallest neighbour,
    then the smaller ones and the node itself, until nothing changes; the number of
    turns grows with the logarithm of the longest path. Neighbours are never gathered:
    a turn is an aggregate of the minimum and a join with it, so a node with very
    many neighbours is only a skewed join key, which adaptive execution splits.
    Every turn is written to the shared folder, which cuts lineage and survives lost
    executors. Nothing but two numbers per turn reaches the driver.
    """
    edges = materialize(
        links.filter("a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    before = None
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = (
            both.filter("v > u")
            .join(least, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .filter("u <> v")
            .distinct()
        )
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .filter("u <> v")
            .distinct()
        )
        edges = materialize(small)
        row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        now = (row["n"], row["s"])
        if now == before:
            break
        before = now
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
