"""Connected components of links that never leave the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def stars(edges: DataFrame) -> DataFrame:
    """One round of contraction: every node hands its larger, then all its neighbours to the least.

    Nodes stay connected as they were, and links end nearer to the least node.
    """
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    large = (
        both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    ).where("u <> v")
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    linked = large.join(low, "u")
    small = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
        linked.select("u", F.col("m").alias("v"))
    )
    return small.where("u <> v").distinct()


def ordered(edges: DataFrame) -> DataFrame:
    """Links from the larger to the smaller node, without loops."""
    return edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")


def labels(edges: DataFrame) -> DataFrame:
    """node, component: the least node that each hangs on so far, which is surely connected with it."""
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))


def components(edges: DataFrame) -> DataFrame:
    """node, component (the least node it is linked with) of every node that has a link to another.

    ``edges`` has long columns u and v.  Union-find by stars: each round links every node to the least
    it knows of, until each hangs on the least of its component.  Rounds grow with the logarithm of the
    longest chain; each is written to the shared folder, and only a count and a checksum reach the driver.
    """
    current = materialize(stars(ordered(edges)))
    mark = None
    while True:
        seen = current.agg(
            F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31)))
        ).first()
        if seen[0] == 0 or seen == mark:
            return current.select(F.col("u").alias("node"), F.col("v").alias("component"))
        mark, current = seen, materialize(stars(current))
