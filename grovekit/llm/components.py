"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Each node's neighbours on one side are tied to the least node of its neighbourhood."""
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if not large:
        both = both.filter("b < a")
    least = both.groupBy("a").agg(F.min("b").alias("least")).withColumn("least", F.least("a", "least"))
    tied = both.join(least, "a")
    if large:
        return tied.filter("b > a").select(F.col("least").alias("a"), "b").filter("a <> b").distinct()
    own = least.select(F.col("least").alias("a"), F.col("a").alias("b"))
    return tied.select(F.col("least").alias("a"), "b").union(own).filter("a <> b").distinct()


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """node, label (the least node of its component) for every node that has a link. Columns a and b, in any order.

    The rounds needed grow with the logarithm of the longest path. The last table of links stays in scratch.
    """
    edges = scratch.keep(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct())
    mark = None
    while True:
        before, edges = edges, scratch.keep(_star(_star(edges, True), False))
        scratch.drop(before)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    return edges.select(F.col("b").alias("node"), F.col("a").alias("label")).union(edges.select(F.col("a").alias("node"), F.col("a").alias("label")).distinct())
