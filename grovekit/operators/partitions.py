"""d-partitions: the taxon sets around an inner node, children and the rest of its own tree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.masks import Masks


def around(nodes: DataFrame, masks: Masks, root_too: bool = False) -> DataFrame:
    """tree, node, kids (child sets, sorted), outside (the rest of the tree; empty at the root)."""
    kids = nodes.filter("parent is not null").groupBy("tree", "parent").agg(F.array_sort(F.collect_list("mask")).alias("kids"))
    whole = nodes.filter("parent is null").select("tree", F.col("mask").alias("whole"))
    inner = nodes.filter("n_children > 1" if root_too else "parent is not null and n_children > 1").select("tree", F.col("node").alias("parent"), "mask")
    rows = inner.join(kids, ["tree", "parent"]).join(whole, "tree")
    return rows.select("tree", F.col("parent").alias("node"), "kids", masks.less(F.col("whole"), F.col("mask")).alias("outside"))


def partition_table(nodes: DataFrame, masks: Masks) -> DataFrame:
    """parts, d, freq. Of two children the pair is unordered and the rest stands last; of more, all parts are one multiset."""
    rows = around(nodes, masks)
    all_parts = F.concat("kids", F.array("outside"))
    parts = F.when(F.size("kids") > 2, F.array_sort(all_parts)).otherwise(all_parts)
    return rows.groupBy(parts.alias("parts")).agg(F.count("*").alias("freq")).select("parts", F.size("parts").alias("d"), "freq")


def tripartitions(partitions: DataFrame) -> DataFrame:
    """m1, m2, m3, freq of those with three parts."""
    return partitions.filter("d = 3").select(*[F.element_at("parts", k).alias(f"m{k}") for k in (1, 2, 3)], "freq")
