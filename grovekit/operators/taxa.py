"""Which taxa occur where: union, intersection, coverage of a list, and the common universe of a run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.newick import leaf_names


def union(trees: DataFrame) -> DataFrame:
    """All leaf names, sorted."""
    return leaf_names(trees).select("name").distinct().orderBy("name")


def intersection(trees: DataFrame) -> DataFrame:
    """Names that stand in every tree, sorted."""
    k = trees.count()
    return leaf_names(trees).groupBy("name").agg(F.countDistinct("tree").alias("k")).filter(F.col("k") == k).select("name").orderBy("name")


def read_list(lines: DataFrame) -> tuple[DataFrame, int]:
    """The distinct names of a list (column value), and how many lines repeat one."""
    names = lines.select(F.trim("value").alias("name")).filter(F.length("name") > 0)
    row = names.agg(F.count("*").alias("n"), F.countDistinct("name").alias("k")).first()
    return names.distinct(), row["n"] - row["k"]


def coverage(leaf: DataFrame, listed: DataFrame, key: str = "name") -> DataFrame:
    """tree, present, missing, ignored: listed and other taxa of each tree. leaf: tree, key. listed: key, a list that fits memory."""
    marked = leaf.join(F.broadcast(listed.select(key).distinct().withColumn("on", F.lit(1))), key, "left")
    each = marked.groupBy("tree").agg(F.countDistinct(F.when(F.col("on") == 1, F.col(key))).alias("present"), F.count(F.when(F.col("on").isNull(), 1)).alias("ignored"))
    n = listed.agg(F.countDistinct(key).alias("n_listed"))
    return each.crossJoin(n).select("tree", "present", (F.col("n_listed") - F.col("present")).alias("missing"), "ignored")


def coverage_report(leaf: DataFrame, listed: DataFrame, key: str = "name") -> DataFrame:
    """One row: trees, mean, least and most listed taxa missing in a tree, ignored leaf occurrences."""
    return coverage(leaf, listed, key).agg(
        F.count("*").alias("trees"), F.avg("missing").alias("mean_missing"), F.min("missing").alias("min_missing"), F.max("missing").alias("max_missing"), F.sum("ignored").alias("ignored")
    )


def universe(listed: DataFrame, *others: DataFrame) -> DataFrame:
    """The listed names that all others have; fewer than four are an error."""
    out = listed.select("name").distinct()
    for o in others:
        out = out.intersect(o.select("name"))
    if len(out.limit(4).collect()) < 4:
        raise ValueError("fewer than four taxa are common to the list and the input")
    return out
