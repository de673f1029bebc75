"""Guide trees by average linkage on a similarity matrix that stays in Spark.

A round merges all pairs of clusters that are each other's nearest. Average linkage is reducible: merging one such pair brings
nothing nearer to another, so all of them are merges of the sequential method too, and the tree is the same. A round is two
aggregations over the pairs of clusters that are left: the nearest of each, and the sums of similarities between merged
clusters. The pairs shrink with the square of the clusters, so all rounds cost about as much as the first few.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.durable import Rounds

_SCALE = float(1 << 52)


def merge_rounds(similar: DataFrame, taxa: DataFrame) -> DataFrame:
    """round, a, b, sim: the merges; a cluster is named by its least taxon (a < b), sim is the mean similarity between both.

    similar: a, b (a < b), sim of the pairs that have one; others count 0. taxa: taxon. Sums are whole numbers (similarities in
    steps of 2**-52), so they depend on no order. Of equal similarities the pair of lesser names goes first; the best pair of all is always
    mutual, so every round merges at least one.
    """
    spark = similar.sparkSession
    kept = Rounds(spark)
    scaled = F.round(F.col("sim") * _SCALE).cast("decimal(20,0)").cast("decimal(38,0)")
    pairs = kept.keep(similar.select(F.col("a").cast("int").alias("a"), F.col("b").cast("int").alias("b"), scaled.alias("s")))
    size = kept.keep(taxa.select(F.col("taxon").cast("int").alias("v"), F.lit(1).cast("long").alias("n")).distinct())
    done = spark.createDataFrame([], "round int, a int, b int, sim double")
    k = 0
    while True:
        one, two = size.select(F.col("v").alias("a"), F.col("n").alias("na")), size.select(F.col("v").alias("b"), F.col("n").alias("nb"))
        mean = F.col("s").cast("double") / (F.col("na") * F.col("nb")).cast("double") / _SCALE
        now = pairs.join(one, "a").join(two, "b").select("a", "b", mean.alias("sim"))
        key = F.struct((-F.col("sim")).alias("m"), "a", "b")
        nearest = now.select(F.explode(F.array("a", "b")).alias("v"), key.alias("key")).groupBy("v").agg(F.min("key").alias("key"))
        mutual = nearest.groupBy("key").agg(F.count("*").alias("n")).filter("n = 2").select("key.a", "key.b", (-F.col("key.m")).alias("sim"))
        merged = kept.keep(mutual.withColumn("round", F.lit(k)))
        if merged.isEmpty():
            break
        done = kept.keep(done.unionByName(merged))
        to = merged.select(F.col("b").alias("v"), F.col("a").alias("to"))
        for c in ("a", "b"):
            pairs = pairs.join(to.select(F.col("v").alias(c), F.col("to").alias(f"to_{c}")), c, "left").withColumn(c, F.coalesce(f"to_{c}", c)).drop(f"to_{c}")
        pairs = kept.keep(pairs.filter("a != b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("s").cast("decimal(38,0)").alias("s")))
        size = kept.keep(size.join(to, "v", "left").groupBy(F.coalesce("to", "v").alias("v")).agg(F.sum("n").alias("n")))
        k += 1
    # what has no similarity left to anything is joined in the order of names
    left = [r["v"] for r in size.orderBy("v").collect()] if size.count() > 1 else []
    rest = spark.createDataFrame([(k + i, left[0], v, 0.0) for i, v in enumerate(left[1:])], done.schema)
    return done.unionByName(rest)


def numbered(merges: DataFrame, taxa: list[int]) -> list[tuple[int, int]]:
    """The merges in their order, the most similar first: items are 0 .. n-1 by taxon, merges n, n+1, ... One row for each taxon."""
    name = {t: i for i, t in enumerate(sorted(taxa))}
    out = []
    for r in merges.orderBy(F.desc("sim"), "round", "a", "b").collect():
        pair = sorted((name[r["a"]], name[r["b"]]))
        name[r["a"]] = len(taxa) + len(out)
        out.append((pair[0], pair[1]))
    return out
