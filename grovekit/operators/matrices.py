"""Pairwise distances and quartet similarities of taxa over a tree collection, in long form (a < b)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .weights import c2


PAIR_BLOCK = 1024


def _ancestor_pairs(nodes: DataFrame) -> DataFrame:
    """tree, n, a, b (a < b), lvl of their least common ancestor, and for either taxon x: lvl_x, size_x, part_x.

    size_x is the size of the ancestor's child that holds x. part_x sums, over the nodes between x and the ancestor, the
    pairs of taxa that such a node has besides its child on the path. Every node is met by the leaves of each of its
    children, so each pair of a tree comes once, at its ancestor. The root of a large tree meets all its leaves with all, so a
    node's leaves are dealt by PAIR_BLOCK neighbouring places, and each block meets all of them: no key has more than PAIR_BLOCK times
    the tree's leaves.
    """
    size = F.col("hi") - F.col("lo")
    up = nodes.select("tree", F.col("node").alias("parent"), size.cast("long").alias("up_size"), F.col("lvl").alias("up_lvl"), F.col("lo").alias("up_lo"), F.col("hi").alias("up_hi"))
    own = nodes.select("tree", "node", "parent", "lo", "hi", "taxon", "lvl").join(up, ["tree", "parent"], "left")
    own = own.withColumn("weight", F.coalesce(c2(F.col("up_size") - size), F.lit(0)))
    # what a node weighs counts for all in its range: running sums over where ranges begin and end
    edges = own.withColumn("e", F.explode(F.array(F.struct(F.col("lo").alias("at"), F.lit(1).alias("kind"), (-F.col("hi")).alias("far")), F.struct(F.col("hi").alias("at"), F.lit(0).alias("kind"), F.col("lo").alias("far")))))
    order = Window.partitionBy("tree").orderBy("e.at", "e.kind", "e.far", "node")
    summed = edges.withColumn("part", F.sum(F.when(F.col("e.kind") == 1, F.col("weight")).otherwise(-F.col("weight"))).over(order)).filter("e.kind = 1").drop("e")
    n = nodes.filter("parent is null").select("tree", F.col("hi").cast("long").alias("n"))
    leaf = summed.filter("taxon is not null").select("tree", F.col("lo").alias("pos"), "taxon", "lvl", F.col("part").alias("leaf_part"))
    child = summed.filter("parent is not null").select("tree", "parent", "node", "up_lvl", "up_lo", "up_hi", size.cast("long").alias("size"), "part", F.explode(F.sequence("lo", F.col("hi") - 1)).alias("pos"))
    placed = child.join(leaf, ["tree", "pos"]).join(n, "tree")
    block = lambda c: F.floor(c / PAIR_BLOCK).cast("int")
    x = placed.select("tree", "parent", block(F.col("pos")).alias("block"), "n", F.col("up_lvl").alias("lvl"), F.col("node").alias("node_a"), F.col("taxon").alias("a"), F.col("lvl").alias("lvl_a"), F.col("size").alias("size_a"), (F.col("leaf_part") - F.col("part")).alias("part_a"))
    y = placed.select("tree", "parent", F.explode(F.sequence(block(F.col("up_lo")), block(F.col("up_hi") - 1))).alias("block"), F.col("node").alias("node_b"), F.col("taxon").alias("b"), F.col("lvl").alias("lvl_b"), F.col("size").alias("size_b"), (F.col("leaf_part") - F.col("part")).alias("part_b"))
    return x.join(y, ["tree", "parent", "block"]).filter("a < b and node_a <> node_b").drop("parent", "block", "node_a", "node_b")


def distances(nodes: DataFrame) -> DataFrame:
    """a, b, total, trees, dist: mean number of edges between two taxa over the trees that have both."""
    edges = (F.col("lvl_a") + F.col("lvl_b") - 2 * F.col("lvl")).cast("long")
    summed = _ancestor_pairs(nodes).groupBy("a", "b").agg(F.sum(edges).alias("total"), F.count("*").alias("trees"))
    return summed.select("a", "b", "total", "trees", (F.col("total") / F.col("trees")).alias("dist"))


def similarities(nodes: DataFrame) -> DataFrame:
    """a, b, num, den, sim for all pairs that occur together in a tree of four taxa or more.

    At each node a pair in two of its sides gains C2 of the taxa outside both, so num counts the quartets in which a
    and b stand on one side; den counts all quartets with a and b. Multifurcations count all their sides. Below the
    common ancestor the two sides of a node are the path's child and what is outside the node, so those terms are
    differences of sums along the way from the root.
    """
    num = F.col("part_a") + F.col("part_b") + c2(F.col("n") - F.col("size_a") - F.col("size_b"))
    both = _ancestor_pairs(nodes).filter("n >= 4").groupBy("a", "b").agg(F.sum(num).alias("num"), F.sum(c2(F.col("n") - 2)).alias("den"))
    return both.select("a", "b", "num", "den", (F.col("num") / F.col("den")).alias("sim"))


def sorted_rows(similar: DataFrame) -> DataFrame:
    """x, y, rank: for each taxon the others by similarity, the most similar first, of equals the higher id first."""
    both = similar.select(F.col("a").alias("x"), F.col("b").alias("y"), "sim").unionByName(similar.select(F.col("b").alias("x"), F.col("a").alias("y"), "sim"))
    return both.select("x", "y", (F.row_number().over(Window.partitionBy("x").orderBy(F.desc("sim"), F.desc("y"))) - 1).alias("rank"))


def nearest_present(ranks: DataFrame, present: DataFrame) -> DataFrame:
    """tree, x, y: for each taxon missing from a tree the nearest that is there. present: tree, taxon."""
    every = ranks.select("x").distinct().agg(F.collect_list("x").alias("every"))  # one row
    there = present.groupBy("tree").agg(F.collect_list("taxon").alias("there"))
    missing = there.crossJoin(F.broadcast(every)).select("tree", F.explode(F.array_except("every", "there")).alias("x"))
    found = missing.join(ranks, "x").join(present.select("tree", F.col("taxon").alias("y")), ["tree", "y"])
    return found.groupBy("tree", "x").agg(F.min_by("y", "rank").alias("y"))


def group_average(groups: DataFrame, similar: DataFrame) -> DataFrame:
    """g, h, sim: mean similarity over the pairs of two groups (g < h); pairs that never meet count 0. groups: g, taxon."""
    x, y = groups.select("g", F.col("taxon").alias("tx")), groups.select(F.col("g").alias("h"), F.col("taxon").alias("ty"))
    met = x.join(y, how="cross").filter("g < h")  # the groups of one node: a handful of taxa squared
    met = met.withColumn("a", F.least("tx", "ty")).withColumn("b", F.greatest("tx", "ty"))
    return met.join(similar.select("a", "b", "sim"), ["a", "b"], "left").groupBy("g", "h").agg(F.avg(F.coalesce("sim", F.lit(0.0))).alias("sim"))
