"""Clusters (taxon sets of nodes and their complements) and bipartitions, with frequencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.masks import Masks


def cluster_table(nodes: DataFrame, masks: Masks, anchor: int | None = None) -> DataFrame:
    """mask, sz, freq over all nodes but roots, both sides; with an anchor only sides without it, and the anchor itself once."""
    own = nodes.filter("parent is not null").select("mask")
    if anchor is None:
        sides = own.select(F.explode(F.array(F.col("mask"), masks.rest(F.col("mask")))).alias("mask"))
    else:
        sides = own.select(F.when(masks.has(F.col("mask"), anchor), masks.rest(F.col("mask"))).otherwise(F.col("mask")).alias("mask"))
    out = sides.filter((F.col("mask") != masks.full) & (F.col("mask") != masks.empty)).groupBy("mask").agg(F.count("*").alias("freq"))
    if anchor is not None:
        out = out.unionByName(nodes.sparkSession.range(1).select(masks.lit(1 << anchor).alias("mask"), F.lit(1).cast("long").alias("freq")))
    return out.select("mask", masks.count(F.col("mask")).alias("sz"), "freq")


def size_bins(clusters: DataFrame) -> DataFrame:
    return clusters.groupBy("sz").agg(F.count("*").alias("clusters"))


def canonical(mask: Column, masks: Masks) -> Column:
    """The smaller side; of equal ones the lesser mask; a single taxon gives way to its complement."""
    rest = masks.rest(mask)
    a, b = masks.count(mask), masks.count(rest)
    side = F.when(a < b, mask).when(a > b, rest).otherwise(F.least(mask, rest))
    return F.when(F.least(a, b) == 1, F.when(a < b, rest).otherwise(mask)).otherwise(side)


def bipartition_table(nodes: DataFrame, masks: Masks) -> DataFrame:
    """mask, freq: in how many trees each bipartition occurs, from inner nodes below the root with at least two taxa."""
    inner = nodes.filter("parent is not null and n_children > 0").filter(masks.count(F.col("mask")).between(2, masks.n - 1))
    return inner.select("tree", canonical(F.col("mask"), masks).alias("mask")).distinct().groupBy("mask").agg(F.count("*").alias("freq"))


def bipartitions_from_clusters(clusters: DataFrame, masks: Masks) -> DataFrame:
    """mask, freq with both orientations of X put together."""
    inner = clusters.filter(F.col("sz").between(2, masks.n - 1))
    return inner.groupBy(canonical(F.col("mask"), masks).alias("mask")).agg(F.sum("freq").alias("freq"))


def nontrivial(nodes: DataFrame, masks: Masks) -> DataFrame:
    """tree, mask: the bipartitions of each tree with two taxa on either side, as the side without taxon 0."""
    side = F.when(masks.has(F.col("mask"), 0), masks.rest(F.col("mask"))).otherwise(F.col("mask"))
    inner = nodes.filter("parent is not null and n_children > 0").select("tree", side.alias("mask"))
    return inner.filter(masks.count(F.col("mask")).between(2, masks.n - 2)).distinct()


def rf_distances(a: DataFrame, b: DataFrame, masks: Masks, pairs_below: bool = False) -> DataFrame:
    """t1, t2, rf, nrf between the trees of two collections; pairs_below: only pairs with t1 < t2.

    The symmetric difference is what both have less twice what they share; shared bipartitions meet in an equi-join,
    so no pair of trees is compared node by node. nrf = rf / (2 * (n - 3)), 0 up to 3 taxa, 1 at most.
    """
    sa, sb = nontrivial(a, masks), nontrivial(b, masks)
    na = a.select("tree").distinct().join(sa.groupBy("tree").agg(F.count("*").alias("k")), "tree", "left").select(F.col("tree").alias("t1"), F.coalesce("k", F.lit(0)).alias("k1"))
    nb = b.select("tree").distinct().join(sb.groupBy("tree").agg(F.count("*").alias("k")), "tree", "left").select(F.col("tree").alias("t2"), F.coalesce("k", F.lit(0)).alias("k2"))
    keep = F.col("t1") < F.col("t2") if pairs_below else F.lit(True)
    shared = sa.select(F.col("tree").alias("t1"), "mask").join(sb.select(F.col("tree").alias("t2"), "mask"), "mask").filter(keep).groupBy("t1", "t2").agg(F.count("*").alias("s"))
    every = na.crossJoin(nb).filter(keep)  # the result has a row for each pair
    rf = F.col("k1") + F.col("k2") - 2 * F.coalesce("s", F.lit(0))
    most = 2 * (masks.n - 3)
    nrf = F.least(F.lit(1.0), rf / F.lit(float(most))) if most > 0 else F.lit(0.0)
    return every.join(shared, ["t1", "t2"], "left").select("t1", "t2", rf.cast("long").alias("rf"), nrf.alias("nrf"))


def discordance(genes: DataFrame, species: DataFrame, masks: Masks) -> DataFrame:
    """One row: mean normalised distance between gene trees, and from them to the species tree.

    The mean over pairs follows from the sums: trees with a bipartition in f trees share it in f * (f - 1) / 2 pairs.
    """
    s = nontrivial(genes, masks)
    k = s.groupBy("mask").agg(F.count("*").alias("f"))
    t = genes.agg(F.countDistinct("tree").alias("t"))
    shared = k.agg(F.sum("f").alias("all"), F.sum(F.col("f") * (F.col("f") - 1)).alias("pairs2"))
    most = float(max(1, 2 * (masks.n - 3)))
    gg = ((F.col("t") - 1) * F.col("all") - F.col("pairs2")) / (F.col("t") * (F.col("t") - 1) / 2) / most
    own = nontrivial(species, masks).select("mask", F.lit(1).alias("theirs"))  # one tree
    each = s.join(own, "mask", "left").groupBy("tree").agg(F.count("*").alias("k"), F.count("theirs").alias("both"))
    each = genes.select("tree").distinct().join(each, "tree", "left").crossJoin(own.agg(F.count("*").alias("k2")))  # one row
    gs = each.agg(F.avg(F.least(F.lit(1.0), (F.coalesce("k", F.lit(0)) + F.col("k2") - 2 * F.coalesce("both", F.lit(0))) / most)).alias("gt_st"))
    return t.crossJoin(shared).select(gg.alias("gt_gt")).crossJoin(gs)


def degree_histogram(nodes: DataFrame) -> DataFrame:
    """degree, nodes: inner nodes by their number of neighbours (children and parent)."""
    inner = nodes.filter("n_children > 0")
    return inner.groupBy((F.col("n_children") + F.col("parent").isNotNull().cast("int")).alias("degree")).agg(F.count("*").alias("nodes"))


def tips(nodes: DataFrame) -> DataFrame:
    """tree, tips, inner_nodes, multifurcations (nodes of more than two children, roots too)."""
    k = F.col("n_children")
    return nodes.groupBy("tree").agg(F.count_if(k == 0).alias("tips"), F.count_if(k > 0).alias("inner_nodes"), F.count_if(k > 2).alias("multifurcations"))


def dump(clusters: DataFrame, names: DataFrame, masks: Masks) -> DataFrame:
    """line: the sorted names of each cluster in braces. names: taxon, name."""
    each = clusters.select("mask", F.explode(masks.members(F.col("mask"))).alias("taxon"))
    lines = each.join(names.select("taxon", "name"), "taxon").groupBy("mask").agg(F.array_sort(F.collect_list("name")).alias("names"))
    return lines.select(F.concat(F.lit("{"), F.array_join("names", ","), F.lit("}")).alias("line")).orderBy("line")
