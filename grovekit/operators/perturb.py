"""Seeded changes of tree collections: taxa removed, edges collapsed, roots set by an outgroup.

Draws are MD5 digests of a seed and what is drawn, so results don't depend on partitions or rows' order.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.masks import Masks
from ..sources import newick
from . import kernels


def _draw(seed: int, *what: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), *what).cast("binary"))


def restricted(nodes: DataFrame, kept: DataFrame, masks: Masks) -> DataFrame:
    """The induced trees on the kept leaves (tree, taxon), as nodes. Trees without any of them vanish; a null taxon is kept nowhere."""
    leaf = newick.leaf_table(nodes).join(kept.select("tree", "taxon", F.lit(1).alias("k")).distinct(), ["tree", "taxon"], "left")
    # kept leaves up to each place; a range keeps those between its ends
    upto = leaf.select("tree", "pos", F.sum(F.coalesce("k", F.lit(0))).over(Window.partitionBy("tree").orderBy("pos")).cast("int").alias("n"))
    ends = nodes.select("tree", "node", "taxon", (F.col("lo") - 1).alias("before"), (F.col("hi") - 1).alias("last"))
    ends = ends.join(upto.select("tree", F.col("pos").alias("before"), F.col("n").alias("lo")), ["tree", "before"], "left")
    ends = ends.join(upto.select("tree", F.col("pos").alias("last"), F.col("n").alias("hi")), ["tree", "last"]).select("tree", "node", F.coalesce("lo", F.lit(0)).alias("lo"), "hi", "taxon")
    innermost = F.row_number().over(Window.partitionBy("tree", "lo", "hi").orderBy(F.col("taxon").isNull(), F.desc("node")))
    left = ends.filter("hi > lo").withColumn("k", innermost).filter("k = 1").drop("k")
    return newick.with_parents(newick.with_masks(left, masks))


def prune_taxa(nodes: DataFrame, masks: Masks, share: float = 0.3, least: int = 4, seed: int = 42) -> DataFrame:
    """Every tree without that share of its taxa (rounded down), but with at least so many."""
    by = Window.partitionBy("tree")
    leaf = newick.leaf_table(nodes).withColumn("rank", F.row_number().over(by.orderBy(_draw(seed, "tree", "taxon"), "taxon"))).withColumn("n", F.count("*").over(by))
    gone = F.greatest(F.lit(0), F.least(F.floor(F.col("n") * share), F.col("n") - least))
    return restricted(nodes, leaf.filter(F.col("rank") > gone), masks)


def collapse_edges(nodes: DataFrame, share: float = 0.3, seed: int = 42) -> DataFrame:
    """Each inner node below the root gives way to its children with that chance."""
    gone = F.col("parent").isNotNull() & (F.col("n_children") > 0) & (F.substring(_draw(seed, "tree", "lo", "hi"), 1, 8) < F.lit(f"{int(share * 2**32):08x}"))
    return newick.with_parents(nodes.filter(~gone))


def rooted(nodes: DataFrame, outgroup: set[int], masks: Masks, seed: int = 1) -> DataFrame:
    """Every tree with its root beside an outgroup: as a clade, else where the others are one, else where the root has all of it on one side, else beside its lowest taxon, else anywhere."""
    from ..plans.inference import map_trees

    def change(root: kernels.Node) -> kernels.Node:
        where = ",".join(str(n.taxon) for n in root.postorder())
        return kernels.by_outgroup(root, outgroup, random.Random(f"{seed}:{where}"))[0] if root.kids else root

    return map_trees(nodes, change, masks)


def cleaned(trees: DataFrame, names: DataFrame, outgroup: set[int], masks: Masks, seed: int = 1) -> DataFrame:
    """tree, newick: without lengths and labels, rooted, and binary."""
    from ..plans.inference import refined

    return newick.to_text(refined(rooted(newick.parse(newick.stripped(trees), names, masks), outgroup, masks, seed), masks), names)
