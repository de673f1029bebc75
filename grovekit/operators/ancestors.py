"""Least common ancestors from what parts neighbouring leaves.

Two neighbouring leaves part at the parent of the node that begins between them. So a tree is a line of leaves with a level
(and a node) in each gap; the ancestor of any two leaves is the gap of least level between them, which is a range minimum.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def gaps(nodes: DataFrame) -> DataFrame:
    """tree, pos, lvl, node: where the leaves before pos and at pos part."""
    begins = nodes.filter("parent IS NOT NULL AND child_ord > 0")
    return begins.select("tree", F.col("lo").cast("int").alias("pos"), (F.col("lvl") - 1).cast("int").alias("lvl"), F.col("parent").alias("node"))


def minima(nodes: DataFrame, most_leaves: int) -> DataFrame:
    """tree, pos, least: for k = 0, 1, ... the least (lvl, node) of the 2**k gaps from pos on.

    Each doubles the one before by a look ahead in the same sorted window, so the table is sorted once per tree and has a row for each leaf.
    """
    by = Window.partitionBy("tree").orderBy("pos")
    rows, width, k = gaps(nodes).select("tree", "pos", F.struct("lvl", "node").alias("m0")), 1, 0
    while 2 * width <= most_leaves:
        rows = rows.withColumn(f"m{k + 1}", F.least(f"m{k}", F.lead(f"m{k}", width).over(by)))
        width, k = 2 * width, k + 1
    return rows.select("tree", "pos", F.array(*[f"m{i}" for i in range(k + 1)]).alias("least"))


def of_pairs(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """pairs (tree, a, b and more), with lvl and node of their least common ancestor; pairs of which a tree lacks a taxon are dropped.

    Two look-ups by (tree, position) a pair, so the work is that of the pairs and the leaves, not of all pairs of a tree.
    A pair of one taxon is its own leaf.
    """
    leaf = nodes.filter("taxon IS NOT NULL").select("tree", "taxon", F.col("lo").cast("int").alias("pos"), F.col("lvl").cast("int").alias("leaf_lvl"), F.col("node").alias("leaf_node"))
    most = nodes.agg(F.max("hi")).first()[0] or 1
    table = minima(nodes, most)
    at = lambda c, p: leaf.select("tree", F.col("taxon").alias(c), F.col("pos").alias(p), *(["leaf_lvl", "leaf_node"] if c == "a" else []))
    placed = pairs.join(at("a", "_pa"), ["tree", "a"]).join(at("b", "_pb"), ["tree", "b"])
    placed = placed.withColumn("_from", F.least("_pa", "_pb") + 1).withColumn("_n", F.abs(F.col("_pa") - F.col("_pb")))
    placed = placed.withColumn("_k", F.length(F.bin(F.col("_n").cast("long"))) - 1).withColumn("_last", F.expr("_from + _n - shiftleft(1, _k)"))
    look = lambda p, name: table.select("tree", F.col("pos").alias(p), F.col("least").alias(name))
    found = placed.join(look("_from", "_l1"), ["tree", "_from"], "left").join(look("_last", "_l2"), ["tree", "_last"], "left")
    best = F.least(F.get("_l1", F.col("_k")), F.get("_l2", F.col("_k")))
    same = F.col("_n") == 0
    return found.select(*pairs.columns, F.when(same, F.col("leaf_lvl")).otherwise(best["lvl"]).alias("lvl"), F.when(same, F.col("leaf_node")).otherwise(best["node"]).alias("node"))


def lines(nodes: DataFrame) -> DataFrame:
    """tree, taxa (by position), levels (of the gaps between them): one row for each tree."""
    leaf = nodes.filter("taxon IS NOT NULL").select("tree", F.col("lo").cast("int").alias("pos"), "taxon")
    rows = leaf.join(gaps(nodes).drop("node"), ["tree", "pos"], "left").withColumn("lvl", F.coalesce("lvl", F.lit(-1)))
    each = rows.groupBy("tree").agg(F.array_sort(F.collect_list(F.struct("pos", "taxon", "lvl"))).alias("e"))
    return each.select("tree", F.col("e")["taxon"].cast("array<int>").alias("taxa"), F.col("e")["lvl"].cast("array<int>").alias("levels"))


def induced_sets(taxa: np.ndarray, levels: np.ndarray, sample: np.ndarray) -> list[int]:
    """The sets of sampled taxa below the tree's inner nodes but the root, as bits of their places in the sample, each once.

    The gaps' least levels between neighbouring sampled leaves are joined into a Cartesian tree by a stack: one step for each
    sampled leaf, whatever lies between. Equal levels are one multifurcation.
    """
    at = np.full(int(max(taxa.max(initial=0), sample.max(initial=0))) + 1, -1)
    at[taxa] = np.arange(len(taxa))
    where = at[sample]
    order = np.argsort(where)
    order = order[where[order] >= 0]
    if len(order) < 2:
        return []
    places = where[order]
    least = np.minimum.reduceat(levels[: places[-1] + 1], places[:-1] + 1)
    bits = [0, *np.cumsum(np.array([1 << int(i) for i in order], dtype=object)).tolist()]  # distinct bits, so sums are unions
    out, stack = [], []  # (level, first sampled leaf) of the nodes that are open
    for i, lvl in enumerate([*least.tolist(), -1]):
        begin = i
        while stack and stack[-1][0] > lvl:
            depth, begin = stack.pop()
            if depth > 0:
                out.append(bits[i + 1] - bits[begin])
        if not stack or stack[-1][0] < lvl:
            stack.append((lvl, begin))
    return out
