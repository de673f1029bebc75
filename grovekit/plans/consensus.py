"""Greedy consensus of many trees: candidates stay in Spark, the driver holds one tree of n taxa.

Taking bipartitions one by one is sequential, but what cannot fit any more is known to all tasks at once. A round takes the
`batch` most frequent candidates left, inserts them into the tree, and sends the tree to the tasks, which drop
every candidate that it now has or that crosses it. The tree is bounded by the taxa, a round by the batch; once the tree is
resolved nothing is left to fit.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.masks import Masks
from ..operators.kernels import THRESHOLDS
from ..operators.laminar import ACCEPTED, Forest, members
from ..sources.durable import durable
from ..sources.newick import with_parents


def accepted(bipartitions: DataFrame, masks: Masks, batch: int = 4096) -> list[tuple[int, int]]:
    """(mask, freq) of the bipartitions that fit all more frequent ones, in that order; at most n - 3.

    bipartitions: mask (the canonical side), freq. Ties go by the side without taxon 0, the lesser first.
    """
    spark = bipartitions.sparkSession
    side = F.when(masks.has(F.col("mask"), 0), masks.rest(F.col("mask"))).otherwise(F.col("mask"))
    left = durable(bipartitions.withColumn("side", side).filter(masks.count(F.col("mask")).between(2, masks.n - 2)))
    order = [F.desc("freq"), F.reverse("side") if masks.wide else F.col("side")]  # the highest word first
    forest, out = Forest(masks.n), []
    while not forest.resolved and (top := left.orderBy(*order).limit(batch).collect()):
        for r in top:
            m = masks.unpack(r["mask"])
            if forest.insert(members(m)) == ACCEPTED:
                out.append((m, r["freq"]))
        if len(top) < batch:
            break
        sent = spark.sparkContext.broadcast(forest)

        def fits(parts: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            for p in parts:
                yield p[[sent.value.outcome(members(masks.unpack(m)))[0] == ACCEPTED for m in p["mask"]]]

        left = durable(left.mapInPandas(fits, left.schema))
        sent.unpersist()
    return out


def families(bipartitions: DataFrame, masks: Masks, n_trees: int, thresholds: tuple[float, ...] = THRESHOLDS) -> list[tuple[int, float, int]]:
    """(index, threshold, mask of the side without taxon 0) of the families above each threshold."""
    full = (1 << masks.n) - 1
    kept = accepted(bipartitions, masks)
    return [(i, t, full & ~m if m & 1 else m) for i, t in enumerate(thresholds) for m, f in kept if f > t * n_trees or t == 0]


def snapshots(bipartitions: DataFrame, masks: Masks, n_trees: int, thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """The ordered consensus tree of each threshold as nodes: tree (the threshold's index), threshold, node, parent, lvl, lo, hi, n_children, child_ord, taxon.

    The families are nested, so one tree grows from the highest threshold to the lowest and is copied on the way. Inner
    nodes are the smaller sides; children stand in the order of their least taxa.
    """
    spark, forest, rows, kept, at = bipartitions.sparkSession, Forest(masks.n), [], accepted(bipartitions, masks), 0
    for i, t in sorted(enumerate(thresholds), key=lambda x: -x[1]):
        while at < len(kept) and (kept[at][1] > t * n_trees or t == 0):
            forest.insert(members(kept[at][0]))
            at += 1
        rows += [(i, t, node, lo, hi, taxon) for node, lo, hi, _, taxon in forest.rows()]
    return with_parents(spark.createDataFrame(rows, "tree int, threshold double, node long, lo int, hi int, taxon int"))
