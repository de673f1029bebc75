"""The search space: how a cluster may be divided into two others."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.masks import Masks
from ..sources.durable import durable


def _pair(parent: Column, a: Column, b: Column) -> list[Column]:
    return [parent.alias("parent"), F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")]


def from_nodes(nodes: DataFrame, masks: Masks) -> DataFrame:
    """parent, lo, hi of all binary nodes: their own set, and the complement of each child seen from outside."""
    kids = nodes.filter("parent is not null").groupBy("tree", "parent").agg(F.sort_array(F.collect_list(F.struct("child_ord", "mask", "n_children"))).alias("k"))
    two = kids.filter("size(k) = 2").select("tree", F.col("parent").alias("node"), F.col("k")[0].alias("a"), F.col("k")[1].alias("b"))
    two = two.join(nodes.select("tree", "node", "mask", F.col("parent").isNull().alias("is_root")), ["tree", "node"])
    down = two.select(*_pair(F.col("mask"), F.col("a.mask"), F.col("b.mask")))
    over = masks.rest(F.col("mask"))
    sides = two.filter(over != masks.empty).select(over.alias("over"), F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("s"))
    up = sides.filter("s.u.n_children <= 2").select(*_pair(masks.rest(F.col("s.u.mask")), F.col("s.v.mask"), F.col("over")))
    return down.unionByName(up).distinct()


def from_incomplete(nodes: DataFrame, masks: Masks) -> DataFrame:
    """All taxa divided into those of an incomplete tree and the others."""
    roots = nodes.filter("parent is null").filter(F.col("mask") != masks.full)
    return roots.select(*_pair(masks.full, F.col("mask"), masks.rest(F.col("mask")))).distinct()


def across_trees(clusters: DataFrame, masks: Masks, with_all: bool = True) -> DataFrame:
    """Every way to divide a cluster into two others of the table, whichever trees they come from.

    Exactly one side holds the cluster's least taxon, so that side is found by an equi-join on it, and the other by an
    equi-join on the difference; each split comes once. Half of all clusters may share one least taxon, so both sides
    of the join are salted: clusters to divide by blocks of 1,024 of one least taxon, in each of which the possible
    sides stand once.
    """
    x = clusters.select("mask").distinct()
    whole = x.unionByName(x.sparkSession.range(1).select(masks.full.alias("mask"))).distinct() if with_all else x
    a = whole.select(F.col("mask").alias("parent"), masks.least(F.col("mask")).alias("low"))
    b = x.select(F.col("mask").alias("side"), masks.least(F.col("mask")).alias("low"))
    salts = a.groupBy("low").agg(F.ceil(F.count("*") / 1024).cast("int").alias("salts"))  # a row for each taxon
    a = a.join(F.broadcast(salts), "low").withColumn("salt", F.pmod(F.xxhash64("parent"), F.col("salts")).cast("int")).drop("salts")
    b = b.join(F.broadcast(salts), "low").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    met = a.join(b, ["low", "salt"]).filter(masks.subset(F.col("side"), F.col("parent")) & (F.col("side") != F.col("parent")))
    met = met.withColumn("other", masks.less(F.col("parent"), F.col("side")))
    return met.join(x.withColumnRenamed("mask", "other"), "other").select(*_pair(F.col("parent"), F.col("side"), F.col("other")))


def reachable(transitions: DataFrame, masks: Masks, one_task: int = 200_000) -> DataFrame:
    """Only divisions of clusters that repeated division of all taxa leads to.

    Up to one_task divisions that is a walk in one bounded task; beyond, a round of joins for each level of the deepest way.
    """
    transitions = durable(transitions)
    if transitions.count() <= one_task:
        full = masks.pack((1 << masks.n) - 1)

        def walk(rows: pd.DataFrame) -> pd.DataFrame:
            key = (lambda m: tuple(m)) if masks.wide else int
            of: dict = {}
            for i, p in enumerate(rows["parent"]):
                of.setdefault(key(p), []).append(i)
            seen, line, kept = set(), [key(full)], []
            while line:
                m = line.pop()
                if m not in seen:
                    seen.add(m)
                    kept += of.get(m, [])
                    line += [key(rows[c].iat[i]) for i in of.get(m, []) for c in ("lo", "hi")]
            return rows.iloc[sorted(kept)]

        return transitions.groupBy(F.lit(0).alias("one")).applyInPandas(walk, transitions.schema)
    start = transitions.sparkSession.range(1).select(masks.full.alias("parent"))
    seen = new = start
    while True:
        sides = transitions.join(new, "parent").select(F.explode(F.array("lo", "hi")).alias("parent")).distinct()
        new = durable(sides.join(transitions.select("parent"), "parent", "left_semi").join(seen, "parent", "left_anti"))
        if new.isEmpty():
            return transitions.join(seen, "parent", "left_semi")
        seen = durable(seen.unionByName(new))


def anchored(transitions: DataFrame, masks: Masks, anchor: int) -> DataFrame:
    """Only clusters without the anchor, and all taxa divided into the anchor and the others."""
    kept = transitions.filter(~masks.has(F.col("parent"), anchor))
    bit = masks.lit(1 << anchor)
    root = transitions.sparkSession.range(1).select(*_pair(masks.full, bit, masks.rest(bit)))
    return kept.unionByName(root).distinct()
