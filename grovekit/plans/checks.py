"""Self-checks of the phases: numbers that are observed while each phase's rows are written, and invariants counted as faults."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.masks import Masks
from ..operators import clusters, partitions, ranges, transitions, weights
from ..sources import newick
from ..sources.durable import durable

PHASES = ("parse", "hash", "clusters", "partitions", "transitions", "weights", "dp")


def _watched(df: DataFrame, total: Column, fault: Column) -> tuple[DataFrame, Callable[[], tuple[int, int, int]]]:
    """The rows, written, and what was seen on the way: their number, the sum of total, and how many are at fault."""
    seen = Observation()
    out = durable(df.observe(seen, F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(total), F.lit(0)).cast("long").alias("total"), F.count_if(fault).alias("faults")))
    return out, lambda: (seen.get["n"], seen.get["total"], seen.get["faults"])


def phases(nodes: DataFrame, masks: Masks, anchor: int | None = 0) -> DataFrame:
    """phase, n, total, faults. nodes: binary gene trees, parsed.

    parse: nodes, their sizes; a node whose mask isn't as large as its range. hash: signatures, their frequencies; one that stands for several
    masks. clusters: their frequencies; an empty or whole set. partitions: frequencies; parts that meet or are empty. transitions: sizes of
    what is divided; sides that meet or aren't all of it. weights: quartets; less than none. dp: the best totals; a total that isn't its
    division's weight and both sides' totals.
    """
    from .inference import best_divisions

    spark, out = nodes.sparkSession, {}
    size = (F.col("hi") - F.col("lo")).cast("long")
    rows, out["parse"] = _watched(nodes, size, masks.count(F.col("mask")) != size)
    leaf = newick.leaf_table(rows)
    named = ranges.signed(rows, leaf).filter("parent IS NOT NULL").groupBy("own").agg(F.count("*").alias("freq"), F.countDistinct("mask").alias("masks"))
    _, out["hash"] = _watched(named, F.col("freq"), F.col("masks") != 1)
    x, out["clusters"] = _watched(clusters.cluster_table(rows, masks, anchor), F.col("freq"), (F.col("mask") == masks.empty) | (F.col("mask") == masks.full))
    merged = F.aggregate("parts", masks.empty, lambda t, m: masks.either(t, m))
    sizes = F.aggregate("parts", F.lit(0).cast("long"), lambda t, m: t + masks.count(m))
    bad = (masks.count(merged) != sizes) | F.exists("parts", lambda m: m == masks.empty)
    parts, out["partitions"] = _watched(partitions.partition_table(rows, masks), F.col("freq"), bad)
    moves = transitions.from_nodes(rows, masks)
    moves = transitions.anchored(moves, masks, anchor) if anchor is not None else moves.unionByName(transitions.from_incomplete(rows, masks)).distinct()
    apart = (masks.both(F.col("lo"), F.col("hi")) != masks.empty) | (masks.either(F.col("lo"), F.col("hi")) != F.col("parent"))
    moves, out["transitions"] = _watched(moves, masks.count(F.col("parent")), apart)
    moves = moves.filter(~apart)  # what is at fault goes no further
    w, out["weights"] = _watched(weights.split_weights(moves, parts, masks), F.col("weight"), F.col("weight") < 0)
    best = durable(best_divisions(moves.join(w, ["lo", "hi"]), masks))
    for side in ("lo", "hi"):
        best = best.join(best.select(F.col("mask").alias(side), F.col("total").alias(f"of_{side}")), side, "left")
    whole = lambda c: F.coalesce(F.col(c).cast("decimal(38,0)"), F.lit(0))
    _, out["dp"] = _watched(best, whole("total"), whole("total") != whole("weight") + whole("of_lo") + whole("of_hi"))
    return spark.createDataFrame([(p, *out[p]()) for p in PHASES], "phase string, n long, total long, faults long")
