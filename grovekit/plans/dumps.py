"""What can be written besides the result: matrices, clusters, completed trees, guide tree bipartitions, as lines of text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.masks import Masks
from ..operators import clusters, matrices
from ..sources import newick
from . import consensus, guide, inference


def _headed(spark, head: list[str], rows: DataFrame) -> DataFrame:
    """line, in order: the head, then rows (k, line) by k."""
    top = spark.createDataFrame([(k - len(head), x) for k, x in enumerate(head)], "k long, line string")
    return top.unionByName(rows.select(F.col("k").cast("long").alias("k"), "line")).orderBy("k").select("line")


def matrix(nodes: DataFrame, names: list[str], similarity: bool) -> DataFrame:
    """line: header, n, taxa and a row for each taxon. Pairs that never meet: inf, or a similarity of 0. One task holds one row."""
    n, spark = len(names), nodes.sparkSession
    pairs = matrices.similarities(nodes).select("a", "b", F.col("sim").alias("v")) if similarity else matrices.distances(nodes).select("a", "b", F.col("dist").alias("v"))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "v"))
    entries = both.groupBy("a").agg(F.map_from_entries(F.collect_list(F.struct("b", "v"))).alias("m"))
    rows = spark.range(n).select(F.col("id").cast("int").alias("a")).join(entries, "a", "left")
    cell = "'%.8f'" if similarity else "'%.6f'"
    own, absent = ("1D", "format_string('%.8f', 0D)") if similarity else ("0D", "'inf'")
    found = f"if(try_element_at(m, j) is null, {absent}, format_string({cell}, try_element_at(m, j)))"
    text = f"transform(sequence(0, {n - 1}), j -> if(j = a, format_string({cell}, {own}), {found}))"
    line = F.concat(F.lit("sim_row" if similarity else "row"), F.col("a"), F.lit("="), F.array_join(F.expr(text), ","))
    return _headed(spark, ["SIMILARITY_MATRIX" if similarity else "DISTANCE_MATRIX", f"n={n}", "taxa=" + ",".join(names)], rows.select(F.col("a").alias("k"), line.alias("line")))


def guide_bipartitions(nodes: DataFrame, names: list[str], masks: Masks) -> DataFrame:
    """line: header, n, taxa and the sorted names below each inner node of the guide tree but the root, lower nodes first."""
    taxa = nodes.sparkSession.range(masks.n).select(F.col("id").alias("taxon"))
    merges = guide.numbered(guide.merge_rounds(matrices.similarities(nodes), taxa), list(range(masks.n)))
    sets: dict[int, frozenset[int]] = {i: frozenset([i]) for i in range(masks.n)}
    lines = []
    for k, (a, b) in enumerate(merges):
        sets[masks.n + k] = sets[a] | sets[b]
        if len(sets[masks.n + k]) < masks.n:
            lines.append((k, "bipartition=" + ",".join(sorted(names[t] for t in sets[masks.n + k]))))
    spark = nodes.sparkSession
    return _headed(spark, ["UPGMA_BIPARTITIONS", f"n={masks.n}", "taxa=" + ",".join(names)], spark.createDataFrame(lines, "k long, line string"))


def completed_trees(nodes: DataFrame, names: DataFrame, masks: Masks, by_distance: bool = False) -> DataFrame:
    """tree, newick: every tree with all taxa placed."""
    return newick.to_text(inference.completed(nodes, masks, by_distance)[0], names)


def cluster_lines(nodes: DataFrame, names: DataFrame, masks: Masks, anchor: int | None) -> DataFrame:
    return clusters.dump(clusters.cluster_table(nodes, masks, anchor), names, masks)


def consensus_lines(nodes: DataFrame, names: list[str], masks: Masks) -> DataFrame:
    """line: for each threshold its number and the sorted names of every cluster of the greedy consensus."""
    rows = consensus.families(clusters.bipartition_table(nodes, masks), masks, nodes.select("tree").distinct().count())
    lines = sorted((i, ",".join(sorted(names[t] for t in range(masks.n) if m >> t & 1)), c) for i, c, m in rows)
    return nodes.sparkSession.createDataFrame([(f"threshold={c:g} {{{x}}}",) for _, x, c in lines] or [("",)], "line string")
