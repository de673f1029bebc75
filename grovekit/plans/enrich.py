"""What the consensus proposes for its unresolved nodes, as rounds of Spark jobs; the gene trees never leave the tasks.

A task is an unresolved node: the groups of taxa around it. Per round a representative of each group is drawn by a seed, the
representatives are sent out (a few numbers for each group, within the budget of squares), and each gene tree says where it
stands which sets of them it has. Counts are summed by task and round; a small greedy builder for each makes a tree of
the representatives, and every set in it proposes the union of its groups.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.masks import Masks
from ..operators import ancestors, clusters, kernels
from ..operators.laminar import ACCEPTED, Forest, members
from ..sources.durable import durable
from . import consensus

#: The kinds of proposal, by preference: from average similarities, from sampled splits, of sampled taxa by similarity, from nested balls, at random.
KINDS = ("A", "B", "distance", "ball", "random")
ROUNDS, BONUS, MOST = 10, 2, 100
_HELD = 200_000
EMISSION = "task int, round int, kind int, freq long, mask string"


@dataclass(frozen=True)
class Task:
    groups: tuple[int, ...]
    family: int


def tasks_of(families: list[tuple[int, float, int]], n: int) -> list[Task]:
    """The groups around the nodes of more than three neighbours, those of the strictest family that has them, within the budget."""
    by: dict[int, list[int]] = {}
    for i, _, m in families:
        by.setdefault(i, []).append(m)
    pool = {tuple(g): i for i in sorted(by, reverse=True) for g in kernels.arms(by[i], n)} or {tuple(g): 0 for g in kernels.arms([], n)}
    limit = kernels.within_budget([len(g) for g in pool], n)
    return [Task(g, i) for g, i in pool.items() if len(g) <= limit]


def representatives(task: Task, seed: int, k: int) -> np.ndarray:
    """A taxon of each group; depends on the groups, the seed and the round alone."""
    r = random.Random(f"{seed}:{task.groups}:{k}")
    return np.array([r.choice(members(g)) for g in task.groups])


def induced_counts(lines: DataFrame, samples: list[tuple[int, int, np.ndarray]]) -> DataFrame:
    """task, round, side, freq: in how many trees the representatives of a task and round are divided so. side: bits of their places, as text.

    lines: of ancestors.lines(). samples: (task, round, taxa).
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[tuple[int, int, int], int] = {}

        def counted() -> pd.DataFrame:
            return pd.DataFrame([(t, k, str(m), f) for (t, k, m), f in seen.items()], columns=["task", "round", "side", "freq"])

        for p in parts:
            for taxa, levels in zip(p["taxa"], p["levels"], strict=True):
                taxa, levels = np.asarray(taxa), np.asarray(levels)
                for t, k, reps in samples:
                    d = len(reps)
                    for m in {min(m, (1 << d) - 1 & ~m) for m in ancestors.induced_sets(taxa, levels, reps) if 2 <= m.bit_count() <= d - 2}:
                        seen[t, k, m] = seen.get((t, k, m), 0) + 1
                if len(seen) > _HELD:
                    yield counted()
                    seen.clear()
        yield counted()

    return lines.mapInPandas(run, "task int, round int, side string, freq long").groupBy("task", "round", "side").agg(F.sum("freq").alias("freq"))


def leftovers(forest: Forest, rng: random.Random) -> list[list[int]]:
    """Random pairs of children are joined in every node that has more than it may, until none has; the sets that this makes, in order."""
    below: dict[int, list[int]] = {v: [v] for v in range(forest.n)}

    def taxa(v: int) -> list[int]:
        if v not in below:
            below[v] = [x for k in sorted(forest.kids[v]) for x in taxa(k)]
        return below[v]

    out = []
    for v in sorted(forest.kids):
        line = sorted(forest.kids[v])
        while len(line) > (3 if v == forest.n else 2):
            pair = [line.pop(rng.randrange(len(line))) for _ in range(2)]
            made = max(below) + len(forest.up) + 1
            below[made] = taxa(pair[0]) + taxa(pair[1])
            line.append(made)
            out.append(below[made])
    return out


def built(counts: DataFrame, tasks: list[Task], seed: int, similar: np.ndarray | None, balls: bool, random_leftovers: bool) -> DataFrame:
    """Emissions (task, round, kind, freq, mask) of each task and round with splits. A group has the different splits of one sample."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        t, k = int(key[0]), int(key[1])
        task = tasks[t]
        reps, forest = representatives(task, seed, k), Forest(len(task.groups))
        out: list[tuple[int, int, int]] = []
        union = lambda side: sum(task.groups[i] for i in side)
        for f, m in sorted(((int(f), int(m)) for f, m in zip(rows["freq"], rows["side"], strict=True)), key=lambda x: (-x[0], x[1])):
            if forest.insert(members(m)) == ACCEPTED:
                out.append((1, f, union(members(m))))
        if random_leftovers:
            out += [(4, 0, union(s)) for s in leftovers(forest, random.Random(f"{seed}:{task.groups}:{k}:leftovers"))]
        if similar is not None:
            out += [(2, 0, m) for m in kernels.resolve_by_similarity(list(task.groups), similar, reps.tolist())]
            if balls and k < ROUNDS and task.family <= 2 and len(task.groups) <= 31:
                out += [(3, 0, m) for m in kernels.nested_balls(list(task.groups), similar, reps.tolist())]
        return pd.DataFrame([(t, k, kind, f, str(m)) for kind, f, m in out], columns=["task", "round", "kind", "freq", "mask"])

    return counts.groupBy("task", "round").applyInPandas(run, EMISSION)


def sampled(lines: DataFrame, tasks: list[Task], n_trees: int, seed: int, similar: np.ndarray | None = None, balls: bool = False, random_leftovers: bool = False) -> DataFrame:
    """The emissions of all rounds. A round that first proposes a set seen in more than 5 trees and 1 % of them earns its task two more, up to MOST.

    The rounds known so far run in one job, for all tasks; then those they have earned.
    """
    spark = lines.sparkSession
    found = spark.createDataFrame([], EMISSION)
    rounds, most = [(t, k) for t, task in enumerate(tasks) if len(task.groups) > 3 for k in range(ROUNDS)], {}
    while rounds:
        new = built(induced_counts(lines, [(t, k, representatives(tasks[t], seed, k)) for t, k in rounds]), tasks, seed, similar, balls, random_leftovers)
        found = durable(found.unionByName(new))
        first = found.filter("kind = 1").groupBy("task", "mask").agg(F.min(F.struct("round", (-F.col("freq")).alias("f"))).alias("first"))
        good = first.filter((-F.col("first.f") > 5) & (-F.col("first.f") >= 0.01 * n_trees))
        earned = {r["task"]: r["n"] for r in good.groupBy("task").agg(F.countDistinct("first.round").alias("n")).collect()}  # a row for each task
        done = {t: 1 + k for t, k in rounds} | most
        for t, k in rounds:
            done[t] = max(done[t], k + 1)
        most = done
        rounds = [(t, k) for t, n in earned.items() for k in range(most[t], ROUNDS + min(MOST, BONUS * n))]
    return found


def by_averages(spark, tasks: list[Task], similar: np.ndarray, balls: bool) -> DataFrame:
    """Emissions of step A, a task at a time, and of balls around whole groups."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = []
            for t in p["id"]:
                groups = list(tasks[int(t)].groups)
                if len(groups) > 3:
                    rows += [(int(t), -1, 0, 0, str(m)) for m in kernels.resolve_by_similarity(groups, similar)]
                    rows += [(int(t), -1, 3, 0, str(m)) for m in kernels.nested_balls(groups, similar)] if balls else []
            yield pd.DataFrame(rows, columns=["task", "round", "kind", "freq", "mask"])

    return spark.range(len(tasks)).mapInPandas(run, EMISSION)


def runs_of(order: dict[int, int], mask: int) -> int:
    """How many ranges of a tree's leaf order make up a set."""
    places = sorted(order[t] for t in members(mask))
    return sum(1 for a, b in zip([-2, *places], places, strict=False) if b != a + 1)


def preferred(emissions: DataFrame, tasks: list[Task], orders: dict[int, dict[int, int]], masks: Masks, anchor: int) -> DataFrame:
    """mask, kind, family, ranges, freq: each proposed bipartition once, as the side without the anchor.

    Of several proposals one by averages goes first, then the lower threshold, then the one made of fewer ranges of its consensus tree.
    """
    full = (1 << masks.n) - 1

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = []
            for t, kind, f, m in zip(p["task"], p["kind"], p["freq"], p["mask"], strict=True):
                family, m = tasks[int(t)].family, int(m)
                side = full & ~m if m >> anchor & 1 else m
                if side and side != full:
                    rows.append((masks.pack(side), int(kind), family, runs_of(orders[family], m), int(f)))
            yield pd.DataFrame(rows, columns=["mask", "kind", "family", "ranges", "freq"])

    each = emissions.mapInPandas(run, f"mask {masks.type}, kind int, family int, ranges int, freq long")
    return one_of_each(each)


def one_of_each(emissions: DataFrame) -> DataFrame:
    """mask, kind, family, ranges, freq: of each mask the emission that goes first."""
    rank = F.row_number().over(Window.partitionBy("mask").orderBy("kind", "family", "ranges", F.desc("freq")))
    return emissions.withColumn("rank", rank).filter("rank = 1").drop("rank")


def leaf_orders(families: list[tuple[int, float, int]], n: int, thresholds: int) -> dict[int, dict[int, int]]:
    """The places of the taxa in each family's ordered tree."""
    out = {}
    for i in range(thresholds):
        forest = Forest(n)
        for k, _, m in families:
            if k == i:
                forest.insert(members(m))
        out[i] = {taxon: lo for _, lo, _, _, taxon in forest.rows() if taxon is not None}
    return out


def proposals(nodes: DataFrame, similar: np.ndarray, masks: Masks, seed: int = 1, balls: bool = False, random_leftovers: bool = False, anchor: int = 0) -> DataFrame:
    """preferred() emissions for a collection of trees (parsed nodes with masks)."""
    spark, n_trees = nodes.sparkSession, nodes.select("tree").distinct().count()
    families = consensus.families(clusters.bipartition_table(nodes, masks), masks, n_trees)
    tasks = tasks_of(families, masks.n)
    lines = durable(ancestors.lines(nodes))
    found = sampled(lines, tasks, n_trees, seed, similar, balls, random_leftovers).unionByName(by_averages(spark, tasks, similar, balls))
    return preferred(found, tasks, leaf_orders(families, masks.n, len(kernels.THRESHOLDS)), masks, anchor)
