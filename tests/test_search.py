"""The dynamic program, reachability, completion and rooting against plain versions; bounded tasks and what stands beyond the bound."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_ranges import random_tree

from grovekit.functions.masks import Masks
from grovekit.operators import kernels, partitions, transitions, weights
from grovekit.plans import checks, inference
from grovekit.sources import newick


@pytest.fixture(scope="module", params=[7, 65])
def space(request, spark):
    """Weighed divisions of a few trees; with 65 taxa masks are arrays."""
    n, r = request.param, random.Random(2)
    masks = Masks(n)
    names = spark.range(n).select(F.col("id").cast("int").alias("taxon"), F.col("id").cast("string").alias("name"))
    some = sorted(r.sample(range(n), 7))
    nodes = inference.refined(newick.parse(newick.from_lines(spark, [random_tree(r, some if n > 7 else range(n)) for _ in range(6)]), names, masks), masks).cache()
    moves = transitions.from_nodes(nodes, masks).unionByName(transitions.from_incomplete(nodes, masks)).distinct().cache()
    parts = partitions.partition_table(nodes, masks).cache()
    return masks, nodes, moves, moves.join(weights.split_weights(moves, parts, masks), ["lo", "hi"]).cache()


def test_divisions_by_size(space):
    masks, _, _, weighed = space
    rows = [(masks.unpack(r["parent"]), masks.unpack(r["lo"]), masks.unpack(r["hi"]), r["weight"]) for r in weighed.collect()]
    want = {tuple(map(str, x)) for x in kernels.best_divisions(rows, (1 << masks.n) - 1)}
    assert len(want) > 5
    for bound in (10**6, 3):
        assert {tuple(r) for r in inference.best_divisions(weighed, masks, bound).collect()} == want


def test_reachable_both_ways(space):
    masks, _, moves, _ = space
    name = lambda r: tuple(masks.unpack(r[c]) for c in ("parent", "lo", "hi"))
    of: dict = {}
    for r in moves.collect():
        of.setdefault(masks.unpack(r["parent"]), set()).add(name(r))
    seen, line = set(), [(1 << masks.n) - 1]
    while line:
        m = line.pop()
        if m not in seen:
            seen.add(m)
            line += [x for t in of.get(m, ()) for x in t[1:]]
    want = {t for m in seen for t in of.get(m, ())}
    for bound in (10**6, 3):
        assert {name(r) for r in transitions.reachable(moves, masks, bound).collect()} == want


def test_a_failing_score_leaves_the_tree(spark, monkeypatch):
    trees = newick.from_lines(spark, ["((A,B,C),(D,E));", "((A,C,B),(E,D));"])
    out = inference.infer(trees)

    def fail(*a, **b):
        raise ArithmeticError("no score")

    monkeypatch.setattr(weights, "fixed_tree_score", fail)
    assert out.newick.count("(") == 4  # known before the score
    with pytest.raises(ArithmeticError):
        assert out.score


def test_pruning_keeps_the_result(spark):
    r = random.Random(1)
    trees = newick.from_lines(spark, [random_tree(r, "ABCDEFG") for _ in range(5)])
    a, b = (inference.infer(trees, inference.Options(full_search=True, prune=p)) for p in (True, False))
    assert a.score == b.score and a.newick == b.newick


def test_phases_find_faults(space):
    masks, nodes, _, _ = space
    rows = {r["phase"]: r for r in checks.phases(nodes, masks, None).collect()}
    assert set(rows) == set(checks.PHASES) and all(r["faults"] == 0 and r["n"] > 0 for r in rows.values())
    bad = nodes.withColumn("mask", F.when((F.col("parent").isNotNull()) & (F.col("n_children") > 0), masks.lit(1)).otherwise(F.col("mask")))
    rows = {r["phase"]: r["faults"] for r in checks.phases(bad, masks, None).collect()}
    assert rows["parse"] > 0 and rows["partitions"] > 0 and rows["transitions"] > 0


def grown(tree, s, near, n):
    """Completion on nested tuples, written from the rule: root at the anchor, go down while a child wins, join there."""
    def leaves(t):
        return [t] if isinstance(t, int) else [x for k in t for x in leaves(k)]

    def edges(t):  # every branch of a binary tree as (below, rest seen from it)
        out = []

        def walk(node, rest):
            out.append((node, rest))
            if not isinstance(node, int):
                a, b = node
                walk(a, b if rest is None else (b, rest))
                walk(b, a if rest is None else (a, rest))

        walk(t, None)
        return out

    for x in range(n):
        if x in leaves(tree):
            continue
        anchor = next(int(y) for y in near[x] if int(y) in leaves(tree))
        rest = next(r for node, r in edges(tree) if node == anchor)

        def put(t, anchor=anchor, x=x):
            if isinstance(t, int):
                return (t, x)
            b, c = leaves(t[0])[0], leaves(t[1])[0]
            pa, pb, pc = s[x, anchor] + s[b, c], s[x, b] + s[anchor, c], s[x, c] + s[anchor, b]
            margin = (pa - pb, pb - pa, pc - pb)
            win = margin.index(max(margin))
            return (x, t) if win == 0 else (put(t[0]), t[1]) if win == 1 else (t[0], put(t[1]))

        tree = (anchor, put(rest))
    return tree


def splits(root, n):
    """The bipartitions of a tree, as sides without taxon 0."""
    return {(1 << n) - 1 & ~m if m & 1 else m for m in kernels.clades(root)}


def as_node(t):
    return kernels.Node(t) if isinstance(t, int) else kernels.Node(kids=[as_node(k) for k in t])


def test_completion_by_the_rule():
    """One missing taxon: the order of children matters only where the representatives of a side tie, and here none do."""
    for seed in range(200):
        r, g = random.Random(seed), np.random.default_rng(seed)
        n = r.randint(4, 9)
        d = g.random((n, 3))  # points in space: similarities like those of trees
        s = 1 / (1 + np.linalg.norm(d[:, None] - d[None], axis=2))
        near = inference.nearest_rows(s)
        gone = r.randrange(n)
        root = kernels.resolve(as_node([t for t in range(n) if t != gone]), r)
        balanced = kernels.balance(root)

        def tuples(v):
            return v.taxon if v.taxon is not None else tuple(tuples(k) for k in v.kids)

        anchor = next(int(y) for y in near[gone] if int(y) != gone)
        turned = tuples(kernels.reroot(next(x for x in balanced.leaves() if x.taxon == anchor), balanced))
        want = grown(turned, s, near, n)
        assert splits(as_node(want), n) == splits(_completed_from(turned, s, near, gone), n)


def _completed_from(turned, s, near, gone):
    """complete() on a tree that is rooted at the anchor already; balance() is left out for the comparison."""
    keep, kernels.balance = kernels.balance, lambda t: t
    try:
        return kernels.complete(as_node(turned), s, near)
    finally:
        kernels.balance = keep


def test_balance_takes_the_first_record_over_half():
    tree = as_node(((((0, 1), 2), 3), (4, 5)))
    sides = {frozenset(x.taxon for x in k.leaves()) for k in kernels.balance(tree).kids}
    assert sides == {frozenset({0, 1, 2}), frozenset({3, 4, 5})}
    two = kernels.balance(as_node((0, (1, (2, 3)))))
    assert sorted(x.taxon for x in two.leaves()) == [0, 1, 2, 3] and splits(two, 4) == {12}


def test_root_side():
    root, how = kernels.by_outgroup(as_node(((0, (1, 2)), (3, (4, 5)))), {0, 1}, random.Random(1))
    assert how == "side" and [sorted(x.taxon for x in k.leaves()) for k in root.kids] == [[0, 1, 2], [3, 4, 5]]
    root, how = kernels.by_outgroup(as_node(((0, (1, 2)), (3, (4, 5)))), {0, 4}, random.Random(1))
    assert how == "single" and root.kids[0].taxon == 0
    root, how = kernels.by_outgroup(as_node(((0, (1, 2)), (3, (4, 5)), 6)), {0, 1}, random.Random(1))
    assert how == "single"
