"""Signatures and prefix counts against masks and brute force."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from grovekit.functions.masks import Masks
from grovekit.operators import clusters, partitions, ranges, transitions, weights
from grovekit.sources import newick


def random_tree(r, taxa):
    forest = [str(t) for t in taxa]
    while len(forest) > 1:
        k = min(max(2, len(forest) - 1), r.choice([2, 2, 2, 3, 4]))  # two at the root
        r.shuffle(forest)
        forest = ["(" + ",".join(forest[:k]) + ")", *forest[k:]]
    return forest[0] + ";"


@pytest.fixture(scope="module")
def trees(spark):
    r, n = random.Random(6), 9
    texts = [random_tree(r, r.sample(range(n), r.randint(4, n))) for _ in range(12)]
    masks = Masks(n)
    names = spark.range(n).select(F.col("id").cast("int").alias("taxon"), F.col("id").cast("string").alias("name"))
    nodes = newick.parse(newick.from_lines(spark, texts + texts[:2]), names, masks).cache()
    return nodes, newick.leaf_table(nodes).cache(), masks, names


def of_signatures(nodes, leaf):
    """Signature to mask, over all sets that may come up."""
    all_taxa = sorted({r["taxon"] for r in leaf.select("taxon").distinct().collect()})
    h = {r["taxon"]: (r["h"], r["g"]) for r in ranges.taxon_hashes(leaf.select("taxon").distinct()).collect()}
    out = {}
    for k in range(len(all_taxa) + 1):
        for s in itertools.combinations(all_taxa, k):
            x = 0
            for t in s:
                x ^= h[t][0]
            out[k, x, sum(h[t][1] for t in s)] = sum(1 << t for t in s)
    return out


def test_tables_equal_those_of_masks(trees):
    nodes, leaf, masks, _ = trees
    rows = ranges.signed(nodes.drop("mask"), leaf)
    of = of_signatures(nodes, leaf)
    assert len(of) == 2**9  # no two sets share a signature
    name = lambda s: of[tuple(s)]
    assert {(name(r["sig"]), r["sig"]["sz"], r["freq"]) for r in ranges.cluster_table(rows).collect()} == {tuple(r) for r in clusters.cluster_table(nodes, masks).collect()}
    at = leaf.filter("taxon = 0").select("tree", F.col("pos").alias("anchor_pos"))
    want = {tuple(r) for r in clusters.cluster_table(nodes, masks, 0).collect()}
    assert {(name(r["sig"]), r["sig"]["sz"], r["freq"]) for r in ranges.cluster_table(rows, at).collect()} | {(1, 1, 1)} == want
    key = lambda parts: (tuple(sorted(parts)) if len(parts) > 3 else (*sorted(parts[:2]), parts[2]))
    assert {(key([name(s) for s in r["parts"]]), r["freq"]) for r in ranges.partition_table(rows).collect()} == {(key(r["parts"]), r["freq"]) for r in partitions.partition_table(nodes, masks).collect()}
    pair = lambda p, a, b: (p, min(a, b), max(a, b))
    assert {pair(*(name(r[c]) for c in ("parent", "lo", "hi"))) for r in ranges.transitions(rows).collect()} == {tuple(r) for r in transitions.from_nodes(nodes, masks).collect()}


def test_weights_equal_those_of_masks(spark, trees):
    nodes, leaf, masks, names = trees
    text = random_tree(random.Random(8), range(9))
    species = newick.parse(newick.from_lines(spark, [text, "((((0,1),2),(3,4)),((5,6),(7,8)));"]), names, masks).cache()
    parts = partitions.partition_table(nodes, masks).cache()
    for tree in (0, 1):
        one = species.filter(F.col("tree") == tree)
        want = weights.fixed_tree_score(one, parts, masks).first()[0]
        table = ranges.partition_table(ranges.signed(nodes, leaf))
        for chosen in (None, table):
            assert int(ranges.fixed_score(one.drop("mask"), newick.leaf_table(one), nodes.drop("mask"), leaf, chosen).first()[0]) == want
    # every division of a binary node has the weight of its tripartition
    moves = transitions.from_nodes(one, masks).filter(masks.less(masks.full, masks.either(F.col("lo"), F.col("hi"))) != 0)
    want = {frozenset((r["lo"], r["hi"], 511 & ~(r["lo"] | r["hi"]))): r["weight"] for r in weights.split_weights(moves, parts, masks).collect()}
    got = ranges.node_weights(ranges.scored(one, newick.leaf_table(one)), ranges.trees_as_rows(nodes, leaf))
    kids = {r["node"]: (*r["kids"], r["outside"]) for r in partitions.around(one, masks, root_too=True).collect()}
    assert {frozenset(m for m in kids[r["node"]] if m): int(r["weight"]) for r in got.collect()} == want


def test_small_blocks_and_empty_tables(trees, monkeypatch):
    nodes, leaf, masks, _ = trees
    one, one_leaf = nodes.filter("tree = 0"), leaf.filter("tree = 0")
    want = ranges.fixed_score(one, one_leaf, nodes, leaf).first()[0]
    for name, value in (("BLOCK_LEAVES", 9), ("_CELLS", 1), ("CHUNK_NODES", 2), ("_EXACT_LEAVES", 2)):
        monkeypatch.setattr(ranges, name, value)
        assert ranges.fixed_score(one, one_leaf, nodes, leaf).first()[0] == want
    assert ranges.fixed_score(one, one_leaf, nodes.limit(0), leaf.limit(0)).first()[0] == 0
    assert ranges.cluster_table(ranges.signed(nodes.limit(0), leaf.limit(0))).collect() == []


def test_quartets_by_definition():
    r = np.random.default_rng(1)
    for rows, cols in ((3, 3), (3, 4), (4, 3), (5, 2), (2, 2)):
        t = r.integers(0, 5, (rows, cols))
        cells = list(itertools.product(range(rows), range(cols)))
        want = sum(t[c] * (t[c] - 1) // 2 * t[a] * t[b] for c in cells for a, b in itertools.combinations([x for x in cells if x[0] != c[0] and x[1] != c[1]], 2) if a[0] != b[0] and a[1] != b[1])
        assert ranges.quartets(t[..., None])[0] == want
