"""Consensus trees, ancestors and proposals against plain versions that compare everything with everything."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from grovekit.functions.masks import Masks
from grovekit.operators import ancestors, clusters, kernels
from grovekit.operators.laminar import ACCEPTED, CROSSING, REDUNDANT, TRIVIAL, Forest, members
from grovekit.plans import consensus, enrich
from grovekit.sources import newick

from test_ranges import random_tree


def parsed(spark, texts, n):
    masks = Masks(n)
    names = spark.range(n).select(F.col("id").cast("int").alias("taxon"), F.col("id").cast("string").alias("name"))
    return newick.parse(newick.from_lines(spark, texts), names, masks).cache(), masks


def greedy(counted, n):
    full, kept = (1 << n) - 1, []
    for f, m in sorted(((f, full & ~m if m & 1 else m) for m, f in counted), key=lambda x: (-x[0], x[1])):
        if 1 < m.bit_count() < n - 1 and all(m & k in (0, m, k) for _, k in kept):
            kept.append((f, m))
    return kept


def test_consensus_in_rounds(spark):
    for n, seed in ((9, 1), (70, 2)):  # one word, and an array of words
        r = random.Random(seed)
        nodes, masks = parsed(spark, [random_tree(r, r.sample(range(n), n - r.choice([0, 0, 2]))) for _ in range(25 if n == 9 else 6)], n)
        bips = clusters.bipartition_table(nodes, masks).cache()
        want = greedy([(masks.unpack(x["mask"]), x["freq"]) for x in bips.collect()], n)
        full = (1 << n) - 1
        for batch in (3, 4096) if n == 9 else (40,):
            assert [(f, full & ~m if m & 1 else m) for m, f in consensus.accepted(bips, masks, batch)] == want
        assert consensus.accepted(bips.limit(0), masks) == []
        rows = consensus.snapshots(bips, masks, 25).collect()
        for i, t in enumerate(kernels.THRESHOLDS):
            tree = [x for x in rows if x["tree"] == i]
            order = {x["lo"]: x["taxon"] for x in tree if x["taxon"] is not None}
            sets = {sum(1 << order[p] for p in range(x["lo"], x["hi"])) for x in tree if x["taxon"] is None and x["parent"] is not None}
            assert {full & ~m if m & 1 else m for m in sets} == {m for f, m in want if f > t * 25 or t == 0}
            kids: dict = {}
            for x in sorted(tree, key=lambda x: x["child_ord"]):
                kids.setdefault(x["parent"], []).append(min(order[p] for p in range(x["lo"], x["hi"])))
            assert all(k == sorted(k) for k in kids.values())


def test_forest_outcomes():
    f = Forest(8)
    assert [f.insert(s) for s in ([1, 2, 3], [1, 2], [2, 1], [3, 4], [5], [0, 1, 2, 3, 4, 5, 6], [4, 5], [1, 2, 3, 4, 5], [6, 7])] == [ACCEPTED, ACCEPTED, REDUNDANT, CROSSING, TRIVIAL, TRIVIAL, ACCEPTED, ACCEPTED, ACCEPTED]
    assert f.insert([0, 6, 7]) == REDUNDANT and f.resolved  # what is left of the root beside [1..5]
    assert [x[1:3] for x in f.rows()][:2] == [(0, 8), (0, 1)]


def test_induced_sets_equal_a_walk(spark):
    r = random.Random(4)
    nodes, masks = parsed(spark, [random_tree(r, r.sample(range(12), r.randint(4, 12))) for _ in range(30)], 12)
    below: dict = {}
    for x in nodes.filter("parent IS NOT NULL AND n_children > 0").collect():
        below.setdefault(x["tree"], set()).add(x["mask"])
    for line in ancestors.lines(nodes).collect():
        for _ in range(20):
            s = r.sample(range(12), r.randint(1, 8))
            want = {sum(1 << i for i, t in enumerate(s) if m >> t & 1) for m in below.get(line["tree"], ())}
            got = ancestors.induced_sets(np.array(line["taxa"]), np.array(line["levels"]), np.array(s))
            assert sorted(got) == sorted(m for m in want if m.bit_count() > 1)


def test_ancestors_of_pairs(spark):
    r = random.Random(9)
    nodes, masks = parsed(spark, [random_tree(r, r.sample(range(14), r.randint(2, 14))) for _ in range(8)], 14)
    rows = nodes.collect()
    pairs = [(t, r.randrange(14), r.randrange(14), k) for k in range(300) for t in (r.randrange(9),)]
    want = {}
    for t, a, b, k in pairs:
        both = [x for x in rows if x["tree"] == t and x["mask"] >> a & 1 and x["mask"] >> b & 1]
        if both:
            low = max(both, key=lambda x: x["lvl"])
            want[k] = (t, a, b, low["lvl"], low["node"])
    got = ancestors.of_pairs(spark.createDataFrame(pairs, "tree long, a int, b int, k int"), nodes).collect()
    assert {x["k"]: (x["tree"], x["a"], x["b"], x["lvl"], x["node"]) for x in got} == want
    assert ancestors.of_pairs(spark.createDataFrame(pairs, "tree long, a int, b int, k int"), nodes.limit(0)).collect() == []


def test_proposals(spark):
    r, n = random.Random(3), 10
    nodes, masks = parsed(spark, [random_tree(r, range(n)) for _ in range(15)], n)
    s = np.array([[1.0 if a == b else ((a * b) % 7) / 10 for b in range(n)] for a in range(n)])
    got = {x["mask"]: x for x in enrich.proposals(nodes, s, masks, 1, True, True).collect()}
    assert got and not any(m & 1 for m in got) and {x["kind"] for x in got.values()} <= set(range(5))
    again = {x["mask"]: x for x in enrich.proposals(nodes.repartition(7), s, masks, 1, True, True).collect()}
    assert got == again  # the seed alone decides
    plain = {x["mask"] for x in enrich.proposals(nodes, s, masks, 1).collect()}
    assert plain <= set(got) and {x["kind"] for x in got.values()} >= {0, 1}


def test_rounds_count_what_trees_have(spark):
    r, n = random.Random(5), 9
    texts = [random_tree(r, range(n)) for _ in range(12)]
    nodes, masks = parsed(spark, texts, n)
    task = enrich.Task((1, 6, 8, 16, 32, 64 + 128 + 256), 0)
    below: dict = {}
    for x in nodes.filter("parent IS NOT NULL AND n_children > 0").collect():
        below.setdefault(x["tree"], set()).add(x["mask"])
    samples = [(0, k, enrich.representatives(task, 1, k)) for k in range(5)]
    want: dict = {}
    for _, k, reps in samples:
        for sets in below.values():
            cut = {sum(1 << i for i, t in enumerate(reps) if m >> int(t) & 1) for m in sets}
            for m in {min(m, 63 - m) for m in cut if 2 <= m.bit_count() <= 4}:
                want[k, m] = want.get((k, m), 0) + 1
    counts = enrich.induced_counts(ancestors.lines(nodes), samples)
    assert {(x["round"], int(x["side"])): x["freq"] for x in counts.collect()} == want
    found = enrich.built(counts, [task], 1, None, False, True).collect()
    for k in range(5):
        reps = samples[k][2]
        of = lambda m: sum(1 << i for i, g in enumerate(task.groups) if m & g)
        sets = [of(int(x["mask"])) for x in found if x["round"] == k]
        assert all(sum(g for g in task.groups if int(x["mask"]) & g) == int(x["mask"]) for x in found)  # unions of groups
        assert all(a & b in (0, a, b) for a in sets for b in sets)  # laminar, random ones too
        assert [m for m in sets if m.bit_count() > 1] and len(reps) == 6
    # a round that is productive earns its task more
    task_rounds = {x["round"] for x in enrich.sampled(ancestors.lines(nodes), [task], 12, 1).collect()}
    assert task_rounds >= set(range(10))


def test_leftovers_resolve_and_nest():
    for seed in range(30):
        f = Forest(7)
        f.insert([1, 2, 3])
        sets = [set(s) for s in enrich.leftovers(f, random.Random(seed))]
        assert all(a <= b or b <= a or not a & b for a in [*sets, {1, 2, 3}] for b in [*sets, {1, 2, 3}]) and len(sets) == 3
        assert sets == [set(s) for s in enrich.leftovers(f, random.Random(seed))]


def test_preference(spark):
    task = [enrich.Task((1, 2, 4, 8), 3), enrich.Task((1, 2, 12, 16), 1)]
    rows = [(0, 1, 1, 4, "12"), (1, 2, 1, 9, "12"), (0, -1, 0, 0, "12"), (0, 3, 4, 0, "6"), (1, 3, 4, 0, "25"), (1, 3, 1, 0, "31"), (1, 3, 1, 0, "0")]
    orders = {1: {0: 0, 3: 1, 4: 2, 1: 3, 2: 4}, 3: {t: t for t in range(5)}}
    got = enrich.preferred(spark.createDataFrame(rows, enrich.EMISSION), task, orders, Masks(5), 0).collect()
    assert {(r["mask"], r["kind"], r["family"], r["ranges"]) for r in got} == {(12, 0, 3, 1), (6, 4, 1, 1)}
    assert members(12) == [2, 3]
