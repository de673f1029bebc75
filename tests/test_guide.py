"""Average linkage in rounds against the sequential method, and that against all pairs."""

from __future__ import annotations

import itertools

import numpy as np

from grovekit.operators import kernels
from grovekit.plans import guide


def frame(spark, s):
    n = len(s)
    return spark.createDataFrame([(a, b, float(s[a, b])) for a, b in itertools.combinations(range(n), 2) if s[a, b]], "a int, b int, sim double"), spark.range(n).withColumnRenamed("id", "taxon")


def test_rounds_equal_the_sequential_method(spark):
    for n, seed in ((2, 0), (5, 1), (23, 2)):
        r = np.random.default_rng(seed)
        s = r.random((n, n))
        s = (s + s.T) / 2
        rows = guide.merge_rounds(*frame(spark, s))
        assert guide.numbered(rows, list(range(n))) == kernels.upgma(s)
        assert n < 20 or rows.agg({"round": "max"}).first()[0] < n // 2


def test_ties_and_missing_pairs(spark):
    s = np.ones((6, 6))  # all alike: every merge is allowed, the lesser names go first
    merges = guide.numbered(guide.merge_rounds(*frame(spark, s)), list(range(6)))
    assert len(merges) == 5 and merges[0] == (0, 1)
    s = np.zeros((5, 5))
    s[1, 3] = s[3, 1] = 0.5
    rows = [tuple(r)[1:] for r in guide.merge_rounds(*frame(spark, s)).orderBy("round").collect()]
    assert [(a, b) for a, b, _ in rows] == [(1, 3), (0, 1), (0, 2), (0, 4)]
    similar, taxa = frame(spark, s)
    assert guide.merge_rounds(similar.limit(0), taxa.limit(0)).collect() == []


def test_sequential_method_by_all_pairs():
    for seed in range(20):
        r = np.random.default_rng(seed)
        s = np.round(r.random((9, 9)), 1 if seed % 2 else 9)
        s = (s + s.T) / 2
        sets = {i: [i] for i in range(9)}
        for step, (a, b) in enumerate(kernels.upgma(s)):
            mean = {(x, y): s[np.ix_(sets[x], sets[y])].mean() for x, y in itertools.combinations(sorted(sets), 2)}
            assert mean[a, b] > max(mean.values()) - 1e-9
            sets[9 + step] = sets.pop(a) + sets.pop(b)
