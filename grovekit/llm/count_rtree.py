"""An R-tree over count vectors: bounds the overlap of two sets by the summed minima of their group counts."""

from __future__ import annotations

import numpy as np

LEAF, FAN = 32, 16


def reaches(shared: np.ndarray, sizes: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether an overlap suffices for sets with that sum of sizes: den * shared >= num * (sizes - shared)."""
    return (den + num) * shared >= num * sizes


class CountRTree:
    """Points are group counts (rows of `counts`), with the size and label of each set.

    A node has the largest count of each group, the smallest and largest size, and the label if all below share
    it. The overlap of a query with any set below is at most the sum of the minima of both counts, so a node is
    passed over if that sum can't reach the threshold with its smallest set, if its sizes don't fit, or if all
    below have the query's label. Labels may merge between searches.
    """

    def __init__(self, counts: np.ndarray, sizes: np.ndarray, labels: np.ndarray, num: int, den: int):
        self.num, self.den = num, den
        self.order = self._arrange(counts, np.arange(len(sizes))) if len(sizes) > LEAF else np.arange(len(sizes))
        self.counts, self.sizes, self.labels = counts[self.order], sizes[self.order], labels[self.order]
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, int, int]] = []
        top, low, high, fan = self.counts, self.sizes, self.sizes, LEAF
        while len(low) > 1:
            at, below = np.arange(0, len(low), fan), len(low)
            top, low, high = np.maximum.reduceat(top, at, axis=0), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)
            self.levels.append((top, low, high, fan, below))
            fan = FAN
        self._label_nodes()

    def _label_nodes(self) -> None:
        """Of each node the label that all below share, or -1."""
        self.one, label = [], self.labels
        for _, _, _, fan, below in self.levels:
            at = np.arange(0, below, fan)
            least = np.minimum.reduceat(label, at)
            label = np.where(np.maximum.reduceat(label, at) == least, least, -1)
            self.one.append(label)

    def merge(self, labels: np.ndarray, into: int) -> None:
        """The given labels become one."""
        self.labels[np.isin(self.labels, labels)] = into
        self._label_nodes()

    @staticmethod
    def _arrange(counts: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Rows so that neighbours are alike: halves along the group of largest spread, in whole leaves."""
        stack, out = [rows], []
        while stack:
            r = stack.pop()
            if len(r) <= LEAF:
                out.append(r)
                continue
            v = counts[r]
            g = int(np.argmax(v.max(0).astype(np.int64) - v.min(0)))
            half = max(LEAF, (len(r) // 2 + LEAF - 1) // LEAF * LEAF)
            r = r[np.argsort(v[:, g], kind="stable")]
            stack += [r[half:], r[:half]]
        return np.concatenate(out)

    def search(self, count: np.ndarray, size: int, label: int) -> tuple[np.ndarray, np.ndarray]:
        """Sets of other labels whose overlap may suffice, and the bounds of their overlap."""
        at = np.arange(len(self.levels[-1][1])) if self.levels else np.arange(len(self.sizes))
        for (top, low, high, fan, below), one in zip(reversed(self.levels), reversed(self.one), strict=True):
            keep = (one[at] != label) & (self.num * size <= self.den * high[at]) & (self.num * low[at] <= self.den * size)
            at = at[keep]
            bound = np.minimum(top[at], count).sum(1, dtype=np.int64)
            at = at[reaches(np.minimum(bound, size), size + low[at], self.num, self.den)]
            at = (at[:, None] * fan + np.arange(fan)).ravel()
            at = at[at < below]
        keep = (self.labels[at] != label) & (self.num * size <= self.den * self.sizes[at]) & (self.num * self.sizes[at] <= self.den * size)
        at = at[keep]
        bound = np.minimum(self.counts[at], count).sum(1, dtype=np.int64)
        good = reaches(bound, size + self.sizes[at], self.num, self.den)
        return self.order[at[good]], bound[good]
