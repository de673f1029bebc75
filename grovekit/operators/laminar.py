"""Laminar families as ordered trees, built one set at a time."""

from __future__ import annotations

from collections.abc import Iterable

ACCEPTED, TRIVIAL, REDUNDANT, CROSSING = "accepted", "trivial", "redundant", "crossing"


class Forest:
    """A tree over n taxa in which every inner node is an accepted set.

    Taxa are nodes 0 .. n-1, the root is n. A set fits if it is a union of children of one node, the lowest common
    ancestor of its taxa. Those children are found from below: a node that the set covers is taken up into its parent's
    count, and once the count is the parent's size, the parent itself is covered. So a set costs its own length,
    not the number of sets accepted before.
    """

    def __init__(self, n: int):
        self.n = n
        self.up = [n] * n + [-1]
        self.size = [1] * n + [n]
        self.least = [*range(n), 0]
        self.kids: dict[int, set[int]] = {n: set(range(n))}

    @property
    def resolved(self) -> bool:
        """No node has children that a further set could join (three neighbours around every inner node at most)."""
        return all(len(k) <= (3 if v == self.n else 2) for v, k in self.kids.items())

    def _covered(self, taxa: Iterable[int]) -> list[int]:
        """The topmost nodes that lie within the set; together they are the set."""
        got: dict[int, int] = {}
        line, full = list(taxa), []
        while line:
            v = line.pop()
            full.append(v)
            p = self.up[v]
            if p >= 0:
                got[p] = got.get(p, 0) + self.size[v]
                if got[p] == self.size[p]:
                    line.append(p)
        return [v for v in full if self.up[v] < 0 or got[self.up[v]] < self.size[self.up[v]]]

    def outcome(self, taxa: list[int]) -> tuple[str, list[int]]:
        """What would become of a set, and the nodes it would join."""
        if not 1 < len(taxa) < self.n - 1:
            return TRIVIAL, []
        tops = self._covered(taxa)
        if len(tops) == 1:
            return REDUNDANT, tops
        if any(self.up[v] != self.up[tops[0]] for v in tops):
            return CROSSING, tops
        # all children but one of the root: the same bipartition as that child
        if self.up[tops[0]] == self.n and len(tops) == len(self.kids[self.n]) - 1:
            return REDUNDANT, tops
        return ACCEPTED, tops

    def insert(self, taxa: list[int]) -> str:
        what, tops = self.outcome(taxa)
        if what == ACCEPTED:
            v, p = len(self.up), self.up[tops[0]]
            self.up.append(p)
            self.size.append(len(taxa))
            self.least.append(min(self.least[k] for k in tops))
            self.kids[v] = set(tops)
            self.kids[p] = self.kids[p] - self.kids[v] | {v}
            for k in tops:
                self.up[k] = v
        return what

    def rows(self) -> list[tuple[int, int, int, int, int | None]]:
        """(node, lo, hi, n_children, taxon) from the root down, children by their least taxon; node numbers follow that order."""
        out, stack, at = [], [self.n], 0
        while stack:
            v = stack.pop()
            out.append((len(out), at, at + self.size[v], len(self.kids.get(v, ())), v if v < self.n else None))
            if v < self.n:
                at += 1
            else:
                stack += sorted(self.kids[v], key=lambda k: -self.least[k])
        return out


def members(mask: int) -> list[int]:
    """The taxa of a mask."""
    out = []
    while mask:
        low = mask & -mask
        out.append(low.bit_length() - 1)
        mask ^= low
    return out
