"""Steps that are sequential by nature, as plain functions on one tree or one small table.

They run inside Arrow functions over grouped rows (see plans.inference); nothing here knows Spark.
"""

from __future__ import annotations

import functools
import random
from collections import deque
from collections.abc import Iterable

import numpy as np


class Node:
    """A tree node: a leaf has a taxon, an inner node has children."""

    __slots__ = ("taxon", "kids", "parent")

    def __init__(self, taxon: int | None = None, kids: Iterable[Node] = ()):
        self.taxon, self.kids, self.parent = taxon, [], None
        for k in kids:
            self.add(k)

    def add(self, kid: Node) -> None:
        self.kids.append(kid)
        kid.parent = self

    def postorder(self) -> list[Node]:
        out, stack = [], [self]
        while stack:
            n = stack.pop()
            out.append(n)
            stack.extend(n.kids)
        return out[::-1]

    def leaves(self) -> list[Node]:
        return [n for n in self.postorder() if n.taxon is not None]


def from_rows(rows: Iterable[tuple[int, int, int | None]]) -> Node:
    """A tree from (lo, hi, taxon or None) of its nodes."""
    root, stack = None, []
    for lo, hi, taxon in sorted(rows, key=lambda r: (r[0], -r[1])):
        node = Node(None if taxon is None else int(taxon))
        while stack and stack[-1][1] <= lo:
            stack.pop()
        if stack:
            stack[-1][0].add(node)
        else:
            root = node
        stack.append((node, hi))
    return root


def to_rows(root: Node) -> list[tuple[int, int, int, int | None]]:
    """(node, lo, hi, taxon), numbered from the root down, children in order."""
    out, place = [], 0
    stack: list[tuple[Node, int]] = [(root, -1)]
    while stack:
        node, at = stack.pop()
        if at >= 0:
            out[at][2] = place
            continue
        out.append([len(out), place, place + 1, node.taxon])
        if node.taxon is not None:
            place += 1
        else:
            stack.append((node, len(out) - 1))
            stack.extend((k, -1) for k in reversed(node.kids))
    return [tuple(r) for r in out]


def to_newick(root: Node, names: list[str]) -> str:
    text: dict[int, str] = {}
    for n in root.postorder():
        text[id(n)] = quoted(names[n.taxon]) if n.taxon is not None else "(" + ",".join(text.pop(id(k)) for k in n.kids) + ")"
    return text[id(root)] + ";"


def quoted(name: str) -> str:
    return "'" + name.replace("'", "''") + "'" if any(c in "(),:;'[]" or c.isspace() for c in name) else name


def resolve(root: Node, rng: random.Random | None = None) -> Node:
    """Binary: the first two children are joined and the join goes to the end, until two are left. rng: random pairs instead."""
    for n in root.postorder():
        if len(n.kids) > 2:
            line = deque(n.kids)
            while len(line) > 2:
                if rng:
                    rng.shuffle(line)
                line.append(Node(kids=[line.popleft(), line.popleft()]))
            n.kids = []
            for k in line:
                n.add(k)
    return root


def isolate_first(root: Node) -> Node:
    """An unrooted root of three or more: its first child on one side, the others together on the other."""
    return Node(kids=[root.kids[0], Node(kids=root.kids[1:])]) if len(root.kids) > 2 else root


def reroot(below: Node, root: Node) -> Node:
    """The tree with a root on the branch above a node: the node first, the rest second. Old roots left with one child vanish."""
    if below is root or below.parent is root and len(root.kids) == 2 and root.kids[0] is below:
        return root
    up = below.parent
    up.kids.remove(below)
    path = [up]
    while path[-1].parent is not None:
        path.append(path[-1].parent)
    for child, parent in zip(path, path[1:], strict=False):
        parent.kids.remove(child)
    for child, parent in zip(path, path[1:], strict=False):
        child.add(parent)
    last = path[-1]
    if len(last.kids) == 1:
        if len(path) == 1:
            up = last.kids[0]
        else:
            holder = path[-2]
            holder.kids[holder.kids.index(last)] = last.kids[0]
            last.kids[0].parent = holder
    up.parent = None
    return Node(kids=[below, up])


def by_outgroup(root: Node, outgroup: set[int], rng: random.Random) -> tuple[Node, str]:
    """Rooted by an outgroup: as a clade, else by the ingroup as a clade, else where a two-sided root has all of it on one side, else by one outgroup taxon, else at random."""
    below: dict[int, frozenset[int]] = {}
    for n in root.postorder():
        below[id(n)] = frozenset([n.taxon]) if n.taxon is not None else frozenset().union(*(below[id(k)] for k in n.kids))
    everything = below[id(root)]
    out = everything & outgroup
    order = root.postorder()[:-1]
    for wanted, how in ((out, "outgroup"), (everything - out, "ingroup")):
        if wanted and wanted != everything:
            for n in order:
                if below[id(n)] == wanted:
                    return reroot(n, root), how
    if out and len(root.kids) == 2:
        for k in root.kids:
            if out <= below[id(k)]:
                return reroot(k, root), "side"
    if out:
        return reroot(next(n for n in order if n.taxon == min(out)), root), "single"
    return reroot(rng.choice(order), root), "random"


def best_divisions(splits: Iterable[tuple[int, int, int, int]], everything: int) -> list[tuple[int, int, int, int, int]]:
    """(cluster, total, lo, hi, weight) of every cluster reached from the root through best divisions.

    splits: parent, lo, hi, weight. total(A) = max over its divisions of weight + total(lo) + total(hi); clusters
    without divisions count 0. Ties: the lesser lo.
    """
    of: dict[int, list[tuple[int, int, int]]] = {}
    for parent, lo, hi, w in splits:
        of.setdefault(parent, []).append((lo, hi, w))
    reached, stack = set(), [everything]
    while stack:
        a = stack.pop()
        if a not in reached:
            reached.add(a)
            stack.extend(x for lo, hi, _ in of.get(a, ()) for x in (lo, hi))
    total: dict[int, int] = {}
    best: dict[int, tuple[int, int, int]] = {}
    for a in sorted(reached, key=int.bit_count):
        if a in of:
            lo, hi, w = min(of[a], key=lambda s: (-(s[2] + total[s[0]] + total[s[1]]), s[0]))
            total[a], best[a] = w + total[lo] + total[hi], (lo, hi, w)
        else:
            total[a] = 0
    out, stack = [], [everything]
    while stack:
        a = stack.pop()
        if a in best:
            lo, hi, w = best[a]
            out.append((a, total[a], lo, hi, w))
            stack += [hi, lo]
    return out


def tree_of(divisions: dict[int, tuple[int, int]], cluster: int) -> tuple[Node, bool]:
    """The tree of chosen divisions, and whether a cluster of several taxa had none (it becomes a multifurcation)."""
    made: dict[int, Node] = {}
    whole, stack = True, [(cluster, False)]
    while stack:
        a, ready = stack.pop()
        if ready:
            made[a] = Node(kids=[made[x] for x in divisions[a]])
        elif a in divisions:
            stack += [(a, True), *((x, False) for x in divisions[a])]
        elif a.bit_count() == 1:
            made[a] = Node(a.bit_length() - 1)
        else:
            whole = False
            made[a] = Node(kids=[Node(t) for t in range(a.bit_length()) if a >> t & 1])
    return made[cluster], not whole


def upgma(similar: np.ndarray) -> list[tuple[int, int]]:
    """Merges of the most similar pair, averages weighted by size. Items are 0 .. n-1, merges n, n+1, ... Ties: the pair of lowest numbers.

    Each row keeps its best; a merge looks again only at rows whose best was one of the two.
    """
    n = len(similar)
    s = similar.astype(float).copy()
    np.fill_diagonal(s, -np.inf)
    name, size, out = np.arange(n), np.ones(n), []
    top = s.max(axis=1, initial=-np.inf)
    for step in range(n - 1):
        rows = np.flatnonzero(top == top.max())
        r, c = np.nonzero(s[rows] == top.max())
        lo, hi = np.minimum(name[rows[r]], name[c]), np.maximum(name[rows[r]], name[c])
        k = np.lexsort((hi, lo))[0]
        i, j = int(rows[r[k]]), int(c[k])
        out.append((int(lo[k]), int(hi[k])))
        again = (top == s[:, i]) | (top == s[:, j])
        merged = (size[i] * s[i] + size[j] * s[j]) / (size[i] + size[j])
        merged[[i, j]] = -np.inf
        s[i], s[:, i], s[j], s[:, j] = merged, merged, -np.inf, -np.inf
        size[i], name[i] = size[i] + size[j], n + step
        again[i] = True
        top = np.maximum(top, s[:, i])
        top[again] = s[again].max(axis=1)
        top[j] = -np.inf
    return out


def guide_tree(merges: list[tuple[int, int]], n: int) -> Node:
    nodes: list[Node] = [Node(i) for i in range(n)]
    for a, b in merges:
        nodes.append(Node(kids=[nodes[a], nodes[b]]))
    return nodes[-1]


def balance(root: Node) -> Node:
    """Before completion: the first leaf among a node's children goes last, and the root to the branch above the most balanced node.

    Most balanced: of the inner nodes in postorder, those whose distance from half the leaves is less than all before (and
    than half) set a record; the first record of a node with more than half the leaves is final, else the last record is.
    """
    order = root.postorder()
    size = {id(n): 1 for n in order if n.taxon is not None}
    inner = [n for n in order if n.taxon is None]
    for n in inner:
        size[id(n)] = sum(size[id(k)] for k in n.kids)
    half = size[id(root)] // 2
    counts = np.array([size[id(n)] for n in inner])
    away = np.abs(counts - half)
    records = np.flatnonzero(away < np.minimum.accumulate([half, *away])[:-1])
    over = records[counts[records] > half]
    for n in inner:
        tip = next((i for i, k in enumerate(n.kids) if k.taxon is not None), None)
        if tip is not None and (tip == 0 or len(n.kids) > 2):
            n.kids.append(n.kids.pop(tip))
    if not len(records):
        return root
    best = inner[over[0] if len(over) else records[-1]]
    return root if best is root else reroot(best, root)


def four_points(similar: np.ndarray, x: int, a: int, b: int, c: int) -> int:
    """Whether x goes with a (0), b (1) or c (2): the pairing with the best margin, of equal ones the first."""
    with_a, with_b, with_c = (similar[x, p] + similar[q, r] for p, q, r in ((a, b, c), (b, a, c), (c, a, b)))
    return int(np.argmax((with_a - with_b, with_b - with_a, with_c - with_b)))


def complete(root: Node, similar: np.ndarray, nearest: np.ndarray) -> Node:
    """The tree with all taxa: each missing one, in order, joins below the first node where its anchor wins.

    nearest: for each taxon the others, nearest first; the anchor is the nearest that is present, and the tree is rooted there.
    From the anchor's sister on, a node stands for its first two children by their first leaves, and the winner of the four
    points says whether x joins here (beside all that is below) or which child is next.
    """
    root = balance(root)
    at = {n.taxon: n for n in root.leaves()}
    for x in sorted(set(range(len(similar))) - set(at)):
        anchor = int(nearest[x][np.isin(nearest[x], list(at))][0])
        root = reroot(at[anchor], root)
        first: dict[int, int] = {}
        for n in root.kids[1].postorder():
            first[id(n)] = n.taxon if n.taxon is not None else first[id(n.kids[0])]
        here = root.kids[1]
        while here.kids and (side := four_points(similar, x, anchor, *(first[id(k)] for k in here.kids[:2]))):
            here = here.kids[side - 1]
        at[x] = Node(x)
        if here.kids:
            below = Node(kids=here.kids)
            here.kids = []
            here.add(at[x])
            here.add(below)
        else:
            up = here.parent
            up.kids.remove(here)
            up.add(Node(kids=[here, at[x]]))
    return root


THRESHOLDS = (0.0, 0.01, 0.02, 0.05, 0.1, 0.2, 1 / 3)


def arms(clusters: list[int], n: int) -> list[list[int]]:
    """The groups around every node of more than three neighbours in the tree of a laminar family."""
    full = (1 << n) - 1
    family = sorted({*clusters, *(1 << t for t in range(n))}, key=lambda m: (m.bit_count(), m))
    kids: dict[int, list[int]] = {full: []}
    for i, m in enumerate(family):
        up = next((k for k in family[i + 1 :] if m & k == m and k != m), full)
        kids.setdefault(up, []).append(m)
    return [sorted([*v, *([full & ~m] if m != full else [])]) for m, v in sorted(kids.items()) if len(v) + (m != full) > 3]


def within_budget(degrees: list[int], n: int) -> int:
    """The largest degree taken: in ascending order until the squares add up to 50 + 25 n."""
    total, limit = 0, 0
    for d in sorted(degrees):
        if total >= 50 + 25 * n:
            break
        total, limit = total + d * d, d
    return limit


def _members(mask: int) -> list[int]:
    return [t for t in range(mask.bit_length()) if mask >> t & 1]


def resolve_by_similarity(groups: list[int], similar: np.ndarray, reps: list[int] | None = None) -> list[int]:
    """Unions of groups that UPGMA on their average similarity, or that of one taxon of each, makes below the root."""
    sets = [[t] for t in reps] if reps else [_members(g) for g in groups]
    s = np.array([[similar[np.ix_(a, b)].mean() for b in sets] for a in sets])
    unions, out = list(groups), []
    merges = upgma(s)
    for a, b in merges[:-1]:
        unions.append(unions[a] | unions[b])
        out.append(unions[-1])
    return out


def sample_multifurcation(groups: list[int], guide: list[int], seed: int, rounds: int = 3) -> list[int]:
    """Unions of the arms of an input multifurcation (4 to 31 arms) that the guide tree suggests for sampled taxa."""
    d = len(groups)
    if not 4 <= d <= 31:
        return []
    rng = random.Random(f"{seed}:{groups}")
    sets, out = [_members(g) for g in groups], []
    for _ in range(rounds):
        reps = [rng.choice(s) for s in sets]
        for m in guide:
            inside = [g for g, t in zip(groups, reps, strict=True) if m >> t & 1]
            if 2 <= len(inside) <= d - 1 and sum(inside) not in out:
                out.append(sum(inside))
    return out


def clades(root: Node) -> list[int]:
    """The taxa below each inner node but the root."""
    below: dict[int, int] = {}
    for n in root.postorder():
        below[id(n)] = 1 << n.taxon if n.taxon is not None else functools.reduce(int.__or__, (below[id(k)] for k in n.kids))
    return [below[id(n)] for n in root.postorder()[:-1] if n.taxon is None]


def nested_balls(groups: list[int], similar: np.ndarray, reps: list[int] | None = None) -> list[int]:
    """For each group the unions with its nearest, second nearest ... group: nested neighbourhoods, by averages or by one taxon of each."""
    sets, out = [[t] for t in reps] if reps else [_members(g) for g in groups], []
    for i, a in enumerate(sets):
        near = sorted((j for j in range(len(sets)) if j != i), key=lambda j: (-similar[np.ix_(a, sets[j])].mean(), j))
        ball = groups[i]
        for j in near[: len(sets) - 3]:
            ball |= groups[j]
            out.append(ball)
    return list(dict.fromkeys(out))
