"""Taxon sets as ranges of one tree: identities by prefix hashes, intersections by prefix counts. Nothing here has n bits.

A set is named by a signature: its size, the XOR and the sum of its taxa's hashes. Both hashes run along a tree's leaves
(before and up to each position), so a range's signature is a difference of two rows, whatever its length, and
complements, differences and disjoint unions are arithmetic on signatures. The XOR has 64 bits; the summed hash has 40, so that
sums over four million taxa stay within a BIGINT. Two sets are taken for equal if size, XOR and sum agree.

How many taxa two ranges of different trees share comes from counts along one tree of membership in the other's range; a
complement is what is left of the whole. Trees meet in a grid of bounded blocks, in which numpy does the counting.
"""

from __future__ import annotations

import functools
import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SUM_BITS = 40
BLOCK_LEAVES = 1 << 22  # leaves of the gene trees' rows in a block, at least one row
STRETCH = 1 << 12  # neighbouring leaves summed by one task
CHUNK_NODES = 1 << 14  # nodes of a gene tree in one row, or so
_CELLS = 1 << 19  # numbers in one of the kernel's arrays
_WORK = 50_000  # leaves below gene nodes worth a task
_EXACT_LEAVES = 40_000  # beyond, a pair of nodes may have more than 2**63 quartets, and whole numbers of any size are used


def signature(size: Column, xor: Column, total: Column) -> Column:
    return F.struct(size.cast("long").alias("sz"), xor.alias("x"), total.cast("long").alias("s"))


def less(a: Column, b: Column) -> Column:
    """a without b, which is part of it; also what a complement within a is."""
    return signature(a["sz"] - b["sz"], a["x"].bitwiseXOR(b["x"]), a["s"] - b["s"])


def joined(a: Column, b: Column) -> Column:
    """The union of disjoint sets."""
    return signature(a["sz"] + b["sz"], a["x"].bitwiseXOR(b["x"]), a["s"] + b["s"])


def taxon_hashes(rows: DataFrame) -> DataFrame:
    """h, g: a taxon's two hashes."""
    return rows.withColumn("h", F.xxhash64("taxon", F.lit(1))).withColumn("g", F.shiftrightunsigned(F.xxhash64("taxon", F.lit(2)), 64 - SUM_BITS))


def running(rows: DataFrame, sums: list[str], xors: tuple[str, ...] = ()) -> DataFrame:
    """rows with the totals of columns up to each pos of its tree, in place of the columns, and the whole tree's as whole_<column>.

    Stretches of STRETCH positions are summed on their own, and then the stretches' totals, so that no task has a whole tree.
    """
    keys, ops = ["tree", "_stretch"], [*((c, F.sum) for c in sums), *((c, F.bit_xor) for c in xors)]
    rows = rows.withColumn("_stretch", F.shiftright("pos", STRETCH.bit_length() - 1))
    totals = rows.groupBy(*keys).agg(*[f(c).alias(c) for c, f in ops])
    tree = Window.partitionBy("tree")
    past = tree.orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*keys, *[F.coalesce(f(c).over(past), F.lit(0)).alias(f"_{c}") for c, f in ops], *[f(c).over(tree).alias(f"whole_{c}") for c, f in ops])
    by = Window.partitionBy(*keys).orderBy("pos")
    own = rows.withColumns({c: f(c).over(by) for c, f in ops}).join(before, keys)
    add = lambda c, f: F.col(c) + F.col(f"_{c}") if f is F.sum else F.col(c).bitwiseXOR(F.col(f"_{c}"))
    return own.withColumns({c: add(c, f) for c, f in ops}).drop("_stretch", *[f"_{c}" for c, _ in ops])


def everything(leaf: DataFrame, sums: dict[str, Column] | None = None) -> DataFrame:
    """One row: the signature of all taxa of the collection, and their totals as all_<name>."""
    rows = taxon_hashes(leaf.select("taxon").distinct())
    more = [F.coalesce(F.sum(c), F.lit(0)).alias(f"all_{k}") for k, c in (sums or {}).items()]
    return rows.agg(signature(F.count("*"), F.coalesce(F.bit_xor("h"), F.lit(0)), F.coalesce(F.sum("g"), F.lit(0))).alias("all"), *more)


def signed(nodes: DataFrame, leaf: DataFrame, sums: dict[str, Column] | None = None) -> DataFrame:
    """Nodes (tree, node, parent, lo, hi, n_children, child_ord) with own, whole (of their tree) and all.

    leaf: tree, pos (gapless from 0), taxon. sums: numbers of a taxon; a node gets the totals of its taxa, and all taxa's as all_<name>.
    What stands up to a place is looked up twice from one table: at a node's end, and where it begins, which for the first leaf is nothing.
    """
    sums = sums or {}
    rows = taxon_hashes(leaf.select("tree", "pos", "taxon")).withColumns(sums)
    rows = running(rows.select("tree", "pos", F.lit(1).alias("n"), F.col("h").alias("x"), F.col("g").alias("s"), *sums), ["n", "s", *sums], ("x",))
    at, added = (F.col("pos") + 1), ["x", "s", *sums]
    whole = signature(F.col("whole_n"), F.col("whole_x"), F.col("whole_s")).alias("whole")
    ends = rows.select("tree", at.alias("hi"), *[F.col(c).alias(f"_{c}1") for c in added], whole)
    starts = rows.select("tree", at.alias("lo"), *[F.col(c).alias(f"_{c}0") for c in added])
    found = nodes.join(ends, ["tree", "hi"]).join(starts, ["tree", "lo"], "left")
    end, start = ({c: F.coalesce(F.col(f"_{c}{k}"), F.lit(0)) for c in added} for k in (1, 0))
    own = signature(F.col("hi") - F.col("lo"), end["x"].bitwiseXOR(start["x"]), end["s"] - start["s"])
    found = found.select(*nodes.columns, own.alias("own"), "whole", *[(end[c] - start[c]).alias(c) for c in sums])
    return found.crossJoin(F.broadcast(everything(leaf, sums)))  # one row


def cluster_table(rows: DataFrame, anchor_at: DataFrame | None = None, sums: tuple[str, ...] = ()) -> DataFrame:
    """sig, freq, exemplar (tree, lo, hi, comp: all taxa but these), and sums of signed(), over all nodes of signed() but roots, both sides.

    anchor_at: tree, anchor_pos of the trees that have the anchor; then only the sides without it count.
    """
    side = lambda sig, comp, of: F.struct(sig.alias("sig"), F.struct("tree", "lo", "hi", F.lit(comp).alias("comp")).alias("exemplar"), *[of(c).alias(c) for c in sums])
    own, rest = side(F.col("own"), False, F.col), side(less(F.col("all"), F.col("own")), True, lambda c: F.col(f"all_{c}") - F.col(c))
    kept = rows.filter("parent IS NOT NULL")
    if anchor_at is None:
        each = kept.select(F.explode(F.array(own, rest)).alias("e"))
    else:
        has = F.coalesce((F.col("anchor_pos") >= F.col("lo")) & (F.col("anchor_pos") < F.col("hi")), F.lit(False))
        each = kept.join(anchor_at, "tree", "left").select(F.when(has, rest).otherwise(own).alias("e"))
    return each.filter("e.sig.sz > 0").groupBy("e.sig").agg(F.count("*").alias("freq"), F.min("e.exemplar").alias("exemplar"), *[F.min(f"e.{c}").alias(c) for c in sums])


def around(rows: DataFrame, root_too: bool = False) -> DataFrame:
    """tree, node, lo, hi, kids (signatures, sorted), outside (the rest of the tree), beyond (the rest of all taxa)."""
    here = F.struct("lo", "hi", less(F.col("whole"), F.col("own")).alias("outside"), less(F.col("all"), F.col("own")).alias("beyond"))
    inner = F.expr("n_children > 1" if root_too else "parent IS NOT NULL AND n_children > 1")
    as_kid = F.struct(F.col("parent").alias("node"), F.col("own").alias("kid"), F.when(F.lit(False), here).alias("here"))
    as_node = F.struct(F.when(inner, F.col("node")).alias("node"), F.when(F.lit(False), F.col("own")).alias("kid"), here.alias("here"))
    each = rows.select("tree", F.explode(F.array(as_kid, as_node)).alias("e")).select("tree", "e.*").filter("node IS NOT NULL")
    # with the rows of a key together first, no list of one child is made and sent
    found = each.repartition("tree", "node").groupBy("tree", "node").agg(F.sort_array(F.collect_list("kid")).alias("kids"), F.max("here").alias("here"))
    return found.filter("here IS NOT NULL").select("tree", "node", "here.*", "kids")


def partition_table(rows: DataFrame) -> DataFrame:
    """parts, d, freq, exemplar (tree, node): the sets around inner nodes, keyed as partitions.partition_table keys masks."""
    all_parts = F.concat("kids", F.array("outside"))
    parts = F.when(F.size("kids") > 2, F.array_sort(all_parts)).otherwise(all_parts)
    grouped = around(rows).groupBy(parts.alias("parts")).agg(F.count("*").alias("freq"), F.min(F.struct("tree", "node")).alias("exemplar"))
    return grouped.select("parts", F.size("parts").alias("d"), "freq", "exemplar")


def transitions(rows: DataFrame) -> DataFrame:
    """parent, lo, hi (signatures) of all binary nodes: their own set, and the complement of each child seen from outside."""
    kid = F.struct("child_ord", F.col("own").alias("sig"), "n_children")
    kids = rows.filter("parent IS NOT NULL").groupBy("tree", F.col("parent").alias("node")).agg(F.sort_array(F.collect_list(kid)).alias("k")).filter("size(k) = 2")
    two = kids.join(rows.select("tree", "node", "own", "all"), ["tree", "node"])
    a, b, over = F.col("k")[0], F.col("k")[1], less(F.col("all"), F.col("own"))
    pair = lambda p, x, y: F.struct(p.alias("parent"), F.least(x, y).alias("lo"), F.greatest(x, y).alias("hi"))
    up = lambda u, v: F.when((over["sz"] > 0) & (u["n_children"] <= 2), pair(less(F.col("all"), u["sig"]), v["sig"], over))
    each = two.select(F.explode(F.array(pair(F.col("own"), a["sig"], b["sig"]), up(a, b), up(b, a))).alias("t")).filter("t IS NOT NULL")
    return each.select("t.*").distinct()


def bounded(nodes: DataFrame, root_too: bool = False) -> DataFrame:
    """tree, node, bounds (where the children begin, and the end), is_root of the inner nodes below the root (root_too: and it)."""
    inner = F.expr("n_children > 1" if root_too else "parent IS NOT NULL AND n_children > 1")
    begin = F.struct(F.col("parent").alias("node"), F.col("lo").cast("int").alias("bound"), F.lit(0).alias("end"))
    end = F.struct(F.when(inner, F.col("node")).alias("node"), F.col("hi").cast("int").alias("bound"), F.when(F.col("parent").isNull(), 2).otherwise(1).alias("end"))
    each = nodes.select("tree", F.explode(F.array(begin, end)).alias("e")).select("tree", "e.*").filter("node IS NOT NULL").repartition("tree", "node")
    found = each.groupBy("tree", "node").agg(F.sort_array(F.collect_list("bound")).alias("bounds"), F.max("end").alias("end"))
    return found.filter("end > 0").select("tree", "node", "bounds", (F.col("end") == 2).alias("is_root"))


def trees_as_rows(nodes: DataFrame, leaf: DataFrame, chosen: DataFrame | None = None, root_too: bool = False, chunk: int | Column | None = None) -> DataFrame:
    """tree, taxa (in the order of the leaves), nodes (node, freq, bounds): bounds are where the children begin, and the end.

    chosen: tree, node, freq of the inner nodes to keep; else all below the root (root_too: and it). chunk: so many nodes in a row, or
    so (a column says it of each tree); a hash deals them out. A row is as long as its tree has leaves.
    """
    taxa = leaf.groupBy("tree").agg(F.sort_array(F.collect_list(F.struct("pos", "taxon")))["taxon"].cast("array<int>").alias("taxa"))
    inner = bounded(nodes, root_too).drop("is_root")
    inner = inner.join(chosen, ["tree", "node"]) if chosen is not None else inner.withColumn("freq", F.lit(1).cast("long"))
    item = F.struct("node", "freq", "bounds")
    part = F.lit(0)
    if chunk is not None:
        inner = inner.join(leaf.groupBy("tree").agg(F.count("*").alias("n")), "tree")
        part = F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / (chunk if isinstance(chunk, Column) else F.lit(chunk))))
    return inner.withColumn("part", part.cast("int")).groupBy("tree", "part").agg(F.collect_list(item).alias("nodes")).join(taxa, "tree")


def quartets(table: np.ndarray) -> np.ndarray:
    """Agreeing quartets for tables of counts (sides, parts, ...): pairs in one cell, with pairs in other rows and columns, not both in one."""
    if table.shape[:2] == (3, 3):  # a pair in one of three cells that share neither row nor column, and one in each of the others
        out = 0
        for i, j, k in itertools.permutations(range(3)):
            a, b, c = table[0, i], table[1, j], table[2, k]
            out = out + a * b * c * np.maximum(a + b + c - 3, 0)
        return out // 2
    rows, cols, total = table.sum(1), table.sum(0), table.sum((0, 1))
    square = table * table
    rows2, cols2, cells_r, cells_c = (rows * rows).sum(0), (cols * cols).sum(0), square.sum(1), square.sum(0)
    out = 0 * total
    for i in range(table.shape[0]):
        for k in range(table.shape[1]):
            n = table[i, k]
            left = total - rows[i] - cols[k] + n
            # squares of the other rows without column k, of the other columns without row i, and of the cells in neither
            r2 = rows2 - rows[i] ** 2 - 2 * ((rows * table[:, k]).sum(0) - rows[i] * n) + cells_c[k] - n * n
            c2 = cols2 - cols[k] ** 2 - 2 * ((cols * table[i]).sum(0) - cols[k] * n) + cells_r[i] - n * n
            cell2 = square.sum((0, 1)) - cells_r[i] - cells_c[k] + n * n
            out += n * (n - 1) // 2 * ((left * left - r2 - c2 + cell2) // 2)
    return out


_BITS = 31  # a whole number beyond 64 bits is high * 2**31 + low
_LOW = (1 << _BITS) - 1


def _even(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return high + (low >> _BITS), low & _LOW


def _times(x: tuple[np.ndarray, np.ndarray], n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """x times n, with n < 2**31."""
    return _even(x[0] * n, x[1] * n)


def _product(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return _even(np.zeros_like(a), a * b)


def _twice(table: np.ndarray, leaves: int) -> tuple[np.ndarray, np.ndarray]:
    """Twice the quartets of each table."""
    if table.shape[:2] != (3, 3):
        q = 2 * quartets(table.astype(np.int64 if leaves <= _EXACT_LEAVES else object))
        return (q >> _BITS).astype(np.int64), (q & _LOW).astype(np.int64)
    high, low = 0, 0
    for i, j, k in itertools.permutations(range(3)):
        a, b, c = table[0, i], table[1, j], table[2, k]
        h, m = _times(_times(_product(a, b), c), np.maximum(a + b + c - 3, 0))
        high, low = high + h, low + m
    return _even(high, low)


def _ways(a: np.ndarray, c: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Of a and c leaves by part: u, a * c * (a + c - 3) over different parts, and v, a * c."""
    v = a.sum(0) * c.sum(0) - (a * c).sum(0)
    terms = (_times(_product(a, a), c.sum(0) - c), _times(_product(c, c), a.sum(0) - a))
    u = [sum(x[h].sum(0) for x in terms) for h in (0, 1)]
    v = (v >> _BITS, v & _LOW)
    return _even(u[0] - 3 * v[0], u[1] - 3 * v[1]), v


def _below(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places from begin to end of each node: the node, the place."""
    size = end - begin
    own = np.repeat(np.arange(len(size)), size)
    return own, np.arange(len(own)) - np.repeat(np.cumsum(size) - size - begin, size)


def _shares(nodes: np.ndarray, visits: np.ndarray) -> list[np.ndarray]:
    """Places of the nodes in runs that have _CELLS visits or so."""
    return np.split(np.arange(len(nodes)), np.flatnonzero(np.diff(np.cumsum(visits) // _CELLS)) + 1)


def _lists(nodes: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a row's nodes: numbers, frequencies, how many bounds each has, and all bounds."""
    bounds = nodes.field("bounds")
    return nodes.field("node").to_numpy(), nodes.field("freq").to_numpy(), pc.list_value_length(bounds).to_numpy().astype(np.int64), bounds.flatten().to_numpy().astype(np.int64)


def _by_width(widths: np.ndarray, flat: np.ndarray):
    """Places of the nodes with equally many bounds, and their bounds as a table."""
    first = np.cumsum(widths) - widths
    for w in np.unique(widths):
        at = np.flatnonzero(widths == w)
        yield at, flat[first[at][:, None] + np.arange(w)]


class _Scored:
    """A scored tree of n places, or a part of one, for look-ups: its inner nodes in preorder (an ancestor has a lesser number), -1 for a root that isn't among them."""

    def __init__(self, n: int, ids: np.ndarray, widths: np.ndarray, flat: np.ndarray):
        self.n = n
        first = np.cumsum(widths) - widths
        pre = np.lexsort((-flat[first + widths - 1], flat[first]))
        self.ids, self.widths = ids[pre], widths[pre]
        self.first = np.cumsum(self.widths) - self.widths
        owner = np.repeat(np.arange(len(pre)), self.widths)
        self.flat = flat[np.arange(len(flat)) + (first[pre] - self.first)[owner]]
        self.lo, self.hi = self.flat[self.first], self.flat[self.first + self.widths - 1]
        self.end = np.searchsorted(self.lo, self.hi)  # below a node are those from it on, up to here
        self.gap = np.full(self.n + 1, -1, np.int32)  # the node whose children part before a leaf
        inner = (self.flat > self.lo[owner]) & (self.flat < self.hi[owner])
        self.gap[self.flat[inner]] = owner[inner]
        self.up = np.maximum(self.gap[self.lo], self.gap[self.hi]).astype(np.int64)
        self.key = owner * (self.n + 1) + self.flat
        self.kid = np.full(len(flat), -1)  # beside a child's first bound, its number, -1 for a leaf
        has = np.flatnonzero(self.up >= 0)
        self.kid[np.searchsorted(self.key, self.up[has] * (self.n + 1) + self.lo[has])] = has
        self.least = [self.gap]  # minima over 2**k gaps
        while 1 << len(self.least) <= self.n:
            w = 1 << (len(self.least) - 1)
            self.least.append(np.append(np.minimum(self.least[-1][:-w], self.least[-1][w:]), self.least[-1][-w:]))
        self.least = np.stack(self.least)

    def ancestor(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of leaves a < b: the least of the gaps between them, as an ancestor has the least number."""
        k = np.frexp(b - a)[1] - 1
        return np.minimum(self.least[k, a + 1], self.least[k, b + 1 - (1 << k)])

    def child(self, node: np.ndarray, leaf: np.ndarray) -> np.ndarray:
        return self.kid[np.searchsorted(self.key, node * (self.n + 1) + leaf, side="right") - 1]


class _Weights:
    """Twice the agreeing quartets of each node of a scored tree with the nodes of one gene tree.

    A node s and a gene node g have none unless leaves below g stand on two sides of s, one of them below s. If they stand below two
    children of s, then s is where neighbours among g's leaves (in the scored tree's order) meet: at most as many s as g has leaves,
    and each gets its table of counts. If they stand below one child and outside alone, a quartet takes a leaf of another child, which has b
    leaves of the gene tree, and is counted by b * u + b**2 * v, where u and v are the same on the whole way up to the next
    meeting: they are put down where it begins, taken away where it ends, and summed below each child. So the work is that of g's leaves, summed over all g.

    leaves: of the whole gene tree. at: where those that stand below scored nodes stand in it, rising; place: and in the scored tree. Several
    may stand in one place, which no scored node divides. count: how many stand there, if not one each. of_tree: place and count of
    all leaves of the gene tree, if these are of a part of it.
    """

    def __init__(self, scored: _Scored, leaves: int, at: np.ndarray, place: np.ndarray, count: np.ndarray | None = None, of_tree: tuple[np.ndarray, np.ndarray] | None = None):
        self.t, self.leaves, self.at, self.place, self.count = scored, leaves, at, place, count
        self.of_tree = (place, count) if of_tree is None else of_tree
        self.high, self.low = np.zeros(len(scored.ids), np.int64), np.zeros(len(scored.ids), np.int64)
        self.ways = {"leaf": np.zeros((4, scored.n), np.int64), "node": np.zeros((4, len(scored.ids)), np.int64)}  # u and v, each high and low

    def _way(self, kind: str, at: np.ndarray, parent: np.ndarray, meets: np.ndarray, leaf: np.ndarray, uv: list[np.ndarray]) -> None:
        """From a leaf or node up to where it meets others (below 0: up to the root)."""
        open_ = parent != meets
        ends = open_ & (meets >= 0)
        top = self.t.child(meets[ends], leaf[ends])
        for k, x in enumerate(uv):
            np.add.at(self.ways[kind][k], at[open_], x[open_])
            np.subtract.at(self.ways["node"][k], top, x[ends])

    def add_all(self, freq: np.ndarray, widths: np.ndarray, flat: np.ndarray) -> None:
        for at, bounds in _by_width(widths, flat):
            # so many gene nodes at once that their leaves are _CELLS or so
            visits = np.searchsorted(self.at, bounds[:, -1]) - np.searchsorted(self.at, bounds[:, 0])
            for some in _shares(at, visits):
                self.add(freq[at[some]], bounds[some])

    def add(self, freq: np.ndarray, bounds: np.ndarray) -> None:
        """Gene nodes with equally many children."""
        t, n, (m, p) = self.t, self.t.n, (len(bounds), bounds.shape[1] - 1)
        parts, found = np.diff(bounds, axis=1), np.searchsorted(self.at, bounds)
        own, leaf = _below(found[:, 0], found[:, -1])
        x, part = self.place[leaf], np.repeat(np.arange(m * p), np.diff(found, axis=1).ravel())
        count = None if self.count is None else self.count[leaf]
        order = np.argsort(own * n + x, kind="stable")
        own, x, part, count = own[order], x[order], part[order], None if count is None else count[order]
        key, by_part = own * n + x, part * n + x
        if count is None:
            by_part = np.sort(by_part, kind="stable")
            before = functools.partial(np.searchsorted, by_part)
        else:
            order = np.argsort(by_part, kind="stable")
            by_part, so_far = by_part[order], np.append(0, np.cumsum(count[order]))
            before = lambda k: so_far[np.searchsorted(by_part, k)]
        # from each leaf up
        new = np.append(True, key[1:] != key[:-1])[: len(key)]
        if count is None and new.all():
            k, k2 = parts.sum(1), (parts * parts).sum(1)
            mine = parts.ravel()[part]
            v = k[own] - mine
            u = k2[own] - mine * mine - 2 * v
            u, v = (u >> _BITS, u & _LOW), (v >> _BITS, v & _LOW)
        else:
            a = np.zeros((p, new.sum()), np.int64)
            np.add.at(a, (part % p, np.cumsum(new) - 1), 1 if count is None else count)
            own, x, key = own[new], x[new], key[new]
            u, v = _ways(a, parts[own].T - a)
        meet = np.full(len(x) + 1, -2, np.int64)  # before each place, where it meets the one before it
        again = np.flatnonzero(own[1:] == own[:-1])
        meet[again + 1] = t.ancestor(x[again], x[again + 1])
        uv = [*_times(u, freq[own]), *_times(v, freq[own])]
        self._way("leaf", x, np.maximum(t.gap[x], t.gap[x + 1]), np.maximum(meet[:-1], meet[1:]), x, uv)
        # where leaves meet, and from there up
        met = np.flatnonzero(meet >= 0)
        g, s = np.divmod(np.unique(own[met] * len(t.ids) + meet[met]), max(1, len(t.ids)))
        for w in np.unique(t.widths[s]):
            which = np.flatnonzero(t.widths[s] == w)
            step = max(1, _CELLS // int(w * (p + 1)))
            for a in range(0, len(which), step):
                self._meetings(g[which[a : a + step]], s[which[a : a + step]], int(w) - 1, parts, freq, key, before, meet)

    def _meetings(self, g, s, d, parts, freq, key, count_before, meet) -> None:
        t, n, p = self.t, self.t.n, parts.shape[1]
        bounds = t.flat[t.first[s][:, None] + np.arange(d + 1)]
        before = count_before(((g[:, None] * p + np.arange(p)) * n)[:, :, None] + bounds[:, None, :])
        table = np.empty((d + 1, p + 1, len(g)), np.int64)
        table[:d, :p] = np.diff(before, axis=2).transpose(2, 1, 0)
        table[:d, p] = np.diff(self.before[bounds], axis=1).T - table[:d, :p].sum(1)
        a, k = table[:d, :p].sum(0), parts[g].T
        c = table[d, :p] = k - a
        table[d, p] = self.leaves - k.sum(0) - table[:d, p].sum(0)
        high, low = _times(_twice(table, self.leaves), freq[g])
        np.add.at(self.high, s, high)
        np.add.at(self.low, s, low)
        u, v = _ways(a, c)
        first, last = np.searchsorted(key, g * n + t.lo[s]), np.searchsorted(key, g * n + t.hi[s])
        self._way("node", s, t.up[s], np.maximum(meet[first], meet[last]), t.lo[s], [*_times(u, freq[g]), *_times(v, freq[g])])

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        t = self.t
        leaf, node = (np.concatenate([np.zeros((4, 1), np.int64), np.cumsum(self.ways[x], axis=1)], axis=1) for x in ("leaf", "node"))
        for at, bounds in _by_width(t.widths, t.flat):
            kid = t.kid[t.first[at][:, None] + np.arange(bounds.shape[1] - 1)]
            below = leaf[:, bounds[:, 1:]] - leaf[:, bounds[:, :-1]] + np.where(kid >= 0, node[:, t.end[kid]] - node[:, kid], 0)
            u, v = _even(below[0], below[1]), _even(below[2], below[3])
            b = np.diff(self.before[bounds], axis=1)
            rest, squares = b.sum(1, keepdims=True) - b, (b * b).sum(1, keepdims=True) - b * b
            more = _times(v, squares >> _BITS)  # times 2**31
            for high, low in (_times(u, rest), _times(v, squares & _LOW), ((more[0] << _BITS) + more[1], 0 * b)):
                self.high[at] += high.sum(1)
                self.low[at] += low.sum(1)
        return _even(self.high, self.low)

    @functools.cached_property
    def before(self) -> np.ndarray:
        """Leaves of the gene tree before each place of the scored tree."""
        return np.append(0, np.cumsum(np.bincount(*self.of_tree, self.t.n).astype(np.int64)))


def _half(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of even numbers."""
    return high >> 1, (low + ((high & 1) << _BITS)) >> 1


def _score(hosts: pa.Table, genes: pa.Table) -> pa.Table:
    """tree, node, high, low of every node of the scored trees: agreeing quartets, over the gene trees of the block, as high * 2**31 + low."""
    found = [pa.table([pa.array([], pa.int64())] * 4, names=["tree", "node", "high", "low"])]
    for tree, taxa, nodes in zip(hosts.column("tree").to_pylist(), hosts.column("taxa"), hosts.column("nodes"), strict=True):
        taxa, (ids, _, widths, flat) = taxa.values.to_numpy(), _lists(nodes.values)
        scored, order = _Scored(len(taxa), ids, widths, flat), np.argsort(taxa)
        high, low = np.zeros(len(scored.ids), np.int64), np.zeros(len(scored.ids), np.int64)
        for gene_taxa, gene_nodes in zip(genes.column("taxa"), genes.column("nodes"), strict=True):
            gene_taxa = gene_taxa.values.to_numpy()
            place = order[np.minimum(np.searchsorted(taxa, gene_taxa, sorter=order), len(taxa) - 1)]
            here = np.flatnonzero(taxa[place] == gene_taxa)
            one = _Weights(scored, len(gene_taxa), here, place[here])
            _, freq, widths, flat = _lists(gene_nodes.values)
            one.add_all(freq, widths, flat)
            h, m = one.total()
            high, low = _even(high + h, low + m)
        found.append(pa.table([np.full(len(high), tree, np.int64), scored.ids, *_half(high, low)], names=["tree", "node", "high", "low"]))
    return pa.concat_tables(found)


def summed() -> Column:
    """weight (decimal), from high and low."""
    exact = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    return (exact("high") * F.lit(1 << _BITS).cast("decimal(20,0)") + exact("low")).cast("decimal(38,0)").alias("weight")


def node_weights(hosts: DataFrame, genes: DataFrame) -> DataFrame:
    """tree, node, weight (decimal): agreeing quartets between each node of the scored trees and all partitions of the gene trees.

    Both are rows of trees_as_rows(), a scored tree in one, and are read twice, so they should be kept at hand. They meet in a grid of blocks: about BLOCK_LEAVES leaves of gene trees (or one row) by one scored tree.
    """
    visits = F.aggregate("nodes", F.lit(0).cast("long"), lambda acc, x: acc + F.element_at(x["bounds"], -1) - F.element_at(x["bounds"], 1))
    size = genes.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.size("taxa")), F.lit(0)).alias("leaves"), F.coalesce(F.sum(visits), F.lit(0)).alias("visits"))
    size = size.crossJoin(hosts.agg(F.count("*").alias("hosts"))).first()
    cores = genes.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, -(-size["leaves"] // BLOCK_LEAVES), min(2 * cores, size["rows"], size["visits"] // _WORK))
    cols = max(1, size["hosts"])
    # blocks are few and of unlike work: places enough that most have a task of their own
    spread = lambda df: df.repartition(min(1_000, 3 * blocks * cols), "row", "col")
    seat = lambda n: F.pmod(F.xxhash64("tree", "part"), F.lit(n)).cast("int")
    left = hosts.withColumn("col", seat(cols)).withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select("tree", F.col("taxa").alias("taxa"), F.col("nodes").alias("nodes"), "row", "col")  # new columns, as both may be parts of one table
    right = genes.withColumn("row", seat(blocks)).withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(cols - 1)))).select("taxa", "nodes", "row", "col")
    met = spread(left.withColumn("tree", F.col("tree").cast("long"))).groupBy("row", "col").cogroup(spread(right).groupBy("row", "col"))
    found = met.applyInArrow(_score, "tree long, node long, high long, low long")
    return found.groupBy("tree", "node").agg(summed())


def total(weights: DataFrame) -> DataFrame:
    """One row, quartet_score (decimal), from the weights of a tree's nodes."""
    return weights.agg((F.coalesce(F.sum("weight"), F.lit(0)) / 2).cast("decimal(38,0)").alias("quartet_score"))


def fixed_score(species_nodes: DataFrame, species_leaf: DataFrame, nodes: DataFrame, leaf: DataFrame, partitions: DataFrame | None = None) -> DataFrame:
    """One row, quartet_score (decimal). partitions: of partition_table(), so that equal ones are scored once; else each node is scored."""
    chosen = partitions.select("exemplar.tree", "exemplar.node", "freq") if partitions is not None else None
    hosts, genes = scored(species_nodes, species_leaf), trees_as_rows(nodes, leaf, chosen, chunk=CHUNK_NODES)
    return total(node_weights(hosts.persist(), genes.persist()))


def scored(species_nodes: DataFrame, species_leaf: DataFrame) -> DataFrame:
    """Rows of the nodes of trees to score; a two-sided root repeats what its children have and is left out."""
    kept = species_nodes.withColumn("n_children", F.when(F.col("parent").isNull() & (F.col("n_children") == 2), 0).otherwise(F.col("n_children")))
    return trees_as_rows(kept, species_leaf, root_too=True)
