"""Hard negatives by vantage-point trees over norm-augmented vectors.

A vector x of a block gets one more component, sqrt(M*M - |x|*|x|) with the block's largest norm M; an anchor q gets a
zero. Then the squared distance is |q|*|q| + M*M - 2 q.x: a higher score is a smaller distance, and a window of scores is an
annulus around the anchor. A tree's node knows the least and greatest distance from its vantage point to what is below it,
which bounds the distances, and so the scores, seen from the anchor. The traversal is incremental: a heap holds nodes by
the best score they can have and rows by their scores, nodes outside the annulus never enter, and rows come out nearest
first, ties by identifier, until k have the wanted label.

Anchors meet all rows in a grid: blocks of rows (one tree each) by blocks of anchors, both of bounded size. A block gives at
most k rows for each anchor or window, of which a ranked window keeps the best k. First come the positives, then the
windows that follow from their scores. Scores are exact integers.
"""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, fields

LEAF = 512
BLOCK_CELLS = 1 << 21  # components in a block of rows, and a quarter of them in a block of anchors
_LEAST_ROWS = 512
_MOST = (1 << 63) - 1
_FOUND = fields("anchor long, pair long, score long, vec_id long")


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """The vectors as rows of doubles, each component as floor(256 x); shorter ones are filled up with zeros."""
    col = column.combine_chunks()
    values = np.floor(256.0 * np.asarray(col.flatten(), dtype=np.float64))
    ends = np.cumsum(np.asarray(col.value_lengths(), dtype=np.int64))
    lengths = np.diff(ends, prepend=0)
    wide = int(lengths.max(initial=0))
    if len(lengths) and (lengths == wide).all():
        return values.reshape(len(lengths), wide)
    out = np.zeros((len(lengths), wide))
    out[np.arange(wide) < lengths[:, None]] = values
    return out


class VPTree:
    """Rows with identifiers and labels, for traversal in the order of their scores with a query."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, labels: np.ndarray, leaf: int = LEAF):
        self.x, self.ids, self.labels, self.leaf = x, ids, labels, leaf
        with np.errstate(over="ignore"):
            self.norms = np.einsum("ij,ij->i", x, x)
        self.top = float(self.norms.max(initial=0.0))  # M * M
        self.exact = self.top < 2.0**52  # else sums of products may need more than a double has
        self._more = np.sqrt(np.maximum(self.top - self.norms, 0)) if self.exact else None
        self.root = self._node(np.arange(len(x))) if self.exact else np.arange(len(x))

    def _node(self, rows: np.ndarray):
        """A leaf is an array of rows, an inner node (vantage point, ((least, greatest distance, node), ...))."""
        if len(rows) <= self.leaf:
            return rows
        v = rows[len(rows) // 2]
        d = np.sqrt(np.maximum(self.norms[rows] + self.norms[v] - 2 * (self.x[rows] @ self.x[v]) + self._more[rows] ** 2 + self._more[v] ** 2 - 2 * self._more[rows] * self._more[v], 0))
        half = np.partition(d, len(d) // 2)[len(d) // 2]
        inner = d < half
        if not inner.any():
            inner = d <= half
        if inner.all():
            return rows  # they are all alike
        return v, tuple((float(d[s].min()), float(d[s].max()), self._node(rows[s])) for s in (inner, ~inner))

    def _scores(self, rows: np.ndarray, q: np.ndarray) -> np.ndarray:
        if self.exact and float(q @ q) < 2.0**52:
            return (self.x[rows] @ q).astype(np.int64)
        whole = [int(c) for c in q]
        return np.array([max(-_MOST, min(_MOST, sum(a * int(b) for a, b in zip(whole, self.x[i], strict=True) if b))) for i in rows], dtype=np.int64)

    def nearest(self, q: np.ndarray, accept: Callable[[np.ndarray], np.ndarray], low: int | None, high: int | None, seen: dict) -> Iterator[tuple[int, int]]:
        """(score, identifier) of accepted rows with low <= score <= high, higher scores first. seen keeps a query's leaf scores."""
        at_zero = float(q @ q) + self.top
        slack = 1 + 1e-6 * at_zero**0.5 + 1e-9 * at_zero  # rounding never hides a row
        count = itertools.count()
        heap = [(-np.inf, 0, 0, self.root, 0.0, np.inf)]
        if not (self.exact and at_zero < 2.0**52):
            heap = [(-np.inf, 0, 0, np.arange(len(self.x)), 0.0, np.inf)]  # one leaf, in whole numbers
        while heap:
            top = heapq.heappop(heap)
            if top[1]:  # the next row of a leaf
                key, _, ident, rest, scores, ids = top
                yield -key, ident
                if rest < len(ids):
                    heapq.heappush(heap, (-int(scores[rest]), 1, int(ids[rest]), rest + 1, scores, ids))
                continue
            _, _, _, node, near, far = top
            if isinstance(node, np.ndarray):
                key = id(node) if len(node) != len(self.x) else -1
                if key not in seen:
                    seen[key] = self._scores(node, q)
                s = seen[key]
                ok = accept(node)
                if low is not None:
                    ok &= s >= low
                if high is not None:
                    ok &= s <= high
                if ok.any():
                    ids, s = self.ids[node][ok], s[ok]
                    order = np.lexsort((ids, -s))
                    ids, s = ids[order], s[order]
                    heapq.heappush(heap, (-int(s[0]), 1, int(ids[0]), 1, s, ids))
                continue
            v, sides = node
            d = max(at_zero - 2 * float(self.x[v] @ q), 0.0) ** 0.5
            for least, greatest, kid in sides:
                n, f = max(near, d - greatest, least - d), min(far, d + greatest)
                best, worst = (at_zero - n * n) / 2 + slack, (at_zero - f * f) / 2 - slack
                if (low is None or best >= low) and (high is None or worst <= high):
                    heapq.heappush(heap, (-best, 0, next(count), kid, n, f))


def _tree(rows: pa.Table) -> tuple[VPTree, np.ndarray]:
    part = rows.sort_by("uid")
    uids, ids, labels = (np.asarray(part.column(c), dtype=np.int64) for c in ("uid", "vec_id", "label"))
    return VPTree(_matrix(part.column("vector")), ids, labels), uids


def _fitted(q: np.ndarray, wide: int) -> tuple[np.ndarray, int]:
    """Queries and rows with the same number of components."""
    most = max(q.shape[1], wide)
    return np.pad(q, ((0, 0), (0, most - q.shape[1]))), most


def _table(rows: list[tuple]) -> pa.Table:
    cols = zip(*rows, strict=True) if rows else ([], [], [], [])
    return pa.table([pa.array(c, pa.int64()) for c in cols], names=_FOUND.names)


def _search(k: int, negatives: bool):
    """For a block of rows and a block of anchors: the best k positives, or the best k of each window."""

    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if rows.num_rows and anchors.num_rows:
            tree, uids = _tree(rows)
            queries, wide = _fitted(_matrix(anchors.column("vector")), tree.x.shape[1])
            tree.x = np.pad(tree.x, ((0, 0), (0, wide - tree.x.shape[1])))
            windows = anchors.column("windows").to_pylist() if negatives else itertools.repeat([None])
            for uid, label, q, asked in zip(anchors.column("uid").to_pylist(), anchors.column("label").to_pylist(), queries, windows, strict=False):
                seen: dict = {}
                for pair in asked:
                    if negatives:
                        found = tree.nearest(q, lambda r, x=label: tree.labels[r] != x, -(-80 * pair // 100), pair, seen)
                    else:
                        found = tree.nearest(q, lambda r, x=label, u=uid: (tree.labels[r] == x) & (uids[r] != u), None, None, seen)
                    out += [(uid, pair or 0, s, i) for s, i in itertools.islice(found, k)]
        return _table(out)

    return run


def _grid(rows: DataFrame, anchors: DataFrame, k: int, negatives: bool, row_blocks: int, anchor_blocks: int) -> DataFrame:
    """Every block of rows with every block of anchors; of what they find, the best k of each anchor and window."""
    block = lambda n: F.pmod(F.xxhash64("uid"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.select("uid", "vec_id", "label", "vector", block(row_blocks).alias("rb"), every(anchor_blocks).alias("ab"))
    right = anchors.select(*anchors.columns, block(anchor_blocks).alias("ab"), every(row_blocks).alias("rb"))
    found = left.groupBy("rb", "ab").cogroup(right.groupBy("rb", "ab")).applyInArrow(_search(k, negatives), _FOUND)
    rank = F.row_number().over(Window.partitionBy("anchor", "pair").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, n_positives: int = 5, k: int = 5, anchor_every: int = 100) -> DataFrame:
    """Rows anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    vectors: vec_id, embedding, label. Rows with a null in any of them, or a null or non-finite component, take no part. A
    label is replaced by (label + 1) % 10 where 7 divides vec_id. Vectors of different lengths are compared as if the shorter
    ended in zeros; a score beyond 64 bits counts as the nearest number that fits. Of repeated rows each takes part, as an anchor too,
    and another row of the same vec_id isn't the anchor itself. An empty table gives an empty result, as does one without
    anchors. Other columns are ignored.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "negatives")
    v = F.col("embedding")
    fine = F.forall(v, lambda c: F.coalesce((F.abs(c) < float("inf")) & ~F.isnan(c), F.lit(False)))
    label = F.col("label").cast("long")
    rows = vectors.filter(v.isNotNull() & F.col("label").isNotNull() & F.col("vec_id").isNotNull() & fine).select(
        F.monotonically_increasing_id().alias("uid"), F.col("vec_id").cast("long").alias("vec_id"), F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"), v.alias("vector")
    )
    rows = scratch.keep(rows)
    anchors = rows.filter(F.col("vec_id") % anchor_every == 0)
    n, a, wide = rows.agg(F.count("*"), F.count(F.when(F.col("vec_id") % anchor_every == 0, 1)), F.max(F.size("vector"))).first()
    in_block = max(16, BLOCK_CELLS // max(1, wide or 1))
    row_blocks = max(1, -(-n // in_block), min(int(spark.conf.get("spark.sql.shuffle.partitions")), n // _LEAST_ROWS))
    anchor_blocks = max(1, -(-4 * a // in_block))
    found = _grid(rows, anchors, n_positives, False, row_blocks, anchor_blocks)
    positives = scratch.keep(found.select(F.col("anchor").alias("uid"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    # a window needs a score of at least 0: below, no number is between four fifths of it and itself
    windows = positives.filter("positive_score >= 0").groupBy("uid").agg(F.collect_set("positive_score").alias("windows"))  # n_positives at most
    asked = scratch.keep(anchors.join(windows, "uid"))
    best = _grid(rows, asked, k, True, row_blocks, anchor_blocks)
    best = best.select(F.col("anchor").alias("uid"), F.col("pair").alias("positive_score"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = positives.join(anchors.select("uid", F.col("vec_id").alias("anchor_id")), "uid")
    out = scratch.keep(named.join(best, ["uid", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
    scratch.only(out)
    return out


ORACLE = """
    WITH v AS (
        SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
        FROM embeddings
        WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (
        SELECT a.vec_id AS anchor_id, v.vec_id AS id, v.label = a.label AS same, list_inner_product(a.q, v.q)::BIGINT AS score
        FROM v AS a JOIN v ON a.vec_id <> v.vec_id WHERE a.vec_id % 100 = 0),
    p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
    SELECT anchor_id, positive_id, row_number() OVER w AS rank, id AS negative_id, positive_score, score AS negative_score
    FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
    WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)
    QUALIFY row_number() OVER w <= 5
"""
