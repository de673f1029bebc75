"""The weights of a large scored tree's nodes, part by part, so that no task has a whole tree.

A part of a tree is a largest subtree of at most PART_LEAVES leaves; the nodes above the parts are few, unless a tree is like a chain.
A scored node takes from a gene node the numbers of its leaves on each side (see ranges._Weights), so

* the nodes of a scored part need the gene tree's leaves in that part alone, and the gene nodes that have any, cut down to them,
* the nodes above take a gene part at a time, as leaves below one scored part aren't told apart, and then the gene nodes above, for
  which a gene part is a few counts.

A task has a scored part (or what is above) and what one gene tree (or one of its parts) has in it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ranges

PART_LEAVES = 1 << 16
TOP = -1  # in place of a part's first leaf: what is above the parts
_ALL = -1  # in place of a gene part: all of a gene tree

_PIECES = pa.schema([("at", pa.int32()), ("tree", pa.int32()), ("piece", pa.int32()), *[(c, pa.list_(pa.int32())) for c in ("pos", "place", "count", "widths", "bounds")]])
_HELD = pa.schema([("at", pa.int32()), ("ids", pa.list_(pa.int64())), ("widths", pa.list_(pa.int32())), ("bounds", pa.list_(pa.int32()))])
_FOUND = pa.schema([("node", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("high", pa.int64()), ("low", pa.int64())])


def _sql(schema: pa.Schema) -> str:
    kinds = {pa.int32(): "int", pa.int64(): "long", pa.list_(pa.int32()): "array<int>", pa.list_(pa.int64()): "array<long>"}
    return ", ".join(f"{f.name} {kinds[f.type]}" for f in schema)


def _bounds(nodes: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """How many bounds each node has, and all bounds."""
    lists = nodes.column("bounds").combine_chunks()
    return lists.value_lengths().to_numpy().astype(np.int64), lists.flatten().to_numpy().astype(np.int64)


def _pieces(leaves: pa.Table, nodes: pa.Table) -> pa.Table:
    """What each scored part, and what is above them, needs of a gene part."""
    if not leaves.num_rows:
        return _PIECES.empty_table()
    tree, part = (leaves.column(c)[0].as_py() for c in ("tree", "part"))
    pos, place, at = (leaves.column(c).to_numpy() for c in ("pos", "place", "at"))
    order = np.argsort(pos)
    pos, place, at = pos[order], place[order], at[order]
    cells, cell, counts = np.unique(at, return_inverse=True, return_counts=True)
    widths, flat = _bounds(nodes)
    m, first = len(widths), np.cumsum(widths) - widths
    begin, end = np.searchsorted(pos, flat[first]), np.searchsorted(pos, flat[first + widths - 1])
    pairs = [np.zeros(0, np.int64)]  # of a scored part and a node that has leaves in it
    for some in ranges._shares(widths, end - begin):
        own, leaf = ranges._below(begin[some], end[some])
        pairs.append(np.unique(cell[leaf] * m + some[own]))
    which, node = np.divmod(np.sort(np.concatenate(pairs)), max(1, m))
    leaf = np.argsort(cell, kind="stable")
    rows = []
    for k, (mine, kept) in enumerate(zip(np.split(leaf, np.cumsum(counts)[:-1]), np.split(node, np.searchsorted(which, np.arange(1, len(cells)))), strict=True)):
        _, near = ranges._below(first[kept], first[kept] + widths[kept])
        rows.append((cells[k], tree, _ALL, pos[mine], place[mine], np.ones(len(mine), np.int64), widths[kept], flat[near]))
    rows.append((TOP, tree, part, pos, place, np.ones(len(pos), np.int64), widths, flat))
    rows.append((TOP, tree, _ALL, np.full(len(cells), part), cells, counts, widths[:0], flat[:0]))
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_PIECES)], schema=_PIECES)


def _hold(nodes: pa.Table) -> pa.Table:
    """The nodes of a scored part as one row."""
    if not nodes.num_rows:
        return _HELD.empty_table()
    widths, flat = _bounds(nodes)
    return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(([nodes.column("at")[0].as_py()], [nodes.column("node").to_numpy()], [widths], [flat]), _HELD, strict=True)], schema=_HELD)


def _weigh(pieces: pa.Table, held: pa.Table) -> pa.Table:
    """Of the nodes of one row of _hold(): twice the agreeing quartets, over gene nodes of one tree."""
    if not held.num_rows:
        return _FOUND.empty_table()
    ids, widths, flat = (held.column(c)[0].values.to_numpy().astype(np.int64) for c in ("ids", "widths", "bounds"))
    first = np.cumsum(widths) - widths
    places = np.unique(flat)  # between two of them leaves aren't told apart
    scored = ranges._Scored(len(places) - 1, ids, widths, np.searchsorted(places, flat))
    of = lambda table, c: np.concatenate([np.zeros(0, np.int64), *(x.values.to_numpy().astype(np.int64) for x in table.column(c))])

    def standing(place: np.ndarray, *more: np.ndarray) -> list[np.ndarray]:
        """Without leaves that are on no node's inner sides."""
        place = np.searchsorted(places, place, side="right") - 1
        here = (place >= 0) & (place < scored.n)
        return [x[here] for x in (place, *more)]

    place, count, pos = standing(of(pieces, "place"), of(pieces, "count"), of(pieces, "pos"))
    order = np.argsort(pos, kind="stable")
    place, count, pos = place[order], count[order], pos[order]
    of_tree = standing(of(held, "cells"), of(held, "numbers")) if held.column("at")[0].as_py() == TOP else None
    one = ranges._Weights(scored, held.column("leaves")[0].as_py(), pos, place, None if (count == 1).all() else count, of_tree)
    kinds = of(pieces, "widths")
    one.add_all(np.ones(len(kinds), np.int64), kinds, of(pieces, "bounds"))
    of_id = np.argsort(ids)
    mine = of_id[np.searchsorted(ids, scored.ids, sorter=of_id)]
    return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip((scored.ids, flat[first[mine]], flat[(first + widths - 1)[mine]], *ranges._half(*one.total())), _FOUND, strict=True)], schema=_FOUND)


def roots(inner: DataFrame) -> DataFrame:
    """tree, leaves."""
    return inner.filter("is_root").select("tree", F.element_at("bounds", -1).alias("leaves"))


def node_weights(inner: DataFrame, leaf: DataFrame, scored: int) -> DataFrame:
    """node, lo, hi, weight (decimal): agreeing quartets between each node of the tree of that number and all inner nodes of the others but their roots.

    inner: of ranges.bounded(), roots too; leaf: tree, pos, taxon, of all trees. Both are read several times, so they should be kept
    at hand. A two-sided root of the scored tree repeats what its children have and is left out.
    """
    size = F.element_at("bounds", -1) - F.element_at("bounds", 1)
    inner = inner.withColumn("tree", F.col("tree").cast("int")).withColumn("lo", F.element_at("bounds", 1)).withColumn("high", size > PART_LEAVES)
    is_scored = F.col("tree") == scored
    bits = ranges.STRETCH.bit_length() - 1
    kids = inner.filter("high").selectExpr("tree", "explode(transform(sequence(1, size(bounds) - 1), i -> struct(get(bounds, i - 1) AS lo, get(bounds, i) AS hi))) AS k").select("tree", "k.*")
    parts = kids.filter(F.col("hi") - F.col("lo") <= PART_LEAVES).unionByName(inner.filter("is_root AND NOT high").select("tree", "lo", F.element_at("bounds", -1).alias("hi")))
    by = parts.select("tree", F.col("lo").alias("part"), "hi", F.explode(F.sequence(F.shiftright("lo", bits), F.shiftright(F.col("hi") - 1, bits))).alias("stretch"))

    def placed(rows: DataFrame, pos: str) -> DataFrame:
        found = rows.withColumn("stretch", F.shiftright(pos, bits)).join(by, ["tree", "stretch"])
        return found.filter((F.col(pos) >= F.col("part")) & (F.col(pos) < F.col("hi"))).drop("stretch", "hi")

    spark = inner.sparkSession
    genes = inner.filter(~is_scored & ~F.col("is_root"))
    work = genes.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0] // ranges._WORK  # parts are of unlike work: places enough that most have a task of their own
    tasks = min(1 + work, max(10 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    # new columns, as both sides are parts of one table
    together = lambda df, *keys: df.select(*[F.col(c).alias(c) for c in df.columns]).repartition(tasks, *keys).groupBy(*keys)
    at = placed(leaf.select(F.col("tree").cast("int").alias("tree"), F.col("pos").cast("int").alias("pos"), "taxon"), "pos")
    here = at.filter(is_scored).select("taxon", F.col("pos").alias("place"), F.col("part").alias("at"))
    leaves = at.filter(~is_scored).join(here, "taxon").select("tree", "part", "pos", "place", "at").persist()
    low = placed(genes.filter("NOT high").select("tree", "lo", "bounds"), "lo").select("tree", "part", "bounds")
    pieces = together(leaves, "tree", "part").cogroup(together(low, "tree", "part")).applyInArrow(_pieces, _sql(_PIECES))

    # gene nodes above the parts, which all need
    cells = parts.filter(is_scored).select(F.col("lo").alias("at"))
    top = spark.range(1, numPartitions=1).select(F.lit(TOP).alias("at"))
    none = F.array().cast("array<int>")
    above = genes.filter("high").crossJoin(F.broadcast(cells.unionByName(top))).select("at", "tree", F.lit(_ALL).alias("piece"), *[none.alias(c) for c in ("pos", "place", "count")], F.array(F.size("bounds")).alias("widths"), "bounds")

    own = inner.filter(is_scored & ~(F.col("is_root") & (F.size("bounds") == 3))).select("tree", "node", "lo", "bounds", "high")
    own = placed(own.filter("NOT high"), "lo").select(F.col("part").alias("at"), "node", "bounds").unionByName(own.filter("high").select(F.lit(TOP).alias("at"), "node", "bounds"))
    trees = roots(inner).filter(~is_scored)
    gene_parts = parts.filter(~is_scored).select("tree", F.col("lo").alias("piece")).unionByName(trees.select("tree", F.lit(_ALL).alias("piece")))
    numbers = leaves.groupBy("tree", "at").agg(F.count("*").cast("int").alias("n")).groupBy("tree").agg(F.sort_array(F.collect_list(F.struct("at", "n"))).alias("x")).select("tree", F.col("x.at").alias("cells"), F.col("x.n").alias("numbers"))
    needed = trees.crossJoin(F.broadcast(cells.withColumn("piece", F.lit(_ALL)))).withColumns({c: none for c in ("cells", "numbers")})
    needed = needed.unionByName(trees.join(gene_parts, "tree").join(numbers, "tree").withColumn("at", F.lit(TOP)).select(needed.columns))
    held = own.groupBy("at").applyInArrow(_hold, _sql(_HELD)).join(needed, "at")

    keys = ("at", "tree", "piece")
    found = together(pieces.unionByName(above), *keys).cogroup(together(held, *keys)).applyInArrow(_weigh, _sql(_FOUND))
    return found.groupBy("node", "lo", "hi").agg(ranges.summed())
