"""Queries on growing collections, on tables unlike those of the smallest scale."""

from __future__ import annotations

import datetime
import math
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from grovekit.operators import ranges
from grovekit.plans import registry
from grovekit.sources import derived


@pytest.fixture(scope="module")
def complete(spark, tmp_path_factory):
    """Tables whose second day has an order of every nation, so that its tree is complete."""
    d = str(tmp_path_factory.mktemp("complete"))
    spark.range(25).select(F.col("id").cast("int").alias("n_nationkey"), F.lit(0).alias("n_regionkey")).write.parquet(f"{d}/nation.parquet")
    spark.range(25).select(F.col("id").alias("c_custkey"), F.col("id").cast("int").alias("c_nationkey")).write.parquet(f"{d}/customer.parquet")
    orders = [(k, datetime.datetime(1995, 3, day)) for day, of in ((1, range(3, 9)), (2, range(25)), (3, [*range(20), 5, 5, 7])) for k in of]
    rows = [(i, k, at) for i, (k, at) in enumerate(orders)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz").write.parquet(f"{d}/orders.parquet")
    return d


def same_as_sql(spark, name, d):
    con = duckdb.connect()
    for t in ("orders", "customer", "nation"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet/*.parquet'")
    df = registry.queries()[name](spark, d)
    columns = sorted(df.columns)
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({registry.oracle_sql()[name]})").fetchall()
    got = sorted(tuple(r) for r in df.select(*columns).collect())
    assert got == sorted(want)
    return got


@pytest.mark.parametrize("name", ["h4_clusters_by_day", "h5_transitions_by_day", "h6_tripartitions_by_day", "t14_fixed_score_by_day"])
def test_complete_trees_by_day(spark, complete, name):
    rows = same_as_sql(spark, name, complete)
    assert len(set(rows)) == len(rows) > 0


def _rows(taxa, nodes):
    """A tree as trees_as_rows() has it; nodes: bounds."""
    kind = pa.list_(pa.struct([("node", pa.int64()), ("freq", pa.int64()), ("bounds", pa.list_(pa.int32()))]))
    return pa.table({"tree": [0], "taxa": pa.array([taxa], pa.list_(pa.int32())), "nodes": pa.array([[{"node": i, "freq": 1, "bounds": b} for i, b in enumerate(nodes)]], kind)})


def _balanced(n):
    """Bounds of all binary nodes of blocks but the root."""
    widths = [1 << k for k in range(n.bit_length())]
    return [[lo, lo + w, min(n, lo + 2 * w)] for w in widths for lo in range(0, n, 2 * w) if lo + w < n and min(n, lo + 2 * w) - lo < n]


def _total(rows):
    return sum((h << 31) + low for h, low in zip(rows["high"].to_pylist(), rows["low"].to_pylist(), strict=True))


def test_weights_of_large_trees():
    """Tens of thousands of leaves, which a table of counts for each pair of nodes would take many minutes for."""
    n = 50_001
    r, nodes = random.Random(2), _balanced(n)
    mixed = r.sample(range(n), n)
    a, b = _rows(list(range(n)), nodes), _rows(mixed, nodes)
    assert _total(ranges._score(a, a)) == 2 * math.comb(n, 4)
    some = _total(ranges._score(a, b))
    assert some == _total(ranges._score(b, a)) and 0.33 < some / (2 * math.comb(n, 4)) < 0.34


def _tree(r, taxa, kids):
    """Taxa in order, and bounds of the inner nodes, the root's first."""
    forest = list(taxa)
    while len(forest) > 1:
        k = min(len(forest), r.choice(kids))
        if r.random() < 0.7:
            r.shuffle(forest)
        forest = [tuple(forest[:k]), *forest[k:]]
    order, nodes = [], []

    def walk(x):
        begin = len(order)
        if isinstance(x, tuple):
            at = len(nodes)
            nodes.append(None)
            nodes[at] = [walk(c) for c in x]
            nodes[at].append(len(order))
        else:
            order.append(x)
        return begin

    walk(forest[0])
    return order, nodes


def test_weights_by_definition():
    """Trees of any degree over different taxa, against a table of counts for each pair of nodes."""
    r = random.Random(5)
    for _ in range(25):
        (own, nodes), (taxa, gene) = (_tree(r, r.sample(range(20), r.randint(5, 18)), kids) for kids in ((2, 2, 3), r.choice([(2,), (2, 3, 5)])))
        nodes, gene = nodes if len(nodes[0]) > 3 else nodes[1:], gene[1:]
        side = lambda b, at: next((j for j in range(len(b) - 1) if at is not None and b[j] <= at < b[j + 1]), len(b) - 1)
        where = [own.index(t) if t in own else None for t in taxa]
        want = []
        for b in nodes:
            total = 0
            for g in gene:
                table = np.zeros((len(b), len(g), 1), np.int64)
                for i, at in enumerate(where):
                    table[side(b, at), side(g, i), 0] += 1
                total += int(ranges.quartets(table)[0])
            want.append(total)
        got = ranges._score(_rows(own, nodes), _rows(taxa, gene)).to_pylist()
        assert [(x["high"] << 31) + x["low"] for x in sorted(got, key=lambda x: x["node"])] == want


def test_node_tables_are_not_broadcast(spark):
    """Exploded rows look as few as the trees they come from."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "64k")
    try:
        leaf = spark.range(40_000).select(F.lit(0).alias("tree"), F.col("id").cast("int").alias("pos"), F.col("id").cast("int").alias("taxon")).repartition(4, "pos")
        df = derived.block_ranges(leaf).join(leaf.select("tree", F.col("pos").alias("lo"), "taxon"), ["tree", "lo"])
        assert len(df.collect()) == 79_999
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.fixture(scope="module")
def few(spark, tmp_path_factory):
    """Customers of three nations and of none, who order in some of three years, and an order without a date."""
    d, r = str(tmp_path_factory.mktemp("few")), random.Random(3)
    spark.range(25).select(F.col("id").cast("int").alias("n_nationkey"), F.lit(0).alias("n_regionkey")).write.parquet(f"{d}/nation.parquet")
    spark.createDataFrame([(k, r.choice([None, 4, 2, 9])) for k in range(40)], "c_custkey long, c_nationkey int").write.parquet(f"{d}/customer.parquet")
    rows = [(i, r.choice([0, *range(3, 40)]), datetime.datetime(r.choice([1995, 1996, 1998]), 3, 1)) for i in range(60)]
    spark.createDataFrame([*rows, (60, 2, None)], "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz").write.parquet(f"{d}/orders.parquet")
    return d


@pytest.mark.parametrize("name", ["a1_clusters_of_customers", "a4_tripartitions_of_customers", "h7_node_weights_of_customers", "t19_fixed_score_of_customers", "j9_ancestors_of_customers"])
def test_customers_without_a_nation_stand_last(spark, few, name):
    assert same_as_sql(spark, name, few)


def _times_made(df):
    """How often a plan makes a tree's blocks."""
    return df._jdf.queryExecution().executedPlan().toString().count("Generate explode(sequence((k")


def test_clusters_make_their_nodes_once(spark, few):
    """One table of nodes gets both sides' sums; beforehand the roots and exemplars were looked up besides."""
    assert _times_made(registry.queries()["a1_clusters_of_customers"](spark, few)) == 1


def test_tripartitions_make_their_nodes_once(spark, few):
    """A node and its children come together in one exchange."""
    assert _times_made(registry.queries()["a4_tripartitions_of_customers"](spark, few)) == 1


def test_rows_of_trees_make_their_nodes_once(spark, few):
    leaf = derived.customer_leaves(spark, few)
    assert _times_made(ranges.trees_as_rows(derived.block_ranges(leaf), leaf)) == 1
    assert _times_made(ranges.trees_as_rows(derived.block_ranges(leaf), leaf, chunk=4)) == 1


@pytest.mark.parametrize(("bits", "levels"), [(1, 20), (1, 5), (1, 3), (2, 6), (3, 2)])
def test_blocks_by_definition(spark, bits, levels):
    """Nodes, parents, levels and children from the blocks themselves."""
    sizes = [1, 2, 3, 5, 8, 9, 16, 17, 31, 33, 64, 100, 129]
    leaf = spark.createDataFrame([(t, p, p) for t, n in enumerate(sizes) for p in range(n)], "tree int, pos int, taxon int")
    want = set()
    for t, n in enumerate(sizes):
        nodes = [(lv, b, b << lv * bits, min(n, (b + 1) << lv * bits)) for lv in range(levels + 1) for b in range(n) if b << lv * bits < n]
        nodes = [x for x in nodes if x[0] == 0 or x[3] - x[2] > 1 << (x[0] - 1) * bits]
        number = lambda x: x[0] * (1 << 40) + x[1]
        ups = {x: sorted(y for y in nodes if y[0] > x[0] and y[2] <= x[2] and y[3] >= x[3]) for x in nodes}
        kids = {x: sorted((y for y in nodes if ups[y] and ups[y][0] == x), key=lambda y: y[2]) for x in nodes}
        for x in nodes:
            up = ups[x][0] if ups[x] else None
            want.add((t, number(x), up and number(up), len(ups[x]), x[2], x[3], len(kids[x]), kids[up].index(x) if up else 0))
    got = derived.block_ranges(leaf, bits, levels).select("tree", "node", "parent", "lvl", "lo", "hi", "n_children", "child_ord").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
