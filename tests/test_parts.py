"""Weights of a tree's nodes part by part, against the same on whole trees, SQL and closed forms."""

from __future__ import annotations

import datetime
import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from grovekit.functions.masks import Masks
from grovekit.operators import parts, ranges
from grovekit.plans import registry
from grovekit.sources import newick
from test_ranges import random_tree

QUERIES = ["h7_node_weights_of_customers", "t19_fixed_score_of_customers"]


@pytest.fixture(autouse=True)
def nothing_kept(spark):
    yield
    spark.catalog.clearCache()


def tables(spark, d, customers, orders):
    """customers: number, nation; orders: customer, year."""
    spark.range(25).select(F.col("id").cast("int").alias("n_nationkey"), F.lit(0).alias("n_regionkey")).write.parquet(f"{d}/nation.parquet")
    customers.write.parquet(f"{d}/customer.parquet")
    orders.write.parquet(f"{d}/orders.parquet")
    return d


@pytest.fixture(scope="module")
def some(spark, tmp_path_factory):
    """70 customers, of whom most order in each of three years."""
    r = random.Random(7)
    customers = spark.createDataFrame([(k, r.choice([None, 4, 2, 9])) for k in range(70)], "c_custkey long, c_nationkey int")
    orders = [(i, r.randrange(70), datetime.datetime(r.choice([1995, 1996, 1998]), 3, 1)) for i in range(300)]
    return tables(spark, str(tmp_path_factory.mktemp("some")), customers, spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz"))


@pytest.mark.parametrize("name", QUERIES)
@pytest.mark.parametrize("leaves", [6, 1 << 16])
def test_parts_of_any_size_give_what_sql_gives(spark, some, name, leaves, monkeypatch):
    monkeypatch.setattr(parts, "PART_LEAVES", leaves)
    con = duckdb.connect()
    for t in ("orders", "customer"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{some}/{t}.parquet/*.parquet'")
    df = registry.queries()[name](spark, some)
    want = con.sql(f"SELECT {', '.join(df.columns)} FROM ({registry.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(want)
    assert df.dtypes[-1][1] == "bigint"


@pytest.mark.parametrize("name", QUERIES)
def test_no_task_has_a_whole_tree(spark, some, name):
    """Beforehand all taxa of a tree stood in one row."""
    plan = registry.queries()[name](spark, some)._jdf.queryExecution().executedPlan().toString()
    assert "collect_list(struct(pos" not in plan and "CartesianProduct" not in plan


def test_more_quartets_than_a_bigint_holds(spark, tmp_path, monkeypatch):
    """Beforehand the last step failed. All customers order in one year, so that its tree is the scored one and each quartet agrees."""
    n = 125_000
    assert math.comb(n, 4) > 2**63
    monkeypatch.setattr(parts, "PART_LEAVES", 1 << 14)
    orders = spark.range(n).select(F.col("id").alias("o_orderkey"), F.col("id").alias("o_custkey"), F.lit(datetime.datetime(1995, 3, 1)).cast("timestamp_ntz").alias("o_orderdate"))
    d = tables(spark, str(tmp_path), spark.range(n).select(F.col("id").alias("c_custkey"), (F.col("id") % 25).cast("int").alias("c_nationkey")), orders)
    assert int(registry.queries()["t19_fixed_score_of_customers"](spark, d).first()[0]) == math.comb(n, 4)


@pytest.mark.parametrize(("text", "leaves"), [("((((0,1),2),(3,4)),(5,6),(7,8));", 2), ("(((((((0,5),3),(1,8)),4),2),6),7);", 1), ("((0,3,6,7),(1,2,(4,5,8)));", 4)])
def test_parts_of_trees_of_any_form(spark, text, leaves, monkeypatch):
    """Gene trees of any degree that lack taxa, against whole trees."""
    r, n = random.Random(text), 9
    masks = Masks(n)
    names = spark.range(n).select(F.col("id").cast("int").alias("taxon"), F.col("id").cast("string").alias("name"))
    texts = [text, *(random_tree(r, r.sample(range(n), r.randint(4, n))) for _ in range(8))]
    nodes = newick.parse(newick.from_lines(spark, texts), names, masks).cache()
    leaf = newick.leaf_table(nodes).cache()
    first = nodes.agg(F.min("tree")).first()[0]
    of = lambda df, keep: df.filter((F.col("tree") == first) == keep)
    hosts = ranges.scored(of(nodes, True), of(leaf, True))
    ends = {x["node"]: (x["bounds"][0], x["bounds"][-1]) for row in hosts.collect() for x in row["nodes"]}
    want = {(x["node"], *ends[x["node"]], x["weight"]) for x in ranges.node_weights(hosts, ranges.trees_as_rows(of(nodes, False), of(leaf, False))).collect()}
    inner = ranges.bounded(nodes, root_too=True).cache()
    monkeypatch.setattr(parts, "PART_LEAVES", leaves)
    got = parts.node_weights(inner, leaf, first).collect()
    assert {tuple(x) for x in got} == want and len(got) == len(want) > 0
