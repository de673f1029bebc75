"""Registered queries on collections that grow with the tables: a tree per order day (25 taxa), and a tree per order year whose taxa are customers.

Sets are ranges and signatures throughout (see operators.ranges); masks and sums of taxa are made at the end, for the comparison alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import ancestors, parts, ranges
from ..sources import derived
from ..sources.durable import Rounds
from .registry import _FULL, _KIDS, _PARTS, _SP, _TERM, _TRANS, _TRIPLES, MASKS, _cte, query

_DAY = """
    counted AS (
        SELECT CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS INT) AS tree, c_nationkey AS taxon, count(*) AS c
        FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
    dleaf AS (SELECT tree, taxon, CAST(row_number() OVER (PARTITION BY tree ORDER BY c DESC, taxon) - 1 AS INT) AS pos FROM counted),
    label_leaf AS (SELECT 0 AS tree, n_nationkey AS taxon, n_nationkey AS pos FROM nation)"""
_DAY_NODE, _DAY_SPECIES = _cte("node", 1, 5, "dleaf"), _cte("sp", 1, 5, "label_leaf")


def _days(*parts: str) -> str:
    return "WITH RECURSIVE " + ",".join((_DAY, *parts))


_CUSTOMERS = """
    ordered AS (SELECT DISTINCT CAST(year(o_orderdate) AS INT) AS tree, CAST(o_custkey AS INT) AS taxon, c_nationkey AS nation FROM orders JOIN customer ON o_custkey = c_custkey),
    wleaf AS (SELECT tree, taxon, row_number() OVER (PARTITION BY tree ORDER BY nation, taxon) - 1 AS pos FROM ordered),
    cleaf AS (SELECT 0 AS tree, taxon, row_number() OVER (ORDER BY nation, taxon) - 1 AS pos FROM (SELECT DISTINCT taxon, nation FROM ordered))"""


def _sets(name: str, leaf: str) -> str:
    """Nodes with their taxa as a sorted list and a bit string (customers of the scale at which results are compared)."""
    return f"""
    {name}_b AS (
        SELECT tree, l, min(pos) AS lo, max(pos) + 1 AS hi, count(*) AS size, list(taxon ORDER BY taxon) AS s, bitstring_agg(taxon, 0, 2047) AS bits
        FROM {leaf}, (SELECT unnest(range(21)) AS l) GROUP BY tree, l, pos >> l),
    {name}_k AS (SELECT * FROM {name}_b WHERE l = 0 OR size > (1 << (l - 1))),
    {name}_r AS (SELECT tree, max(size) AS n FROM {name}_k GROUP BY tree),
    {name} AS (
        SELECT c.tree, c.l, c.lo, c.hi, c.size, c.s, c.bits, CASE WHEN c.size < r.n THEN (SELECT min((p.size, p.lo, p.hi)) FROM {name}_k p WHERE p.tree = c.tree AND p.lo <= c.lo AND p.hi >= c.hi AND p.size > c.size) END AS up
        FROM {name}_k c JOIN {name}_r r USING (tree))"""


def _wide(*parts: str) -> str:
    return "WITH " + ",".join((_CUSTOMERS, *parts))


_SUMS = "len(s) AS sz, list_sum(s)::BIGINT AS taxon_sum, list_sum(list_transform(s, lambda x: x::BIGINT * x))::BIGINT AS taxon_sq"


def _masks(table: DataFrame, leaf: DataFrame) -> DataFrame:
    """sig, mask of each exemplar."""
    each = table.select("sig", "exemplar.*").withColumn("pos", F.explode(F.sequence("lo", F.col("hi") - 1)))
    own = each.join(leaf, ["tree", "pos"]).groupBy("sig", "comp").agg(MASKS.union_of("taxon").alias("m"))
    return own.select("sig", F.when(F.col("comp"), MASKS.rest(F.col("m"))).otherwise(F.col("m")).alias("mask"))


def _day_nodes(spark, d):
    leaf = derived.leaves(spark, d, by_day=True)
    return derived.block_ranges(leaf, levels=5), leaf


@query(_days(_DAY_NODE) + f" SELECT mask, CAST(bit_count(mask) AS BIGINT) AS sz, count(*) AS freq FROM (SELECT unnest([mask, {_FULL} & ~mask]) AS mask FROM node WHERE psize IS NOT NULL) WHERE mask NOT IN (0, {_FULL}) GROUP BY mask")
def h4_clusters_by_day(spark, d):
    """Clusters keyed by signature, with the complement within all taxa by subtraction."""
    nodes, leaf = _day_nodes(spark, d)
    table = ranges.cluster_table(ranges.signed(nodes, leaf))
    return table.join(_masks(table, leaf), "sig").select("mask", "sig.sz", "freq")


@query(_days(_DAY_NODE, _KIDS.format(n="node")) + _TRANS.format(n="node") + " SELECT * FROM trans")
def h5_transitions_by_day(spark, d):
    """Divisions whose three sets are signatures, each found by arithmetic on others."""
    nodes, leaf = _day_nodes(spark, d)
    rows = ranges.signed(nodes, leaf)
    known = _masks(ranges.cluster_table(rows.withColumn("parent", F.coalesce("parent", F.lit(-1)))), leaf)  # and the trees' own taxa
    # a complete tree's own taxa are all taxa, which must not stand twice
    known = known.unionByName(ranges.everything(leaf).select(F.col("all").alias("sig"), MASKS.full.alias("mask"))).dropDuplicates(["sig"]).persist()
    t = ranges.transitions(rows)
    for c in ("parent", "lo", "hi"):
        t = t.join(known.select(F.col("sig").alias(c), F.col("mask").alias(f"{c}_mask")), c)
    return t.select(F.col("parent_mask").alias("parent"), F.least("lo_mask", "hi_mask").alias("lo"), F.greatest("lo_mask", "hi_mask").alias("hi"))


@query(_days(_DAY_NODE, _KIDS.format(n="node")) + " SELECT m1, m2, m3, count(*) AS freq FROM around WHERE psize IS NOT NULL GROUP BY 1, 2, 3")
def h6_tripartitions_by_day(spark, d):
    nodes, leaf = _day_nodes(spark, d)
    rows = ranges.signed(nodes, leaf)
    known = _masks(ranges.cluster_table(rows), leaf).persist()
    # the rest of an incomplete tree isn't a cluster; its mask is what the tree has less the children
    whole = leaf.groupBy("tree").agg(MASKS.union_of("taxon").alias("whole"))
    p = ranges.partition_table(rows).filter("d = 3").select(F.element_at("parts", 1).alias("p1"), F.element_at("parts", 2).alias("p2"), "freq", "exemplar.tree")
    for k in ("1", "2"):
        p = p.join(known.select(F.col("sig").alias(f"p{k}"), F.col("mask").alias(f"k{k}")), f"p{k}")
    p = p.join(whole, "tree").withColumn("m1", F.least("k1", "k2")).withColumn("m2", F.greatest("k1", "k2"))
    return p.select("m1", "m2", MASKS.less(F.col("whole"), MASKS.either(F.col("m1"), F.col("m2"))).alias("m3"), "freq")


@query(_days(_DAY_NODE, _KIDS.format(n="node"), _DAY_SPECIES) + _SP.format(s="sp") + _TRIPLES.format(p=_PARTS) + f" SELECT CAST(sum({_TERM}) // 4 AS BIGINT) AS quartet_score FROM tri CROSS JOIN cell")
def t14_fixed_score_by_day(spark, d):
    """The score of the label-ordered tree from ranges and prefix counts."""
    nodes, leaf = _day_nodes(spark, d)
    label = derived.label_leaves(spark, d)
    score = ranges.fixed_score(derived.block_ranges(label, levels=5), label, nodes, leaf, ranges.partition_table(ranges.signed(nodes, leaf)))
    return score.select(F.col("quartet_score").cast("long").alias("quartet_score"))


@query(_wide(_sets("node", "wleaf")) + f""",
    own AS (SELECT s FROM node WHERE up IS NOT NULL),
    each AS (SELECT row_number() OVER () AS id, s, f FROM (SELECT s, count(*) AS f FROM own GROUP BY s)),
    member AS (SELECT id, unnest(s) AS taxon FROM each),
    rest AS (SELECT id, f, list(taxon ORDER BY taxon) AS s FROM (SELECT id, f, taxon FROM each CROSS JOIN cleaf) q ANTI JOIN member USING (id, taxon) GROUP BY id, f),
    x AS (SELECT s, sum(f)::BIGINT AS freq FROM (SELECT s, f FROM each UNION ALL SELECT s, f FROM rest) GROUP BY s)
    SELECT {_SUMS}, freq FROM x""")
def a1_clusters_of_customers(spark, d):
    """Clusters of over a thousand taxa, both sides."""
    leaf = derived.customer_leaves(spark, d).persist()
    taxon = F.col("taxon").cast("long")
    sums = {"taxon_sum": taxon, "taxon_sq": taxon * taxon}
    table = ranges.cluster_table(ranges.signed(derived.block_ranges(leaf), leaf, sums), sums=tuple(sums))
    return table.select("sig.sz", "taxon_sum", "taxon_sq", "freq")


@query(_wide(_sets("node", "wleaf")) + """,
    kid AS (SELECT tree, up[2] AS lo, up[3] AS hi, list(s ORDER BY s) AS kids FROM node WHERE up IS NOT NULL GROUP BY 1, 2, 3),
    tri AS (SELECT kids, outside, count(*) AS freq FROM (SELECT k.kids, list(l.taxon ORDER BY l.taxon) AS outside FROM node x JOIN kid k USING (tree, lo, hi) JOIN wleaf l ON l.tree = x.tree AND (l.pos < x.lo OR l.pos >= x.hi) WHERE x.up IS NOT NULL GROUP BY x.tree, x.lo, x.hi, k.kids) GROUP BY 1, 2)
    SELECT least(len(kids[1]), len(kids[2])) AS sz1, greatest(len(kids[1]), len(kids[2])) AS sz2, len(outside) AS sz3, freq FROM tri""")
def a4_tripartitions_of_customers(spark, d):
    leaf = derived.customer_leaves(spark, d).persist()
    p = ranges.partition_table(ranges.signed(derived.block_ranges(leaf), leaf))
    at = lambda k: F.element_at("parts", k)["sz"]
    return p.select(F.least(at(1), at(2)).alias("sz1"), F.greatest(at(1), at(2)).alias("sz2"), at(3).alias("sz3"), "freq")


#: Counts of all three sides with all three parts; a pair of nodes has the six ways to pair them.
_PAIRS = """,
    gk AS (SELECT tree, up[2] AS lo, up[3] AS hi, arg_min(bits, lo) AS k1, arg_max(bits, lo) AS k2 FROM node WHERE up IS NOT NULL GROUP BY 1, 2, 3),
    gw AS (SELECT tree, bits AS whole FROM node WHERE up IS NULL),
    g AS (SELECT k1, k2, whole & ~(k1 | k2) AS k3 FROM gk JOIN gw USING (tree) JOIN node x USING (tree, lo, hi) WHERE x.up IS NOT NULL),
    sk AS (SELECT up[2] AS lo, up[3] AS hi, arg_min(bits, lo) AS s1, arg_max(bits, lo) AS s2 FROM sp WHERE up IS NOT NULL GROUP BY 1, 2),
    s AS (SELECT sk.lo, sk.hi, s1, s2, ~(s1 | s2) AS s3 FROM sk JOIN sp x USING (lo, hi) WHERE x.up IS NOT NULL),
    n AS (
        SELECT lo, hi, bit_count(s1 & k1)::BIGINT AS a1, bit_count(s1 & k2)::BIGINT AS a2, bit_count(s1 & k3)::BIGINT AS a3, bit_count(s2 & k1)::BIGINT AS b1, bit_count(s2 & k2)::BIGINT AS b2, bit_count(s2 & k3)::BIGINT AS b3,
               bit_count(s3 & k1)::BIGINT AS c1, bit_count(s3 & k2)::BIGINT AS c2, bit_count(s3 & k3)::BIGINT AS c3 FROM s CROSS JOIN g),
    w AS (SELECT lo, hi, sum(""" + " + ".join(f"a{i} * b{j} * c{k} * greatest(a{i} + b{j} + c{k} - 3, 0)" for i, j, k in ((1, 2, 3), (1, 3, 2), (2, 1, 3), (2, 3, 1), (3, 1, 2), (3, 2, 1))) + ") AS twice FROM n GROUP BY lo, hi)"


def _customers(spark, d):
    """Weights of the tree of all customers against the years' trees, from one table of nodes; and the type for numbers of quartets: BIGINT as long as it holds all that the years' trees have."""
    # files, as a plan that names a table at hand many times has the table's own plan each time, which fills the driver
    tables = Rounds(spark)
    leaf = tables.keep(derived.customer_leaves_and_label(spark, d))
    inner = tables.keep(ranges.bounded(derived.block_ranges(leaf), root_too=True))
    n = F.col("leaves").cast("double")
    most = parts.roots(inner).filter(F.col("tree") != derived.LABEL).agg(F.sum(n * (n - 1) * (n - 2) * (n - 3) / 24)).first()[0]
    return parts.node_weights(inner, leaf, derived.LABEL), "long" if (most or 0) < 0.999 * 2.0**63 else "decimal(38,0)"


@query(_wide(_sets("node", "wleaf"), _sets("sp", "cleaf")) + _PAIRS + " SELECT CAST(lo AS INT) AS lo, CAST(hi AS INT) AS hi, CAST(twice // 2 AS BIGINT) AS weight FROM w")
def h7_node_weights_of_customers(spark, d):
    """The agreeing quartets around each node of a tree of over a thousand taxa."""
    weights, kind = _customers(spark, d)
    return weights.select("lo", "hi", F.col("weight").cast(kind).alias("weight"))


@query(_wide(_sets("node", "wleaf"), _sets("sp", "cleaf")) + _PAIRS + " SELECT CAST(sum(twice) // 4 AS BIGINT) AS quartet_score FROM w")
def t19_fixed_score_of_customers(spark, d):
    weights, kind = _customers(spark, d)
    return ranges.total(weights).select(F.col("quartet_score").cast(kind).alias("quartet_score"))


@query(_wide(_sets("node", "wleaf")) + """,
    pair AS (SELECT DISTINCT tree, a, b FROM (SELECT CAST(year(o_orderdate) AS INT) AS tree, CAST(o_custkey AS INT) AS a, CAST(lead(o_custkey) OVER (PARTITION BY year(o_orderdate) ORDER BY o_orderkey) AS INT) AS b FROM orders) WHERE b IS NOT NULL)
    SELECT p.tree, p.a, p.b, CAST(count(*) - 1 AS INT) AS lvl, CAST(max(q.lo) AS INT) AS lo, CAST(min(q.hi) AS INT) AS hi
    FROM pair p JOIN wleaf x ON x.tree = p.tree AND x.taxon = p.a JOIN wleaf y ON y.tree = p.tree AND y.taxon = p.b JOIN node q ON q.tree = p.tree AND q.lo <= least(x.pos, y.pos) AND q.hi > greatest(x.pos, y.pos) GROUP BY 1, 2, 3""")
def j9_ancestors_of_customers(spark, d):
    """The least common ancestors of customers whose orders follow each other."""
    leaf = derived.customer_leaves(spark, d).persist()
    nodes = derived.block_ranges(leaf).join(leaf.select("tree", F.col("pos").alias("lo"), F.col("taxon").alias("t")), ["tree", "lo"]).withColumn("taxon", F.when(F.col("n_children") == 0, F.col("t"))).drop("t")
    orders = spark.read.parquet(f"{d}/orders.parquet").select(F.year("o_orderdate").alias("tree"), F.col("o_custkey").cast("int").alias("a"), "o_orderkey")
    after = F.lead("a").over(Window.partitionBy("tree").orderBy("o_orderkey"))
    pairs = orders.withColumn("b", after).filter("b IS NOT NULL").select("tree", "a", "b").distinct()
    nodes = nodes.persist()
    return ancestors.of_pairs(pairs, nodes).join(nodes.select("tree", "node", "lo", "hi"), ["tree", "node"]).select("tree", "a", "b", "lvl", "lo", "hi")
