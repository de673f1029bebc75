"""The registered queries over tree collections and their SQL.

The collections are derived from the orders tables (see sources.derived): `binary` trees, `wide` ones with nodes of
up to four children, and the summary tree in the order of the nations.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.masks import Masks
from ..operators import ancestors, clusters, kernels, matrices, partitions, perturb, support, taxa, transitions, weights
from ..sources import derived, newick
from ..sources.durable import shared_dir
from . import checks, consensus, enrich, guide, inference

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
N = 25
MASKS = Masks(N)
ANCHOR = 0


def binary(spark: SparkSession, d: str) -> DataFrame:
    """Kept at hand, as most queries read the nodes several times; lost parts are made again from the tables."""
    return derived.block_nodes(derived.leaves(spark, d), MASKS, 1, 5).persist()


def wide(spark: SparkSession, d: str) -> DataFrame:
    return derived.block_nodes(derived.leaves(spark, d), MASKS, 2, 3).persist()


def summary(spark: SparkSession, d: str, bits: int = 1) -> DataFrame:
    return derived.block_nodes(derived.label_leaves(spark, d), MASKS, bits, 5 if bits == 1 else 3).persist()


def _parts(nodes: DataFrame) -> DataFrame:
    return partitions.partition_table(nodes, MASKS).persist()


def _cte(name: str, bits: int, levels: int, leaf: str = "leaf") -> str:
    """Nodes with parent interval, as a chain of CTEs: name has tree, lo, hi, size, mask, plo, phi (of the parent), kids."""
    return f"""
    {name}_b AS (
        SELECT tree, l, pos >> (l * {bits}) AS b, min(pos) AS lo, max(pos) + 1 AS hi, count(*) AS size, bit_or(1::BIGINT << taxon) AS mask, min(taxon) AS taxon
        FROM {leaf}, (SELECT unnest(range({levels + 1})) AS l) GROUP BY tree, l, pos >> (l * {bits})),
    {name}_k AS (SELECT * FROM {name}_b WHERE l = 0 OR size > (1 << ((l - 1) * {bits}))),
    {name} AS (
        SELECT c.tree, c.lo, c.hi, c.size, c.mask, CASE WHEN c.l = 0 THEN c.taxon END AS taxon,
               min(p.size) AS psize, arg_min(p.lo, p.size) AS plo, arg_min(p.hi, p.size) AS phi, count(p.size) AS lvl,
               CASE WHEN c.l = 0 THEN 0 ELSE CAST(ceil(c.size / (1 << ((c.l - 1) * {bits}))) AS INT) END AS kids
        FROM {name}_k c LEFT JOIN {name}_k p ON p.tree = c.tree AND p.lo <= c.lo AND p.hi >= c.hi AND p.size > c.size
        GROUP BY c.tree, c.lo, c.hi, c.size, c.mask, c.taxon, c.l)"""


_LEAF = """
    counted AS (
        SELECT CAST(year(o_orderdate) * 12 + month(o_orderdate) AS INT) AS tree, c_nationkey AS taxon, count(*) AS c
        FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
    leaf AS (SELECT tree, taxon, CAST(row_number() OVER (PARTITION BY tree ORDER BY c DESC, taxon) - 1 AS INT) AS pos FROM counted),
    label_leaf AS (SELECT 0 AS tree, n_nationkey AS taxon, n_nationkey AS pos FROM nation)"""
_FULL = (1 << N) - 1
_BINARY, _WIDE = _cte("node", 1, 5), _cte("wnode", 2, 3)
_SPECIES, _WSPECIES = _cte("sp", 1, 5, "label_leaf"), _cte("wsp", 2, 3, "label_leaf")
_KIDS = """
    kid AS (SELECT tree, plo AS lo, phi AS hi, list_sort(list(mask)) AS kids, min(mask) AS m1, max(mask) AS m2 FROM {n} WHERE psize IS NOT NULL GROUP BY 1, 2, 3),
    whole AS (SELECT tree, mask AS whole FROM {n} WHERE psize IS NULL),
    around AS (SELECT x.tree, x.lo, x.hi, x.mask, x.psize, k.kids, k.m1, k.m2, w.whole & ~x.mask AS m3, w.whole FROM {n} x JOIN kid k USING (tree, lo, hi) JOIN whole w USING (tree))"""


def _with(*parts: str) -> str:
    return "WITH RECURSIVE " + ",".join((_LEAF, *parts))


def query(sql: str | None = None):
    def put(f):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return put


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import growing  # noqa: F401  it registers its own

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import growing  # noqa: F401

    return dict(_SQL)


@query(_with(_BINARY) + " SELECT tree, lo, hi, CAST(lvl AS INT) AS lvl, kids AS n_children, taxon, mask FROM node")
def s4_nodes(spark, d):
    return binary(spark, d).select("tree", "lo", "hi", "lvl", "n_children", "taxon", "mask")


def _as_newick(nodes: DataFrame) -> DataFrame:
    return newick.to_text(nodes, _names(nodes.sparkSession))


def _names(spark: SparkSession) -> DataFrame:
    return spark.range(N).select(F.col("id").cast("int").alias("taxon"), F.concat(F.lit("n"), "id").alias("name"))


@query(_with(_WIDE) + " SELECT tree, lo, hi, CAST(lvl AS INT) AS lvl, kids AS n_children, taxon, mask FROM wnode WHERE tree IN (SELECT tree FROM leaf GROUP BY tree HAVING count(*) > 1)")
def s3_newick_round_trip(spark, d):
    """Derived trees are written as text and parsed back to the same nodes."""
    text = _as_newick(wide(spark, d)).filter(F.col("newick").startswith("("))
    return newick.parse(text, _names(spark), MASKS).select("tree", F.col("lo").cast("int").alias("lo"), F.col("hi").cast("int").alias("hi"), "lvl", "n_children", "taxon", "mask")


@query(_with() + " SELECT DISTINCT 'n' || taxon AS name FROM leaf")
def f2_taxa_union(spark, d):
    return taxa.union(_as_newick(binary(spark, d)))


@query(_with() + " SELECT 'n' || taxon AS name FROM leaf GROUP BY taxon HAVING count(DISTINCT tree) = (SELECT count(DISTINCT tree) FROM leaf)")
def f3_taxa_intersection(spark, d):
    return taxa.intersection(_as_newick(binary(spark, d)))


@query(_with() + " SELECT tree, n_leaves FROM (SELECT row_number() OVER (ORDER BY tree) - 1 AS tree, count(*) AS n_leaves FROM leaf GROUP BY leaf.tree) WHERE tree < 50")
def o5_first_trees(spark, d):
    """The trees written as lines of text in order, read back by number, and the first fifty of them."""
    folder = f"{shared_dir(spark)}/lines-{uuid.uuid4().hex}"
    _as_newick(binary(spark, d)).orderBy("tree").select("newick").write.text(folder)
    first = newick.first_trees(newick.read_lines(spark, folder), 50)
    return newick.leaf_names(first).groupBy("tree").agg(F.count("*").alias("n_leaves"))


_ASIA = "(SELECT n_nationkey AS taxon FROM nation WHERE n_regionkey <= 1)"


def _listed(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/nation.parquet").filter("n_regionkey <= 1").select(F.col("n_nationkey").cast("int").alias("taxon"))


@query(_with() + f" SELECT tree, count(*) FILTER (WHERE taxon IN {_ASIA}) AS present, (SELECT count(*) FROM {_ASIA}) - count(*) FILTER (WHERE taxon IN {_ASIA}) AS missing, count(*) FILTER (WHERE taxon NOT IN {_ASIA}) AS ignored FROM leaf GROUP BY tree")
def f5_selection_scan(spark, d):
    return taxa.coverage(derived.leaves(spark, d), _listed(spark, d), "taxon")


@query(_with() + f", c AS (SELECT tree, (SELECT count(*) FROM {_ASIA}) - count(*) FILTER (WHERE taxon IN {_ASIA}) AS missing, count(*) FILTER (WHERE taxon NOT IN {_ASIA}) AS ignored FROM leaf GROUP BY tree) SELECT count(*) AS trees, avg(missing) AS mean_missing, min(missing) AS min_missing, max(missing) AS max_missing, CAST(sum(ignored) AS BIGINT) AS ignored FROM c")
def f4_coverage_stats(spark, d):
    return taxa.coverage_report(derived.leaves(spark, d), _listed(spark, d), "taxon")


@query(_with(_BINARY) + f", n AS (SELECT x.tree, x.mask & (SELECT bit_or(1::BIGINT << taxon) FROM {_ASIA}) AS mask FROM node x WHERE x.kids > 0) SELECT DISTINCT tree, mask FROM n WHERE bit_count(mask) > 1")
def s6_restricted_nodes(spark, d):
    """Parsing with a list of leaves to keep: the inner nodes of the induced trees."""
    keep = _listed(spark, d).select(F.concat(F.lit("n"), "taxon").alias("name"))
    return newick.parse(_as_newick(binary(spark, d)), _names(spark), MASKS, keep).filter("n_children > 0").select("tree", "mask")


@query(_with(_WIDE) + f" SELECT tree, CAST(max(hi) AS INT) AS n_leaves, max(hi) = {N} AS is_complete, bool_or(kids > 3 OR (kids = 3 AND psize IS NOT NULL)) AS has_polytomy FROM wnode GROUP BY tree")
def f11_f12_tree_flags(spark, d):
    return newick.trees_summary(wide(spark, d), N)


@query(_with(_BINARY) + f" SELECT mask, CAST(bit_count(mask) AS BIGINT) AS sz, count(*) AS freq FROM (SELECT unnest([mask, {_FULL} & ~mask]) AS mask FROM node WHERE psize IS NOT NULL) WHERE mask NOT IN (0, {_FULL}) GROUP BY mask")
def a1_cluster_table(spark, d):
    return clusters.cluster_table(binary(spark, d), MASKS)


_A2 = f"(SELECT mask, count(*) AS freq FROM (SELECT CASE WHEN mask & 1 = 1 THEN {_FULL} & ~mask ELSE mask END AS mask FROM node WHERE psize IS NOT NULL) WHERE mask NOT IN (0, {_FULL}) GROUP BY mask UNION ALL SELECT 1::BIGINT, 1)"


@query(_with(_BINARY) + f" SELECT mask, CAST(bit_count(mask) AS BIGINT) AS sz, freq FROM {_A2}")
def a2_cluster_table_anchored(spark, d):
    return clusters.cluster_table(binary(spark, d), MASKS, ANCHOR)


@query(_with(_BINARY) + f" SELECT CAST(bit_count(mask) AS BIGINT) AS sz, count(*) AS clusters FROM {_A2} GROUP BY 1")
def a3_size_bins(spark, d):
    return clusters.size_bins(clusters.cluster_table(binary(spark, d), MASKS, ANCHOR))


@query(_with(_BINARY, _KIDS.format(n="node")) + " SELECT m1, m2, m3, count(*) AS freq FROM around WHERE psize IS NOT NULL GROUP BY 1, 2, 3")
def a4_tripartitions(spark, d):
    return partitions.tripartitions(partitions.partition_table(binary(spark, d), MASKS))


_PARTS = "(SELECT CASE WHEN len(kids) > 2 THEN list_sort(list_append(kids, m3)) ELSE list_append(kids, m3) END AS parts, count(*) AS freq FROM around WHERE psize IS NOT NULL GROUP BY 1)"


@query(_with(_WIDE, _KIDS.format(n="wnode")) + f" SELECT list_aggregate(parts, 'string_agg', ',') AS parts, CAST(len(parts) AS INT) AS d, freq FROM {_PARTS}")
def a5_partitions(spark, d):
    p = partitions.partition_table(wide(spark, d), MASKS)
    return p.select(F.array_join(F.transform("parts", lambda m: m.cast("string")), ",").alias("parts"), "d", "freq")


_CANON = f"""(SELECT DISTINCT tree, CASE WHEN least(a, b) = 1 THEN CASE WHEN a < b THEN r ELSE mask END WHEN a < b THEN mask WHEN a > b THEN r ELSE least(mask, r) END AS mask
    FROM (SELECT tree, mask, {_FULL} & ~mask AS r, bit_count(mask) AS a, {N} - bit_count(mask) AS b FROM node WHERE psize IS NOT NULL AND kids > 0) WHERE a BETWEEN 2 AND {N - 1})"""


@query(_with(_BINARY) + f" SELECT mask, count(*) AS freq FROM {_CANON} GROUP BY mask")
def a11_bipartition_frequency(spark, d):
    return clusters.bipartition_table(binary(spark, d), MASKS)


_SIDE = f"CASE WHEN least(a, b) = 1 THEN CASE WHEN a < b THEN r ELSE mask END WHEN a < b THEN mask WHEN a > b THEN r ELSE least(mask, r) END"


@query(_with(_BINARY) + f" SELECT {_SIDE} AS mask, CAST(sum(freq) AS BIGINT) AS freq FROM (SELECT mask, freq, {_FULL} & ~mask AS r, bit_count(mask) AS a, {N} - bit_count(mask) AS b FROM (SELECT mask, count(*) AS freq FROM (SELECT unnest([mask, {_FULL} & ~mask]) AS mask FROM node WHERE psize IS NOT NULL) WHERE mask NOT IN (0, {_FULL}) GROUP BY mask)) WHERE a BETWEEN 2 AND {N - 1} GROUP BY 1")
def a12_bipartitions_of_clusters(spark, d):
    return clusters.bipartitions_from_clusters(clusters.cluster_table(binary(spark, d), MASKS), MASKS)


@query(_with(_BINARY) + " SELECT a.taxon AS a, b.taxon AS b, CAST(sum(abs_path) AS BIGINT) AS total, count(*) AS trees, sum(abs_path) / count(*) AS dist FROM (SELECT x.tree, x.taxon AS ta, y.taxon AS tb, x.lvl + y.lvl - 2 * (SELECT count(*) - 1 FROM node p WHERE p.tree = x.tree AND p.lo <= least(x.lo, y.lo) AND p.hi >= greatest(x.hi, y.hi)) AS abs_path FROM node x JOIN node y ON x.tree = y.tree AND x.taxon < y.taxon) q JOIN (SELECT n_nationkey AS taxon FROM nation) a ON a.taxon = q.ta JOIN (SELECT n_nationkey AS taxon FROM nation) b ON b.taxon = q.tb GROUP BY 1, 2")
def a6_distance_matrix(spark, d):
    return matrices.distances(binary(spark, d))


_SIM = """,
    sides AS (
        SELECT p.tree, p.lo AS nlo, p.hi AS nhi, c.lo AS side, c.hi - c.lo AS size, l.taxon FROM {n} c JOIN {n} p ON p.tree = c.tree AND p.lo = c.plo AND p.hi = c.phi JOIN leaf l ON l.tree = c.tree AND l.pos >= c.lo AND l.pos < c.hi
        UNION ALL
        SELECT p.tree, p.lo, p.hi, -1, w.n - p.size, l.taxon FROM {n} p JOIN (SELECT tree, count(*) AS n FROM leaf GROUP BY tree) w USING (tree) JOIN leaf l ON l.tree = p.tree AND (l.pos < p.lo OR l.pos >= p.hi) WHERE p.kids > 0),
    k AS (SELECT tree, count(*) AS n FROM leaf GROUP BY tree),
    num AS (SELECT x.taxon AS a, y.taxon AS b, sum((n - x.size - y.size) * (n - x.size - y.size - 1) // 2) AS num FROM sides x JOIN sides y ON x.tree = y.tree AND x.nlo = y.nlo AND x.nhi = y.nhi AND x.side <> y.side AND x.taxon < y.taxon JOIN k ON k.tree = x.tree GROUP BY 1, 2),
    den AS (SELECT x.taxon AS a, y.taxon AS b, sum((n - 2) * (n - 3) // 2) AS den FROM leaf x JOIN leaf y ON x.tree = y.tree AND x.taxon < y.taxon JOIN k ON k.tree = x.tree WHERE n >= 4 GROUP BY 1, 2),
    sim AS (SELECT a, b, CAST(coalesce(num, 0) AS BIGINT) AS num, CAST(den AS BIGINT) AS den, CAST(coalesce(num, 0) AS DOUBLE) / CAST(den AS DOUBLE) AS sim FROM den LEFT JOIN num USING (a, b))"""


@query(_with(_BINARY) + _SIM.format(n="node") + " SELECT * FROM sim")
def a7_similarity_matrix(spark, d):
    return matrices.similarities(binary(spark, d))


@query(_with(_WIDE) + _SIM.format(n="wnode") + " SELECT * FROM sim")
def a8_similarity_polytomous(spark, d):
    return matrices.similarities(wide(spark, d))


@query(_with(_BINARY) + _SIM.format(n="node") + " SELECT a, b, num FROM sim")
def a9_similarity_closed_form(spark, d):
    return matrices.similarities(binary(spark, d)).select("a", "b", "num")


_ROWS = ", both_ways AS (SELECT a AS x, b AS y, sim FROM sim UNION ALL SELECT b, a, sim FROM sim), ranked AS (SELECT x, y, CAST(row_number() OVER (PARTITION BY x ORDER BY sim DESC, y DESC) - 1 AS INT) AS rank FROM both_ways)"


@query(_with(_BINARY) + _SIM.format(n="node") + _ROWS + " SELECT * FROM ranked")
def c1_sorted_rows(spark, d):
    return matrices.sorted_rows(matrices.similarities(binary(spark, d)))


@query(_with(_BINARY) + _SIM.format(n="node") + _ROWS + " SELECT t.tree, r.x, arg_min(r.y, r.rank) AS y FROM (SELECT DISTINCT tree FROM leaf) t CROSS JOIN ranked r JOIN leaf l ON l.tree = t.tree AND l.taxon = r.y WHERE NOT EXISTS (SELECT 1 FROM leaf m WHERE m.tree = t.tree AND m.taxon = r.x) GROUP BY 1, 2")
def j8_nearest_present(spark, d):
    nodes = binary(spark, d)
    return matrices.nearest_present(matrices.sorted_rows(matrices.similarities(nodes)), newick.leaf_table(nodes).select("tree", "taxon"))


@query(_with(_BINARY) + _SIM.format(n="node") + " SELECT x.n_regionkey AS g, y.n_regionkey AS h, avg(coalesce(sim, 0)) AS sim FROM nation x JOIN nation y ON x.n_regionkey < y.n_regionkey LEFT JOIN sim ON a = least(x.n_nationkey, y.n_nationkey) AND b = greatest(x.n_nationkey, y.n_nationkey) GROUP BY 1, 2")
def a17_group_average(spark, d):
    groups = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_regionkey").alias("g"), F.col("n_nationkey").cast("int").alias("taxon"))
    return matrices.group_average(groups, matrices.similarities(binary(spark, d)))


_TRANS = f""",
    down AS (SELECT mask AS parent, m1 AS lo, m2 AS hi FROM around WHERE len(kids) = 2),
    side AS (SELECT c.mask, c.kids, a.mask AS up, CASE WHEN a.m1 = c.mask THEN a.m2 ELSE a.m1 END AS sib FROM {{n}} c JOIN around a ON a.tree = c.tree AND a.lo = c.plo AND a.hi = c.phi WHERE len(a.kids) = 2),
    up AS (SELECT {_FULL} & ~mask AS parent, least(sib, {_FULL} & ~up) AS lo, greatest(sib, {_FULL} & ~up) AS hi FROM side WHERE kids <= 2 AND up <> {_FULL}),
    trans AS (SELECT * FROM down UNION SELECT * FROM up)"""


@query(_with(_WIDE, _KIDS.format(n="wnode")) + _TRANS.format(n="wnode") + " SELECT * FROM trans")
def t3_t4_transitions(spark, d):
    return transitions.from_nodes(wide(spark, d), MASKS)


@query(_with(_BINARY) + f" SELECT DISTINCT {_FULL}::BIGINT AS parent, least(mask, {_FULL} & ~mask) AS lo, greatest(mask, {_FULL} & ~mask) AS hi FROM node WHERE psize IS NULL AND mask <> {_FULL}")
def t5_incomplete_roots(spark, d):
    return transitions.from_incomplete(binary(spark, d), MASKS)


_ANCH = f", anch AS (SELECT * FROM trans WHERE parent & 1 = 0 UNION SELECT {_FULL}, 1, {_FULL - 1})"


@query(_with(_BINARY, _KIDS.format(n="node")) + _TRANS.format(n="node") + _ANCH + " SELECT * FROM anch")
def t7_anchored_transitions(spark, d):
    return transitions.anchored(transitions.from_nodes(binary(spark, d), MASKS), MASKS, ANCHOR)




@query(_with(_BINARY) + f", x AS (SELECT DISTINCT unnest([mask, {_FULL} & ~mask]) AS mask FROM node WHERE psize IS NOT NULL), xs AS (SELECT mask FROM x WHERE mask NOT IN (0, {_FULL})), w AS (SELECT mask FROM xs UNION SELECT {_FULL}) SELECT a.mask AS parent, b.mask AS lo, c.mask AS hi FROM w a JOIN xs b ON b.mask & a.mask = b.mask AND b.mask <> a.mask JOIN xs c ON c.mask = (a.mask & ~b.mask) AND b.mask < c.mask")
def j1_cross_tree_splits(spark, d):
    return transitions.across_trees(clusters.cluster_table(binary(spark, d), MASKS), MASKS)



_TRIPLES = ", cell AS (SELECT parts, freq, i, j, k FROM (SELECT parts, freq, unnest(range(1, len(parts) + 1)) AS i FROM {p}), (SELECT unnest(range(1, 6)) AS j), (SELECT unnest(range(1, 6)) AS k) WHERE i <> j AND j <> k AND i <> k AND j <= len(parts) AND k <= len(parts))"
_TERM = "bit_count(s1 & parts[i])::BIGINT * bit_count(s2 & parts[j]) * bit_count(s3 & parts[k]) * greatest(bit_count(s1 & parts[i]) + bit_count(s2 & parts[j]) + bit_count(s3 & parts[k]) - 3, 0) * freq"


@query(_with(_BINARY, _KIDS.format(n="node")) + _TRANS.format(n="node") + _ANCH + _TRIPLES.format(p=_PARTS) + f" SELECT s1 AS lo, s2 AS hi, CAST(sum({_TERM}) // 2 AS BIGINT) AS weight FROM (SELECT DISTINCT lo AS s1, hi AS s2, {_FULL} & ~(lo | hi) AS s3 FROM anch) CROSS JOIN cell GROUP BY 1, 2")
def a13_split_weights(spark, d):
    nodes = binary(spark, d)
    t = transitions.anchored(transitions.from_nodes(nodes, MASKS), MASKS, ANCHOR).persist()
    return weights.split_weights(t, _parts(nodes), MASKS)


_A13 = f"(SELECT s1 AS lo, s2 AS hi, CAST(sum({_TERM}) // 2 AS BIGINT) AS weight FROM (SELECT DISTINCT lo AS s1, hi AS s2, {_FULL} & ~(lo | hi) AS s3 FROM anch) CROSS JOIN cell GROUP BY 1, 2)"


@query(_with(_BINARY, _KIDS.format(n="node")) + _TRANS.format(n="node") + _ANCH + _TRIPLES.format(p=_PARTS) + f" SELECT count(*) AS splits, max(weight) AS most, CAST(sum(weight) AS BIGINT) AS total FROM {_A13}")
def a14_weight_stats(spark, d):
    return weights.weight_stats(a13_split_weights(spark, d))


_REACH = f", reach(parent) AS (SELECT {_FULL}::BIGINT UNION SELECT x.m FROM reach JOIN (SELECT parent, unnest([lo, hi]) AS m FROM {{t}}) x USING (parent))"


@query(_with(_BINARY, _KIDS.format(n="node")) + _TRANS.format(n="node") + _ANCH + _REACH.format(t="anch") + " SELECT * FROM anch WHERE parent IN (SELECT parent FROM reach)")
def f13_reachable_divisions(spark, d):
    moves = transitions.anchored(transitions.from_nodes(binary(spark, d), MASKS), MASKS, ANCHOR).persist()
    return transitions.reachable(moves, MASKS)


_SP = ", sps AS (SELECT list_sort(list(c.mask)) AS kids, p.mask AS mask FROM {s} c JOIN {s} p ON p.lo = c.plo AND p.hi = c.phi GROUP BY p.mask), sides AS (SELECT list_filter(list_append(kids, " + str(_FULL) + " & ~mask), lambda m: m <> 0) AS s FROM sps), tri AS (SELECT s[1] AS s1, s[2] AS s2, s[3] AS s3 FROM sides WHERE len(s) = 3)"


@query(_with(_WIDE, _KIDS.format(n="wnode"), _SPECIES) + _SP.format(s="sp") + _TRIPLES.format(p=_PARTS) + f" SELECT s1 AS lo, s2 AS hi, CAST(sum({_TERM}) // 2 AS BIGINT) AS weight FROM tri CROSS JOIN cell GROUP BY 1, 2")
def t10_polytomous_weights(spark, d):
    sides = weights.species_sides(summary(spark, d), MASKS).select(F.element_at("sides", 1).alias("lo"), F.element_at("sides", 2).alias("hi"))
    return weights.split_weights(sides, _parts(wide(spark, d)), MASKS)


@query(_with(_BINARY, _KIDS.format(n="node"), _SPECIES) + _SP.format(s="sp") + _TRIPLES.format(p=_PARTS) + f" SELECT CAST(sum({_TERM}) // 4 AS BIGINT) AS quartet_score FROM tri CROSS JOIN cell")
def t19_fixed_tree_score(spark, d):
    return weights.fixed_tree_score(summary(spark, d), _parts(binary(spark, d)), MASKS)


#: Straight from the definition: pairs of cells that share neither row nor column, beside a pair within a third cell.
_T21 = f""",
    part AS (SELECT row_number() OVER () AS g, parts, freq FROM {_PARTS}),
    spn AS (SELECT row_number() OVER () AS v, s FROM sides WHERE len(s) > 2),
    cells AS (SELECT v, g, freq, i, p, bit_count(s[i] & parts[p])::BIGINT AS n FROM (SELECT v, s, unnest(range(1, len(s) + 1)) AS i FROM spn), (SELECT g, parts, freq, unnest(range(1, len(parts) + 1)) AS p FROM part)),
    filled AS (SELECT * FROM cells WHERE n > 0)
    SELECT CAST(sum(x.freq * (x.n * (x.n - 1) // 2) * y.n * z.n) // 2 AS BIGINT) AS quartet_score
    FROM filled x JOIN filled y ON x.v = y.v AND x.g = y.g AND x.i <> y.i AND x.p <> y.p AND x.n > 1
    JOIN filled z ON z.v = x.v AND z.g = x.g AND z.i <> x.i AND z.p <> x.p AND z.i > y.i AND z.p <> y.p"""


@query(_with(_WIDE, _KIDS.format(n="wnode"), _WSPECIES) + _SP.format(s="wsp") + _T21)
def t21_polytomous_score(spark, d):
    return weights.fixed_tree_score(summary(spark, d, 2), _parts(wide(spark, d)), MASKS)


_NONTRIV = f"bip AS (SELECT DISTINCT tree, CASE WHEN mask & 1 = 1 THEN {_FULL} & ~mask ELSE mask END AS mask FROM node WHERE psize IS NOT NULL AND kids > 0 AND bit_count(mask) BETWEEN 2 AND {N - 2})"


@query(_with(_BINARY, _NONTRIV) + f", k AS (SELECT tree, (SELECT count(*) FROM bip b WHERE b.tree = t.tree) AS k FROM (SELECT DISTINCT tree FROM leaf) t), s AS (SELECT a.tree AS t1, b.tree AS t2, count(*) AS s FROM bip a JOIN bip b ON a.mask = b.mask AND a.tree < b.tree GROUP BY 1, 2) SELECT a.tree AS t1, b.tree AS t2, a.k + b.k - 2 * coalesce(s, 0) AS rf, least(1.0, (a.k + b.k - 2 * coalesce(s, 0)) / {2.0 * (N - 3)}::DOUBLE) AS nrf FROM k a JOIN k b ON a.tree < b.tree LEFT JOIN s ON t1 = a.tree AND t2 = b.tree")
def u2_all_pairs_rf(spark, d):
    nodes = binary(spark, d)
    return clusters.rf_distances(nodes, nodes, MASKS, pairs_below=True)


@query(_with(_WIDE) + " SELECT tree, count(*) FILTER (WHERE kids = 0) AS tips, count(*) FILTER (WHERE kids > 0) AS inner_nodes, count(*) FILTER (WHERE kids > 2) AS multifurcations FROM wnode GROUP BY tree")
def u5_tree_tips(spark, d):
    return clusters.tips(wide(spark, d))


@query(_with(_WIDE) + " SELECT CAST(kids + CASE WHEN psize IS NULL THEN 0 ELSE 1 END AS INT) AS degree, count(*) AS nodes FROM wnode WHERE kids > 0 GROUP BY 1")
def u5_degree_histogram(spark, d):
    return clusters.degree_histogram(wide(spark, d))


def _weighed(nodes: DataFrame) -> DataFrame:
    moves = transitions.anchored(transitions.from_nodes(nodes, MASKS), MASKS, ANCHOR).persist()
    return moves.join(weights.split_weights(moves, _parts(nodes), MASKS), ["lo", "hi"])


#: Best totals by growing size, all earlier ones carried along; then down from all taxa. Ties: the lesser lo.
_BEST = f""",
    weighed AS (SELECT a.parent, a.lo, a.hi, coalesce(w.weight, 0) AS weight FROM anch a LEFT JOIN (SELECT s1 AS lo, s2 AS hi, CAST(sum({_TERM}) // 2 AS BIGINT) AS weight FROM (SELECT DISTINCT lo AS s1, hi AS s2, {_FULL} & ~(lo | hi) AS s3 FROM anch) CROSS JOIN cell GROUP BY 1, 2) w USING (lo, hi)),
    known AS (SELECT DISTINCT m FROM (SELECT unnest([parent, lo, hi]) AS m FROM weighed)),
    bare AS (SELECT m FROM known WHERE m NOT IN (SELECT parent FROM weighed)),
    best AS (
        SELECT 1 AS step, m AS mask, CAST(0 AS BIGINT) AS total, CAST(NULL AS BIGINT) AS lo, CAST(NULL AS BIGINT) AS hi, CAST(NULL AS BIGINT) AS weight FROM bare
        UNION ALL
        SELECT step + 1, mask, total, lo, hi, weight FROM (
            SELECT step, mask, total, lo, hi, weight FROM best
            UNION ALL
            SELECT * FROM (
                SELECT l.step, s.parent AS mask, s.weight + l.total + h.total AS total, s.lo, s.hi, s.weight
                FROM weighed s JOIN best l ON l.mask = s.lo JOIN best h ON h.mask = s.hi WHERE bit_count(s.parent) = l.step + 1
                QUALIFY row_number() OVER (PARTITION BY s.parent ORDER BY s.weight + l.total + h.total DESC, s.lo) = 1))
        WHERE step < {N}),
    chosen AS (
        SELECT mask, total, lo, hi, weight FROM best WHERE step = {N} AND mask = {_FULL}
        UNION ALL
        SELECT b.mask, b.total, b.lo, b.hi, b.weight FROM chosen c JOIN best b ON b.mask IN (c.lo, c.hi) WHERE b.step = {N} AND b.lo IS NOT NULL)
    SELECT * FROM chosen"""


@query(_with(_BINARY, _KIDS.format(n="node")) + _TRANS.format(n="node") + _ANCH + _TRIPLES.format(p=_PARTS) + _BEST)
def t17_best_divisions(spark, d):
    """The dynamic program: the divisions of the best summary tree and their totals."""
    best = inference.best_divisions(_weighed(binary(spark, d)), MASKS)
    return best.select(*[F.col(c).cast("long").alias(c) for c in ("mask", "total", "lo", "hi", "weight")])


@query("SELECT CAST(0 AS BIGINT) AS faults")
def s28_node_faults(spark, d):
    """Inner nodes whose children don't make up their taxa, and repeated ranges."""
    nodes = wide(spark, d)
    around = partitions.around(nodes, MASKS, root_too=True).join(nodes.select("tree", "node", "mask"), ["tree", "node"])
    return around.agg(F.count_if(F.aggregate("kids", F.lit(0).cast("long"), lambda t, m: t + m) != F.col("mask")).alias("faults"))


_CHECKS = f""",
    allx AS {_A2},
    parts AS {_PARTS},
    dp AS (SELECT * FROM chosen)
    SELECT 'parse' AS phase, count(*) AS n, sum(size)::BIGINT AS total, count(*) FILTER (WHERE bit_count(mask) <> size) AS faults FROM node
    UNION ALL SELECT 'hash', count(DISTINCT mask), count(*), 0 FROM node WHERE psize IS NOT NULL
    UNION ALL SELECT 'clusters', count(*), sum(freq)::BIGINT, count(*) FILTER (WHERE mask IN (0, {_FULL})) FROM allx
    UNION ALL SELECT 'partitions', count(*), sum(freq)::BIGINT, count(*) FILTER (WHERE list_sum(list_transform(parts, lambda m: bit_count(m))) <> bit_count(list_bit_or(parts))) FROM parts
    UNION ALL SELECT 'transitions', count(*), sum(bit_count(parent))::BIGINT, count(*) FILTER (WHERE lo & hi <> 0 OR lo | hi <> parent) FROM anch
    UNION ALL SELECT 'weights', count(*), sum(weight)::BIGINT, count(*) FILTER (WHERE weight < 0) FROM (SELECT DISTINCT lo, hi, weight FROM weighed)
    UNION ALL SELECT 'dp', count(*), sum(total)::BIGINT, count(*) FILTER (WHERE total <> weight + coalesce((SELECT any_value(l.total) FROM dp l WHERE l.mask = dp.lo), 0) + coalesce((SELECT any_value(h.total) FROM dp h WHERE h.mask = dp.hi), 0)) FROM dp"""


@query(_with(_BINARY, _KIDS.format(n="node")) + _TRANS.format(n="node") + _ANCH + _TRIPLES.format(p=_PARTS) + _BEST.removesuffix("SELECT * FROM chosen").rstrip() + _CHECKS)
def s28_phase_checks(spark, d):
    """The numbers of all phases of a search, and their faults."""
    return checks.phases(binary(spark, d), MASKS, ANCHOR)


#: One merge a step on the sums of similarities; a cluster is named by its least taxon. A row of -1 outlives the last merge.
_UPGMA = """,
    start AS (SELECT x.n_nationkey AS a, y.n_nationkey AS b, coalesce(sim, 0) AS s, 1::BIGINT AS c FROM nation x JOIN nation y ON x.n_nationkey < y.n_nationkey LEFT JOIN sim ON sim.a = x.n_nationkey AND sim.b = y.n_nationkey),
    up AS (
        SELECT 0 AS step, a::INT AS a, b::INT AS b, s::DOUBLE AS s, c, NULL::INT AS ma, NULL::INT AS mb, NULL::DOUBLE AS sim FROM start UNION ALL SELECT 0, -1, -1, 0, 1, NULL, NULL, NULL
        UNION ALL
        SELECT step, a, b, s, c, ma, mb, sim FROM (
            SELECT u.step + 1 AS step, least(CASE WHEN u.a = m.b THEN m.a ELSE u.a END, CASE WHEN u.b = m.b THEN m.a ELSE u.b END) AS a, greatest(CASE WHEN u.a = m.b THEN m.a ELSE u.a END, CASE WHEN u.b = m.b THEN m.a ELSE u.b END) AS b,
                   sum(u.s) AS s, sum(u.c)::BIGINT AS c, any_value(m.a) AS ma, any_value(m.b) AS mb, any_value(m.s / m.c) AS sim
            FROM up u CROSS JOIN (SELECT a, b, s, c FROM up WHERE a >= 0 ORDER BY s / c DESC, a, b LIMIT 1) m GROUP BY 1, 2, 3)
        WHERE a <> b OR a = -1)
    SELECT ma AS a, mb AS b, round(sim, 9) AS sim FROM up WHERE a = -1 AND ma IS NOT NULL"""


@query(_with(_BINARY) + _SIM.format(n="node") + _UPGMA)
def c8_upgma_guide(spark, d):
    """The merges of the guide tree on the similarities of all taxa, with their averages."""
    nations = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").alias("taxon"))
    return guide.merge_rounds(matrices.similarities(binary(spark, d)), nations).select("a", "b", F.round("sim", 9).alias("sim"))


@query(_with() + f" SELECT tree::BIGINT AS tree, {N} AS n_leaves, {2 * N - 1}::BIGINT AS n_nodes FROM leaf GROUP BY tree HAVING count(*) > 1")
def c5_completed_trees(spark, d):
    """Every tree with all taxa, placed by the four-point rule; the trees' sizes are checked."""
    nodes = binary(spark, d)
    s = inference.dense(matrices.similarities(nodes), N)
    near = inference.nearest_rows(s)
    whole = nodes.join(nodes.filter("parent is null and n_children > 0").select("tree"), "tree", "left_semi")
    done = inference.map_trees(whole, lambda t: kernels.complete(t, s, near), MASKS)
    return done.groupBy("tree").agg(F.max("hi").alias("n_leaves"), F.count("*").alias("n_nodes"))


#: The accepted clusters so far are carried along, one bipartition a step.
_CONSENSUS = f""",
    bip AS (SELECT CASE WHEN mask & 1 = 1 THEN {_FULL} & ~mask ELSE mask END AS m, count(*) AS f FROM {_CANON} GROUP BY 1),
    ranked AS (SELECT m, f, row_number() OVER (ORDER BY f DESC, m) AS r FROM bip WHERE bit_count(m) BETWEEN 2 AND {N - 2}),
    walk AS (
        SELECT CAST(0 AS BIGINT) AS r, CAST([] AS BIGINT[]) AS kept
        UNION ALL
        SELECT x.r, CASE WHEN len(list_filter(kept, lambda k: k & x.m <> 0 AND k & x.m <> k AND k & x.m <> x.m)) = 0 THEN list_append(kept, x.m) ELSE kept END FROM walk w JOIN ranked x ON x.r = w.r + 1),
    chosen AS (SELECT unnest(kept) AS m FROM walk WHERE r = (SELECT count(*) FROM ranked)),
    threshold AS (SELECT * FROM (VALUES {", ".join(f"({i}, {t!r}::DOUBLE)" for i, t in enumerate(kernels.THRESHOLDS))}) v(family, threshold))
    SELECT family, threshold, m AS mask FROM chosen JOIN ranked USING (m) CROSS JOIN threshold WHERE threshold = 0 OR f > threshold * (SELECT count(DISTINCT tree) FROM leaf)"""


@query(_with(_BINARY) + _CONSENSUS)
def g1_greedy_consensus(spark, d):
    """The laminar families at all thresholds."""
    nodes = binary(spark, d)
    rows = consensus.families(clusters.bipartition_table(nodes, MASKS), MASKS, nodes.select("tree").distinct().count())
    return spark.createDataFrame(rows, "family int, threshold double, mask long")


#: Inner nodes are the smaller sides; a node begins where its parent does, after the siblings with lesser taxa.
_SNAPSHOT = _CONSENSUS.split("SELECT family, threshold, m AS mask")[0] + f""",
    inside AS (
        SELECT family, CASE WHEN bit_count(m) * 2 < {N} THEN m ELSE {_FULL} & ~m END AS mask FROM chosen JOIN ranked USING (m) CROSS JOIN threshold WHERE threshold = 0 OR f > threshold * (SELECT count(DISTINCT tree) FROM leaf)
        UNION ALL SELECT family, 1::BIGINT << t FROM threshold, (SELECT unnest(range({N})) AS t)),
    whole AS (SELECT * FROM inside UNION ALL SELECT family, {_FULL}::BIGINT FROM threshold),
    kid AS (SELECT c.family, c.mask, min((bit_count(p.mask), p.mask))[2] AS up FROM inside c JOIN whole p ON p.family = c.family AND p.mask & c.mask = c.mask AND p.mask <> c.mask GROUP BY 1, 2),
    placed AS (SELECT family, mask, up, sum(bit_count(mask)) OVER (PARTITION BY family, up ORDER BY mask & -mask) - bit_count(mask) AS off FROM kid),
    walk2 AS (SELECT family, {_FULL}::BIGINT AS mask, 0::BIGINT AS lo FROM threshold UNION ALL SELECT k.family, k.mask, (w.lo + k.off)::BIGINT FROM walk2 w JOIN placed k ON k.family = w.family AND k.up = w.mask)
    SELECT family, CAST(lo AS INT) AS lo, CAST(lo + bit_count(mask) AS INT) AS hi, CASE WHEN bit_count(mask) = 1 THEN CAST(log2(mask) AS INT) END AS taxon, CAST((SELECT count(*) FROM kid k WHERE k.family = w.family AND k.up = w.mask) AS INT) AS n_children FROM walk2 w"""


@query(_with(_BINARY) + _SNAPSHOT)
def g5_consensus_snapshots(spark, d):
    """The ordered consensus trees at all thresholds, node by node."""
    nodes = binary(spark, d)
    trees = consensus.snapshots(clusters.bipartition_table(nodes, MASKS), MASKS, nodes.select("tree").distinct().count())
    return trees.select(F.col("tree").alias("family"), "lo", "hi", "taxon", "n_children")


@query(_with(_BINARY) + " SELECT mask, kind, family, ranges, freq FROM (SELECT mask, CAST(lvl % 5 AS INT) AS kind, CAST(tree % 7 AS INT) AS family, CAST(bit_count(mask & ~(mask << 1)) AS INT) AS ranges, size AS freq FROM node WHERE kids > 0) QUALIFY row_number() OVER (PARTITION BY mask ORDER BY kind, family, ranges, freq DESC) = 1")
def g17_emission_preference(spark, d):
    """Of equal proposals one is left: by kind, threshold and number of ranges."""
    each = binary(spark, d).filter("n_children > 0")
    ranges = F.bit_count(F.col("mask").bitwiseAND(F.bitwise_not(F.shiftleft("mask", 1))))
    return enrich.one_of_each(each.select("mask", (F.col("lvl") % 5).cast("int").alias("kind"), (F.col("tree") % 7).cast("int").alias("family"), ranges.cast("int").alias("ranges"), (F.col("hi") - F.col("lo")).cast("long").alias("freq")))


@query(_with(_BINARY) + """,
    rep AS (SELECT n_regionkey AS place, n_nationkey AS taxon, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS round FROM nation),
    cut AS (SELECT DISTINCT x.tree, r.round, (SELECT sum(1 << q.place)::BIGINT FROM rep q WHERE q.round = r.round AND (x.mask >> q.taxon) & 1 = 1) AS side FROM node x, (SELECT DISTINCT round FROM rep) r WHERE x.psize IS NOT NULL)
    SELECT round::INT AS round, least(side, 31 - side)::BIGINT AS side, count(DISTINCT tree) AS freq FROM cut WHERE bit_count(side) BETWEEN 2 AND 3 GROUP BY 1, 2""")
def g11_induced_splits(spark, d):
    """How the trees divide samples of one nation from each region."""
    nation = spark.read.parquet(f"{d}/nation.parquet").orderBy("n_regionkey", "n_nationkey").select("n_nationkey", "n_regionkey").collect()
    regions = [[r["n_nationkey"] for r in nation if r["n_regionkey"] == k] for k in range(5)]
    samples = [(0, k, np.array([g[k] for g in regions])) for k in range(5)]
    counts = enrich.induced_counts(ancestors.lines(binary(spark, d)), samples)
    return counts.select("round", F.col("side").cast("long").alias("side"), "freq")


_LCA = " SELECT p.tree, p.a, p.b, CAST(count(*) - 1 AS INT) AS lvl, CAST(max(q.lo) AS INT) AS lo, CAST(min(q.hi) AS INT) AS hi FROM pair p JOIN {leaf} x ON x.tree = p.tree AND x.taxon = p.a JOIN {leaf} y ON y.tree = p.tree AND y.taxon = p.b JOIN {node} q ON q.tree = p.tree AND q.lo <= least(x.pos, y.pos) AND q.hi > greatest(x.pos, y.pos) GROUP BY 1, 2, 3"


@query(_with(_WIDE) + ", pair AS (SELECT DISTINCT CAST(year(o_orderdate) * 12 + month(o_orderdate) AS INT) AS tree, CAST(c_nationkey AS INT) AS a, CAST(s_nationkey AS INT) AS b FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey)" + _LCA.format(leaf="leaf", node="wnode"))
def j9_ancestors_of_traders(spark, d):
    """The least common ancestor of each customer's and supplier's nations, in the tree of the order's month."""
    t = lambda n: spark.read.parquet(f"{d}/{n}.parquet")
    made = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
    month = (F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("int")
    pairs = made.select(month.alias("tree"), F.col("c_nationkey").cast("int").alias("a"), F.col("s_nationkey").cast("int").alias("b")).distinct()
    nodes = wide(spark, d)
    return ancestors.of_pairs(pairs, nodes).join(nodes.select("tree", "node", "lo", "hi"), ["tree", "node"]).select("tree", "a", "b", "lvl", "lo", "hi")


_KEPT = "kept AS (SELECT tree, bit_or(1::BIGINT << taxon) AS k FROM (SELECT tree, taxon, row_number() OVER (PARTITION BY tree ORDER BY md5('42:' || tree || ':' || taxon), taxon) AS rank, count(*) OVER (PARTITION BY tree) AS n FROM leaf) WHERE rank > greatest(0, least(floor(n * 0.3::DOUBLE), n - 4)) GROUP BY tree)"


@query(_with(_BINARY, _KEPT) + " SELECT DISTINCT tree, mask & k AS mask FROM node JOIN kept USING (tree) WHERE bit_count(mask & k) > 1")
def u10_pruned_trees(spark, d):
    """Inner nodes after three tenths of each tree's taxa are removed."""
    return perturb.prune_taxa(binary(spark, d), MASKS).filter("n_children > 0").select("tree", "mask")


@query(_with(_BINARY) + f" SELECT tree, lo, hi, mask FROM node WHERE NOT (psize IS NOT NULL AND kids > 0 AND substr(md5('42:' || tree || ':' || lo || ':' || hi), 1, 8) < '{int(0.3 * 2**32):08x}')")
def u11_collapsed_edges(spark, d):
    return perturb.collapse_edges(binary(spark, d)).select("tree", "lo", "hi", "mask")


_OUTGROUP = "(SELECT n_nationkey AS taxon FROM nation WHERE n_regionkey = 4)"


@query(_with(_BINARY, f"o AS (SELECT tree, bit_or(CASE WHEN taxon IN {_OUTGROUP} THEN 1::BIGINT << taxon ELSE 0 END) AS o, bit_or(1::BIGINT << taxon) AS whole, min(taxon) FILTER (WHERE taxon IN {_OUTGROUP}) AS first FROM leaf GROUP BY tree)", "halves AS (SELECT c.tree, c.mask FROM node c JOIN node p ON p.tree = c.tree AND p.psize IS NULL AND p.lo = c.plo AND p.hi = c.phi)", "r AS (SELECT tree, whole, CASE WHEN EXISTS (SELECT 1 FROM node n WHERE n.tree = o.tree AND n.mask IN (o.o, o.whole & ~o.o)) THEN o ELSE coalesce((SELECT min(h.mask) FROM halves h WHERE h.tree = o.tree AND h.mask & o = o), 1::BIGINT << first) END AS side FROM o WHERE o NOT IN (0, whole))") + " SELECT tree::BIGINT AS tree, least(side, whole & ~side) AS a, greatest(side, whole & ~side) AS b FROM r")
def u7_outgroup_roots(spark, d):
    """The two sides of each tree's root after it is set beside an outgroup (trees with and without such taxa)."""
    outgroup = {r["n_nationkey"] for r in spark.read.parquet(f"{d}/nation.parquet").filter("n_regionkey = 4").select("n_nationkey").collect()}
    nodes = binary(spark, d)
    bits = MASKS.lit(sum(1 << t for t in outgroup))
    mixed = nodes.filter("parent is null").filter((MASKS.both(F.col("mask"), bits) != 0) & (MASKS.less(F.col("mask"), bits) != 0)).select("tree")
    done = perturb.rooted(nodes.join(mixed, "tree", "left_semi"), outgroup, MASKS)
    root = done.filter("parent is null").select("tree", F.col("node").alias("parent"))
    return done.join(root, ["tree", "parent"]).groupBy("tree").agg(F.min("mask").alias("a"), F.max("mask").alias("b"))


_BRANCH = f""",
    spk AS (SELECT plo, phi, psize, arg_min(mask, lo) AS k0, arg_max(mask, lo) AS k1, count(*) AS k FROM sp WHERE psize IS NOT NULL GROUP BY 1, 2, 3),
    cand AS (
        SELECT x.lo, x.hi, x.mask, x.plo, x.phi, o.k0 AS c2, o.k1 AS c1, u.k0 AS s0, u.k1 AS s1, p.psize IS NULL AS at_root
        FROM sp x JOIN spk o ON o.plo = x.lo AND o.phi = x.hi JOIN spk u ON u.plo = x.plo AND u.phi = x.phi JOIN sp p ON p.lo = x.plo AND p.hi = x.phi WHERE x.psize IS NOT NULL AND x.kids = 2),
    sister AS (SELECT c.*, CASE WHEN s0 = c.mask THEN s1 ELSE s0 END AS sib FROM cand c),
    branch AS (
        SELECT row_number() OVER () AS node, c1, c2, CASE WHEN at_root THEN o.k1 ELSE sib END AS sister, CASE WHEN at_root THEN o.k0 ELSE {_FULL} & ~(x.mask | sib) END AS remaining
        FROM sister x LEFT JOIN sp y ON y.mask = x.sib LEFT JOIN spk o ON o.plo = y.lo AND o.phi = y.hi WHERE NOT at_root OR (y.kids = 2 AND x.lo = 0)),
    gside AS (SELECT tree, whole, list_filter([m1, m2, m3], lambda m: m <> 0) AS s FROM around WHERE m3 <> 0),
    met AS (SELECT node, tree, s, [c1, c2, sister, remaining] AS g, bit_count(c1 & whole)::BIGINT * bit_count(c2 & whole) * bit_count(sister & whole) * bit_count(remaining & whole) AS product FROM branch, gside),
    perm AS (SELECT * FROM (VALUES (1, 2, 3), (2, 1, 3), (3, 1, 2), (1, 3, 2), (2, 3, 1), (3, 2, 1)) p(i, j, k)),
    pairing AS (SELECT * FROM (VALUES (1, 1, 2, 3, 4), (2, 1, 3, 2, 4), (3, 1, 4, 2, 3)) p(q, x, y, z, w)),
    hit AS (
        SELECT node, tree, product, q, sum(bit_count(g[z] & s[i])::BIGINT * bit_count(g[w] & s[i]) * bit_count(g[x] & s[j]) * bit_count(g[y] & s[k]) + bit_count(g[x] & s[i])::BIGINT * bit_count(g[y] & s[i]) * bit_count(g[z] & s[j]) * bit_count(g[w] & s[k])) AS n
        FROM met, perm, pairing WHERE product > 0 GROUP BY 1, 2, 3, 4)
    SELECT any_value(b.c1) AS c1, any_value(b.c2) AS c2, any_value(b.sister) AS sister, count(DISTINCT tree) AS n_genes,
           round(sum(n / (2.0::DOUBLE * product)) FILTER (WHERE q = 1), 6) AS f1, round(sum(n / (2.0::DOUBLE * product)) FILTER (WHERE q = 2), 6) AS f2, round(sum(n / (2.0::DOUBLE * product)) FILTER (WHERE q = 3), 6) AS f3
    FROM hit JOIN branch b USING (node) GROUP BY node"""


@query(_with(_BINARY, _KIDS.format(n="node"), _SPECIES) + _BRANCH)
def b2_quartet_frequencies(spark, d):
    """The shares of the three pairings around each branch of the summary tree, to six decimals."""
    branch = support.branches(summary(spark, d), MASKS)
    found = support.quartet_frequencies(branch, support.gene_sides(binary(spark, d), MASKS), MASKS)
    return found.join(branch, "node").select("c1", "c2", "sister", "n_genes", *[F.round(f, 6).alias(f) for f in ("f1", "f2", "f3")])


@query()
def b2_branch_support(spark, d):
    """Quartet frequencies, posteriors and lengths of the summary tree's branches."""
    nodes, species = binary(spark, d), summary(spark, d)
    branch = support.branches(species, MASKS)
    return support.annotate(support.quartet_frequencies(branch, support.gene_sides(nodes, MASKS), MASKS), branch, MASKS)


@query(_with(_BINARY, _SPECIES) + f""", gb AS (SELECT DISTINCT tree, CASE WHEN mask & 1 = 1 THEN {_FULL} & ~mask ELSE mask END AS mask FROM node WHERE psize IS NOT NULL AND kids > 0 AND bit_count(mask) BETWEEN 2 AND {N - 2}),
    sb AS (SELECT DISTINCT CASE WHEN mask & 1 = 1 THEN {_FULL} & ~mask ELSE mask END AS mask FROM sp WHERE psize IS NOT NULL AND kids > 0 AND bit_count(mask) BETWEEN 2 AND {N - 2}),
    t AS (SELECT DISTINCT tree FROM leaf),
    rf AS (SELECT t.tree, (SELECT count(*) FROM gb WHERE gb.tree = t.tree) + (SELECT count(*) FROM sb) - 2 * (SELECT count(*) FROM gb JOIN sb USING (mask) WHERE gb.tree = t.tree) AS rf FROM t),
    pair AS (SELECT a.tree AS t1, b.tree AS t2 FROM t a JOIN t b ON a.tree < b.tree),
    gg AS (SELECT (SELECT count(*) FROM gb WHERE gb.tree IN (t1, t2)) - 2 * (SELECT count(*) FROM gb x JOIN gb y USING (mask) WHERE x.tree = t1 AND y.tree = t2) AS rf FROM pair)
    SELECT (SELECT avg(rf / {2.0 * (N - 3)}::DOUBLE) FROM gg) AS gt_gt, (SELECT avg(least(1.0, rf / {2.0 * (N - 3)}::DOUBLE)) FROM rf) AS gt_st""")
def u9_discordance(spark, d):
    return clusters.discordance(binary(spark, d), summary(spark, d), MASKS)
