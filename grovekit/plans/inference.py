"""Finding the summary tree with the most agreeing quartets, and scoring and annotating a given one."""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.masks import Masks
from ..operators import clusters, kernels, matrices, partitions, support, transitions, weights
from ..sources import newick
from ..sources.durable import Rounds, durable
from .enrich import proposals


@dataclass(frozen=True)
class Options:
    """full_search: also divisions that no single tree has. keep_multifurcations: don't refine the input for the search."""

    full_search: bool = False
    anchor: int | None = 0
    completion: bool = False
    by_distance: bool = False
    consensus: bool = False
    keep_multifurcations: bool = False
    nearest_balls: bool = False
    random_leftovers: bool = False
    sample_input: bool = False
    seed: int = 1
    prune: bool = True  # divisions of clusters that nothing reachable is divided into aren't weighed


#: The presets of search spaces; I1 to I4 name ways to count intersections, of which this engine needs one.
PRESETS = {
    "S1": Options(),
    "S2": Options(completion=True, full_search=True),
    "S3": Options(completion=True, full_search=True, consensus=True, nearest_balls=True, random_leftovers=True, sample_input=True),
}
INTERSECTION_METHODS = ("I1", "I2", "I3", "I4")


def preset(name: str, **changes) -> Options:
    return replace(PRESETS[name], **changes)


_ROWS = "tree long, node long, lo int, hi int, taxon int"


def map_trees(nodes: DataFrame, change: Callable[[kernels.Node], kernels.Node], masks: Masks) -> DataFrame:
    """Every tree changed by a function, tree by tree."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        root = kernels.from_rows((int(lo), int(hi), None if pd.isna(t) else int(t)) for lo, hi, t in zip(rows.lo, rows.hi, rows.taxon, strict=True))
        out = pd.DataFrame(kernels.to_rows(change(root)), columns=["node", "lo", "hi", "taxon"])
        out["taxon"] = out["taxon"].astype("Int32")
        return out.assign(tree=int(rows.tree.iloc[0]))[["tree", "node", "lo", "hi", "taxon"]]

    plain = nodes.select(F.col("tree").cast("long").alias("tree"), "lo", "hi", "taxon")
    return newick.with_parents(newick.with_masks(plain.groupBy("tree").applyInPandas(run, _ROWS), masks))


def refined(nodes: DataFrame, masks: Masks) -> DataFrame:
    return map_trees(nodes, kernels.resolve, masks)


def normalised(nodes: DataFrame, masks: Masks) -> DataFrame:
    return map_trees(nodes, kernels.isolate_first, masks)


def dense(similar: DataFrame, n: int) -> np.ndarray:
    """The matrix of all taxa, 1 on the diagonal, 0 for pairs that never meet. n squared numbers on the driver, as any guide tree needs."""
    s = np.eye(n)
    for r in similar.select("a", "b", "sim").toLocalIterator():
        s[r["a"], r["b"]] = s[r["b"], r["a"]] = r["sim"]
    return s


def nearest_rows(s: np.ndarray) -> np.ndarray:
    """For each taxon the others, most similar first; of equals the higher id."""
    n = len(s)
    return np.array([[y for y in sorted(range(n), key=lambda y: (-s[x, y], -y)) if y != x] for x in range(n)])


def _single_tree(spark, root: kernels.Node, masks: Masks) -> DataFrame:
    rows = spark.createDataFrame([(0, *r) for r in kernels.to_rows(root)], _ROWS)
    return newick.with_parents(newick.with_masks(rows, masks))


@dataclass
class Result:
    """The tree, and its score, which is computed when it is first asked for: a tree is never lost to a score that fails."""

    newick: str
    unresolved: bool
    scored: Callable[[], int]
    divisions: list[tuple[int, int, int, int, int]] = field(default_factory=list)

    @functools.cached_property
    def score(self) -> int:
        return self.scored()


#: Up to so many divisions the dynamic program is one bounded task; beyond, a job for each size of cluster.
ONE_TASK = 200_000


def best_divisions(splits: DataFrame, masks: Masks, one_task: int = ONE_TASK) -> DataFrame:
    """mask, total, lo, hi, weight of the best divisions, as decimal text so that any width fits. splits: parent, lo, hi, weight."""
    splits = durable(splits.select("parent", "lo", "hi", F.col("weight").cast("decimal(38,0)").alias("weight")))
    if splits.count() > one_task:
        return _best_by_size(splits, masks)
    full = (1 << masks.n) - 1

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = kernels.best_divisions(((masks.unpack(p), masks.unpack(a), masks.unpack(b), int(w)) for p, a, b, w in zip(rows.parent, rows.lo, rows.hi, rows.weight, strict=True)), full)
        return pd.DataFrame([tuple(map(str, r)) for r in out], columns=["mask", "total", "lo", "hi", "weight"])

    # at most one_task rows
    return splits.withColumn("weight", F.col("weight").cast("string")).groupBy(F.lit(0).alias("one")).applyInPandas(run, "mask string, total string, lo string, hi string, weight string")


def _best_by_size(splits: DataFrame, masks: Masks) -> DataFrame:
    """The same as DataFrame rounds: clusters of one size at a time take the best of their divisions, all smaller ones being known.

    A cluster without divisions counts 0. Of equal totals the division with the lesser lo is taken.
    """
    spark = splits.sparkSession
    kept = Rounds(spark)
    low = F.reverse("lo") if masks.wide else F.col("lo")
    sized = kept.keep(splits.withColumn("sz", masks.count(F.col("parent"))))
    sizes = [r["sz"] for r in sized.select("sz").distinct().orderBy("sz").collect()]  # at most a number for each taxon
    known = spark.createDataFrame([], T.StructType([*splits.select(F.col("parent").alias("mask")).schema, *splits.select(F.col("weight").alias("total"), "lo", "hi", "weight").schema]))
    for size in sizes:
        part = sized.filter(F.col("sz") == size)
        for side in ("lo", "hi"):
            part = part.join(known.select(F.col("mask").alias(side), F.col("total").alias(f"total_{side}")), side, "left")
        total = (F.col("weight") + F.coalesce("total_lo", F.lit(0)) + F.coalesce("total_hi", F.lit(0))).cast("decimal(38,0)")
        best = part.withColumn("total", total).groupBy("parent").agg(F.min(F.struct((-F.col("total")).alias("m"), low.alias("l"), "total", "lo", "hi", "weight")).alias("b"))
        known = kept.keep(known.unionByName(best.select(F.col("parent").alias("mask"), "b.total", "b.lo", "b.hi", "b.weight")))
    chosen = new = kept.keep(known.filter(F.col("mask") == masks.full))
    while not new.isEmpty():
        sides = new.select(F.explode(F.array("lo", "hi")).alias("mask")).distinct()
        new = kept.keep(known.join(sides, "mask", "left_semi"))
        chosen = kept.keep(chosen.unionByName(new))
    text = F.udf(lambda m: str(masks.unpack(m)), "string")  # a row for each node of one tree
    return chosen.select(text("mask").alias("mask"), F.col("total").cast("string"), text("lo").alias("lo"), text("hi").alias("hi"), F.col("weight").cast("string"))


def enrich(x: DataFrame, nodes: DataFrame, s: np.ndarray, masks: Masks, o: Options) -> DataFrame:
    """X with what the consensus of the trees proposes for its unresolved nodes, as sides without the anchor."""
    found = proposals(nodes, s, masks, o.seed, o.nearest_balls, o.random_leftovers, 0 if o.anchor is None else o.anchor)
    added = found.join(x, "mask", "left_anti").select("mask", masks.count(F.col("mask")).alias("sz"), F.lit(0).cast("long").alias("freq"))
    return x.unionByName(added)


def sampled_unions(x: DataFrame, nodes: DataFrame, guide: kernels.Node, masks: Masks, o: Options) -> DataFrame:
    """X with unions of the sides of multifurcating input nodes, as the guide tree has them on sampled taxa."""
    whole = F.concat("kids", F.array("outside"))
    sides = partitions.around(nodes, masks, root_too=True).select(F.filter(whole, lambda m: m != masks.empty).alias("sides")).filter("size(sides) between 4 and 31").distinct()
    clades, full, a = kernels.clades(guide), (1 << masks.n) - 1, o.anchor

    def run(parts):
        for p in parts:
            found = {m for row in p.sides for m in kernels.sample_multifurcation([masks.unpack(v) for v in row], clades, o.seed) if 2 <= m.bit_count() <= masks.n - 2}
            yield pd.DataFrame({"mask": [masks.pack(full & ~m if a is not None and m >> a & 1 else m) for m in sorted(found)]})

    emitted = sides.mapInPandas(run, f"mask {masks.type}").distinct()
    added = emitted.join(x, "mask", "left_anti").select("mask", masks.count(F.col("mask")).alias("sz"), F.lit(0).cast("long").alias("freq"))
    return x.unionByName(added)


def completed(nodes: DataFrame, masks: Masks, by_distance: bool = False, s: np.ndarray | None = None) -> tuple[DataFrame, kernels.Node]:
    """Every tree with all taxa, and the guide tree. by_distance: the nearest taxa are those fewest edges away."""
    s = dense(matrices.similarities(nodes), masks.n) if s is None else s
    near = nearest_rows(s)
    if by_distance:
        d = np.full_like(s, np.inf)
        for r in matrices.distances(nodes).toLocalIterator():
            d[r["a"], r["b"]] = d[r["b"], r["a"]] = r["dist"]
        near = nearest_rows(-d)
    return map_trees(nodes, lambda t: kernels.complete(t, s, near), masks), kernels.guide_tree(kernels.upgma(s), masks.n)


def _resolved_space(native: DataFrame, masks: Masks, o: Options, like: DataFrame) -> DataFrame:
    """The refined (and completed) trees with their guide, under numbers of their own: unresolved nodes propose nothing themselves, so a full search takes these besides."""
    out = durable(refined(native, masks))
    if o.completion:
        done, guide = completed(out, masks, o.by_distance)
        out = done.unionByName(_single_tree(native.sparkSession, guide, masks).withColumn("tree", F.lit(-1).cast("long")).select(done.columns))
    return out.withColumn("tree", -F.col("tree") - 3).select(like.columns)


def search_space(native: DataFrame, evidence: DataFrame, masks: Masks, o: Options) -> DataFrame:
    """parent, lo, hi: the divisions that the options allow. Searched are the evidence's trees, completed and enriched."""
    search, s, guide = evidence, None, None
    if o.completion or o.consensus or o.sample_input:
        s = dense(matrices.similarities(evidence), masks.n)
        guide = kernels.guide_tree(kernels.upgma(s), masks.n)
    whole = search
    if o.completion:
        whole = durable(completed(evidence, masks, o.by_distance, s)[0])
        search = whole.unionByName(_single_tree(native.sparkSession, guide, masks).withColumn("tree", F.lit(-1).cast("long")).select(whole.columns))
    if o.full_search and o.keep_multifurcations:
        search = search.unionByName(_resolved_space(native, masks, o, search))
    search = durable(search) if search is not evidence else search
    moves = transitions.from_nodes(search, masks)
    if o.anchor is None:
        moves = moves.unionByName(transitions.from_incomplete(search, masks)).distinct()
    if o.full_search or o.consensus or o.sample_input:
        x = clusters.cluster_table(search, masks, o.anchor)
        if o.sample_input:
            x = durable(sampled_unions(x, whole, guide, masks, o))
        if o.consensus:
            x = durable(enrich(x, whole, s, masks, o))
        moves = moves.unionByName(transitions.across_trees(x, masks)).distinct()
    if o.anchor is not None:
        moves = transitions.anchored(moves, masks, o.anchor)
    return durable(moves)


def infer_nodes(native: DataFrame, masks: Masks, names: list[str], o: Options = Options()) -> Result:
    """The best tree for parsed gene trees. Searched are refined (completed, enriched) trees; the evidence stays what was read."""
    spark = native.sparkSession
    native = durable(native)
    evidence = durable(normalised(native, masks) if o.keep_multifurcations else refined(native, masks))
    moves = search_space(native, evidence, masks, o)
    if o.prune:
        moves = durable(transitions.reachable(moves, masks))
    parts = durable(partitions.partition_table(evidence, masks))
    exact = _number(native, masks)
    weighed = moves.join(weights.split_weights(moves, parts, masks, exact), ["lo", "hi"])
    chosen = [tuple(int(v) for v in r) for r in best_divisions(weighed, masks).toLocalIterator()]
    full = (1 << masks.n) - 1
    root, unresolved = kernels.tree_of({m: (lo, hi) for m, _, lo, hi, _ in chosen}, full)
    total = next((t for m, t, *_ in chosen if m == full), 0)
    if o.random_leftovers and unresolved:
        import random

        root = kernels.resolve(root, random.Random(o.seed))
    poly = native.filter("n_children > 2 and not (parent is null and n_children = 3)").limit(1).count() > 0
    if total % 2:
        raise ArithmeticError("an odd total: every quartet is counted at both ends of its path")

    def scored() -> int:
        if not unresolved and (not poly or o.keep_multifurcations):
            return total // 2
        # the total holds for the refined input only
        kept = durable(partitions.partition_table(normalised(native, masks), masks))
        return int(weights.fixed_tree_score(_single_tree(spark, root, masks), kept, masks, exact).first()[0])

    return Result(kernels.to_newick(root, names), unresolved, scored, chosen)


def _number(nodes: DataFrame, masks: Masks) -> str:
    """The type that sums of quartets fit."""
    return "decimal(38,0)" if weights.is_wide(masks.n, nodes.select("tree").distinct().count()) else "long"


def universe(trees: DataFrame, keep: DataFrame | None) -> tuple[DataFrame, list[str], Masks]:
    names = newick.taxa(trees)
    if keep is not None:
        from pyspark.sql import Window

        names = names.join(keep.select("name").distinct(), "name", "left_semi").select((F.row_number().over(Window.orderBy("taxon")) - 1).cast("int").alias("taxon"), "name")
    listed = [r["name"] for r in names.orderBy("taxon").collect()]
    if keep is not None and len(listed) < 4:
        raise ValueError("fewer than four taxa are common to the list and the input")
    return names, listed, Masks(len(listed))


def infer(trees: DataFrame, o: Options = Options(), keep: DataFrame | None = None) -> Result:
    """tree, newick in. keep: a list of taxon names; the others are cut before anything else."""
    names, listed, masks = universe(trees, keep)
    return infer_nodes(newick.parse(trees, names, masks, keep), masks, listed, o)


def score(genes: DataFrame, species: DataFrame, keep: DataFrame | None = None) -> int:
    """Agreeing quartets of a given tree; without a list it must have exactly the genes' taxa."""
    if keep is None:
        newick.check_species(species, newick.taxa(genes))
    else:
        keep = keep.select("name").intersect(newick.taxa(species).select("name"))
    names, _, masks = universe(genes, keep)
    g = durable(normalised(newick.parse(genes, names, masks, keep), masks))
    parsed = newick.parse(species, names, masks, keep)
    left = parsed.filter("taxon is not null").agg(F.count("*"), F.countDistinct("tree")).first()
    if tuple(left) != (masks.n, 1):
        raise newick.StrictTreeError(f"the species tree keeps {left[0]} of {masks.n} taxa")
    s = normalised(parsed, masks)
    parts = durable(partitions.partition_table(g, masks))
    return int(weights.fixed_tree_score(s, parts, masks, _number(g, masks)).first()[0])


def annotated(genes: DataFrame, species: DataFrame, prior: float = 0.5) -> DataFrame:
    """Support of every eligible branch, by the node's place (lo, hi) in the species tree."""
    newick.check_strict(species)
    newick.check_species(species, newick.taxa(genes))
    names, _, masks = universe(genes, None)
    g, s = newick.parse(genes, names, masks), newick.parse(species, names, masks)
    branch = support.branches(s, masks)
    found = support.annotate(support.quartet_frequencies(branch, support.gene_sides(g, masks), masks), branch, masks, prior)
    return found.join(s.select("node", "lo", "hi", "mask"), "node")


def support_newick(species: DataFrame, labels: DataFrame, names: DataFrame, masks: Masks) -> str:
    """The species tree with a label and length for each annotated branch. labels: node, label, length."""
    nodes = newick.parse(species, names, masks)
    rows = nodes.join(labels.withColumnRenamed("length", "new_length").withColumnRenamed("label", "new_label"), "node", "left").join(names, "taxon", "left")
    found = rows.collect()  # one tree
    below: dict[int | None, list] = {}
    for r in sorted(found, key=lambda r: r["lo"]):
        below.setdefault(r["parent"], []).append(r)
    text: dict[int, str] = {}
    for r in sorted(found, key=lambda r: -r["lvl"]):
        if r["taxon"] is not None:
            text[r["node"]] = kernels.quoted(r["name"]) + ("" if r["length"] is None else f":{r['length']}")
        else:
            inner = ",".join(text[k["node"]] for k in below[r["node"]])
            text[r["node"]] = f"({inner}){r['new_label'] or ''}" + ("" if r["new_length"] is None else f":{r['new_length']}")
    return text[below[None][0]["node"]] + ";"
