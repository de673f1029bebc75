"""Branch support: quartet frequencies around each branch, local posterior, length and p-value."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_EVEN, Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stats
from ..functions.masks import Masks


def branches(species: DataFrame, masks: Masks) -> DataFrame:
    """node, c1, c2, sister, remaining: the four groups around each branch that is eligible.

    Left out are leaves, the root, multifurcations, children of multifurcations (but for a root of three), and a
    child of a two-sided root whose sister isn't binary. Of two children of such a root one branch is told.
    """
    s = species.select("node", "parent", "n_children", "child_ord", "mask")
    root = s.filter("parent is null").select(F.col("node").alias("root"), F.col("mask").alias("everything"), F.col("n_children").alias("root_n"))
    kid = lambda k, name: s.filter(f"child_ord = {k} and parent is not null").select(F.col("parent").alias("node"), F.col("mask").alias(name))
    cand = s.filter("parent is not null and n_children = 2").join(kid(1, "c1"), "node").join(kid(0, "c2"), "node").crossJoin(root)
    up = s.select(F.col("node").alias("parent"), F.col("n_children").alias("up_n"), F.col("mask").alias("up_mask"))
    cand = cand.join(up, "parent")
    sib = s.filter("parent is not null").select("parent", F.col("node").alias("sib"), F.col("mask").alias("sib_mask"), F.col("n_children").alias("sib_n"), F.col("child_ord").alias("sib_ord"))
    # the sister: the next child of the parent, or the first
    near = cand.join(sib, "parent").filter("sib <> node").groupBy("node").agg(F.min_by("sib", F.struct(F.col("sib_ord") < F.col("child_ord"), "sib_ord")).alias("sib"))
    cand = cand.join(near, "node").join(sib.select("sib", "sib_mask", "sib_n"), "sib")
    at_root = F.col("parent") == F.col("root")
    cand = cand.filter((F.col("up_n") == 2) | (at_root & (F.col("up_n") == 3)))
    two = at_root & (F.col("up_n") == 2)
    cand = cand.filter(~two | ((F.col("sib_n") == 2) & (F.col("child_ord") == 0)))
    s1, s0 = kid(1, "n1").withColumnRenamed("node", "sib"), kid(0, "n0").withColumnRenamed("node", "sib")
    cand = cand.join(s1, "sib", "left").join(s0, "sib", "left")
    sister = F.when(two, F.col("n1")).otherwise(F.col("sib_mask"))
    out = cand.select("node", "c1", "c2", sister.alias("sister"), "everything")
    held = masks.either(masks.either(F.col("c1"), F.col("c2")), F.col("sister"))
    return out.select("node", "c1", "c2", "sister", masks.less(F.col("everything"), held).alias("remaining"))


def quartet_frequencies(branch: DataFrame, gene_sides: DataFrame, masks: Masks) -> DataFrame:
    """node, f1, f2, f3, n_genes: per branch the mean share of each pairing over gene trees that have all four groups.

    gene_sides: tree, sides, whole (its taxa), for each inner node. For the pairing xy|zw the quartets whose x and y
    part from z and w at a node: x and y in two sides, z and w in a third together. Each quartet has two such nodes.
    """
    # every branch of one summary tree with every node: branches are dealt to chunks of 256, nodes stand once in each
    n = branch.count()
    chunks = max(1, -(-n // 256))
    per = branch.withColumn("chunk", F.pmod(F.xxhash64("node"), F.lit(chunks)).cast("int"))
    seats = gene_sides.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    per = seats.join(F.broadcast(per) if n <= 100_000 else per, "chunk")
    g = [F.col(x) for x in ("c1", "c2", "sister", "remaining")]

    def pairing(x: int, y: int, z: int, w: int) -> Column:
        add = lambda v: F.aggregate(v, F.lit(0).cast("long"), lambda t, q: t + q)
        cell = lambda m: F.transform(F.col("sides"), lambda s: masks.shared(s, m))

        def one_way(x: Column, y: Column, z: Column, w: Column) -> Column:
            # z and w together in side s, x and y in two different other sides
            tx, ty, txy = add(cell(x)), add(cell(y)), add(F.zip_with(cell(x), cell(y), lambda a, b: a * b))
            return add(F.transform(F.col("sides"), lambda s: masks.shared(s, z) * masks.shared(s, w) * ((tx - masks.shared(s, x)) * (ty - masks.shared(s, y)) - (txy - masks.shared(s, x) * masks.shared(s, y)))))

        return one_way(g[x], g[y], g[z], g[w]) + one_way(g[z], g[w], g[x], g[y])

    sizes = [masks.shared(m, F.col("whole")) for m in g]
    per = per.withColumn("product", sizes[0] * sizes[1] * sizes[2] * sizes[3]).filter("product > 0")
    rows = per.select("node", "tree", "product", pairing(0, 1, 2, 3).alias("q1"), pairing(0, 2, 1, 3).alias("q2"), pairing(0, 3, 1, 2).alias("q3"))
    by_tree = rows.groupBy("node", "tree", "product").agg(*[F.sum(q).alias(q) for q in ("q1", "q2", "q3")])
    share = lambda q: F.sum(F.col(q) / (2 * F.col("product"))).alias("f" + q[1])
    return by_tree.groupBy("node").agg(share("q1"), share("q2"), share("q3"), F.count("*").alias("n_genes"))


def gene_sides(nodes: DataFrame, masks: Masks) -> DataFrame:
    """tree, sides, whole for every inner node; a two-sided root is left out."""
    from .partitions import around

    rows = around(nodes, masks, root_too=True).join(nodes.filter("parent is null").select("tree", F.col("mask").alias("whole")), "tree")
    sides = F.filter(F.concat("kids", F.array("outside")), lambda m: m != masks.empty)
    return rows.select("tree", sides.alias("sides"), "whole").filter("size(sides) > 2")


_OUT = "node long, q1 double, q2 double, q3 double, f1 double, f2 double, f3 double, pp1 double, pp2 double, pp3 double, qc double, en double, pvalue double, length double"


def annotate(frequencies: DataFrame, branch: DataFrame, masks: Masks, prior: float = 0.5) -> DataFrame:
    """All figures of each branch. en: genes, or the sum of the shares where quartets are unresolved. pvalue: null up to 15 genes."""
    total = F.col("f1") + F.col("f2") + F.col("f3")
    en = F.when(F.abs(F.col("n_genes") - total) > 1e-11, total).otherwise(F.col("n_genes").cast("double"))
    sizes = [masks.count(F.col(c)) for c in ("c1", "c2", "sister", "remaining")]
    rows = frequencies.join(branch, "node").select("node", "f1", "f2", "f3", en.alias("en"), (sizes[0] * sizes[1] * sizes[2] * sizes[3]).cast("double").alias("qc"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            out = []
            for r in p.itertuples():
                f = (r.f1, r.f2, r.f3)
                post = [stats.local_posterior(f[i], f[(i + 1) % 3], f[(i + 2) % 3], r.en, prior) for i in range(3)]
                out.append((r.node, *[x / r.en if r.en else 0.0 for x in f], *f, *post, r.qc, r.en, stats.polytomy_pvalue(*f, r.en), stats.branch_length(r.f1, r.en, prior)))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in _OUT.split(", ")])

    return rows.mapInPandas(run, _OUT)


def low_n(annotated: DataFrame, least: float = 20.0) -> DataFrame:
    """One row: branches with few effective genes, and the sum of log posteriors."""
    return annotated.agg(F.count_if(F.col("en") < least).alias("low"), F.sum(F.log("pp1")).alias("log_posterior"))


def short_text(x: float | None, digits: int) -> str:
    """At most so many decimals, half to even of the number as it is stored; no trailing zeros; groups of three before the point."""
    if x is None or x != x:
        return "NaN"
    text = f"{Decimal(x).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_EVEN):,f}"
    text = text.rstrip("0").rstrip(".") if "." in text else text
    return "0" if text == "-0" else text


def _short(digits: int):
    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda v: short_text(v, digits))

    return run


#: What a branch may be annotated with: names of the styles, as users write them.
STYLES = ("none", "q1", "pvalue", "pp", "percent", "full", "q3", "pp3")


def label(annotated: DataFrame, style: str) -> DataFrame:
    """node, label, length. q1: per cent of the first pairing; percent: the posterior in whole per cent; full: unrounded."""
    two, five = _short(2), _short(5)
    named = lambda **cs: F.concat(F.lit("'["), F.concat_ws(";", *[F.concat(F.lit(k + "="), v) for k, v in cs.items()]), F.lit("]'"))
    whole = lambda *cs: {c: F.col(c).cast("string") for c in cs}
    styles = {
        "none": lambda: F.lit(""),
        "pp": lambda: two(F.col("pp1")),
        "q1": lambda: F.when(F.col("en") != 0, two(F.col("f1") / F.nullif(F.col("en"), F.lit(0.0)) * 100)).otherwise(F.lit("")),
        "percent": lambda: F.floor(two(F.col("pp1")).cast("double") * 100 + 0.5).cast("string"),
        "pvalue": lambda: F.when(F.col("pvalue").isNull(), F.lit("NA")).otherwise(five(F.coalesce("pvalue", F.lit(0.0)))),
        "pp3": lambda: named(**{c: two(F.col(c)) for c in ("pp1", "pp2", "pp3")}),
        "q3": lambda: named(**{c: two(F.col(c)) for c in ("q1", "q2", "q3")}),
        "full": lambda: named(**whole("q1", "q2", "q3", "f1", "f2", "f3", "pp1", "pp2", "pp3"), QC=F.col("qc").cast("long").cast("string"), EN=F.col("en").cast("string")),
    }
    return annotated.select("node", styles[style]().alias("label"), "length")
