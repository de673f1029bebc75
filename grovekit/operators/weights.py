"""Quartet weights: how many quartets of the gene trees agree with a split of a cluster or with a node."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.masks import Masks

PARTITIONS_IN_BLOCK = 8192
PAIRS_WORTH_A_TASK = 20_000


def c2(x: Column) -> Column:
    return F.when(x > 1, F.expr("1L") * x * (x - 1) / 2).otherwise(0).cast("long")


def is_wide(n_taxa: int, n_trees: int) -> bool:
    """Whether sums may leave 64 bits: trees times n**4 / 12 above an eighth of the largest BIGINT."""
    return n_trees * n_taxa**4 / 12 > (2**63 - 1) / 8


def twice_binary(x: list[Column], y: list[Column], masks: Masks, exact: str = "long") -> Column:
    """Twice the agreeing quartets of two tripartitions: sum over the six ways to pair their sides."""
    n = [[masks.shared(a, b).cast(exact) for b in y] for a in x]
    total = None
    for i, j, k in ((0, 1, 2), (0, 2, 1), (1, 0, 2), (1, 2, 0), (2, 0, 1), (2, 1, 0)):
        a, b, c = n[0][i], n[1][j], n[2][k]
        term = a * b * c * F.greatest(a + b + c - 3, F.lit(0).cast(exact))
        total = term if total is None else total + term
    return total


def twice_any(x: list[Column], parts: Column, masks: Masks, exact: str = "long") -> Column:
    """The same against d parts, in time d: triples of distinct parts from sums of powers and products."""

    def step(s: Column, p: Column) -> Column:
        a, b, c = (masks.shared(v, p).cast(exact) for v in x)
        new = {"a": a, "b": b, "c": c, "aa": a * a, "bb": b * b, "cc": c * c, "ab": a * b, "ac": a * c, "bc": b * c, "aab": a * a * b, "aac": a * a * c, "abb": a * b * b, "bbc": b * b * c, "acc": a * c * c, "bcc": b * c * c, "abc": a * b * c, "aabc": a * a * b * c, "abbc": a * b * b * c, "abcc": a * b * c * c}
        return F.struct(*[(s[k] + v).cast(exact).alias(k) for k, v in new.items()])

    names = ("a", "b", "c", "aa", "bb", "cc", "ab", "ac", "bc", "aab", "aac", "abb", "bbc", "acc", "bcc", "abc", "aabc", "abbc", "abcc")
    zero = F.struct(*[F.lit(0).cast(exact).alias(k) for k in names])

    def distinct(s: Column, p: str, q: str, r: str, pq: str, pr: str, qr: str, pqr: str) -> Column:
        return s[p] * s[q] * s[r] - s[pq] * s[r] - s[pr] * s[q] - s[qr] * s[p] + 2 * s[pqr]

    def done(s: Column) -> Column:
        return (
            distinct(s, "aa", "b", "c", "aab", "aac", "bc", "aabc")
            + distinct(s, "a", "bb", "c", "abb", "ac", "bbc", "abbc")
            + distinct(s, "a", "b", "cc", "ab", "acc", "bcc", "abcc")
            - 3 * distinct(s, "a", "b", "c", "ab", "ac", "bc", "abc")
        )

    return F.aggregate(parts, zero, step, done)


def node_score(sides: Column, parts: Column, masks: Masks, exact: str = "long") -> Column:
    """Agreeing quartets of a node with any number of sides and a partition, each seen from this node.

    For each pair of taxa in one cell of the table sides x parts, the pairs in other rows, other columns and not both
    in one row or column, by sums of squares.
    """
    zero = F.lit(0).cast(exact)
    table = F.transform(sides, lambda s: F.transform(parts, lambda p: masks.shared(s, p).cast(exact)))
    add = lambda v: F.aggregate(v, zero, lambda t, x: (t + x).cast(exact))
    square = lambda x: (x * x).cast(exact)
    columns = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: add(F.transform(table, lambda r: F.element_at(r, k))))
    pairs = lambda x: _half(F.when(x > 1, x * (x - 1)).otherwise(zero), 2, exact != "long")

    def of_row(r: Column, i: Column) -> Column:
        def cell(n: Column, k: Column) -> Column:
            row, col = add(r), F.element_at(columns, k + 1)
            total = add(columns) - row - col + n
            rows2 = add(F.transform(table, lambda q, j: F.when(j == i, zero).otherwise(square(add(q) - F.element_at(q, k + 1)))))
            cols2 = add(F.transform(columns, lambda c, j: F.when(j == k, zero).otherwise(square(c - F.element_at(r, j + 1)))))
            cells2 = add(F.transform(table, lambda q, j: F.when(j == i, zero).otherwise(add(F.transform(q, lambda m, l: F.when(l == k, zero).otherwise(square(m)))))))  # noqa: E741
            return F.when(n > 1, (pairs(n) * _half(total * total - rows2 - cols2 + cells2, 2, exact != "long")).cast(exact)).otherwise(zero)

        return add(F.transform(r, cell))

    return add(F.transform(table, of_row))


def _met(splits: DataFrame, partitions: DataFrame) -> DataFrame:
    """Every split with every partition, dealt to tasks as a grid: blocks of partitions by blocks of splits.

    A cell has at most PARTITIONS_IN_BLOCK of either, and there are at least as many cells as the cluster has cores,
    so long as there is work for them; no key has more than its cell.
    """
    spark = partitions.sparkSession
    n_parts, n_splits, cores = partitions.count(), splits.count(), spark.sparkContext.defaultParallelism
    rows = max(1, -(-n_parts // PARTITIONS_IN_BLOCK), min(cores, n_parts * n_splits // PAIRS_WORTH_A_TASK, n_parts))
    cols = max(1, -(-n_splits // PARTITIONS_IN_BLOCK))
    seat = lambda df, n: F.pmod(F.xxhash64(*df.columns), F.lit(n)).cast("int")
    asked = splits.withColumn("col", seat(splits, cols)).withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))))
    blocks = partitions.withColumn("row", seat(partitions, rows)).withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(cols - 1))))
    return asked.join(blocks, ["row", "col"])


def split_weights(splits: DataFrame, partitions: DataFrame, masks: Masks, exact: str = "long") -> DataFrame:
    """lo, hi, weight: the agreeing quartets of the tripartition (lo, hi, all others), over all partitions.

    exact: "decimal(38,0)" where sums may leave 64 bits. The products are summed before anything is shuffled. The
    splits and partitions are counted and then read, so both are best kept at hand (persisted or written).
    """
    wide = exact != "long"
    kind = "decimal(38,0)" if wide else "long"
    asked = splits.select("lo", "hi").distinct()
    met = _met(asked, partitions).withColumn("rest", masks.rest(masks.either(F.col("lo"), F.col("hi"))))
    x = [F.col("lo"), F.col("hi"), F.col("rest")]
    y = [F.element_at("parts", k) for k in (1, 2, 3)]
    twice = F.when(F.col("d") == 3, twice_binary(x, y, masks, exact)).otherwise(twice_any(x, F.col("parts"), masks, exact))
    summed = met.groupBy("lo", "hi").agg(_half(F.sum(twice * F.col("freq")), 2, wide).alias("weight"))
    return asked.join(summed, ["lo", "hi"], "left").select("lo", "hi", F.coalesce("weight", F.lit(0)).cast(kind).alias("weight"))


def _half(total: Column, by: int, wide: bool) -> Column:
    """total / by for an even total, or one divisible by four."""
    return (total.cast("decimal(38,0)") / by).cast("decimal(38,0)") if wide else F.shiftright(total.cast("long"), by // 2)


def weight_stats(weights: DataFrame) -> DataFrame:
    return weights.agg(F.count("*").alias("splits"), F.max("weight").alias("most"), F.sum("weight").cast("long").alias("total"))


def species_sides(species: DataFrame, masks: Masks) -> DataFrame:
    """node, sides: the sets around every node of a summary tree with at least three of them. A two-sided root has none of its own."""
    from .partitions import around

    rows = around(species, masks, root_too=True)
    sides = F.filter(F.concat("kids", F.array("outside")), lambda m: m != masks.empty)
    return rows.select("node", sides.alias("sides")).filter("size(sides) > 2")


def fixed_tree_score(species: DataFrame, partitions: DataFrame, masks: Masks, exact: str = "long") -> DataFrame:
    """One row, quartet_score: each agreeing quartet is seen from two nodes, so the sum is halved. A root with two sides repeats what its children have."""
    wide = exact != "long"
    met = _met(species_sides(species, masks).select("sides"), partitions)
    x = [F.element_at("sides", k) for k in (1, 2, 3)]
    y = [F.element_at("parts", k) for k in (1, 2, 3)]
    three = F.when(F.col("d") == 3, twice_binary(x, y, masks, exact)).otherwise(twice_any(x, F.col("parts"), masks, exact))
    twice = F.when(F.size("sides") == 3, three).otherwise(2 * node_score(F.col("sides"), F.col("parts"), masks, exact))
    return met.agg(_half(F.coalesce(F.sum(twice * F.col("freq")), F.lit(0)), 4, wide).alias("quartet_score"))
