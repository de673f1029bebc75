"""Mixing sources by temperature: exponentiated token shares, realised as budgeted block permutations.

The weights of the sources are their token shares to a power, normalised. The power is found by bisection: the
largest one whose entropy reaches a target, or the smallest that keeps the repetition of every source within a
limit, if that is larger. Each source then goes through its documents in epochs, each epoch in a seeded order of
its own, until its share of the token budget is used. The sequence of all sources is cut into blocks of a token
budget; each block takes an equal stretch of every source and is permuted by itself.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import body, durable, free_names, squeezed


def weights(tokens: np.ndarray, power: float) -> np.ndarray:
    """Shares of the sources before they are normalised, relative to the largest."""
    return (tokens / tokens.max()) ** power


def entropy(w: np.ndarray, number: np.ndarray) -> float:
    """Of the normalised weights, where `number` sources have each."""
    total = float((number * w).sum())
    x = w / total
    return float(-(number * np.where(x > 0, x * np.log(np.where(x > 0, x, 1.0)), 0.0)).sum())


def bisect(holds, low: float = 0.0, high: float = 1.0, steps: int = 60) -> float:
    """The largest power at which holds is true; it is true at low and turns false once at most."""
    if holds(high):
        return high
    for _ in range(steps):
        mid = (low + high) / 2
        low, high = (mid, high) if holds(mid) else (low, mid)
    return low


@dataclass(frozen=True)
class Mixture:
    """A source with t tokens has (t / top) ** power / norm of the budget."""

    power: float
    budget: float
    top: float
    norm: float

    def quota(self, tokens: float) -> float:
        return (tokens / self.top) ** self.power / self.norm * self.budget


def solve(tokens: list[int], number: list[int], entropy_share: float, most_repeats: float, budget: float | None = None) -> Mixture:
    """The mixture for sources with the given tokens (all above 0), of which there are so many each.

    entropy_share: of the entropy of equal weights. budget: tokens of the mixture; by default the fewest at which
    every document comes at least once.
    """
    t, k = np.array(tokens, float), np.array(number, float)
    full = math.log(k.sum()) if k.sum() > 1 else 0.0

    def size(w: np.ndarray) -> float:
        return budget or float((t * (k * w).sum() / w).max())

    def repeats(power: float) -> float:
        w = weights(t, power)
        return float((size(w) * w / (k * w).sum() / t).max())

    by_entropy = bisect(lambda a: entropy(weights(t, a), k) >= entropy_share * full - 1e-12)
    # repetition falls as the power rises: the smallest power that keeps the limit
    by_repeats = 1.0 - bisect(lambda b: repeats(1.0 - b) <= most_repeats + 1e-9)
    power = max(by_entropy, by_repeats)
    w = weights(t, power)
    return Mixture(power, size(w), float(t.max()), float((k * w).sum()))


def _tokens(text: Column) -> Column:
    """Words, at least 1 so that each document has a place in the sequence."""
    t = F.trim(squeezed(text))
    return F.greatest(F.lit(1), F.octet_length(t) - F.octet_length(F.replace(t, F.lit(" "), F.lit(""))) + 1).cast("long")


def _units(docs: DataFrame, source: str) -> DataFrame:
    """Rows alike in doc_id, text and source are one unit with their number."""
    text = body(docs)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), docs[source].cast("string").alias("source"), _tokens(text).alias("tokens"))
    return durable(rows.groupBy("doc_id", "text_hash", "source", "tokens").agg(F.count("*").alias("rows")))


def place_units(units: DataFrame, entropy_share: float, most_repeats: float, budget: float | None, block_tokens: int, seed: int) -> tuple[DataFrame, Mixture | None]:
    """A row for each unit and epoch it is taken in: doc_id, text_hash, source, tokens, rows, epoch, block.

    The driver holds how many sources have each total of tokens. Totals that differ sum up to at least half the square
    of their number, so of T tokens there are at most sqrt(2 * T) of them, however many sources there are.
    """
    sums = durable(units.groupBy("source").agg(F.sum(F.col("tokens") * F.col("rows")).alias("total"), F.count("*").alias("n")))
    totals = sums.groupBy("total").agg(F.count("*").alias("sources")).toPandas().sort_values("total")
    mixture = solve(totals["total"], totals["sources"], entropy_share, most_repeats, budget) if len(totals) else None
    m = mixture or Mixture(1.0, 1.0, 1.0, 1.0)
    n_blocks = max(1, math.ceil(m.budget / block_tokens))
    quota = F.pow(F.col("total") / F.lit(m.top), F.lit(m.power)) / F.lit(m.norm) * F.lit(m.budget)
    per_source = sums.select(F.col("source").alias("s_source"), F.col("total").cast("double").alias("total"), quota.alias("quota"), F.ceil(F.sqrt("n")).cast("int").alias("buckets"))
    per_source = per_source.withColumn("epochs", F.floor(F.col("quota") / F.col("total") + 1e-9).cast("int"))
    # up to 50,000 sources are a small table; of more, Spark joins by source and divides what is skewed
    few = int(totals["sources"].sum()) <= 50_000
    rows = units.join(F.broadcast(per_source) if few else per_source, F.col("source").eqNullSafe(F.col("s_source"))).drop("s_source")
    rows = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("epochs"))))
    rows = rows.withColumn("draw", F.pmod(F.xxhash64(F.lit(seed), "epoch", "doc_id", "text_hash"), F.lit(1 << 40)))
    # the order of an epoch is cut into about as many buckets as each has units
    rows = rows.withColumn("bucket", F.floor(F.col("draw") * F.col("buckets") / float(1 << 40)).cast("int")).withColumn("mass", F.col("tokens") * F.col("rows"))
    key = ["source", "epoch", "bucket"]
    sized = rows.groupBy(*key).agg(F.sum("mass").alias("bucket_mass"))
    before = F.sum("bucket_mass").over(Window.partitionBy("source", "epoch").orderBy("bucket")) - F.col("bucket_mass")
    sized = sized.select(*[F.col(c).alias(f"b_{c}") for c in key], before.alias("before"))
    on = F.col("source").eqNullSafe(F.col("b_source")) & (F.col("epoch") == F.col("b_epoch")) & (F.col("bucket") == F.col("b_bucket"))
    inside = Window.partitionBy(*key).orderBy("draw", "doc_id", "text_hash")
    rows = rows.join(sized, on).withColumn("before", F.col("before") + F.sum("mass").over(inside) - F.col("mass"))
    left = F.col("quota") - F.col("epochs") * F.col("total")  # for the last, broken epoch
    rows = rows.filter((F.col("epoch") < F.col("epochs")) | (F.col("before") + F.col("mass") <= left))
    part = (F.col("epoch") * F.col("total") + F.col("before")) / F.greatest("quota", F.lit(1.0))
    rows = rows.withColumn("block", F.least(F.lit(n_blocks - 1), F.floor(part * n_blocks)).cast("long"))
    return rows.select("doc_id", "text_hash", "source", "tokens", "rows", "epoch", "block"), mixture


def mix(docs: DataFrame, source: str = "source", entropy_share: float = 0.98, most_repeats: float = 2.0, budget: float | None = None, block_tokens: int = 1 << 17, seed: int = 20) -> DataFrame:
    """A row for each time a document is placed: doc_id, source, tokens, epoch, block, slot (from 0 in its block).

    Without a budget every document comes at least once. A null text counts one token, as an empty one; a null
    source is a source; repeated rows are placed side by side, each in a slot of its own; extra columns are ignored;
    an empty table gives an empty result.
    """
    placed, _ = place_units(_units(docs, source), entropy_share, most_repeats, budget, block_tokens, seed)
    each = placed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
    order = Window.partitionBy("block").orderBy(F.xxhash64(F.lit(seed), "block", "epoch", "doc_id", "text_hash"), "doc_id", "text_hash", "source", "epoch", "copy")
    return each.select("doc_id", "source", "tokens", F.col("epoch").cast("long").alias("epoch"), "block", (F.row_number().over(order) - 1).cast("long").alias("slot"))


def mixed_documents(docs: DataFrame, source: str = "source", entropy_share: float = 0.98, most_repeats: float = 2.0, seed: int = 20) -> DataFrame:
    """The documents with their own columns, each as often as the mixture takes it, once at least.

    Null texts and sources, repeated rows and empty tables are treated as in mix().
    """
    units = _units(docs, source)
    placed, _ = place_units(units, entropy_share, most_repeats, None, 1 << 17, seed)
    taken = placed.groupBy("doc_id", "text_hash", "source").agg(F.count("*").cast("int").alias("times"))
    i, h, s, t, turn, mark = free_names(docs, "unit_doc", "unit_hash", "unit_source", "times", "turn", "text_mark")
    taken = taken.select(F.col("doc_id").alias(i), F.col("text_hash").alias(h), F.col("source").alias(s), F.col("times").alias(t))
    rows = docs.withColumn(mark, F.xxhash64(body(docs)))
    on = rows["doc_id"].cast("long").eqNullSafe(taken[i]) & (rows[mark] == taken[h]) & rows[source].cast("string").eqNullSafe(taken[s])
    return rows.join(taken, on).withColumn(turn, F.explode(F.sequence(F.lit(1), F.col(t)))).select(*docs.columns)
