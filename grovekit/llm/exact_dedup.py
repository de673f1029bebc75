"""Exact duplicates by a tree-merge of sorted digest runs, with DataFrame operations only.

The rows are spread over fan**2 leaves by a hash of their identifier. Each leaf makes a sorted run: one entry
per digest with the smallest identifier and a count. Then two binomial rounds of radix `fan` follow. In each
round, `fan` partners exchange slices of their runs (recursive halving of the digest space, so no partition ever
holds all digests), merge what they receive in digest order and keep the smallest identifier of each digest. An
entry merges with another only if the length and a second digest agree as well (verification). The radix grows
with the square root of the number of rows, so a leaf or a node of the last round has about a million at most.

A hot group of copies has at most one entry per leaf after the first step, at most `fan` after the first round.
The results go back the same way: root to leaf runs by digest, leaf runs to rows by leaf and digest, so that no
join meets more than a leaf's share of a group in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import body, durable, free_names, squeezed

_KEY = ("digest", "n_bytes", "second")


def _entries(docs: DataFrame) -> DataFrame:
    """doc_id, uid (tells repeated rows apart) and the key of the normalised text."""
    text = squeezed(body(docs))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text.alias("t")).select(
        "doc_id",
        F.unhex(F.sha2("t", 256)).alias("digest"),
        F.octet_length("t").cast("long").alias("n_bytes"),
        F.xxhash64("t").alias("second"),
    )
    return durable(rows.withColumn("uid", F.monotonically_increasing_id()))


def radix(rows: int, in_leaf: int = 1_000_000) -> int:
    """The fan of two rounds that gives leaves of about in_leaf rows, 16 at least."""
    return max(16, math.isqrt(rows // in_leaf) + 1)


def _merge(runs: DataFrame, *node: str) -> DataFrame:
    """One multiway merge: the runs that meet in a node, in digest order."""
    met = runs.repartition(*node).sortWithinPartitions(*node, *_KEY)
    return met.groupBy(*node, *_KEY).agg(F.min("first").alias("first"), F.sum("n").alias("n"))


def merge_runs(entries: DataFrame, fan: int) -> tuple[DataFrame, DataFrame]:
    """The leaf runs, and the root: one row per distinct text with first (doc_id, uid) and n."""
    # nulls sort first in Spark's min of structs, so a null identifier is put behind all others
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "uid")
    leaf_runs = _merge(entries.select("leaf", *_KEY, first.alias("first"), F.lit(1).cast("long").alias("n")), "leaf")
    piece = F.conv(F.substring(F.hex("digest"), 1, 12), 16, 10).cast("long")
    runs = leaf_runs.select(
        (F.col("leaf") / fan).cast("int").alias("origin"),
        F.pmod(piece, F.lit(fan)).cast("int").alias("low"),
        F.pmod(F.floor(piece / fan), F.lit(fan)).cast("int").alias("high"),
        *_KEY, "first", "n",
    )
    runs = _merge(runs, "origin", "low", "high")  # round one: partners share the origin
    return leaf_runs, _merge(runs.drop("origin"), "low", "high").drop("low", "high")  # round two: all origins


def exact_dedup(docs: DataFrame, fan: int | None = None) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    A null text counts as empty. Of repeated rows with the smallest identifier exactly one is kept. A null
    doc_id loses against any other; if all are null, keep_id is null. Extra columns are ignored; an empty
    table gives an empty result.
    """
    entries = _entries(docs)
    fan = fan or radix(entries.count())
    entries = entries.withColumn("leaf", F.pmod(F.xxhash64("doc_id", "uid"), F.lit(fan * fan)).cast("int"))
    leaf_runs, root = merge_runs(entries, fan)
    root = root.select(*_KEY, F.col("first.doc_id").alias("keep_id"), F.col("first.uid").alias("keep_uid"), F.col("n").alias("group_size"))
    down = leaf_runs.select("leaf", *_KEY).join(root, list(_KEY))
    return entries.join(down, ["leaf", *_KEY]).select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("uid") == F.col("keep_uid")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def _orderable(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return all(_orderable(f.dataType) for f in kind)
    return _orderable(kind.elementType) if isinstance(kind, T.ArrayType) else not isinstance(kind, (T.MapType, T.VariantType))


def drop_copies(docs: DataFrame, fan: int | None = None) -> DataFrame:
    """The documents that exact_dedup keeps, with their own columns.

    Where rows repeat under the smallest identifier the least of them by the other columns stays (columns without an
    order, such as maps, aren't compared; of rows alike in all others any one stays).
    """
    found = durable(exact_dedup(docs, fan))
    key_id, key, mark, turn, part = free_names(docs, "keep_doc", "keep_digest", "own_digest", "turn", "part")
    keepers = found.filter("kept").select(F.col("doc_id").alias(key_id), F.col("text_sha256").alias(key))
    rows = docs.withColumn(mark, F.sha2(squeezed(body(docs)), 256))
    on = rows["doc_id"].cast("long").eqNullSafe(keepers[key_id]) & (rows[mark] == keepers[key])
    left = rows.join(keepers, on, "left_semi")
    if found.filter(~F.col("kept") & F.col("doc_id").eqNullSafe(F.col("keep_id"))).limit(1).count():
        # whole rows repeat under the smallest identifier: the least of each part, then of these
        order = [F.col(f"`{f.name}`") for f in docs.schema if _orderable(f.dataType)] or [F.lit(0)]
        left = left.withColumn(part, F.pmod(F.monotonically_increasing_id(), F.lit(64)))
        for by in (["doc_id", mark, part], ["doc_id", mark]):
            left = left.withColumn(turn, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(turn) == 1)
    return left.select(*docs.columns)
