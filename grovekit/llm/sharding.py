"""Sharding by sampled splitters: ranges of a key with near equal bytes.

Records are ordered by (hash of the text, doc_id, row). A sample in proportion to size gives splitters at its
quantiles; every range is then measured, and overfull ones are divided by a fresh sample of their own, inside a
key where one key alone is too large (a hot group of copies). The measured ranges give each record its exact place
in the order, in rows and bytes, and a shard is a stretch of the order with an equal share of the bytes. So the
sample decides how even the work is, never the result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import body, durable

_LOW = np.iinfo(np.int64).min
OVERHEAD = 16


def _records(docs: DataFrame) -> DataFrame:
    text = body(docs)
    rows = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"),
        (F.octet_length(text) + F.lit(OVERHEAD)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("key"),
    )
    return durable(rows.withColumn("uid", F.monotonically_increasing_id()))


def _order(rows: pd.DataFrame) -> pd.DataFrame:
    return rows.sort_values(["key", "doc", "uid"], kind="stable").reset_index(drop=True)


def _splitters(sample: pd.DataFrame, pieces: int) -> pd.DataFrame:
    """pieces - 1 quantiles by weight. The first splitter in a key stands before the whole key, further ones within it."""
    s = _order(sample)
    ends = np.cumsum(s["weight"].to_numpy())
    at = np.searchsorted(ends, ends[-1] * np.arange(1, pieces) / pieces) if len(s) else []
    cut = s.iloc[np.unique(np.minimum(at, len(s) - 1))][["key", "doc", "uid"]].copy() if len(s) else s[["key", "doc", "uid"]]
    cut.loc[~cut["key"].duplicated(), ["doc", "uid"]] = _LOW
    return cut


def place(cuts: tuple[np.ndarray, np.ndarray, np.ndarray], key: np.ndarray, doc: np.ndarray, uid: np.ndarray) -> np.ndarray:
    """How many splitters stand at or before each record, in the order of (key, doc, uid)."""
    out = np.searchsorted(cuts[0], key, "right")
    low = np.searchsorted(cuts[0], key, "left")
    for k in np.unique(low[out > low]):  # records of a key that has splitters
        rows = np.flatnonzero((low == k) & (out > low))
        n = int(out[rows[0]] - k)
        marks = pd.MultiIndex.from_arrays([cuts[1][k : k + n], cuts[2][k : k + n]])
        both = pd.MultiIndex.from_arrays([doc[rows], uid[rows]])
        ranks = pd.Series(np.arange(n + len(rows)), index=marks.append(both)).sort_index(kind="stable")
        passed = np.cumsum(ranks.to_numpy() < n)
        where = np.empty(n + len(rows), np.int64)
        where[ranks.to_numpy()] = passed
        out[rows] = k + where[n:]
    return out


def _range_of(cuts: pd.DataFrame) -> Column:
    arrays = tuple(cuts[c].to_numpy(np.int64) for c in ("key", "doc", "uid"))

    def run(key: pd.Series, doc: pd.Series, uid: pd.Series) -> pd.Series:
        return pd.Series(place(arrays, key.to_numpy(np.int64), doc.to_numpy(np.int64), uid.to_numpy(np.int64)))

    return F.pandas_udf(run, T.LongType())("key", _doc(), "uid")


def _doc() -> Column:
    return F.coalesce("doc_id", F.lit(int(_LOW)))


def _draw(rows: DataFrame, chance: Column, salt: int) -> pd.DataFrame:
    """Records drawn with the given chance; those with a chance above 1 carry it as their weight."""
    dice = F.pmod(F.xxhash64("uid", F.lit(salt)), F.lit(1 << 40)) / float(1 << 40)
    drawn = rows.withColumn("chance", chance).filter(dice < F.col("chance"))
    return drawn.select("key", _doc().alias("doc"), "uid", F.greatest("chance", F.lit(1.0)).alias("weight")).toPandas()


def split_ranges(rows: DataFrame, pieces: int, per_piece: int = 24, slack: float = 3.0, rounds: int = 6, fine: int = 256) -> tuple[pd.DataFrame, pd.DataFrame]:
    """Splitters, and the measured ranges: part, n, size. Ranges of at most `fine` records are left as they are. The driver holds about pieces * per_piece sampled keys."""
    total = rows.agg(F.count("*").alias("n"), F.sum("size").alias("size")).first()
    if not total["n"]:
        return pd.DataFrame({c: pd.Series(dtype=np.int64) for c in ("key", "doc", "uid")}), pd.DataFrame({c: pd.Series(dtype=np.int64) for c in ("part", "n", "size")})
    cuts = _splitters(_draw(rows, F.col("size") * (pieces * per_piece / total["size"]), 1), pieces)
    for again in range(rounds + 1):
        measured = rows.withColumn("part", _range_of(cuts)).groupBy("part").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
        parts = measured.toPandas().sort_values("part").reset_index(drop=True)  # a row for each range
        load = np.maximum(parts["n"] / max(total["n"], pieces), parts["size"] / total["size"]) * pieces
        over = parts.assign(load=load)[(load > slack) & (parts["n"] > fine)]
        if again == rounds or not len(over):
            return cuts, parts
        # the range number and the chance of its records: at most `pieces` overfull ranges, so safe to broadcast
        chance = rows.sparkSession.createDataFrame([(int(r.part), float(min(1.0, per_piece * r.load / r.n))) for r in over.itertuples()], "part long, share double")
        fresh = _draw(rows.withColumn("part", _range_of(cuts)).join(F.broadcast(chance), "part"), F.col("share"), 2 + again)
        fresh["part"] = place(tuple(cuts[c].to_numpy(np.int64) for c in ("key", "doc", "uid")), *(fresh[c].to_numpy(np.int64) for c in ("key", "doc", "uid")))
        more = [_splitters(g, 1 + int(np.ceil(over.loc[over["part"] == p, "load"].iloc[0]))) for p, g in fresh.groupby("part")]
        cuts = _order(pd.concat([cuts, *more])).drop_duplicates().reset_index(drop=True)


def shard(docs: DataFrame, shards: int = 40, rows_in_range: int = 500_000, whole_share: float = 0.02) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law ("bytes"), shard, slot, grown_shard (null).

    Equal texts stand side by side and stay in one shard if together they have at most whole_share of a shard;
    larger groups are divided. A null text has no bytes; a null doc_id comes first in its key; repeated rows are
    placed each; extra columns are ignored; an empty table gives an empty result.
    """
    rows = _records(docs)
    pieces = max(8 * shards, rows.count() // rows_in_range)
    cuts, parts = split_ranges(rows, pieces)
    total = max(1, int(parts["size"].sum()))
    parts = parts.assign(n_before=parts["n"].cumsum() - parts["n"], size_before=parts["size"].cumsum() - parts["size"])
    starts = docs.sparkSession.createDataFrame([tuple(map(int, x)) for x in parts[["part", "n_before", "size_before"]].itertuples(index=False)], "part long, n_before long, size_before long")
    # a row for each range, whose number is set here: safe to broadcast
    placed = rows.withColumn("part", _range_of(cuts)).join(F.broadcast(starts), "part")
    inside = Window.partitionBy("part").orderBy("key", "doc_id", "uid")
    group = Window.partitionBy("part", "key")
    placed = placed.withColumn("end", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) + F.col("size_before"))
    placed = placed.withColumn("rank", F.row_number().over(inside) - 1 + F.col("n_before"))
    placed = placed.withColumn("group_size", F.sum("size").over(group)).withColumn("group_end", F.max("end").over(group))
    whole = F.col("group_size") <= F.lit(int(total / shards * whole_share))
    middle = F.when(whole, 2 * F.col("group_end") - F.col("group_size")).otherwise(2 * F.col("end") - F.col("size"))
    placed = placed.withColumn("shard", F.least(F.lit(shards - 1), F.floor(middle * F.lit(shards / (2.0 * total))).cast("int")))
    placed = durable(placed.select("doc_id", "size", "text_crc32", "shard", "rank"))
    first = placed.groupBy("shard").agg(F.min("rank").alias("first"))  # a row for each shard
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("rank") - F.col("first")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
