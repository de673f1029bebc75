"""Packing by minimum bin slack over the histogram of remaining lengths.

Each document's ids are cut into full windows and one rest. Rests of equal length are interchangeable, so the
plan is made from their counts alone: at most `window` numbers, whatever the corpus. The plan repeats one step:
take the longest length left, find by a bitset subset-sum over the other lengths (with their counts) the
multiset that fills the window closest, trace back how often each length is used, and apply this pattern as
often as the counts allow. Each step uses up a length, so there are about `window` patterns.

Rows find their place by their rank among the pieces of their length, which is counted in salted groups. A length has as
many groups as its rows need, so neither full windows, which are most pieces of long texts, nor a length that a
third of all rows share meet in a few tasks; all lengths together have at most 2**18 groups and one for each length.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import body, durable, small_batches

WINDOW = 1024
_MOST_KNOWN = 1 << 17
_PIECES = "doc_id long, doc_tokens long, start long, length int, ids_crc32 long"


class _Ids(dict):
    """Stretch of text between single spaces -> the ids of a space and that stretch, as bytes; forgets all when full.

    A space between two characters that aren't white space always starts a new pre-token, so the ids of a text are
    those of its stretches. They equal the ids of `tokenizers` with the JSON file of the same vocabulary between the
    strings of added tokens.
    """

    def __init__(self, ranks: str, pattern: str):
        import base64

        import tiktoken

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._encode = tiktoken.Encoding("ids", pat_str=pattern, mergeable_ranks=table, special_tokens={}).encode_ordinary

    def ids(self, text: str) -> bytes:
        return np.array(self._encode(text), dtype="<u4").tobytes()

    def __missing__(self, part: str) -> bytes:
        ids = self.ids(" " + part)
        if len(part) <= 64:
            if len(self) >= _MOST_KNOWN:
                self.clear()
            self[part] = ids
        return ids


_known: _Ids | None = None
_added: tuple[re.Pattern, dict[str, bytes]] | None = None


def _added_tokens(path: str) -> tuple[re.Pattern, dict[str, bytes]]:
    """A pattern of the JSON file's added tokens, longer ones first, and the id of each as bytes."""
    with open(path, encoding="utf-8") as f:
        tokens = json.load(f)["added_tokens"]
    if bad := [t["content"] for t in tokens if t["single_word"] or t["lstrip"] or t["rstrip"]]:
        raise ValueError(f"added tokens that depend on what stands beside them: {bad}")
    ids = {t["content"]: np.array([t["id"]], dtype="<u4").tobytes() for t in tokens}
    return re.compile("(" + "|".join(map(re.escape, sorted(ids, key=len, reverse=True))) + ")" if ids else "((?!))"), ids


def token_bytes(text: str, special: bool = False) -> bytes:
    """The ids of a text, 4 bytes each, without the closing id. special: strings of added tokens give their ids, as `tokenizers` does by default."""
    global _known, _added
    if _known is None:
        import public_tokenizers as p

        _known, _added = _Ids(p.path("byte_bpe_50k.tiktoken"), p.PATTERN), _added_tokens(p.path("byte_bpe_50k.json"))
    if special:
        pattern, ids = _added
        return b"".join(ids[x] if k % 2 else _plain_bytes(x) for k, x in enumerate(pattern.split(text)))
    return _plain_bytes(text)


def _plain_bytes(text: str) -> bytes:
    if not text:
        return b""
    first, *rest = re.split(r"(?<=\S) (?=\S)", text) if re.search(r"\s\s", text) else text.split(" ")
    return _known.ids(first) + b"".join(map(_known.__getitem__, rest))


def _cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tokens, starts, lengths, sums = [], [], [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = token_bytes(text.as_py(), special=True) + b"\0\0\0\0"
                n = len(data) // 4
                for a in range(0, n, window):
                    piece = data[4 * a : 4 * (a + window)]
                    ids.append(doc)
                    tokens.append(n)
                    starts.append(a)
                    lengths.append(len(piece) // 4)
                    sums.append(zlib.crc32(piece))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(tokens, pa.int64()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int32()), pa.array(sums, pa.int64())], names=["doc_id", "doc_tokens", "start", "length", "ids_crc32"])

    return run


def fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """How often to use each length so that their sum is as close to room as counts allow, by a bitset of reachable sums."""
    reach, steps = 1, []
    full = (1 << (room + 1)) - 1
    for length in sorted((x for x in counts if x <= room and counts[x] > 0), reverse=True):
        left, unit = min(counts[length], room // length), 1
        while left > 0:  # counts in powers of two
            take = min(unit, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & full
            left, unit = left - take, unit * 2
        if reach >> room & 1:
            break
    total, used = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> total & 1:  # this sum needs the step
            used[length] = used.get(length, 0) + take
            total -= length * take
    return used


def plan(counts: dict[int, int], window: int = WINDOW) -> list[tuple[dict[int, int], int]]:
    """Patterns (length to number) and how often each is repeated; together they use every count up."""
    left, out = {k: v for k, v in counts.items() if v > 0}, []
    while left:
        longest = max(left)
        rest = dict(left)
        rest[longest] -= 1
        pattern = fill(rest, window - longest)
        pattern[longest] = pattern.get(longest, 0) + 1
        times = min(left[k] // v for k, v in pattern.items())
        out.append((pattern, times))
        for k, v in pattern.items():
            left[k] -= v * times
            if not left[k]:
                del left[k]
    return out


def _segments(patterns: list[tuple[dict[int, int], int]]) -> list[tuple]:
    """For each length of each pattern: length, its ranks from and to, number in a window, place in it, first sequence."""
    taken: dict[int, int] = {}
    out, sequence = [], 0
    for pattern, times in patterns:
        place = 0
        for length in sorted(pattern, reverse=True):
            first = taken.get(length, 0)
            taken[length] = first + pattern[length] * times
            out.append((length, first, taken[length], pattern[length], place, sequence))
            place += length * pattern[length]
        sequence += times
    return out


def pack(docs: DataFrame, window: int = WINDOW, rows_in_group: int = 2000, groups: int = 1 << 18) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is the closing id alone. A null doc_id stays null. Repeated rows are packed each.
    Extra columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), body(docs).alias("text")).mapInArrow(_cut(window), _PIECES)
    rows = durable(rows.withColumn("draw", F.xxhash64("doc_id", "start", F.monotonically_increasing_id())))
    totals = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most window rows
    most = max(rows_in_group, sum(totals.values()) // groups)
    salts = spark.createDataFrame([(k, -(-n // most)) for k, n in totals.items()] or [(0, 1)], "length int, salts int")
    rows = rows.join(F.broadcast(salts), "length").withColumn("salt", F.pmod("draw", "salts").cast("int")).drop("draw", "salts")
    counts = durable(rows.groupBy("length", "salt").agg(F.count("*").alias("n")))  # at most groups + window rows
    segments = _segments(plan(totals, window)) or [(0, 0, 0, 1, 0, 0)]
    places = spark.createDataFrame(segments, "length int, first long, until long, in_one long, place long, sequence long")
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).drop("n")
    rank = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32"))
    # both sides are bounded, by groups + window and by about 45 * window rows
    ranked = rows.withColumn("rank", rank - 1).join(F.broadcast(before), ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("before"))
    placed = ranked.join(F.broadcast(places), "length").filter("rank >= first AND rank < until").withColumn("k", F.col("rank") - F.col("first"))
    return placed.select(
        "doc_id",
        "start",
        F.col("length").cast("long").alias("length"),
        "ids_crc32",
        "doc_tokens",
        F.expr("sequence + k div in_one").alias("sequence_id"),
        F.expr("place + k % in_one * length").alias("offset"),
    )
