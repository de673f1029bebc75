"""Spelling variants: words within one inserted, deleted or replaced character, found by automata that walk tries.

1. Runs of letters are counted with plain DataFrame operations (partial sums before the shuffle).
2. The distinct words, in code-point order, are cut into shards of bounded words and characters. A shard travels as one
   front-coded value, which is a fraction of its trie.
3. Shards are broadcast in groups of bounded bytes, as many groups as there are. A task holds a block of words and one
   trie at a time (the shard's radix tree): each word's automaton of distance one descends it depth-first and accepts at
   the ends of words. The automaton is deterministic: it follows the word as long as the trie does, and spends its edit
   where they part, so that every neighbour is met once. A shard whose common prefix is further off ends at its root.
4. Each block gives, for a word and a shard, the number of neighbours and the best of them; sums and minima over the shards
   follow, and forms are followed to their roots by doubling.
"""

from __future__ import annotations

import json
import math
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, body, fields

SHARD_WORDS, SHARD_CHARS = 50_000, 1 << 20
BLOCK_WORDS, BLOCK_CHARS = 50_000, 4 << 20
GROUP_BYTES = 32 << 20
_LETTERS = r"[A-Za-zÀ-ÿ]"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NEAR = fields("word string, n_near long, minus_n long, form string")


def _lowered(w: Column) -> Column:
    return F.when(F.octet_length(w) == F.char_length(w), F.lower(w)).otherwise(F.translate(w, _UPPER, _LOWER))


def word_counts(docs: DataFrame, least_length: int = 6, least_n: int = 5, one_in: int = 199) -> DataFrame:
    """word, n of all words long and frequent enough. One in `one_in` occurrences, told by a checksum, loses a character."""
    # a shorter run gives no word that is long enough
    run = F.explode(F.regexp_extract_all(body(docs), F.lit(f"{_LETTERS}{{{least_length},}}"), F.lit(0)))
    doc = F.coalesce(docs["doc_id"].cast("long").cast("string"), F.lit(""))
    each = docs.select(doc.alias("doc"), run.alias("run")).withColumn("run", _lowered(F.col("run")))
    each = each.withColumn("h", F.crc32(F.concat("doc", F.lit(":"), "run")))
    cut = F.expr("concat(substring(run, 1, cast(h % char_length(run) AS int)), substring(run, cast(h % char_length(run) AS int) + 2))")
    word = F.when(F.col("h") % one_in == 0, cut).otherwise(F.col("run"))
    return each.select(word.alias("word")).filter(F.char_length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_n)


def packed(words: list[str], counts: list[int]) -> bytes:
    """Sorted words as what they share with the one before and the rest, compressed."""
    shared, rests, before = [], [], ""
    for w in words:
        k, most = 0, min(len(w), len(before))
        while k < most and w[k] == before[k]:
            k += 1
        shared.append(k)
        rests.append(w[k:])
        before = w
    return zlib.compress(json.dumps([shared, rests, counts], ensure_ascii=False, separators=(",", ":")).encode(), 1)


class Trie:
    """A radix tree: the text on the edge to a node, its children by their first character, and n where a word ends."""

    __slots__ = ("kids", "n", "text")

    def __init__(self, text: str = "", n: int = 0):
        self.text, self.n, self.kids = text, n, {}

    @classmethod
    def unpacked(cls, data: bytes) -> Trie:
        root, path, lengths = cls(), [], []
        path.append(root)
        lengths.append(0)  # of the prefix at each node of the path
        for shared, rest, n in zip(*json.loads(zlib.decompress(data)), strict=True):
            last = None
            while lengths[-1] > shared:
                last = path.pop()
                lengths.pop()
            if lengths[-1] < shared:  # the last edge is divided where the words part
                top, k = path[-1], shared - lengths[-1]
                mid = cls(last.text[:k])
                last.text = last.text[k:]
                mid.kids[last.text[0]] = last
                top.kids[mid.text[0]] = mid
                path.append(mid)
                lengths.append(shared)
            leaf = cls(rest, n)
            path[-1].kids[rest[0]] = leaf
            path.append(leaf)
            lengths.append(shared + len(rest))
        return root

    def near(self, word: str) -> list[tuple[int, str]]:
        """(n, word) of all words at distance one exactly, each once."""
        end, out = len(word), []
        stack = [(self, 0, False, "")]  # a node, what of the word is read, whether the edit is spent, the text so far
        while stack:
            node, i, spent, so_far = stack.pop()
            if node.n and (i == end if spent else end - i == 1):
                out.append((node.n, so_far))
            if spent:
                if i < end and (kid := node.kids.get(word[i])) and word.startswith(kid.text, i):
                    stack.append((kid, i + len(kid.text), True, so_far + kid.text))
                continue
            for kid in node.kids.values():
                text, j = kid.text, 0
                most = min(len(text), end - i)
                while j < most and text[j] == word[i + j]:
                    j += 1
                if j == len(text):
                    stack.append((kid, i + j, False, so_far + text))
                    continue
                at, after = i + j, text[j + 1 :]  # they part here: the trie's character is added, or the word's replaced or left out
                if word.startswith(after, at):
                    stack.append((kid, at + len(after), True, so_far + text))
                if at < end:
                    if word.startswith(after, at + 1):
                        stack.append((kid, at + 1 + len(after), True, so_far + text))
                    if word.startswith(text[j:], at + 1):
                        stack.append((kid, at + 1 + len(after) + 1, True, so_far + text))
        return out


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted words and counts as packed shards."""
    words, counts, size = [], [], 0

    def shard() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([packed(words, counts)], pa.binary())], names=["shard"])

    for batch in batches:
        for w, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if words and (len(words) >= SHARD_WORDS or size + len(w) > SHARD_CHARS):
                yield shard()
                words, counts, size = [], [], 0
            words.append(w)
            counts.append(n)
            size += len(w)
    if words:
        yield shard()


def _meet(shards):
    """shards: a broadcast list. Blocks of words meet one trie at a time."""

    def block(words: list[str]) -> Iterator[pa.RecordBatch]:
        for data in shards.value:
            trie, rows = Trie.unpacked(data), []
            for w in words:
                if found := trie.near(w):
                    minus, form = min((-n, x) for n, x in found)
                    rows.append((w, len(found), minus, form))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=_NEAR.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for w in batch.column(0).to_pylist():
                held.append(w)
                size += len(w)
                if len(held) >= BLOCK_WORDS or size >= BLOCK_CHARS:
                    yield from block(held)
                    held, size = [], 0
        if held:
            yield from block(held)

    return run


def near_words(words: DataFrame, scratch: Scratch) -> DataFrame:
    """word, n_near, minus_n, form (the best near word and its n, negative) of all words that have near ones. words: word, n, distinct."""
    spark, total = words.sparkSession, words.count()
    ranges = words.select("word", "n").repartitionByRange(total // SHARD_WORDS + 1, "word").sortWithinPartitions("word")
    shards = scratch.keep(ranges.mapInArrow(_shards, fields("shard binary")).withColumn("k", F.monotonically_increasing_id()).withColumn("bytes", F.octet_length("shard")))
    spread = scratch.keep(words.select("word").repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // BLOCK_WORDS + 1), "word"))
    groups, size = [[]], 0
    for r in shards.select("k", "bytes").orderBy("k").toLocalIterator():  # one small row for 50,000 words
        if groups[-1] and size + r["bytes"] > GROUP_BYTES:
            groups.append([])
            size = 0
        groups[-1].append(r["k"])
        size += r["bytes"]
    found = []
    for ks in groups:
        some = shards.filter(F.col("k").between(ks[0], ks[-1])) if ks else shards.limit(0)
        sent = spark.sparkContext.broadcast([bytes(r["shard"]) for r in some.select("shard").collect()])  # GROUP_BYTES at most
        found.append(scratch.keep(spread.mapInArrow(_meet(sent), _NEAR)))
        sent.unpersist()
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    best = F.min(F.struct("minus_n", "form"))
    return every.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n_near", "best.minus_n", "best.form")


def roots(forms: DataFrame, largest: int, factor: int, scratch: Scratch) -> DataFrame:
    """word, root: forms (word, form) followed to the end. Each step multiplies n by the factor at least, which bounds the rounds."""
    steps = 1 + max(0, math.ceil(math.log(max(largest, 1), factor)))
    at = scratch.keep(forms.select("word", F.col("form").alias("root")))
    for _ in range(math.ceil(math.log2(steps))):
        onward = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        at = scratch.keep(at.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root")))
    return at


def variants(docs: DataFrame, factor: int = 5, least_length: int = 6, least_n: int = 5) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF, A-Z lowered, of at least six characters and five occurrences
    over all documents. form is the near word of largest n (of equal ones the first in code-point order), if that is
    at least `factor` times the word's own; root is the last of its forms, the word itself if it has none.
    Null texts have no words; a null doc_id counts as an empty one in the checksum. Repeated rows count each. Long texts and
    long words are taken whole. Empty tables, or ones without frequent words, give an empty result. Other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "spelling")
    words = scratch.keep(word_counts(docs, least_length, least_n))
    met = scratch.keep(words.join(near_words(words, scratch), "word", "left"))
    good = F.col("minus_n") <= -factor * F.col("n")
    near = met.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(good, F.col("form")).alias("form"), F.when(good, -F.col("minus_n")).alias("form_n"))
    largest = words.agg(F.max("n")).first()[0] or 0
    ends = roots(near.filter("form IS NOT NULL"), largest, factor, scratch)
    scratch.only(met, ends)
    return near.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
