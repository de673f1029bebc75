"""Benchmark decontamination by a distributed positional inverted index, with DataFrame operations only.

1. Every training text becomes the hashes of its words (64 bits). Words of the test texts get postings: term, document,
   position. The index is sharded by document and sorted by term within each shard, so building it shuffles nothing.
2. A test text is a set of windows. Each window is looked up by its two rarest terms in the corpus: the lists of both are
   shifted by the terms' places in the text and intersected, which leaves (document, shift) pairs. Windows that share
   their rarest terms share the look-up, and a window with a term that never occurs has none.
3. What is left is verified term by term: at each shift the text's other terms meet the postings at their exact
   positions. Runs of at least a window's length are exact phrase matches.
4. A proximity match needs the two rarest terms of a window within `slop` words of where the phrase would put them; the
   shifts meet in bins, so that a text full of both terms doesn't make all pairs.

Words count as equal if their 64-bit hashes are; an exact match needs a whole window of them in order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, body

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The ASCII characters that stand in no word, A-Z lowered.
_BETWEEN = "".join(chr(c) for c in range(128) if not chr(c).isalnum())
#: Rows up to which a table of test terms or look-ups is broadcast; beyond it is joined by a shuffle.
BROADCAST_ROWS = 1 << 20
_BUCKETS = 1 << 20


def term_hashes(text: Column) -> Column:
    """The words' hashes in order. Separators become spaces, at which a plain split is much faster than a search for the class."""
    spaced = F.translate(text, _UPPER + _BETWEEN, _LOWER + " " * len(_BETWEEN))
    return F.transform(F.array_remove(F.split(spaced, " "), ""), lambda w: F.xxhash64(w))


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


@dataclass
class PhraseIndex:
    """texts: uid, doc_id, n_words, terms. postings: term, uid, pos. items: iid, item_id, terms, need (words in a window)."""

    texts: DataFrame
    postings: DataFrame
    items: DataFrame
    lookups: DataFrame
    n_lookups: int
    scratch: Scratch

    @classmethod
    def build(cls, docs: DataFrame, items: DataFrame, window: int = 10) -> PhraseIndex:
        """docs: doc_id, text. items: item_id, text. Null texts have no words; other columns are ignored."""
        scratch = Scratch(docs.sparkSession, "phrases")
        uid = F.monotonically_increasing_id()
        texts = docs.select(uid.alias("uid"), docs["doc_id"].cast("long").alias("doc_id"), term_hashes(body(docs)).alias("terms"))
        texts = scratch.keep(texts.select("uid", "doc_id", F.size("terms").cast("long").alias("n_words"), "terms"))
        tests = items.select(uid.alias("iid"), items["item_id"].cast("string").alias("item_id"), term_hashes(body(items)).alias("terms"))
        tests = scratch.keep(tests.filter(F.size("terms") > 0).withColumn("need", F.least(F.size("terms"), F.lit(window))))
        wanted = scratch.keep(tests.select(F.explode("terms").alias("term")).distinct())
        each = texts.select("uid", F.posexplode("terms").alias("pos", "term"))
        postings = scratch.keep(each.join(_small(wanted, wanted.count()), "term", "left_semi").select("term", "uid", "pos").sortWithinPartitions("term", "uid", "pos"))
        counts = postings.groupBy("term").agg(F.count("*").alias("n"))
        lookups = scratch.keep(_lookups(tests, counts))
        return cls(texts, postings, tests, lookups, lookups.count(), scratch)

    def shifts(self, which: str) -> DataFrame:
        """iid, o1, o2, uid, shift: where the text would have to begin in a document for one of its rarest terms (t1, t2) to fit."""
        look = self.lookups.filter(f"{which} IS NOT NULL").withColumn("term", F.col(which))
        at = F.col("pos") - F.col("o" + which[1:])
        return self.postings.join(_small(look, self.n_lookups), "term").select("iid", "o1", "o2", "uid", at.alias("shift"))

    def candidates(self) -> DataFrame:
        """iid, uid, shift of the look-ups whose two lists meet there, and of windows of one word."""
        marked = [self.shifts(t).withColumn("has", F.lit(bit)) for t, bit in (("t1", 1), ("t2", 2))]
        met = marked[0].unionByName(marked[1]).groupBy("iid", "o1", "o2", "uid", "shift").agg(F.bit_or("has").alias("has"))
        return met.filter("has = 3 OR o2 IS NULL").select("iid", "uid", "shift").distinct()

    def runs(self) -> DataFrame:
        """iid, item_id, uid, start, stop: the exact phrase matches, each a run of at least a window's length."""
        found = self.scratch.keep(self.candidates())
        # only documents in the candidates' buckets meet them; at most _BUCKETS numbers are broadcast
        bucket = F.pmod(F.xxhash64("uid"), F.lit(_BUCKETS)).cast("int")
        buckets = found.select(bucket.alias("bucket")).distinct()
        some = self.postings.withColumn("bucket", bucket).join(F.broadcast(buckets), "bucket", "left_semi").drop("bucket")
        tests = self.items.select("iid", "item_id", "need", "terms")
        wanted = found.join(tests, "iid").select("iid", "item_id", "need", "uid", "shift", F.posexplode("terms").alias("o", "term"))
        wanted = wanted.withColumn("pos", F.col("shift") + F.col("o"))
        there = wanted.join(some, ["uid", "pos", "term"], "left_semi")
        line = Window.partitionBy("iid", "uid", "shift").orderBy("o")
        there = there.withColumn("run", F.col("o") - F.row_number().over(line))
        runs = there.groupBy("iid", "item_id", "uid", "shift", "run", "need").agg(F.min("pos").alias("start"), (F.max("pos") + 1).alias("stop"))
        return runs.filter("stop - start >= need").select("iid", "item_id", "uid", "start", "stop")

    def near(self, slop: int) -> DataFrame:
        """uid, item_id, off: the two rarest terms of one of the item's windows within slop words of their places; off is the least such distance."""
        own = self.shifts("t1").filter("o2 IS NOT NULL").withColumn("bin", F.expr(f"shift div {slop + 1} - cast(shift < 0 AS int)"))
        own = own.withColumn("bin", F.explode(F.expr("array(bin - 1, bin, bin + 1)"))).withColumnRenamed("shift", "first")
        other = self.shifts("t2").withColumn("bin", F.expr(f"shift div {slop + 1} - cast(shift < 0 AS int)"))
        met = own.join(other, ["iid", "o1", "o2", "uid", "bin"]).withColumn("off", F.abs(F.col("first") - F.col("shift"))).filter(F.col("off") <= slop)
        best = met.groupBy("iid", "uid").agg(F.min("off").alias("off"))
        return best.join(self.items.select("iid", "item_id"), "iid").groupBy("uid", "item_id").agg(F.min("off").alias("off"))


def _lookups(tests: DataFrame, counts: DataFrame) -> DataFrame:
    """iid, o1, t1, o2, t2: the places and hashes of the two rarest terms of each window whose terms all occur, once for each such pair."""
    starts = tests.select("iid", "need", "terms", F.explode(F.expr("sequence(0, size(terms) - need)")).alias("start"))
    each = starts.select("iid", "start", "need", F.posexplode(F.expr("slice(terms, start + 1, need)")).alias("k", "term"))
    each = each.join(counts, "term").withColumn("r", F.struct("n", (F.col("start") + F.col("k")).alias("o"), "term"))
    rare = each.groupBy("iid", "start", "need").agg(F.array_sort(F.collect_list("r")).alias("r")).filter("size(r) = need")  # need is at most the window
    pick = [F.get("r", F.lit(i)).getField(f).alias(f"{a}{i + 1}") for i in (0, 1) for f, a in (("o", "o"), ("term", "t"))]
    return rare.select("iid", *pick).distinct()


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Words are runs of a-z, digits and characters beyond ASCII, A-Z lowered. A window is `window` consecutive words of an item,
    or a shorter item as a whole; a document's word in an occurrence of one is hit. Items without words have none.
    A null text has no words. Repeated documents get a row each, as do those with a null doc_id. Rows of one item_id are one
    item with the windows of all; a null item_id is listed as the word null. Long texts are searched whole. Empty
    documents give an empty result; with no items nothing is hit. Other columns are ignored.
    """
    index = PhraseIndex.build(docs, items, window)
    runs = index.scratch.keep(index.runs())
    index.scratch.only(index.texts, runs)
    by = Window.partitionBy("uid").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    covered = F.greatest(F.lit(0), F.col("stop") - F.greatest("start", F.coalesce(F.max("stop").over(by), F.lit(0))))
    hits = runs.withColumn("hit", covered).groupBy("uid").agg(F.sum("hit").cast("long").alias("n_hit"))
    names = runs.select("uid", F.coalesce("item_id", F.lit("null")).alias("item_id")).distinct().groupBy("uid").agg(F.array_sort(F.collect_list("item_id")).alias("ids"))
    all_docs = index.texts.select("uid", "doc_id", "n_words").join(hits.join(names, "uid"), "uid", "left")
    return all_docs.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("ids", ","), F.lit("")), 256).alias("items_sha256"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
    )


def near_items(docs: DataFrame, items: DataFrame, window: int = 10, slop: int = 5) -> DataFrame:
    """doc_id, item_id, off of the proximity matches; exact ones are among them (off 0) unless the window is a single word."""
    index = PhraseIndex.build(docs, items, window)
    return index.near(slop).join(index.texts.select("uid", "doc_id"), "uid").select("doc_id", "item_id", "off")


ORACLE = r"""
    WITH d AS (
        SELECT row_number() OVER () AS u, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
        FROM documents),
    b AS (
        SELECT item_id::VARCHAR AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
        FROM benchmark),
    gram AS (
        SELECT item_id, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
        FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
    size AS (SELECT DISTINCT k FROM gram),
    place AS (SELECT u, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, size WHERE len(w) >= k),
    spot AS (SELECT u, i, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM place),
    met AS (SELECT u, i, k, item_id FROM spot JOIN gram USING (k, g)),
    hit AS (SELECT u, count(DISTINCT p) AS n FROM (SELECT u, unnest(range(i, i + k)) AS p FROM met) GROUP BY u),
    item AS (SELECT u, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT u, item_id FROM met) GROUP BY u)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(item.n, 0)::BIGINT AS n_items,
           sha256(coalesce(ids, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
    FROM d LEFT JOIN hit USING (u) LEFT JOIN item USING (u)
"""
