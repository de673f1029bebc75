"""Similarity join on word n-grams, by count vectors in R-trees.

1. A document's set of n-grams becomes sorted 64-bit hashes. Documents with the same set form one class; only
   classes go on.
2. Two sets that reach the threshold share one of the first hashes of each (as many as may be missing, plus one),
   in any one order of all hashes. So a class is filed under those hashes. The order puts rare hashes first, by a
   table of counters over all documents; the counters are shared by many hashes, but any order gives the same links.
   Linked sets are of a like size, so what is filed under a hash falls into runs of sizes that may link; a hash and
   a run make a key.
3. Under a key the classes are points in an R-tree: hashes are dealt into groups, and a set is the counts of its
   groups. The summed minima of two points bound the overlap. A search passes over sets that are in the query's
   component already.
4. Contraction: each class goes to one key, the one with most classes. Those that survive a search on counts bring
   their sets, are verified at once and merge. Then each component sends one member to one key, in the same way. A
   group of near copies becomes a few components here, at one row for each class.
5. The filter: in every key that still has several components, the classes outside its largest one search all
   others, on counts alone. It gives the classes that survive, each once for a place: the key itself for two that
   are both outside, the largest component for one that is within. So a place has no more rows than its key or
   component has classes, and pairs are never listed.
6. The refinement: survivors bring their sets to their places, are verified there, and the links found merge
   components. No link between different components is lost.
7. What meets in one place is divided into blocks of bounded number and bytes; in the last two steps each block of
   those who are searched meets each block of those who search.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, body, fields, free_names, small_batches
from .components import components
from .count_rtree import CountRTree, reaches

_P = np.uint64(0x9E3779B97F4A7C15)
_LEAST_BITS, _MOST_BITS = 17, 27  # of a bit table, as powers of two: at most 2**21 rows are broadcast


@dataclass(frozen=True)
class Join:
    """words: in an n-gram. Two sets link when den * shared >= num * union."""

    words: int = 3
    num: int = 90
    den: int = 100
    groups: int = 256
    counter_bits: int = 23  # 2**23 counters of hashes order them by rarity; bounds what is broadcast, not what is found
    block: int = 2048  # classes in a tree
    block_hashes: int = 1 << 21  # and hashes of their sets


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def shingles(text: bytes, words: int) -> np.ndarray:
    """The distinct hashes of the n-grams, in ascending order. Bytes split and lower as the contract's classes do."""
    import xxhash

    w = text.lower().split()
    if not w:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, w), np.uint64, len(w))
    k = min(words, len(w))
    out = np.full(len(w) - k + 1, k, np.uint64)
    for i in range(k):
        out = _mixed(out * _P + h[i : len(w) - k + 1 + i])
    return np.unique(out)


def _slots(s: np.ndarray, join: Join) -> np.ndarray:
    return (s >> np.uint64(64 - join.counter_bits)).astype(np.int32)


def _partial_counts(join: Join, chunk: int = 1 << 19, part: int = 1 << 17):
    """How many hashes of a task fall to each counter, as compressed parts of the table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, held, size = np.zeros(1 << join.counter_bits, np.uint32), [], 0

        def add() -> None:
            slots, n = np.unique(_slots(np.concatenate(held), join), return_counts=True)
            counts[slots] += n.astype(np.uint32)

        for batch in batches:
            for text in batch.column(0):
                held.append(shingles(text.as_py(), join.words))
                size += len(held[-1])
                if size >= chunk:
                    add()
                    held, size = [], 0
        if held:
            add()
        for i in range(0, len(counts), part):
            if (some := counts[i : i + part]).any():
                yield pa.RecordBatch.from_arrays([pa.array([i // part], pa.int64()), pa.array([zlib.compress(some.tobytes(), 1)], pa.binary())], names=["part", "counts"])

    return run


def _summed_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of the parts; a task holds one table of its parts, however many rows come."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            counts = np.frombuffer(zlib.decompress(packed.as_py()), np.uint32).astype(np.uint64)
            sums[k] = sums[k] + counts if k in sums else counts
    for k, counts in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([zlib.compress(_ranks(counts).tobytes(), 1)], pa.binary())], names=["part", "counts"])


def _ranks(counts: np.ndarray) -> np.ndarray:
    """Counts in 16 bits: themselves up to 4,096, then in steps of a sixteen-hundredth of a doubling."""
    large = 4096 + 1600 * np.log2(np.maximum(counts, 4096) / 4096.0)
    return np.minimum(np.where(counts <= 4096, counts, large), 65535).astype(np.uint16)


def rarity(texts: DataFrame, join: Join) -> np.ndarray:
    """How often the hashes of each counter occur in all documents. Its size is fixed, and so is what is broadcast."""
    part = 1 << 17
    schema = fields("part long, counts binary")
    rows = texts.select("text").mapInArrow(_partial_counts(join, part=part), schema).repartition("part").mapInArrow(_summed_counts, schema).collect()
    out = np.zeros(1 << join.counter_bits, np.uint16)
    for r in rows:
        some = np.frombuffer(zlib.decompress(bytes(r["counts"])), np.uint16)
        out[r["part"] * part : r["part"] * part + len(some)] = some
    return out


def first_hashes(s: np.ndarray, often: np.ndarray, join: Join) -> np.ndarray:
    """Those under which a set is filed: as many as the other set may lack, and one. The rarest, by the counters."""
    need = -(-join.num * len(s) // join.den)
    take = len(s) - need + 1
    return s[np.lexsort((s, often[_slots(s, join)]))[:take]]


def group_counts(s: np.ndarray, groups: int) -> bytes:
    """The counts in one byte each if they fit, else in four."""
    n = np.bincount((_mixed(s) % np.uint64(groups)).astype(np.int64), minlength=groups)
    return n.astype(np.uint8 if n.max() < 256 else np.uint32).tobytes()


def _count_rows(packed: list[bytes], groups: int) -> np.ndarray:
    if all(len(x) == groups for x in packed):
        return np.frombuffer(b"".join(packed), np.uint8).reshape(-1, groups)
    return np.stack([np.frombuffer(x, np.uint8 if len(x) == groups else np.uint32).astype(np.uint32) for x in packed])


def _class_id(s: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(s.tobytes())


def _points(often: Broadcast, join: Join):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, c, first, counts = [], [], [], []
            for text in batch.column(1):
                s = shingles(text.as_py(), join.words)
                n.append(len(s))
                c.append(_class_id(s))
                first.append(first_hashes(s, often.value, join).view(np.int64) if len(s) else s.view(np.int64))
                counts.append(group_counts(s, join.groups))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(c, pa.binary()), pa.array(first, pa.list_(pa.int64())), pa.array(counts, pa.binary())], names=["doc_id", "n", "c", "first", "counts"])

    return run


_SETS = "c binary, counts binary, s array<long>"


def _sets(join: Join):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c, sets, counts = [], [], []
            for text in batch.column(0):
                s = shingles(text.as_py(), join.words)
                c.append(_class_id(s))
                sets.append(s.view(np.int64))
                counts.append(group_counts(s, join.groups))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()), pa.array(counts, pa.binary()), pa.array(sets, pa.list_(pa.int64()))], names=["c", "counts", "s"])

    return run


_SURVIVOR = "place long, c binary, label binary, n long, host boolean, guest boolean"


class _Place:
    """The rows that meet in one task: who is searched (hosts), who searches (guests), and their components."""

    def __init__(self, rows: pa.Table, join: Join):
        self.join = join
        self.n = rows["n"].to_numpy()
        self.counts = _count_rows(rows["counts"].to_pylist(), join.groups)
        labels = rows["label"].to_pylist()
        self.names = sorted(set(labels))  # numbers in the order of the names, so every block gives two labels the same order
        number = {x: k for k, x in enumerate(self.names)}
        self.label = np.array([number[x] for x in labels], np.int64)
        self.hosts = np.flatnonzero(rows["host"].to_numpy())
        self.guests = np.flatnonzero(rows["guest"].to_numpy())

    def tree(self) -> CountRTree:
        h = self.hosts
        return CountRTree(self.counts[h], self.n[h], self.label[h], self.join.num, self.join.den)

    def candidates(self, tree: CountRTree, i: int) -> tuple[np.ndarray, np.ndarray]:
        at, bound = tree.search(self.counts[i], int(self.n[i]), int(self.label[i]))
        return self.hosts[at], bound


def _near(join: Join):
    """The rows that survive a search on counts, in places of those that may link, however long the way."""

    def one(rows: pa.Table) -> dict[str, list]:
        import xxhash

        place = _Place(rows, join)
        now, tree = np.arange(len(place.names)), place.tree()
        for i in place.guests if len(now) > 1 else ():
            at, _ = place.candidates(tree, i)
            if len(at):
                old = np.unique(np.append(place.label[at], place.label[i]))
                for x in (place.label, now):
                    x[np.isin(x, old)] = old[0]
                tree.merge(old, int(old[0]))
        some = np.flatnonzero(np.bincount(now, minlength=len(now))[place.label] > 1)
        out = {x: rows[x].take(pa.array(some)).to_pylist() for x in ("c", "label", "n", "host", "guest")}
        return out | {"place": [xxhash.xxh3_64_intdigest(place.names[k]) - (1 << 63) for k in place.label[some]]}

    return _by_place(one, fields(_SURVIVOR))


def _merged(rows: pa.Table, join: Join) -> tuple[_Place, np.ndarray]:
    """The place, and the number of the component of each of its labels after all links in it are found."""
    place = _Place(rows, join)
    now = np.arange(len(place.names))
    if len(now) < 2 or not len(place.hosts) or not len(place.guests):
        return place, now
    lists = rows["s"].combine_chunks()
    flat, ends = lists.values.to_numpy().view(np.uint64), lists.offsets.to_numpy()
    sets = [flat[a:b] for a, b in zip(ends, ends[1:], strict=False)]
    tree = place.tree()
    asks = np.zeros(len(place.n), bool)
    asks[place.guests] = True
    for i in place.guests:
        at, bound = place.candidates(tree, i)
        first = ~asks[at] | (at < i)  # of two that both ask, one will do
        at, bound = at[first], bound[first]
        at = at[np.argsort(-(bound / (place.n[i] + place.n[at])), kind="stable")]  # the tightest first
        step = 2
        while len(at := at[place.label[at] != place.label[i]]):
            some, at, step = at[:step], at[step:], min(4 * step, 512)
            shared = _overlaps(sets[i], [sets[j] for j in some])
            linked = some[reaches(shared, place.n[i] + place.n[some], join.num, join.den)]
            if len(linked):
                old = np.unique(np.append(place.label[linked], place.label[i]))
                into = int(old[0])
                for x in (place.label, now):
                    x[np.isin(x, old)] = into
                tree.merge(old, into)
    return place, now


def _overlaps(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """How many hashes each of the others shares with the one; all are sorted and not empty."""
    flat = np.concatenate(others)
    hit = one[np.minimum(np.searchsorted(one, flat), len(one) - 1)] == flat
    return np.add.reduceat(hit, np.cumsum([0, *map(len, others[:-1])]), dtype=np.int64)


def _contracted(join: Join):
    """label, into: for each label the component that its links under this key give it."""

    def one(rows: pa.Table) -> dict[str, list]:
        place, now = _merged(rows, join)
        return {"label": place.names, "into": [place.names[k] for k in now]}

    return _by_place(one, fields("label binary, into binary"))


def _refined(join: Join):
    """a, b: links that join the components of a place, no more than their number."""

    def one(rows: pa.Table) -> dict[str, list]:
        place, now = _merged(rows, join)
        moved = np.flatnonzero(now != np.arange(len(now)))
        return {"a": [place.names[now[k]] for k in moved], "b": [place.names[k] for k in moved]}

    return _by_place(one, fields("a binary, b binary"))


def _filtered(join: Join):
    """The rows that survive the search on counts, each once for a place."""

    def one(rows: pa.Table) -> dict[str, list]:
        import xxhash

        place = _Place(rows, join)
        main = rows["main"].to_numpy()
        within, asks, outside = (np.zeros(len(main), bool) for _ in range(3))
        tree = place.tree() if len(place.hosts) and len(place.guests) else None
        for i in place.guests if tree else ():
            at, _ = place.candidates(tree, i)
            in_main = main[at]
            within[at[in_main]] = True
            asks[i] |= bool(in_main.any())
            # of two that are both outside, the one with the larger label finds the other
            pair = at[~in_main & (place.label[at] < place.label[i])]
            if len(pair):
                outside[pair] = outside[i] = True
        key = rows["place"][0].as_py()
        home = xxhash.xxh3_64_intdigest(place.names[place.label[np.argmax(main)]]) - (1 << 63) if within.any() else 0
        out: dict[str, list] = {x.split()[0]: [] for x in _SURVIVOR.split(", ")}
        for at, where, host, guest in ((within, home, True, False), (asks, home, False, True), (outside, key, True, True)):
            k = np.flatnonzero(at)
            out["place"] += [where] * len(k)
            for x in ("c", "label", "n"):
                out[x] += rows[x].take(pa.array(k)).to_pylist()
            out["host"] += [host] * len(k)
            out["guest"] += [guest] * len(k)
        return out

    return _by_place(one, fields(_SURVIVOR))


def _by_place(one: Callable[[pa.Table], dict[str, list]], returns: T.StructType):
    """Over rows sorted by place and block: `one` of the rows of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(returns)
        current, held = None, []

        def done() -> Iterator[pa.RecordBatch]:
            if held:
                out = one(pa.Table.from_batches(held).combine_chunks())
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in schema], schema=schema)

        for batch in batches:
            keys = np.stack([batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("place", "block")], 1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1), len(keys)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                k = (int(keys[a][0]), int(keys[a][1]))
                if k != current:
                    yield from done()
                    current, held = k, []
                held.append(batch.slice(a, b - a))
        yield from done()

    return run


def _seated(rows: DataFrame, join: Join, meet_all: bool) -> DataFrame:
    """rows (place, c, label, n, host, guest, ...) with a block, for places that are too large for one tree.

    meet_all: each block of hosts meets each block of guests, so rows of such places come several times; else a
    row stands in one block only.
    """
    size = [F.sum(F.col(x).cast("long")).alias(f"{x}s") for x in ("host", "guest")] + [F.sum(F.when(F.col(x), F.col("n"))).alias(f"{x}_n") for x in ("host", "guest")]
    blocks = {x: F.greatest(F.lit(1), F.ceil(F.col(f"{x}s") / join.block), F.ceil(F.coalesce(F.col(f"{x}_n"), F.lit(0)) / join.block_hashes)).cast("int").alias(f"{x}_blocks") for x in ("host", "guest")}
    large = rows.groupBy("place").agg(*size).select("place", *blocks.values()).filter("host_blocks > 1 OR guest_blocks > 1")
    met = rows.join(large, "place", "left").withColumn("host_blocks", F.coalesce("host_blocks", F.lit(1))).withColumn("guest_blocks", F.coalesce("guest_blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("c"), F.col("host_blocks")).cast("int")
    if not meet_all:
        return met.withColumn("block", own).drop("host_blocks", "guest_blocks")
    seat = F.pmod(F.xxhash64("c", F.lit(7)), F.col("guest_blocks")).cast("int")
    at = lambda block, host: F.struct(block.cast("int").alias("block"), F.lit(host).alias("host"), F.lit(not host).alias("guest"))
    none = F.expr("cast(array() as array<struct<block:int,host:boolean,guest:boolean>>)")
    as_host = F.when(F.col("host"), F.transform(F.sequence(F.lit(0), F.col("guest_blocks") - 1), lambda g: at(own * F.col("guest_blocks") + g, True))).otherwise(none)
    as_guest = F.when(F.col("guest"), F.transform(F.sequence(F.lit(0), F.col("host_blocks") - 1), lambda b: at(b * F.col("guest_blocks") + seat, False))).otherwise(none)
    one = (F.col("host_blocks") == 1) & (F.col("guest_blocks") == 1)
    seats = F.when(one, F.array(F.struct(F.lit(0).alias("block"), F.col("host").alias("host"), F.col("guest").alias("guest")))).otherwise(F.concat(as_host, as_guest))
    others = [x for x in rows.columns if x not in ("host", "guest")]
    return met.withColumn("seat", F.explode(seats)).select(*others, "seat.*")


def _meet(rows: DataFrame, run, returns: str) -> DataFrame:
    return rows.repartition("place", "block").sortWithinPartitions("place", "block").mapInArrow(run, fields(returns))


@dataclass(frozen=True)
class _Tables:
    """texts: doc_id, text. classes: c, rep, n, first. filed: c, n, key, m. points: c, counts of filed classes."""

    texts: DataFrame
    classes: DataFrame
    filed: DataFrame
    points: DataFrame

    def with_sets(self, rows: DataFrame, most: int, join: Join) -> DataFrame:
        """rows, in blocks, with the sets of their classes (at most `most` of them); only these are made again from the texts."""
        ids = rows.select("c").distinct()
        readers = self.classes.select("c", F.col("rep").alias("doc_id")).join(ids, "c", "left_semi")
        sets = _asked(self.texts, readers, "doc_id", most).select("text").mapInArrow(_sets(join), _SETS)
        return rows.join(sets.join(ids, "c", "left_semi").dropDuplicates(["c"]), "c")


def _contract(t: _Tables, labels: DataFrame | None, join: Join, scratch: Scratch) -> DataFrame:
    """c, label: the components after one member of each has met others under one key, the one with most of them."""
    if labels is None:
        rows = t.filed.select(F.struct("c", "n").alias("one"), "key", "m", F.col("c").alias("label"))
    else:
        rows = t.filed.join(labels, "c").groupBy("key", "label").agg(F.min(F.struct("c", "n")).alias("one"))
        several = rows.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1")
        rows = rows.join(several, "key")
    chosen = rows.groupBy("label").agg(F.max(F.struct("m", "key", "one")).alias("x"))
    chosen = scratch.keep(chosen.select("label", F.col("x.key").alias("place"), "x.one.*", F.lit(True).alias("host"), F.lit(True).alias("guest")))
    near = scratch.keep(_meet(_seated(chosen, join, False).join(t.points, "c"), _near(join), _SURVIVOR))
    found = scratch.keep(_meet(t.with_sets(_seated(near, join, False), near.count(), join), _contracted(join), "label binary, into binary").filter("label <> into"))
    if labels is None:
        labels = chosen.select("c", "label")
    return scratch.keep(labels.join(found, "label", "left").select("c", F.coalesce("into", "label").alias("label")))


def _survivors(t: _Tables, labels: DataFrame, join: Join) -> DataFrame:
    """Rows for the refinement, from the search on counts under all keys with several components."""
    rows = t.filed.select("c", "n", "key").join(labels, "c")
    parts = rows.groupBy("key", "label").agg(F.count("*").alias("k"))
    keys = parts.groupBy("key").agg(F.count("*").alias("n_labels"), F.max(F.struct("k", "label")).alias("most")).filter("n_labels > 1")
    rows = rows.join(keys.select("key", F.col("most.label").alias("most")), "key").withColumn("main", F.col("label") == F.col("most"))
    rows = rows.select(F.col("key").alias("place"), "c", "label", "n", F.lit(True).alias("host"), (~F.col("main")).alias("guest"), "main")
    return _meet(_seated(rows, join, True).join(t.points, "c"), _filtered(join), _SURVIVOR)


def _bit(value: Column, bits: int) -> tuple[Column, Column]:
    """Where a value stands in a table of 2**bits bits: the word, and the bit within it."""
    at = F.pmod(F.xxhash64(value), F.lit(1 << bits))
    return F.shiftright(at, 6).alias("word"), F.call_function("shiftleft", F.expr("1L"), (at % 64).cast("int"))


def _asked(rows: DataFrame, readers: DataFrame, by: str, most: int) -> DataFrame:
    """The rows whose `by` may be among the readers', of whom there are at most `most`.

    The table has 8 to 16 bits for each reader, so an eighth of the other rows pass at most, up to 2**24 readers;
    with more of them more pass. It has at most 2**(_MOST_BITS - 6) rows, so it is broadcast, and rows that don't pass
    are not shuffled; what passes wrongly is sorted out by the join that follows.
    """
    bits = min(max((8 * most).bit_length(), _LEAST_BITS), _MOST_BITS)
    word, bit = _bit(F.col(by), bits)
    table = readers.select(word, bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    met = rows.withColumn("word", word).withColumn("bit", bit).join(F.broadcast(table), "word")
    return met.filter(F.col("bits").bitwiseAND(F.col("bit")) != 0).select(*rows.columns)


def _filed(classes: DataFrame, join: Join, scratch: Scratch) -> DataFrame:
    """c, n, key, m: the classes under each of their first hashes that others of a like size share; m of them do.

    The sizes under a hash, in order, fall into runs wherever one is too large to link with the one before; a key is a
    hash and a run of two classes or more. Only sizes are ordered, so a hash that most documents share is no more than
    as many rows as there are sizes. Classes go by a short number, with which no two need differ: who is filed under
    another's keys as well is compared in vain.
    Keys with the very same classes (a passage has many) are one: of each such set, told by its number and two sums
    of hashes, the least key stays.
    """
    each = classes.select(F.xxhash64("c").alias("id"), F.col("n").cast("int").alias("n"), F.explode("first").alias("hash"))
    sizes = each.groupBy("hash", "n").agg(F.count("*").alias("m"))
    by_size = Window.partitionBy("hash").orderBy("n")
    before = F.lag("n").over(by_size)
    apart = F.coalesce(join.num * F.col("n").cast("long") > join.den * before, F.lit(True))
    runs = sizes.withColumn("apart", apart.cast("int")).withColumn("run", F.sum("apart").over(by_size))
    runs = runs.groupBy("hash", "run").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.sum("m").alias("m")).filter("m > 1").select("hash", "low", "high")
    filed = scratch.keep(each.join(runs, "hash").filter("n between low and high").select("id", F.xxhash64("hash", "low").alias("key")))
    told = filed.groupBy("key").agg(F.count("*").alias("m"), F.bit_xor("id").alias("x"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("y"))
    keys = told.groupBy("m", "x", "y").agg(F.min("key").alias("key")).select("key", "m")
    out = scratch.keep(filed.join(keys, "key").join(classes.select(F.xxhash64("c").alias("id"), "c", "n"), "id").select("c", "n", "key", "m"))
    scratch.drop(filed)
    return out


def class_components(docs: DataFrame, join: Join) -> tuple[DataFrame, DataFrame]:
    """The documents (doc_id, n, c) and, for each class that is filed with others, its component (c, label)."""
    small_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "ngram-join")
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), body(docs).cast("binary").alias("text"))
    often = docs.sparkSession.sparkContext.broadcast(rarity(texts, join))
    whole = scratch.keep(texts.mapInArrow(_points(often, join), "doc_id long, n long, c binary, first array<long>, counts binary"))
    often.unpersist()
    classes = scratch.keep(whole.filter("n > 0").groupBy("c").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("first").alias("first")))
    filed = _filed(classes, join, scratch)
    ids = filed.select("c").distinct()
    points = _asked(whole.select("c", "counts"), ids, "c", classes.count()).dropDuplicates(["c"]).join(ids, "c", "left_semi")
    t = _Tables(texts, classes, filed, scratch.keep(points))
    labels = _contract(t, None, join, scratch)
    labels = _contract(t, labels, join, scratch)
    left = scratch.keep(_survivors(t, labels, join).groupBy("place", "c").agg(F.first("label").alias("label"), F.first("n").alias("n"), F.max("host").alias("host"), F.max("guest").alias("guest")))
    links = components(_meet(t.with_sets(_seated(left, join, True), left.count(), join), _refined(join), "a binary, b binary"), scratch)
    labels = labels.join(links.select(F.col("node").alias("label"), F.col("label").alias("into")), "label", "left").select("c", F.coalesce("into", "label").alias("label"))
    return whole.select("doc_id", "n", "c"), labels


def ngram_components(docs: DataFrame, join: Join = Join()) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest doc_id that links reach, itself included).

    A document without words (null or empty text) has no shingles and is its own component. Rows without doc_id take
    part; a component of such rows alone has no identifier. Repeated rows have the same set, so the same component.
    Extra columns are ignored; an empty table gives an empty result.
    """
    points, labels = class_components(docs, join)
    # each class first, so that a large group of copies is one row in what follows
    own = points.filter("n > 0").groupBy("c").agg(F.min("doc_id").alias("own"))
    own = own.join(labels, "c", "left").withColumn("label", F.coalesce("label", "c"))
    least = own.join(own.groupBy("label").agg(F.min("own").alias("least")), "label").select("c", "least")
    out = points.join(least, "c", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, join: Join) -> DataFrame:
    """Of each component the document with the smallest doc_id, with its own columns; documents without words stay."""
    stay = ngram_components(docs, join).filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id").distinct()
    (key,) = free_names(docs, "stays")
    stay = stay.select(F.col("doc_id").alias(key))
    return docs.join(stay, docs["doc_id"].cast("long").eqNullSafe(stay[key]), "left_semi").select(*docs.columns)
