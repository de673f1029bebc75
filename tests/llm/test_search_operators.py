"""Decontamination, spelling variants and hard negatives against brute force, with awkward rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from grovekit.llm import hard_negatives as hn
from grovekit.llm import spelling
from grovekit.llm.phrase_index import PhraseIndex, decontaminate, near_items

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))


def contamination(docs, items, window):
    out = Counter()
    for doc, text in docs:
        w, hit, names = words(text), set(), set()
        for name, item in items:
            b = words(item)
            k = min(window, len(b))
            grams = {tuple(b[i : i + k]) for i in range(len(b) - k + 1)} if b else set()
            for i in range(len(w) - k + 1):
                if tuple(w[i : i + k]) in grams:
                    hit |= set(range(i, i + k))
                    names.add("null" if name is None else str(name))
        out[doc, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)] += 1
    return out


def phrase_rows():
    r = random.Random(3)
    text = lambda n, v: " ".join(r.choice("abcdefgh"[:v]) for _ in range(n))
    items = [(10, "One two, three FOUR five six Éseven eight 9 ten eleven"), (2, "the the the the the the"), (3, "short one"), (4, ""), (5, None), (6, "!!! --"), (7, text(30, 4)), (7, text(12, 3)), (None, "null item here now"), (9, text(30, 4)), (10, "one two three four five six éseven"), (11, "solo")]
    docs = [
        (1, "x one TWO three\nfour five-six éseven y"), (2, None), (3, ""), (None, "null item here now"), (4, "the " * 9), (5, "a short one and solo"), (5, "a short one and solo"), (6, items[6][1] + " " + items[7][1]),
        (7, "q " * 20_000 + items[9][1] + " q" * 20_000), (8, "one two three x four five six éseven"), (9, "Éseven éSEVEN"),
    ]
    docs += [(100 + i, text(r.randint(1, 200), r.randint(2, 6))) for i in range(60)]
    return docs, items


def frames(spark, docs, items):
    d = spark.createDataFrame([(*x, 1, "clash") for x in docs], "doc_id long, text string, pos int, term string").repartition(3)
    return d, spark.createDataFrame([(*x, 5) for x in items], "item_id long, text string, n int").repartition(2)


def test_decontamination(spark):
    docs, items = phrase_rows()
    got = decontaminate(*frames(spark, docs, items), window=5)
    assert Counter(tuple(r) for r in got.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()) == contamination(docs, items, 5)
    assert "Python" not in got._jdf.queryExecution().toString() and "Arrow" not in got._jdf.queryExecution().toString()


@pytest.mark.parametrize("no", ["docs", "items"])
def test_decontamination_of_empty_tables(spark, no):
    docs, items = phrase_rows()
    d, b = frames(spark, docs, items)
    got = decontaminate(d.limit(0) if no == "docs" else d, b.limit(0) if no == "items" else b).collect()
    assert (no == "docs" and not got) or Counter((r["doc_id"], r["n_hit"]) for r in got) == Counter((i, 0) for i, _ in docs)


def test_proximity(spark):
    """The two rarest terms of a window within slop of their places, whatever stands between."""
    docs = [(1, "u v alpha w beta u v"), (2, "alpha u v u v u v u v u v w beta"), (3, "beta alpha"), (4, "alpha beta"), (5, "u v w " * 600), (6, "alpha " * 500 + "beta " * 500)]
    d, b = frames(spark, docs, [(1, "u alpha beta v"), (2, "w")])
    got = {(r["doc_id"], r["off"]) for r in near_items(d, b, window=4, slop=3).collect()}
    assert got == {(1, 1), (3, 2), (4, 0), (6, 0)}


def test_rarest_terms_are_looked_up(spark):
    d, b = frames(spark, [(1, "c c c a b"), (2, "c a b c"), (3, "c b")], [(1, "c a b c")])
    index = PhraseIndex.build(d, b, 4)
    assert [(r["o1"], r["o2"]) for r in index.lookups.collect()] == [(1, 2)]


def variants_of(docs, factor=5, length=6, least=5):
    c = Counter()
    for doc, text in docs:
        for m in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            m = m.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{m}".encode())
            if h % 199 == 0:
                m = m[: h % len(m)] + m[h % len(m) + 1 :]
            c[m] += 1
    c = {k: v for k, v in c.items() if v >= least and len(k) >= length}
    gone = defaultdict(set)
    for x in c:
        for i in range(len(x)):
            gone[x[:i] + x[i + 1 :]].add(x)
    near = {x: ({y for i in range(len(x)) for y in gone[x[:i] + x[i + 1 :]] if sum(a != b for a, b in zip(x, y, strict=True)) == 1} | gone.get(x, set()) | {z for i in range(len(x)) if (z := x[:i] + x[i + 1 :]) in c}) for x in c}
    best = {x: min(near[x], key=lambda y: (-c[y], y), default=None) for x in c}
    form = {x: b if b is not None and c[b] >= factor * c[x] else None for x, b in best.items()}

    def root(x):
        while form[x] is not None:
            x = form[x]
        return x

    return {(x, form[x], root(x), c[x], len(near[x]), c[form[x]] if form[x] is not None else None) for x in c}


def spelling_rows():
    r = random.Random(5)
    stems = ["".join(r.choice("abcÀé") for _ in range(r.randint(6, 9))) for _ in range(40)]
    docs = [(None, "nulldoc nulldoc NULLDOC"), (1, None), (2, ""), (3, "short ab a" * 5), (900, "chainaaa " * 6 + "chainaab " * 40 + "chainabb " * 250), (4, ("l" * 5000 + "ong ") * 6 + ("l" * 5001 + "ong ") * 40)]
    for i in range(400):
        out = []
        for _ in range(r.randint(0, 60)):
            w = stems[min(int(r.expovariate(0.15)), 39)]
            if r.random() < 0.3:
                k = r.randrange(len(w))
                w = r.choice([w[:k] + w[k + 1 :], w[:k] + r.choice("abÿ") + w[k:], w[:k] + r.choice("abcÿ") + w[k + 1 :]])
            out.append(w.upper() if r.random() < 0.2 and w.isascii() else w)
        docs.append((i, r.choice([" ", "-", "\n1 "]).join(out)))
    return docs + docs[:30]


def test_spelling_variants(spark, monkeypatch):
    docs = spelling_rows()
    frame = spark.createDataFrame([(*x, 1, "clash") for x in docs], "doc_id long, text string, n int, word string").repartition(3)
    want = variants_of(docs)
    assert sum(w[1] is not None for w in want) > 20 and any(w[1] != w[2] for w in want if w[1])
    names = ("word", "form", "root", "n", "n_near", "form_n")
    assert {tuple(r) for r in spelling.variants(frame).select(*names).collect()} == want
    # many small shards, groups and blocks give the same
    monkeypatch.setattr(spelling, "SHARD_WORDS", 50)
    monkeypatch.setattr(spelling, "GROUP_BYTES", 2000)
    monkeypatch.setattr(spelling, "BLOCK_WORDS", 20)
    assert {tuple(r) for r in spelling.variants(frame).select(*names).collect()} == want
    assert spelling.variants(frame.limit(0)).collect() == [] and spelling.variants(frame.filter("text = ''")).collect() == []


def test_automaton_meets_each_neighbour_once():
    r = random.Random(1)
    some = sorted({"".join(r.choice("ab") for _ in range(r.randint(1, 7))) for _ in range(120)})
    trie = spelling.Trie.unpacked(spelling.packed(some, list(range(1, len(some) + 1))))

    def distance_one(x, y):
        if len(x) == len(y):
            return sum(a != b for a, b in zip(x, y, strict=True)) == 1
        x, y = sorted((x, y), key=len)
        return len(y) == len(x) + 1 and any(y[:i] + y[i + 1 :] == x for i in range(len(y)))

    for w in [*some, "", "c", "abc"]:
        found = [x for _, x in trie.near(w)]
        assert sorted(found) == [x for x in some if distance_one(w, x)], w


def negatives_of(rows, n_pos=5, k=5):
    good = []
    for i, (vec, v, label) in enumerate(rows):
        if vec is not None and v is not None and label is not None and all(c is not None and np.isfinite(c) for c in v):
            good.append((i, vec, [int(np.floor(256 * np.float64(c))) for c in v], (label + 1) % 10 if vec % 7 == 0 else label))
    out = Counter()
    for i, vec, q, label in good:
        if vec % 100:
            continue
        scored = [(max(1 - (1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(q, x)))), w, lab) for j, w, x, lab in good if j != i]  # noqa: B905
        scored.sort(key=lambda s: (-s[0], s[1]))
        for ps, p, _ in [s for s in scored if s[2] == label][:n_pos]:
            for rank, (ns, n, _) in enumerate([s for s in scored if s[2] != label and 80 * ps <= 100 * s[0] <= 100 * ps][:k], 1):
                out[vec, p, rank, n, ps, ns] += 1
    return out


def test_hard_negatives(spark, monkeypatch):
    r = np.random.default_rng(2)
    centres = r.normal(0, 0.4, (6, 8))
    rows = [(int(i), [float(np.float32(c)) for c in centres[i % 6] + r.normal(0, 0.1, 8)], int(r.integers(0, 4))) for i in range(900)]
    rows += [(900 + i, rows[3][1], i % 3) for i in range(300)]  # one vector for a quarter of the rows: ties
    rows += [rows[200], rows[200], rows[5], rows[5]]
    rows += [(5000, None, 1), (5001, [1.0, None], 1), (None, rows[0][1], 1), (5100, rows[0][1], None), (5200, [float("nan")] * 8, 1), (5300, [float("inf")] * 8, 1), (5400, [], 1), (5500, [0.0] * 8, 2), (5600, [0.3], 2), (5700, [1e30] * 8, 3), (5701, [1e30, -1e30] * 4, 1)]
    frame = spark.createDataFrame([(*x, "clash", 1) for x in rows], "vec_id long, embedding array<double>, label int, uid string, score int").repartition(5)
    names = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    want = negatives_of(rows)
    assert len(want) > 50
    assert Counter(tuple(x) for x in hn.hard_negatives(frame).select(*names).collect()) == want
    monkeypatch.setattr(hn, "BLOCK_CELLS", 8 * 100)
    monkeypatch.setattr(hn, "LEAF", 8)
    assert Counter(tuple(x) for x in hn.hard_negatives(frame).select(*names).collect()) == want
    assert hn.hard_negatives(frame.limit(0)).collect() == [] and hn.hard_negatives(frame.filter("vec_id = 7")).collect() == []


def test_traversal_is_nearest_first_and_prunes():
    r = np.random.default_rng(4)
    x = np.floor(256 * np.concatenate([r.normal(c, 0.02, (400, 6)) for c in (-1, 0, 1)]))
    tree = hn.VPTree(x, np.arange(1200), np.zeros(1200, int), leaf=16)
    for q in x[::300]:
        s = (x @ q).astype(int)
        low, high = int(np.quantile(s, 0.5)), int(np.quantile(s, 0.9))
        seen: dict = {}
        got = list(tree.nearest(q, lambda rows: np.ones(len(rows), bool), low, high, seen))
        assert got == sorted(((int(v), i) for i, v in enumerate(s) if low <= v <= high), key=lambda p: (-p[0], p[1]))
        seen = {}
        next(tree.nearest(q, lambda rows: np.ones(len(rows), bool), None, None, seen))
        assert abs(q.mean()) < 100 or len(seen) < 50  # of about 120 leaves; from the middle all rows are about as far


def test_packing_in_many_small_groups(spark):
    from grovekit.llm import packing

    rows = [(i, "word " * (3000 if i % 3 == 0 else i % 40)) for i in range(200)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for in_group in (1, 7, 10**6):
        got = packing.pack(frame, rows_in_group=in_group).collect()
        taken = defaultdict(list)
        for r in got:
            taken[r["sequence_id"]].append((r["offset"], r["length"]))
        for spans in taken.values():
            spans.sort()
            assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:], strict=False)) and spans[-1][0] + spans[-1][1] <= 1024
        assert sorted(taken) == list(range(len(taken))) and len(got) == len({(r["doc_id"], r["start"]) for r in got})
    assert packing.pack(frame, rows_in_group=1, groups=4).count() == len(got)
