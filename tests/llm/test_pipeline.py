"""The corpus pipeline on a small corpus, stage by stage and as a whole, against plain Python."""

from __future__ import annotations

import ast
import random
import re
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest
from test_operators import _components

from grovekit.llm import quality_rules

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    r = random.Random(12)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "ne", "ru", "ta") for b in ("den", "fol", "gar", "hin", "jus", "kel", "lam")]
    rows, labels = [], []
    for i in range(60):  # clean
        rows.append((i, " ".join(r.choice(words) for _ in range(r.randint(40, 120))), "en", "abc"[min(2, int(r.expovariate(1.0)))], 0))
        labels.append((i, 1, 0))
    for i in range(60, 90):  # junk that the base rule lets pass
        rows.append((i, " ".join(r.choice(["#", "$$", "%", *words]) + r.choice(["", "|", "*"]) for _ in range(60)), "en", "a", 0))
        labels.append((i, 0, 0))
    for i in range(90, 100):
        rows.append((i, "  " + rows[i - 90][1].replace(" ", " \n"), "en", "b", 0))  # equal but for white space
    for i in range(100, 110):
        w = rows[i - 100][1].split()
        rows.append((i, " ".join([*w[:-1], "other"]), "en", "c", 0))  # near
    rows += [(110, None, "en", "a", 0), (111, "", None, None, 0), (112, "a few words", "en", "a", 0), (113, "again and once more " * 30, "en", "a", 0), (50, rows[50][1], "en", rows[50][3], 0)]
    folder = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder), rows


def test_stages_equal_brute_force(spark, corpus):
    folder, rows = corpus
    stages, docs = dict(corpus_pipeline.STAGES), spark.read.parquet(f"{folder}/documents.parquet")

    def step(name):
        out = stages[name](spark, docs, folder).cache()
        return out, [(x["doc_id"], x["text"], x["source"]) for x in out.collect()]

    docs, kept = step("quality_rules")
    assert docs.columns == [x.split()[0] for x in SCHEMA.split(", ")]
    assert {i for i, _, _ in kept} == set(range(60)) | set(range(90, 110)) and len(kept) == 81
    rules = quality_rules.fit(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    assert rules.rules and "symbols_per_word" in rules.text()[0]

    squeeze = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    least = {}
    for i, t, _ in kept:
        least[squeeze(t)] = min(i, least.get(squeeze(t), i))
    docs, kept = step("exact_dedup")
    assert Counter(i for i, _, _ in kept) == Counter(least.values())

    groups = {ast.literal_eval(k) for k in _components([(i, t) for i, t, _ in kept], 5, 80, 100)}  # (doc_id, set size, component)
    docs, kept = step("ngram_join")
    assert {i for i, _, _ in kept} == {c for _, _, c in groups} and len(kept) == len({c for _, _, c in groups}) < len(groups)

    before = {i for i, _, _ in kept}
    docs, kept = step("temperature_mixing")
    times = Counter(i for i, _, _ in kept)
    assert set(times) == before and max(times.values()) <= 3
    by_source = defaultdict(set)
    for i, _, s in kept:
        by_source[s].add(times[i])
    assert all(max(v) - min(v) <= 1 for v in by_source.values())

    pieces, length = stages["packing"](spark, docs, folder).collect(), defaultdict(int)
    for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
        assert p["offset"] == length[p["sequence_id"]]
        length[p["sequence_id"]] += p["length"]
    assert max(length.values()) <= 1024 and Counter(p["doc_id"] for p in pieces if p["start"] == 0) == times
    tokens = {p["doc_id"]: p["doc_tokens"] for p in pieces}
    assert sum(length.values()) == sum(tokens[i] * n for i, n in times.items())
    assert len(length) <= np.ceil(sum(length.values()) / 1024) + 2


def test_whole_run(spark, corpus, tmp_path):
    folder, _ = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    key = lambda df: sorted(map(tuple, df.select("doc_id", "start", "length", "ids_crc32", "doc_tokens").collect()))
    assert key(corpus_pipeline.run(spark, folder)) == key(docs)
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
