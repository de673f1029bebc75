"""Cases that the operators once left out, each against plain Python."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from grovekit.llm import licenses, packing, personal_data, quality_rules, secrets


def _best_window(text: str) -> dict[int, float]:
    """For each template the best coefficient over all windows of all lengths that reach the threshold."""
    w = re.sub("[^A-Za-z0-9]+", " ", text).strip().lower().split()
    grams, out = [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)], {}
    for k, (_, _, b) in enumerate(licenses.template_bigrams()):
        have = Counter(b)
        for i in range(len(grams)):
            left, shared = dict(have), 0
            for n in range(1, min(len(grams) - i, 3 * len(b) // 2) + 1):
                if left.get(grams[i + n - 1], 0):
                    left[grams[i + n - 1]] -= 1
                    shared += 1
                if 40 * shared >= licenses.THRESHOLD * (n + len(b)):
                    out[k] = max(out.get(k, 0.0), 2.0 * shared / (n + len(b)))
    return out


def test_licenses_within_longer_text(spark):
    rows, prose = [], "words that stand around it and go on for quite a while "
    for k, (_, _, t) in enumerate(licenses.TEMPLATES):
        w = t.split()
        comment = "/*\n" + "".join(f" * {' '.join(w[i : i + 8])}\n" for i in range(0, len(w), 8)) + " */\n" + "int f(int a) { return a + 1; }\n" * 60
        rows += [(k, comment), (100 + k, 6 * prose + t + " " + 6 * prose), (200 + k, 6 * prose + " ".join(w[: len(w) // 2]) + 6 * prose)]
    rows += [(300, 6 * prose + "Released under the MIT License. " + 6 * prose + "Released under the MIT License. " + 6 * prose), (301, "of the " * 3000 + "license the license of " * 300)]
    found = {r["doc_id"]: r for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, (name, _, _) in enumerate(licenses.TEMPLATES):
        assert found[k]["license"] == name, k
        best = _best_window(rows[3 * k + 1][1])
        assert found[100 + k]["license"] == name and found[100 + k]["dice"] == max(best.values()) and found[100 + k]["n_hits"] == len(best), k
        assert (found[200 + k]["n_hits"] > 0) == bool(_best_window(rows[3 * k + 2][1])), k
    assert (found[300]["license"], found[300]["dice"], found[300]["n_hits"]) == ("MIT", 1.0, 2)
    assert found[301]["n_hits"] == 0


def test_packing_gives_added_tokens_their_ids(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))  # with its own settings
    r, end = random.Random(7), "<|endoftext|>"
    texts = [end, end + end, f"one {end} two", f"{end}\n x  {end}y", "<|endoftext|", f"<{end}>", f"a {end[:-1]} |>"]
    texts += ["".join(r.choice(["a", " ", "  ", "\n", " \n", "it's", "12", "é", "<|", "|>", end, "word "]) for _ in range(r.randint(0, 25))) for _ in range(200)]
    rows = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    ids = {i: [*tok.encode(t, add_special_tokens=False).ids, 0] for i, t in enumerate(texts)}
    assert 50256 in ids[0]
    assert {r["doc_id"]: (r["doc_tokens"], r["ids_crc32"]) for r in rows} == {i: (len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in ids.items()}


def test_secret_lexer_reads_whole_syntax():
    key = "Zk3v9QpL8xW2mN5b"
    forms = [
        'config["db_passphrase"] = "{}"', 'passphrase: str = "{}"', 'const passphrase: string = "{}";', 'PASSPHRASE = (\n    "{}"\n)', "passphrase:\n  {}\n", "passphrase: |\n  {}\n",
        '{{"passphrase": {{"value": "{}"}}}}', "passphrase:\n  value: {}\nother: 1\n", "<passphrase>{}</passphrase>", '<add key="passphrase" value="{}"/>', 'passphrase = os.getenv("X", "{}")', 'passphrase = str(os.getenv("X", "{}"))',
        'passphrase: Optional[str] = "{}"', 'var passphrase string = "{}"', 'passphrase_list = ["{}"]', 'char passphrase[] = "{}";', 'passphrase =\n    "{}"', 'passphrase = "{}"', "passphrase: {}", 'x = 1\nf(passphrase="{}")',
    ]
    for f in forms:
        text = "plain words, don't mind\n" + f.format(key) + "\nand more\n"
        assert [text[a:b] for k, a, b in secrets.scan(text) if k == "literal"] == [key], f
    long = "".join(random.Random(2).choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", k=6000))
    assert [b - a for k, a, b in secrets.scan(f'passphrase = "{long}"') if k == "literal"] == [6000]
    assert len(secrets.scan('passphrase = "Zk3v9QpL8xW2"\n' + "passphrase = passphrase + passphrase\n" * 60)) == 1


def test_many_matches_in_one_text(spark):
    """Work that grows with the square of a text would not end here."""
    texts = ["1.2.3.4 " * 20_000, "a@b.co, " * 20_000, "call 555-123-4567 " * 5_000, "x at y dot com 10.0.0.1 " * 3_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r for r in personal_data.find(df).collect()}
    assert (found[0]["n_ip"], found[1]["n_email"], found[3]["n_ip"]) == (20_000, 20_000, 3_000)
    assert found[2]["n_added"] == 5_000 and found[2]["spans"].split(",")[:2] == ["number:5:17", "number:23:35"]
    clear = {r["doc_id"]: r["text"] for r in personal_data.redacted(df).collect()}
    assert clear[0] == "[ip] " * 20_000 and clear[1] == "[email], " * 20_000 and clear[2] == "call [number] " * 5_000
    quotes = 'key a="' + '\\"' * 100_000 + '\nsecret_key = "Zk3v9QpL8xW2mN5b"\n' + 'password=hunter2abc key="Zk3v9QpL8xW2mN5b" ' * 5_000
    spans = secrets.scan(quotes)
    assert Counter(k for k, _, _ in spans) == {"assign": 5_000, "literal": 5_001}
    assert len(secrets.scan("secret = " + " + ".join(f'"ab{k}x"' for k in range(20_000)))) == 20_000


def test_spans_clear_of_others(spark):
    r = random.Random(5)
    rows = []
    for i in range(200):
        others = [(a, a + r.randint(1, 9)) for a in (r.randint(0, 60) for _ in range(r.randint(0, 6)))]
        marks = sorted(r.sample(range(70), 2 * r.randint(0, 6)))
        rows.append((i, list(zip(marks[::2], marks[1::2], strict=True)), others))
    kind = "array<struct<start:int,end:int>>"
    df = spark.createDataFrame(rows, f"i int, spans {kind}, others {kind}")
    got = {x["i"]: [tuple(m) for m in x["kept"]] for x in df.select("i", personal_data.clear_of(F.col("spans"), F.col("others")).alias("kept")).collect()}
    assert got == {i: [(a, b) for a, b in spans if not any(s < b and a < e for s, e in others)] for i, spans, others in rows}
    numbers = spark.createDataFrame([(i, [r.randint(-50, 50) for _ in range(n)]) for i, n in enumerate((0, 1, 2, 3, 9, 10, 100))], "i int, v array<int>")
    for x in numbers.select("v", personal_data.running(F.col("v"), 0, lambda a, b: a + b).alias("sums"), personal_data.running(F.col("v"), -99, lambda a, b: F.greatest(a, b)).alias("tops")).collect():
        assert x["sums"] == [sum(x["v"][: k + 1]) for k in range(len(x["v"]))] and x["tops"] == [max(x["v"][: k + 1]) for k in range(len(x["v"]))]


def test_rules_cut_between_the_classes():
    r = np.random.default_rng(4)
    n = 400
    bad = np.arange(n) % 4 == 0
    x = {"symbols_per_word": np.where(bad & (np.arange(n) % 8 == 0), r.uniform(0.5, 0.9, n), 0.0), "words": np.where(bad & (np.arange(n) % 8 == 4), r.uniform(10, 20, n), r.uniform(60, 300, n)), "noise": r.random(n)}
    rules = quality_rules.learn(x, bad)
    told = np.zeros(n, bool)
    for rule in rules.rules:
        told |= np.logical_and.reduce([c.holds(x) for c in rule])
    assert (told == bad).all()
    cut = {c.feature: c.threshold for rule in rules.rules for c in rule}
    assert 0.2 < cut["symbols_per_word"] < 0.5 and 20 < cut["words"] < 60
    assert quality_rules.learn({"noise": r.random(n)}, bad).rules == []


#: Texts written by hand, not by the generator the trees learn from; what stands between double angle brackets is personal.
HELD = """
You can reach her under <<mueller (at) uni-bonn.de>> until Friday.|Questions go to <<sales[at]firm[dot]de>>, please.|mail: <<jane.roe at example dot org>>|Contact <<info(at)club.fr>> for seats.|correo <<ana_b [at] empresa.es>> gracias
Call <<(212) 555-0187>> after six.|Fax: <<415.555.0132>>|phone <<617-555-0199>> or come by|Tel <<030 1234 5678>>|My cell is <<303-555-0110>>.
SSN <<078-05-1120>> was on the form|social security: <<219-09-9999>>|passport holder's ssn is <<457-55-5462>>
IBAN <<DE89 3704 0044 0532 0130 00>>|Konto <<GB82 WEST 1234 5698 7654 32>>|account <<NL91ABNA0417164300>>|pay to <<FR7630006000011234567890189>>
They met at noon. Later it rained.|We sat at home. Nobody came.|Look at this dot in the corner|arrive at eight. Tea is served
The order 48820391 was shipped.|Invoice 2024-11-28 is open|ISBN 978-3-16-148410-0|Version 10.2.33.4000 fixes it|1999 2000 2001 2002 were dry years|Between 1200 - 1450 the town grew|page 1234567|about 12 345 678 people|Ref 555 019 283 in the ledger|serial 9081726354
Model DE12345678901234567890 is old|code FR11 2233 4455 6677 8899 00|batch NL00ABCD1234567890|lot GB11 AAAA 1234 5678 9012 34
"""


def test_added_spans_on_texts_by_hand(spark):
    texts = [t.strip() for line in HELD.strip().split("\n") for t in line.split("|")]
    rows, true = [], {}
    for i, t in enumerate(texts):
        a = t.find("<<")
        true[i] = {(a, t.find(">>") - 2)} if a >= 0 else set()
        rows.append((i, t.replace("<<", "").replace(">>", "")))
    got = {r["doc_id"]: {tuple(map(int, x.split(":")[1:])) for x in r["spans"].split(",") if x.split(":")[0] in personal_data.ADDED} for r in personal_data.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    hit, said, all_true = sum(len(got[i] & true[i]) for i in got), sum(map(len, got.values())), sum(map(len, true.values()))
    print(hit, said, all_true, [(rows[i][1], sorted(got[i]), sorted(true[i])) for i in got if got[i] != true[i]])
    assert said and hit / said >= 0.9 and hit / all_true >= 0.6
