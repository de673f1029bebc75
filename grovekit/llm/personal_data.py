"""Personal data: fixed patterns, and candidates that boosted trees accept or turn down. Spark expressions only.

Besides the four fixed kinds, three generous generators propose spans that may overlap: spelled-out mail
addresses, sequences of 7 to 19 digits, and account numbers. Each proposal gets features of its format (digits,
groups, separators, checksums) and of its context (words before it). Trees boosted on synthetic, labelled texts
score it; the score is calibrated on held-out texts, and each generator has a threshold at which the held-out
precision is at least 99 %. Accepted spans that meet no fixed one are added; of accepted ones that meet, account
numbers go before mail addresses, and these before sequences of digits.

Offsets: `regexp_extract_all` gives the matches and `split` what stands between them, by the same matcher, so the
running sum of both lengths gives each match its place, in code points. Running sums and maxima go by chunks of about
the square root of an array's length, as every step of a fold copies what it has; so a text of m matches costs m**1.5
small steps at worst.
"""

from __future__ import annotations

import functools
import random
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .boosting import Boosted, boost, calibrate, threshold
from .common import body, fields

BASE = ("email", "ip", "card", "phone")
ADDED = ("mail_words", "number", "account")
FIRST = ("account", "mail_words", "number")  # of accepted spans that meet
#: The fixed kinds. Runs are possessive, and a match begins at the start of a run or where the last match ended,
#: which is where the leftmost match begins; so matching is linear in the text and needs no deep stack.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){15,}+",  # 16 digits at least, so that few matches are kept for the checks
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "mail_words": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{2,40}+\x20?(?:\(at\)|\[at\]|\{at\}|\x20at\x20)\x20?[A-Za-z0-9-]{2,40}+(?:\x20?(?:\(dot\)|\[dot\]|\{dot\}|\.|\x20dot\x20)\x20?[A-Za-z]{2,12}+){1,3}+",
    "number": r"(?<![0-9A-Za-z+.])\(?[0-9](?:[\x20().-]{0,2}[0-9]){6,18}+(?![0-9A-Za-z])",
    "account": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}+(?:\x20?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])",
}
_GUARD = {"email": "@", "mail_words": "at"}
_SPANS = "array<struct<start:int,end:int,s:string,before:string>>"
#: Words that announce a kind, in the languages of the tables; looked for in the 32 characters before a span, no further back than the match before.
CONTEXT = {
    "calls": "phone|tel|call|mobile|cell|fax|móvil|llam|anruf|handy|appel",
    "cards": "card|visa|carte|karte|tarjeta|credit",
    "mails": "mail|contact|write|correo|schreib|écri",
    "ids": "ssn|social|passport|dni|nif|ausweis|identi|sécurité",
    "banks": "iban|account|bank|konto|cuenta|compte",
    "codes": "order|invoice|ref|isbn|version|article|nummer|número|total|page",
}
FEATURES = ("digits", "separators", "brackets", "spaces", "phone_groups", "id_groups", "luhn", "mod97", "marked_at", "known_end", *CONTEXT)


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value computed once."""
    return F.transform(F.array(value), then)[0]


def running(values: Column, start: int, step: Callable[[Column, Column], Column]) -> Column:
    """step over all elements up to each, for whole numbers; start changes nothing, and step groups in any way."""

    def along(x: Column, first: Column) -> Column:
        return F.aggregate(x, F.array(first), lambda acc, y: F.array_append(acc, step(F.element_at(acc, -1), y)))

    def by_chunks(v: Column, k: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / k).cast("int")), lambda c: F.slice(v, c * k + 1, k))
        return _let(chunks, lambda cs: _let(along(F.transform(cs, lambda x: F.aggregate(x, F.lit(start), step)), F.lit(start)), lambda heads: F.flatten(F.transform(cs, lambda x, i: F.slice(along(x, heads[i]), F.lit(2), F.size(x))))))

    whole = _let(values, lambda v: by_chunks(v, F.ceil(F.sqrt(F.size(v))).cast("int")))
    return F.when(F.size(values) > 0, whole).otherwise(F.expr("cast(array() as array<int>)"))


def _sums(values: Column) -> Column:
    return running(values, 0, lambda x, y: x + y)


def located(text: Column, pattern: str, guard: str | None = None) -> Column:
    """All matches with start and end in code points, and what stands before."""

    def of(found: Column) -> Column:
        h, g = found["h"], found["g"]
        ends = _sums(F.transform(h, lambda x, i: F.length(x) + F.length(g[i])))
        return _let(ends, lambda e: F.transform(h, lambda x, i: F.struct((e[i] - F.length(x)).alias("start"), e[i].alias("end"), x.alias("s"), F.right(F.concat(F.coalesce(F.get(h, i - 1), F.lit("")), g[i]), F.lit(32)).alias("before"))))

    none = F.expr(f"cast(array() as {_SPANS})")
    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("h"), F.split(text, pattern, -1).alias("g"))
    may = text.rlike(pattern)
    return F.when(F.contains(text, F.lit(guard)) & may if guard else may, _let(both, of)).otherwise(none)


def _no_spans() -> Column:
    return F.expr("cast(array() as array<struct<start:int,end:int>>)")


def _plain(spans: Column) -> Column:
    return F.transform(spans, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end")))


def clear_of(spans: Column, others: Column) -> Column:
    """The spans (start, end; by start) that meet none of the others, which may meet one another."""

    def of(u: Column) -> Column:
        before = running(F.transform(u, lambda x: F.when(x["own"] == 0, x["end"]).otherwise(F.lit(-1))), -1, lambda x, y: F.greatest(x, y))
        far = (1 << 31) - 1
        after = F.reverse(running(F.reverse(F.transform(u, lambda x: F.when(x["own"] == 0, x["start"]).otherwise(F.lit(far)))), far, lambda x, y: F.least(x, y)))
        scans = F.struct(before.alias("before"), after.alias("after"))
        return _let(scans, lambda p: F.filter(u, lambda x, i: (x["own"] == 1) & (p["before"][i] <= x["start"]) & (p["after"][i] >= x["end"])))

    tagged = lambda a, own: F.transform(a, lambda m: F.struct(m["start"].alias("start"), F.lit(own).alias("own"), m["end"].alias("end")))
    union = F.array_sort(F.concat(tagged(others, 0), tagged(spans, 1)))
    return F.when((F.size(spans) == 0) | (F.size(others) == 0), _plain(spans)).otherwise(_plain(_let(union, of)))


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    n = F.length(digits)

    def step(acc: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        return acc + F.when(i % 2 == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    return (n > 0) & (F.aggregate(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), F.lit(0), step) % 10 == 0)


def _mod97(s: Column) -> Column:
    """The checksum of account numbers: the first four characters go to the end, letters count from 10."""
    t = F.replace(s, F.lit(" "), F.lit(""))
    t = F.concat(F.substring(t, 5, 40), F.substring(t, 1, 4))

    def step(acc: Column, c: Column) -> Column:
        k = F.ascii(c) - F.when(c.between("0", "9"), F.lit(48)).otherwise(F.lit(55))
        return F.pmod(acc * F.when(k > 9, F.lit(100)).otherwise(F.lit(10)) + k, F.lit(97))

    return F.aggregate(F.split(t, ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise(step(a, c))) == 1


def base_spans(text: Column) -> dict[str, Column]:
    fits = {
        "email": lambda m: F.lit(True),
        "ip": lambda m: F.forall(F.split(m["s"], r"\."), lambda p: F.coalesce(p.try_cast("int") <= 255, F.lit(False))),
        "card": lambda m: F.length(_digits(m["s"])).between(16, 19) & luhn(_digits(m["s"])),
        "phone": lambda m: F.length(_digits(m["s"])).between(8, 15),
    }
    return {k: F.filter(located(text, PATTERNS[k], _GUARD.get(k)), fits[k]) for k in BASE}


def _features(m: Column) -> list[Column]:
    s, d, before = m["s"], _digits(m["s"]), F.lower(m["before"])
    flag = lambda c: F.coalesce(c.cast("int"), F.lit(0))
    out = {
        "digits": F.length(d),
        "separators": F.length(F.regexp_replace(s, r"[A-Za-z0-9]", "")),
        "brackets": flag(s.rlike(r"[(\[{]")),
        "spaces": F.length(F.regexp_replace(s, r"[^\x20]", "")),
        "phone_groups": flag(s.rlike(r"^(?:\([0-9]{2,4}\)\x20?|[0-9]{3}[.\x20-])[0-9]{3}[.\x20-][0-9]{4}$|^0[0-9]{1,4}[\x20/-][0-9]{3,4}[\x20-]?[0-9]{3,4}$")),
        "id_groups": flag(s.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$")),
        "luhn": flag(luhn(d)),
        "mod97": flag(F.when(s.rlike("^[A-Z]{2}[0-9]{2}"), _mod97(s))),
        "marked_at": flag(s.rlike(r"[(\[{]at[)\]}]")),
        "known_end": flag(s.rlike(r"(?i)(?:\.|dot\x20?|dot[)\]}]\x20?)(?:com|org|net|edu|gov|info|io|de|fr|es|uk|eu)$")),
    }
    return [out[f].cast("int").alias(f) if f in out else flag(before.rlike(CONTEXT[f])).alias(f) for f in FEATURES]


def proposals(text: Column) -> Column:
    """All candidates with their features: array of kind, start, end, and one field for each feature."""

    def of(n: int, kind: str) -> Column:
        return F.transform(located(text, PATTERNS[kind], _GUARD.get(kind)), lambda m: F.struct(F.lit(n).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), *_features(m)))

    return F.concat(*[of(n, k) for n, k in enumerate(ADDED)])


def _example(r: random.Random) -> tuple[str, list[tuple[int, int, int]]]:
    """A short text with its true spans (kind, start, end). Half of the candidates in it are not personal data."""
    word = lambda: "".join(r.choice(["er", "in", "th", "an", "on", "re", "ou", "le", "st", "de"]) for _ in range(r.randint(1, 4)))
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    cues = {k: v.split("|") for k, v in CONTEXT.items()}
    kind, true = r.randrange(3), r.random() < 0.5
    cue = word()
    if kind == 0:
        a, b, end = word(), word(), r.choice(["com", "org", "net", "de", "fr", "es"])
        if true:
            at, dot = r.choice([("(at)", "(dot)"), ("[at]", "[dot]"), (" (at) ", "."), (" [at] ", " [dot] "), (" at ", " dot ")])
            s, cue = a + at + b + dot + end, r.choice(cues["mails"]) if at == " at " or r.random() < 0.5 else word()
        else:
            s = f"{a} at {b}{r.choice(['. ', '.', ' dot '])}{word().capitalize() if r.random() < 0.7 else end}"
    elif kind == 1:
        if true:
            what = r.randrange(3)
            if what == 0:
                s = r.choice([f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"{digits(3)}.{digits(3)}.{digits(4)}", f"0{digits(2)} {digits(4)} {digits(4)}"])
                cue = r.choice(cues["calls"]) if r.random() < 0.8 else word()
            elif what == 1:
                s, cue = f"{digits(3)}-{digits(2)}-{digits(4)}", r.choice(cues["ids"]) if r.random() < 0.7 else word()
            else:
                s = digits(14)
                total = sum((2 * int(c) - 9 * (int(c) > 4)) if i % 2 == 0 else int(c) for i, c in enumerate(reversed(s)))
                s, cue = s + str(-total % 10), r.choice(cues["cards"])
        else:
            s = r.choice([digits(r.randint(7, 19)), f"{digits(4)}-{digits(2)}-{digits(2)}", f"{digits(2)}.{digits(2)}.{digits(4)}", f"{digits(1)}.{digits(2)}.{digits(4)}", f"{digits(4)} {digits(4)}", f"{digits(4)} - {digits(4)}", f"{digits(3)} {digits(3)} {digits(3)}", f"{digits(2)} {digits(1)} {digits(3)} {digits(2)}"])
            cue = r.choice(cues["codes"]) if r.random() < 0.6 else word()
    else:
        rest = digits(r.choice([12, 14, 16, 18]))
        land = r.choice(["DE", "FR", "ES", "GB", "NL"])
        if true:
            number = int("".join(str(int(c, 36)) for c in rest + land + "00"))
            s = f"{land}{98 - number % 97:02d}{rest}"
            cue = r.choice(cues["banks"]) if r.random() < 0.6 else word()
        else:
            s = f"{land}{digits(2)}{rest}"
        if r.random() < 0.5:
            s = " ".join(s[i : i + 4] for i in range(0, len(s), 4))
    lead = f"{word()} {word()} {cue}{r.choice([' ', ': ', ' is '])}"
    return lead + s + f", {word()} {word()}", [(kind, len(lead), len(lead) + len(s))] if true else []


@functools.cache
def _model(app: str, n_examples: int, seed: int) -> tuple[Boosted, tuple[float, float], tuple[float, ...]]:
    spark = SparkSession.active()
    r = random.Random(seed)
    texts = [_example(r) for _ in range(n_examples)]
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], fields("i long, text string"))
    got = rows.select("i", F.inline(proposals(F.col("text")))).collect()  # a few candidates for each of n_examples texts
    x = np.array([[g[f] for f in FEATURES] for g in got], float)
    y = np.array([int((g["kind"], g["start"], g["end"]) in texts[g["i"]][1]) for g in got])
    kind, held = np.array([g["kind"] for g in got]), np.array([g["i"] % 3 == 0 for g in got])
    model = boost(x[~held], y[~held])
    m = model.margin(x[held])
    a, b = calibrate(m, y[held])
    p = 1 / (1 + np.exp(-(a * m + b)))
    cuts = tuple(max(0.5, threshold(p[kind[held] == k], y[held][kind[held] == k], 0.99)) for k in range(len(ADDED)))
    return model, (a, b), cuts


def train(spark: SparkSession, n_examples: int = 3000, seed: int = 4) -> tuple[Boosted, tuple[float, float], tuple[float, ...]]:
    """The trees, their calibration and the thresholds by kind, learned from n_examples synthetic texts."""
    return _model(spark.sparkContext.applicationId, n_examples, seed)


def passed_sql(model: tuple) -> str:
    """SQL over the column `proposed`: the candidates whose calibrated score reaches their kind's threshold."""
    trees, (a, b), cuts = model
    margin = f"{a!r}D * ({trees.sql([f'x.{f}' for f in FEATURES])}) + {b!r}D"
    limits = "array(" + ", ".join(f"{c!r}D" for c in cuts) + ")"
    return f"filter(proposed, x -> 1 / (1 + exp(-({margin}))) >= element_at({limits}, x.kind + 1))"


def _is(kind: int) -> Callable[[Column], Column]:
    return lambda x: x["kind"] == kind


def _spans(docs: DataFrame, n_examples: int) -> DataFrame:
    """doc_id, text, and the spans of each kind by start, in a column of its name; `base` has the fixed ones."""
    model = train(docs.sparkSession, n_examples)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), body(docs).alias("text"))
    rows = rows.select("doc_id", "text", *[_plain(c).alias(k) for k, c in base_spans(F.col("text")).items()], proposals(F.col("text")).alias("proposed"))
    rows = rows.withColumn("base", F.concat(*BASE)).withColumn("passed", F.expr(passed_sql(model))).drop("proposed")
    taken = ["base"]
    for kind in FIRST:
        own = F.filter("passed", _is(ADDED.index(kind)))
        rows = rows.withColumn(kind, F.when(F.size("passed") > 0, _let(own, lambda o: clear_of(o, F.concat(*taken)))).otherwise(_no_spans()))
        taken.append(kind)
    return rows


def find(docs: DataFrame, n_examples: int = 3000) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added.

    A null text counts as empty: no spans, the digest of the empty string. A null doc_id stays null; repeated rows
    give repeated results; extra columns are ignored; an empty table gives an empty result.
    """
    rows = _spans(docs, n_examples)

    def listed(kinds: tuple[str, ...]) -> Column:
        def one(kind: str) -> Column:
            return F.transform(kind, lambda m: F.concat_ws(":", F.lit(kind), m["start"], m["end"]))

        return F.concat(*map(one, kinds))

    return rows.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(F.array_join(listed(BASE), ","), 256).alias("base_sha256"),
        F.array_join(listed(BASE + ADDED), ",").alias("spans"),
        sum((F.size(k) for k in ADDED), F.lit(0)).cast("long").alias("n_added"),
    )


def redacted(docs: DataFrame, n_examples: int = 3000) -> DataFrame:
    """doc_id and the text with every span, fixed or added, replaced by its kind in brackets. Overlapping spans merge into the first.

    A null text counts as empty. The text is cut into about as many chunks as each has spans, then each of these.
    """
    rows = _spans(docs, n_examples)

    def named(kind: str) -> Column:
        return F.transform(kind, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lit(kind).alias("kind")))

    rows = rows.select("doc_id", "text", F.array_sort(F.concat(*map(named, BASE + ADDED))).alias("spans"))
    ends = running(F.transform("spans", lambda m: m["end"]), 0, lambda x, y: F.greatest(x, y))
    rows = rows.select("doc_id", "text", "spans", ends.alias("ends"))
    at = lambda i: F.coalesce(F.get("ends", i - 1), F.lit(0))
    heads = F.filter(F.transform("spans", lambda m, i: F.struct(at(i).alias("from"), m["start"].alias("start"), m["kind"].alias("kind"))), lambda m: m["start"] >= m["from"])
    rows = rows.select("doc_id", "text", F.coalesce(F.array_max("ends"), F.lit(0)).alias("last"), heads.alias("heads"))

    def pieces(h: Column, k: Column) -> Column:
        def one(c: Column) -> Column:
            some = F.slice(h, c * k + 1, k)
            return _let(some, lambda x: _let(F.substring(F.col("text"), x[0]["from"] + 1, F.element_at(x, -1)["start"] - x[0]["from"]), lambda t: F.array_join(F.transform(x, lambda m: F.concat(F.substring(t, m["from"] - x[0]["from"] + 1, m["start"] - m["from"]), F.lit("["), m["kind"], F.lit("]"))), "")))

        return F.array_join(F.transform(F.sequence(F.lit(0), F.floor((F.size(h) - 1) / k).cast("int")), one), "")

    front = F.when(F.size("heads") > 0, _let(F.col("heads"), lambda h: pieces(h, F.ceil(F.sqrt(F.size(h))).cast("int")))).otherwise(F.lit(""))
    return rows.select("doc_id", F.concat(front, F.substring(F.col("text"), F.col("last") + 1, F.length("text"))).alias("text"))
