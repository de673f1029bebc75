"""Quality rules: a decision list learned by sequential covering, applied as an ordered Spark CASE expression."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import body, fields, free_names, small_batches

STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long, n_digits long"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Per-document rates that conditions may use, as SQL over the statistics.
FEATURES = {
    "words": "n_words",
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "repeated_lines": "n_dup_lines / greatest(n_lines, 1)",
    "repeated_words": "n_repeat_words / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
}
_UPPER, _DIGIT, _BLANK = re.compile("[A-Z]+"), re.compile("[0-9]+"), re.compile("[\x20\x09-\x0d]+")


def _repeated(words: list[bytes]) -> int:
    """Words in windows of five that occur twice or more."""
    windows = list(zip(words, words[1:], words[2:], words[3:], words[4:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    seen, end, total = Counter(windows), 0, 0
    for i, w in enumerate(windows):
        if seen[w] > 1:
            total += i + WINDOW - max(i, end)
            end = i + WINDOW
    return total


def measure(text: str) -> tuple[int, ...]:
    """The statistics of one whole text, in the order of STATS."""
    words = text.encode("utf-8", "surrogatepass").split()  # splits at 9-13 and 32 only, as bytes
    if not words:
        return (0,) * 8
    lines = Counter(x for x in text.split("\n") if x and not _BLANK.fullmatch(x))
    n_lines = sum(lines.values())
    return (
        len(words),
        len(text) - sum(map(text.count, " \t\n\v\f\r")),
        sum(map(text.count, SYMBOLS)),
        n_lines - len(lines),
        _repeated(words),
        n_lines,
        sum(map(len, _UPPER.findall(text))),
        sum(map(len, _DIGIT.findall(text))),
    )


@F.pandas_udf(fields(STATS))
def text_stats(text: pd.Series) -> pd.DataFrame:
    names = [x.split()[0] for x in STATS.split(", ")]
    return pd.DataFrame([measure(t) for t in text], columns=names)


def base_failed() -> str:
    return "(n_words < 10 OR 100 * n_repeat_words > 20 * n_words)"


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] > self.threshold if self.above else x[self.feature] <= self.threshold

    def sql(self) -> str:
        return f"({FEATURES[self.feature]}) {'>' if self.above else '<='} {self.threshold!r}D"


@dataclass
class DecisionList:
    """Ordered rules; the first whose conditions all hold rejects the document, else it stays."""

    rules: list[list[Condition]] = field(default_factory=list)

    def expression(self, prefix: str = "") -> Column:
        """The name of the first rule that fires, or null. prefix: of the struct that has the statistics."""
        case = None
        for k, rule in enumerate(self.rules):
            sql = " AND ".join(c.sql() for c in rule)
            if prefix:
                sql = re.sub(r"\bn_\w+|\bword_chars\b", lambda m: f"`{prefix}`.{m[0]}", sql)
            case = (case or F).when(F.expr(sql), F.lit(f"rule_{k + 1}"))
        return F.lit(None).cast("string") if case is None else case.otherwise(F.lit(None).cast("string"))

    def text(self) -> list[str]:
        return [" and ".join(f"{c.feature} {'>' if c.above else '<='} {c.threshold:.4g}" for c in r) for r in self.rules]


def _cuts(values: np.ndarray, bad: np.ndarray, most: int = 40) -> list[tuple[float, float]]:
    """Candidate thresholds with the gap they stand in: always half-way between two neighbouring values.

    Of the places between values those count where the class changes (the widest gaps first, if there are many) and
    those next to the quantiles.
    """
    order = np.argsort(values, kind="stable")
    v, b = values[order], bad[order]
    ends = np.flatnonzero(v[1:] != v[:-1])
    if not len(ends):
        return []
    least, largest = np.minimum.reduceat(b, np.append(0, ends + 1)), np.maximum.reduceat(b, np.append(0, ends + 1))
    change = ends[~((least[1:] == largest[:-1]) & (largest[1:] == least[:-1]))]
    change = change[np.argsort(v[change] - v[change + 1], kind="stable")[:most]]
    near = ends[np.minimum(np.searchsorted(ends, np.linspace(0.05, 0.95, 19) * len(v)), len(ends) - 1)]
    return [(float((v[k] + v[k + 1]) / 2), float(v[k + 1] - v[k])) for k in np.unique(np.append(change, near))]


def learn(x: dict[str, np.ndarray], bad: np.ndarray, least_precision: float = 0.95, longest: int = 3, most_rules: int = 12) -> DecisionList:
    """Sequential covering: grow a conjunction by FOIL gain, prune it on held-out rows, keep it if it is precise, go on with what it leaves.

    bad: True for rows to reject. A rule stays only if its precision (with one pseudo-count for each class, on all
    rows it meets) reaches least_precision, so clean documents stay. Rows that an imprecise rule meets grow no other
    one. Among conditions of equal gain the one in the widest gap between values, relative to their range, counts.
    """
    n = len(bad)
    out, left, held, fresh = DecisionList(), np.ones(n, bool), np.arange(n) % 3 == 2, np.ones(n, bool)
    width = {f: float(v.max() - v.min()) or 1.0 for f, v in x.items()} if n else {}
    for _ in range(4 * most_rules):
        grow, prune = left & fresh & ~held, left & held
        if len(out.rules) == most_rules or (grow & bad).sum() < 3:
            break
        rule: list[Condition] = []
        covered = grow.copy()
        while len(rule) < longest and (covered & ~bad).any():
            p0, n0 = (covered & bad).sum(), (covered & ~bad).sum()
            best, gain, room = None, 1e-9, 0.0
            for f, v in x.items():
                for cut, gap in _cuts(v[covered], bad[covered]):
                    for above in (True, False):
                        c = Condition(f, above, cut)
                        hit = covered & c.holds(x)
                        p, q = (hit & bad).sum(), (hit & ~bad).sum()
                        g = p * (np.log2(p / (p + q)) - np.log2(p0 / (p0 + n0))) if p else 0
                        if g > gain + 1e-9 or g > gain - 1e-9 and gap / width[f] > room and best:
                            best, gain, room = c, max(g, gain), gap / width[f]
            if best is None:
                break
            rule.append(best)
            covered &= best.holds(x)

        def value(r: list[Condition], rows: np.ndarray = prune) -> float:
            hit = rows.copy()
            for c in r:
                hit &= c.holds(x)
            p, q = (hit & bad).sum(), (hit & ~bad).sum()
            return (p - q) / (p + q) if p + q else -1.0

        while len(rule) > 1 and value(rule[:-1]) >= value(rule):
            rule.pop()
        hit = left.copy()
        for c in rule:
            hit &= c.holds(x)
        p, q = (hit & bad).sum(), (hit & ~bad).sum()
        if not rule:
            break
        if p and ((p + 1) / (p + q + 2) >= least_precision or q == 0 and p >= 5):
            out.rules.append(rule)
            left &= ~hit
        else:
            fresh &= ~(hit & bad)
            if not (hit & bad & grow).any():
                break
    return out


def fit(docs: DataFrame, labels: DataFrame, most_labels: int = 20_000) -> DecisionList:
    """A list learned on at most most_labels labelled documents, chosen by a hash of their identifier.

    Labels without identifier or quality are left out; of documents with one identifier the one with the least
    statistics counts. Without labels of both classes (or any documents) the list is empty.
    """
    small_batches(docs.sparkSession)
    label = (
        labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["quality"].cast("int").alias("quality"))
        .dropna()
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most_labels)
    )
    # at most most_labels rows of two integers: safe to broadcast
    some = docs.select(docs["doc_id"].cast("long").alias("doc_id"), body(docs).alias("t")).join(F.broadcast(label), "doc_id")
    rows = some.select("doc_id", "quality", text_stats("t").alias("s")).select("doc_id", "quality", "s.*").filter(f"NOT {base_failed()}")
    one = F.struct("quality", *[F.expr(f"double({sql})").alias(f) for f, sql in FEATURES.items()])
    got = rows.groupBy("doc_id").agg(F.min(one).alias("one")).select("doc_id", "one.*").toPandas()  # at most most_labels rows
    got = got.sort_values("doc_id", kind="stable")
    bad = (got["quality"] == 0).to_numpy()
    if not bad.any() or bad.all():
        return DecisionList()
    return learn({f: got[f].to_numpy() for f in FEATURES}, bad)


def score(docs: DataFrame, rules: DecisionList) -> DataFrame:
    """One row per document: doc_id, the statistics, base_failed, rule (that fired, or null), kept.

    A null text has no words, so it fails the base rule. A null doc_id stays null. Extra columns are ignored.
    """
    small_batches(docs.sparkSession)
    s = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_stats(body(docs)).alias("s")).select("doc_id", "s.*")
    return s.withColumn("base_failed", F.expr(base_failed())).withColumn("rule", rules.expression()).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that stay, with their own columns. Null and empty texts go; repeated rows stay or go together; an empty table stays empty."""
    rules = fit(docs, labels)
    (s,) = free_names(docs, "stats")
    failed = re.sub(r"\bn_\w+", lambda m: f"`{s}`.{m[0]}", base_failed())
    return docs.withColumn(s, text_stats(body(docs))).filter(~F.expr(failed) & rules.expression(s).isNull()).select(*docs.columns)
