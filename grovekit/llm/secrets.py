"""Secret scan: assignment-aware lexing of source and configuration syntax.

Besides the three fixed patterns, the scan reads a whole text as source or configuration: it splits it into names,
string literals, bare values, signs, brackets and line ends, builds name-literal pairs, carries constants from one
statement to later ones (also through concatenation), and scores each literal by how sensitive the name is that it
reaches and by how much the literal looks like a key. A target may be a name, a string or a subscript, with or
without a type; a value may stand in brackets, on the next line, behind a comment, as a default or an argument in a call, as either
side of a choice, in several assignments at once, under nested keys (by braces or by indentation), or as the text of
an XML element. A text without any part of a sensitive name has no such pair and isn't split.

A constant keeps what its score needs (length, classes and counts of characters) and links to its operands, so the time is
in proportion to the text, however long the chain of constants.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import body, fields, small_batches

KINDS = ("assign", "access", "hex", "literal")
SCHEMA = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_literal long"


def _any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_WORDS = "|".join([_any_case(w) for w in ("password", "passwd", "secret", "token")] + ["[Aa][Pp][Ii]_?[Kk][Ee][Yy]"])
_ASSIGN = re.compile(rf"({_WORDS})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
# runs below the least length can't be matched by any later start within them, so the length stands in the pattern
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")

_STRINGS = {'"': r'"(?:\\.|[^"\\\n])*+(?P<no_double>")?+', "'": r"'(?:\\.|[^'\\\n])*+(?P<no_single>')?+", "`": r"`[^`\n]*+(?P<no_back>`)?+"}


@functools.cache
def _token(quotes: str) -> re.Pattern:
    """One token; strings only in the given quotes, and those that no quote ends reach to the end of the line."""
    strings = "|".join(_STRINGS[q] for q in quotes) or "(?!)"
    triple = "|".join(rf"{3 * q}(?:[^{q}\\]|\\.|{q}(?!{q}{q}))*+{3 * q}" for q in "\"'") if len(quotes) == 3 else "(?!)"
    return re.compile(rf"""(?P<long>{triple})|(?P<nl>\n[^\S\n]*)|(?P<str>{strings})|(?P<name>[A-Za-z_$][A-Za-z0-9_$.-]*)|(?P<sign>:=|=>|==|!=|<=|>=|[=:+])|(?P<space>[^\S\n]+)|(?P<sigil>[*@]+(?=[A-Za-z_])|--(?=[A-Za-z]))|(?P<bare>[^\s"'`=:+,;(){{}}\[\]<>#]+)|(?P<other>.)""", re.S)


def tokens(text: str, start: int = 0, end: int | None = None, quotes: str = "\"'`") -> Iterator[tuple[str, int, int]]:
    """Kind, start and end of each token but spaces.

    Behind a quote that nothing ends on its line, no other quote of that kind on the line is ended either (all stand
    behind a backslash), so the rest of the line is read again without that kind; no character is read more than
    four times.
    """
    for m in _token(quotes).finditer(text, start, len(text) if end is None else end):
        if m["long"] is not None:
            yield "str", m.start(), m.end()
        elif m["str"] is not None and (m.end() - m.start() < 2 or not any(m.groupdict().get(x) for x in ("no_double", "no_single", "no_back"))):
            yield "other", m.start(), m.start() + 1
            yield from tokens(text, m.start() + 1, m.end(), quotes.replace(text[m.start()], ""))
        elif m["space"] is None:
            yield next((k for k in ("nl", "str", "name", "sign", "bare") if m[k] is not None), "other"), m.start(), m.end()


_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
#: Weights of name parts.
SENSITIVE = {"password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "secret": 1.0, "token": 1.0, "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "private": 0.5, "access": 0.4, "auth": 0.6, "bearer": 0.8, "key": 0.5, "pass": 0.7, "signature": 0.5, "salt": 0.6, "api": 0.4}
HARMLESS = {"public": -0.6, "name": -0.5, "id": -0.3, "count": -0.8, "length": -0.8, "size": -0.8, "type": -0.5, "url": -0.4, "path": -0.5, "file": -0.5, "max": -0.6, "min": -0.6, "field": -0.6, "label": -0.6, "hint": -0.6}
_DUMMY = re.compile(r"(?i)x{4,}|\*{3,}|changeme|example|placeholder|your|dummy|todo|none|null|true|false|\$\{|\{\{|<")
_REACH = 16  # no dummy word is longer
_SETTER = re.compile(r"(?:.*[.$-])?(?:set|with|use|put|add)(?=[A-Z_])")
_CHOICES = ("?", "if", "or", "and", "||", "&&", "??", "?:")
LEAST_SCORE = 0.5
#: Each sensitive name part has one of these within it.
_HINTS = ("pass", "pwd", "secret", "token", "key", "credential", "private", "access", "auth", "bearer", "signature", "salt", "api")
_XML = re.compile(r"<([A-Za-z_][\w.:-]*)(?:\s[^<>]*)?>\s*([^<>\s]+)\s*</\1\s*>")
_ATTRIBUTES = re.compile(r"""\b(?:key|name)\s*=\s*(["'])([^"'<>]+)\1\s+value\s*=\s*(["'])([^"'<>]+)\3""")
_SIGNS = ("=", ":", ":=", "=>")
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}


def name_sum(name: str) -> float:
    return sum(SENSITIVE.get(p, 0) + HARMLESS.get(p, 0) for p in map(str.lower, _PART.findall(name)))


class Value:
    """A literal, or literals joined: what the score of the whole text needs, and where it comes from."""

    __slots__ = ("alnum", "classes", "counts", "dummy", "head", "n", "parts", "place", "space", "tail")

    def __init__(self, text: str, place: tuple[int, int] | None = None):
        self.n, self.place, self.parts = len(text), place, ()
        self.space, self.dummy = any(map(str.isspace, text)), _DUMMY.search(text) is not None
        self.classes = tuple(any(map(f, text)) for f in (str.islower, str.isupper, str.isdigit))
        self.alnum = all(map(str.isalnum, text))
        self.counts = Counter(ord(c) & 255 for c in text)  # at most 256 kinds, so that joining takes no longer for long values
        self.head, self.tail = text[:_REACH], text[-_REACH:]

    @classmethod
    def joined(cls, parts: list[Value]) -> Value:
        if len(parts) == 1:
            return parts[0]
        out = cls("")
        for p in parts:
            out.n, out.space = out.n + p.n, out.space or p.space
            out.dummy = out.dummy or p.dummy or _DUMMY.search(out.tail + p.head) is not None
            out.classes = tuple(a or b for a, b in zip(out.classes, p.classes, strict=True))
            out.alnum = out.alnum and p.alnum
            out.counts.update(p.counts)
            out.head, out.tail = (out.head + p.head)[:_REACH], (out.tail + p.tail)[-_REACH:]
        out.parts = tuple(parts)
        return out

    def score(self) -> float:
        """0 for short, spaced or dummy values; rises with entropy and mixed classes of characters."""
        if self.n < 8 or self.space or self.dummy:
            return 0.0
        bits = -sum(k / self.n * math.log2(k / self.n) for k in self.counts.values())
        return min(1.0, bits / 4) * (1.0 if sum(self.classes) + (not self.alnum) >= 2 else 0.4)


class _Reader:
    """The tokens of a text and the name-literal pairs they make."""

    def __init__(self, text: str):
        self.text = text
        self.t = list(tokens(text))
        self.known: dict[str, Value] = {}
        self.values: dict[int, Value] = {}  # of the literals, by token
        self.line_end, self.comment_end = [0] * len(self.t), [-1] * len(self.t)  # for each token the next line end, and the next end of a comment
        line, comment = len(self.t), -1
        for i in range(len(self.t) - 1, -1, -1):
            kind, a, b = self.t[i]
            line = i if kind == "nl" else line
            comment = i if kind == "bare" and text.endswith("*/", a, b) else comment
            self.line_end[i], self.comment_end[i] = line, comment
        self.closed: dict[int, int] = {}  # opening brackets, with the closing ones
        opened = []
        for i, (kind, a, b) in enumerate(self.t):
            if kind == "other" and text[a:b] in _OPEN:
                opened.append(i)
            elif kind == "other" and text[a:b] in _CLOSE and opened:
                self.closed[opened.pop()] = i

    def kind(self, i: int) -> str | None:
        return self.t[i][0] if 0 <= i < len(self.t) else None

    def word(self, i: int) -> str:
        return self.text[self.t[i][1] : self.t[i][2]] if 0 <= i < len(self.t) else ""

    def bare_name(self, i: int) -> str:
        return self.word(i).strip("\"'`")

    def sign(self, i: int) -> bool:
        return self.kind(i) == "sign" and self.word(i) in _SIGNS

    def skip_lines(self, i: int) -> int:
        while self.kind(i) == "nl":
            i += 1
        return i

    def indent(self, i: int) -> int:
        """White space before the line of token i."""
        while i >= 0 and self.kind(i) != "nl":
            i -= 1
        return len(self.word(i)) - 1 if i >= 0 else 0

    def target(self, i: int) -> str | None:
        """The name that the sign at i gives a value to."""
        at = i - 1
        if self.word(at) == "]":
            key, at = at - 1, at - 2
            if self.word(key) == "[":  # an array without a size
                return self.bare_name(key - 1) if self.kind(key - 1) == "name" else None
            if self.word(at) == "[" and self.kind(key) == "str":
                return self.bare_name(key)
            return self.bare_name(at - 1) if self.word(at) == "[" and self.kind(at - 1) == "name" else None
        if self.kind(at) not in ("name", "str"):
            return None
        if self.word(i) == "=" and self.kind(at - 1) == "name" and self.word(at - 2) in ("var", "const", "let"):
            return self.bare_name(at - 1)  # the type follows the name
        return self.bare_name(at)

    def after_type(self, i: int) -> int | None:
        """Where a colon at i begins a type, the place of the assignment sign behind it."""
        j, names = i + 1, 0
        while j < len(self.t):
            kind, word = self.kind(j), self.word(j)
            if self.sign(j) and word == "=":
                return j if names else None
            if kind in ("nl", "sign", "str") or word in ("{", "}", ";", ")"):
                return None
            # two names side by side are no type, but for a lifetime or a mutability
            if kind == "name" and self.kind(j - 1) == "name" and self.word(j - 2) != "'" and self.word(j - 1) not in ("mut", "const", "readonly", "unsigned"):
                return None
            names, j = names + (kind == "name"), j + 1
        return None

    def call_defaults(self, i: int) -> list[tuple[str | None, int]]:
        """The literals behind a first argument in the call whose bracket is at i and in calls within it, each with the literal that names it.

        A call within it that has a target of its own is read with that target, so each token is read once.
        """
        calls, out, j = [], [], i
        while j < len(self.t):
            word = self.word(j)
            if word in _OPEN:
                if calls and self.sign(j - 2):
                    if j not in self.closed:
                        break
                    j = self.closed[j]
                else:
                    calls.append([False, None])
            elif word in _CLOSE:
                calls.pop()
                if not calls:
                    break
            elif word == ",":
                calls[-1][0] = True
            elif self.kind(j) == "str":
                if calls[-1][0]:
                    out.append((calls[-1][1], j))
                else:
                    calls[-1][1] = self.bare_name(j)
            j += 1
        return out

    def literal(self, j: int) -> Value:
        """The literal at a token, without its quotes."""
        if j not in self.values:
            a, b = self.t[j][1:]
            q = 3 if b - a >= 6 and self.text[a : a + 3] in ('"' * 3, "'" * 3) else 1
            self.values[j] = Value(self.text[a + q : b - q], (a + q, b - q))
        return self.values[j]

    def piece(self, j: int, one_line: bool) -> tuple[Value, int] | None:
        """Value and end of one operand."""
        kind, a, b = self.t[j]
        if kind == "str":
            return self.literal(j), j + 1
        if kind == "name" and self.text[a:b] in self.known:
            return self.known[self.text[a:b]], j + 1
        if kind == "name" and self.kind(j + 1) == "str" and self.t[j + 1][1] == b and b - a <= 2:
            return self.piece(j + 1, one_line)  # a prefixed string
        if kind in ("name", "bare") and one_line:
            while j + 1 < len(self.t) and self.t[j + 1][0] in ("name", "bare", "sign") and self.t[j + 1][1] == b:
                j, b = j + 1, self.t[j + 1][2]  # a bare value as in a shell or configuration line
            if self.word(j + 1) in ("[", "(") and self.t[j + 1][1] == b:
                return None  # an expression
            return Value(self.text[a:b], (a, b)), j + 1
        return None

    def joined(self, j: int, inside: bool) -> tuple[Value | None, int]:
        """Operands joined by plus signs, or strings side by side (on one line, or within brackets). An operand that comes again adds nothing."""
        values: list[Value] = []
        seen: set[int] = set()
        while j < len(self.t):
            found = self.piece(j, not inside)
            if not found:
                break
            text_next = self.kind(j) == "str"
            piece, j = found
            if id(piece) not in seen:
                seen.add(id(piece))
                values.append(piece)
            k = self.skip_lines(j)
            if self.word(k) == "+" and self.kind(self.skip_lines(k + 1)) in ("str", "name", "bare"):
                j = self.skip_lines(k + 1)
            elif self.kind(k) == "str" and (inside or text_next and k == j and not self.sign(k + 1)):
                j = k
            else:
                break
        return Value.joined(values) if values else None, j

    def choices(self, j: int) -> list[Value]:
        """The literals on the rest of a line behind a sign of choice, up to its end or the end of what holds it."""
        out, depth = [], 0
        if self.word(j) in _CHOICES:
            for k in range(j + 1, self.line_end[j]):
                word = self.word(k)
                depth += (word in _OPEN) - (word in _CLOSE)
                if depth < 0 or not depth and word in (";", ","):
                    break
                if self.kind(k) == "str" and not depth:
                    out.append(self.literal(k))
        return out

    def several(self, i: int, owners: list) -> list[str]:
        """The names that an equals sign at i gives values to, if they are more than one and begin a line outside brackets."""
        if self.word(i) != "=" or owners and owners[-1][0] in _OPEN:
            return []
        at, names = i - 1, []
        while self.kind(at) == "name":
            names.append(self.bare_name(at))
            if self.word(at - 1) != ",":
                return names[::-1] if len(names) > 1 and self.kind(at - 1) in (None, "nl") else []
            at -= 2
        return []

    def behind(self, j: int, at: int) -> int:
        """Where the value begins behind comments, and behind an anchor or a tag."""
        while True:
            word = self.word(j)
            if word.startswith("/*") and self.comment_end[j] >= 0 and self.comment_end[j] < self.line_end[j]:
                j = self.comment_end[j] + 1
            elif (word.startswith("//") or word == "#") and self.t[j][1] > self.t[j - 1][2] and self.line_end[j] < len(self.t):
                return self.line_end[j]
            elif self.word(at) == ":" and self.kind(j) == "bare" and word[:1] in "&!" and len(word) > 1:
                j += 1
            else:
                return j

    def called(self, i: int) -> Iterator[tuple[tuple[str, ...], Value]]:
        """The literals that the call whose bracket is at i gives to what it names: by a first literal, or by a setter's own name."""
        for first, k in self.call_defaults(i):
            if first:
                yield (first,), self.literal(k)
        if self.kind(i + 1) == "str" and self.word(i + 2) in (")", ",") and _SETTER.match(self.word(i - 1)):
            yield (self.bare_name(i - 1),), self.literal(i + 1)

    def pairs(self) -> Iterator[tuple[tuple[str, ...], Value]]:
        """Names (of what holds the target, and the target's own) and values."""
        read = 0  # brackets of calls before this place are read
        owners: list[tuple[str, str, int]] = []  # bracket or indentation, name, indentation
        given: dict[int, str] = {}  # the opening brackets of values, with their names
        last, i = -1, 0
        while i < len(self.t):
            word = self.word(i)
            if self.kind(i) == "nl" and owners and self.kind(i + 1) != "nl":
                while owners and owners[-1][0] == "line" and len(word) - 1 <= owners[-1][2]:
                    owners.pop()
            elif word in _OPEN:
                if word == "(" and i >= read and self.kind(i - 1) == "name" and self.t[i - 1][2] == self.t[i][1]:
                    yield from self.called(i)
                    read = self.closed.get(i, len(self.t))
                owners.append((word, given.pop(i, ""), 0))
            elif word in _CLOSE:
                while owners and owners[-1][0] == "line":
                    owners.pop()
                if owners:
                    owners.pop()
            elif self.kind(i) == "str" and owners and owners[-1][0] == "[" and owners[-1][1] and not self.sign(i + 1) and i >= last:
                value, last = self.joined(i, True)
                yield (owners[-1][1],), value
            elif (word == "define" and self.word(i - 1) == "#" or word in ("ENV", "ARG") and self.kind(i - 1) in (None, "nl")) and self.kind(i + 1) == "name" and i + 2 < self.line_end[i] and not self.sign(i + 2):
                value, last = self.joined(i + 2, False)
                if value:
                    self.known[self.word(i + 1)] = value
                    yield (self.word(i + 1),), value
            elif self.sign(i) and i >= last and (names := self.several(i, owners)):
                j = i + 1
                for name in names:
                    value, end = self.joined(j, False)
                    if not value:
                        break
                    self.known[name] = value
                    yield (name,), value
                    last = end
                    if self.word(end) != ",":
                        break
                    j = end + 1
            elif self.sign(i) and i >= last and (name := self.target(i)):
                at = i
                if word == ":" and (typed := self.after_type(i)):
                    at = typed
                outer = tuple(n for _, n, _ in owners[-3:] if n)
                full = (*outer, name)
                j = self.behind(at + 1, at)
                if self.word(at) == ":" and self.word(j) in ("|", ">", "|-", ">-", "|+", ">+") and self.kind(self.skip_lines(j + 1)) and self.kind(j + 1) == "nl":
                    j += 1
                if self.word(j) == "\\":
                    j += 1
                line = self.kind(j) == "nl"
                if line:
                    j = self.skip_lines(j)
                    if self.word(j) == "-":
                        j += 1
                    deeper = self.indent(j) > self.indent(i)
                    if self.word(j) not in _OPEN and (self.sign(j + 1) or not deeper and self.kind(j) != "str"):
                        if deeper and self.word(at) == ":":
                            owners.append(("line", name, self.indent(i)))
                        i += 1
                        continue
                if self.word(j) == "(":
                    value, end = self.joined(self.skip_lines(j + 1), True)
                elif self.word(j) in _OPEN:
                    given[j] = name
                    i = max(i + 1, at)
                    last = max(last, at + 1)
                    continue
                elif self.kind(j) == "name" and self.word(j + 1) == "(" and self.t[j + 1][1] == self.t[j][2]:
                    for first, k in self.call_defaults(j + 1):
                        yield full, self.literal(k)
                        if first:
                            yield (first,), self.literal(k)
                    i, last = max(i + 1, j), max(last, at + 1)
                    continue
                else:
                    value, end = self.joined(j, False)
                if value:
                    self.known[name] = value
                    yield full, value
                    if outer:
                        yield (name,), value
                    for other in self.choices(end):
                        yield (name,), other
                    last = end
                    i = max(i + 1, end)
                    if self.word(j) == "(":
                        i = j
                    continue
                last = max(last, at + 1)
            i += 1


def pairs(text: str) -> Iterator[tuple[tuple[str, ...], Value]]:
    """Names and value of every assignment of a known value."""
    yield from _Reader(text).pairs()
    for m in _XML.finditer(text):
        yield (m[1],), Value(m[2], m.span(2))
    for m in _ATTRIBUTES.finditer(text):
        yield (m[2],), Value(m[4], m.span(4))


def secret_places(text: str) -> set[tuple[int, int]]:
    """The places of all literals that make up a sensitive value. Each name is scored once, and each literal is reached once."""
    sums: dict[str, float] = {}
    line: list[Value] = []
    for names, value in pairs(text):
        for n in names:
            if n not in sums:
                sums[n] = name_sum(n)
        weight = max(0.0, min(1.0, sum(sums[n] for n in names)))
        if weight and weight * value.score() >= LEAST_SCORE:
            line.append(value)
    found, seen = set(), set()
    while line:
        v = line.pop()
        if id(v) not in seen:
            seen.add(id(v))
            line += v.parts
            if v.place and v.place[1] - v.place[0] >= 4:
                found.add(v.place)
    return found


def _disjoint(spans: Iterable[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the union of spans, in order."""
    starts: list[int] = []
    ends: list[int] = []
    for s, e in sorted(spans):
        if ends and s < ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    return starts, ends


def _meets(starts: list[int], ends: list[int], a: int, b: int) -> bool:
    k = bisect.bisect_right(ends, a)
    return k < len(starts) and starts[k] < b


def scan(text: str) -> list[tuple[str, int, int]]:
    """All spans of a text by start, then kind. The fixed patterns come first; a literal that meets one of theirs is left out."""
    base = [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    base += [(kind, m.start(), m.end()) for kind, p in (("access", _ACCESS), ("hex", _HEX)) for m in p.finditer(text)]
    low = text.lower()
    found = secret_places(text) if any(h in low for h in _HINTS) else set()
    starts, ends = _disjoint((s, e) for _, s, e in base)
    found = {(a, b) for a, b in found if not _meets(starts, ends, a, b)}
    base += [("literal", a, b) for a, b in found]
    return sorted(base, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def digest_columns(text: str) -> tuple:
    spans = scan(text)
    n = Counter(k for k, _, _ in spans)
    base = joined([x for x in spans if x[0] != "literal"])
    return n["assign"], n["access"], n["hex"], hashlib.sha256(base.encode()).hexdigest(), joined(spans), n["literal"]


@F.pandas_udf(fields(SCHEMA))
def find_secrets(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([digest_columns(t) for t in text], columns=[x.split()[0] for x in SCHEMA.split(", ")])


def secret_scan(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id and the counts, digest and spans of its secrets.

    A null text counts as empty: no spans, the digest of the empty string. A null doc_id stays null; repeated
    rows give repeated results; extra columns are ignored; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), find_secrets(body(docs)).alias("s")).select("doc_id", "s.*")
