"""Licence scan: normalised segments and word windows against licence templates by the Dice coefficient over bigrams.

Segments are a text's lines, its paragraphs of several lines, and the whole text. Bigrams are counted as often as
they occur, on both sides, so n words have n - 1 bigrams, and an exact copy has a coefficient of 1; dice = 2 * shared
/ (both sizes), and only templates whose size lies within t / (2 - t) and (2 - t) / t times the segment's can reach
the threshold t. Notices that stand within longer lines or paragraphs, or run over comment signs, are found by
windows over the words of the whole text: of every length that can reach the threshold, from each place where one
of the template's bigrams is to each later one (windows that begin or end elsewhere have a lower coefficient).
Of windows that overlap the best counts, and none counts where a segment is already a hit of the same template.
A hit shares at least t / (2 - t) of a template's bigrams, so a text without any of certain words has none and
is left out at once. Spark expressions only; no row leaves its partition.
"""

from __future__ import annotations

import functools
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import body

#: Name, class, text of well-known notices.
TEMPLATES = (
    ("Apache-2.0", "permissive", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "permissive", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("MIT", "permissive", "Released under the MIT License."),
    ("MIT", "permissive", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'),
    ("MIT", "permissive", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("GPL-3.0", "copyleft", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "copyleft", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "copyleft", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("MPL-2.0", "copyleft", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("BSD-3-Clause", "permissive", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "permissive", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    ("ISC", "permissive", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("CC-BY-NC-4.0", "noncommercial", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "attribution", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
)
#: Twentieths, so that the comparison is one of whole numbers.
THRESHOLD = 16


def plain(text: Column) -> Column:
    """Letters and digits of ASCII in lower case, everything else as single spaces."""
    return F.lower(F.trim(F.regexp_replace(text, "[^A-Za-z0-9]+", " ")))


def _template_words(text: str) -> list[str]:
    return "".join(c if c.isascii() and c.isalnum() else " " for c in text).lower().split()


def template_bigrams() -> list[tuple[str, str, list[str]]]:
    """Name, class and bigrams of each template, as often as they occur."""
    out = []
    for name, kind, text in TEMPLATES:
        w = _template_words(text)
        out.append((name, kind, [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]))
    return out


def repeated(bigrams: list[str]) -> dict[str, int]:
    """The bigrams that a template has twice or more, with their number."""
    return {g: n for g, n in Counter(bigrams).items() if n > 1}


def within(n: Column, size: Column) -> Column:
    """Whether a segment of n bigrams and a template of this size can reach the threshold at all."""
    t = THRESHOLD
    return ((40 - t) * n >= t * size) & ((40 - t) * size >= t * n)


def least_shared(size: int) -> int:
    """Bigrams that any hit shares with a template of this size: a segment has no fewer than it shares."""
    return -(-THRESHOLD * size // (40 - THRESHOLD))


_COMMON = {"the", "this", "that", "under", "with", "and", "can", "any", "all", "may", "you", "not", "for", "use", "by", "of", "is", "in", "to", "a", "0", "4", "2", "3", "work"}


def gate_words() -> list[str]:
    """Words one of which every hit has: for each template so many of its bigrams have one that no hit lacks them all."""
    out: set[str] = set()
    for _, _, b in template_bigrams():
        spare = len(b) - least_shared(len(b))
        left = [x for x in b if out.isdisjoint(x.split())]
        while len(b) - len(left) <= spare:
            words = {w for x in left for w in x.split()}
            best = max(words, key=lambda w: (w not in _COMMON, sum(w in x.split() for x in left) * len(w), w))
            out.add(best)
            left = [x for x in left if best not in x.split()]
    # a word that has another one of them within itself says nothing new
    return sorted(w for w in out if len(w) < 5 or not any(v != w and len(v) >= 5 and v in w for v in out))


def may_hit(text: Column) -> Column:
    low = F.lower(text)
    words = gate_words()
    found = [F.contains(low, F.lit(w)) for w in words if len(w) >= 5]
    found += [low.rlike(f"(?<![a-z0-9])(?:{'|'.join(short)})(?![a-z0-9])") for short in [[w for w in words if len(w) < 5]] if short]
    return functools.reduce(Column.__or__, found)


def _templates() -> Column:
    """The templates as one literal: number k, size, need (what a hit shares at least), reach (the longest window), distinct bigrams b, and those that occur twice or more."""

    def one(k: int, b: list[str]) -> str:
        many = repeated(b)
        twice = ", ".join(f"named_struct('g', '{g}', 'r', {r})" for g, r in many.items())
        words = ", ".join(f"'{x}'" for x in dict.fromkeys(b))
        return f"named_struct('k', {k}, 'size', {len(b)}, 'need', {least_shared(len(b))}, 'reach', {(40 - THRESHOLD) * len(b) // THRESHOLD}, 'b', array({words}), 'twice', cast(array({twice}) as array<struct<g:string,r:int>>))"

    return F.expr("array(" + ", ".join(one(k, b) for k, (_, _, b) in enumerate(template_bigrams())) + ")")


def _let(value: Column, then) -> Column:
    """then(value), with the value computed once."""
    return F.transform(F.array(value), then)[0]


def _spaces(s: Column) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))


def _bigrams(segment: Column) -> Column:
    words = F.split(segment, " ", -1)
    return F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.concat(a, F.lit(" "), b))


_HIT = "array<struct<shared:int,n:int,size:int,template:int,first:int>>"


def _hit(shared: Column, n: Column, t: Column, first: Column) -> Column:
    return F.struct(shared.cast("int").alias("shared"), n.cast("int").alias("n"), t["size"].alias("size"), t["k"].alias("template"), first.cast("int").alias("first"))


def _reached(h: Column) -> Column:
    return 40 * h["shared"] >= THRESHOLD * (h["n"] + h["size"])


def _segment_hits(parts: Column, several: bool) -> Column:
    """Hits of the parts of a text (all of them, or those of several lines); first is the word where the part begins."""
    templates = template_bigrams()
    every = sorted({x for _, _, b in templates for x in b})
    sizes = F.array(*[F.lit(x) for x in sorted({len(b) for _, _, b in templates})])

    def found(plains: Column) -> Column:
        at = F.transform(plains, lambda p, i: F.struct(p["s"].alias("s"), p["many"].alias("many"), _spaces(p["s"]).alias("n"), i.alias("i")))
        may = F.filter(at, lambda x: (x["s"] != "") & (x["many"] if several else F.lit(True)) & F.exists(sizes, lambda z: within(x["n"], z)))
        # only bigrams of some template count
        counted = F.transform(may, lambda x: F.struct(x["n"].alias("n"), x["i"].alias("i"), F.filter(_bigrams(x["s"]), lambda g: g.isin(*every)).alias("b")))
        counted = F.filter(counted, lambda x: 40 * F.size(x["b"]) >= THRESHOLD * x["n"])

        def shared(x: Column, t: Column) -> Column:
            more = F.transform(t["twice"], lambda w: F.greatest(F.lit(0), F.least(F.size(F.filter(x["b"], lambda y: y == w["g"])), w["r"]) - 1))
            return F.size(F.array_intersect(x["b"], t["b"])) + F.aggregate(more, F.lit(0), lambda u, v: u + v)

        def compare(x: Column) -> Column:
            fit = F.filter(_templates(), lambda t: within(x["n"], t["size"]))
            return F.filter(F.transform(fit, lambda t: _hit(shared(x, t), x["n"], t, x["i"])), _reached)

        words = lambda p: F.when(p["s"] == "", 0).otherwise(_spaces(p["s"]) + 1)
        before = lambda h: F.aggregate(F.slice(plains, 1, h["first"]), F.lit(0), lambda t, p: t + words(p))
        return F.transform(F.flatten(F.transform(counted, compare)), lambda h: h.withField("first", before(h)))

    return _let(F.transform(parts, lambda p: F.struct(plain(p).alias("s"), F.contains(p, F.lit("\n")).alias("many"))), found)


def _windows(marked: Column, t: Column) -> Column:
    """The best windows of a template that don't overlap, from its bigrams' places (i) and names (g) in order."""

    def best_from(last: Column, x: Column) -> Column:
        """The best window from the place x on. A bigram counts in it if it has not been there as often as in the template: its place so many times before lies before x."""
        ends = F.filter(F.slice(last, x["at"] + 1, t["reach"]), lambda e: e["i"] < x["i"] + t["reach"])
        start = F.struct(F.lit(0).alias("seen"), F.lit(0).alias("shared"), F.lit(1).alias("n"))

        def step(u: Column, e: Column) -> Column:
            seen, n = u["seen"] + F.when(e["last"] < x["i"], 1).otherwise(0), e["i"] - x["i"] + 1
            better = seen * (u["n"] + t["size"]) > u["shared"] * (n + t["size"])
            return F.struct(seen.alias("seen"), F.when(better, seen).otherwise(u["shared"]).alias("shared"), F.when(better, n).otherwise(u["n"]).alias("n"))

        return F.aggregate(ends, start, step, lambda u: _hit(u["shared"], u["n"], t, x["i"]))

    def search(p: Column) -> Column:
        def same(x: Column, at: Column) -> Column:
            earlier = F.slice(p, F.greatest(F.lit(1), at - t["reach"] + 1), F.least(at, t["reach"]))
            times = F.coalesce(F.get(F.filter(t["twice"], lambda w: w["g"] == x["g"]), F.lit(0))["r"], F.lit(1))
            return _let(F.filter(earlier, lambda e: e["g"] == x["g"]), lambda e: F.coalesce(F.get(e, F.size(e) - times)["i"], F.lit(-1)))

        return _let(F.transform(p, lambda x, at: F.struct(x["i"].alias("i"), at.alias("at"), same(x, at).alias("last"))), apart)

    def apart(last: Column) -> Column:
        dense = F.filter(last, lambda x: F.coalesce(F.get(last, x["at"] + t["need"] - 1)["i"] - x["i"] < t["reach"], F.lit(False)))
        good = F.filter(F.transform(dense, lambda x: best_from(last, x)), _reached)

        def step(u: Column, h: Column) -> Column:
            end = F.element_at(u, -1)
            clear = (F.size(u) == 0) | (h["first"] >= end["first"] + end["n"])
            better = h["shared"] * (end["n"] + t["size"]) > end["shared"] * (h["n"] + t["size"])
            return F.when(clear, F.concat(u, F.array(h))).when(better, F.concat(F.slice(u, 1, F.size(u) - 1), F.array(h))).otherwise(u)

        return _let(good, lambda g: F.when(F.size(g) == 0, F.array().cast(_HIT)).otherwise(F.aggregate(g, F.array().cast(_HIT), step)))

    return search(marked)


def _window_hits(text: Column) -> Column:
    every = sorted({x for _, _, b in template_bigrams() for x in b})
    placed = F.transform(_bigrams(plain(text)), lambda g, i: F.struct(g.alias("g"), i.alias("i")))

    def each(marked: Column) -> Column:
        names = F.array_distinct(F.transform(marked, lambda x: x["g"]))
        spare = lambda t: F.aggregate(t["twice"], F.lit(0), lambda u, w: u + w["r"] - 1)
        some = _let(names, lambda d: F.filter(_templates(), lambda t: F.size(F.array_intersect(d, t["b"])) >= t["need"] - spare(t)))
        return F.flatten(F.transform(some, lambda t: _let(F.filter(marked, lambda x: F.array_contains(t["b"], x["g"])), lambda p: _windows(p, t))))

    return _let(F.filter(placed, lambda x: x["g"].isin(*every)), each)


def hits(text: Column) -> Column:
    """Array of (shared, n, size, template, first) of the segments, then of the windows, that reach the threshold."""
    lines = _segment_hits(F.split(text, r"\n", -1), False)
    many = _segment_hits(F.split(text, r"\n[\x20\x09\x0B-\x0D]*\n", -1), True)
    whole = F.when(text.rlike(r"\n[\x20\x09\x0B-\x0D]*\n"), _segment_hits(F.array(text), False)).otherwise(F.array().cast(_HIT))
    meets = lambda a, b: (a["template"] == b["template"]) & (a["first"] < b["first"] + b["n"]) & (b["first"] < a["first"] + a["n"])
    both = _let(F.concat(lines, many, whole), lambda found: F.concat(found, F.filter(_window_hits(text), lambda h: ~F.exists(found, lambda g: meets(h, g)))))
    return F.when(may_hit(text), both).otherwise(F.array().cast(_HIT))


def license_scan(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_hits, license, license_class, dice of the best hit (ties: the first template).

    A null or empty text has no segments: n_hits 0, the others null. A null doc_id stays null; repeated rows give
    repeated results; extra columns are ignored; an empty table gives an empty result.
    """
    templates = template_bigrams()
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), hits(body(docs)).alias("h"))
    scored = F.transform("h", lambda h: F.struct((2.0 * h["shared"] / (h["n"] + h["size"])).alias("dice"), (-h["template"]).alias("back")))
    rows = rows.select("doc_id", F.size("h").cast("long").alias("n_hits"), F.array_max(scored).alias("best"))
    pick = lambda i: F.when(F.col("n_hits") > 0, F.element_at(F.array(*[F.lit(t[i]) for t in templates]), 1 - F.col("best.back")))
    return rows.select("doc_id", "n_hits", pick(0).alias("license"), pick(1).alias("license_class"), F.col("best.dice").alias("dice"))


def oracle() -> str:
    templates = template_bigrams()
    quoted = lambda b: "[" + ", ".join("'" + x + "'" for x in dict.fromkeys(b)) + "]"
    more = lambda b: "[" + ", ".join(f"{{'g': '{g}', 'r': {r}}}" for g, r in (repeated(b) or {"": 1}).items()) + "]"
    values = ", ".join(f"({k}, '{n}', '{c}', {len(b)}, {quoted(b)}, {more(b)})" for k, (n, c, b) in enumerate(templates))
    t = THRESHOLD
    return rf"""
        WITH template(k, license, license_class, size, bigrams, more) AS (VALUES {values}),
        doc AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
        raw AS (
            SELECT row, unnest(string_split(text, chr(10))) AS s FROM doc
            UNION ALL SELECT * FROM (SELECT row, unnest(regexp_split_to_array(text, '\n[\x20\x09\x0B-\x0D]*\n')) AS s FROM doc) WHERE contains(s, chr(10))
            UNION ALL SELECT row, text FROM doc WHERE regexp_matches(text, '\n[\x20\x09\x0B-\x0D]*\n')),
        words AS (SELECT row, string_split(lower(trim(regexp_replace(s, '[^A-Za-z0-9]+', ' ', 'g'))), ' ') AS w FROM raw),
        seg AS (SELECT row, len(w) - 1 AS n, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS b FROM words WHERE len(w) > 1),
        hit AS (
            SELECT row, k, license, license_class, n, size,
                   len(list_intersect(b, bigrams)) + list_sum(list_transform(more, lambda x: greatest(0, least(len(list_filter(b, lambda y: y = x.g)), x.r) - 1))) AS shared
            FROM seg JOIN template ON {40 - t} * n >= {t} * size AND {40 - t} * size >= {t} * n),
        good AS (
            SELECT *, 2.0::DOUBLE * shared / (n + size) AS dice, count(*) OVER (PARTITION BY row) AS n_hits,
                   row_number() OVER (PARTITION BY row ORDER BY 2.0::DOUBLE * shared / (n + size) DESC, k) AS r
            FROM hit WHERE 40 * shared >= {t} * (n + size))
        SELECT doc_id, coalesce(n_hits, 0) AS n_hits, license, license_class, dice
        FROM doc LEFT JOIN (SELECT * FROM good WHERE r = 1) USING (row)
    """
