"""Licence scans: parts of a text compared to licence templates by the Dice coefficient over word bigrams.

A text's units are its lines, its blocks between blank lines, the whole text, and runs of two lines or more (windows) whose size
a template allows and which begin and end with a line that has a known bigram; of windows that overlap the best stays. A unit's words are runs of a-z and 0-9 after
A-Z become lower case, so punctuation, other letters and white space only separate. The coefficient of two bags of bigrams is
twice what they share over the sum of their sizes; to reach the limit t with a template of b bigrams, a unit must have between
b * t / (2 - t) and b * (2 - t) / t of them. Templates are kept in order of size, so each unit meets only those whose bounds
hold its size, and only if enough of its bigrams stand in any template.

Rules for odd rows: null and empty texts, and units of fewer than two words, match nothing; of templates with the same
coefficient the first by name is named; texts of any length are compared whole; rows are independent of one another, so
repeated rows, empty tables and further columns need no rule.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Least coefficient of a match.
LEAST = 0.8
#: Name and text of each template: notices and short licences. Fixed values.
TEMPLATES = {
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "MIT-notice": "Released under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "ISC-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "BSD-notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "GPL-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0-notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "Unlicense-notice": "This is free and unencumbered software released into the public domain.",
}

_WORDS = re.compile("[a-z0-9]+")
_BLANK = re.compile(r"\n[\x20\x09-\x0D]*\n")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLD = str.maketrans(_UPPER, _LOWER)


def folded(text: str) -> str:
    return text.lower() if text.isascii() else text.translate(_FOLD)


def words_of(text: str) -> list[str]:
    return _WORDS.findall(folded(text))


class Templates:
    """Bags of bigrams in order of size."""

    def __init__(self, texts: dict[str, str], least: float):
        bags = []
        for name in sorted(texts):
            w = words_of(texts[name])
            bags.append((len(w) - 1, name, Counter(zip(w, w[1:]))))
        bags.sort(key=lambda b: b[:2])
        self.bags, self.least, self.sizes = bags, least, [b[0] for b in bags]
        self.known = frozenset(g for b in bags for g in b[2])
        # Sizes of units that any template allows, and which share of a unit's bigrams, and how many, must be known at least; a
        # little slack, so that no bound fails by rounding.
        self.share = least / (2 - least)
        self.low, self.high = (self.sizes[0] * self.share - 1e-6, self.sizes[-1] / self.share + 1e-6) if bags else (np.inf, -np.inf)
        self.fewest = max(self.low, 1) * self.share - 1e-6

    def best(self, words: list[str]) -> tuple[float, str] | None:
        """The largest coefficient that reaches the limit, and the first template by name that has it."""
        n, t = len(words) - 1, self.least
        if n < 1:
            return None
        # A little slack, so that no bound fails by rounding; the coefficient itself decides.
        lo, hi = bisect_left(self.sizes, n * t / (2 - t) - 1e-6), bisect_right(self.sizes, n * (2 - t) / t + 1e-6)
        if lo == hi:
            return None
        shared = [g for g in zip(words, words[1:]) if g in self.known]
        if 2 * len(shared) < t * (n + self.sizes[lo]):
            return None
        bag, found = Counter(shared), None
        for size, name, other in self.bags[lo:hi]:
            dice = 2 * sum(min(c, other[g]) for g, c in bag.items() if g in other) / (n + size)
            if dice >= t and (found is None or (-dice, name) < (-found[0], found[1])):
                found = dice, name
        return found


MATCHES = "array<struct<unit: string, number: int, licence: string, dice: double>>"


def scan(text: Column, texts: dict[str, str] = TEMPLATES, least: float = LEAST) -> Column:
    """The units of each text that match: kind (line, block, text or window), number from 0 (a window's is its first line's), template and coefficient."""

    @F.pandas_udf(MATCHES)
    def run(column: pd.Series) -> pd.Series:
        templates = Templates(texts, least)
        return column.map(lambda t: unit_matches(t or "", templates))

    return run(text)


def unit_matches(text: str, templates: Templates) -> list[dict]:
    """The units that match. The words are read once; counts of known bigrams up to each word tell which units may match."""
    split = [_WORDS.findall(line) for line in folded(text).split("\n")]
    words = [w for line in split for w in line]
    hits = [g in templates.known for g in zip(words, words[1:])]
    if sum(hits) < templates.fewest:
        return []
    known = np.concatenate(([0], np.cumsum(hits, dtype=np.int64), [sum(hits)]))
    ends = np.cumsum([len(line) for line in split])
    starts = np.concatenate(([0], ends[:-1]))
    found = []
    for kind, first, last in (("line", starts, ends), ("block", *block_bounds(text, starts, ends)), ("text", starts[:1], ends[-1:])):
        n = last - first - 1
        shared = known[np.maximum(last - 1, 0)] - known[first]
        for i in np.flatnonzero((n >= np.maximum(templates.low, 1)) & (n <= templates.high) & (shared >= n * templates.share - 1e-6)).tolist():
            if best := templates.best(words[first[i] : last[i]]):
                found.append({"unit": kind, "number": i, "licence": best[1], "dice": best[0]})
    full = np.flatnonzero(ends > starts)
    return found + windows(words, known, full, starts[full], ends[full], templates, {m["number"]: m for m in found if m["unit"] == "line"})


def block_bounds(text: str, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First words and ends of the blocks between blank lines, from those of the lines."""
    first, last, line, at = [], [], 0, 0
    for gap in _BLANK.finditer(text):
        first.append(starts[line])
        line += text.count("\n", at, gap.start())
        last.append(ends[line])
        line += text.count("\n", gap.start(), gap.end())
        at = gap.end()
    return np.array([*first, starts[line]]), np.array([*last, ends[-1]])


def windows(words: list[str], known: np.ndarray, numbers: np.ndarray, starts: np.ndarray, ends: np.ndarray, templates: Templates, lines: dict[int, dict]) -> list[dict]:
    """The runs of lines that match, without overlap, best first; a run is left out if one of its lines matches as well as it.

    numbers, starts, ends: the lines with words. known: how many known bigrams begin before each word.
    """
    if len(numbers) < 2:
        return []
    share = templates.share
    # A line at an end of a run that shares nothing only lowers the coefficient.
    opens = known[ends] > known[starts]
    last = known[ends - 1] > known[np.maximum(starts - 1, 0)]
    # A run has enough known bigrams if this rises from its start to its end; so some later end must be as high as the start.
    level = known[ends - 1] - share * (ends - 1)
    later = np.append(np.maximum.accumulate(level[:0:-1])[::-1], -np.inf)
    met = []
    for s in np.flatnonzero(opens & (later >= known[starts] - share * starts - 1e-6)).tolist():
        e = np.arange(s + 1, int(np.searchsorted(ends, starts[s] + templates.high + 1, "right")))
        n = ends[e] - starts[s] - 1
        shared = known[ends[e] - 1] - known[starts[s]]
        for j in e[last[e] & (n >= templates.low) & (shared >= n * share - 1e-6)].tolist():
            best = templates.best(words[starts[s] : ends[j]])
            if best and not any(lines[i]["dice"] >= best[0] for i in numbers[s : j + 1].tolist() if i in lines):
                met.append((-best[0], s, j, best[1]))
    kept: list[tuple] = []
    for m in sorted(met):
        if all(m[2] < k[1] or k[2] < m[1] for k in kept):
            kept.append(m)
    return [{"unit": "window", "number": int(numbers[s]), "licence": name, "dice": -d} for d, s, _, name in sorted(kept, key=lambda k: k[1])]


def op2_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document its best template with the coefficient in millionths, the lines that match and all templates met."""
    found = table(spark, sf_dir, "documents").select("doc_id", scan(F.col("text")).alias("found"))
    best = F.array_min(F.transform("found", lambda m: F.struct((-F.round(m["dice"] * 1000000)).cast("long").alias("d"), m["licence"].alias("licence"))))
    return found.select(
        "doc_id", best["licence"].alias("licence"), F.coalesce(-best["d"], F.lit(0)).alias("dice_ppm"),
        F.size(F.filter("found", lambda m: m["unit"] == "line")).cast("long").alias("n_lines"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("found", lambda m: m["licence"]))), ",").alias("licences"),
    )


def queries() -> dict:
    return {"op2_licences": op2_licences}


def _oracle() -> str:
    rows = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in TEMPLATES.items())
    fold = f"translate({{}}, '{_UPPER}', '{_LOWER}')"
    return rf"""
WITH t AS (SELECT name, w, len(w) - 1 AS b FROM (SELECT name, regexp_extract_all({fold.format("body")}, '[a-z0-9]+') AS w FROM (VALUES {rows}) AS v(name, body))),
tg AS (SELECT name, g, count(*) AS c FROM (SELECT name, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM t) GROUP BY ALL),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS x FROM documents),
u AS (
  SELECT r, 'line' AS unit, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM (SELECT r, string_split(x, chr(10)) AS l FROM d)
  UNION ALL SELECT r, 'block', unnest(l), generate_subscripts(l, 1) FROM (SELECT r, string_split_regex(x, '\n[\x20\x09-\x0D]*\n') AS l FROM d)
  UNION ALL SELECT r, 'text', x, 1 FROM d),
w AS (SELECT r, unit, i, regexp_extract_all({fold.format("x")}, '[a-z0-9]+') AS w FROM u),
g AS (SELECT r, unit, i, n, g, count(*) AS c FROM (SELECT r, unit, i, len(w) - 1 AS n, unnest(list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1])) AS g FROM w WHERE len(w) > 1) GROUP BY ALL),
m AS (SELECT r, unit, i, tg.name, 2 * sum(least(g.c, tg.c)) / (n + t.b) AS dice FROM g JOIN tg USING (g) JOIN t ON t.name = tg.name GROUP BY r, unit, i, n, tg.name, t.b HAVING 2 * sum(least(g.c, tg.c)) / (n + t.b) >= {LEAST}),
o AS (SELECT r, unit, i, arg_min(name, (-dice, name)) AS name, max(dice) AS dice FROM m GROUP BY ALL),
s AS (SELECT r, arg_min(name, (-round(dice * 1000000), name)) AS licence, max(round(dice * 1000000))::BIGINT AS dice_ppm, count(*) FILTER (WHERE unit = 'line') AS n_lines, string_agg(DISTINCT name, ',' ORDER BY name) AS licences FROM o GROUP BY r)
SELECT doc_id, licence, coalesce(dice_ppm, 0)::BIGINT AS dice_ppm, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(licences, '') AS licences FROM d LEFT JOIN s USING (r)
"""


def oracle_sql() -> dict:
    return {"op2_licences": _oracle()}
