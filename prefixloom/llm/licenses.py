"""Licence scans: runs of lines, and runs of words in long lines, compared with licence templates by the Dice coefficient of their word bigrams.

Two sizes bound the coefficient before any comparison: with ``n`` and ``m``
distinct bigrams it is at most 2 min(n, m) / (n + m), so a template is a
candidate only for runs of m t / (2 - t) to m (2 - t) / t bigrams, and only for
texts that hold m t / (2 - t) of the template's own bigrams at all.
"""

from __future__ import annotations

from heapq import heappop, heappush
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from prefixloom.llm.common import map_arrow, table, texts

THRESHOLD = 0.8

# Licence notices and short licences; whole ones are in the folder of templates.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
TEMPLATES = {
    "Apache-2.0 header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "BSD-2-Clause": f"{_BSD}\n{_BSD_END}",
    "BSD-3-Clause": f"{_BSD}\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n{_BSD_END}",
    "CC-BY-4.0 notice": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0 notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "GPL-3.0 header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": _ISC,
    "MIT": _MIT,
    "MIT notice": "Released under the MIT License.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}


def full_texts(folder: str = str(Path(__file__).parent / "templates")) -> dict[str, str]:
    """Whole licences by name, one text file each, read on the driver; what is sent to executors is bounded by the folder's size."""
    return {p.stem: p.read_text(encoding="utf-8") for p in sorted(Path(folder).glob("*.txt"))}


TEMPLATES |= full_texts()

_KEEP = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def normalised(text: str) -> list[bytes]:
    """Words of ASCII letters and digits, letters in lower case; everything else separates."""
    return text.encode("utf-8", "surrogatepass").translate(_KEEP).split()


def bigrams(words: list[bytes]) -> frozenset[tuple[bytes, bytes]]:
    return frozenset(zip(words, words[1:]))


class _Text:
    """A text's words and bigrams as arrays; bigram k is of words k and k + 1.

    ``before[k]`` is the place of the same bigram before k (-1 for none), so a
    window of words that starts at ``a`` meets k as new just if before[k] < a.
    ``floor`` has the least ``before`` of each block of places: blocks that
    repeat what a window has seen already are passed over whole.
    """

    BLOCK = 256

    def __init__(self, text: str):
        rows = [(k, w) for k, w in enumerate(map(normalised, text.split("\n"))) if w]
        self.line = np.repeat([k for k, _ in rows], [len(w) for _, w in rows])
        words = [x for _, w in rows for x in w]
        known: dict[tuple[bytes, bytes], int] = {}
        self.ids = np.array([known.setdefault(x, len(known)) for x in zip(words, words[1:])], dtype=np.int64)
        self.bigrams = list(known)
        self.n = len(self.ids)
        order = np.argsort(self.ids, kind="stable")
        same = self.ids[order[1:]] == self.ids[order[:-1]]
        self.before = np.full(-(-self.n // self.BLOCK) * self.BLOCK, self.n, dtype=np.int64)
        self.before[order] = np.concatenate([[-1], np.where(same, order[:-1], -1)])
        self.floor = self.before.reshape(-1, self.BLOCK).min(axis=1)
        first = np.flatnonzero(np.diff(self.line, prepend=-1))
        self.starts_line, self.ends_line = np.zeros(self.n + 1, bool), np.zeros(self.n + 1, bool)
        self.starts_line[first], self.ends_line[np.append(first[1:] - 1, self.n)] = True, True
        row = np.cumsum(self.starts_line) - 1
        inside = (row[:-1] == row[1:]) & (self.before[: self.n] < first[row[:-1]])
        self.sizes = np.bincount(row[:-1][inside], minlength=len(first))[row]  # distinct bigrams inside the line of each word

    def meets(self, low: int, high: int, most: float) -> tuple[np.ndarray, np.ndarray]:
        """Places from ``low`` on that a window from ``low`` or ``high`` may meet as new, up to the first at which one from ``high`` has over ``most``; and how many that one has."""
        blocks = np.flatnonzero(self.floor[low // self.BLOCK :] < high) if low < high else np.flatnonzero(self.floor[low // self.BLOCK :] < low)
        blocks += low // self.BLOCK
        take = int(most + high - low) // self.BLOCK + 2
        while True:
            at = (blocks[:take, None] * self.BLOCK + np.arange(self.BLOCK)).ravel()
            at = at[(at >= low) & (at < self.n)]
            at = at[self.before[at] < high] if low < high else at[self.before[at] < low]
            have = np.cumsum(at >= high)
            if take >= len(blocks) or (len(have) and have[-1] > most):
                return at, have
            take *= 4


class Scanner:
    """Finds, for each template, a text's best run of words."""

    def __init__(self, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD):
        self.threshold = threshold
        self.sets = {name: bigrams(normalised(t)) for name, t in sorted(templates.items())}
        self.of: dict[tuple[bytes, bytes], list[str]] = {}
        for name, s in self.sets.items():
            for b in s:
                self.of.setdefault(b, []).append(name)
        self.known = frozenset(self.of)

    def least(self, name: str) -> float:
        """Fewest bigrams, shared or in a run, that let the coefficient reach the threshold."""
        return len(self.sets[name]) * self.threshold / (2 - self.threshold) - 1e-9

    def most(self, name: str) -> float:
        return len(self.sets[name]) * (2 - self.threshold) / self.threshold + 1e-9

    def scan(self, text: str | None) -> list[tuple[str, float, int, int]]:
        """(template, coefficient, first line, last line) for each template that some run of words reaches.

        A run starts at the first word of a line and ends at the last of one.
        In a line of more distinct bigrams than the template's upper bound,
        which no run could hold whole, it may also start at a bigram that the
        template has and end at one.  Of equal coefficients the earliest and
        then shortest run counts.
        """
        words = normalised(text or "")
        shared = self.known.intersection(zip(words, words[1:]))
        if not shared:
            return []
        counts: dict[str, int] = {}
        for b in shared:
            for name in self.of[b]:
                counts[name] = counts.get(name, 0) + 1
        names = [n for n, c in sorted(counts.items()) if c >= self.least(n)]
        if not names:
            return []
        body = _Text(text)
        return [best for n in names if (best := self._best(n, body))]

    def _best(self, name: str, body: _Text) -> tuple[str, float, int, int] | None:
        """The best run for one template, by ranges of starts, best bound first.

        A run from any start of a range has no more shared bigrams than the
        one from its first start to the same end, and no fewer bigrams than
        the one from its last, nor fewer than it shares; this bounds the
        range's coefficients.  Ranges that reach the threshold are halved until
        one start is left, whose bound is its best coefficient itself, so the
        first one met is the best.
        """
        wanted, most = self.sets[name], self.most(name)
        mine = np.fromiter((b in wanted for b in body.bigrams), bool, len(body.bigrams))[body.ids]
        lengthy = body.sizes > most
        starts = np.flatnonzero(body.starts_line[:-1] | (lengthy[:-1] & mine))
        ends = np.flatnonzero(body.ends_line[1:] | (lengthy[1:] & mine))
        size = len(wanted)
        edges = np.flatnonzero(np.diff(starts // max(64, size // 8), prepend=-1, append=body.n))
        heap = []

        def push(a: int, b: int) -> None:
            """Bounds the starts a to b - 1."""
            low, high = int(starts[a]), int(starts[b - 1])
            at, have = body.meets(low, high, most)
            if low < high:
                same = np.cumsum(mine[at] & (body.before[at] < low))
                dice = np.where(have <= most, 2.0 * same / (np.maximum(have, same) + size), 0.0)
                bound, end = dice.max(initial=0.0), 0
            else:
                same = np.cumsum(mine[at])
                stop = ends[np.searchsorted(ends, at)]  # the run may go on to here, unless it meets something new before
                fits = (have <= most) & (stop < np.append(at[1:], body.n))
                dice = np.where(fits, 2.0 * same / (have + size), 0.0)
                k = int(dice.argmax())
                bound, end = dice[k], int(stop[k])
            if bound >= self.threshold:
                heappush(heap, (-float(bound), low, a, b, end))

        for a, b in zip(edges[:-1], edges[1:]):
            push(int(a), int(b))
        while heap:
            bound, low, a, b, end = heappop(heap)
            if b - a == 1:
                return name, -bound, int(body.line[low]), int(body.line[end + 1])
            push(a, (a + b) // 2)
            push((a + b) // 2, b)
        return None


def license_scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document and template found: doc_id, license, dice, first_line, last_line (0-based).

    Null, empty and one-word texts have no bigrams and no row; repeated rows
    and null ids each give their own rows.  Time is in proportion to a text's
    words where nothing comes near a template, however often they repeat.
    """

    def run(columns):
        scanner = Scanner(templates, threshold)
        out = [(i, *m) for i, x in zip(*columns, strict=True) for m in scanner.scan(x)]
        return [list(c) for c in zip(*out)] if out else [[]] * 5

    return map_arrow(texts(docs), "doc_id: long, license: string, dice: double, first_line: long, last_line: long", run)


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def oracle() -> str:
    """The same rows in DuckDB SQL over every run of the texts that hold enough shared bigrams."""
    scanner = Scanner()
    values = ", ".join(f"('{n}', {len(s)}, '{a.decode()} {b.decode()}')" for n, s in scanner.sets.items() for a, b in sorted(s))
    low, up = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    t = THRESHOLD
    most = f"size * (2 - {t}) / {t} + 1e-9"
    return f"""
WITH tpl(license, size, big) AS (VALUES {values}),
d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT rid, unnest(range(len(lines))) AS line, unnest(lines) AS body FROM d),
w AS (SELECT rid, line, unnest(regexp_extract_all(translate(body, '{up}', '{low}'), '[a-z0-9]+')) AS word,
             generate_subscripts(regexp_extract_all(translate(body, '{up}', '{low}'), '[a-z0-9]+'), 1) AS k FROM l),
p AS (SELECT * FROM (SELECT rid, line AS one, lead(line) OVER o AS two, row_number() OVER o AS k, lag(line) OVER o IS DISTINCT FROM line AS opens, lead(line, 2) OVER o IS DISTINCT FROM lead(line) OVER o AS closes,
                            word || ' ' || lead(word) OVER o AS big FROM w WINDOW o AS (PARTITION BY rid ORDER BY line, k)) WHERE big IS NOT NULL),
c AS (SELECT rid, license, size FROM p JOIN tpl USING (big) GROUP BY ALL HAVING count(DISTINCT big) >= size * {t} / (2 - {t}) - 1e-9),
b AS MATERIALIZED (SELECT *, coalesce(lag(k) OVER (PARTITION BY rid, big ORDER BY k), -1) AS before FROM p WHERE rid IN (SELECT rid FROM c)),
lengthy AS (SELECT rid, license, line FROM (SELECT rid, one AS line, count(DISTINCT big) AS own FROM b WHERE one = two GROUP BY ALL) JOIN c USING (rid) WHERE own > {most}),
m AS (SELECT c.rid, c.license, b.k, b.one, b.two FROM c JOIN b USING (rid) JOIN tpl ON tpl.license = c.license AND tpl.big = b.big),
a AS (SELECT c.rid, c.license, b.k AS a, b.one AS first_line FROM c JOIN b USING (rid) WHERE opens
      UNION SELECT m.rid, m.license, m.k, m.one FROM m JOIN lengthy g ON g.rid = m.rid AND g.license = m.license AND g.line = m.one),
e AS (SELECT c.rid, c.license, b.k AS stop, b.two AS last_line FROM c JOIN b USING (rid) WHERE closes
      UNION SELECT m.rid, m.license, m.k, m.two FROM m JOIN lengthy g ON g.rid = m.rid AND g.license = m.license AND g.line = m.two),
r AS (SELECT a.*, b.k, row_number() OVER s AS have, count(m.k) OVER s AS same, lead(b.k) OVER s AS next
      FROM a JOIN b ON b.rid = a.rid AND b.k >= a.a AND b.before < a.a LEFT JOIN m ON m.rid = a.rid AND m.license = a.license AND m.k = b.k
      WINDOW s AS (PARTITION BY a.rid, a.license, a.a ORDER BY b.k)),
s AS (SELECT r.*, 2.0::DOUBLE * same / (have + size) AS dice FROM r JOIN c USING (rid, license) WHERE have <= {most}),
q AS (SELECT s.*, e.stop, e.last_line FROM (SELECT * FROM s WHERE dice >= {t}) s ASOF JOIN e ON s.rid = e.rid AND s.license = e.license AND s.k <= e.stop),
z AS (SELECT *, row_number() OVER (PARTITION BY rid, license ORDER BY dice DESC, a, stop) AS best FROM q WHERE next IS NULL OR stop < next)
SELECT d.doc_id, license, dice, first_line, last_line FROM z JOIN d USING (rid) WHERE best = 1"""
