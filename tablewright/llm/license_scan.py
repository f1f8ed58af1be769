"""License scans (operator 2).

Patience alignment: words that occur once in a stretch of the document and once in the
license text are anchors; the longest increasing run of anchors is kept, and the gaps
between them are aligned in the same way.  Coverage is the share of the license's words
that are aligned.

Only words of the license can be aligned, so of the whole text these are looked at, however many others
stand between them.  A stretch starts at one of them and goes on for twice as many as the license has, within SPREAD times
its length of the text: a notice that is torn further apart is none.  So a notice is found wherever it stands, with any other words put in between, and with as many words of the
license's own as it has.  Where anchors align fewer words than a longest common subsequence has, that one is taken.  Stretches that cannot reach the wished coverage, by the words they share with the license or by their longest
common subsequence with it, are not aligned.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from tablewright.llm import text as T
from tablewright.llm.store import with_columns

# Names and wording of public license notices.
LICENSES = {
    "MIT": "Released under the MIT License.",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software."
    ),
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either '
        "express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "LGPL-2.1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License version 2.1.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "All rights reserved": "Copyright. All rights reserved.",
}
COVERAGE = 0.8
#: How many times a license's length its notice may span in a text.
SPREAD = 16
_BETWEEN = np.ones(256, bool)
_BETWEEN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words(text: str | None) -> list[bytes]:
    return _WORD.findall((text or "").encode().lower())


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs, sorted by the first number, whose second numbers rise (patience sorting)."""
    tops: list[int] = []
    where: list[int] = []
    back: list[int] = []
    for k, (_, y) in enumerate(pairs):
        pile = bisect_left(tops, y)
        back.append(where[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(y)
            where.append(k)
        else:
            tops[pile], where[pile] = y, k
    out, k = [], where[-1] if where else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def align(a: list, b: list) -> list[tuple[int, int]]:
    """Places (in a, in b) of aligned words, rising in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, j, x, y = todo.pop()
        # Equal words at either end need no anchor.
        while i < j and x < y and a[i] == b[x]:
            out.append((i, x))
            i, x = i + 1, x + 1
        while i < j and x < y and a[j - 1] == b[y - 1]:
            j, y = j - 1, y - 1
            out.append((j, y))
        once: dict = {}
        for k in range(i, j):
            once[a[k]] = k if a[k] not in once else -1
        other: dict = {}
        for k in range(x, y):
            other[b[k]] = k if b[k] not in other else -1
        anchors = _rising(sorted((k, other[w]) for w, k in once.items() if k >= 0 and other.get(w, -1) >= 0))
        if not anchors:
            continue
        out += anchors
        edges = [(i - 1, x - 1), *anchors, (j, y)]
        todo += [(p + 1, r, q + 1, s) for (p, q), (r, s) in zip(edges, edges[1:], strict=False) if r > p + 1 and s > q + 1]
    return sorted(out)


def _rows(a: list, places: dict, size: int):
    """For each start of a, the bits where its longest common subsequence with the wording's first words grows; places: the bits of each word's places."""
    row, full = 0, (1 << size) - 1
    yield row
    for w in a:
        both = row | places[w]
        row = both & ~(both - (row << 1 | 1)) & full
        yield row


def common(a: list, places: dict, size: int) -> int:
    """The length of the longest common subsequence of a and a wording: a word of a is a few operations on whole numbers."""
    row = 0
    for row in _rows(a, places, size):  # noqa: B007
        pass
    return row.bit_count()


def _traced(a: list, b: list) -> list[tuple[int, int]]:
    """Pairs of a longest common subsequence, as early in a as can be."""
    places = {w: sum(1 << k for k, x in enumerate(b) if x == w) for w in set(a)}
    rows = list(_rows(a, places, len(b)))
    length = lambda i, j: (rows[i] & ((1 << j) - 1)).bit_count()
    i, j, out = len(a), len(b), []
    while i and j:
        if length(i - 1, j) == length(i, j):
            i -= 1
        elif length(i, j - 1) == length(i, j):
            j -= 1
        else:
            i, j = i - 1, j - 1
            out.append((i, j))
    return out[::-1]


def _stretch(own: list, wording: list, a: int, stop: int, most: int, coverage: float) -> tuple[int, int, int]:
    """(words aligned, first word, word after the last) of the alignment of own[a:stop]; most: how many words can be aligned."""
    size = len(wording)
    pairs = align(own[a:stop], wording)
    if len(pairs) < most:
        # Where the notice is repeated at once, words of the next one are no anchors: end before it, too.
        for end in range(a + max(1, int(coverage * size)), stop):
            if own[end] == own[a]:
                pairs = max(pairs, align(own[a:end], wording), key=len)
    if len(pairs) < most:
        # Anchors that lead astray: the exact subsequence, to its earliest end and from its latest start.
        end = a + _traced(own[a:stop], wording)[-1][0] + 1
        back = _traced(own[a:end][::-1], wording[::-1])
        return len(back), end - 1 - back[-1][0], end
    if not pairs:
        return 0, a, a
    # The last words may be aligned with later ones like them: as short as it gets.
    while pairs[-1][0] - pairs[0][0] + 1 > len(pairs):
        a, n = a + pairs[0][0], pairs[-1][0] - pairs[0][0]
        shorter = align(own[a : a + n], wording)
        pairs = [(i - pairs[0][0], x) for i, x in pairs]
        if len(shorter) < len(pairs):
            break
        pairs = shorter
    return len(pairs), a + pairs[0][0], a + pairs[-1][0] + 1


def scan(text: list, licenses: dict[str, list], coverage: float, spread: int = SPREAD) -> list[tuple[str, float, int, int]]:
    """(license, coverage, first word, word after the last) of the best stretch for each license that reaches coverage."""
    out = []
    for name, wording in licenses.items():
        size, limit = len(wording), Counter(wording)
        at = [k for k, w in enumerate(text) if w in limit]
        own = [text[k] for k in at]
        bits = {w: sum(1 << k for k, x in enumerate(wording) if x == w) for w in limit}
        counts = dict.fromkeys(limit, 0)
        best, end, most, known, known_end = None, 0, 0, 0, 0
        need = math.ceil(coverage * size - 1e-9)
        for a, first in enumerate(own):
            stop = min(a + 2 * size, bisect_left(at, at[a] + spread * size))
            for w in own[end:stop]:
                counts[w] += 1
                most += counts[w] <= limit[w]
            end = max(end, stop)
            # At most so many words of this stretch can be aligned: as many as it shares, and a common
            # subsequence grows by a word at most for each word that comes in.
            if most >= need and known + end - known_end >= need and (best is None or most > best[0] or most == best[0] < best[2] - best[1]):
                known, known_end = common(own[a:end], bits, size), end
                if known >= need:
                    n, i, j = _stretch(own, wording, a, end, known, coverage)
                    found = (n, at[i], at[j - 1] + 1) if n else (0, 0, 0)
                    if n >= need and (best is None or (-n, found[2] - found[1]) < (-best[0], best[2] - best[1])):
                        best = found
            most -= counts[first] <= limit[first]
            counts[first] -= 1
        if best:
            out.append((name, best[0] / size, *best[1:]))
    return sorted(out, key=lambda x: (-x[1], -len(licenses[x[0]]), x[0]))


def scan_licenses(docs: DataFrame, licenses: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """docs (text, others) with licenses: an array of (license, coverage, first_word, end_word), best first.

    licenses: wording by name; by default LICENSES.  Words are runs of letters, digits and
    non-ASCII characters, with A-Z lower-cased.  A license is listed once, by its best
    stretch (the shortest of equals, then the first), if at least `coverage` of its words are aligned; ties go
    to the longer wording, then by name.

    Null and empty texts have none (an empty array), and so have all without licenses.  Long
    texts are looked at whole; a notice may span SPREAD times its wording's length, and twice its number of words of the wording.
    Repeated rows get a result each.  An empty table gives no rows.  A column of docs named
    licenses is replaced.
    """
    docs = docs.drop("licenses")
    wordings = {k: w for k, v in (LICENSES if licenses is None else licenses).items() if (w := words(v))}
    kind = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("first_word", pa.int64()), ("end_word", pa.int64())]))

    def run(batches):
        names = list(wordings)
        every = sorted({w for v in wordings.values() for w in v})
        known, _ = T.word_hashes(pa.array([w.decode() for w in every]), False, _BETWEEN)
        rank = np.argsort(known)
        member = np.array([[w in set(wordings[n]) for n in names] for w in every], np.int64).reshape(len(every), len(names))[rank]
        known = known[rank]
        needed = np.array([np.ceil(coverage * len(wordings[n])) - (len(wordings[n]) - len(set(wordings[n]))) for n in names])
        for batch in T.parts(batches, "text"):
            column = batch.column("text")
            h, at = T.word_hashes(column, True, _BETWEEN)
            found: list[list] = [[] for _ in range(batch.num_rows)]
            if len(known) and len(h):
                place = np.minimum(np.searchsorted(known, h), len(known) - 1)
                hit = np.flatnonzero(known[place] == h)
                row = np.searchsorted(at, hit, "right") - 1
                both = np.unique(row * len(known) + place[hit])
                distinct = np.zeros((batch.num_rows, len(names)), np.int64)
                np.add.at(distinct, both // len(known), member[both % len(known)])
                # A license is looked for where enough different words of it occur at all.
                able = distinct >= np.maximum(needed, 1)
                for r in np.flatnonzero(able.any(1)).tolist():
                    found[r] = scan(words(column[r].as_py()), {n: wordings[n] for k, n in enumerate(names) if able[r, k]}, coverage)
            rows = [[dict(zip(("license", "coverage", "first_word", "end_word"), x, strict=True)) for x in f] for f in found]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, kind)], [*batch.schema.names, "licenses"])

    found = StructType([StructField("license", StringType()), StructField("coverage", DoubleType()), StructField("first_word", LongType()), StructField("end_word", LongType())])
    return docs.mapInArrow(run, with_columns(docs.schema, ("licenses", ArrayType(found))))
