"""Licence scans: normalised text against licence templates by the Dice coefficient over word bigrams.

Text and templates are folded to lower-case words of letters and digits.  A match is a stretch of words, from one bigram of a template to
another, whose set of bigrams A and the template's set B have 2 |A and B| / (|A| + |B|) of at least ``threshold`` t.  From that follow bounds on size that
prune: |A| lies between t / (2 - t) |B| and (2 - t) / t |B|, and a text with fewer than t / (2 - t) |B| distinct bigrams of the template cannot
match it.  All such stretches are listed and the best one is chosen: higher coefficient, then more bigrams in the template, smaller name, earlier start,
shorter; then the best of those that share no word with it, until none is left.  A template may thus be found many times in a text.
Longer templates, such as whole licence texts, come from a folder by ``read_templates``.

Null texts, empty texts and texts without words match nothing.  Rows are independent: repeated rows get equal results, an empty table none; other columns
are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import Words, column, documents, raw, slices

THRESHOLD = 0.8

# Wordings of licence notices and short licences.
TEMPLATES = {
    "MIT-line": "Released under the MIT License.",
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under the Creative Commons Attribution 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/ or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA.",
    "CC-BY-SA-4.0": "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by-sa/4.0/ or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}

PLAIN = np.arange(256, dtype=np.uint8)
PLAIN[[b for b in range(128) if not chr(b).isalnum()]] = 32


def bigrams(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, Words]:
    words = Words(PLAIN[buf], offsets)
    hashes, doc = words.shingles(2)
    return hashes, np.searchsorted(doc, np.arange(len(offsets))), words


@lru_cache(maxsize=4)
def prepared(templates: tuple[tuple[str, str], ...]):
    """Sorted distinct bigrams of all templates, and for each template its name and its bigrams as numbers."""
    sets = [np.unique(bigrams(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[0]) for _, t in templates]
    every = np.unique(np.concatenate(sets)) if sets else np.zeros(0, np.uint64)
    quick = np.zeros(1 << 16, bool)
    quick[(every >> np.uint64(48)).astype(np.int64)] = True
    holds = np.zeros((len(sets), len(every)), bool)
    for k, s in enumerate(sets):
        holds[k, np.searchsorted(every, s)] = True
    return every, quick, holds, np.array([len(s) for s in sets]), [n for n, _ in templates]


def stretches(own: np.ndarray, number: np.ndarray, holds: np.ndarray, sizes: np.ndarray, t: float) -> dict:
    """All stretches with a coefficient of at least ``t``: for (template, first bigram) the (-coefficient, last bigram), best first.

    ``own`` are the bigrams of a text, ``number`` their numbers among the bigrams of the templates (-1: in none).  A step to the left keeps
    the places where the distinct bigrams from here on stand first; a stretch with at most ``most`` of them is read off that list, however often they
    repeat, so the list needs no more than the longest bound and the work grows with the text.  Of stretches with equal sets the shortest counts.
    """
    most, least = np.floor((2 - t) / t * sizes + 1e-9).astype(np.int64), t / (2 - t) * sizes - 1e-9
    longest = int(most.max())
    order = np.argsort(own, kind="stable")
    same = np.flatnonzero(own[order][1:] == own[order][:-1])
    again = np.full(len(own), -1)
    again[order[same]] = order[same + 1]
    again, known = again.tolist(), number.tolist()
    hits = np.flatnonzero(number >= 0)
    first: list[int] = []  # negative places, so that they rise
    shared = np.zeros(len(sizes), np.int64)
    out: dict = {}
    for a in range(int(hits[-1]), int(hits[0]) - 1, -1):
        mine = known[a]
        if again[a] >= 0:
            k = bisect_left(first, -again[a])
            if k < len(first) and first[k] == -again[a]:
                del first[k]
                if mine >= 0:
                    shared -= holds[:, mine]
        first.append(-a)
        if mine >= 0:
            shared += holds[:, mine]
        if len(first) > longest:
            gone = known[-first.pop(0)]
            if gone >= 0:
                shared -= holds[:, gone]
        if mine < 0:
            continue
        can = np.flatnonzero((shared >= least) & holds[:, mine])
        if not len(can):
            continue
        places = -np.array(first[::-1])
        which = number[places]
        for k in can.tolist():
            n = int(most[k])
            hit = holds[k, which[:n]] & (which[:n] >= 0)
            ends = np.flatnonzero(hit)
            dice = 2 * np.arange(1, len(ends) + 1) / (ends + 1 + sizes[k])
            good = np.flatnonzero(dice >= t - 1e-12)
            if len(good):
                out[k, a] = sorted(zip((-dice[good]).tolist(), places[ends[good]].tolist()))
    return out


def chosen(found: dict, sizes: np.ndarray) -> list[tuple[int, float, int, int]]:
    """(template, coefficient, first word, last word): the best stretch first, then the best of those that share no word with it, and so on."""
    heap = [(ends[0][0], -int(sizes[k]), k, a, ends[0][1], 0) for (k, a), ends in found.items()]
    heapify(heap)
    begins: list[int] = []  # first and last bigrams taken so far
    stops: list[int] = []
    kept = []
    while heap:
        dice, size, k, a, b, i = heappop(heap)
        at = bisect_left(begins, a)
        if (at and stops[at - 1] + 1 >= a) or (at < len(begins) and begins[at] == a):
            continue
        if at < len(begins) and b + 1 >= begins[at]:
            ends = found[k, a]
            i = next((j for j in range(i + 1, len(ends)) if ends[j][1] + 1 < begins[at]), None)
            if i is not None:
                heappush(heap, (ends[i][0], size, k, a, ends[i][1], i))
            continue
        begins.insert(at, a)
        stops.insert(at, b)
        kept.append((k, -dice, a, b + 1))
    return sorted(kept, key=lambda m: m[2])


def matches(own: np.ndarray, every, quick, holds, sizes, t: float) -> list[tuple[int, float, int, int]]:
    """Non-overlapping (template, coefficient, first word, last word) of one text."""
    at = np.flatnonzero(quick[(own >> np.uint64(48)).astype(np.int64)])
    place = np.searchsorted(every, own[at])
    known = every[np.minimum(place, len(every) - 1)] == own[at]
    at, place = at[known], place[known]
    if not len(at):
        return []
    possible = np.flatnonzero((sizes > 0) & (holds[:, np.unique(place)].sum(axis=1) >= t / (2 - t) * sizes - 1e-9))
    if not len(possible):
        return []
    number = np.full(len(own), -1)
    number[at] = place
    found = stretches(own, number, holds[possible], sizes[possible], t)
    return [(int(possible[k]), *m) for k, *m in chosen(found, sizes[possible])]


def read_templates(spark, path: str, max_bytes: int = 16 << 20) -> dict[str, str]:
    """Templates from a folder of plain text files, one licence a file, named by the file; refused beyond ``max_bytes``, as they go to every task."""
    files = spark.read.format("binaryFile").load(path)
    size = files.agg(F.sum("length")).first()[0] or 0
    if size > max_bytes:
        raise ValueError(f"{size} bytes of licence templates, at most {max_bytes} are allowed")
    names = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.txt$", "")
    return {r["name"]: r["text"] for r in files.select(names.alias("name"), F.decode("content", "utf-8").alias("text")).collect()}


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id and ``found``: an array of (licence, dice, first_word, last_word) per row."""
    listed = tuple(sorted(templates.items()))
    shape = pa.list_(pa.struct([("licence", pa.string()), ("dice", pa.float64()), ("first_word", pa.int64()), ("last_word", pa.int64())]))

    def run(batches):
        every, quick, holds, sizes, names = prepared(listed)
        for batch in batches:
            buf, offsets = raw(column(batch, "text"))
            rows: list = []
            for a, b in slices(offsets):
                hashes, at, _ = bigrams(buf[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
                near = np.append(0, np.cumsum(quick[(hashes >> np.uint64(48)).astype(np.int64)]))[at]
                for i in range(b - a):
                    some = len(every) and near[i + 1] > near[i]
                    got = matches(hashes[at[i]:at[i + 1]], every, quick, holds, sizes, threshold) if some else ()
                    rows.append([{"licence": names[k], "dice": d, "first_word": x, "last_word": y} for k, d, x, y in got])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, shape)], ["doc_id", "found"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, found array<struct<licence:string,dice:double,first_word:long,last_word:long>>")


def op4_license_scan(spark, sf_dir: str) -> DataFrame:
    found = scan(documents(spark, sf_dir))
    return found.select("doc_id", F.size("found").cast("long").alias("n_licences"), F.array_join(F.transform("found", lambda x: F.concat_ws(":", x["licence"], x["first_word"].cast("string"), x["last_word"].cast("string"))), ",").alias("licences"),
                        F.coalesce(F.array_max(F.transform("found", lambda x: x["dice"])), F.lit(0.0)).alias("best_dice"))
