"""Licence scan: MinHash bands over overlapping text windows find templates, exact
shingle containment verifies them.

Templates are grouped by length.  For a group whose longest template has B words,
a text is cut into blocks of B shingles and a window is two neighbouring blocks,
so every occurrence of a template lies whole inside one window.  A window's MinHash
is the minimum of its blocks' MinHashes.  With one row to a band, a window that
holds the required part of a template agrees in a given band with probability J,
their Jaccard similarity, which the group's lengths bound from below; the number of
bands is chosen so that at least one agrees with probability ``target``.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausekit.llm import words as W
from clausekit.llm.decontaminate import _table

cloudpickle.register_pickle_by_value(sys.modules[__name__])

N = 5
PERCENT = 75
GROUPS = (5, 6, 8, 12, 16, 24, 32, 48, 64, 96, 128, 192, 256, 384, 512, 768, 1024)
OUT = "doc_id bigint, license_id string, containment double, start_word bigint, end_word bigint"

#: Common licence notices, one line each or the operative paragraph.
TEMPLATES = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "mit-line": "Released under the MIT License.",
    "apache-2.0-notice": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        "\"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the "
        "specific language governing permissions and limitations under the License."),
    "gpl-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without "
        "even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    "mit-notice": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright "
        "notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    "bsd-notice": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
        "distribution."),
    "mpl-2.0-notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
}


def _shingles(column: pa.Array):
    for lo, hi, data, off in W.chunks(pc.utf8_lower(column.cast(pa.large_string()).fill_null(""))):
        w = W.split_words(data, off, _table())
        h, d = W.grams(w, N)
        if len(d) and (np.diff(d) < 0).any():
            k = np.argsort(d, kind="stable")
            h, d = h[k], d[k]
        yield lo, hi, h, np.searchsorted(d, np.arange(hi - lo + 1)), w


class Templates:
    """Signatures of the templates, by group of lengths."""

    def __init__(self, texts: dict[str, str], target: float = 0.99):
        self.names = sorted(texts)
        self.sets, self.count = [], []
        for _, _, h, cut, w in _shingles(pa.array([texts[n] for n in self.names], pa.large_string())):
            self.sets += [np.unique(h[a:b]) for a, b in zip(cut[:-1], cut[1:])]
            self.count += np.diff(w.first).tolist()
        groups: dict[int, list[int]] = {}
        for i, s in enumerate(self.sets):
            if len(s):
                size = next((g for g in GROUPS if g >= self.count[i]), self.count[i])
                groups.setdefault(size, []).append(i)
        self.groups = []
        for size, mine in sorted(groups.items()):
            need = [-(-PERCENT * len(self.sets[i]) // 100) for i in mine]
            j = min(k / (2 * size + len(self.sets[i]) - k) for k, i in zip(need, mine))
            bands = math.ceil(math.log(1 - target) / math.log(1 - j))
            rng = np.random.default_rng([5, size])
            mult = rng.integers(0, 1 << 63, bands, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
            sig = np.stack([[(self.sets[i] * m).min() for i in mine] for m in mult])
            self.groups.append((size, np.array(mine), mult, sig))

    def matches(self, h: np.ndarray, cut: np.ndarray, w: W.Words):
        """(text, template, containment, first word, end word): the best window of
        every pair, the first of equals."""
        out = {}
        n = np.diff(cut)
        for size, mine, mult, sig in self.groups:
            blocks = -(-n // size)
            if not blocks.sum():
                continue
            text = np.repeat(np.arange(len(n)), blocks)
            start = np.repeat(cut[:-1], blocks) + (np.arange(len(text)) - np.repeat(np.cumsum(blocks) - blocks, blocks)) * size
            more = np.zeros(len(text), bool)
            more[:-1] = text[1:] == text[:-1]
            found = []
            for m, row in zip(mult, sig):
                low = np.minimum.reduceat(h * m, start)
                low[:-1] = np.where(more[:-1], np.minimum(low[:-1], low[1:]), low[:-1])
                near = np.zeros(1 << 16, bool)
                near[(row >> np.uint64(48)).astype(np.int64)] = True
                hit = np.flatnonzero(near[(low >> np.uint64(48)).astype(np.int64)])
                if len(hit):
                    k, t = np.nonzero(low[hit][:, None] == row[None, :])
                    found.append(hit[k] * len(mine) + t)
            for code in np.unique(np.concatenate(found)) if found else ():
                b, t = divmod(int(code), len(mine))
                d, i = int(text[b]), int(mine[t])
                lo, hi = int(start[b]), int(min(cut[d + 1], start[b] + 2 * size))
                at = np.flatnonzero(np.isin(h[lo:hi], self.sets[i]))
                part = len(np.unique(h[lo:hi][at])) / len(self.sets[i])
                if 100 * part >= PERCENT and part > out.get((d, i), (0,))[0]:
                    first = lo + int(at[0]) - int(cut[d])
                    last = lo + int(at[-1]) - int(cut[d]) + N
                    out[d, i] = (part, first, min(last, int(w.first[d + 1] - w.first[d])))
        return [(d, i, *v) for (d, i), v in sorted(out.items())]


def _scan(templates: Templates):
    def run(batches):
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for lo, _, h, cut, w in _shingles(b.column(1)):
                rows = templates.matches(h, cut, w)
                if rows:
                    d, i, part, s, e = zip(*rows)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[lo + np.array(d)]), pa.array([templates.names[k] for k in i]),
                         pa.array(part, pa.float64()), pa.array(s, pa.int64()), pa.array(e, pa.int64())],
                        ["doc_id", "license_id", "containment", "start_word", "end_word"])
    return run


def find_licenses(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id",
                  text_col: str = "text", target: float = 0.99) -> DataFrame:
    """(doc_id, license_id, containment, start_word, end_word): every licence of which
    a window of the text holds at least 75 % of the five-word shingles (words lower-
    cased, ASCII punctuation dropped; shorter templates count as one shingle).  The
    templates are a parameter of bounded size.  Null or empty texts and null ids give
    no rows; repeated rows of an id give its best window; other columns are ignored."""
    t = Templates(templates if templates is not None else TEMPLATES, target)
    d = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    best = F.max(F.struct("containment", -F.col("start_word"), -F.col("end_word"))).alias("m")
    out = d.mapInArrow(_scan(t), OUT).groupBy("doc_id", "license_id").agg(best)
    return out.select(F.col("doc_id").alias(id_col), "license_id", F.col("m.containment").alias("containment"),
                      (-F.col("m.col2")).alias("start_word"), (-F.col("m.col3")).alias("end_word"))
