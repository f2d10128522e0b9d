"""License scans: a trained paragraph classifier with a calibrated unknown class, confirmed by templates."""

from __future__ import annotations

import functools
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .pieces import parts

# Wordings of public licence notices, by family.
TEMPLATES: dict[str, list[str]] = {
    "MIT": [
        "Released under the MIT License.", "This project is licensed under the terms of the MIT license.", "Licensed under the MIT License (MIT).", "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "MIT License", "The MIT License (MIT)",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.", "This file is released under the Apache License 2.0.", "SPDX-License-Identifier: Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Apache License Version 2.0, January 2004",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.", "Licensed under the GPL v3.", "SPDX-License-Identifier: GPL-3.0-or-later", "Released under the GNU GPL, version 2 or later.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "Released under the GPL.", "GPLv3 or later",
    ],
    "LGPL": ["Licensed under the GNU Lesser General Public License, version 2.1.", "SPDX-License-Identifier: LGPL-2.1-only", "This library is free software under the terms of the GNU Lesser General Public License"],
    "AGPL": ["Licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-only", "This program is covered by the GNU Affero General Public License"],
    "BSD": [
        "Released under the BSD 3-Clause License.", "Licensed under the 2-clause BSD license.", "SPDX-License-Identifier: BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "CC-BY": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "Available under the Creative Commons Attribution licence."],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Text is available under the Creative Commons Attribution-ShareAlike License."],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Available under the Creative Commons Attribution NonCommercial licence."],
    "CC0": ["Released under CC0 1.0 Universal.", "To the extent possible under law, the author has waived all copyright and related rights to this work.", "Dedicated to the public domain under CC0."],
    "Proprietary": ["All rights reserved.", "Copyright by the author. All rights reserved.", "Unauthorized copying of this file is strictly prohibited. Proprietary and confidential."],
}
#: Notices of licences outside the families, and words on licences in general. They teach the class "unknown".
OTHERS = [
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "Licensed under the ISC License.", "Distributed under the ISC licence.", "This software is provided as-is, under the zlib license.", "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.",
    "Licensed under the Eclipse Public License, version 2.0.", "This program and the accompanying materials are made available under the terms of the Eclipse Public License.", "Licensed under the Artistic License 2.0.",
    "Released under the Boost Software License, Version 1.0.", "Licensed under the SIL Open Font License, Version 1.1.", "Released under the WTFPL.", "Licensed under the Common Development and Distribution License.",
    "Distributed under the terms of the Foo licence, version 2.", "This work is licensed under its own licence.", "SPDX-License-Identifier: EPL-2.0", "SPDX-License-Identifier: ISC", "SPDX-License-Identifier: Zlib", "See the file LICENSE for the terms of this licence.",
    "Use of this data is governed by a licence agreement.", "This package is distributed under the same terms as Perl itself.", "The software is provided as is, without warranty of any kind, express or implied.",
]
NONE, UNKNOWN = "none", "unknown"
CLASSES = [NONE, *TEMPLATES, UNKNOWN]
DIMS = 4096
NGRAMS = 3
SAMPLE = 2_000  #: about so many documents, chosen by hash of id and text over the whole table, give ordinary segments to train on
STATED, SURE = 0.7, 0.9  #: segments state a licence if "none" has no more than the rest of this probability; of the second where no family fits
CONFIDENCE, CONTAINED = 0.6, 0.6  #: under this probability, or this share of a template's shingles (or of the statement's own), a statement is "unknown"
WORDS = 500_000  #: words a task remembers the hashes of

_WORD = re.compile(r"[^\W_]+")
_CUT = re.compile(r"\n+|(?<=[.;!?])[ \t]++(?!\d)")
_BLANK = re.compile(r"\n[ \t\r]*\n")


@functools.lru_cache(maxsize=WORDS)
def _code(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass"))


def words(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


def grams(ws: list[str]) -> list[np.ndarray]:
    """Hashed word n-grams: for each n the slots of the n-grams that start at each word."""
    code = np.fromiter(map(_code, ws), np.uint64, len(ws))
    out, run = [], np.zeros(len(ws), np.uint64)
    for k in range(NGRAMS):
        if len(ws) <= k:
            break
        run = run[: len(ws) - k] * np.uint64(0x100000001B3) + code[k:] + np.uint64(1)
        out.append(((run * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % DIMS)
    return out


def features(ws: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Sparse hashed word n-grams, scaled by the root of their number."""
    at, n = np.unique(np.concatenate([np.zeros(0, np.int64), *grams(ws)]), return_counts=True)
    return at, n / np.sqrt(max(1, n.sum()))


def training_set(ordinary: list[list[str]], rng: np.random.Generator, copies: int = 24) -> tuple[list[list[str]], np.ndarray]:
    """Notices whole, with words lost, broken as by line ends, and with ordinary words around; ordinary segments, also with stray words of licences."""
    rows, y = [], []
    pool = [w for p in ordinary for w in p] or ["a", "note", "on", "the", "weather"]

    def some(n: int) -> list[str]:
        k = int(rng.integers(0, len(pool)))
        return pool[k : k + n]

    for f, texts in enumerate([*TEMPLATES.values(), OTHERS], 1):
        for t in texts:
            whole = words(t)
            for c in range(copies):
                ws = whole if c < 4 else [w for w in whole if rng.random() > 0.06]
                if c >= 8 and len(ws) > 14:  # a line of a wrapped notice
                    k = int(rng.integers(0, len(ws) - 7))
                    ws = ws[k : k + int(rng.integers(7, 15))]
                if c % 4 == 3:
                    ws = some(int(rng.integers(0, 6))) + ws + some(int(rng.integers(0, 6)))
                rows.append(ws)
                y.append(f)
    stray = ["license", "licence", "licensed", "copyright", "permission", "version", "public", "general", "rights", "source", "terms", "of", "the", "under", "software", "files", "without", "free"]
    for i in range(len(rows)):
        ws = list(ordinary[int(rng.integers(0, len(ordinary)))]) if ordinary else some(12)
        if i % 4 == 0:  # a short one
            k = int(rng.integers(0, len(ws)))
            ws = ws[k : k + int(rng.integers(1, 5))]
        for _ in range(i % 3):
            ws.insert(int(rng.integers(0, len(ws) + 1)), stray[int(rng.integers(0, len(stray)))])
        rows.append(ws)
        y.append(0)
    return rows, np.array(y)


def _shingles(ws: list[str]) -> set[tuple[str, ...]]:
    return set(zip(ws, ws[1:], strict=False)) or {tuple(ws)}


class Model:
    """Multinomial logistic regression with a temperature fitted on held-out rows."""

    def __init__(self, weights: np.ndarray, temperature: float):
        self.weights, self.temperature = weights, temperature
        self.by_class = np.ascontiguousarray(weights[:-1].T)
        self.shapes = {f: [_shingles(words(t)) for t in ts] for f, ts in TEMPLATES.items()}

    def probabilities(self, starts: np.ndarray, ends: np.ndarray, slots: list[np.ndarray]) -> np.ndarray:
        """Class probabilities of each run of words starts[i]:ends[i] of a text whose n-grams are slots: n-grams within the run count."""
        z, n = np.zeros((len(starts), self.weights.shape[1])), np.zeros(len(starts))
        for k, at in enumerate(slots):
            last = np.maximum(ends - k, starts)
            lo, hi = np.minimum(starts, len(at)), np.minimum(last, len(at))
            for c, w in enumerate(self.by_class):
                total = np.r_[0.0, np.cumsum(w[at], dtype=float)]
                z[:, c] += total[hi] - total[lo]
            n += last - starts
        z = (z / np.sqrt(np.maximum(n, 1))[:, None] + self.weights[-1]) / self.temperature
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def near(self, family: str, ws: list[str], full: bool = False) -> float:
        """Largest share of a template's shingles that the words hold, or (not full) of the words' own that a template holds."""
        have = _shingles(ws)
        return max(len(have & t) / (len(t) if full else min(len(t), len(have))) for t in self.shapes[family])

    def name(self, p: np.ndarray, ws: list[str]) -> tuple[str, float]:
        """(family, probability) of a statement with class probabilities p: the likeliest family if a template confirms it, else "unknown"."""
        said = p[1:] / p[1:].sum()
        k = int(said.argmax()) + 1
        if CLASSES[k] != UNKNOWN and said[k - 1] >= CONFIDENCE:
            if self.near(CLASSES[k], ws) >= CONTAINED:
                return CLASSES[k], float(said[k - 1])
        return UNKNOWN, float(said[-1])

    def statements(self, text: str) -> list[tuple[str, int, int, float]]:
        """(family, start, end, probability) of the licence statements of a text, in order.

        A text is cut at line ends and sentence ends. Every segment is put to the classifier; segments that state a licence and
        follow each other within a paragraph (up to a blank line) are one statement, unless both are whole notices of families that differ.
        """
        cut = [_WORD.findall(x) for x in _CUT.split(text)]
        size = np.fromiter(map(len, cut), np.int64, len(cut))
        ends = np.cumsum(size)[size > 0]
        if not len(ends):
            return []
        starts = np.r_[0, ends[:-1]]
        ws = [w.lower() for x in cut for w in x]
        slots = grams(ws)
        p = self.probabilities(starts, ends, slots)
        on = np.flatnonzero(p[:, 0] <= 1 - STATED)
        if not len(on):
            return []
        begin, stop = (np.array(v) for v in zip(*((m.start(), m.end()) for m in _WORD.finditer(text)), strict=True))
        block = np.searchsorted(np.array([m.end() for m in _BLANK.finditer(text)], np.int64), begin[starts[on]], side="right")
        out: list[list] = []  # first and last segment, paragraph, family, whether a segment is a whole notice of it
        for i, b in zip(on, block, strict=True):
            mine = ws[starts[i] : ends[i]]
            name = self.name(p[i], mine)[0]
            full = name != UNKNOWN and self.near(name, mine, True) >= CONTAINED
            if out and out[-1][1] == i - 1 and out[-1][2] == b and not (name != out[-1][3] and full and out[-1][4]):
                out[-1][1] = i
                if out[-1][3] == UNKNOWN or full and not out[-1][4]:
                    out[-1][3:] = [name, full]
            else:
                out.append([i, i, b, name, full])
        runs = np.array([[starts[o[0]], ends[o[1]]] for o in out]).reshape(-1, 2)
        whole = self.probabilities(runs[:, 0], runs[:, 1], slots)
        got = []
        for (s, e), q, o in zip(runs, whole, out, strict=True):
            family, chance = self.name(q, ws[s:e])
            k = CLASSES.index(o[3])
            if family == UNKNOWN != o[3]:  # a named segment beside others that no template holds
                family, chance = o[3], float(q[k] / q[1:].sum())
            if family != UNKNOWN or q[0] <= 1 - SURE:
                got.append((family, int(begin[s]), int(stop[e - 1]), chance))
        return got


def train(ordinary: list[list[str]], seed: int = 3, rounds: int = 150) -> Model:
    rng = np.random.default_rng(seed)
    rows, y = training_set(ordinary, rng)
    x = np.zeros((len(rows), DIMS + 1), np.float32)
    for i, ws in enumerate(rows):
        at, v = features(ws)
        x[i, at] = v
    x[:, -1] = 1
    held = np.arange(len(rows)) % 5 == 4
    target = np.eye(len(CLASSES), dtype=np.float32)[y]
    w = np.zeros((DIMS + 1, len(CLASSES)), np.float32)
    m, v2 = np.zeros_like(w), np.zeros_like(w)

    def soft(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    fit_x, fit_y = x[~held], target[~held]
    for t in range(1, rounds + 1):
        g = fit_x.T @ (soft(fit_x @ w) - fit_y) / len(fit_x) + 2e-5 * w
        m, v2 = 0.9 * m + 0.1 * g, 0.999 * v2 + 0.001 * g * g
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v2 / (1 - 0.999**t)) + 1e-8)
    z = x[held] @ w
    loss = {t: -np.log(soft(z / t)[np.arange(len(z)), y[held]] + 1e-12).mean() for t in (0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0)}
    return Model(w, min(loss, key=loss.get))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Model:
    """Model from the notices and from an ordinary segment of each of at most about `sample` documents (none of an empty table)."""
    share = min(1.0, sample / max(1, docs.count()))
    src = docs.where(F.col(text_col).isNotNull()).select(F.col(text_col).cast("string").alias("t"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("h"))
    if share < 1:
        src = src.where(F.pmod("h", F.lit(1 << 30)) < int(share * (1 << 30)))

    def pick(batches):
        for b in batches:
            got = []
            for t, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                cut = [p for p in (words(x) for x in _CUT.split(t)) if 1 <= len(p) <= 60 and not KNOWN & set(p)]
                if cut:
                    got.append(" ".join(cut[h % len(cut)]))
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.string())], ["s"])

    # what is taken for ordinary must not itself state a licence
    KNOWN = {"license", "licence", "licensed", "copyright", "spdx", "gpl", "apache", "mit", "cc", "rights", "reserved", "redistributions", "sublicense"}
    ordinary = sorted({r[0] for r in src.mapInArrow(pick, "s string").collect()})  # short segments, about `sample` of them
    return train([s.split() for s in ordinary])


def scan(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, licences array<struct<family,start,end,probability>>: what states a licence, in order.

    Offsets are code points, end exclusive, from the first to the last word. A statement that no family fits is "unknown". A null or
    empty text has none. Texts are judged whole, whatever their length; each row by itself, so repeated rows have equal licences; of
    equally likely families the first of CLASSES counts.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for whole in batches:
            for b in parts(whole, 1):
                got = [[{"family": f, "start": s, "end": e, "probability": p} for f, s, e, p in shared.value.statements(t or "")] for t in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, kind)], ["id", "licences"])

    kind = pa.list_(pa.struct([("family", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("probability", pa.float64())]))
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    return src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, licences array<struct<family:string,start:long,end:long,probability:double>>")


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    got = scan(docs, fit(docs))
    spans = F.array_join(F.transform("licences", lambda x: F.concat_ws(":", x["family"], x["start"], x["end"])), ",")
    return got.select(F.col("id").alias("doc_id"), F.size("licences").cast("long").alias("n_licences"), F.array_join(F.array_sort(F.array_distinct(F.col("licences.family"))), ",").alias("families"), spans.alias("spans"))


QUERIES = {"op6_licenses": op6_licenses}
SQL: dict[str, str] = {}
