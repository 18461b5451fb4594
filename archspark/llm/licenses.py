"""Licence scans: a paragraph classifier over word n-grams, with a calibrated unknown class and confirmation by templates.

A paragraph is a run of lines that aren't blank, so a notice wrapped over lines is read as one. The classifier is a multinomial
logistic regression on hashed word 1- to 3-grams of windows of a paragraph, of several sizes (SIZES), so that a short notice
within a long line fills one. A bound by the largest weight of each n-gram leaves out windows that no family can win, without
changing the result. It is trained on the notices of TEMPLATES, varied by
dropping, exchanging and adding words, against windows of a bounded sample of the corpus (SAMPLE documents) and sentences about
licences that grant none, which make up the unknown class. Temperature and threshold are calibrated with whole templates held
out (one in three of each family), then the model is trained on all. Every stretch of a paragraph whose windows are accepted is
reported; it is confirmed where it has enough of the word pairs of one of the family's templates.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archspark.llm.common import CACHE_WORDS, row_batches

#: Documents of the sample, and windows drawn from each.
SAMPLE, DRAWN = 400, 10
FEATURES = 1 << 16
#: Windows of a paragraph, in words, and the steps between them; the largest is what training sees of a notice.
SIZES = ((24, 8), (12, 4), (6, 2), (4, 1))
WINDOW, STEP = SIZES[0]
#: Windows whose probabilities are worked out at once.
CHUNK = 512
#: Share of a template's word pairs that a paragraph must have.
CONFIRMED = 0.6
UNKNOWN = "unknown"

# Customary notices by SPDX identifier of the licence.
TEMPLATES = {
    "MIT": ["Released under the MIT License.", "Licensed under the MIT license.", "This project is licensed under the terms of the MIT license.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "SPDX-License-Identifier: MIT"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "Released under the Apache 2.0 license.", "SPDX-License-Identifier: Apache-2.0"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License version 3", "Released under the GPL version 3.", "SPDX-License-Identifier: GPL-3.0-only"],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "under the terms of the GNU General Public License version 2 as published by the Free Software Foundation", "SPDX-License-Identifier: GPL-2.0-only"],
    "LGPL-2.1": ["under the terms of the GNU Lesser General Public License version 2.1", "This library is licensed under the GNU Lesser General Public License.", "SPDX-License-Identifier: LGPL-2.1-only"],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3.", "under the terms of the GNU Affero General Public License version 3", "SPDX-License-Identifier: AGPL-3.0-only"],
    "BSD-3-Clause": ["Released under the BSD 3-Clause License.", "Use of this source code is governed by a BSD-style license.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software", "SPDX-License-Identifier: BSD-3-Clause"],
    "BSD-2-Clause": ["Released under the BSD 2-Clause License.", "Licensed under the Simplified BSD License.", "SPDX-License-Identifier: BSD-2-Clause"],
    "LGPL-3.0": ["under the terms of the GNU Lesser General Public License version 3", "This library is licensed under the GNU LGPL version 3 or later.", "SPDX-License-Identifier: LGPL-3.0-only"],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", "Licensed under the Eclipse Public License, version 2.0.", "SPDX-License-Identifier: EPL-2.0"],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary", "SPDX-License-Identifier: Unlicense"],
    "Zlib": ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely", "SPDX-License-Identifier: Zlib"],
    "Artistic-2.0": ["This program is free software; you can redistribute it and/or modify it under the terms of the Artistic License 2.0.", "Released under the Artistic License 2.0.", "SPDX-License-Identifier: Artistic-2.0"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "ISC": ["Released under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "SPDX-License-Identifier: ISC"],
    "CC0-1.0": ["Dedicated to the public domain under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related rights to this work.", "SPDX-License-Identifier: CC0-1.0"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "Proprietary": ["All rights reserved.", "Copyright, all rights reserved. No part of this work may be reproduced without written permission.", "Proprietary and confidential. Unauthorized copying of this file is strictly prohibited."],
}
# Sentences about licences that grant none.
OTHER = ["You need a driving license to rent a car.", "The license fee is due every year.", "Her license was revoked by the board.", "The version of the software is old.", "The public is permitted to use the park.", "Terms and conditions apply to this offer.", "A fishing license is required in this county.", "Please read the terms of service before use.", "The general public was not informed.", "All is well that ends well.", "The rights of the author are reserved seats.", "He holds a pilot license, version of 1990.", "The apache helicopter landed on the field.", "She studied at MIT and licensed her patent.", "The creative commons of the village were crowded.", "A copy of the public record was free of charge.", "He was permitted to use and modify the source of the river.", "The conditions of sale are met by both parties.", "The Eclipse was visible to the general public."]
_WORD = re.compile(r"[^\W_]+(?:\.\d+)*")
_END = re.compile(r"\n")
_PARAGRAPH = re.compile(r"[^\n]*\S[^\n]*(?:\n[^\n]*\S[^\n]*)*")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def hashes(ws: list[str], cache: dict[str, int]) -> np.ndarray:
    if len(cache) >= CACHE_WORDS:
        cache.clear()
    out = []
    for w in ws:
        h = cache.get(w)
        if h is None:
            h = cache[w] = zlib.crc32(w.encode("utf-8", "surrogatepass"))
        out.append(h)
    return np.array(out, np.uint64)


def grams(h: np.ndarray) -> list[np.ndarray]:
    """Feature numbers of the 1-, 2- and 3-grams that begin at each word (with a mark of no word after the last)."""
    mark = np.append(h, np.full(2, np.uint64(0x5BD1E995)))
    mul = np.uint64(0x9E3779B97F4A7C15)
    one = h * mul
    two = (one ^ mark[1 : len(h) + 1]) * mul
    three = (two ^ mark[2 : len(h) + 2]) * mul
    return [(x >> np.uint64(48)).astype(np.int64) % FEATURES for x in (one, two, three)]


@dataclass
class LicenceModel:
    families: list[str]
    weights: np.ndarray  # features by classes; the last class is unknown
    bias: np.ndarray
    temperature: float
    threshold: float

    def __post_init__(self):
        self.most = (self.weights[:, :-1] - self.weights[:, -1:]).max(axis=1)  # what a feature can speak for any family, at most
        self.least = self.temperature * float(np.log(self.threshold / (1 - self.threshold))) - float((self.bias[:-1] - self.bias[-1]).max())

    def scored(self, h: np.ndarray, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First word of each window of a paragraph that a family may win, word after its last, that family's number and calibrated probability. Windows of all SIZES slide over the paragraph, and each line shorter than a window is one too; lines has their first words."""
        n, features = len(h), np.stack(grams(h))
        ends = np.append(lines[1:], n)
        short = ends - lines < WINDOW
        slid = [np.arange(0, max(1, n - size + step), step) for size, step in SIZES]
        starts = np.concatenate([*slid, lines[short]])
        stops = np.minimum(np.concatenate([*(x + size for x, (size, _) in zip(slid, SIZES)), ends[short]]), n)
        upto = np.r_[0, self.most[features].sum(axis=0).cumsum()]
        may = np.flatnonzero((upto[stops] - upto[starts]) / np.sqrt(3 * (stops - starts)) >= self.least - 1e-6)
        starts, stops = starts[may], stops[may]
        family, score = np.zeros(len(may), np.int64), np.zeros(len(may))
        for at in range(0, len(may), CHUNK):
            here = slice(at, at + CHUNK)
            size = stops[here] - starts[here]
            word = np.repeat(starts[here] - np.r_[0, size.cumsum()[:-1]], size) + np.arange(size.sum())
            z = np.add.reduceat(self.weights[features[0][word]] + self.weights[features[1][word]] + self.weights[features[2][word]], np.r_[0, size.cumsum()[:-1]], axis=0)
            z = (z / np.sqrt(3 * size)[:, None] + self.bias) / self.temperature
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            family[here], score[here] = p[:, :-1].argmax(axis=1), p[:, :-1].max(axis=1)
        won = score >= self.threshold
        return starts[won], stops[won], family[won], score[won]

    def notices(self, h: np.ndarray, lines: np.ndarray) -> list[tuple[int, float, int, int]]:
        """Family index, probability, first word and word after the last of every accepted stretch: of windows that overlap the likeliest counts (by tenths, then the longest, which sees more of a notice), and neighbours of one family are one stretch."""
        starts, stops, family, score = self.scored(h, lines)
        used, taken = np.zeros(len(h), bool), []
        for i in np.lexsort((starts, starts - stops, -np.floor(score * 10))).tolist():
            if not used[starts[i] : stops[i]].any():
                used[starts[i] : stops[i]] = True
                taken.append((int(starts[i]), int(stops[i]), int(family[i]), float(score[i])))
        out: list[tuple[int, float, int, int]] = []
        for a, b, own, x in sorted(taken):
            if out and out[-1][0] == own and a - out[-1][3] <= STEP:
                out[-1] = (own, max(x, out[-1][1]), out[-1][2], b)
            else:
                out.append((own, x, a, b))
        return out


def _varied(ws: list[str], rng: np.random.Generator, fill: list[str]) -> list[str]:
    out = [fill[rng.integers(len(fill))] if rng.random() < 0.04 else w for w in ws if len(ws) < 6 or rng.random() > 0.06]
    before, after = ([fill[i] for i in rng.integers(len(fill), size=int(rng.integers(0, 10)))] if rng.random() < 0.5 else [] for _ in range(2))
    return before + out + after


def _examples(windows: list[str], rng: np.random.Generator) -> list[tuple[np.ndarray, int, bool]]:
    """Features, class and whether the example's template (or window) is one of those held out."""
    families = sorted(TEMPLATES)
    fill = [w for p in windows for w in words(p)] or [w for p in OTHER for w in words(p)]
    cache: dict[str, int] = {}
    rows: list[tuple[np.ndarray, int, bool]] = []

    def add(ws: list[str], y: int, held: bool) -> None:
        if ws:
            rows.append((np.concatenate(grams(hashes(ws[:WINDOW], cache))), y, held))

    for y, family in enumerate(families):
        for j, template in enumerate(TEMPLATES[family]):
            for i in range(60):
                add(words(template) if i < 6 else _varied(words(template), rng, fill), y, j % 3 == 1)
    for i, p in enumerate([*OTHER * 30, *windows]):
        ws = _varied(words(p), rng, fill) if i < len(OTHER) * 10 else words(p)
        add(ws[: SIZES[i // 3 % len(SIZES)][0]], len(families), i % 3 == 1)
    return rows


def _fitted(rows: list[tuple[np.ndarray, int, bool]], k: int, rng: np.random.Generator, rounds: int = 4) -> tuple[np.ndarray, np.ndarray]:
    y = np.array([r[1] for r in rows])
    share = (len(y) / k / np.maximum(np.bincount(y, minlength=k), 1))[y].clip(0.2, 5)
    w, b = np.zeros((FEATURES, k)), np.zeros(k)
    square = np.full((FEATURES, 1), 1e-8)
    order = np.arange(len(rows))
    for _ in range(rounds):
        rng.shuffle(order)
        for i in order:
            x = rows[i][0]
            z = w[x].sum(axis=0) / np.sqrt(len(x)) + b
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            g = p * share[i] / np.sqrt(len(x))
            square[x, 0] += float((g**2).mean())  # an n-gram that the window repeats is moved once
            w[x] -= 0.15 * g / np.sqrt(square[x])
            b -= 0.01 * p * share[i]
    return w, b


def train(windows: list[str], seed: int = 1) -> LicenceModel:
    """Windows of the corpus (without notices, as far as known) -> model."""
    rng = np.random.default_rng(seed)
    families = sorted(TEMPLATES)
    rows, k = _examples(windows, rng), len(families) + 1
    held = [r for r in rows if r[2]]
    w, b = _fitted([r for r in rows if not r[2]], k, rng)
    z = np.array([w[x].sum(axis=0) / np.sqrt(len(x)) + b for x, _, _ in held])
    truth = np.array([y for _, y, _ in held])

    def soft(t: float) -> np.ndarray:
        e = np.exp((z - z.max(axis=1, keepdims=True)) / t)
        return e / e.sum(axis=1, keepdims=True)

    temperature = min(np.geomspace(0.25, 8, 40), key=lambda t: -np.log(soft(t)[np.arange(len(truth)), truth] + 1e-12).mean())
    p = soft(temperature)[:, :-1].max(axis=1)
    # the least threshold that lets at most one in a thousand of the unknown through, and not under a half
    threshold = float(max(0.5, np.quantile(p[truth == k - 1], 0.999)))
    w, b = _fitted(rows, k, rng)
    return LicenceModel(families, w, b, float(temperature), min(threshold, 0.95))


def _pairs(ws: list[str]) -> set[tuple[str, str]]:
    return set(zip(ws, ws[1:])) or {(w, "") for w in ws}


_PAIRS = {family: [(_pairs(words(t)), t) for t in ts] for family, ts in TEMPLATES.items()}


def likeness(family: str, ws: list[str]) -> float:
    """Largest share of a template's word pairs that the words have."""
    have = _pairs(ws)
    return max(len(p & have) / len(p) for p, _ in _PAIRS[family])


def compared(family: str, ws: list[str]) -> tuple[str, float]:
    """The family that the words are of by its templates, and its likeness: the predicted one, unless another's template has more of its word pairs there (notices that differ in a version's number)."""
    own = likeness(family, ws)
    best = max(_PAIRS, key=lambda f: likeness(f, ws)) if own >= CONFIRMED / 2 else family
    other = likeness(best, ws)
    return (best, other) if other > own else (family, own)


_SURE = re.compile(r"(?i)licen[sc]e|copyright|rights reserved|spdx|public domain")
_WINDOWS = pa.schema([("h", pa.int64()), ("k", pa.int32()), ("text", pa.string())])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """DRAWN windows from anywhere in each text, without those that may be of a notice."""
    for batch in batches:
        for h, text in zip(*(batch.column(i).to_pylist() for i in range(2))):
            rng, ws = np.random.default_rng(h & (2**63 - 1)), words(text)
            for k in range(DRAWN):
                at = int(rng.integers(0, max(1, len(ws) - WINDOW)))
                window = " ".join(w[:100] for w in ws[at : at + WINDOW])
                if window and not _SURE.search(window):
                    yield h, k, window


def fit(documents: DataFrame) -> LicenceModel:
    """The model for a corpus: the unknown class is trained on DRAWN windows of each of about SAMPLE documents, by the hash of id and text. Repeated rows count once."""
    keyed = documents.where("text is not null").select(F.xxhash64("doc_id", F.col("text").cast("string")).alias("h"), F.col("text").cast("string"))
    n = keyed.count()
    drawn = keyed.where(F.pmod("h", F.lit(1 << 30)) / (1 << 30) < SAMPLE / max(n, 1))
    cut = drawn.mapInArrow(lambda b: row_batches(_cut(b), _WINDOWS), "h long, k int, text string").distinct()
    return train([r["text"] for r in cut.orderBy(F.shiftrightunsigned("h", 30), "h", "k").limit(2 * SAMPLE * DRAWN).collect()])


_OUT = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("family", pa.string()), ("score", pa.float64()), ("likeness", pa.float64()), ("confirmed", pa.bool_())])


def paragraphs(text: str) -> Iterator[tuple[np.ndarray, list[tuple[int, int, str]]]]:
    """Of each run of lines that aren't blank: the first words of its lines, and the words with their places in the text."""
    for m in _PARAGRAPH.finditer(text):
        found = [(m.start() + w.start(), m.start() + w.end(), w[0].lower()) for w in _WORD.finditer(m[0])]
        if found:
            ends = [m.start() + x.start() for x in _END.finditer(m[0])]
            yield np.unique(np.searchsorted([a for a, _, _ in found], [m.start(), *ends])[: len(ends) + 1].clip(max=len(found) - 1)), found


def scan(documents: DataFrame, model: LicenceModel) -> DataFrame:
    """documents(doc_id, text) -> a row per stretch of a paragraph that the classifier gives to a licence family.

    doc_id, start and length of the stretch in code points, family, score (calibrated probability of its best window), likeness
    to the nearest template (with STEP words around), confirmed. Null, empty and wordless texts give no rows, repeated rows
    give theirs each; an empty table gives no rows.
    """

    def rows(batches: Iterator[pa.RecordBatch]):
        cache: dict[str, int] = {}
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for lines, found in paragraphs(text or ""):
                    ws = [w for _, _, w in found]
                    for family, p, a, b in model.notices(hashes(ws, cache), lines):
                        name, like = compared(model.families[family], ws[max(0, a - STEP) : b + STEP])
                        yield doc, found[a][0], found[b - 1][1] - found[a][0], name, p, like, like >= CONFIRMED

    source = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return source.mapInArrow(lambda b: row_batches(rows(b), _OUT), "doc_id long, start long, length long, family string, score double, likeness double, confirmed boolean")


def licences(documents: DataFrame, model: LicenceModel) -> DataFrame:
    """documents -> per (doc_id, family) with a confirmed notice: doc_id, family, n_notices, score, likeness (the largest of each)."""
    found = scan(documents, model).where("confirmed")
    return found.groupBy("doc_id", "family").agg(F.count("*").alias("n_notices"), F.max("score").alias("score"), F.max("likeness").alias("likeness"))
