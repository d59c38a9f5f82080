"""License scans: a trained paragraph classifier names the licence family, a template comparison confirms it."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import WORD, slices

#: Short notices as they are found in files, by family (SPDX names); our own selection of public wordings.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "MIT": (
        "Released under the MIT License.",
        "This software is distributed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "You can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    ),
    "LGPL": (
        "This library is licensed under the GNU Lesser General Public License.",
        "This library is free software; you can redistribute it under the terms of the GNU Lesser General Public License, version 2.1.",
    ),
    "AGPL-3.0": (
        "This program is licensed under the GNU Affero General Public License, version 3.",
        "You can redistribute it under the terms of the GNU Affero General Public License as published by the Free Software Foundation.",
    ),
    "BSD": (
        "Use of this source code is governed by a BSD-style license.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Released under the BSD 3-Clause License.",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
    ),
    "ISC": (
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    ),
    "CC-BY": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "CC-BY-SA": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "CC-BY-NC": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "CC-BY-ND": (
        "Licensed under CC BY-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    ),
    "CC0": (
        "Released under CC0 1.0 Universal.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0.",
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software.",
    ),
}
FAMILIES = tuple(TEMPLATES)
#: Paragraphs of the corpus that the unknown class is learnt from, at most; taken by the least hash of doc_id.
SAMPLE = 2000
#: Part of a template's word pairs that a confirmed paragraph has, at least.
LIKENESS = 0.6
#: Part of unknown examples held out that may be named, at most: sets the confidence asked for.
MISTAKES = 0.001


def tokens(text: str) -> list[str]:
    return [w for w in (x.strip(".,;:!?\"'()[]*#") for x in text.lower().split()) if w]


def grams(words: list[str]) -> list[str]:
    return words + [f"{a} {b}" for a, b in zip(words, words[1:])]


class Model(NamedTuple):
    column: dict[str, int]  #: the n-grams of the templates; no others weigh anything
    weights: np.ndarray  #: a column per family, the last for unknown
    bias: np.ndarray
    temperature: float
    least: float  #: confidence below which a paragraph is unknown

    def probabilities(self, rows: list[list[str]]) -> np.ndarray:
        out = np.stack([self._logits(r) for r in rows]) / self.temperature
        out = np.exp(out - out.max(1, keepdims=True))
        return out / out.sum(1, keepdims=True)

    def _logits(self, words: list[str]) -> np.ndarray:
        own = [self.column[g] for g in set(grams(words)) if g in self.column]
        return self.weights[own].sum(0) / max(1.0, len(own)) ** 0.5 + self.bias


def examples(rng: np.random.Generator, copies: int = 40) -> tuple[list[list[str]], np.ndarray]:
    """Template paragraphs as they are met: words lost, cut short, with other words before or behind; and, as
    unknown, the templates' words out of order or a few of them only."""
    rows, labels = [], []
    pool = [w for family in TEMPLATES.values() for t in family for w in tokens(t)]
    for label, family in enumerate(TEMPLATES.values()):
        for template in family:
            words = tokens(template)
            for k in range(copies):
                own = [w for w in words if k == 0 or rng.random() > 0.08]
                if len(own) > 12 and k % 3 == 1:
                    a = rng.integers(0, len(own) // 3 + 1)
                    own = own[a : a + 2 * len(words) // 3]
                if k % 2:
                    filler = [f"x{rng.integers(1000)}" for _ in range(rng.integers(0, 12))]
                    own = filler + own if k % 4 == 1 else own + filler
                rows.append(own)
                labels.append(label)
            for _ in range(copies // 2):
                rows.append(list(rng.choice(pool, rng.integers(1, 12))))
                labels.append(len(FAMILIES))
    return rows, np.array(labels)


def train(unknown: list[str], seed: int = 5) -> Model:
    """Multinomial logistic regression over sparse word unigrams and bigrams, by gradient descent in numpy.

    A quarter is held out: the temperature is the one that makes its likelihood largest, and ``least`` the
    confidence that at most MISTAKES of its unknown examples reach."""
    rng = np.random.default_rng(seed)
    rows, labels = examples(rng)
    others = [t for t in map(tokens, unknown) if max(map(template_likeness, [t] * len(FAMILIES), FAMILIES)) < LIKENESS / 2]
    rows, labels = rows + others, np.concatenate([labels, np.full(len(others), len(FAMILIES))])
    column: dict[str, int] = {}
    for family in TEMPLATES.values():
        for template in family:
            for g in grams(tokens(template)):
                column.setdefault(g, len(column))
    x = np.zeros((len(rows), len(column)), np.float32)
    for i, words in enumerate(rows):
        own = [column[g] for g in set(grams(words)) if g in column]
        x[i, own] = 1 / max(1, len(own)) ** 0.5
    y = np.eye(len(FAMILIES) + 1, dtype=np.float32)[labels]
    held = rng.random(len(rows)) < 0.25
    weights, bias = np.zeros((len(column), len(FAMILIES) + 1), np.float32), np.zeros(len(FAMILIES) + 1, np.float32)
    speed, speed_bias = np.zeros_like(weights), np.zeros_like(bias)
    a, b = x[~held], y[~held]
    for _ in range(300):
        p = _softmax(a @ weights + bias)
        speed = 0.9 * speed - 4.0 * (a.T @ (p - b) / len(a) + 1e-5 * weights)
        speed_bias = 0.9 * speed_bias - 4.0 * (p - b).mean(0)
        weights, bias = weights + speed, bias + speed_bias
    logits, truth = x[held] @ weights + bias, labels[held]
    temperature = min((0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0), key=lambda t: -np.log(_softmax(logits / t)[np.arange(len(truth)), truth] + 1e-12).mean())
    named = np.sort(_softmax(logits[truth == len(FAMILIES)] / temperature)[:, :-1].max(1))[::-1]
    least = float(named[int(MISTAKES * len(named))]) if len(named) else 0.5
    return Model(column, weights, bias, temperature, min(0.9, max(0.5, least + 1e-6)))


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(1, keepdims=True))
    return x / x.sum(1, keepdims=True)


_PAIRS = {name: [set(zip(t, t[1:])) for t in map(tokens, family)] for name, family in TEMPLATES.items()}


def template_likeness(words: list[str], family: str) -> float:
    """The largest part of a template's pairs of neighbouring words that the paragraph has."""
    own = set(zip(words, words[1:]))
    return max(len(own & pairs) / len(pairs) for pairs in _PAIRS[family])


def fitted(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from the templates, and for the unknown class from a paragraph of each of ``sample`` documents."""
    first = F.get(F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD)), F.lit(0))
    rows = docs.filter("text is not null").select("doc_id", first.alias("p")).orderBy(F.xxhash64("doc_id"), "doc_id", "p").limit(sample)
    return train([r.p for r in rows.collect() if r.p])


def license_paragraphs(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """One row per paragraph (line) that is taken for a licence: doc_id, paragraph (from 0), family, confidence,
    likeness (to the nearest template of the family), confirmed (likeness of LIKENESS or more).

    Every line of every whole text is classified. A line without any pair of neighbouring words of a template can't
    be confirmed and is unknown. Null and empty texts have no paragraphs; equal rows are reported each."""
    docs = docs.select("doc_id", "text")
    model = model or fitted(docs)
    # the rarest part of the work first: lines without one of the templates' telling words are unknown
    telling = "|".join(sorted({w for t in TEMPLATES.values() for x in t for w in tokens(x) if len(w) > 3 and w.isalpha()} | {"cc", "mit", "isc", "bsd", "gnu", "cc0"}))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            lines = pc.split_pattern(pc.fill_null(part.column("text"), ""), "\n")
            row = pc.list_parent_indices(lines).to_numpy()
            flat = pc.list_flatten(lines)
            number = np.arange(len(row)) - np.searchsorted(row, row)
            hit = np.flatnonzero(pc.match_substring_regex(flat, rf"\b({telling})\b", ignore_case=True).to_numpy(zero_copy_only=False))
            words = [tokens(t) for t in flat.take(pa.array(hit)).to_pylist()]
            some = [k for k, w in enumerate(words) if any(f"{a} {b}" in model.column for a, b in zip(w, w[1:]))]
            out = []
            if some:
                odds = model.probabilities([words[k] for k in some])
                for k, p in zip(some, odds, strict=True):
                    best = int(np.argmax(p))
                    if best < len(FAMILIES) and p[best] >= model.least:
                        like = template_likeness(words[k], FAMILIES[best])
                        out.append((int(row[hit[k]]), int(number[hit[k]]), FAMILIES[best], float(p[best]), like, like >= LIKENESS))
            rows = list(zip(*out, strict=True)) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").take(pa.array(rows[0], pa.int64())), *[pa.array(c, t) for c, t in zip(rows[1:], (pa.int64(), pa.string(), pa.float64(), pa.float64(), pa.bool_()), strict=True)]],
                names=["doc_id", "paragraph", "family", "confidence", "likeness", "confirmed"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(scan, f"doc_id {kind}, paragraph long, family string, confidence double, likeness double, confirmed boolean")
