"""Licence scan: a trained paragraph classifier with a calibrated unknown class.

A paragraph is a block of lines between blank lines, so that a notice may be wrapped. It is read in windows of
``WINDOW`` words that start every ``STEP`` words: each run of words as long as the longest template lies whole in one
of them.

Training rows are made from the licence templates and a bounded sample of the corpus's own distinct windows
(``SAMPLE_ROWS``, those with the smallest hashes, none above ``LONGEST`` characters): two fifths of them, without licence
words, are examples of ``none``; a fifth has licence words but little of any template, and is ``none`` too; the others
carry a template, with words dropped, between the words of the window. Sparse binary word n-grams feed a
multinomial logistic regression with an elastic net. One fifth of the rows, held out, gives the temperature of
the probabilities and, for a licence and for ``none``, the probability below which a prediction is not sure. A sure
prediction is confirmed by comparing the window with the templates of the family; one that is not sure, or without enough
of any template, is ``unknown``. A ``none`` that is not sure is ``unknown`` where half as much of a template is there.

Every window of every text is scored; a paragraph has a row for each family confirmed in it, by its most probable
window, or else one for ``unknown``. Defined results: null or empty text has no paragraphs; a paragraph without known
n-grams is ``none``; repeated rows are scanned each for itself; no documents give no rows. Other columns are not
carried.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer, StringIndexer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import plain, stored

SAMPLE_ROWS, LONGEST, MAX_FEATURES, CONFIRM_SHARE, KEEP_RATE = 6000, 20_000, 20_000, 0.6, 0.995
NONE, UNKNOWN = "none", "unknown"

# Wordings of licence notices by family.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files, to deal in the Software without restriction."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "You may not use this file except in compliance with the License. You may obtain a copy of the License."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                "General Public License as published by the Free Software Foundation, either version 3 of the License."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted."),
    ("BSD", "Licensed under the BSD 3-Clause License."),
    ("CC-BY", "Licensed under CC BY 4.0."),
    ("CC-BY", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0", "To the extent possible under law, the author has waived all copyright and related rights to this work. CC0 1.0."),
    ("proprietary", "All rights reserved."),
    ("proprietary", "Copyright. All rights reserved. No part of this publication may be reproduced without permission."),
]
PLAIN = ("The weather was fine and the train left on time.", "She read the second chapter aloud to the children.",
         "Add the flour and stir until the dough is smooth.", "The committee will meet again at the end of the month.")
MENTIONS = ("He lost his driving license on the way home.", "The pub was granted a licence to sell beer until midnight.",
            "An apache scout rode ahead of the herd.", "She studied physics at MIT before she moved to Geneva.",
            "The gnu and the zebra graze together in the dry season.", "The singer owns the copyright of her early songs.",
            "Permission is needed to climb the tower.", "The fishing licences of the village are sold at the post office.")
CUE = "licen[cs]|copyright|rights reserved|public domain|redistribut|permission is|creative commons|gnu|mit|apache|bsd"
_WORD = re.compile(r"\w+")
_CUE = re.compile(rf"\b(?:{CUE})", re.IGNORECASE)
_BLANK = re.compile(r"\n[ \t\r\x0b\x0c]*(?=\n)")
_LONGEST_TEMPLATE = max(len(_WORD.findall(wording)) for _, wording in TEMPLATES)
WINDOW, STEP = 3 * _LONGEST_TEMPLATE, 2 * _LONGEST_TEMPLATE


def grams(text: str) -> list[str]:
    """Words and word pairs of a paragraph, lower-cased; a hyphen or point ends a word."""
    words = _WORD.findall(text.lower())
    return [*words, *map(" ".join, zip(words, words[1:]))]


def windows(text: str | None):
    """(paragraph, window) of a text, paragraphs with words counted from 0."""
    number = 0
    for block in _BLANK.split(text or ""):
        words = block.split()
        for at in range(0, max(1, len(words) - WINDOW + STEP), STEP) if words else ():
            yield number, " ".join(words[at:at + WINDOW])
        number += bool(words)


_TEMPLATE_GRAMS: dict[str, list[frozenset]] = {}
for _family, _wording in TEMPLATES:
    _TEMPLATE_GRAMS.setdefault(_family, []).append(frozenset(grams(_wording)))


def template_share(found: set[str], family: str | None = None) -> float:
    """The largest share of a template's n-grams that is there, of one family or of all."""
    return max(len(t & found) / len(t) for f, ts in _TEMPLATE_GRAMS.items() if family in (None, f) for t in ts)


def _sample(docs: DataFrame, rows: int) -> list[tuple[str, bool]]:
    """At most ``rows`` distinct windows (text, has a licence word), a quarter of them with one: the smallest by hash.
    The first pass counts those in the lowest sixteenth of the hashes, the second brings those below a hash that some four
    times as many are expected to pass."""
    lowest = {False: 2 ** 59 - 1, True: 2 ** 59 - 1}

    def read(batches, limits):
        widest = max(limits.values())
        for batch in batches:
            out = []
            for text in batch["text"]:
                for _, window in windows(text):
                    h = xxhash.xxh3_64_intdigest(window) >> 1
                    if h <= widest and len(window) <= LONGEST and h <= limits[cue := bool(_CUE.search(window))]:
                        out.append((h, cue, window))
            yield plain(pd.DataFrame(out, columns=["h", "cue", "window"]), "window")

    shape = "h long, cue boolean, window string"
    counts = docs.select("text").mapInPandas(lambda b: read(b, lowest), shape).groupBy("cue").agg(F.approx_count_distinct("h").alias("n"))
    there = {r["cue"]: 16 * r["n"] for r in counts.collect()}
    want = {False: rows - rows // 4, True: rows // 4}
    limits = {cue: int(min(1.0, 4 * n / max(1, there.get(cue, 0))) * (2 ** 63 - 1)) for cue, n in want.items()}
    near = stored(docs.select("text").mapInPandas(lambda b: read(b, limits), shape).distinct())
    picked = [near.where(F.col("cue") == cue).orderBy("h", "window").limit(n).collect() for cue, n in want.items()]
    return [(r["window"], r["cue"]) for part in picked for r in part]


def _examples(sample: list[tuple[str, bool]]) -> list[tuple[str, str]]:
    """Training rows from windows. What is dropped and added follows from the window's place in the sample."""
    out, i = [], 0
    for text, cue in sample:
        if cue:
            if template_share(set(grams(text))) < CONFIRM_SHARE / 2:
                out.append((text, NONE))
            continue
        words, i = text.split(), i + 1
        if i % 2:
            out.append((text, NONE))
            continue
        rng = np.random.default_rng(i)
        family, wording = TEMPLATES[(i // 2) % len(TEMPLATES)]
        notice = wording.split()
        if len(notice) > 6:
            notice = [w for w in notice if rng.random() > 0.08]
        room = rng.integers(0, WINDOW - len(notice)) * (rng.random() < 0.7)
        before = rng.integers(0, room + 1)
        out.append((" ".join([*words[:before], *notice, *words[before:room]]), family))
    return out


def training_rows(docs: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(grams, label, held_out) from a bounded sample of the windows, the same for the same corpus."""
    always = [(x, False) for x in PLAIN * 2 * len(TEMPLATES)] + [(x, True) for x in MENTIONS * 4]
    made = _examples(_sample(docs, rows) + always)
    table = [(grams(t), label, xxhash.xxh3_64_intdigest(f"{i} {t}") % 5 == 0) for i, (t, label) in enumerate(made)]
    return docs.sparkSession.createDataFrame(table, "grams array<string>, label string, held_out boolean")


def _temperature(scores: np.ndarray, truth: np.ndarray) -> float:
    """The temperature with the smallest log loss on the held-out rows."""
    def loss(t: float) -> float:
        z = scores / t
        z = z - z.max(axis=1, keepdims=True)
        return float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(z)), truth]).mean())

    return min(np.geomspace(0.25, 8, 41), key=loss)


class Classifier:
    """Weights of the fitted model in a form that a task can use: a bounded vocabulary."""

    def __init__(self, vocabulary: list[str], labels: list[str], weights: np.ndarray, bias: np.ndarray,
                 temperature: float = 1.0, least: float = 0.0, least_none: float = 0.0):
        self.place = {g: i for i, g in enumerate(vocabulary)}
        self.known = frozenset(vocabulary)
        self.labels, self.weights, self.bias = labels, np.ascontiguousarray(weights.T), bias
        self.temperature, self.least, self.least_none = temperature, least, least_none
        self.none = labels.index(NONE)

    def scores(self, found: list[str]) -> np.ndarray:
        at = [self.place[g] for g in self.known.intersection(found)]
        return self.bias + self.weights[at].sum(axis=0) if at else self.bias

    def judge(self, text: str) -> tuple[str, str, float, float] | None:
        """(family or unknown, predicted family, probability, template share), None for ``none``."""
        found = grams(text)
        z = self.scores(found) / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        none = bool(p.argmax() == self.none)
        if none and p[self.none] >= self.least_none:
            return None
        p[self.none] = 0
        best = int(p.argmax())
        family = self.labels[best]
        share = template_share(set(found), family)
        if none and share < CONFIRM_SHARE / 2:
            return None
        sure = not none and p[best] >= self.least and share >= CONFIRM_SHARE
        return (family if sure else UNKNOWN), family, float(p[best]), share

    def families(self, text: str | None) -> list[tuple]:
        """(paragraph, family or unknown, predicted family, probability, template share) of a whole text."""
        best: dict[tuple[int, str], tuple] = {}
        for number, window in windows(text):
            said = self.judge(window)
            if said and (old := best.get((number, said[0]))) is None or said and said[2:] > old[2:]:
                best[number, said[0]] = said
        sure = {number for number, family in best if family != UNKNOWN}
        return [(number, *said) for (number, family), said in sorted(best.items()) if family != UNKNOWN or number not in sure]


def fit(docs: DataFrame, rows: int = SAMPLE_ROWS) -> Classifier:
    examples = stored(training_rows(docs, rows))
    counter = CountVectorizer(inputCol="grams", outputCol="features", binary=True, minDF=2.0, vocabSize=MAX_FEATURES)
    names = StringIndexer(inputCol="label", outputCol="y", stringOrderType="alphabetAsc").fit(examples)
    ready = names.transform(examples)
    words = counter.fit(ready.where("NOT held_out"))
    ready = words.transform(ready)
    model = LogisticRegression(featuresCol="features", labelCol="y", family="multinomial", maxIter=60,
                               regParam=0.002, elasticNetParam=0.3).fit(ready.where("NOT held_out"))
    made = Classifier(words.vocabulary, list(names.labels), model.coefficientMatrix.toArray(),
                      np.array(model.interceptVector.toArray()))
    held = ready.where("held_out").select("grams", "y").toPandas()  # a fifth of the bounded sample
    scores = np.array([made.scores(g) for g in held["grams"]])
    truth = held["y"].to_numpy("int64")
    made.temperature = _temperature(scores, truth)
    z = np.exp(scores / made.temperature - (scores / made.temperature).max(axis=1, keepdims=True))
    right, top = scores.argmax(axis=1) == truth, z.max(axis=1) / z.sum(axis=1)
    keep = lambda p: float(np.quantile(p, 1 - KEEP_RATE)) if len(p) else 0.5
    made.least, made.least_none = keep(top[right & (truth != made.none)]), keep(top[right & (truth == made.none)])
    return made


def scan(docs: DataFrame, classifier: Classifier) -> DataFrame:
    """A row per paragraph and licence: doc_id, paragraph (from 0), family, predicted, probability, template_share."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"], batch["text"]):
                rows += [(doc, *said) for said in classifier.families(text)]
            names = ["doc_id", "paragraph", "family", "predicted", "probability", "template_share"]
            yield plain(pd.DataFrame(rows, columns=names), "doc_id", "family", "predicted")

    done = docs.select(F.col("doc_id").cast("string"), "text").mapInPandas(
        run, "doc_id string, paragraph long, family string, predicted string, probability double, template_share double")
    return done.withColumn("doc_id", F.col("doc_id").cast(kind))
