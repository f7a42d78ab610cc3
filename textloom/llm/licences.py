"""Licence scans with DataFrame functions only.

A line, or a few wrapped lines joined, is classified by multinomial logistic regression on its word 1- to
3-grams. The model is trained here from the notices below and from paragraphs that only
talk about licences, then its probabilities are calibrated with a temperature; a
paragraph is of a family if the calibrated probability says so and the words of one of
the family's notices confirm it. Everything else is unknown.

Scoring stays in one projection: no join, no exchange, no Python on executors. Weights and
notices travel as constants of the plan.
"""

from __future__ import annotations

import json
import math
import random
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Probability from which a family is accepted, and the share of a notice's words that must be there.
ACCEPT, CONFIRM = 0.5, 0.6
#: Most lines over which a notice is wrapped.
WRAPPED = 6
#: Lines with any of these are listed even if no family is confirmed.
ANCHOR = r"(?i)licen[cs]e|copyright|rights reserved|public domain|redistribution"

#: How each licence family is announced.
NOTICES = {
    "apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", "This project is released under the Apache 2.0 license.", "SPDX-License-Identifier: Apache-2.0"],
    "mit": ["Released under the MIT License.", "This software is distributed under the terms of the MIT license.", "Licensed under the MIT license.", "SPDX-License-Identifier: MIT"],
    "gpl": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.", "Licensed under the GPL version 2 or later.", "SPDX-License-Identifier: GPL-3.0-or-later"],
    "lgpl": ["This library is licensed under the GNU Lesser General Public License, version 2.1.", "Licensed under the LGPL version 3 license.", "SPDX-License-Identifier: LGPL-2.1-only"],
    "agpl": ["This work is licensed under the GNU Affero General Public License, version 3.", "Licensed under the AGPL version 3 license.", "SPDX-License-Identifier: AGPL-3.0-only"],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.", "Released under the BSD 3-Clause License.", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", "SPDX-License-Identifier: BSD-3-Clause"],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0.", "Licensed under the MPL 2.0 license.", "SPDX-License-Identifier: MPL-2.0"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Content available under the CC BY-NC-SA 4.0 license."],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "Text is available under the CC BY-SA 4.0 license."],
    "public-domain": ["This work has been released into the public domain.", "This is free and unencumbered software released into the public domain.", "To the extent possible under law, all copyright has been waived under CC0 1.0; the work is in the public domain."],
    "proprietary": ["All rights reserved.", "Copyright the authors. All rights reserved.", "Confidential and proprietary. All rights reserved. No part of this publication may be reproduced without written permission."],
}
#: Paragraphs that mention the subject without being a notice.
OTHERS = [
    "He renewed his driving licence last week.", "The restaurant applied for a liquor license in the spring.", "Copyright law protects authors for many years.", "The city issued a building license to the owner of the house.", "A lecture on public domain music was held at the library.", "You need a license plate and a registration to drive this car.", "The court heard a case about copyright and parody.", "Redistribution of income was the topic of the debate.",
    "The licence fee pays for radio and television.", "She lost her fishing license on the way to the lake.", "The minister defended the redistribution of land.", "They argued about the license for hours.", "Poetic license lets a writer bend the rules.", "Students asked which license to choose for their project.", "An open letter about software and copyright was published.", "The museum placed some pictures in the collection.",
    "The weather in the north was cold and the roads were closed.", "Please read the manual before you start the machine.", "The new version of the program is faster than the last one.", "A general question about public transport in the city.", "Work on the bridge is expected to last until the summer.", "The terms of the agreement were not made public.", "Free software was the subject of the talk.", "The committee met in the old town hall.",
]

_WORD = r"[a-z0-9]+(?:[.+-][a-z0-9]+)*"


def words_of(text: str) -> list[str]:
    return re.findall(_WORD, text.lower())


def grams_of(words: list[str]) -> set[str]:
    return {" ".join(words[k : k + n]) for n in (1, 2, 3) for k in range(len(words) - n + 1)}


def gate() -> str:
    """A pattern that every paragraph with CONFIRM of a notice's words matches.

    Of each notice's m words so many are taken (the longest) that fewer than CONFIRM * m are left without them.
    """
    some = set()
    for text in (t for ts in NOTICES.values() for t in ts):
        words = sorted(set(words_of(text)), key=lambda w: (-len(w), w))
        some.update(words[: len(words) - math.ceil(CONFIRM * len(words)) + 1])
    # a pattern inside another one's words is enough for both
    least = sorted(w for w in some if not any(v != w and v in w for v in some))
    return "(?i)" + "|".join(re.escape(w) for w in least)


class Classifier:
    """Weights by feature, a bias for each class and the calibrated temperature; class 0 is unknown."""

    def __init__(self, seed: int = 1, rounds: int = 30):
        self.classes = ["unknown", *NOTICES]
        rng = random.Random(seed)
        rows = [(k, t) for k, name in enumerate(self.classes) for t in NOTICES.get(name, OTHERS if not k else [])]
        fit = [(k, grams_of(self._noisy(t, rng, part))) for k, t in rows for part in range(8 if k else 14)]
        held = [(k, grams_of(self._noisy(t, rng, part))) for k, t in rows for part in range(3)]
        self.weights: dict[str, list[float]] = {}
        self.bias = [0.0] * len(self.classes)
        self.temperature = 1.0
        for turn in range(rounds):
            rng.shuffle(fit)
            rate = 0.5 / (1 + 0.1 * turn)
            for k, features in fit:
                p = self.probabilities(features)
                for c in range(len(p)):
                    step = rate * ((c == k) - p[c])
                    if abs(step) < 1e-4:
                        continue
                    self.bias[c] += 0.1 * step
                    for f in features:
                        self.weights.setdefault(f, [0.0] * len(p))[c] += step / math.sqrt(len(features))
        # features that only the foreign words brought are dropped
        real = set().union(*(grams_of(words_of(t)) for _, t in rows))
        self.weights = {f: [round(x, 4) for x in w] for f, w in self.weights.items() if f in real and max(map(abs, w)) >= 0.05}
        # the temperature under which held-out variants are most likely
        loss = {}
        for t in (0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0):
            self.temperature = t
            loss[t] = -sum(math.log(max(self.probabilities(f)[k], 1e-12)) for k, f in held)
        self.temperature = min(loss, key=loss.get)

    @staticmethod
    def _noisy(text: str, rng: random.Random, part: int) -> list[str]:
        """Variants: the text itself, and the text with words lost and foreign words around it."""
        words = words_of(text)
        if part:
            if len(words) > 4:
                words = [w for w in words if rng.random() > 0.08]
            foreign = ["".join(rng.choice("aeiounrstlh") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(0, 6))]
            cut = rng.randint(0, len(foreign))
            words = foreign[:cut] + words + foreign[cut:]
        return words

    def probabilities(self, features) -> list[float]:
        # features are summed in a fixed order, which the DataFrame form repeats
        scale = 1 / math.sqrt(max(len(features), 1))
        z = list(self.bias)
        for f in sorted(features):
            w = self.weights.get(f)
            if w:
                for c, x in enumerate(w):
                    z[c] += x * scale
        top = max(z)
        e = [math.exp((x - top) / self.temperature) for x in z]
        return [x / sum(e) for x in e]

    def classify(self, paragraph: str) -> tuple[str, float, float]:
        """(family or unknown, calibrated probability of the best family, share of a notice that is there)."""
        words = words_of(paragraph)
        p = self.probabilities(grams_of(words))
        best = max(range(1, len(p)), key=lambda c: (p[c], -c))
        family = self.classes[best]
        share = max(len(set(words) & set(words_of(t))) / len(set(words_of(t))) for t in NOTICES[family])
        return (family if p[best] >= ACCEPT and share >= CONFIRM else "unknown"), p[best], share


_trained: list[Classifier] = []


def classifier() -> Classifier:
    if not _trained:
        _trained.append(Classifier())
    return _trained[0]


def classify_paragraph(paragraph: Column, model: Classifier) -> Column:
    """struct(family, probability, share) of a paragraph column."""
    weights = F.from_json(F.lit(json.dumps(model.weights)), "map<string,array<double>>")
    notices = F.from_json(F.lit(json.dumps([[sorted(set(words_of(t))) for t in NOTICES[c]] for c in model.classes[1:]])), "array<array<array<string>>>")
    bias = F.from_json(F.lit(json.dumps(model.bias)), "array<double>")
    classes = F.from_json(F.lit(json.dumps(model.classes[1:])), "array<string>")

    def of_words(words: Column) -> Column:
        n = F.size(words)
        runs = lambda k: F.when(n >= k, F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.array_join(F.slice(words, i, k), " "))).otherwise(F.array().cast("array<string>"))
        return F.array_distinct(F.concat(words, runs(2), runs(3)))

    def scored(words: Column) -> Column:
        grams = of_words(words)
        scale = 1 / F.sqrt(F.greatest(F.size(grams), F.lit(1)).cast("double"))
        zero = F.lit([0.0] * len(model.classes))
        used = F.array_sort(F.array_intersect(grams, F.map_keys(weights)))
        total = F.aggregate(used, bias, lambda acc, g: F.zip_with(acc, F.coalesce(F.element_at(weights, g), zero), lambda a, b: a + b * scale))
        return F.struct(words.alias("words"), total.alias("z"))

    def soft(x: Column) -> Column:
        e = F.transform(x["z"], lambda z: F.exp((z - F.array_max(x["z"])) / model.temperature))
        return F.struct(x["words"].alias("words"), F.transform(F.slice(e, 2, len(model.classes) - 1), lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, b: a + b)).alias("p"))

    def best(x: Column) -> Column:
        return F.struct(x["words"].alias("words"), F.array_max(x["p"]).alias("p"), F.array_position(x["p"], F.array_max(x["p"])).cast("int").alias("at"))

    def told(x: Column) -> Column:
        share = F.array_max(F.transform(F.element_at(notices, x["at"]), lambda t: F.size(F.array_intersect(x["words"], t)) / F.size(t)))
        family = F.when((x["p"] >= ACCEPT) & (share >= CONFIRM), F.element_at(classes, x["at"])).otherwise("unknown")
        return F.struct(family.alias("family"), x["p"].alias("probability"), share.alias("share"))

    # each step is a transform over one element, so that its result is computed once
    step = F.array(F.regexp_extract_all(F.lower(paragraph), F.lit(_WORD), 0))
    for fn in (scored, soft, best, told):
        step = F.transform(step, fn)
    return F.element_at(step, 1)


def confirmable(paragraph: Column) -> Column:
    """Whether CONFIRM of the words of some notice are there, without the model: no other paragraph gets a family."""
    sets = [sorted(set(words_of(t))) for ts in NOTICES.values() for t in ts]
    notices = F.from_json(F.lit(json.dumps(sets)), "array<array<string>>")
    every = F.from_json(F.lit(json.dumps(sorted(set().union(*map(set, sets))))), "array<string>")
    least = min(next(n for n in range(len(t) + 1) if n / len(t) >= CONFIRM) for t in sets)
    step = F.array(F.array_intersect(F.regexp_extract_all(F.lower(paragraph), F.lit(_WORD), 0), every))
    return paragraph.rlike(gate()) & F.exists(step, lambda w: (F.size(w) >= least) & F.exists(notices, lambda t: F.size(F.array_intersect(t, w)) / F.size(t) >= CONFIRM))


def scan_licences(docs: DataFrame, column: str = "text") -> DataFrame:
    """docs with the column `licences`: the classified paragraphs of each text, in order.

    `licences` is an array of (line, family, probability, share): the lines with an ANCHOR
    word, other lines of a family, and notices that are wrapped over 2 to WRAPPED lines
    with no blank line between them (line is then the first one, and lines of a family of
    their own are not joined). family is "unknown" where the calibrated model or the
    notices do not confirm one. Null, empty and other texts without such a line have an
    empty array. Rows are independent of each other, so repeated rows, null ids and extra
    columns pass through; a column named licences is replaced.
    """
    model = classifier()
    text = F.col(column).cast("string")
    kind = "array<struct<line:bigint,family:string,probability:double,share:double>>"
    likely = lambda x: x.rlike(ANCHOR) | confirmable(x)
    known = lambda x: x["c"]["family"] != "unknown"
    flat = lambda found: F.transform(found, lambda x: F.struct(x["line"].alias("line"), x["c"]["family"].alias("family"), x["c"]["probability"].alias("probability"), x["c"]["share"].alias("share"))).cast(kind)

    def classified(rows: Column) -> Column:
        told = F.transform(rows, lambda x: F.struct(x["line"].alias("line"), x["last"].alias("last"), x["paragraph"].rlike(ANCHOR).alias("anchored"), classify_paragraph(x["paragraph"], model).alias("c")))
        return F.filter(told, lambda x: x["anchored"] | known(x))

    def wrapped(lines: Column, own: Column) -> Column:
        """Notices over several lines, the first and shortest of those that overlap."""
        closed = F.transform(F.filter(own, known), lambda x: x["line"])
        rows = F.filter(F.transform(lines, lambda p, i: F.struct((i + 1).cast("long").alias("line"), p.alias("p"))), lambda x: F.trim(x["p"]).rlike(r"\S") & ~F.array_contains(closed, x["line"]))
        at = lambda x, n: F.struct(x["line"].alias("line"), (x["line"] + (n - 1)).alias("last"), F.array_join(F.slice(lines, x["line"].cast("int"), n), " ").alias("paragraph"))

        def joined(rows: Column) -> Column:
            # rows n - 1 places on in the list are n - 1 lines on only if no line is left out between them
            each = lambda x, i, n: F.when(F.get(rows, i + (n - 1))["line"] == x["line"] + (n - 1), at(x, n))
            sets = F.flatten(F.transform(rows, lambda x, i: F.array(*(each(x, i, n) for n in range(2, WRAPPED + 1)))))
            return F.filter(sets, lambda x: x.isNotNull() & confirmable(x["paragraph"]))

        found = F.filter(classified(F.flatten(F.transform(F.array(rows), joined))), known)
        return F.aggregate(found, F.array().cast(held), lambda acc, x: F.when((F.size(acc) > 0) & (F.get(acc, F.size(acc) - 1)["last"] >= x["line"]), acc).otherwise(F.concat(acc, F.array(x).cast(held))))

    held = "array<struct<line:bigint,last:bigint,anchored:boolean,c:struct<family:string,probability:double,share:double>>>"

    def scanned(lines: Column) -> Column:
        single = F.filter(F.transform(lines, lambda p, i: F.struct((i + 1).cast("long").alias("line"), (i + 1).cast("long").alias("last"), p.alias("paragraph"))), lambda x: likely(x["paragraph"]))
        # each step is a transform over one element, so that its result is computed once
        return F.element_at(F.transform(F.array(classified(single)), lambda own: F.array_sort(F.concat(flat(own), flat(wrapped(lines, own))))), 1)

    found = F.element_at(F.transform(F.array(F.split(text, "\n", -1)), scanned), 1)
    return docs.withColumn("licences", F.when(likely(text), found).otherwise(F.array().cast(kind)))


def summary(scanned: DataFrame) -> DataFrame:
    """doc_id, paragraphs looked at, paragraphs of a family, the families and the best probability."""
    known = F.filter("licences", lambda x: x["family"] != "unknown")
    return scanned.select("doc_id", F.size("licences").cast("long").alias("n_candidates"), F.size(known).cast("long").alias("n_licences"), F.array_join(F.array_sort(F.array_distinct(F.transform(known, lambda x: x["family"]))), ",").alias("families"), F.round(F.coalesce(F.array_max(F.transform(known, lambda x: x["probability"])), F.lit(0.0)), 6).alias("probability"))
