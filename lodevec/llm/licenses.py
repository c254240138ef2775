"""License scans with a trained paragraph classifier, scored in DataFrame functions alone.

A paragraph is a run of lines that aren't blank. It is judged as a whole, so a wrapped notice is seen in one piece; where
that confirms no family, each of its lines is judged alone, so a notice amid other lines is found too. The
features are the distinct word unigrams and bigrams. A sparse logistic regression with one class a licence family and
one for everything else is fitted on the driver to variants of the notices below and of ordinary prose. Its scores
are calibrated by a temperature on notices in other words. A family is confirmed where the text and one
of its templates share most bigrams of both, and where the text has no word that names another family.

Scores need no join: a gram's place in the weights comes from a collision-free table of slots by hash.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}]+(?:\.[0-9]+)*"
#: The same for Python's re, whose \w also has the underscore.
WORD_RE = re.compile(r"[^\W_]+(?:\.[0-9]+)*")
#: What parts paragraphs: a line of nothing but white space.
BLANK = r"\n(?:[ \t\r\x0B\f]*\n)+"
UNKNOWN = "unknown"
LEAST_CHANCE, LEAST_SHARED = 0.5, 0.5
VARIANTS, STEPS, RATE, SPARSITY = 14, 300, 0.5, 1e-4
SEED = 42

#: Usual wordings of licence notices, by family.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "This project is licensed under the terms of the MIT license.",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Released under the Apache 2.0 license.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "BSD": [
        "Licensed under the BSD 3-Clause License.",
        "Released under the BSD 2-Clause license.",
        "Use of this source code is governed by a BSD-style license.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "Released under the GNU GPL version 2.",
        "Licensed under the GPL, version 3 or later.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "LGPL": [
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "You can redistribute it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
        "Released under the LGPL.",
        "SPDX-License-Identifier: LGPL-2.1-only",
    ],
    "AGPL": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "You can redistribute it under the terms of the GNU Affero General Public License as published by the Free Software Foundation.",
        "Released under the AGPL, version 3.",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "EPL": [
        "Licensed under the Eclipse Public License, version 2.0.",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.",
        "SPDX-License-Identifier: EPL-2.0",
    ],
    "ISC": [
        "Licensed under the ISC license.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
        "SPDX-License-Identifier: ISC",
    ],
    "Unlicense": [
        "Released under the Unlicense.",
        "This is free and unencumbered software released into the public domain.",
        "SPDX-License-Identifier: Unlicense",
    ],
    "BSL-1.0": [
        "Distributed under the Boost Software License, Version 1.0.",
        "Licensed under the Boost Software License 1.0.",
        "SPDX-License-Identifier: BSL-1.0",
    ],
    "BUSL": [
        "Licensed under the Business Source License 1.1.",
        "Use of this software is governed by the Business Source License included in the file.",
        "SPDX-License-Identifier: BUSL-1.1",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Released under a Creative Commons BY-NC license.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ],
    "CC-BY-SA": [
        "Licensed under CC BY-SA 4.0.",
        "Text is available under the Creative Commons Attribution-ShareAlike License.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "CC-BY": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Released under a Creative Commons Attribution license.",
    ],
    "CC0": [
        "Dedicated to the public domain under CC0 1.0.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work.",
        "SPDX-License-Identifier: CC0-1.0",
    ],
    "proprietary": [
        "All rights reserved.",
        "Copyright by the company. All rights reserved.",
        "This software is proprietary and confidential. Unauthorized copying of this file is strictly prohibited.",
        "No part of this publication may be reproduced without the prior written permission of the publisher.",
    ],
}

#: Names of licences, by family, and frames of notices. Each name is learnt in each frame.
TITLES = {
    "MIT": ["MIT License"], "Apache-2.0": ["Apache License 2.0", "Apache License"], "BSD": ["BSD license", "2-clause BSD License"], "GPL": ["GNU General Public License", "GPL v3"],
    "LGPL": ["GNU Lesser General Public License", "LGPL v3"], "AGPL": ["GNU Affero General Public License", "AGPL v3"], "MPL-2.0": ["Mozilla Public License", "MPL 2.0"],
    "EPL": ["Eclipse Public License", "EPL 2.0"], "ISC": ["ISC License"], "Unlicense": ["Unlicense"], "BSL-1.0": ["Boost Software License"], "BUSL": ["Business Source License", "BUSL 1.1"],
    "CC-BY-NC": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial license"], "CC-BY-SA": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike license"],
    "CC-BY": ["CC BY 4.0", "Creative Commons Attribution license"], "CC0": ["CC0", "CC0 1.0"],
}
FRAMES = [
    "This file is released under the terms of the {}.", "Available under the {}, see the file for details.", "You may use it under the {}.", "The {} applies to this work.", "The contents are subject to the {}.",
    "Published by the author under {}.",
]

#: Words that name a family. A text that has one of another family, and none of its own, isn't confirmed.
NAMES = {
    "MIT": ["mit"], "Apache-2.0": ["apache"], "BSD": ["bsd"], "GPL": ["gpl"], "LGPL": ["lgpl", "lesser"], "AGPL": ["agpl", "affero"], "MPL-2.0": ["mpl", "mozilla"],
    "EPL": ["epl", "eclipse"], "ISC": ["isc"], "Unlicense": ["unlicense", "unencumbered"], "BSL-1.0": ["bsl", "boost"], "BUSL": ["busl", "business"],
    "CC-BY-NC": ["nc", "noncommercial"], "CC-BY-SA": ["sa", "sharealike"], "CC0": ["cc0"],
}

#: Notices in other words, which set the temperature and aren't learnt from.
CALIBRATION = {
    "MIT": ["The code is available under the MIT license.", "Distributed under the terms of the MIT License (see LICENSE)."],
    "Apache-2.0": ["This file is made available under the Apache License 2.0.", "The library is distributed under the Apache License, Version 2.0."],
    "BSD": ["This code is distributed under the 3-clause BSD license.", "Licensed under a modified BSD license."],
    "GPL": ["The program may be copied under the terms of the GNU General Public License.", "Distributed under the GNU GPL v3."],
    "LGPL": ["This library is covered by the GNU Lesser General Public License.", "Distributed under the terms of the LGPL version 3."],
    "AGPL": ["The server is published under the GNU Affero General Public License.", "Distributed under the AGPL v3."],
    "MPL-2.0": ["The files are covered by the Mozilla Public License 2.0."],
    "EPL": ["The plugin is distributed under the Eclipse Public License 1.0."],
    "ISC": ["The module is distributed under the ISC license."],
    "Unlicense": ["This code is placed into the public domain under the Unlicense."],
    "BSL-1.0": ["The headers are covered by the Boost Software License."],
    "BUSL": ["The server is available under the Business Source License."],
    "CC-BY-NC": ["The pictures are shared under a Creative Commons Attribution-NonCommercial license."],
    "CC-BY-SA": ["The article is shared under CC BY-SA 3.0."],
    "CC-BY": ["The data are shared under CC BY 4.0."],
    "CC0": ["The data have been released under CC0."],
    "proprietary": ["Copyright 2020 by the publisher, all rights reserved worldwide."],
}

#: Prose that shares words with licence notices and isn't one.
ORDINARY = [
    "The driver had no license and was fined by the court.",
    "She works as a licensed nurse in a public hospital.",
    "The general said the work of the foundation was free of charge.",
    "He studied at MIT and later moved to Boston.",
    "An Apache helicopter was seen over the town.",
    "The version of the software was released in spring.",
    "Copyright law protects the author of a creative work.",
    "The commons were open to the public under the old law.",
    "All rights of the person were granted without restriction.",
    "Please read the terms and conditions before you use the site.",
    "The gnu is an animal that lives in the open plains.",
    "The source of the river was found by accident.",
    "They met in the library and talked about the permission to build.",
    "A copy of this document was sent to any person who asked for it.",
    "Under the new rules the software may be used in schools.",
    "The license plate was lost in the snow.",
    "All seats were reserved by the company for its guests.",
    "The eclipse was seen by the general public in the north.",
    "A boost of the business came from a new source.",
    "The publisher had no part in the prior agreement.",
    "The lesser of the two evils was chosen by the board.",
    "Parts of the file were copied and distributed to the members.",
]


def words_of(paragraph: str) -> list[str]:
    return WORD_RE.findall(paragraph.lower())


def bigrams_of(words: list[str]) -> list[str]:
    return list(dict.fromkeys(map(" ".join, zip(words, words[1:], strict=False))))


def grams_of(words: list[str]) -> list[str]:
    """Distinct words, then distinct bigrams, each in order of the text."""
    return [*dict.fromkeys(words), *bigrams_of(words)]


@dataclass
class Model:
    families: list[str]  # without the last class, unknown
    grams: list[str]
    weights: list[list[float]]  # of a gram: a value a class, over a temperature
    bias: list[float]
    templates: list[tuple[str, list[str]]]  # family, bigrams
    slots: tuple[int, int, list[int]] = field(default=(0, 0, []), repr=False)  # shift, bits, gram by slot (-1: none)

    def classify(self, paragraph: str) -> tuple[str, float, float, bool]:
        """Family, chance, similarity and whether it is confirmed, in plain Python; what the expressions below must agree with."""
        at = {g: i for i, g in enumerate(self.grams)}
        words = words_of(paragraph)
        scores = np.asarray(self.bias) + sum((np.asarray(self.weights[at[g]]) for g in grams_of(words) if g in at), np.zeros(len(self.bias)))
        chance = np.exp(scores - scores.max())
        chance /= chance.sum()
        best = int(chance.argmax())
        if best == len(self.families) or chance[best] < LEAST_CHANCE:
            return UNKNOWN, float(chance[-1]), 0.0, False
        family, mine = self.families[best], set(bigrams_of(words))
        alike = max(2 * len(mine & set(t)) / max(1, len(mine) + len(t)) for f, t in self.templates if f == family)
        own, others = names_of(family)
        named = bool(set(words) & set(own)) or not set(words) & set(others)
        return family, float(chance[best]), alike, bool(round(alike, 6) >= LEAST_SHARED and named)


def names_of(family: str) -> tuple[list[str], list[str]]:
    """Words that name a family, and those that name others."""
    own = NAMES.get(family, [])
    return own, sorted({w for f, ws in NAMES.items() if f != family for w in ws} - set(own))


def train(seed: int = 11) -> Model:
    """Fit on the templates, with words left out and prose around them, and on ordinary, shuffled and long prose."""
    rng = np.random.default_rng(seed)
    families = list(TEMPLATES)
    notices = [t for ts in TEMPLATES.values() for t in ts] + [frame.format(t) for ts in TITLES.values() for t in ts for frame in FRAMES]
    vocabulary = sorted({g for t in notices for g in grams_of(words_of(t))})
    place = {g: i for i, g in enumerate(vocabulary)}
    pool = [w for t in ORDINARY for w in words_of(t)]
    telling = {w for ws in NAMES.values() for w in ws}  # without them a notice would be another family's

    def row_of(words: list[str]) -> np.ndarray:
        row = np.zeros(len(vocabulary), np.float32)
        row[[place[g] for g in grams_of(words) if g in place]] = 1
        return row

    def example(words: list[str], lost: float, around: int) -> np.ndarray:
        kept = [w for w in words if w in telling or rng.random() >= lost] or words
        before = int(rng.integers(0, around + 1))
        return row_of([*rng.choice(pool, before), *kept, *rng.choice(pool, around - before)])

    rows, labels = [], []
    for i, family in enumerate(families):
        for t in TEMPLATES[family]:
            for k in range(VARIANTS):
                rows.append(example(words_of(t), 0.0 if k % 3 == 0 else 0.12, 0 if k % 4 == 0 else int(rng.integers(0, 12))))
                labels.append(i)
    for family, titles in TITLES.items():
        for text in (frame.format(title) for title in titles for frame in FRAMES):
            for k in range(VARIANTS // 3):
                rows.append(example(words_of(text), 0.1, 4 * k))
                labels.append(families.index(family))
    scraps = [w for ts in TEMPLATES.values() for t in ts for w in words_of(t) if w not in telling]
    for t in ORDINARY:
        for k in range(2 * VARIANTS):
            rows.append(example(words_of(t), 0.1, int(rng.integers(0, 6))))
            rows.append(row_of([*rng.choice(scraps, 3), *rng.choice(pool, 8 if k % 4 else 60)]))
            labels += [len(families)] * 2
    x, y = np.asarray(rows), np.asarray(labels)
    classes = len(families) + 1
    goal = np.eye(classes, dtype=np.float32)[y]
    w, b = np.zeros((len(vocabulary), classes), np.float32), np.zeros(classes, np.float32)
    b[-1] = 1.0
    for _ in range(STEPS):
        p = _softmax(x @ w + b)
        w -= RATE * (x.T @ (p - goal)) / len(y) * 20
        w = np.sign(w) * np.maximum(np.abs(w) - RATE * SPARSITY * 20, 0)
        b -= RATE * (p - goal).mean(0)
    told = [(families.index(f), t) for f, ts in CALIBRATION.items() for t in ts] + [(len(families), t) for t in ORDINARY]
    scores = np.asarray([row_of(words_of(t)) for _, t in told]) @ w + b
    heats = np.exp(np.linspace(0.0, 2.0, 21))  # a temperature only takes confidence away
    losses = [-np.log(_softmax(scores / t)[np.arange(len(told)), [i for i, _ in told]] + 1e-12).mean() for t in heats]
    heat = heats[int(np.argmin(losses))]
    used = [i for i in range(len(vocabulary)) if np.abs(w[i]).max() > 1e-6]
    grams = [vocabulary[i] for i in used]
    templates = [(f, bigrams_of(words_of(t))) for f, ts in TEMPLATES.items() for t in ts]
    weights = (w[used].astype(float) / heat).round(6).tolist()
    return Model(families, grams, weights, (b.astype(float) / heat).round(6).tolist(), templates, slots_of(grams))


@lru_cache(maxsize=1)
def trained() -> Model:
    """The model of the templates above, fitted once a process."""
    return train()


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def slots_of(grams: list[str]) -> tuple[int, int, list[int]]:
    """Bits of the grams' XXH64 that differ for all of them: ``(shift, bits, gram by slot)``, with as few bits as will do."""
    hashes = np.asarray([xxhash.xxh64_intdigest(g.encode(), SEED) for g in grams], np.uint64)
    for bits in range(max(4, len(grams).bit_length()), 25):
        for shift in range(64 - bits):
            at = (hashes >> np.uint64(shift)) & np.uint64((1 << bits) - 1)
            if len(np.unique(at)) == len(grams):
                table = np.full(1 << bits, -1)
                table[at.astype(np.int64)] = np.arange(len(grams))
                return shift, bits, table.tolist()
    raise ValueError("too many grams for a table of slots")


# ---------------------------------------------------------------------- expressions
def _list(values: list, kind: str = "string") -> Column:
    """A constant array; it is one literal in the plan."""
    whole = F.split(F.lit("\n".join(map(str, values))), "\n")
    return whole if kind == "string" else whole.cast(f"array<{kind}>")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once. A column of a select would be put in wherever it is used, again and again."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _family(words: Column, pairs: Column, scores: Column, model: Model) -> Column:
    """The struct (family, chance, similarity, confirmed) of a text's scores; null where the family is unknown."""

    def told(family: Column, chance: Column) -> Column:
        alike, named = F.lit(0.0), F.lit(False)
        for name in model.families:
            shares = [2 * F.size(F.array_intersect(pairs, _list(t))) / F.greatest(F.size(pairs) + len(t), F.lit(1)) for f, t in model.templates if f == name]
            alike = F.when(family == name, F.greatest(*shares, F.lit(0.0))).otherwise(alike)
            own, others = names_of(name)
            clear = ~F.arrays_overlap(words, _list(others))
            named = F.when(family == name, clear | F.arrays_overlap(words, _list(own)) if own else clear).otherwise(named)
        confirmed = lambda share: (share >= LEAST_SHARED) & named
        return _let(F.round(alike, 6), lambda share: F.struct(family.alias("family"), F.round(chance, 6).alias("chance"), share.alias("similarity"), confirmed(share).alias("confirmed")))

    def best(top: Column) -> Column:
        place = F.array_position(scores, top).cast("int")
        chance = 1 / F.aggregate(F.transform(scores, lambda s: F.exp(s - top)), F.lit(0.0), lambda a, b: a + b)
        known = (place <= len(model.families)) & (chance >= LEAST_CHANCE)
        return F.when(known, told(F.get(_list([*model.families, UNKNOWN]), place - 1), chance))

    return _let(F.array_max(scores), best)


def scored(text: Column, model: Model) -> Column:
    """What ``_family`` gives for a text column, from its words to its scores."""
    shift, bits, table = model.slots
    grams, places = _list([model.grams[i] if i >= 0 else "" for i in table]), _list(table, "int")
    slot = lambda g: F.shiftrightunsigned(F.xxhash64(g), shift).bitwiseAND(F.lit((1 << bits) - 1)).cast("int")

    def total(place: int, bias: float, hits: Column) -> Column:
        weights = _list([w[place] for w in model.weights], "double")
        return F.round(F.aggregate(hits, F.lit(float(bias)), lambda s, i: s + F.get(weights, i)), 9)

    def of_words(words: Column) -> Column:
        rest = F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0)))
        pairs = F.array_distinct(F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), rest, lambda a, b: F.concat_ws(" ", a, b)))
        return _let(pairs, lambda p: of_grams(words, p))

    def of_grams(words: Column, pairs: Column) -> Column:
        found = F.filter(F.concat(F.array_distinct(words), pairs), lambda g: F.get(grams, slot(g)) == g)
        hits = F.transform(found, lambda g: F.get(places, slot(g)))
        # without a known gram the bias decides, which is for unknown
        return _let(hits, lambda h: F.when(F.size(h) > 0, _let(F.array(*(total(c, b, h) for c, b in enumerate(model.bias))), lambda scores: _family(words, pairs, scores, model))))

    return _let(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)), of_words)


def scan(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, paragraph, line, family, chance, similarity, confirmed)``, one row for each paragraph or line of a known family.

    ``paragraph`` counts runs of lines that aren't blank, from 0, and ``line`` the lines of one; a null line is the whole of a
    paragraph of several lines, which then is confirmed. All paragraphs and lines are scored whole, however
    long. A null or empty text has no rows; repeated rows repeat; an empty table gives an empty result; other
    columns aren't looked at. Each row is judged by itself, without a shuffle.
    """
    model = model or trained()
    source = docs.select(F.col(id_col).alias("id"), F.posexplode_outer(F.split(F.coalesce(F.col(text_col).cast("string"), F.lit("")), BLANK)).alias("paragraph", "body"))
    row = lambda line, found: F.struct(line.cast("int").alias("line"), found.alias("found"))

    def rows(whole: Column) -> Column:
        lines = F.split("body", "\n")
        single = F.transform(lines, lambda line, n: row(n, scored(line, model)))
        return F.when(F.size(lines) == 1, F.array(row(F.lit(0), whole))).when(whole["confirmed"], F.array(row(F.lit(None), whole))).otherwise(F.filter(single, lambda r: r["found"].isNotNull()))

    # an outer explode, as the other kind would have its array computed twice to filter by its size
    found = source.select("id", "paragraph", F.explode_outer(_let(scored(F.col("body"), model), rows)).alias("r")).where("r.found is not null")
    return found.select(F.col("id").alias(id_col), "paragraph", "r.line", "r.found.family", "r.found.chance", "r.found.similarity", "r.found.confirmed")
