"""Licence statements in documents: a trained paragraph classifier confirmed by template comparison, in DataFrame operations.

Paragraphs are lines; lines of 50 to 100 characters that another line follows are taken for hard-wrapped text and joined with it.
A paragraph that holds a word of rights (licence, license, copyright, ... in any form) or one of the model's indicators (n-grams that
the training chose, see ``indicators``) is a candidate.  Its word n-grams (1 to 3) meet the sparse weights of a multinomial logistic regression, trained here on the templates below, on
variants of them, on general statements about rights (the class ``unknown``) and on ordinary sentences (``none``).  Probabilities
are calibrated by a temperature chosen on variants left out of the training; how probable a family must be that no template confirms,
else the statement is ``unknown``, is chosen on statements of families left out of the training.  A family is confirmed if the paragraph shares
enough 3-grams with one of its templates, and both name the same versions and restrictions.  Where it names others than the family has, or
shares hardly anything with its templates, the statement is ``unknown``.
"""

from __future__ import annotations

import functools
import random
import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedweave.llm.common import id_and_text, stored, table

CONFIRM = 0.6  # share of the 3-grams of a paragraph, or of a template, that both have
AGREE = 0.3  # below this share with every template of its family a statement is unknown
SPEAKS_OF_RIGHTS = "(?<![a-z])(?:(?:re|sub|un)?licen[cs]|copyright|copyleft|spdx|redistribut)"
WRAPPED = "(?md)^([^\\n]{50,100})\\n(?=[^\\n]*\\S)"

# Names of the licences as their texts and the SPDX list write them; the last is the SPDX identifier.
NAMES = {
    "apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0", "Apache 2.0 license", "Apache Software License 2.0", "Apache-2.0"),
    "mit": ("MIT License", "MIT license", "Expat License", "MIT-style license", "MIT-style terms", "MIT"),
    "gpl-2.0": ("GNU General Public License, version 2", "GNU General Public License v2", "GNU GPL version 2", "GNU GPL v2", "GPLv2", "GPL v2", "GPL 2", "GPL-2.0-only"),
    "gpl-3.0": ("GNU General Public License, version 3", "GNU General Public License v3", "GNU GPL version 3", "GNU GPL v3", "GPLv3", "GPL v3", "GPL 3", "GPL-3.0-or-later"),
    "lgpl-2.1": ("GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License v2.1", "GNU LGPL version 2.1", "LGPLv2.1", "LGPL 2.1", "LGPL-2.1-only"),
    "lgpl-3.0": ("GNU Lesser General Public License, version 3", "GNU Lesser General Public License v3", "GNU LGPL version 3", "LGPLv3", "LGPL 3", "LGPL-3.0-or-later"),
    "agpl-3.0": ("GNU Affero General Public License, version 3", "GNU Affero General Public License v3", "GNU AGPL version 3", "AGPLv3", "AGPL 3", "AGPL-3.0-or-later"),
    "bsd-2-clause": ("BSD 2-Clause License", "BSD 2-Clause", "2-clause BSD license", "Simplified BSD License", "two-clause BSD license", "BSD-2-Clause"),
    "bsd-3-clause": ("BSD 3-Clause License", "BSD 3-Clause", "3-clause BSD license", "New BSD License", "three-clause BSD license", "BSD-3-Clause"),
    "isc": ("ISC License", "ISC license", "terms of the ISC license", "ISC"),
    "mpl-2.0": ("Mozilla Public License, v. 2.0", "Mozilla Public License 2.0", "Mozilla Public License, version 2.0", "MPL 2.0", "MPL-2.0"),
    "epl-2.0": ("Eclipse Public License 2.0", "Eclipse Public License v2.0", "Eclipse Public License, version 2.0", "EPL 2.0", "EPL-2.0"),
    "bsl-1.0": ("Boost Software License, Version 1.0", "Boost Software License 1.0", "Boost Software License", "BSL-1.0"),
    "unlicense": ("Unlicense", "The Unlicense", "terms of the Unlicense"),
    "cc0-1.0": ("CC0 1.0 Universal", "CC0 1.0", "Creative Commons Zero 1.0", "CC0", "CC0-1.0"),
    "cc-by-4.0": ("Creative Commons Attribution 4.0 International License", "Creative Commons Attribution 4.0", "CC BY 4.0", "CC-BY-4.0"),
    "cc-by-sa-4.0": ("Creative Commons Attribution-ShareAlike 4.0 International License", "Creative Commons Attribution-ShareAlike 4.0", "CC BY-SA 4.0", "CC-BY-SA-4.0"),
    "cc-by-nc-4.0": ("Creative Commons Attribution-NonCommercial 4.0 International License", "Creative Commons Attribution-NonCommercial 4.0", "CC BY-NC 4.0", "CC-BY-NC-4.0"),
    "cc-by-nd-4.0": ("Creative Commons Attribution-NoDerivatives 4.0 International License", "Creative Commons Attribution-NoDerivatives 4.0", "CC BY-ND 4.0", "CC-BY-ND-4.0"),
    "cc-by-nc-sa-4.0": ("Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0", "CC BY-NC-SA 4.0", "CC-BY-NC-SA-4.0"),
    "cc-by-nc-nd-4.0": ("Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0", "CC BY-NC-ND 4.0", "CC-BY-NC-ND-4.0"),
}
FRAMES = (
    "Licensed under the {}.", "Released under the {}.", "This work is licensed under the {}.", "Distributed under the {}.", "This project is licensed under the terms of the {}.",
    "You may use this under {}.", "Published under {}.", "Available under a {}.", "Released under {}.", "Licensed under {}.", "License: {}", "SPDX-License-Identifier: {}",
)
# Paragraphs of the licences' own texts and of the notices that they recommend.
PARAGRAPHS = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    ),
    "gpl-2.0": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    "gpl-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "lgpl-2.1": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ),
    "lgpl-3.0": (
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "agpl-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "bsd-3-clause": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    "epl-2.0": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    ),
    "bsl-1.0": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software",
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    "cc0-1.0": (
        "To the extent possible under law, the authors have waived all copyright and related or neighboring rights to this work under CC0 1.0.",
    ),
}
# Paragraphs that several families' texts share, so that they name none by themselves.
SHARED = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
)
UNKNOWN = (
    *SHARED,
    "All rights reserved.", "Copyright 2021 the authors. All rights reserved.", "This material is proprietary and licensed to you under a separate agreement.",
    "Licensed under the terms of the agreement between the parties.", "Distributed under a custom license; see the file for details.", "This work is in the public domain.",
    "Use of this software requires a commercial license.", "Released under the Example Community License.", "Permission to redistribute must be requested in writing.",
    "Licensed under the Community Research License, version 1.1.", "This project is licensed under the terms of the Sample Public Licence 1.2.", "See the LICENSE file for license information.",
    "No part of this publication may be reproduced without prior written permission of the publisher.", "Published under an open license of the ministry.", "License: proprietary",
)
NONE = (
    "The driver lost a license after the accident and the hearing was last week.", "A one year warranty covers the battery and the screen.", "The copyright debate in parliament went on until late at night.",
    "She asked for permission to leave the room.", "They redistributed the chairs among the tables.", "A fishing licence is needed in this county.", "The and of to in is that it for was on are as with.",
    "He keeps a licensed pub near the station.", "The court issued a warrant on Monday.", "Volunteers redistribute food to those in need.", "The dealer offers an extended warranty on used cars.",
    "Er kommt mit dem Zug und mit der Bahn.", "Das Kind spielt mit dem Hund im Garten.", "La version finale du projet est disponible sur le site.", "El software se publica cada mes y la version 2 llega en mayo.",
    "An apache helicopter landed near the base.", "Use the form to obtain a copy of the report.", "The general public was invited to the opening.", "This software program runs version 3 of the protocol.",
    "Any person may use the library for free on Sundays.", "You can obtain one at the counter in the main hall.", "The following conditions are met every year, the source said.", "Version 2.0 of the app was released last week under a new name.",
    "His driving licence was taken away for three months.", "Poetic license let the author move the battle to spring.", "The clerk at the license office stamps each form twice.", "Copyright law was the topic of a long lecture.",
    "Licensed plumbers charge more on weekends.", "The city licenses about forty taxi drivers a year.", "Attribution of the painting is uncertain; the international jury met at four.", "This program is available to the public at no charge.", "The foundation published a list of names and products.",
)
# Everyday words, which indicate nothing by themselves; mit is one in German.
COMMON = frozenset(
    """mit the a an is in it all any each every most some such only other others same own see seen must may can could should would might shall will without within under over after before later
    never always often again also even still yet then than thus so if or and but not no nor as at by for from in into of off on out to up with about between through during
    this that these those it its he she they we you i his her their our your my who whom whose which what where when while why how there here be is are was were been being have
    has had do does did done go goes came come make made take taken use used find found keep kept give given get got let new old good great many much more less few first last
    one two three next long little right left high way work works year day time people part place case name names notice agreement binary commercial available terms conditions
    public domain software version source form file files copy copies free general permission provided""".split()
)
# What a licence's name differs in from its relatives': words that restrict, and what stands before a version number.
RESTRICTS = "lesser lgpl affero agpl noncommercial nc sharealike sa noderivatives nd clause isc mit".split()
BEFORE_VERSION = "version v license licence gpl lgpl agpl apache mpl epl bsd by nc sa nd cc0 zero international attribution sharealike noncommercial noderivatives software boost only or later".split()
NUMBER = "v?[0-9]{1,2}([.][0-9]{1,2})*"
JOINED = "[a-z]?gplv([0-9.]+)"


def statements(family: str) -> list[str]:
    """The family's templates for training: each name by itself and in three of the frames, its identifier, and paragraphs."""
    names = NAMES[family]
    first = list(NAMES).index(family)
    framed = [FRAMES[(first + 3 * i + j) % (len(FRAMES) - 2)].format(n) for i, n in enumerate(names[:-1]) for j in range(3)]
    common = [f.format(names[0]) for f in FRAMES[:3]]
    return list(dict.fromkeys([*names, *common, *framed, f"License: {names[-1]}", f"SPDX-License-Identifier: {names[-1]}", *PARAGRAPHS.get(family, ())]))


TEMPLATES = {family: tuple(statements(family)) for family in NAMES}  # what the classifier learns from
# What confirms: each name in every frame, and the paragraphs.
CONFIRMING = {family: tuple(dict.fromkeys([*(f.format(n) for n in names for f in FRAMES), *PARAGRAPHS.get(family, ())])) for family, names in NAMES.items()}


def words_column(paragraph: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(paragraph), "[^a-z0-9.+]+|[.]+(?=\\s|\\z)", " "), " "), lambda w: w != "")


def words(paragraph: str) -> list[str]:
    """As words_column, for training."""
    return [w for w in re.sub(r"[^a-z0-9.+]+|[.]+(?=\s|\Z)", " ", paragraph.lower()).split(" ") if w]


def grams(own: list[str]) -> set[str]:
    return {" ".join(own[i : i + n]) for n in (1, 2, 3) for i in range(len(own) - n + 1)}


def _runs(own: Column, k: int) -> Column:
    n = F.size(own)
    return F.when(n >= k, F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.array_join(F.slice(own, i, k), " "))).otherwise(F.array().cast("array<string>"))


def grams_column(own: Column) -> Column:
    return F.array_distinct(F.concat(_runs(own, 1), _runs(own, 2), _runs(own, 3)))


def keys(own: list[str]) -> set[str]:
    """The restrictions and versions that a statement names: 3.0, 3 and v3 are the same version."""
    found = {w for w in own if w in RESTRICTS}
    for before, w in zip([""] + own, own):
        m = re.fullmatch(JOINED, w)
        if m or before in BEFORE_VERSION and re.fullmatch(NUMBER, w):
            found.add(re.sub(r"^v|([.]0)+$", "", m[1] if m else w))
        if m and w[0] in "la":
            found.add(w.split("v")[0])
    return {{"lgpl": "lesser", "agpl": "affero", "noncommercial": "nc", "sharealike": "sa", "noderivatives": "nd"}.get(w, w) for w in found}


def keys_column(own: Column) -> Column:
    """As keys."""
    before = F.concat(F.array(F.lit("")), own)
    version = F.filter(F.transform(own, lambda w, i: F.when(F.element_at(before, i + 1).isin(BEFORE_VERSION) & w.rlike(f"^{NUMBER}\\z"), w)), lambda w: w.isNotNull())
    joined = F.filter(own, lambda w: w.rlike(f"^{JOINED}\\z"))
    numbers = F.transform(F.concat(version, F.transform(joined, lambda w: F.regexp_extract(w, JOINED, 1))), lambda w: F.regexp_replace(w, "^v|([.]0)+\\z", ""))
    restricts = F.concat(F.filter(own, lambda w: w.isin(RESTRICTS)), F.transform(F.filter(joined, lambda w: w.rlike("^[la]")), lambda w: F.substring_index(w, "v", 1)))
    short = F.create_map(*(F.lit(x) for x in "lgpl lesser agpl affero noncommercial nc sharealike sa noderivatives nd".split()))
    return F.array_distinct(F.concat(numbers, F.transform(restricts, lambda w: F.coalesce(F.try_element_at(short, w), w))))


def training_rows(seed: int, left_out: frozenset[str] = frozenset()) -> list[tuple[list[str], str]]:
    """Templates and variants of them: a word or two lost or replaced, cut at either end, filler around."""
    rng = random.Random(seed)
    filler = sorted({w for text in NONE for w in words(text)} - {w for names in NAMES.values() for n in names for w in words(n)})
    rows = []
    sources = [(t, c, 3) for c, own in TEMPLATES.items() if c not in left_out for t in own] + [(t, "unknown", 8) for t in UNKNOWN] + [(t, "none", 8) for t in NONE]
    for text, label, variants in sources:
        own = words(text)
        named = set(keys(own))
        rows.append((own, label))
        for _ in range(variants):
            v = list(own)
            for _ in range(rng.randint(0, max(1, len(v) // 8))):
                k = rng.randrange(len(v))
                if v[k] not in named and not v[k][0].isdigit():
                    v[k : k + 1] = [] if rng.random() < 0.5 and len(v) > 4 else [rng.choice(filler)]
            v = [rng.choice(filler) for _ in range(rng.randint(0, 4))] + v + [rng.choice(filler) for _ in range(rng.randint(0, 4))]
            rows.append((v, label))
    for _ in range(200):
        rows.append(([rng.choice(filler) for _ in range(rng.randint(3, 30))], "none"))
    return rows


def _matrix(rows, index: dict[str, int], classes: list[str]) -> tuple[np.ndarray, np.ndarray]:
    x = np.zeros((len(rows), len(index) + 1), np.float32)
    x[:, -1] = 1
    for i, (own, _) in enumerate(rows):
        for g in grams(own):
            if g in index:
                x[i, index[g]] = 1
    return x, np.array([classes.index(c) if c in classes else -1 for _, c in rows])


def _softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def train(seed: int = 6, steps: int = 150, ridge: float = 1e-3, left_out: frozenset[str] = frozenset()) -> tuple[list[str], dict[str, list[float]], list[float]]:
    """Classes, weights by n-gram (of those that occur twice, so bounded by the templates) and biases, divided by the temperature."""
    rows, other = training_rows(seed, left_out), training_rows(seed + 1, left_out)
    classes = [*(c for c in TEMPLATES if c not in left_out), "unknown", "none"]
    seen: dict[str, int] = {}
    for own, _ in rows:
        for g in grams(own):
            seen[g] = seen.get(g, 0) + 1
    index = {g: i for i, g in enumerate(sorted(g for g, n in seen.items() if n > 1))}
    x, y = _matrix(rows, index, classes)
    one = np.eye(len(classes), dtype=np.float32)[y]
    w, speed = np.zeros((x.shape[1], len(classes)), np.float32), np.full((x.shape[1], len(classes)), 1e-6, np.float32)
    for _ in range(steps):
        g = x.T @ (one - _softmax(x @ w)) / len(x) - ridge * w / 10
        speed += g**2
        w += 0.3 * g / np.sqrt(speed)
    x, y = _matrix(other, index, classes)
    z = x @ w
    t = min((0.5, 0.7, 1.0, 1.4, 2.0, 3.0), key=lambda t: -np.log(_softmax(z / t)[np.arange(len(y)), y] + 1e-12).mean())
    w = w / t
    return classes, {g: [float(v) for v in w[i]] for g, i in index.items()}, [float(v) for v in w[-1]]


def probabilities(model, own: list[str]) -> np.ndarray:
    classes, weights, bias = model
    z = np.array(bias)
    for g in grams(own):
        if g in weights:
            z = z + weights[g]
    return _softmax(z[None])[0]


def least_probability() -> float:
    """How probable a family must be: the bound that best tells statements of families left out from variants of those trained."""
    strange, known = [], []
    families = list(TEMPLATES)
    for k in range(4):
        out = frozenset(families[k::4])
        model = train(seed=20 + k, steps=80, left_out=out)
        inside = [i for i, c in enumerate(model[0]) if c in TEMPLATES]
        strange += [float(probabilities(model, words(t))[inside].max()) for c in sorted(out) for t in TEMPLATES[c]]
        known += [float(probabilities(model, own)[model[0].index(c)]) for own, c in training_rows(50 + k, out) if c in TEMPLATES]
    strange_, known_ = np.array(strange), np.array(known)
    return max((float((strange_ < b).mean() + (known_ >= b).mean()), -b) for b in np.arange(0.3, 1.0, 0.01).round(2).tolist())[1] * -1


def indicators(model) -> list[str]:
    """Words and pairs of words, never in ordinary sentences and not of everyday words alone, such that each statement about rights holds two of them, where it has two.

    Greedily, those that most statements without two hold, by weight against ``none`` where equal.
    """
    classes, weights, _ = model
    none = classes.index("none")
    ordinary = set().union(*(grams(words(t)) for t in NONE))
    value = {g: max(w) - w[none] for g, w in weights.items() if g not in ordinary and g.count(" ") < 2 and not g[0].isdigit() and len(g) > 2 and not COMMON.issuperset(g.split(" "))}
    need = [[2, {g for g in grams(words(t)) if g in value}] for texts in [*TEMPLATES.values(), UNKNOWN] for t in texts]
    chosen: list[str] = []
    while True:
        gain: dict[str, int] = {}
        for n, own in need:
            for g in own if n else ():
                gain[g] = gain.get(g, 0) + 1
        if not gain:
            return sorted(chosen)
        best = max(gain, key=lambda g: (gain[g], value[g], g))
        chosen.append(best)
        for pair in need:
            if best in pair[1]:
                pair[1].discard(best)
                pair[0] = max(0, pair[0] - 1)


@functools.lru_cache(1)
def trained():
    """The model, its least probability of a family and its indicators."""
    model = train()
    return model, least_probability(), indicators(model)


def paragraphs_column(text: Column) -> Column:
    joined = F.when(F.contains(text, F.lit("\n")), F.regexp_replace(text, WRAPPED, "$1 ")).otherwise(text)
    return F.filter(F.split(joined, "\n"), lambda p: F.trim(p) != "")


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: ``doc_id, n_paragraphs, n_candidates, n_licences, family, score, confirmed``.

    ``family`` is that of the document's most probable licence paragraph: a key of TEMPLATES, ``unknown`` for a statement
    about rights that fits none well enough, or ``none``; ties go to the earlier paragraph, then to the class that sorts first.
    ``score`` is the probability of the paragraph's most probable class; ``confirmed`` tells whether a template of the family agrees.
    Null, empty and blank texts have no paragraphs and the family ``none`` with score 0.  Repeated rows and rows without a doc_id
    come back each; an empty table gives an empty result; other columns are ignored.  Whole texts are scanned.
    """
    spark = docs.sparkSession
    (classes, weights, bias), least, marks = trained()
    weight_rows = spark.createDataFrame([(g, w) for g, w in sorted(weights.items())], "gram string, w array<double>")
    shapes = [(c, n, len(t3), " ".join(sorted(keys(own))), g) for c, texts in CONFIRMING.items() for n, t in enumerate(texts) for own in [words(t)] for t3 in [{" ".join(own[i : i + 3]) for i in range(max(1, len(own) - 2))}] for g in sorted(t3)]
    template_rows = spark.createDataFrame(shapes, "family string, template int, t_size int, keys string, gram string")

    # a text or paragraph that has neither a word of rights nor the longest of the uncommon words of any indicator is no candidate
    heads = sorted({max((w for w in m.split(" ") if w not in COMMON), key=len) for m in marks})
    some_head = SPEAKS_OF_RIGHTS + "|(?<![a-z0-9])(?:" + "|".join(h.replace(".", "[.]").replace("+", "[+]") for h in heads) + ")(?![a-z0-9])"

    # equal texts are scanned once
    rows = id_and_text(docs).withColumn("mark", F.xxhash64("text")).withColumn("mark2", F.xxhash64(F.lit(7), "text"))
    base = rows.select("doc_id", "mark", "mark2", F.size(paragraphs_column(F.col("text"))).cast("long").alias("n_paragraphs"))
    some = rows.where(F.lower("text").rlike(some_head)).dropDuplicates(["mark", "mark2"]).select("mark", "mark2", F.posexplode(paragraphs_column(F.col("text"))).alias("pos", "p"))
    # each step is written, so that what it made isn't computed again for each use
    own = stored(some.where(F.lower("p").rlike(some_head)).select("mark", "mark2", "pos", words_column(F.col("p")).alias("own")))
    marked = F.arrays_overlap(F.concat(_runs(F.col("own"), 1), _runs(F.col("own"), 2)), F.array(*map(F.lit, marks)))
    own = stored(own.where(F.array_join("own", " ").rlike(SPEAKS_OF_RIGHTS) | marked))

    key = ["mark", "mark2", "pos"]
    hits = own.select(*key, F.explode(grams_column(F.col("own"))).alias("gram")).join(F.broadcast(weight_rows), "gram")  # bounded by the templates
    sums = hits.groupBy(*key).agg(F.array(*(F.sum(F.col("w")[i]) for i in range(len(classes)))).alias("sums"))
    # one array of scores per paragraph, so that no class repeats the others' expressions
    biases, ranks, names = F.array(*map(F.lit, bias)), F.array(*(F.lit(-sorted(classes).index(c)) for c in classes)), F.array(*map(F.lit, classes))
    z = F.when(F.col("sums").isNull(), biases).otherwise(F.zip_with("sums", biases, lambda a, b: F.coalesce(a, F.lit(0.0)) + b))
    scored = own.join(sums, key, "left").select(*key, "own", z.alias("z"))
    e = F.transform("z", lambda v: F.exp(v - F.array_max("z")))
    scored = scored.select(*key, "own", e.alias("e")).withColumn("total", F.aggregate("e", F.lit(0.0), lambda a, v: a + v))
    best = F.array_max(F.transform("e", lambda v, i: F.struct((v / F.col("total")).alias("score"), F.element_at(ranks, i + 1).alias("r"), F.element_at(names, i + 1).alias("family"))))
    scored = scored.withColumn("b", best).select(*key, "own", "b.score", "b.family")
    scored = stored(scored)

    named = scored.where(~F.col("family").isin("unknown", "none"))
    threes = F.array_distinct(F.when(F.size("own") >= 3, _runs(F.col("own"), 3)).otherwise(F.array(F.array_join("own", " "))))
    named = stored(named.select(*key, "family", F.array_join(F.array_sort(keys_column(F.col("own"))), " ").alias("keys"), threes.alias("threes")))
    parts = named.select(*key, "family", "keys", F.size("threes").alias("n"), F.explode("threes").alias("gram"))
    agreed = parts.withColumnRenamed("keys", "own_keys").join(F.broadcast(template_rows), ["family", "gram"])
    agreed = agreed.groupBy(*key, "template", (F.col("own_keys") == F.col("keys")).alias("alike")).agg((F.count("*") / F.least(F.max("n"), F.max("t_size"))).alias("share"))
    agreed = agreed.groupBy(*key).agg(F.max(F.when(F.col("alike"), F.col("share"))).alias("sure"), F.max("share").alias("share"))
    # a statement that names versions or restrictions which no template of the family has is about another licence
    allowed = F.create_map(*(x for c, texts in CONFIRMING.items() for x in (F.lit(c), F.array(*map(F.lit, sorted(set().union(*(keys(words(t)) for t in texts)))) or [F.lit("")]))))
    strange = named.select(*key, (F.size(F.array_except(F.split("keys", " "), F.concat(F.array(F.lit("")), F.element_at(allowed, F.col("family"))))) > 0).alias("strange"))
    judged = scored.join(agreed, key, "left").join(strange, key, "left")
    sure = F.coalesce(F.col("sure") >= CONFIRM, F.lit(False))
    doubted = ~F.col("family").isin("unknown", "none") & (F.col("strange") | (F.coalesce("share", F.lit(0.0)) < AGREE) | (~sure & (F.col("score") < least)))
    judged = judged.select(*key, "score", F.when(doubted, "unknown").otherwise(F.col("family")).alias("family"), (sure & ~doubted).alias("confirmed"))

    licence = F.col("family") != "none"
    order = F.struct(licence.cast("int").alias("l"), "score", (-F.col("pos")).alias("p"), "family", "confirmed")
    # written, so that Spark can split the partition of a text with many copies
    per_text = stored(judged.groupBy("mark", "mark2").agg(F.count("*").alias("n_candidates"), F.sum(licence.cast("long")).alias("n_licences"), F.max(order).alias("m")))
    found = F.coalesce(F.col("m.l") == 1, F.lit(False))
    return base.join(per_text, ["mark", "mark2"], "left").select(
        "doc_id", "n_paragraphs", F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"), F.coalesce("n_licences", F.lit(0)).alias("n_licences"),
        F.when(found, F.col("m.family")).otherwise("none").alias("family"), F.when(found, F.col("m.score")).otherwise(0.0).alias("score"), F.when(found, F.col("m.confirmed")).otherwise(False).alias("confirmed"),
    )


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
