"""License scans: a trained paragraph classifier, calibrated, then confirmed against templates.

``train`` fits a multinomial logistic regression on sparse counts of word n-grams. Its rows are a bounded
set, SAMPLES_PER_CLASS a class, made from the TEMPLATES and NOTICES by dropping, swapping and adding words, and for
the class unknown from everyday sentences with the same words and from shuffled templates. Calibration never sees a
row of a template that its weights were trained on: each of FOLDS parts of the templates is held out whole and judged by weights
from the others. A temperature fitted on those rows calibrates the probabilities; ``accept`` is the least one at which their
predictions of a family are right with the wanted precision. ``confirmed`` compares a prediction with the family's templates and
short notices.

A paragraph is a line, or a run of lines between blank ones, where a line without letters and digits is blank. The words of all
templates and notices but the FUNCTION words are signals. What has none of them shares nothing telling with a template, so
it could not be confirmed; it has no features and is unknown by definition, and one gate on the text skips it. Lines with a
signal that hold a template are taken alone; the other lines of their paragraph are then read together, next the neighbouring
ones with signals, and last single lines that are part of a template.

Defined results: null and empty texts hold no licence; repeated rows are scanned alike; other columns pass by
untouched, clashing names are refused.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import table

SAMPLES_PER_CLASS = 240
PRECISION = 0.99
CONFIRM = 0.55
LONGEST_GRAM = 3
FOLDS = 3
UNKNOWN = "unknown"

# Notices and opening sentences of public licences, by family.
TEMPLATES = {
    "apache": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "mit": (
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "SPDX-License-Identifier: MIT",
    ),
    "bsd": (
        "Licensed under the 3-Clause BSD License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version.",
        "Released under the GPL v3.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "lgpl": (
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: LGPL-2.1-only",
    ),
    "agpl": (
        "Licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ),
    "mpl": (
        "Licensed under the Mozilla Public License, version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "cc-by": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ),
    "cc-by-sa": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply.",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC-SA 3.0.",
    ),
    "public-domain": (
        "This work has been released into the public domain.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0 Universal.",
        "This is free and unencumbered software released into the public domain.",
    ),
    "isc": (
        "Licensed under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "SPDX-License-Identifier: ISC",
    ),
    "epl": (
        "Licensed under the Eclipse Public License, version 2.0.",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
        "SPDX-License-Identifier: EPL-2.0",
    ),
    "bsl": (
        "Distributed under the Boost Software License, Version 1.0.",
        "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)",
        "SPDX-License-Identifier: BSL-1.0",
    ),
    "zlib": (
        "Licensed under the zlib License.",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "SPDX-License-Identifier: Zlib",
    ),
    "eupl": (
        "Licensed under the European Union Public Licence, version 1.2.",
        "Licensed under the EUPL, Version 1.2 or - as soon they will be approved by the European Commission - subsequent versions of the EUPL (the \"Licence\")",
        "SPDX-License-Identifier: EUPL-1.2",
    ),
    "proprietary": (
        "Copyright 2020 Example Corporation. All rights reserved.",
        "All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form without the prior written permission of the publisher.",
        "This software is proprietary and confidential. Unauthorized copying of this file is strictly prohibited.",
    ),
}


def _named(name: str) -> tuple[str, ...]:
    """The usual short notices of a licence in the languages of the texts."""
    return (
        f"Licensed under the {name} license.", f"Released under the {name} license.", f"Published under the terms of the {name} license.",
        f"Lizenziert unter der {name}-Lizenz.", f"Veröffentlicht unter der {name} Lizenz, Version 2.", f"Sous licence {name}, version 2.", f"Publié sous licence {name}.",
        f"Distribué selon les termes de la licence {name}.", f"Bajo la licencia {name}, versión 2.", f"Publicado bajo la licencia {name}.", f"Distribuido según los términos de la licencia {name}.",
    )


# Short notices by family, whole lines of their own.
NOTICES = {
    "apache": ("Apache License", "Apache License, Version 2.0", "License: Apache 2.0", "License: Apache-2.0", *_named("Apache"), *_named("Apache 2.0")),
    "mit": ("MIT License", "The MIT License (MIT)", "License: MIT", "MIT licensed", *_named("MIT")),
    "bsd": ("BSD License", "BSD 3-Clause License", "License: BSD", "License: BSD-3-Clause", *_named("BSD")),
    "gpl": ("GNU General Public License", "License: GPL", "License: GPLv3", "Distributed under GPLv3", *_named("GPL"), *_named("GNU GPL"), *_named("GNU General Public License")),
    "lgpl": ("GNU Lesser General Public License", "License: LGPL", "License: LGPLv2.1", "Distributed under LGPLv2.1", *_named("LGPL")),
    "agpl": ("GNU Affero General Public License", "License: AGPL", "License: AGPLv3", "Distributed under AGPLv3", *_named("AGPL")),
    "mpl": ("Mozilla Public License", "License: MPL", "License: MPLv2", "Distributed under MPLv2", *_named("MPL"), *_named("Mozilla Public License")),
    "cc-by": ("CC BY 4.0", "License: CC BY 4.0", "Creative Commons Attribution", *_named("CC BY"), "Dieses Werk ist lizenziert unter einer Creative Commons Namensnennung 4.0 International Lizenz.", "Cette œuvre est mise à disposition selon les termes de la Licence Creative Commons Attribution 4.0 International.", "Esta obra está bajo una Licencia Creative Commons Atribución 4.0 Internacional."),
    "cc-by-sa": ("CC BY-SA 4.0", "License: CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike", *_named("CC BY-SA"), "Dieses Werk ist lizenziert unter einer Creative Commons Namensnennung - Weitergabe unter gleichen Bedingungen 4.0 International Lizenz.", "Licence Creative Commons Attribution - Partage dans les Mêmes Conditions 4.0 International.", "Licencia Creative Commons Atribución-CompartirIgual 4.0 Internacional."),
    "cc-by-nc": ("CC BY-NC 4.0", "License: CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial", *_named("CC BY-NC"), "Creative Commons Namensnennung - Nicht kommerziell 4.0 International Lizenz.", "Licence Creative Commons Attribution - Pas d'Utilisation Commerciale 4.0 International.", "Licencia Creative Commons Atribución-NoComercial 4.0 Internacional."),
    "public-domain": ("This work is in the public domain.", "License: public domain", "License: CC0", "License: Unlicense", *_named("Unlicense"), "Released under the terms of the Unlicense.", "Dieses Werk ist gemeinfrei.", "Cette œuvre est dans le domaine public.", "Esta obra está en el dominio público."),
    "isc": ("ISC License", "License: ISC", "ISC licensed", *_named("ISC")),
    "epl": ("Eclipse Public License", "License: EPL-2.0", *_named("EPL"), *_named("Eclipse Public License")),
    "bsl": ("Boost Software License", "License: BSL-1.0", *_named("Boost Software License")),
    "zlib": ("zlib License", "License: zlib", *_named("zlib")),
    "eupl": ("European Union Public Licence", "License: EUPL", *_named("EUPL")),
    "proprietary": ("All rights reserved.", "Copyright 2020 Example. All rights reserved.", "License: proprietary", "Alle Rechte vorbehalten.", "Tous droits réservés.", "Todos los derechos reservados.", "© 2020 Example. Alle Rechte vorbehalten.", "© 2020 Example. Tous droits réservés.", "© 2020 Example. Todos los derechos reservados."),
}
# Sentences with licence words that are no licence.
EVERYDAY = (
    "He lost his driving license on the way to the town.", "The fishing license costs ten euros a year at the office.", "She has a license to teach at this school.", "The council may grant a license for the new shop.",
    "The public is free to use the garden without permission.", "Free software was the topic of the general meeting.", "The terms of the contract were published in the general report.", "You may copy the file to the other folder.",
    "The warranty of the car ends next year.", "A copyright law was debated in the public session.", "The copyright office moved to another building.", "All members may use the library in the village.",
    "Permission to leave was granted by the general.", "The foundation published a version of its report.", "The Mozilla office and the Apache helicopter were both in the news.", "The university of Massachusetts Institute of Technology, MIT, opened a laboratory.",
    "The creative class and the commons were themes of the lecture.", "They released the birds into the public park.", "Distribution of the leaflets is permitted in the station.", "Attribution of the painting is uncertain.",
    "The source of the river is under the hill.", "Software and documentation were delivered under the agreement.", "Redistribution of income is a political question.", "The domain was public and the rights were reserved for later.",
)
# Words of notices that say nothing by themselves, in the languages of the texts.
FUNCTION = frozenset(
    "a all an and any are as at be been but by can for from has have if in into is it no not of on or other see so such that the their them they this to was were which will with without work works you your "
    "above available distributed end events event following found free general held made may must new obtain part program provided public published purpose released retain source subject text this time use using version "
    "and das dem den der des die ein eine einer eines ist selon la le les de des du en est et à au aux une un sous dans por el los las una según con está esta es bajo obra cette dieses werk unter publié publicado publicada términos termes "
    "alle tous todos example software file files author authors code copy copying list form forms extent law person persons fee materials conditions terms damages implied express union european commission international "
    "program use modify distribute sublicense deal restriction including limitation pas one only nicht possible mise either kind later soon style option project prior related required apply additional basis charge "
    "versions versión writing written under universal org http https www txt unless except met appear applicable mêmes gleichen bedingungen kommerziell partage utilisation subsequent approved arising associated agreed".split()
)

# A version's v is a word of its own, as in GPLv3.
_WORD = re.compile(r"[^\W\d_]+?(?=v[0-9])|[^\W\d_]+|[0-9]+")
_FILLED = re.compile(r"[^\W_]")


def _words(text: str) -> list[str]:
    """The words of a text; numbers only say that there is one."""
    return ["0" if w[0].isdigit() else w for w in _WORD.findall(text.lower())]


#: Words that some template or notice has and that say something.
SIGNALS = frozenset(w for texts in (*TEMPLATES.values(), *NOTICES.values()) for t in texts for w in _words(t) if len(w) > 1) - FUNCTION


def signals(text: str) -> bool:
    return not SIGNALS.isdisjoint(_words(text))


def gate(text: Column) -> Column:
    """Whether a text may have a signal word: true for every text that has one. Words are cut at all but letters; a version's v may be their last."""
    known = sorted(SIGNALS | {w + "v" for w in SIGNALS})
    return F.arrays_overlap(F.split(F.lower(text), r"(?U)[^\p{L}]+", -1), F.array(*(F.lit(w) for w in known)))


def grams(text: str) -> list[str]:
    """Word n-grams up to LONGEST_GRAM; numbers only say that there is one. Empty without a signal word."""
    words = _words(text)
    if SIGNALS.isdisjoint(words):
        return []
    return [" ".join(words[i : i + n]) for n in range(1, LONGEST_GRAM + 1) for i in range(len(words) - n + 1)]


@dataclass(frozen=True)
class Classifier:
    """Weights by n-gram and class, with the temperature of the probabilities and the least accepted one."""

    families: tuple[str, ...]
    index: dict[str, int]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    accept: float

    def rows(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sparse counts as (row, column, value), each row of length 1; n-grams that were not trained on count in the length."""
        row, column, value = [], [], []
        for i, text in enumerate(texts):
            found = grams(text)
            known = [self.index[g] for g in found if g in self.index]
            row += [i] * len(known)
            column += known
            value += [1 / np.sqrt(max(len(found), 1))] * len(known)
        return np.array(row, np.int64), np.array(column, np.int64), np.array(value)

    def logits(self, texts: list[str]) -> np.ndarray:
        row, column, value = self.rows(texts)
        return self.bias + _sum_by(row, len(texts))(value[:, None] * self.weights[column])

    def probabilities(self, texts: list[str]) -> np.ndarray:
        return _softmax(self.logits(texts) / self.temperature)

    def classify(self, texts: list[str], inside: bool = True) -> list[tuple[str, float]]:
        """Family and probability; unknown where nothing is accepted and confirmed, with inside also as a part of a template."""
        if not texts:
            return []
        chances = self.probabilities(texts)
        best = chances.argmax(axis=1)
        out = []
        for text, k, row in zip(texts, best.tolist(), chances, strict=True):
            family, chance = self.families[k], float(row[k])
            sure = family != UNKNOWN and chance >= self.accept and confirmed(text, family, inside=inside)
            out.append((family, chance) if sure else (UNKNOWN, float(row[self.families.index(UNKNOWN)])))
        return out


def _softmax(logits: np.ndarray) -> np.ndarray:
    powers = np.exp(logits - logits.max(axis=1, keepdims=True))
    return powers / powers.sum(axis=1, keepdims=True)


def _bigrams(text: str) -> frozenset:
    words = _words(text)
    return frozenset(zip(words, words[1:])) if len(words) > 1 else frozenset(words)


@lru_cache(maxsize=None)
def _known(family: str) -> list[frozenset]:
    """The word pairs of a family's templates and notices."""
    return [_bigrams(t) for t in (*TEMPLATES[family], *NOTICES[family])]


def _share(own: frozenset, family: str, inside: bool, left_out: int | None) -> float:
    known = [t for i, t in enumerate(_known(family)) if left_out is None or i % FOLDS != left_out]
    return max(max(len(own & t) / len(t), len(own & t) / len(own) if inside and len(own) >= 4 else 0.0) for t in known)


def confirmed(text: str, family: str, least: float = CONFIRM, inside: bool = True, left_out: int | None = None) -> bool:
    """Whether the text has at least this share of the word pairs of a template or notice of the family, or, with inside, one of them this
    share of the text's; and whether no other family has a greater share.

    A text inside a template counts from four pairs; shorter ones must be notices. left_out is a fold of the family's templates that is not looked at.
    """
    own = _bigrams(text)
    share = _share(own, family, inside, left_out) if own else 0.0
    return share >= least and all(_share(own, f, inside, None) <= share for f in TEMPLATES if f != family)


def _variants(texts: tuple[str, ...], n: int, rng: np.random.Generator, noise: list[str]) -> list[str]:
    out = list(texts)
    while len(out) < n:
        words = texts[len(out) % len(texts)].split()
        words = [w for w in words if rng.random() > 0.06] or words
        for _ in range(rng.integers(0, 6)):
            words.insert(int(rng.choice([0, len(words)])), str(rng.choice(noise)))
        if rng.random() < 0.3 and len(words) > 8:
            words = words[: int(rng.integers(6, len(words)))]
        text = " ".join(words)
        out.append(text.upper() if rng.random() < 0.1 else text.lower() if rng.random() < 0.2 else text)
    return out[:n]


def _scrambled(n: int, rng: np.random.Generator) -> list[str]:
    words = [w for texts in TEMPLATES.values() for t in texts for w in t.split()]
    return [" ".join(rng.choice(words, int(rng.integers(3, 25))).tolist()) for _ in range(n)]


def _sum_by(keys: np.ndarray, n: int) -> Callable[[np.ndarray], np.ndarray]:
    """Sums of rows by key, for n keys."""
    order = np.argsort(keys, kind="stable")
    at = np.flatnonzero(np.concatenate(([True], keys[order][1:] != keys[order][:-1]))) if len(keys) else np.zeros(0, np.int64)
    present = keys[order][at]

    def run(rows: np.ndarray) -> np.ndarray:
        out = np.zeros((n, rows.shape[1]), rows.dtype)
        if len(at):
            out[present] = np.add.reduceat(rows[order], at, axis=0)
        return out

    return run


def _fitted(families: tuple[str, ...], texts: list[str], target: np.ndarray, steps: int) -> Classifier:
    """Weights by gradient steps with momentum over the counts of all rows."""
    counts: dict[str, int] = {}
    for text in texts:
        for g in set(grams(text)):
            counts[g] = counts.get(g, 0) + 1
    index = {g: i for i, g in enumerate(sorted(g for g, n in counts.items() if n >= 3))}
    weights, bias = np.zeros((len(index), len(families)), np.float32), np.zeros(len(families), np.float32)
    row, column, value = Classifier(families, index, weights, bias, 1.0, 0.5).rows(texts)
    # The training rows are bounded, so their counts fit as a full matrix, which BLAS multiplies faster than sparse sums run.
    counted = np.zeros((len(texts), len(index)), np.float32)
    np.add.at(counted, (row, column), value.astype(np.float32))
    wanted = np.eye(len(families), dtype=np.float32)[target]
    speed_w, speed_b = np.zeros_like(weights), np.zeros_like(bias)
    for _ in range(steps):
        error = (_softmax(counted @ weights + bias) - wanted) / np.float32(len(texts))
        speed_w = 0.9 * speed_w - 12.0 * (counted.T @ error + 1e-5 * weights)
        speed_b = 0.9 * speed_b - 2.0 * error.sum(axis=0)
        weights, bias = weights + speed_w, bias + speed_b
    return Classifier(families, index, weights.astype(np.float64), bias.astype(np.float64), 1.0, 0.5)


@lru_cache(maxsize=4)
def train(samples: int = SAMPLES_PER_CLASS, precision: float = PRECISION, seed: int = 7, steps: int = 120) -> Classifier:
    """The classifier, from a fixed seed, calibrated on rows of templates that were held out whole."""
    rng = np.random.default_rng(seed)
    noise = [w for t in EVERYDAY for w in t.split()]
    families = (*TEMPLATES, UNKNOWN)
    texts, labels, folds = [], [], []
    for k, family in enumerate(families):
        source = (*TEMPLATES[family], *NOTICES[family]) if family != UNKNOWN else EVERYDAY
        for fold in range(FOLDS):
            own = source[fold::FOLDS]
            rows = _variants(own, samples // FOLDS if family != UNKNOWN else samples, rng, noise)
            rows += _scrambled(samples, rng) if family == UNKNOWN else []
            texts, labels, folds = texts + rows, labels + [k] * len(rows), folds + [fold] * len(rows)
    target, fold_of = np.array(labels), np.array(folds)
    held = np.zeros((len(texts), len(families)))
    for fold in range(FOLDS):
        inside, outside = np.flatnonzero(fold_of != fold), np.flatnonzero(fold_of == fold)
        held[outside] = _fitted(families, [texts[i] for i in inside], target[inside], steps).logits([texts[i] for i in outside])
    loss = lambda t: -np.log(_softmax(held / t)[np.arange(len(target)), target] + 1e-12).mean()
    temperature = float(min(np.geomspace(0.2, 5, 60), key=loss))
    chances = _softmax(held / temperature)
    guess, top = chances.argmax(axis=1), chances.max(axis=1)
    # What counts are predictions that templates of the other folds confirm.
    sure = np.array([families[g] != UNKNOWN and t >= 0.2 and confirmed(x, families[g], left_out=f if g == y else None) for x, g, t, f, y in zip(texts, guess.tolist(), top.tolist(), folds, labels, strict=True)])
    right = lambda a: (guess[sure & (top >= a)] == target[sure & (top >= a)])
    accept = next((float(a) for a in np.linspace(0.2, 0.95, 31) if right(a).size and right(a).mean() >= precision), 0.95)
    model = _fitted(families, texts, target, steps)
    return Classifier(families, model.index, model.weights, model.bias, temperature, accept)


def find(text: str, model: Classifier) -> list[tuple[str, int, int, float]]:
    """(family, start, end, probability) of a text's licence paragraphs, in code points."""
    # (start, end, signal) of the lines by paragraph; a line without letters and digits parts two.
    paragraphs: list[list[tuple[int, int, bool]]] = [[]]
    at = 0
    for line in text.split("\n"):
        if _FILLED.search(line):
            paragraphs[-1].append((at, at + len(line), signals(line)))
        elif paragraphs[-1]:
            paragraphs.append([])
        at += len(line) + 1
    lines = [(a, b) for p in paragraphs for a, b, signal in p if signal]

    def read(places: list[tuple[int, int]], inside: bool = True) -> list[tuple[str, int, int, float]]:
        return [(f, a, b, p) for (a, b), (f, p) in zip(places, model.classify([text[a:b].replace("\n", " ") for a, b in places], inside), strict=True) if f != UNKNOWN]

    def rest(found: list[tuple[str, int, int, float]], every: bool) -> list[tuple[int, int]]:
        """Runs of two or more lines with a signal that no span has: of all lines of a paragraph, or of those with a signal."""
        taken, runs = [(a, b) for _, a, b, _ in sorted(found, key=lambda x: x[1])], []
        k = 0
        for paragraph in paragraphs:
            run: list[tuple[int, int, bool]] = []
            for a, b, signal in [*paragraph, (-1, -1, False)]:
                while a >= 0 and k < len(taken) and taken[k][1] < a:
                    k += 1
                free = a >= 0 and not (k < len(taken) and taken[k][0] <= a)
                if free and (signal or every):
                    run.append((a, b, signal))
                    continue
                if len(run) > 1 and any(s for *_, s in run):
                    runs.append((run[0][0], run[-1][1]))
                run = []
        return runs

    found = read(lines, False)
    found += read(rest(found, True))
    found += read(rest(found, False))
    taken = sorted((a, b) for _, a, b, _ in found)
    starts = [a for a, _ in taken]
    found += read([(a, b) for a, b in lines if not (k := bisect_right(starts, a)) or taken[k - 1][1] <= a])
    return sorted(found, key=lambda x: x[1])


def with_licenses(df: DataFrame, text: str = "text", model: Classifier | None = None) -> DataFrame:
    """df with licenses, an array of (family, start, end, probability). One pass; texts without a signal word stay in the JVM's filter."""
    if clash := {"licenses", "license_text"} & set(df.columns):
        raise ValueError(f"columns in the way: {sorted(clash)}")
    fitted = model or train()
    kind = T.ArrayType(T.StructType().add("family", "string").add("start", "long").add("end", "long").add("probability", "double"))
    arrow = pa.list_(pa.struct([("family", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("probability", pa.float64())]))
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(len(names)).to_pylist()
            found = [[{"family": f, "start": a, "end": b, "probability": p} for f, a, b, p in find(t, fitted)] if t else [] for t in column]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(found, arrow)], [*names, "licenses"])

    gated = df.withColumn("license_text", F.when(gate(F.col(text)), F.col(text)))
    return gated.mapInArrow(run, T.StructType([*df.schema.fields]).add("licenses", kind))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence paragraphs of every document: their number, families and places."""
    documents = table(spark, sf_dir, "documents")
    # Only the gated text goes to Python.
    rows = documents.select("doc_id", F.when(gate(F.col("text")), F.col("text")).alias("text"))
    found = with_licenses(rows)
    return found.select(
        "doc_id", F.size("licenses").cast("long").alias("n_licenses"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("licenses", lambda x: x["family"]))), ",").alias("families"),
        F.array_join(F.transform("licenses", lambda x: F.concat_ws(":", x["family"], x["start"].cast("string"), x["end"].cast("string"))), ",").alias("spans"),
    )
