"""Licence classifier: held-out accuracy, templates, unknown texts, spans."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.llm import licenses


def test_held_out_accuracy():
    model, rng = licenses.train(), np.random.default_rng(99)
    noise = [w for t in licenses.EVERYDAY for w in t.split()]
    right = total = wrong = 0
    for family, templates in licenses.TEMPLATES.items():
        for text, (guess, _) in zip(v := licenses._variants(templates, 60, rng, noise), model.classify(v)):
            total, right, wrong = total + 1, right + (guess == family), wrong + (guess not in (family, licenses.UNKNOWN))
    assert right / total > 0.85 and wrong / total < 0.02


def test_templates_and_unknown():
    model = licenses.train()
    for family, templates in licenses.TEMPLATES.items():
        assert [f for f, _ in model.classify(list(templates))] == [family] * len(templates)
    assert {f for f, _ in model.classify(list(licenses.EVERYDAY))} == {licenses.UNKNOWN}
    assert model.classify(["Sie fahren mit dem Zug nach Hause, the of and."])[0][0] == licenses.UNKNOWN


def test_probabilities_are_calibrated():
    model, rng = licenses.train(), np.random.default_rng(5)
    noise = [w for t in licenses.EVERYDAY for w in t.split()]
    texts, truth = [], []
    for k, family in enumerate(model.families):
        own = licenses._variants(licenses.TEMPLATES[family], 40, rng, noise) if family != licenses.UNKNOWN else licenses._scrambled(40, rng)
        texts, truth = texts + own, truth + [k] * len(own)
    chances = model.probabilities(texts)
    assert abs((chances.argmax(1) == truth).mean() - chances.max(1).mean()) < 0.08


def test_query(spark, tmp_path):
    wrapped = "Use of this source code is governed by a BSD-style license\nthat can be found in the LICENSE file."
    texts = [None, "", "é\nReleased under the MIT License.\nmore", "no\nLicensed under CC BY-NC 4.0.\nThis work is licensed under the GNU General Public License, version 3.", wrapped, "plain words " * 500]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.n_licenses, r.families, r.spans) for r in licenses.op7_licenses(spark, str(tmp_path)).collect()}
    assert got[0] == got[1] == got[5] == (0, "", "")
    assert got[2] == (1, "mit", "mit:2:33")
    assert got[3][1] == "cc-by-nc,gpl"
    assert got[4][1] == "bsd"


def test_empty_and_clashing(spark):
    rows = spark.createDataFrame([], "doc_id long, text string, family string")
    assert licenses.with_licenses(rows).collect() == []
    with pytest.raises(ValueError):
        licenses.with_licenses(rows.withColumnRenamed("family", "licenses"))


SHORT = {
    "All rights reserved.": "proprietary", "ALL RIGHTS RESERVED": "proprietary", "(c) 1999 Harbour Press. All rights reserved.": "proprietary", "MIT License": "mit", "License: MIT": "mit", "license = MIT": "mit",
    "distributed under GPLv3": "gpl", "Licensed under GPLv2": "gpl", "licensed under LGPLv2.1": "lgpl", "License: AGPLv3": "agpl", "released under MPLv2": "mpl",
}


def test_short_notices():
    model = licenses.train()
    assert {t: [f for f, *_ in licenses.find(f"some words\n\n{t}\n\nmore", model)] for t in SHORT} == {t: [f] for t, f in SHORT.items()}
    plain = ["the license of the car", "He reserved all the rooms by right.", "the public domain of the town was closed", "MIT opened a laboratory for the license of teachers"]
    assert [licenses.find(t, model) for t in plain] == [[]] * len(plain)


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:"""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies."""
AFTER = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY."""


@pytest.mark.parametrize(("family", "body"), [("mit", MIT), ("isc", ISC)])
def test_wrapped_files(family, body):
    text = f"Copyright (c) 2020 Jane Roe\n\n{body}\n\n{AFTER}\n"
    spans = [(f, text[a:b]) for f, a, b, _ in licenses.find(text, licenses.train())]
    assert (family, body) in spans
    commented = "\n".join(f"# {x}".rstrip() for x in text.split("\n")) + "\nimport os\n"
    assert family in {f for f, *_ in licenses.find(commented, licenses.train())}


def test_gate_lets_every_signal_pass(spark):
    texts = ["GPLv3", "LGPLv2.1", "xgplv3", "gplvx", "AGPLv3license", "license", "licensev", "mplv2", "Tous droits réservés", "RÉSERVÉS", "die MIT-Lizenz", "x_license_y", "日本license", "license2", "plain words", "", "Namensnennung", "a\u0301license"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").withColumn("gate", licenses.gate(F.col("text"))).collect()
    assert not [r.text for r in rows if licenses.signals(r.text) and not r.gate]
    assert [r.gate for r in rows if r.text in ("plain words", "")] == [False, False]


# Notices that no template was made from: (text, family).
FOREIGN = [
    ("Licensed under the Eclipse Public License 2.0", "epl"), ("Distributed under the Boost Software License", "bsl"), ("Alle Rechte vorbehalten.", "proprietary"), ("Sous licence Apache, version 2.0", "apache"),
    ("Lizenziert unter der MIT-Lizenz.", "mit"), ("Published under the terms of the Unlicense.", "public-domain"), ("Redistributions of source code must retain the above copyright notice.", "bsd"),
    ("Ce logiciel est distribué sous licence GPL v3.", "gpl"), ("Este programa se publica bajo la licencia MIT.", "mit"), ("Todos los derechos reservados por el autor.", "proprietary"), ("See the Mozilla Public License 2.0 for details.", "mpl"),
    ("The module is released under the Apache License 2.0.", "apache"), ("This file is licensed under the BSD license", "bsd"), ("Tous droits réservés à l'auteur.", "proprietary"), ("Veröffentlicht unter der GPL, Version 2.", "gpl"),
    ("Images are licensed under CC BY-SA 3.0.", "cc-by-sa"), ("Text and images: CC BY-NC 3.0", "cc-by-nc"), ("Code in this folder is published under the ISC license", "isc"), ("Distributed under the GNU Affero General Public License", "agpl"),
    ("Licensed under the EUPL, Version 1.1", "eupl"), ("Released under the zlib license", "zlib"), ("Bajo la licencia LGPL, versión 3.", "lgpl"),
]
PLAIN = [
    "Der Führerschein ist eine Lizenz zum Fahren, sagte er.", "La licencia de pesca cuesta diez euros.", "Il a perdu sa licence de pêche dans la rivière.", "Les droits de la ville furent votés.", "She won the general election for the public library.",
    "Creative people met at the commons.", "A copyright dispute delayed the film.", "The foundation of the house is weak.", "They granted him permission to leave early.", "Die Rechte der Bürger sind wichtig.",
]


def test_notices_outside_the_templates():
    model = licenses.train()
    got = [(t, [f for f, *_ in licenses.find(t, model)]) for t, _ in FOREIGN]
    right = sum(g == [f] for (_, g), (_, f) in zip(got, FOREIGN))
    assert right >= 0.9 * len(FOREIGN), [(t, g) for (t, g), (_, f) in zip(got, FOREIGN) if g != [f]]
    assert not [(t, g) for (t, g), (_, f) in zip(got, FOREIGN) if g and g != [f]]
    assert [licenses.find(t, model) for t in PLAIN] == [[]] * len(PLAIN)


def slow_classify(text, model):
    """The classifier by plain loops over words."""
    import math
    import re

    words = ["0" if w[0].isdigit() else w for w in re.findall(r"[^\W\d_]+?(?=v[0-9])|[^\W\d_]+|[0-9]+", text.lower())]
    known = {f: [x for t in (*licenses.TEMPLATES[f], *licenses.NOTICES[f]) for x in [pairs(["0" if w[0].isdigit() else w for w in re.findall(r"[^\W\d_]+?(?=v[0-9])|[^\W\d_]+|[0-9]+", t.lower())])]] for f in licenses.TEMPLATES}
    every = [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)] if licenses.SIGNALS & set(words) else []
    logits = [float(b) for b in model.bias]
    for g in every:
        if g in model.index:
            for k in range(len(logits)):
                logits[k] += model.weights[model.index[g]][k] / math.sqrt(len(every))
    powers = [math.exp(x / model.temperature) for x in logits]
    chances = [p / sum(powers) for p in powers]
    best = max(range(len(chances)), key=chances.__getitem__)
    family, own = model.families[best], pairs(words)
    if family == licenses.UNKNOWN or chances[best] < model.accept:
        return licenses.UNKNOWN
    share = {f: max([len(own & t) / len(t) for t in known[f]] + [len(own & t) / len(own) for t in known[f] if len(own) >= 4]) for f in known}
    return family if share[family] >= 0.55 and share[family] == max(share.values()) else licenses.UNKNOWN


def pairs(words):
    return set(zip(words, words[1:])) if len(words) > 1 else set(words)


def test_classes_match_brute_force():
    model, rng = licenses.train(), np.random.default_rng(17)
    noise = [w for t in licenses.EVERYDAY for w in t.split()]
    texts = [t for t, _ in FOREIGN] + PLAIN + licenses._scrambled(60, rng) + [t for f in licenses.TEMPLATES for t in licenses._variants(licenses.TEMPLATES[f], 12, rng, noise)] + ["", "license", "MIT", "…"]
    assert [f for f, _ in model.classify(texts)] == [slow_classify(t, model) for t in texts]


def test_spans_are_paragraphs_of_long_and_repeated_texts():
    model = licenses.train()
    notice = "Released under the MIT License."
    text = "\n".join([notice, "words " * 20_000, "", notice, notice])
    got = [(f, text[a:b]) for f, a, b, _ in licenses.find(text, model)]
    assert got == [("mit", notice)] * 3
