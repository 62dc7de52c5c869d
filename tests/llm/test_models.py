import random
import re
import zlib

import numpy as np
import pytest

from patchloom.llm import common, licenses, quality_model, toxicity

DOCS = "doc_id long, text string"


def corpus():
    draw = random.Random(6)
    good = [f"w{i}" for i in range(60)]
    out = []
    for i in range(240):
        n = draw.randint(20, 60)
        kind = i % 4
        words = draw.choices(good, k=n)
        if kind == 0:
            words = [w.upper() + "!!" for w in words]
        if kind == 1:
            for at in draw.sample(range(n), 6):
                words[at] = draw.choice(["idiot", "trash", "moron"])
        out.append((i, " ".join(words), int(kind != 0), int(kind == 1)))
    return out


@pytest.fixture(scope="module")
def tables(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t) for i, t, _, _ in rows] + [(900, None), (901, ""), (None, "w1 w2")], DOCS).repartition(2)
    labels = spark.createDataFrame([(i, q, x) for i, _, q, x in rows] + [(5, 1, 1), (None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    return docs, labels


def held(i, by=4, rest=2):
    return zlib.crc32(str(i).encode()) % by == rest


def test_ftrl_equals_a_plain_loop():
    draw = np.random.default_rng(4)
    learner = quality_model.FTRL(12)
    z, n = [0.0] * 12, [0.0] * 12
    for _ in range(200):
        index = np.sort(draw.choice(12, 4, replace=False))
        value, label = draw.random(4), float(draw.random() < 0.5)
        learner.learn(index, value, label)
        w = [0.0 if abs(z[i]) <= quality_model.L1 else -(z[i] - np.sign(z[i]) * quality_model.L1) / ((quality_model.BETA + n[i] ** 0.5) / quality_model.ALPHA + quality_model.L2) for i in index]
        p = 1 / (1 + np.exp(-sum(a * b for a, b in zip(w, value))))
        for i, v, own in zip(index, value, w):
            g = (p - label) * v
            z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / quality_model.ALPHA * own
            n[i] += g * g
    assert np.allclose(learner.z, z) and np.allclose(learner.n, n)


def test_sample_is_bounded_by_rows(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(500)] + [(1, "same")] * 200 + [(2, "two")], DOCS).repartition(3)
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    got = quality_model.labelled_sample(docs, labels, "quality", 50, held_out=5)
    assert 5 < got.count() < 120 and got.where("text = 'same'").count() <= 1


def test_kinds_part_toxic_documents():
    rows = toxicity.Rows(np.array([0, 1, 0, 1, 2, 3, 2, 3, 0, 2]), np.array([0, 2, 4, 6, 8, 10]), np.array([1.0, 1, 1, 1, 0]), np.zeros(5))
    kind = toxicity.kinds_of(rows, 4)
    assert kind[0] == kind[1] != kind[2] == kind[3] and kind[4] == -1


def test_quality_on_held_out(tables):
    docs, labels = tables
    weights = quality_model.train(quality_model.labelled_sample(docs, labels, "quality", 1000))
    got = {r["doc_id"]: r["score"] for r in quality_model.score_quality(docs, weights, ["doc_id"]).collect()}
    out = [(i, q) for i, _, q, _ in corpus() if held(i)]
    assert len(out) > 30 and np.mean([(got[i] >= 0.7) == q for i, q in out]) > 0.9
    assert 0 < got[901] < 1 and got[900] == got[901] and len(got) == 243
    none = quality_model.train(quality_model.labelled_sample(docs, labels.limit(0), "quality", 1000))
    assert {r["score"] for r in quality_model.score_quality(docs, none, ["doc_id"]).collect()} == {0.5}


def test_dot_product_equals_direct(tables):
    draw = np.random.default_rng(1)
    weights = draw.normal(size=(1 << quality_model.BITS) + 1)
    texts = [t.encode() for _, t, _, _ in corpus()[:20]] + [b"", None]
    together = quality_model.margins(texts, weights)
    alone = [float(sum(weights[i] * v for i, v in zip(*x))) for x in quality_model._examples(texts)]
    assert np.allclose(together, alone)


def test_toxicity_on_held_out(tables):
    docs, labels = tables
    model = toxicity.train_chain(toxicity.labelled_sample(docs, labels, "toxic", 1000))
    assert list(model.weights) == ["kind_1", "kind_2", "toxic"]
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(docs, model, ["doc_id"]).collect()}
    out = [(i, x) for i, _, _, x in corpus() if held(i)]
    assert np.mean([(got[i]["p_toxic"] > toxicity.THRESHOLD) == x for i, x in out]) > 0.9
    assert got[900]["p_toxic"] == got[901]["p_toxic"] < 0.5
    empty = toxicity.train_chain(toxicity.labelled_sample(docs, labels.limit(0), "toxic", 1000))
    assert {r["p_toxic"] for r in toxicity.score_toxicity(docs, empty, ["doc_id"]).collect()} == {0.5}


@pytest.mark.parametrize(
    "text, base, labels, n_base",
    [
        ("Released under the MIT License.", {"mit"}, {"mit", "mit-notice"}, 1),
        ("This fine work is licensed under the terms of the GNU General Public License, version 3.", {"gpl"}, {"gpl", "gpl-3.0"}, 1),
        ("licensed under the GNU General Public License either version 2", {"gpl"}, {"gpl", "gpl-2.0"}, 1),
        ("licensed under the GNU General Private License version 2", set(), set(), 0),
        ("Licensed under the Apache License, Version 2.0; apache license", {"apache"}, {"apache", "apache-2.0"}, 2),
        ("mit license mit license", {"mit"}, {"mit"}, 2),
        ("Licensed under a CC BY-NC 4.0", {"cc-by"}, {"cc-by", "cc-by-nc-4.0"}, 1),
        (None, set(), set(), 0),
    ],
)
def test_license_templates(text, base, labels, n_base):
    found = licenses.Scanner().scan(text.encode() if text else None)
    assert (found[4], found[5], found[1]) == (base, labels, n_base)


GPL = "This program is free software{} you can redistribute it and/or modify\nit under the terms of the GNU{} General Public License as published by\nthe Free Software Foundation{} either version {} of the License, or\n(at your option) any later version."
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell"""
MIT_REST = """ copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""
ISC = """Permission to use, copy, modify, and distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR
ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF
OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any
means.

In jurisdictions that recognize copyright laws, the author or authors
of this software dedicate any and all copyright interest in the
software to the public domain. We make this dedication for the benefit
of the public at large and to the detriment of our heirs and
successors. We intend this dedication to be an overt act of
relinquishment in perpetuity of all present and future rights to this
software under copyright law.
""" + MIT_REST[MIT_REST.index("THE SOFTWARE IS") :].replace("THE\nAUTHORS OR COPYRIGHT HOLDERS", "THE AUTHORS") + "\n\nFor more information, please refer to <https://unlicense.org/>"
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:"""
BSD_3 = """3. Neither the name of the copyright holder nor the names of its
contributors may be used to endorse or promote products derived from
this software without specific prior written permission."""


@pytest.mark.parametrize(
    "text, labels",
    [
        (MIT, {"mit-grant"}),
        (MIT + MIT_REST, {"mit-grant", "mit-text"}),
        (MIT + MIT_REST.replace("THE\nAUTHORS OR COPYRIGHT HOLDERS", "ACME Corp"), {"mit-grant", "mit-text"}),
        (MIT + MIT_REST.replace("substantial", "other"), {"mit-grant"}),
        (ISC, {"isc-text"}),
        (GPL.format(":", "", ",", 3), {"gpl", "gpl-3.0"}),
        (GPL.format(";", "", ";", 2), {"gpl", "gpl-2.0"}),
        (GPL.format(":", " Lesser", ",", 3), {"lgpl-3.0"}),
        (GPL.format(";", " Lesser", ";", 2.1), {"lgpl-2.1"}),
        (GPL.format(":", " Affero", ",", 3), {"agpl-3.0"}),
        ('Licensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance with the License.', {"apache", "apache-2.0"}),
        ("Apache License\n    Version 2.0, January 2004\n    http://www.apache.org/licenses/", {"apache", "apache-2.0"}),
        ("This work is licensed under a Creative Commons Attribution 4.0 International License.", {"cc-by-4.0"}),
        ("Creative Commons Attribution-NonCommercial 4.0 International Public License", {"cc-by-nc-4.0"}),
        ("This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this file", {"mpl-2.0"}),
        ("Mozilla Public License Version 2.0\n==================================\n\n1. Definitions\n--------------", {"mpl-2.0"}),
        (GPL.format(";", " Library", ";", 2), {"lgpl-2.0"}),
        ("Creative Commons Attribution-ShareAlike 4.0 International Public License", {"cc-by-sa-4.0"}),
        ("This text is licensed under CC BY-SA 4.0.", {"cc-by", "cc-by-sa-4.0"}),
        ("To the extent possible under law, A. Person has waived all copyright and\nrelated or neighboring rights to this work.", {"cc0-1.0"}),
        ("Creative Commons Legal Code\n\nCC0 1.0 Universal", {"cc0-1.0"}),
        ("Distributed under the Boost Software License, Version 1.0.", {"boost-1.0"}),
        (UNLICENSE, {"unlicense-text"}),
        (BSD, {"bsd-grant"}),
        (BSD + "\n1. Redistributions of source code must retain the above copyright notice.\n" + BSD_3, {"bsd-grant", "bsd-3-clause"}),
        ("Released under the MIT License", {"mit", "mit-notice"}),
    ],
)
def test_license_templates_find_the_published_wording(text, labels):
    found = licenses.Scanner().scan(f"/* Copyright 2020 A. Person\n\n{text} */ import os".encode())
    assert found[5] == labels and found[7] == 1.0
    assert licenses.Scanner().scan(" ".join(text.split()[::-1]).encode())[7] < 1.0


def test_whole_licenses_accept_only_their_wording():
    scanner = licenses.Scanner()
    draw = random.Random(4)
    for label, markup in licenses.TEMPLATES.items():
        if not label.endswith("-text"):
            continue
        parts = re.split(r"(<<[^>]*>>)", markup)
        for _ in range(20):
            words, skip, fixed = [], False, []
            for part in parts:
                if part.startswith("<<optional"):
                    skip, inside = draw.random() < 0.5, True
                elif part.startswith("<<end"):
                    skip, inside = False, False
                elif part.startswith("<<any"):
                    words += [] if skip else draw.choices(["acme", "inc", "2020"], k=draw.randint(0, int(part[5:-2])))
                elif not skip:
                    own = [w.decode() for w in common.alnum_words(part.encode())]
                    fixed += [] if part != parts[0] and inside else range(len(words), len(words) + len(own))
                    words += own
                inside = part.startswith("<<optional") or (not part.startswith("<<end") and locals().get("inside", False))
            assert label in scanner.scan(" ".join(words).encode())[5]
            words[draw.choice(fixed)] = "changed"
            assert label not in scanner.scan(" ".join(words).encode())[5]


def test_license_places_equal_brute_force(tables):
    draw = random.Random(9)
    scanner = licenses.Scanner()
    pieces = [p.split() for p in licenses.BASE] + [["mit"], ["by"], ["cc"], ["x"], ["license"]]
    for _ in range(200):
        words = [w for _ in range(draw.randint(0, 25)) for w in draw.choice(pieces)]
        places = [i for p in licenses.BASE for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        n, n_base, first, last, *_ = scanner.scan(" ".join(words).encode())
        assert (n, n_base, first, last) == (len(words), len(places), min(places, default=None), max(places, default=None))
    docs, _ = tables
    assert licenses.scan_licenses(docs, ["doc_id"]).count() == 243


def test_automaton_equals_enumeration():
    made = licenses.compile_template("t", "a <<optional>>b <<end>>c <<any 2>> d")
    accepted = {("a", *b, "c", *x, "d") for b in ((), ("b",)) for x in [(), *[(p,) for p in "abcd"], *[(p, q) for p in "abcd" for q in "abcd"]]}
    draw = random.Random(1)
    for _ in range(3000):
        words = tuple(draw.choices("abcd", k=draw.randint(1, 7)))
        n = made.accepts_at([w.encode() for w in words])
        want = min((len(a) for a in accepted if words[: len(a)] == a), default=0)
        assert n == want
