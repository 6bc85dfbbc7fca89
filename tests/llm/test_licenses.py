"""The positional index against a plain search of every template at every place."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lattica.llm import licenses as L

TEMPLATES = L.templates_of()


def plain(words: list[str], index: L.Index) -> set[str]:
    """Labels of the templates that reach the share at some place and whose key phrases stand there."""
    at: dict = {}
    for i, w in enumerate(words):
        at.setdefault(w, []).append(i)
    return {index.labels[t] for t in range(len(TEMPLATES)) for o in range(-60, len(words)) if index.score(t, o, at) >= index.least and index.verified(t, o, words)}


@pytest.fixture(scope="module")
def index():
    return L.Index(TEMPLATES, L.PHRASES, 24, 3, 0.6)


def test_index_finds_what_a_plain_search_finds(index):
    rng = random.Random(3)
    filler = [f"w{i}" for i in range(50)] + ["the", "license", "under", "version", "2", "0", "gnu", "by", "4"]
    n = 0
    for _ in range(200):
        words = [rng.choice(filler) for _ in range(rng.randrange(30))]
        for _ in range(rng.randrange(3)):
            own = rng.choice(TEMPLATES)[1].split()
            own = [w for w in own if rng.random() > 0.05]
            k = rng.randrange(len(words) + 1)
            words[k:k] = own
        got, want = set(index.matches(words)), plain(words, index)
        assert got == want
        n += len(want)
    assert n > 100


@pytest.mark.parametrize(
    ("line", "label"),
    [
        ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0"),
        ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"),
        ("Released under the MIT License.", "MIT"),
        ("Licensed under the Apache License, Version 2.0.", "Apache-2.0"),
        (L.NOTICES["BSD-2-Clause"][0], "BSD-2-Clause"),
        ("the mit campus issued a license for the house", None),
        ("they studied under the apache and took a license", None),
    ],
)
def test_lines(index, line, label):
    found = index.matches(L.WORD.findall(line.lower()))
    assert (label in found) if label else not found


def test_licensed_documents_of_the_corpus(spark):
    """Of the documents in which a base phrase stands, most get a label beyond the base; of the others none does."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = L.scan(docs.select("doc_id", "text")).cache()
    base = found.where(F.size("places") > 0)
    assert base.count() >= 15 and base.where(F.size("matches") > 0).count() >= 0.9 * base.count()
    assert found.where((F.size("places") == 0) & (F.size("matches") > 0)).count() == 0


def test_long_texts_and_other_templates(spark):
    text = "word " * 40_000 + "Released under the MIT License. " + "license the under " * 20_000
    rows = spark.createDataFrame([(1, text), (1, text), (2, None), (3, "")], "doc_id long, text string").withColumn("matches", F.lit(1)).withColumn("_f", F.lit(2))
    got = L.scan(rows).collect()
    assert [[m.template for m in x.matches] for x in got] == [["MIT"], ["MIT"], [], []] and got[0].n_words == 100_005
    own = L.scan(rows.limit(1), templates=[("x", "released under", ("released",))]).first()
    assert [m.template for m in own.matches] == ["x"]


# Public file headers and texts, as they stand in files.
HEADERS = {
    "GPL-2.0": "# This program is free software; you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation; either version 2 of the License, or\n# (at your option) any later version.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL-2.1": " * This library is free software; you can redistribute it and/or\n * modify it under the terms of the GNU Lesser General Public\n * License as published by the Free Software Foundation; either\n * version 2.1 of the License, or (at your option) any later version.",
    "LGPL-3.0": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "AGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MPL-2.0": "// This Source Code Form is subject to the terms of the Mozilla Public\n// License, v. 2.0. If a copy of the MPL was not distributed with this\n// file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "BSD-2-Clause": "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\"",
    "BSD-3-Clause": "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\"",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "CC-BY-4.0": "Creative Commons Attribution 4.0 International Public License",
    "CC-BY-SA-4.0": "Creative Commons Attribution-ShareAlike 4.0 International Public License",
    "CC-BY-NC-4.0": "Creative Commons Attribution-NonCommercial 4.0 International Public License",
    "CC-BY-ND-4.0": "Creative Commons Attribution-NoDerivatives 4.0 International Public License",
    "CC0-1.0": "To the extent possible under law, the person who associated CC0 with this work has waived all copyright and related or neighboring rights to this work.",
}


@pytest.mark.parametrize("label", HEADERS)
def test_headers_and_texts(index, label):
    """Each is found alone, between other words, and with a word lost or put in outside its key phrases, under its own label only."""
    words = L.WORD.findall(HEADERS[label].lower())
    assert set(index.matches(words)) == {label}
    assert set(index.matches(["import", "sys"] * 20 + words + ["def", "main"] * 20)) == {label}
    if len(words) > 20:
        keys = [k for t, _, ks in TEMPLATES if t == label for k in ks]
        for at in range(len(words)):
            own = [*words[:at], *words[at + 1 :]]
            if all(f" {k} " in f" {' '.join(own)} " for k in keys if f" {k} " in f" {' '.join(words)} "):
                assert set(index.matches(own)) == {label}
