"""License scans: a positional index of rare licence words.

Templates are licence notices: the short forms in which a licence is named
(``FORMS`` by ``NAMES``), file headers and parts of full texts that tell licences
apart (``NOTICES``), and ``HEADINGS`` of legal texts.  The index holds the
words that stand in at most a quarter of the templates, with their inverse
template frequency (IDF) and postings (template, position).

A file's licence words are looked up by falling IDF, ``look_up`` of them for each
template that their postings name.  Each occurrence votes, with its word's IDF,
for a relative position of the template in the file; the postings of a template
intersect where its votes, within a small slack, meet.  A position is scored by
the IDF of the template's rare words that stand in their places there.  From the
``least`` share on it is a match if the template's mandatory key phrases stand
word for word inside it; positions are tried by falling support.

Null and empty texts have no words, no places and score 0.  Repeated rows are
scanned alike.  Texts of any length are processed whole.  Columns of the input
are carried along; added columns replace those of the same name.  Tables without
rows give none.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Mapping, Sequence
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}
# Phrases and the label that each stands for.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Licences by their public identifiers, and the names that notices give them.
NAMES = {
    "MIT": ("mit license",),
    "Apache-2.0": ("apache license version 2 0", "apache 2 0 license"),
    "GPL-2.0": ("gnu general public license version 2", "gnu gpl v2"),
    "GPL-3.0": ("gnu general public license version 3", "gnu gpl v3"),
    "LGPL-2.1": ("gnu lesser general public license version 2 1",),
    "LGPL-3.0": ("gnu lesser general public license version 3",),
    "AGPL-3.0": ("gnu affero general public license version 3",),
    "MPL-2.0": ("mozilla public license version 2 0",),
    "BSD-2-Clause": ("bsd 2 clause license",),
    "BSD-3-Clause": ("bsd 3 clause license",),
    "ISC": ("isc license",),
    "CC-BY-4.0": ("cc by 4 0", "creative commons attribution 4 0 international license"),
    "CC-BY-SA-4.0": ("cc by sa 4 0", "creative commons attribution sharealike 4 0 international license"),
    "CC-BY-NC-4.0": ("cc by nc 4 0", "creative commons attribution noncommercial 4 0 international license"),
    "CC-BY-ND-4.0": ("cc by nd 4 0", "creative commons attribution noderivatives 4 0 international license"),
    "CC0-1.0": ("cc0 1 0 universal",),
}
# The ways in which a notice names a licence.
FORMS = ("licensed under the {}", "licensed under {}", "released under the {}", "distributed under the terms of the {}", "available under the {}")
# Full notices, file headers and parts of texts that tell licences apart, and the phrases that each must hold.
NOTICES = {
    "MIT": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies",
        ("permission is hereby granted", "without restriction"),
    ),
    "Apache-2.0": (
        "licensed under the apache license version 2 0 you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org "
        "licenses license 2 0 unless required by applicable law or agreed to in writing",
        ("apache license", "version 2 0"),
    ),
    "GPL-2.0": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation "
        "either version 2 of the license or at your option any later version",
        ("gnu general public license", "free software foundation", "version 2 of the license"),
    ),
    "GPL-3.0": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation "
        "either version 3 of the license or at your option any later version",
        ("gnu general public license", "free software foundation", "version 3 of the license"),
    ),
    "LGPL-2.1": (
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software "
        "foundation either version 2 1 of the license or at your option any later version",
        ("gnu lesser general public license", "free software foundation", "version 2 1 of the license"),
    ),
    "LGPL-3.0": (
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software "
        "foundation either version 3 of the license or at your option any later version",
        ("gnu lesser general public license", "free software foundation", "version 3 of the license"),
    ),
    "AGPL-3.0": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software "
        "foundation either version 3 of the license or at your option any later version",
        ("gnu affero general public license", "free software foundation", "version 3 of the license"),
    ),
    "MPL-2.0": (
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http "
        "mozilla org mpl 2 0",
        ("mozilla public license v 2 0",),
    ),
    "BSD-2-Clause": (
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials "
        "provided with the distribution this software is provided by the copyright holders and contributors as is",
        ("redistributions in binary form", "with the distribution this software is provided by"),
    ),
    "BSD-3-Clause": (
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials "
        "provided with the distribution neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
        "software without specific prior written permission",
        ("redistributions in binary form", "neither the name of", "endorse or promote products derived from this software"),
    ),
    "ISC": (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this "
        "permission notice appear in all copies",
        ("with or without fee is hereby granted",),
    ),
    "CC0-1.0": (
        "to the extent possible under law the person who associated cc0 with this work has waived all copyright and related or neighboring rights to this work",
        ("to the extent possible under law", "cc0", "waived all copyright"),
    ),
}
# Headings of the legal texts.
HEADINGS = {
    "CC-BY-4.0": (
        "creative commons attribution 4 0 international public license",
        ("creative commons attribution 4 0 international public license",),
    ),
    "CC-BY-SA-4.0": (
        "creative commons attribution sharealike 4 0 international public license",
        ("attribution sharealike 4 0 international",),
    ),
    "CC-BY-NC-4.0": (
        "creative commons attribution noncommercial 4 0 international public license",
        ("attribution noncommercial 4 0 international",),
    ),
    "CC-BY-ND-4.0": (
        "creative commons attribution noderivatives 4 0 international public license",
        ("attribution noderivatives 4 0 international",),
    ),
    "CC0-1.0": (
        "creative commons legal code cc0 1 0 universal",
        ("cc0 1 0 universal",),
    ),
}
Template = tuple[str, str, tuple[str, ...]]


def templates_of(names: Mapping[str, Sequence[str]] = NAMES, forms: Sequence[str] = FORMS, notices: Mapping[str, tuple[str, Sequence[str]]] = NOTICES, headings: Mapping[str, tuple[str, Sequence[str]]] = HEADINGS) -> list[Template]:
    """(label, words, key phrases) of every name in every form, whose key phrase is the name, and of every notice and heading."""
    short = [(label, form.format(name), (name,)) for label, own in names.items() for name in own for form in forms]
    return short + [(label, text, tuple(keys)) for own in (notices, headings) for label, (text, keys) in own.items()]


class Index:
    """Postings of the templates' rare words, and the phrases as word lists."""

    def __init__(self, templates: Sequence[Template], phrases: Mapping[str, str], look_up: int, slack: int, least: float) -> None:
        self.phrases = [(p, tuple(p.split()), label) for p, label in phrases.items()]
        self.look_up, self.slack, self.least = look_up, slack, least
        self.labels = [label for label, _, _ in templates]
        self.keys = [[k.split() for k in keys] for _, _, keys in templates]
        words = [WORD.findall(text) for _, text, _ in templates]
        self.length = [len(w) for w in words]
        held = Counter(w for own in words for w in set(own))
        self.idf = {w: math.log1p(len(templates) / n) for w, n in held.items() if 4 * n <= max(4, len(templates))}
        self.postings: dict[str, list[tuple[int, int]]] = defaultdict(list)
        self.rare: list[list[tuple[int, str]]] = [[(p, w) for p, w in enumerate(own) if w in self.idf] for own in words]
        for t, own in enumerate(self.rare):
            for p, w in own:
                self.postings[w].append((t, p))
        self.templates = {w: list(Counter(t for t, _ in own).items()) for w, own in self.postings.items()}
        self.weight = [sum(self.idf[w] for _, w in own) for own in self.rare]

    def places(self, words: list[str], joined: str) -> list[tuple[int, str]]:
        """Starts and labels of the places where a phrase's words follow one another."""
        out = []
        for phrase, parts, label in self.phrases:
            if f" {phrase} " not in joined:
                continue
            for i, w in enumerate(words):
                if w == parts[0] and tuple(words[i : i + len(parts)]) == parts:
                    out.append((i, label))
        return out

    def matches(self, words: list[str]) -> dict[str, tuple[int, float]]:
        """Best start and score of each label of which a template stands in the file."""
        idf = self.idf
        held = idf.keys() & set(words)
        present: dict[int, float] = defaultdict(float)
        for w in held:
            for t, n in self.templates[w]:
                present[t] += n * idf[w]
        likely = {t for t, x in present.items() if x >= self.least * self.weight[t] - 1e-9}
        if not likely:
            return {}
        at: dict[str, list[int]] = defaultdict(list)
        for i, w in enumerate(words):
            if w in held:
                at[w].append(i)
        seen: Counter = Counter()
        votes: dict[int, Counter] = defaultdict(Counter)
        for w in sorted(held, key=lambda w: (-idf[w], w)):
            for t, own in groupby(self.postings[w], key=lambda x: x[0]):
                if t in likely and seen[t] < self.look_up:
                    seen[t] += 1
                    for _, p in own:
                        for i in at[w]:
                            votes[t][i - p] += idf[w]
        out: dict[str, tuple[int, float]] = {}
        for t, found in votes.items():
            near = {o: sum(found[o + d] for d in range(-self.slack, self.slack + 1)) for o in list(found)}
            best = out.get(self.labels[t], (0, 0.0))[1]
            for o in sorted(near, key=lambda o: (-near[o], o)):
                score = self.score(t, o, at)
                if score >= self.least and score > best and self.verified(t, o, words):
                    out[self.labels[t]] = (o, score)
                    break
        return out

    def score(self, t: int, offset: int, at: Mapping[str, list[int]]) -> float:
        hit = []
        for p, w in self.rare[t]:
            own = at.get(w, ())
            k = bisect_left(own, offset + p - self.slack)
            if k < len(own) and own[k] <= offset + p + self.slack:
                hit.append(self.idf[w])
        return sum(hit) / self.weight[t]  # as the weight is summed, so that a whole template scores 1

    def verified(self, t: int, offset: int, words: list[str]) -> bool:
        """Whether the template's key phrases stand word for word where it is put."""
        window = f" {' '.join(words[max(0, offset - self.slack) : offset + self.length[t] + self.slack])} "
        return all(f" {' '.join(k)} " in window for k in self.keys[t])


def scan(docs: DataFrame, templates: Sequence[Template] | None = None, phrases: Mapping[str, str] | None = None, look_up: int = 24, slack: int = 3, least: float = 0.6) -> DataFrame:
    """``docs`` with n_words, places (start, label), matches (template, start, score) and score."""
    index = Index(templates_of() if templates is None else templates, PHRASES if phrases is None else phrases, look_up, slack, least)

    def one(text: str | None) -> tuple[int, list, list, float]:
        words = WORD.findall(text.translate(LOWER) if not text.isascii() else text.lower()) if text else []
        if not words:
            return 0, [], [], 0.0
        places = index.places(words, f" {' '.join(words)} ")
        matches = sorted((label, max(0, o), score) for label, (o, score) in index.matches(words).items())
        return len(words), sorted(places), matches, min(1.0, max([0.5 * bool(places), *(s for _, _, s in matches)]))

    found = F.pandas_udf(
        lambda s: pd.DataFrame([one(t) for t in s], columns=["n_words", "places", "matches", "score"]),
        "n_words long, places array<struct<start:long,label:string>>, matches array<struct<template:string,start:long,score:double>>, score double",
    )
    return docs.drop("n_words", "places", "matches", "score", "_f").withColumn("_f", found("text")).select("*", "_f.*").drop("_f")
