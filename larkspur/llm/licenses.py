"""License scans with a positional index of the templates' rarest words.

A word's rarity is its inverse document frequency over all scanned texts, counted for the templates' vocabulary. Of each template the
rarest words, as many as it takes to hold ANCHORS of its weight, stand in an index from word to (template, position). A text's own
licence words of highest rarity are looked up there; a posting gives a relative position, that is where the template would begin, and
postings of one template whose relative positions differ by SLACK at most are added up. Where a template can't come to LEAST of its weight any more, the place is
left; since all but the anchors together weigh 1 - ANCHORS, no place of LEAST is lost by that. What stays is weighed with
all its words, each within SLACK of its position, and must hold every mandatory key phrase as it stands. Names and years between the words of a notice are so
passed over, and clauses that are left out cost their weight.

A place of a template is a relative position at which one of its anchors stands exactly. Of the places of a template that overlap the one with the largest share
is reported, of equal ones that with the most weight exactly in its position, then the first. The base phrases are found by their words alone, all places.

Defined results: a null text is empty and has no words, places or labels; words are the maximal runs of ASCII letters and digits and of
characters beyond ASCII, with A-Z lower-cased; rows that repeat, or whose id is null or repeats, are scanned each; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm._words import Words, over_chunks, words_of
from larkspur.llm.lexical import FOLD

#: Share of a template's weight that a place must have, share that its indexed words hold, words that a word may be off its position.
LEAST, ANCHORS, SLACK = 0.8, 0.6, 4
#: Words of all templates together: they travel to all tasks.
MOST_WORDS = 200_000
#: Cells that are compared at once.
CELLS = 4_000_000


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    phrases: tuple[str, ...]


# Phrases whose words alone give a label.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# The wording of public licenses' notices, and the phrases without which a notice isn't one of that license.
_GRANT = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
TEMPLATES = (
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", ("permission is hereby granted free of charge", "copies or substantial portions of the software")),
    Template("mit", "Released under the MIT License.", ("mit license",)),
    Template("mit", "Licensed under the MIT License.", ("mit license",)),
    Template("mit", "SPDX-License-Identifier: MIT", ("spdx license identifier mit",)),
    Template("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.", ("apache license version 2 0",)),
    Template("apache", "Licensed under the Apache License, Version 2.0.", ("apache license",)),
    Template("apache", "SPDX-License-Identifier: Apache-2.0", ("spdx license identifier apache 2 0",)),
    *(Template(label, _GRANT.format(name, version), (f"{name.lower()} as published", f"version {version} of the license")) for label, name, version in (("gpl-2", "General Public License", 2), ("gpl-3", "General Public License", 3), ("lgpl-2", "Lesser General Public License", 2), ("lgpl-3", "Lesser General Public License", 3), ("agpl-3", "Affero General Public License", 3))),
    *(Template(f"gpl-{version}", f"This work is licensed under the GNU General Public License, version {version}.", (f"gnu general public license version {version}",)) for version in (1, 2, 3)),
    *(Template(f"gpl-{version}", f"SPDX-License-Identifier: GPL-{version}.0", (f"spdx license identifier gpl {version} 0",)) for version in (1, 2, 3)),
    Template("bsd", _BSD, ("redistribution and use in source and binary forms", "with or without modification are permitted")),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", ("for any purpose with or without fee is hereby granted",)),
    Template("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions", ("alter it and redistribute it freely",)),
    Template("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", ("mozilla public license",)),
    Template("boost", "Distributed under the Boost Software License, Version 1.0.", ("boost software license",)),
    Template("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.", ("unencumbered software released into the public domain",)),
    Template("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", ("waived all copyright and related or neighboring rights",)),
    *(Template(f"cc-{kind.replace(' ', '-')}", f"Licensed under CC {kind} 4.0.", (f"under cc {kind} 4 0",)) for kind in ("by", "by sa", "by nc", "by nd", "by nc sa", "by nc nd")),
)


def _split(text: str) -> list[bytes]:
    return text.encode().translate(FOLD).split()


def _folded(texts: list[bytes]) -> Words:
    return words_of([t.translate(FOLD) for t in texts])


class Index:
    """The templates with the words' weights: every word's number, and for the anchors (template, position) by word."""

    def __init__(self, templates: tuple[Template, ...], df: dict[bytes, int], n_docs: int):
        self.labels = [t.label for t in templates]
        words = [_split(t.text) for t in templates]
        if any(not w for w in words) or sum(map(len, words)) > MOST_WORDS:
            raise ValueError(f"templates need words, {MOST_WORDS} at most together")
        self.phrases = sorted({p for t in templates for p in t.phrases} | set(BASE))
        self.needs = [[self.phrases.index(p) for p in t.phrases] for t in templates]
        self.spelled = [_split(p) for p in self.phrases]
        self.number = {w: i for i, w in enumerate(sorted({w for ws in words + self.spelled for w in ws}))}
        weight = np.array([math.log((n_docs + 1) / (df.get(w, 0) + 0.5)) for w in self.number])
        weight = np.maximum(weight, 1e-3)
        self.words = [np.array([self.number[w] for w in ws]) for ws in words]
        self.weights = [weight[w] / weight[w].sum() for w in self.words]
        self.anchors = []
        postings: list[tuple[int, int, int]] = []
        for t, (w, share) in enumerate(zip(self.words, self.weights, strict=True)):
            # equal words go together; the rarest first
            order = np.lexsort((np.arange(len(w)), w, -weight[w]))
            upto = np.cumsum(share[order])
            last = w[order[min(int(np.searchsorted(upto, ANCHORS - 1e-9)), len(w) - 1)]]
            some = {int(x) for x in w[order[: np.flatnonzero(w[order] == last)[-1] + 1]]}
            self.anchors.append(some)
            postings += [(int(x), t, q) for q, x in enumerate(w) if int(x) in some]
        postings.sort()
        self.posted = np.array(postings, np.int64).reshape(-1, 3)
        self.starts = np.searchsorted(self.posted[:, 0], np.arange(len(self.number) + 1))
        self.posted_weight = np.array([self.weights[t][q] for _, t, q in postings])
        self.need = np.array([sum(s for s, x in zip(share, w.tolist(), strict=True) if x in some) for share, w, some in zip(self.weights, self.words, self.anchors, strict=True)]) + LEAST - 1


def _phrase_places(at: np.ndarray, phrase: list[int], owners: np.ndarray) -> np.ndarray:
    """Where the phrase's words stand one after the other in one text."""
    n = len(at) - len(phrase) + 1
    if n <= 0:
        return np.empty(0, np.int64)
    places = np.flatnonzero(at[:n] == phrase[0])
    for k, word in enumerate(phrase[1:], 1):
        places = places[at[places + k] == word]
    return places[owners[places] == owners[places + len(phrase) - 1]]


def _found(at: np.ndarray, w: Words, index: Index, phrases: list[np.ndarray]) -> list[tuple[int, int, int, float]]:
    """(text, template, first word, share) of each place of a template, all words numbered through."""
    owners, offsets = w.owners, w.offsets
    hits = np.flatnonzero((at >= 0) & (np.diff(index.starts)[at] > 0))
    many = np.diff(index.starts)[at[hits]]
    posting = np.repeat(index.starts[at[hits]], many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
    place = np.repeat(hits, many)
    template, begin = index.posted[posting, 1], place - index.posted[posting, 2]
    # postings of one template and text whose relative positions are near are added up; texts are kept apart by wide gaps
    span = SLACK + 1 + max(map(len, index.words))
    key = template * (len(at) + (len(w.counts) + 2) * 2 * span) + begin + owners[place] * 2 * span + span
    order = np.argsort(key, kind="stable")
    key, template, begin, text, upto = key[order], template[order], begin[order], owners[place[order]], np.cumsum(np.append(0.0, index.posted_weight[posting[order]]))
    hoped = upto[np.searchsorted(key, key + SLACK, "right")] - upto[np.searchsorted(key, key - SLACK, "left")]
    stays = np.flatnonzero((hoped >= index.need[template] - 1e-9) & np.append(True, key[1:] != key[:-1]))
    out = []
    for t in np.unique(template[stays]).tolist():
        own = stays[template[stays] == t]
        words, share = index.words[t], index.weights[t]
        step = max(1, CELLS // (len(words) * (2 * SLACK + 1)))
        best: tuple[int, int, int, float] | None = None
        straight = 0.0
        for some in (own[i : i + step] for i in range(0, len(own), step)):
            lo, hi = offsets[text[some]], offsets[text[some] + 1]
            has, exact = np.zeros((len(some), len(words)), bool), np.empty(0)
            for off in range(-SLACK, SLACK + 1):
                where = begin[some][:, None] + np.arange(len(words)) + off
                inside = (where >= lo[:, None]) & (where < hi[:, None])
                same = inside & (at[np.clip(where, 0, len(at) - 1)] == words)
                has |= same
                exact = (same * share).sum(1) if not off else exact
            score = (has * share).sum(1)
            good = score >= LEAST - 1e-9
            for p in index.needs[t]:
                first = np.searchsorted(phrases[p], np.maximum(begin[some] - SLACK, lo))
                last = np.minimum(begin[some] + len(words) + SLACK, hi) - len(index.spelled[p])
                good &= (first < len(phrases[p])) & (np.append(phrases[p], len(at))[first] <= last)
            for i in np.flatnonzero(good).tolist():
                now = (int(text[some[i]]), t, int(begin[some[i]]), float(score[i]))
                if best and best[0] == now[0] and now[2] < best[2] + len(words):
                    if (round(now[3], 9), round(exact[i], 9)) > (round(best[3], 9), round(straight, 9)):
                        best, straight = now, exact[i]
                    continue
                if best:
                    out.append(best)
                best, straight = now, exact[i]
        if best:
            out.append(best)
    return out


_MATCH = T.StructType([T.StructField("label", T.StringType()), T.StructField("template", T.IntegerType()), T.StructField("first_word", T.LongType()), T.StructField("share", T.DoubleType())])
_PLACE = T.StructType([T.StructField("label", T.StringType()), T.StructField("first_word", T.LongType())])


def _vocabulary_counts(texts: DataFrame, vocabulary: list[bytes]) -> tuple[dict[bytes, int], int]:
    """In how many texts each word of the vocabulary is, and how many texts there are."""
    size = len(vocabulary)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, out = {w: i for i, w in enumerate(vocabulary)}, np.zeros(size + 1, np.int64)

        def add(_: pa.RecordBatch, some: list[bytes]) -> list[pa.RecordBatch]:
            w = _folded(some)
            at = np.fromiter((number.get(x, -1) for x in w.distinct), np.int64, len(w.distinct))[w.ids]
            known = np.flatnonzero(at >= 0)
            out[:size] += np.bincount(np.unique(w.owners[known] * size + at[known]) % size, minlength=size)
            out[size] += len(some)
            return []

        yield from over_chunks(batches, "text", add)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size + 1)), pa.array(out)], ["at", "n"])

    found = texts.mapInArrow(counted, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()  # a row a word of the templates
    counts = dict(zip(found.column("at").to_pylist(), found.column("n").to_pylist(), strict=True))
    return {w: counts.get(i, 0) for i, w in enumerate(vocabulary)}, counts.get(size, 0)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """(id, n_words, base, found): base has (label, first_word) of each place of a base phrase, found (label, template, first_word, share) of each place of a template.

    first_word counts from 0; of a template whose first words are cut off it is below where its words begin, and may be negative.
    """
    given = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    vocabulary = sorted({w for t in templates for w in _split(t.text)})
    df, n_docs = _vocabulary_counts(given.select("text"), vocabulary)
    index = Index(templates, df, n_docs)
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("n_words", T.LongType()), T.StructField("base", T.ArrayType(_PLACE)), T.StructField("found", T.ArrayType(_MATCH))])
    kinds = [pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64())])), pa.list_(pa.struct([("label", pa.string()), ("template", pa.int32()), ("first_word", pa.int64()), ("share", pa.float64())]))]

    def looked_up(batch: pa.RecordBatch, texts: list[bytes]) -> list[pa.RecordBatch]:
        w = _folded(texts)
        base: list[list[dict]] = [[] for _ in texts]
        found: list[list[dict]] = [[] for _ in texts]
        if len(w.ids):
            at = np.fromiter((index.number.get(x, -1) for x in w.distinct), np.int64, len(w.distinct))[w.ids]
            owners, offsets = w.owners, w.offsets
            places = [_phrase_places(at, [index.number[x] for x in p], owners) for p in index.spelled]
            for phrase, label in BASE.items():
                for p in places[index.phrases.index(phrase)].tolist():
                    base[owners[p]].append({"label": label, "first_word": p - int(offsets[owners[p]])})
            for text, t, begin, share in _found(at, w, index, places):
                found[text].append({"label": index.labels[t], "template": t, "first_word": begin - int(offsets[text]), "share": min(1.0, share)})
        return [pa.RecordBatch.from_arrays([batch.column(0), pa.array(w.counts), pa.array(base, kinds[0]), pa.array(found, kinds[1])], schema.names)]

    return given.mapInArrow(lambda batches: over_chunks(batches, "text", looked_up), schema)
