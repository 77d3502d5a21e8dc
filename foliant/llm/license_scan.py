"""Licence scans: matching statistics from a suffix automaton of templates, chained into covered spans.

The words of all templates make one automaton, as large as the templates and
held by every worker.  A document's words are streamed through it; at each word
it knows the longest run of words up to there that some template holds.  Runs
that cannot grow any more are anchors, placed in every template that holds them,
and anchors of a template that follow one another with small gaps, in the
document and in the template, chain into a span.  The share of the template's
words that a chain covers decides.  Short phrases are templates of their own,
found wherever they stand whole.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words of the shortest anchor; largest gap between anchors of a chain, in words; share of a template that gives its label.
ANCHOR, GAP, COVER = 4, 30, 0.6
#: Bytes of a document that are split into words at a time.
CHUNK = 8_000_000

# Phrases and the labels they stand for.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Public notices and grants, with their labels.
TEMPLATES = [
    ("mit", "Released under the MIT License."),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the "
        "Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies "
        "of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        "copyright notice and this permission notice appear in all copies.",
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary "
        "form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials "
        "provided with the distribution.",
    ),
    (
        "apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy "
        "of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the "
        "License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free "
        "Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be "
        "useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    ),
    (
        "lgpl",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the "
        "Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ),
    (
        "mpl-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can "
        "obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
]

_WORD_BYTES = bytes(range(48, 58)) + bytes(range(97, 123)) + bytes(range(128, 256))
_PLAIN = bytes(ord(chr(b).lower()) if 65 <= b <= 90 else b if b in _WORD_BYTES else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    """Words of a text, A-Z in lower case: runs of ASCII letters and digits and of all characters beyond ASCII."""
    return text.encode().translate(_PLAIN).split()


class Automaton:
    """Suffix automaton of the words of several templates.

    State 0 is the empty run.  ``size`` is the longest run of a state, ``link``
    the state of the longest shorter run with more places, ``next`` the state
    that a word leads to.
    """

    def __init__(self, templates: list[tuple[str, list[bytes]]]):
        self.labels, self.lengths = [t[0] for t in templates], [len(t[1]) for t in templates]
        if min(self.lengths, default=2) < 2:
            raise ValueError("a template or phrase needs two words")
        self.numbers: dict[bytes, int] = {}
        self.size, self.link, self.next, self.ends = [0], [-1], [{}], [[]]
        pairs = set()
        for t, (_, words) in enumerate(templates):
            ids = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in words]
            pairs.update(zip(ids, ids[1:]))
            state = 0
            for at, w in enumerate(ids):
                state = self._grow(state, w)
                self.ends[state].append((t, at))
        self._pairs = np.zeros((len(self.numbers) + 1,) * 2, bool) if len(self.numbers) < 4000 else None
        self._codes = np.array(sorted(a << 32 | b for a, b in pairs), dtype=np.int64)
        if self._pairs is not None:
            for a, b in pairs:
                self._pairs[a, b] = True
        self._below: list[list[int]] = [[] for _ in self.size]
        for s, up in enumerate(self.link[1:], 1):
            self._below[up].append(s)
        self._places: dict[int, list[tuple[int, int]]] = {}

    def _new(self, size: int, link: int, moves: dict[int, int]) -> int:
        self.size.append(size)
        self.link.append(link)
        self.next.append(moves)
        self.ends.append([])
        return len(self.size) - 1

    def _split(self, parent: int, word: int) -> int:
        """The state of the run of ``parent`` and ``word``, parted from longer runs that shared it."""
        old = self.next[parent][word]
        if self.size[old] == self.size[parent] + 1:
            return old
        new = self._new(self.size[parent] + 1, self.link[old], dict(self.next[old]))
        self.link[old] = new
        while parent >= 0 and self.next[parent].get(word) == old:
            self.next[parent][word] = new
            parent = self.link[parent]
        return new

    def _grow(self, last: int, word: int) -> int:
        """The state of the whole template so far, ``word`` being its next."""
        if word in self.next[last]:
            return self._split(last, word)
        new = self._new(self.size[last] + 1, 0, {})
        while last >= 0 and word not in self.next[last]:
            self.next[last][word] = new
            last = self.link[last]
        if last >= 0:
            self.link[new] = self._split(last, word)
        return new

    def places(self, state: int) -> list[tuple[int, int]]:
        """Templates, and where in them the runs of a state end."""
        got = self._places.get(state)
        if got is None:
            got, todo = [], [state]
            while todo:
                s = todo.pop()
                got += self.ends[s]
                todo += self._below[s]
            self._places[state] = got
        return got

    def known_pairs(self, ids: np.ndarray) -> np.ndarray:
        """Whether each two words in a row are so in a template."""
        a, b = ids[:-1], ids[1:]
        if self._pairs is not None:
            return self._pairs[a, b]
        code = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self._codes, code), len(self._codes) - 1)
        return self._codes[at] == code

    def stream(self, ids: list[int]) -> Iterator[tuple[int, int]]:
        """For each word the state and the length of the longest run that ends with it: the matching statistics."""
        state = size = 0
        moves, link, longest = self.next, self.link, self.size
        for w in ids:
            while state and w not in moves[state]:
                state = link[state]
                size = longest[state]
            state = moves[state].get(w, 0)
            size = size + 1 if state else 0
            yield state, size


class Scanner:
    """Phrases and covered spans of a document."""

    def __init__(self, phrases: dict[str, str], templates: list[tuple[str, str]], anchor: int, gap: int, cover: float):
        self.short, self.anchor, self.gap, self.cover = len(phrases), anchor, gap, cover
        both = [(label, words_of(p)) for p, label in phrases.items()] + [(label, words_of(t)) for label, t in templates]
        self.auto, self._known = Automaton(both), {}

    def ids(self, text: str) -> np.ndarray:
        data, get, parts, begin = text.encode().translate(_PLAIN), self.auto.numbers.get, [], 0
        while begin < len(data):
            end = data.find(b" ", begin + CHUNK) + 1 or len(data)
            parts.append(np.array([get(w, 0) for w in data[begin:end].split()], dtype=np.int32))
            begin = end
        return np.concatenate(parts) if parts else np.zeros(0, np.int32)

    def matches(self, ids: np.ndarray) -> tuple[list[tuple[int, int]], list[tuple[int, int, int]]]:
        """Phrases as (start, phrase), and anchors as (end, length, state); a run of two words or more lies in known pairs."""
        if len(ids) < 2:
            return [], []
        auto, phrases, anchors = self.auto, [], []
        edges = np.flatnonzero(np.diff(np.concatenate([[0], auto.known_pairs(ids).view(np.int8), [0]])))
        for first, last in zip(edges[0::2].tolist(), edges[1::2].tolist(), strict=True):
            held = None
            for at, (state, size) in enumerate(auto.stream(ids[first : last + 1].tolist()), first):
                if held and size <= held[1] and held[1] >= self.anchor:  # it could not grow
                    anchors.append(held)
                held = at, size, state
                for t, length in self._phrases(state):
                    if length <= size:
                        phrases.append((at - length + 1, t))
            if held and held[1] >= self.anchor:
                anchors.append(held)
        return phrases, anchors

    def _phrases(self, state: int) -> list[tuple[int, int]]:
        """Phrases that end runs of the state, with their lengths."""
        got = self._known.get(state)
        if got is None:
            got, s = [], state
            while s > 0:
                got += [(t, at + 1) for t, at in self.auto.ends[s] if t < self.short and at + 1 == self.auto.lengths[t]]
                s = self.auto.link[s]
            self._known[state] = got
        return got

    def chains(self, anchors: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
        """Spans as (template, begin, end, covered words), the best first; no anchor is in two of one template.

        An anchor goes on from the chain before it that covers most, among those
        that end within the gap; where two overlap only the new words count.
        """
        placed = defaultdict(list)  # by template: end in document, end in template, length
        for end, size, state in anchors:
            for t, at in self.auto.places(state):
                if t >= self.short:
                    placed[t].append((end, at, min(size, at + 1)))
        spans = []
        for t, items in placed.items():
            items.sort()
            best: list[tuple[int, int]] = []  # covered words, the anchor before
            low = 0
            for end, at, size in items:
                got = size, -1
                while low < len(best) and items[low][0] < end - size - self.gap:
                    low += 1
                for j in range(low, len(best)):
                    end0, at0, _ = items[j]
                    if end0 >= end or at0 >= at:
                        continue
                    new = min(size, end - end0, at - at0)  # the words beyond both ends
                    if end - new - end0 <= self.gap and at - new - at0 <= self.gap and best[j][0] + new > got[0]:
                        got = best[j][0] + new, j
                best.append(got)
            used = [False] * len(items)
            for k in sorted(range(len(items)), key=lambda k: (-best[k][0], k)):
                path, j = [], k
                while j >= 0:
                    path.append(j)
                    j = best[j][1]
                if any(used[j] for j in path):
                    continue
                for j in path:
                    used[j] = True
                head = items[path[-1]]
                spans.append((t, head[0] - head[2] + 1, items[k][0] + 1, best[k][0]))
        return spans

    def __call__(self, text: str) -> dict:
        ids = self.ids(text)
        phrases, anchors = self.matches(ids)
        names, lengths = self.auto.labels, self.auto.lengths
        chains = [(names[t], a, z, covered / lengths[t]) for t, a, z, covered in self.chains(anchors)]
        spans = sorted((x for x in chains if x[3] >= self.cover), key=lambda x: (x[1], x[2], x[0]))
        base = {names[t] for _, t in phrases}
        starts = [a for a, _ in phrases]
        return {
            "n_words": len(ids), "n_base": len(phrases), "first_word": min(starts, default=None), "last_word": max(starts, default=None),
            "base_labels": sorted(base), "labels": sorted(base | {x[0] for x in spans}), "score": 1.0 if phrases else max((x[3] for x in chains), default=0.0),
            "spans": [dict(zip(("label", "begin", "stop", "coverage"), x, strict=True)) for x in spans],
        }


_FOUND = (
    "n_words long, n_base long, first_word long, last_word long, base_labels array<string>, labels array<string>, score double, "
    "spans array<struct<label: string, begin: bigint, stop: bigint, coverage: double>>"
)


def scan_licenses(
    docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: list[tuple[str, str]] = TEMPLATES, anchor: int = ANCHOR, gap: int = GAP,
    cover: float = COVER, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per document: ``id_col, n_words, n_base, first_word, last_word, base_labels, labels, score, spans``.

    ``n_base`` counts the places where a phrase stands, ``first_word`` and
    ``last_word`` are the first and last of them (null if none).  ``spans`` holds
    the chains that cover ``cover`` of a template, in words from 0, ends
    exclusive; their labels join those of the phrases in ``labels``.  ``score``
    is the largest share of a template, or of a phrase, that a chain covers.

    A null text counts as empty.  Null and repeated ids are kept, one row each;
    an empty table gives an empty result; other columns are ignored.  A worker
    holds the automaton, one text, its word numbers, and its anchors.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")))
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *T.StructType.fromDDL(_FOUND)])
    arrow = to_arrow_schema(schema)
    scanner = docs.sparkSession.sparkContext.broadcast(Scanner(phrases, templates, anchor, gap, cover))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = scanner.value
        for b in batches:
            found = [scan(x.as_py()) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([f[c.name] for f in found], c.type) for c in list(arrow)[1:]]], schema=arrow)

    return rows.mapInArrow(run, schema)
