"""License scans with a generalised suffix automaton.

The automaton holds the words of all license templates (each in a path of its own). Texts stream through it and give matching statistics: at
each word the longest run ending there that occurs in some template. Maximal long runs become anchors, at every place of a template where the
run occurs. The anchors of a template, with short gaps, make a stretch, and the longest chain of their words that keeps the
order of both text and template is its span: pairs of places by text, then an increasing subsequence of template places, so the
chain is exact at n log n for any number of anchors. Templates whose chained words cover enough of them compete where their spans overlap: the one with the fewest
uncovered words, of the template and inside the span together, gives its label, of equals the one with more words chained. So a chain that skips the word that tells two licenses apart loses to
the license that has it. Base phrases are looked up beside that, at every place.

Words outside the templates' vocabulary cut runs, so only runs of known words walk the automaton. One narrow pass, no
shuffle; the automaton is as large as the templates and goes out with the task.

Defined results: null and empty texts have no words and no labels; an empty table gives an empty result; very long texts are scanned as a whole;
repeated rows are scanned each; templates that fit a stretch equally well all give their labels; of chains of equal length the one that ends first is the span; the operator's
output columns replace input columns of the same names.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import text_buffers, without

#: Base phrases and their labels.
BASE_PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Well-known public license notices.
TEMPLATES = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "apache-2": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mpl-2": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "bsd-3": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "gpl-2": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "lgpl-2.1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "lgpl-3": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "agpl-3": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    "gfdl-1.3": "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3 or any later version published by the Free Software Foundation; with no Invariant Sections, no Front-Cover Texts, and no Back-Cover Texts.",
    "0bsd": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "mit-0": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.",
    "boost-1": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following",
    "postgresql": "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies.",
    "zlib": "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "mpl-1.1": "The contents of this file are subject to the Mozilla Public License Version 1.1 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.mozilla.org/MPL/",
    "cddl-1": "The contents of this file are subject to the terms of the Common Development and Distribution License (the License). You may not use this file except in compliance with the License.",
    "epl-2": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "epl-1": "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html",
    "eupl-1.2": "Licensed under the EUPL, Version 1.2 or as soon they will be approved by the European Commission subsequent versions of the EUPL (the Licence); You may not use this work except in compliance with the Licence.",
    "ofl-1.1": "This Font Software is licensed under the SIL Open Font License, Version 1.1. This license is copied below, and is also available with a FAQ at",
    "odbl-1": "This database is made available under the Open Database License: http://opendatacommons.org/licenses/odbl/1.0/. Any rights in individual contents of the database are licensed under the Database Contents License",
    "cc0-1": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "cc-by-3": "This work is licensed under a Creative Commons Attribution 3.0 Unported License.",
    "cc-by-sa-3": "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License.",
    "cc-by-nc": "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License.",
    "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-nd": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "cc-by-nc-sa": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "cc-by-nc-nd": "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
}

#: Bytes of words to their lower case, all others to a space.
WORD_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(WORD_TABLE).split()


@dataclass
class SuffixAutomaton:
    """States as lists; ends[state]: {template: all end positions} of the runs that the state stands for, if they have `least` words."""

    next: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    ends: list[dict[int, set[int]]] = field(default_factory=lambda: [{}])

    def _state(self, length: int, like: int | None = None) -> int:
        self.next.append(dict(self.next[like]) if like is not None else {})
        self.link.append(self.link[like] if like is not None else 0)
        self.length.append(length)
        self.ends.append({})
        return len(self.next) - 1

    def add(self, words: list[int], template: int) -> None:
        last = 0
        for at, word in enumerate(words):
            last = self._extend(last, word)
            self.ends[last].setdefault(template, set()).add(at + 1)

    def _extend(self, last: int, word: int) -> int:
        if word in self.next[last]:
            state = self.next[last][word]
            return state if self.length[state] == self.length[last] + 1 else self._split(last, word, state)
        new, p = self._state(self.length[last] + 1), last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, word, q)
        return new

    def _split(self, p: int, word: int, q: int) -> int:
        clone = self._state(self.length[p] + 1, q)
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def finish(self, least: int = 1) -> None:
        """Gives each state of `least` words and more the ends of all longer runs that contain it as a suffix."""
        for state in sorted(range(1, len(self.next)), key=lambda s: -self.length[s]):
            if self.length[self.link[state]] >= least:
                for template, ends in self.ends[state].items():
                    self.ends[self.link[state]].setdefault(template, set()).update(ends)


def longest_chain(anchors: list[tuple[int, int, int]]) -> tuple[int, int, int]:
    """(first word, last word, length) of the longest chain of matched words that grows in text and template. anchors: (text start, template start, length)."""
    pairs = sorted({(at + i, -pos - i) for at, pos, n in anchors for i in range(n)})
    tails: list[int] = []  # the least template place that ends a chain of each length
    begins: list[int] = []  # the first word of that chain
    best = (0, 0, 0)
    for at, minus in pairs:
        k = bisect_left(tails, -minus)
        first = begins[k - 1] if k else at
        if k == len(tails):
            tails.append(-minus)
            begins.append(first)
            best = (first, at, k + 1)
        else:
            tails[k], begins[k] = -minus, first
    return best


@dataclass
class LicenseModel:
    vocabulary: dict[bytes, int]
    automaton: SuffixAutomaton
    labels: list[str]
    sizes: list[int]
    phrases: list[tuple[list[int], str]]
    least_run: int

    @classmethod
    def build(cls, templates: dict[str, str], phrases: dict[str, str], least_run: int = 5) -> LicenseModel:
        vocabulary: dict[bytes, int] = {}
        ids = lambda text: [vocabulary.setdefault(w, len(vocabulary)) for w in words_of(text.encode())]
        automaton, sizes = SuffixAutomaton(), []
        for k, text in enumerate(templates.values()):
            automaton.add(own := ids(text), k)
            sizes.append(max(1, len(own)))
        automaton.finish(least_run)
        return cls(vocabulary, automaton, list(templates), sizes, [(ids(p), label) for p, label in phrases.items()], least_run)

    def anchors(self, run: list[int], start: int) -> list[tuple[int, int, int, int]]:
        """(template, template start, text start, length) of each maximal run of at least least_run words."""
        auto, state, n, found = self.automaton, 0, 0, []

        def put(end: int) -> None:
            if n >= self.least_run:
                found.extend((t, e - n, start + end - n, n) for t, ends in auto.ends[state].items() for e in sorted(ends))

        for i, word in enumerate(run):
            if word not in auto.next[state]:
                put(i)
                while state and word not in auto.next[state]:
                    state = auto.link[state]
                    n = auto.length[state]
            if word in auto.next[state]:
                state, n = auto.next[state][word], n + 1
        put(len(run))
        return found

    def chains(self, anchors: list[tuple[int, int, int, int]], gap: int = 40) -> list[tuple[int, int, int, int]]:
        """(template, first word, stop, words chained): the best chain of each stretch of a template's anchors."""
        out = []
        by_template: dict[int, list[tuple[int, int, int]]] = {}
        for t, pos, at, n in anchors:
            by_template.setdefault(t, []).append((at, pos, n))
        for t, own in sorted(by_template.items()):
            stretch, stop = [], 0
            for a in [*sorted(own), None]:
                if stretch and (a is None or a[0] - stop > gap):
                    first, last, words = longest_chain(stretch)
                    out.append((t, first, last + 1, words))
                    stretch = []
                if a is not None:
                    stop = max(stop, a[0] + a[2]) if stretch else a[0] + a[2]
                    stretch.append(a)
        return out

    def chosen(self, spans: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
        """Spans that no better one overlaps by half of the shorter of the two. Better: fewer uncovered words on both sides, then more chained ones."""
        rank = lambda s: (self.sizes[s[0]] - s[3] + s[2] - s[1] - s[3], -s[3])
        kept: list[tuple[int, int, int, int]] = []
        for s in sorted(spans, key=lambda s: (rank(s), s)):
            better = (k for k in kept if rank(k) < rank(s) and 2 * (min(k[2], s[2]) - max(k[1], s[1])) >= min(k[2] - k[1], s[2] - s[1]))
            if next(better, None) is None:
                kept.append(s)
        return kept

    def scan(self, raw: bytes, least_cover: float = 0.5) -> dict:
        words = words_of(raw)
        known = bytes(map(self.vocabulary.__contains__, words))
        starts, base, anchors = [], set(), []
        for m in re.finditer(rb"\x01{3,}", known):
            run = [self.vocabulary[w] for w in words[m.start() : m.end()]]
            for phrase, label in self.phrases:
                for i in range(len(run) - len(phrase) + 1):
                    if run[i] == phrase[0] and run[i : i + len(phrase)] == phrase:
                        starts.append(m.start() + i)
                        base.add(label)
            if len(run) >= self.least_run:
                anchors += self.anchors(run, m.start())
        spans = self.chains(anchors) if anchors else []
        cover = lambda s: min(1.0, s[3] / self.sizes[s[0]])
        found = {self.labels[s[0]] for s in self.chosen([s for s in spans if cover(s) >= least_cover])}
        score = 1.0 if base else max(map(cover, spans), default=0.0)
        return {"n_words": len(words), "n_base": len(starts), "first_word": min(starts, default=None), "last_word": max(starts, default=None), "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(base | found)), "score": score, "spans": [{"label": self.labels[s[0]], "start": s[1], "stop": s[2], "cover": cover(s)} for s in spans]}


SPANS = T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("start", T.LongType()), T.StructField("stop", T.LongType()), T.StructField("cover", T.DoubleType())]))
FIELDS = [("n_words", T.LongType()), ("n_base", T.LongType()), ("first_word", T.LongType()), ("last_word", T.LongType()), ("base_labels", T.StringType()), ("labels", T.StringType()), ("score", T.DoubleType()), ("spans", SPANS)]


def scan_licenses(docs: DataFrame, text_col: str = "text", templates: dict[str, str] | None = None, phrases: dict[str, str] | None = None, least_run: int = 5, least_cover: float = 0.5) -> DataFrame:
    """docs without the text, with word counts, base phrases, labels, score and spans (word ranges, with their coverage). Phrases have three words at least."""
    model = LicenseModel.build(TEMPLATES if templates is None else templates, BASE_PHRASES if phrases is None else phrases, least_run)
    if any(len(p) < 3 for p, _ in model.phrases):
        raise ValueError("a phrase has fewer than three words")
    kept = without(docs, *[n for n, _ in FIELDS if n != text_col])
    rest = [c for c in kept.columns if c != text_col]
    schema = T.StructType([*kept.select(*rest).schema.fields, *[T.StructField(n, k) for n, k in FIELDS]])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    spans_type = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("cover", pa.float64())]))
    kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.float64(), spans_type]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            data, offsets = text_buffers(batch.column(len(rest)))
            rows = [own.scan(data[a:b].tobytes(), least_cover) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], *[pa.array([r[n] for r in rows], k) for (n, _), k in zip(FIELDS, kinds, strict=True)]], schema.names)

    return kept.select(*rest, text_col).mapInArrow(run, schema)

