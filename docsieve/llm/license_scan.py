"""Licence scans by a generalised suffix automaton of licence tokens.

All templates and base phrases go into one automaton. Streaming a file through it gives matching
statistics: at each word, the longest stretch ending there that occurs in some template, and by suffix links the
longest one of every template. Matches of ``min_match`` words or more, or of a whole shorter template, are chained in order along each
template; the share of a template's words that its best chain covers decides about the labels that the method adds. Where
templates of several labels cover the same words, as variants of one licence do, the best covered one has them.

Scale: map-only; the automaton is a fixed table of a few thousand states.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsieve.llm.text import alnum_words

#: Phrases whose every place counts, with their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: The operative words of public licences' notices.
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("lgpl", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-nc-sa", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    ("cc-by-nd", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc-sa", "Licensed under CC BY-NC-SA 4.0"),
    ("cc-by-nd", "Licensed under CC BY-ND 4.0"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("mit", "Released under the MIT License"),
    ("mit", "SPDX-License-Identifier: MIT"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "SPDX-License-Identifier: Apache-2.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License"),
    ("bsl", "Distributed under the Boost Software License, Version 1.0"),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software"),
)
SCHEMA = (
    "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "score double, covered array<struct<label:string,first_word:long,last_word:long,coverage:double>>"
)


class SuffixAutomaton:
    """Substrings of several word sequences. Words are numbers from 1; 0 is any other word."""

    def __init__(self) -> None:
        self.length, self.link, self.next = [0], [-1], [{}]
        self.ends: list[dict[int, set[int]]] = [{}]  # sequence -> all ends of the state's strings in it

    def _state(self, length: int, arrows: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(0)
        self.next.append(arrows)
        self.ends.append({})
        return len(self.length) - 1

    def _split(self, p: int, word: int) -> int:
        """The state of the string that goes from p by the word, made if it has none of its own."""
        q = self.next[p][word]
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._state(self.length[p] + 1, dict(self.next[q]))
        self.link[copy], self.link[q] = self.link[q], copy
        self.ends[copy] = {k: set(v) for k, v in self.ends[q].items()}
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def add(self, words: list[int], sequence: int) -> None:
        last = 0
        for at, word in enumerate(words):
            if word in self.next[last]:
                last = self._split(last, word)
            else:
                new, p = self._state(self.length[last] + 1, {}), last
                while p >= 0 and word not in self.next[p]:
                    self.next[p][word] = new
                    p = self.link[p]
                self.link[new] = self._split(p, word) if p >= 0 else 0
                last = new
            v = last
            while v > 0:
                self.ends[v].setdefault(sequence, set()).add(at)
                v = self.link[v]

    def step(self, state: int, matched: int, word: int) -> tuple[int, int]:
        while state and word not in self.next[state]:
            state = self.link[state]
            matched = self.length[state]
        to = self.next[state].get(word)
        return (to, matched + 1) if to is not None else (0, 0)


class Scanner:
    def __init__(self, templates=TEMPLATES, phrases=PHRASES, min_match: int = 5, min_cover: float = 0.5, max_gap: int = 10):
        self.min_match, self.min_cover, self.max_gap = min_match, min_cover, max_gap
        self.words: dict[bytes, int] = {}
        number = lambda text: [self.words.setdefault(w, len(self.words) + 1) for w in alnum_words(text.encode())]
        self.automaton = SuffixAutomaton()
        self.templates = [(label, number(text)) for label, text in templates]
        self.phrases = [(label, number(text)) for text, label in phrases]
        for i, (_, words) in enumerate([*self.templates, *self.phrases]):
            self.automaton.add(words, i)
        self.phrase_at: list[list[int]] = [[] for _ in self.automaton.length]
        homes = {}
        for i, (_, words) in enumerate(self.phrases):
            state = matched = 0
            for w in words:
                state, matched = self.automaton.step(state, matched, w)
            homes.setdefault(state, []).append(i)
        for v in range(1, len(self.phrase_at)):
            u = v
            while u > 0:
                self.phrase_at[v] += homes.get(u, [])
                u = self.automaton.link[u]
        self.least = [min(min_match, len(w)) for _, w in self.templates]
        self.shortest = min([min_match, *self.least, *(len(w) for _, w in self.phrases)])

    def scan(self, text: bytes | None) -> tuple:
        words = alnum_words(text)
        ids = np.fromiter(map(self.words.get, words, _zeros), np.int64, len(words))
        base, matches = [], {}
        known = np.flatnonzero(np.diff(np.concatenate([[0], (ids > 0).view(np.int8), [0]])))
        for start, end in zip(known[::2].tolist(), known[1::2].tolist(), strict=True):
            if end - start >= self.shortest:
                self.run(ids[start:end].tolist(), start, base, matches)
        covered = self.chains(matches)
        strong = self.winners([c for c in covered if c[3] >= self.min_cover])
        base_labels = sorted({label for _, label in base})
        labels = sorted({*base_labels, *(c[0] for c in strong)})
        starts = [at for at, _ in base]
        score = max([1.0 if base else 0.0, *(c[3] for c in covered)])
        return (len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(base_labels), ",".join(labels), score,
                [dict(zip(("label", "first_word", "last_word", "coverage"), c[:4], strict=True)) for c in covered])

    def run(self, ids: list[int], start: int, base: list, matches: dict[int, list[tuple[int, int, int]]]) -> None:
        """Adds the phrases and the matches of a run of known words: by template ``(end in the text, end in the template, words)``.

        At every place the state and its suffix links have all ends of what matches there in each template. A match is
        taken where the next word does not make it longer in that template, whether or not another one goes on.
        """
        a, state, matched = self.automaton, 0, 0
        for i, word in enumerate(ids):
            state, matched = a.step(state, matched, word)
            for k in self.phrase_at[state]:
                if matched >= len(self.phrases[k][1]):
                    base.append((start + i - len(self.phrases[k][1]) + 1, self.phrases[k][0]))
            after = ids[i + 1] if i + 1 < len(ids) else 0
            v, n = state, matched
            seen = set()
            while v > 0 and n >= self.shortest:
                for sequence, ends in a.ends[v].items():
                    if sequence < len(self.templates) and n >= self.least[sequence]:
                        words = self.templates[sequence][1]
                        for end in ends:
                            if (sequence, end) not in seen and (end + 1 == len(words) or words[end + 1] != after):
                                matches.setdefault(sequence, []).append((start + i, end, n))
                            seen.add((sequence, end))
                v = a.link[v]
                n = a.length[v]

    def chains(self, matches: dict[int, list[tuple[int, int, int]]]) -> list[tuple[str, int, int, float, int]]:
        """The best chain of each template: its first and last word in the text, the share of the template that it covers, and how many words.

        A chain's matches move on in the text and in the template, with at most ``max_gap`` words of the text between
        two of them; of matches that overlap only what is new counts.
        """
        out = []
        for sequence, spans in sorted(matches.items()):
            label, words = self.templates[sequence]
            covered, first, last = best_chain(spans, self.max_gap)
            out.append((label, first, last, covered / len(words), covered))
        return out

    @staticmethod
    def winners(chains: list[tuple[str, int, int, float, int]]) -> list[tuple[str, int, int, float, int]]:
        """The chains that no better one of another label overlaps, by share and then by words: variants of a text differ in a word or two."""
        return [c for c in chains if not any(d[0] != c[0] and d[3:] > c[3:] and d[1] <= c[2] and c[1] <= d[2] for d in chains)]


def best_chain(spans: list[tuple[int, int, int]], max_gap: int) -> tuple[int, int, int]:
    """Words covered, first and last word in the text of the best chain of ``(end in the text, end in the template, words)``.

    Of equal chains the one that ends first counts, then the one that starts last.
    """
    longest: dict[tuple[int, int], int] = {}
    for at, end, n in spans:
        longest[at, end] = max(n, longest.get((at, end), 0))
    done: list[tuple[int, int, int, int]] = []  # end in the text, in the template, covered, first word
    best = (0, 0, 0)
    for (at, end), n in sorted(longest.items()):
        covered, first = n, at - n + 1
        for at2, end2, covered2, first2 in reversed(done):
            if at2 < at - n - max_gap:
                break
            if at2 < at and end2 < end:
                covered, first = max((covered, first), (covered2 + min(n, at - at2, end - end2), first2))
        done.append((at, end, covered, first))
        if covered > best[0]:
            best = (covered, first, at)
    return best


class _Zeros:
    def __iter__(self):
        return self

    def __next__(self) -> int:
        return 0


_zeros = _Zeros()


def license_scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, phrases=PHRASES,
                 min_match: int = 5, min_cover: float = 0.5, max_gap: int = 10) -> DataFrame:
    """Per document: its words, base phrases, labels, a score and the chained template spans.

    A null or empty text has no words, no labels and score 0. Every input row gives one row, repeated rows
    too; other columns are ignored. ``labels`` has the base labels and those of templates of whose words a
    chain of matches covers ``min_cover`` or more, unless it overlaps with a chain of another label that covers more; ``score`` is 1 with a base phrase, else the largest cover.
    """
    kind = dict(docs.dtypes)[id_col]
    names = [x.split(" ")[0] for x in SCHEMA.split(", ")]
    span = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("coverage", pa.float64())]))
    kinds = [*[pa.int64()] * 4, pa.string(), pa.string(), pa.float64(), span]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, phrases, min_match, min_cover, max_gap)
        for batch in batches:
            rows = [scanner.scan(t) for t in batch["text"].to_pylist()]
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([batch["id"], *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], ["id", *names])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, {SCHEMA}").withColumnRenamed("id", id_col)
