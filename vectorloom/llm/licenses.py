"""License scans: known phrases, and an exact set-similarity join of text blocks with license templates.

A block is a window of a paragraph (lines up to an empty one, so that wrapped licenses are found), a quarter longer than the
template; a template T is contained in it if |T and B| >= threshold * |T| as sets of words and B has all of T's telling words
(``TELLING``: names by which licenses differ). Words are put in one global order, rarest in the corpus first (document
frequencies over all documents, of the templates' words: only those are ever compared). If B holds enough of T, it misses at most
``floor((1 - threshold) * |T|)`` of T's words, so one of the first that many plus one in the order is in B: these prefixes make the
inverted index (prefix filter). A paragraph with fewer distinct words of templates than T needs can't match (length filter); and a
candidate first met at position p of T's order can hold at most |T| - p of T's words (positional filter). What passes is
verified by sliding the window over the paragraph, so the join is exact.

Where templates nearly contain each other (``Licensed under CC BY`` and ``Licensed under CC BY-NC``) the one that holds more words of a
place names it: of overlapping matches that are alike by the threshold the one with more words in common stays.

The templates are part of the program, so what is broadcast (templates and the frequencies of their words) has a fixed size.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, per_text, quoted, raw_texts, sorted_csv, words_of

THRESHOLD = 0.8
#: Phrases (words that stand consecutively) and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Sentences of public licenses, by label.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "mit": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "You may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "Released under the GPL License.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    ),
    "lgpl": ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",),
    "agpl": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",),
    "bsd": (
        "Released under the BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    ),
    "isc": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",),
    "mpl-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "zlib": ("Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely",),
    "unlicense": ("This is free and unencumbered software released into the public domain.",),
    "cc0": ("Licensed under CC0 1.0.", "This work is released into the public domain under Creative Commons CC0 1.0 Universal."),
    "cc-by": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "cc-by-sa": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "cc-by-nd": ("Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    "cc-by-nc-sa": ("Licensed under CC BY-NC-SA 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    "cc-by-nc-nd": ("Licensed under CC BY-NC-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
}
#: Names by which licenses differ. A template's own ones must all be there.
TELLING = frozenset(b"mit apache gnu gpl lesser affero bsd mozilla unencumbered cc cc0 by nc sa nd creative commons attribution noncommercial sharealike noderivatives".split())

Template = tuple[str, tuple[bytes, ...], int]
#: Words from and to (exclusive) of a paragraph, words in common, template.
Match = tuple[int, int, int, int]


def template_words(templates: Mapping[str, tuple[str, ...]] = TEMPLATES) -> set[bytes]:
    return {w for texts in templates.values() for t in texts for w in words_of(t.encode())}


def word_frequencies(docs: DataFrame, words: set[bytes], text_col: str = "text") -> dict[bytes, int]:
    """In how many documents each of ``words`` stands; counted over the whole table, one small row for each word and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter[bytes] = Counter()
        for b in batches:
            for t in raw_texts(b.column(0)):
                n.update(words.intersection(words_of(t)))
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.binary()), pa.array(list(n.values()), pa.int64())], names=["word", "n"])

    found = map_arrow(docs.select(F.col(quoted(text_col)).cast("string").alias("text")), run, "word binary, n long")
    return {bytes(w): n for w, n in found.groupBy("word").agg(F.sum("n")).collect()}  # as many rows as the templates have words


class Index:
    """Prefix index of the templates under one global order of words."""

    def __init__(self, frequencies: Mapping[bytes, int], templates: Mapping[str, tuple[str, ...]] = TEMPLATES, threshold: float = THRESHOLD, telling: frozenset[bytes] = TELLING) -> None:
        def order(w: bytes) -> tuple[int, bytes]:
            return frequencies.get(w, 0), w

        self.templates: list[Template] = []
        self.sets: list[frozenset[bytes]] = []
        self.telling: list[frozenset[bytes]] = []
        self.spans: list[int] = []
        self.prefix: dict[bytes, list[tuple[int, int]]] = {}
        for label, texts in templates.items():
            for t in texts:
                words = tuple(sorted(set(words_of(t.encode())), key=order))
                need = len(words) - int((1 - threshold) * len(words) + 1e-9)
                k = len(self.templates)
                self.templates.append((label, words, need))
                self.sets.append(frozenset(words))
                self.telling.append(self.sets[k] & telling)
                self.spans.append(-(-len(words_of(t.encode())) * 5 // 4))
                for p, w in enumerate(words[: len(words) - need + 1]):
                    self.prefix.setdefault(w, []).append((k, p))
        self.rare = frozenset(self.prefix)
        self.every = frozenset().union(*self.sets)
        #: For each template those of other labels that contain enough of it.
        self.alike = [frozenset(j for j, t in enumerate(self.sets) if self.templates[j][0] != self.templates[k][0] and len(s & t) >= threshold * len(s)) for k, s in enumerate(self.sets)]

    def candidates(self, there: Sequence[tuple[int, bytes]]) -> list[int]:
        """Templates that a paragraph with these words may hold."""
        block = {w for _, w in there}
        first: dict[int, int] = {}
        for w in self.rare & block:
            for k, p in self.prefix[w]:
                first[k] = min(p, first.get(k, p))
        return sorted(k for k, p in first.items() if self.templates[k][2] <= min(len(block), len(self.templates[k][1]) - p) and len(self.sets[k] & block) >= self.templates[k][2])

    def places(self, k: int, there: Sequence[tuple[int, bytes]]) -> Iterator[Match]:
        """Windows of a paragraph that hold template ``k``, one after another, each with as many of its words as follow within the window."""
        own, need, telling, span = self.sets[k], self.templates[k][2], self.telling[k], self.spans[k]
        at = [(i, w) for i, w in there if w in own]
        held: Counter[bytes] = Counter()
        start = end = 0
        while end < len(at):
            i, w = at[end]
            held[w] += 1
            end += 1
            while at[start][0] <= i - span:
                held[at[start][1]] -= 1
                held += Counter()
                start += 1
            if len(held) >= need and all(x in held for x in telling):
                while held[at[start][1]] > 1:  # the shortest such window
                    held[at[start][1]] -= 1
                    start += 1
                last = end
                for j in range(end, len(at)):
                    if at[j][0] >= at[start][0] + span:
                        break
                    if at[j][1] not in held:
                        held[at[j][1]] += 1
                        last = j + 1
                yield at[start][0], at[last - 1][0] + 1, len(held), k
                held.clear()
                start = end = last

    def match(self, words: Sequence[bytes]) -> list[Match]:
        """Places of templates in a paragraph's words; those that better ones of another label overlap by half are left out."""
        there = [(i, w) for i, w in enumerate(words) if w in self.every]
        found = [m for k in self.candidates(there) for m in self.places(k, there)]
        return [m for m in found if not any(o[3] in self.alike[m[3]] and o[2] > m[2] and 2 * (min(o[1], m[1]) - max(o[0], m[0])) >= m[1] - m[0] for o in found)]


_PHRASE = {p.encode(): label for p, label in PHRASES.items()}
_EMPTY_LINE = re.compile(rb"\r?\n[\x20\t]*\r?\n|\r[\x20\t]*\r")
_PHRASE_AT = {p: re.compile(b"(?= " + p + b" )") for p in _PHRASE}


def phrases_in(words: list[bytes]) -> tuple[list[int], set[str]]:
    """Word positions where phrases start, and the phrases' labels."""
    starts, labels = [], set()
    line = b" " + b" ".join(words) + b" "
    for p, rx in _PHRASE_AT.items():
        if p in line:
            for m in rx.finditer(line):
                starts.append(line.count(b" ", 0, m.start()))
                labels.add(_PHRASE[p])
    return starts, labels


def scan(text: bytes, index: Index) -> tuple[int, list[int], set[str], set[str], float]:
    """Number of words, phrase starts, phrase labels, template labels, best containment."""
    words = words_of(text)
    starts, base = phrases_in(words)
    labels, best = set(), 0.0
    if not index.rare.isdisjoint(words):
        for paragraph in _EMPTY_LINE.split(text):
            for _, _, common, k in index.match(words_of(paragraph)):
                label, own, _ = index.templates[k]
                labels.add(label)
                best = max(best, common / len(own))
    return len(words), starts, base, labels, best


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: Mapping[str, tuple[str, ...]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row of ``docs``.

    ``score``: the best containment of a template in one of its windows, 1 where a phrase stands, else 0. Null
    text: no words, null positions, empty labels. Ties: of places that hold equally many words of two templates both stay.
    Repeated rows are rows of the result; empty table: empty result; extra columns are not read."""
    index = Index(word_frequencies(docs, template_words(templates), text_col), templates, threshold)

    def score(texts: list[bytes]) -> dict[str, list]:
        found = [scan(t, index) for t in texts]
        return {
            "n_words": [n for n, *_ in found], "n_base": [len(s) for _, s, *_ in found],
            "first_word": [min(s, default=None) for _, s, *_ in found], "last_word": [max(s, default=None) for _, s, *_ in found],
            "base_labels": [sorted_csv(b) for _, _, b, _, _ in found], "labels": [sorted_csv(b | m) for _, _, b, m, _ in found],
            "score": [1.0 if s else x for _, s, _, _, x in found],
        }

    arrow = pa.schema([("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())])
    return per_text(docs, id_col, text_col, score, "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double", arrow)
