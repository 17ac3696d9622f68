"""Licence scan with a generalised suffix automaton of licence words.

All templates (one-sentence statements, whole texts of short licences, notices
of long ones) form one suffix automaton over words: a state stands for the word sequences that occur at the same template places.
Each document's words stream through it and leave matching statistics: at each
word, how many words up to it occur together in some template, and the state.
Where a match can't go on in a template, and it's at least ``MIN_WORDS`` words
long (or a whole template), it is a fragment of that template, also where the
text goes on as another template does.
Fragments of one template chain in order of text and template over gaps of at
most ``MAX_GAP`` words; a chain that covers ``MIN_COVER`` of its template is a
find: a label, a span of words and the share covered.

Phrases are templates that must stand whole; their places are counted too.

Words: runs of 0-9, a-z and characters beyond ASCII, after lower-casing A-Z.

Defined results: null counts as the empty text (no words, no labels, score 0);
texts are streamed whole; repeated rows each give their row; extra columns go
no further; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from functools import lru_cache

from pyspark.sql import DataFrame

from ballotlens.llm.common import arrays_to_batch, id_and_text, small_batches
from ballotlens.llm.license_texts import WHOLE_TEXTS

# Phrases that count wherever their words stand consecutively.
PHRASES = [
    ("cc-by", "cc by"),
    ("gpl", "general public license"),
    ("reserved", "all rights reserved"),
]

# Statements of public licences, as their texts have them.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("gpl-3.0", "licensed under the GNU General Public License, version 3"),
    ("gpl-3.0", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version"),
    ("gpl-2.0", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or any later version"),
    ("lgpl", "GNU Lesser General Public License"),
    ("agpl", "GNU Affero General Public License"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "Creative Commons Attribution-NonCommercial"),
    ("cc-by-sa", "Creative Commons Attribution-ShareAlike"),
    ("cc-by-4.0", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]

MIN_WORDS = 4      # of a fragment
MAX_GAP = 6        # words between fragments of a chain
MIN_COVER = 0.75   # of a template
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(text: str) -> list[bytes]:
    """The words, as UTF-8: the bytes of characters beyond ASCII are word
    characters, and lower-casing bytes touches A-Z only."""
    return _WORD.findall(text.encode("utf-8", "surrogatepass").lower())


class Automaton:
    """Suffix automaton of several word sequences.

    ``go``: transitions of each state; ``link``: the state of its longest
    shorter suffix; ``length``: its longest sequence; ``places``: the
    (template, end) at which its sequences occur.
    """

    def __init__(self, sequences: list[list[bytes]]):
        self.go, self.link, self.length, self.places = [{}], [-1], [0], [set()]
        for t, words in enumerate(sequences):
            last = 0
            for end, w in enumerate(words, 1):
                last = self._add(last, w)
                self.places[last].add((t, end))
        for s in sorted(range(len(self.go)), key=self.length.__getitem__, reverse=True):
            if self.link[s] > 0:
                self.places[self.link[s]] |= self.places[s]
        self.vocabulary = {w for words in sequences for w in words}

    def _state(self, length, go, link) -> int:
        self.go.append(go)
        self.link.append(link)
        self.length.append(length)
        self.places.append(set())
        return len(self.go) - 1

    def _split(self, state, target, w) -> int:
        """The state for the sequences of ``target`` that end ``state`` plus w."""
        clone = self._state(self.length[state] + 1, dict(self.go[target]), self.link[target])
        self.link[target] = clone
        while state >= 0 and self.go[state].get(w) == target:
            self.go[state][w] = clone
            state = self.link[state]
        return clone

    def _add(self, last, w) -> int:
        known = self.go[last].get(w)
        if known is not None:                # another template has begun like this
            return known if self.length[known] == self.length[last] + 1 else self._split(last, known, w)
        new, s = self._state(self.length[last] + 1, {}, 0), last
        while s >= 0 and w not in self.go[s]:
            self.go[s][w] = new
            s = self.link[s]
        if s >= 0:
            target = self.go[s][w]
            self.link[new] = target if self.length[target] == self.length[s] + 1 else self._split(s, target, w)
        return new

    def statistics(self, words: list[bytes], at: list[int]):
        """(position, length, state) for each word of the vocabulary; ``at``
        has their positions.  Other words end every match."""
        state, n, before = 0, 0, -2
        for i in at:
            if i != before + 1:
                state, n = 0, 0
            w, before = words[i], i
            while state and w not in self.go[state]:
                state = self.link[state]
                n = self.length[state]
            if w in self.go[state]:
                state, n = self.go[state][w], n + 1
            yield i, n, state


class Scanner:
    def __init__(self, phrases=PHRASES, templates=(*TEMPLATES, *WHOLE_TEXTS), min_words=MIN_WORDS, max_gap=MAX_GAP, min_cover=MIN_COVER):
        self.phrases = [(label, words_of(p)) for label, p in phrases]
        self.labels = [x for x, _ in phrases] + [x for x, _ in templates]
        self.words = [w for _, w in self.phrases] + [words_of(t) for _, t in templates]
        self.automaton = Automaton(self.words)
        self.min_words, self.max_gap, self.min_cover = min_words, max_gap, min_cover
        # states that a template of under min_words words, as a whole, is or ends
        self.whole_short = [False] * len(self.automaton.go)
        for k in sorted(range(1, len(self.whole_short)), key=self.automaton.length.__getitem__):
            self.whole_short[k] = self.whole_short[self.automaton.link[k]] or any(
                end == len(self.words[t]) <= min(min_words - 1, self.automaton.length[k]) for t, end in self.automaton.places[k])
        self.last_words = {}
        for k, (_, w) in enumerate(self.phrases):
            self.last_words.setdefault(w[-1], []).append((k, w))

    def fragments(self, words, at):
        """(template, text start, text end, template start) of the matches that
        can't go on in their template, whatever goes on in others."""
        auto, least = self.automaton, self.min_words
        for i, n, state in auto.statistics(words, at):
            if n < least and not self.whole_short[state]:
                continue
            after = words[i + 1] if i + 1 < len(words) else None
            m, before = n, frozenset()
            while state > 0 and (m >= least or self.whole_short[state]):
                for t, end in auto.places[state] - before:
                    w = self.words[t]
                    if (m >= least or m >= len(w)) and (end == len(w) or w[end] != after):
                        yield t, i + 1 - m, i + 1, end - m
                before, state = auto.places[state], auto.link[state]
                m = auto.length[state]

    def chains(self, words, at):
        """(template, text start, text end, words covered): the best chain that
        ends at each fragment, of those no longer chain takes up."""
        by: dict[int, list] = {}
        for f in self.fragments(words, at):
            by.setdefault(f[0], []).append(f[1:])
        for t, found in by.items():
            found.sort(key=lambda f: (f[1], f[0], f[2]))
            best, ends, used = [], [f[1] for f in found], set()
            for k, (a, b, p) in enumerate(found):
                top = (b - a, a, None)
                # ends rise, starts needn't: a long match can begin before a short one that ends earlier
                for j in range(bisect_left(ends, a - self.max_gap), k):
                    x, y, q = found[j]
                    over = max(0, y - a, q + y - x - p)        # words that both would cover
                    if x < a and q < p and b - a > over and best[j][0] + b - a - over > top[0]:
                        top = (best[j][0] + b - a - over, best[j][1], j)
                best.append(top)
                if top[2] is not None:
                    used.add(top[2])
            for k, (_, b, _) in enumerate(found):
                if k not in used:
                    yield t, best[k][1], b, min(best[k][0], len(self.words[t]))

    def scan(self, text: str):
        """n_words, base starts, base labels, spans (label, start, end, share) and score."""
        words = words_of(text)
        vocabulary = self.automaton.vocabulary
        at = [i for i, w in enumerate(words) if w in vocabulary]
        starts, base = [], set()
        for i in at:
            for k, w in self.last_words.get(words[i], ()):
                s = i + 1 - len(w)
                if s >= 0 and words[s:i + 1] == w:
                    starts.append(s)
                    base.add(self.phrases[k][0])
        spans, score = set(), 0.0
        for t, a, b, n in self.chains(words, at):
            share = n / len(self.words[t])
            if t < len(self.phrases):
                if share < 1 or b - a != n:
                    continue
            score = max(score, share)
            if share >= self.min_cover:
                spans.add((self.labels[t], a, b, share))
        return len(words), starts, base, sorted(spans, key=lambda s: (s[1], s[2], s[0])), score


@lru_cache(maxsize=1)
def load(templates: tuple[tuple[str, str], ...]) -> Scanner:
    return Scanner(templates=templates)


def scan_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=(*TEMPLATES, *WHOLE_TEXTS)) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels,
    score, spans): word positions from 0, spans' ends exclusive; ``templates``
    are (label, text)."""
    small_batches(docs.sparkSession)
    templates = tuple(map(tuple, templates))

    def scan(batches):
        import pyarrow as pa
        span = pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("share", pa.float64())])
        schema = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_words", "n_base", "first_word", "last_word")),
                            ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.list_(span))])
        scanner = load(templates)
        for b in batches:
            rows = []
            for t in b.column(1).to_pylist():
                n, starts, base, spans, score = scanner.scan(t)
                rows.append((n, len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)),
                             ",".join(sorted(base | {s[0] for s in spans})), score, [dict(zip(("label", "start", "end", "share"), s, strict=True)) for s in spans]))
            yield arrays_to_batch(schema, [b.column(0), *([r[k] for r in rows] for k in range(8))])

    return id_and_text(docs, id_col, text_col).mapInArrow(
        scan, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
              "spans array<struct<label: string, start: long, end: long, share: double>>")
