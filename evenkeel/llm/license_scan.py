"""Licence notices by a generalised suffix automaton of their words.

The automaton holds every run of words of every template. A text streams through it word by word,
which gives its matching statistics: at each word the longest run ending there that occurs in a
template. Where such a run can't go on and has ``least`` words it is a match, and matches that
advance in both text and template, with at most ``gap`` words of the text between them, form a
chain. A chain that covers ``share`` of its template is a span of that licence.

Phrases are runs of their own in the automaton: every state knows which phrases and whole templates
are suffixes of what it stands for, so each place of a phrase is reported, however short it is, and
a template that stands whole is a span also where it is part of a longer match.

Templates and phrases are a parameter, and what is sent to tasks grows with them alone. A text is
read in pieces of a megabyte with state and chains carried on.

Of several places of a match in one template the first after the chain's end counts, else the
first of all; so chains are greedy and the same on every run.

Defined cases: a null text is an empty one and has no words, no labels and score 0; null and repeated
ids are rows like any other; extra columns are ignored; a table without rows gives none.
"""

from __future__ import annotations

import bisect
from collections import defaultdict
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.llm.ascii_words import byte_columns, pieces, spaced
from evenkeel.llm.shared import per_process

# The phrases and labels of the base report.
PHRASES = (("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved"))
# Notices as licences tell their users to write them.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    (
        "apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
        "compliance with the License. You may obtain a copy of the License at",
    ),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    (
        "gpl-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License",
    ),
    ("mit", "Released under the MIT License"),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction',
    ),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
)
LEAST = 3
GAP = 20
SHARE = 0.8
PIECE_BYTES = 1 << 20


class LicenceAutomaton:
    """Generalised suffix automaton over the words of templates and phrases."""

    def __init__(self, templates: Sequence[tuple[str, str]], phrases: Sequence[tuple[str, str]]):
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.places: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.labels = [label for label, _ in templates]
        self.sizes: list[int] = []
        self.phrase_labels = [label for label, _ in phrases]
        cut = [self._numbers(text) for _, text in (*templates, *phrases)]
        for number, words in enumerate(cut):
            self.sizes.append(len(words))
            self._add(words, number if number < len(templates) else None)
        self.children: dict[int, list[int]] = defaultdict(list)
        for state in range(1, len(self.next)):
            self.children[self.link[state]].append(state)
        self._seen: dict[int, dict[int, list[int]]] = {}
        own: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for number, words in enumerate(cut):
            state = 0
            for w in words:
                state = self.next[state][w]
            if words:
                own[state].append((len(words), number))
        # Templates, and phrases numbered after them, that end what a state stands for: its own and those of its suffixes.
        self.ends: list[list[tuple[int, int]]] = [[] for _ in self.next]
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            self.ends[state] = self.ends[self.link[state]] + own.get(state, [])

    def _numbers(self, text: str) -> list[int]:
        words = spaced(text.encode()).split()
        return [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]

    def _state(self, length: int, link: int, following: dict[int, int]) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, state: int, word: int, target: int) -> int:
        """A state for the runs of ``target`` that are one word longer than those of ``state``."""
        half = self._state(self.length[state] + 1, self.link[target], dict(self.next[target]))
        self.link[target] = half
        while state >= 0 and self.next[state].get(word) == target:
            self.next[state][word] = half
            state = self.link[state]
        return half

    def _add(self, words: list[int], template: int | None) -> None:
        last = 0
        for at, word in enumerate(words):
            target = self.next[last].get(word)
            if target is not None:
                # Another template had this run already.
                last = target if self.length[target] == self.length[last] + 1 else self._split(last, word, target)
            else:
                fresh, state = self._state(self.length[last] + 1, 0, {}), last
                while state >= 0 and word not in self.next[state]:
                    self.next[state][word] = fresh
                    state = self.link[state]
                if state >= 0:
                    target = self.next[state][word]
                    exact = self.length[target] == self.length[state] + 1
                    self.link[fresh] = target if exact else self._split(state, word, target)
                last = fresh
            if template is not None:
                self.places[last].append((template, at))

    def ends_in(self, state: int) -> dict[int, list[int]]:
        """Where the runs of a state end, as sorted word numbers of each template."""
        found = self._seen.get(state)
        if found is None:
            gathered, stack = defaultdict(set), [state]
            while stack:
                one = stack.pop()
                for template, at in self.places.get(one, ()):
                    gathered[template].add(at)
                stack += self.children.get(one, ())
            found = self._seen[state] = {template: sorted(at) for template, at in gathered.items()}
        return found

    def statistics(self, words: Iterator[bytes]) -> Iterator[tuple[int, int]]:
        """State and length of the longest known run that ends at each word."""
        number, following, link, sizes = self.vocabulary.get, self.next, self.link, self.length
        state = length = 0
        for w in words:
            x = number(w)
            if x is None:
                state = length = 0
            else:
                while x not in following[state]:
                    state = link[state]
                    length = sizes[state]
                state = following[state][x]
                length += 1
            yield state, length


class Scan:
    """One text: its words are fed in order, and places, spans and the best coverage are kept."""

    def __init__(self, automaton: LicenceAutomaton, least: int, gap: int, share: float):
        self.automaton, self.least, self.gap, self.share = automaton, least, gap, share
        self.n_words = self.n_places = 0
        self.first_place = self.last_place = None
        self.labels: set[str] = set()
        # Coverage by first word, last word and label.
        self.spans: dict[tuple[int, int, str], float] = {}
        self.best = 0.0
        # Of each template the open chain: first and last word of the text, last word of the template, words covered.
        self.chains: dict[int, list[int]] = {}

    def read(self, text: bytes) -> "Scan":
        a = self.automaton
        before = (0, 0)
        words = (w for piece in pieces(spaced(text), PIECE_BYTES) for w in piece.split())
        for at, (state, length) in enumerate(a.statistics(words)):
            if length:
                for size, number in a.ends[state]:
                    if size <= length:
                        self._place(at - size + 1, at, number)
            # A run that did not go on is as long as it gets.
            if before[1] >= self.least and length <= before[1]:
                self._match(at - 1, *before)
            before = (state, length)
            self.n_words = at + 1
        if before[1] >= self.least:
            self._match(self.n_words - 1, *before)
        for template in list(self.chains):
            self._close(template)
        return self

    def _place(self, start: int, end: int, number: int) -> None:
        """A phrase or a whole template."""
        a = self.automaton
        self.best = 1.0
        if number < len(a.labels):
            self.spans[start, end, a.labels[number]] = 1.0
            return
        self.n_places += 1
        self.first_place = start if self.first_place is None else min(self.first_place, start)
        self.last_place = start if self.last_place is None else max(self.last_place, start)
        self.labels.add(a.phrase_labels[number - len(a.labels)])

    def _match(self, end: int, state: int, length: int) -> None:
        start = end - length + 1
        for template, ends in self.automaton.ends_in(state).items():
            chain = self.chains.get(template)
            if chain and start - chain[1] <= self.gap + 1:
                later = bisect.bisect_right(ends, chain[2])
                if later < len(ends):
                    chain[3] += min(length, ends[later] - chain[2])
                    chain[1], chain[2] = end, ends[later]
                    continue
                if min(length, self.automaton.sizes[template]) < chain[3]:
                    # A shorter run out of order; the chain may still go on.
                    continue
            if chain:
                self._close(template)
            self.chains[template] = [start, end, ends[0], length]

    def _close(self, template: int) -> None:
        first, last, _, covered = self.chains.pop(template)
        coverage = covered / self.automaton.sizes[template]
        self.best = max(self.best, coverage)
        if coverage >= self.share:
            span = first, last, self.automaton.labels[template]
            self.spans[span] = max(coverage, self.spans.get(span, 0.0))


_SPAN = "struct<label:string,first_word:bigint,last_word:bigint,coverage:double>"
_SCHEMA = (
    "doc_id long, n_words long, n_places long, first_place long, last_place long, "
    f"phrase_labels array<string>, spans array<{_SPAN}>, score double"
)
_ARROW = pa.schema(
    [("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_words", "n_places", "first_place", "last_place")),
     ("phrase_labels", pa.list_(pa.string())),
     ("spans", pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("coverage", pa.float64())]))),
     ("score", pa.float64())]
)


def license_spans(
    docs: DataFrame,
    templates: Sequence[tuple[str, str]] = TEMPLATES,
    phrases: Sequence[tuple[str, str]] = PHRASES,
    least: int = LEAST,
    gap: int = GAP,
    share: float = SHARE,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row for each document: places of phrases, and spans of templates with their coverage.

    ``score`` is the greatest coverage of any chain, 1 where a phrase stands. One pass without a shuffle.
    """
    templates, phrases = tuple(templates), tuple(phrases)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = per_process(("licences", templates, phrases), lambda: LicenceAutomaton(templates, phrases))
        for whole in batches:
            for first in range(0, whole.num_rows, 500):
                batch = whole.slice(first, 500)
                rows = []
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                    s = Scan(automaton, least, gap, share).read(text.as_py())
                    spans = [dict(zip(("first_word", "last_word", "label", "coverage"), (*span, c))) for span, c in sorted(s.spans.items())]
                    rows.append(
                        {"doc_id": doc_id, "n_words": s.n_words, "n_places": s.n_places, "first_place": s.first_place,
                         "last_place": s.last_place, "phrase_labels": sorted(s.labels), "spans": spans, "score": s.best}
                    )
                yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    return byte_columns(docs, id_col, text_col).mapInArrow(run, _SCHEMA)


def label_report(spans: DataFrame) -> DataFrame:
    """The base report of the phrases, with all labels, as text."""
    all_labels = F.array_sort(F.array_distinct(F.concat("phrase_labels", "spans.label")))
    return spans.select(
        "doc_id",
        "n_words",
        F.col("n_places").alias("n_base"),
        F.col("first_place").alias("first_word"),
        F.col("last_place").alias("last_word"),
        F.array_join("phrase_labels", ",").alias("base_labels"),
        F.array_join(all_labels, ",").alias("labels"),
        "score",
    )
