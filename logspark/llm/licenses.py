"""Operator 2: license scan by a generalised suffix automaton of license words.

All templates and base phrases form one automaton over word numbers.  A text streams through it once; at each word it
gives the longest match that ends there (matching statistics).  Matches of ``LEAST`` words or more that can't be
extended are chained, in text and template order with small gaps, into spans; a template whose chain covers enough of
it adds its label.  Base phrases are found by the same walk: the states whose strings end in a phrase are known.

Edge cases: null and empty texts have no words, no places and null first and last word; repeated rows are scanned
each; an empty table gives no rows; other columns are not read.  The automaton has a fixed size (the templates).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from logspark.llm.text import chunks

# Phrases of the base and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
# Public license notices, with their labels.
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"),
    ("warranty", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
)
#: Words of a match that is chained, words between chained matches, share of a template that a chain must cover.
LEAST, GAP, COVERED = 3, 12, 0.8
#: Bytes of words (lower-cased); all others separate them.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: bytes) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a text with A-Z lower-cased."""
    return text.translate(_TABLE).split()


class Automaton:
    """Suffix automaton of several word sequences, with the places of each state in each."""

    def __init__(self, base: tuple[tuple[str, str], ...] = BASE, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> None:
        self.base = [(tuple(words(p.encode())), label) for p, label in base]
        self.templates = [(tuple(words(t.encode())), label) for label, t in templates]
        self.number: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.places: list[dict[int, int]] = [{}]  # template: where its first occurrence ends
        for k, (ws, _) in enumerate([*self.templates, *self.base]):
            last = 0
            for at, w in enumerate(ws):
                last = self._extend(last, self.number.setdefault(w, len(self.number)))
                if k < len(self.templates):
                    self.places[last].setdefault(k, at)
        order = sorted(range(1, len(self.next)), key=lambda s: -self.length[s])
        for s in order:
            for k, at in self.places[s].items():
                up = self.places[self.link[s]]
                up[k] = min(at, up.get(k, at))
        self.phrases: list[tuple[tuple[int, int], ...]] = [()] * len(self.next)  # (words, base phrase) that end here
        own: dict[int, list[tuple[int, int]]] = {}
        for k, (ws, _) in enumerate(self.base):
            s = 0
            for w in ws:
                s = self.next[s][self.number[w]]
            own.setdefault(s, []).append((len(ws), k))
        for s in reversed(order):
            self.phrases[s] = (*self.phrases[self.link[s]], *own.get(s, ()))

    def _state(self, length: int, link: int, next_: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(next_)
        self.places.append({})
        return len(self.next) - 1

    def _extend(self, last: int, w: int) -> int:
        """The state of the sequence so far and w (generalised: that state may be there already)."""
        if (to := self.next[last].get(w)) is not None:
            return to if self.length[to] == self.length[last] + 1 else self._split(last, w, to)
        new = self._state(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
        return new

    def _split(self, p: int, w: int, q: int) -> int:
        """A copy of q for the shorter strings that come by p and its suffixes."""
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.places[copy] = dict(self.places[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def scan(self, text_words: list[bytes]) -> tuple[list[tuple[int, int]], list[tuple[int, int, int, float]]]:
        """Places (start, base phrase) and spans (template, first word, last word, share of the template covered)."""
        found: list[tuple[int, int]] = []
        blocks: list[tuple[int, int, int]] = []  # end in the text, length, state
        next_, link, length, phrases = self.next, self.link, self.length, self.phrases
        state, size, before = 0, 0, -2
        get = self.number.get
        for at, w in [(k, n) for k, n in enumerate(map(get, text_words)) if n is not None]:
            if at != before + 1:
                if size >= LEAST:
                    blocks.append((before, size, state))
                state, size = 0, 0
            to = next_[state].get(w)
            if to is None:
                if size >= LEAST:
                    blocks.append((before, size, state))
                while to is None and state:
                    state = link[state]
                    size = length[state]
                    to = next_[state].get(w)
            if to is not None:
                state, size = to, size + 1
                for n, k in phrases[state]:
                    if size >= n:
                        found.append((at - n + 1, k))
            before = at
        if size >= LEAST:
            blocks.append((before, size, state))
        return found, self._chain(blocks)

    def _chain(self, blocks: list[tuple[int, int, int]]) -> list[tuple[int, int, int, float]]:
        open_: dict[int, tuple[int, int, int, int]] = {}  # template: first word, last word, last template word, covered
        spans: list[tuple[int, int, int, float]] = []

        def close(k: int) -> None:
            first, last, _, covered = open_.pop(k)
            share = covered / len(self.templates[k][0])
            if share >= COVERED:
                spans.append((k, first, last, share))

        for end, size, state in blocks:
            for k, t_end in self.places[state].items():
                start, t_start = end - size + 1, t_end - size + 1
                if k in open_:
                    first, last, t_last, covered = open_[k]
                    if start > last + GAP or t_end <= t_last:
                        close(k)
                    else:
                        fresh = min(size, end - last, t_end - t_last)
                        open_[k] = (first, end, t_end, covered + max(0, fresh))
                        continue
                open_[k] = (start, end, t_end, size)
        for k in list(open_):
            close(k)
        return spans


@lru_cache(maxsize=1)
def automaton() -> Automaton:
    return Automaton()


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_words, places and labels of the base, all labels, score, and the spans of templates."""
    key = docs.schema[id_col].dataType.simpleString()
    span = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("covered", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton()
        for b in batches:
            raw = b.column(1).cast(pa.binary())
            for lo, hi in chunks(b.column(1)):
                rows = []
                for t in raw.slice(lo, hi - lo).to_pylist():
                    ws = words(t or b"")
                    places, spans = a.scan(ws)
                    base = {a.base[k][1] for _, k in places}
                    more = {a.templates[k][1] for k, *_ in spans}
                    starts = [s for s, _ in places]
                    score = max([1.0 if places else 0.0, *(min(1.0, c) for *_, c in spans)])
                    rows.append((len(ws), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | more)), score, [{"label": a.templates[k][1], "first_word": f, "last_word": e, "covered": c} for k, f, e, c in spans]))
                cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), span), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), *cols], [id_col, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {key}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label string, first_word long, last_word long, covered double>>")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses of every document."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("spans")
