"""License notices and license texts in documents, by winnowed fingerprints and banded alignment.

Texts and templates are sequences of lower-case words of letters and digits. From each window of
WINDOW neighbouring GRAM-word shingles of a template the one with the least hash is a fingerprint (of
templates up to SHORT words every shingle is one). They form an inverted index. A document asks for all
its shingles, so any GRAM + WINDOW - 1 words that it shares with a template give a hit. Hits on
neighbouring diagonals are a candidate if they are at least a FEW of the template's fingerprints; a banded
local alignment over words then measures how much of the template is there, and where. What comes before
and after a notice is aligned again, so notices that follow each other are all found.

Documents are scanned in a narrow map; the index holds the templates only, which are a parameter
(MOST characters at most), and is broadcast.

Edge cases: null and empty texts have none; repeated rows each give rows; a template with fewer than
GRAM words is rejected; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import itertools
import pathlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import slices

GRAM, WINDOW, BAND, COVERAGE, MOST = 3, 3, 8, 0.8, 8 << 20
#: Words up to which every shingle is a fingerprint; share of the fingerprints that makes a candidate; widest region.
SHORT, FEW, SPAN = 24, 0.1, 256
#: Whole license texts, a file each.
TEXTS = pathlib.Path(__file__).parent / "license_texts"
FOUND = "doc_id long, license_id string, span_start long, span_end long, coverage double, matched_words int, template_words int"
_WORD = re.compile(r"[^\W_]+")

# The usual wording of license notices.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "BSD-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "Apache-2.0-header": "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "GPL-freedom": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


class Index:
    """Fingerprints of templates."""

    def __init__(self, templates: dict[str, str]):
        if sum(map(len, templates.values())) > MOST:
            raise ValueError(f"templates of more than {MOST} characters in all")
        self.names = sorted(templates)
        split = [_WORD.findall(templates[n].lower()) for n in self.names]
        if short := [n for n, w in zip(self.names, split, strict=True) if len(w) < GRAM]:
            raise ValueError(f"templates of fewer than {GRAM} words: {short}")
        self.vocabulary = {w: k for k, w in enumerate(sorted({w for s in split for w in s}))}
        self.words = [np.array([self.vocabulary[w] for w in s]) for s in split]
        self.few, rows = [], []
        for t, w in enumerate(self.words):
            h = shingles(w)
            chosen = np.arange(len(h)) if len(w) <= SHORT else winnow(h)
            self.few.append(max(1, int(FEW * len(chosen))) if len(w) > SHORT else 1)
            rows += [(int(h[p]), t, int(p)) for p in chosen]
        rows.sort()
        self.hashes, self.template, self.place = (np.array([r[k] for r in rows], np.uint64 if k == 0 else np.int64) for k in range(3))

    def notices(self, text: str | None, coverage: float = COVERAGE) -> list[tuple]:
        """(name, start, end, coverage, matched words, template words), best first where they overlap."""
        if not text:
            return []
        lower = text.lower() if len(text.lower()) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        words = _WORD.findall(lower)
        w = np.fromiter(map(self.vocabulary.get, words, itertools.repeat(-1)), np.int64, len(words))
        h = shingles(w)
        known = np.flatnonzero(h != _UNKNOWN)
        begin = np.searchsorted(self.hashes, h[known])
        n = np.searchsorted(self.hashes, h[known], "right") - begin
        if not n.sum():
            return []
        entry = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())
        template, spot = self.template[entry], np.repeat(known, n)
        diagonal = spot - self.place[entry]
        order = np.lexsort((spot, diagonal, template))
        found, at = [], None
        for t, lo, hi, spots in self._regions(template[order], diagonal[order], spot[order]):
            m, at = len(self.words[t]), at or [x.span() for x in _WORD.finditer(lower)]
            todo = [(max(0, int(spots[0]) - m), min(len(w), int(spots[-1]) + GRAM + m))]
            while todo:
                x, y = todo.pop()
                if np.searchsorted(spots, y - GRAM, "right") - np.searchsorted(spots, x) < self.few[t]:
                    continue
                hit = align(self.words[t], w, lo - BAND, hi + BAND, x, y)
                if hit and hit[2] >= coverage * m:
                    found.append((self.names[t], at[hit[0]][0], at[hit[1] - 1][1], hit[2] / m, hit[2], m))
                    todo += [(x, hit[0]), (hit[1], y)]
        chosen: list[tuple] = []
        for f in sorted(set(found), key=lambda f: (-f[4], f[1], f[0])):
            if not any(f[1] < c[2] and f[2] > c[1] for c in chosen):
                chosen.append(f)
        return sorted(chosen, key=lambda f: (f[1], f[0]))

    def _regions(self, template: np.ndarray, diagonal: np.ndarray, spot: np.ndarray) -> Iterator[tuple]:
        """(template, least and greatest diagonal, sorted places of its hits) where hits are near each other."""
        edge = np.flatnonzero((np.diff(template) != 0) | (np.diff(diagonal) > 2 * BAND)) + 1
        for a, b in zip([0, *edge.tolist()], [*edge.tolist(), len(template)], strict=True):
            while a < b:  # a run too wide is cut where SPAN ends; the bands of its parts overlap
                z = a + int(np.searchsorted(diagonal[a:b], diagonal[a] + SPAN))
                if z - a >= self.few[template[a]]:
                    yield int(template[a]), int(diagonal[a]), int(diagonal[z - 1]), np.sort(spot[a:z])
                a = z


_UNKNOWN = np.iinfo(np.uint64).max


def shingles(words: np.ndarray) -> np.ndarray:
    """A hash of each run of GRAM words; the greatest value where a word is unknown."""
    n = len(words) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h, known = np.zeros(n, np.uint64), np.ones(n, bool)
    for k in range(GRAM):
        part = words[k : k + n]
        known &= part >= 0
        h = (h ^ (part.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return np.where(known, h >> np.uint64(1), _UNKNOWN)


def winnow(h: np.ndarray) -> np.ndarray:
    """Places of the fingerprints: the last least hash of each window of WINDOW (of all, if fewer)."""
    if not len(h):
        return np.zeros(0, np.int64)
    width = min(WINDOW, len(h))
    windows = np.lib.stride_tricks.sliding_window_view(h, width)
    place = np.unique(np.arange(len(windows)) + width - 1 - np.argmin(windows[:, ::-1], axis=1))
    return place[h[place] != _UNKNOWN]


def align(template: np.ndarray, doc: np.ndarray, lo: int, hi: int, first: int, last: int) -> tuple[int, int, int] | None:
    """(first word, end, matched words) of the best local alignment in doc[first:last] on diagonals lo..hi:
    a matched word scores 2, one that is missing, added or replaced -1. Ties go to the one that ends first."""
    m = len(template)
    lo, hi = max(lo, first - m + 1), min(hi, last - 1)
    width = hi - lo + 1
    if width <= 0:
        return None
    pad = np.full(width + m, -2, np.int64)  # what lies outside matches nothing
    a, b = max(first, lo), min(last, lo + width + m)
    pad[a - lo : b - lo] = doc[a:b]
    # score << 42 | first word (relative to lo) << 21 | matched words: one maximum carries all three
    one, cols = 1 << 42, np.arange(width)
    drift, low = cols * one, -(1 << 60)
    row, best, where = np.full(width, low), 0, None
    for p in range(m):
        fresh = (p + cols) << 21
        step = np.maximum(row, fresh) + np.where(pad[p : p + width] == template[p], 2 * one + 1, -one)
        step = np.maximum(step, np.append(row[1:], low) - one)
        row = np.maximum.accumulate(step + drift) - drift
        k = int(np.argmax(row >> 42))
        if row[k] >> 42 > best:
            best, where = int(row[k] >> 42), (int(row[k]), p + lo + k + 1)
    if where is None:
        return None
    value, end = where
    return (value >> 21 & 0x1FFFFF) + lo, end, value & 0x1FFFFF


def _read_texts(folder: pathlib.Path = TEXTS) -> dict[str, str]:
    return {f.stem: f.read_text() for f in sorted(folder.glob("*.txt"))}


@functools.cache
def usual() -> dict[str, str]:
    """The notices above and the whole texts in TEXTS."""
    return TEMPLATES | _read_texts()


def scan(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """A row of FOUND for each notice; spans are code points of the text, ends exclusive."""
    index = docs.sparkSession.sparkContext.broadcast(Index(usual() if templates is None else templates))
    types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32())
    names = [x.split()[0] for x in FOUND.split(", ")]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            rows = [(doc, *f) for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True) for f in index.value.notices(text, coverage)]
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(find, FOUND)
