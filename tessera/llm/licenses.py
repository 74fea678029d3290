"""License scans: an exact set-similarity join of text blocks with license templates.

A template of L words is compared with every window of 2 L words of a text, whichever word it begins at; it matches if
some window holds at least THRESHOLD of the template's distinct words. Words are put in one global order, rarest in the
whole corpus first, by counts over all documents. With a = ceil(THRESHOLD * t) needed of t words:
  prefix: a window without any of the t - a + 1 rarest template words cannot match;
  length: nor can a text with fewer than a distinct template words;
  position: words that are 2 L places or more from all prefix words are in no window that can match.
What is left is counted exactly: the word at place p adds one to all windows that begin after its last occurrence and
hold p, so the running sum over places is the number of distinct template words of every window.

Base phrases are found as consecutive words, all places. Words are runs of ASCII letters and digits and all non-ASCII
characters, A-Z lowered.

Cases: null text is empty and has no words; very long texts are read whole; a label is given once a document; of equal
best windows the first counts; first and last places are null without a base phrase; repeated rows each give their row;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _shared as S
from .decontamination import words

THRESHOLD = 0.8

# Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Well-known passages of public licenses and their notices, by SPDX-like label.
TEMPLATES = {
    "agpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
    "apache-2.0-short": "Licensed under the Apache License, Version 2.0.",
    "bsd-conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "cc-by-nc-short": "Licensed under CC BY-NC 4.0.",
    "cc-by-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc0-notice": "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide.",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-short": "This work is licensed under the GNU General Public License, version 3.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.",
    "mit-short": "Released under the MIT License.",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
}


class Scanner:
    """Templates and phrases as word ids; the ids follow the global order once counts are given."""

    def __init__(self, templates: dict[str, str] = TEMPLATES, phrases: dict[str, str] = PHRASES, threshold: float = THRESHOLD, seen: dict[bytes, int] | None = None):
        texts = {k: words(v.encode()) for k, v in templates.items()}
        spoken = {label: words(p.encode()) for p, label in phrases.items()}
        known = {w for ws in (*texts.values(), *spoken.values()) for w in ws}
        order = sorted(known, key=lambda w: ((seen or {}).get(w, 0), w))
        self.ids = {w: i for i, w in enumerate(order)}
        self.order = order
        self.phrases = [(label, np.array([self.ids[w] for w in ws])) for label, ws in sorted(spoken.items())]
        self.templates = []
        for label, ws in sorted(texts.items()):
            distinct = np.array(sorted({self.ids[w] for w in ws}))
            self.templates.append((label, len(ws), distinct, math.ceil(threshold * len(distinct) - 1e-9)))

    def encode(self, text: bytes) -> np.ndarray:
        w = words(text)
        return np.fromiter(map(self.ids.get, w, repeat(-1)), np.int32, len(w))

    def base(self, ids: np.ndarray) -> list[tuple[str, np.ndarray]]:
        """Places of each phrase."""
        out = []
        for label, phrase in self.phrases:
            at = np.flatnonzero(ids[: max(0, len(ids) - len(phrase) + 1)] == phrase[0])
            for i in range(1, len(phrase)):
                at = at[ids[at + i] == phrase[i]]
            if len(at):
                out.append((label, at))
        return out

    def matches(self, ids: np.ndarray) -> list[tuple[str, int, float]]:
        """(label, first word of the best window, containment) of every template that matches some window."""
        places = np.flatnonzero(ids >= 0)
        have = np.bincount(ids[places], minlength=len(self.ids)) > 0 if len(places) else np.zeros(len(self.ids), dtype=bool)
        out = []
        for label, length, distinct, need in self.templates:
            prefix = distinct[: len(distinct) - need + 1]
            if not have[prefix].any() or have[distinct].sum() < need:
                continue
            found, start = densest(ids, places, distinct, prefix, 2 * length)
            if found >= need:
                out.append((label, start, found / len(distinct)))
        return out


def densest(ids: np.ndarray, places: np.ndarray, distinct: np.ndarray, prefix: np.ndarray, width: int) -> tuple[int, int]:
    """Most distinct words that a window of `width` words holds, of windows with a prefix word, and its first place."""
    own = places[np.isin(ids[places], distinct)]
    seeds = own[np.isin(ids[own], prefix)]
    after = np.searchsorted(seeds, own)
    near = np.minimum(np.abs(own - seeds[np.maximum(after - 1, 0)]), np.abs(seeds[np.minimum(after, len(seeds) - 1)] - own)) < width
    own = own[near]
    order = np.lexsort((own, ids[own]))
    last = np.full(len(own), -1)  # the last place of the same word
    same = np.flatnonzero(np.diff(ids[own[order]]) == 0)
    last[order[same + 1]] = own[order[same]]
    begin = np.maximum(np.maximum(last, own - width) + 1, 0)
    event = np.concatenate([begin, own + 1])
    step = np.repeat((1, -1), len(own))
    order = np.argsort(event, kind="stable")
    event, total = event[order], np.cumsum(step[order])
    ends = np.flatnonzero(np.append(np.diff(event) > 0, True))  # all that happens at a place has happened
    best = ends[np.argmax(total[ends])]
    return int(total[best]), int(event[best])


def corpus_counts(docs: DataFrame, scanner: Scanner) -> dict[bytes, int]:
    """Occurrences in all documents of the words that templates and phrases have; one row a word."""
    size = len(scanner.order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.int64)
        for _, texts in S.blocks(batches, 0):
            for text in texts:
                ids = scanner.encode(text)
                total += np.bincount(ids[ids >= 0], minlength=size)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], names=["word", "seen"])

    rows = S.small_batches(docs).select(S.text_bytes().alias("bytes")).mapInArrow(run, "word long, seen long").groupBy("word").agg(F.sum("seen").alias("seen")).collect()
    return {scanner.order[r["word"]]: r["seen"] for r in rows}


_SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row a document: words, base phrases found, labels (base and templates'), and score, the best containment.

    score is 1 where a base phrase stands, and 0 without any match.
    """
    scanner = Scanner(templates, threshold=threshold, seen=corpus_counts(docs, Scanner(templates, threshold=threshold)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in S.blocks(batches, 1):
            rows = []
            for text in texts:
                ids = scanner.encode(text)
                base = scanner.base(ids)
                more = scanner.matches(ids)
                at = np.concatenate([a for _, a in base]) if base else np.empty(0, dtype=np.int64)
                labels = sorted({label for label, _ in base} | {label for label, _, _ in more})
                score = 1.0 if base else max((c for _, _, c in more), default=0.0)
                rows.append((len(ids), len(at), int(at.min()) if len(at) else None, int(at.max()) if len(at) else None, ",".join(label for label, _ in base), ",".join(labels), score))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())
            arrays = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), *arrays], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    return S.small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), S.text_bytes().alias("bytes")).mapInArrow(run, _SCHEMA)


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(S.table(spark, sf_dir, "documents"))


QUERIES = {"op9_licenses": op9_licenses}
ORACLES: dict[str, str] = {}
