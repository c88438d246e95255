"""Licence statements in whole texts, by a positional index of the templates' rare words.

Words are runs of ASCII letters and digits and of all non-ASCII characters, with A-Z in lower case. Base phrases are
found wherever their words stand one after the other. Beyond them the method finds templates by an index of postings: each word
leads to the templates that have it, and to its places there. A text's licence words are looked up in descending IDF (from their document
frequency in the whole corpus, one aggregation over all texts); each template that they lead to is ruled out or verified once. It is ruled out
if fewer than two of its words, or not all words of its mandatory key phrases, are in the text. Else its postings are intersected by
relative position: it begins where at least two of its words (or all that it has) stand at their places, and where all its key phrases stand
within ``SLACK`` words of theirs. The share of the template's words found at their places is the score.

Null or empty texts have no words and no labels. Repeated rows are each answered. Extra columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravane.llm import textkernel as K
from terravane.llm.shared import batches

# The base phrases with their labels, and the templates (label, opening words of the public statement, key phrases).
BASE = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]
TEMPLATES = [
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ["permission is hereby granted", "free of charge"]),
    ("apache-2", "licensed under the apache license version 2 0", ["apache license", "version 2"]),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", ["gnu general public license", "version 3"]),
    ("gpl-2", "this program is licensed under the gnu general public license version 2", ["gnu general public license", "version 2"]),
    ("lgpl", "licensed under the gnu lesser general public license", ["lesser general public license"]),
    ("agpl-3", "licensed under the gnu affero general public license version 3", ["affero general public license"]),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ["redistribution and use", "binary forms"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["for any purpose", "without fee"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["cc by sa"]),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", ["creative commons attribution"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["unencumbered software", "public domain"]),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement", ["the software is provided as is", "fitness for a particular purpose and noninfringement"]),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ["except in compliance with the license", "apache org licenses license 2 0"]),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", ["gnu general public license", "free software foundation", "version 3 of the license"]),
    ("gpl-2", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", ["gnu general public license", "free software foundation", "version 2 of the license"]),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", ["gnu lesser general public license", "free software foundation"]),
    ("agpl-3", "it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license", ["gnu affero general public license", "free software foundation"]),
    ("mpl-2", "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0", ["copy of the mpl", "mozilla org mpl 2 0"]),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", ["redistributions in binary form", "list of conditions and the following disclaimer"]),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ["neither the name of", "endorse or promote products", "prior written permission"]),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", ["in no event will the authors be held liable", "arising from the use of this software"]),
    ("bsl-1", "boost software license version 1 0", ["boost software license"]),
    ("epl-2", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", ["accompanying materials are made available", "eclipse public license"]),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ["waived all copyright", "neighboring rights"]),
    ("artistic-2", "the artistic license 2 0", ["artistic license 2 0"]),
    ("cc-by-nd", "licensed under cc by nd 4 0", ["cc by nd"]),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license", ["creative commons attribution noncommercial"]),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license", ["creative commons attribution sharealike"]),
]
SLACK = 3


class Index:
    """Hashes of all words of phrases and templates, sorted, with the places of the templates' key phrases."""

    def __init__(self) -> None:
        texts = [t for _, t, _ in TEMPLATES] + [p for p, _ in BASE]
        self.words = sorted({w for t in texts for w in t.split()})
        number = {w: k for k, w in enumerate(self.words)}
        w = K.words_of(pa.array(self.words), K.ALNUM)
        hashes = K.word_hashes(w)
        order = np.argsort(hashes)
        self.hashes, self.number = hashes[order], order
        numbers = lambda text: np.array([number[x] for x in text.split()])
        self.base = [(numbers(p), label) for p, label in BASE]
        self.templates = []
        self.postings: dict[int, list[int]] = {}  # of each word: the templates that have it
        for label, text, keys in TEMPLATES:
            own = numbers(text)
            words = text.split()
            placed = []
            for key in keys:
                k = key.split()
                placed.append((next(i for i in range(len(words)) if words[i : i + len(k)] == k), numbers(key)))
            self.templates.append((label, own, placed))
            for word in np.unique(own).tolist():
                self.postings.setdefault(word, []).append(len(self.templates) - 1)
        shape = len(self.templates), len(self.words)
        self.members, self.needed = np.zeros(shape, np.float32), np.zeros(shape, np.float32)
        for t, (_, own, placed) in enumerate(self.templates):
            self.members[t, own] = 1
            for _, key in placed:
                self.needed[t, key] = 1

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each word in the index, or -1."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.number[at], -1)


_INDEX: Index | None = None


def index() -> Index:
    global _INDEX
    _INDEX = _INDEX or Index()
    return _INDEX


def _frequencies(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own = index()
    n = len(own.words)
    counts, rows = np.zeros(n, dtype=np.int64), 0
    for batch in it:
        for i, j in K.slices(batch.column(0)):
            w = K.words_of(batch.column(0).slice(i, j - i), K.ALNUM)
            number = own.find(K.word_hashes(w))
            there = number >= 0
            pairs = np.unique(w.row[there] * n + number[there])
            counts += np.bincount(pairs % n, minlength=n)
            rows += j - i
    yield pa.RecordBatch.from_arrays([pa.array([*range(n), -1], pa.int32()), pa.array([*counts.tolist(), rows], pa.int64())], names=["word", "n"])


def inverse_frequencies(docs: DataFrame) -> np.ndarray:
    """IDF of each word of the index over all of ``docs``: one row for each of these few words reaches the driver."""
    rows = docs.select("text").mapInArrow(_frequencies, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    counts = {r["word"]: r["n"] for r in rows}
    n = counts.get(-1, 0)
    return np.array([np.log((n + 1) / (counts.get(k, 0) + 0.5)) for k in range(len(index().words))])


def _runs(number: np.ndarray, row: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    """Positions among all words where ``phrase`` stands, in one row."""
    start = np.flatnonzero(number == phrase[0])
    start = start[start + len(phrase) <= len(number)]
    for k in range(1, len(phrase)):
        start = start[(number[start + k] == phrase[k])]
    return start[row[start] == row[start + len(phrase) - 1]]


def candidates(number: np.ndarray, row: np.ndarray, n: int, idf: np.ndarray) -> Iterator[tuple[int, list[int], list[int]]]:
    """(row, its licence words by descending IDF, the templates that their postings lead to, in that order) of the texts of a slice.

    Templates that are ruled out by words alone are left out: those of which fewer than two words are there, or of whose key phrases one is missing.
    """
    own = index()
    there = number >= 0
    present = np.zeros((n, len(own.words)), np.float32)
    present[row[there], number[there]] = 1
    enough = present @ own.members.T >= np.minimum(2, own.members.sum(1))
    open_ = enough & (present @ own.needed.T == own.needed.sum(1))
    for r in np.flatnonzero(open_.any(axis=1)).tolist():
        words = np.flatnonzero(present[r])
        words = words[np.argsort(-idf[words], kind="stable")].tolist()
        found = dict.fromkeys(t for word in words for t in own.postings.get(word, ()) if open_[r, t])
        yield r, words, list(found)


def match(number: np.ndarray, words: list[int], t: int) -> float:
    """The best share of template ``t`` that agrees with a text (numbers of its words), or -1 without a place for it.

    Postings of the rarest words are intersected by relative position: each gives the places where the template would begin, and a
    place needs two of its words. So the most common one of the text's need not be looked up: another one leads to each such place. Then every key
    phrase has to stand within SLACK words of its own place.
    """
    _, template, keys = index().templates[t]
    zeros = np.zeros(len(number), np.int64)
    stand = []
    for q, key in keys:
        stand.append((q, _runs(number, zeros, key)))
        if not len(stand[-1][1]):
            return -1.0
    distinct = np.unique(template)
    least = min(2, len(distinct))
    ours = set(distinct.tolist())
    rare = [w for w in words if w in ours]
    start = np.unique(np.concatenate([(np.flatnonzero(number == w)[:, None] - np.flatnonzero(template == w)).ravel() for w in (rare[:-1] if least == 2 else rare)]))
    for q, places in stand:
        start = start[np.searchsorted(places, start + q + SLACK, side="right") > np.searchsorted(places, start + q - SLACK)]
    at = start[:, None] + np.arange(len(template))
    same = (at >= 0) & (at < len(number))
    same[same] = number[at[same]] == np.broadcast_to(template, at.shape)[same]
    agreeing = sum((same[:, template == w].any(axis=1).astype(int) for w in distinct), np.zeros(len(start), int))
    hits = same.sum(axis=1)[agreeing >= least]
    return float(hits.max()) / len(template) if len(hits) else -1.0


def _templates(number: np.ndarray, row: np.ndarray, first: np.ndarray, idf: np.ndarray) -> Iterator[tuple[str, int, float]]:
    """Label, row and score of each template that each text of a slice holds (numbers of its words, -1 for others)."""
    for r, words, found in candidates(number, row, len(first) - 1, idf):
        for t in found:
            if (share := match(number[first[r] : first[r + 1]], words, t)) >= 0:
                yield index().templates[t][0], r, share


def _scan(it: Iterator[pa.RecordBatch], idf: np.ndarray) -> Iterator[pa.RecordBatch]:
    own = index()
    for batch in it:
        for i, j in K.slices(batch.column(1)):
            part = batch.slice(i, j - i)
            w = K.words_of(part.column(1), K.ALNUM)
            number = own.find(K.word_hashes(w))
            n = j - i
            found = [(_runs(number, w.row, phrase), label) for phrase, label in own.base]
            places = np.concatenate([f for f, _ in found])
            rows = w.row[places]
            inside = places - w.first[rows]
            n_base = np.bincount(rows, minlength=n)
            first = np.full(n, np.iinfo(np.int64).max)
            last = np.full(n, -1, dtype=np.int64)
            np.minimum.at(first, rows, inside)
            np.maximum.at(last, rows, inside)
            labels: dict[int, set[str]] = {}
            for f, label in found:
                for r in np.unique(w.row[f]).tolist():
                    labels.setdefault(r, set()).add(label)
            base_labels = [",".join(sorted(labels.get(r, ()))) for r in range(n)]
            scores = np.where(n_base > 0, 1.0, 0.0)
            for label, r, share in _templates(number, w.row, w.first, idf):
                scores[r] = max(scores[r], share)
                labels.setdefault(r, set()).add(label)
            none = n_base == 0
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array(np.diff(w.first)),
                    pa.array(n_base),
                    pa.array(first, mask=none),
                    pa.array(last, mask=none),
                    pa.array(base_labels),
                    pa.array([",".join(sorted(labels.get(r, ()))) for r in range(n)]),
                    pa.array(scores),
                ],
                names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
            )


def license_scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row of ``docs`` (doc_id, text)."""
    batches(docs)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    idf = inverse_frequencies(docs)
    return docs.mapInArrow(lambda it: _scan(it, idf), "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
