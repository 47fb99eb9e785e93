"""Licence scans by a positional index of rare licence words.

Templates are short standard notices. Their words form a vocabulary of fixed size; each word's inverse document
frequency comes from all files. In a file, each template's highest-IDF words that stand there are looked up in its
postings, whatever other words or templates the file has: so many that two of them at least are in place wherever a share
of MIN_COVER is; occurrences that agree on its relative position, within SLACK words for insertions, seed a match. A
template counts where enough of its words stand in place and one of its mandatory key phrases stands there in full.
Templates that cannot be in a file, as it lacks too many of their words or some word of each key phrase, aren't looked up.

Beside that, base phrases give labels wherever their words stand consecutively.

Nulls are empty texts: no words, no labels, score 0. Repeated rows stay rows of their own, ties don't arise (labels are
sets), and other columns don't matter.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import doc_text, text_slices, word_hashes, words

# fixed values: base phrases and their labels
BASE = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

# fixed values: standard notices (label, words, mandatory key phrases)
TEMPLATES = (
    ("gpl", "this work is licensed under the gnu general public license version 3", ("gnu general public license",)),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ("gnu general public license", "gnu gpl")),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", ("gnu lesser general public license",)),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ("apache license",)),
    ("apache", "licensed under the apache license version 2 0", ("apache license", "apache 2 0")),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ("permission is hereby granted free of charge",)),
    ("mit", "released under the mit license", ("mit license",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify",)),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("cc-by", "licensed under cc by 4 0", ("cc by",)),
    ("cc-by", "licensed under the creative commons attribution 4 0 international license", ("creative commons attribution",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software",)),
)

SLACK = 4
MIN_COVER = 0.6

#: Separators: everything in ASCII but digits and letters.
SEPARATORS = np.zeros(256, bool)
SEPARATORS[:128] = True
SEPARATORS[[*range(0x30, 0x3A), *range(0x61, 0x7B)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def hashes_of(phrase: str) -> np.ndarray:
    data = np.frombuffer(phrase.encode(), np.uint8)
    starts, ends, _ = words(data, np.array([0, len(data)]), SEPARATORS)
    return word_hashes(data, starts, ends)


class Index:
    """Vocabulary, postings (word -> template, position) and key phrases, all as hashes."""

    def __init__(self, templates=TEMPLATES):
        self.labels = [t[0] for t in templates]
        self.texts = [hashes_of(t[1]) for t in templates]
        self.distinct = [set(text.tolist()) for text in self.texts]
        self.keys = [[hashes_of(k) for k in t[2]] for t in templates]
        self.base = [(hashes_of(p), label) for p, label in BASE]
        self.vocabulary = np.unique(np.concatenate([*self.texts, *(p for p, _ in self.base), *(k for x in self.keys for k in x)]))
        place = lambda h: np.searchsorted(self.vocabulary, h)
        #: How often each vocabulary word stands in each template, and the words of each key phrase.
        self.uses = np.stack([np.bincount(place(text), minlength=len(self.vocabulary)) for text in self.texts], 1)
        self.key_places = [[place(k) for k in x] for x in self.keys]
        self.postings: dict[int, list[tuple[int, int]]] = {}
        for t, text in enumerate(self.texts):
            for q, h in enumerate(text.tolist()):
                self.postings.setdefault(h, []).append((t, q))

    def possible(self, here: np.ndarray) -> np.ndarray:
        """(documents, templates): whether a document with these vocabulary words (documents, vocabulary) may match."""
        lengths = np.array([len(text) for text in self.texts])
        out = here.astype(np.int32) @ self.uses >= MIN_COVER * lengths - 1e-9
        for t, keys in enumerate(self.key_places):
            out[:, t] &= np.any([here[:, k].all(1) for k in keys], axis=0)
        return out

    def searched(self, here: set[int], idf: dict[int, float], templates: list[int]) -> dict[int, list[tuple[int, int]]]:
        """Word -> postings of those of the templates that it is one of the highest-IDF words of, among the words here."""
        out: dict[int, list[tuple[int, int]]] = {}
        for t in templates:
            words = self.distinct[t]
            k = int(len(self.texts[t]) * (1 - MIN_COVER)) + 2
            for h in sorted(words & here, key=lambda h: (-idf.get(h, 0.0), h))[:k]:
                out.setdefault(h, []).extend(x for x in self.postings[h] if x[0] == t)
        return out


def lowered(column: pa.Array):
    """(first row, last row, word hashes, first words) of the lower-cased texts."""
    for i, j, data, offsets in text_slices(column):
        data = LOWER[data]
        starts, ends, firsts = words(data, offsets, SEPARATORS)
        yield i, j, word_hashes(data, starts, ends), firsts


def members(hashes: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    """Indexes of the words that are in the vocabulary."""
    at = np.searchsorted(vocabulary, hashes)
    at[at == len(vocabulary)] = 0
    return np.flatnonzero(vocabulary[at] == hashes)


def file_frequencies(texts: DataFrame, index: Index) -> tuple[int, dict[int, int]]:
    """Files, and the number of files with each vocabulary word; a row a word at most comes to the driver."""
    vocabulary = index.vocabulary

    def run(batches):
        files, seen = 0, np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            files += batch.num_rows
            for i, j, hashes, firsts in lowered(batch.column(1)):
                hit = members(hashes, vocabulary)
                doc = np.searchsorted(firsts, hit, "right") - 1
                pair = np.unique(doc * len(vocabulary) + np.searchsorted(vocabulary, hashes[hit]))
                seen += np.bincount(pair % len(vocabulary), minlength=len(vocabulary))
        yield pa.RecordBatch.from_arrays([pa.array([*range(len(vocabulary)), -1]), pa.array([*seen.tolist(), files])], ["word", "n"])

    got = {r["word"]: r["n"] for r in texts.mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return got.pop(-1, 0), {int(vocabulary[k]): n for k, n in got.items()}


def phrase_at(hashes: np.ndarray, phrase: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Starts of the phrase among the words lo to hi (exclusive)."""
    n = hi - lo - len(phrase) + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    at = np.flatnonzero(hashes[lo : lo + n] == phrase[0]) + lo
    for k in range(1, len(phrase)):
        at = at[hashes[at + k] == phrase[k]]
    return at


def match(index: Index, hashes: np.ndarray, places: np.ndarray, searched: dict[int, list[tuple[int, int]]], lo: int, hi: int) -> list[tuple[str, float]]:
    """(label, share of the template's words in place) of the templates found among the words lo to hi.

    places: where vocabulary words stand; searched: the postings of the words that are looked up.
    """
    votes: dict[tuple[int, int], int] = {}
    for p in places.tolist():
        for t, q in searched.get(int(hashes[p]), ()):
            votes[t, p - q] = votes.get((t, p - q), 0) + 1
    best: dict[int, float] = {}
    for (t, offset), n in votes.items():
        text = index.texts[t]
        if best.get(t) == 1.0 or n + sum(votes.get((t, offset + d), 0) for d in range(-SLACK, SLACK + 1) if d) < min(2, len(text)):
            continue
        found = np.zeros(len(text), bool)
        for d in range(-SLACK, SLACK + 1):
            at = offset + d + np.arange(len(text))
            inside = (at >= lo) & (at < hi)
            found[inside] |= hashes[at[inside]] == text[inside]
        cover = float(found.mean())
        if cover >= MIN_COVER and cover > best.get(t, 0.0):
            first, last = max(lo, offset - SLACK), min(hi, offset + len(text) + SLACK)
            if any(len(phrase_at(hashes, k, first, last)) for k in index.keys[t]):
                best[t] = cover
    return [(index.labels[t], cover) for t, cover in best.items()]


def base_places(index: Index, hashes: np.ndarray, hit: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, first word and phrase number of every base phrase; hit: where vocabulary words stand."""
    found = []
    document = np.searchsorted(firsts, hit, "right") - 1
    for number, (phrase, _) in enumerate(index.base):
        at = np.flatnonzero(hashes[hit] == phrase[0])
        start, doc = hit[at], document[at]
        inside = start + len(phrase) <= firsts[doc + 1]
        start, doc = start[inside], doc[inside]
        for n in range(1, len(phrase)):
            stay = hashes[start + n] == phrase[n]
            start, doc = start[stay], doc[stay]
        found.append((doc, start - firsts[doc], np.full(len(doc), number)))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def scanned(index: Index, idf: dict[int, float], hashes: np.ndarray, firsts: np.ndarray) -> list[tuple]:
    """n_words, n_base, first_word, last_word, base_labels, labels, score of each document."""
    n, size = len(firsts) - 1, len(index.vocabulary)
    hit = members(hashes, index.vocabulary)
    document = np.searchsorted(firsts, hit, "right") - 1
    here = np.zeros((n, size), bool)
    here[document, np.searchsorted(index.vocabulary, hashes[hit])] = True
    doc, word, phrase = base_places(index, hashes, hit, firsts)
    count = np.bincount(doc, minlength=n)
    least, most = np.full(n, len(hashes)), np.full(n, -1)
    np.minimum.at(least, doc, word)
    np.maximum.at(most, doc, word)
    base: dict[int, set[str]] = {}
    for d, k in zip(doc.tolist(), phrase.tolist(), strict=True):
        base.setdefault(d, set()).add(index.base[k][1])
    found: dict[int, list[tuple[str, float]]] = {}
    possible = index.possible(here)
    cut = np.searchsorted(hit, firsts)
    for d in np.flatnonzero(possible.any(1)).tolist():
        words_here = set(index.vocabulary[here[d]].tolist())
        searched = index.searched(words_here, idf, np.flatnonzero(possible[d]).tolist())
        places = hit[cut[d] : cut[d + 1]]
        places = places[np.isin(hashes[places], np.array(list(searched), np.uint64))]
        found[d] = match(index, hashes, places, searched, int(firsts[d]), int(firsts[d + 1]))
    out = []
    for d, length in enumerate(np.diff(firsts).tolist()):
        plain, more = base.get(d, set()), found.get(d, [])
        labels = ",".join(sorted(plain | {label for label, _ in more}))
        span = (int(least[d]), int(most[d])) if count[d] else (None, None)
        out.append((length, int(count[d]), *span, ",".join(sorted(plain)), labels, 1.0 if plain else max([0.0, *(c for _, c in more)])))
    return out


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of each row."""
    texts, index = doc_text(docs), Index()
    files, frequency = file_frequencies(texts, index)
    idf = {h: math.log((files + 1) / (n + 1)) for h, n in frequency.items()}

    def run(batches):
        for batch in batches:
            rows = [x for _, _, hashes, firsts in lowered(batch.column(1)) for x in scanned(index, idf, hashes, firsts)]
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array([x[k] for x in rows], kind) for k, kind in enumerate(kinds))],
                ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
            )

    return texts.mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
