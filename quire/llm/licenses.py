"""Licence scan with a positional rare-token index.

Every licence template is a word sequence with mandatory key phrases; a key
phrase is a template of its own too.  The index holds, for each template, the
postings (word, position) of its highest-IDF words only; IDF counts the
documents of the whole corpus that hold a word.  For each file

1. its rare licence words are looked up in the index;
2. each pair of a place in the file and a posting votes, with the word's
   IDF, for a relative position; the votes at a position over the template's
   total are its coverage there.  A notice is proposed by a coverage of
   ``propose`` at its best position, a key phrase at every position where all
   its postings line up;
3. a proposed place of a key phrase is verified word for word, and a proposed
   notice by one of its key phrases.  Labels are those of verified templates.

A phrase that stands in a file has all its postings in line, so no place is
lost.  The template texts are short notices; their vocabulary bounds the
index (some hundred words), whatever the corpus.  One pass counts document
frequencies, a second, narrow pass scans; both work on flat arrays of word
hashes.

*Defined results.*  Null and empty texts have no words and no labels.
Matches never cross documents.  Repeated rows and null ids give a row each.
An empty table gives an empty result.  Very long texts are scanned whole.
Only id and text are read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import byte_view, col, steps

# The base labels and their phrases.
BASE = {"apache": "apache license", "gpl": "general public license", "mit": "mit license"}

# Notices, their label and their key phrases (any one verifies).
TEMPLATES = [
    ("mit", "Released under the MIT License", ["mit license"]),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction", ["permission is hereby granted free of charge to any person obtaining a copy of this software"]),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License", ["apache license"]),
    ("gpl", "This work is licensed under the GNU General Public License, version 3", ["general public license"]),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", ["general public license"]),
    ("lgpl", "GNU Lesser General Public License", ["lesser general public license", "library general public license"]),
    ("agpl", "GNU Affero General Public License", ["affero general public license"]),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms"]),
    ("bsd", "Use of this source code is governed by a BSD style license that can be found in the LICENSE file", ["bsd license", "bsd style license", "bsd 2 clause", "bsd 3 clause"]),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ["mozilla public license"]),
    ("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0", ["eclipse public license"]),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", ["isc license", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"]),
    ("unlicense", "This is free and unencumbered software released into the public domain", ["free and unencumbered software released into the public domain"]),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0", ["cc by nc", "creative commons attribution noncommercial", "creative commons attribution non commercial"]),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0", ["cc by sa", "creative commons attribution sharealike", "creative commons attribution share alike"]),
    ("cc-by", "Licensed under CC BY 4.0 Creative Commons Attribution 4.0 International License", ["cc by 4 0", "cc by 3 0", "creative commons attribution 4 0"]),
    ("cc0", "CC0 1.0 Universal Public Domain Dedication", ["cc0 1 0", "public domain dedication"]),
    ("boost", "Distributed under the Boost Software License, Version 1.0", ["boost software license"]),
    ("all-rights-reserved", "All rights reserved", ["all rights reserved"]),
]

# What splits words besides A-Z, which is lower-cased.
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[65:91] = WORD[97:123] = WORD[128:] = True
LOWERED = np.arange(256, dtype=np.uint64)
LOWERED[65:91] += np.uint64(32)
MIX = np.uint64(0x9E3779B97F4A7C15)


def split_words(text: str) -> list[str]:
    """Words of a template, by the same rule as the files' words."""
    return "".join(c.lower() if c.isascii() and c.isalnum() or ord(c) > 127 else " " for c in text).split()


def word_hashes(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hash of each word of each text, and the texts' offsets in them."""
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    word = WORD[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[at] = True
    begin = np.flatnonzero(word & (edge[:-1] | np.append(True, ~word[:-1])))
    stop = np.flatnonzero(word & (edge[1:] | np.append(~word[1:], True))) + 1
    power = np.multiply.accumulate(np.full(len(raw), MIX))
    total = np.append(np.uint64(0), np.cumsum((LOWERED[raw] + np.uint64(1)) * power))
    # sum of byte * MIX^(place in the word): shifting by the inverse removes the place in the text
    shift = np.multiply.accumulate(np.full(len(raw), np.uint64(pow(int(MIX), -1, 1 << 64))))
    return (total[stop] - total[begin]) * shift[begin], np.searchsorted(begin, at)


def hash_words(words: list[str]) -> np.ndarray:
    raw = [w.encode() for w in words]
    at = np.append(0, np.cumsum([len(w) for w in raw]))
    h, _ = word_hashes(np.frombuffer(b"".join(raw), np.uint8), at)
    return h


@dataclass
class Index:
    vocab: np.ndarray  # sorted word hashes
    idf: np.ndarray
    words: list[np.ndarray]  # word ids of each template
    labels: list[str]
    keys: list[list[int]]  # key phrases of each template, as template numbers
    base: list[bool]  # whether the template is a base phrase
    need: np.ndarray  # coverage from which a template is proposed
    total: np.ndarray  # votes that a whole template gets
    first: np.ndarray  # postings of word x are first[x] to first[x + 1]
    template: np.ndarray
    position: np.ndarray


def vocabulary() -> np.ndarray:
    words = {w for _, text, keys in TEMPLATES for s in (text, *keys) for w in split_words(s)}
    words |= {w for s in BASE.values() for w in split_words(s)}
    return np.unique(hash_words(sorted(words)))


COMMON = 0.01  # words of a larger share of the documents are postings only if a template has no two others


def build_index(vocab: np.ndarray, df: np.ndarray, n_docs: int, rare: int = 8, propose: float = 0.3) -> Index:
    """Postings of up to ``rare`` highest-IDF words of each template."""
    idf = np.maximum(np.log((n_docs + 1.0) / (df + 0.5)), 1e-3)
    ids = lambda s: np.searchsorted(vocab, hash_words(split_words(s)))
    phrases = sorted({(label, key) for label, _, many in TEMPLATES for key in many} | set(BASE.items()))
    number = {p: i for i, p in enumerate(phrases)}
    texts = [(label, key, [i], BASE.get(label) == key, 0.999) for i, (label, key) in enumerate(phrases)]
    texts += [(label, text, [number[label, k] for k in many], False, propose) for label, text, many in TEMPLATES]
    words, total, postings = [ids(text) for _, text, *_ in texts], np.zeros(len(texts)), []
    for t, w in enumerate(words):
        best = sorted(set(w.tolist()), key=lambda x: (-idf[x], x))[:rare]
        best = [x for i, x in enumerate(best) if i < 2 or df[x] <= COMMON * n_docs]
        for q, x in enumerate(w.tolist()):
            if x in best:
                postings.append((x, t, q))
                total[t] += idf[x]
    x, t, q = np.array(sorted(postings), np.int64).T
    first = np.searchsorted(x, np.arange(len(vocab) + 1))
    return Index(vocab, idf, words, [e[0] for e in texts], [e[2] for e in texts], [e[3] for e in texts], np.array([e[4] for e in texts]), total, first, t, q)


def _ids(vocab: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Vocabulary id of each word, -1 for words of no template."""
    i = np.minimum(np.searchsorted(vocab, h), len(vocab) - 1)
    return np.where(vocab[i] == h, i, -1)


def count_documents(vocab: np.ndarray):
    """Per task: how many texts hold each licence word, and how many texts there are."""

    def run(batches):
        df, n = np.zeros(len(vocab), np.int64), 0
        for batch in batches:
            raw, at = byte_view(batch.column(0))
            for i, j in steps(at):
                h, off = word_hashes(raw[at[i] : at[j]], at[i : j + 1] - at[i])
                w, doc = _ids(vocab, h), np.repeat(np.arange(j - i), np.diff(off))
                seen = np.unique(doc[w >= 0] * len(vocab) + w[w >= 0])
                df += np.bincount(seen % len(vocab), minlength=len(vocab))
                n += j - i
        yield pa.RecordBatch.from_pydict(
            {"w": pa.array([*range(len(vocab)), -1], pa.int64()), "n": pa.array([*df.tolist(), n], pa.int64())}
        )

    return run


BACK = 1 << 20  # added to relative positions, which may be below zero


def _votes(index: Index, w: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, template, relative position, coverage) wherever a posting meets its word."""
    place = np.flatnonzero(w >= 0)
    x = w[place]
    many = index.first[x + 1] - index.first[x]
    place, x = np.repeat(place, many), np.repeat(x, many)
    nth = np.arange(len(x)) - np.repeat(np.cumsum(many) - many, many)
    posting = index.first[x] + nth
    doc = np.searchsorted(off, place, side="right") - 1
    t, rel = index.template[posting], place - off[doc] - index.position[posting]
    key = (doc * len(index.words) + t) << 32 | (rel + BACK)
    key, which = np.unique(key, return_inverse=True)
    votes = np.bincount(which, index.idf[x], minlength=len(key))
    doc, t = np.divmod(key >> 32, len(index.words))
    return doc, t, (key & ((1 << 32) - 1)) - BACK, votes / index.total[t]


def scan_batch(index: Index, raw: np.ndarray, at: np.ndarray) -> dict[str, list]:
    h, off = word_hashes(raw, at)
    w, n = _ids(index.vocab, h), len(at) - 1
    doc, t, rel, cover = _votes(index, w, off)
    proposed = cover >= index.need[t]
    doc, t, rel, cover = doc[proposed], t[proposed], rel[proposed], np.minimum(cover[proposed], 1.0)
    stands: set[tuple[int, int]] = set()
    places: list[list[np.ndarray]] = [[] for _ in range(n)]
    base: list[set[str]] = [set() for _ in range(n)]
    for e in np.unique(t[index.need[t] > 0.9]).tolist():  # key phrases: word for word
        d, start, words = doc[t == e], rel[t == e], index.words[e]
        inside = (start >= 0) & (off[d] + start + len(words) <= off[d + 1])
        d, start = d[inside], start[inside]
        for k, x in enumerate(words):
            same = w[off[d] + start + k] == x
            d, start = d[same], start[same]
        for i in np.unique(d).tolist():
            stands.add((i, e))
            if index.base[e]:
                base[i].add(index.labels[e])
                places[i].append(start[d == i])
    labels: list[dict[str, float]] = [{} for _ in range(n)]
    for d, e, c in zip(doc.tolist(), t.tolist(), cover.tolist()):
        if any((d, k) in stands for k in index.keys[e]):
            c = 0.0 if index.need[e] > 0.9 else c  # coverage is that of a whole notice
            labels[d][index.labels[e]] = max(labels[d].get(index.labels[e], 0.0), c)
    out: dict[str, list] = {k: [] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")}
    for d in range(n):
        found = np.concatenate(places[d]) if places[d] else np.zeros(0, np.int64)
        out["n_words"].append(int(off[d + 1] - off[d]))
        out["n_base"].append(len(found))
        out["first_word"].append(int(found.min()) if len(found) else None)
        out["last_word"].append(int(found.max()) if len(found) else None)
        out["base_labels"].append(",".join(sorted(base[d])))
        out["labels"].append(",".join(sorted(labels[d])))
        out["score"].append(0.5 + 0.5 * max(labels[d].values()) if labels[d] else 0.0)
    return out


SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
ARROW = [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())]


def corpus_index(docs: DataFrame, text_col: str = "text", rare: int = 8) -> Index:
    """The index with IDF over all rows of ``docs``; only the counts of the
    templates' words come to the driver."""
    vocab = vocabulary()
    counts = docs.select(col(text_col)).mapInArrow(count_documents(vocab), "w long, n long")
    counts = {r.w: r.n for r in counts.groupBy("w").agg(F.sum("n").alias("n")).collect()}
    df = np.array([counts.get(k, 0) for k in range(len(vocab))], float)
    return build_index(vocab, df, counts.get(-1, 0), rare)


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rare: int = 8) -> DataFrame:
    """One row per row of ``docs``: id, word count, base phrase places, labels, score."""
    index = corpus_index(docs, text_col, rare)

    def scan(batches):
        for batch in batches:
            raw, at = byte_view(batch.column(1))
            for i, j in steps(at):
                got = scan_batch(index, raw[at[i] : at[j]], at[i : j + 1] - at[i])
                cols = [batch.column(0).slice(i, j - i), *(pa.array(got[k], t) for k, t in ARROW)]
                yield pa.RecordBatch.from_arrays(cols, ["id", *(k for k, _ in ARROW)])

    kind = docs.select(col(id_col)).dtypes[0][1]
    out = docs.select(col(id_col).alias("id"), col(text_col).alias("text")).mapInArrow(scan, f"id {kind}, {SCHEMA}")
    return out.withColumnRenamed("id", id_col)
