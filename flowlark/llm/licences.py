"""Licence scan with a positional index of rare licence words.

``PASSAGES`` are notices and sentences of licences. Their words are weighted by how rare they are in the whole corpus. A
file states a passage if, at one relative position, words with at least ``LEAST`` % of the passage's weight stand where the
passage has them, its key phrases among them word for word.

Any such place holds one of the passage's rarest words: of those whose weights add up to more than the rest may lack. Only
they are indexed, with their positions in the passages. A file's words are looked up there, a posting's position taken from
the word's place gives a relative position, and each different one is then compared word by word. So nothing is missed, and
common words never open a comparison. Texts are read twice: once to count the licence words' documents, once to scan.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, Vocabulary, chunks, utf8, words

# Labels, wordings of public licence notices, and the phrases in them that must stand word for word.
PASSAGES = (
    ("mit", "Released under the MIT License", ["mit license"]),
    ("mit", "Licensed under the MIT License", ["mit license"]),
    ("mit", "SPDX-License-Identifier: MIT", ["license identifier mit"]),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software", ["permission is hereby granted", "deal in the software without restriction"]),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", ["with or without fee is hereby granted"]),
    ("isc", "SPDX-License-Identifier: ISC", ["license identifier isc"]),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms", "following conditions are met"]),
    ("bsd", "SPDX-License-Identifier: BSD-3-Clause", ["license identifier bsd"]),
    ("bsd", "SPDX-License-Identifier: BSD-2-Clause", ["license identifier bsd"]),
    ("apache", "Licensed under the Apache License, Version 2.0", ["apache license version 2"]),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", ["except in compliance with the license", "apache org licenses license 2"]),
    ("apache", "SPDX-License-Identifier: Apache-2.0", ["license identifier apache"]),
    ("gpl", "This work is licensed under the GNU General Public License, version 3", ["gnu general public license"]),
    ("gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", ["terms of the gnu general public license"]),
    ("gpl", "SPDX-License-Identifier: GPL-3.0-or-later", ["license identifier gpl"]),
    ("gpl", "SPDX-License-Identifier: GPL-2.0-only", ["license identifier gpl"]),
    ("lgpl", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", ["gnu lesser general public license"]),
    ("lgpl", "SPDX-License-Identifier: LGPL-3.0-or-later", ["license identifier lgpl"]),
    ("agpl", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation", ["gnu affero general public license"]),
    ("agpl", "SPDX-License-Identifier: AGPL-3.0-or-later", ["license identifier agpl"]),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ["mozilla public license v 2"]),
    ("mpl", "SPDX-License-Identifier: MPL-2.0", ["license identifier mpl"]),
    ("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", ["eclipse public license"]),
    ("boost", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", ["person or organization obtaining a copy"]),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software", ["provided as is", "in no event will the authors be held liable"]),
    ("unlicense", "This is free and unencumbered software released into the public domain", ["free and unencumbered software"]),
    ("cc0", "CC0 1.0 Universal Public Domain Dedication", ["cc0 1 0"]),
    ("cc-by", "Licensed under CC BY 4.0", ["cc by 4"]),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License", ["creative commons attribution 4"]),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0", ["cc by sa 4"]),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ["creative commons attribution sharealike 4"]),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0", ["cc by nc 4"]),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", ["creative commons attribution noncommercial 4"]),
    ("cc-by-nd", "Licensed under CC BY-ND 4.0", ["cc by nd 4"]),
    ("cc-by-nc-sa", "Licensed under CC BY-NC-SA 4.0", ["cc by nc sa 4"]),
    ("cc-by-nc-nd", "Licensed under CC BY-NC-ND 4.0", ["cc by nc nd 4"]),
)
# Phrases that name a licence wherever they stand.
PHRASES = (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license"))
#: A passage is there if so much of its weight (in %) stands at one relative position.
LEAST = 60
#: Comparisons that are held at a time.
COMPARED = 1 << 14
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_BYTES = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])
HITS = "array<struct<label:string,start:bigint,length:int,share:double,phrase:boolean>>"


def words_of(text: str) -> list[bytes]:
    return _WORD.findall(text.encode("utf-8", "surrogatepass").translate(LOWER.tobytes()))


def weights_of(n_docs: int, counts: dict[bytes, int]) -> dict[bytes, int]:
    """Words' weights, at least 1, from the number of documents that hold them."""
    return {w: 1 + max(0, math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))) for w, df in counts.items()}


def key_places(passage: list[bytes], keys: list[str]) -> list[int]:
    """The places in the passage of its key phrases' words, each phrase where it stands first."""
    out = set()
    for phrase in map(words_of, keys):
        at = next(i for i in range(len(passage)) if passage[i : i + len(phrase)] == phrase)
        out |= set(range(at, at + len(phrase)))
    return sorted(out)


class Index:
    """Passages as arrays of word numbers and weights, and the postings (passage, position) of their rarest words."""

    def __init__(self, vocabulary: Vocabulary, weights: np.ndarray, passages=PASSAGES, phrases=PHRASES, least: int = LEAST):
        number = {w: i for i, w in enumerate(vocabulary.words)}
        numbers = lambda text: np.array([number[w] for w in words_of(text)])
        self.vocabulary, self.least = vocabulary, least
        self.passages = [(label, x := numbers(text), weights[x], key_places(words_of(text), keys)) for label, text, keys in passages]
        self.phrases = [(label, numbers(text)) for label, text in phrases]
        self.postings: list[list[tuple[int, int]]] = [[] for _ in vocabulary.words]
        for k, (_, x, w, _) in enumerate(self.passages):
            spare, total = 100 * w.sum(), w.sum()
            for word in sorted(set(x.tolist()), key=lambda v: (-weights[v], v)):
                # What is left without the words so far could still reach the least share, so one more is needed.
                if spare < least * total:
                    break
                self.postings[word] += [(k, int(p)) for p in np.flatnonzero(x == word)]
                spare -= 100 * w[x == word].sum()
        self.rare = np.array([bool(p) for p in self.postings])

    def hits(self, ids: np.ndarray, row: np.ndarray, first: np.ndarray) -> list[tuple[np.ndarray, str, np.ndarray, int, np.ndarray, bool]]:
        """(rows, label, first words, length, shares, phrase) of each passage and phrase. ``ids``: the words' numbers in the
        vocabulary, -1 for others; ``row``: the words' rows; ``first``: the rows' first words."""
        out = []
        for label, phrase in self.phrases:
            at = np.flatnonzero(ids[: max(0, len(ids) - len(phrase) + 1)] == phrase[0])
            for j in range(1, len(phrase)):
                at = at[(ids[at + j] == phrase[j]) & (row[at + j] == row[at])]
            if len(at):
                out.append((row[at], label, at - first[row[at]], len(phrase), np.ones(len(at)), True))
        places = np.flatnonzero((ids >= 0) & self.rare[ids])
        starts: dict[int, list[np.ndarray]] = {}
        for word in np.unique(ids[places]).tolist():
            mine = places[ids[places] == word]
            for k, p in self.postings[word]:
                # A relative position is told by the row and where the passage would begin, perhaps before the text does.
                starts.setdefault(k, []).append(np.stack([row[mine], mine - p]))
        for k in sorted(starts):
            label, x, w, keys = self.passages[k]
            every = np.unique(np.concatenate(starts[k], axis=1), axis=1)
            for a in range(0, every.shape[1], COMPARED):
                mine, begin = every[:, a : a + COMPARED]
                at = begin[:, None] + np.arange(len(x))
                inside = (at >= first[mine][:, None]) & (at < first[mine + 1][:, None])
                same = inside & (ids[np.clip(at, 0, len(ids) - 1)] == x)
                weight = same @ w
                good = np.flatnonzero((100 * weight >= self.least * w.sum()) & same[:, keys].all(axis=1))
                if len(good):
                    out.append((mine[good], label, begin[good] - first[mine[good]], len(x), weight[good] / w.sum(), False))
        return out


def _scanned(column: pa.Array, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words' numbers and rows, and the rows' first words."""
    data, offsets = utf8(column)
    data = LOWER[data]
    starts, ends, first = words(data, offsets, _BYTES)
    return vocabulary.find(data, starts, ends), np.repeat(np.arange(len(column)), np.diff(first)), first


def build_index(docs: DataFrame, text_col: str = "text", passages=PASSAGES, phrases=PHRASES, least: int = LEAST) -> Index:
    """The index of the passages, with their words' weights from all texts of ``docs`` that have a word."""
    vocabulary = Vocabulary([w for text in [*(p[1] for p in passages), *(p[1] for p in phrases)] for w in words_of(text)])

    def count(batches):
        for batch in chunks(batches):
            ids, row, first = _scanned(batch.column(0), vocabulary)
            hit = np.flatnonzero(ids >= 0)
            each = np.unique(row[hit] * len(vocabulary) + ids[hit]) % len(vocabulary)
            n = np.append(np.bincount(each, minlength=len(vocabulary)), np.count_nonzero(np.diff(first)))
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], ["word", "n"])

    found = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n"))
    n = np.zeros(len(vocabulary) + 1, np.int64)
    for word, df in found.collect():  # a row for each word of the passages at most
        n[word] = df
    weights = weights_of(int(n[-1]), dict(zip(vocabulary.words, n[:-1].tolist(), strict=True)))
    return Index(vocabulary, np.array([weights[w] for w in vocabulary.words], np.int64), passages, phrases, least)


def scan(docs: DataFrame, index: Index, text_col: str = "text") -> DataFrame:
    """``docs`` without its texts but with n_words and hits: label, first word (from 0), length in words, share of the
    passage's weight, and whether it is one of the phrases. A passage that begins before its text does has a start below 0.

    Null and empty texts have no words and no hits, very long ones are scanned whole, repeated rows each; an empty table
    gives an empty one. Columns of ``docs`` named n_words or hits are left out.
    """
    keep = [c for c in docs.columns if c not in (text_col, "n_words", "hits")]
    rows = docs.select(*keep, F.col(text_col).cast("string").alias("_text"))
    held = docs.sparkSession.sparkContext.broadcast(index)  # the passages alone
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]], "n_words long", f"hits {HITS}"])
    kind = pa.struct([("label", pa.string()), ("start", pa.int64()), ("length", pa.int32()), ("share", pa.float64()), ("phrase", pa.bool_())])

    def run(batches):
        for batch in chunks(batches, "_text"):
            ids, row, first = _scanned(batch.column(len(keep)), held.value.vocabulary)
            found = held.value.hits(ids, row, first) if len(ids) else []
            hits: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for rows_of, label, start, length, share, phrase in found:
                for r, s, x in zip(rows_of.tolist(), start.tolist(), share.tolist(), strict=True):
                    hits[r].append({"label": label, "start": s, "length": length, "share": x, "phrase": phrase})
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.diff(first)), pa.array(hits, pa.list_(kind))], [*keep, "n_words", "hits"])

    return rows.mapInArrow(run, schema)
