"""Licence scans by a positional index of rare words.

Licence templates are indexed by word, each posting a template and a place in it.  Words are
weighed by their inverse document frequency, counted over all documents.  In each file the
licence words of the highest weight, those that make up most of a template, are looked up;
their postings are intersected by relative position, that is by the offset at which the
template would lie in the file.  Where they agree, the whole template is laid over the file,
the weight of its words found in their places is its share, and its mandatory key phrases
must stand there word by word.

The index is the fixed set of templates, so it travels with the job.  Base phrases are found
besides, wherever their words stand consecutively.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import joined_words, short_batches, word_hashes

# The phrases of the base and their labels.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

_WARRANTY = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY"
)
_GNU = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0}General Public License as published by the Free Software Foundation, "
    "either version {1} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; "
    "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
)
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
_BSD_TWO = (
    _BSD + ": Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution."
)
_NAMES = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."

# Fixed values: (label, template, mandatory key phrases).
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, "
     "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software. " + _WARRANTY, ("hereby granted free of charge",)),
    ("mit", "Released under the MIT License.", ("mit license",)),
    ("mit", "Licensed under the MIT License.", ("mit license",)),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
     ("with or without fee",)),
    ("bsd-2-clause", _BSD_TWO, ("source and binary forms",)),
    ("bsd-3-clause", _BSD_TWO + " " + _NAMES, ("source and binary forms", "endorse or promote products")),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
     "http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
     "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.", ("apache license version 2 0",)),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0.", ("apache license version 2 0",)),
    ("gpl-2.0", _GNU.format("", 2), ("gnu general public license", "version 2")),
    ("gpl-3.0", _GNU.format("", 3), ("gnu general public license", "version 3")),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2.", ("gnu general public license version 2",)),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3.", ("gnu general public license version 3",)),
    ("lgpl-3.0", _GNU.format("Lesser ", 3), ("gnu lesser general public license", "version 3")),
    ("agpl-3.0", _GNU.format("Affero ", 3), ("gnu affero general public license", "version 3")),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
     ("mozilla public license v 2 0",)),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, "
     "either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.", ("unencumbered software",)),
    ("cc-by-4.0", "Licensed under CC BY 4.0.", ("cc by 4 0",)),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0.", ("cc by sa 4 0",)),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0.", ("cc by nc 4 0",)),
    ("cc-by-nd-4.0", "Licensed under CC BY-ND 4.0.", ("cc by nd 4 0",)),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License.", ("creative commons attribution 4 0",)),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", ("creative commons attribution sharealike 4 0",)),
)

MATCH = "struct<label:string,start:bigint,end:bigint,share:double>"


def license_words(text: str) -> list[str]:
    """Words as the scan takes them: A-Z lower-cased, runs of digits, a-z and letters beyond ASCII."""
    raw = text.encode().lower()
    return "".join(chr(b) if b >= 128 or 48 <= b < 58 or 97 <= b < 123 else " " for b in raw).encode("latin-1").decode().split(" ") if raw else []


class Index:
    """Numbers of the templates' words, and by document frequency their weights and probes."""

    def __init__(self, templates=TEMPLATES, base=BASE):
        self.labels = [t[0] for t in templates]
        number: dict[str, int] = {}

        def ids(text):
            return np.array([number.setdefault(w, len(number)) for w in license_words(text) if w], np.int64)

        self.words = [ids(t[1]) for t in templates]
        self.keys = [[ids(k) for k in t[2]] for t in templates]
        self.base = [(ids(p), label) for p, label in base]
        self.vocabulary = list(number)
        h = np.concatenate([word_hashes(w.encode()) for w in self.vocabulary])
        self.order = np.argsort(h)
        self.hashes = h[self.order]
        self.seen = np.zeros(1 << 16, bool)
        self.seen[(h >> np.uint64(48)).astype(np.int64)] = True

    def numbers(self, h: np.ndarray) -> np.ndarray:
        """The number of each word by its hash, -1 for words of no template."""
        out = np.full(len(h), -1, np.int64)
        maybe = np.flatnonzero(self.seen[(h >> np.uint64(48)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.hashes, h[maybe]), len(self.hashes) - 1)
        same = self.hashes[at] == h[maybe]
        out[maybe[same]] = self.order[at[same]]
        return out

    def weigh(self, frequency: np.ndarray, documents: int, probe: float = 0.6):
        """Weights, and of each template the rarest words that make up `probe` of its weight."""
        self.idf = np.log(1 + documents / (1.0 + frequency))
        self.total = [float(self.idf[w].sum()) for w in self.words]
        self.probes, self.is_probe = [], np.zeros(len(self.vocabulary) + 1, bool)
        for w, total in zip(self.words, self.total, strict=True):
            chosen, held = set(), 0.0
            for v in sorted(set(w.tolist()), key=lambda v: (-self.idf[v], v)):
                chosen.add(v)
                held += self.idf[v] * int((w == v).sum())
                if held >= probe * total:
                    break
            self.probes.append((probe, chosen))
            self.is_probe[list(chosen)] = True
        return self

    def matches(self, words: np.ndarray, least: float, slack: int) -> list[tuple[str, int, int, float]]:
        """(label, start, end, share) of the templates that lie in a file of these word numbers."""
        places = np.flatnonzero(words >= 0)
        order = np.argsort(words[places], kind="stable")
        places, held = places[order], words[places][order]
        edge = np.searchsorted(held, np.arange(len(self.vocabulary) + 1))
        out = []
        for t, w in enumerate(self.words):
            share, chosen = self.probes[t]
            offsets, posts = [], []
            for j in np.flatnonzero(np.isin(w, list(chosen))).tolist():
                mine = places[edge[w[j]] : edge[w[j] + 1]]
                offsets.append(mine - j)
                posts.append(np.full(len(mine), j))
            offset, post = np.concatenate(offsets), np.concatenate(posts)
            if not len(offset):
                continue
            # A template that lies at some offset has its words within slack of it: in two neighbouring buckets.
            need, bucket = (least + share - 1) * self.total[t], offset // (2 * slack + 1)
            pair = np.unique(np.stack([np.concatenate([bucket, bucket - 1]), np.concatenate([post, post])]), axis=1)
            first = np.flatnonzero(np.diff(pair[0], prepend=pair[0][0] - 1))
            vote = np.add.reduceat(self.idf[w[pair[1]]], first)
            good = pair[0][first[vote >= need - 1e-9]]
            near, exact = np.unique(offset, return_counts=True)
            at_bucket = near // (2 * slack + 1)
            open_ = np.isin(at_bucket, good) | np.isin(at_bucket - 1, good)
            near, exact = near[open_], exact[open_]
            found = self._shares(w, places, edge, near, slack) / self.total[t]
            # The best offsets first; a template lies nowhere twice.
            taken: dict[int, int] = {}
            for i in np.lexsort((near, -exact, -found)).tolist():
                o, cell = int(near[i]), int(near[i]) // len(w)
                if found[i] < least:
                    break
                if all(abs(taken.get(c, o + len(w)) - o) >= len(w) for c in (cell - 1, cell, cell + 1)) and self._has_keys(words, t, o, slack):
                    taken[cell] = o
                    out.append((self.labels[t], max(0, o), min(len(words), o + len(w)), float(found[i])))
        return sorted(out, key=lambda m: (m[1], m[0], m[2]))

    def _shares(self, w, places, edge, offsets, slack) -> np.ndarray:
        """The weight of a template's words that stand within slack of their place, at each offset."""
        total = np.zeros(len(offsets))
        for j, v in enumerate(w.tolist()):
            mine = places[edge[v] : edge[v + 1]]
            if len(mine):
                at = np.searchsorted(mine, offsets + (j - slack))
                total += self.idf[v] * ((at < len(mine)) & (mine[np.minimum(at, len(mine) - 1)] <= offsets + (j + slack)))
        return total

    def _has_keys(self, words, t, offset, slack) -> bool:
        part = words[max(0, offset - slack) : offset + len(self.words[t]) + slack]
        return all(len(consecutive(part, key)) for key in self.keys[t])


def consecutive(words: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    """Places in words where the phrase starts."""
    at = np.flatnonzero(words[: max(0, len(words) - len(phrase) + 1)] == phrase[0])
    for i, v in enumerate(phrase[1:].tolist(), 1):
        at = at[words[at + i] == v]
    return at


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, base=BASE, least: float = 0.8, slack: int = 4) -> DataFrame:
    """The licences that each document names or quotes, one row a row of docs.

    Adds to id_col: n_words, n_base (places of base phrases), first_word and last_word (their
    least and greatest start, else null), base_labels, labels (of base phrases and templates,
    distinct, sorted, joined by commas), score (the greatest share of a template found, at
    least 0.5 with a base phrase, 0 without any label) and matches (label, start, end, share).

    A template is found where words of `least` of its weight, each within `slack` words of
    its place, and all its key phrases are.  Weights are counted over all of docs, a row once;
    only counts of the templates' words come to the driver.  Words are compared by 64-bit
    hashes.  Null and empty texts have no words and no labels; null and repeated ids are rows
    of their own; whole texts are scanned, in time in proportion to their length; other
    columns are not read.  No rows: empty.
    """
    if not 0 < least <= 1 or slack < 0 or not templates:
        raise ValueError("least must be in (0, 1], slack 0 or more, and templates given")
    short_batches(docs.sparkSession)
    index = Index(templates, base)
    probe = max(0.6, 1.01 - least)
    size = len(index.vocabulary)

    def numbered(column):
        h, doc = joined_words(column.to_pylist(), letters=True, lower=True)
        return index.numbers(h), doc

    def counted(batches):
        total, rows = np.zeros(size, np.int64), 0
        for batch in batches:
            words, doc = numbered(batch.column(0))
            known = words >= 0
            total += np.bincount(np.unique(doc[known] * size + words[known]) % size, minlength=size)
            rows += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([*range(size), -1], pa.int32()), pa.array([*total.tolist(), rows], pa.int64())], names=["word", "n"])

    text = docs.select(F.col(text_col).cast("string").alias("text"))
    frequency = {r["word"]: r["n"] for r in text.mapInArrow(counted, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    index.weigh(np.array([frequency.get(i, 0) for i in range(size)], np.float64), frequency.get(-1, 0), probe)

    def scan(batches):
        for batch in batches:
            words, doc = numbered(batch.column(1))
            edge = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            places, labels = defaultdict(list), defaultdict(set)
            for phrase, label in index.base:
                at = consecutive(words, phrase)
                at = at[doc[at] == doc[at + len(phrase) - 1]]
                for d, p in zip(doc[at].tolist(), (at - edge[doc[at]]).tolist(), strict=True):
                    places[d].append(p)
                    labels[d].add(label)
            found = {d: index.matches(words[edge[d] : edge[d + 1]], least, slack) for d in np.unique(doc[index.is_probe[words]]).tolist()}
            out = defaultdict(list)
            for d in range(batch.num_rows):
                hits, at = found.get(d, []), places.get(d, [])
                own = labels[d] if d in labels else set()
                score = max([h[3] for h in hits], default=0.0)
                out["n_base"].append(len(at))
                out["first_word"].append(min(at, default=None))
                out["last_word"].append(max(at, default=None))
                out["base_labels"].append(",".join(sorted(own)))
                out["labels"].append(",".join(sorted(own | {h[0] for h in hits})))
                out["score"].append(min(1.0, max(score, 0.5 if at else 0.0)))
                out["matches"].append([dict(zip(("label", "start", "end", "share"), h, strict=True)) for h in hits])
            match = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("share", pa.float64())]))
            kinds = {"n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(), "matches": match}
            columns = [pa.array(out[n], k) for n, k in kinds.items()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(edge), pa.int64()), *columns], names=["id", "n_words", *kinds])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches array<{MATCH}>"
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(scan, schema).withColumnRenamed("id", id_col)
