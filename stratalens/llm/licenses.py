"""License scans: winnowed fingerprints nominate, banded alignment decides.

Words are runs of letters and digits (and anything beyond ASCII), A-Z in lower case. A
template's fingerprints are the least hashes of ``K`` words in each window of ``WINDOW``
successive ones, kept in an inverted index; a run of K + WINDOW - 1 words that text and
template share has a fingerprint in common. Four fifths of a template of more than ``SHORT``
words hold such a run, if words are changed or left out; of shorter ones all pairs of
neighbouring words are fingerprints, of which four fifths hold one. (Words put in every few
places can hide a notice from either.) Each place nominated is aligned with its
template inside a band around the diagonal of its fingerprints (``BAND`` words, a tenth of
the template if that is more): matched words over the template's words are the coverage.

Templates are one-line notices, standard headers and whole licence texts. A text of more
than ``LONG`` words is cut at its headings into sections, each found on its own;
successive sections found one behind the other are one find again.
"""

from __future__ import annotations

import itertools
import pkgutil
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, small_batches, texts
from .decontaminate import words_of

K, WINDOW, BAND, SHORT = 3, 2, 8, 15
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

# Customary notices of well-known licences, and opening sentences of some.
TEMPLATES: list[tuple[str, str]] = [
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]

# The headers that licences ask to be put in each file.
_GPL = "This {p} is free software: you can redistribute it and/or modify it under the terms of the GNU {n} as published by the Free Software Foundation, either version {v} of the License, or (at your option) any later version. This {p} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {n} for more details. You should have received a copy of the GNU {n} along with this {p}."
_CC = "This work is licensed under the Creative Commons {n} 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/{u}/4.0/ or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA."
HEADERS: list[tuple[str, str]] = [
    ("GPL-2.0", _GPL.format(p="program", n="General Public License", v="2")),
    ("GPL-3.0", _GPL.format(p="program", n="General Public License", v="3")),
    ("LGPL-2.1", _GPL.format(p="library", n="Lesser General Public License", v="2.1")),
    ("LGPL-3.0", _GPL.format(p="library", n="Lesser General Public License", v="3")),
    ("AGPL-3.0", _GPL.format(p="program", n="Affero General Public License", v="3")),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("CC-BY-4.0", _CC.format(n="Attribution", u="by")),
    ("CC-BY-NC-4.0", _CC.format(n="Attribution-NonCommercial", u="by-nc")),
    ("CC-BY-ND-4.0", _CC.format(n="Attribution-NoDerivatives", u="by-nd")),
    ("CC-BY-SA-4.0", _CC.format(n="Attribution-ShareAlike", u="by-sa")),
]
# What AGPL shares with GPL stands behind GPL: a section by itself is GPL's.
TEXTS = ["Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC0-1.0", "GPL-2.0", "GPL-3.0", "AGPL-3.0", "ISC", "LGPL-2.1", "LGPL-3.0", "MIT", "MPL-2.0", "Unlicense"]
LONG, SHORTEST, FULL = 400, 30, 100
_HEADING = re.compile(r"\s*([0-9]+\.|TERMS AND|END OF|APPENDIX|Preamble|How to Apply)")


def sections(text: str) -> list[str]:
    """``text``, or its sections of ``FULL`` words or up to a heading, never less than ``SHORTEST``."""
    if len(words_of(text)) <= LONG:
        return [text]
    out: list[list[str]] = [[]]
    size = 0
    for p in re.split(r"\n[ \t]*\n", text):
        if size >= FULL or (size >= SHORTEST and _HEADING.match(p)):
            out.append([])
            size = 0
        out[-1].append(p)
        size += len(words_of(p))
    if len(out) > 1 and size < SHORTEST:
        last = out.pop()
        out[-1] += last
    return ["\n\n".join(s) for s in out]


def full_texts() -> list[tuple[str, list[str]]]:
    """(licence, sections) of each text in ``license_texts``; read on the driver, the index travels."""
    return [(n, sections(pkgutil.get_data(__package__, f"license_texts/{n}.txt").decode())) for n in TEXTS]


def _grams(ids: np.ndarray, k: int = K) -> np.ndarray:
    h = np.full(max(0, len(ids) - k + 1), k, np.uint64)
    for j in range(k):
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + ids[j : j + len(h)].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    return h ^ (h >> np.uint64(32))


def winnow(h: np.ndarray) -> np.ndarray:
    """Places of the least hash of each window, the last one on ties."""
    if len(h) < WINDOW:
        return np.zeros(0, np.int64)
    w = np.lib.stride_tricks.sliding_window_view(h, WINDOW)
    return np.unique(np.arange(len(w)) + WINDOW - 1 - w[:, ::-1].argmin(1))


class Index:
    """Templates as word ids, and the inverted index of their fingerprints.

    ``long`` are texts in sections; ``part`` tells a section's text and its place there.
    """

    def __init__(self, templates: list[tuple[str, str]], long: list[tuple[str, list[str]]] | None = None):
        self.vocabulary: dict[bytes, int] = {}
        self.names, self.words = [], []
        self.part: list[tuple[int, int]] = []
        post: list[tuple[int, int, int]] = []
        every = [(n, t, (-1, 0)) for n, t in templates] + [(n, t, (k, j)) for k, (n, parts) in enumerate(long or []) for j, t in enumerate(parts)]
        for t, (name, text, part) in enumerate(every):
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)], np.int64)
            self.names.append(name)
            self.words.append(ids)
            self.part.append(part)
            h = _grams(ids) if len(ids) > SHORT else _grams(ids, 2)
            post += [(int(h[p]), t, int(p)) for p in (winnow(h) if len(ids) > SHORT else range(len(h)))]
        post.sort()
        self.keys = np.array([k for k, _, _ in post], np.uint64)
        self.template = np.array([t for _, t, _ in post], np.int64)
        self.place = np.array([p for _, _, p in post], np.int64)
        self.own = [np.unique(w, return_counts=True) for w in self.words]

    def band(self, t: int) -> int:
        return max(BAND, len(self.words[t]) // 10)

    def at_most(self, t: int, ids: np.ndarray, begin: int) -> int:
        """No alignment in the band matches more words: those that template and text have in common there."""
        band, (own, times) = self.band(t), self.own[t]
        there = np.bincount(ids[max(0, begin - band) : max(0, begin + len(self.words[t]) + band)], minlength=len(self.vocabulary) + 1)
        return int(np.minimum(there[own], times).sum())

    def nominate(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """(template, place in the text where it would begin), one for each diagonal band."""
        pairs = np.flatnonzero((ids[:-1] != 0) & (ids[1:] != 0))  # windows that hold another word share nothing
        if not len(pairs):
            return []
        at, h = pairs, _grams(ids, 2)[pairs]
        grams = _grams(ids)
        if len(grams) >= WINDOW:
            starts = np.flatnonzero(np.lib.stride_tricks.sliding_window_view(ids != 0, K + WINDOW - 1).all(1))
            w = np.lib.stride_tricks.sliding_window_view(grams, WINDOW)[starts]
            own = np.unique(starts + WINDOW - 1 - w[:, ::-1].argmin(1))
            at, h = np.r_[at, own], np.r_[h, grams[own]]
        lo, hi = np.searchsorted(self.keys, h, "left"), np.searchsorted(self.keys, h, "right")
        hit = np.flatnonzero(hi > lo)
        out: set[tuple[int, int]] = set()
        for p, a, b in zip(at[hit].tolist(), lo[hit].tolist(), hi[hit].tolist(), strict=True):
            for t, place in zip(self.template[a:b].tolist(), self.place[a:b].tolist(), strict=True):
                begin = p - place
                if not any((t, begin + d) in out for d in range(-BAND // 2, BAND // 2 + 1)):
                    out.add((t, begin))
        return sorted(out)


def align(template: np.ndarray, text: np.ndarray, begin: int, band: int = BAND) -> tuple[int, int, int]:
    """(matched words, first, end) of the best local alignment within ``band`` of the diagonal.

    A match counts 2, a different or a missing word -1 each.
    """
    m, n = len(template), len(text)
    best = (0, 0, 0, 0)  # score, matched, first, end
    above: dict[int, tuple[int, int, int]] = {}
    for i in range(m):
        row: dict[int, tuple[int, int, int]] = {}
        for j in range(max(0, begin + i - band), min(n, begin + i + band + 1)):
            same = template[i] == text[j]
            s, k, f = above.get(j - 1, (0, 0, j))
            cell = (s + 2, k + 1, f) if same else (s - 1, k, f)
            for other in (above.get(j), row.get(j - 1)):
                if other is not None and other[0] - 1 > cell[0]:
                    cell = (other[0] - 1, other[1], other[2])
            if cell[0] <= 0:
                cell = (0, 0, j + 1)
            row[j] = cell
            if cell[0] > best[0]:
                best = (cell[0], cell[1], cell[2], j + 1)
        above = row
    return best[1], best[2], best[3]


def scan(index: Index, text: str, coverage: float) -> list[tuple[str, float, int, int]]:
    """(licence, coverage, start, end) in code points.

    Of overlapping finds of one licence the one with most matched words stays; of several
    licences the best covered, then the one with most matched words, then the licence
    with most of them in ``text`` (licences share sections).
    """
    words = words_of(text)
    get = index.vocabulary.get
    ids = np.fromiter(map(get, words, itertools.repeat(0)), np.int64, len(words))
    found = set()
    for t, begin in index.nominate(ids):
        w = index.words[t]
        if index.at_most(t, ids, begin) < coverage * len(w):
            continue
        matched, first, end = align(w, ids, begin, index.band(t))
        if matched >= coverage * len(w):
            found.add((matched, t, first, end))
    if not found:
        return []
    total: Counter[str] = Counter()
    for matched, t, _, _ in found:
        total[index.names[t]] += matched
    apart = lambda f, kept: all(f[3] <= a or b <= f[2] for _, _, a, b in kept)
    own: dict[str, list[tuple[int, int, int, int]]] = {}
    for f in sorted(found, key=lambda f: (-f[0], len(index.words[f[1]]), f[1:])):
        if apart(f, mine := own.setdefault(index.names[f[1]], [])):
            mine.append(f)
    kept: list[tuple[int, int, int, int]] = []
    for f in sorted(itertools.chain(*own.values()), key=lambda f: (-f[0] / len(index.words[f[1]]), -f[0], -total[index.names[f[1]]], f[1:])):
        if apart(f, kept):
            kept.append(f)
    runs: list[list[int]] = []  # template found last, matched words, words, first, end
    for matched, t, first, end in sorted(kept, key=lambda f: f[2]):
        (k, j), n = index.part[t], len(index.words[t])
        if runs and k >= 0 and index.part[runs[-1][0]] == (k, j - 1) and first - runs[-1][4] <= SHORTEST:
            last = runs[-1]
            runs[-1] = [t, last[1] + matched, last[2] + n, last[3], end]
        else:
            runs.append([t, matched, n, first, end])
    spans = [m.span() for m in _WORD.finditer(text)]
    return [(index.names[t], m / n, spans[first][0], spans[end - 1][1]) for t, m, n, first, end in runs]


def license_scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, coverage: float = 0.8) -> DataFrame:
    """doc_id, n_licenses, licenses (names, sorted), spans (``name:start:end:coverage``, coverage in percent): one row per row.

    Null or empty text has none; rows with one doc_id are scanned each on its own; other
    columns are ignored. No rows give none. One pass, nothing is shuffled.
    """
    small_batches(docs.sparkSession)
    index = Index(templates) if templates else Index([*TEMPLATES, *HEADERS], full_texts())

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [scan(index, t, coverage) for t in texts(b, "_text")]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(f) for f in found], pa.int64()), pa.array([sorted({n for n, *_ in f}) for f in found], pa.list_(pa.string())), pa.array([",".join(f"{n}:{s}:{e}:{int(100 * c)}" for n, c, s, e in f) for f in found], pa.string())],
                names=["doc_id", "n_licenses", "licenses", "spans"],
            )

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("_text"))
    return d.mapInArrow(lean(scanned), "doc_id long, n_licenses long, licenses array<string>, spans string")
