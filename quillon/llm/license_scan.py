"""License scans: winnowed template fingerprints pick candidates, banded alignment reports coverage and spans.

Templates are cut into GRAM-word shingles and winnowed: of each WINDOW neighbouring hashes the
least is kept, so any run of GRAM + WINDOW - 1 template words holds a kept one. An inverted index
from kept hashes to (template, place) is probed with every shingle of the whole texts. A template of
up to SHORT words is found by single words instead: what reaches the threshold lacks at most a few
of its words, so it has one of any few and one; the longest, which are rare, are taken. Hits of a
template on near diagonals are one candidate; the words around it are aligned with the template in
a band about the diagonal (match 16, mismatch and gap -1), carrying the number of matched words and
the place where the alignment began. Coverage is matched words / template words; what reaches
``threshold`` is reported, overlapping places of one template once.

The index depends on the templates alone (a parameter; at most MAX_TEMPLATE_WORDS words in all, so
what is broadcast is bounded). Texts are never shuffled.

Defined cases. Null, empty and wordless texts: no rows. Null doc_id: reported with null. Repeated
rows: reported each. Templates of fewer than GRAM words: rejected. Ties: of overlapping places of a
template the one that covers most is reported, then the first. Texts of any length are scanned whole.
An empty table gives an empty result. Other columns play no part.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import Words, clean_columns, grams, in_arrow, table, text_buffers, word_chunks

GRAM, WINDOW, THRESHOLD, MAX_TEMPLATE_WORDS = 3, 3, 0.8, 1_000_000
SHORT = 20
MATCH = 16

#: Usual short notices (public texts).
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        'You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, '
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
        "and/or other materials provided with the distribution."
    ),
    "BSD-disclaimer": (
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, '
        "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE "
        "LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS "
        "OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, "
        "OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "BSD-3-Clause": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
        "without specific prior written permission."
    ),
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "AGPL-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the "
        "Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "GPL-2.0-notice": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
        "Free Software Foundation; either version 2 of the License, or (at your option) any later version."
    ),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
        "Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        "copyright notice and this permission notice appear in all copies."
    ),
    "LGPL-2.1-notice": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the "
        "Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."
    ),
    "MIT": "Released under the MIT License.",
    "MIT-text": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "MIT-disclaimer": (
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
        "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}


def templates_in(folder: str) -> dict[str, str]:
    """Whole license texts, one file each, under the files' names; a file that is longer than a template may be is cut into parts of 5,000 words."""
    out = {}
    for path in sorted(Path(folder).iterdir()):
        text = path.read_text(encoding="utf-8", errors="replace").split() if path.is_file() else []
        parts = [text[i : i + 5000] for i in range(0, len(text), 5000)]
        for i, part in enumerate(parts):
            out[path.name if len(parts) == 1 else f"{path.name}#{i + 1}"] = " ".join(part)
    return {name: text for name, text in out.items() if len(words_of(text)) >= GRAM}


def words_of(text: str) -> np.ndarray:
    data, offsets = text_buffers(pa.array([text]))
    return Words(data, offsets).hash


def winnow(g: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Places of the kept hashes: the rightmost least one of each window."""
    n = max(1, len(g) - window + 1)
    kept = [i + len(part) - 1 - int(part[::-1].argmin()) for i in range(n) if len(part := g[i : i + window])]
    return np.unique(np.array(kept, np.int64))


def seed_words(text: str, threshold: float) -> np.ndarray:
    """Places of the longest words, one more than an alignment of this coverage may lack."""
    data, offsets = text_buffers(pa.array([text]))
    w = Words(data, offsets)
    n = len(w.hash)
    least = max(1, int(np.ceil(threshold * n - 1e-9)))
    return np.sort(np.argsort(w.start - w.end, kind="stable")[: max(1, n - least + 1)])


class Seeds:
    """Inverted index from the hash of ``size`` words to (template, place)."""

    def __init__(self, size: int, seeds: list[tuple[int, np.ndarray, np.ndarray]]):
        self.size = size
        h = np.concatenate([x for _, _, x in seeds]) if seeds else np.zeros(0, np.uint64)
        order = np.argsort(h, kind="stable")
        self.which = np.concatenate([np.full(len(at), i) for i, at, _ in seeds])[order] if seeds else np.zeros(0, np.int64)
        self.place = np.concatenate([at for _, at, _ in seeds])[order] if seeds else np.zeros(0, np.int64)
        self.unique, self.first = np.unique(h[order], return_index=True)
        self.many = np.diff(np.concatenate([self.first, [len(h)]]))
        self.bits = np.zeros(1 << 16, bool)
        self.bits[(self.unique >> np.uint64(48)).astype(np.int64)] = True

    def hits(self, w: Words, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, template, begin of the template in the text) of each seed found."""
        g = grams(w.hash, self.size) if self.size > 1 else w.hash
        at = np.flatnonzero(self.bits[(g >> np.uint64(48)).astype(np.int64)])
        at = at[of[at] == of[at + self.size - 1]]
        place = np.searchsorted(self.unique, g[at])
        place[place == len(self.unique)] = 0
        ok = self.unique[place] == g[at] if len(self.unique) else np.zeros(len(at), bool)
        at, place = at[ok], place[ok]
        reps = self.many[place]
        entry = np.repeat(self.first[place] - (np.cumsum(reps) - reps), reps) + np.arange(reps.sum())
        text = np.repeat(of[at], reps)
        return text, self.which[entry], np.repeat(at, reps) - w.first[text] - self.place[entry]


class Templates:
    """Words of the templates and the inverted indexes of their seeds."""

    def __init__(self, texts: dict[str, str], threshold: float = THRESHOLD):
        self.names = sorted(texts)
        self.words = [words_of(texts[n]) for n in self.names]
        self.length = np.array([len(w) for w in self.words], np.int64)
        if len(self.length) and self.length.min() < GRAM:
            raise ValueError(f"a template needs at least {GRAM} words")
        if len(self.length) and self.length.max() > 30_000:
            raise ValueError("a template may have 30,000 words")
        if self.length.sum() > MAX_TEMPLATE_WORDS:
            raise ValueError(f"templates may have {MAX_TEMPLATE_WORDS} words in all")
        single, shingles = [], []
        for i, w in enumerate(self.words):
            if len(w) <= SHORT:
                at = seed_words(texts[self.names[i]], threshold)
                single.append((i, at, w[at]))
            else:
                g = grams(w, GRAM)
                at = winnow(g)
                shingles.append((i, at, g[at]))
        self.seeds = [Seeds(1, single), Seeds(GRAM, shingles)]


def band_of(length: np.ndarray) -> np.ndarray:
    return np.maximum(4, length // 8)


def align(template: np.ndarray, texts: list[np.ndarray], start: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(matched words, begin, end) of the template in each text, the diagonal beginning at start +- band.

    A cell holds score << 44 | matched << 22 | (2**22 - 1 - begin), begin counted from start - band.
    """
    n, la, wide = len(texts), len(template), 2 * band + 1
    region = np.zeros((n, la + 2 * band), np.uint64)
    blank = mix_free(template)
    region[:] = blank
    for i, (t, s) in enumerate(zip(texts, start, strict=True)):
        lo, hi = s - band, s + la + band
        part = t[max(lo, 0) : max(hi, 0)]
        region[i, max(0, -lo) : max(0, -lo) + len(part)] = part
    score, one = np.int64(1) << np.int64(44), np.int64(1) << np.int64(22)
    offs = np.arange(wide, dtype=np.int64)
    slope = offs * score
    h = np.tile(one - 1 - offs, (n, 1))  # empty alignments that begin at each column
    best, end = h[:, 0].copy(), np.zeros(n, np.int64)
    for i in range(la):
        same = region[:, i : i + wide] == template[i]
        new = h + np.where(same, MATCH * score + one, -score)
        up = np.full_like(h, np.iinfo(np.int64).min // 2)
        up[:, :-1] = h[:, 1:] - score
        h = np.maximum(new, up)
        h = np.maximum.accumulate(h + slope, axis=1) - slope
        empty = one - 1 - (offs + i + 1)
        h = np.where(h < score, empty[None, :], h)
        top = h.argmax(axis=1)
        value = h[np.arange(n), top]
        better = value > best
        best, end = np.where(better, value, best), np.where(better, top + i + 1, end)
    low = best & (one - 1)
    shift = start - band
    return best >> 22 & one - 1, np.maximum(one - 1 - low + shift, 0), end + shift


def mix_free(template: np.ndarray) -> np.uint64:
    """A hash that no word of the template has, to fill what lies beyond a text."""
    x = np.uint64(0)
    while (template == x).any():
        x += np.uint64(1)
    return x


def scan(w: Words, index: Templates, threshold: float = THRESHOLD):
    """Rows (text, template, coverage, first word, end word)."""
    of = w.of()
    text, which, begin = (np.concatenate(x) for x in zip(*(seeds.hits(w, of) for seeds in index.seeds), strict=True))
    if not len(text):
        return []
    half = band_of(index.length[which])
    candidates = np.unique(np.stack([text, which, begin // half], 1), axis=0)
    out = []
    for t in np.unique(candidates[:, 1]):
        mine = candidates[candidates[:, 1] == t]
        half = int(band_of(index.length[t : t + 1])[0])
        for part in np.array_split(mine, max(1, len(mine) // 512)):
            starts = part[:, 2] * half + half // 2
            texts = [w.hash[w.first[i] : w.first[i + 1]] for i in part[:, 0]]
            matched, first, end = align(index.words[t], texts, starts, 2 * half)
            coverage = matched / index.length[t]
            for j in np.flatnonzero(coverage >= threshold):
                out.append((int(part[j, 0]), int(t), float(coverage[j]), int(first[j]), int(end[j])))
    out.sort(key=lambda r: (r[0], r[1], -r[2], r[3]))
    kept: list[tuple] = []
    mine: list[tuple[int, int]] = []  # places of one text and template, in order
    for r in out:
        if not kept or kept[-1][:2] != r[:2]:
            mine = []
        i = bisect_left(mine, (r[3], r[4]))
        if not (i and mine[i - 1][1] > r[3]) and not (i < len(mine) and mine[i][0] < r[4]):
            mine.insert(i, (r[3], r[4]))
            kept.append(r)
    return kept


def find(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, license, coverage, first_word, end_word), words counted from 0."""
    shared = docs.sparkSession.sparkContext.broadcast(Templates(TEMPLATES if templates is None else templates, threshold))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            for at, to, w in word_chunks(batch.column(1)):
                rows = scan(w, index, threshold)
                cols = list(zip(*rows, strict=True)) if rows else [()] * 5
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, to - at).take(pa.array(cols[0], pa.int64())), pa.array([index.names[t] for t in cols[1]], pa.string()), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int64())],
                    names=["doc_id", "license", "coverage", "first_word", "end_word"],
                )

    slim = clean_columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return slim.transform(in_arrow, search, "doc_id long, license string, coverage double, first_word long, end_word long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"))
