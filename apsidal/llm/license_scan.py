"""License scan: MinHash bands over overlapping windows retrieve templates, exact containment verifies.

Words are runs of ASCII letters and digits, lower case. For each template length the words of a text are
covered by windows of ``length + stride`` words that start every ``stride`` words, so any passage of the
template's length lies in one window whole. A window and a template that share a MinHash band are a
candidate; the share of the template's five-word shingles that the window contains is then counted
exactly, and 0.8 or more is a match.

Band settings: with L shingles, a window that holds at least 0.8 of a template has a Jaccard similarity
of at least 0.8 * L / (L + stride + 0.2 * L). The stride is a quarter of the words, so for long templates
that is 0.55 and at 32 bands of two rows the chance of no collision is (1 - 0.55 ** 2) ** 32 < 1e-5; for
wordings of five to nine words it is 0.5 and the chance is about 1e-4.

A band of a window and a template can only agree if the window holds a shingle in which a template's
row has its minimum. Windows without one are passed over before hashing them, which loses no collision.

Scale: a narrow map over whole texts, no shuffle; the templates are constants.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORDS = re.compile(r"[a-z0-9]+")
SHINGLE_WORDS, CONTAINMENT = 5, 0.8
BANDS, ROWS = 32, 2
#: Notices of well-known public licenses, name to wordings.
TEMPLATES = {
    "MIT": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "CC-BY-NC-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "GPL-2.0": ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",),
    "LGPL-2.1": ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",),
    "AGPL-3.0": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",),
    "Unlicense": ("This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",),
    "CC0-1.0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",),
    "CC-BY-SA-4.0": ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",),
    "Zlib": ("This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",),
    "BSL-1.0": ("Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",),
    "EPL-2.0": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at",),
    "CC-BY-4.0": ("This work is licensed under a Creative Commons Attribution 4.0 International License.",),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",),
}
MATCH_SCHEMA = "doc_id long, matches array<struct<license: string, start: long, end: long, containment: double>>"


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(words: list[str], known: dict[str, int]) -> np.ndarray:
    """Hash of every run of five words; a shorter text is one run."""
    import xxhash

    ids = np.empty(len(words), np.uint64)
    for i, w in enumerate(words):
        h = known.get(w)
        if h is None:
            if len(known) > 500_000:
                known.clear()
            h = known[w] = xxhash.xxh64_intdigest(w)
        ids[i] = h
    k = min(SHINGLE_WORDS, len(words))
    if not k:
        return np.zeros(0, np.uint64)
    n = len(words) - k + 1
    out = np.full(n, k, np.uint64)
    for j in range(k):
        out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + ids[j : j + n])
    return out


SEEDS = _mixed(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def bands(shingles: np.ndarray) -> np.ndarray:
    """The minima of a set of shingles as BANDS x ROWS."""
    return _mixed(shingles[None, :] ^ SEEDS[:, None]).min(1).reshape(BANDS, ROWS)


class Templates:
    def __init__(self, templates: dict[str, tuple[str, ...]]) -> None:
        self.items, minima = [], []
        for name, wordings in templates.items():
            for text in wordings:
                w = WORDS.findall(text.lower())
                s = np.unique(shingle_hashes(w, {}))
                values = _mixed(s[None, :] ^ SEEDS[:, None])
                minima.append(s[values.argmin(1)])
                self.items.append((name, len(w), s, bands(s)))
        self.minima = np.unique(np.concatenate(minima))

    def find(self, shingles: np.ndarray, n_words: int) -> list[tuple[str, int, int, float]]:
        """(license, first word, word after the last, containment) of verified windows, the best per passage."""
        at = np.searchsorted(self.minima, shingles)
        at[at == len(self.minima)] = 0
        hits = np.flatnonzero(self.minima[at] == shingles)
        found: list[tuple[str, int, int, float]] = []
        if not len(hits):
            return found
        for name, length, own, sig in self.items:
            stride = max(1, length // 4)
            width = length + stride
            span = max(1, width - SHINGLE_WORDS + 1)  # shingles of a window
            first = np.maximum(0, (hits - span + stride) // stride)
            starts = np.unique(np.concatenate([np.minimum(first + i, hits // stride) for i in range(-(-span // stride) + 1)]))
            for start in (starts * stride).tolist():
                window = shingles[start : start + span]
                if not len(window) or not (bands(window) == sig).all(1).any():
                    continue
                inside = np.flatnonzero(np.isin(window, own))
                share = len(np.unique(window[inside])) / len(own)
                if share >= CONTAINMENT:
                    found.append((name, start + int(inside[0]), min(n_words, start + int(inside[-1]) + SHINGLE_WORDS), share))
        out: list[tuple[str, int, int, float]] = []
        for x in sorted(found, key=lambda x: (x[0], x[1], -x[2])):
            if out and out[-1][0] == x[0] and x[1] < out[-1][2]:
                out[-1] = (x[0], out[-1][1], max(out[-1][2], x[2]), max(out[-1][3], x[3]))
            else:
                out.append(x)
        return sorted(out, key=lambda x: (x[1], x[2], x[0]))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """doc_id, matches (license, start, end in code points, containment): one row per document.

    Null and empty texts have no matches; texts shorter than five words are one shingle. Overlapping
    matches of one license count as one passage. Repeated rows, null ids and extra columns need no care.
    """
    wanted = templates or TEMPLATES
    kind = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("containment", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book, known = Templates(wanted), {}
        for b in batches:
            rows = []
            for t in b.column(1):
                text = t.as_py() or ""
                low = text.translate(LOWER)
                words = WORDS.findall(low)
                got = book.find(shingle_hashes(words, known), len(words)) if words else []
                places = [m.span() for m in WORDS.finditer(low)] if got else []
                rows.append([{"license": n, "start": places[a][0], "end": places[z - 1][1], "containment": s} for n, a, z, s in got])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, kind)], names=["doc_id", "matches"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, MATCH_SCHEMA)


#: Lowers A-Z only, so places in a text stay.
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def license_report(found: DataFrame) -> DataFrame:
    """doc_id, n_matches, licenses and spans as text."""
    span = lambda m: F.concat_ws(":", m["license"], m["start"].cast("string"), m["end"].cast("string"))
    names = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["license"])))
    return found.select("doc_id", F.size("matches").cast("long").alias("n_matches"), F.concat_ws(",", names).alias("licenses"), F.concat_ws(",", F.transform("matches", span)).alias("spans"))
