"""License scans: MinHash bands over overlapping windows retrieve templates, exact containment verifies them.

A text's words are folded (ASCII letters lower-case, ASCII punctuation a space) and
shingled by five; a template of fewer words is one shingle. Windows hold one and a
half times a template's shingles and begin at each half of it, so that any stretch as
long as the template lies within one. If a window holds 0.8 of a template's shingles,
their resemblance is at least 0.8 / (1.5 + 0.2 + rounding), over 0.36 for the shortest
and 0.47 for long ones; with BANDS bands of ROWS rows it is retrieved with probability
over 1 - (1 - 0.36 ** ROWS) ** BANDS, which is beyond 0.9999.

If no window holds all of a template, containment is verified over two template
lengths either side of each retrieved window too: a template with up to a length of
text inserted is verified whole, if any window that overlaps it is retrieved. Windows
of a part of a template are retrieved with a lesser probability than the above. The
stretch given, where that holds more, is from the first to the last of the template's shingles in it.

A band matches only if a window's minima are the template's, so only windows that hold
one of the templates' minima can be retrieved: others are passed over by one lookup of
each shingle, which leaves the retrieved set as it is.

Cases. Null or empty text: no match. Several windows match a template: the best, then
the first, is returned, and their number. Repeated rows: the matches of each. Empty
table: no rows. Null ids are kept. Further columns of any name are not looked at.
"""

from __future__ import annotations

import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, packed, text_batches

WORDS = 5
LEAST = 0.8
BANDS, ROWS = 72, 2
BATCH_BYTES = 4 << 20
#: Templates are shipped whole: at most this many bytes of them.
MAX_TEMPLATE_BYTES = 4 << 20
#: Short notices and the opening terms of common public licences.
TEMPLATES = (
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("mit", "Released under the MIT License."),
    ("all-rights-reserved", "All rights reserved."),
    ("mit-text", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'),
    ("apache-2.0-text", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("gpl-3.0-text", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("bsd-text", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("cc-by-4.0-text", "This work is licensed under the Creative Commons Attribution 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/ or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA."),
)

_fold = bytes.maketrans((string.ascii_uppercase + string.punctuation).encode(), (string.ascii_lowercase + " " * len(string.punctuation)).encode())


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_fold).split()


def shingle_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Of each run of so many words, from the words' hashes."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(width):
        out = (out ^ hashes[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


class Templates:
    """Shingles, minima and bands of the templates."""

    def __init__(self, templates: tuple[tuple[str, str], ...], words: int = WORDS, bands: int = BANDS, rows: int = ROWS):
        rng = np.random.default_rng(11)
        self.mul = rng.integers(1, 1 << 63, bands * rows, np.uint64) * np.uint64(2) + np.uint64(1)
        self.add = rng.integers(0, 1 << 63, bands * rows, np.uint64)
        self.bands, self.rows = bands, rows
        self.of_width: dict[int, list[tuple]] = {}
        for name, text in templates:
            tokens = words_of(text)
            if tokens:
                width = min(words, len(tokens))
                hashes = shingle_hashes(word_hashes(tokens), width)
                sets = {tuple(tokens[i : i + width]) for i in range(len(tokens) - width + 1)}
                mixed = self.mixed(hashes)
                n = len(hashes)
                self.of_width.setdefault(width, []).append((name, sets, self.banded(mixed.min(1)), n + -(-n // 2), max(1, n // 2), np.unique(hashes[mixed.argmin(1)]), n))
        self.minima = {w: np.unique(np.concatenate([t[5] for t in own])) for w, own in self.of_width.items()}

    def mixed(self, hashes: np.ndarray) -> np.ndarray:
        x = hashes[None, :] * self.mul[:, None] + self.add[:, None]
        return (x ^ (x >> np.uint64(31))) * self.mul[::-1, None]

    def banded(self, signature: np.ndarray) -> np.ndarray:
        return signature.reshape(self.bands, self.rows)

    def matches(self, tokens: list[bytes], hashes: np.ndarray, hit: np.ndarray, width: int, least: float):
        """(name, containment, first word, words, windows) of each template in a text; hit: places of minima among its shingles."""
        for name, own, bands, size, step, _, n in self.of_width[width]:
            # A window begins at each step; a shorter text is one window.
            last = max(0, -(-(len(hashes) - size) // step))
            low = np.maximum(0, -(-(hit - size + 1) // step))
            starts = {w for a, b in zip(low.tolist(), np.minimum(last, hit // step).tolist(), strict=True) for w in range(a, b + 1)}
            best, wider, windows, near = None, None, 0, []
            for w in sorted(starts):
                a = w * step
                window = hashes[a : a + size]
                if not len(window) or not (self.banded(self.mixed(window).min(1)) == bands).all(1).any():
                    continue
                there = {tuple(tokens[i : i + width]) for i in range(a, a + len(window))}
                share = len(own & there) / len(own)
                if share >= least:
                    windows += 1
                    if best is None or share > best[0]:
                        best = share, a, len(window) + width - 1
                near.append((max(0, a - 2 * n), a + size + 2 * n, share >= least))
            # No window holds all: text may be inserted, so two lengths either side of those retrieved are looked at.
            for a, b, counted in near if best is None or best[0] < 1 else ():
                at = [i for i in range(a, min(b, len(hashes))) if tuple(tokens[i : i + width]) in own]
                share = len({tuple(tokens[i : i + width]) for i in at}) / len(own)
                if share >= least:
                    windows += not counted
                    if wider is None or share > wider[0]:
                        wider = share, at[0], at[-1] - at[0] + width
            if wider and (best is None or wider[0] > best[0]):
                best = wider
            if best:
                yield name, *best, windows


def word_hashes(tokens: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh64_intdigest, tokens), np.uint64, len(tokens))


_loaded: dict[tuple, Templates] = {}


def prepared(templates: tuple[tuple[str, str], ...]) -> Templates:
    if templates not in _loaded:
        _loaded[templates] = Templates(templates)
    return _loaded[templates]


def scan(text: str | None, tool: Templates, least: float = LEAST) -> list[tuple]:
    tokens = words_of(text)
    hashes = word_hashes(tokens)
    found = []
    for width, minima in tool.minima.items():
        shingles = shingle_hashes(hashes, width)
        at = np.minimum(np.searchsorted(minima, shingles), len(minima) - 1)
        hit = np.nonzero(minima[at] == shingles)[0]
        if len(hit):
            found += tool.matches(tokens, shingles, hit, width, least)
    return found


def license_scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """doc_id, license, containment, first_word, n_words and n_windows of each template found in each whole text."""
    if sum(len(t.encode()) for _, t in templates) > MAX_TEMPLATE_BYTES:
        raise ValueError(f"templates are shipped whole and may have at most {MAX_TEMPLATE_BYTES} bytes")
    rows = packed(docs)
    rows = rows.select(column(rows, "doc_id", "bigint").alias("doc_id"), column(rows, "text", "string").alias("text"))
    templates = tuple(templates)

    def run(batches):
        tool = prepared(templates)
        for batch in text_batches(batches, "text", BATCH_BYTES):
            out = [(i, *m) for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True) for m in scan(t, tool, least)]
            kinds = [pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([o[j] for o in out], kind) for j, kind in enumerate(kinds)], names=["doc_id", "license", "containment", "first_word", "n_words", "n_windows"])

    return rows.mapInArrow(run, "doc_id long, license string, containment double, first_word long, n_words long, n_windows long")
