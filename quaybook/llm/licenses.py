"""Licence scans: MinHash bands over overlapping text windows retrieve templates, exact shingle containment verifies them.

Templates are short notices and, of the full texts in ``license_texts``, all passages of twenty words or more, so that a licence is
found whole or in part.  Each belongs to the window length next above twice its own, and windows of every length in use run over the whole
text, half a window apart, so that one of them holds any occurrence entirely.  Bands of one row each retrieve a template with the
probability that :func:`guarantee` gives; least hashes of long windows are taken from those of short ones, so all lengths together cost
little more than one.  A retrieved template is verified around the windows: each stretch whose share of its shingles reaches the threshold
is a match, repeated ones included.

A passage that several licences share is listed under the first of them by name.

Defined cases: a null or empty text has no matches; repeated rows are scanned one by one; an empty table gives no rows; other
columns are ignored.  Words are runs of ASCII letters and digits or other characters beyond ASCII, A-Z lower-cased.
"""

from __future__ import annotations

import bisect
import functools
import heapq
import importlib.resources
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaybook.llm.shared import hashed_words, in_small_batches, mix64, window_hashes

#: Names and notices of public licences.
NOTICES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at '
        "http://www.apache.org/licenses/LICENSE-2.0",
    ),
    (
        "Apache-2.0",
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
        "either express or implied.",
    ),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    (
        "MIT",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, '
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("LGPL", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("AGPL-3.0", "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0."),
    ("proprietary", "All rights reserved."),
)

#: Words of the longest passage, and of the shortest.
_LONGEST_PASSAGE, _SHORTEST_PASSAGE = 128, 20


def passages(text: str) -> list[str]:
    """The paragraphs of a text that have words enough, long ones in parts of equal length."""
    out = []
    for paragraph in re.split(r"\n\s*\n", text):
        words = paragraph.split()
        parts = -(-len(words) // _LONGEST_PASSAGE)
        for k in range(parts):
            part = " ".join(words[len(words) * k // parts : len(words) * (k + 1) // parts])
            if len(hashed_words(part.encode(), _BLANKS)[0]) >= _SHORTEST_PASSAGE:
                out.append(part)
    return out


@functools.cache
def default_templates() -> tuple[tuple[str, str], ...]:
    """The notices and the passages of all texts that come with the package, each once."""
    found, seen = list(NOTICES), {hashed_words(t.encode(), _BLANKS)[0].tobytes() for _, t in NOTICES}
    folder = importlib.resources.files("quaybook.llm") / "license_texts"
    for file in sorted(folder.iterdir(), key=lambda f: f.name):
        for part in passages(file.read_text(encoding="utf-8")) if file.name.endswith(".txt") else ():
            same = hashed_words(part.encode(), _BLANKS)[0].tobytes()
            if same not in seen:
                seen.add(same)
                found.append((file.name.removesuffix(".txt"), part))
    return tuple(found)


#: Every ASCII byte but letters and digits parts words.
_BLANKS = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])


@dataclass(frozen=True)
class LicenseConfig:
    #: Longest shingle in words; a template of few words has shorter ones, see :meth:`Template`.
    width: int = 5
    containment: float = 0.8
    bands: int = 64
    seed: int = 11
    #: Shingles whose hashes are held in all bands at once, a power of two.
    stretch: int = 4096


class Template:
    def __init__(self, name: str, text: str, config: LicenseConfig) -> None:
        words = hashed_words(text.encode(), _BLANKS)[0]
        self.name, self.words = name, len(words)
        #: Five-word shingles for passages of 20 words or more, two-word shingles for notices.
        self.width = config.width if len(words) >= 4 * config.width else 2
        self.shingles = np.unique(window_hashes(words, self.width))
        #: The window: the power of two from twice the length on.
        self.window = 1 << (2 * len(words) - 1).bit_length()


_ODD = np.uint64(0x9E3779B97F4A7C15)
_TABLE_BITS = 20


class _Kind:
    """The templates of one shingle width and window length, by the least hash of each band."""

    def __init__(self, names: list[int], signatures: list[np.ndarray], salt: np.ndarray) -> None:
        keys = np.stack(signatures) ^ salt
        order = np.argsort(keys.ravel(), kind="stable")
        self.keys, self.names = keys.ravel()[order], np.repeat(names, keys.shape[1])[order]
        # a quick look tells nearly all windows that retrieve nothing
        self.may = np.zeros(1 << _TABLE_BITS, bool)
        self.may[self._slot(self.keys)] = True

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return ((keys >> np.uint64(8)) & np.uint64((1 << _TABLE_BITS) - 1)).astype(np.int64)

    def retrieved(self, keys: np.ndarray) -> set[tuple[int, int]]:
        """Pairs of window and template that share a band, from the keys of windows by band."""
        band, window = np.nonzero(self.may[self._slot(keys)])
        if not len(window):
            return set()
        wanted = keys[band, window]
        low, high = np.searchsorted(self.keys, wanted), np.searchsorted(self.keys, wanted, "right")
        return {(int(w), int(k)) for w, a, b in zip(window, low, high, strict=True) if a < b for k in self.names[a:b]}


class Templates:
    """All templates with the lookup from bands to them, by shingle width and window length."""

    def __init__(self, templates: tuple[tuple[str, str], ...], config: LicenseConfig) -> None:
        self.config = config
        self.templates = [Template(n, t, config) for n, t in templates]
        self.seeds = mix64(np.arange(1, config.bands + 1, dtype=np.uint64) + np.uint64(config.seed * 1000))[:, None]
        # keys of different bands never meet but by chance
        self.salt = mix64(self.seeds[:, 0] + _ODD)
        groups: dict[tuple[int, int], list[int]] = {}
        for k, t in enumerate(self.templates):
            groups.setdefault((t.width, t.window), []).append(k)
        self.kinds: dict[int, dict[int, _Kind]] = {}
        for (width, window), ks in groups.items():
            self.kinds.setdefault(width, {})[window] = _Kind(ks, [self.least(self.templates[k].shingles) for k in ks], self.salt)

    def hashes(self, shingles: np.ndarray) -> np.ndarray:
        """A hash of each shingle in each band."""
        with np.errstate(over="ignore"):
            return (shingles[None, :] ^ self.seeds) * _ODD

    def least(self, shingles: np.ndarray) -> np.ndarray:
        """Least hash in each band, a band having one row."""
        return self.hashes(shingles).min(1)

    def _blocks(self, shingles: np.ndarray, size: int) -> np.ndarray:
        """Least hashes of the blocks of so many shingles, by band."""
        whole = -(-len(shingles) // size) * size
        out = []
        for at in range(0, len(shingles), self.config.stretch):
            part = self.hashes(shingles[at : at + self.config.stretch])
            short = min(whole - at, self.config.stretch) - part.shape[1]
            if short:
                part = np.pad(part, ((0, 0), (0, short)), constant_values=np.iinfo(np.uint64).max)
            out.append(part.reshape(part.shape[0], -1, size).min(2))
        return np.concatenate(out, axis=1)

    def retrieved(self, shingles: np.ndarray, width: int) -> dict[int, list[tuple[int, int]]]:
        """For each template that shares a band with a window, stretches of shingles to verify."""
        places: dict[int, list[tuple[int, int]]] = {}
        kinds = self.kinds[width]
        half = min(kinds) // 2
        blocks = self._blocks(shingles, half) if len(shingles) else None
        while blocks is not None:
            if 2 * half in kinds:
                # windows begin at each block and end with the next one
                following = np.concatenate([blocks[:, 1:], blocks[:, -1:]], axis=1)
                for window, k in sorted(kinds[2 * half].retrieved(np.minimum(blocks, following) ^ self.salt[:, None])):
                    low, high = max(0, (window - 1) * half), (window + 3) * half
                    around = places.setdefault(k, [])
                    if around and low <= around[-1][1]:
                        around[-1] = (around[-1][0], high)
                    else:
                        around.append((low, high))
            if 2 * half >= max(kinds):
                return places
            if blocks.shape[1] % 2:
                blocks = np.pad(blocks, ((0, 0), (0, 1)), constant_values=np.iinfo(np.uint64).max)
            blocks = np.minimum(blocks[:, ::2], blocks[:, 1::2])
            half *= 2
        return places

    def matches(self, text: str | None) -> list[tuple[str, int, int, float]]:
        """``(name, start, end, containment)`` in code points, by start; of overlapping matches the better one."""
        if not text:
            return []
        raw = text.encode("utf-8", "surrogatepass")
        words, edges = hashed_words(raw, _BLANKS)
        by_width = {width: window_hashes(words, width) for width in self.kinds}
        places = {k: around for width, shingles in by_width.items() for k, around in self.retrieved(shingles, width).items()}
        found = [(k, *m) for k, around in places.items() for low, high in around for m in self._verified(self.templates[k], by_width[self.templates[k].width], low, high)]
        chosen: list[tuple[int, int, int, float]] = []
        taken = _Apart()
        for k, a, b, share in sorted(found, key=lambda x: (-x[3], -(x[2] - x[1]), x[1], x[0])):
            if taken.limit(a) >= b:
                taken.add(a, b)
                chosen.append((k, a, b, share))
        if not chosen:
            return []
        first, last = edges[::2], edges[1::2]
        # every byte but the continuing ones begins a code point
        points = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
        out = [(self.templates[k].name, int(points[first[a]]), int(points[last[b - 1]]), share) for k, a, b, share in chosen]
        return sorted(out, key=lambda m: (m[1], m[2], m[0]))

    def _verified(self, template: Template, shingles: np.ndarray, low: int, high: int) -> list[tuple[int, int, float]]:
        """All stretches of about the template's length that hold enough of its shingles and do not overlap, in words.

        They are taken by share, then the shorter, then the earlier one; a stretch ends where it has all it can reach.
        """
        part = shingles[low:high]
        i = np.minimum(np.searchsorted(template.shingles, part), len(template.shingles) - 1)
        here = np.flatnonzero(template.shingles[i] == part)
        which, reach = i[here], template.words + max(2, template.words // 4)
        least = self.config.containment * len(template.shingles) - 1e-9
        stops = np.searchsorted(here, here + reach)

        def longest(k: int, limit: float) -> tuple[float, int, int, int] | None:
            """The stretch from a shingle on that ends at a word before the limit, as it ranks."""
            stop = min(int(stops[k]), int(np.searchsorted(here, limit - template.width, "right")))
            if stop - k < least:
                return None
            kinds, firsts = np.unique(which[k:stop], return_index=True)
            if len(kinds) < least:
                return None
            a, b = int(here[k]), int(here[k + int(firsts.max())]) + template.width
            return -len(kinds) / len(template.shingles), b - a, a, k

        ranked = [m for k in np.flatnonzero(stops - np.arange(len(here)) >= least).tolist() if (m := longest(k, np.inf))]
        heapq.heapify(ranked)
        taken, out = _Apart(), []
        while ranked:
            share, length, a, k = heapq.heappop(ranked)
            limit = taken.limit(a)
            if limit >= a + length:
                taken.add(a, a + length)
                out.append((low + a, low + a + length, -share))
            elif limit > a and (m := longest(k, limit)):
                heapq.heappush(ranked, m)
        return out


class _Apart:
    """Stretches that do not overlap."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []

    def limit(self, a: int) -> float:
        """How far a stretch from ``a`` on may go; ``a`` itself where that is taken."""
        k = bisect.bisect_right(self.starts, a)
        if k and self.ends[k - 1] > a:
            return a
        return self.starts[k] if k < len(self.starts) else np.inf

    def add(self, a: int, b: int) -> None:
        k = bisect.bisect_right(self.starts, a)
        self.starts.insert(k, a)
        self.ends.insert(k, b)


def guarantee(templates: Templates) -> float:
    """Least probability that a template whose containment just reaches the threshold is retrieved from the window that holds it."""
    worst = 1.0
    for t in templates.templates:
        shared = np.ceil(templates.config.containment * len(t.shingles))
        union = t.window + len(t.shingles) - shared
        worst = min(worst, 1 - (1 - shared / union) ** templates.config.bands)
    return float(worst)


_MATCHES = pa.list_(pa.struct([("name", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("containment", pa.float64())]))


def scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] | None = None, config: LicenseConfig = LicenseConfig()) -> DataFrame:
    """``doc_id, key, matches``: for each document the licences found with their spans; ``key`` is ``xxhash64(text)``."""

    chosen = templates or default_templates()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Templates(chosen, config)
        for batch in batches:
            found = [[dict(zip(("name", "start", "end", "containment"), m, strict=True)) for m in known.matches(cell.as_py())] for cell in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, _MATCHES)], names=["doc_id", "key", "matches"])

    rows = in_small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, key long, matches array<struct<name:string,start:long,end:long,containment:double>>")
