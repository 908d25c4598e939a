"""License scan: MinHash bands over overlapping word windows find templates, exact containment decides.

Texts are cut into words; five words in a row are a shingle. For each template size, every window of
about that many shingles gets MinHash values; two in a band equal to a template's retrieve it. A
minimum equal to a template's is the hash of the shingle that gave the template its minimum, so only
windows around such shingles are hashed; no other window can share a band with a template. A
retrieved window matches if it holds at least `least` of the template's shingles, compared as words.
The number of bands follows from the likeness a matching window has at least (see `bands_for`).
Windows are made and looked up in the task that scans the text; templates are a bounded parameter.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegraph.llm.common import as_text, slices

SHINGLE = 5
ROWS = 2
#: Collision probability of a window at the least likeness of a match.
COLLISION = 0.999
#: Bounds of the template table, checked when it is read.
MAX_TEMPLATES = 5_000
MAX_TEMPLATE_WORDS = 20_000

# Short notices of public licenses, by SPDX id.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "MIT-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software "
    "and associated documentation files, to deal in the Software without restriction",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-program": "you can redistribute it and/or modify it under the terms of the GNU General Public License as "
    "published by the Free Software Foundation, either version 3 of the License, or any later version",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted "
    "provided that the following conditions are met",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
}

_WORD = re.compile(r"\w+")
_ODD = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def width_for(shingles: int) -> int:
    """Shingles in a window for a template of so many: the next of 1, 2, 3, 4, 6, 8, 12, 16, 24, ..."""
    power = 1 << max(0, (shingles - 1).bit_length())
    return power * 3 // 4 if power >= 4 and shingles <= power * 3 // 4 else power


def bands_for(least: float) -> int:
    """Bands that give a matching window the collision probability.

    A template has more than 2/3 of its window's shingles. A window with a share c of the q shingles
    has a Jaccard of c*q / (width + (1-c)*q), at least c / (1.5 + 1 - c).
    """
    likeness = least / (2.5 - least)
    return math.ceil(math.log(1 - COLLISION) / math.log(1 - likeness**ROWS))


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(31))) * _ODD
    return values ^ (values >> np.uint64(29))


def word_hashes(words: list[str]) -> np.ndarray:
    """Hashes of words: their length in bytes, then eight bytes at a time."""
    data = [w.encode() for w in words]
    lengths = np.array([len(d) for d in data], np.int64)
    h = lengths.astype(np.uint64)
    parts = (lengths + 7) // 8
    flat = np.frombuffer(b"".join([d.ljust((len(d) + 7) // 8 * 8, b"\0") for d in data]), "<u8").astype(np.uint64)
    first = np.cumsum(parts) - parts
    left = np.flatnonzero(parts)
    k = 0
    while len(left):
        h[left] = _mixed(h[left] + flat[first[left] + k])
        k += 1
        left = left[parts[left] > k]
    return h


def _among(values: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which values are among the sorted keys."""
    if len(keys) == 0:
        return np.zeros(len(values), bool)
    return keys[np.minimum(np.searchsorted(keys, values), len(keys) - 1)] == values


def _windows_over(places: np.ndarray, step: int, reach: int, windows: int) -> np.ndarray:
    """Numbers of the windows, `reach` wide at multiples of `step`, that hold one of the places."""
    covered = np.zeros(windows + 1, np.int32)
    np.add.at(covered, np.minimum(np.maximum(0, -((reach - 1 - places) // step)), windows), 1)
    np.add.at(covered, np.minimum(places // step + 1, windows), -1)
    return np.flatnonzero(np.cumsum(covered[:windows]))


def shingle_hashes(words: np.ndarray) -> np.ndarray:
    """Hashes of all shingles of word hashes, in order."""
    n = len(words) - SHINGLE + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        h = _mixed(h + words[k : k + n])
    return h


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum over each `width` values in a row, from halves that overlap."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


@dataclass(frozen=True)
class Match:
    template: str
    first_word: int
    last_word: int
    containment: float


class Scanner:
    """Templates indexed by window width and band."""

    def __init__(self, templates: dict[str, str], least: float):
        if len(templates) > MAX_TEMPLATES:
            raise ValueError(f"{len(templates)} templates; at most {MAX_TEMPLATES}")
        self.least = least
        self.bands = bands_for(least)
        seeds = np.random.default_rng(20_000).integers(1, 2**63, self.bands * ROWS, dtype=np.uint64)
        self.seeds = seeds | np.uint64(1)
        self.names = sorted(templates)
        self.shingles: list[set[tuple[str, ...]]] = []
        self.widths: list[int] = []
        by_width: dict[int, list[int]] = {}
        hashes = []
        for k, name in enumerate(self.names):
            words = words_of(templates[name])
            if not SHINGLE <= len(words) <= MAX_TEMPLATE_WORDS:
                raise ValueError(f"template {name} has {len(words)} words")
            self.shingles.append({tuple(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)})
            hashes.append(shingle_hashes(word_hashes(words)))
            self.widths.append(width_for(len(words) - SHINGLE + 1))
            by_width.setdefault(self.widths[-1], []).append(k)
        known = sorted({w for own in self.shingles for shingle in own for w in shingle})
        #: number and hash of each word of the templates
        self.numbers = {w: n for n, w in enumerate(known)}
        self.known = word_hashes(known)
        #: per width: per band the sorted keys and the template of each
        self.index: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        #: per width: the sorted hashes of the shingles that are some template's minimum under some seed
        self.minima: dict[int, np.ndarray] = {}
        for width, own in by_width.items():
            mixed = {k: [_mixed(hashes[k] * s) for s in self.seeds] for k in own}
            mins = [[m.min() for m in mixed[k]] for k in own]
            self.minima[width] = np.unique([hashes[k][m.argmin()] for k in own for m in mixed[k]])
            bands = []
            for b in range(self.bands):
                keys = np.array([self._key(m[ROWS * b], m[ROWS * b + 1]) for m in mins], np.uint64)
                order = keys.argsort()
                bands.append((keys[order], np.array(own)[order]))
            self.index[width] = bands
        self.all_minima = np.unique(np.concatenate([*self.minima.values(), np.zeros(0, np.uint64)]))

    @staticmethod
    def _key(a, b):
        return a ^ (b << np.uint64(1))

    def _places(self, words: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Positions and hashes of the shingles that are some template's minimum. None is no word."""
        numbers = np.fromiter(map(self.numbers.get, words, repeat(-1)), np.int64, len(words))
        n = len(words) - SHINGLE + 1
        whole = numbers >= 0
        run = whole[:n].copy()
        for k in range(1, SHINGLE):
            run &= whole[k : k + n]
        at = np.flatnonzero(run)
        hashes = np.zeros(len(at), np.uint64)
        for k in range(SHINGLE):
            hashes = _mixed(hashes + self.known[numbers[at + k]])
        held = _among(hashes, self.all_minima)
        return at[held], hashes[held]

    def candidates(self, texts: list[list[str]]) -> set[tuple[int, int, int]]:
        """(text, window start, template) of all windows that share a band with a template.

        Windows of width w start at multiples of w // 8 (1 at least) and are wider by that step less
        one, so that each passage of w shingles lies in one of them.
        """
        found: set[tuple[int, int, int]] = set()
        gap = SHINGLE if len(texts) > 1 else 0
        words: list[str | None] = []
        for own in texts:
            words.extend(own)
            words.extend([None] * gap)
        n = len(words) - SHINGLE + 1
        if n <= 0:
            return found
        starts = np.cumsum([0, *(len(w) + gap for w in texts)])
        places, place_hashes = self._places(words)
        for width, bands in self.index.items():
            step = max(1, width // 8)
            reach = min(width + step - 1, n)
            held = places[_among(place_hashes, self.minima[width])]
            windows = _windows_over(held, step, reach, (n - reach) // step + 1)
            if len(windows) == 0:
                continue
            # the shingles of these windows, neighbours next to each other
            needed = np.zeros(n + 1, np.int32)
            np.add.at(needed, windows * step, 1)
            np.add.at(needed, windows * step + reach, -1)
            shingles = np.flatnonzero(np.cumsum(needed[:n]))
            hashes = self._hashes_at(words, shingles, starts, gap)
            first_of = np.searchsorted(shingles, windows * step)
            for b in range(self.bands):
                first, second = (_mixed(hashes * self.seeds[ROWS * b + j]) for j in range(ROWS))
                a, c = (sliding_min(v, reach)[first_of] for v in (first, second))
                keys, templates = bands[b]
                values = self._key(a, c)
                for w in np.flatnonzero(_among(values, keys)):
                    lo, hi = np.searchsorted(keys, values[w]), np.searchsorted(keys, values[w], side="right")
                    at = int(windows[w]) * step
                    text = int(np.searchsorted(starts, at, side="right")) - 1
                    found.update((text, at - int(starts[text]), int(k)) for k in templates[lo:hi])
        return found

    @staticmethod
    def _hashes_at(words: list[str | None], shingles: np.ndarray, starts: np.ndarray, gap: int) -> np.ndarray:
        """Hashes of the shingles at some positions; after each text, words that occur nowhere else."""
        at = np.unique(shingles[:, None] + np.arange(SHINGLE))
        own = [words[k] for k in at.tolist()]
        numbers = {w: k for k, w in enumerate(dict.fromkeys(own))}
        hashes = word_hashes(["" if w is None else w for w in numbers])[[numbers[w] for w in own]]
        gaps = np.flatnonzero([w is None for w in own])
        text = np.searchsorted(starts, at[gaps], side="right")  # numbered from 1
        hashes[gaps] = _mixed((gap * text - (starts[text] - at[gaps])).astype(np.uint64) + np.uint64(1 << 40))
        first = np.searchsorted(at, shingles)
        h = np.zeros(len(shingles), np.uint64)
        for k in range(SHINGLE):
            h = _mixed(h + hashes[first + k])
        return h

    def scan(self, texts: list[str]) -> list[list[Match]]:
        """Matches of each text: per template, the windows that hold most of it, without overlaps."""
        split = [words_of(t) for t in texts]
        held: dict[tuple[int, int], list[tuple[float, int, int]]] = {}
        for text, at, k in self.candidates(split):
            own, wanted = split[text], self.shingles[k]
            reach = self.widths[k] + max(1, self.widths[k] // 8) - 1
            places = [i for i in range(at, at + reach) if tuple(own[i : i + SHINGLE]) in wanted]
            share = len({tuple(own[i : i + SHINGLE]) for i in places}) / len(wanted)
            if share >= self.least:
                held.setdefault((text, k), []).append((share, places[0], places[-1] + SHINGLE - 1))
        out: list[list[Match]] = [[] for _ in texts]
        for (text, k), windows in held.items():
            taken: list[tuple[int, int]] = []
            for share, first, last in sorted(set(windows), key=lambda w: (-w[0], w[2] - w[1], w[1])):
                if all(last < a or first > b for a, b in taken):
                    taken.append((first, last))
                    out[text].append(Match(self.names[k], first, last, share))
        return [sorted(own, key=lambda m: (m.first_word, m.template)) for own in out]


SCHEMA = "doc_id long, license string, start_char int, end_char int, containment double, passage string"


def _scan(templates: dict[str, str], least: float):
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.string()]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, least)
        for part in slices(batches, 64):
            texts, rows = as_text(part.column(1)), []
            for doc, text, matches in zip(part.column(0).to_pylist(), texts, scanner.scan(texts)):
                if matches:
                    # lower() may change the number of characters; words_of looked at the lowered text
                    text = text if len(text.lower()) == len(text) else text.lower()
                    spans = [m.span() for m in _WORD.finditer(text.lower())]
                    for m in matches:
                        a, b = spans[m.first_word][0], spans[m.last_word][1]
                        rows.append((doc, m.template, a, b, m.containment, text[a:b]))
            columns = [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * len(names), kinds)]
            yield pa.RecordBatch.from_arrays(columns, names)

    return scan


def license_matches(docs: DataFrame, templates: dict[str, str] | None = None, least: float = 0.8) -> DataFrame:
    """One row per match: doc_id, license, its span in characters, containment, and the passage.

    A match is a window of the text with at least `least` of a template's distinct shingles; of
    overlapping windows of one template the best is reported. NULL, empty and short texts have no
    matches. Repeated rows give their matches each; other columns are not read. Spans are those of
    the lower-cased text where lower case has another length.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.mapInArrow(_scan(templates or TEMPLATES, least), SCHEMA)
