"""License notices in documents (operator 8).

Each template's winnowed fingerprints are in an inverted index; a document that shares some with a
template is aligned with it in a band around the shared places.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackwork.llm.license_texts import WHOLE
from trackwork.llm.shingles import windows
from trackwork.llm.tables import in_batches, kind
from trackwork.llm.tokens import slices

#: Words of a fingerprint, and fingerprints of which the least is kept: any four equal words in a row meet.
GRAM, WINDOW = 3, 2
#: Words by which a match may shift against its template, and the share of the template it must cover.
BAND, COVERAGE = 8, 0.8
TOKEN = re.compile(r"[^\W_]+")

_GNU = (
    "you can redistribute it and/or modify it under the terms of the GNU {} License as published by the Free Software "
    "Foundation, either version {} of the License, or (at your option) any later version."
)
#: Usual notices of common licenses, then their whole texts.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files, to deal in the Software without restriction, including without limitation the rights to use, "
        "copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0-or-later",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
        "Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    (
        "BSD",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met",
    ),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("all-rights-reserved", "All rights reserved."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    (
        "GPL-2.0-only",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by "
        "the Free Software Foundation",
    ),
    ("GPL-2.0-or-later", _GNU.format("General Public", "2")),
    ("LGPL-2.1-or-later", _GNU.format("Lesser General Public", "2.1")),
    ("LGPL-3.0-or-later", _GNU.format("Lesser General Public", "3")),
    ("AGPL-3.0-or-later", _GNU.format("Affero General Public", "3")),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    (
        "EPL-2.0",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 "
        "which is available at https://www.eclipse.org/legal/epl-2.0/",
    ),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    (
        "CC0-1.0",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    ),
    ("ISC", "Licensed under the ISC License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    *WHOLE,
)


class Match(NamedTuple):
    template: int
    coverage: float
    first: int
    last: int


def tokens(text: str) -> list[str]:
    return TOKEN.findall(text.lower())


def hashes(found: list[str]) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(t) for t in found), dtype=np.uint64, count=len(found))


def winnowed(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of the fingerprints that are the least of some window."""
    grams = windows(own, GRAM)
    if len(grams) <= WINDOW:
        at = np.flatnonzero(grams == grams.min()) if len(grams) else np.empty(0, np.int64)
        return at, grams[at]
    view = np.lib.stride_tricks.sliding_window_view(grams, WINDOW)
    at = np.unique(np.arange(len(view)) + view.argmin(axis=1))
    return at, grams[at]


class Index(NamedTuple):
    """Fingerprints of all templates: sorted values with their template and place."""

    names: list[str]
    words: list[np.ndarray]
    values: np.ndarray
    owners: np.ndarray
    places: np.ndarray
    #: Fingerprints of templates that have no other: documents keep these too.
    only: np.ndarray


def index(templates) -> Index:
    words = [hashes(tokens(text)) for _, text in templates]
    every = [(v, i, p) for i, own in enumerate(words) for p, v in zip(*(x.tolist() for x in winnowed(own)))]
    every.sort()
    columns = list(zip(*every)) or [(), (), ()]
    return Index([n for n, _ in templates], words, np.array(columns[0], np.uint64), np.array(columns[1], np.int64), np.array(columns[2], np.int64), np.concatenate([np.empty(0, np.uint64), *(windows(w, GRAM) for w in words if len(w) <= GRAM)]))


def fingerprints(own: np.ndarray, known: Index) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of a document's fingerprints."""
    at, values = winnowed(own)
    if not len(known.only):
        return at, values
    grams = windows(own, GRAM)
    alone = np.flatnonzero(np.logical_or.reduce([grams == v for v in known.only]))
    return np.concatenate([at, alone]), np.concatenate([values, grams[alone]])


def within(template: np.ndarray, doc: np.ndarray, diagonal: int, band: int) -> int:
    """Words of the template that the band holds in any order: no fewer than in order."""
    at = np.arange(len(template))[:, None] + np.arange(diagonal - band, diagonal + band + 1)
    there = (at >= 0) & (at < len(doc))
    return int(((doc[at.clip(0, len(doc) - 1)] == template[:, None]) & there).any(axis=1).sum())


def align(template: np.ndarray, doc: np.ndarray, diagonal: int, band: int) -> tuple[int, int, int]:
    """Most words of the template found in order within the band: (words, first place, place after the last).

    Cell d of row i is place ``i + diagonal - band + d`` of the document. Of as many words, those nearest
    to the diagonal count, so that of repeated notices each diagonal finds its own.
    """
    width = 2 * band + 1
    none = (0, 0, 0, 0)  # words, minus the shifts, first and last place
    best = [none] * (width + 1)
    for i, word in enumerate(template):
        start, row, left = i + diagonal - band, [], none
        for d in range(width):
            at = start + d
            cell = max(best[d + 1], left)
            if 0 <= at < len(doc) and doc[at] == word:
                n, shift, first, _ = best[d]
                cell = max(cell, (n + 1, shift - abs(d - band), first if n else at, at))
            left = cell
            row.append(cell)
        best = [*row, none]
    n, _, first, last = max(best)
    return n, first, last + 1


def scan(text: str, known: Index, band: int, coverage: float) -> list[Match]:
    """Matches of a text's whole length, spans in characters; of overlapping ones the best."""
    own = hashes(tokens(text))
    at, values = fingerprints(own, known)
    low, high = (np.searchsorted(known.values, values, side) for side in ("left", "right"))
    if (low == high).all():
        return []
    spans = [m.span() for m in TOKEN.finditer(text)]
    own = hashes([text[a:b].lower() for a, b in spans])
    at, values = fingerprints(own, known)
    low, high = (np.searchsorted(known.values, values, side) for side in ("left", "right"))
    some = np.flatnonzero(low < high)
    hits = sorted({(int(known.owners[j]), int(p) - int(known.places[j])) for p, a, b in zip(at[some], low[some], high[some]) for j in range(a, b)})
    found, tried = [], None
    for template, diagonal in hits:
        if tried and tried[0] == template and diagonal - tried[1] <= band // 2:
            continue  # the band around the last one covers it
        tried = (template, diagonal)
        words = known.words[template]
        room = min(diagonal + len(words) + band, len(own)) - max(diagonal - band, 0)
        if min(room, len(words)) < coverage * len(words) or within(words, own, diagonal, band) < coverage * len(words):
            continue
        n, first, last = align(words, own, diagonal, band)
        if n >= coverage * len(words):
            found.append((n, Match(template, n / len(words), spans[first][0], spans[last - 1][1])))
    out: list[Match] = []
    for _, match in sorted(found, key=lambda x: (-x[0], -x[1].coverage, x[1].first, x[1].template)):
        if all(match.last <= other.first or match.first >= other.last for other in out):
            out.append(match)
    return sorted(out, key=lambda m: m.first)


def scan_licenses(
    docs: DataFrame,
    templates=TEMPLATES,
    coverage: float = COVERAGE,
    band: int = BAND,
    id_column: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """(id, license, template, coverage, first, last) of every notice in every document.

    ``coverage`` is the share of the template's words found in order; first and last are characters of the text,
    last excluded. Where matches overlap, the one with most words stays. Null and empty texts have none; null
    ids are kept; repeated rows are reported each; an empty table gives none; other columns are not read.
    ``templates`` is a parameter and as small as it is given.
    """
    known = index(templates)
    names = [id_column, "license", "template", "coverage", "first", "last"]
    schema = f"{id_column} {kind(docs, id_column)}, license string, template int, coverage double, first int, last int"

    def read(batches):
        for batch in batches:
            for part in slices(batch):
                found = [(i, m) for i, t in enumerate(part.column(1).to_pylist()) for m in scan(t or "", known, band, coverage)]
                ids = part.column(0).take(pa.array([i for i, _ in found], pa.int64()))
                matches = [m for _, m in found]
                made = [ids, pa.array([known.names[m.template] for m in matches], pa.string()), pa.array([m.template for m in matches], pa.int32())]
                made += [pa.array([m.coverage for m in matches], pa.float64())]
                made += [pa.array([m.first for m in matches], pa.int32()), pa.array([m.last for m in matches], pa.int32())]
                yield pa.RecordBatch.from_arrays(made, names=names)

    return in_batches(docs.select(F.col(id_column), F.col(text).cast("string"))).mapInArrow(read, schema)
