"""License scans: MinHash bands over overlapping windows of words retrieve templates; exact containment confirms them.

Words are lower-cased runs of letters and digits. A template with t shingles (of five words) belongs to the class of the
next power of two, S. A text is read in windows of 2 S shingles that begin every S shingles, so each occurrence of the
template lies whole in some window, and the Jaccard similarity of the two has a lower bound. Bands have one row each, and
their number follows from that bound and from the chance ``MISS`` of no equal band. A window and a template that share a
band are compared exactly: of the template's distinct shingles, the window must hold the share ``CONTAINED``.

Templates are a driver-side list, sent out in groups of at most ``GROUP`` shingles: each group scans the texts once.

Defined results: a null or empty text matches nothing; a null document id is returned as null; repeated rows match each;
other columns are ignored, whatever their names; an empty table gives an empty result; of windows that hold as much of a
template the first counts, of templates that tie for a stretch the first by name order of the list; a template of fewer
than five words is an error. A text is read whole, some tens of bytes of memory for each of its own.
"""

from __future__ import annotations

import math
import pkgutil
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tracemill.llm import _common
from tracemill.llm import _words as words

SHINGLE, CONTAINED, MISS, GROUP = 5, 0.8, 1e-4, 1 << 18

#: One-line notices, and headers, grants and whole texts of public licenses as their publishers word them.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "BSD-2-Clause-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "LGPL-2.1-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "AGPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "ISC-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    **{f"CC-{code}-4.0-sentence": f"This work is licensed under a Creative Commons Attribution-{kind} 4.0 International License." for code, kind in (("BY-NC", "NonCommercial"), ("BY-SA", "ShareAlike"), ("BY-ND", "NoDerivatives"), ("BY-NC-SA", "NonCommercial-ShareAlike"), ("BY-NC-ND", "NonCommercial-NoDerivatives"))},
    **{name: pkgutil.get_data("tracemill.llm", f"licenses/{name}.txt").decode() for name in ("Apache-2.0", "BSD-3-Clause", "CC0-1.0", "GPL-2", "GPL-3", "LGPL-2.1", "LGPL-3", "MIT", "MPL-2.0", "Unlicense")},
}

#: Each byte as the scan reads it: ASCII letters in lower case, other ASCII signs as spaces.
_READ = np.array([b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)], np.uint8)


def shingles(data: np.ndarray, row_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of all rows, one row after another, and how many each has."""
    h, n = words.word_hashes(_READ[data], row_at)
    count = np.maximum(0, n - SHINGLE + 1)
    if len(h) < SHINGLE:
        return np.empty(0, np.uint64), count
    first = np.cumsum(n) - n
    at = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())
    return words.ngrams(h, SHINGLE)[at], count


def bands_for(template: int, size: int, contained: float = CONTAINED, miss: float = MISS) -> int:
    """Bands of one row that miss a window holding that share of the template with a chance of at most ``miss``."""
    held = math.ceil(contained * template - 1e-9)
    similar = held / (2 * size + template - held)
    return max(1, math.ceil(math.log(miss) / math.log1p(-min(similar, 0.999))))


class Index:
    """Templates by class: (S, bands, and for each band the sorted values with their templates)."""

    def __init__(self, templates: dict[str, str]):
        self.names, self.sets = list(templates), []
        for name, text in templates.items():
            data = np.frombuffer(text.encode(), np.uint8)
            h, _ = shingles(data, np.array([0, len(data)]))
            if not len(h):
                raise ValueError(f"template {name} has fewer than {SHINGLE} words")
            self.sets.append((np.unique(h), len(h)))
        self.classes = []
        for size in sorted({1 << (n - 1).bit_length() for _, n in self.sets}):
            members = [t for t, (_, n) in enumerate(self.sets) if 1 << (n - 1).bit_length() == size]
            bands = max(bands_for(len(self.sets[t][0]), size) for t in members)
            tables = []
            for k in range(bands):
                values = np.array([band(self.sets[t][0], k).min() for t in members], np.uint64)
                order = np.argsort(values, kind="stable")
                tables.append((values[order], np.array(members)[order]))
            self.classes.append((size, tables))


def band(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th permutation of the hashes."""
    return (h ^ np.uint64((k + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64((2 * k + 1) * 0xD1B54A32D192ED03 & (1 << 64) - 1)


def scan_shingles(index: Index, h: np.ndarray, count: np.ndarray) -> list[tuple[int, int, float, int, int]]:
    """(row, template, containment, first shingle, last shingle) of the best window of each row and template.

    Where templates compete for a stretch (half of the shorter), the one with more of its shingles there has it.
    """
    start = np.cumsum(count) - count
    hits: dict[int, list[tuple[int, float, int, int, int]]] = {}
    for size, tables in index.classes:
        blocks = -(-count // size)
        row = np.repeat(np.arange(len(count)), blocks)
        if not len(row):
            continue
        nth = np.arange(len(row)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        at = start[row] + nth * size
        follows = np.r_[row[1:] == row[:-1], False]
        pairs = set()
        for k, (values, members) in enumerate(tables):
            least = np.minimum.reduceat(band(h, k), at)
            least[:-1] = np.where(follows[:-1], np.minimum(least[:-1], least[1:]), least[:-1])
            if len(values) <= 8:
                for value, t in zip(values, members.tolist(), strict=True):
                    pairs.update((w, t) for w in np.flatnonzero(least == value).tolist())
            else:
                low, high = np.searchsorted(values, least, "left"), np.searchsorted(values, least, "right")
                for w in np.flatnonzero(low < high).tolist():
                    pairs.update((w, t) for t in members[low[w] : high[w]].tolist())
        for w, t in sorted(pairs):
            r, begin = int(row[w]), int(at[w])
            part = h[begin : min(begin + 2 * size, int(start[r] + count[r]))]
            hit = np.flatnonzero(np.isin(part, index.sets[t][0]))
            if not len(hit):
                continue
            held = len(np.unique(part[hit]))
            share = held / len(index.sets[t][0])
            if share >= CONTAINED:
                hits.setdefault(r, []).append((-held, -share, t, begin + int(hit[0]) - int(start[r]), begin + int(hit[-1]) - int(start[r])))
    out = []
    for r, found in sorted(hits.items()):
        taken: dict[int, tuple[float, int, int]] = {}
        spans: list[tuple[int, int, int]] = []
        for _, share, t, a, b in sorted(found):
            if all(o == t or 2 * (min(b, d) - max(a, c) + 1) <= min(b - a, d - c) + 1 for o, c, d in spans):
                spans.append((t, a, b))
                if -share > taken.get(t, (0.0,))[0]:
                    taken[t] = (-share, a, b)
        out += [(r, t, *taken[t]) for t in sorted(taken)]
    return out


def groups_of(templates: dict[str, str], most: int = GROUP) -> list[dict[str, str]]:
    """Templates in groups of at most ``most`` words, so that what is sent out has a bound."""
    out, room = [{}], most
    for name, text in templates.items():
        size = len(text.split())
        if size > room and out[-1]:
            out.append({})
            room = most
        out[-1][name] = text
        room -= size
    return out


def scan(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """doc_id, license, containment, begin_word, end_word: one row per text and template that it contains."""
    schema = "doc_id long, license string, containment double, begin_word long, end_word long"
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))

    def scanner(group: dict[str, str]):
        def run(batches: Iterable[pa.RecordBatch]):
            index = Index(group)
            for batch in batches:
                data, at = _common.utf8_of(batch.column(1))
                data, ids = np.frombuffer(data, np.uint8), batch.column(0)
                for first, end in words.chunks(at):
                    h, count = shingles(data[at[first] : at[end]], np.array(at[first : end + 1]) - at[first])
                    if found := scan_shingles(index, h, count) if len(h) else []:
                        row, t, share, begin, last = zip(*found, strict=True)
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array([first + r for r in row])), pa.array([index.names[x] for x in t]), pa.array(share), pa.array(begin, pa.int64()), pa.array([x + SHINGLE for x in last], pa.int64())], ["doc_id", "license", "containment", "begin_word", "end_word"])

        return run

    out = None
    for group in groups_of(TEMPLATES if templates is None else templates):
        Index(group)  # a bad template fails here and not on an executor
        part = rows.mapInArrow(scanner(group), schema)
        out = part if out is None else out.unionByName(part)
    return out


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against the built-in notices and grants."""
    _common.tune(spark)
    return scan(_common.documents(spark, sf_dir))
