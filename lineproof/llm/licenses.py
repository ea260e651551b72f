"""License scan: MinHash bands over overlapping windows retrieve templates, exact shingle containment decides.

Texts become lower-case words without ASCII punctuation and shingles of WORDS words. The document is cut into blocks of
BLOCK shingles; the windows of a template are all runs of the fewest blocks that hold its length at any offset. So a
template of t shingles, of which CONTAINMENT stand in a window, has J of at least 0.8 t / (1.2 t + 14), 0.38 from
t = EXACT on, and BANDS bands of one minwise value each miss it with (1 - J)^BANDS, about 1e-5 at most. Templates under
EXACT shingles are looked up by each of their shingles instead. Around a hit the share of the template's shingles found
must reach CONTAINMENT.

The templates are a bounded table (short public notices and the leading paragraphs of common licenses); they travel in
the task closure. Work is a map over rows.

Defined cases: null or empty texts match nothing; a document shorter than a template may still hold CONTAINMENT of it;
a template found twice counts once, with its best containment; repeated rows give repeated results; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineproof.llm.mph import mix
from lineproof.llm.shared import batch, sliced

WORDS = 5
BANDS = 24
CONTAINMENT = 0.8
BLOCK = 8
EXACT = 16
WORD_CACHE = 200_000
#: Wordings of public license notices.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "GPL-3.0": "licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "MIT": "Released under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "BSD-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "ISC-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
}
PUNCTUATION = bytes.maketrans(bytes(c for c in range(33, 127) if not chr(c).isalnum()), b" " * 32)
FOUND = pa.schema([("doc_id", pa.int64()), ("licenses", pa.list_(pa.string())), ("containment", pa.list_(pa.float64()))])
MULTIPLIERS = np.random.default_rng(7).integers(0, 2**63, (2, BANDS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Scanner:
    def __init__(self, templates: dict[str, str], words: int = WORDS, containment: float = CONTAINMENT):
        import xxhash

        self.hash, self.words, self.containment, self.cache = xxhash.xxh3_64_intdigest, words, containment, {}
        self.names = sorted(templates)
        self.sets = [np.unique(self.shingles(templates[n])) for n in self.names]
        sizes = [len(self.shingles(templates[n])) for n in self.names]
        self.short = [i for i, size in enumerate(sizes) if size < EXACT]
        self.asked = np.unique(np.concatenate([self.sets[i] for i in self.short])) if self.short else np.zeros(0, np.uint64)
        #: Templates by the blocks of their windows.
        self.classes: dict[int, list[int]] = {}
        for i, size in enumerate(sizes):
            if size >= EXACT:
                self.classes.setdefault(-(-(size + BLOCK - 1) // BLOCK), []).append(i)
        self.mins = {blocks: np.array([self.minima(self.sets[i][None])[:, 0] for i in own]) for blocks, own in self.classes.items()}

    def shingles(self, text: str) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").lower().translate(PUNCTUATION).split()
        if len(self.cache) > WORD_CACHE:
            self.cache = {}
        for w in set(words).difference(self.cache):
            self.cache[w] = self.hash(w)
        h = np.fromiter(map(self.cache.__getitem__, words), np.uint64, len(words))
        if not len(h):
            return h
        span = min(self.words, len(h))
        with np.errstate(over="ignore"):
            total = mix(h[: len(h) - span + 1])
            for i in range(1, span):
                total = total * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - span + 1 + i]
            return mix(total)

    @staticmethod
    def minima(sets: np.ndarray) -> np.ndarray:
        """(bands, rows) least values of rows of shingles."""
        with np.errstate(over="ignore"):
            return np.array([(sets * a + b).min(1) for a, b in MULTIPLIERS.T])

    def scan(self, text: str) -> dict[str, float]:
        h = self.shingles(text)
        found: dict[str, float] = {}
        if not len(h):
            return found
        for at in np.flatnonzero(np.isin(h, self.asked)):
            for i in self.short:
                if (self.sets[i] == h[at]).any():
                    self.confirm(i, h[max(0, at - 2 * EXACT) : at + 2 * EXACT], found)
        if not self.classes:
            return found
        starts = np.arange(0, len(h), BLOCK)
        with np.errstate(over="ignore"):
            low = np.array([np.minimum.reduceat(h * a + b, starts) for a, b in MULTIPLIERS.T])
        run = 1
        for blocks, own in sorted(self.classes.items()):
            held = min(blocks, len(starts))
            while 2 * run <= held:
                low = np.minimum(low[:, :-run], low[:, run:])
                run *= 2
            # Two runs of a power of two blocks that overlap make a window.
            n = len(starts) - held + 1
            window = np.minimum(low[:, :n], low[:, held - run :])
            hits = np.zeros((n, len(own)), bool)
            for band, row in enumerate(window):
                hits |= row[:, None] == self.mins[blocks][None, :, band]
            for at, k in zip(*np.nonzero(hits), strict=True):
                self.confirm(own[k], h[max(0, (at - blocks) * BLOCK) : (at + 2 * blocks) * BLOCK], found)
        return found

    def confirm(self, i: int, near: np.ndarray, found: dict[str, float]) -> None:
        share = float(np.isin(self.sets[i], near).mean())
        if share >= self.containment:
            found[self.names[i]] = max(share, found.get(self.names[i], 0.0))


def _scan(templates: dict[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        for b in sliced(batches, "text", 2 << 20):
            found = [sorted(scanner.scan(t or "").items()) for t in b["text"].to_pylist()]
            yield batch(FOUND, doc_id=b["doc_id"], licenses=[[n for n, _ in f] for f in found], containment=[[c for _, c in f] for f in found])

    return run


def scan_documents(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, licenses, containment) of every document; empty lists where nothing matches."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_scan(templates or TEMPLATES), "doc_id long, licenses array<string>, containment array<double>")
