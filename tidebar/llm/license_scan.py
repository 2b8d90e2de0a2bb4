"""License scans: MinHash bands over overlapping windows retrieve templates, exact containment verifies.

Templates are put in classes by length: class c holds templates of at most 2**c words. Its
windows are 2**(c + 1) words long and start every 2**c words, so each occurrence lies whole
in one of them. A window that holds such a template has a Jaccard similarity to it of about a
quarter or more; with one row a band, ``bands_for`` gives the number of bands that makes a
common band as likely as asked (40 bands: 0.99999). A band of a window can only be common if
the window holds a shingle of a template of its class, so other windows need no signature. Retrieved
pairs are then compared shingle by shingle, and the share of the template's shingles in
the window is the containment.

Templates are a stated query set, read in blocks of bounded bytes, each sent to the tasks and
held against all rows; only verified windows leave a task.

Edge cases: a null text counts as empty; texts and templates of fewer words than a shingle
give one shingle of all of them; empty ones match nothing; repeated rows give one result an id
and template; empty tables give empty results; columns other than those named are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidebar.llm.words import PUNCTUATED, block_words, mix, text_grams

WORDS = 3
CONTAINMENT = 0.8
SIMILARITY, TARGET = 0.25, 0.99999
BLOCK_BYTES = 8 << 20
_BITS = 20

# fixed values: notices of public licenses, in the words in which files state them
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "MIT": "Released under the MIT License.",
    "MIT-permission": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so',
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "BSD-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}


def bands_for(similarity: float = SIMILARITY, target: float = TARGET, rows: int = 1) -> int:
    """Bands of so many rows that make a common band at this similarity as likely as asked."""
    return math.ceil(math.log(1 - target) / math.log(1 - similarity**rows))


BANDS = bands_for()
_MULT = mix(np.arange(1, BANDS + 1, dtype=np.uint64)) | np.uint64(1)


def signature(grams: np.ndarray) -> np.ndarray:
    """The least value of each hash function over a set of shingles."""
    out = np.full(BANDS, np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(grams), 4096):
        out = np.minimum(out, mix(grams[lo : lo + 4096, None] * _MULT).min(0))
    return out


def length_class(words: int) -> int:
    return max(words - 1, 1).bit_length()


def _template_rows(texts: list) -> list[tuple[int, np.ndarray]]:
    """(class, shingle set) of each template."""
    out = []
    for _, bounds, h in block_words(texts, PUNCTUATED):
        g, gb = text_grams(h, bounds, WORDS)
        out += [(length_class(int(bounds[i + 1] - bounds[i])), np.unique(g[gb[i] : gb[i + 1]])) for i in range(len(gb) - 1)]
    return out


class Templates:
    """The templates of one block: their shingles and signatures by length class."""

    def __init__(self, rows: list[tuple[str | None, str]]):
        made = [(name, c, u) for (name, _), (c, u) in zip(rows, _template_rows([t for _, t in rows]), strict=True) if len(u)]
        self.classes = {}
        for c in sorted({c for _, c, _ in made}):
            mine = [(n, u) for n, k, u in made if k == c]
            known = np.unique(np.concatenate([u for _, u in mine]))
            seen = np.zeros(1 << _BITS, bool)
            seen[(known >> np.uint64(64 - _BITS)).astype(np.int64)] = True
            self.classes[c] = ([n for n, _ in mine], [u for _, u in mine], np.stack([signature(u) for _, u in mine]), known, seen)

    def matches(self, texts: list, containment: float) -> Iterator[tuple[int, str | None, float, int]]:
        """(text, license, containment, first word of the window) of each window that holds a template."""
        for first, bounds, h in block_words(texts, PUNCTUATED):
            g, gb = text_grams(h, bounds, WORDS)
            for c, (names, own, sigs, known, seen) in self.classes.items():
                at = np.flatnonzero(seen[(g >> np.uint64(64 - _BITS)).astype(np.int64)])
                at = at[known[np.minimum(np.searchsorted(known, g[at]), len(known) - 1)] == g[at]]
                doc = np.searchsorted(gb, at, "right") - 1
                # a shingle lies in the window that begins at or before its step and in the one before that
                step = (at - gb[doc]) >> c
                for w in np.unique(np.concatenate([doc << 32 | step, doc << 32 | np.maximum(step - 1, 0)])).tolist():
                    d, start = w >> 32, (w & 0xFFFFFFFF) << c
                    lo = gb[d] + start
                    u = np.unique(g[lo : max(min(lo + (2 << c) - WORDS + 1, gb[d + 1]), lo + 1)])
                    for t in np.flatnonzero((sigs == signature(u)).any(1)):  # a common band
                        share = len(np.intersect1d(own[t], u, assume_unique=True)) / len(own[t])
                        if share >= containment:
                            yield first + d, names[t], share, start


def default_templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TEMPLATES.items()), "license string, text string")


def scan(docs: DataFrame, templates: DataFrame, id_col: str = "doc_id", text_col: str = "text", name_col: str = "license", template_col: str = "text", containment: float = CONTAINMENT) -> DataFrame:
    """(doc_id, license, containment, first_word, n_windows) of each text and template that it holds."""
    spark = docs.sparkSession
    own = templates.select(F.col(name_col).cast("string").alias("license"), F.coalesce(F.col(template_col), F.lit("")).alias("text"))
    total = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count, out = total // BLOCK_BYTES + 1, None
    for b in range(count):
        part = own if count == 1 else own.where(F.pmod(F.xxhash64("license", "text"), F.lit(count)) == b)
        rows = sorted(map(tuple, part.distinct().collect()), key=lambda r: (r[0] is not None, r[0] or "", r[1]))
        shared = spark.sparkContext.broadcast(Templates(rows))  # bounded by BLOCK_BYTES

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = list(shared.value.matches(batch.column(1).to_pylist(), containment))
                if found:
                    text, name, share, start = (list(x) for x in zip(*found, strict=True))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(text)), pa.array(name, pa.string()), pa.array(share), pa.array(start, pa.int64())], names=["doc_id", "license", "share", "start"])

        held = docs.select(F.col(id_col).alias("doc_id"), text_col).mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, license string, share double, start long")
        found = held.groupBy("doc_id", "license").agg(F.max("share").alias("containment"), F.min("start").alias("first_word"), F.countDistinct("start").alias("n_windows"))
        out = found if out is None else out.unionByName(found)
    return out
