"""License scans: templates retrieved by MinHash bands, verified by exact containment.

Templates of like length form a class with a stride of shingles, the power of two from
their length on.  Texts are cut into windows of two strides that overlap by one, so a
copy of a template lies in one window as a whole, and its shingles are then at least a
fifth of all in window and template.  Every window gets ``BANDS`` MinHash values, each a
band of its own; a window and a template that share a fifth of their shingles share a
band with a chance of 1 - 5e-10.  Windows without any shingle of any template cannot
match and get no signature.  A match is verified by the share of the template's shingles
that the window holds.

Templates are a parameter of bounded size (``MOST_TEMPLATE_WORDS`` in total), so their
bands may be broadcast.  Words are runs of letters and digits, lower case; templates of
fewer than five words are refused.  Null and empty texts match nothing; rows that share a
key count as one document; a null key is reported as such; an empty table gives an empty
result; other columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.shipping import ship_by_value
from loomgraph.llm.bag_minhash import SHINGLE, _lists, _spans, mixed, shingles, word_hashes
from loomgraph.llm.shared import whole_text

ship_by_value(__name__)

CONTAINMENT = 0.8
BANDS = 96
MOST_TEMPLATE_WORDS = 200_000

# Notices, standard headers and titles as their licences word them; the whole texts of the GNU, Apache, MPL
# and CC licences are known by their titles.  Templates that name a version have at most four shingles, all of which are
# then required, or so few that another version word leaves less than ``CONTAINMENT``.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        'files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, '
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software "
        "is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be "
        "included in all copies or substantial portions of the Software."
    ),
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed "
        'to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF '
        "ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "Apache-2.0-text": "Apache License Version 2.0, January 2004",
    "GPL-1.0": "under the GNU General Public License, version 1",
    "GPL-1.0-notice": "of the GNU General Public License, version 1",
    "GPL-1.0-text": "GNU General Public License Version 1, February 1989",
    "GPL-2.0": "under the GNU General Public License, version 2",
    "GPL-2.0-notice": "of the GNU General Public License, version 2",
    "GPL-2.0-text": "GNU General Public License Version 2, June 1991",
    "GPL-3.0": "under the GNU General Public License, version 3",
    "GPL-3.0-notice": "of the GNU General Public License, version 3",
    "GPL-3.0-text": "GNU General Public License Version 3, 29 June",
    "GPL-2.0-short-notice": "GNU General Public License v2.0",
    "GPL-3.0-short-notice": "GNU General Public License v3.0",
    "LGPL-2.0": "GNU Library General Public License version 2",
    "LGPL-2.1": "GNU Lesser General Public License version 2.1",
    "LGPL-3.0": "GNU Lesser General Public License version 3",
    "AGPL-3.0": "GNU Affero General Public License version 3",
    "GPL-2.0-header": "the terms of the GNU General Public License as published by the Free Software Foundation; version 2 of the License",
    "GPL-2.0-or-later-header": "the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License",
    "GPL-3.0-or-later-header": "the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License",
    "LGPL-2.1-or-later-header": "the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License",
    "LGPL-3.0-or-later-header": "the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License",
    "AGPL-3.0-or-later-header": "the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License",
    "MPL-1.1": "Mozilla Public License Version 1.1",
    "MPL-2.0": "Mozilla Public License, v. 2.0",
    "MPL-2.0-text": "Mozilla Public License Version 2.0",
    "EPL-2.0": "Eclipse Public License 2.0",
    "EPL-2.0-text": "Eclipse Public License - v 2.0",
    "Artistic-2.0": "The Artistic License 2.0",
    "CC0-1.0": "has waived all copyright and related or neighboring rights to",
    "CC0-1.0-notice": "Licensed under CC0 1.0",
    "CC0-1.0-text": "Legal Code CC0 1.0 Universal",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.",
    "CC-BY-NC-SA-4.0": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-NC-ND-4.0": "Licensed under CC BY-NC-ND 4.0.",
    "CC-BY-SA-4.0-text": "Creative Commons Attribution-ShareAlike 4.0 International",
    "CC-BY-ND-4.0-text": "Creative Commons Attribution-NoDerivatives 4.0 International",
    "CC-BY-NC-4.0-text": "Creative Commons Attribution-NonCommercial 4.0 International",
    "CC-BY-NC-SA-4.0-text": "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International",
    "CC-BY-NC-ND-4.0-text": "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
        "that the above copyright notice and this permission notice appear in all copies."
    ),
    "BSD-2-Clause": "materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE",
    "BSD-2-Clause-notice": "Licensed under the BSD 2-Clause License",
    "BSD-3-Clause": "provided with the distribution. 3. Neither the name of",
    "BSD-3-Clause-text": "provided with the distribution. Neither the name of",
    "BSD-3-Clause-notice": "Licensed under the BSD 3-Clause License",
    "BSD-4-Clause": "All advertising materials mentioning features or use of this software must display the following acknowledgement",
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any "
        "damages arising from the use of this software."
    ),
    "BSL-1.0": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying "
        "documentation covered by this license"
    ),
}

_WORD = re.compile(r"[^\W_]+")


def template_words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def stride_of(n_shingles: int) -> int:
    return 1 << (n_shingles - 1).bit_length()


def minhashes(hashes: np.ndarray) -> np.ndarray:
    """The smallest of the scrambled hashes under each of ``BANDS`` scramblings."""
    salts = mixed(np.arange(1, BANDS + 1, dtype=np.uint64))
    return mixed(hashes[None, :] ^ salts[:, None]).min(1).view(np.int64)


def template_table(spark, templates: dict[str, str]) -> DataFrame:
    """``license, stride, shingles, bands``; words are hashed as those of the texts."""
    words = {name: template_words(text) for name, text in templates.items()}
    short = [name for name, found in words.items() if len(found) < SHINGLE]
    if short or sum(map(len, words.values())) > MOST_TEMPLATE_WORDS:
        raise ValueError(f"templates need {SHINGLE} words each and {MOST_TEMPLATE_WORDS} at most together: {short}")
    given = spark.createDataFrame(list(templates.items()), "license string, text string")
    rows = []
    for row in given.select("license", word_hashes(F.col("text")).alias("w")).collect():
        found = np.array(row.w, np.int64).view(np.uint64)
        unique = np.unique(shingles(found, np.array([len(found)]))[1])
        rows.append((row.license, stride_of(len(unique)), unique.view(np.int64).tolist(), minhashes(unique).tolist()))
    return spark.createDataFrame(rows, "license string, stride int, shingles array<bigint>, bands array<bigint>")


def windows(docs: DataFrame, known: np.ndarray, strides: list[int], key: str, text: str) -> DataFrame:
    """``key, stride, start, shingles, bands`` of the windows that hold a template's shingle; ``shingles`` only those."""

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, lengths = _lists(batch.column(1))
            for first, last in _spans(lengths):
                part = batch.slice(first, last - first)
                words, counts = _lists(part.column(1))
                rows, hashes = shingles(words, counts)
                at = np.searchsorted(known, hashes)
                hit = known[np.minimum(at, len(known) - 1)] == hashes
                out: list[list] = [[] for _ in range(5)]
                for row in np.unique(rows[hit]):
                    a, b = np.searchsorted(rows[: max(0, counts_end(counts))], [row, row + 1])
                    own, own_hit = hashes[a:b], np.flatnonzero(hit[a:b])
                    for stride in strides:
                        for number in np.unique(np.concatenate([own_hit // stride, np.maximum(own_hit // stride - 1, 0)])):
                            start = int(number) * stride
                            inside = own[start : start + 2 * stride]
                            held = np.unique(inside[hit[a:b][start : start + 2 * stride]])
                            for column, value in zip(out, (int(row), stride, start, held.view(np.int64).tolist(), minhashes(inside).tolist()), strict=True):
                                column.append(value)
                longs = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(pa.array(out[0], pa.int64())), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int64()), pa.array(out[3], longs), pa.array(out[4], longs),
                ], names=["key", "stride", "start", "shingles", "bands"])

    def counts_end(counts: np.ndarray) -> int:
        # Texts shorter than a shingle come last and cannot hold a template.
        return int(np.maximum(counts - SHINGLE + 1, 0).sum())

    schema = f"key {docs.schema[key].dataType.simpleString()}, stride int, start bigint, shingles array<bigint>, bands array<bigint>"
    return docs.select(F.col(key).alias("key"), word_hashes(whole_text(text)).alias("words")).mapInArrow(stage, schema)


def scan(docs: DataFrame, templates: dict[str, str] | None = None, containment: float = CONTAINMENT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, license, n_matched, n_template, first_word``: every template that a text holds.

    ``n_matched`` is the most shingles of the template in a window, ``first_word`` where the first
    matching window begins.
    """
    spark = docs.sparkSession
    table = template_table(spark, TEMPLATES if templates is None else templates)
    held = table.collect()
    known = np.unique(np.array([s for row in held for s in row.shingles], np.int64).view(np.uint64))
    found = windows(docs, known, sorted({row.stride for row in held}), key, text)
    bands = table.select("stride", "license", F.posexplode("bands").alias("band", "value"))
    retrieved = (
        found.select("key", "stride", "start", "shingles", F.posexplode("bands").alias("band", "value"))
        .join(F.broadcast(bands), ["stride", "band", "value"]).select("key", "license", "start", "shingles").distinct()
    )
    exact = F.broadcast(table.select("license", F.col("shingles").alias("wanted")))
    matched = F.size(F.array_intersect("shingles", "wanted")).cast("bigint")
    return (
        retrieved.join(exact, "license").select("key", "license", "start", matched.alias("n_matched"), F.size("wanted").cast("bigint").alias("n_template"))
        .filter(F.col("n_matched") >= containment * F.col("n_template"))
        .groupBy(F.col("key").alias(key), "license", "n_template").agg(F.max("n_matched").alias("n_matched"), F.min("start").alias("first_word"))
        .select(key, "license", "n_matched", "n_template", "first_word")
    )
