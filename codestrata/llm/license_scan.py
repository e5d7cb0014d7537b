"""License scan: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies (DataFrame functions only).

A text that shares no five-word shingle with any template cannot contain one and
is left after one look at its shingles. Of the others, windows of one and a half
template lengths, a half apart, are signed with as many minimum hashes as the
templates need (``bands_needed``: 49 for those that are given); a window that
agrees with a template in any of them is verified. The shortest template, of one
shingle, and a window of four have a similarity of 1/4 if one contains the other,
so that it is missed with a chance of ``0.75 ** 49``; longer ones less often.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Notices and texts of common licenses; a license may have several.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    (
        "Apache-2.0",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
        You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing,
        software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
        See the License for the specific language governing permissions and limitations under the License.""",
    ),
    ("MIT", "Released under the MIT License"),
    (
        "MIT",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"),
        to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense,
        and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
        The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
        FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
        LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS
        IN THE SOFTWARE.""",
    ),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0 International"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0 International"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    (
        "GPL-3.0",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by
        the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""",
    ),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2"),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3"),
    (
        "AGPL-3.0",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by
        the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""",
    ),
    (
        "ISC",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above
        copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD
        TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.""",
    ),
    (
        "Zlib",
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising
        from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter
        it and redistribute it freely, subject to the following restrictions:""",
    ),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
]
WORDS = 5
CONTAINMENT = 0.8
#: The largest chance that a window which contains a template is not retrieved.
MISS = 1e-6


def bands_needed(words: int, containment: float = CONTAINMENT, miss: float = MISS) -> int:
    """Bands of one minimum hash each that leave at most ``miss``, for a template of so many words in a window of one and a half times that."""
    template, window = words - WORDS + 1, max(1, -(-3 * words // 2) - WORDS + 1)
    shared = math.ceil(containment * template)
    alike = shared / (window + template - shared)
    return 1 if alike == 1 else math.ceil(math.log(miss) / math.log(1 - alike))


_TOKEN = "[a-z0-9]+"


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(_TOKEN), F.lit(0))


def _shingles(words: str) -> Column:
    """A 64-bit hash of every five consecutive words."""
    whole = F.slice(words, 1, F.greatest(F.size(words) - (WORDS - 1), F.lit(0)))
    return F.transform(whole, lambda w, i: F.xxhash64(w, *[F.get(F.col(words), i + k) for k in range(1, WORDS)]))


def _signature(shingles: str, bands: int) -> Column:
    """The least hash of the shingles under each of so many seeds."""

    def least(seed: int) -> Column:
        return F.array_min(F.transform(F.col(shingles), lambda s: F.xxhash64(s, F.lit(seed))))

    return F.array(*[least(seed) for seed in range(bands)])


def scan(docs: DataFrame, templates: list[tuple[str, str]] | dict[str, str] = TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """``doc_id, license, first_word, containment``: a row for each license found in each document.

    ``containment`` is the largest share of the template's shingles in one
    window, ``first_word`` the first word of the first window that reaches the
    threshold. Null and empty texts have no rows. Very long texts are scanned
    whole. Rows alike in id and text give one row; of several templates of a
    license the best counts; other columns are ignored; an empty table gives an
    empty result. Templates of fewer than five words cannot be found. One scan of
    the texts; the table of templates is broadcast, never that of documents.
    """
    spark = docs.sparkSession
    known = spark.createDataFrame(list(templates.items() if isinstance(templates, dict) else templates), "license string, notice string").withColumn("words", _words(F.col("notice")))
    known = known.select("license", F.size("words").alias("t_words"), F.array_distinct(_shingles("words")).alias("template")).where(F.size("template") > 0)
    rows = known.collect()
    every = F.array(*[F.lit(s) for s in sorted({s for r in rows for s in r["template"]})]).cast("array<bigint>")
    n_bands = max([bands_needed(r["t_words"], containment) for r in rows], default=1)
    bands = known.withColumn("sign", _signature("template", n_bands)).select("license", "t_words", "template", F.posexplode("sign").alias("t_band", "t_value"))

    words = docs.select("doc_id", F.xxhash64("text").alias("key"), _words(F.col("text")).alias("words"))
    # A generator, not a filter: Spark would push a filter below the words and split the text anew for each of them.
    near = words.select("doc_id", "key", F.explode(F.filter(F.array(_shingles("words")), lambda s: F.arrays_overlap(s, every))).alias("shingles"))

    def windows(span: int) -> Column:
        width, stride = max(1, -(-3 * span // 2) - WORDS + 1), max(1, span // 2)
        starts = F.sequence(F.lit(0), F.size("shingles") - 1, F.lit(stride))
        cut = F.transform(starts, lambda s: F.struct(s.alias("first_word"), F.lit(span).alias("span"), F.slice("shingles", s + 1, F.lit(width)).alias("window")))
        return F.filter(cut, lambda w: F.arrays_overlap(w["window"], every))

    spans = sorted({r["t_words"] for r in rows}) or [WORDS]
    cut = near.select("doc_id", "key", F.explode(F.concat(*[windows(span) for span in spans])).alias("w")).select("doc_id", "key", "w.*")
    signed = cut.select("doc_id", "key", "first_word", "span", "window", F.posexplode(_signature("window", n_bands)).alias("band", "value"))
    met = signed.join(F.broadcast(bands), (F.col("band") == F.col("t_band")) & (F.col("value") == F.col("t_value")) & (F.col("span") == F.col("t_words")))
    share = F.size(F.array_intersect("template", "window")) / F.size("template")
    met = met.withColumn("share", share).where(F.col("share") >= containment)
    return met.groupBy("doc_id", "key", "license").agg(F.min("first_word").cast("long").alias("first_word"), F.max("share").alias("containment")).drop("key")
