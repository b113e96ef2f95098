"""License scans: sparse TF-IDF cosine of headers and licence files to templates, then inheritance from the nearest ancestor directory."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import arrow_batches, map_text, trimmed, written
from .textvec import word_hashes

# What licences and the notices for them say, by SPDX identifier.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT license. See LICENSE file in the project root for full license information.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "SPDX-License-Identifier: MIT",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "GPL-2.0": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or any later version.",
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
        "SPDX-License-Identifier: GPL-2.0-only",
    ),
    "LGPL-3.0": ("Licensed under the GNU Lesser General Public License, version 3.", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "SPDX-License-Identifier: LGPL-3.0-or-later"),
    "AGPL-3.0": ("Licensed under the GNU Affero General Public License, version 3.", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007", "SPDX-License-Identifier: AGPL-3.0-or-later"),
    "BSD-3-Clause": (
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Mozilla Public License Version 2.0", "SPDX-License-Identifier: MPL-2.0"),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC0-1.0": ("Dedicated to the public domain under CC0 1.0 Universal.", "SPDX-License-Identifier: CC0-1.0"),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
}
SPANS = (1, 2, 4, 8, 16)  # lines that are compared together
LICENCE_NAME = re.compile(r"(?:^|/)(?:un)?licen[cs]e(?:s)?(?:[.-][^/]*)?\Z|(?:^|/)copying(?:[.-][^/]*)?\Z|(?:^|/)notice(?:[.-][^/]*)?\Z", re.I)


class Matcher:
    """The templates as sparse TF-IDF vectors. Words that no template has weigh as much as the rarest."""

    def __init__(self, templates: dict[str, tuple[str, ...]]) -> None:
        self.names = [k for k in sorted(templates) for _ in templates[k]]
        h, at = word_hashes([t for k in sorted(templates) for t in templates[k]])
        self.words = [h[i:j] for i, j in zip(at[:-1], at[1:], strict=True)]
        self.vocabulary = np.unique(h)

    def weigh(self, df: np.ndarray, lines: int) -> None:
        """df: in how many of the lines each word of the vocabulary occurs."""
        self.idf = np.log((1 + lines) / (1 + df)) + 1e-6
        self.unknown = float(np.log(1 + lines)) + 1e-6
        vectors = np.zeros((len(self.names), len(self.vocabulary)))
        for k, w in enumerate(self.words):
            np.add.at(vectors[k], np.searchsorted(self.vocabulary, w), 1)
        vectors *= self.idf
        self.vectors = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """Each word's number in the vocabulary, -1 for others."""
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at, -1)

    def cosine(self, hashes: np.ndarray) -> tuple[float, int]:
        at = self.places(hashes)
        bag = np.bincount(at[at >= 0], minlength=len(self.vocabulary)) * self.idf
        _, other = np.unique(hashes[at < 0], return_counts=True)
        norm = float(np.sqrt((bag * bag).sum() + (other.astype(float) ** 2).sum() * self.unknown**2))
        if norm == 0:
            return 0.0, -1
        near = self.vectors @ bag / norm
        k = int(near.argmax())
        return min(1.0, float(near[k])), k

    def reaching(self, hashes: np.ndarray, offsets: np.ndarray, least: float) -> Iterator[tuple[int, int, float]]:
        """(first line, line behind the last, bound) of the runs whose cosine may be ``least`` or more. The bound takes unknown words as all different: with repeats the cosine is lower."""
        n, size = len(offsets) - 1, len(self.vocabulary)
        at = self.places(hashes)
        for start in range(0, n, 2048):  # long texts in pieces
            stop = min(n, start + 2048)
            end = min(n, stop + SPANS[-1] - 1)
            line = np.searchsorted(offsets, np.arange(offsets[start], offsets[end]), "right") - start
            counts = np.zeros((end - start + 1, size + 1))
            np.add.at(counts, (line, at[offsets[start] : offsets[end]]), 1)  # -1, the last column: unknown words
            counts = np.cumsum(counts, axis=0)
            lo = np.arange(stop - start)
            bounds = np.zeros((len(lo), len(SPANS)))
            for k, span in enumerate(SPANS):
                run = counts[np.minimum(lo + span, end - start)] - counts[lo]
                bag = run[:, :-1] * self.idf
                norm = np.sqrt((bag * bag).sum(axis=1) + run[:, -1] * self.unknown**2)
                bounds[:, k] = (bag @ self.vectors.T).max(axis=1) / np.where(norm > 0, norm, 1)
            for i, k in np.argwhere(bounds >= least - 1e-9).tolist():
                if k == 0 or i + start + SPANS[k - 1] < n:  # else a shorter span has the same lines
                    yield i + start, min(n, i + start + SPANS[k]), float(bounds[i, k])

    def best(self, texts: list, least: float) -> tuple[list, list, list]:
        """For each whole text the best licence of any run of lines (None if no run's cosine is ``least``), its cosine, and the share of the text's words in that run.

        Texts are skipped only where no run can reach ``least``, however frequent its words are: a cosine is at most the norm of that part of the template's vector whose words the text has.
        """
        hashes, offsets = word_hashes(texts)
        at = self.places(hashes)
        known = np.flatnonzero(at >= 0)
        held = np.zeros((len(texts), len(self.vocabulary)))
        held[np.searchsorted(offsets, known, "right") - 1, at[known]] = 1
        part = held @ (self.vectors**2).T
        names: list = [None] * len(texts)
        scores = [0.0] * len(texts)
        shares = [0.0] * len(texts)
        for i in np.flatnonzero((part >= least * least - 1e-9).any(axis=1)):
            h, o = word_hashes(texts[i].split("\n"))
            for lo, hi, bound in self.reaching(h, o, least):
                if bound < scores[i] - 1e-9:
                    continue
                score, k = self.cosine(h[o[lo] : o[hi]])
                if score >= least and score > scores[i] + 1e-12:
                    names[i], scores[i], shares[i] = self.names[k], score, float((o[hi] - o[lo]) / max(1, o[-1]))
                    if score == 1:
                        break
        return names, scores, shares


def line_frequencies(files: DataFrame, text: str, matcher: Matcher) -> tuple[np.ndarray, int]:
    """In how many lines of all files each template word occurs, and the number of lines."""
    vocabulary = matcher.vocabulary

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(len(vocabulary), np.int64)
        total = 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 100):
                lines = [x for t in batch.column(0).slice(lo, 100).to_pylist() if t for x in t.split("\n")]
                total += len(lines)
                h, at = word_hashes(lines)
                place = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
                known = np.flatnonzero(vocabulary[place] == h)
                line = np.searchsorted(at, known, "right") - 1
                found += np.bincount(np.unique(line * len(vocabulary) + place[known]) % len(vocabulary), minlength=len(vocabulary))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(vocabulary))), pa.array(np.concatenate(([total], found)))], ["w", "n"])

    sums = files.select(text).mapInArrow(trimmed(count), "w long, n long").groupBy("w").agg(F.sum("n").alias("n")).toArrow()
    w, n = sums["w"].to_numpy(), sums["n"].to_numpy()
    df = np.zeros(len(vocabulary))
    df[w[w >= 0]] = n[w >= 0]
    return df, int(n[w < 0].sum())


def scan(files: DataFrame, *, key: str = "doc_id", path: str = "path", text: str = "text", templates: dict[str, tuple[str, ...]] | None = None, least: float = 0.75, whole: float = 0.5) -> DataFrame:
    """(key, path, license, score, origin, from_dir) for every row of files.

    origin is ``own`` if a run of the file's lines has a cosine of ``least`` or more with a template; else ``inherited`` if the file's directory or an ancestor holds a licence
    file (the nearest counts); else ``none``, with a null license. score is the cosine, the licence file's where inherited. A file speaks for its directory if its name is that of a licence file or
    if ``whole`` of its words belong to the matched lines; of several, the one with the highest score, then the first license by name. Null or empty paths are in the root ""; null and empty texts
    have no license of their own. Repeated rows stay; columns besides these go; an empty table gives none.
    IDF counts the lines of all files and only weighs words: runs begin at any line, however common its words are. Directories, not files, look their ancestors up, so no ancestor meets all files below it.
    """
    spark = files.sparkSession
    arrow_batches(spark)
    matcher = Matcher(templates or TEMPLATES)
    matcher.weigh(*line_frequencies(files, text, matcher))
    sent = spark.sparkContext.broadcast(matcher)
    kinds = dict(files.dtypes)

    def match(texts: list) -> dict:
        names, scores, shares = sent.value.best(texts, least)
        return {"license": names, "score": scores, "share": shares}

    where = F.regexp_replace(F.coalesce(F.col(path), F.lit("")), r"^/+|/+$", "")
    src = files.select(F.col(key), where.alias("path"), F.col(text).alias("text"))
    found = map_text(src, match, f"`{key}` {kinds[key]}, path string, license string, score double, share double", keep=[key, "path"], text="text")
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    own = F.col("score") >= least
    found = written(found.select(key, "path", folder.alias("dir"), F.when(own, F.col("license")).alias("own"), F.when(own, F.col("score")).alias("score"), (own & ((F.col("share") >= whole) | F.col("path").rlike(LICENCE_NAME.pattern.replace(r"\Z", "$").join(("(?i)(?:", ")"))))).alias("speaks")), "license-own")
    speakers = written(found.where("speaks").groupBy("dir").agg(F.min(F.struct((-F.col("score")).alias("minus"), F.col("own").alias("license"))).alias("m")).select("dir", F.col("m.license").alias("license"), (-F.col("m.minus")).alias("score")), "license-dirs")
    dirs = found.select("dir").distinct()  # neither they nor their ancestors are written: with local storage each part file costs the executor a process
    steps = F.filter(F.split("dir", "/"), lambda x: x != "")
    above = F.transform(F.sequence(F.lit(0), F.size(steps)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(steps, F.lit(1), n), "/").alias("at")))
    ancestors = dirs.select("dir", F.explode(above).alias("a")).select("dir", "a.depth", F.col("a.at").alias("at"))
    met = ancestors.join(speakers.withColumnRenamed("dir", "at"), "at")
    nearest = written(met.groupBy("dir").agg(F.max(F.struct("depth", "at", "license", "score")).alias("m")).select("dir", F.col("m.at").alias("from_dir"), F.col("m.license").alias("inherited"), F.col("m.score").alias("their")), "nearest")
    joined = found.join(nearest, "dir", "left")
    return joined.select(
        key,
        "path",
        F.coalesce("own", "inherited").alias("license"),
        F.when(F.col("own").isNotNull(), F.col("score")).otherwise(F.coalesce("their", F.lit(0.0))).alias("score"),
        F.when(F.col("own").isNotNull(), "own").when(F.col("inherited").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(F.col("own").isNull(), F.col("from_dir")).alias("from_dir"),
    )
