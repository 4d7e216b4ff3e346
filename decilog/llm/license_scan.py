"""Licences of files: TF-IDF cosine of headers and licence texts to templates, then inheritance by path.

What is compared are windows of one to LINES neighbouring lines, so notices and
sentences that are wrapped over several lines are met whole. A window's terms are weighed
by their rarity over all files; out-of-vocabulary terms only lengthen its vector. A window
can reach the threshold only if it has one of a template's *anchors*: without them the
template's other terms are too light, however the window is made. So only windows with an
anchor are compared. A file without a match takes the licence of the nearest directory
above it that has one.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from decilog.llm.common import Scratch, need

#: Notices by which files name their licence, and sentences of licence texts that no other has.
TEMPLATES = {
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "SPDX-License-Identifier: AGPL-3.0-only", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0", "SPDX-License-Identifier: Apache-2.0", "Apache License Version 2.0, January 2004",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License", "SPDX-License-Identifier: BSD-2-Clause"],
    "BSD-3-Clause": [
        "Licensed under the BSD 3-Clause License", "Use of this source code is governed by a BSD-style license", "SPDX-License-Identifier: BSD-3-Clause",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    ],
    "CC-BY-4.0": ["Licensed under CC BY 4.0", "Licensed under the Creative Commons Attribution 4.0 International License"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0", "Licensed under the Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0", "Licensed under the Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC0-1.0": ["CC0 1.0 Universal", "SPDX-License-Identifier: CC0-1.0"],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", "SPDX-License-Identifier: EPL-2.0"],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2", "SPDX-License-Identifier: GPL-2.0-only", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
        "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3", "SPDX-License-Identifier: GPL-3.0-only", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    ],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "SPDX-License-Identifier: ISC"],
    "LGPL-3.0": ["Licensed under the GNU Lesser General Public License, version 3", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "MIT": [
        "Released under the MIT License", "Licensed under the MIT License", "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0", "Mozilla Public License Version 2.0"],
    "Unlicense": ["This is free and unencumbered software released into the public domain", "SPDX-License-Identifier: Unlicense"],
}
#: Lines of the widest window.
LINES = 5
THRESHOLD = 0.7
TERM = r"[a-z0-9]+(?:\.[0-9]+)*"


def template_terms() -> list[tuple[str, int, str, int]]:
    """(licence, template number, term, occurrences)."""
    rows, number = [], 0
    for name, texts in sorted(TEMPLATES.items()):
        for text in texts:
            terms = re.findall(TERM, text.lower())
            rows += [(name, number, t, terms.count(t)) for t in sorted(set(terms))]
            number += 1
    return rows


def rarity(n_files: float, n_with: float) -> float:
    return math.log((1 + n_files) / (1 + n_with)) + 1


def anchors(weights: dict[int, dict[str, float]], threshold: float) -> set[str]:
    """Terms without which no line reaches ``threshold`` to any template.

    Each template's heaviest terms, until the rest is lighter than ``threshold`` times
    the whole.
    """
    found = set()
    for terms in weights.values():
        left = sum(w * w for w in terms.values())
        whole = left
        for term, w in sorted(terms.items(), key=lambda x: (-x[1], x[0])):
            if left < threshold**2 * whole:
                break
            found.add(term)
            left -= w * w
    return found


def line_terms(line: Column) -> Column:
    return F.regexp_extract_all(F.lower(line), F.lit(f"({TERM})"), 1)


def windows(lines: Column, widths: Iterable[int]) -> Column:
    """Structs (line, width, content) of all runs of ``widths`` lines, joined by spaces."""

    def of_width(w: int) -> Column:
        run = lambda i: F.struct(i.alias("line"), F.lit(w).alias("width"), F.array_join(F.slice(lines, i + 1, F.lit(w)), " ").alias("content"))
        none = F.array().cast("array<struct<line:int,width:int,content:string>>")
        return F.when(F.size(lines) >= w, F.transform(F.sequence(F.lit(0), F.size(lines) - w), run)).otherwise(none)

    return F.flatten(F.array(*map(of_width, widths)))


def word_pattern(words: Iterable[str]) -> str:
    """A regular expression of any of the words, whole and in either case; grouped by the first letter, so few are tried."""
    by: dict[str, list[str]] = {}
    for word in sorted(words):
        by.setdefault(word[0], []).append(re.escape(word[1:]))
    return "(?i)(?<![a-z0-9])(?:" + "|".join(f"{first}(?:{'|'.join(rest)})" for first, rest in by.items()) + ")(?![a-z0-9])"


def match_lines(files: DataFrame, threshold: float, widths: Iterable[int] = (1,), scratch: Scratch | None = None) -> DataFrame:
    """file_id, line, license, score: of the windows that begin at a line the best, with its best template at or above ``threshold``.

    The document counts behind the weights are those of all files. ``scratch`` gets the
    files with an anchor, from which the result is read.
    """
    scratch = scratch or Scratch()
    spark = files.sparkSession
    rows = template_terms()
    vocabulary = sorted({t for _, _, t, _ in rows})
    lowered = files.select(line_terms(F.coalesce("text", F.lit(""))).alias("terms")).select(F.explode(F.array_intersect("terms", F.array(*[F.lit(t) for t in vocabulary]))).alias("term"))
    n_with = {r["term"]: r["n"] for r in lowered.groupBy("term").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each term of the templates
    n_files = files.count()
    idf = {t: rarity(n_files, n_with.get(t, 0)) for t in vocabulary}
    weights: dict[int, dict[str, float]] = {}
    for _, number, term, n in rows:
        weights.setdefault(number, {})[term] = n * idf[term]
    norm = {number: math.sqrt(sum(w * w for w in terms.values())) for number, terms in weights.items()}
    table = spark.createDataFrame([(name, number, t, weights[number][t] / norm[number]) for name, number, t, _ in rows], "license string, template int, term string, unit double")
    rare = spark.createDataFrame([(t, w) for t, w in idf.items()], "term string, idf double")
    unknown = rarity(n_files, 0)
    anchor = word_pattern(anchors(weights, threshold))
    near = scratch.stage(files.where(F.col("text").rlike(anchor)).select("file_id", "text"), "license-near")
    lines = (
        near.select("file_id", F.split("text", "\n").alias("lines"))
        .select("file_id", F.inline(windows(F.col("lines"), widths)))
        .where(F.col("content").rlike(anchor))
    )
    unit = ["file_id", "line", "width"]
    terms = (
        lines.select(*unit, F.explode(line_terms(F.col("content"))).alias("term"))
        .groupBy(*unit, "term").agg(F.count(F.lit(1)).alias("tf"))
        .join(F.broadcast(rare), "term", "left")
        .withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(unknown)))
    )
    length = terms.groupBy(*unit).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = terms.join(F.broadcast(table), "term").groupBy(*unit, "license", "template").agg(F.sum(F.col("w") * F.col("unit")).alias("dot"))
    scored = dots.join(length, unit).select("file_id", "line", "license", F.round(F.col("dot") / F.col("norm"), 6).alias("score")).where(F.col("score") >= threshold)
    return scored.groupBy("file_id", "line").agg(F.max(F.struct("score", "license")).alias("top")).select("file_id", "line", "top.license", "top.score")


def ancestors(path: Column) -> Column:
    """The directories above a path, from the nearest up to the root (empty)."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.size(parts) - 1, F.lit(0), F.lit(-1)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))


def scan(files: DataFrame, threshold: float = THRESHOLD, left: Scratch | None = None) -> DataFrame:
    """One row per file of ``files`` (file_id, path, text).

    file_id, path, own_license, own_score, license, found_in: ``found_in`` is the
    path itself for an own licence, the directory for an inherited one, and null
    with the licence where there is none. A file's own licence is its best window's (ties: the
    later name). A directory's licence is the one that most files directly in it
    name (ties: the first name). Null paths have no directory above them; null and
    empty texts have no licence of their own. File ids name files: rows that repeat one
    share its licence, a row without one has none of its own. An empty table gives no rows;
    other columns are not read.
    """
    files = need(files, "file_id", "path", "text")
    scratch, left = Scratch(), left or Scratch()
    own = match_lines(files, threshold, range(1, LINES + 1), scratch).groupBy("file_id").agg(F.max(F.struct("score", "license")).alias("top"))
    own = left.stage(own.select("file_id", F.col("top.license").alias("own_license"), F.col("top.score").alias("own_score")), "license-own")
    scratch.clear()
    named = files.select("file_id", "path").join(own, "file_id", "left")
    votes = named.where("own_license IS NOT NULL AND path IS NOT NULL").select(F.element_at(ancestors(F.col("path")), 1).alias("dir"), "own_license")
    votes = votes.groupBy("dir", "own_license").agg(F.count(F.lit(1)).alias("n"))
    of_dir = votes.groupBy("dir").agg(F.min_by("own_license", F.struct(-F.col("n"), "own_license")).alias("dir_license"))
    bare = named.where("own_license IS NULL")
    dirs = bare.where("path IS NOT NULL").select(F.element_at(ancestors(F.col("path")), 1).alias("leaf")).distinct()
    up = dirs.select("leaf", F.posexplode(ancestors(F.concat("leaf", F.lit("/x")))).alias("height", "dir"))
    nearest = up.join(of_dir, "dir").groupBy("leaf").agg(F.min_by(F.struct("dir", "dir_license"), "height").alias("near"))
    inherited = bare.withColumn("leaf", F.element_at(ancestors(F.col("path")), 1)).join(nearest, "leaf", "left").select("file_id", "path", "own_license", "own_score", F.col("near.dir_license").alias("license"), F.col("near.dir").alias("found_in"))
    direct = named.where("own_license IS NOT NULL").select("file_id", "path", "own_license", "own_score", F.col("own_license").alias("license"), F.col("path").alias("found_in"))
    return direct.unionByName(inherited)
