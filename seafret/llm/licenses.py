"""Licences of files: TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

Units of a file are compared with all templates as sparse TF-IDF vectors: its lines, all runs of words as long as a template
in blocks of neighbouring lines (sentences inside a line, notices broken over lines), and every licence file as a whole; document
frequencies count the lines of all files, for all terms. A file with a matching unit has that licence. A file whose name is that of
a licence file, or whose lines are covered by matches by half at least, gives its licence to its directory. A file without a licence
of its own takes that of the nearest directory above it that has one.

Weights: log(1 + lines / (1 + lines with the term)) times the term's count. Units that miss the cosine even with the least weights for
their other terms are left out before those terms are looked up.
A sentence that several licences share names only their family (BSD), clauses elsewhere in the file tell the variant (BSD-2-Clause,
GPL-2.0-or-later). The numbers of a template, and an identifier as a whole, must be in a unit that matches it.
The best match decides, of equal ones that of the earlier line, then the licence whose name comes first.
Null or empty texts have no licence of their own; a null path has no directory and inherits nothing. Files repeated whole repeat
their result; of several licence files of one directory the best match decides. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from seafret.llm.common import attach, text_of, written

# Short notices by licence. A name that starts with = is the title of a full text, one with + a clause that several
# licences share or that tells their variants apart; a clause alone names no licence (see VARIANTS).
TEMPLATES = {
    "AGPL-3.0": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "Licensed under the GNU Affero General Public License.",
        "under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: AGPL-3.0",
    ],
    "=AGPL-3.0": ["GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"],
    "AGPL-3.0-or-later": ["SPDX-License-Identifier: AGPL-3.0-or-later"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Apache License Version 2.0, January 2004", "SPDX-License-Identifier: Apache-2.0"],
    "BSD": ["Redistribution and use in source and binary forms, with or without modification, are permitted."],
    "+bsd-2": [
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
        "in the documentation and/or other materials provided with the distribution.",
    ],
    "+bsd-3": [
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived "
        "from this software without specific prior written permission.",
    ],
    "+bsd-4": ["All advertising materials mentioning features or use of this software must display the following acknowledgement"],
    "BSD-2-Clause": ["SPDX-License-Identifier: BSD-2-Clause"],
    "BSD-3-Clause": ["SPDX-License-Identifier: BSD-3-Clause"],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0.", "SPDX-License-Identifier: BSL-1.0"],
    "CC0-1.0": [
        "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide.",
        "CC0 1.0 Universal",
        "SPDX-License-Identifier: CC0-1.0",
    ],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "EPL-2.0": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
        "SPDX-License-Identifier: EPL-2.0",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
        "that the above copyright notice and this permission notice appear in all copies.",
        "SPDX-License-Identifier: ISC",
    ],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: Unlicense"],
    "Zlib": [
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "SPDX-License-Identifier: Zlib",
    ],
    "+later-2": ["either version 2 of the License, or (at your option) any later version"],
    "+later-2.1": ["either version 2.1 of the License, or (at your option) any later version"],
    "+later-3": ["either version 3 of the License, or (at your option) any later version"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 License."],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "under the terms of the GNU General Public License version 2 as published by the Free Software Foundation",
        "SPDX-License-Identifier: GPL-2.0",
    ],
    "=GPL-2.0": ["GNU GENERAL PUBLIC LICENSE Version 2, June 1991"],
    "GPL-2.0-or-later": ["SPDX-License-Identifier: GPL-2.0-or-later"],
    "=GPL-3.0": ["GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "GPL-3.0-or-later": ["SPDX-License-Identifier: GPL-3.0-or-later"],
    "=LGPL-2.1": ["GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"],
    "=LGPL-3.0": ["GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "LGPL-2.1-or-later": ["SPDX-License-Identifier: LGPL-2.1-or-later"],
    "LGPL-3.0-or-later": ["SPDX-License-Identifier: LGPL-3.0-or-later"],
    "GPL-3.0": [
        "Licensed under the GNU General Public License.",
        "under the terms of the GNU General Public License as published by the Free Software Foundation",
        "under the terms of the GNU General Public License as published by",
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License.",
        "SPDX-License-Identifier: GPL-3.0",
    ],
    "LGPL-3.0": [
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "Licensed under the GNU Lesser General Public License.",
        "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "under the terms of the GNU Lesser General Public License as published by",
        "SPDX-License-Identifier: LGPL-3.0",
    ],
    "MIT": [
        "Licensed under the MIT License.",
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software.",
        "SPDX-License-Identifier: MIT",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "Proprietary": ["All rights reserved."],
}
# What a licence (or family) becomes by a clause of the same file, the first that is there.
VARIANTS = {
    "BSD": (("+bsd-4", "BSD-4-Clause"), ("+bsd-3", "BSD-3-Clause"), ("+bsd-2", "BSD-2-Clause")),
    "AGPL-3.0": (("+later-3", "AGPL-3.0-or-later"),),
    "GPL-3.0": (("+later-3", "GPL-3.0-or-later"), ("+later-2", "GPL-2.0-or-later")),
    "LGPL-3.0": (("+later-3", "LGPL-3.0-or-later"), ("+later-2.1", "LGPL-2.1-or-later"), ("+later-2", "LGPL-2.0-or-later")),
}
LICENSE_FILE = re.compile(r"(?:^|/)(?:licen[cs]e|copying|notice)(?:[.-][a-z]+)?$", re.I)
TERM = re.compile(r"[a-z0-9]+")
#: Least cosine of a match.
COSINE = 0.7


def terms(line: str) -> list[str]:
    return TERM.findall(line.lower())


class Matcher:
    def __init__(self, templates: dict[str, list[str]], lines: int = 0, frequency: dict[str, int] | None = None, least: float = COSINE):
        self.lines, self.frequency, self.least = lines, frequency or {}, least
        self.vocabulary = {t for notices in templates.values() for n in notices for t in terms(n)}
        self.unseen = self.weight(0)
        self.floor = self.weight(self.lines)
        self.templates = []
        self.words: list[list[str]] = []
        # numbers of a template, and all words of an identifier, must be there: they are what tells versions and names apart
        self.needed: list[frozenset[str]] = []
        self.anchors: dict[str, list[int]] = {}
        self.by_term: dict[str, list[tuple[int, float]]] = {}
        for name in sorted(templates):
            for notice in templates[name]:
                vector, norm = self.vector(Counter(terms(notice)))
                for t, w in vector.items():
                    self.by_term.setdefault(t, []).append((len(self.templates), w / norm))
                # a match has one of the terms without which the template falls short
                left = 1.0
                for t, w in sorted(vector.items(), key=lambda x: (-x[1], x[0])):
                    if left < least * least:
                        break
                    self.anchors.setdefault(t, []).append(len(self.templates))
                    left -= (w / norm) ** 2
                self.templates.append(name)
                self.words.append(terms(notice))
                self.needed.append(frozenset(t for t in terms(notice) if t.isdigit() or notice.startswith("SPDX")))

    def weight(self, frequency: int) -> float:
        return math.log(1 + max(self.lines, 1) / (1 + frequency))

    def vector(self, counts: Counter, others: dict[str, int] | None = None, other: float | None = None) -> tuple[dict[str, float], float]:
        """Weights of terms and their norm; `others` has the frequencies of terms of no template, else each weighs `other`."""
        other = self.unseen if other is None else other

        def weight(t: str) -> float:
            if t in self.vocabulary:
                return self.weight(self.frequency.get(t, 0))
            return other if others is None else self.weight(others.get(t, 0))

        v = {t: n * weight(t) for t, n in counts.items()}
        return v, math.sqrt(sum(w * w for w in v.values()))

    def best(self, vector: dict[str, float], norm: float) -> tuple[str | None, float]:
        scores: dict[int, float] = {}
        for t, w in vector.items():
            for k, share in self.by_term.get(t, ()):
                scores[k] = scores.get(k, 0.0) + w * share / norm
        scores = {k: x for k, x in scores.items() if self.needed[k] <= vector.keys()}
        if not scores:
            return None, 0.0
        k = max(sorted(scores), key=lambda i: round(scores[i], 9))
        return self.templates[k], scores[k]

    def match(self, line: str, least: float = COSINE, others: dict[str, int] | None = None) -> tuple[str | None, float]:
        """Best licence of a line and its cosine."""
        name, score = self.best(*self.vector(Counter(terms(line)), others))
        return (name, min(score, 1.0)) if name and score >= least else (None, score)

    def possible(self, words: list[str]) -> bool:
        return self.best(*self.vector(Counter(words), None, self.floor))[1] >= self.least - 1e-9

    def units(self, text: str, whole: bool) -> tuple[int, dict[str, set[int]]]:
        """Number of lines, and the units of a text that may match with the lines they cover by half at least; `whole` adds all of it."""
        found: dict[str, set[int]] = {}
        n, words, at, hits = 0, [], [], []

        def block() -> None:
            size = Counter(at)
            start = {k: i for i, k in reversed(list(enumerate(at)))}
            spans = {(start[at[p]], start[at[p]] + size[at[p]]) for p in hits}
            for p in hits:
                for k in self.anchors[words[p]]:
                    m = min(len(self.words[k]), len(words))
                    for i in range(max(0, p - m + 1), min(p, len(words) - m) + 1):
                        j = i + m
                        # other words at the ends only lower the cosine
                        while words[i] not in self.words[k]:
                            i += 1
                        while words[j - 1] not in self.words[k]:
                            j -= 1
                        spans.add((i, j))
            for i, j in spans:
                if self.possible(words[i:j]):
                    covered = found.setdefault(" ".join(words[i:j]), set())
                    covered |= {k for k, c in Counter(at[i:j]).items() if 2 * c >= size[k]}

        for line in [*text.split("\n"), ""]:
            if line.strip():
                mine = terms(line)
                hits += [len(words) + i for i, t in enumerate(mine) if t in self.anchors]
                words += mine
                at += [n] * len(mine)
                n += 1
            else:
                if hits:
                    block()
                words, at, hits = [], [], []
        if whole:
            mine = terms(text)
            if not self.anchors.keys().isdisjoint(mine) and self.possible(mine):
                found.setdefault(" ".join(mine), set())
        return n, found


def frequencies(files: DataFrame) -> DataFrame:
    """term, n: number of lines of all files that have the term; the empty term counts all lines."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen.keys()), pa.string()), pa.array(list(seen.values()), pa.int64())], ["term", "n"])

        for batch in batches:
            for text in batch.column(0):
                for line in text.as_py().split("\n"):
                    if line.strip():
                        seen[""] += 1
                        seen.update(set(terms(line)))
            if len(seen) > 100_000:
                yield told()
                seen.clear()
        yield told()

    return files.select(text_of().alias("text")).mapInArrow(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def matched(units: DataFrame, frequency: DataFrame, matcher: Matcher, least: float) -> DataFrame:
    """unit, n, name, score of the units that match; frequencies of their terms come by join."""
    words = units.select("unit", F.explode(F.array_distinct(F.split("unit", " "))).alias("term"))
    words = written(words.filter(~F.col("term").isin(sorted(matcher.vocabulary))), "license-words")
    sizes = words.groupBy("term").agg(F.count(F.lit(1)).alias("size"))
    known = written(sizes.join(frequency.withColumnRenamed("n", "lines"), "term"), "license-known")
    each = attach(words, known, "term", "size").groupBy("unit").agg(F.collect_list("term").alias("terms"), F.collect_list("lines").alias("lines"))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = []
            for unit, names, lines in zip(batch.column(0), batch.column(2), batch.column(3)):
                got.append(matcher.match(unit.as_py(), least, dict(zip(names.as_py() or [], lines.as_py() or []))))
            found = [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *found], ["unit", "n", "name", "score"])

    joined = units.join(each, "unit", "left").select("unit", "n", "terms", "lines")
    return joined.mapInArrow(decide, "unit string, n long, name string, score double").filter(F.col("name").isNotNull())


def variant(name: Column, names: Column) -> Column:
    """The licence meant by the best match of a file, given all names and clauses found in it."""
    out = F.regexp_replace(name, "^=", "")
    for family, clauses in VARIANTS.items():
        chosen = F.coalesce(*[F.when(F.array_contains(names, clause), F.lit(meant)) for clause, meant in clauses], F.lit(family))
        out = F.when(name == family, chosen).otherwise(out)
    return out


def scan(files: DataFrame, templates: dict[str, list[str]] = TEMPLATES, least: float = COSINE) -> DataFrame:
    """doc_id, path, license, cosine, origin (own, inherited, none), license_dir of every file (doc_id, path, text)."""
    frequency = written(frequencies(files), "license-terms")
    known = {r.term: r.n for r in frequency.filter(F.col("term").isin(["", *sorted(Matcher(templates).vocabulary)])).collect()}
    matcher = Matcher(templates, known.pop("", 0), known, least)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            named = [bool(p.as_py() and LICENSE_FILE.search(p.as_py())) for p in batch.column(1)]
            got = [matcher.units(t.as_py(), n) for t, n in zip(batch.column(2), named)]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:2],
                    pa.array(named, pa.bool_()),
                    pa.array([n for n, _ in got], pa.int64()),
                    pa.array([list(u) for _, u in got], pa.list_(pa.string())),
                    pa.array([[sorted(c) for c in u.values()] for _, u in got], pa.list_(pa.list_(pa.int64()))),
                ],
                ["doc_id", "path", "named", "lines", "units", "covers"],
            )

    read = files.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("path").cast("string").alias("path"), text_of().alias("text"))
    kinds = "doc_id long, path string, named boolean, lines long, units array<string>, covers array<array<long>>"
    found = written(read.mapInArrow(own, kinds).withColumn("file", F.monotonically_increasing_id()), "license-files")
    each = found.select("file", F.explode(F.arrays_zip("units", "covers")).alias("u")).select("file", "u.units", "u.covers")
    each = each.withColumnsRenamed({"units": "unit", "covers": "cover"})
    units = written(each.groupBy("unit").agg(F.count(F.lit(1)).alias("n")), "license-units")
    hits = attach(each, written(matched(units, frequency, matcher, least), "license-matched"), "unit", "n").filter(F.col("name").isNotNull())
    rank = F.struct(F.size("cover") == 0, -F.round("score", 9), F.array_min("cover"), F.col("name").alias("name"), F.col("score").alias("score"))
    rank = F.when(~F.col("name").startswith("+"), rank)
    decided = hits.groupBy("file").agg(F.min(rank).alias("best"), F.collect_set("name").alias("names"), F.size(F.array_distinct(F.flatten(F.collect_list("cover")))).alias("covered"))
    stands = F.col("best").isNotNull() & (F.col("named") | (F.col("covered") >= F.col("lines")))
    found = found.drop("units", "covers").join(decided, "file", "left").select(
        "doc_id", "path", variant(F.col("best.name"), F.col("names")).alias("license"), F.coalesce("best.score", F.lit(0.0)).alias("cosine"), stands.alias("stands")
    )
    directory = F.regexp_replace("path", "/?[^/]*$", "")
    found = written(found.withColumn("dir", directory), "licenses")
    # one row per directory from here on
    smallest = F.min("license").alias("license")
    top = found.filter("stands and dir is not null").groupBy("dir", "license").agg(F.max("cosine").alias("cosine"))
    most = top.groupBy("dir").agg(F.max("cosine").alias("most"))
    given = top.join(most, "dir").filter(F.col("cosine") >= F.col("most")).groupBy("dir").agg(smallest)
    given = written(given.select(F.col("dir").alias("above"), F.col("license").alias("inherited")), "license-dirs")
    dirs = written(found.filter("dir is not null").groupBy("dir").agg(F.count(F.lit(1)).alias("n")), "dirs")
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    paths = dirs.select("dir", F.explode(F.array_distinct(above)).alias("above")).withColumn("depth", F.length("above"))
    size = paths.groupBy("above").agg(F.count(F.lit(1)).alias("dirs"))
    sized = written(given.join(size, "above").select("above", "inherited", "dirs"), "license-above")
    met = attach(paths, sized, "above", "dirs").filter(F.col("inherited").isNotNull())
    nearest = met.groupBy("dir").agg(F.max(F.struct("depth", F.col("above").alias("license_dir"), "inherited")).alias("m"))
    nearest = written(nearest.join(dirs, "dir").select("dir", "m.license_dir", "m.inherited", "n"), "license-nearest")
    told = attach(found, nearest, "dir", "n")
    mine = F.col("license").isNotNull()
    return told.select(
        "doc_id",
        "path",
        F.coalesce("license", "inherited").alias("license"),
        F.when(mine, F.col("cosine")).alias("cosine"),
        F.when(mine, "own").when(F.col("inherited").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(~mine, F.col("license_dir")).alias("license_dir"),
    )
