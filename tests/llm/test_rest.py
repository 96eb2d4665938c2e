"""Licences, token counts, line dedup, toxicity."""

import random
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer, models, pre_tokenizers

from frames import empty, messy, rows
from seafret.llm import licenses, line_dedup, toxicity, unigram_counts

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def library(pieces):
    vocab = [("<unk>", 0.0), *pieces]
    t = Tokenizer(models.Unigram(vocab, unk_id=0))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always")
    return t


SMALL = [("▁", -3.0), ("a", -2.0), ("b", -2.5), ("ab", -4.5), ("▁a", -5.0), ("ba", -4.5), ("aab", -6.5), ("▁ab", -6.0), ("c▁", -1.0), ("bb", -5.0)]


@pytest.mark.parametrize("pieces", [SMALL, None])
def test_counts_equal_the_library(pieces):
    pieces = pieces or unigram_counts.vocabulary(PIECES)
    lib, mine = library(pieces), unigram_counts.UnigramCounter(pieces)
    rng = random.Random(6)
    texts = ["", " ", "a", "  a  b", "▁a", "xyz", "a x b", "aaabbbabab", "日本 語a", "a\nb\tc"]
    texts += ["".join(rng.choice("aab bx ▁c") for _ in range(rng.randint(0, 40))) for _ in range(400)]
    texts += ["".join(rng.choice("the quick brown fox é日 ") for _ in range(60)) for _ in range(100)]
    for t in texts:
        assert mine.count(t) == len(lib.encode(t, add_special_tokens=False).ids), repr(t)


def test_count_frame(spark):
    mine = unigram_counts.UnigramCounter(unigram_counts.vocabulary(PIECES))
    got = unigram_counts.token_counts(messy(spark), PIECES).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in got) == sorted((str(i), mine.count(t or "")) for i, t, *_ in rows())
    assert unigram_counts.token_counts(empty(spark), PIECES).count() == 0


def test_line_dedup_against_brute_force(spark):
    rng = random.Random(7)
    data = []
    for i in range(120):
        lines = [f"own {i} {k}" for k in range(3)] + [f"shared {j}" for j in range(9) if rng.random() < (j + 1) / 10] + [""]
        rng.shuffle(lines)
        data.append((i, "\n".join(lines), f"s{rng.randint(0, j)}" if (j := i % 12) else None))
    data += [(None, "shared 8\nx", "s1"), (500, None, "s2"), (501, "", "s2"), (7, data[7][1], data[7][2])]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string").repartition(5)
    sites = defaultdict(set)
    for _, text, source in data:
        for line in (text or "").split("\n"):
            if source is not None and line:
                sites[line].add(source)
    for least in (2, 5, 9):
        bad = {line for line, s in sites.items() if len(s) >= least}
        got = sorted((str(r.doc_id), str(r.text), r.n_lines, r.n_removed) for r in line_dedup.remove(docs, min_sites=least).collect())
        want = []
        for i, text, _ in data:
            lines = text.split("\n") if text is not None else []
            kept = [x for x in lines if x not in bad]
            want.append((str(i), str("\n".join(kept) if text is not None else None), len(lines), len(lines) - len(kept)))
        assert got == sorted(want)


def test_line_dedup_messy(spark):
    got = line_dedup.remove(messy(spark), min_sites=3)
    assert got.count() == len(rows())
    assert line_dedup.remove(empty(spark)).count() == 0


def test_spread_beyond_the_exact_band(spark):
    docs = spark.range(6000).selectExpr("id as doc_id", "concat('s', id % 700) as source", "concat('everywhere\nonly ', id % 40, '\nrow ', id) as text")
    got = {r.n: r.spread for r in line_dedup.boilerplate(docs, min_sites=30).collect()}
    assert set(got) == {6000, 150}
    assert abs(got[6000] - 700) < 40 and got[150] == 35


def test_licenses(spark):
    files = [
        (1, "repo/LICENSE", "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software."),
        (2, "repo/src/a.py", "some code\nmore code"),
        (3, "repo/src/b.py", "# Licensed under the Apache License, Version 2.0.\ncode"),
        (4, "repo/src/vendor/COPYING.txt", "This work is licensed under the GNU General Public License, version 3."),
        (5, "repo/src/vendor/deep/er/c.py", "code"),
        (6, "other/d.py", "the state of the art is free software for any person"),
        (7, None, "All rights reserved."),
        (8, None, None),
        (9, "repo/e.py", ""),
        (10, "notice-only/x.txt", "All rights reserved."),
        (11, "notice-only/y.txt", "text"),
        (11, "notice-only/y.txt", "text"),
        (None, "top.py", "Licensed under CC BY-NC 4.0.\ncode"),
    ] + [(100 + i, f"repo/src/many/{i}.py", f"line {i} of the code is here") for i in range(300)]
    docs = spark.createDataFrame(files, "doc_id long, path string, text string").selectExpr("*", "'x' as dir", "'y' as license")
    got = licenses.scan(docs).collect()
    assert len(got) == len(files)
    found = {r.doc_id: (r.license, r.origin, r.license_dir) for r in got}
    assert found[1] == ("MIT", "own", None)
    assert found[2] == ("MIT", "inherited", "repo")
    assert found[3] == ("Apache-2.0", "own", None)
    assert found[5] == ("GPL-3.0", "inherited", "repo/src/vendor")
    assert found[6] == (None, "none", None)
    assert found[7] == ("Proprietary", "own", None)
    assert found[8] == (None, "none", None)
    assert found[9] == ("MIT", "inherited", "repo")
    assert found[11] == ("Proprietary", "inherited", "notice-only")
    assert found[None] == ("CC-BY-NC-4.0", "own", None)
    assert found[399] == ("MIT", "inherited", "repo")
    assert all(r.cosine is None or 0.7 <= r.cosine <= 1 for r in got)
    assert licenses.scan(docs.limit(0)).count() == 0


def test_notices_with_other_words_and_over_lines(spark):
    notices = {
        "Proprietary": ["Copyright 2024 Example Corp. All rights reserved."],
        "MIT": ["Copyright (c) 2020 Jane Doe. Released under the MIT License.", "Licensed under the MIT license."],
        "Apache-2.0": ["This file is part of Foo and is licensed under the Apache License, Version 2.0; see LICENSE.", "# Licensed under the\n# Apache License,\n# Version 2.0"],
        "GPL-3.0": ["it under the terms of the GNU General Public License as published by", "you can redistribute it\nunder the terms of the GNU\nGeneral Public License as published by\nus"],
        "LGPL-3.0": ["Licensed under the GNU Lesser General Public License."],
    }
    files = [(f"{k}/{i}.py", f"code of file {i}\n\n{n}\nmore code {i}", k) for k, ns in notices.items() for i, n in enumerate(ns)]
    files += [(f"n/{i}.py", f"line {i} of the code is under the rights of all", None) for i in range(300)]
    docs = spark.createDataFrame([(i, p, t) for i, (p, t, _) in enumerate(files)], "doc_id long, path string, text string")
    found = {r.path: r.license for r in licenses.scan(docs).collect()}
    assert found == {p: k for p, _, k in files}


REST = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED"
BSD = """Copyright (c) 2021, Jane Doe

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD3 = """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
HEADER = """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU {} Public License as published by
the Free Software Foundation; either version {} of the License, or
(at your option) any later version.
"""
MIT_TEXT = """MIT License

Copyright (c) 2020 Jane Doe

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:
"""
ISC_TEXT = """Copyright (c) 2020, Jane Doe

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.
"""
APACHE_TEXT = """                                 Apache License
                           Version 2.0, January 2004
                        http://www.apache.org/licenses/

   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION
"""
FULL = [
    ("BSD-2-Clause", BSD + REST), ("BSD-3-Clause", BSD + BSD3 + REST), ("ISC", ISC_TEXT + REST), ("MIT", MIT_TEXT), ("Apache-2.0", APACHE_TEXT),
    ("GPL-2.0-or-later", HEADER.format("General", "2")), ("GPL-3.0-or-later", HEADER.format("General", "3")),
    ("LGPL-2.1-or-later", HEADER.format("Lesser General", "2.1")), ("AGPL-3.0-or-later", HEADER.format("Affero General", "3")),
    ("Unlicense", "This is free and unencumbered software released into the public domain.\n"),
    ("GPL-3.0", "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n" + HEADER.format("General", "3")),
    ("GPL-2.0", "                    GNU GENERAL PUBLIC LICENSE\n                       Version 2, June 1991\n\n" + HEADER.format("General", "2")),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted."),
    (None, "SPDX-License-Identifier: WTFPL"), (None, "either version 2 of the License, or (at your option) any later version"),
    (None, "the terms of the agreement are published by the foundation for any later version of the text"),
]


def test_full_texts_and_headers_are_told_apart(spark):
    """Confusion of planted texts, each as a licence file and as a commented header of code: nothing off the diagonal."""
    rows, want = [], {}
    for i, (name, text) in enumerate(FULL):
        rows += [(f"r{i}/LICENSE", text), (f"r{i}/src/deep/code.c", f"int f{i};"), (f"h{i}/x.py", "\n".join(f"# {x}" for x in text.split("\n")) + f"\n\ncode {i}\nmore\nlines\n" * 9)]
        want |= {f"r{i}/LICENSE": name, f"r{i}/src/deep/code.c": name, f"h{i}/x.py": name}
    rows += [(f"n/{i}.py", f"line {i} of the code\n\nis under the rights of all users {i % 7}") for i in range(300)]
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, path string, text string")
    found = {r.path: r.license for r in licenses.scan(docs).collect()}
    assert {p: found[p] for p in want} == want
    assert all(found[p] is None for p in found if p.startswith("n/"))


def test_inheritance_against_brute_force(spark):
    r = random.Random(9)
    paths = ["/".join(r.choice("abc") for _ in range(r.randrange(0, 5))) for _ in range(150)]
    files = [(i, f"{d}/{'LICENSE' if i % 5 == 0 else f'f{i}.py'}".lstrip("/"), r.choice(["Licensed under the MIT License.", "Licensed under the Apache License, Version 2.0."]) if i % 5 == 0 else "x") for i, d in enumerate(paths)]
    got = {x.doc_id: (x.license, x.license_dir) for x in licenses.scan(spark.createDataFrame(files, "doc_id long, path string, text string")).collect()}
    given = defaultdict(set)
    for i, path, text in files:
        if i % 5 == 0:
            given["/".join(path.split("/")[:-1])].add("MIT" if "MIT" in text else "Apache-2.0")
    for i, path, text in files:
        if i % 5:
            d = path.split("/")[:-1]
            above = next(("/".join(d[:k]) for k in range(len(d), -1, -1) if "/".join(d[:k]) in given), None)
            assert got[i] == ((min(given[above]), above) if above is not None else (None, None))


def test_all_terms_have_frequencies():
    m = licenses.Matcher({"A": ["one two"]}, 100, {"one": 3, "two": 5})
    assert m.match("one two often", 0.0, {"often": 90})[1] > 0.98 > m.match("one two often", 0.0, {"often": 1})[1]


def test_cosine_against_plain_vectors():
    m = licenses.Matcher({"A": ["one two three"], "B": ["two four"]}, 100, {"one": 3, "two": 50, "three": 1, "four": 9})
    vocab = ["one", "two", "three", "four", "zzz", "yyy"]

    def vec(text):
        w = np.array([m.weight(m.frequency.get(t, 0)) if t in m.vocabulary else m.unseen for t in vocab])
        return w * np.array([text.split().count(t) for t in vocab])

    for line in ("one two", "two four zzz", "three three one two", "four zzz yyy"):
        want = max(float(vec(line) @ vec(t) / np.linalg.norm(vec(line)) / np.linalg.norm(vec(t))) for t in ("one two three", "two four"))
        assert m.match(line, 0.0)[1] == pytest.approx(want)


def toxic_corpus(spark, n=900):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    docs, labels = [], []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(5, 80))]
        bad = rng.random() < 0.3
        low = rng.random() < 0.3
        if bad:
            text += rng.sample(["grob", "fies", "gemein"], 2)
        if low:
            text += ["spam"]
        docs.append((i, " ".join(text)))
        labels.append((i, 0 if low else 1, int(bad)))
    return (
        spark.createDataFrame(docs, "doc_id long, text string"),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
    )


def test_toxic_texts_are_told_without_their_labels(spark):
    docs, labels = toxic_corpus(spark)
    got = {r.doc_id: r for r in toxicity.classify(docs, labels.filter("doc_id % 3 > 0")).collect()}
    unseen = [r for r in labels.collect() if r.doc_id % 3 == 0]
    assert np.mean([got[r.doc_id].toxic == bool(r.toxic) for r in unseen]) > 0.97
    assert np.mean([(got[r.doc_id].p_quality > 0.5) == bool(r.quality) for r in unseen]) > 0.97


def test_later_categories_see_earlier_ones():
    rng = np.random.default_rng(9)
    rows_ = [np.unique(rng.integers(0, 50, 8)) for _ in range(400)]
    first = np.array([7 in r for r in rows_], float)
    chain = toxicity.Chain(("a", "b")).fit(rows_, np.column_stack([first, first]), np.arange(400) % 4)
    assert chain.models[1].dense[0] > 0.5
    assert len(chain.models[0].dense) == 0


def test_toxicity_messy(spark):
    docs, labels = toxic_corpus(spark, 200)
    odd = spark.createDataFrame([(2, None, 1), (None, 1, 1), (3, 1, None), (1, 0, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")
    chain = toxicity.fit(docs, labels.union(odd))
    got = toxicity.score(messy(spark), chain).collect()
    assert len(got) == len(rows())
    assert not any(r.toxic for r in got if r.doc_id in (2, 3, 4))
    assert toxicity.classify(empty(spark), labels).count() == 0
    alone = toxicity.classify(messy(spark), labels.limit(0)).collect()
    assert {(r.p_quality, r.p_toxic, r.toxic) for r in alone} == {(0.0, 0.0, False)}


def test_limit_has_the_best_f1():
    r = np.random.default_rng(3)
    for _ in range(50):
        p, y = np.round(r.random(60), 2), (r.random(60) < 0.2).astype(float)
        f1 = lambda t: 2 * ((p >= t) & (y > 0)).sum() / ((p >= t).sum() + y.sum())
        got = toxicity.best_limit(p, y)
        if y.any():
            assert abs(f1(got) - max(f1(t) for t in p)) < 1e-12
    assert toxicity.best_limit(np.array([0.1, 0.9]), np.zeros(2)) == toxicity.LIMIT


def test_repeated_rows_count_once_in_the_toxicity_fit(spark):
    docs, labels = toxic_corpus(spark, 300)
    hot = docs.filter("doc_id = 7").crossJoin(spark.range(400)).select(docs.columns)
    one, two = toxicity.fit(docs, labels), toxicity.fit(docs.unionByName(hot), labels)
    assert one.index == two.index and one.limit == two.limit
    assert np.allclose(one.models[-1].weight, two.models[-1].weight) if hasattr(one.models[-1], "weight") else one.limit == two.limit
