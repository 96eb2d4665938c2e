"""Reversed search against a brute-force ranking of all documents for all items."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest

from seafret.llm import lexical_search
from tests.llm.frames import empty, messy

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return re.findall(lexical_search.TERM, (text or "").translate(LOWER))


def brute(docs, items, k=10):
    docs = [(i, Counter(terms(t))) for i, t in docs]
    docs = [(i, c) for i, c in docs if c]
    n_docs, total = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for item, text in items:
        found = []
        for doc, c in docs:
            m = 100 - 90 + (90 * sum(c.values()) * n_docs) // total
            score = 0
            for t in set(terms(text)):
                if c[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m))
            if score > 0:
                found.append((-score, doc is None, doc or 0, doc))
        out += [(item, r, f[3], -f[0]) for r, f in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def sample(spark):
    r = random.Random(3)
    words = ["The", "cat", "é", "É", "sat9", "on", "MAT", "語", "x_y", "zwei", "drei"] + [f"w{i}" for i in range(60)]
    text = lambda n: r.choice([" ", ", ", "\n", "\x00", "--"]).join(r.choices(words, weights=[1 / (1 + i) for i in range(len(words))], k=n))
    docs = [(i * 3 - 50, text(r.randrange(0, 80))) for i in range(300)] + [(5, "cat cat"), (5, "cat cat"), (None, "cat cat"), (6, None), (7, " .")]
    items = [(i, text(r.randrange(0, 12))) for i in range(40)] + [(3, "cat MAT"), (None, "cat"), (90, None), (91, "!"), (92, "nowhere"), (3, "cat MAT")]
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id long, text string").repartition(2), docs, items


@pytest.mark.parametrize("postings", [lexical_search.POSTINGS, 60, 1])
def test_equals_brute_force(spark, postings):
    docs, items, d, i = sample(spark)
    if postings == 1:  # every item is a block of its own
        items, i = items.filter("item_id in (3, 92)"), [x for x in i if x[0] in (3, 92)]
    assert got(lexical_search.search(docs, items, postings=postings)) == brute(d, i)


def test_other_depth(spark):
    docs, items, d, i = sample(spark)
    assert got(lexical_search.search(docs, items, k=3)) == brute(d, i, 3)


def test_messy_rows(spark):
    docs = messy(spark)
    items = docs.selectExpr("doc_id AS item_id", "text", "score", "mark", "lang AS terms").filter("item_id IS NULL OR item_id % 7 < 3")
    assert got(lexical_search.search(docs, items)) == brute(
        [(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()]
    )


def test_empty_tables(spark):
    docs, items, d, i = sample(spark)
    none = empty(spark)
    assert got(lexical_search.search(none, items)) == []
    assert got(lexical_search.search(docs, none.withColumnRenamed("doc_id", "item_id"))) == []
    assert lexical_search.search(none, items).columns == ["item_id", "rank", "doc_id", "score"]


def test_numbers_above_32_bits():
    index = lexical_search.Index([(0, [b"a", b"b"]), (1, [b"b"])])
    import numpy as np

    one = np.array([0, 0], np.int64)
    out = lexical_search.scores_of(index, np.array([40_000, 30_000]), np.array([10]), one, np.array([0, 1]), np.array([2_000_000_000, 7], np.int64))
    b = 30_000 * (10**9 * 7 // (7000 + 80))
    assert out.tolist() == [[40_000 * (10**9 * 2_000_000_000 // (1000 * 2_000_000_000 + 80)) + b, b]]
