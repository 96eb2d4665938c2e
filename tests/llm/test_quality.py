"""Quality classifier: the fit against the same formulas over all rows at once, held-out accuracy, odd inputs."""

from __future__ import annotations

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from seafret.llm import quality
from tests.llm.frames import empty, messy

WORDS = "of the and a cat sat mat moon house river over under long winding road which that were stone green".split()


def good(r):
    return ". ".join(" ".join(r.choices(WORDS, k=r.randrange(5, 14))).capitalize() for _ in range(r.randrange(1, 12))) + "."


def bad(r):
    words = good(r).split()
    kind = r.randrange(3)
    if kind == 0:
        return " ".join(w + r.choice(["###", "$$$", "&&&"]) for w in words)
    if kind == 1:
        return " ".join(w.upper() + "!!" for w in words)
    return " ".join([words[0]] * (20 + len(words)))


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(11)
    rows = [(i, (bad if i % 6 == 0 else good)(r), int(i % 6 != 0)) for i in range(1500)]
    docs = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(x[0], x[2], 0) for x in rows if x[0] % 4], "doc_id long, quality int, toxic int")
    return docs, labels, rows


def is_held_out(doc_id) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def test_held_out_accuracy(corpus):
    docs, labels, rows = corpus
    truth = {i: q for i, _, q in rows}
    got = quality.classify(docs, labels).collect()
    assert len(got) == len(rows)
    assert all(r.held_out == is_held_out(r.doc_id) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) >= 0.98


def test_fit_equals_formulas_over_all_rows(corpus):
    docs, labels, rows = corpus
    x = quality.vectors(docs)
    model = quality.fit(x, labels)
    mine = [(quality.statistics(t.encode()), q) for i, t, q in rows if i % 4 and not is_held_out(i)]
    # repeated rows of one id and vector count once; ids are unique here
    a, y = np.array([m[0] for m in mine]), np.array([m[1] for m in mine])
    sd = a.std(axis=0)
    z = quality.BEND * np.tanh((a - a.mean(axis=0)) / np.where(sd > 1e-9, sd, 1.0) / quality.BEND)
    parts, shared = [], sum((z[y == k] - z[y == k].mean(axis=0)).T @ (z[y == k] - z[y == k].mean(axis=0)) for k in (0, 1)) / (len(y) - 2)
    for k in (0, 1):
        cov = (1 - model.pooled) * np.cov(z[y == k].T) + model.pooled * shared
        cov = (1 - model.identity) * cov + (model.identity * np.trace(cov) / len(cov) + 1e-6) * np.eye(len(cov))
        gap = z - z[y == k].mean(axis=0)
        distance = np.einsum("ij,ij->i", gap, np.linalg.solve(cov, gap.T).T)
        parts.append(math.log(np.mean(y == k)) - 0.5 * (np.linalg.slogdet(cov)[1] + distance))
    assert np.allclose(model.discriminant.log_ratio(model.scaler.bent(a)), parts[1] - parts[0], rtol=1e-6, atol=1e-6)


def test_held_out_labels_and_other_columns_change_nothing(spark, corpus):
    docs, labels, _ = corpus
    held = quality.held_out(F.col("doc_id"))
    turned = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    more = docs.withColumns({"lang": F.lit("en"), "x": F.lit(1), "label": F.lit(0), "fold": F.lit("f")})
    one = {r.doc_id: r.score for r in quality.classify(docs, labels).collect()}
    two = {r.doc_id: r.score for r in quality.classify(more, turned).collect()}
    assert all(abs(one[i] - two[i]) < 1e-9 for i in one)


def test_repeated_and_conflicting_labels(spark, corpus):
    docs, labels, _ = corpus
    wrong = labels.filter("doc_id % 7 = 0").withColumn("quality", 1 - F.col("quality"))
    nulls = spark.createDataFrame([(None, 1, 0), (5, None, 0), (10**6, 1, 0)], labels.schema)
    messy_labels = labels.unionByName(labels).unionByName(wrong).unionByName(nulls)
    x = quality.vectors(docs)
    clean = labels.filter("doc_id % 7 <> 0 OR doc_id IS NULL")
    assert quality.training_rows(x.unionByName(x), messy_labels).count() == quality.training_rows(x, clean).count()


def test_messy_rows(spark, corpus):
    docs = messy(spark)
    labels = spark.createDataFrame([(i, int(i % 3 != 0), 0) for i in range(100, 190)], "doc_id long, quality int, toxic int")
    got = quality.classify(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (r.doc_id is not None and is_held_out(r.doc_id)) for r in got)
    by_text = {}
    for r in got:
        by_text.setdefault(r.doc_id, set()).add(round(r.score, 12))
    assert len(by_text[6]) == 1  # repeated rows
    assert by_text[2] == by_text[3]  # null and empty


def test_one_class_none_and_empty_tables(spark, corpus):
    docs, labels, _ = corpus
    some = docs.filter("doc_id < 50")
    assert {r.score for r in quality.classify(some, labels.filter("quality = 1")).collect()} == {1.0}
    assert {r.score for r in quality.classify(some, labels.filter("doc_id < 0")).collect()} == {0.5}
    assert quality.classify(empty(spark), labels).collect() == []


def test_statistics_are_finite():
    for text in ("", " ", "\n\n", "é", "a" * 100_000, "😀" * 5, "\x00", "A! b? C.\n" * 3):
        assert np.isfinite(quality.statistics(text.encode())).all()
        assert len(quality.statistics(text.encode())) == len(quality.STATISTICS)
