"""Kinds of boosting rounds against plain arithmetic and against Spark's own learner."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from seafret.operators import boosting_kinds as kinds, ml
from seafret.session import new_path

COLS = list("abcd")


def numbers(n=700):
    r = np.random.default_rng(11)
    x = (r.random((n, 4)) < [0.5, 0.3, 0.8, 0.4]).astype(float)
    y = (x[:, 0] + 0.7 * x[:, 1] * x[:, 2] + 0.6 * r.normal(size=n) > 0.7).astype(int)
    return x, y, 1.0 + np.arange(n) % 3


def table(spark, n=700, every=5):
    x, y, w = numbers(n)
    rows = [(i, *map(float, v), int(k), float(a), i % every == 0) for i, (v, k, a) in enumerate(zip(x, y, w))]
    df = spark.createDataFrame(rows, "i int, a double, b double, c double, d double, label int, weight double, is_valid boolean").coalesce(2)
    return VectorAssembler(inputCols=COLS, outputCol="features").transform(df)


def learner(kind, rounds=6, depth=1, rate=0.3, **more):
    clf = ml.boosted_trees({"n_estimators": rounds, "depth": depth, "learning_rate": rate, "min_data_in_leaf": 1} | more, by_round=True)
    clf.kind = kind
    return clf


def margins(model, df):
    return np.array([r["rawPrediction"][1] for r in model.transform(df).orderBy("i").collect()])


def plain_boosting(kind, rounds, rate, seed=1):
    """Trees of depth one over columns of 0 and 1, as arrays of their values by row, and their scales."""
    x, y, w = numbers()
    sign = 2.0 * y - 1
    trees, scales = [], []
    for k in range(rounds):
        out = kinds.dropped_trees(kind, k, seed)
        now = sum((s * t for i, (s, t) in enumerate(zip(scales, trees)) if i not in out), np.zeros(len(y)))
        g = 4 * sign / (1 + np.exp(2 * sign * now)) if k else sign
        gains, values = [], []
        for c in range(4):
            v, gain = np.empty(len(y)), 0.0
            for h in (x[:, c] == 0, x[:, c] == 1):
                v[h] = (w * g)[h].sum() / (w[h].sum() + kind.l2)
                gain += (w * g)[h].sum() ** 2 / w[h].sum()
            gains.append(gain)
            values.append(v)
        trees.append(values[int(np.argmax(gains))])
        scales = [s * len(out) / (len(out) + 1) if i in out else s for i, s in enumerate(scales)]
        scales.append((rate if k else 1.0) / (len(out) + 1))
    return sum(s * t for s, t in zip(scales, trees)), scales


def test_plain_kind_equals_sparks_learner(spark):
    df = table(spark).cache()
    settings = {"n_estimators": 10, "depth": 3, "learning_rate": 0.2, "min_data_in_leaf": 5}
    theirs = ml.boosted_trees(settings).fit(df)
    ours = ml.boosted_trees(settings, by_round=True).fit(df)  # more than one stage
    assert np.allclose(ours.treeWeights, theirs.treeWeights) and ours.rounds_trained == 10
    assert np.allclose(margins(ours, df), margins(theirs, df), atol=1e-9)


@pytest.mark.parametrize(
    "kind",
    [kinds.Kind(), kinds.Kind(l2=40.0), kinds.Kind("dart", drop=0.5, skip=0.0), kinds.Kind("dart", l2=9.0, drop=1.0, skip=0.3, most_dropped=2)],
    ids=str,
)
def test_rounds_equal_plain_arithmetic(spark, kind):
    df = table(spark).cache()
    model = learner(kind).fit(df)
    expected, scales = plain_boosting(kind, 6, 0.3)
    assert np.allclose(model.treeWeights, scales)
    assert np.allclose(margins(model, df), expected, atol=1e-9)


def test_l2_shrinks_what_later_rounds_see(spark):
    df = table(spark).cache()
    weak, strong = (margins(learner(kinds.Kind(l2=v), 3, 3).fit(df), df) for v in (0.0, 200.0))
    assert np.abs(strong).max() < 0.8 * np.abs(weak).max()


def test_sampling_keeps_large_gradients_and_total_weight(spark):
    df = table(spark, 6000).withColumn("label", F.col("label").cast("double")).cache()
    clf = learner(kinds.Kind("goss", top=0.25, other=0.25), 1, 2)
    rounds = kinds._Rounds(clf, df)
    try:
        rounds.stage(1)
        rows = rounds._at(rounds.scales)
        target = 4.0 * F.col("_sign") / (1.0 + F.exp(2.0 * F.col("_sign") * F.col("_now")))
        size = F.abs(target) * F.col("_w")
        kept, weight = rounds._sampled(rows, target)
        all_rows = [r[0] for r in rows.select(size).collect()]
        limit = np.quantile(all_rows, 0.75, method="inverted_cdf")
        got = kept.select("_u", size.alias("size"), weight.alias("weight"), "_w").collect()
        large = [r for r in got if r["size"] >= limit]
        assert len(large) == sum(s >= limit for s in all_rows) and all(r["weight"] == r["_w"] for r in large)
        assert all(abs(r["weight"] - 3 * r["_w"]) < 1e-9 for r in got if r["size"] < limit)
        total = rows.agg(F.sum("_w")).first()[0]
        assert abs(sum(r["weight"] for r in got) - total) < 0.06 * total
        assert sorted(r["_u"] for r in got) == sorted(r["_u"] for r in kept.collect())  # the same rows at every reading
    finally:
        rounds.close()


def test_sampled_model_is_as_good_as_the_plain_one(spark):
    df = table(spark, 3000).cache()
    train, held = df.where("not is_valid"), df.where("is_valid")
    right = [learner(k, 8, 2).fit(train).transform(held).where("prediction = label").count() for k in (kinds.Kind(), kinds.Kind("goss"))]
    assert right[1] > right[0] - 0.05 * held.count()


def test_patience_stops_sampling_but_not_dropping(spark):
    df = table(spark, 500).cache()
    train, valid = df.where("not is_valid"), df.where("is_valid")
    early = kinds.fit_kind(learner(kinds.Kind("goss"), 60, 4, 1.0), train, valid, 3)
    assert early.rounds_trained < 60 and early.getNumTrees <= early.rounds_trained - 3
    late = kinds.fit_kind(learner(kinds.Kind("dart"), 7, 2, 1.0), train, valid, 3)
    assert late.rounds_trained == late.getNumTrees == 7
    assert kinds.fit_kind(learner(kinds.Kind(l2=1.0), 5), train, valid.where("false"), 3).getNumTrees == 5


def test_model_is_saved_reloaded_and_explained(spark):
    df = table(spark).cache()
    model = learner(kinds.Kind("dart", l2=5.0, drop=0.5, skip=0.0), 5, 3).fit(df)
    path = new_path(spark, "kinds")
    model.save(path)
    again = type(model).load(path)
    assert np.array_equal(margins(model, df), margins(again, df))
    assert abs(sum(r["importance"] for r in ml.feature_importance(model, COLS).collect()) - 1) < 1e-6


def test_drawn_parameters_reach_the_learner(spark):
    drawn = {"boosting": "dart", "lambda_l2": 4.0, "n_estimators": 3, "max_depth": 2, "learning_rate": 0.3}
    clf = ml.learner("lgb", drawn, by_round=True)
    assert clf.kind == kinds.Kind("dart", 4.0) and ml.early_stopping(clf).kind == clf.kind
    assert ml.learner("cb", {}, by_round=True).kind.l2 == 3 and ml.learner("xgb", {}, by_round=True).kind.l2 == 5
    assert not hasattr(ml.learner("lgb", drawn), "kind")
    df = table(spark, 300).withColumn("label", F.col("i") % 3)
    model = ml.fit_classifier(ml.early_stopping(ml.learner("lgb", drawn, 3, by_round=True)), df, 2, 3)
    assert [m.getNumTrees for m in model.models] == [3, 3, 3]


def test_what_is_refused():
    for wrong in ({"name": "other"}, {"l2": -1.0}, {"top": 0.0}, {"top": 0.9, "other": 0.2}):
        with pytest.raises(ValueError):
            kinds.Kind(**wrong)
    with pytest.raises(ValueError):
        ml.learner("cb", {}, 3, joint=True, by_round=True)


def test_dropped_trees_are_the_same_again_and_bounded():
    kind = kinds.Kind("dart", drop=0.3, skip=0.0, most_dropped=4)
    drawn = [kinds.dropped_trees(kind, 200, seed) for seed in range(30)]
    assert drawn == [kinds.dropped_trees(kind, 200, seed) for seed in range(30)]
    assert all(len(d) == 4 and d == sorted(set(d)) for d in drawn) and len({tuple(d) for d in drawn}) > 20
    rare = [len(kinds.dropped_trees(kinds.Kind("dart", drop=0.1, skip=0.5, most_dropped=500), 100, s)) for s in range(200)]
    assert 3 < np.mean(rare) < 7 and 60 < rare.count(0) < 140
    assert kinds.dropped_trees(kinds.Kind("goss"), 100, 1) == []
