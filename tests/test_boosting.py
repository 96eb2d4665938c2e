"""Resumed boosting against one long fit, and the joint softmax model."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from seafret.operators import boosting, ml
from seafret.session import new_path


def table(spark, n=900, classes=2, noise=0.3):
    r = np.random.default_rng(4)
    x = r.normal(size=(n, 4))
    signal = x[:, 0] + 0.5 * x[:, 1] * x[:, 2] + noise * r.normal(size=n)
    y = np.digitize(signal, [-0.4, 0.6][: classes - 1] if classes > 2 else [0.2])
    rows = [(*map(float, v), int(k), float(1 + (i % 3)), i % 5 == 0) for i, (v, k) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, label int, weight double, is_valid boolean").coalesce(2)
    return VectorAssembler(inputCols=list("abcd"), outputCol="features").transform(df).cache()


def test_resumed_rounds_equal_one_long_fit(spark):
    rows = table(spark)
    train, valid = rows.where("not is_valid"), rows.where("is_valid")
    clf = ml.boosted_trees({"n_estimators": 40, "depth": 2, "learning_rate": 0.1, "min_data_in_leaf": 5})
    long = clf.fit(train)
    losses = long.evaluateEachIteration(valid)
    best = boosting.best_round(losses, 3)
    assert best > 5  # more than the first stage
    got = boosting.fit_patient(clf, train, valid, 3)
    assert got.getNumTrees == best and 6 < got.rounds_trained < 3 * best + 10
    assert np.allclose(got.evaluateEachIteration(valid), losses[:best], rtol=1e-9)
    assert np.allclose(got.treeWeights, long.treeWeights[:best])


@pytest.mark.parametrize("rate", [0.5, 1.0])
def test_a_thousand_rounds_are_not_grown(spark, rate):
    rows = table(spark, 400, noise=1.5)
    clf = ml.boosted_trees({"n_estimators": 1000, "depth": 3, "learning_rate": rate})
    model = ml.fit_classifier(clf, rows, patience=10)
    assert model.getNumTrees <= 12 and model.rounds_trained < 40


def test_bounds_of_the_stages():
    for best in range(4, 1000):
        trained = 20
        while trained - best < 10:
            trained += boosting.stage_length(trained, 1 << 30)
        assert trained < 3 * best + 10
    assert boosting.stage_length(990, 1000) == 10


def test_resumed_model_is_saved_and_reloaded(spark):
    rows = table(spark)
    clf = ml.boosted_trees({"n_estimators": 30, "depth": 2, "learning_rate": 0.1})
    model = boosting.fit_patient(clf, rows.where("not is_valid"), rows.where("is_valid"), 2)
    path = new_path(spark, "resumed")
    model.save(path)
    again = type(model).load(path)
    both = model.transform(rows).select("a", "prediction").join(again.transform(rows).select("a", F.col("prediction").alias("p")), "a")
    assert both.where("prediction <> p").count() == 0
    found = ml.feature_importance(model, list("abcd")).collect()
    assert len(found) == 4 and abs(sum(r["importance"] for r in found) - 1) < 1e-6


def test_joint_loss_falls_and_beats_a_constant(spark):
    rows = table(spark, classes=3)
    spec = ml.boosted_trees({"n_estimators": 6, "depth": 3, "learning_rate": 0.4}, 3, joint=True)
    seen = []
    model = boosting.fit_joint(spec, rows.where("not is_valid"), rows.where("false"), 3, None, lambda k, loss: seen.append(loss))
    assert len(seen) == 6 and all(b < a for a, b in zip(seen, seen[1:]))  # training loss, every round
    assert seen[-1] < 0.7 * np.log(3)
    held = rows.where("is_valid")
    commonest = max(r["count"] for r in held.groupBy("label").count().collect())
    assert model.transform(held).where("prediction = label").count() > commonest + 0.2 * held.count()


def test_joint_probabilities_come_from_one_softmax(spark):
    rows = table(spark, 300, classes=3)
    spec = ml.boosted_trees({"n_estimators": 3, "depth": 2, "learning_rate": 0.5}, 3, joint=True)
    model = boosting.fit_joint(spec, rows, rows.where("false"), 3)
    path = new_path(spark, "joint")
    model.save(path)
    again = type(model).load(path)
    assert boosting.is_joint(model) and boosting.is_joint(again)
    keyed = rows.withColumn("station", F.lit("s")).withColumn("datetime", F.monotonically_increasing_id())
    p = ml.predict_proba(ml.PipelineModel([again]), keyed, ["datetime", "features"]).collect()
    for r in p[:50]:
        margins = [m.predictRaw(r["features"])[1] for m in model.models]
        e = np.exp(np.array(margins) - max(margins))
        assert np.allclose([r["p0"], r["p1"], r["p2"]], e / e.sum()) and r["pred"] == int(np.argmax(e))


def test_joint_stops_with_patience(spark):
    rows = table(spark, 400, classes=3, noise=2.0)
    spec = ml.boosted_trees({"n_estimators": 200, "depth": 4, "learning_rate": 1.0}, 3, joint=True)
    model = ml.fit_classifier(spec, rows, 3, 3)
    assert len(model.models) == 3 and len({m.getNumTrees for m in model.models}) == 1
    assert model.rounds_trained <= model.models[0].getNumTrees + 3
