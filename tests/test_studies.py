"""A whole small run: raw rows to features, tuning, refits, reports; also hot series and plan checks."""

import dataclasses
import math

import pytest
from pyspark.sql import functions as F

from seafret.operators import folds as fold_ops, ml, trials as trial_ops, weights
from seafret.plans import features, studies
from seafret.schema import lag_columns
from seafret.sources import tables

SETTINGS = features.Settings(max_lag=2, horizons=(1,), rows_per_hour=1, fog_rows=30)


def minute_rows(spark, days: int):
    """Two stations, fog in the early hours of most days."""
    hour = F.hour("datetime")
    base = spark.range(days * 1440 * 2).select(
        F.when(F.col("id") % 2 == 0, "SF_0001").otherwise("SF_0002").alias("station"),
        F.timestamp_seconds(1514764800 + F.expr("id div 2") * 60).alias("datetime"),
        (F.pmod(F.xxhash64("id"), F.lit(100)) / 100).alias("e"),
    )
    foggy = (hour < 6) & (F.dayofyear("datetime") % 4 != 0)
    return base.select(
        "station",
        "datetime",
        (F.col("e") * 360).alias("wd"),
        F.when(foggy, F.col("e")).otherwise(5 + F.col("e")).alias("ws"),
        F.when(F.col("e") > 0.05, 10 + F.sin(hour * math.pi / 12) + F.col("e")).alias("temp"),
        (12 + F.col("e")).alias("sst"),
        (1010 + F.col("e")).alias("qff"),
        F.when(foggy, 95.0).otherwise(60.0).alias("rh"),
        F.when(foggy, 200.0).otherwise(15000.0).alias("vis20"),
    )


@pytest.fixture(scope="module")
def plan(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("run"))
    tables.write_features(features.features(minute_rows(spark, 12), SETTINGS), f"{root}/features")
    return studies.Plan(
        spark,
        f"{root}/features",
        f"{root}/trials",
        stations=["SF_0001", "SF_0002"],
        horizons=[1],
        models=["cb", "rf"],
        cols=lag_columns(max_lag=2),
        periods=[("2018-01-08", "2018-01-12"), ("2018-01-02", "2018-01-05")],
        n_trials=2,
        rounds=2,
        patience=None,
    )


def test_features_of_minute_data(plan):
    df = tables.scan_features(plan.spark, plan.features)
    assert df.count() == 2 * 12 * 144
    assert df.groupBy("station", "datetime").count().where("count > 1").count() == 0
    row = df.where("station = 'SF_0001' and datetime = timestamp'2018-01-03 03:00:00'").first()
    assert row["fog_count_lag00"] == 60 and row["label"] == 1 and row["vis_lag00"] == 200 and row["label3"] == 2
    day = df.where("station = 'SF_0001' and datetime = timestamp'2018-01-03 12:00:00'").first()
    assert day["fog_count_lag00"] == 0 and day["y_1"] == 0 and day["vis_lag00"] == 3000 and day["label3"] == 0


def test_run_goes_on_where_it_stopped_and_reports(plan, tmp_path):
    plan.n_trials = 1
    studies.tune(plan)
    assert plan.history().count() == 4
    plan.n_trials = 2
    studies.tune(plan)
    studies.tune(plan)
    assert plan.history().count() == 8
    assert plan.history().groupBy("station", "horizon", "model", "trial_id").count().where("count > 1").count() == 0
    best, summary = studies.refit_report(plan)
    assert best.count() == 2 and {r["score"] for r in summary.collect()} == {"acc_1", "f1_1"}
    votes, _ = studies.ensemble_report(plan)
    assert votes.count() == 2 and votes.where("F1 between 0 and 1").count() == 2
    names = studies.export(plan, str(tmp_path / "out"))
    assert names.count() == 2
    preds = tables.scan_predictions(plan.spark, str(tmp_path / "out" / "SF_0001_1" / "predictions"))
    assert preds.where("pred not in (0, 1) or obs is null").count() == 0 and preds.count() > 0
    assert studies.importance_report(plan, 5).count() > 0
    found = studies.holdout(plan, str(tmp_path / "holdout"), "2018-01-08")
    assert found.count() == 2 and found.where("F1 between 0 and 1 and stage = 'test'").count() == 2
    assert tables.scan_trials(plan.spark, str(tmp_path / "holdout" / "scores")).count() == 2
    plan.static_weight = 50.0
    studies.refit_report(plan, 1, str(tmp_path / "report"))
    plan.static_weight = None
    assert plan.spark.read.csv(str(tmp_path / "report" / "folds" / "SF_0001_1"), header=True).count() == 2
    assert {r["status"] for r in plan.status_table().collect()} == {"done"}


def other(plan, path, **change):
    return dataclasses.replace(plan, trials=path, status=[], **change)


def test_stop_in_mid_study_keeps_finished_trials(plan, tmp_path, monkeypatch):
    mine = other(plan, str(tmp_path / "trials"), stations=["SF_0001"], models=["rf"], n_trials=4, parallelism=1)
    real, calls = ml.cv_fit, []

    def stops(*args, **kwargs):
        calls.append(1)
        if len(calls) == 3:
            raise RuntimeError("power cut")
        return real(*args, **kwargs)

    monkeypatch.setattr(ml, "cv_fit", stops)
    with pytest.raises(RuntimeError, match="power cut"):
        studies.tune(mine)
    assert mine.history().count() == 2
    monkeypatch.setattr(ml, "cv_fit", real)
    studies.tune(mine)
    assert sorted(r["trial_id"] for r in mine.history().collect()) == [1, 2, 3, 4]


def test_wrong_setting_is_raised(plan, tmp_path, monkeypatch):
    def wrong(self, *args):
        raise ValueError("set spark.checkpoint.dir")

    monkeypatch.setattr(studies.Plan, "folds", wrong)
    with pytest.raises(ValueError, match="checkpoint"):
        studies.tune(other(plan, str(tmp_path / "trials")))


def test_place_without_fog_is_listed(plan, tmp_path):
    clear = tables.scan_features(plan.spark, plan.features).withColumn("y_1", F.when(F.col("station") == "SF_0001", F.col("y_1")).otherwise(0))
    tables.write_features(clear, str(tmp_path / "features"))
    mine = other(plan, str(tmp_path / "trials"), features=str(tmp_path / "features"), models=["rf"], n_trials=1)
    found = {(r["station"], r["status"]) for r in studies.tune(mine).collect()}
    assert ("SF_0001", "done") in found
    assert [s for p, s in found if p == "SF_0002"] == ["no fold has fog rows to test and two classes to train on"]
    assert mine.history().count() == 1
    best, _ = studies.refit_report(mine, 1)
    assert [r["station"] for r in best.collect()] == ["SF_0001"]


def test_trials_by_classes(plan):
    assert dataclasses.replace(plan, n_trials=None).trials_wanted == 150
    assert dataclasses.replace(plan, n_trials=None, classes=3).trials_wanted == 200


def joins(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_wide_table_is_not_shuffled_for_weights_or_roles(plan):
    df = tables.scan_features(plan.spark, plan.features)
    weighted = weights.sample_weight_binary(df, 0.3)
    assert "BroadcastHashJoin" in joins(weighted) and "Exchange hashpartitioning" not in joins(weighted)
    roles = fold_ops.fold_roles(fold_ops.year_folds(fold_ops.day_group(df), plan.periods))
    assert "BroadcastHashJoin" in joins(roles) and "Exchange hashpartitioning" not in joins(roles)


def test_top_k_limits_before_the_shuffle(spark):
    t = spark.range(1000).selectExpr("concat('s', id % 3) station", "1 horizon", "'cb' model", "id trial_id", "cast(id as double) value")
    text = joins(trial_ops.last_n_trials(t, 5))
    assert text.count("WindowGroupLimit") == 2


def test_class_weighted(spark):
    df = spark.createDataFrame([("s", 0)] * 6 + [("s", 1)] * 2, "station string, label int")
    assert {(r["label"], r["weight"]) for r in weights.class_weighted(df).collect()} == {(0, 1.0), (1, 2.0)}


def test_class_weights_reach_the_fit(plan, monkeypatch):
    mine = dataclasses.replace(plan, class_weight=True)
    fold = plan.folds("SF_0001", 1)[0]
    n = {r["label"]: r["count"] for r in fold.train.groupBy("label").count().collect()}
    seen = []
    monkeypatch.setattr(ml, "fit_classifier", lambda clf, rows, *a: seen.append(rows))
    monkeypatch.setattr(ml.trial_ops, "topk_models", lambda *a: plan.spark.createDataFrame([("cb", 1)], "model string, rank int"))
    monkeypatch.setattr(ml, "tuned_params", lambda trials: {"cb": {"pos_label_ratio": 0.3}})
    monkeypatch.setattr(studies.Plan, "history", lambda *a: None)
    studies._refits(mine, "SF_0001", 1, [fold], 1)
    got = {r["label"]: r["weight"] for r in seen[0].select("label", "weight").distinct().collect()}
    assert got == {0: 1.0, 1: n[0] / (n[1] + 1)}
    with pytest.raises(ValueError):
        studies._fixed_weights(dataclasses.replace(mine, static_weight=2.0))


def test_rounds_of_their_own_reach_refits_and_trials(plan, monkeypatch):
    mine = dataclasses.replace(plan, by_round=True)
    fold = plan.folds("SF_0001", 1)[0]
    seen = []
    monkeypatch.setattr(ml, "fit_classifier", lambda clf, *a: seen.append(clf))
    monkeypatch.setattr(ml.trial_ops, "topk_models", lambda *a: plan.spark.createDataFrame([("lgb", 1)], "model string, rank int"))
    tried = {"model_params.boosting": "dart", "model_params.lambda_l2": "4.0", "pos_label_ratio": "0.3"}
    history = plan.spark.createDataFrame([("SF_0001", 1, "lgb", 1, 0.5, tried)], "station string, horizon int, model string, trial_id long, value double, params map<string,string>")
    monkeypatch.setattr(studies.Plan, "history", lambda *a: history)
    studies._refits(mine, "SF_0001", 1, [fold], 1)
    studies._refits(plan, "SF_0001", 1, [fold], 1)
    assert (seen[0].kind.name, seen[0].kind.l2) == ("dart", 4.0) and not hasattr(seen[1], "kind")


def test_shares_of_columns_by_tree_and_node_are_one():
    share = lambda **p: ml.spark_params(p, ml.FOREST).get("featureSubsetStrategy")
    assert share(feature_fraction=0.7, feature_fraction_bynode=0.9) == "0.63"
    assert share(feature_fraction_bynode=0.5) == "0.5" and share(feature_fraction=0.7) == "0.7" and share() is None
