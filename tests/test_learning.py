import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import series
from seafret.operators import boosting, forecast, ml, prep, scores, trials, weights
from seafret.session import new_path

LIMITS = {"n_estimators": 3, "depth": 3, "max_depth": 3}
PERIODS = [("2018-01-21", "2018-01-30"), ("2018-01-11", "2018-01-20")]
COLS = ["a", "b-c"]


@pytest.fixture(scope="module")
def rows(spark):
    at = F.timestamp_seconds(1514764800 + F.col("id") * 3600)
    noise = F.pmod(F.xxhash64("id"), F.lit(100)) / 100.0
    df = spark.range(24 * 30).select(
        F.when(F.col("id") % 3 == 0, "SF_0001").otherwise("SF_0002").alias("station"),
        at.alias("datetime"),
        (noise * 10).alias("a"),
        F.sin(F.col("id").cast("double")).alias("b-c"),
        F.when(noise > 0.7, 1).otherwise(0).cast("double").alias("y_1"),
    )
    return ml.training_rows(df, COLS, "y_1")


@pytest.fixture(scope="module")
def folds(rows):
    return ml.prepare_folds(ml.fold_table(rows, PERIODS), COLS)


def test_scaler_sees_training_rows_only(folds):
    for fold in folds:
        train = fold.train.where("role = 'train'")
        mean = train.select(F.avg(ml.vector_to_array("features")[0])).first()[0]
        assert abs(mean) < 1e-9
        assert {r["role"] for r in fold.train.select("role").distinct().collect()} == {"train", "valid"}


def test_ratio_changes_class_zero_only(rows):
    a = ml.at_ratio(rows, 0.3).select("station", "datetime", F.col("weight").alias("wa"))
    b = weights.sample_weight_binary(rows.drop("weight"), 0.3).select("station", "datetime", F.col("weight").alias("wb"))
    assert a.join(b, ["station", "datetime"]).where("abs(wa - wb) > 1e-12").count() == 0


@pytest.mark.parametrize("model", ["cb", "lgb", "rf", "xgb"])
def test_learners_find_the_rule(folds, model):
    for row in ml.cv_evaluate(folds, lambda: ml.learner(model, LIMITS | {"pos_label_ratio": 1}), 1.0).collect():
        assert row["F1"] > 0.9


def test_early_stopping_stops_and_needs_no_retry(folds):
    clf = ml.early_stopping(ml.boosted_trees({"n_estimators": 20, "depth": 2, "learning_rate": 0.5}), tol=0.01)
    coin = F.pmod(F.xxhash64("datetime", F.lit("coin")), F.lit(2)).cast("int")
    train = folds[0].train.withColumn("label", coin)
    model, how = ml.fit_retry(lambda: ml.fit_classifier(clf, train))
    assert how == "fit 1" and model.getNumTrees < 20


def test_patience_keeps_the_best_round(folds):
    assert boosting.best_round([3, 2, 1, 2, 2, 0.5], 2) == 3
    assert boosting.best_round([3, 2, 1, 2, 2, 0.5], 3) == 6
    assert boosting.best_round([1, 1, 1], 10) == 1
    coin = F.pmod(F.xxhash64("datetime", F.lit("coin")), F.lit(2)).cast("int")
    rows = folds[0].train.withColumn("label", coin).cache()
    clf = ml.boosted_trees({"n_estimators": 15, "depth": 2, "learning_rate": 0.5})
    losses = clf.fit(rows.where("not is_valid")).evaluateEachIteration(rows.where("is_valid"))
    assert ml.fit_classifier(clf, rows, patience=4).getNumTrees == boosting.best_round(losses, 4) < 15


@pytest.mark.parametrize("classes", [2, 3])
@pytest.mark.parametrize("model", ["cb", "lgb", "rf", "xgb"])
def test_validation_rows_are_never_fitted(spark, model, classes):
    """Validation rows, five for each training row, follow the opposite rule."""
    data = [(x / 100, k == 0) for x in range(100) for k in range(6)]
    rows = [(x, not first, (int(x * classes) if first else classes - 1 - int(x * classes)), 1.0) for x, first in data]
    df = spark.createDataFrame(rows, "x double, is_valid boolean, label int, weight double")
    df = ml.VectorAssembler(inputCols=["x"], outputCol="features").transform(df)
    clf = ml.learner(model, LIMITS | {"min_child_samples": 1, "min_data_in_leaf": 1, "feature_fraction": 1.0, "bagging_fraction": 1.0}, classes)
    for learner, patience in ((ml.early_stopping(clf), None), (clf, None), (clf, 2)):
        fitted = ml.fit_classifier(learner, df, patience, classes)
        right = fitted.transform(df.where("not is_valid")).where("prediction = label").count()
        assert right > 80


def test_leaves_limit_the_depth():
    assert ml.effective_params({"max_depth": 41, "max_leaves": 7}) == {"max_depth": 3}
    assert ml.effective_params({"max_depth": 29, "num_leaves": 8}) == {"max_depth": 3}
    assert ml.effective_params({"max_depth": 2, "num_leaves": 60}) == {"max_depth": 2}
    assert ml.effective_params({"max_depth": 3, "max_leaves": 1}) == {"max_depth": 1}
    assert ml.effective_params({"depth": 40})["depth"] == ml.MAX_DEPTH
    assert ml.spark_params({"depth": 7}, ml.BOOSTED) == {"maxDepth": 7}


def test_repeatable(folds):
    runs = [ml.cv_predict(ml.cv_fit(folds, lambda: ml.learner("rf", LIMITS), 0.3)) for _ in range(2)]
    keys = ["station", "fold", "datetime"]
    assert scores.pred_parity(*runs, keys=keys).count() == 0


def test_retry_then_fallback():
    calls = []

    def fails():
        calls.append(1)
        raise RuntimeError

    assert ml.fit_retry(fails, 2, lambda: "plain") == ("plain", "fallback") and len(calls) == 2
    with pytest.raises(RuntimeError):
        ml.fit_retry(fails, 2)


@pytest.mark.parametrize("error", [OSError("disk"), MemoryError(), Exception("Job aborted: ExecutorLostFailure (executor 3 exited)")])
def test_other_errors_than_the_learners_rise(error):
    def fails():
        raise error

    with pytest.raises(type(error)):
        ml.fit_retry(fails, 2, lambda: "plain")


def test_search_refit_and_ensemble(spark, folds):
    base = spark.createDataFrame([("ALL", 1, m) for m in ("rf", "cb")], "station string, horizon int, model string")
    history = []
    for m in ("rf", "cb"):
        space = trials.search_space(base.where(F.col("model") == m), 2)
        history.append(ml.param_search(folds, ("ALL", 1, m), space, 3))
    table = prep.union_stations(history).cache()
    assert table.count() == 4 and table.where("value between 0 and 1").count() == 4
    skipped = ml.param_search(folds, ("ALL", 1, "rf"), trials.search_space(base.where("model = 'rf'"), 2), 3, done=[1])
    assert [r["trial_id"] for r in skipped.collect()] == [2]
    best = ml.refit_top2(folds, table, "ALL", 1, 3).first()
    assert best["model"] in ("rf", "cb") and best["F1"] <= 100
    assert ml.ensemble_refit(folds, table, 1, 3).count() == 2
    assert table.where("status = 'fold 1: fit 1, fold 2: fit 1' and cast(effective['max_depth'] as int) <= 5").count() == 2  # rf
    params = ml.tuned_params(table)
    assert set(params["rf"]) == set(ml.DEFAULT_PARAMS["rf"])


def test_pipeline_holdout_probabilities_and_reload(spark, rows):
    model, table = ml.holdout_test(rows, COLS, "2018-01-21", ml.learner("cb", LIMITS), 1.0)
    assert table.count() == 2
    p = ml.predict_proba(model, rows)
    assert p.where("abs(p0 + p1 - 1) > 1e-9 or pred not in (0, 1)").count() == 0
    assert ml.reload_parity(model, rows, new_path(spark, "parity")).count() == 0
    top = ml.feature_importance(model).orderBy(F.desc("importance")).first()
    assert top["feature"] == "a"


def test_three_classes(spark, rows):
    three = rows.withColumn("label", F.when(F.col("a") > 7, 2).when(F.col("a") > 4, 1).otherwise(0))
    one = ml.prepare_folds(ml.fold_table(three, PERIODS).where("fold = 1"), COLS, positive=2)
    for model in ("rf", "cb"):
        row = ml.cv_evaluate(one, lambda m=model: ml.learner(m, LIMITS, 3), 1.0, 3).first()
        assert row["F1"] > 0.8


def test_three_classes_refit_vote_export_importance(spark, rows, tmp_path):
    three = rows.withColumn("label", F.when(F.col("a") > 7, 2).when(F.col("a") > 4, 1).otherwise(0))
    one = ml.prepare_folds(ml.fold_table(three, PERIODS).where("fold = 1"), COLS, positive=2)
    params = F.create_map(F.lit("pos_label_ratio"), F.lit("1"), F.lit("depth"), F.lit("3"), F.lit("max_depth"), F.lit("3"))
    history = spark.createDataFrame([("ALL", 1, m, 1, v) for m, v in (("rf", 0.9), ("cb", 0.8))], "station string, horizon int, model string, trial_id long, value double")
    history = history.withColumn("params", params)
    best = ml.refit_top2(one, history, "ALL", 1, 3, 3).first()
    assert best["F1"] > 80
    votes = ml.ensemble_refit(one, history, 1, 3, 3)
    assert votes.where("F1 > 0.8").count() == 2
    ml.export_topk_predictions(one, history, 2, 1, str(tmp_path), 3, 3)
    model = ml.tables.load_model(f"{tmp_path}/models/cb_1_cv1")
    p = ml.predict_proba(model, three)
    assert p.where("abs(p0 + p1 + p2 - 1) > 1e-9 or pred not in (0, 1, 2)").count() == 0
    assert ml.feature_importance(model).orderBy(F.desc("importance")).first()["feature"] == "a"
    forest = ml.tables.load_model(f"{tmp_path}/models/rf_1_cv1")
    assert ml.predict_proba(forest, three).columns[-3:] == ["p0", "p1", "p2"]


def test_majority_vote_and_its_ties(spark):
    data = [(1, 0, m, p) for m, p in enumerate([0, 1, 1, 2])] + [(2, 2, m, p) for m, p in enumerate([0, 0, 2, 2])] + [(3, 1, 0, None)]
    df = spark.createDataFrame(data, "at int, obs int, m int, pred int").selectExpr("'s' as station", "1 as horizon", "1 as fold", "at as datetime", "obs", "pred")
    got = {r["datetime"]: r["pred"] for r in scores.vote_ensemble(df, classes=3).collect()}
    assert got == {1: 1, 2: 2, 3: None}


# ---- forecasts -----------------------------------------------------------------------


def walk(n, seed=1):
    r = np.random.default_rng(seed)
    return [float(x) for x in 20 + np.cumsum(r.normal(0, 1, n))]


def lag_matrix(y, w, first):
    x = np.array([[1.0, *[y[i - k] for k in range(1, w + 1)]] for i in range(first, len(y))])
    return x, np.array(y[first:])


def test_recursive_forecast_against_plain(spark, monkeypatch):
    monkeypatch.setattr(forecast, "BLOCK_ROWS", 16)
    y = walk(70)
    x, target = lag_matrix(y, 3, 3)
    beta = np.linalg.lstsq(x, target, rcond=None)[0]
    past = list(y)
    for _ in range(5):
        past.append(beta[0] + sum(b * v for b, v in zip(beta[1:], past[::-1])))
    got = forecast.recursive_forecast(series(spark, {"y": y}), "y", 3, 5).orderBy("step").collect()
    assert np.allclose([r["pred"] for r in got], past[-5:], rtol=1e-6)


def test_detrended_forecast_of_a_line_is_the_line(spark):
    y = [3 + 0.5 * i + (-1) ** i for i in range(60)]
    got = forecast.recursive_forecast(series(spark, {"y": y}), "y", 5, 4, with_trend=True).orderBy("step").collect()
    assert np.allclose([r["pred"] for r in got], [3 + 0.5 * i + (-1) ** i for i in range(60, 64)], atol=0.2)


def test_series_with_windows_and_horizons_of_their_own(spark):
    data = {f"SF_000{k}": walk(60 + k, k) for k in range(1, 5)}
    df = None
    for s, y in data.items():
        one = series(spark, {"y": y}).withColumn("station", F.lit(s))
        df = one if df is None else df.union(one)
    plan = spark.createDataFrame([(s, k % 2 + 2, 3 * k) for k, s in enumerate(data, 1)], "station string, window int, horizon int")
    got = forecast.recursive_forecast(df, "y", plan, plan, with_trend=True).collect()
    for s, w, h in plan.collect():
        y = np.array(data[s])
        line = np.polyfit(np.arange(len(y)), y, 1)
        flat = list(y - np.polyval(line, np.arange(len(y))))
        x, target = lag_matrix(flat, w, 3)  # rows with the lags of the longest window
        beta = np.linalg.lstsq(x, target, rcond=None)[0]
        for _ in range(h):
            flat.append(beta[0] + sum(b * v for b, v in zip(beta[1:], flat[::-1])))
        want = np.array(flat[-h:]) + np.polyval(line, np.arange(len(y), len(y) + h))
        mine = [r["pred"] for r in sorted(got, key=lambda r: r["step"]) if r["station"] == s]
        assert np.allclose(mine, want, rtol=1e-6)


def test_trend_of_every_fold(spark, monkeypatch):
    monkeypatch.setattr(forecast, "BLOCK_ROWS", 16)
    y, w, n = np.array(walk(80, 3)) + 0.7 * np.arange(80), 3, 80
    apes = []
    for row in range(int(n * 0.7), n):
        line = np.polyfit(np.arange(row), y[:row], 1)
        flat = y - np.polyval(line, np.arange(n))
        x, target = lag_matrix(flat, w, w)
        beta = np.linalg.lstsq(x[: row - w], target[: row - w], rcond=None)[0]
        apes.append(abs(flat[row] - x[row - w] @ beta) / abs(y[row]))
    got = forecast.window_errors(series(spark, {"y": [float(v) for v in y]}), "y", (w,), with_trend=True).first()
    assert got["n_folds"] == len(apes) and abs(got["mape"] - np.mean(apes)) < 1e-6 * np.mean(apes)


def test_searched_forecast_covers_all_test_rows(spark):
    y = walk(100, 4)
    df = series(spark, {"y": y})
    at = df.orderBy("datetime").collect()[70]["datetime"]
    rows, errors = forecast.searched_forecast(df.where(F.col("datetime") < at), df.where(F.col("datetime") >= at), "y", (2, 4))
    assert rows.count() == 30 and rows.where("pred is null").count() == 0
    one = errors.first()
    assert one["window"] in (2, 4) and one["mae"] >= 0 and one["mape"] >= 0


def test_window_search_refits_every_fold(spark, monkeypatch):
    monkeypatch.setattr(forecast, "BLOCK_ROWS", 16)
    y, windows, n = walk(90, 2), (2, 4), 90
    want = {}
    for w in windows:
        x, target = lag_matrix(y, w, max(windows))
        apes = []
        for row in range(int(n * 0.7), n):
            i = row - max(windows)
            beta = np.linalg.lstsq(x[:i], target[:i], rcond=None)[0]
            apes.append(abs(y[row] - x[i] @ beta) / abs(y[row]))
        want[w] = np.mean(apes)
    df = series(spark, {"y": y})
    got = {r["window"]: (r["mape"], r["n_folds"]) for r in forecast.window_errors(df, "y", windows).collect()}
    for w in windows:
        assert got[w][1] == n - int(n * 0.7) and abs(got[w][0] - want[w]) < 1e-6 * want[w]
    best = forecast.forecast_window_search(df, "y", windows).first()
    assert best["window"] == min(want, key=want.get)


def test_trend(spark):
    y = [2 + 0.25 * i for i in range(40)]
    df = series(spark, {"y": y})
    row = forecast.trend_fit(df, "y").first()
    assert abs(row["slope"] - 0.25) < 1e-9 and abs(row["intercept"] - 2) < 1e-9
    assert forecast.detrend(df, "y").where("abs(y_detrended) > 1e-9").count() == 0



def test_patience_holds_wherever_it_is_not_named(folds, monkeypatch):
    import inspect

    from seafret.plans import studies

    names = "cv_fit cv_evaluate param_search refit refit_models refit_best refit_top2 ensemble_refit export_topk_predictions".split()
    assert {n: inspect.signature(getattr(ml, n)).parameters["patience"].default for n in names} == dict.fromkeys(names, ml.PATIENCE)
    seen = []
    monkeypatch.setattr(ml, "fit_classifier", lambda clf, rows, patience=None, classes=2: seen.append(patience))
    ml.cv_fit(folds, lambda: ml.learner("cb", ml.base_params(3)))
    assert seen == [ml.PATIENCE] * len(folds)

    told = []
    plan = studies.Plan(None, "", "", stations=["a"], horizons=[1], patience=7, static_weight=0.5)
    monkeypatch.setattr(studies.Plan, "history", lambda *a: "trials")
    monkeypatch.setattr(ml, "static_fold", lambda fold, weight: (fold, weight))
    monkeypatch.setattr(ml, "refit_models", lambda *a: told.append(a) or {})
    monkeypatch.setattr(ml.tables, "write_predictions", lambda *a: None)
    monkeypatch.setattr(ml.tables, "write_summary", lambda *a: None)
    monkeypatch.setattr(ml, "model_predictions", lambda *a: None)
    monkeypatch.setattr(ml.trial_ops, "topk_models", lambda *a: None)
    monkeypatch.setattr(ml.trial_ops, "join_model_names", lambda *a: None)
    monkeypatch.setattr(studies, "_each_place", lambda plan, step, work: [work("a", 1, ["fold"])])
    monkeypatch.setattr(studies, "_union", lambda plan, parts, step: parts)
    studies.export(plan, "out")
    studies._refits(plan, "a", 1, ["fold"], 1)
    assert told[0] == told[1] == ([("fold", 0.5)], "trials", 1, None, 2, 7, True)


def test_a_fit_runs_in_few_tasks(folds, monkeypatch):
    """Tasks follow rows, not the files or partitions that the rows happen to be in."""
    assert [boosting.fit_tasks(n, 12) for n in (0, 24_000, 50_001, 2_000_000, 10_000_000)] == [1, 1, 2, 6, 20]
    seen = []
    monkeypatch.setattr(ml, "fit_binary", lambda clf, rows, patience: seen.append(rows.rdd.getNumPartitions()))
    ml.fit_classifier(ml.learner("cb", LIMITS), folds[0].train.repartition(16))
    assert seen == [1]


def test_folds_write_one_copy_of_the_rows(rows, folds, monkeypatch):
    """Scaled vectors are made in reading; rows written as vectors give the same ones."""
    table = ml.fold_table(rows, PERIODS, cols=COLS)
    assert ml.RAW in table.columns and not set(COLS) & set(table.columns)
    monkeypatch.setattr(ml, "materialize", None)
    keys = ["station", "datetime", "role", "weight"]
    for a, b in zip(folds, ml.prepare_folds(table, COLS), strict=True):
        assert a.train.columns == b.train.columns and "raw_features" not in b.train.columns
        for x, y in ((a.train, b.train), (a.test, b.test)):
            x, y = ({tuple(r[k] for k in keys): r["features"].toArray() for r in d.collect()} for d in (x, y))
            assert x.keys() == y.keys() and all(np.allclose(x[k], y[k], rtol=0, atol=1e-9) for k in x)
        labels = b.scaling.transform(rows).select("features")
        assert labels.count() == rows.count()


def test_fits_wait_for_room(spark, monkeypatch):
    """Fits side by side cache no more than there is room for; one too large for it runs alone."""
    import time

    from seafret import session

    monkeypatch.setattr(session, "storage_memory", lambda spark: 100 / session.CACHE_SHARE)
    now, most = [], []

    def work(size):
        with session.cache_room(spark, size):
            now.append(size)
            most.append(sum(now))
            time.sleep(0.05)
            now.remove(size)

    session.in_threads(work, [40] * 6 + [300], 7)
    assert len(most) == 7 and sorted(most)[-1] == 300 and sorted(most)[-2] == 80


def test_fits_at_once_share_out_the_cores(spark, folds, monkeypatch):
    """Every task of a fit sends all its sums, so many fits at once take one task each, few fits more."""
    from seafret import session

    assert [boosting.fit_tasks(400_000, 12, beside) for beside in (1, 2, 3, 9, 36)] == [6, 6, 4, 1, 1]
    assert boosting.fit_tasks(2_000_000, 12, 36) == 4  # so many rows are not one task
    widths = session.in_threads(lambda _: session.in_threads(lambda _: session.side_by_side(), range(5), 3), range(2))
    assert session.side_by_side() == 1 and widths == [[6] * 5] * 2

    rows, clf, seen = folds[0].train.repartition(16), ml.learner("cb", LIMITS), []
    monkeypatch.setattr(boosting, "TASK_ROWS", 10)
    monkeypatch.setattr(ml, "fit_binary", lambda clf, rows, patience: seen.append(rows.rdd.getNumPartitions()))
    cores = spark.sparkContext.defaultParallelism
    for beside in (2, cores):
        session.in_threads(lambda _: ml.fit_classifier(clf, rows), range(beside), beside)
    assert seen == [cores // 2] * 2 + [1] * cores
    monkeypatch.setattr(ml, "fits_in_room", lambda spark, size: 1)  # fits that wait for room leave it all to one
    seen.clear()
    session.in_threads(lambda _: ml.fit_classifier(clf, rows), range(cores), cores)
    assert seen == [cores // 2] * cores


def test_models_are_refitted_side_by_side(spark, folds, monkeypatch):
    from threading import Barrier

    params = F.create_map(F.lit("pos_label_ratio"), F.lit("1"))
    history = spark.createDataFrame([("ALL", 1, m, 1, v) for m, v in (("rf", 0.7), ("cb", 0.8), ("xgb", 0.9))], "station string, horizon int, model string, trial_id long, value double")
    both = Barrier(3, timeout=20)

    def refit(folds, model, *rest):
        both.wait()
        return [model]

    monkeypatch.setattr(ml, "refit", refit)
    assert list(ml.refit_models(folds, history.withColumn("params", params), 3).items()) == [("xgb", ["xgb"]), ("cb", ["cb"]), ("rf", ["rf"])]


def test_learners_of_a_query_are_fitted_side_by_side(spark, monkeypatch):
    from threading import Barrier

    from workload import learning

    both = Barrier(2, timeout=20)
    monkeypatch.setattr(learning, "fold_scores", lambda s, m, classes: both.wait() and None or spark.range(classes))
    assert sorted((r["id"], r["model"]) for r in learning.models_scores(None, ("cb", "rf")).collect()) == [(0, "cb"), (0, "rf"), (1, "cb"), (1, "rf")]


@pytest.mark.parametrize("name, operator", [("export_3class", "export_topk_predictions"), ("refit_3class", "refit_best"), ("vote_3class", "ensemble_refit")])
def test_three_class_queries_take_every_fold(spark, monkeypatch, name, operator):
    from workload import learning
    from workload.registry import ORACLE, QUERIES
    from workload.standins import Tables

    class Seen(Exception):
        pass

    def stop(folds, *rest):
        raise Seen(folds)

    monkeypatch.setattr(Tables, "periods", [])
    monkeypatch.setattr(learning, "_made", {})
    monkeypatch.setattr(learning.Study, "__post_init__", lambda s: setattr(s, "key", ("test",)))
    monkeypatch.setattr(learning.Study, "rows", lambda s, h: None)
    monkeypatch.setattr(learning.Study, "trials", lambda s, h: None)
    monkeypatch.setattr(ml, "fold_table", lambda *a, **k: spark.range(1, 4).withColumnRenamed("id", "fold"))
    monkeypatch.setattr(ml, "prepare_folds", lambda table, *a, **k: sorted(r["fold"] for r in table.collect()))
    monkeypatch.setattr(ml, operator, stop)
    with pytest.raises(Seen) as seen:
        QUERIES[name](spark, "no folder")
    assert seen.value.args[0] == [1, 2, 3] and "fold = 1" not in ORACLE[name]


def test_ensemble_refit_takes_as_many_rounds_as_a_run(spark, monkeypatch):
    from workload import learning
    from workload.registry import QUERIES

    class Seen(Exception):
        pass

    def stop(folds, trials, k, rounds, *rest, **kinds):
        raise Seen(k, rounds)

    monkeypatch.setattr(learning.Study, "__post_init__", lambda s: None)
    monkeypatch.setattr(learning.Study, "folds", lambda s, h: [])
    monkeypatch.setattr(learning.Study, "trials", lambda s, h: None)
    monkeypatch.setattr(ml, "refit_models", stop)
    with pytest.raises(Seen) as seen:
        QUERIES["ensemble_refit"](spark, "no folder")
    assert seen.value.args == (4, None)
    params = ml.base_params(None) | ml.DEFAULT_PARAMS["cb"]
    assert ml.learner("cb", params).getMaxIter() == ml.learner("rf", ml.base_params(None)).getNumTrees() == 1000
