import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from seafret.operators import folds, scores, trials, weights

D = dt.datetime(2018, 1, 1)


def table(spark, obs, pred, fold=1):
    rows = [("SF_0001", 1, "cb", fold, D + dt.timedelta(minutes=10 * i), o, p) for i, (o, p) in enumerate(zip(obs, pred))]
    return spark.createDataFrame(rows, "station string, horizon int, model string, fold int, datetime timestamp, obs int, pred int")


def plain(obs, pred):
    out = []
    for c in sorted(set(obs) | set(pred)):
        tp = sum(o == c and p == c for o, p in zip(obs, pred))
        fp = sum(o != c and p == c for o, p in zip(obs, pred))
        fn = sum(o == c and p != c for o, p in zip(obs, pred))
        pr, rc = tp / (tp + fp) if tp + fp else 0, tp / (tp + fn) if tp + fn else 0
        out.append((pr, rc, 2 * tp / (2 * tp + fp + fn)))
    return [np.mean([o == p for o, p in zip(obs, pred)]), *np.mean(out, axis=0)]


@pytest.mark.parametrize(
    "obs,pred,labels",
    [
        ([0, 0, 1, 1, 0], [0, 1, 1, 0, 0], [0, 1]),
        ([0, 0, 0], [0, 0, 0], [0, 1]),
        ([0, 0, 0], [1, 1, 1], [0, 1]),
        ([0, 1, 2, 2, 1, 0], [0, 2, 2, 1, 1, 0], [0, 1, 2]),
        ([0, 2, 2], [0, 0, 0], [0, 1, 2]),
    ],
)
def test_macro_scores(spark, obs, pred, labels):
    row = scores.score_table(table(spark, obs, pred), labels=labels).first()
    assert np.allclose([row["ACC"], row["PAG"], row["POD"], row["F1"]], plain(obs, pred))


def test_one_vs_rest_undefined_is_null(spark):
    rows = {r["label"]: r for r in scores.score_one_vs_rest(table(spark, [0, 0, 2], [0, 2, 2])).collect()}
    assert rows[1]["pag"] is None and rows[1]["f1"] is None and rows[1]["acc"] == 100
    assert rows[2]["pag"] == 50 and rows[2]["pod"] == 100 and rows[2]["f1"] == 66.67


def test_guard_and_fold_mean_skip_clear_folds(spark):
    df = table(spark, [0, 1], [0, 1]).unionByName(table(spark, [0, 0], [0, 0], 2))
    guard = {r["fold"]: r["all_clear"] for r in scores.degenerate_fold_guard(df).collect()}
    assert guard == {1: False, 2: True}
    assert scores.fold_macro_mean(scores.scored_folds(df)).first()["F1"] == 1


def test_vote_tie_is_fog(spark):
    a = table(spark, [1, 0], [1, 0])
    b = table(spark, [1, 0], [0, 0]).withColumn("model", F.lit("rf"))
    votes = scores.vote_ensemble(a.unionByName(b)).orderBy("datetime").collect()
    assert [v["pred"] for v in votes] == [1, 0]


def test_parity(spark):
    a, b = table(spark, [1, 0, 1], [1, 0, 1]), table(spark, [1, 0, 1], [1, 1, 0])
    assert scores.pred_parity(a, b).count() == 2
    assert scores.pred_parity(a, a).count() == 0
    assert scores.first_mismatch(a, b).first()["datetime"] == D + dt.timedelta(minutes=10)


def test_rounding_like_numpy(spark):
    xs = [0.545, 0.125, 0.135, 2.5, 1.005, 0.5, 66.665]
    df = spark.createDataFrame([(x,) for x in xs], "x double").select(scores.half_even(F.col("x"), 2).alias("r"))
    assert [r["r"] for r in df.collect()] == [float(np.round(x, 2)) for x in xs]


def hours(spark, n, label):
    rows = [("SF_0001", D + dt.timedelta(hours=i), label(i)) for i in range(n)]
    return spark.createDataFrame(rows, "station string, datetime timestamp, label int")


def test_folds_are_disjoint_by_day(spark):
    df = hours(spark, 24 * 40, lambda i: int(i % 24 < (i // 24) % 5))
    periods = [("2018-01-25", "2018-02-05"), ("2018-01-10", "2018-01-20")]
    roles = folds.fold_roles(folds.year_folds(folds.day_group(df), periods)).cache()
    assert roles.count() == 2 * df.count()
    shared = roles.where("role != 'test'").groupBy("fold", "day_group").agg(F.count_distinct("role").alias("n"))
    assert shared.where("n > 1").count() == 0
    test = roles.where("fold = 1 and role = 'test'").agg(F.min("datetime"), F.max("datetime")).first()
    assert test[0] == dt.datetime(2018, 1, 25, 1) and test[1] == dt.datetime(2018, 2, 5)
    share = roles.where("fold = 1 and role != 'test'").agg(F.avg((F.col("role") == "valid").cast("int"))).first()[0]
    assert 0.15 < share < 0.27


PERIODS = [("2018-01-25", "2018-02-05"), ("2018-01-10", "2018-01-20")]


@pytest.mark.parametrize("classes", [2, 3])
def test_greedy_parts_are_balanced(spark, classes):
    df = hours(spark, 24 * 90, lambda i: (int(i % 24 < (i // 24) % 5) + int(classes == 3 and i % 24 == 1 and (i // 24) % 4 == 0)))
    days = folds.class_days(df, PERIODS, classes=classes).cache()
    names = [f"n{c}" for c in range(classes)]
    dealt = folds.greedy_group_split(days, classes=classes).cache()
    assert dealt.count() == days.count() and dealt.select("fold", "day_group").distinct().count() == days.count()
    for fold in (1, 2):
        mine = dealt.where(F.col("fold") == fold).toPandas()
        assert set(mine["part"]) == set(range(5))
        for n in names:  # no part is further from a fifth than the largest day of the class
            share = mine.groupby("part")[n].sum() / mine[n].sum()
            assert (share - 0.2).abs().max() <= mine[n].max() / mine[n].sum() + 1e-9


def test_greedy_split_equals_trying_every_part(spark):
    import numpy as np

    r = np.random.default_rng(5)
    rows = [("s", d, 1, *map(int, r.integers(0, [150, 20, 4]))) for d in range(60)]
    got = folds.greedy_group_split(spark.createDataFrame(rows, "station string, day_group int, fold int, n0 long, n1 long, n2 long")).collect()
    total = np.array([x[3:] for x in rows]).sum(axis=0)
    held, want = np.zeros((5, 3)), {}
    for x in sorted(rows, key=lambda x: (-np.std(x[3:]), x[1])):
        tried = []
        for p in range(5):
            after = held.copy()
            after[p] += x[3:]
            tried.append((round(float((after / total).var(axis=0).sum()), 15), held[p].sum(), p))
        want[x[1]] = min(tried)[2]
        held[want[x[1]]] += x[3:]
    assert {r["day_group"]: r["part"] for r in got} == want


def test_bits_say_what_exploded_roles_say(spark):
    df = hours(spark, 24 * 40, lambda i: int(i % 24 < (i // 24) % 5))
    want = folds.fold_roles(folds.year_folds(folds.day_group(df), PERIODS)).select("station", "datetime", "fold", "role")
    bits = folds.fold_bits(df, PERIODS)
    got = folds.by_fold(bits, 2).select("station", "datetime", "fold", "role")
    assert bits.count() == df.count() and got.count() == want.count()
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    plan = folds.by_fold(bits, 2).where("fold = 2")._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and "Generate" not in plan


def test_embargo_against_brute_force(spark):
    df = hours(spark, 24 * 40, lambda i: int(i % 24 < (i // 24) % 5))
    before, after = 6 * 3600, 12 * 3600 + 1
    got = folds.by_fold(folds.fold_bits(df, PERIODS, embargo=(before, after)), 2).toPandas()
    all_rows = folds.by_fold(folds.fold_bits(df, PERIODS), 2).toPandas()
    for fold, (start, end) in enumerate(PERIODS, 1):
        s, e = dt.datetime.fromisoformat(start), dt.datetime.fromisoformat(end)
        far = lambda t: s < t <= e or t <= s - dt.timedelta(seconds=before) or t > e + dt.timedelta(seconds=after)
        want = {t for t in all_rows[all_rows["fold"] == fold]["datetime"] if far(t)}
        mine = got[got["fold"] == fold]
        assert set(mine["datetime"]) == want and len(mine) == len(want) < 24 * 40
        assert set(mine[mine["role"] == "test"]["datetime"]) == {t for t in want if s < t <= e}
        valid, train = (set(mine[mine["role"] == r]["datetime"].dt.date) - {s.date(), e.date()} for r in ("valid", "train"))
        assert valid and not valid & train


def test_weights_with_and_without_fog(spark):
    some = weights.sample_weight_binary(hours(spark, 10, lambda i: int(i < 2)), 0.5).collect()
    assert {r["weight"] for r in some if r["label"] == 0} == {1 / (8 / 3 * 0.5)}
    assert {r["weight"] for r in some if r["label"] == 1} == {1.0}
    none = weights.sample_weight_binary(hours(spark, 10, lambda i: 0), 0.5).collect()
    assert {r["weight"] for r in none} == {1 / (10 * 0.5)}
    only = weights.sample_weight_binary(hours(spark, 10, lambda i: 1), 0.5).collect()
    assert {r["weight"] for r in only} == {1.0}


def test_expanding_folds(spark):
    rows = folds.expanding_window_folds(hours(spark, 20, lambda i: 0)).orderBy("fold").collect()
    assert [(r["fold"], r["train_rows"]) for r in rows] == [(k, 14 + k) for k in range(6)]


def trial_rows(spark):
    rows = [
        ("SF_0001", 1, "cb", 1, 0.5), ("SF_0001", 1, "cb", 2, 0.7), ("SF_0001", 1, "cb", 3, 0.7),
        ("SF_0001", 1, "lgb", 4, 0.7), ("SF_0001", 1, "rf", 5, None), ("SF_0001", 1, "rf", 6, 0.9),
        ("SF_0001", 1, "xgb", 7, 0.1),
    ]
    return spark.createDataFrame(rows, "station string, horizon int, model string, trial_id long, value double")


def test_choice_of_models(spark):
    t = trial_rows(spark)
    assert {r["model"]: r["trial_id"] for r in trials.best_trial(t).collect()} == {"cb": 2, "lgb": 4, "rf": 6, "xgb": 7}
    assert trials.best_model(t).first()["model"] == "rf"
    assert trials.join_model_names(trials.topk_models(t, 3)).first()["models"] == "rf_cb_lgb"
    assert {r["model"]: r["place"] for r in trials.argmax_trial(t).collect()}["cb"] == 1
    assert trials.last_n_trials(t, 1).count() == 4
    assert trials.study_complete(t, 2).count() == 2


def test_overrides(spark):
    df = spark.createDataFrame(
        [(1, ["model_params.depth=7", "pos_label_ratio=0.3", "stage=train", "pred_hour=3"])], "trial_id long, overrides array<string>"
    )
    assert {(r["param"], r["value"]) for r in trials.parse_overrides(df).collect()} == {("depth", 7.0), ("pos_label_ratio", 0.3)}
    wide = trials.trial_params_wide(df, ["depth", "gamma"]).first()
    assert wide["depth"] == 7 and wide["gamma"] is None


def test_overlay_ignores_unknown_names(spark):
    key = "station string, horizon int, model string, param string, value double"
    base = spark.createDataFrame([("a", 1, "cb", "depth", 7.0), ("a", 1, "cb", "rate", 0.1)], key)
    best = spark.createDataFrame([("a", 1, "cb", "depth", 9.0), ("a", 1, "cb", "other", 1.0)], key)
    assert {(r["param"], r["value"]) for r in trials.overlay_params(base, best).collect()} == {("depth", 9.0), ("rate", 0.1)}


def test_search_space_is_repeatable_and_on_the_grid(spark):
    t = trial_rows(spark)
    a, b = (trials.search_space(t, 30, 1).collect() for _ in range(2))
    assert sorted(map(str, a)) == sorted(map(str, b))
    for r in a:
        if r["param"] == "boosting":
            assert r["choice"] in trials.BOOSTING
        elif r["param"] == "pos_label_ratio":
            assert r["value"] in trials.RATIOS
        else:
            first, step, n = next((x[1], x[2], x[3]) for x in trials.SPACES[r["model"]] if x[0] == r["param"])
            level = (r["value"] - first) / step
            assert abs(level - round(level)) < 1e-6 and 0 <= round(level) < n
    free = trials.search_space(t, 5, 1, (0.001, 0.6)).where("param = 'pos_label_ratio'").collect()
    assert all(0.001 <= r["value"] <= 0.6 for r in free)
