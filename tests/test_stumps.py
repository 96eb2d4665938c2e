"""Trees of depth one against plain weighted means."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from seafret.operators import ml

PERIODS = [("2018-01-21", "2018-01-30"), ("2018-01-11", "2018-01-20")]
FLAGS = ["a", "b", "c"]
STUMP = {"depth": 1, "min_data_in_leaf": 1, "n_estimators": 1}
RATIO = 0.3


@pytest.fixture(scope="module")
def folds(spark):
    part = lambda salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(100)) / 100.0
    df = spark.range(24 * 30).select(
        F.when(F.col("id") % 3 == 0, "SF_0001").otherwise("SF_0002").alias("station"),
        F.timestamp_seconds(1514764800 + F.col("id") * 3600).alias("datetime"),
        (part("a") > 0.5).cast("double").alias("a"),
        (part("b") > 0.3).cast("double").alias("b"),
        (part("c") > 0.9).cast("double").alias("c"),
        ((part("a") > 0.5) & (part("y") > 0.2)).cast("double").alias("y_1"),
    )
    return ml.prepare_folds(ml.fold_table(ml.training_rows(df, FLAGS, "y_1"), PERIODS), FLAGS)


def plain_stump(x, sign, w):
    """Column of the split and (mean of the low half, mean of the high half)."""
    best = None
    for k in range(x.shape[1]):
        halves = [x[:, k] == v for v in np.unique(x[:, k])]
        sums = [(w[h].sum(), (w * sign)[h].sum()) for h in halves]
        gain = sum(s * s / n for n, s in sums)
        if len(halves) == 2 and (best is None or gain > best[0]):
            best = gain, k, [s / n for n, s in sums]
    return best[1], best[2]


def pulled(df):
    rows = df.select(ml.vector_to_array("features").alias("x"), "label", "weight", "datetime").collect()
    return np.array([r["x"] for r in rows]), np.array([2 * r["label"] - 1 for r in rows]), np.array([r["weight"] for r in rows]), [r["datetime"] for r in rows]


def test_split_leaves_and_probabilities(folds):
    for fit in ml.cv_fit(folds, lambda: ml.learner("cb", STUMP), RATIO):
        x, sign, w, _ = pulled(ml.at_ratio(fit.fold.train.where("not is_valid"), RATIO))
        column, means = plain_stump(x, sign, w)
        assert FLAGS[column] == "a" and means[0] < 0 < means[1]
        tx, _, _, at = pulled(fit.fold.test)
        want = {d: 1 / (1 + np.exp(-2 * means[int(v > 0)])) for d, v in zip(at, tx[:, column])}
        got = ml.predict_proba(PipelineModel([fit.model]), fit.fold.test).collect()
        assert len(got) == len(want)
        assert max(abs(r["p1"] - want[r["datetime"]]) for r in got) < 1e-9
        assert len({round(r["p1"], 9) for r in got}) == 2  # no constant predictor
        assert ml.feature_importance(fit.model, FLAGS).where("importance = 1").first()["feature"] == "a"
