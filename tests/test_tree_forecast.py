"""Tree forecasts against trees walked node by node; polynomial trends against least squares."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from helpers import series
from seafret.operators import forecast, tree_forecast

SMALL = {"rounds": 4, "depth": 3, "rate": 0.5}


def wave(n, phase=0.0):
    return [float(10 + 3 * np.sin(i / 3 + phase) + (i % 7) / 10) for i in range(n)]


def two_series(spark, n=90):
    a = series(spark, {"y": wave(n)})
    return a.union(series(spark, {"y": wave(n - 10, 1.0)}, station="SF_0002"))


def test_flat_trees_equal_spark(spark):
    rows, _ = tree_forecast._levelled(two_series(spark), "y", ["station"], "datetime", False)
    lags = forecast._lag_rows(rows, 3, ["station"])
    model = tree_forecast.fit_one_step(lags, 3, **SMALL)
    z = np.array([r["z"] for r in lags.collect()])
    features = tree_forecast.array_to_vector(F.slice("z", 3, 3)).alias("features")
    want = {tuple(r["features"]): r["prediction"] for r in model.transform(lags.select(features)).collect()}
    got = tree_forecast.flat_trees(model).predict(z[:, 2:5])
    assert np.allclose(got, [want[tuple(x)] for x in z[:, 2:5]], rtol=1e-12)


def test_roll_equals_brute_force_on_two_lags(spark):
    df = two_series(spark)
    rows, _ = tree_forecast._levelled(df, "y", ["station"], "datetime", False)
    model = tree_forecast.fit_one_step(forecast._lag_rows(rows, 2, ["station"]), 2, **SMALL)
    from pyspark.ml.linalg import Vectors

    want = {}
    for s, y in (("SF_0001", wave(90)), ("SF_0002", wave(80, 1.0))):
        past = list(y)
        for _ in range(6):
            past.append(model.predict(Vectors.dense([past[-1], past[-2]])))
        want[s] = past[-6:]
    got = tree_forecast.recursive_forecast_trees(df, "y", 2, 6, **SMALL).collect()
    for s in want:
        assert np.allclose([r["pred"] for r in sorted(got, key=lambda r: r["step"]) if r["station"] == s], want[s], rtol=1e-12)


def test_window_per_series_and_all_test_rows(spark):
    df = two_series(spark)
    at = df.where("station = 'SF_0001'").orderBy("datetime").collect()[60]["datetime"]
    train, test = df.where(F.col("datetime") < at), df.where(F.col("datetime") >= at)
    rows, errors = tree_forecast.searched_tree_forecast(train, test, "y", (2, 4), with_trend=True, **SMALL)
    assert rows.count() == 50 and rows.where("pred is null").count() == 0
    found = errors.collect()
    assert len(found) == 2 and all(r["window"] in (2, 4) and r["mape"] < 1 for r in found)


def test_short_series_get_no_forecast(spark):
    df = two_series(spark).union(series(spark, {"y": [1.0]}, station="SF_0003"))
    got = tree_forecast.recursive_forecast_trees(df, "y", 2, 3, **SMALL)
    assert {r["station"] for r in got.collect()} == {"SF_0001", "SF_0002"}


def test_polynomial_trend(spark):
    y = [2 + 0.3 * i - 0.01 * i * i + 0.2 * (-1) ** i for i in range(50)]
    y[7] = None
    df = series(spark, {"y": y})
    u = (2 * np.arange(50) - 49) / 49
    for degree in (1, 2, 3):
        keep = [i for i in range(50) if y[i] is not None]
        want = np.polynomial.polynomial.polyfit(u[keep], [y[i] for i in keep], degree)
        got = forecast.polynomial_trend(df, "y", degree).first()
        assert got["n"] == 50 and np.allclose(got["coefficients"], want, rtol=1e-8)
        rest = forecast.detrend(df, "y", degree=degree).orderBy("datetime").collect()
        fit = np.polynomial.polynomial.polyval(u, want)
        assert all(r["y_detrended"] is None if y[i] is None else abs(r["y_detrended"] - (y[i] - fit[i])) < 1e-8 for i, r in enumerate(rest))


def test_trend_of_fewer_rows_than_coefficients(spark):
    one = forecast.detrend(series(spark, {"y": [4.0, 5.0]}), "y", degree=3)
    assert one.where("abs(y_detrended) > 1e-6").count() == 0


def test_folds_are_fitted_side_by_side(spark, monkeypatch):
    """No fold waits for another; window and errors are the same as those of its own trees."""
    from threading import Barrier

    together, fit = Barrier(2 * tree_forecast.FOLDS, timeout=60), tree_forecast.fit_one_step

    def met(*args):
        together.wait()
        return fit(*args)

    monkeypatch.setattr(tree_forecast, "fit_one_step", met)
    got = tree_forecast.tree_window_errors(two_series(spark), "y", (2, 3), **SMALL).collect()
    assert {(r["station"], r["window"]): r["n_tested"] for r in got} == {("SF_0001", 2): 27, ("SF_0001", 3): 27, ("SF_0002", 2): 24, ("SF_0002", 3): 24}
    assert all(0 < r["mape"] < 1 for r in got)
