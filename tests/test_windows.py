"""Chunked windows equal the uncut series, also across chunk borders and gaps."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import Window, functions as F

from helpers import close, none, series, values
from seafret.operators import grid, labels, prep, windows
from seafret.operators.timeline import row_index

RELAXED = dict(deadline=None, suppress_health_check=list(HealthCheck))
GAPS = {3, 4, 5, 11, 17, 18, 30, 31, 32, 33, 34, 35, 36, 37, 38, 39, 40, 41}


def rng_series(n: int, seed: int, null_share: float = 0.2) -> list:
    r = np.random.default_rng(seed)
    return [None if r.random() < null_share else round(float(x), 3) for x in r.normal(10, 5, n)]


def frame(cols: dict[str, list], minutes: int, skip=frozenset()) -> pd.DataFrame:
    n = len(next(iter(cols.values())))
    index = pd.date_range("2018-01-01", periods=n, freq=f"{minutes}min")
    return pd.DataFrame({c: pd.Series(v, index=index, dtype=float) for c, v in cols.items()})[[i not in skip for i in range(n)]]


@pytest.mark.parametrize("chunk", [700, 1800, 10**7])
def test_rolling_equals_pandas(spark, chunk):
    cols = {c: rng_series(80, i) for i, c in enumerate(["ws", "temp", "sst", "rh", "vis"])}
    df, pdf = series(spark, cols, 1, skip=GAPS), frame(cols, 1, GAPS)
    mean = windows.rolling_mean_10m(df, ["temp", "vis"], chunk_seconds=chunk)
    std = windows.rolling_std_10m(df, chunk_seconds=chunk)
    for c in ("temp", "vis"):
        assert close(values(mean, c), none(pdf[c].rolling("10min").mean()), 1e-7)
    assert close(values(std, "std_ws"), none(pdf.ws.rolling("10min").std()), 1e-6)
    assert close(values(std, "std_ASTD"), none((pdf.temp - pdf.sst).rolling("10min").std()), 1e-6)
    fog = windows.fog_count_60m(df, threshold=8, chunk_seconds=chunk)
    assert values(fog, "fog_count") == [int(x) for x in pdf.vis.le(8).rolling("60min").sum()]


def test_one_exchange_for_all_minute_windows(spark):
    cols = {c: rng_series(40, i) for i, c in enumerate(["u", "v", "ws", "temp", "sst", "qff", "rh", "vis"])}
    df = windows.join_windows(series(spark, cols, 1), with_std=True)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    assert df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("size", [5, 13, 10_000])
@pytest.mark.parametrize("step", [None, 600])
def test_lag_lead_across_chunks(spark, size, step):
    v = rng_series(60, 3)
    df = series(spark, {"temp": v, "label": [float(i % 3 == 0) for i in range(60)]})
    lagged = windows.lag_features(df, ["temp"], 12, step=step, size=size)
    pdf = frame({"temp": v}, 10)
    for k in (0, 1, 5, 12):
        assert close(values(lagged, f"temp_lag{k:02d}"), none(pdf.temp.shift(k)))
    led = windows.lead_targets(df, rows_per_hour=6, step=step, size=size)
    label = pd.Series([float(i % 3 == 0) for i in range(60)])
    for h in (1, 3, 6):
        assert close(values(led, f"y_{h}"), none(label.shift(-6 * h)))


def test_positional_lag_ignores_time_gaps(spark):
    v = rng_series(60, 4, 0)
    df = series(spark, {"temp": v}, skip=GAPS)
    kept = [x for i, x in enumerate(v) if i not in GAPS]
    lagged = windows.lag_features(df, ["temp"], 3, size=4)
    assert close(values(lagged, "temp_lag03"), [None] * 3 + kept[:-3])


def test_row_index_with_hot_series(spark):
    df = spark.range(5000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 50)).alias("station"),
        F.timestamp_seconds(1514764800 + F.col("id") * 977).alias("datetime"),
    )
    got = row_index(df, chunk_seconds=86400)
    want = df.withColumn("want", F.row_number().over(Window.partitionBy("station").orderBy("datetime")) - 1)
    assert got.join(want, ["station", "datetime"]).where("_pos != want").count() == 0
    assert got.count() == 5000


def test_interpolation_example(spark):
    v = [1, None, None, 4, 5] + [None] * 9 + [14] + [None] * 8
    df = series(spark, {"temp": v})
    for size in (4, 7, 1000):
        got = values(windows.interpolate_limit(df, ["temp"], 6, size=size, step=600), "temp")
        assert close(got, [1, 2, 3, 4, 5, 5.9, 6.8, 7.7, 8.6, 9.5, 10.4, None, None, None, 14] + [14] * 6 + [None] * 2)


@settings(max_examples=12, **RELAXED)
@given(
    st.lists(st.one_of(st.none(), st.none(), st.integers(0, 50)), min_size=1, max_size=40),
    st.integers(1, 4),
    st.sampled_from([3, 8, 500]),
)
def test_interpolation_equals_pandas(spark, v, limit, size):
    want = pd.Series(v, dtype=float).interpolate(method="linear", limit=limit)
    got = windows.interpolate_limit(series(spark, {"temp": v}), ["temp"], limit, size=size, step=600)
    assert close(values(got, "temp"), none(want), 1e-9)


def smooth_plain(v: list[int], rows: int = 5) -> list[int]:
    out = list(v)
    fog = [i for i, x in enumerate(v) if x == 1]
    for a, b in zip(fog, fog[1:]):
        if b - a <= rows:
            out[a:b] = [1] * (b - a)
    n = len(out)
    lone = [i for i in range(rows, n - rows) if out[i] == 1 and sum(out[i - rows : i + rows + 1]) == 1]
    return [0 if i in lone else x for i, x in enumerate(out)]


@settings(max_examples=12, **RELAXED)
@given(st.lists(st.sampled_from([0, 0, 0, 0, 1]), min_size=1, max_size=50), st.sampled_from([3, 11, 500]))
def test_smoothing_equals_plain(spark, v, size):
    df = series(spark, {"label": v})
    assert values(labels.smooth_labels(df, size=size, step=600), "smoothed") == smooth_plain(v)


def test_smoothing_points(spark):
    v = [0, 0, 0, 0, 0, 1, 0, 0, 1, 0, 0, 0, 0, 0, 0, 0]
    df = series(spark, {"label": v})
    for size in (3, 100):
        assert [i for i, x in enumerate(values(labels.smooth_start_points(df, size=size, step=600), "is_start")) if x] == [5]
        assert [i for i, x in enumerate(values(labels.smooth_end_points(df, size=size, step=600), "is_end")) if x] == [8]


def test_spine_and_gaps(spark):
    df = series(spark, {"temp": rng_series(60, 5)}, skip=GAPS)
    full = grid.regular_grid(df, 600)
    assert full.count() == 60 and full.where("temp is null").count() >= len(GAPS)
    assert grid.grid_gaps(df, 600).count() == len(GAPS)
    assert grid.grid_gaps(df, 600, "2018-01-01", "2018-01-02").count() == 144 - (60 - len(GAPS))
    assert grid.step_uniformity(full).first()["n_steps"] == 1
    assert grid.step_uniformity(df).first()["mode_step"] == 600


def test_clip_keeps_missing(spark):
    df = series(spark, {"vis20": [None, 1, 5000, 700]})
    assert values(prep.clip_visibility(df), "vis") == [None, 20, 3000, 700]


def test_lag_reduction(spark):
    df = series(spark, {"y": list(range(10))})
    rows = windows.lag_reduction(df, "y", 5, size=3).orderBy("datetime").collect()
    assert [(r["y"], r["x1"], r["x5"]) for r in rows] == [(i, i - 1, i - 5) for i in range(5, 10)]


def test_spine_before_1970(spark):
    bounds = spark.createDataFrame([("s", -5, 3), ("t", -25000, -9990)], "station string, first long, last long")
    got = grid.spine(bounds, 600)
    assert got.where("station = 's'").count() == 9
    assert got.where("station = 't'").distinct().count() == 25000 - 9990 + 1
    low = got.where("station = 's'").agg(F.min(F.unix_seconds("datetime"))).first()[0]
    assert low == -5 * 600
