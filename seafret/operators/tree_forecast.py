"""Recursive forecasts with a tree ensemble as the one-step model.

One ensemble of regression trees is fitted by Spark to the lag rows of all series. Its nodes are exported as flat arrays (their
number is bounded by rounds and depth, so they travel with the task) and all series of a batch are rolled forward together.
The lag window of each series is the one with the least error over expanding folds, one ensemble per window and fold.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame, functions as F

from seafret.operators.boosting import kept_bytes
from seafret.operators.forecast import BATCH_VALUES, EPS, ROW, WINDOWS, _indexed, _lag_rows, _line, _types, forecast_errors, series_lengths
from seafret.operators.scores import error_mae_mape
from seafret.schema import KEYS, TS
from seafret.session import cache_room, in_threads, materialize

#: Share of a series in the first training part, and number of expanding folds after it.
INITIAL, FOLDS = 0.7, 3
ROUNDS, DEPTH, RATE = 50, 5, 0.1
#: Fits submitted side by side; they start as their rows fit into memory.
AT_ONCE = 6


@dataclass
class FlatTrees:
    """Nodes of all trees in one row of arrays; a leaf is its own child."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    weights: np.ndarray
    depth: int

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Weighted sum of the trees for each row of `x`."""
        node = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        row = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            node = np.where(x[row, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
        return self.value[node] @ self.weights

    def roll(self, past: np.ndarray, steps: int) -> np.ndarray:
        """`steps` values after `past` (latest last) of every series, each fed with its own."""
        window = past.shape[1]
        values = np.empty((len(past), window + steps))
        values[:, :window] = past
        for k in range(window, window + steps):
            values[:, k] = self.predict(values[:, k - window : k][:, ::-1])
        return values[:, window:]


def flat_trees(model: GBTRegressionModel) -> FlatTrees:
    """The ensemble from Spark's own description of its trees, which lists nodes in preorder with exact numbers."""
    nodes: list[list] = []  # feature, threshold, left, right, value
    roots, deepest = [], 0

    def grow(lines: list[str], at: int) -> int:
        """Read the subtree that starts at a line; returns the line behind it."""
        me = len(nodes)
        text = lines[at].strip()
        if text.startswith("Predict:"):
            nodes.append([0, 0.0, me, me, float(text.split(":")[1])])
            return at + 1
        feature, _, threshold = text.removeprefix("If (feature ").rstrip(")").split(" ")
        nodes.append([int(feature), float(threshold), len(nodes) + 1, 0, 0.0])
        at = grow(lines, at + 1)
        nodes[me][3] = len(nodes)
        return grow(lines, at + 1)  # behind the line of "Else"

    for tree in model.trees:
        roots.append(len(nodes))
        grow(tree.toDebugString.rstrip().split("\n")[1:], 0)
        deepest = max(deepest, tree.depth)
    columns = [np.array(c) for c in zip(*nodes)]
    return FlatTrees(columns[0].astype(np.int64), columns[1].astype(float), columns[2].astype(np.int64), columns[3].astype(np.int64),
                     columns[4].astype(float), np.array(roots), np.array(model.treeWeights), deepest)


def fit_one_step(lags: DataFrame, window: int, rounds: int = ROUNDS, depth: int = DEPTH, rate: float = RATE) -> GBTRegressionModel:
    """One ensemble for the lag rows (`z` = 1, row, previous values, value) of all series."""
    rows = lags.select(array_to_vector(F.slice("z", 3, window)).alias("features"), F.element_at("z", -1).alias("label"))
    return GBTRegressor(maxIter=rounds, maxDepth=depth, stepSize=rate, seed=1).fit(rows)


def _levelled(df: DataFrame, col: str, keys: list[str], ts: str, with_trend: bool) -> tuple[DataFrame, DataFrame]:
    """Rows keys, row, y less the line of their series (0 without trend), and the lines."""
    rows = _indexed(df, col, keys, ts)
    line = _line(rows, "y", keys)
    if not with_trend:
        line = line.withColumns({"slope": F.lit(0.0), "intercept": F.lit(0.0)})
    line = materialize(line.na.fill(0.0, ["slope", "intercept"]), "trend")
    flat = rows.join(line, keys).withColumn("y", F.col("y") - F.col("intercept") - F.col("slope") * F.col(ROW))
    return materialize(flat.select(*keys, ROW, "y"), "levelled"), line


def recursive_forecast_trees(
    df: DataFrame, col: str, window: int | DataFrame = 5, horizon: int | DataFrame = 36, with_trend: bool = False, keys: list[str] = KEYS,
    ts: str = TS, rounds: int = ROUNDS, depth: int = DEPTH, rate: float = RATE,
) -> DataFrame:
    """Forecast the rows after each series by feeding one-step forecasts of the trees back in.

    `window` and `horizon` are numbers, or tables with a column of that name for each series. Series without a full window of last
    values get no forecast.
    """
    rows, line = _levelled(df, col, keys, ts, with_trend)
    plan = line
    for name, value in (("window", window), ("horizon", horizon)):
        plan = plan.join(value.select(*keys, name), keys) if isinstance(value, DataFrame) else plan.withColumn(name, F.lit(value))
    plan = materialize(plan.withColumns({n: F.col(n).cast("int") for n in ("window", "horizon")}), "forecast-plan")
    windows = sorted(r["window"] for r in plan.select("window").distinct().collect())  # one of the windows that were tried

    def one(w: int) -> DataFrame:
        trees = flat_trees(fit_one_step(materialize(_lag_rows(rows, w, keys), "lags"), w, rounds, depth, rate))
        mine = plan.where(F.col("window") == w)
        last = rows.join(mine.select(*keys, "n"), keys).where(F.col(ROW) >= F.col("n") - w)
        ordered = F.array_sort(F.collect_list(F.struct(ROW, "y")))
        tail = last.where(F.col("y").isNotNull()).groupBy(*keys).agg(F.transform(ordered, lambda r: r["y"]).alias("tail"))

        def run(batches):
            for pdf in batches:
                pdf = pdf[pdf["tail"].map(len) == w]
                each = max(1, BATCH_VALUES // (int(pdf["horizon"].max()) + w)) if len(pdf) else 1
                for i in range(0, len(pdf), each):
                    some = pdf.iloc[i : i + each]
                    n, steps = some["n"].to_numpy(), some["horizon"].to_numpy()
                    made = trees.roll(np.stack(some["tail"].to_numpy()), int(steps.max()))
                    step = np.arange(1, made.shape[1] + 1)
                    made += some["intercept"].to_numpy()[:, None] + some["slope"].to_numpy()[:, None] * (n[:, None] - 1 + step)
                    use = step[None, :] <= steps[:, None]
                    index = np.nonzero(use)
                    yield pd.DataFrame({k: some[k].to_numpy()[index[0]] for k in keys} | {"step": step[index[1]], "pred": made[use]})

        return tail.join(mine, keys).mapInPandas(run, f"{_types(df, keys)}, step long, pred double")

    parts = in_threads(one, windows, 2)
    out = parts[0] if parts else df.select(*keys, F.lit(0).cast("long").alias("step"), F.lit(0.0).alias("pred")).limit(0)
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def tree_window_errors(
    df: DataFrame, col: str, windows: tuple[int, ...] = WINDOWS, with_trend: bool = False, keys: list[str] = KEYS, ts: str = TS,
    initial: float = INITIAL, folds: int = FOLDS, rounds: int = ROUNDS, depth: int = DEPTH, rate: float = RATE,
) -> DataFrame:
    """MAPE and number of tested rows of each window and series over expanding folds.

    Fold k trains on the rows of all series before the share initial + k (1 - initial) / folds and tests the rows up to the next one.
    """
    rows, line = _levelled(df, col, keys, ts, with_trend)
    width = (1 - initial) / folds
    part = F.greatest(F.lit(-1.0), F.floor((F.col(ROW) / F.col("n") - initial) / width + 1e-9)).cast("int")

    def lagged(window: int) -> DataFrame:
        found = _lag_rows(rows, window, keys).join(line, keys).withColumn("part", F.least(part, F.lit(folds - 1)))
        return materialize(found, "lags")

    lags = dict(zip(windows, in_threads(lagged, windows, 3)))

    def one(place: tuple[int, int]) -> DataFrame | None:
        window, k = place
        train = lags[window].where(F.col("part") < k)
        n = train.count()
        if not n:
            return None
        with cache_room(train.sparkSession, kept_bytes(n, window)):
            model = fit_one_step(train, window, rounds, depth, rate).setPredictionCol("_p")
        rows_k = lags[window].where(F.col("part") == k).withColumn("features", array_to_vector(F.slice("z", 3, window)))
        back = F.col("intercept") + F.col("slope") * F.col(ROW)
        y = F.element_at("z", -1) + back
        ape = F.abs(y - F.col("_p") - back) / F.greatest(F.abs(y), F.lit(EPS))
        made = model.transform(rows_k).groupBy(*keys).agg(F.sum(ape).alias("ape"), F.count("*").alias("n"))
        return made.withColumn("window", F.lit(window))

    parts = [p for p in in_threads(one, [(w, k) for k in reversed(range(folds)) for w in windows], AT_ONCE) if p is not None]
    tested = parts[0]
    for p in parts[1:]:
        tested = tested.unionByName(p)
    return tested.groupBy(*keys, "window").agg((F.sum("ape") / F.sum("n")).alias("mape"), F.sum("n").alias("n_tested")).select(*keys, "window", "mape", "n_tested")


def searched_tree_forecast(
    train: DataFrame, test: DataFrame, col: str, windows: tuple[int, ...] = WINDOWS, with_trend: bool = False, keys: list[str] = KEYS, ts: str = TS, **how
) -> tuple[DataFrame, DataFrame]:
    """Choose the window of each series, forecast all its test rows; the rows, and window, MAE and MAPE by series."""
    errors = tree_window_errors(train, col, windows, with_trend, keys, ts, **how)
    best = F.min(F.struct("mape", "window"))
    chosen = materialize(errors.groupBy(*keys).agg(best.alias("_b")).select(*keys, "_b.window"), "windows")
    ahead = recursive_forecast_trees(train, col, chosen, series_lengths(test, keys), with_trend, keys, ts, **how)
    rows = materialize(forecast_errors(ahead, test, col, keys, ts), "forecast")
    found = error_mae_mape(rows.where("obs is not null and pred is not null"), keys)
    return rows, chosen.join(found, keys)
