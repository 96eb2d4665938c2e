"""Trend, recursive forecasts and window choice on lagged values.

The one-step model is a least-squares fit on the last values. Its sums (the Gram matrix of
the lag table) are made per block of rows and added up, so a series of any length is fitted
without gathering it; only the small matrices reach a solver. A trend is taken off the sums and not
off the rows, so every fold can have its own at no further pass.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from seafret.functions.columns import floor_div
from seafret.operators.scores import error_mae_mape
from seafret.operators.timeline import CHUNK_ROWS, over_chunks, row_index
from seafret.schema import KEYS, TS
from seafret.session import materialize

ROW = "row"
BLOCK = "_block"
BLOCK_ROWS = 1024
# Forecast values that one step of the solver holds at most.
BATCH_VALUES = 1 << 20
# Window lengths tried, least divisor of a percentage error.
WINDOWS = (5, 10, 15, 20, 25, 30)
EPS = 2.220446049250313e-16
# Products of [1, row, value] that a line is made of.
HEAD = ((0, 0), (0, 1), (1, 1), (0, 2), (1, 2))


# ---- trend ---------------------------------------------------------------------------


def _line(rows: DataFrame, col: str, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(
        F.regr_slope(col, ROW).alias("slope"), F.regr_intercept(col, ROW).alias("intercept"), F.count("*").alias("n")
    )


def trend_fit(df: DataFrame, col: str, keys: list[str] = KEYS, ts: str = TS) -> DataFrame:
    """Straight line over the row number of each series."""
    return _line(row_index(df.select(*keys, ts, col), keys, ts, ROW), col, keys)


def _position(n: Column) -> Column:
    """Row number of a series of n rows, moved and scaled to -1 .. 1, where powers stay well apart."""
    return (2 * F.col(ROW) - (n - 1)) / F.greatest(n - 1, F.lit(1))


def _polynomial(rows: DataFrame, col: str, degree: int, keys: list[str]) -> DataFrame:
    """keys, n, coefficients: sums of powers are combined before the shuffle, and one small system is solved per series."""
    sizes = materialize(rows.groupBy(*keys).agg(F.count("*").alias("n")), "sizes")
    placed = rows.join(sizes, keys).where(F.col(col).isNotNull()).withColumn("_u", _position(F.col("n")))
    power = lambda k: F.pow("_u", F.lit(float(k))) if k else F.lit(1.0)
    sums = placed.groupBy(*keys).agg(
        F.array(*[F.sum(power(k)) for k in range(2 * degree + 1)]).alias("left"), F.array(*[F.sum(power(k) * F.col(col)) for k in range(degree + 1)]).alias("right")
    )

    def solve(batches):
        for pdf in batches:
            if len(pdf):
                at = np.add.outer(np.arange(degree + 1), np.arange(degree + 1))
                left, right = np.stack(pdf["left"].to_numpy())[:, at], np.stack(pdf["right"].to_numpy())
                # fewer rows than coefficients: the fit of least norm
                found = [np.linalg.lstsq(a, b, rcond=1e-12)[0] for a, b in zip(left, right)]
                yield pdf[keys].assign(coefficients=found)

    fits = sums.mapInPandas(solve, f"{_types(rows, keys)}, coefficients array<double>")
    return sizes.join(fits, keys, "left")


def polynomial_trend(df: DataFrame, col: str, degree: int = 1, keys: list[str] = KEYS, ts: str = TS) -> DataFrame:
    """Least-squares polynomial of each series: n and coefficients, ascending, of the row number moved and scaled to -1 .. 1."""
    return _polynomial(materialize(row_index(df.select(*keys, ts, col), keys, ts, ROW), "indexed"), col, degree, keys)


def detrend(df: DataFrame, col: str, keys: list[str] = KEYS, ts: str = TS, degree: int = 1) -> DataFrame:
    """`col` less its trend of the given degree, as <col>_detrended."""
    rows = materialize(row_index(df, keys, ts, ROW), "indexed")
    if degree != 1:
        fits = _polynomial(rows.select(*keys, ROW, col), col, degree, keys)
        fits = materialize(fits.select(*keys, F.col("n").alias("_n"), F.col("coefficients").alias("_coefficients")), "trend")
        value = F.col("_coefficients")[degree]
        for k in range(degree - 1, -1, -1):
            value = value * _position(F.col("_n")) + F.col("_coefficients")[k]
        return rows.join(fits, keys).withColumn(f"{col}_detrended", F.col(col) - value).drop("_coefficients", "_n", ROW)
    line = F.col("intercept") + F.col("slope") * F.col(ROW)
    return (
        rows.join(materialize(_line(rows, col, keys).drop("n"), "trend"), keys)
        .withColumn(f"{col}_detrended", F.col(col) - line)
        .drop("slope", "intercept", ROW)
    )


# ---- least squares on lags -----------------------------------------------------------


def _indexed(df: DataFrame, col: str, keys: list[str], ts: str) -> DataFrame:
    """keys, row, y; written once, as sums, last values and trend all read it."""
    return materialize(row_index(df.select(*keys, ts, F.col(col).alias("y")), keys, ts, ROW).drop(ts), "indexed")


def _lag_rows(rows: DataFrame, window: int, keys: list[str], size: int = CHUNK_ROWS) -> DataFrame:
    """Rows with z = [1, row, previous values (latest first), value]; incomplete rows are left out."""

    def build(w):
        return {"z": F.array(F.lit(1.0), F.col(ROW).cast("double"), *[F.lag("y", k).over(w) for k in range(1, window + 1)], F.col("y"))}

    lagged = over_chunks(rows, build, ROW, size, window, 0, keys)
    complete = lagged.where((F.col(ROW) >= window) & ~F.exists("z", lambda x: x.isNull()))
    return complete.select(*keys, ROW, floor_div(F.col(ROW), BLOCK_ROWS).alias(BLOCK), "z")


def _types(df: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)


def _block_grams(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Upper triangle of the sum of z zT per block of at most BLOCK_ROWS rows."""

    def gram(key, pdf: pd.DataFrame) -> pd.DataFrame:
        z = np.stack(pdf["z"].to_numpy())
        return pd.DataFrame([[*key, (z.T @ z)[np.triu_indices(z.shape[1])]]], columns=[*keys, BLOCK, "gram"])

    return rows.groupBy(*keys, BLOCK).applyInPandas(gram, f"{_types(rows, keys)}, {BLOCK} long, gram array<double>")


def _packed(cells: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """Cells of a matrix back into one array per group."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", F.col(value).alias("v"))))
    return cells.groupBy(*by).agg(F.transform(ordered, lambda s: s["v"]).alias(name))


def _matrix(values, window: int) -> np.ndarray:
    side = window + 3
    out = np.zeros((side, side))
    out[np.triu_indices(side)] = np.asarray(values, dtype=float)
    return out + np.triu(out, 1).T


def _detrended(grams: np.ndarray, slope: np.ndarray, intercept: np.ndarray) -> np.ndarray:
    """Gram matrices of [1, lags, value] less a line: a linear map of the sums, one line for each matrix.

    The value at lag k of row i is y - intercept - slope (i - k).
    """
    side = grams.shape[-1]
    lags = np.append(np.arange(1, side - 2), 0)
    m = np.zeros((len(grams), side - 1, side))
    m[:, 0, 0] = 1
    m[:, 1:, 0] = slope[:, None] * lags - intercept[:, None]
    m[:, 1:, 1] = -slope[:, None]
    m[:, np.arange(1, side - 1), np.arange(2, side)] = 1
    return m @ grams @ m.transpose(0, 2, 1)


def _solve(gram: np.ndarray, window: int) -> np.ndarray:
    """Intercept and coefficients of the latest `window` values from stacked Gram matrices of [1, lags, value]."""
    a, b = gram[..., : window + 1, : window + 1], gram[..., : window + 1, -1]
    try:
        return np.linalg.solve(a, b[..., None])[..., 0]
    except np.linalg.LinAlgError:
        flat_a, flat_b = a.reshape(-1, window + 1, window + 1), b.reshape(-1, window + 1)
        fits = [np.linalg.lstsq(x, y, rcond=None)[0] for x, y in zip(flat_a, flat_b)]
        return np.stack(fits).reshape(b.shape)


def _ahead(beta: np.ndarray, past: np.ndarray, steps: int) -> np.ndarray:
    """Values of many series, each fed with its own; `past` has the latest value last."""
    window = beta.shape[1] - 1
    values = np.empty((len(beta), window + steps))
    values[:, :window] = past
    turned = beta[:, :0:-1]
    for k in range(window, window + steps):
        values[:, k] = beta[:, 0] + np.einsum("ij,ij->i", turned, values[:, k - window : k])
    return values[:, window:]


def recursive_forecast(
    df: DataFrame,
    col: str,
    window: int | DataFrame = 5,
    horizon: int | DataFrame = 36,
    with_trend: bool = False,
    keys: list[str] = KEYS,
    ts: str = TS,
) -> DataFrame:
    """Forecast the rows after each series by feeding one-step forecasts back in.

    `window` and `horizon` are numbers, or tables with a column of that name for each series. Series with fewer
    complete lags than coefficients get the least-norm fit; those without a full window of last values get none.
    """
    rows = _indexed(df, col, keys, ts)
    line = materialize(_line(rows, "y", keys), "trend")
    for name, value in (("window", window), ("horizon", horizon)):
        line = line.join(value.select(*keys, name), keys) if isinstance(value, DataFrame) else line.withColumn(name, F.lit(value))
    line = materialize(line.withColumns({n: F.col(n).cast("int") for n in ("window", "horizon")}), "forecast-plan")
    most = window if isinstance(window, int) else line.agg(F.max("window")).first()[0] or 1

    cells = _block_grams(_lag_rows(rows, most, keys), keys).select(*keys, F.posexplode("gram"))
    total = _packed(cells.groupBy(*keys, "pos").agg(F.sum("col").alias("v")), keys, "v", "gram")
    last = rows.join(line.select(*keys, "n", "window"), keys).where(F.col(ROW) >= F.col("n") - F.col("window"))
    ordered = F.array_sort(F.collect_list(F.struct(ROW, "y")))
    tail = last.where(F.col("y").isNotNull()).groupBy(*keys).agg(F.transform(ordered, lambda r: r["y"]).alias("tail"))
    inputs = total.join(tail, keys).join(line, keys)

    def run(batches):
        for pdf in batches:
            pdf = pdf[pdf["tail"].map(len) == pdf["window"]]
            for w, part in pdf.groupby("window"):
                each = max(1, BATCH_VALUES // (int(part["horizon"].max()) + int(w)))
                for i in range(0, len(part), each):
                    some = part.iloc[i : i + each]
                    slope = some["slope"].fillna(0.0).to_numpy() if with_trend else np.zeros(len(some))
                    start = some["intercept"].fillna(0.0).to_numpy() if with_trend else np.zeros(len(some))
                    n, steps = some["n"].to_numpy(), some["horizon"].to_numpy()
                    grams = _detrended(np.stack([_matrix(g, most) for g in some["gram"]]), slope, start)
                    at = n[:, None] - w + np.arange(w)
                    past = np.stack(some["tail"].to_numpy()) - start[:, None] - slope[:, None] * at
                    made = _ahead(_solve(grams, int(w)), past, int(steps.max()))
                    step = np.arange(1, made.shape[1] + 1)
                    made += start[:, None] + slope[:, None] * (n[:, None] - 1 + step)
                    use = step[None, :] <= steps[:, None]
                    index = np.nonzero(use)
                    out = {k: some[k].to_numpy()[index[0]] for k in keys} | {"step": step[index[1]], "pred": made[use]}
                    yield pd.DataFrame(out)

    return inputs.mapInPandas(run, f"{_types(df, keys)}, step long, pred double")


def series_lengths(df: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Rows of each series, as the horizon of a forecast over all of them."""
    return df.groupBy(*keys).agg(F.count("*").cast("int").alias("horizon"))


def forecast_errors(forecast: DataFrame, test: DataFrame, col: str, keys: list[str] = KEYS, ts: str = TS) -> DataFrame:
    """All rows that followed, beside their forecast (null where there is none)."""
    rows = row_index(test.select(*keys, ts, F.col(col).alias("obs")), keys, ts, ROW)
    return rows.withColumn("step", F.col(ROW) + 1).drop(ROW).join(forecast, [*keys, "step"], "left")


def window_errors(
    df: DataFrame,
    col: str,
    windows: tuple[int, ...] = WINDOWS,
    initial: float = 0.7,
    keys: list[str] = KEYS,
    ts: str = TS,
    with_trend: bool = False,
) -> DataFrame:
    """MAPE of each window length over expanding folds.

    Fold k trains on all rows before row n0 + k and tests that row; with a trend, its line is fitted to the same rows.
    The sums before a block are added up over the blocks; inside a block they grow row by row, so every fold has its
    own exact fit although no task sees more than one block. A trend needs a series without missing values at its start.
    """
    most = max(windows)
    indexed = _indexed(df, col, keys, ts)
    rows = _lag_rows(indexed, most, keys)
    cells = _block_grams(rows, keys).select(*keys, BLOCK, F.posexplode("gram"))
    before = Window.partitionBy(*keys, "pos").orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    base = _packed(
        cells.select(*keys, BLOCK, "pos", F.coalesce(F.sum("col").over(before), F.lit(0.0)).alias("v")),
        [*keys, BLOCK],
        "v",
        "gram",
    )
    # the first rows have no complete lags, but the line goes through them too
    early = F.when((F.col(ROW) < most) & F.col("y").isNotNull(), F.array(F.lit(1.0), F.col(ROW).cast("double"), F.col("y")))
    sizes = indexed.withColumn("_e", early).groupBy(*keys).agg(
        F.floor(F.count("*") * initial).alias("n0"),
        *[F.coalesce(F.sum(F.col("_e")[i] * F.col("_e")[j]), F.lit(0.0)).alias(f"h{i}{j}") for i, j in HEAD],
    )
    sizes = materialize(sizes, "sizes")
    tested = rows.join(sizes, keys).where(F.col(BLOCK) >= floor_div(F.col("n0"), BLOCK_ROWS))
    out_cols = [*keys, "window", "n", "ape"]

    def score(key, part: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        if part.empty:
            return pd.DataFrame(columns=out_cols)
        part = part.sort_values(ROW)
        z = np.stack(part["z"].to_numpy())
        first = _matrix(start["gram"].iloc[0], most)
        grown = first + np.cumsum(z[:, :, None] * z[:, None, :], axis=0)
        ahead = np.concatenate([first[None], grown[:-1]])
        line = np.zeros((2, len(z)))
        if with_trend:
            one = part.iloc[0]
            n, i, ii = (ahead[:, a, b] + one[h] for a, b, h in ((0, 0, "h00"), (0, 1, "h01"), (1, 1, "h11")))
            y, iy = ahead[:, 0, -1] + one["h02"], ahead[:, 1, -1] + one["h12"]
            spread = n * ii - i * i
            slope = np.divide(n * iy - i * y, spread, out=np.zeros(len(z)), where=spread > 0)
            line = np.stack([slope, (y - slope * i) / np.maximum(n, 1)])
        grams = _detrended(ahead, *line)
        at = z[:, 1]
        shifted = np.concatenate([z[:, :1], z[:, 2:]], axis=1)
        back = np.append(np.arange(1, most + 1), 0)
        shifted[:, 1:] -= line[1][:, None] + line[0][:, None] * (at[:, None] - back)
        found = []
        for w in windows:
            use = (part[ROW].to_numpy() >= part["n0"].to_numpy()) & (ahead[:, 0, 0] > w + 1)
            if not use.any():
                continue
            beta = _solve(grams[use], w)
            y = z[use, -1]
            pred = np.einsum("ij,ij->i", beta, shifted[use, : w + 1]) + line[1][use] + line[0][use] * at[use]
            ape = np.abs(y - pred) / np.maximum(np.abs(y), EPS)
            found.append([*key[: len(keys)], w, int(use.sum()), float(ape.sum())])
        return pd.DataFrame(found, columns=out_cols)

    parts = (
        tested.groupBy(*keys, BLOCK)
        .cogroup(base.groupBy(*keys, BLOCK))
        .applyInPandas(score, f"{_types(df, keys)}, window long, n long, ape double")
    )
    return parts.groupBy(*keys, "window").agg((F.sum("ape") / F.sum("n")).alias("mape"), F.sum("n").alias("n_folds"))


def forecast_window_search(df: DataFrame, col: str, windows: tuple[int, ...] = WINDOWS, **how) -> DataFrame:
    """Window length with the smallest error per series; the shorter one on a tie."""
    keys = how.get("keys", KEYS)
    errors = window_errors(df, col, windows, **how)
    best = F.min(F.struct("mape", "window"))
    return errors.groupBy(*keys).agg(best.alias("_b")).select(*keys, "_b.window", "_b.mape")


def searched_forecast(
    train: DataFrame,
    test: DataFrame,
    col: str,
    windows: tuple[int, ...] = WINDOWS,
    with_trend: bool = False,
    keys: list[str] = KEYS,
    ts: str = TS,
) -> tuple[DataFrame, DataFrame]:
    """Choose the window of each series, forecast all its test rows; the rows, and window, MAE and MAPE by series."""
    chosen = materialize(forecast_window_search(train, col, windows, keys=keys, ts=ts, with_trend=with_trend), "windows")
    ahead = recursive_forecast(train, col, chosen, series_lengths(test, keys), with_trend, keys, ts)
    rows = materialize(forecast_errors(ahead, test, col, keys, ts), "forecast")
    errors = error_mae_mape(rows.where("obs is not null and pred is not null"), keys)
    return rows, chosen.select(*keys, "window").join(errors, keys)
