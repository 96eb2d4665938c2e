"""Windows over the series, all cut into chunks (see timeline)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from seafret.operators.timeline import CHUNK_ROWS, CHUNK_SECONDS, POS, by_rows, by_time, nearest_valid, positioned
from seafret.schema import AVERAGED, BASE, KEYS, MAX_LAG, TS, lag_name

MICROS = 1_000_000


def _open_left(w, seconds: int):
    """Frame (t - seconds, t]."""
    return w.rangeBetween(-(seconds * MICROS - 1), 0)


def _std_exprs() -> dict[str, Column]:
    return {"std_ws": F.col("ws"), "std_ASTD": F.col("temp") - F.col("sst"), "std_rh": F.col("rh")}


def _count_in_window(flag: Column, w, seconds: int) -> Column:
    """Exact count over (t - seconds, t] as the difference of two growing counts.

    Growing frames cost one step per row, a sliding frame costs its whole length per row.
    """
    upto = F.sum(flag).over(w.rangeBetween(Window.unboundedPreceding, 0))
    gone = F.sum(flag).over(w.rangeBetween(Window.unboundedPreceding, -seconds * MICROS))
    return upto - F.coalesce(gone, F.lit(0))


def _low(col: str, threshold: float) -> Column:
    return F.when(F.col(col) <= threshold, 1).otherwise(0)


def rolling_mean_10m(
    df: DataFrame,
    cols: list[str] = AVERAGED,
    seconds: int = 600,
    keys: list[str] = KEYS,
    ts: str = TS,
    chunk_seconds: int = CHUNK_SECONDS,
) -> DataFrame:
    """Replace each column by its mean over the window ending at the row."""
    return by_time(
        df,
        lambda w: {c: F.avg(c).over(_open_left(w, seconds)) for c in cols},
        before=seconds * MICROS,
        keys=keys,
        ts=ts,
        chunk_seconds=chunk_seconds,
    )


def rolling_std_10m(
    df: DataFrame,
    exprs: dict[str, Column] | None = None,
    seconds: int = 600,
    keys: list[str] = KEYS,
    ts: str = TS,
    chunk_seconds: int = CHUNK_SECONDS,
) -> DataFrame:
    """Sample standard deviation over the window; null for a single value."""
    return by_time(
        df,
        lambda w: {n: F.stddev_samp(e).over(_open_left(w, seconds)) for n, e in (exprs or _std_exprs()).items()},
        before=seconds * MICROS,
        keys=keys,
        ts=ts,
        chunk_seconds=chunk_seconds,
    )


def fog_count_60m(
    df: DataFrame,
    col: str = "vis",
    threshold: float = 1000,
    seconds: int = 3600,
    keys: list[str] = KEYS,
    ts: str = TS,
    chunk_seconds: int = CHUNK_SECONDS,
) -> DataFrame:
    """Rows at or below the threshold in the window; a missing value is not fog."""
    return by_time(
        df,
        lambda w: {"fog_count": _count_in_window(_low(col, threshold), w, seconds)},
        before=seconds * MICROS,
        keys=keys,
        ts=ts,
        chunk_seconds=chunk_seconds,
    )


def join_windows(
    df: DataFrame,
    cols: list[str] = AVERAGED,
    seconds: int = 600,
    fog_seconds: int = 3600,
    threshold: float = 1000,
    with_std: bool = False,
    keys: list[str] = KEYS,
    ts: str = TS,
    chunk_seconds: int = CHUNK_SECONDS,
) -> DataFrame:
    """Means, fog count and (optionally) deviations of one row, from one exchange and sort."""

    def build(w):
        frame = _open_left(w, seconds)
        out = {c: F.avg(c).over(frame) for c in cols}
        out["fog_count"] = _count_in_window(_low("vis", threshold), w, fog_seconds)
        if with_std:
            out |= {n: F.stddev_samp(e).over(frame) for n, e in _std_exprs().items()}
        return out

    wide = by_time(
        df, build, before=max(seconds, fog_seconds) * MICROS, keys=keys, ts=ts, chunk_seconds=chunk_seconds
    )
    std = list(_std_exprs()) if with_std else []
    return wide.select(*keys, ts, *cols, "fog_count", *std)


def lag_features(
    df: DataFrame,
    cols: list[str] = BASE,
    max_lag: int = MAX_LAG,
    keys: list[str] = KEYS,
    ts: str = TS,
    step: int | None = None,
    size: int = CHUNK_ROWS,
) -> DataFrame:
    """Each column at lags 0..max_lag, replacing the columns themselves."""
    out = by_rows(df, lambda w: _packs(cols, max_lag, w), before=max_lag, keys=keys, ts=ts, step=step, size=size)
    return _unpacked(out, cols, max_lag)


def _packs(cols: list[str], max_lag: int, w) -> dict[str, Column]:
    """The columns as one struct at each lag: one window expression per lag, not per lag and column."""
    pack = F.struct(*[F.col(f"`{c}`") for c in cols])
    return {f"_lag{k}": F.lag(pack, k).over(w) for k in range(1, max_lag + 1)}


def _unpacked(df: DataFrame, cols: list[str], max_lag: int) -> DataFrame:
    packs = [f"_lag{k}" for k in range(1, max_lag + 1)]
    rest = [F.col(f"`{c}`") for c in df.columns if c not in cols and c not in packs]
    lags = [(F.col(f"_lag{k}").getField(c) if k else F.col(f"`{c}`")).alias(lag_name(c, k)) for k in range(max_lag + 1) for c in cols]
    return df.select(*rest, *lags)


def lead_targets(
    df: DataFrame,
    label: str = "label",
    hours: list[int] = (1, 3, 6),
    rows_per_hour: int = 6,
    prefix: str = "y",
    keys: list[str] = KEYS,
    ts: str = TS,
    step: int | None = None,
    size: int = CHUNK_ROWS,
) -> DataFrame:
    """The label `h` hours ahead as y_h; null at the end of the series."""
    return by_rows(
        df,
        lambda w: {f"{prefix}_{h}": F.lead(label, h * rows_per_hour).over(w) for h in hours},
        after=max(hours) * rows_per_hour,
        keys=keys,
        ts=ts,
        step=step,
        size=size,
    )


def lead_class3(df: DataFrame, label: str = "label3", hours: list[int] = (1, 3, 6), rows_per_hour: int = 6, **how):
    return lead_targets(df, label, hours, rows_per_hour, prefix="y3", **how)


def lags_and_leads(
    df: DataFrame,
    cols: list[str] = BASE,
    labels: dict[str, str] | None = None,
    max_lag: int = MAX_LAG,
    hours: list[int] = (1, 3, 6),
    rows_per_hour: int = 6,
    keys: list[str] = KEYS,
    ts: str = TS,
    step: int | None = None,
    size: int = CHUNK_ROWS,
) -> DataFrame:
    """lag_features and lead_targets in one exchange; `labels` maps column to target prefix."""
    labels = labels or {"label": "y"}

    def build(w):
        out = {
            f"{p}_{h}": F.lead(label, h * rows_per_hour).over(w) for label, p in labels.items() for h in hours
        }
        return out | _packs(cols, max_lag, w)

    wide = by_rows(df, build, before=max_lag, after=max(hours) * rows_per_hour, keys=keys, ts=ts, step=step, size=size)
    return _unpacked(wide, cols, max_lag)


def interpolate_limit(
    df: DataFrame,
    cols: list[str],
    limit: int = 6,
    keys: list[str] = KEYS,
    ts: str = TS,
    step: int | None = None,
    size: int = CHUNK_ROWS,
) -> DataFrame:
    """Linear fill by row position, at most `limit` rows after a valid value.

    Leading nulls stay; after the last valid value it is repeated up to the limit.
    """
    frame = nearest_valid(positioned(df, keys, ts, step), cols, keys, POS, size)
    at = F.col(POS)

    def filled(c: str) -> Column:
        pp, px, np, nx = (F.col(f"_{k}_{c}") for k in ("pp", "px", "np", "nx"))
        slope = F.try_divide((nx - px) * (at - pp), np - pp)
        return F.coalesce(
            F.col(c), F.when(pp.isNull() | (at - pp > limit), None).when(np.isNull(), px).otherwise(px + slope)
        )

    return frame.select(*[filled(c).alias(c) if c in cols else F.col(f"`{c}`") for c in df.columns])


def lag_reduction(
    df: DataFrame,
    col: str,
    window: int = 5,
    keys: list[str] = KEYS,
    ts: str = TS,
    step: int | None = None,
    size: int = CHUNK_ROWS,
) -> DataFrame:
    """Regression table: the `window` values before a row (x1 the latest) and its value y."""
    out = by_rows(
        df.select(*keys, ts, F.col(col).alias("y")),
        lambda w: {f"x{k}": F.lag("y", k).over(w) for k in range(1, window + 1)},
        before=window,
        keys=keys,
        ts=ts,
        step=step,
        size=size,
    )
    return out.where(F.col(f"x{window}").isNotNull())
