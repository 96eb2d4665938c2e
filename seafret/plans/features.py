"""Raw minute observations to the feature and label table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from seafret.operators import grid, prep, windows
from seafret.operators.timeline import CHUNK_ROWS, CHUNK_SECONDS
from seafret.schema import BASE, COVARIATES, HORIZONS, KEYS, MAX_LAG, TS
from seafret.session import materialize


@dataclass(frozen=True)
class Settings:
    """Lengths and limits of the preparation; defaults are for 1-minute data."""

    mean_seconds: int = 600
    fog_seconds: int = 3600
    fog_visibility: float = 1000
    grid_seconds: int = 600
    fill_rows: int = 6
    fog_rows: int = 50
    fog3: float = 1000
    clear3: float = 3000
    max_lag: int = MAX_LAG
    horizons: tuple[int, ...] = tuple(HORIZONS)
    rows_per_hour: int = 6
    chunk_seconds: int = CHUNK_SECONDS
    chunk_rows: int = CHUNK_ROWS


def minute_windows(obs: DataFrame, s: Settings = Settings(), with_std: bool = True) -> DataFrame:
    """Wind vector, clipped visibility and all rolling columns of every raw row."""
    frame = prep.clip_visibility(prep.wind_components(obs))
    return windows.join_windows(
        frame,
        seconds=s.mean_seconds,
        fog_seconds=s.fog_seconds,
        threshold=s.fog_visibility,
        with_std=with_std,
        chunk_seconds=s.chunk_seconds,
    )


def model_grid(obs: DataFrame, s: Settings = Settings(), with_std: bool = True, cut: bool = False) -> DataFrame:
    """Gap-free grid with filled columns, physical features and labels.

    Filling reads the thinned rows twice. `cut` writes them (a tenth of the input) to the
    shared folder first, so that the raw windows run once; leave it off when only columns
    that need no filling are used, Spark then drops the rest of the plan.
    """
    thin = prep.grid_filter(minute_windows(obs, s, with_std), every=s.grid_seconds)
    if cut:
        thin = materialize(thin, "grid")
    full = grid.regular_grid(thin, s.grid_seconds)
    filled = windows.interpolate_limit(full, COVARIATES, s.fill_rows, step=s.grid_seconds, size=s.chunk_rows)
    named = prep.thermo_features(prep.fill_visibility(filled)).drop("T")
    return prep.visibility_class3(prep.fog_label(named, s.fog_rows), s.fog3, s.clear3)


def features(obs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Lagged features, targets y_h and y3_h, time columns, deviations, station columns."""
    wide = windows.lags_and_leads(
        model_grid(obs, s, cut=True),
        BASE,
        {"label": "y", "label3": "y3"},
        s.max_lag,
        list(s.horizons),
        s.rows_per_hour,
        KEYS,
        TS,
        s.grid_seconds,
        s.chunk_rows,
    )
    return prep.one_hot_station(prep.time_encoding(wide))
