from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd

T0 = dt.datetime(2018, 1, 1)


def series(spark, columns: dict[str, list], minutes: int = 10, station: str = "SF_0001", skip: set[int] = frozenset()):
    """One station on a regular grid; positions in `skip` have no row. Nullable doubles."""
    n = len(next(iter(columns.values())))
    rows = [
        (station, T0 + dt.timedelta(minutes=minutes * i), *[None if c[i] is None else float(c[i]) for c in columns.values()])
        for i in range(n)
        if i not in skip
    ]
    fields = ", ".join(f"`{c}` double" for c in columns)
    return spark.createDataFrame(rows, f"station string, datetime timestamp, {fields}")


def values(df, col: str, order: str = "datetime") -> list:
    return [None if v is None or (isinstance(v, float) and np.isnan(v)) else v for v in (r[col] for r in df.orderBy(order).collect())]


def close(a: list, b: list, tol: float = 1e-9) -> bool:
    if len(a) != len(b):
        return False
    return all((x is None) == (y is None) and (x is None or abs(x - y) <= tol * max(1, abs(y))) for x, y in zip(a, b))


def none(s: pd.Series) -> list:
    return [None if pd.isna(x) else x for x in s]
