"""Smoothing of 0/1 fog labels: close short gaps, drop lone rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from seafret.operators.timeline import CHUNK_ROWS, POS, over_chunks, positioned
from seafret.schema import KEYS, TS


def _run(df, build, before, after, keys, ts, step, size):
    return over_chunks(positioned(df, keys, ts, step), build, POS, size, before, after, keys).drop(POS)


def smooth_start_points(
    df: DataFrame, label: str = "label", rows: int = 5, keys=KEYS, ts: str = TS, step=None, size: int = CHUNK_ROWS
) -> DataFrame:
    """is_start: fog with at least one more fog row in the `rows` rows after it (full frame)."""

    def build(w):
        frame = w.rowsBetween(0, rows)
        ok = (F.col(label) == 1) & (F.sum(label).over(frame) >= 2) & (F.count(label).over(frame) == rows + 1)
        return {"is_start": F.coalesce(ok, F.lit(False)).cast("int")}

    return _run(df, build, 0, rows, keys, ts, step, size)


def smooth_end_points(
    df: DataFrame, label: str = "label", rows: int = 5, keys=KEYS, ts: str = TS, step=None, size: int = CHUNK_ROWS
) -> DataFrame:
    """is_end: fog with at least one more fog row in the `rows` rows before it (full frame)."""

    def build(w):
        frame = w.rowsBetween(-rows, 0)
        ok = (F.col(label) == 1) & (F.sum(label).over(frame) >= 2) & (F.count(label).over(frame) == rows + 1)
        return {"is_end": F.coalesce(ok, F.lit(False)).cast("int")}

    return _run(df, build, rows, 0, keys, ts, step, size)


def smooth_fill_gaps(
    df: DataFrame, label: str = "label", rows: int = 5, keys=KEYS, ts: str = TS, step=None, size: int = CHUNK_ROWS
) -> DataFrame:
    """Set rows between two fog rows at most `rows` apart to fog, as column `filled`."""

    def build(w):
        fog_at = F.when(F.col(label) == 1, F.col(POS))
        before = F.last(fog_at, ignorenulls=True).over(w.rowsBetween(-rows, 0))
        after = F.first(fog_at, ignorenulls=True).over(w.rowsBetween(0, rows))
        return {"filled": F.when(after - before <= rows, 1).otherwise(F.col(label))}

    return _run(df, build, rows, rows, keys, ts, step, size)


def smooth_drop_isolated(
    df: DataFrame, label: str = "filled", rows: int = 5, keys=KEYS, ts: str = TS, step=None, size: int = CHUNK_ROWS
) -> DataFrame:
    """Clear fog rows that are alone in their centred full frame, as column `smoothed`."""

    def build(w):
        frame = w.rowsBetween(-rows, rows)
        lone = (
            (F.col(label) == 1)
            & (F.sum(label).over(frame) == 1)
            & (F.count(label).over(frame) == 2 * rows + 1)
        )
        return {"smoothed": F.when(lone, 0).otherwise(F.col(label))}

    return _run(df, build, rows, rows, keys, ts, step, size)


def smooth_labels(
    df: DataFrame, label: str = "label", rows: int = 5, keys=KEYS, ts: str = TS, step=None, size: int = CHUNK_ROWS
) -> DataFrame:
    """Close gaps, then drop lone rows."""
    filled = smooth_fill_gaps(df, label, rows, keys, ts, step, size)
    return smooth_drop_isolated(filled, "filled", rows, keys, ts, step, size).drop("filled")
