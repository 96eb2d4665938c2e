"""Ordered work on long series without putting a series into one task.

A window over ``partitionBy(station)`` puts a whole station into one task. Here every
series is cut into chunks of fixed length along a position (time or row number), rows
near a border are copied into the neighbour chunk (the halo), windows run per
(station, chunk), and the copies are dropped. Frames that never reach further than the
halo give exactly the result of the uncut series.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from seafret.functions.columns import floor_div, slot
from seafret.schema import KEYS, TS

CHUNK = "_chunk"
CORE = "_core"
POS = "_pos"

CHUNK_SECONDS = 30 * 86400
CHUNK_ROWS = 5000

Build = Callable[[WindowSpec], dict[str, Column]]


def spread(df: DataFrame, pos: str, size: int, before: int = 0, after: int = 0) -> DataFrame:
    """Give each row its chunk and copy it to chunks whose frames reach it.

    A row serves every chunk with a core position q where q - before <= pos <= q + after.
    """
    own = floor_div(F.col(pos), size)
    if before == 0 and after == 0:
        return df.withColumn(CHUNK, own).withColumn(CORE, F.lit(True))
    first = floor_div(F.col(pos) - after, size)
    last = floor_div(F.col(pos) + before, size)
    return df.withColumn(CHUNK, F.explode(F.sequence(first, last))).withColumn(CORE, F.col(CHUNK) == own)


def chunk_window(keys: list[str], pos: str) -> WindowSpec:
    return Window.partitionBy(*keys, CHUNK).orderBy(pos)


def over_chunks(
    df: DataFrame,
    build: Build,
    pos: str,
    size: int,
    before: int = 0,
    after: int = 0,
    keys: list[str] = KEYS,
) -> DataFrame:
    """Add the window columns `build(w)` returns; one exchange and one sort."""
    keep = df.columns
    columns = build(chunk_window(keys, pos))
    out = spread(df, pos, size, before, after).select(
        *[F.col(f"`{c}`") for c in keep if c not in columns], *[e.alias(n) for n, e in columns.items()], CORE
    )
    return out.where(CORE).drop(CORE)


def row_index(
    df: DataFrame, keys: list[str] = KEYS, ts: str = TS, name: str = POS, chunk_seconds: int = CHUNK_SECONDS
) -> DataFrame:
    """Number the rows of each series from 0 in time order.

    Rows are counted per time chunk (combined before the shuffle), the counts are summed
    up over the few chunks of a series, and each chunk numbers its own rows from there.
    """
    cut = slot(F.col(ts), chunk_seconds)
    earlier = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        df.groupBy(*keys, cut.alias(CHUNK))
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*keys, CHUNK, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    )
    inside = Window.partitionBy(*keys, CHUNK).orderBy(ts)
    return (
        df.withColumn(CHUNK, cut)
        .join(starts, [*keys, CHUNK])
        .withColumn(name, F.row_number().over(inside) - 1 + F.col("_start"))
        .select(*df.columns, name)
    )


def positioned(
    df: DataFrame, keys: list[str] = KEYS, ts: str = TS, step: int | None = None, name: str = POS
) -> DataFrame:
    """Row position in the series.

    With `step` (seconds of a gap-free grid) the slot number serves and no shuffle is
    needed; otherwise rows are numbered.
    """
    if step:
        return df.withColumn(name, slot(F.col(ts), step))
    return row_index(df, keys, ts, name)


def by_rows(
    df: DataFrame,
    build: Build,
    before: int = 0,
    after: int = 0,
    keys: list[str] = KEYS,
    ts: str = TS,
    step: int | None = None,
    size: int = CHUNK_ROWS,
) -> DataFrame:
    """Row-framed windows that look `before` rows back and `after` rows ahead."""
    frame = positioned(df, keys, ts, step)
    return over_chunks(frame, build, POS, size, before, after, keys).drop(POS)


def by_time(
    df: DataFrame,
    build: Build,
    before: int = 0,
    after: int = 0,
    keys: list[str] = KEYS,
    ts: str = TS,
    chunk_seconds: int = CHUNK_SECONDS,
) -> DataFrame:
    """Range-framed windows over microseconds; `before`/`after` are the reach in microseconds."""
    frame = df.withColumn(POS, F.unix_micros(ts))
    return over_chunks(frame, build, POS, chunk_seconds * 1_000_000, before, after, keys).drop(POS)


def nearest_valid(
    df: DataFrame, cols: list[str], keys: list[str] = KEYS, pos: str = POS, size: int = CHUNK_ROWS
) -> DataFrame:
    """Position and value of the previous and next non-null value of each column.

    The distance is unbounded, so no halo is enough: each chunk also gives its first and
    last valid value, and the chunk that needs one takes it from that small table.
    Adds `_pp_<c>`, `_px_<c>` (previous position, value) and `_np_<c>`, `_nx_<c>` (next),
    including the row itself.
    """
    chunked = spread(df, pos, size)
    valid = {c: F.when(F.col(c).isNotNull(), F.col(pos)) for c in cols}
    edges = chunked.groupBy(*keys, CHUNK).agg(
        *[e.alias(f"{n}_{c}") for c in cols for n, e in {
            "_lp": F.max(valid[c]),
            "_lx": F.max_by(c, valid[c]),
            "_fp": F.min(valid[c]),
            "_fx": F.min_by(c, valid[c]),
        }.items()]
    )
    past = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    future = Window.partitionBy(*keys).orderBy(F.desc(CHUNK)).rowsBetween(Window.unboundedPreceding, -1)
    carried = edges.select(
        *keys,
        CHUNK,
        *[F.last(f"_l{k}_{c}", ignorenulls=True).over(past).alias(f"_cp{k}_{c}") for c in cols for k in "px"],
        *[F.last(f"_f{k}_{c}", ignorenulls=True).over(future).alias(f"_cn{k}_{c}") for c in cols for k in "px"],
    )
    up = Window.partitionBy(*keys, CHUNK).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*keys, CHUNK).orderBy(F.desc(pos)).rowsBetween(Window.unboundedPreceding, 0)

    def near(side: str, w) -> list[Column]:
        return [
            F.coalesce(F.last(value, ignorenulls=True).over(w), F.col(f"_c{side}{k}_{c}")).alias(f"_{side}{k}_{c}")
            for c in cols
            for k, value in (("p", valid[c]), ("x", F.col(c)))
        ]

    return chunked.join(carried, [*keys, CHUNK], "left").select(*df.columns, *near("p", up), *near("n", down))
