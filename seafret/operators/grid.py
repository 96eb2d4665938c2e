"""Regular time grids: spine, gaps, coverage, uniformity."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from seafret.functions.columns import floor_div, slot, slot_time
from seafret.operators.timeline import CHUNK_SECONDS, by_rows
from seafret.schema import KEYS, TS

SPINE_SLOTS = 10_000


def spine(bounds: DataFrame, step: int, keys: list[str] = KEYS, ts: str = TS) -> DataFrame:
    """Every slot from `first` to `last` (slot numbers) per key.

    Slots are made in two stages, so that no row has to hold a whole series and the
    second stage is spread over the cluster.
    """
    block = F.explode(F.sequence(floor_div(F.col("first"), SPINE_SLOTS), floor_div(F.col("last"), SPINE_SLOTS)))
    blocks = bounds.withColumn("_block", block).repartition(*keys, "_block")
    low = F.greatest(F.col("first"), F.col("_block") * SPINE_SLOTS)
    high = F.least(F.col("last"), F.col("_block") * SPINE_SLOTS + SPINE_SLOTS - 1)
    return blocks.select(*keys, F.explode(F.sequence(low, high)).alias("_slot")).select(
        *keys, slot_time(F.col("_slot"), step).alias(ts)
    )


def series_bounds(df: DataFrame, step: int, keys: list[str] = KEYS, ts: str = TS) -> DataFrame:
    at = slot(F.col(ts), step)
    return df.groupBy(*keys).agg(F.min(at).alias("first"), F.max(at).alias("last"))


def regular_grid(df: DataFrame, step: int, keys: list[str] = KEYS, ts: str = TS) -> DataFrame:
    """Add the missing slots of each series as rows of nulls; all rows must lie on the grid."""
    slots = spine(series_bounds(df, step, keys, ts), step, keys, ts)
    return slots.join(df, [*keys, ts], "left")


def grid_gaps(
    df: DataFrame, step: int, start: str | None = None, end: str | None = None, keys: list[str] = KEYS, ts: str = TS
) -> DataFrame:
    """Expected timestamps in [start, end) that have no row; by default between each series' ends."""
    bounds = series_bounds(df, step, keys, ts)
    if start is not None:
        bounds = bounds.withColumn("first", slot(F.lit(start).cast("timestamp"), step))
    if end is not None:
        bounds = bounds.withColumn("last", slot(F.lit(end).cast("timestamp") - F.expr("interval 1 second"), step))
    return spine(bounds, step, keys, ts).join(df.select(*keys, ts), [*keys, ts], "left_anti")


def coverage_counts(
    df: DataFrame, cut: str, starts: DataFrame, end: str, step: int, ts: str = TS
) -> DataFrame:
    """Rows before and from the cut against the slots expected from each station's start."""
    at, until = F.lit(cut).cast("timestamp"), F.lit(end).cast("timestamp")
    counts = df.groupBy("station").agg(
        F.count_if(F.col(ts) < at).alias("rows_before"), F.count_if(F.col(ts) >= at).alias("rows_after")
    )
    return counts.join(starts, "station").select(
        "station",
        "rows_before",
        F.floor((F.unix_seconds(at) - F.unix_seconds("start")) / step).alias("expected_before"),
        "rows_after",
        F.floor((F.unix_seconds(until) - F.unix_seconds(at)) / step).alias("expected_after"),
    )


def time_steps(df: DataFrame, keys: list[str] = KEYS, ts: str = TS) -> DataFrame:
    return by_rows(
        df.select(*keys, ts),
        lambda w: {"step_seconds": F.unix_seconds(ts) - F.unix_seconds(F.lag(ts, 1).over(w))},
        before=1,
        keys=keys,
        ts=ts,
    )


def step_uniformity(df: DataFrame, keys: list[str] = KEYS, ts: str = TS) -> DataFrame:
    """Number of distinct steps and the most frequent one (smallest on a tie)."""
    counts = (
        time_steps(df, keys, ts).where("step_seconds is not null").groupBy(*keys, "step_seconds").agg(F.count("*").alias("n"))
    )
    best = F.max(F.struct("n", (-F.col("step_seconds")).alias("s")))
    return counts.groupBy(*keys).agg(
        F.count("*").alias("n_steps"), (-best["s"]).alias("mode_step"), best["n"].alias("mode_count")
    )


def distinct_station(df: DataFrame) -> DataFrame:
    return df.select("station").distinct()


def null_audit(df: DataFrame, cols: list[str]) -> DataFrame:
    """Null cells per column and in all."""
    each = [F.sum(F.col(f"`{c}`").isNull().cast("long")).alias(c) for c in cols]
    return df.agg(*each).withColumn("total", sum((F.col(f"`{c}`") for c in cols), F.lit(0)).cast("long"))
