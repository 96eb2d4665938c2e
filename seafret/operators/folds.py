"""Test periods, day groups, validation days, expanding windows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from seafret.operators.timeline import row_index
from seafret.schema import KEYS, TS, YEAR_PERIODS
from seafret.session import materialize

SPLITS = 5


def in_period(ts: str, start: str, end: str) -> Column:
    """start < t <= end, both at midnight."""
    at = F.col(ts)
    return (at > F.lit(start).cast("timestamp")) & (at <= F.lit(end).cast("timestamp"))


def in_embargo(ts: str, start: str, end: str, embargo: tuple[int, int]) -> Column:
    """Outside the test period, but so close that labels reach into it (seconds before it) or lags reach back to it (seconds after)."""
    at, before, after = F.col(ts), *(F.make_dt_interval(secs=F.lit(s)) for s in embargo)
    near = (at > F.lit(start).cast("timestamp") - before) & (at <= F.lit(end).cast("timestamp") + after)
    return near & ~in_period(ts, start, end)


def year_folds(df: DataFrame, periods: list[tuple[str, str]] = YEAR_PERIODS, ts: str = TS) -> DataFrame:
    """Every row once per fold with `in_test`; the folds are a literal array, not a join."""
    flags = [
        F.struct(F.lit(i + 1).alias("fold"), in_period(ts, start, end).alias("in_test"))
        for i, (start, end) in enumerate(periods)
    ]
    return df.withColumn("_f", F.explode(F.array(*flags))).select(*df.columns, "_f.fold", "_f.in_test")


def period_fold(df: DataFrame, periods: list[tuple[str, str]] = YEAR_PERIODS, ts: str = TS) -> DataFrame:
    """Only the test rows, each with the fold it is tested in (periods do not overlap)."""
    fold = F.coalesce(*[F.when(in_period(ts, s, e), i + 1) for i, (s, e) in enumerate(periods)])
    return df.withColumn("fold", fold).where(F.col("fold").isNotNull())


def day_group(df: DataFrame, ts: str = TS) -> DataFrame:
    return df.withColumn("day_group", F.year(ts) * 366 + F.dayofyear(ts))


def complement_split(df: DataFrame, predicate: Column) -> DataFrame:
    return df.where(~predicate)


def stratified_group_split(
    df: DataFrame, n_splits: int = SPLITS, label: str = "label", keys: list[str] = KEYS
) -> DataFrame:
    """Days of each (series, fold) outside the test period, every n-th of them for validation.

    Days are dealt in order of their fog rows, so the parts get similar shares. Rows are
    reduced to days before anything is ordered.
    """
    days = (
        df.where(~F.col("in_test"))
        .groupBy(*keys, "fold", "day_group")
        .agg(F.count("*").alias("n_rows"), F.sum(F.col(label).cast("long")).alias("n_fog"))
    )
    deal = Window.partitionBy(*keys, "fold").orderBy(F.desc("n_fog"), "day_group")
    return days.withColumn("is_valid", (F.row_number().over(deal) - 1) % n_splits == 0)


def fold_roles(
    df: DataFrame, n_splits: int = SPLITS, label: str = "label", keys: list[str] = KEYS
) -> DataFrame:
    """role: test, valid or train; needs year_folds and day_group.

    The day table is written first; its real size then decides how it is joined.
    """
    days = stratified_group_split(df, n_splits, label, keys).select(*keys, "fold", "day_group", "is_valid")
    days = materialize(days, "days")
    role = F.when(F.col("in_test"), "test").when(F.col("is_valid"), "valid").otherwise("train")
    return df.join(days, [*keys, "fold", "day_group"], "left").withColumn("role", role).drop("is_valid")


def class_days(
    df: DataFrame, periods: list[tuple[str, str]], label: str = "label", keys: list[str] = KEYS, classes: int = 3, ts: str = TS,
    embargo: tuple[int, int] = (0, 0),
) -> DataFrame:
    """Rows per class of each (series, fold, day) outside the test period: n0, n1, ... ; rows are counted once, not once per fold."""
    counts = [
        F.count_if(~in_period(ts, start, end) & ~in_embargo(ts, start, end, embargo) & (F.col(label) == c)).alias(f"_{k}_{c}")
        for k, (start, end) in enumerate(periods, 1)
        for c in range(classes)
    ]
    by_day = day_group(df, ts).groupBy(*keys, "day_group").agg(*counts)
    folds = [
        F.struct(F.lit(k).alias("fold"), *[F.col(f"_{k}_{c}").alias(f"n{c}") for c in range(classes)]) for k in range(1, len(periods) + 1)
    ]
    days = by_day.select(*keys, "day_group", F.explode(F.array(*folds)).alias("_f")).select(*keys, "day_group", "_f.*")
    return days.where(sum([F.col(f"n{c}") for c in range(1, classes)], F.col("n0")) > 0)


def greedy_group_split(days: DataFrame, n_splits: int = SPLITS, keys: list[str] = KEYS, classes: int = 3) -> DataFrame:
    """`part` 0 .. n_splits - 1 of every day of `class_days`, so that all classes are spread evenly over the parts.

    Days come in order of the spread of their class counts, largest first, and go to the part whose class shares then vary
    least (then to the one with fewest rows, then the first). The state of a (series, fold) is one counter per part and class, and its
    input one row per day.
    """
    names = [f"n{c}" for c in range(classes)]

    def deal(pdf: pd.DataFrame) -> pd.DataFrame:
        counts = pdf[names].to_numpy(np.float64)
        total = np.maximum(counts.sum(axis=0), 1)
        order = np.lexsort((pdf["day_group"].to_numpy(), -counts.std(axis=1)))
        held, rows = np.zeros((n_splits, classes)), np.zeros(n_splits)
        part = np.zeros(len(pdf), np.int64)
        for i in order:
            # the sum of shares does not depend on the part, so the cross term alone tells the variances apart
            cost = held @ (counts[i] / total**2)
            best = np.lexsort((np.arange(n_splits), rows, cost))[0]
            part[i] = best
            held[best] += counts[i]
            rows[best] += counts[i].sum()
        return pdf.assign(part=part.astype(np.int32))

    schema = T.StructType([*days.schema.fields, T.StructField("part", T.IntegerType())])
    return days.groupBy(*keys, "fold").applyInPandas(deal, schema)


def fold_bits(
    df: DataFrame, periods: list[tuple[str, str]] = YEAR_PERIODS, n_splits: int = SPLITS, label: str = "label", keys: list[str] = KEYS,
    classes: int = 2, ts: str = TS, embargo: tuple[int, int] = (0, 0),
) -> DataFrame:
    """`test_bits` and `valid_bits`: bit k - 1 is set if the row is tested, or validates, in fold k; any other row trains in it.

    With an embargo (seconds before and after a test period) `gap_bits` marks the folds that a row has no part in.

    A row stays one row whatever the number of folds. Two classes are dealt as in `stratified_group_split`, more by
    `greedy_group_split`. The day table is written first; its real size then decides how it is joined.
    """
    days = class_days(df, periods, label, keys, classes, ts, embargo)
    if classes == 2:
        by_fog = Window.partitionBy(*keys, "fold").orderBy(F.desc("n1"), "day_group")
        days = days.withColumn("part", (F.row_number().over(by_fog) - 1) % n_splits)
    else:
        days = greedy_group_split(days, n_splits, keys, classes)
    bit = F.when(F.col("part") == 0, F.expr("shiftleft(1, fold - 1)")).otherwise(0)
    valid = materialize(days.groupBy(*keys, "day_group").agg(F.sum(bit).cast("int").alias("valid_bits")), "days")
    tested = [F.when(in_period(ts, s, e), 1 << k).otherwise(0) for k, (s, e) in enumerate(periods)]
    bits = [sum(tested[1:], tested[0]).cast("int").alias("test_bits"), F.coalesce("valid_bits", F.lit(0)).alias("valid_bits")]
    if any(embargo):
        gaps = [F.when(in_embargo(ts, s, e, embargo), 1 << k).otherwise(0) for k, (s, e) in enumerate(periods)]
        bits.append(sum(gaps[1:], gaps[0]).cast("int").alias("gap_bits"))
    return day_group(df, ts).join(valid, [*keys, "day_group"], "left").select(*df.columns, *bits)


def by_fold(bits: DataFrame, folds: int) -> DataFrame:
    """`fold` and `role` from the bits; choosing one fold leaves a plain scan, as the others are empty by their literal."""
    rest = [c for c in bits.columns if c not in ("test_bits", "valid_bits", "gap_bits")]

    def one(k: int) -> DataFrame:
        has = lambda c: F.col(c).bitwiseAND(1 << (k - 1)) != 0
        role = F.when(has("test_bits"), "test").when(has("valid_bits"), "valid").otherwise("train")
        mine = bits.where(~has("gap_bits")) if "gap_bits" in bits.columns else bits
        return mine.select(*rest, F.lit(k).alias("fold"), role.alias("role"))

    out = one(1)
    for k in range(2, folds + 1):
        out = out.unionByName(one(k))
    return out


def first_fold_only(df: DataFrame) -> DataFrame:
    return df.where(F.col("fold") == 1)


def expanding_window_folds(
    df: DataFrame, initial: float = 0.7, keys: list[str] = KEYS, ts: str = TS
) -> DataFrame:
    """Fold k of a series trains on its first `train_rows` rows and tests the next one.

    One row per fold; the training rows are given by the count instead of being repeated.
    """
    rows = row_index(df.select(*keys, ts), keys, ts, "row")
    sizes = materialize(df.groupBy(*keys).agg(F.floor(F.count("*") * initial).alias("_first")), "sizes")
    return (
        rows.join(sizes, keys)
        .where(F.col("row") >= F.col("_first"))
        .select(*keys, (F.col("row") - F.col("_first")).alias("fold"), F.col("row").alias("train_rows"), F.col(ts).alias("test_time"))
    )
