"""Helpers the operators share: columns by type, bounded broadcasts, joins that survive a hot key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from seafret.session import materialize

#: A key that holds at least one in SHARE of all rows is heavy; there can be no more than SHARE of them.
SHARE = 1000
#: Rows of a few bytes each that may be broadcast after they were counted.
BROADCAST_ROWS = 200_000


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(f"`{name}`"), F.lit(""))


def written(df: DataFrame, name: str) -> DataFrame:
    """The table written to the shared folder and read again: later steps neither recompute nor lose it."""
    return materialize(df, f"llm-{name}")


def attach(rows: DataFrame, groups: DataFrame, key: str, size: str) -> DataFrame:
    """Left join of `groups`, one row per `key` with its number of rows in `size`, to all `rows`.

    Keys with at least 1/SHARE of the rows are at most SHARE keys: they are broadcast, and their rows meet
    no shuffle by that key. All other rows are shuffled by key; none of these keys is large.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    heavy = F.col(size) * SHARE >= total
    values = [c for c in groups.columns if c != key]
    on_top = F.broadcast(groups.filter(heavy).select(F.col(key).alias("__heavy"), F.struct(*values).alias("__first")))
    below = groups.filter(~heavy).select(F.col(key).alias("__light"), F.struct(*values).alias("__second"))
    joined = rows.join(on_top, rows[key] == F.col("__heavy"), "left")
    spread = F.when(F.col("__heavy").isNull(), F.col(key))
    joined = joined.withColumn("__on", spread).withColumn(
        "__salt", F.when(F.col("__on").isNull(), F.xxhash64(*rows.columns)).otherwise(F.lit(0))
    )
    joined = joined.join(
        below.withColumn("__zero", F.lit(0).cast("long")),
        (F.col("__on") == F.col("__light")) & (F.col("__salt") == F.col("__zero")),
        "left",
    )
    got = F.coalesce(F.col("__first"), F.col("__second"))
    return joined.select(*rows.columns, *[got[c].alias(c) for c in values])


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """`df` marked for broadcast if it has no more than `rows` rows, else as it is."""
    return F.broadcast(df) if len(df.select(F.lit(1)).limit(rows + 1).groupBy().count().filter(F.col("count") <= rows).take(1)) else df


def without(docs: DataFrame, dropped: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """Rows of `docs` for which no row of `dropped` has the same keys (null equals null).

    `keys` maps columns of `dropped` to expressions over `docs`; names of `docs` may be anything.
    """
    names = {k: f"__drop_{i}" for i, k in enumerate(keys)}
    small = bounded(dropped.select(*[F.col(k).alias(n) for k, n in names.items()]))
    cond = None
    for k, n in names.items():
        one = keys[k].eqNullSafe(F.col(n))
        cond = one if cond is None else cond & one
    return docs.join(small, cond, "left_anti")
