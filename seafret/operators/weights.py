"""Class counts and weights that favour the rare fog rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from seafret.schema import KEYS
from seafret.session import materialize


def class_counts(df: DataFrame, label: str = "label", keys: list[str] = KEYS, classes: int = 2) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count(label).alias("n"), *[F.count_if(F.col(label) == c).alias(f"n{c}") for c in range(classes)]
    )


def _weighted(df: DataFrame, label: str, keys: list[str], rare: int, ratio: float, classes: int) -> DataFrame:
    """Counts are combined before the shuffle and written, one row per series.

    Spark then knows their size and broadcasts them if it is small enough, so the wide
    table is not shuffled by a key that may be hot; otherwise it joins by sorting.
    """
    counts = materialize(class_counts(df, label, keys, classes), "counts").select(
        *keys, F.try_divide(F.lit(1.0), F.col("n0") / (F.col(f"n{rare}") + 1) * ratio).alias("_w0")
    )
    weight = F.when(F.col(label) == 0, F.col("_w0")).when(F.col(label).isNotNull(), 1.0)
    return df.join(counts, keys).withColumn("weight", weight).drop("_w0")


def sample_weight_binary(df: DataFrame, ratio: float, label: str = "label", keys: list[str] = KEYS) -> DataFrame:
    """1 for fog, 1 / (n0 / (n1 + 1) * ratio) for the rest."""
    return _weighted(df, label, keys, 1, ratio, 2)


def sample_weight_3class(df: DataFrame, ratio: float, label: str = "label3", keys: list[str] = KEYS) -> DataFrame:
    """1 / (n0 / (n2 + 1) * ratio) for class 0, 1 for the others."""
    return _weighted(df, label, keys, 2, ratio, 3)


def sample_weight_static(df: DataFrame, w: float, label: str = "label") -> DataFrame:
    return df.withColumn("weight", F.when(F.col(label) == 0, 1.0 / w).when(F.col(label).isNotNull(), 1.0))


def class_weight_params(
    df: DataFrame, label: str = "label", keys: list[str] = KEYS, classes: int = 2
) -> DataFrame:
    """Weight per class for the learner: 1 for class 0, n0 / (n_c + 1) for class c."""
    counts = class_counts(df, label, keys, classes)
    pairs = [F.struct(F.lit(0).alias("class"), F.lit(1.0).alias("class_weight"))] + [
        F.struct(F.lit(c).alias("class"), (F.col("n0") / (F.col(f"n{c}") + 1)).alias("class_weight"))
        for c in range(1, classes)
    ]
    return counts.select(*keys, F.inline(F.array(*pairs)))


def class_weighted(df: DataFrame, label: str = "label", keys: list[str] = KEYS, classes: int = 2) -> DataFrame:
    """Give every row the weight of its class, for learners without a class-weight setting."""
    table = class_weight_params(df, label, keys, classes).select(
        *keys, F.col("class").alias(label), F.col("class_weight").alias("weight")
    )
    return df.join(materialize(table, "class_weights"), [*keys, label], "left")
