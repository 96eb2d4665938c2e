"""Confusion counts and the scores made from them.

Every score starts from one grouped count (combined before the shuffle), so the number of
rows per study does not matter; all ratios are computed on the few counted cells.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from seafret.functions.columns import half_even, safe_ratio
from seafret.schema import KEYS, TS

FOLD_KEYS = ["station", "horizon", "model", "fold"]
STUDY_KEYS = ["station", "horizon", "model"]


def _cell(o: int, p: int) -> str:
    return f"c_{o}_{p}"


def _total(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols)


def cells(df: DataFrame, keys: list[str], labels: list[int], obs: str = "obs", pred: str = "pred") -> DataFrame:
    return df.groupBy(*keys).agg(
        *[F.count_if((F.col(obs) == o) & (F.col(pred) == p)).alias(_cell(o, p)) for o in labels for p in labels]
    )


def confusion_binary(df: DataFrame, keys: list[str] = FOLD_KEYS) -> DataFrame:
    names = {_cell(0, 0): "TN", _cell(0, 1): "FP", _cell(1, 0): "FN", _cell(1, 1): "TP"}
    return cells(df, keys, [0, 1]).withColumnsRenamed(names)


def confusion_3class(df: DataFrame, keys: list[str] = FOLD_KEYS) -> DataFrame:
    """cm1..cm9: rows observed, columns predicted, row by row."""
    names = {_cell(o, p): f"cm{3 * o + p + 1}" for o in range(3) for p in range(3)}
    return cells(df, keys, [0, 1, 2]).withColumnsRenamed(names)


class _Counts:
    """tp, fp, fn per label as expressions on the cells."""

    def __init__(self, labels: list[int]):
        self.labels = labels
        self.all = _total([F.col(_cell(o, p)) for o in labels for p in labels])
        self.hits = _total([F.col(_cell(c, c)) for c in labels])

    def tp(self, c: int) -> Column:
        return F.col(_cell(c, c))

    def fp(self, c: int) -> Column:
        return _total([F.col(_cell(o, c)) for o in self.labels if o != c])

    def fn(self, c: int) -> Column:
        return _total([F.col(_cell(c, p)) for p in self.labels if p != c])

    def present(self, c: int) -> Column:
        return self.tp(c) + self.fp(c) + self.fn(c) > 0

    def macro(self, per_class) -> Column:
        """Mean over the labels present among observations or predictions."""
        value = _total([F.when(self.present(c), per_class(c)).otherwise(0.0) for c in self.labels])
        return F.try_divide(value, _total([self.present(c).cast("int") for c in self.labels]))

    def precision(self, c: int) -> Column:
        return safe_ratio(self.tp(c), self.tp(c) + self.fp(c))

    def recall(self, c: int) -> Column:
        return safe_ratio(self.tp(c), self.tp(c) + self.fn(c))

    def f1(self, c: int) -> Column:
        return safe_ratio(2 * self.tp(c), 2 * self.tp(c) + self.fp(c) + self.fn(c))

    def columns(self) -> dict[str, Column]:
        return {
            "ACC": F.try_divide(self.hits, self.all),
            "PAG": self.macro(self.precision),
            "POD": self.macro(self.recall),
            "F1": self.macro(self.f1),
        }


def score_table(
    df: DataFrame,
    keys: list[str] = FOLD_KEYS,
    labels: list[int] = (0, 1),
    only: list[str] | None = None,
    obs: str = "obs",
    pred: str = "pred",
) -> DataFrame:
    """ACC, PAG (macro precision), POD (macro recall), F1 (macro) per key."""
    metrics = _Counts(list(labels)).columns()
    return cells(df, keys, list(labels), obs, pred).select(
        *keys, *[e.alias(n) for n, e in metrics.items() if only is None or n in only]
    )


def score_accuracy(df: DataFrame, keys: list[str] = FOLD_KEYS, labels: list[int] = (0, 1)) -> DataFrame:
    return score_table(df, keys, labels, ["ACC"])


def score_precision_macro(df: DataFrame, keys: list[str] = FOLD_KEYS, labels: list[int] = (0, 1)) -> DataFrame:
    return score_table(df, keys, labels, ["PAG"])


def score_recall_macro(df: DataFrame, keys: list[str] = FOLD_KEYS, labels: list[int] = (0, 1)) -> DataFrame:
    return score_table(df, keys, labels, ["POD"])


def score_f1_macro(df: DataFrame, keys: list[str] = FOLD_KEYS, labels: list[int] = (0, 1)) -> DataFrame:
    return score_table(df, keys, labels, ["F1"])


def score_one_vs_rest(df: DataFrame, keys: list[str] = FOLD_KEYS, labels: list[int] = (0, 1, 2)) -> DataFrame:
    """Percent scores of each label against the rest; F1 from the rounded values, null if undefined."""
    counts = _Counts(list(labels))

    def row(c: int) -> Column:
        tp, fp, fn = counts.tp(c), counts.fp(c), counts.fn(c)
        return F.struct(
            F.lit(c).alias("label"),
            half_even(F.try_divide(counts.all - fp - fn, counts.all) * 100, 2).alias("acc"),
            half_even(F.when(tp + fp > 0, tp / (tp + fp)) * 100, 2).alias("pag"),
            half_even(F.when(tp + fn > 0, tp / (tp + fn)) * 100, 2).alias("pod"),
        )

    table = cells(df, keys, list(labels)).select(*keys, F.inline(F.array(*[row(c) for c in labels])))
    f1 = F.when(F.col("pag") + F.col("pod") > 0, 2 * F.col("pag") * F.col("pod") / (F.col("pag") + F.col("pod")))
    return table.withColumn("f1", half_even(f1, 2))


def degenerate_fold_guard(df: DataFrame, keys: list[str] = FOLD_KEYS) -> DataFrame:
    """no_fog: nothing observed; all_clear: nothing observed nor predicted either."""
    return (
        df.groupBy(*keys)
        .agg(F.count("*").alias("n"), F.count_if(F.col("obs") == 1).alias("n_obs"), F.count_if(F.col("pred") == 1).alias("n_pred"))
        .withColumns(
            {"no_fog": F.col("n_obs") == 0, "all_clear": (F.col("n_obs") == 0) & (F.col("n_pred") == 0)}
        )
    )


def scored_folds(df: DataFrame, keys: list[str] = FOLD_KEYS, labels: list[int] = (0, 1)) -> DataFrame:
    """Scores of the folds that observed fog, the highest label."""
    counts = _Counts(list(labels))
    fog = max(labels)
    seen = counts.tp(fog) + counts.fn(fog) > 0
    return cells(df, keys, list(labels)).where(seen).select(*keys, *[e.alias(n) for n, e in counts.columns().items()])


def fold_macro_mean(scores: DataFrame, keys: list[str] = STUDY_KEYS, percent: bool = False) -> DataFrame:
    """Mean over folds; `percent` gives 100 times, two decimals."""
    mean = {m: F.avg(m) for m in ("ACC", "PAG", "POD", "F1")}
    if percent:
        mean = {m: half_even(e * 100, 2) for m, e in mean.items()}
    return scores.groupBy(*keys).agg(*[e.alias(m) for m, e in mean.items()])


def vote_ensemble(preds: DataFrame, threshold: float = 0.5, ts: str = TS, classes: int = 2) -> DataFrame:
    """Share of models voting fog against the threshold; a tie is fog.

    With more classes the label most models give, the higher one on a tie.
    """
    if classes > 2:
        votes = F.array_max(F.array(*[F.struct(F.count_if(F.col("pred") == c).alias("n"), F.lit(c).alias("c")) for c in range(classes)]))
        return preds.groupBy("station", "horizon", "fold", ts).agg(
            F.first("obs", ignorenulls=True).alias("obs"), F.when(F.count("pred") > 0, votes["c"]).alias("pred")
        )
    return preds.groupBy("station", "horizon", "fold", ts).agg(
        F.first("obs", ignorenulls=True).alias("obs"), (F.avg("pred") >= threshold).cast("int").alias("pred")
    )


def ensemble_scores(preds: DataFrame, threshold: float = 0.5, classes: int = 2) -> DataFrame:
    """Votes scored per fold with two decimals, then averaged over folds."""
    votes = label_rows(vote_ensemble(preds, threshold, classes=classes))
    folds = scored_folds(votes, ["station", "horizon", "fold"], list(range(classes)))
    rounded = folds.withColumns({m: half_even(F.col(m), 2) for m in ("ACC", "PAG", "POD", "F1")})
    return fold_macro_mean(rounded, ["station", "horizon"])


def label_rows(df: DataFrame) -> DataFrame:
    return df.where(F.col("obs").isNotNull() & F.col("pred").isNotNull())


def summary_pivot(scores: DataFrame, stations: list[str]) -> DataFrame:
    """Rows acc_<h> and f1_<h>, one column per station."""
    tall = scores.select(
        "station",
        F.inline(
            F.array(
                F.struct(F.concat(F.lit("acc_"), F.col("horizon")).alias("score"), F.col("ACC").alias("x")),
                F.struct(F.concat(F.lit("f1_"), F.col("horizon")).alias("score"), F.col("F1").alias("x")),
            )
        ),
    )
    return tall.groupBy("score").pivot("station", stations).agg(F.first("x"))


def scaler_stats(df: DataFrame, cols: list[str], keys: list[str]) -> DataFrame:
    """Mean and population deviation per key and feature, as (keys, feature, mean, std)."""
    wide = df.groupBy(*keys).agg(
        *[F.struct(F.avg(f"`{c}`").alias("mean"), F.stddev_pop(f"`{c}`").alias("std")).alias(c) for c in cols]
    )
    rows = [F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`.mean"), F.col(f"`{c}`.std")) for c in cols]
    return wide.select(*keys, F.inline(F.array(*rows)))


def positive_totals(a: DataFrame, b: DataFrame, keys: list[str] = STUDY_KEYS) -> DataFrame:
    """Predicted positives of two runs per study."""
    tagged = a.select(*keys, F.col("pred").alias("pa"), F.lit(0).alias("pb")).unionByName(
        b.select(*keys, F.lit(0).alias("pa"), F.col("pred").alias("pb"))
    )
    return tagged.groupBy(*keys).agg(F.sum("pa").alias("positives_a"), F.sum("pb").alias("positives_b"))


def pred_parity(a: DataFrame, b: DataFrame, keys: list[str] = [*FOLD_KEYS, TS], extra: list[str] = ()) -> DataFrame:
    """Rows that are positive in exactly one of two runs."""
    left = a.select(*keys, F.col("pred").alias("pred_a"), *[F.col(c).alias(f"{c}_a") for c in extra])
    right = b.select(*keys, F.col("pred").alias("pred_b"), *[F.col(c).alias(f"{c}_b") for c in extra])
    one = F.coalesce("pred_a", F.lit(0)) + F.coalesce("pred_b", F.lit(0))
    return left.join(right, keys, "full").where(one == 1)


def first_mismatch(a: DataFrame, b: DataFrame, keys: list[str] = [*FOLD_KEYS, TS], extra: list[str] = ()) -> DataFrame:
    """One example of a disagreement."""
    return pred_parity(a, b, keys, extra).orderBy(*keys).limit(1)


def error_mae_mape(df: DataFrame, keys: list[str], obs: str = "obs", pred: str = "pred") -> DataFrame:
    """Mean absolute and mean absolute percentage error."""
    gap, eps = F.abs(F.col(obs) - F.col(pred)), 2.220446049250313e-16
    return df.groupBy(*keys).agg(
        F.avg(gap).alias("mae"), F.avg(gap / F.greatest(F.abs(F.col(obs)), F.lit(eps))).alias("mape")
    )


def join_obs_pred(obs: DataFrame, pred: DataFrame, keys: list[str] = ["station", "horizon", "fold", TS]) -> DataFrame:
    return obs.join(pred, keys)
