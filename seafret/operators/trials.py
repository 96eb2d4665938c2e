"""Trial history: parameters, best trials, model choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from seafret.functions.columns import half_even, last_part, study_key
from seafret.schema import MODELS
from seafret.session import materialize

STUDY = ["station", "horizon", "model"]
PLACE = ["station", "horizon"]


def model_order(model: str = "model", order: list[str] = MODELS) -> Column:
    """Place of the model in the order it is tried; breaks ties."""
    return F.array_position(F.array(*[F.lit(m) for m in order]), F.col(model)).cast("int")


def study_name(df: DataFrame) -> DataFrame:
    return df.withColumn("study", study_key(F.col("station"), F.col("horizon"), F.col("model")))


def split_study_name(df: DataFrame, col: str = "study") -> DataFrame:
    """station, horizon and model back from the name (station codes hold one underscore)."""
    part = F.split(col, "_")
    return df.withColumns(
        {
            "station": F.array_join(F.slice(part, F.lit(1), F.size(part) - 2), "_"),
            "horizon": F.element_at(part, -2).cast("int"),
            "model": F.element_at(part, -1),
        }
    )


def run_overrides(df: DataFrame, stop: str = "stage=train", col: str = "overrides") -> DataFrame:
    """Only the overrides before the run settings."""
    at = F.array_position(col, stop)
    return df.withColumn(col, F.when(at > 0, F.slice(col, F.lit(1), (at - 1).cast("int"))).otherwise(F.col(col)))


def parse_overrides(df: DataFrame, keys: list[str] = ["trial_id"], col: str = "overrides") -> DataFrame:
    """a.b.c=value strings as rows (param c, value)."""
    return (
        run_overrides(df, col=col)
        .select(*keys, F.explode(col).alias("_o"))
        .select(
            *keys,
            last_part(F.split_part("_o", F.lit("="), F.lit(1))).alias("param"),
            F.split_part("_o", F.lit("="), F.lit(2)).cast("double").alias("value"),
        )
    )


def trial_params_wide(
    df: DataFrame, names: list[str], keys: list[str] = ["trial_id"], col: str = "overrides"
) -> DataFrame:
    """One column per parameter; row-local, nothing is shuffled."""
    params = F.map_from_entries(
        F.transform(
            col,
            lambda o: F.struct(
                last_part(F.split_part(o, F.lit("="), F.lit(1))), F.split_part(o, F.lit("="), F.lit(2)).cast("double")
            ),
        )
    )
    return run_overrides(df, col=col).select(*keys, params.alias("_m")).select(
        *keys, *[F.try_element_at("_m", F.lit(n)).alias(n) for n in names]
    )


def strip_param_prefix(df: DataFrame, col: str = "param") -> DataFrame:
    return df.withColumn(col, last_part(F.col(col)))


def overlay_params(base: DataFrame, best: DataFrame, keys: list[str] = STUDY) -> DataFrame:
    """Tuned values over the defaults; only names the base knows are taken."""
    tuned = best.select(*keys, "param", F.col("value").alias("_tuned"))
    return (
        base.join(tuned, [*keys, "param"], "left")
        .withColumn("value", F.coalesce("_tuned", "value"))
        .drop("_tuned")
    )


def best_trial(trials: DataFrame, keys: list[str] = STUDY) -> DataFrame:
    """Highest value per study, lowest id on ties; combined before the shuffle."""
    rank = F.struct("value", -F.col("trial_id"))
    rest = [c for c in trials.columns if c not in keys]
    return (
        trials.where(F.col("value").isNotNull())
        .groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), rank).alias("_b"))
        .select(*keys, "_b.*")
    )


def argmax_trial(trials: DataFrame, keys: list[str] = STUDY) -> DataFrame:
    """Place (from 0, in trial order) and value of the best trial, missing values ignored."""
    place = trials.groupBy(*keys).agg(
        F.max_by("trial_id", F.struct("value", -F.col("trial_id"))).alias("trial_id"), F.max("value").alias("best")
    )
    before = trials.select(*keys, F.col("trial_id").alias("_t")).join(materialize(place, "best"), keys)
    return before.groupBy(*keys, "trial_id", "best").agg(F.count_if(F.col("_t") < F.col("trial_id")).alias("place"))


def last_n_trials(trials: DataFrame, n: int = 300, keys: list[str] = STUDY) -> DataFrame:
    """Newest n trials; the row-number filter lets Spark limit each partition before the shuffle."""
    newest = Window.partitionBy(*keys).orderBy(F.desc("trial_id"))
    return trials.withColumn("_r", F.row_number().over(newest)).where(F.col("_r") <= n).drop("_r")


def study_complete(trials: DataFrame, n: int = 300, keys: list[str] = STUDY) -> DataFrame:
    return trials.groupBy(*keys).agg(F.count("*").alias("n_trials")).where(F.col("n_trials") >= n)


def topk_models(trials: DataFrame, k: int) -> DataFrame:
    """Best k models of each place by their best trial, with `rank` from 1."""
    ranked = Window.partitionBy(*PLACE).orderBy(F.desc("value"), model_order())
    return best_trial(trials).withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)


def top2_models(trials: DataFrame) -> DataFrame:
    return topk_models(trials, 2)


def best_model(trials: DataFrame) -> DataFrame:
    return topk_models(trials, 1).drop("rank")


def best_of_refit(scores: DataFrame) -> DataFrame:
    """Best refitted candidate of each place by F1."""
    rest = [c for c in scores.columns if c not in PLACE]
    best = F.max_by(F.struct(*rest), F.struct("F1", -model_order()))
    return scores.groupBy(*PLACE).agg(best.alias("_b")).select(*PLACE, "_b.*")


def join_model_names(ranked: DataFrame, sep: str = "_") -> DataFrame:
    """Names of the chosen models in rank order; at most one per model name."""
    names = F.transform(F.array_sort(F.collect_list(F.struct("rank", "model"))), lambda s: s["model"])
    return ranked.groupBy(*PLACE).agg(F.array_join(names, sep).alias("models"))


def topk_importance(df: DataFrame, k: int = 30, keys: list[str] = STUDY) -> DataFrame:
    """Features with positive importance, best k per study, four decimals."""
    ranked = Window.partitionBy(*keys).orderBy(F.desc("importance"), "feature")
    return (
        df.where(F.col("importance") > 0)
        .withColumn("rank", F.row_number().over(ranked))
        .where(F.col("rank") <= k)
        .withColumn("importance", half_even(F.col("importance"), 4))
    )


# Weight ratios tried for every model.
RATIOS = [0.001, 0.003, 0.005, 0.007, 0.01, 0.05, 0.1, 0.3]

# Fixed values: (parameter, first, step, number of levels) per model.
SPACES = {
    "cb": [
        ("learning_rate", 0.005, 0.01, 11),
        ("depth", 7, 2, 2),
        ("min_data_in_leaf", 1, 1, 31),
        ("l2_leaf_reg", 1, 2, 3),
    ],
    "lgb": [
        ("learning_rate", 0.005, 0.03, 5),
        ("max_depth", 2, 3, 11),
        ("num_leaves", 5, 5, 12),
        ("min_child_samples", 1, 1, 22),
        ("lambda_l2", 0, 2, 4),
    ],
    "rf": [
        ("max_depth", 5, 3, 9),
        ("num_leaves", 2, 3, 11),
        ("min_child_samples", 1, 1, 22),
        ("lambda_l2", 0, 2, 4),
        ("bagging_fraction", 0.5, 0.2, 3),
        ("bagging_freq", 1, 1, 3),
        ("feature_fraction", 0.5, 0.2, 3),
        ("feature_fraction_bynode", 0.5, 0.2, 3),
    ],
    "xgb": [
        ("eta", 0.05, 0.5, 1),
        ("max_depth", 3, 2, 24),
        ("max_leaves", 1, 3, 11),
        ("lambda", 1, 2, 3),
        ("gamma", 0, 0.01, 3),
    ],
}

# Boosting kinds, a choice of lgb only.
BOOSTING = ["gbdt", "dart", "goss"]


def draw(text: Column, levels: Column) -> Column:
    """Reproducible level number from 0 for a text."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % levels


def search_space(studies: DataFrame, n: int, seed: int = 1, ratio_range: tuple[float, float] | None = None) -> DataFrame:
    """n parameter draws for every study as rows (keys, draw, param, value, choice).

    Each level is drawn by hash, so draws need no state and the grid is never built.
    `ratio_range` draws the weight ratio from an interval instead of the list.
    """
    entry = "struct<param: string, first: double, step: double, levels: bigint>"
    space = F.create_map(
        *[
            part
            for model, params in SPACES.items()
            for part in (
                F.lit(model),
                F.array(
                    *[F.struct(F.lit(p), F.lit(float(a)), F.lit(float(s)), F.lit(m)).cast(entry) for p, a, s, m in params],
                    F.struct(F.lit("pos_label_ratio"), F.lit(0.0), F.lit(1.0), F.lit(len(RATIOS))).cast(entry),
                    *(
                        [F.struct(F.lit("boosting"), F.lit(0.0), F.lit(1.0), F.lit(len(BOOSTING))).cast(entry)]
                        if model == "lgb"
                        else []
                    ),
                ),
            )
        ]
    )
    rows = (
        studies.select(*STUDY)
        .distinct()
        .withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(n))))
        .withColumn("_p", F.explode(F.element_at(space, F.col("model"))))
        .select(*STUDY, "draw", "_p.*")
    )
    text = F.concat_ws("|", *STUDY, F.col("draw"), F.col("param"), F.lit(str(seed)))
    level = F.col("_level")
    if ratio_range:
        low, high = ratio_range
        share = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / float(16**8)
        ratio = low + (high - low) * share
    else:
        ratio = F.element_at(F.array(*[F.lit(r) for r in RATIOS]), (level + 1).cast("int"))
    return rows.withColumn("_level", draw(text, F.col("levels"))).select(
        *STUDY,
        "draw",
        "param",
        F.when(F.col("param") == "pos_label_ratio", ratio)
        .when(F.col("param") == "boosting", None)
        .otherwise(F.round(F.col("first") + F.col("step") * level, 6))
        .alias("value"),
        F.when(
            F.col("param") == "boosting", F.element_at(F.array(*[F.lit(b) for b in BOOSTING]), (level + 1).cast("int"))
        ).alias("choice"),
    )
