"""Fitting, tuning, refitting and scoring of tree classifiers with Spark ML.

A study is one label over one table (a station, or all of them). The rows are written once per
place, unscaled; folds are roles joined to them, and the scaler of a fold is a stage in front of
every fit. Learners see training rows only: validation rows decide when to stop, never a split.
Fits are Spark jobs and are submitted by a small thread pool.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from py4j.protocol import Py4JNetworkError
from pyspark.errors import AnalysisException
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, OneVsRest, OneVsRestModel, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from seafret.operators import boosting, boosting_kinds, boosting_task, folds as fold_ops, prep, scores, trials as trial_ops, weights
from seafret.schema import KEYS, TS, YEAR_PERIODS
from seafret.session import cache_room, fits_in_room, in_threads, materialize, new_path, side_by_side
from seafret.sources import tables

LABEL, WEIGHT, FEATURES, VALID = "label", "weight", "features", "is_valid"
#: Unscaled vectors.
RAW = "raw_features"

# Most rounds (or trees) of a fit, and rounds without a gain after which boosting stops.
ROUNDS = 1000
PATIENCE = 10

# Ours: deepest tree Spark may be asked for. Leaf-limited learners stay far below it.
MAX_DEPTH = 12

LEAVES = ("num_leaves", "max_leaves")
DEPTHS = ("depth", "max_depth")
L2 = ("l2_leaf_reg", "lambda_l2", "lambda")
BY_NODE = "feature_fraction_bynode"

# Names used by the tuned learners and the Spark ML parameters that mean the same.
COMMON = {
    "depth": "maxDepth",
    "max_depth": "maxDepth",
    "min_data_in_leaf": "minInstancesPerNode",
    "min_child_samples": "minInstancesPerNode",
    "gamma": "minInfoGain",
    "bagging_fraction": "subsamplingRate",
    "feature_fraction": "featureSubsetStrategy",
    "random_seed": "seed",
    "seed": "seed",
}
BOOSTED = {**COMMON, "learning_rate": "stepSize", "eta": "stepSize", "n_estimators": "maxIter"}
FOREST = {**COMMON, "n_estimators": "numTrees"}

# Parameters used when a model is not tuned.
DEFAULT_PARAMS = {
    "cb": {"learning_rate": 0.075, "depth": 7, "min_data_in_leaf": 19, "l2_leaf_reg": 3, "pos_label_ratio": 0.005},
    "lgb": {"learning_rate": 0.035, "max_depth": 8, "num_leaves": 55, "min_child_samples": 7, "lambda_l2": 6, "pos_label_ratio": 0.3},
    "rf": {"max_depth": 29, "num_leaves": 8, "min_child_samples": 13, "lambda_l2": 2, "bagging_fraction": 0.5, "bagging_freq": 1, "feature_fraction": 0.7, "feature_fraction_bynode": 0.9, "pos_label_ratio": 0.009},
    "xgb": {"eta": 0.05, "max_depth": 41, "max_leaves": 7, "lambda": 5, "gamma": 0.01, "pos_label_ratio": 0.01},
}


# ---- learners ------------------------------------------------------------------------


class NoUsableFold(ValueError):
    """No fold has fog to test and two classes to train on."""


def effective_params(params: dict) -> dict:
    """Parameters as Spark fits them: a limit of L leaves becomes the depth at which a tree has L leaves.

    The result is stored with a trial, beside what was drawn.
    """
    out = {k: v for k, v in params.items() if k not in LEAVES and v is not None}
    leaves = [int(params[k]) for k in LEAVES if params.get(k)]
    for name in DEPTHS:
        if name in out:
            limits = [int(out[name]), MAX_DEPTH, *[max(1, math.ceil(math.log2(n))) for n in leaves if n > 0]]
            out[name] = min(limits)
    return out


def spark_params(params: dict, names: dict[str, str]) -> dict:
    """Translate known parameters; those without a counterpart are left out."""
    out = {}
    used = effective_params(params)
    if BY_NODE in used:
        # Spark draws columns anew at every node, so the share of the tree and that of the node are one
        used["feature_fraction"] = round(float(used.get("feature_fraction", 1.0)) * float(used.pop(BY_NODE)), 9)
    for name, value in used.items():
        target = names.get(name)
        if target is None:
            continue
        if target in ("maxDepth", "minInstancesPerNode", "seed", "maxIter", "numTrees"):
            value = int(value)
        elif target == "featureSubsetStrategy":
            value = str(value)
        else:
            value = float(value)
        out[target] = value
    return out


def kind_of(params: dict) -> boosting_kinds.Kind:
    """Kind of rounds and L2 term of drawn parameters."""
    l2 = next((float(params[k]) for k in L2 if params.get(k) is not None), 0.0)
    return boosting_kinds.Kind(params.get("boosting") or "gbdt", l2)


def boosted_trees(params: dict, classes: int = 2, label: str = LABEL, joint: bool = False, by_round: bool = False) -> Estimator:
    """Gradient boosted trees; more than two classes are fitted one against the rest, or share one softmax if `joint`.

    With `by_round` L2 terms and the kind of boosting act, which takes a fit of its own for each round.
    """
    settings = {"maxIter": ROUNDS, "seed": 1} | spark_params(params, BOOSTED)
    if joint and by_round:
        raise ValueError("joint boosting has no other kinds of rounds")
    make = boosting_kinds.KindBoosting if by_round else GBTClassifier
    gbt = make(featuresCol=FEATURES, labelCol=label, weightCol=WEIGHT, **settings)
    if by_round:
        gbt.kind = kind_of(params)
    if classes == 2:
        return gbt
    kind = boosting.JointBoosting if joint else OneVsRest
    return kind(classifier=gbt, featuresCol=FEATURES, labelCol=label, weightCol=WEIGHT)


def random_forest(params: dict, label: str = LABEL) -> RandomForestClassifier:
    settings = {"numTrees": ROUNDS, "seed": 1} | spark_params(params, FOREST)
    return RandomForestClassifier(featuresCol=FEATURES, labelCol=label, weightCol=WEIGHT, **settings)


def learner(model: str, params: dict, classes: int = 2, joint: bool = False, by_round: bool = False) -> Estimator:
    """Learner of a model name: cb, lgb and xgb are boosted, rf is a forest."""
    params = DEFAULT_PARAMS[model] | params
    return random_forest(params) if model == "rf" else boosted_trees(params, classes, joint=joint, by_round=by_round)


def early_stopping(clf: Estimator, col: str = VALID, tol: float = 1e-4) -> Estimator:
    """Stop boosting at the first round in which the rows flagged in `col` gain no more; forests are left as they are."""
    if isinstance(clf, OneVsRest):
        return clf.copy().setClassifier(early_stopping(clf.getClassifier(), col, tol))
    if isinstance(clf, GBTClassifier):
        return clf.copy({clf.validationIndicatorCol: col, clf.validationTol: tol})
    return clf


def fit_one_vs_rest(clf: OneVsRest, rows: DataFrame, fit: Callable[[Estimator, DataFrame], Model], classes: int) -> OneVsRestModel:
    """One binary model per class, each fitted like any binary learner, joined to one model."""
    label = clf.getLabelCol()

    def one(c: int) -> Model:
        return fit(clf.getClassifier(), rows.withColumn(label, (F.col(label) == c).cast("double")))

    model = OneVsRestModel(in_threads(one, range(classes)))
    model.set(model.classifier, clf.getClassifier())  # needed to save it
    return model.setFeaturesCol(clf.getFeaturesCol()).setPredictionCol(clf.getPredictionCol()).setRawPredictionCol(clf.getRawPredictionCol())


def fit_classifier(clf: Estimator, rows: DataFrame, patience: int | None = None, classes: int = 2) -> Model:
    """Fit on the rows that are not flagged for validation.

    Boosted learners that stop early get the flagged rows only to decide when; all others never see them. Fits side by side
    start as their rows fit into the memory of the executors, and share out the cores.
    """
    train = rows.where(~F.col(VALID))
    if isinstance(clf, boosting.JointBoosting):
        one = clf.getClassifier()
        stops = patience or (1 if one.isSet(one.validationIndicatorCol) else None)
        return boosting.fit_joint(clf, train, rows.where(VALID), classes, stops)
    if isinstance(clf, OneVsRest):
        return fit_one_vs_rest(clf, rows, lambda c, r: fit_classifier(c, r, patience), classes)
    n = train.count()
    columns = rows.schema[FEATURES].metadata.get("ml_attr", {}).get("num_attrs", 0)
    size = boosting.kept_bytes(n, columns)
    beside = min(side_by_side(), fits_in_room(rows.sparkSession, size))
    with cache_room(rows.sparkSession, size):
        return fit_binary(clf, boosting.packed(rows, n, beside), patience)


def grown_or_fitted(clf: Estimator, rows: DataFrame, patience: int | None = None, classes: int = 2) -> Model:
    """As `fit_classifier`, for models that only label rows: boosting whose rows are one task anyway is grown within it, one class against the rest."""
    if type(clf) is OneVsRest and boosting_task.can_grow(clf.getClassifier()):
        label = clf.getLabelCol()
        against = lambda c: rows.withColumn(label, (F.col(label) == c).cast("double"))
        models = in_threads(lambda c: grown_or_fitted(clf.getClassifier(), against(c), patience), range(classes))
        if all(isinstance(m, boosting_task.GrownModel) for m in models):
            return boosting_task.GrownOneVsRest(models)
        return fit_classifier(clf, rows, patience, classes)
    if patience and classes == 2 and boosting_task.can_grow(clf):
        n = rows.where(~F.col(VALID)).count()
        if n and boosting.fit_tasks(n, rows.sparkSession.sparkContext.defaultParallelism, side_by_side()) == 1:
            return boosting_task.fit_in_task(clf, rows, n, VALID, patience)
    return fit_classifier(clf, rows, patience, classes)


def fit_binary(clf: Estimator, rows: DataFrame, patience: int | None = None) -> Model:
    train = rows.where(~F.col(VALID))
    if isinstance(clf, boosting_kinds.KindBoosting):
        stops = patience or (1 if clf.isSet(clf.validationIndicatorCol) else None)
        return boosting_kinds.fit_kind(clf, train, rows.where(VALID), stops)
    if isinstance(clf, GBTClassifier):
        if patience:
            return boosting.fit_patient(clf, train, rows.where(VALID), patience)
        if clf.isSet(clf.validationIndicatorCol):
            return clf.fit(rows)
    return clf.fit(train)


#: What Spark reports when the cluster failed and not the learner.
LOST = (
    "ExecutorLostFailure", "FetchFailed", "cancelled", "SparkContext was shut down", "SparkContext has been shutdown", "OutOfMemoryError",
    "No space left on device",
)


def is_learner_error(error: Exception) -> bool:
    """Whether a fit failed for its data or settings. Lost machines, full disks, missing tables and a closed session did not."""
    if isinstance(error, (OSError, MemoryError, AnalysisException, Py4JNetworkError)):
        return False
    return not any(sign in str(error) for sign in LOST)


def fit_retry(fit: Callable[[], Model], n: int = 2, fallback: Callable[[], Model] | None = None) -> tuple[Model, str]:
    """Try a fit up to n times, then the fallback; also tells which one worked. Only errors of the learner are retried."""
    error: Exception | None = None
    for attempt in range(1, n + 1):
        try:
            return fit(), f"fit {attempt}"
        except Exception as e:
            if not is_learner_error(e):
                raise
            error = e
    if fallback is None:
        raise error
    return fallback(), "fallback"


def assembler(cols: list[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=cols, outputCol=RAW)


def scaler(cols: list[str]) -> Pipeline:
    return Pipeline(stages=[assembler(cols), StandardScaler(inputCol=RAW, outputCol=FEATURES, withMean=True)])


def fit_pipeline(
    train: DataFrame, cols: list[str], clf: Estimator, valid: DataFrame | None = None, classes: int = 2
) -> PipelineModel:
    """Scale by the training rows, then fit; validation rows are scaled the same way and only stop boosting."""
    scaling = scaler(cols).fit(train)
    rows = scaling.transform(train.withColumn(VALID, F.lit(False)))
    if valid is not None:
        clf = early_stopping(clf)
        rows = rows.unionByName(scaling.transform(valid.withColumn(VALID, F.lit(True))))
    return PipelineModel([*scaling.stages, fit_classifier(clf, rows, None if valid is None else PATIENCE, classes)])


# ---- tables --------------------------------------------------------------------------


def training_rows(
    features: DataFrame, cols: list[str], target: str, classes: int = 2, keys: list[str] = KEYS
) -> DataFrame:
    """Complete rows of one target as keys, features, `label` and the weight for ratio 1."""
    rows = prep.drop_incomplete(features, [*cols, target])
    rows = prep.cast_label(rows.withColumn(LABEL, F.col(target)), LABEL).select(
        *KEYS, TS, *[F.col(f"`{c}`") for c in cols], LABEL
    )
    make = weights.sample_weight_binary if classes == 2 else weights.sample_weight_3class
    return make(rows, 1.0, LABEL, keys)


def at_ratio(rows: DataFrame, ratio: float) -> DataFrame:
    """Weights for another ratio: only class 0 depends on it, so nothing is counted again."""
    return rows.withColumn(WEIGHT, F.when(F.col(LABEL) == 0, F.col(WEIGHT) / ratio).otherwise(F.col(WEIGHT)))


def fold_table(
    rows: DataFrame,
    periods: list[tuple[str, str]] = YEAR_PERIODS,
    keys: list[str] = KEYS,
    name: str = "rows",
    path: str | None = None,
    classes: int = 2,
    embargo: tuple[int, int] = (0, 0),
    cols: list[str] | None = None,
) -> DataFrame:
    """Rows once per fold with their role; with an embargo without those too near to the fold's test period.

    The rows are written once with bits that tell their roles; a fold is read from them by its bit, so neither the table
    nor a scan of one fold holds copies. With `path` the caller owns the written rows (below `path`/rows) and can discard them.
    With `cols` these columns are written as one unscaled vector, from which `prepare_folds` goes on.
    """
    if cols:
        rows = assembler(cols).transform(rows).drop(*cols)
    bits = fold_ops.fold_bits(rows, periods, keys=keys, classes=classes, embargo=embargo)
    written = materialize(bits, name, path and f"{path}/rows")
    return fold_ops.by_fold(written, len(periods))


@dataclass
class Fold:
    """One fold ready to fit: scaled vectors with the validation flag, and test rows."""

    number: int
    scaling: PipelineModel
    train: DataFrame
    test: DataFrame


def usable_folds(table: DataFrame, positive: int = 1) -> list[int]:
    """Folds with fog in the test rows and more than one class to train on."""
    counts = table.groupBy("fold").agg(
        F.count_if((F.col("role") == "test") & (F.col(LABEL) == positive)).alias("fog"),
        F.size(F.collect_set(F.when(F.col("role") == "train", F.col(LABEL)))).alias("classes"),
    )
    return sorted(r["fold"] for r in counts.where("fog > 0 and classes > 1").collect())


def prepare_folds(table: DataFrame, cols: list[str], folds: list[int] | None = None, positive: int = 1) -> list[Fold]:
    """Fit the scaler of each fold, whatever is tuned later.

    Its vectors are scaled as they are read, so that folds add nothing to the one written copy of the rows.
    """
    numbers = usable_folds(table, positive) if folds is None else folds
    if not numbers:
        raise NoUsableFold("no fold has fog rows to test and two classes to train on")
    make, scale = scaler(cols).getStages()
    vectors = table if RAW in table.columns else make.transform(table).drop(*cols)

    def prepare(number: int) -> Fold:
        part = vectors.where(F.col("fold") == number)
        scaling = PipelineModel([make, scale.fit(part.where("role = 'train'"))])
        scaled = scaling.stages[1].transform(part).drop(RAW)
        train = scaled.where("role != 'test'").withColumn(VALID, F.col("role") == "valid")
        return Fold(number, scaling, train, scaled.where("role = 'test'"))

    return in_threads(prepare, numbers)


# ---- evaluation ----------------------------------------------------------------------


def _labelled(model: Model, df: DataFrame) -> DataFrame:
    return model.transform(df).withColumn("pred", F.col("prediction").cast("int"))


@dataclass
class Fit:
    """A fitted fold and how the fit came about."""

    fold: Fold
    model: Model
    status: str


def cv_fit(
    folds: list[Fold], make_clf: Callable[[], Estimator], ratio: float = 1.0, classes: int = 2, patience: int | None = PATIENCE, labels_only: bool = False
) -> list[Fit]:
    """A new model per fold; the folds are fitted side by side.

    If a learner fails with early stopping it is fitted without; `status` says so. With `labels_only` models are for `cv_predict`, not to be saved.
    """
    best = grown_or_fitted if labels_only else fit_classifier

    def fit(fold: Fold) -> Fit:
        train, clf = at_ratio(fold.train, ratio), make_clf()
        model, status = fit_retry(
            lambda: best(early_stopping(clf), train, patience, classes),
            fallback=lambda: fit_classifier(clf, train, None, classes),
        )
        return Fit(fold, model, status)

    return in_threads(fit, folds)


def cv_predict(fitted: list[Fit], keep: list[str] = [*KEYS, TS]) -> DataFrame:
    parts = [
        _labelled(f.model, f.fold.test).select(*keep, F.lit(f.fold.number).alias("fold"), F.col(LABEL).alias("obs"), "pred")
        for f in fitted
    ]
    return prep.union_stations(parts)


def cv_evaluate(
    folds: list[Fold],
    make_clf: Callable[[], Estimator],
    ratio: float = 1.0,
    classes: int = 2,
    patience: int | None = PATIENCE,
) -> DataFrame:
    """Fit and predict every fold; scores per fold."""
    preds = cv_predict(cv_fit(folds, make_clf, ratio, classes, patience))
    return scores.score_table(preds, ["fold"], list(range(classes)))


TRIAL_SCHEMA = "station string, horizon int, model string, trial_id long, value double, ACC double, PAG double, POD double, params map<string,string>, effective map<string,string>, status string"


def draws_of(space: DataFrame) -> list[dict]:
    """Parameter sets of one study, one per draw (trials of a study, not data)."""
    packed = space.groupBy("draw").agg(
        F.map_from_entries(F.collect_list(F.struct("param", F.coalesce(F.col("value").cast("string"), "choice")))).alias("params")
    )
    return [{"draw": r["draw"], "params": r["params"]} for r in packed.orderBy("draw").collect()]


def _number(value: str):
    try:
        return float(value)
    except ValueError:
        return value


def param_search(
    folds: list[Fold],
    study: tuple[str, int, str],
    space: DataFrame,
    rounds: int | None = None,
    done: Iterable[int] = (),
    classes: int = 2,
    parallelism: int = 4,
    sink: Callable[[DataFrame], None] | None = None,
    patience: int | None = PATIENCE,
    by_round: bool = False,
) -> DataFrame:
    """Fit and score every draw of a study, as rows of the trial table.

    Draws in `done` are skipped. `rounds` is the number of rounds or trees where a draw does not give one; drawn
    parameters are never overridden. `sink` gets the finished trials `parallelism` at a time, so a run that stops loses no more.
    """
    station, horizon, model = study
    spark = folds[0].test.sparkSession
    skip = set(done)

    def run(trial: dict) -> tuple:
        drawn = {k: _number(v) for k, v in trial["params"].items()}
        params = base_params(rounds) | drawn
        fits = cv_fit(folds, lambda: learner(model, params, classes, by_round=by_round), drawn.get("pos_label_ratio", 1.0), classes, patience, labels_only=True)
        table = scores.score_table(cv_predict(fits), ["fold"], list(range(classes)))
        row = table.agg(*[F.avg(m).alias(m) for m in ("ACC", "PAG", "POD", "F1")]).first()
        used = {k: str(v) for k, v in effective_params(DEFAULT_PARAMS[model] | params).items()}
        status = ", ".join(f"fold {f.fold.number}: {f.status}" for f in fits)
        return (station, horizon, model, int(trial["draw"]), row["F1"], row["ACC"], row["PAG"], row["POD"], trial["params"], used, status)

    todo = [d for d in draws_of(space) if d["draw"] not in skip]
    rows: list[tuple] = []
    for i in range(0, len(todo), parallelism):
        found = in_threads(run, todo[i : i + parallelism], parallelism)
        if sink:
            sink(spark.createDataFrame(found, TRIAL_SCHEMA))
        rows += found
    return spark.createDataFrame(rows, TRIAL_SCHEMA)


# ---- refits --------------------------------------------------------------------------


def tuned_params(trials: DataFrame) -> dict[str, dict]:
    """Best parameters per model of one study place, over the defaults of the model."""
    best = trial_ops.best_trial(trials, ["model"]).select("model", "params").collect()
    out = {}
    for row in best:
        base = DEFAULT_PARAMS[row["model"]]
        tuned = {k.split(".")[-1]: _number(v) for k, v in row["params"].items()}
        out[row["model"]] = base | {k: v for k, v in tuned.items() if k in base or k == "boosting"}
    return out


def base_params(rounds: int | None) -> dict:
    return {} if rounds is None else {"n_estimators": rounds}


def static_fold(fold: Fold, weight: float) -> Fold:
    """The fold with class 0 weighted 1 / weight and every other row 1, whatever was tuned."""
    return Fold(fold.number, fold.scaling, weights.sample_weight_static(fold.train, weight, LABEL), fold.test)


def class_weighted_fold(fold: Fold, classes: int = 2, keys: list[str] = KEYS) -> Fold:
    """The fold with the weight of its class for every row (1 for class 0, n0 / (n_c + 1) for class c), as learners take class weights."""
    return Fold(fold.number, fold.scaling, weights.class_weighted(fold.train.drop(WEIGHT), LABEL, keys, classes), fold.test)


def refit(
    folds: list[Fold],
    model: str,
    params: dict,
    rounds: int | None = None,
    classes: int = 2,
    patience: int | None = PATIENCE,
    static: bool = False,
    by_round: bool = False,
    labels_only: bool = False,
) -> list[Fit]:
    """Fitted folds of a model with tuned parameters and tuned weight ratio (or the weights the folds have)."""
    ratio = 1.0 if static else params["pos_label_ratio"]
    return cv_fit(folds, lambda: learner(model, base_params(rounds) | params, classes, by_round=by_round), ratio, classes, patience, labels_only)


def refit_models(
    folds: list[Fold],
    trials: DataFrame,
    k: int,
    rounds: int | None = None,
    classes: int = 2,
    patience: int | None = PATIENCE,
    static: bool = False,
    **kinds: bool,
) -> dict[str, list[Fit]]:
    """Refit the k best models of the place side by side, best first; `by_round` and `labels_only` go to the refits."""
    ranked = [r["model"] for r in trial_ops.topk_models(trials, k).orderBy("rank").collect()]
    params = tuned_params(trials)
    fits = in_threads(lambda m: refit(folds, m, params[m], rounds, classes, patience, static, **kinds), ranked)
    return dict(zip(ranked, fits))


def model_predictions(fits: dict[str, list[Fit]], horizon: int) -> DataFrame:
    parts = [cv_predict(f).withColumns({"horizon": F.lit(horizon), "model": F.lit(m)}) for m, f in fits.items()]
    return prep.union_stations(parts)


def refit_folds(fits: dict[str, list[Fit]], place: str, horizon: int, classes: int = 2) -> DataFrame:
    """Scores of refitted models by fold."""
    preds = model_predictions(fits, horizon).withColumn("station", F.lit(place))
    return scores.score_table(preds, labels=list(range(classes)))


def refit_scores(fits: dict[str, list[Fit]], place: str, horizon: int, classes: int = 2) -> DataFrame:
    """Percent scores of refitted models, averaged over folds."""
    return scores.fold_macro_mean(refit_folds(fits, place, horizon, classes), percent=True)


def refit_best(
    folds: list[Fold], trials: DataFrame, place: str, horizon: int, rounds: int | None = None, classes: int = 2,
    patience: int | None = PATIENCE,
) -> DataFrame:
    return refit_scores(refit_models(folds, trials, 1, rounds, classes, patience), place, horizon, classes)


def refit_top2(
    folds: list[Fold], trials: DataFrame, place: str, horizon: int, rounds: int | None = None, classes: int = 2,
    patience: int | None = PATIENCE,
) -> DataFrame:
    """Refit the best two and keep the one that scores better now."""
    return trial_ops.best_of_refit(refit_scores(refit_models(folds, trials, 2, rounds, classes, patience), place, horizon, classes))


def ensemble_refit(
    folds: list[Fold], trials: DataFrame, horizon: int, rounds: int | None = None, classes: int = 2, patience: int | None = PATIENCE
) -> DataFrame:
    """Refit all models and score their vote per station."""
    preds = model_predictions(refit_models(folds, trials, 4, rounds, classes, patience, labels_only=True), horizon)
    return scores.ensemble_scores(preds, classes=classes)


def export_topk_predictions(
    folds: list[Fold], trials: DataFrame, k: int, horizon: int, path: str, rounds: int | None = None, classes: int = 2,
    patience: int | None = PATIENCE, static: bool = False, **kinds: bool,
) -> DataFrame:
    """Refit the k best models; write models, predictions and the chosen names, return the latter."""
    fits = refit_models(folds, trials, k, rounds, classes, patience, static, **kinds)

    def save(name: str, f: Fit) -> None:
        tables.save_model(PipelineModel([*f.fold.scaling.stages, f.model]), f"{path}/models/{name}_{horizon}_cv{f.fold.number}")

    in_threads(lambda one: save(*one), [(name, f) for name, fitted in fits.items() for f in fitted])
    tables.write_predictions(model_predictions(fits, horizon), f"{path}/predictions")
    chosen = trial_ops.join_model_names(trial_ops.topk_models(trials, k))
    tables.write_summary(chosen, f"{path}/chosen")
    return chosen


def holdout_test(
    rows: DataFrame, cols: list[str], start: str, clf: Estimator, ratio: float, keys: list[str] = KEYS, classes: int = 2,
    weight_keys: list[str] = KEYS,
) -> tuple[PipelineModel, DataFrame]:
    """Fit on everything before `start`, score after it, per `keys`."""
    make = weights.sample_weight_binary if classes == 2 else weights.sample_weight_3class
    train = make(prep.holdout_split(rows, start, "refit"), ratio, LABEL, weight_keys)
    model = fit_pipeline(train, cols, clf, classes=classes)
    preds = batch_predict(model, prep.holdout_split(rows, start, "test"))
    return model, scores.score_table(preds.withColumn("obs", F.col(LABEL)), keys, list(range(classes)))


def batch_predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    return _labelled(model, df).drop("raw_features", FEATURES, "rawPrediction", "probability", "prediction")


def predict_proba(model: PipelineModel, df: DataFrame, keep: list[str] = [*KEYS, TS]) -> DataFrame:
    """pred and one probability per class, p0, p1, ...

    Joint boosting gives each class a margin of one softmax. Models fitted one class against the rest give
    separate margins, whose logistic values are scaled to add up to 1.
    """
    last = model.stages[-1]
    out = _labelled(model, df)
    if boosting.is_joint(last):
        classes = len(last.models)
        margin = vector_to_array("rawPrediction")
        out = out.withColumn("_p", F.array(*boosting.softmax([margin[c] for c in range(classes)])))
    elif isinstance(last, OneVsRestModel):
        classes = len(last.models)
        share = F.transform(vector_to_array("rawPrediction"), lambda m: 1 / (1 + F.exp(-2 * m)))
        total = F.aggregate("_share", F.lit(0.0), lambda a, x: a + x)
        out = out.withColumn("_share", share).withColumn("_p", F.transform("_share", lambda x: x / total))
    else:
        classes = last.numClasses
        out = out.withColumn("_p", vector_to_array("probability"))
    return out.select(*keep, "pred", *[F.col("_p")[c].alias(f"p{c}") for c in range(classes)])


def feature_importance(model: Model, cols: list[str] | None = None) -> DataFrame:
    """Importance of each input column, one row per column, from the fitted trees; averaged over one-vs-rest models."""
    stages = model.stages if isinstance(model, PipelineModel) else [model]
    if cols is None:
        cols = next(s for s in stages if isinstance(s, VectorAssembler)).getInputCols()
    fitted = stages[-1].models if isinstance(stages[-1], OneVsRestModel) else [stages[-1]]
    each = [m.featureImportances.toArray().tolist() for m in fitted]
    # the array may end with the last column that a tree uses
    each = [v + [0.0] * (len(cols) - len(v)) for v in each]
    values = [sum(v) / len(each) for v in zip(*each)]
    return SparkSession.builder.getOrCreate().createDataFrame(list(zip(cols, values)), "feature string, importance double")


def reload_parity(model: PipelineModel, df: DataFrame, path: str, keep: list[str] = [*KEYS, TS]) -> DataFrame:
    """Rows that a saved and reloaded model labels differently; must be empty."""
    tables.save_model(model, path)
    again = tables.load_model(path)
    return scores.pred_parity(predict_proba(model, df), predict_proba(again, df), keep, ["p1"])


def save_scaler(folds: list[Fold], path: str) -> None:
    for fold in folds:
        fold.scaling.write().overwrite().save(f"{path}/cv{fold.number}")
