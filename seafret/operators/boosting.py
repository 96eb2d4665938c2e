"""Boosting that goes on where it stopped, grown round by round with Spark's regression trees.

A round is one tree (or one per class) fitted by Spark to what the rounds before it left over. The margins that these give are
columns of a written table, renewed after every stage of rounds, so a row is never sent through more than one stage of
trees again and a lost executor costs one stage. Between stages the loss on validation rows decides whether to go on, and the
trees up to the best round become the model: nothing is fitted twice.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark import SparkContext
from pyspark.ml import Model
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, OneVsRest, OneVsRestModel
from pyspark.ml.regression import DecisionTreeRegressionModel, GBTRegressionModel, RandomForestRegressor
from pyspark.sql import Column, DataFrame, functions as F

from seafret.session import discard, in_threads, materialize, new_path

#: Rounds between two looks at the validation rows: at least, at most.
SHORT_STAGE, LONG_STAGE = 4, 16
#: Start of the uid of models that share one softmax; it is stored with them.
JOINT = "joint"
#: Bytes that a learner keeps of a row beside its bin numbers.
ROW_BYTES = 160
#: Rows worth a task of a fit, and rows that a task takes at most.
TASK_ROWS, MOST_ROWS = 50_000, 500_000
#: Bounds of the working response and least working weight of a class probability.
RESPONSE, LEAST = 4.0, 1e-4

Trees = list[DecisionTreeRegressionModel]


def best_round(losses: list[float], patience: int) -> int:
    """Number of rounds up to the best one, seen by stopping after `patience` rounds without a gain."""
    best = 0
    for k, loss in enumerate(losses):
        if loss < losses[best]:
            best = k
        elif k - best >= patience:
            break
    return best + 1


def settled(losses: list[float], patience: int) -> bool:
    """Whether more rounds can no longer change `best_round`."""
    return bool(losses) and len(losses) - best_round(losses, patience) >= patience


def fit_tasks(rows: int, cores: int, beside: int = 2) -> int:
    """Tasks of a fit: its share of the cores with `beside` fits at once (half of them at most), more only for very many rows."""
    return max(1, min(math.ceil(rows / TASK_ROWS), round(cores / max(2, beside))), math.ceil(rows / MOST_ROWS))


def kept_bytes(rows: int, columns: int) -> int:
    """Bytes that a learner keeps in memory: a bin number for every column, and what belongs to the row."""
    return rows * (ROW_BYTES + 4 * columns)


def packed(df: DataFrame, rows: int, beside: int = 2) -> DataFrame:
    """The table in the tasks of a fit. Each sends sums of all nodes, columns and bins for every level of a tree, so shuffles follow the tasks."""
    return df.coalesce(fit_tasks(rows, df.sparkSession.sparkContext.defaultParallelism, beside))


def stage_length(trained: int, most: int) -> int:
    return min(most - trained, max(SHORT_STAGE, min(LONG_STAGE, trained // 2)))


# ---- trees as models -----------------------------------------------------------------


def _assembled(java_class: str, uid: str, trees: Trees, weights: list[float]):
    gateway = SparkContext._active_spark_context._gateway
    made = gateway.new_array(gateway.jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, len(trees))
    scales = gateway.new_array(gateway.jvm.double, len(trees))
    for i, (tree, weight) in enumerate(zip(trees, weights)):
        made[i], scales[i] = tree._java_obj, float(weight)
    package, name = java_class.rsplit(".", 1)
    return getattr(getattr(gateway.jvm.org.apache.spark.ml, package), name)(uid, made, scales)


def classifier_of(clf: GBTClassifier, trees: Trees, weights: list[float], uid: str | None = None) -> GBTClassificationModel:
    """The trees as the model that `clf` would have returned."""
    model = GBTClassificationModel(_assembled("classification.GBTClassificationModel", uid or clf.uid, trees, weights))
    model = clf._copyValues(model)
    model._transfer_params_to_java()  # labels and weights are read there by `evaluateEachIteration`
    return model


def add_margin(df: DataFrame, trees: Trees, weights: list[float], features: str, col: str) -> DataFrame:
    """Weighted sum of the trees as a new column (0 without trees)."""
    if not trees:
        return df.withColumn(col, F.lit(0.0))
    model = GBTRegressionModel(_assembled("regression.GBTRegressionModel", f"margin_{col}", trees, weights))
    return model.setFeaturesCol(features).setPredictionCol(col).transform(df)


def fit_tree(clf: GBTClassifier, rows: DataFrame, target: Column, weight: Column | None, round_no: int) -> DecisionTreeRegressionModel:
    """One regression tree with the settings of a boosted learner."""
    learner = RandomForestRegressor(
        featuresCol=clf.getFeaturesCol(), labelCol="_target", numTrees=1, bootstrap=False, subsamplingRate=clf.getSubsamplingRate(),
        featureSubsetStrategy=clf.getFeatureSubsetStrategy(), maxDepth=clf.getMaxDepth(), maxBins=clf.getMaxBins(),
        minInstancesPerNode=clf.getMinInstancesPerNode(), minInfoGain=clf.getMinInfoGain(),
        seed=clf.getSeed() + (round_no if clf.getSubsamplingRate() < 1 or clf.getFeatureSubsetStrategy() != "all" else 0),
    )
    kept = rows.select(clf.getFeaturesCol(), target.alias("_target"), *([] if weight is None else [weight.alias("_weight")]))
    if weight is not None:
        learner = learner.setWeightCol("_weight")
    return learner.fit(kept).trees[0]


# ---- two classes ---------------------------------------------------------------------


def fit_patient(clf: GBTClassifier, train: DataFrame, valid: DataFrame, patience: int) -> GBTClassificationModel:
    """Boost on the training rows and keep the rounds up to the best one by the validation rows.

    The first 2 x patience rounds are one fit of Spark's learner, which finds its split points once. As long as the best round is less than `patience` rounds old,
    stages of further rounds follow, each tree fitted to the gradient of the log loss as in that learner, so the model is the
    beginning of the one that all rounds would give (above 10 000 rows up to the sample from which split points are taken).
    `model.rounds_trained` tells how many rounds were grown.
    """
    clf = clf.copy()
    clf.clear(clf.validationIndicatorCol)
    most = clf.getMaxIter()
    if valid.isEmpty():
        return clf.fit(train)
    model = clf.copy({clf.maxIter: min(most, 2 * patience)}).fit(train)
    trees, scales = list(model.trees), list(model.treeWeights)
    losses = model.evaluateEachIteration(valid)
    growth = _Growth(clf, train, trees, scales) if len(trees) < most and not settled(losses, patience) else None
    try:
        while len(trees) < most and not settled(losses, patience):
            growth.stage(stage_length(len(trees), most))
            losses = classifier_of(clf, trees, scales).evaluateEachIteration(valid)
    finally:
        if growth:
            growth.close()
    keep = best_round(losses, patience)
    out = model if keep == len(model.trees) else classifier_of(clf, trees[:keep], scales[:keep])
    out.rounds_trained = len(trees)
    return out


class _Growth:
    """Further rounds of a binary model over one written table of margins."""

    def __init__(self, clf: GBTClassifier, train: DataFrame, trees: Trees, scales: list[float]):
        self.clf, self.trees, self.scales = clf, trees, scales
        self.spark = train.sparkSession
        self.sign = 2.0 * F.col(clf.getLabelCol()) - 1.0
        weight = F.col(clf.getWeightCol()) if clf.isSet(clf.weightCol) else F.lit(1.0)
        base = add_margin(train, trees, scales, clf.getFeaturesCol(), "_margin")
        self.path: str | None = None
        self._write(base.select(clf.getFeaturesCol(), self.sign.alias("_sign"), weight.alias("_w"), "_margin"))

    def _write(self, rows: DataFrame) -> None:
        old, self.path = self.path, new_path(self.spark, "margins")
        self.rows = materialize(rows, "margins", self.path)
        if old:
            discard(self.spark, old)

    def stage(self, rounds: int) -> None:
        new: Trees = []
        scale = self.clf.getStepSize()
        for _ in range(rounds):
            seen = add_margin(self.rows, new, [scale] * len(new), self.clf.getFeaturesCol(), "_since")
            margin = F.col("_margin") + F.col("_since")
            gradient = 4.0 * F.col("_sign") / (1.0 + F.exp(2.0 * F.col("_sign") * margin))
            new.append(fit_tree(self.clf, seen, gradient, F.col("_w"), len(self.trees) + len(new)))
        grown = add_margin(self.rows, new, [scale] * len(new), self.clf.getFeaturesCol(), "_since")
        self._write(grown.withColumn("_margin", F.col("_margin") + F.col("_since")).drop("_since"))
        self.trees += new
        self.scales += [scale] * len(new)

    def close(self) -> None:
        if self.path:
            discard(self.spark, self.path)


# ---- more classes, one softmax -------------------------------------------------------


class JointBoosting(OneVsRest):
    """Settings of a learner whose classes share one softmax; `fit_joint` fits it."""


def softmax(margins: list[Column]) -> list[Column]:
    top = F.greatest(*margins)
    parts = [F.exp(m - top) for m in margins]
    total = sum(parts[1:], parts[0])
    return [p / total for p in parts]


def fit_joint(
    spec: OneVsRest, train: DataFrame, valid: DataFrame, classes: int, patience: int | None = None, told: Callable[[int, float], None] | None = None
) -> OneVsRestModel:
    """One model of all classes: in every round each class gets a tree, all fitted to the residuals of one shared softmax.

    A tree is a weighted least-squares fit of the working response (y - p) / (p (1 - p)) with weights p (1 - p), so its leaves are
    Newton steps. `told(round, loss)` sees the weighted log loss of the validation rows (of the training rows without any)
    after each round. The model is kept as one margin per class, whose largest is the label; `is_joint` tells it from separate models.
    """
    clf: GBTClassifier = spec.getClassifier()
    features, label = clf.getFeaturesCol(), spec.getLabelCol()
    spark, numbers = train.sparkSession, range(classes)
    weight = F.col(clf.getWeightCol()) if clf.isSet(clf.weightCol) else F.lit(1.0)
    scale = clf.getStepSize() * (classes - 1) / classes
    most, checked = clf.getMaxIter(), not valid.isEmpty()
    flagged = train.withColumn("_valid", F.lit(False))
    if checked:
        flagged = flagged.unionByName(valid.withColumn("_valid", F.lit(True)))
    base = flagged.select(features, F.col(label).cast("int").alias("_y"), weight.cast("double").alias("_w"), "_valid", *[F.lit(0.0).alias(f"_m{k}") for k in numbers])
    trees: list[Trees] = [[] for _ in numbers]
    losses: list[float] = []
    path = new_path(spark, "margins")
    rows = materialize(base, "margins", path)
    try:
        while len(losses) < most and not (patience and checked and settled(losses, patience)):
            new: list[Trees] = [[] for _ in numbers]

            def margins(df: DataFrame, since: list[Trees] = new) -> DataFrame:
                for k in numbers:
                    df = add_margin(df, since[k], [scale] * len(since[k]), features, f"_s{k}")
                return df.withColumns({f"_f{k}": F.col(f"_m{k}") + F.col(f"_s{k}") for k in numbers})

            for _ in range(stage_length(len(losses), most)):
                seen = margins(rows)
                p = softmax([F.col(f"_f{k}") for k in numbers])

                def one(k: int) -> DecisionTreeRegressionModel:
                    room = F.greatest(p[k] * (1 - p[k]), F.lit(LEAST))
                    gap = (F.col("_y") == k).cast("double") - p[k]
                    response = F.greatest(F.lit(-RESPONSE), F.least(F.lit(RESPONSE), gap / room))
                    return fit_tree(clf, seen.where(~F.col("_valid")), response, F.col("_w") * room, len(losses))

                for k, tree in enumerate(in_threads(one, numbers, classes)):
                    new[k].append(tree)
                losses.append(_log_loss(margins(rows).where(F.col("_valid") == checked), classes))
                if told:
                    told(len(losses), losses[-1])
                if patience and checked and settled(losses, patience):
                    break
            for k in numbers:
                trees[k] += new[k]
            old, path = path, new_path(spark, "margins")
            grown = margins(rows)
            rows = materialize(grown.select(features, "_y", "_w", "_valid", *[F.col(f"_f{k}").alias(f"_m{k}") for k in numbers]), "margins", path)
            discard(spark, old)
    finally:
        discard(spark, path)
    keep = best_round(losses, patience) if patience and checked else len(losses)
    parts = [classifier_of(clf, t[:keep], [scale] * keep, f"{JOINT}_{k}_{clf.uid}") for k, t in enumerate(trees)]
    model = OneVsRestModel(parts)
    model.set(model.classifier, clf)  # needed to save it
    model.rounds_trained = len(losses)
    return model.setFeaturesCol(features).setPredictionCol(spec.getPredictionCol()).setRawPredictionCol(spec.getRawPredictionCol())


def _log_loss(df: DataFrame, classes: int) -> float:
    p = softmax([F.col(f"_f{k}") for k in range(classes)])
    own = F.element_at(F.array(*p), F.col("_y") + 1)
    found = df.agg((F.sum(-F.log(F.greatest(own, F.lit(1e-300))) * F.col("_w")) / F.sum("_w")).alias("loss")).first()["loss"]
    return float("inf") if found is None else found


def is_joint(model: Model) -> bool:
    """Whether the parts of the model share one softmax; holds after reloading too."""
    return isinstance(model, OneVsRestModel) and all(m.uid.startswith(JOINT) for m in model.models)
