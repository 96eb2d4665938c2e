"""Boosting round by round with L2 terms and other kinds of rounds: gradient-based sampling and dropped trees.

Each round is one regression tree that Spark grows over a written table of margins. What differs between kinds is a filter
and a weight on its rows (`goss`) or the trees that its margin leaves out (`dart`). L2 terms shrink the leaves of a tree as soon as it is
grown, so later rounds see the shrunken ones. The result is an ordinary boosted model: it is saved, reloaded and explained like any other.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark import SparkContext
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.regression import DecisionTreeRegressionModel
from pyspark.sql import Column, DataFrame, functions as F

from seafret.operators.boosting import Trees, add_margin, best_round, classifier_of, fit_tree, settled, stage_length
from seafret.session import discard, materialize, new_path

#: Steps in which a row's chance is told; error of the limit of large gradients as a share of rows is one in `LIMIT_STEPS`.
CHANCES, LIMIT_STEPS = 1 << 20, 10_000


@dataclass(frozen=True)
class Kind:
    """How rounds are grown.

    `l2` is added to the weight of a leaf: its value is sum(w g) / (sum(w) + l2).
    `goss` grows a tree from the share `top` of rows with the largest weighted gradients and a share `other` of all rows drawn from
    the rest, whose weights make up for those left out. `dart` leaves each earlier tree out with chance `drop` (none with chance
    `skip`, at most `most_dropped`) and scales the k dropped ones by k / (k + 1), the new one by 1 / (k + 1).
    """

    name: str = "gbdt"
    l2: float = 0.0
    top: float = 0.2
    other: float = 0.1
    drop: float = 0.1
    skip: float = 0.5
    most_dropped: int = 50

    def __post_init__(self):
        if self.name not in ("gbdt", "goss", "dart"):
            raise ValueError(f"unknown kind of boosting: {self.name}")
        if self.l2 < 0:
            raise ValueError("an L2 term is not negative")
        if not (0 < self.top < 1 and 0 < self.other <= 1 - self.top):
            raise ValueError("shares of rows are above 0 and add up to 1 at most")


class KindBoosting(GBTClassifier):
    """Spark's boosted learner whose rounds follow `kind`; with the plain kind its model is the same."""

    kind = Kind()

    def _fit(self, dataset: DataFrame) -> GBTClassificationModel:
        return fit_kind(self, dataset)


def chance(seed: int, *what: int) -> float:
    """A number from 0 to 1 that depends on its arguments only, so that a repeated run drops the same trees."""
    text = ",".join(map(str, (seed, *what)))
    return int(hashlib.sha256(text.encode()).hexdigest()[:13], 16) / 16.0**13


def dropped_trees(kind: Kind, grown: int, seed: int) -> list[int]:
    """Numbers of the trees that the next round leaves out."""
    if kind.name != "dart" or chance(seed, grown) < kind.skip:
        return []
    drawn = sorted((chance(seed, grown, i), i) for i in range(grown))
    return sorted(i for c, i in drawn[: kind.most_dropped] if c < kind.drop)


def shrunken(tree: DecisionTreeRegressionModel, l2: float) -> DecisionTreeRegressionModel:
    """The tree with each node's value times w / (w + l2), where w is the weight of its rows."""
    if not l2:
        return tree
    ml = SparkContext._active_spark_context._gateway.jvm.org.apache.spark.ml

    def again(node):
        stats = node.impurityStats()
        weight = stats.count()
        value = node.prediction() * weight / (weight + l2)
        if not node.subtreeDepth():
            return ml.tree.LeafNode(value, node.impurity(), stats)
        return ml.tree.InternalNode(value, node.impurity(), node.gain(), again(node.leftChild()), again(node.rightChild()), node.split(), stats)

    made = ml.regression.DecisionTreeRegressionModel(tree.uid, again(tree._java_obj.rootNode()), tree.numFeatures)
    return tree._copyValues(DecisionTreeRegressionModel(made))


def fit_kind(clf: KindBoosting, train: DataFrame, valid: DataFrame | None = None, patience: int | None = None) -> GBTClassificationModel:
    """Grow all rounds, or with `patience` as many as the validation rows ask for and keep those up to the best.

    Rounds of `dart` change the weights of earlier trees, so no beginning of the model is a model of its own: it grows all its rounds.
    `model.rounds_trained` tells how many rounds were grown.
    """
    clf = clf.copy()
    clf.clear(clf.validationIndicatorCol)
    most = clf.getMaxIter()
    checked = bool(patience) and clf.kind.name != "dart" and valid is not None and not valid.isEmpty()
    growth, losses = _Rounds(clf, train), []
    try:
        while len(growth.trees) < most and not (checked and settled(losses, patience)):
            growth.stage(stage_length(len(growth.trees), most))
            if checked:
                losses = classifier_of(clf, growth.trees, growth.scales).evaluateEachIteration(valid)
    finally:
        growth.close()
    keep = best_round(losses, patience) if checked else len(growth.trees)
    model = classifier_of(clf, growth.trees[:keep], growth.scales[:keep])
    model.rounds_trained = len(growth.trees)
    return model


class _Rounds:
    """Trees so far, their scales, and a written table with the margin that they had when it was written."""

    def __init__(self, clf: KindBoosting, train: DataFrame):
        self.clf, self.kind, self.features = clf, clf.kind, clf.getFeaturesCol()
        self.spark = train.sparkSession
        self.trees: Trees = []
        self.scales: list[float] = []
        self.written: list[float] = []
        self.path: str | None = None
        weight = F.col(clf.getWeightCol()) if clf.isSet(clf.weightCol) else F.lit(1.0)
        sign = 2.0 * F.col(clf.getLabelCol()) - 1.0
        # a row's number is written once, so every reading of the table draws the same rows
        self._write(train.select(self.features, sign.alias("_sign"), weight.cast("double").alias("_w"), F.rand(clf.getSeed()).alias("_u"), F.lit(0.0).alias("_margin")))

    def _write(self, rows: DataFrame) -> None:
        old, self.path = self.path, new_path(self.spark, "margins")
        self.rows = materialize(rows, "margins", self.path)
        self.written = list(self.scales)
        if old:
            discard(self.spark, old)

    def _at(self, scales: list[float]) -> DataFrame:
        """The rows with `_now`, their margin at these scales: only trees whose scale has changed are asked again."""
        then = self.written + [0.0] * (len(self.trees) - len(self.written))
        moved = [(t, new - old) for t, new, old in zip(self.trees, scales, then) if new != old]
        seen = add_margin(self.rows, [t for t, _ in moved], [d for _, d in moved], self.features, "_since")
        return seen.withColumn("_now", F.col("_margin") + F.col("_since")).drop("_since")

    def _sampled(self, rows: DataFrame, target: Column) -> tuple[DataFrame, Column]:
        """Rows of the round and their weights. Gradients as large as the limit all stay."""
        kind, weight = self.kind, F.col("_w")
        if kind.name != "goss" or not self.trees:
            return rows, weight
        size = F.abs(target) * weight
        limit = rows.agg(F.percentile_approx(size, 1.0 - kind.top, LIMIT_STEPS).alias("limit")).first()["limit"]
        if limit is None:
            return rows, weight
        share = kind.other / (1.0 - kind.top)
        drawn = F.pmod(F.xxhash64("_u", F.lit(len(self.trees))), F.lit(CHANCES)) < int(share * CHANCES)
        return rows.where((size >= limit) | drawn), F.when(size >= limit, weight).otherwise(weight / share)

    def _round(self) -> None:
        grown, seed = len(self.trees), self.clf.getSeed()
        out = dropped_trees(self.kind, grown, seed)
        rows = self._at([0.0 if i in out else s for i, s in enumerate(self.scales)])
        sign = F.col("_sign")
        # as in Spark's learner: the first tree fits the signs at full scale, the others the gradient of the log loss
        target = 4.0 * sign / (1.0 + F.exp(2.0 * sign * F.col("_now"))) if grown else sign
        kept, weight = self._sampled(rows, target)
        tree = fit_tree(self.clf, kept, target, weight, grown)
        for i in out:
            self.scales[i] *= len(out) / (len(out) + 1)
        self.trees.append(shrunken(tree, self.kind.l2))
        self.scales.append((self.clf.getStepSize() if grown else 1.0) / (len(out) + 1))

    def stage(self, rounds: int) -> None:
        for _ in range(rounds):
            self._round()
        self._write(self._at(self.scales).withColumn("_margin", F.col("_now")).drop("_now"))

    def close(self) -> None:
        if self.path:
            discard(self.spark, self.path)
