"""All studies of a feature table: tune, refit, combine, hold out, report.

A study is one station, horizon and model. The feature table is written by station, so a
study reads only its own files; the rows of a place (station and horizon) are written once, shared
by its models and discarded when its work is done. Trials are appended as they finish and not
run again, so a stopped run goes on where it was. Places run side by side, each in its own
scheduler pool. A place without a usable fold is no error: it is listed in `Plan.status`.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from threading import Lock

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from seafret.operators import ml, prep, scores, trials as trial_ops
from seafret.schema import HORIZONS, MODELS, STATIONS, TEST_START, TIME_COLUMNS, YEAR_PERIODS, lag_columns
from seafret.session import discard, new_path
from seafret.sources import tables

# Trials of a study by number of classes.
TRIALS = {2: 150, 3: 200}
APPEND = Lock()
STATUS = "station string, horizon int, step string, status string"


@dataclass
class Plan:
    """What to run and where its tables are.

    `embargo` (seconds before and after a test period) leaves out rows whose labels or lags reach into it; off by default.
    Refits weigh rows by the tuned ratio, or all of class 0 by 1 / `static_weight`, or with `class_weight` every class by its share.
    With `by_round` the L2 terms and boosting kinds of the draws act, at the cost of a fit for each round.
    """

    spark: SparkSession
    features: str
    trials: str
    stations: list[str] = field(default_factory=lambda: list(STATIONS))
    horizons: list[int] = field(default_factory=lambda: list(HORIZONS))
    models: list[str] = field(default_factory=lambda: list(MODELS))
    cols: list[str] = field(default_factory=lambda: lag_columns() + TIME_COLUMNS)
    periods: list[tuple[str, str]] = field(default_factory=lambda: list(YEAR_PERIODS))
    classes: int = 2
    n_trials: int | None = None
    seed: int = 1
    rounds: int | None = None
    patience: int | None = ml.PATIENCE
    static_weight: float | None = None
    class_weight: bool = False
    embargo: tuple[int, int] = (0, 0)
    by_round: bool = False
    parallelism: int = 4
    places_at_once: int = 2
    status: list[tuple[str, int, str, str]] = field(default_factory=list)

    @property
    def target(self) -> str:
        return "y" if self.classes == 2 else "y3"

    @property
    def kinds(self) -> dict[str, bool]:
        """How refits boost, where it is not the usual way."""
        return {"by_round": True} if self.by_round else {}

    @property
    def trials_wanted(self) -> int:
        return TRIALS[self.classes] if self.n_trials is None else self.n_trials

    def rows(self, station: str, horizon: int) -> DataFrame:
        return ml.training_rows(
            tables.scan_features(self.spark, self.features, station), self.cols, f"{self.target}_{horizon}", self.classes
        )

    def folds(self, station: str, horizon: int, path: str | None = None) -> list[ml.Fold]:
        """Prepared folds of a place; three-class work uses the first one only."""
        table = ml.fold_table(self.rows(station, horizon), self.periods, path=path, classes=self.classes, embargo=self.embargo, cols=self.cols)
        if self.classes == 3:
            table = table.where(F.col("fold") == 1)
        return ml.prepare_folds(table, self.cols, positive=self.classes - 1)

    def history(self, station: str | None = None, horizon: int | None = None) -> DataFrame | None:
        """Trials so far, or None before the first one."""
        try:
            return tables.scan_trials(self.spark, self.trials, station, horizon)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def places(self) -> list[tuple[str, int]]:
        return [(s, h) for s in self.stations for h in self.horizons]

    def status_table(self) -> DataFrame:
        """What happened at each place and step."""
        return self.spark.createDataFrame(self.status, STATUS)


def _each_place(plan: Plan, step: str, work: Callable[[str, int, list[ml.Fold]], DataFrame | None]) -> list[DataFrame]:
    """Run all places; those without a usable fold are listed in the status, any other error ends the run."""

    def one(place: tuple[str, int]) -> DataFrame | None:
        station, horizon = place
        plan.spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"{station}_{horizon}")
        path = new_path(plan.spark, "place")
        try:
            folds = plan.folds(station, horizon, path)
            result = work(station, horizon, folds)
            if result is not None:
                # the place's rows go, so what is made of them has to be kept first
                result = plan.spark.createDataFrame(result.collect(), result.schema)
            plan.status.append((station, horizon, step, "done"))
            return result
        except ml.NoUsableFold as none:
            plan.status.append((station, horizon, step, str(none)))
            return None
        finally:
            discard(plan.spark, path)

    return [r for r in ml.in_threads(one, plan.places(), plan.places_at_once) if r is not None]


def _union(plan: Plan, parts: list[DataFrame], step: str) -> DataFrame:
    if not parts:
        raise ml.NoUsableFold(f"no place has a usable fold to {step}")
    return prep.union_stations(parts)


def tune(plan: Plan) -> DataFrame:
    """Run the missing trials of every study and append them to the trial table; returns the status."""

    def append(found: DataFrame) -> None:
        with APPEND:  # one writer of the table at a time
            tables.write_metrics(found, plan.trials)

    def search(station: str, horizon: int, folds: list[ml.Fold]) -> None:
        past = plan.history(station, horizon)
        for model in plan.models:
            done = [] if past is None else [r["trial_id"] for r in past.where(F.col("model") == model).select("trial_id").distinct().collect()]
            if len(done) >= plan.trials_wanted:
                continue
            study = plan.spark.createDataFrame([(station, horizon, model)], "station string, horizon int, model string")
            span = (0.001, 0.6) if plan.classes == 3 else None
            space = trial_ops.search_space(study, plan.trials_wanted, plan.seed, span)
            ml.param_search(
                folds,
                (station, horizon, model),
                space,
                plan.rounds,
                done,
                plan.classes,
                plan.parallelism,
                append,
                plan.patience,
                plan.by_round,
            )

    _each_place(plan, "tune", search)
    return plan.status_table()


def _fixed_weights(plan: Plan) -> bool:
    if plan.class_weight and plan.static_weight is not None:
        raise ValueError("choose static_weight or class_weight")
    return plan.class_weight or plan.static_weight is not None


def _weighted(plan: Plan, folds: list[ml.Fold]) -> list[ml.Fold]:
    if plan.class_weight:
        return [ml.class_weighted_fold(f, plan.classes) for f in folds]
    return folds if plan.static_weight is None else [ml.static_fold(f, plan.static_weight) for f in folds]


def _refits(plan: Plan, station: str, horizon: int, folds: list[ml.Fold], k: int) -> dict[str, list[ml.Fit]]:
    """Refitted models of a place, with the tuned ratio or the weights that the plan fixes."""
    return ml.refit_models(_weighted(plan, folds), plan.history(station, horizon), k, plan.rounds, plan.classes, plan.patience, _fixed_weights(plan), **plan.kinds)


def refit_report(plan: Plan, k: int = 2, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Refit the k best models of each place; the better one per place, and scores by station.

    With `path` the scores of every fold, the importances and both tables are written below it.
    """

    def run(station: str, horizon: int, folds: list[ml.Fold]) -> DataFrame:
        fits = _refits(plan, station, horizon, folds, k)
        by_fold = ml.refit_folds(fits, station, horizon, plan.classes)
        if path:
            by_fold = plan.spark.createDataFrame(by_fold.collect(), by_fold.schema)
            tables.write_summary(by_fold, f"{path}/folds/{station}_{horizon}")
            for model, fitted in fits.items():
                found = _importances(plan, fitted, station, horizon, model)
                tables.write_summary(trial_ops.topk_importance(found), f"{path}/importances/{station}_{horizon}_{model}")
        return trial_ops.best_of_refit(scores.fold_macro_mean(by_fold, percent=True))

    best = _union(plan, _each_place(plan, "refit", run), "refit")
    summary = scores.summary_pivot(best, plan.stations)
    if path:
        tables.write_summary(best, f"{path}/best")
        tables.write_summary(summary, f"{path}/summary")
    return best, summary


def ensemble_report(plan: Plan) -> tuple[DataFrame, DataFrame]:
    """Refit all models of each place and score their vote."""

    def run(station: str, horizon: int, folds: list[ml.Fold]) -> DataFrame:
        preds = ml.model_predictions(_refits(plan, station, horizon, folds, 4), horizon)
        return scores.ensemble_scores(preds, classes=plan.classes)

    table = _union(plan, _each_place(plan, "ensemble", run), "vote on")
    return table, scores.summary_pivot(table, plan.stations)


def export(plan: Plan, path: str, k: int = 1) -> DataFrame:
    """Refit the k best models of each place and write models, predictions and chosen names."""

    def run(station: str, horizon: int, folds: list[ml.Fold]) -> DataFrame:
        target = f"{path}/{station}_{horizon}"
        static = _fixed_weights(plan)
        return ml.export_topk_predictions(
            _weighted(plan, folds), plan.history(station, horizon), k, horizon, target, plan.rounds, plan.classes, plan.patience, static, **plan.kinds
        )

    return _union(plan, _each_place(plan, "export", run), "export")


def _importances(plan: Plan, fitted: list[ml.Fit], station: str, horizon: int, model: str) -> DataFrame:
    found = ml.feature_importance(fitted[-1].model, plan.cols)
    return found.select(F.lit(station).alias("station"), F.lit(horizon).alias("horizon"), F.lit(model).alias("model"), "*")


def importance_report(plan: Plan, k: int = 30) -> DataFrame:
    """Best features of the best model of each place, from its last fold."""

    def run(station: str, horizon: int, folds: list[ml.Fold]) -> DataFrame:
        ((model, fitted),) = _refits(plan, station, horizon, folds, 1).items()
        return _importances(plan, fitted, station, horizon, model)

    return trial_ops.topk_importance(_union(plan, _each_place(plan, "importance", run), "rank features"), k)


def holdout(plan: Plan, path: str, start: str = TEST_START) -> DataFrame:
    """Best trial of each place: refit on all rows before `start`, save, reload, score the rows from `start`, write.

    Places without a trial, or without both classes before `start`, are listed in the status.
    """

    def one(place: tuple[str, int]) -> DataFrame | None:
        station, horizon = place
        past = plan.history(station, horizon)
        best = None if past is None else trial_ops.best_model(past).first()
        rows = plan.rows(station, horizon)
        seen = prep.holdout_split(rows, start, "refit").select(ml.LABEL).distinct().count()
        if best is None or seen < 2:
            plan.status.append((station, horizon, "holdout", "no trial" if best is None else "one class before the start"))
            return None
        params = ml.base_params(plan.rounds) | ml.tuned_params(past)[best["model"]]
        model, _ = ml.holdout_test(
            rows, plan.cols, start, ml.learner(best["model"], params, plan.classes, by_round=plan.by_round), params["pos_label_ratio"], classes=plan.classes
        )
        target = f"{path}/models/{station}_{horizon}_{best['model']}"
        tables.save_model(model, target)
        again = tables.load_model(target)
        preds = ml.batch_predict(again, prep.holdout_split(rows, start, "test")).withColumn("obs", F.col(ml.LABEL))
        table = scores.score_table(preds, ["station"], list(range(plan.classes)))
        table = table.select(
            "station", F.lit(horizon).alias("horizon"), F.lit(best["model"]).alias("model"), F.lit(best["trial_id"]).alias("trial_id"),
            F.lit("test").alias("stage"), "ACC", "PAG", "POD", "F1",
        )
        plan.status.append((station, horizon, "holdout", "done"))
        return plan.spark.createDataFrame(table.collect(), table.schema)

    parts = [r for r in ml.in_threads(one, plan.places(), plan.places_at_once) if r is not None]
    found = _union(plan, parts, "hold out")
    tables.write_metrics(found, f"{path}/scores", mode="overwrite")
    return found
