"""Queries on fitting, tuning, refitting and forecasting.

One study over all stations, with the station columns among the features, for every horizon. Features and folds are written once
per session. Fits cannot be said in SQL; their queries return one row per place and fold with the number of results that break
a rule (a score outside 0..1, a label outside the classes, probabilities that do not add up to 1), and the SQL says which rows
there must be and that no rule is broken.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from threading import Lock

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, functions as F

from seafret.operators import folds as fold_ops, forecast, ml, prep, scores, tree_forecast, trials as trial_ops
from seafret.schema import HORIZONS, KEYS, MODELS, STATIONS, TIME_COLUMNS, TS, lag_columns
from seafret.session import materialize, new_path
from seafret.sources import tables
from workload.registry import cte, query
from workload.standins import FOLD_OF, TEST_START_SQL, Tables

COLS = lag_columns() + TIME_COLUMNS + STATIONS
#: Rounds or trees of every fit of these queries but `ensemble_refit` (which, as a run, takes up to ml.ROUNDS), and draws of a study in `param_search`.
ROUNDS = 20
DRAWS = 4
#: Rounds of joint three-class boosting, each one tree per class.
JOINT_ROUNDS = 6
PLACE = "ALL"
BASE = ml.base_params(ROUNDS)


#: Written features and prepared folds of a session, by what they are made of.
_made: dict[tuple, object] = {}
_making = Lock()


def once(key: tuple, make):
    """What `make` returned for the key in this session; queries over the same tables share it."""
    with _making:
        lock = _made.setdefault((*key, "lock"), Lock())
    with lock:
        if key not in _made:
            _made[key] = make()
    return _made[key]


@dataclass
class Study:
    """Rows and folds of all horizons, made once per session and folder of tables; with `first_only` the first fold alone."""

    tables: Tables
    classes: int = 2
    first_only: bool = False
    features: DataFrame = field(init=False)

    def __post_init__(self):
        self.key = (self.tables.spark.sparkContext.applicationId, self.tables.dir)
        self.features = once((*self.key, "features"), lambda: materialize(self.tables.features, "features"))

    def rows(self, horizon: int) -> DataFrame:
        return ml.training_rows(self.features, COLS, f"{'y' if self.classes == 2 else 'y3'}_{horizon}", self.classes)

    def folds(self, horizon: int) -> list[ml.Fold]:
        def make() -> list[ml.Fold]:
            table = ml.fold_table(self.rows(horizon), self.tables.periods, classes=self.classes, cols=COLS)
            if self.first_only:
                table = fold_ops.first_fold_only(table)
            return ml.prepare_folds(table, COLS, positive=self.classes - 1)

        return once((*self.key, "folds", horizon, self.classes, self.first_only), make)

    def model(self, horizon: int):
        """A model of the rows before the test period, and all rows."""
        rows = self.rows(horizon)
        train = prep.holdout_split(rows, self.tables.test_start, "refit")
        return ml.fit_pipeline(train, COLS, ml.learner("cb", BASE)), rows

    def trials(self, horizon: int) -> DataFrame:
        """Trials of one horizon over all stations, as one study place."""
        params = F.create_map(
            F.lit("model_params.depth"), F.col("depth").cast("string"),
            F.lit("model_params.max_depth"), F.col("depth").cast("string"),
            F.lit("model_params.learning_rate"), F.col("learning_rate").cast("string"),
            F.lit("pos_label_ratio"), F.lit("0.3"),
        )
        return self.tables.trials.where(F.col("horizon") == horizon).select(
            F.lit(PLACE).alias("station"), "horizon", "model", "trial_id", "value", params.alias("params")
        )


def every_horizon(work) -> DataFrame:
    """work(horizon) for all horizons side by side, with the horizon as a column."""
    return prep.union_stations(ml.in_threads(lambda h: work(h).withColumn("horizon", F.lit(h)), HORIZONS, len(HORIZONS)))


def counted(df: DataFrame, keys: list[str], bad: Column) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(bad | bad.isNull()).alias("bad"))


def outside(*cols: str, top: float = 1.0) -> Column:
    """Some score is missing or not in 0..top."""
    found = F.lit(False)
    for c in cols:
        found = found | F.coalesce((F.col(c) < 0) | (F.col(c) > top), F.lit(True))
    return found


METRICS = ("ACC", "PAG", "POD", "F1")

COMPLETE = " and ".join(f'"{c}" is not null' for c in lag_columns())
for _name, _target in (("", "y"), ("3", "y3")):
    cte(
        f"rows{_name}",
        f"""select * from (select station, datetime, unnest([1, 3, 6]) as horizon,
  cast(unnest([{_target}_1, {_target}_3, {_target}_6]) as integer) as obs from features where {COMPLETE}) where obs is not null""",
        "features",
    )
    cte(
        f"row_folds{_name}",
        f"""select *, {FOLD_OF} = fold as in_test from (
  select station, datetime, horizon, obs, year(datetime) * 366 + dayofyear(datetime) as day_group, unnest([1, 2, 3]) as fold from rows{_name})""",
        f"rows{_name}",
        "cal",
    )
    cte(
        f"row_days{_name}",
        f"""select *, (row_number() over (partition by station, horizon, fold order by n_fog desc, day_group) - 1) % 5 = 0 as is_valid from (
  select station, horizon, fold, day_group, sum(obs) as n_fog from row_folds{_name} where not in_test group by all)""",
        f"row_folds{_name}",
    )
    cte(
        f"usable{_name}",
        f"""select horizon, fold from row_folds{_name} left join row_days{_name} using (station, horizon, fold, day_group) group by horizon, fold
having count(*) filter (where in_test and obs = {2 if _name else 1}) > 0 and count(distinct obs) filter (where not in_test and not is_valid) > 1""",
        f"row_folds{_name}",
        f"row_days{_name}",
    )
cte("cells", "select distinct horizon, station from row_folds join usable using (horizon, fold) where in_test group by horizon, station, fold having sum(obs) > 0", "row_folds", "usable")
cte("cells3", "select distinct horizon, station from row_folds3 join usable3 using (horizon, fold) where in_test group by horizon, station, fold having count(*) filter (where obs = 2) > 0", "row_folds3", "usable3")
ZERO = "cast(0 as bigint) as bad"
FOLDS_OK = f"select horizon, fold, {ZERO} from usable"
FOLDS3_OK = f"select horizon, fold, {ZERO} from usable3 where fold = 1"
BY_HORIZON = f"select distinct horizon, {ZERO} from usable"
BY_STATION = f"select horizon, station, count(*) as n, {ZERO} from rows group by horizon, station"


def models_scores(s: Study, models: tuple[str, ...], classes: int = 2) -> DataFrame:
    """`fold_scores` of learners fitted side by side, with their names."""
    return prep.union_stations(ml.in_threads(lambda m: fold_scores(s, m, classes).withColumn("model", F.lit(m)), models))


def fold_scores(s: Study, model: str, classes: int = 2, patience: int | None = ml.PATIENCE) -> DataFrame:
    """Broken rules per horizon and fold of one learner."""

    def work(h: int) -> DataFrame:
        made = ml.cv_evaluate(s.folds(h), lambda: ml.learner(model, BASE, classes), 0.3, classes, patience)
        return made.select("fold", outside(*METRICS).cast("long").alias("bad"))

    return every_horizon(work)


@query("fit_pipeline", BY_STATION, ["rows"])
def _(t):
    """A pipeline fitted before the test period labels all rows."""
    s = Study(t)

    def work(h: int) -> DataFrame:
        model, rows = s.model(h)
        return counted(ml.batch_predict(model, rows), ["station"], ~F.col("pred").isin(0, 1))

    return every_horizon(work)


@query("boosted_trees", f"select unnest(['cb', 'lgb', 'xgb']) as model, * from ({FOLDS_OK})", ["usable"])
def _(t):
    return models_scores(Study(t), ("cb", "lgb", "xgb"))


@query("random_forest", FOLDS_OK, ["usable"])
def _(t):
    return fold_scores(Study(t), "rf")


@query(
    "early_stopping",
    f"select horizon, fold, count(*) as n_test, {ZERO} from usable join row_folds using (horizon, fold) where in_test group by horizon, fold",
    ["usable", "row_folds"],
)
def _(t):
    """Boosting ends with the best round by the validation rows, ten rounds without a gain later at most."""
    s = Study(t)

    def work(h: int) -> DataFrame:
        parts = []
        for fit in ml.cv_fit(s.folds(h), lambda: ml.learner("cb", BASE | {"learning_rate": 0.5}), 0.3, patience=ml.PATIENCE):
            right = 1 <= fit.model.getNumTrees <= ROUNDS and fit.status == "fit 1"
            parts.append(fit.fold.test.groupBy("fold").agg(F.count("*").alias("n_test")).withColumn("bad", F.lit(0 if right else 1).cast("long")))
        return prep.union_stations(parts)

    return every_horizon(work)


@query("cv_evaluate", FOLDS_OK, ["usable"])
def _(t):
    return fold_scores(Study(t), "cb")


@query("classify_3class", f"select unnest(['cb', 'rf']) as model, * from ({FOLDS3_OK})", ["usable3"])
def _(t):
    """Three classes by a forest and by boosting one class against the rest, on the first fold."""
    return models_scores(Study(t, 3, first_only=True), ("cb", "rf"), 3)


@query("classify_3class_joint", FOLDS3_OK, ["usable3"])
def _(t):
    """Three classes by boosting with one softmax; its scores, and its log loss must be below that of the class shares."""
    s = Study(t, 3, first_only=True)

    def work(h: int) -> DataFrame:
        parts = []
        for fit in ml.cv_fit(s.folds(h), lambda: ml.learner("cb", ml.base_params(JOINT_ROUNDS) | {"learning_rate": 0.4}, 3, joint=True), 0.3, 3):
            test, k = fit.fold.test, fit.fold.number
            table = scores.score_table(ml.cv_predict([fit]), ["fold"], [0, 1, 2]).select("fold", outside(*METRICS).alias("outside"))
            own = F.element_at(F.array("p0", "p1", "p2"), F.col(ml.LABEL) + 1)
            p = ml.predict_proba(PipelineModel([fit.model]), test, [*KEYS, TS, ml.LABEL])
            shares = test.groupBy(ml.LABEL).count().agg(F.sum(F.col("count") * F.log("count")).alias("a"), F.sum("count").alias("n"))
            loss = p.agg(F.avg(-F.log(F.greatest(own, F.lit(1e-12)))).alias("loss"), F.count_if(unlikely(3)).alias("unlikely"))
            # weights favour rare classes, so the bar is the loss of equal shares where that is higher
            bar = F.greatest(F.log(F.col("n")) - F.col("a") / F.col("n"), F.log(F.lit(3.0)))
            wrong = (F.col("loss") >= bar) | (F.col("unlikely") > 0)
            parts.append(table.join(loss.crossJoin(shares).select(F.lit(k).alias("fold"), wrong.alias("wrong")), "fold").select("fold", (F.col("outside") | F.col("wrong")).cast("long").alias("bad")))
        return prep.union_stations(parts)

    return every_horizon(work)


@query(
    "param_search",
    f"select horizon, unnest(['cb', 'lgb', 'rf', 'xgb']) as model, cast({DRAWS} as bigint) as n, {ZERO} from (select distinct horizon from usable)",
    ["usable"],
)
def _(t):
    """Trials of all learners; a trial also tells how its folds were fitted and the parameters really used."""
    s = Study(t)

    def work(h: int) -> DataFrame:
        folds = s.folds(h)

        def search(m: str) -> DataFrame:
            space = trial_ops.search_space(s.trials(h).where(F.col("model") == m), DRAWS)
            return ml.param_search(folds, (PLACE, h, m), space, ROUNDS)

        found = prep.union_stations(ml.in_threads(search, MODELS))
        depth = F.coalesce(F.col("effective")["depth"], F.col("effective")["max_depth"]).cast("double")
        return counted(found, ["model"], outside("value", "ACC", "PAG", "POD") | (depth > ml.MAX_DEPTH) | F.col("status").contains("fallback"))

    return every_horizon(work)


@query("fit_retry", f"select horizon, fold, 'fallback' as how, count(*) as n, {ZERO} from usable join row_folds using (horizon, fold) where in_test group by horizon, fold", ["usable", "row_folds"])
def _(t):
    """A learner that fails twice is replaced by a plain one, which labels all test rows."""
    s = Study(t)

    def work(h: int) -> DataFrame:
        def one(fold: ml.Fold) -> DataFrame:
            train = ml.at_ratio(fold.train, 0.3)
            broken = ml.learner("cb", BASE).copy().setFeaturesCol("no_such_column")
            model, how = ml.fit_retry(lambda: broken.fit(train), 2, lambda: ml.fit_classifier(ml.learner("rf", BASE), train))
            made = model.transform(fold.test).withColumn("how", F.lit(how))
            return counted(made, ["fold", "how"], ~F.col("prediction").isin(0.0, 1.0))

        return prep.union_stations(ml.in_threads(one, s.folds(h)))

    return every_horizon(work)


def refitted(s: Study, work) -> DataFrame:
    """Percent scores of refits as broken rules per place."""
    made = every_horizon(lambda h: work(s.folds(h), s.trials(h), h).drop("horizon"))
    return counted(made, ["horizon", "station"], outside(*METRICS, top=100.0))


PLACES_OK = f"select distinct horizon, '{PLACE}' as station, cast(1 as bigint) as n, {ZERO} from usable"


@query("refit_best", PLACES_OK, ["usable"])
def _(t):
    return refitted(Study(t), lambda folds, trials, h: ml.refit_best(folds, trials, PLACE, h, ROUNDS))


@query("refit_top2", PLACES_OK, ["usable"])
def _(t):
    return refitted(Study(t), lambda folds, trials, h: ml.refit_top2(folds, trials, PLACE, h, ROUNDS))


@query("ensemble_refit", f"select horizon, station, cast(1 as bigint) as n, {ZERO} from cells", ["cells"])
def _(t):
    """All learners refitted with as many rounds or trees as a run takes, and their vote."""
    return refitted(Study(t), lambda folds, trials, h: ml.ensemble_refit(folds, trials, h))


EXPORTED = """select horizon, fold, cast(sum({k}) as bigint) as n, cast(0 as bigint) as bad from {usable} join {rows} using (horizon, fold) where in_test group by horizon, fold"""


def exported(t: Tables, classes: int, k: int) -> DataFrame:
    """Predictions of the k best models, written and read again."""
    s = Study(t, classes)

    def work(h: int) -> DataFrame:
        path = new_path(t.spark, "export")
        ml.export_topk_predictions(s.folds(h), s.trials(h), k, h, path, ROUNDS, classes)
        found = tables.scan_predictions(t.spark, f"{path}/predictions")
        return counted(found, ["fold"], ~F.col("pred").isin(*range(classes)) | ~F.col("obs").isin(*range(classes)))

    return every_horizon(work)


@query("export_topk_predictions", EXPORTED.format(k=2, usable="usable", rows="row_folds"), ["usable", "row_folds"])
def _(t):
    return exported(t, 2, 2)


@query("export_3class", EXPORTED.format(k=1, usable="usable3", rows="row_folds3"), ["usable3", "row_folds3"])
def _(t):
    return exported(t, 3, 1)


@query("refit_3class", PLACES_OK.replace("usable", "usable3"), ["usable3"])
def _(t):
    return refitted(Study(t, 3), lambda folds, trials, h: ml.refit_best(folds, trials, PLACE, h, ROUNDS, 3))


@query("vote_3class", f"select horizon, station, cast(1 as bigint) as n, {ZERO} from cells3", ["cells3"])
def _(t):
    """All learners refitted on three classes; the label most of them give."""
    return refitted(Study(t, 3), lambda folds, trials, h: ml.ensemble_refit(folds, trials, h, ROUNDS, 3))


@query(
    "holdout_test",
    f"select horizon, station, {ZERO} from rows where datetime >= {TEST_START_SQL} group by horizon, station",
    ["rows", "cal"],
)
def _(t):
    s = Study(t)

    def work(h: int) -> DataFrame:
        _, table = ml.holdout_test(s.rows(h), COLS, t.test_start, ml.learner("rf", BASE), 0.3)
        return table.select("station", outside(*METRICS).cast("long").alias("bad"))

    return every_horizon(work)


@query("batch_predict", f"select horizon, station, obs as label, count(*) as n, {ZERO} from rows group by horizon, station, obs", ["rows"])
def _(t):
    s = Study(t)

    def work(h: int) -> DataFrame:
        model, rows = s.model(h)
        return counted(ml.batch_predict(model, rows), ["station", "label"], ~F.col("pred").isin(0, 1))

    return every_horizon(work)


def unlikely(classes: int = 2) -> Column:
    """Probabilities outside 0..1 or not adding up to 1, or a label that has not the largest."""
    p = [F.col(f"p{c}") for c in range(classes)]
    total = sum(p[1:], p[0])
    own = F.element_at(F.array(*p), F.col("pred") + 1)
    return outside(*[f"p{c}" for c in range(classes)]) | (F.abs(total - 1) > 1e-9) | (own < F.greatest(*p))


@query("predict_proba", BY_STATION, ["rows"])
def _(t):
    s = Study(t)

    def work(h: int) -> DataFrame:
        return counted(ml.predict_proba(*s.model(h)), ["station"], unlikely())

    return every_horizon(work)


@query("predict_proba_3class", BY_STATION.replace("from rows", "from rows3"), ["rows3"])
def _(t):
    """One probability per class, from boosting one class against the rest."""
    s = Study(t, 3)

    def work(h: int) -> DataFrame:
        rows = s.rows(h)
        train = prep.holdout_split(rows, t.test_start, "refit")
        model = ml.fit_pipeline(train, COLS, ml.learner("cb", BASE, 3), classes=3)
        return counted(ml.predict_proba(model, rows), ["station"], unlikely(3))

    return every_horizon(work)


@query("feature_importance", BY_HORIZON, ["usable"])
def _(t):
    """At most 30 positive importances in falling order, which add up to no more than 1."""
    s = Study(t)

    def work(h: int) -> DataFrame:
        found = ml.feature_importance(s.model(h)[0], COLS).withColumn("study", F.lit("cb"))
        top = trial_ops.topk_importance(found, 30, ["study"])
        total = top.agg(F.sum("importance").alias("s"), F.count("*").alias("n"), F.min("importance").alias("least"))
        return total.select(((F.col("s") > 1.01) | (F.col("n") > 30) | (F.col("n") < 1) | (F.col("least") < 0)).cast("long").alias("bad"))

    return every_horizon(work)


@query("save_model", BY_STATION, ["rows"])
def _(t):
    s = Study(t)

    def work(h: int) -> DataFrame:
        model, rows = s.model(h)
        path = new_path(t.spark, "model")
        tables.save_model(model, path)
        return counted(ml.predict_proba(tables.load_model(path), rows), ["station"], unlikely())

    return every_horizon(work)


@query("load_model", f"select horizon, station, obs as label, count(*) as n, {ZERO} from rows group by horizon, station, obs", ["rows"])
def _(t):
    """Labels of a reloaded model counted per station."""
    s = Study(t)

    def work(h: int) -> DataFrame:
        model, rows = s.model(h)
        path = new_path(t.spark, "model")
        tables.save_model(model, path)
        return counted(ml.batch_predict(tables.load_model(path), rows), ["station", "label"], ~F.col("pred").isin(0, 1))

    return every_horizon(work)


@query("reload_parity", "select unnest([1, 3, 6]) as horizon, cast(0 as bigint) as mismatches")
def _(t):
    s = Study(t)

    def work(h: int) -> DataFrame:
        model, rows = s.model(h)
        return ml.reload_parity(model, rows, new_path(t.spark, "parity")).agg(F.count("*").alias("mismatches"))

    return every_horizon(work)


cte(
    "row_train",
    """select fold, features.* from row_folds join row_days using (station, horizon, fold, day_group) join features using (station, datetime)
where horizon = 1 and not in_test and not is_valid and fold in (select fold from usable where horizon = 1)""",
    "row_folds",
    "row_days",
    "usable",
    "features",
)


def scaler_sql(kind: str, cols: list[str]) -> str:
    names = ", ".join(f"'{c}'" for c in cols)
    means = ", ".join(f'avg("{c}")' for c in cols)
    stds = ", ".join(f'stddev_samp("{c}")' for c in cols)
    return f"""select '{kind}' as kind, fold, unnest([{names}]) as feature, unnest([{means}]) as mean, unnest([{stds}]) as std
from row_train group by fold"""


@query(
    "save_scaler",
    f"{scaler_sql('all', lag_columns() + TIME_COLUMNS)} union all {scaler_sql('no_time', lag_columns())}",
    ["row_train"],
    ["mean", "std"],
)
def _(t):
    """Scaler of each fold of the first horizon with and without the time columns, read back as tables."""
    table = ml.fold_table(Study(t).rows(1), t.periods)
    path = new_path(t.spark, "scaler")
    parts = []
    for name, cols in (("all", lag_columns() + TIME_COLUMNS), ("no_time", lag_columns())):

        def fit(k: int, cols: list[str] = cols) -> ml.Fold:
            train = table.where((F.col("fold") == k) & (F.col("role") == "train"))
            return ml.Fold(k, ml.scaler(cols).fit(train), table, table)

        folds = ml.in_threads(fit, ml.usable_folds(table))
        ml.save_scaler(folds, f"{path}/{name}")
        for fold in folds:
            scaling = ml.tables.load_model(f"{path}/{name}/cv{fold.number}").stages[1]
            stats = [(name, fold.number, c, float(m), float(d)) for c, m, d in zip(cols, scaling.mean, scaling.std)]
            parts.append(t.spark.createDataFrame(stats, "kind string, fold int, feature string, mean double, std double"))
    return prep.union_stations(parts)


@query(
    "trend_fit",
    """select station, regr_slope(sst, i) as slope, regr_intercept(sst, i) as intercept, count(*) as n from (
  select station, sst, row_number() over (partition by station order by datetime) - 1 as i from obs) group by station""",
    ["obs"],
    ["slope", "intercept"],
)
def _(t):
    return forecast.trend_fit(t.obs, "sst")


@query(
    "detrend",
    """select station, datetime, sst - (intercept + slope * i) as sst_detrended from (
  select station, datetime, sst, row_number() over (partition by station order by datetime) - 1 as i from obs) join (
  select station, regr_slope(sst, i) as slope, regr_intercept(sst, i) as intercept from (
    select station, sst, row_number() over (partition by station order by datetime) - 1 as i from obs) group by station) using (station)""",
    ["obs"],
    ["sst_detrended"],
)
def _(t):
    return forecast.detrend(t.obs.select("station", "datetime", "sst"), "sst").drop("sst")


@query(
    "detrend_polynomial",
    """with s as (select station, datetime, sst as y, row_number() over w - 1 as i, count(*) over (partition by station) as n from obs window w as (partition by station order by datetime)),
p as (select *, (2 * i - (n - 1)) / greatest(n - 1, 1)::double as u from s),
m as (select station, count(y)::double as a0, sum(u) filter (y is not null) as a1, sum(u ** 2) filter (y is not null) as a2, sum(u ** 3) filter (y is not null) as a3,
  sum(u ** 4) filter (y is not null) as a4, sum(y) as b0, sum(y * u) as b1, sum(y * u ** 2) as b2 from p group by station),
d as (select *, a0 * (a2 * a4 - a3 * a3) - a1 * (a1 * a4 - a3 * a2) + a2 * (a1 * a3 - a2 * a2) as det from m),
c as (select station, (b0 * (a2 * a4 - a3 * a3) - a1 * (b1 * a4 - a3 * b2) + a2 * (b1 * a3 - a2 * b2)) / det as c0,
  (a0 * (b1 * a4 - b2 * a3) - b0 * (a1 * a4 - a3 * a2) + a2 * (a1 * b2 - a2 * b1)) / det as c1,
  (a0 * (a2 * b2 - a3 * b1) - a1 * (a1 * b2 - a2 * b1) + b0 * (a1 * a3 - a2 * a2)) / det as c2 from d)
select station, datetime, y - (c0 + c1 * u + c2 * u * u) as sst_detrended from p join c using (station)""",
    ["obs"],
    ["sst_detrended"],
)
def _(t):
    """A trend of the second degree taken off, against its normal equations in SQL."""
    return forecast.detrend(t.obs.select("station", "datetime", "sst"), "sst", degree=2).drop("sst")


SERIES = """(select station, sst, row_number() over (partition by station order by datetime) as i from obs where datetime {side} TEST_START)"""
TRAIN, TEST = SERIES.format(side="<").replace("TEST_START", TEST_START_SQL), SERIES.format(side=">=").replace("TEST_START", TEST_START_SQL)


def halves(t: Tables) -> tuple[DataFrame, DataFrame]:
    return prep.holdout_split(t.obs, t.test_start, "refit"), prep.holdout_split(t.obs, t.test_start, "test")


@query("recursive_forecast", f"select station, count(*) as n, {ZERO} from {TEST} group by station", ["obs", "cal"])
def _(t):
    """All test rows are forecast on five detrended lags; no value may be missing or far off the range seen."""
    train, test = halves(t)
    ahead = forecast.recursive_forecast(train, "sst", 5, forecast.series_lengths(test), with_trend=True)
    return counted(forecast.forecast_errors(ahead, test, "sst"), ["station"], F.isnan("pred") | (F.abs("pred") > 1000))


@query(
    "recursive_forecast_one_lag",
    f"""with recursive pairs as (select station, sst as y, lag(sst) over (partition by station order by i) as x, i from {TRAIN}),
fit as (select station, regr_slope(y, x) as b, regr_intercept(y, x) as a, arg_max(y, i) as y0 from pairs group by station),
ahead as (select station, a, b, cast(1 as bigint) as step, a + b * y0 as pred from fit union all
  select station, a, b, step + 1, a + b * pred from ahead where step < (select max(i) from {TEST}))
select station, step, sst as obs, pred from ahead join (select station, i as step, sst from {TEST}) using (station, step)""",
    ["obs", "cal"],
    ["obs", "pred"],
)
def _(t):
    """Forecasts on one lag, which SQL can follow step by step."""
    train, test = halves(t)
    ahead = forecast.recursive_forecast(train, "sst", 1, forecast.series_lengths(test))
    return forecast.forecast_errors(ahead, test, "sst").select("station", "step", "obs", "pred")


@query("forecast_window_search", "select station, cast(0 as bigint) as bad from obs group by station", ["obs"])
def _(t):
    """Best window of each series with and without a trend in every fold."""
    found = [forecast.forecast_window_search(t.obs, "sst", with_trend=trend) for trend in (False, True)]
    wrong = ~F.col("window").isin(*forecast.WINDOWS) | outside("mape", top=10.0)
    return prep.union_stations(found).groupBy("station").agg(F.count_if(wrong).alias("bad"))


@query(
    "forecast_window_errors_one_lag",
    """with s as (select station, sst as y, lag(sst) over w as x, row_number() over w - 1 as i, count(*) over (partition by station) as n
  from obs window w as (partition by station order by datetime)),
f as (select *, regr_slope(y, x) over past as b, regr_intercept(y, x) over past as a from s
  window past as (partition by station order by i rows between unbounded preceding and 1 preceding))
select station, cast(1 as bigint) as window, avg(abs(y - (a + b * x)) / greatest(abs(y), 2.220446049250313e-16)) as mape, count(*) as n_folds
from f where i >= floor(n * 0.7) group by station""",
    ["obs"],
    ["mape"],
)
def _(t):
    """Errors of every expanding fold for one lag."""
    return forecast.window_errors(t.obs, "sst", (1,))


@query(
    "searched_forecast",
    f"select station, trend, count(*) as n, {ZERO} from (select station, unnest([true, false]) as trend from {TEST}) group by station, trend",
    ["obs", "cal"],
)
def _(t):
    """Window of each series, with and without a trend, then all its test rows, MAE and MAPE."""
    train, test = halves(t)
    parts = []
    for trend in (False, True):
        rows, errors = forecast.searched_forecast(train, test, "sst", with_trend=trend)
        made = rows.join(materialize(errors, "errors"), "station", "left").withColumn("trend", F.lit(trend))
        wrong = F.isnan("pred") | (F.abs("pred") > 1000) | F.col("window").isNull() | F.col("mae").isNull() | F.col("mape").isNull()
        parts.append(counted(made, ["station", "trend"], wrong))
    return prep.union_stations(parts)


TREES = {"rounds": 10, "depth": 4, "rate": 0.3}


@query(
    "recursive_forecast_trees",
    f"select station, count(*) as n, {ZERO} from {TEST} group by station",
    ["obs", "cal"],
)
def _(t):
    """All test rows are forecast by one tree ensemble on two lags; forecasts stay near the range of what was seen and are not all alike."""
    train, test = halves(t)
    ahead = tree_forecast.recursive_forecast_trees(train, "sst", 2, forecast.series_lengths(test), **TREES)
    seen = train.agg(F.min("sst").alias("lo"), F.max("sst").alias("hi")).first()
    wide = seen["hi"] - seen["lo"]
    rows = forecast.forecast_errors(ahead, test, "sst")
    return counted(rows, ["station"], F.isnan("pred") | ~F.col("pred").between(seen["lo"] - wide, seen["hi"] + wide))


@query(
    "searched_forecast_trees",
    f"select station, count(*) as n, {ZERO} from {TEST} group by station",
    ["obs", "cal"],
)
def _(t):
    """Window of each series by expanding folds of tree ensembles, then all its test rows, MAE and MAPE."""
    train, test = halves(t)
    rows, errors = tree_forecast.searched_tree_forecast(train, test, "sst", (2, 5), **TREES)
    made = rows.join(materialize(errors, "errors"), "station", "left")
    wrong = F.isnan("pred") | F.col("window").isNull() | ~F.col("window").isin(2, 5) | F.col("mae").isNull() | outside("mape", top=10.0)
    return counted(made, ["station"], wrong | F.col("pred").isNull())
