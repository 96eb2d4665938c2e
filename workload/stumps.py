"""Fits whose values SQL can say: one tree of depth one over columns of 0 and 1.

The split of such a tree is the column whose two halves differ most and its leaves are weighted means, so SQL finds the same
tree from sums per column and value, and with it every probability, label, score and importance. The queries go through the
same folds, weights, learners and scores as those of `workload.learning`; a constant predictor fails them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from seafret.operators import ml, prep
from seafret.operators.boosting_kinds import Kind, dropped_trees
from seafret.schema import KEYS, TS
from workload.learning import METRICS, PLACE, Study, every_horizon, once
from workload.registry import cte, query
from workload.scoring import scores_sql
from workload.standins import TEST_START_SQL

#: Columns of 0 and 1: a feature above a limit that lies between the values readings can have.
FLAGS = {
    "fog_seen": ("fog_count_lag00", 8.5),
    "fog_before": ("fog_count_lag06", 8.5),
    "humid": ("rh_lag00", 75.03),
    "sea_colder": ("ASTD_lag00", 0.013),
    "high_pressure": ("qff_lag00", 1020.017),
    "easterly": ("u_lag00", 0.017),
    "clear": ("vis_lag00", 2000.3),
}
#: One tree of depth one, grown whatever it gains and however few rows a leaf has.
STUMP = {"depth": 1, "max_depth": 1, "min_data_in_leaf": 1, "min_child_samples": 1, "gamma": 0}
RATIO = 0.3


def flagged(s: Study, horizon: int) -> DataFrame:
    """The training rows of a horizon with flags in place of features."""
    flags = [(F.col(f"`{c}`") > limit).cast("double").alias(name) for name, (c, limit) in FLAGS.items()]
    return s.rows(horizon).select(*KEYS, TS, *flags, ml.LABEL, ml.WEIGHT)


def flag_folds(s: Study, horizon: int) -> list[ml.Fold]:
    def make() -> list[ml.Fold]:
        return ml.prepare_folds(ml.fold_table(flagged(s, horizon), s.tables.periods), list(FLAGS))

    return once((*s.key, "flag folds", horizon), make)


def stump(classes: int = 2):
    return ml.learner("cb", STUMP | ml.base_params(1), classes)


def held_out(s: Study, horizon: int):
    """Model of the rows before the test period, and its scores per station after it."""
    return ml.holdout_test(flagged(s, horizon), list(FLAGS), s.tables.test_start, stump(s.classes), RATIO, classes=s.classes)


# ---- the same trees in SQL -------------------------------------------------------------

VALUES = ", ".join(f'cast("{c}" > {limit} as integer) as {name}' for name, (c, limit) in FLAGS.items())


def weight_sql(rare: int) -> str:
    return f"case when obs = 0 then 1 / (n0 / (n{rare} + 1) * {RATIO}) else 1e0 end as w"


def counts_sql(rows: str, rare: int) -> str:
    return f"(select station, horizon, count(*) filter (where obs = 0) as n0, count(*) filter (where obs = {rare}) as n{rare} from {rows} group by all)"


def trees(name: str, classes: list[int], *deps: str) -> None:
    """Sums, split, leaves and test predictions of the trees over `{name}_rows`, one tree per horizon, fold and class."""
    flags = ", ".join(f"'{f}'" for f in FLAGS)
    cte(f"{name}_tall", f"select horizon, fold, station, datetime, obs, w, part, unnest([{flags}]) as flag, unnest([{', '.join(FLAGS)}]) as v from {name}_rows", f"{name}_rows", *deps)
    cte(
        f"{name}_sums",
        f"""select horizon, fold, c, flag, v, sum(w) as sw, sum(case when obs = c then w else -w end) as sy
from (select *, unnest({classes}) as c from {name}_tall where part = 'train') group by all""",
        f"{name}_tall",
    )
    cte(
        f"{name}_split",
        f"""select horizon, fold, c, arg_max(flag, gain) as flag from (
  select horizon, fold, c, flag, sum(sy * sy / sw) as gain from {name}_sums group by all having count(*) = 2) group by all""",
        f"{name}_sums",
    )
    cte(f"{name}_leaves", f"select horizon, fold, c, flag, v, sy / sw as margin from {name}_sums join {name}_split using (horizon, fold, c, flag)", f"{name}_sums", f"{name}_split")
    label = "case when max(margin) > 0 then 1 else 0 end" if len(classes) == 1 else "first(c order by margin desc, c)"
    cte(
        f"{name}_preds",
        f"""select horizon, fold, station, datetime, max(obs) as obs, {label} as pred, max(1 / (1 + exp(-2 * margin))) as p1
from {name}_tall join {name}_leaves using (horizon, fold, flag, v) where part = 'test' group by horizon, fold, station, datetime""",
        f"{name}_tall",
        f"{name}_leaves",
    )


cte(
    "stump_rows",
    f"""select horizon, fold, station, datetime, obs, {weight_sql(1)}, case when in_test then 'test' when is_valid then 'valid' else 'train' end as part, {VALUES}
from row_folds join usable using (horizon, fold) left join row_days using (station, horizon, fold, day_group)
join {counts_sql('rows', 1)} using (station, horizon) join features using (station, datetime)""",
    "row_folds", "usable", "row_days", "rows", "features",
)
trees("stump", [1])
for _name, _rows, _rare, _classes in (("held", "rows", 1, [1]), ("held3", "rows3", 2, [0, 1, 2])):
    cte(
        f"{_name}_rows",
        f"""select horizon, 1 as fold, station, datetime, obs, {weight_sql(_rare)}, case when datetime < {TEST_START_SQL} then 'train' else 'test' end as part, {VALUES}
from {_rows} left join {counts_sql(f'(select * from {_rows} where datetime < {TEST_START_SQL})', _rare)} using (station, horizon) join features using (station, datetime)""",
        _rows, "features", "cal",
    )
    trees(_name, _classes)
SCORES = ", ".join(f'"{m}"' for m in METRICS)

#: Kinds of boosting rounds with an L2 term, rounds and step size; dropping is made frequent, so that few rounds show it.
KINDS = {"gbdt": Kind(l2=25.0), "dart": Kind("dart", l2=4.0, drop=0.6, skip=0.0)}
KIND_ROUNDS, KIND_STEP, SEED = 3, 0.4, 1


def kind_rounds(name: str, kind: Kind) -> list[float]:
    """A table of each round's sums, leaves and tree values `t0`, `t1`, ...; the scales of the trees after the last round."""
    scales: list[float] = []
    total = lambda parts: " + ".join(f"{s!r} * t{i}" for i, s in enumerate(parts) if s) or "0e0"
    values, flags = ", ".join(FLAGS), ", ".join(f"'{f}'" for f in FLAGS)
    cte(f"{name}_x0", "select *, 2e0 * obs - 1 as y from stump_rows", "stump_rows")
    for k in range(KIND_ROUNDS):
        out = dropped_trees(kind, k, SEED)
        now = total([0.0 if i in out else s for i, s in enumerate(scales)])
        g = f"4 * y / (1 + exp(2 * y * ({now})))" if k else "y"
        cte(
            f"{name}_sums{k}",
            f"""select horizon, fold, flag, v, sum(w) as sw, sum(w * g) as sg from (
  select horizon, fold, w, {g} as g, unnest([{flags}]) as flag, unnest([{values}]) as v from {name}_x{k} where part = 'train') group by all""",
            f"{name}_x{k}",
        )
        cte(
            f"{name}_leaves{k}",
            f"""select horizon, fold, flag, v, sg / (sw + {kind.l2!r}) as t{k} from {name}_sums{k} join (
  select horizon, fold, arg_max(flag, gain) as flag from (
    select horizon, fold, flag, sum(sg * sg / sw) as gain from {name}_sums{k} group by all having count(*) = 2) group by all) using (horizon, fold, flag)""",
            f"{name}_sums{k}",
        )
        own = " ".join(f"when '{f}' then {f}" for f in FLAGS)
        cte(
            f"{name}_x{k + 1}",
            f"select x.*, l.t{k} from {name}_x{k} x join {name}_leaves{k} l on x.horizon = l.horizon and x.fold = l.fold and l.v = case l.flag {own} end",
            f"{name}_x{k}",
            f"{name}_leaves{k}",
        )
        scales = [s * len(out) / (len(out) + 1) if i in out else s for i, s in enumerate(scales)]
        scales.append((KIND_STEP if k else 1.0) / (len(out) + 1))
    cte(f"{name}_preds", f"select horizon, fold, station, {total(scales)} as margin from {name}_x{KIND_ROUNDS} where part = 'test'", f"{name}_x{KIND_ROUNDS}")
    return scales


for _name, _kind in KINDS.items():
    kind_rounds(f"kind_{_name}", _kind)


# ---- queries ---------------------------------------------------------------------------


@query("boosted_stumps", "select horizon, fold, station, count(*) as n, cast(sum(pred) as bigint) as n_pred, avg(p1) as p1 from stump_preds group by horizon, fold, station", ["stump_preds"], ["p1"])
def _(t):
    """Labels and mean probability of every station's test rows in every fold."""
    s = Study(t)

    def work(h: int) -> DataFrame:
        parts = []
        for fit in ml.cv_fit(flag_folds(s, h), stump, RATIO):
            p = ml.predict_proba(ml.PipelineModel([fit.model]), fit.fold.test)
            found = p.groupBy("station").agg(F.count("*").alias("n"), F.sum(F.col("pred").cast("long")).alias("n_pred"), F.avg("p1").alias("p1"))
            parts.append(found.withColumn("fold", F.lit(fit.fold.number)))
        return prep.union_stations(parts)

    return every_horizon(work)


@query(
    "boosting_kinds_stumps",
    " union all ".join(
        f"""select '{n}' as kind, horizon, fold, station, count(*) as n, count(*) filter (where margin > 0) as n_pred, avg(1 / (1 + exp(-2 * margin))) as p1
from kind_{n}_preds group by horizon, fold, station""" for n in KINDS
    ),
    [f"kind_{n}_preds" for n in KINDS],
    ["p1"],
)
def _(t):
    """Labels and mean probability of the test rows after rounds with shrunken leaves, and with dropped trees besides."""
    s = Study(t)

    def one(name: str, fold: ml.Fold) -> DataFrame:
        clf = ml.learner("cb", STUMP | ml.base_params(KIND_ROUNDS) | {"learning_rate": KIND_STEP}, by_round=True)
        clf.kind = KINDS[name]
        p = ml.predict_proba(ml.PipelineModel([ml.fit_classifier(clf, ml.at_ratio(fold.train, RATIO))]), fold.test)
        found = p.groupBy("station").agg(F.count("*").alias("n"), F.sum(F.col("pred").cast("long")).alias("n_pred"), F.avg("p1").alias("p1"))
        return found.withColumns({"fold": F.lit(fold.number), "kind": F.lit(name)})

    def work(h: int) -> DataFrame:
        places = [(n, f) for n in KINDS for f in flag_folds(s, h)]
        return prep.union_stations(ml.in_threads(lambda p: one(*p), places))

    return every_horizon(work)


@query("cv_evaluate_stumps", f"select horizon, fold, {SCORES} from ({scores_sql('stump_preds', ['horizon', 'fold'])})", ["stump_preds"], list(METRICS))
def _(t):
    """Scores of every fold."""
    s = Study(t)
    return every_horizon(lambda h: ml.cv_evaluate(flag_folds(s, h), stump, RATIO).select("fold", *METRICS))


@query(
    "refit_best_stumps",
    f"""select horizon, '{PLACE}' as station, {', '.join(f'round_even(avg("{m}") * 100, 2) as "{m}"' for m in METRICS)}
from ({scores_sql('stump_preds', ['horizon', 'fold'])}) group by horizon""",
    ["stump_preds"],
    list(METRICS),
)
def _(t):
    """The best boosted learner of the trials with its tuned values, refitted on every fold: percent scores, averaged."""
    s = Study(t)
    tuned = F.create_map(*[F.lit(str(x)) for pair in (STUMP | {"pos_label_ratio": RATIO}).items() for x in pair])

    def work(h: int) -> DataFrame:
        history = s.trials(h).where("model != 'rf'").withColumn("params", tuned)
        return ml.refit_best(flag_folds(s, h), history, PLACE, h, 1).select("station", *METRICS)

    return every_horizon(work)


@query("holdout_test_stumps", f"select horizon, station, {SCORES} from ({scores_sql('held_preds', ['horizon', 'station'])})", ["held_preds"], list(METRICS))
def _(t):
    s = Study(t)
    return every_horizon(lambda h: held_out(s, h)[1].select("station", *METRICS))


@query("holdout_test_stumps_3class", f"select horizon, station, {SCORES} from ({scores_sql('held3_preds', ['horizon', 'station'], [0, 1, 2])})", ["held3_preds"], list(METRICS))
def _(t):
    """Three classes, one tree against the rest for each."""
    s = Study(t, 3)
    return every_horizon(lambda h: held_out(s, h)[1].select("station", *METRICS))


@query(
    "feature_importance_stumps",
    f"select horizon, feature, case when feature = flag then 1e0 else 0e0 end as importance from held_split, (select unnest({list(FLAGS)}) as feature)",
    ["held_split"],
)
def _(t):
    """The column of the split has all the importance."""
    s = Study(t)
    return every_horizon(lambda h: ml.feature_importance(held_out(s, h)[0], list(FLAGS)))
