"""Queries on folds, weights and scores."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from seafret.operators import folds, prep, scores, weights
from seafret.schema import STATIONS
from seafret.session import materialize
from workload.registry import query
from workload.standins import FOLD_OF, T0

FOLD_KEYS = ["station", "horizon", "model", "fold"]


# ---- folds ---------------------------------------------------------------------------


@query("year_folds", "select station, datetime, fold, in_test from folds", ["folds"])
def _(t):
    return folds.year_folds(t.labels, t.periods).select("station", "datetime", "fold", "in_test")


@query("day_group", "select station, datetime, year(datetime) * 366 + dayofyear(datetime) as day_group from obs", ["obs"])
def _(t):
    return folds.day_group(t.obs).select("station", "datetime", F.col("day_group").cast("long").alias("day_group"))


@query("stratified_group_split", "select * from days", ["days"])
def _(t):
    return folds.stratified_group_split(t.folds).withColumn("day_group", F.col("day_group").cast("long"))


CLASS_DAYS = """select station, fold, cast(day_group as bigint) as day_group, count(*) filter (where label3 = 0) as n0, count(*) filter (where label3 = 1) as n1,
  count(*) filter (where label3 = 2) as n2 from folds where not in_test and label3 is not null group by all"""


@query("class_days", CLASS_DAYS, ["folds"])
def _(t):
    days = folds.class_days(t.labels, t.periods, "label3")
    return days.withColumn("day_group", F.col("day_group").cast("long"))


@query(
    "greedy_group_split",
    f"""select station, fold, count(*) as days, cast(sum(n0) as bigint) as n0, cast(sum(n1) as bigint) as n1, cast(sum(n2) as bigint) as n2, cast(0 as bigint) as unbalanced
from ({CLASS_DAYS}) group by station, fold""",
    ["folds"],
)
def _(t):
    """All days are dealt; no part holds a share of a class further from a fifth than two of its largest days."""
    names = ["n0", "n1", "n2"]
    dealt = folds.greedy_group_split(folds.class_days(t.labels, t.periods, "label3"))
    parts = dealt.groupBy("station", "fold", "part").agg(F.count("*").alias("days"), *[F.sum(n).alias(n) for n in names], *[F.max(n).alias(f"max_{n}") for n in names])
    total = parts.groupBy("station", "fold").agg(
        F.sum("days").alias("days"), *[F.sum(n).alias(n) for n in names], *[F.max(f"max_{n}").alias(f"max_{n}") for n in names],
        F.collect_list(F.struct(*names)).alias("held"),
    )

    def far_from_a_fifth(n: str) -> Column:
        return F.exists("held", lambda h: F.abs(h[n] - F.col(n) / 5) > F.col(f"max_{n}") * 2).cast("long")

    far = [far_from_a_fifth(n) for n in names]
    return total.select("station", "fold", "days", *names, (far[0] + far[1] + far[2]).alias("unbalanced"))


@query(
    "embargoed_folds",
    f"""select station, fold, count(*) as n, count(*) filter (where in_test) as n_test from folds, cal
where label is not null and (in_test or epoch(datetime) <= {T0} + (3 - fold) * third * 86400 - 21600
  or fold > 1 and epoch(datetime) > {T0} + (4 - fold) * third * 86400 + 43200) group by station, fold""",
    ["folds", "cal"],
)
def _(t):
    """Rows too near to a test period, six hours before or twelve after it, have no part in its fold."""
    bits = folds.fold_bits(t.labels.where("label is not null"), t.periods, embargo=(21600, 43200))
    return folds.by_fold(bits, 3).groupBy("station", "fold").agg(F.count("*").alias("n"), F.count_if(F.col("role") == "test").alias("n_test"))


@query("fold_roles", "select station, datetime, fold, role from roles", ["roles"])
def _(t):
    return folds.fold_roles(t.folds).select("station", "datetime", "fold", "role")


@query("first_fold_only", "select station, datetime, fold, role, label3 from roles where fold = 1", ["roles"])
def _(t):
    return folds.first_fold_only(folds.fold_roles(t.folds)).select("station", "datetime", "fold", "role", "label3")


@query(
    "complement_split",
    f"select station, datetime, label from grid where {FOLD_OF} <> 1",
    ["grid", "cal"],
)
def _(t):
    return folds.complement_split(t.labels.drop("label3"), folds.in_period("datetime", *t.periods[0]))


@query(
    "expanding_window_folds",
    """select station, i - first as fold, i as train_rows, datetime as test_time from (
  select station, datetime, row_number() over (partition by station order by datetime) - 1 as i,
    cast(floor(count(*) over (partition by station) * 0.7) as bigint) as first from obs) where i >= first""",
    ["obs"],
)
def _(t):
    return folds.expanding_window_folds(t.obs)


# ---- weights -------------------------------------------------------------------------

N = "sum(case when label = {c} then 1 else 0 end)"


@query(
    "class_counts",
    "select station, count(label) as n, count(*) filter (where label = 0) as n0, count(*) filter (where label = 1) as n1 from grid group by station",
    ["grid"],
)
def _(t):
    return weights.class_counts(t.labels)


@query(
    "sample_weight_binary",
    """select station, datetime, label, case when label = 0 then 1 / (n0 / (n1 + 1) * 0.3e0) else 1e0 end as weight from grid join (
  select station, count(*) filter (where label = 0) as n0, count(*) filter (where label = 1) as n1 from grid group by station) using (station)""",
    ["grid"],
    ["weight"],
)
def _(t):
    return weights.sample_weight_binary(t.labels.drop("label3"), 0.3)


@query(
    "sample_weight_3class",
    """select station, datetime, label3, case when label3 = 0 then 1 / (n0 / (n2 + 1) * 0.3e0) else 1e0 end as weight from grid join (
  select station, count(*) filter (where label3 = 0) as n0, count(*) filter (where label3 = 2) as n2 from grid group by station) using (station)""",
    ["grid"],
    ["weight"],
)
def _(t):
    return weights.sample_weight_3class(t.labels.drop("label"), 0.3)


@query("sample_weight_static", "select station, datetime, label, case when label = 0 then 1 / 50e0 else 1e0 end as weight from grid", ["grid"], ["weight"])
def _(t):
    return weights.sample_weight_static(t.labels.drop("label3"), 50)


@query(
    "class_weight_params",
    """select station, unnest([0, 1, 2]) as class, unnest([1e0, n0 / (n1 + 1), n0 / (n2 + 1)]) as class_weight from (
  select station, count(*) filter (where label3 = 0) as n0, count(*) filter (where label3 = 1) as n1,
    count(*) filter (where label3 = 2) as n2 from grid group by station)""",
    ["grid"],
    ["class_weight"],
)
def _(t):
    return weights.class_weight_params(t.labels, "label3", classes=3)


# ---- scores --------------------------------------------------------------------------


def cell(o: int, p: int) -> str:
    return f"count(*) filter (where obs = {o} and pred = {p})"


def macro_sql(kind: str, labels: list[int], table: str, keys: list[str]) -> str:
    """Macro score by joining class counts, written per class and averaged."""
    k = ", ".join(keys)
    classes = ", ".join(str(c) for c in labels)
    value = {
        "PAG": "case when tp + fp > 0 then tp / (tp + fp) else 0 end",
        "POD": "case when tp + fn > 0 then tp / (tp + fn) else 0 end",
        "F1": "case when 2 * tp + fp + fn > 0 then 2 * tp / (2 * tp + fp + fn) else 0 end",
    }[kind]
    return f"""select {k}, avg({value}) as "{kind}" from (
  select {k}, c, count(*) filter (where obs = c and pred = c) as tp, count(*) filter (where obs <> c and pred = c) as fp,
    count(*) filter (where obs = c and pred <> c) as fn
  from (select *, unnest([{classes}]) as c from {table}) group by {k}, c) where tp + fp + fn > 0 group by {k}"""


def scores_sql(table: str, keys: list[str], labels: list[int] = (0, 1)) -> str:
    k = ", ".join(keys)
    parts = " join ".join(
        [f"(select {k}, avg(case when obs = pred then 1e0 else 0e0 end) as \"ACC\", max(obs) as top from {table} group by {k})"]
        + [f"({macro_sql(m, list(labels), table, keys)}) using ({k})" for m in ("PAG", "POD", "F1")]
    )
    return f'select {k}, "ACC", "PAG", "POD", "F1", top from {parts}'


K = ", ".join(FOLD_KEYS)


@query(
    "confusion_binary",
    f'select {K}, {cell(0, 0)} as "TN", {cell(0, 1)} as "FP", {cell(1, 0)} as "FN", {cell(1, 1)} as "TP" from preds group by {K}',
    ["preds"],
)
def _(t):
    return scores.confusion_binary(t.preds)


@query(
    "confusion_3class",
    f"select {K}, " + ", ".join(f"{cell(o, p)} as cm{3 * o + p + 1}" for o in range(3) for p in range(3)) + f" from preds3 group by {K}",
    ["preds3"],
)
def _(t):
    return scores.confusion_3class(t.preds3)


@query("score_accuracy", f'select {K}, avg(case when obs = pred then 1e0 else 0e0 end) as "ACC" from preds group by {K}', ["preds"], ["ACC"])
def _(t):
    return scores.score_accuracy(t.preds)


@query("score_precision_macro", macro_sql("PAG", [0, 1], "preds", FOLD_KEYS), ["preds"], ["PAG"])
def _(t):
    return scores.score_precision_macro(t.preds)


@query("score_recall_macro", macro_sql("POD", [0, 1], "preds", FOLD_KEYS), ["preds"], ["POD"])
def _(t):
    return scores.score_recall_macro(t.preds)


@query("score_f1_macro", macro_sql("F1", [0, 1, 2], "preds3", FOLD_KEYS), ["preds3"], ["F1"])
def _(t):
    return scores.score_f1_macro(t.preds3, labels=[0, 1, 2])


@query(
    "score_one_vs_rest",
    f"""select *, case when pag + pod > 0 then round_even(2 * pag * pod / (pag + pod), 2) end as f1 from (
  select {K}, label, round_even((n - fp - fn) / n * 100, 2) as acc, case when tp + fp > 0 then round_even(tp / (tp + fp) * 100, 2) end as pag,
    case when tp + fn > 0 then round_even(tp / (tp + fn) * 100, 2) end as pod from (
    select {K}, label, count(*) as n, count(*) filter (where obs = label and pred = label) as tp,
      count(*) filter (where obs <> label and pred = label) as fp, count(*) filter (where obs = label and pred <> label) as fn
    from (select *, unnest([0, 1, 2]) as label from preds3) group by {K}, label))""",
    ["preds3"],
    ["acc", "pag", "pod", "f1"],
)
def _(t):
    return scores.score_one_vs_rest(t.preds3)


@query(
    "degenerate_fold_guard",
    f"""select *, n_obs = 0 as no_fog, n_obs = 0 and n_pred = 0 as all_clear from (
  select {K}, count(*) as n, count(*) filter (where obs = 1) as n_obs, count(*) filter (where pred = 1) as n_pred from preds group by {K})""",
    ["preds"],
)
def _(t):
    return scores.degenerate_fold_guard(t.preds)


FOLDS_SQL = f"select * from ({scores_sql('preds', FOLD_KEYS)}) where top > 0"
METRICS = ["ACC", "PAG", "POD", "F1"]


@query(
    "fold_macro_mean",
    'select station, horizon, model, avg("ACC") as "ACC", avg("PAG") as "PAG", avg("POD") as "POD", avg("F1") as "F1" '
    f"from ({FOLDS_SQL}) group by station, horizon, model",
    ["preds"],
    METRICS,
)
def _(t):
    return scores.fold_macro_mean(scores.scored_folds(t.preds))


VOTES_SQL = """select station, horizon, fold, datetime, max(obs) as obs, case when avg(pred) >= 0.5 then 1 else 0 end as pred
from preds group by station, horizon, fold, datetime"""


@query("vote_ensemble", VOTES_SQL, ["preds"])
def _(t):
    return scores.vote_ensemble(t.preds)


ENSEMBLE_SQL = f"""with votes as ({VOTES_SQL}), per as (
  select * from ({scores_sql('votes', ['station', 'horizon', 'fold'])}) where top > 0)
select station, horizon, avg(round_even("ACC", 2)) as "ACC", avg(round_even("PAG", 2)) as "PAG",
  avg(round_even("POD", 2)) as "POD", avg(round_even("F1", 2)) as "F1" from per group by station, horizon"""


@query("ensemble_scores", ENSEMBLE_SQL, ["preds"], METRICS)
def _(t):
    return scores.ensemble_scores(t.preds)


PIVOT_SQL = ", ".join(f"max(case when station = '{s}' then x end) as {s}" for s in STATIONS)


@query(
    "summary_pivot",
    f"""select score, {PIVOT_SQL} from (
  select station, 'acc_' || horizon as score, "ACC" as x from ({ENSEMBLE_SQL}) union all
  select station, 'f1_' || horizon, "F1" from ({ENSEMBLE_SQL})) group by score""",
    ["preds"],
    STATIONS,
)
def _(t):
    return scores.summary_pivot(scores.ensemble_scores(t.preds), STATIONS)


SCALED = ["temp", "sst", "qff", "rh", "temp-Td"]


@query(
    "scaler_stats",
    " union all ".join(
        f"select fold, '{c}' as feature, avg(\"{c}\") as mean, stddev_pop(\"{c}\") as std from roles join grid using (station, datetime) where role = 'train' group by fold"
        for c in SCALED
    ),
    ["roles", "grid"],
    ["mean", "std"],
)
def _(t):
    rows = t.grid.select("station", "datetime", "label", *SCALED)
    train = folds.fold_roles(folds.year_folds(folds.day_group(rows), t.periods)).where("role = 'train'")
    return scores.scaler_stats(train, SCALED, ["fold"])


PAIR_KEYS = ["station", "horizon", "fold", "datetime"]


def two_runs(t):
    """Predictions of two models from one written table."""
    preds = materialize(t.preds.where(F.col("model").isin("cb", "lgb")), "preds")
    return tuple(prep.run_filter(preds, model=m).select(*PAIR_KEYS, "pred") for m in ("cb", "lgb"))


@query(
    "positive_totals",
    "select station, horizon, cast(sum(pred) filter (where model = 'cb') as bigint) as positives_a, cast(sum(pred) filter (where model = 'lgb') as bigint) as positives_b from preds group by station, horizon",
    ["preds"],
)
def _(t):
    return scores.positive_totals(*two_runs(t), keys=["station", "horizon"])


PARITY_SQL = """select * from (
  select station, horizon, fold, datetime, max(pred) filter (where model = 'cb') as pred_a, max(pred) filter (where model = 'lgb') as pred_b
  from preds group by station, horizon, fold, datetime) where coalesce(pred_a, 0) + coalesce(pred_b, 0) = 1"""


@query("pred_parity", PARITY_SQL, ["preds"])
def _(t):
    return scores.pred_parity(*two_runs(t), keys=PAIR_KEYS)


@query("first_mismatch", f"{PARITY_SQL} order by station, horizon, fold, datetime limit 1", ["preds"])
def _(t):
    return scores.first_mismatch(*two_runs(t), keys=PAIR_KEYS)


@query(
    "error_mae_mape",
    """select station, avg(abs(sst - p)) as mae, avg(abs(sst - p) / greatest(abs(sst), 2.220446049250313e-16)) as mape
from (select station, sst, lag(sst) over (partition by station order by datetime) as p from obs) where p is not null group by station""",
    ["obs"],
    ["mae", "mape"],
)
def _(t):
    from seafret.operators.windows import lag_reduction

    pairs = lag_reduction(t.obs, "sst", 1)
    return scores.error_mae_mape(pairs, ["station"], "y", "x1")


@query(
    "join_obs_pred",
    f"""select station, horizon, fold, datetime, model, obs, pred from
(select distinct station, horizon, fold, datetime, obs from preds) join (select station, horizon, fold, datetime, model, pred from preds) using (station, horizon, fold, datetime)""",
    ["preds"],
)
def _(t):
    obs = t.preds.select(*PAIR_KEYS, "obs").distinct()
    return scores.join_obs_pred(obs, t.preds.select(*PAIR_KEYS, "model", "pred"))

