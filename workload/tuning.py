"""Queries on trial history, parameters and model choice."""

from __future__ import annotations

from pyspark.sql import functions as F

from seafret.operators import prep, scores, trials
from workload.registry import CTES, cte, query, with_ctes  # noqa: F401
from workload.scoring import FOLDS_SQL

STUDY = "station, horizon, model"
ORDER = "case model when 'cb' then 1 when 'lgb' then 2 when 'rf' then 3 else 4 end"

cte("best", f"select * exclude r from (select *, row_number() over (partition by {STUDY} order by value desc, trial_id) as r from trials) where r = 1", "trials")
cte("ranked", f"select *, row_number() over (partition by station, horizon order by value desc, {ORDER}) as rank from best", "best")
cte(
    "trial_log",
    """select *, ['model_params.depth=' || depth, 'model_params.learning_rate=0.' || lpad(cast(trial_id % 10 * 10 + 5 as varchar), 3, '0'),
  'pos_label_ratio=0.00' || (trial_id % 9 + 1), 'stage=train', 'pred_hour=' || horizon] as overrides from trials""",
    "trials",
)
ALL = ["value", "learning_rate"]


@query("scan_trials", "select * from trials where station = 'SF_0003' and horizon = 3 and model = 'rf'", ["trials"], ALL)
def _(t):
    from seafret.session import new_path
    from seafret.sources import tables

    path = new_path(t.spark, "trials")
    tables.write_metrics(t.trials, path)
    return tables.scan_trials(t.spark, path, "SF_0003", 3, "rf")


@query("run_filter", "select * from trials where model = 'lgb' and horizon = 1", ["trials"], ALL)
def _(t):
    return prep.run_filter(t.trials, model="lgb", horizon=1)


@query("best_trial", "select * from best", ["best"], ALL)
def _(t):
    return trials.best_trial(t.trials)


@query("best_model", "select * exclude rank from ranked where rank = 1", ["ranked"], ALL)
def _(t):
    return trials.best_model(t.trials)


@query("top2_models", "select * from ranked where rank <= 2", ["ranked"], ALL)
def _(t):
    return trials.top2_models(t.trials)


@query("topk_models", "select * from ranked where rank <= 3", ["ranked"], ALL)
def _(t):
    return trials.topk_models(t.trials, 3)


@query(
    "best_of_refit",
    f"""select station, horizon, model, "ACC", "PAG", "POD", "F1" from (
  select *, row_number() over (partition by station, horizon order by "F1" desc, {ORDER}) as r from (
    select station, horizon, model, round_even(avg("ACC") * 100, 2) as "ACC", round_even(avg("PAG") * 100, 2) as "PAG",
      round_even(avg("POD") * 100, 2) as "POD", round_even(avg("F1") * 100, 2) as "F1" from ({FOLDS_SQL}) group by station, horizon, model)) where r = 1""",
    ["preds"],
    ["ACC", "PAG", "POD", "F1"],
)
def _(t):
    return trials.best_of_refit(scores.fold_macro_mean(scores.scored_folds(t.preds), percent=True))


@query(
    "topk_importance",
    f"""select {STUDY}, feature, round_even(x, 4) as importance, r as rank from (
  select *, row_number() over (partition by {STUDY} order by x desc, feature) as r from (
    select {STUDY}, 'depth_' || depth || '_' || trial_id % 100 as feature, sum(value) as x from trials group by all) where x > 0) where r <= 30""",
    ["trials"],
    ["importance"],
)
def _(t):
    name = F.concat(F.lit("depth_"), F.col("depth"), F.lit("_"), F.col("trial_id") % 100)
    shares = t.trials.groupBy("station", "horizon", "model", name.alias("feature")).agg(F.sum("value").alias("importance"))
    return trials.topk_importance(shares, 30)


@query(
    "last_n_trials",
    f"select * exclude r from (select *, row_number() over (partition by {STUDY} order by trial_id desc) as r from trials) where r <= 50",
    ["trials"],
    ALL,
)
def _(t):
    return trials.last_n_trials(t.trials, 50)


@query(
    "argmax_trial",
    f"select {STUDY}, best.trial_id, best.value as best, count(*) filter (where trials.trial_id < best.trial_id) as place from trials join best using ({STUDY}) group by {STUDY}, best.trial_id, best.value",
    ["best", "trials"],
    ["best"],
)
def _(t):
    return trials.argmax_trial(t.trials)


@query("study_complete", f"select {STUDY}, count(*) as n_trials from trials group by all having count(*) >= 110", ["trials"])
def _(t):
    return trials.study_complete(t.trials, 110)


@query(
    "join_model_names",
    "select station, horizon, string_agg(model, '_' order by rank) as models from ranked where rank <= 3 group by all",
    ["ranked"],
)
def _(t):
    return trials.join_model_names(trials.topk_models(t.trials, 3))


PARSED = "(select trial_id, unnest(overrides[1:3]) as o from trial_log)"


@query(
    "parse_overrides",
    f"select trial_id, split_part(split_part(o, '=', 1), '.', -1) as param, cast(split_part(o, '=', 2) as double) as value from {PARSED}",
    ["trial_log"],
    ["value"],
)
def _(t):
    return trials.parse_overrides(t.trial_log)


@query(
    "trial_params_wide",
    f"""select trial_id, max(case when o like '%depth=%' then cast(split_part(o, '=', 2) as double) end) as depth,
  max(case when o like '%learning_rate=%' then cast(split_part(o, '=', 2) as double) end) as learning_rate,
  max(case when o like 'pos_label_ratio=%' then cast(split_part(o, '=', 2) as double) end) as pos_label_ratio from {PARSED} group by trial_id""",
    ["trial_log"],
    ["depth", "learning_rate", "pos_label_ratio"],
)
def _(t):
    return trials.trial_params_wide(t.trial_log, ["depth", "learning_rate", "pos_label_ratio"])


@query("strip_param_prefix", f"select trial_id, regexp_replace(split_part(o, '=', 1), '^.*\\.', '') as param from {PARSED}", ["trial_log"])
def _(t):
    names = trials.run_overrides(t.trial_log).select("trial_id", F.explode("overrides").alias("o"))
    return trials.strip_param_prefix(names.select("trial_id", F.split_part("o", F.lit("="), F.lit(1)).alias("param")))


DEFAULTS = [("depth", 7.0), ("learning_rate", 0.075), ("n_estimators", 1000.0)]
DEFAULT_SQL = ", ".join(f"('{p}', {v}e0)" for p, v in DEFAULTS)


@query(
    "overlay_params",
    f"""select {STUDY}, param, coalesce(case param when 'depth' then depth when 'learning_rate' then learning_rate end, value0) as value
from best cross join (values {DEFAULT_SQL}) as d(param, value0)""",
    ["best"],
    ["value"],
)
def _(t):
    best = trials.best_trial(t.trials)
    tuned = best.select(
        "station", "horizon", "model",
        F.inline(F.array(*[F.struct(F.lit(p).alias("param"), F.col(p).cast("double").alias("value")) for p in ("depth", "learning_rate")])),
    )
    base = best.select(
        "station", "horizon", "model",
        F.inline(F.array(*[F.struct(F.lit(p).alias("param"), F.lit(v).alias("value")) for p, v in DEFAULTS])),
    )
    return trials.overlay_params(base, tuned)


@query(
    "study_name",
    "select trial_id, station || '_' || horizon || '_' || model as study, station, horizon, model from trials",
    ["trials"],
)
def _(t):
    named = trials.study_name(t.trials).select("trial_id", "study")
    return trials.split_study_name(named)


@query("round_half_even", "select trial_id, round_even(value, 2) as value from trials", ["trials"], ["value"])
def _(t):
    return prep.round_half_even(t.trials.select("trial_id", "value"), ["value"], 2)


def space_sql(n: int, seed: int) -> str:
    rows = ", ".join(
        f"('{m}', '{p}', {float(a)}e0, {float(s)}e0, {k})" for m, ps in trials.SPACES.items() for p, a, s, k in ps
    )
    extra = ", ".join(f"('{m}', 'pos_label_ratio', 0e0, 1e0, {len(trials.RATIOS)})" for m in trials.SPACES)
    ratios = "[" + ", ".join(f"{r}e0" for r in trials.RATIOS) + "]"
    kinds = "['" + "', '".join(trials.BOOSTING) + "']"
    return f"""select {STUDY}, draw, param, case when param = 'pos_label_ratio' then {ratios}[level + 1] when param = 'boosting' then null
    else round(first + step * level, 6) end as value, case when param = 'boosting' then {kinds}[level + 1] end as choice from (
  select *, cast('0x' || substr(md5({STUDY.replace(', ', " || '|' || ")} || '|' || draw || '|' || param || '|{seed}'), 1, 8) as bigint) % levels as level
  from (select {STUDY}, unnest(generate_series(1, {n})) as draw from (select distinct {STUDY} from trials))
  join (values {rows}, {extra}, ('lgb', 'boosting', 0e0, 1e0, 3)) as s(model, param, first, step, levels) using (model))"""


@query("search_space", space_sql(20, 1), ["trials"], ["value"])
def _(t):
    return trials.search_space(t.trials, 20, 1).withColumn("draw", F.col("draw").cast("long"))
