"""Queries on sources and sinks: what is written is read back whole."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyarrow.fs import FileSystem
from pyspark.sql import functions as F

from seafret.functions.columns import slot
from seafret.operators import scores, trials
from seafret.schema import RAW_HEADERS, STATIONS, lag_columns
from seafret.session import materialize, new_path
from seafret.sources import observations, runlog, tables
from workload.registry import query
from workload.scoring import ENSEMBLE_SQL, PIVOT_SQL
from workload.series import OBS

HEADERS = {n: h for h, n in RAW_HEADERS.items()}


@query("scan_obs_csv", "select * from obs", ["obs"], OBS)
def _(t):
    path = new_path(t.spark, "csv")
    observations.write_raw_merged(t.obs, path, observations.KOREAN)
    return observations.read_obs(t.spark, path, observations.KOREAN)


@query("write_raw_merged", "select station, count(*) as n, max(datetime) as last, sum(sst) as sst from obs group by station", ["obs"], ["sst"])
def _(t):
    path = new_path(t.spark, "raw")
    observations.write_raw_merged(t.obs, path)
    back = observations.read_obs(t.spark, path, observations.KOREAN)
    return back.groupBy("station").agg(F.count("*").alias("n"), F.max("datetime").alias("last"), F.sum("sst").alias("sst"))


def zip_csv(key, pdf: pd.DataFrame) -> pd.DataFrame:
    """One port and month as a zipped CSV with the raw headers."""
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
        text = pdf.drop(columns="_month").rename(columns=HEADERS).to_csv(index=False)
        archive.writestr(f"{key[0]}.csv", text.encode("utf-8"))
    return pd.DataFrame({"path": [f"{key[0]}-{key[1]}.csv.zip"], "content": [buffer.getvalue()]})


@query("scan_obs_zip", "select * from obs", ["obs"], OBS)
def _(t):
    """Archives are made from all rows, one per port and month, then read like files."""
    months = t.obs.withColumn("_month", slot(F.col("datetime"), 30 * 86400))
    files = months.groupBy("station", "_month").applyInPandas(zip_csv, "path string, content binary")
    return observations.parse_zipped(files).select("station", "datetime", *OBS)


@query("scan_obs_zip_members", "select * from obs", ["obs"], OBS)
def _(t):
    """Archives of one month, with a member for every port, are written to the shared folder and read member by member."""
    path = new_path(t.spark, "archives")

    def write(key, pdf: pd.DataFrame) -> pd.DataFrame:
        system, folder = FileSystem.from_uri(path)
        system.create_dir(folder)
        # the same rows give the same file, so a task that runs again only writes it again
        with system.open_output_stream(f"{folder}/{key[0]}.csv.zip") as file, zipfile.ZipFile(file, "w", zipfile.ZIP_DEFLATED) as archive:
            for port, rows in pdf.drop(columns="_month").groupby("station"):
                archive.writestr(f"{port}.csv", rows.rename(columns=HEADERS).to_csv(index=False).encode("utf-8"))
        return pd.DataFrame({"rows": [len(pdf)]})

    months = t.obs.withColumn("_month", slot(F.col("datetime"), 30 * 86400))
    materialize(months.groupBy("_month").applyInPandas(write, "rows long"), "archived")
    return observations.read_obs_zip(t.spark, path).select("station", "datetime", *OBS)


@query("write_features", "select station, count(*) as n, sum(temp_lag00) as temp, count(temp_lag12) as n12, cast(sum(y_1) as bigint) as y_1 from features group by station", ["features"], ["temp"])
def _(t):
    path = new_path(t.spark, "features")
    tables.write_features(t.features, path)
    return tables.scan_features(t.spark, path).groupBy("station").agg(
        F.count("*").alias("n"),
        F.sum("temp_lag00").alias("temp"),
        F.count("temp_lag12").alias("n12"),
        F.sum("y_1").alias("y_1"),
    )


@query(
    "scan_features",
    "select station, datetime, " + ", ".join(f'"{c}"' for c in lag_columns(max_lag=1)) + ", y_1 from features where station = 'SF_0004'",
    ["features"],
    [c for c in lag_columns(max_lag=1) if not c.startswith("fog_count")],
)
def _(t):
    path = new_path(t.spark, "features")
    tables.write_features(t.features, path)
    return tables.scan_features(t.spark, path, "SF_0004").select(
        "station", "datetime", *[F.col(f"`{c}`") for c in lag_columns(max_lag=1)], "y_1"
    )


@query("write_predictions", "select model, horizon, fold, count(*) as n, cast(sum(obs) as bigint) as obs, cast(sum(pred) as bigint) as pred from preds group by all", ["preds"])
def _(t):
    path = new_path(t.spark, "preds")
    tables.write_predictions(t.preds, path)
    return tables.scan_predictions(t.spark, path).groupBy("model", "horizon", "fold").agg(
        F.count("*").alias("n"), F.sum("obs").alias("obs"), F.sum("pred").alias("pred")
    )


@query("scan_predictions", "select * from preds where model = 'rf' and horizon = 3", ["preds"])
def _(t):
    path = new_path(t.spark, "preds")
    tables.write_predictions(t.preds, path, "parquet")
    return tables.scan_predictions(t.spark, path, "parquet", model="rf", horizon=3)


@query("write_metrics", "select station, count(*) as n, max(value) as best from trials group by station", ["trials"], ["best"])
def _(t):
    path = new_path(t.spark, "metrics")
    tables.write_metrics(t.trials, path)
    return tables.scan_trials(t.spark, path).groupBy("station").agg(F.count("*").alias("n"), F.max("value").alias("best"))


@query(
    "write_summary",
    f"""select score, {PIVOT_SQL} from (
  select station, 'acc_' || horizon as score, "ACC" as x from ({ENSEMBLE_SQL}) union all
  select station, 'f1_' || horizon, "F1" from ({ENSEMBLE_SQL})) group by score""",
    ["preds"],
    STATIONS,
)
def _(t):
    path = new_path(t.spark, "summary")
    tables.write_summary(scores.summary_pivot(scores.ensemble_scores(t.preds), STATIONS), path)
    types = ", ".join(f"{s} double" for s in STATIONS)
    return t.spark.read.option("header", True).schema(f"score string, {types}").csv(path)


@query(
    "scan_runlog",
    """select station || '_' || horizon || '_' || model as run, '2.1' as api_version, 'train' as stage, station as station_code,
  horizon as pred_hour, model as model_name, value as "ACC", value / 2 as "PAG", value / 4 as "POD", value / 8 as "F1" from best""",
    ["best"],
    ["ACC", "PAG", "POD", "F1"],
)
def _(t):
    """Best trials are written as run folders and read back; other stages are filtered out."""
    path = new_path(t.spark, "runs")
    best = trials.study_name(trials.best_trial(t.trials))
    config = F.format_string(
        "api_version: 2.1\nstage: train\nstation_code: %s\npred_hour: %d\nmodel_name: %s\n", "station", "horizon", "model"
    )
    metrics = F.concat_ws("\n", *[F.concat(F.lit("- "), (F.col("value") / d).cast("string")) for d in (1, 2, 4, 8)])
    both = F.array(
        F.struct(F.lit("config").alias("kind"), config.alias("value")),
        F.struct(F.lit("metrics").alias("kind"), metrics.alias("value")),
    )
    texts = best.select(F.col("study").alias("run"), F.inline(both))
    other = texts.where("kind = 'config'").select(
        F.concat("run", F.lit("_test")).alias("run"), "kind", F.replace("value", F.lit("stage: train"), F.lit("stage: test")).alias("value")
    )
    texts.unionByName(other).write.partitionBy("run", "kind").text(path)
    return runlog.scan_runlog(
        t.spark, path, "2.1", "train", "run=*/kind=config/part-*", "run=*/kind=metrics/part-*", r"run=([^/]+)/"
    )


@query(
    "scan_results",
    """select station || '_' || horizon || '_' || model as run, value as best_value, param, coalesce(case param when 'depth' then depth
  when 'learning_rate' then learning_rate end, base) as value
from best cross join (values ('depth', 7e0), ('learning_rate', 0.075e0), ('l2_leaf_reg', 3e0)) as d(param, base)""",
    ["best"],
    ["best_value", "value"],
)
def _(t):
    """Best trials are written as nested result files, read back and laid over default parameters."""
    path = new_path(t.spark, "results")
    best = trials.study_name(trials.best_trial(t.trials))
    text = F.format_string(
        "name: search\nbest_params:\n  model_cfg.model_params.depth: %s\n  'model_params.learning_rate': %s # tuned\n  unknown: 1\nbest_value: %s\n",
        F.col("depth").cast("string"), F.col("learning_rate").cast("string"), F.col("value").cast("string"),
    )
    best.select(F.col("study").alias("run"), text.alias("value")).write.partitionBy("run").text(path)
    results = runlog.scan_results(t.spark, path, "run=*/part-*", r"run=([^/]+)/")
    defaults = F.array(*[F.struct(F.lit(p).alias("param"), F.lit(v).alias("value")) for p, v in (("depth", "7"), ("learning_rate", "0.075"), ("l2_leaf_reg", "3"))])
    base = results.select("run", "best_value", F.inline(defaults))
    laid = trials.overlay_params(base, runlog.best_params(results), ["run"])
    return laid.select("run", "best_value", "param", F.col("value").cast("double").alias("value"))
