import datetime as dt
import zipfile

import pytest
from pyspark.sql import functions as F

from seafret.operators import prep, trials
from seafret.schema import port_dim
from seafret.sources import observations, runlog, tables

LINES = [
    "시간,항,풍속(m/s),풍향(수치),기온(℃),수온(℃),기압(hPa),습도(%),강수량(mm),시정(3km),시정(20km),source",
    "2018-01-01 00:00:00,부산항,3.5,90,1.5,10,1013.2,80,0,3000,20000,a",
    "2018-01-01 00:01:00,부산항신항,,270,,10.5,bad,81,0,3000,700,a",
]
TEXT = "\n".join(LINES) + "\n"


def check(rows):
    first, second = sorted(rows, key=lambda r: r["datetime"])
    assert first["station"] == "부산항" and first["ws"] == 3.5 and first["wd"] == 90 and first["vis20"] == 20000
    assert first["datetime"] == dt.datetime(2018, 1, 1)
    assert second["ws"] is None and second["temp"] is None and second["qff"] is None and second["vis20"] == 700


@pytest.mark.parametrize("encoding", ["EUC-KR", "UTF-8"])
def test_csv_by_name_and_charset(spark, tmp_path, encoding):
    (tmp_path / "x.csv").write_bytes(TEXT.encode(encoding))
    check(observations.read_obs(spark, str(tmp_path), encoding).collect())


def test_files_with_columns_in_other_orders(spark, tmp_path):
    (tmp_path / "a.csv").write_text("시간,항,풍속(m/s),기온(℃)\n2018-01-01 00:00:00,부산항,1,20\n")
    (tmp_path / "b.csv").write_text("기온(℃),항,시간,풍속(m/s),source\n20,부산항,2018-01-01 00:01:00,1,x\n")
    rows = observations.read_obs(spark, str(tmp_path)).orderBy("datetime").collect()
    assert [(r["ws"], r["temp"], r["source"]) for r in rows] == [(1.0, 20.0, None), (1.0, 20.0, "x")]


def test_unreadable_cells_are_counted(spark, tmp_path):
    (tmp_path / "x.csv").write_text(TEXT)
    row = observations.bad_cells(spark, str(tmp_path)).first()
    assert row["qff"] == 1 and sum(row.asDict().values()) == 1


def test_zip(spark, tmp_path):
    for name in ("a", "b"):
        with zipfile.ZipFile(tmp_path / f"{name}.csv.zip", "w") as z:
            z.writestr(f"{name}.csv", TEXT)
    df = observations.read_obs_zip(spark, str(tmp_path))
    assert df.count() == 4
    check(df.distinct().collect())


def test_members_of_one_archive_are_tasks_of_their_own(spark, tmp_path):
    folder = tmp_path / "old data"
    folder.mkdir()
    with zipfile.ZipFile(folder / "all.csv.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("부산항.csv", TEXT.encode("EUC-KR"))
        z.mkdir("deeper")
        z.writestr("deeper/b.csv", TEXT.encode("EUC-KR"))
        z.writestr("empty.csv", b"")
    with zipfile.ZipFile(folder / "nothing.csv.zip", "w"):
        pass
    files = spark.read.format("binaryFile").load(str(folder))
    assert {r["member"] for r in observations.zip_members(files).collect()} == {"부산항.csv", "deeper/b.csv"}
    df = observations.read_obs_zip(spark, str(folder), "EUC-KR")
    parts = df.groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert [r["count"] for r in parts] == [2, 2]
    check(df.distinct().collect())
    whole = observations.read_obs_zip(spark, str(folder), "EUC-KR", by_member=False)
    assert sorted(map(str, df.collect())) == sorted(map(str, whole.collect()))


def test_port_names(spark, tmp_path):
    (tmp_path / "x.csv").write_bytes(TEXT.encode("EUC-KR"))
    df = prep.set_station(observations.read_obs(spark, str(tmp_path), "EUC-KR"), port_dim(spark))
    assert {r["station"] for r in df.collect()} == {"부산항", "부산항(부산신항)"}


def test_raw_round_trip(spark, tmp_path):
    df = observations.read_obs(spark, _csv(tmp_path), "EUC-KR")
    observations.write_raw_merged(df, str(tmp_path / "out"))
    check(observations.read_obs(spark, str(tmp_path / "out"), "EUC-KR").collect())


def _csv(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.csv").write_bytes(TEXT.encode("EUC-KR"))
    return str(tmp_path / "in")


def test_runlog_layout(spark, tmp_path):
    for i, (version, stage) in enumerate([("2.1", "train"), ("2.1", "test"), ("2.0", "train"), ("2.1", "train")]):
        run = tmp_path / f"{i}"
        (run / ".hydra").mkdir(parents=True)
        (run / ".hydra" / "config.yaml").write_text(
            f"api_version: {version}\nstage: {stage}\nstation_code: SF_0009\npred_hour: 3\nmodel_params:\n  depth: 7\nmodel_name: rf\n"
        )
        if i != 3:
            (run / "metrics.yaml").write_text("- 0.9\n- 0.8\n- 0.7\n- 0.6\n")
    rows = runlog.scan_runlog(spark, str(tmp_path), "2.1", "train").collect()
    assert [(r["run"], r["model_name"], r["pred_hour"], r["ACC"], r["F1"]) for r in rows] == [("0", "rf", 3, 0.9, 0.6)]
    assert runlog.scan_runlog(spark, str(tmp_path)).count() == 3


NESTED = """# result of a search
name: optuna
best_params:
  model_cfg.model_params.depth: 9   # tuned
  'pos_label_ratio': 0.005
  deep:
      note: "a: b # c"
      empty:
best_evaluated_value: 1
tags:
- x
- 'y z'
best_params_other: 3
best_value: 0.57
"""


def test_nested_settings(spark):
    df = spark.createDataFrame([(NESTED,), ("",), (None,), ("a: 1\na: 2\n",)], "value string")
    got = [r["m"] for r in df.select(runlog.flat_settings(F.col("value")).alias("m")).collect()]
    assert got[0] == {
        "name": "optuna", "best_params.model_cfg.model_params.depth": "9", "best_params.pos_label_ratio": "0.005",
        "best_params.deep.note": "a: b # c", "best_evaluated_value": "1", "tags.0": "x", "tags.1": "y z", "best_params_other": "3", "best_value": "0.57",
    }
    assert got[1] == {} and got[2] is None and got[3] == {"a": "2"}


def test_search_results_feed_the_overlay(spark, tmp_path):
    (tmp_path / "r1").mkdir()
    (tmp_path / "r1" / "optimization_results.yaml").write_text(NESTED)
    results = runlog.scan_results(spark, str(tmp_path))
    row = results.first()
    assert row["run"] == "r1" and row["best_value"] == 0.57 and row["best_params"]["pos_label_ratio"] == "0.005"
    base = spark.createDataFrame([("r1", "depth", "7"), ("r1", "l2_leaf_reg", "3")], "run string, param string, value string")
    got = trials.overlay_params(base, runlog.best_params(results), ["run"]).orderBy("param").collect()
    assert [(r["param"], r["value"]) for r in got] == [("depth", "9"), ("l2_leaf_reg", "3")]


def test_partition_pruning(spark, tmp_path):
    df = spark.range(200).select(
        F.concat(F.lit("SF_000"), F.col("id") % 3 + 1).alias("station"),
        F.timestamp_seconds(1514764800 + F.col("id") * 600).alias("datetime"),
        F.col("id").cast("double").alias("temp_lag00"),
    )
    path = str(tmp_path / "f")
    tables.write_features(df, path)
    one = tables.scan_features(spark, path, "SF_0002")
    assert one.count() == df.where("station = 'SF_0002'").count()
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(station" in plan
