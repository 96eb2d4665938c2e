"""Feature, prediction, trial and report tables: writers and scans.

Tables are partitioned by low-cardinality keys, so that scans of one station or study
prune directories. Writers shuffle by those keys plus a time chunk or a salt, which keeps
the number of files per directory small without sending a hot key to one task.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from seafret.functions.columns import slot
from seafret.schema import TS

FILE_SECONDS = 366 * 86400
STUDY = ["station", "horizon", "model"]


def _write(df: DataFrame, keys: list[str], spread: list, fmt: str, path: str, mode: str, **options) -> None:
    # a fixed number of tasks: the files are many even where the rows are few
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(tasks, *[F.col(k) for k in keys], *spread).write.mode(mode).partitionBy(*keys).format(fmt).options(
        **options
    ).save(path)


def write_features(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One directory per station, one file per station and year."""
    _write(df, ["station"], [slot(F.col(TS), FILE_SECONDS)], "parquet", path, mode)


def scan_features(spark: SparkSession, path: str, station: str | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df if station is None else df.where(F.col("station") == station)


def write_metrics(df: DataFrame, path: str, salts: int = 4, mode: str = "append") -> None:
    """Append trial or test metrics; a salt spreads stations with many trials."""
    plain = [f.name for f in df.schema.fields if f.dataType.typeName() != "map"]
    _write(df, ["station"], [F.pmod(F.xxhash64(*plain), F.lit(salts))], "parquet", path, mode)


def scan_trials(
    spark: SparkSession,
    path: str,
    station: str | None = None,
    horizon: int | None = None,
    model: str | None = None,
) -> DataFrame:
    df = spark.read.parquet(path)
    for name, value in (("station", station), ("horizon", horizon), ("model", model)):
        if value is not None:
            df = df.where(F.col(name) == value)
    return df


def write_predictions(df: DataFrame, path: str, fmt: str = "csv", mode: str = "overwrite") -> None:
    """obs and pred below station/horizon/model/fold."""
    options = {"header": "true"} if fmt == "csv" else {}
    _write(df, [*STUDY, "fold"], [slot(F.col(TS), FILE_SECONDS)], fmt, path, mode, **options)


def scan_predictions(spark: SparkSession, path: str, fmt: str = "csv", **where) -> DataFrame:
    """Predictions of chosen partitions; unread partitions are pruned."""
    schema = "datetime timestamp, obs int, pred int, station string, horizon int, model string, fold int"
    df = spark.read.format(fmt).options(header="true").schema(schema).load(path)
    for name, value in where.items():
        df = df.where(F.col(name) == value)
    return df


def write_summary(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Report of a few aggregated rows as one CSV file."""
    df.coalesce(1).write.mode(mode).option("header", True).csv(path)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
