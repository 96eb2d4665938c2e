"""Run folders: settings, a list of scores, and the result of a search (best value and parameters) per run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SETTINGS = ["api_version", "stage", "station_code", "pred_hour", "model_name"]
SCORES = ["ACC", "PAG", "POD", "F1"]


def _texts(spark: SparkSession, glob: str, run_pattern: str) -> DataFrame:
    return spark.read.text(glob, wholetext=True).select(
        F.regexp_extract(F.col("_metadata.file_path"), run_pattern, 1).alias("run"), "value"
    )


def _setting(name: str) -> Column:
    found = F.trim(F.regexp_extract("value", rf"(?m)^{name}:[ \t]*(.*)$", 1))
    return F.nullif(found, F.lit(""))


def scan_runlog(
    spark: SparkSession,
    path: str,
    api_version: str | None = None,
    stage: str | None = None,
    config_glob: str = "*/.hydra/config.yaml",
    metric_glob: str = "*/metrics.yaml",
    run_pattern: str = r"([^/]+)/(?:\.hydra/)?[^/]+$",
) -> DataFrame:
    """Settings and scores of the runs that finished, optionally of one version and stage."""
    configs = _texts(spark, f"{path}/{config_glob}", run_pattern).select(
        "run", *[_setting(s).alias(s) for s in SETTINGS]
    )
    numbers = F.regexp_extract_all("value", F.lit(r"(?m)^-[ \t]*(\S+)"), F.lit(1))
    metrics = _texts(spark, f"{path}/{metric_glob}", run_pattern).select(
        "run", *[F.try_element_at(numbers, F.lit(i + 1)).try_cast("double").alias(s) for i, s in enumerate(SCORES)]
    )
    if api_version is not None:
        configs = configs.where(F.col("api_version") == api_version)
    if stage is not None:
        configs = configs.where(F.col("stage") == stage)
    return configs.join(metrics, "run").withColumn("pred_hour", F.col("pred_hour").try_cast("int"))


# ---- nested settings -----------------------------------------------------------------

LINE = "struct<indent:int,key:string,value:string>"


def flat_settings(text: Column) -> Column:
    """A settings text as a map from dotted names to values.

    Reads nested `name: value` lines with any indentation, comments, quoted values and lists (`- value`, numbered from 0).
    A name without a value opens a level; one that never gets any content is left out.
    """
    lines = F.filter(F.split(text, r"\r?\n"), lambda t: ~F.trim(t).rlike(r"^(#.*|---.*|)$"))

    def read(t: Column) -> Column:
        item = F.regexp_like(t, F.lit(r"^\s*-(\s|$)"))
        body = F.trim(F.regexp_replace(F.when(item, F.regexp_replace(t, r"^\s*-", "")).otherwise(t), r"(^|\s)#[^'\"]*$", ""))
        key = F.when(item, F.lit("-")).otherwise(F.regexp_extract(body, r"^('[^']*'|\"[^\"]*\"|[^:]+?)\s*:(\s|$)", 1))
        value = F.when(item, body).otherwise(F.regexp_extract(body, r"^(?:'[^']*'|\"[^\"]*\"|[^:]+?)\s*:(?:\s+(.*))?$", 1))
        bare = lambda c: F.regexp_replace(c, r"^(['\"])(.*)\1$", "$2")
        # items of a list belong below the name above them even at the same indentation
        indent = F.length(F.regexp_extract(t, r"^(\s*)", 1)) * 2 + item.cast("int")
        return F.struct(indent.cast("int").alias("indent"), bare(key).alias("key"), bare(F.trim(value)).alias("value"))

    parsed = F.filter(F.transform(lines, read), lambda l: l["key"] != "")
    start = F.struct(
        F.array().cast(f"array<{LINE}>").alias("open"), F.array().cast("array<struct<name:string,value:string>>").alias("found")
    )

    def step(state: Column, line: Column) -> Column:
        above = F.filter(state["open"], lambda o: o["indent"] < line["indent"])
        parent = F.concat_ws(".", F.transform(above, lambda o: o["key"]))
        before = F.size(F.filter(state["found"], lambda f: F.regexp_replace(f["name"], r"\.\d+$", "") == parent))
        own = F.when(line["key"] == "-", before.cast("string")).otherwise(line["key"])
        name = F.concat_ws(".", F.nullif(parent, F.lit("")), own)
        leaf = line["value"] != ""
        return F.struct(
            F.when(leaf, above).otherwise(F.concat(above, F.array(line))).alias("open"),
            F.when(leaf, F.concat(state["found"], F.array(F.struct(name.alias("name"), line["value"].alias("value"))))).otherwise(state["found"]).alias("found"),
        )

    found = F.aggregate(parsed, start, step)["found"]
    # of a repeated name the last value counts
    kept = F.filter(found, lambda f, i: ~F.exists(F.slice(found, i + 2, F.size(found)), lambda g: g["name"] == f["name"]))
    return F.map_from_entries(kept)


def scan_results(
    spark: SparkSession, path: str, glob: str = "*/optimization_results.yaml", run_pattern: str = r"([^/]+)/[^/]+$"
) -> DataFrame:
    """run, best_value and best_params (dotted name to value) of every finished search."""
    flat = _texts(spark, f"{path}/{glob}", run_pattern).select("run", flat_settings(F.col("value")).alias("all"))
    own = F.map_filter("all", lambda k, v: k.startswith("best_params."))
    params = F.transform_keys(own, lambda k, v: F.substr(k, F.lit(len("best_params.") + 1)))
    return flat.select("run", F.try_element_at("all", F.lit("best_value")).try_cast("double").alias("best_value"), params.alias("best_params"))


def best_params(results: DataFrame) -> DataFrame:
    """One row per run and tuned parameter (run, param, value), named by the last part, as `overlay_params` takes them."""
    rows = results.select("run", F.explode("best_params").alias("name", "value"))
    return rows.select("run", F.element_at(F.split("name", r"\."), -1).alias("param"), "value")
