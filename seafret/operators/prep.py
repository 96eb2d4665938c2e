"""Row-local preparation: names, filters, derived columns, small lookups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from seafret.functions import columns as C
from seafret.schema import BASE, KEYS, STATIONS, TS

DIM_LIMIT = 200_000


def small(dim: DataFrame, limit: int = DIM_LIMIT) -> DataFrame:
    """Broadcast hint for a lookup, given only when its row count is below the limit."""
    return F.broadcast(dim) if dim.limit(limit + 1).count() <= limit else dim


def rename_columns(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(mapping)


def station_start_filter(df: DataFrame, dim: DataFrame, ts: str = TS) -> DataFrame:
    return df.join(small(dim), "station").where(F.col(ts) >= F.col("start")).drop("start")


def station_filter(df: DataFrame, station: str) -> DataFrame:
    return df.where(F.col("station") == station)


def set_station(df: DataFrame, names: DataFrame) -> DataFrame:
    """Replace historic port names (old_port) by the current ones (port)."""
    pairs = names.select(F.col("old_port").alias("station"), F.col("port").alias("_new"))
    return df.join(small(pairs), "station", "left").withColumn(
        "station", F.coalesce("_new", "station")
    ).drop("_new")


def join_station_dim(df: DataFrame, dim: DataFrame, on: str = "station") -> DataFrame:
    return df.join(small(dim), on)


def join_std_left(df: DataFrame, std: DataFrame, on: list[str] = [*KEYS, TS]) -> DataFrame:
    """Rolling deviations of the raw rows beside the grid rows; time is in the key, so no key is hot."""
    return df.join(std, on, "left")


def join_time_features(df: DataFrame, times: DataFrame, on: list[str] = [*KEYS, TS]) -> DataFrame:
    return df.join(times, on, "left")


def grid_filter(df: DataFrame, ts: str = TS, every: int = 600) -> DataFrame:
    """Keep rows on the model grid; `every` in seconds."""
    return df.where(C.seconds(F.col(ts)) % every == 0)


def wind_components(df: DataFrame, ws: str = "ws", wd: str = "wd") -> DataFrame:
    return df.withColumns({"u": C.wind_u(F.col(ws), F.col(wd)), "v": C.wind_v(F.col(ws), F.col(wd))})


def clip_visibility(df: DataFrame, lo: float = 20, hi: float = 3000, source: str = "vis20") -> DataFrame:
    return df.withColumn("vis", C.clip(F.col(source), lo, hi))


def fill_visibility(df: DataFrame, value: float = 3000) -> DataFrame:
    return df.withColumn("vis", F.coalesce("vis", F.lit(float(value))))


def thermo_features(df: DataFrame) -> DataFrame:
    temp, sst = F.col("temp"), F.col("sst")
    td = C.dew_point(temp, F.col("rh"))
    return df.withColumns(
        {"T": temp + 273.15, "ASTD": temp - sst, "Td": td, "temp-Td": temp - td, "sst-Td": sst - td}
    )


def time_encoding(df: DataFrame, ts: str = TS) -> DataFrame:
    t = F.col(ts)
    return df.withColumns(
        {
            "time_day_sin": C.cycle(t, C.DAY_SECONDS, F.sin),
            "time_day_cos": C.cycle(t, C.DAY_SECONDS, F.cos),
            "time_year_sin": C.cycle(t, C.YEAR_SECONDS, F.sin),
            "time_year_cos": C.cycle(t, C.YEAR_SECONDS, F.cos),
        }
    )


def one_hot_station(df: DataFrame, categories: list[str] = STATIONS) -> DataFrame:
    return df.withColumns({c: (F.col("station") == c).cast("int") for c in categories})


def base_select(df: DataFrame, cols: list[str] = BASE, keep: list[str] = [*KEYS, TS]) -> DataFrame:
    return df.select(*keep, *[F.col(f"`{c}`") for c in cols])


def flatten_names(df: DataFrame, pairs: dict[str, tuple[str, str]], sep: str = "_") -> DataFrame:
    """Two-level names (first, second) of the listed columns become first_second."""
    return df.withColumnsRenamed({name: sep.join(pair) for name, pair in pairs.items()})


def drop_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.drop(*cols)


def drop_time_columns(df: DataFrame, n: int = 4) -> DataFrame:
    return df.select([F.col(f"`{c}`") for c in df.columns[:-n]])


def drop_incomplete(df: DataFrame, subset: list[str]) -> DataFrame:
    """One null count over all columns; a filter per column would slow planning down a lot."""
    return df.dropna(how="any", subset=subset)


def cast_label(df: DataFrame, col: str) -> DataFrame:
    return df.withColumn(col, F.col(col).cast("int"))


def holdout_split(df: DataFrame, start: str, stage: str, ts: str = TS) -> DataFrame:
    """`test`: rows from `start` on; `refit`: the rows before."""
    cut = F.lit(start).cast("timestamp")
    if stage == "test":
        return df.where(F.col(ts) >= cut)
    if stage == "refit":
        return df.where(F.col(ts) < cut)
    raise ValueError(f"unknown stage {stage!r}")


def label_notnull_mask(df: DataFrame, col: str) -> DataFrame:
    return df.where(F.col(col).isNotNull())


def run_filter(df: DataFrame, **equals) -> DataFrame:
    return df.where(reduce(lambda a, b: a & b, [F.col(k) == v for k, v in equals.items()]))


def fog_label(df: DataFrame, min_count: int = 50) -> DataFrame:
    return df.withColumn("label", C.fog_flag(F.col("fog_count"), min_count))


def visibility_class3(df: DataFrame, fog: float = 1000, clear: float = 3000, vis: str = "vis") -> DataFrame:
    return df.withColumn("label3", C.visibility_class(F.col(vis), fog, clear))


def round_half_even(df: DataFrame, cols: list[str], digits: int) -> DataFrame:
    return df.withColumns({c: C.half_even(F.col(c), digits) for c in cols})


def union_old_new(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.unionByName(new, allowMissingColumns=True)


def union_stations(dfs: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def sort_by_time(df: DataFrame, keys: list[str] = KEYS, ts: str = TS) -> DataFrame:
    """Total order by time inside each series (range partitioned, so no single task)."""
    return df.orderBy(*keys, ts)

