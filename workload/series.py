"""Queries on preparation, windows, joins and checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from seafret.operators import grid, labels, prep, windows
from seafret.plans import features as plan
from seafret.schema import AVERAGED, BASE, COVARIATES, EARLY_STARTS, PORTS, RAW_HEADERS, STATIONS, TIME_COLUMNS, lag_columns, lag_name, port_dim, start_dim
from workload.registry import query
from workload.standins import FOG, FOG_FRAME, GRID, HOT, LATE_START, MEAN_FRAME, MEANS, RAW_STEP, SETTINGS, STARTS, STDS, TEST_START_SQL, TIMES, interpolation_sql

OBS = ["wd", "ws", "temp", "sst", "qff", "rh", "vis20"]
LABEL_SIZE = SETTINGS.chunk_rows


# ---- projections, filters ----------------------------------------------------------

HEADERS = {n: h for h, n in RAW_HEADERS.items() if n in [*OBS, "station", "datetime"]}


@query("rename_columns", "select * from obs", ["obs"], OBS)
def _(t):
    raw = t.obs.withColumnsRenamed(HEADERS)
    return prep.rename_columns(raw, RAW_HEADERS)


EARLY = ", ".join(f"'{s}'" for s in STARTS)
START_SQL = f"case when station in ({EARLY}) then timestamp '{min(STARTS.values())}' else timestamp '{LATE_START}' end"


def late_starts(t):
    return start_dim(t.spark, {s: STARTS.get(s, LATE_START) for s in STATIONS})


@query("station_start_filter", f"select * from obs where datetime >= {START_SQL}", ["obs"], OBS)
def _(t):
    return prep.station_start_filter(t.obs, late_starts(t))


@query("station_filter", "select * from obs where station = 'SF_0003'", ["obs"], OBS)
def _(t):
    return prep.station_filter(t.obs, "SF_0003")


PORT_ROWS = ", ".join(f"('{code}','{port}','{old}','{city}')" for port, old, code, city in PORTS)
PORT_VALUES = f"(values {PORT_ROWS}) as p(station, port, old_port, city)"


@query("set_station", f"select p.port as station, datetime, vis20 from obs join {PORT_VALUES} using (station)", ["obs"], ["vis20"])
def _(t):
    ports = port_dim(t.spark)
    named = prep.join_station_dim(t.obs, ports.select("station", "old_port")).select(
        F.col("old_port").alias("station"), "datetime", "vis20"
    )
    return prep.set_station(named, ports)


@query("join_station_dim", f"select station, port, city, datetime, temp from obs join {PORT_VALUES} using (station)", ["obs"], ["temp"])
def _(t):
    dim = port_dim(t.spark).select("station", "port", "city")
    return prep.join_station_dim(t.obs, dim).select("station", "port", "city", "datetime", "temp")


@query("grid_filter", f"select station, datetime, temp from obs where epoch(datetime)::bigint % {GRID} = 0", ["obs"], ["temp"])
def _(t):
    return prep.grid_filter(t.obs, every=GRID).select("station", "datetime", "temp")


@query("wind_components", "select station, datetime, u, v from prepared", ["prepared"], ["u", "v"])
def _(t):
    return prep.wind_components(t.obs).select("station", "datetime", "u", "v")


@query("clip_visibility", "select station, datetime, vis from prepared", ["prepared"], ["vis"])
def _(t):
    return prep.clip_visibility(t.obs).select("station", "datetime", "vis")


@query("fill_visibility", "select station, datetime, coalesce(vis, 3000) as vis from prepared", ["prepared"], ["vis"])
def _(t):
    return prep.fill_visibility(prep.clip_visibility(t.obs)).select("station", "datetime", "vis")


THERMO = ["T", "ASTD", "Td", "temp-Td", "sst-Td"]
TD_SQL = "temp - (20 - rh / 5) * sqrt((temp + 273.15e0) / 300) - 0.00135e0 * (rh - 84) * (rh - 84) + 0.35e0"


@query(
    "thermo_features",
    f"""select station, datetime, temp + 273.15e0 as "T", temp - sst as "ASTD", td as "Td", temp - td as "temp-Td", sst - td as "sst-Td"
from (select *, {TD_SQL} as td from obs)""",
    ["obs"],
    THERMO,
)
def _(t):
    return prep.thermo_features(t.obs).select("station", "datetime", *THERMO)


@query("fog_label", f"select station, datetime, fog_count, case when fog_count >= {SETTINGS.fog_rows} then 1 else 0 end as label from regular", ["regular"])
def _(t):
    full = grid.regular_grid(t.thin.select("station", "datetime", "fog_count"), GRID)
    return prep.fog_label(full, SETTINGS.fog_rows)


@query(
    "visibility_class3",
    "select station, datetime, vis, case when vis is null then null when vis <= 1000 then 2 when vis < 3000 then 1 else 0 end as label3 from prepared",
    ["prepared"],
    ["vis"],
)
def _(t):
    return prep.visibility_class3(t.prepared).select("station", "datetime", "vis", "label3")


@query("time_encoding", f"select station, datetime, {TIMES} from obs", ["obs"], TIME_COLUMNS)
def _(t):
    return prep.time_encoding(t.obs).select("station", "datetime", *TIME_COLUMNS)


@query("one_hot_station", f"select station, datetime, {HOT} from obs", ["obs"])
def _(t):
    return prep.one_hot_station(t.obs.select("station", "datetime"))


@query("base_select", "select station, datetime, " + ", ".join(f'"{c}"' for c in BASE) + " from grid", ["grid"], BASE[:-1])
def _(t):
    return prep.base_select(t.grid)


@query(
    "flatten_names",
    'select station, datetime, temp as temp_lag00, lag(temp, 1) over w as temp_lag01 from obs window w as (partition by station order by datetime)',
    ["obs"],
    ["temp_lag00", "temp_lag01"],
)
def _(t):
    lagged = windows.lag_features(t.obs.select("station", "datetime", "temp"), ["temp"], 1)
    two_level = lagged.withColumnsRenamed({"temp_lag00": "('temp', 'lag00')", "temp_lag01": "('temp', 'lag01')"})
    return prep.flatten_names(two_level, {f"('temp', 'lag0{k}')": ("temp", f"lag0{k}") for k in (0, 1)})


@query("drop_columns", "select station, datetime, temp, sst, qff, rh, vis20 from obs", ["obs"], OBS[2:])
def _(t):
    return prep.drop_columns(t.obs, ["wd", "ws"])


@query("drop_time_columns", "select station, datetime, temp from obs", ["obs"], ["temp"])
def _(t):
    return prep.drop_time_columns(prep.time_encoding(t.obs.select("station", "datetime", "temp")))


COMPLETE = " and ".join(f'"{c}" is not null' for c in [*lag_columns(), "y_1"])


@query("drop_incomplete", f"select station, datetime, temp_lag00, temp_lag12, y_1 from features where {COMPLETE}", ["features"], ["temp_lag00", "temp_lag12"])
def _(t):
    full = prep.drop_incomplete(t.features, [*lag_columns(), "y_1"])
    return full.select("station", "datetime", "temp_lag00", "temp_lag12", "y_1")


@query("cast_label", "select station, datetime, cast(y_1 as integer) as y_1 from (select station, datetime, lead(label, 6) over (partition by station order by datetime) as y_1 from grid)", ["grid"])
def _(t):
    y = windows.lead_targets(t.labels, hours=[1], step=GRID, size=LABEL_SIZE)
    return prep.cast_label(y.withColumn("y_1", F.col("y_1").cast("double")), "y_1").select("station", "datetime", "y_1")


@query(
    "holdout_split",
    f"select station, datetime, label, case when datetime >= {TEST_START_SQL} then 'test' else 'refit' end as stage from grid",
    ["grid", "cal"],
)
def _(t):
    parts = [
        prep.holdout_split(t.labels, t.test_start, s).select("station", "datetime", "label", F.lit(s).alias("stage"))
        for s in ("test", "refit")
    ]
    return prep.union_stations(parts)


@query(
    "label_notnull_mask",
    "select * from (select station, datetime, lead(label, 6) over (partition by station order by datetime) as obs from grid) where obs is not null",
    ["grid"],
)
def _(t):
    y = windows.lead_targets(t.labels, hours=[1], step=GRID, size=LABEL_SIZE)
    return prep.label_notnull_mask(y.select("station", "datetime", F.col("y_1").alias("obs")), "obs")


# ---- windows -------------------------------------------------------------------------


@query("rolling_mean_10m", f"select station, datetime, {MEANS} from prepared window m as ({MEAN_FRAME})", ["prepared"], AVERAGED)
def _(t):
    out = windows.rolling_mean_10m(t.prepared, seconds=SETTINGS.mean_seconds, chunk_seconds=SETTINGS.chunk_seconds)
    return out.select("station", "datetime", *AVERAGED)


STD_COLUMNS = ["std_ws", "std_ASTD", "std_rh"]


@query("rolling_std_10m", f"select station, datetime, {STDS} from prepared window m as ({MEAN_FRAME})", ["prepared"], STD_COLUMNS)
def _(t):
    out = windows.rolling_std_10m(t.prepared, seconds=SETTINGS.mean_seconds, chunk_seconds=SETTINGS.chunk_seconds)
    return out.select("station", "datetime", *STD_COLUMNS)


@query("fog_count_60m", f"select station, datetime, {FOG} from prepared window f as ({FOG_FRAME})", ["prepared"])
def _(t):
    out = windows.fog_count_60m(t.prepared, seconds=SETTINGS.fog_seconds, chunk_seconds=SETTINGS.chunk_seconds)
    return out.select("station", "datetime", "fog_count")


@query("join_windows", "select station, datetime, " + ", ".join(AVERAGED) + ", fog_count from wins", ["wins"], AVERAGED)
def _(t):
    return t.windows


LAG_SQL = ", ".join(f'lag("{c}", {k}) over w as "{lag_name(c, k)}"' for k in range(13) for c in OBS)


@query(
    "lag_features",
    f"select station, datetime, {LAG_SQL} from obs window w as (partition by station order by datetime)",
    ["obs"],
    [lag_name(c, k) for k in range(13) for c in OBS],
)
def _(t):
    return windows.lag_features(t.obs, OBS)


@query(
    "lead_targets",
    "select station, datetime, label, lead(label, 6) over w as y_1, lead(label, 18) over w as y_3, lead(label, 36) over w as y_6 from grid window w as (partition by station order by datetime)",
    ["grid"],
)
def _(t):
    return windows.lead_targets(t.labels.drop("label3"), step=GRID, size=LABEL_SIZE)


@query(
    "lead_class3",
    "select station, datetime, label3, lead(label3, 6) over w as y3_1, lead(label3, 18) over w as y3_3, lead(label3, 36) over w as y3_6 from grid window w as (partition by station order by datetime)",
    ["grid"],
)
def _(t):
    return windows.lead_class3(t.labels.drop("label"), step=GRID, size=LABEL_SIZE)


@query(
    "interpolate_limit",
    f"select station, datetime, {', '.join(COVARIATES)} from ({interpolation_sql(COVARIATES, 'regular')})",
    ["regular"],
    COVARIATES,
)
def _(t):
    full = grid.regular_grid(t.thin.select("station", "datetime", *COVARIATES), GRID)
    return windows.interpolate_limit(full, COVARIATES, 6, step=GRID, size=LABEL_SIZE)


SMOOTH_W = "window w as (partition by station order by datetime)"


@query(
    "smooth_start_points",
    """select station, datetime, label, case when label = 1 and s >= 2 and n = 6 then 1 else 0 end as is_start from (
  select station, datetime, label, sum(label) over w as s, count(label) over w as n from grid
  window w as (partition by station order by datetime rows between current row and 5 following))""",
    ["grid"],
)
def _(t):
    return labels.smooth_start_points(t.labels.drop("label3"), step=GRID, size=LABEL_SIZE)


@query(
    "smooth_end_points",
    """select station, datetime, label, case when label = 1 and s >= 2 and n = 6 then 1 else 0 end as is_end from (
  select station, datetime, label, sum(label) over w as s, count(label) over w as n from grid
  window w as (partition by station order by datetime rows between 5 preceding and current row))""",
    ["grid"],
)
def _(t):
    return labels.smooth_end_points(t.labels.drop("label3"), step=GRID, size=LABEL_SIZE)


FILLED_SQL = """select station, datetime, label, case when label = 1 or nxt - prv <= 5 then 1 else label end as filled from (
  select station, datetime, label, i,
    max(case when label = 1 then i end) over (partition by station order by i rows between unbounded preceding and current row) as prv,
    min(case when label = 1 then i end) over (partition by station order by i rows between current row and unbounded following) as nxt
  from (select station, datetime, label, row_number() over (partition by station order by datetime) as i from grid))"""


@query("smooth_fill_gaps", FILLED_SQL, ["grid"])
def _(t):
    return labels.smooth_fill_gaps(t.labels.drop("label3"), step=GRID, size=LABEL_SIZE)


@query(
    "smooth_drop_isolated",
    f"""select station, datetime, label, case when filled = 1 and s = 1 and c = 11 then 0 else filled end as smoothed from (
  select *, sum(filled) over w as s, count(*) over w as c from ({FILLED_SQL})
  window w as (partition by station order by datetime rows between 5 preceding and 5 following))""",
    ["grid"],
)
def _(t):
    return labels.smooth_labels(t.labels.drop("label3"), step=GRID, size=LABEL_SIZE)


@query(
    "lag_reduction",
    "select * from (select station, datetime, sst as y, "
    + ", ".join(f"lag(sst, {k}) over w as x{k}" for k in range(1, 6))
    + " from obs window w as (partition by station order by datetime)) where x5 is not null",
    ["obs"],
    ["y"] + [f"x{k}" for k in range(1, 6)],
)
def _(t):
    return windows.lag_reduction(t.obs, "sst", 5)


# ---- joins, checks -------------------------------------------------------------------


@query("join_std_left", f"select station, datetime, label, {', '.join(q for q in ['std_ws', 'std_rh'])}, \"std_ASTD\" from grid", ["grid"], STD_COLUMNS)
def _(t):
    std = windows.rolling_std_10m(t.prepared, seconds=SETTINGS.mean_seconds, chunk_seconds=SETTINGS.chunk_seconds)
    return prep.join_std_left(t.labels.drop("label3"), std.select("station", "datetime", *STD_COLUMNS))


@query(
    "join_time_features",
    f'select station, datetime, lag("temp", 1) over w as temp_lag01, temp as temp_lag00, {TIMES} from grid window w as (partition by station order by datetime)',
    ["grid"],
    ["temp_lag00", "temp_lag01", *TIME_COLUMNS],
)
def _(t):
    lagged = windows.lag_features(t.grid.select("station", "datetime", "temp"), ["temp"], 1, step=GRID, size=LABEL_SIZE)
    times = prep.time_encoding(t.grid.select("station", "datetime"))
    return prep.join_time_features(lagged, times)


@query(
    "grid_gaps",
    f"""select station, datetime from (select station, unnest(generate_series(lo, hi, interval {RAW_STEP} seconds)) as datetime
  from (select station, min(datetime) as lo, max(datetime) as hi from obs group by station)) anti join obs using (station, datetime)""",
    ["obs"],
)
def _(t):
    return grid.grid_gaps(t.obs, RAW_STEP)


@query(
    "coverage_counts",
    f"""select station, count(*) filter (where datetime < timestamp '2018-01-05') as rows_before,
  cast(epoch(timestamp '2018-01-05') - epoch({START_SQL}) as bigint) // {RAW_STEP} as expected_before,
  count(*) filter (where datetime >= timestamp '2018-01-05') as rows_after,
  cast(epoch(timestamp '2018-01-10') - epoch(timestamp '2018-01-05') as bigint) // {RAW_STEP} as expected_after
from obs group by station""",
    ["obs"],
)
def _(t):
    return grid.coverage_counts(t.obs, "2018-01-05", late_starts(t), "2018-01-10", RAW_STEP)


@query(
    "step_uniformity",
    """select station, count(*) as n_steps, arg_max(step, n * 1000000000 - step) as mode_step, max(n) as mode_count from (
  select station, step, count(*) as n from (
    select station, cast(epoch(datetime) - epoch(lag(datetime) over (partition by station order by datetime)) as bigint) as step from obs)
  where step is not null group by all) group by station""",
    ["obs"],
)
def _(t):
    return grid.step_uniformity(t.obs)


@query("distinct_station", "select distinct station from obs", ["obs"])
def _(t):
    return grid.distinct_station(t.obs)


NULL_COLS = lag_columns() + ["y_1", "y_3", "y_6"]


@query(
    "null_audit",
    "select "
    + ", ".join(f'count(*) - count("{c}") as "{c}"' for c in NULL_COLS)
    + ", "
    + " + ".join(f'count(*) - count("{c}")' for c in NULL_COLS)
    + " as total from features",
    ["features"],
)
def _(t):
    return grid.null_audit(t.features, NULL_COLS)


# ---- unions, order -------------------------------------------------------------------


@query(
    "union_old_new",
    "select * exclude (qff), case when datetime < timestamp '2018-01-05' then null else qff end as qff from obs",
    ["obs"],
    OBS,
)
def _(t):
    cut = F.lit("2018-01-05").cast("timestamp")
    return prep.union_old_new(t.obs.where(F.col("datetime") < cut).drop("qff"), t.obs.where(F.col("datetime") >= cut))


@query("union_stations", "select * from obs", ["obs"], OBS)
def _(t):
    return prep.union_stations([prep.station_filter(t.obs, s) for s in STATIONS])


@query("sort_by_time", "select station, datetime, sst from obs order by station, datetime", ["obs"], ["sst"])
def _(t):
    return prep.sort_by_time(t.obs.select("station", "datetime", "sst"))


# ---- whole tables --------------------------------------------------------------------


@query("model_grid", "select * exclude (std_ws, \"std_ASTD\", std_rh) from grid", ["grid"], BASE[:-1])
def _(t):
    return t.grid


@query("features", "select * from features", ["features"], [c for c in lag_columns() if not c.startswith("fog_count")] + TIME_COLUMNS + STD_COLUMNS)
def _(t):
    return t.features
