"""Stand-ins for station data, derived from the given tables.

`events` rows become readings of 11 stations every 10 minutes with some gaps; error events
play missing sensor values. All lengths of the 1-minute data are taken ten times as long:
means over 100 minutes, fog over 600 minutes, one grid row per 100 minutes. `orders` rows
become tuning trials.
"""

from __future__ import annotations

from datetime import datetime, timedelta
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from seafret.operators import folds as fold_ops, prep, windows
from seafret.plans import features as plan
from seafret.schema import AVERAGED, BASE, COVARIATES, MODELS, lag_name
from workload.registry import cte

T0 = 1514764800  # 2018-01-01
EPOCH = datetime(2018, 1, 1)
RAW_STEP = 600
SETTINGS = plan.Settings(
    mean_seconds=6000,
    fog_seconds=36000,
    grid_seconds=6000,
    fog_rows=15,
    fog3=1500,
    clear3=2000,
    chunk_seconds=4 * 86400,
    chunk_rows=500,
)
GRID = SETTINGS.grid_seconds
STARTS = {"SF_0001": "2018-01-01", "SF_0003": "2018-01-01", "SF_0004": "2018-01-01"}
LATE_START = "2018-01-02"
PRED_SHIFT = dict(zip(MODELS, range(4)))


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.dir = sf_dir
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def obs(self) -> DataFrame:
        s = F.expr("event_id div 11")
        at = T0 + RAW_STEP * (s + 40 * F.expr("event_id div 11 div 300") + 60 * F.expr("event_id div 11 div 600"))
        ok = F.col("event_type") != "error"
        return self.read("events").select(
            F.concat(F.lit("SF_"), F.lpad((F.col("event_id") % 11 + 1).cast("string"), 4, "0")).alias("station"),
            F.timestamp_seconds(at).alias("datetime"),
            (F.regexp_extract("props", "([0-9]+)", 1).cast("double") * 3.6).alias("wd"),
            (F.col("value") / 10).alias("ws"),
            F.when(ok, 5 + (F.col("event_id") % 250).cast("double") / 10).alias("temp"),
            (5 + F.col("user_id") % 15 + (F.col("event_id") % 30).cast("double") / 10).alias("sst"),
            (1000 + (F.col("event_id") % 400).cast("double") / 10).alias("qff"),
            F.when(ok, (50 + F.col("event_id") % 51).cast("double")).alias("rh"),
            F.when(ok, F.col("value") * 60).alias("vis20"),
        )

    @cached_property
    def third(self) -> int:
        """A third of the days all readings span: the test periods cover the whole table."""
        last = self.read("events").agg(F.max("event_id").alias("m")).first()["m"] // 11
        days = RAW_STEP * (last + 40 * (last // 300) + 60 * (last // 600)) // 86400 + 1
        self._days = days
        return max(1, days // 3)

    @cached_property
    def periods(self) -> list[tuple[str, str]]:
        """Latest third first, as (start, end) days; the latest takes the rest of the days."""
        cuts = [0, self.third, 2 * self.third, max(self._days, 3 * self.third)]
        day = [str((EPOCH + timedelta(days=c)).date()) for c in cuts]
        return [(day[2], day[3]), (day[1], day[2]), (day[0], day[1])]

    @property
    def test_start(self) -> str:
        return self.periods[0][0]

    @cached_property
    def prepared(self) -> DataFrame:
        return prep.clip_visibility(prep.wind_components(self.obs))

    @cached_property
    def windows(self) -> DataFrame:
        return plan.minute_windows(self.obs, SETTINGS, with_std=False)

    @cached_property
    def thin(self) -> DataFrame:
        return prep.grid_filter(self.windows, every=GRID)

    @cached_property
    def grid(self) -> DataFrame:
        return plan.model_grid(self.obs, SETTINGS, with_std=False)

    @cached_property
    def labels(self) -> DataFrame:
        return self.grid.select("station", "datetime", "label", "label3")

    @cached_property
    def features(self) -> DataFrame:
        return plan.features(self.obs, SETTINGS)

    @cached_property
    def folds(self) -> DataFrame:
        return fold_ops.year_folds(fold_ops.day_group(self.labels), self.periods)

    def predictions(self, label: str = "label") -> DataFrame:
        """obs: the label h grid rows ahead; pred: the label 0..3 rows ago, one shift per model."""
        ahead = windows.by_rows(
            self.labels.select("station", "datetime", F.col(label).alias("label")),
            lambda w: {f"obs_{h}": F.lead("label", h).over(w) for h in (1, 3, 6)}
            | {f"pred_{m}": F.lag("label", k).over(w) for m, k in PRED_SHIFT.items()},
            before=3,
            after=6,
            step=GRID,
            size=SETTINGS.chunk_rows,
        )
        obs = F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"obs_{h}").alias("obs")) for h in (1, 3, 6)])
        pred = F.array(*[F.struct(F.lit(m).alias("model"), F.col(f"pred_{m}").alias("pred")) for m in MODELS])
        tall = (
            fold_ops.period_fold(ahead, self.periods)
            .withColumn("_o", F.explode(obs))
            .withColumn("_p", F.explode(pred))
            .select("station", "datetime", "_o.horizon", "_p.model", "fold", "_o.obs", "_p.pred")
        )
        return tall.where("obs is not null and pred is not null")

    @cached_property
    def preds(self) -> DataFrame:
        return self.predictions()

    @cached_property
    def preds3(self) -> DataFrame:
        return self.predictions("label3")

    @cached_property
    def trials(self) -> DataFrame:
        return self.read("orders").select(
            F.concat(F.lit("SF_"), F.lpad((F.col("o_custkey") % 11 + 1).cast("string"), 4, "0")).alias("station"),
            F.expr("case o_orderkey % 3 when 0 then 1 when 1 then 3 else 6 end").alias("horizon"),
            F.expr("case o_custkey % 4 when 0 then 'cb' when 1 then 'lgb' when 2 then 'rf' else 'xgb' end").alias("model"),
            F.col("o_orderkey").alias("trial_id"),
            ((F.col("o_orderkey") * 7919 % 10000).cast("double") / 10000).alias("value"),
            (F.col("o_orderkey") % 4 + 4).cast("int").alias("depth"),
            ((F.col("o_orderkey") % 10) / 100 + 0.005).alias("learning_rate"),
        )

    @cached_property
    def trial_log(self) -> DataFrame:
        """Trials with their raw overrides."""
        return self.trials.withColumn(
            "overrides",
            F.array(
                F.concat(F.lit("model_params.depth="), F.col("depth").cast("string")),
                F.concat(F.lit("model_params.learning_rate=0."), F.lpad((F.col("trial_id") % 10 * 10 + 5).cast("string"), 3, "0")),
                F.concat(F.lit("pos_label_ratio=0.00"), (F.col("trial_id") % 9 + 1).cast("string")),
                F.lit("stage=train"),
                F.concat(F.lit("pred_hour="), F.col("horizon").cast("string")),
            ),
        )


# The same stand-ins as SQL, written independently of the operators.

def q(name: str) -> str:
    return f'"{name}"'


cte(
    "obs",
    f"""select 'SF_' || lpad(cast(event_id % 11 + 1 as varchar), 4, '0') as station,
  make_timestamp(({T0} + {RAW_STEP} * (s + 40 * (s // 300) + 60 * (s // 600))) * 1000000) as datetime,
  cast(regexp_extract(props, '([0-9]+)', 1) as double) * 3.6 as wd, value / 10 as ws,
  case when event_type = 'error' then null else 5 + cast(event_id % 250 as double) / 10 end as temp,
  5 + user_id % 15 + cast(event_id % 30 as double) / 10 as sst,
  1000 + cast(event_id % 400 as double) / 10 as qff,
  case when event_type = 'error' then null else cast(50 + event_id % 51 as double) end as rh,
  case when event_type = 'error' then null else value * 60 end as vis20
from (select *, event_id // 11 as s from events)""",
)
cte(
    "prepared",
    """select *, ws * sin(radians(wd)) as u, ws * cos(radians(wd)) as v,
  case when vis20 is null then null when vis20 < 20 then 20e0 when vis20 > 3000 then 3000e0 else vis20 end as vis
from obs""",
    "obs",
)
MEAN_FRAME = f"partition by station order by datetime range between interval {SETTINGS.mean_seconds * 10**6 - 1} microseconds preceding and current row"
FOG_FRAME = f"partition by station order by datetime range between interval {SETTINGS.fog_seconds * 10**6 - 1} microseconds preceding and current row"
MEANS = ", ".join(f"avg({c}) over m as {c}" for c in AVERAGED)
FOG = "cast(sum(case when vis <= 1000 then 1 else 0 end) over f as bigint) as fog_count"
STDS = "stddev_samp(ws) over m as std_ws, stddev_samp(temp - sst) over m as \"std_ASTD\", stddev_samp(rh) over m as std_rh"
cte(
    "wins",
    f"select station, datetime, {MEANS}, {FOG}, {STDS} from prepared window m as ({MEAN_FRAME}), f as ({FOG_FRAME})",
    "prepared",
)
cte("thin", f"select * from wins where epoch(datetime)::bigint % {GRID} = 0", "wins")
cte(
    "spine",
    f"""select station, unnest(generate_series(lo, hi, interval {GRID} seconds)) as datetime
from (select station, min(datetime) lo, max(datetime) hi from thin group by 1)""",
    "thin",
)
cte(
    "regular",
    "select spine.station, spine.datetime, thin.* exclude (station, datetime) from spine left join thin using (station, datetime)",
    "spine",
    "thin",
)


def interpolation_sql(cols: list[str], source: str, limit: int = 6) -> str:
    """Linear fill by position, at most `limit` rows after a valid value."""
    up = "partition by station order by datetime rows between unbounded preceding and current row"
    down = "partition by station order by datetime rows between current row and unbounded following"
    parts = ", ".join(
        f"last_value(case when {c} is not null then i end ignore nulls) over up as p_{c}, "
        f"last_value({c} ignore nulls) over up as px_{c}, "
        f"first_value(case when {c} is not null then i end ignore nulls) over down as n_{c}, "
        f"first_value({c} ignore nulls) over down as nx_{c}"
        for c in cols
    )
    fill = ", ".join(
        f"coalesce({c}, case when p_{c} is null or i - p_{c} > {limit} then null when n_{c} is null then px_{c} "
        f"else px_{c} + (nx_{c} - px_{c}) * (i - p_{c}) / (n_{c} - p_{c}) end) as {c}"
        for c in cols
    )
    drop = ", ".join(["i"] + [f"{k}_{c}" for c in cols for k in ("p", "px", "n", "nx")] + cols)
    return f"""select * exclude ({drop}), {fill} from (
  select *, {parts} from (select *, row_number() over (partition by station order by datetime) as i from {source})
  window up as ({up}), down as ({down}))"""


cte("filled", interpolation_sql(COVARIATES, "regular"), "regular")
TD = "(temp - ((100 - rh) / 5) * sqrt((temp + 273.15e0) / 300) - 0.00135e0 * power(rh - 84, 2) + 0.35e0)"
cte(
    "grid",
    f"""select station, datetime, u, v, temp, sst, qff, rh, vis, temp - sst as "ASTD", {TD} as "Td",
  temp - {TD} as "temp-Td", sst - {TD} as "sst-Td", fog_count, std_ws, "std_ASTD", std_rh,
  case when fog_count >= {SETTINGS.fog_rows} then 1 else 0 end as label,
  case when vis <= {SETTINGS.fog3} then 2 when vis < {SETTINGS.clear3} then 1 else 0 end as label3
from (select * replace (coalesce(vis, 3000e0) as vis) from filled)""",
    "filled",
)
LAGS = ", ".join(f'lag("{c}", {k}) over w as "{lag_name(c, k)}"' for k in range(13) for c in BASE)
LEADS = ", ".join(
    f"lead({l}, {h * 6}) over w as {p}_{h}" for l, p in (("label", "y"), ("label3", "y3")) for h in (1, 3, 6)
)
TIMES = """sin(epoch(datetime)::bigint * (2 * pi() / 86400)) as time_day_sin, cos(epoch(datetime)::bigint * (2 * pi() / 86400)) as time_day_cos,
  sin(epoch(datetime)::bigint * (2 * pi() / 31556952)) as time_year_sin, cos(epoch(datetime)::bigint * (2 * pi() / 31556952)) as time_year_cos"""
HOT = ", ".join(f"case when station = 'SF_{i:04d}' then 1 else 0 end as SF_{i:04d}" for i in range(1, 12))
cte(
    "features",
    f"""select station, datetime, std_ws, "std_ASTD", std_rh, label, label3, {LAGS}, {LEADS}, {TIMES}, {HOT}
from grid window w as (partition by station order by datetime)""",
    "grid",
)
cte(
    "cal",
    f"""select greatest(1, ({RAW_STEP} * (s + 40 * (s // 300) + 60 * (s // 600)) // 86400 + 1) // 3) as third
from (select max(event_id) // 11 as s from events)""",
)
# 1 for the latest third of the days, 3 for the first; midnight belongs to the earlier part
FOLD_OF = f"cast(3 - least(2, floor((epoch(datetime) - {T0} - 1) / ((select third from cal) * 86400))) as integer)"
TEST_START_SQL = f"make_timestamp(({T0} + 2 * (select third from cal) * 86400) * 1000000)"
cte(
    "folds",
    f"""select *, {FOLD_OF} = fold as in_test from (
  select station, datetime, label, label3, year(datetime) * 366 + dayofyear(datetime) as day_group, unnest([1, 2, 3]) as fold from grid)""",
    "grid",
    "cal",
)
cte(
    "days",
    """select *, (row_number() over (partition by station, fold order by n_fog desc, day_group) - 1) % 5 = 0 as is_valid from (
  select station, fold, day_group, count(*) as n_rows, cast(sum(label) as bigint) as n_fog
  from folds where not in_test group by all)""",
    "folds",
)
cte(
    "roles",
    """select folds.*, case when in_test then 'test' when is_valid then 'valid' else 'train' end as role
from folds left join days using (station, fold, day_group)""",
    "folds",
    "days",
)
def preds_sql(label: str) -> str:
    branches = " union all ".join(
        f"select station, datetime, {h} as horizon, '{m}' as model, {FOLD_OF} as fold, "
        f"lead({label}, {h}) over w as obs, lag({label}, {k}) over w as pred from grid "
        "window w as (partition by station order by datetime)"
        for h in (1, 3, 6)
        for m, k in PRED_SHIFT.items()
    )
    return f"select * from ({branches}) where fold <= 3 and obs is not null and pred is not null"


cte("preds", preds_sql("label"), "grid", "cal")
cte("preds3", preds_sql("label3"), "grid", "cal")
cte(
    "trials",
    """select 'SF_' || lpad(cast(o_custkey % 11 + 1 as varchar), 4, '0') as station,
  case o_orderkey % 3 when 0 then 1 when 1 then 3 else 6 end as horizon,
  case o_custkey % 4 when 0 then 'cb' when 1 then 'lgb' when 2 then 'rf' else 'xgb' end as model,
  o_orderkey as trial_id, cast(o_orderkey * 7919 % 10000 as double) / 10000 as value,
  cast(o_orderkey % 4 + 4 as integer) as depth, cast(o_orderkey % 10 as double) / 100 + 0.005e0 as learning_rate
from orders""",
)
