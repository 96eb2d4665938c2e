"""Column names, dtypes and small lookup tables of the data model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, types as T

# Headers of the raw observation files and their short names.
RAW_HEADERS = {
    "시간": "datetime",
    "항": "station",
    "풍향(수치)": "wd",
    "풍속(m/s)": "ws",
    "기온(℃)": "temp",
    "수온(℃)": "sst",
    "기압(hPa)": "qff",
    "습도(%)": "rh",
    "강수량(mm)": "precipitation",
    "시정(3km)": "vis3",
    "시정(20km)": "vis20",
    "source": "source",
}

# Port name, its name in the historic files, station code, city alias.
PORTS = [
    ("부산항", "부산항", "SF_0001", "Busan"),
    ("부산항(부산신항)", "부산항신항", "SF_0002", "NBusan"),
    ("인천항", "인천항", "SF_0003", "Incheon"),
    ("평택당진항", "평택당진항", "SF_0004", "PTDJ"),
    ("군산항", "군산항", "SF_0005", "Gunsan"),
    ("대산항", "대산항", "SF_0006", "Daesan"),
    ("목포항", "목포항", "SF_0007", "Mokpo"),
    ("여수항", "여수광양항", "SF_0008", "Yeosu"),
    ("해운대", "해운대", "SF_0009", "Haeundae"),
    ("울산항", "울산항", "SF_0010", "Ulsan"),
    ("포항항", "포항항", "SF_0011", "Pohang"),
]

# First day kept per station; the rest start at DEFAULT_START.
DEFAULT_START = "2018-01-01"
EARLY_STARTS = {"SF_0001": "2017-01-01", "SF_0003": "2017-01-01", "SF_0004": "2017-01-01"}

STATIONS = [f"SF_{i:04d}" for i in range(1, 12)]
HORIZONS = [1, 3, 6]
MODELS = ["cb", "lgb", "rf", "xgb"]

COVARIATES = ["u", "v", "temp", "sst", "qff", "rh"]
AVERAGED = COVARIATES + ["vis"]
BASE = ["u", "v", "temp", "sst", "qff", "rh", "vis", "ASTD", "Td", "temp-Td", "sst-Td", "fog_count"]
TIME_COLUMNS = ["time_day_sin", "time_day_cos", "time_year_sin", "time_year_cos"]
MAX_LAG = 12

# Yearly test periods, start exclusive and end inclusive at midnight.
YEAR_PERIODS = [
    ("2021-07-01", "2022-06-30"),
    ("2020-07-01", "2021-06-30"),
    ("2019-07-01", "2020-06-30"),
]
TEST_START = "2021-07-01"

KEYS = ["station"]
TS = "datetime"

RAW_SCHEMA = T.StructType(
    [
        T.StructField("시간", T.TimestampType()),
        T.StructField("항", T.StringType()),
        *[
            T.StructField(h, T.DoubleType())
            for h, n in RAW_HEADERS.items()
            if n not in ("datetime", "station", "source")
        ],
        T.StructField("source", T.StringType()),
    ]
)

OBS_SCHEMA = T.StructType(
    [T.StructField(RAW_HEADERS[f.name], f.dataType) for f in RAW_SCHEMA.fields]
)


def lag_name(column: str, lag: int) -> str:
    return f"{column}_lag{lag:02d}"


def lag_columns(columns: list[str] = BASE, max_lag: int = MAX_LAG) -> list[str]:
    return [lag_name(c, k) for k in range(max_lag + 1) for c in columns]


def port_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PORTS, "port string, old_port string, station string, city string")


def start_dim(spark: SparkSession, starts: dict[str, str] | None = None) -> DataFrame:
    """First day kept per station."""
    starts = EARLY_STARTS if starts is None else starts
    rows = [(s, starts.get(s, DEFAULT_START)) for s in STATIONS]
    return spark.createDataFrame(rows, "station string, start string").selectExpr(
        "station", "cast(start as timestamp) as start"
    )
