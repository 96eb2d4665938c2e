"""Column expressions: everything here stays inside code generation."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

DAY_SECONDS = 86400
YEAR_SECONDS = 365.2425 * DAY_SECONDS


def wind_u(ws: Column, wd: Column) -> Column:
    return ws * F.sin(F.radians(wd))


def wind_v(ws: Column, wd: Column) -> Column:
    return ws * F.cos(F.radians(wd))


def clip(value: Column, low: float, high: float) -> Column:
    """Clip, keeping null (least/greatest alone would skip it)."""
    return F.when(value.isNotNull(), F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), value)))


def dew_point(temp: Column, rh: Column) -> Column:
    kelvin = temp + 273.15
    return temp - ((100 - rh) / 5) * F.sqrt(kelvin / 300) - 0.00135 * F.pow(rh - 84, F.lit(2)) + 0.35


def seconds(ts: Column) -> Column:
    return F.unix_seconds(ts)


def cycle(ts: Column, period: float, fn) -> Column:
    return fn(seconds(ts) * F.lit(2 * math.pi / period))


def slot(ts: Column, step: int) -> Column:
    """Number of the time slot of `step` seconds a timestamp lies in."""
    s = seconds(ts)
    return ((s - F.pmod(s, F.lit(step))) / step).cast("long")


def slot_time(number: Column, step: int) -> Column:
    return F.timestamp_seconds(number * step)


def floor_div(value: Column, size: int) -> Column:
    """Exact floor division of a long column."""
    return ((value - F.pmod(value, F.lit(size))) / size).cast("long")


def fog_flag(count: Column, min_count: int) -> Column:
    return F.when(count >= min_count, 1).otherwise(0)


def visibility_class(vis: Column, fog: float, clear: float) -> Column:
    """2 fog, 1 low visibility, 0 clear, null unknown."""
    return F.when(vis.isNull(), None).when(vis <= fog, 2).when(vis < clear, 1).otherwise(0)


def safe_ratio(num: Column, den: Column) -> Column:
    return F.when(den > 0, num / den).otherwise(0.0)


def half_even(value: Column, digits: int) -> Column:
    """Scale, round half to even, scale back: the rounding of NumPy on doubles."""
    return F.rint(value * float(10**digits)) / float(10**digits)


def last_part(name: Column, sep: str = r"\.") -> Column:
    return F.element_at(F.split(name, sep), -1)


def study_key(station: Column, horizon: Column, model: Column) -> Column:
    return F.concat_ws("_", station, horizon.cast("string"), model)
