"""Column expressions shared by the operators.  All of them stay in the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0088
DAY_MICROS = 86_400_000_000


def normalize_label(label: Column) -> Column:
    """Trimmed, single-spaced, lower-case label; NULL becomes the empty string."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(label, F.lit("")), r"\s+", " ")))


def slug(text: Column) -> Column:
    lowered = F.lower(F.coalesce(text, F.lit("")))
    return F.btrim(F.regexp_replace(lowered, "[^a-z0-9]+", "_"), F.lit("_"))


def month_day(date: Column) -> Column:
    return F.date_format(date, "MM-dd")


def null_if_nan(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def number(value: Column) -> Column:
    """Numeric coercion: anything unparsable, and NaN, becomes NULL."""
    return null_if_nan(value.try_cast("double"))


def floor_at_zero(value: Column) -> Column:
    """``greatest(value, 0)`` that keeps NULL (plain ``greatest`` would give 0)."""
    return F.when(value.isNotNull(), F.greatest(value, F.lit(0.0)))


def c_to_f(celsius: Column) -> Column:
    return celsius * 9 / 5 + 32


def gdd(t_min_f: Column, t_max_f: Column, base: float = 50.0) -> Column:
    return floor_at_zero((t_max_f + t_min_f) / 2 - base)


def cdd(t_min_f: Column, t_max_f: Column, base: float = 50.0) -> Column:
    return floor_at_zero(base - (t_min_f + t_max_f) / 2)


def pest_year(date: Column, month: int = 3, day: int = 1) -> Column:
    """Season year: days before the season start belong to the previous year."""
    before = (F.month(date) < month) | ((F.month(date) == month) & (F.dayofmonth(date) < day))
    return F.year(date) - before.cast("int")


def days_between(end: Column, start: Column) -> Column:
    """Fractional days from ``start`` to ``end``."""
    micros = F.timestamp_diff("MICROSECOND", start.cast("timestamp_ntz"), end.cast("timestamp_ntz"))
    return micros / float(DAY_MICROS)


def floor_days(end: Column, start: Column) -> Column:
    """Whole days from ``start`` to ``end``, rounded down (-0.5 gives -1)."""
    return F.floor(days_between(end, start)).cast("int")


def plus_days(date: Column, days: Column) -> Column:
    """Timestamp ``days`` (fractional) after ``date``."""
    micros = F.round(days * float(DAY_MICROS)).cast("bigint")
    return F.timestamp_add("MICROSECOND", micros, date.cast("timestamp_ntz")).cast("timestamp_ntz")


def plus_whole_days(date: Column, days: Column) -> Column:
    """Calendar day reached ``days`` (fractional) after a calendar day."""
    return F.date_add(date, F.floor(days).cast("int"))


def midpoint(first: Column, second: Column) -> Column:
    return first + (second - first) / 2


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    half_lat = (p2 - p1) / 2
    half_lon = (F.radians(lon2) - F.radians(lon1)) / 2
    a = F.pow(F.sin(half_lat), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(half_lon), 2)
    return 2 * EARTH_RADIUS_KM * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def unit_vector(lat: Column, lon: Column) -> list[Column]:
    """Point on the unit sphere; straight-line order equals great-circle order."""
    p, q = F.radians(lat), F.radians(lon)
    return [F.cos(p) * F.cos(q), F.cos(p) * F.sin(q), F.sin(p)]


def rms(value: Column) -> Column:
    return F.sqrt(F.avg(value * value))


def rate(condition: Column) -> Column:
    """Share of rows where the condition holds; NULL counts as not holding."""
    return F.avg(F.coalesce(condition, F.lit(False)).cast("int"))


def ratio(numerator: Column, denominator: Column) -> Column:
    return numerator / F.nullif(denominator, F.lit(0))


def isclose_zero(value: Column, tolerance: float = 1e-8) -> Column:
    return F.abs(value) <= tolerance


def years_before(day: str, years: int) -> Column:
    """Constant date ``years`` before ``day``; folded before the scan."""
    return F.add_months(F.lit(day).cast("date"), -12 * years)


def log2_ceil(value: Column) -> Column:
    return F.ceil(F.log(value) / math.log(2.0)).cast("int")
