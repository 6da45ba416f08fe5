"""Daily weather features.

A season has at most 366 days, so once ``dedupe_weather`` has left one row per
place and day, no (pest_year, place) window can hold more than 366 rows however
the raw rows were distributed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seasontide.config import SEASON_MEASURES, Settings
from seasontide.functions import scalars as S
from seasontide.functions.ordering import keep_first

MEASURES = ("air_temp_max_c", "air_temp_min_c", "precip_total_mm", "humidity_mean_pct")


def unify_coords(df: DataFrame) -> DataFrame:
    """One latitude/longitude pair (matched point before centroid) and numeric measures."""
    out = df
    for name, choices in (
        ("latitude", ("matched_lat", "centroid_lat", "latitude")),
        ("longitude", ("matched_lon", "centroid_lon", "longitude")),
    ):
        present = [F.col(c).cast("double") for c in choices if c in df.columns]
        if present:
            out = out.withColumn(name, F.coalesce(*present))
    out = out.drop("matched_lat", "matched_lon", "centroid_lat", "centroid_lon")
    typed = {c: S.number(F.col(c)) for c in MEASURES if c in out.columns}
    return out.withColumns({"date": F.col("date").cast("date"), **typed})


def add_temperatures(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "air_temp_max_f": S.c_to_f(F.col("air_temp_max_c")),
            "air_temp_min_f": S.c_to_f(F.col("air_temp_min_c")),
        }
    )


def add_degree_days(df: DataFrame, base: float = 50.0) -> DataFrame:
    low, high = F.col("air_temp_min_f"), F.col("air_temp_max_f")
    return df.withColumns({"gdd_air": S.gdd(low, high, base), "cdd_air": S.cdd(low, high, base)})


def add_calendar(df: DataFrame, season_start: tuple[int, int] = (3, 1)) -> DataFrame:
    return df.withColumns(
        {
            "doy": F.dayofyear("date"),
            "pest_year": S.pest_year(F.col("date"), *season_start),
        }
    )


def _season(key: str = "place_id"):
    return Window.partitionBy("pest_year", key).orderBy("date")


def season_cumulative(
    df: DataFrame, cols: Sequence[str] = SEASON_MEASURES, key: str = "place_id"
) -> DataFrame:
    """Running season totals; a NULL day stays NULL and does not break the total."""
    w = _season(key).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns(
        {f"cumu_{c}": F.when(F.col(c).isNotNull(), F.sum(c).over(w)) for c in cols}
    )


def season_rolling(
    df: DataFrame, rows: int, cols: Sequence[str] = SEASON_MEASURES, key: str = "place_id"
) -> DataFrame:
    """Mean of the last ``rows`` rows (rows, not days) of the season."""
    w = _season(key).rowsBetween(-(rows - 1), 0)
    return df.withColumns({f"rolling_{c}": F.avg(c).over(w) for c in cols})


def dedupe_weather(
    df: DataFrame, key: str = "location_id", order: Sequence[Column | str] | None = None
) -> DataFrame:
    """First row per (date, location)."""
    ties = [c for c in ("place_id", "latitude", "longitude") if c in df.columns and c != key]
    return keep_first(df, ["date", key], order or ties or ["date"])


def compression(before: DataFrame, key: str = "location_id") -> DataFrame:
    """Row counts ahead of and after the daily dedupe, and their ratio, in one pass."""
    per_day = before.groupBy("date", key).agg(F.count(F.lit(1)).alias("n"))
    return per_day.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows_before"), F.count("n").alias("rows_after")
    ).withColumn("compression", F.col("rows_before") / F.greatest("rows_after", F.lit(1)))


def attach_locations(df: DataFrame, mapping: DataFrame) -> DataFrame:
    """Map places to labelled locations; rows of other places are dropped."""
    pairs = mapping.select("location_id", "place_id").dropna().distinct()
    return df.drop("location_id").join(pairs, "place_id")


def season_slice(weather: DataFrame, start: str, end: str, cfg: Settings = Settings()) -> DataFrame:
    """Raw days needed for features of [start, end]: from the first season's start on.

    Season totals cannot be pruned by date once they are windows, so the raw scan
    is pruned instead.
    """
    month, day = cfg.season_start
    first = F.lit(start).cast("date")
    season_start = F.make_date(S.pest_year(first, month, day), F.lit(month), F.lit(day))
    return weather.where(F.col("date").between(season_start, F.lit(end).cast("date")))


def engineer_features(
    weather: DataFrame,
    cfg: Settings = Settings(),
    mode: str = "predict",
    mapping: DataFrame | None = None,
    dates: tuple[str, str] | None = None,
) -> DataFrame:
    """Daily feature table; one shuffle by (pest_year, place) serves every window.

    ``train`` keeps only rows of mapped locations, ``predict`` keeps every place.
    ``dates`` limits the scan to the seasons of that range.
    """
    if dates is not None:
        weather = season_slice(weather, *dates, cfg)
    df = add_calendar(
        add_degree_days(add_temperatures(unify_coords(weather)), cfg.degree_base_f),
        cfg.season_start,
    )
    df = season_rolling(season_cumulative(df), cfg.rolling_rows)
    if mode == "train" and mapping is not None and "location_id" not in weather.columns:
        df = attach_locations(df, mapping)
    return df
