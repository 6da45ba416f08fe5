"""Declared schemas; readers cast to these instead of inferring."""

from __future__ import annotations

from pyspark.sql import types as T

RAW_EVENTS = T.StructType(
    [
        T.StructField("location_id", T.StringType()),
        T.StructField("location_name", T.StringType()),
        T.StructField("location_state", T.StringType()),
        T.StructField("latitude", T.DoubleType()),
        T.StructField("longitude", T.DoubleType()),
        T.StructField("stage_id", T.IntegerType()),
        T.StructField("stage_name", T.StringType()),
        T.StructField("stage_date", T.TimestampNTZType()),
    ]
)

EVENT_EXPORT_COLUMNS = ("location_id", "latitude", "longitude", "stage_id", "stage_date")
IDENTITY_COLUMNS = ("date", "location_id", "place_id", "latitude", "longitude")
REQUEST_COLUMNS = ("loc", "latitude", "longitude", "start_date", "end_date")
COVERAGE_COLUMNS = (
    "centroid_lat",
    "centroid_lon",
    "place_id",
    "location_id",
    "latitude",
    "longitude",
)
INDEX_COLUMNS = ("place_id", "start_compact", "end_compact")

# Source column -> short measure name, and the columns kept.
WEATHER_ALIASES = {
    "lat": "centroid_lat",
    "lon": "centroid_lon",
    "temperature_c_2_m_above_gnd_max": "air_temp_max_c",
    "temperature_c_2_m_above_gnd_min": "air_temp_min_c",
    "temperature_c_2_m_above_gnd_avg": "air_temp_avg_c",
    "temperature_c_0to10cm_below_gnd_avg": "soil_temp_c",
    "precipitation_total_grid_mm_surface_sum": "precip_total_mm",
    "relative_humidity_pct_2_m_above_gnd_avg": "humidity_mean_pct",
    "soil_water_content_m3_per_m3_0to10cm_below_gnd_avg": "soil_moisture_mean_m3m3",
    "daylight_duration_min_surface_sum": "sun_duration_min",
}
WEATHER_KEPT = (
    "location_id",
    "place_id",
    "location_year_key",
    "date",
    "centroid_lat",
    "centroid_lon",
    "matched_lat",
    "matched_lon",
    "air_temp_max_c",
    "air_temp_min_c",
    "air_temp_avg_c",
    "soil_temp_c",
    "precip_total_mm",
    "humidity_mean_pct",
    "soil_moisture_mean_m3m3",
    "sun_duration_min",
)


def require_columns(df, columns) -> None:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
