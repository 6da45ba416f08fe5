"""The driver tables seen through the engine's schemas (test plumbing, not weather).

Sums run over integers so that both engines get bit-equal values in any order.
Every adapter aggregates to its daily key first, which bounds later groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def lat_of(key: Column) -> Column:
    return F.lit(36.0) + (key * 7 % 90) / 10.0


def lon_of(key: Column) -> Column:
    return F.lit(-90.0) + (key * 13 % 200) / 10.0


def n_places(spark: SparkSession, sf: str) -> Column:
    return table(spark, sf, "supplier").agg(F.count(F.lit(1))).scalar()


def locations(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(
        key.cast("string").alias("location_id"),
        F.concat(F.lit("grid_"), key.cast("string")).alias("place_id"),
        lat_of(key).alias("latitude"),
        lon_of(key).alias("longitude"),
        F.col("s_nationkey").cast("string").alias("state"),
    )


def coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Grid cells a little off their locations; cells in debt have no location."""
    key = F.col("s_suppkey")
    named = F.col("s_acctbal") >= 0
    return table(spark, sf, "supplier").select(
        (lat_of(key) + 0.03).alias("centroid_lat"),
        (lon_of(key) - 0.04).alias("centroid_lon"),
        F.concat(F.lit("grid_"), key.cast("string")).alias("place_id"),
        F.when(named, key.cast("string")).alias("location_id"),
        F.when(named, lat_of(key)).alias("latitude"),
        F.when(named, lon_of(key)).alias("longitude"),
        F.col("s_nationkey").cast("string").alias("state_code"),
    )


def weather_daily(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("l_suppkey")
    cents = F.sum(F.round(F.col("l_discount") * 100).cast("bigint"))
    return (
        table(spark, sf, "lineitem")
        .groupBy("l_suppkey", F.to_date("l_shipdate").alias("date"))
        .agg(
            (F.max("l_quantity") * 0.8).alias("air_temp_max_c"),
            (F.min("l_quantity") * 0.4).alias("air_temp_min_c"),
            F.sum(F.round(F.col("l_tax") * 100).cast("bigint")).cast("double").alias(
                "precip_total_mm"
            ),
            (F.lit(50.0) + cents * 4.0 / F.count(F.lit(1))).alias("humidity_mean_pct"),
        )
        .select(
            F.concat(F.lit("grid_"), key.cast("string")).alias("place_id"),
            lat_of(key).alias("centroid_lat"),
            lon_of(key).alias("centroid_lon"),
            "date",
            "air_temp_max_c",
            "air_temp_min_c",
            "precip_total_mm",
            "humidity_mean_pct",
        )
    )


def weather_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Undeduplicated pulls: one row per line item."""
    key = F.col("l_suppkey")
    return table(spark, sf, "lineitem").select(
        key.cast("string").alias("loc"),
        key.cast("string").alias("location_id"),
        F.to_date("l_shipdate").alias("date"),
        F.col("l_quantity").cast("string").alias("temperature_c_2_m_above_gnd_max"),
        F.col("l_discount").alias("relative_humidity_pct_2_m_above_gnd_avg"),
        F.col("l_orderkey").alias("pull_id"),
        F.col("l_linenumber").alias("pull_line"),
    )


def raw_events(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("o_custkey") % n_places(spark, sf)
    digit = F.substring("o_orderpriority", 1, 1)
    name = (
        F.when(digit == "1", "Stage 1")
        .when(digit == "2", " stage  2 ")
        .when(digit == "3", "Stage 3")
        .when(digit == "4", "Phase 1")
        .otherwise("PHASE 2")
    )
    return (
        table(spark, sf, "orders")
        .withColumn("_k", key)
        .select(
            F.col("_k").cast("string").alias("location_id"),
            lat_of(F.col("_k")).alias("latitude"),
            lon_of(F.col("_k")).alias("longitude"),
            digit.cast("int").alias("stage_id"),
            name.alias("stage_name"),
            F.col("o_orderdate").cast("timestamp_ntz").alias("stage_date"),
        )
    )


def _event_rows(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("event_type")
    stage = (
        F.when(kind == "click", 1).when(kind == "view", 4).when(kind == "purchase", 2).otherwise(3)
    )
    return table(spark, sf, "events").select(
        "user_id",
        stage.alias("stage_id"),
        F.to_date("ts").alias("prediction_date"),
        F.round(F.col("value") * 100).cast("bigint").alias("_cents"),
    )


def _signal(cents: Column, n: Column) -> Column:
    """Days on a 1/64 grid, so that sums and means are exact in any order."""
    day = F.dayofmonth("prediction_date")
    return F.floor((F.lit(25.0) - day + (cents / (n * 100.0) - 50.0) / 10.0) * 64.0) / 64.0


def _finish(df: DataFrame, spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("user_id") % F.col("_places")
    raw = F.col("raw_signed_days")
    return df.withColumn("_places", n_places(spark, sf)).select(
        F.col("user_id").cast("string").alias("location_id"),
        F.concat(F.lit("grid_"), key.cast("string")).alias("place_id"),
        "stage_id",
        lat_of(key).alias("latitude"),
        lon_of(key).alias("longitude"),
        "prediction_date",
        F.year("prediction_date").alias("trajectory_year"),
        "raw_signed_days",
        F.greatest(raw, F.lit(0.0)).alias("predicted_days"),
        F.date_add(
            "prediction_date", F.floor(F.greatest(raw, F.lit(0.0))).cast("int")
        ).alias("predicted_stage_date"),
        F.date_add(F.lit("2024-01-10").cast("date"), (F.col("user_id") % 12).cast("int")).alias(
            "actual_stage_date"
        ),
    )


def trajectory(spark: SparkSession, sf: str) -> DataFrame:
    """One row per (user, type, day)."""
    daily = _event_rows(spark, sf).groupBy("user_id", "stage_id", "prediction_date").agg(
        F.sum("_cents").alias("_c"), F.count(F.lit(1)).alias("_n")
    )
    return _finish(daily.withColumn("raw_signed_days", _signal(F.col("_c"), F.col("_n"))), spark, sf)


def duplicate_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """One row per event, several per prediction key."""
    rows = _event_rows(spark, sf)
    return _finish(
        rows.withColumn("raw_signed_days", _signal(F.col("_cents"), F.lit(1))), spark, sf
    ).drop("actual_stage_date")


def detail(spark: SparkSession, sf: str) -> DataFrame:
    """Two model versions: the trajectory, and the same one day later."""
    base = trajectory(spark, sf).withColumn("test_year", F.lit(2024))
    shift = F.explode(
        F.array(
            F.struct(F.lit("A").alias("v"), F.lit(0.0).alias("d")),
            F.struct(F.lit("B").alias("v"), F.lit(1.0).alias("d")),
        )
    )
    return (
        base.withColumn("_s", shift)
        .withColumns(
            {
                "model_version": F.col("_s.v"),
                "raw_signed_days": F.col("raw_signed_days") + F.col("_s.d"),
            }
        )
        .withColumns(
            {
                "predicted_days": F.greatest("raw_signed_days", F.lit(0.0)),
                "predicted_stage_date": F.date_add(
                    "prediction_date",
                    F.floor(F.greatest("raw_signed_days", F.lit(0.0))).cast("int"),
                ),
            }
        )
        .drop("_s")
    )


def track_events(spark: SparkSession, sf: str) -> DataFrame:
    """Actual event of each trajectory of the two-version detail."""
    kind = F.col("event_type")
    stage = (
        F.when(kind == "click", 1).when(kind == "view", 4).when(kind == "purchase", 2).otherwise(3)
    )
    key = F.col("user_id") % F.col("_places")
    day = F.date_add(F.lit("2024-01-10").cast("date"), (F.col("user_id") % 12).cast("int"))
    return (
        table(spark, sf, "events")
        .select("user_id", stage.alias("stage_id"))
        .distinct()
        .withColumn("_places", n_places(spark, sf))
        .select(
            F.col("user_id").cast("string").alias("location_id"),
            "stage_id",
            F.year(day).alias("year"),
            day.cast("timestamp_ntz").alias("stage_date"),
            lat_of(key).alias("latitude"),
            lon_of(key).alias("longitude"),
            F.concat(F.lit("S"), (key % 7).cast("string")).alias("location_state"),
            F.concat(F.lit("loc "), F.col("user_id").cast("string")).alias("location_name"),
        )
    )


def cache_index(spark: SparkSession, sf: str) -> DataFrame:
    """Per place and year, first and last day; places in debt are not indexed."""
    key = F.col("l_suppkey")
    indexed = table(spark, sf, "supplier").where("s_acctbal >= 0")
    return (
        table(spark, sf, "lineitem")
        .join(indexed.select(F.col("s_suppkey").alias("l_suppkey")), "l_suppkey", "left_semi")
        .groupBy("l_suppkey", F.year("l_shipdate").alias("_y"))
        .agg(F.min("l_shipdate").alias("_a"), F.max("l_shipdate").alias("_b"))
        .select(
            F.concat(F.lit("grid_"), key.cast("string")).alias("PLACE_ID"),
            F.date_format("_a", "yyyyMMdd").alias("START_COMPACT"),
            F.date_format("_b", "yyyyMMdd").alias("END_COMPACT"),
            F.concat_ws("/", F.lit("cache"), key.cast("string"), F.col("_y").cast("string")).alias(
                "KEY"
            ),
        )
    )


def cells(spark: SparkSession, sf: str) -> DataFrame:
    """Square polygons of 0.1 degree around every location, as WKT."""
    key = F.col("s_suppkey")
    lat, lon = lat_of(key), lon_of(key)

    def corner(dx: float, dy: float) -> Column:
        return F.concat_ws(
            " ",
            F.round(lon + dx, 4).cast("string"),
            F.round(lat + dy, 4).cast("string"),
        )

    ring = F.concat_ws(
        ", ",
        corner(-0.05, -0.05),
        corner(0.05, -0.05),
        corner(0.05, 0.05),
        corner(-0.05, 0.05),
        corner(-0.05, -0.05),
    )
    return table(spark, sf, "supplier").select(
        F.concat(F.lit("grid_"), key.cast("string")).alias("place_id"),
        F.concat(F.lit("POLYGON (("), ring, F.lit("))")).alias("boundary"),
    )
