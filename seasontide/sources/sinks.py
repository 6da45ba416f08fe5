"""Writers.  Output is partitioned by date; re-runs replace only their own dates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seasontide.operators.spatial import enrich_weather


def missing_days(landed_days: DataFrame, start: str, end: str) -> DataFrame:
    """Days of the inclusive range without landed data."""
    spark = landed_days.sparkSession
    days = spark.range(1).select(
        F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("date")
    )
    return days.join(landed_days.select("date").distinct(), "date", "left_anti")


def pending_weather(
    weather: DataFrame, coverage: DataFrame, landed_days: DataFrame, start: str, end: str
) -> DataFrame:
    """Raw weather of days not landed yet, joined to the coverage."""
    days = (F.lit(start).cast("date"), F.lit(end).cast("date"))
    fresh = weather.where(F.col("date").between(*days)).join(
        landed_days.select("date").distinct(), "date", "left_anti"
    )
    return enrich_weather(fresh, coverage)


def land_weather(
    weather: DataFrame, coverage: DataFrame, path: str, start: str, end: str
) -> DataFrame:
    """Write the missing days below ``path``, one partition per day.

    Returns the days stored within the range, landed before or now; only their
    folders are read.
    """
    spark = weather.sparkSession
    wanted = F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    try:
        landed = spark.read.parquet(path).where(wanted).select("date")
    except Exception as error:  # first run: nothing there yet
        if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
            raise
        landed = weather.select("date").where(F.lit(False))
    fresh = pending_weather(weather, coverage, landed, start, end)
    write_by_day(fresh, path, "date")
    return spark.read.schema(fresh.schema).parquet(path).where(wanted)


def write_by_day(df: DataFrame, path: str, day: str) -> None:
    """Dynamic overwrite by day.

    ``rebalance`` gathers the rows of a day into files of the advisory size and
    splits a day too large for one task.
    """
    (
        df.hint("rebalance", F.col(day))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(day)
        .parquet(path)
    )


def write_predictions(df: DataFrame, path: str, run_date: str) -> None:
    """Publish the predictions of one run date."""
    today = df.where(F.col("prediction_date") == F.lit(run_date).cast("date"))
    write_by_day(today, path, "prediction_date")


def write_outputs(frames: dict[str, DataFrame], path: str, run_id: str) -> list[str]:
    """Detail and summary tables of one run, as Parquet and CSV, then the pointer to it.

    A run has a folder of its own, which must not exist yet.  The pointer is a row that
    is appended last: until then readers get the run before, so a run that is killed
    at any moment leaves the published tables as they were.
    """
    written = []
    for name, df in frames.items():
        run = f"{path}/runs/{run_id}/{name}"
        df.write.parquet(f"{run}.parquet")
        stored = df.sparkSession.read.parquet(f"{run}.parquet")
        stored.write.option("header", True).csv(f"{run}.csv")
        written += [f"{run}.parquet", f"{run}.csv"]
    if frames:
        spark = next(iter(frames.values())).sparkSession
        row = spark.range(1).select(F.lit(run_id).alias("run_id"), F.current_timestamp().alias("published_at"))
        row.coalesce(1).write.mode("append").parquet(f"{path}/published")
    return written


def write_snapshots(snapshots: DataFrame, path: str) -> None:
    write_by_day(snapshots, path, "cutoff")
