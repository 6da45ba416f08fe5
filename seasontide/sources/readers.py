"""Readers and scan-level operators.  Filters and projections reach the scan."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seasontide.config import TARGET_IDS
from seasontide.functions import scalars as S
from seasontide.functions.ordering import keep_first, number_rows
from seasontide.sources import schemas


def read_table(spark: SparkSession, path: str, **csv_options) -> DataFrame:
    """CSV (with header) or Parquet, by suffix."""
    if path.rstrip("/").endswith((".csv", ".csv.gz")):
        return spark.read.options(header=True, **csv_options).csv(path)
    return spark.read.parquet(path)


def type_events(raw: DataFrame) -> DataFrame:
    """Ids as strings, coordinates as doubles, dates as naive timestamps, plus year and doy."""
    stage_date = F.col("stage_date").cast("timestamp_ntz")
    return raw.withColumns(
        {
            "location_id": F.col("location_id").cast("string"),
            "latitude": S.number(F.col("latitude")),
            "longitude": S.number(F.col("longitude")),
            "stage_date": stage_date,
            "year": F.year(stage_date),
            "day_of_year": F.dayofyear(stage_date),
        }
    )


def until(events: DataFrame, cutoff: str) -> DataFrame:
    """Events dated at or before the cutoff."""
    return events.where(F.col("stage_date") <= F.lit(cutoff).cast("timestamp_ntz"))


def read_events(source: DataFrame, cutoff: str) -> DataFrame:
    """Raw event table up to ``cutoff`` (filtered before typing, so it pushes down)."""
    return type_events(until(source, cutoff))


def read_event_export(source: DataFrame, ids: Iterable[int] = TARGET_IDS) -> DataFrame:
    """Canonical event export: typed, bad rows dropped, known targets kept."""
    schemas.require_columns(source, schemas.EVENT_EXPORT_COLUMNS)
    typed = source.withColumns(
        {
            "location_id": F.col("location_id").cast("string"),
            "latitude": S.number(F.col("latitude")),
            "longitude": S.number(F.col("longitude")),
            "stage_id": F.col("stage_id").try_cast("double").cast("int"),
            "stage_date": F.col("stage_date").try_cast("timestamp_ntz"),
        }
    )
    needed = ["stage_date", "stage_id", "latitude", "longitude"]
    return (
        typed.dropna(subset=needed)
        .where(F.col("stage_id").isin(*ids))
        .withColumn("event_year", F.year("stage_date"))
    )


def read_features(source: DataFrame, features: Sequence[str]) -> DataFrame:
    """Engineered daily features, typed.  ``audits.require_features`` checks the contract."""
    needed = list(dict.fromkeys([*schemas.IDENTITY_COLUMNS, *features]))
    needed = [c for c in needed if c != "stage_id"]
    schemas.require_columns(source, needed)
    text = {"date", "location_id", "place_id"}
    return source.select(
        F.col("date").cast("date").alias("date"),
        F.col("location_id").cast("string").alias("location_id"),
        F.col("place_id").cast("string").alias("place_id"),
        *[S.number(F.col(c)).alias(c) for c in needed if c not in text],
    )


def parse_day(value: Column) -> Column:
    """Request dates: ISO, compact, or month/day/year with a short or long year."""
    text = F.trim(value.cast("string"))
    short = F.try_to_date(text, "M/d/yy")
    # two-digit years 69..99 belong to the last century
    short = F.when(F.year(short) >= 2069, F.add_months(short, -1200)).otherwise(short)
    return F.coalesce(
        F.try_to_date(text, "yyyy-MM-dd"),
        F.try_to_date(text, "yyyyMMdd"),
        short,
        F.try_to_date(text, "M/d/yyyy"),
    )


def read_requests(source: DataFrame) -> DataFrame:
    """Location requests with parsed dates and a status per row."""
    schemas.require_columns(source, schemas.REQUEST_COLUMNS)
    parsed = source.withColumns(
        {"_start": parse_day(F.col("start_date")), "_end": parse_day(F.col("end_date"))}
    )
    status = (
        F.when(F.col("_start").isNull() | F.col("_end").isNull(), "unparsable")
        .when(F.col("_start") > F.col("_end"), "start_after_end")
        .otherwise("ok")
    )
    return (
        parsed.withColumn("status", status)
        .withColumns(
            {
                "start_date": F.col("_start"),
                "end_date": F.col("_end"),
                "start_yyyymmdd": F.date_format("_start", "yyyyMMdd"),
                "end_yyyymmdd": F.date_format("_end", "yyyyMMdd"),
            }
        )
        .drop("_start", "_end")
    )


def require_requests(requests: DataFrame) -> DataFrame:
    """Raise when a request row was rejected; at most ten rows reach the driver."""
    bad = requests.where("status <> 'ok'").select("loc", "status").take(10)
    if bad:
        raise ValueError(f"rejected requests: {[tuple(r) for r in bad]}")
    return requests.drop("status")


def read_coverage(source: DataFrame, with_location: bool = False) -> DataFrame:
    """Spatial coverage, one row per centroid (and per location for hindcasts)."""
    schemas.require_columns(source, schemas.COVERAGE_COLUMNS)
    keys = ["centroid_lat", "centroid_lon"] + (["location_id"] if with_location else [])
    cols = list(schemas.COVERAGE_COLUMNS)
    typed = source.select(cols).withColumns(
        {"place_id": F.col("place_id").cast("string"), "location_id": F.col("location_id").cast("string")}
    )
    return keep_first(typed, keys, [c for c in ("place_id", "location_id", "latitude", "longitude")])


def scan_features(
    source: DataFrame, columns: Sequence[str], start: str, end: str | None = None
) -> DataFrame:
    """Rows of a date range with the requested columns that exist (plus ``date``)."""
    cols = [c for c in columns if c in source.columns]
    cols = cols if "date" in cols else ["date", *cols]
    days = (F.lit(start).cast("date"), F.lit(end or start).cast("date"))
    return source.where(F.col("date").between(*days)).select(*cols)


def scan_history(source: DataFrame, start: str, end: str) -> DataFrame:
    """Prediction history of a date range in (date, location, stage) order."""
    days = (F.lit(start).cast("date"), F.lit(end).cast("date"))
    return source.where(F.col("prediction_date").between(*days)).orderBy(
        "prediction_date", "location_id", "stage_id"
    )


def scan_places(weather: DataFrame, places: DataFrame, start: str, end: str) -> DataFrame:
    """Weather of the listed places in a date range, in (place, date) order."""
    days = (F.lit(start).cast("date"), F.lit(end).cast("date"))
    wanted = places.select(F.col("place_id").cast("string").alias("place_id"))
    return (
        weather.where(F.col("date").between(*days))
        .join(wanted, "place_id", "left_semi")
        .orderBy("place_id", "date")
    )


def pending_dates(plan: DataFrame, done: DataFrame) -> DataFrame:
    """Planned prediction dates that are not completed yet."""
    return plan.join(done.select("prediction_date").distinct(), "prediction_date", "left_anti")


def consolidate_weather(
    pulls: DataFrame, numeric: Sequence[str], last: Sequence[Column | str]
) -> DataFrame:
    """Merged pulls: numeric casts, then the last row per (loc, date).

    ``last`` states the arrival order, latest first.
    """
    typed = pulls.withColumns({c: S.number(F.col(c)) for c in numeric if c in pulls.columns})
    return keep_first(typed, ["loc", "date"], last)


def stride_sample(
    df: DataFrame, order: Sequence[Column | str], step: int, cap: int | None = None
) -> DataFrame:
    """Every ``step``-th row of a total order, starting with the first, at most ``cap`` rows."""
    kept = number_rows(df, order, "_row").where((F.col("_row") - 1) % step == 0)
    if cap is not None and cap > 0:
        kept = kept.where(F.col("_row") <= (cap - 1) * step + 1)
    return kept.drop("_row")


def snapshot_by_cutoff(events: DataFrame, cutoffs: Sequence[str]) -> DataFrame:
    """Events visible at each cutoff: one copy per cutoff at or after the event date."""
    days = F.array(*[F.lit(c).cast("date") for c in sorted(set(cutoffs))])
    visible = F.filter(days, lambda d: F.col("stage_date") <= d.cast("timestamp_ntz"))
    return events.withColumn("cutoff", F.explode(visible))


def snapshot_manifest(snapshots: DataFrame) -> DataFrame:
    return snapshots.groupBy("cutoff").agg(
        F.count(F.lit(1)).alias("n_rows"), F.max("stage_date").alias("last_stage_date")
    )


def latest_run(spark: SparkSession, path: str) -> str:
    """The run that was published last below ``path``, of equal times the greatest id."""
    runs = spark.read.parquet(f"{path}/published")
    last = runs.orderBy(F.desc("published_at"), F.desc("run_id")).select("run_id").first()
    return last["run_id"]


def read_latest(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table of the run that was published last."""
    return spark.read.parquet(f"{path}/runs/{latest_run(spark, path)}/{name}.parquet")
