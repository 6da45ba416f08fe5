"""Data-quality and cache audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seasontide.config import TARGET_IDS
from seasontide.functions import scalars as S
from seasontide.functions.checkpoints import reliable
from seasontide.sources.schemas import IDENTITY_COLUMNS, INDEX_COLUMNS, require_columns


def normalize_index(df: DataFrame) -> DataFrame:
    """Cache index with lower-case names and real dates, distinct."""
    lower = df.withColumnsRenamed({c: c.lower() for c in df.columns})
    require_columns(lower, INDEX_COLUMNS)

    def day(name: str) -> Column:
        return F.to_date(F.col(name).cast("string"), "yyyyMMdd")

    return lower.select(
        F.col("place_id").cast("string").alias("place_id"),
        day("start_compact").alias("start_date"),
        day("end_compact").alias("end_date"),
    ).distinct()


def date_gaps(actual: DataFrame, index: DataFrame) -> DataFrame:
    """Per index entry: expected, actual and missing days, and which days are missing.

    A place has at most one row per calendar day after ``distinct``, so the list
    is bounded by the length of the interval.  An interval that ends before it
    starts expects nothing.
    """
    have = actual.select("place_id", "date").distinct()
    n_actual = have.groupBy("place_id").agg(F.count("date").alias("actual_dates"))
    forward = index.where("start_date <= end_date")
    expected = forward.withColumn("date", F.explode(F.sequence("start_date", "end_date")))
    missing = (
        expected.join(have, ["place_id", "date"], "left_anti")
        .groupBy("place_id", "start_date", "end_date")
        .agg(
            F.count("date").alias("missing_count"),
            F.array_sort(F.collect_list("date")).alias("missing_dates"),
        )
    )
    return (
        index.withColumn("expected_dates", F.greatest(F.datediff("end_date", "start_date") + 1, F.lit(0)))
        .join(missing, ["place_id", "start_date", "end_date"], "left")
        .join(n_actual, "place_id", "left")
        .select(
            "place_id",
            "start_date",
            "end_date",
            "expected_dates",
            F.coalesce("actual_dates", F.lit(0)).alias("actual_dates"),
            F.coalesce("missing_count", F.lit(0)).alias("missing_count"),
            F.coalesce("missing_dates", F.array().cast("array<date>")).alias("missing_dates"),
        )
    )


def unindexed(actual: DataFrame, index: DataFrame) -> DataFrame:
    """Places that have data but no index entry."""
    return (
        actual.select("place_id").distinct().join(index.select("place_id"), "place_id", "left_anti")
    )


def date_segments(df: DataFrame, key: str = "place_id", day: str = "date") -> DataFrame:
    """Runs of consecutive days per place.

    Distinct first: a place then has one row per calendar day, which bounds the
    window group by the length of the calendar.
    """
    days = df.select(F.col(key), F.col(day).cast("date").alias("_day")).distinct().dropna()
    w = Window.partitionBy(key).orderBy("_day")
    return (
        days.withColumn("_run", F.date_sub("_day", F.row_number().over(w)))
        .groupBy(key, "_run")
        .agg(
            F.min("_day").alias("start_date"),
            F.max("_day").alias("end_date"),
            F.count("_day").alias("n_days"),
        )
        .drop("_run")
    )


def segment_index(segments: DataFrame, prefix: str = "cache") -> DataFrame:
    """Index rows of a rebuilt cache, with the key of each segment."""
    start = F.date_format("start_date", "yyyyMMdd")
    end = F.date_format("end_date", "yyyyMMdd")
    return segments.select(
        "place_id",
        start.alias("start_compact"),
        end.alias("end_compact"),
        F.concat_ws("_", F.concat(F.lit(prefix + "/"), "place_id"), start, end).alias("key"),
    )


def segment_report(df: DataFrame) -> DataFrame:
    """Dry run: per place, the number of segments and whether a rewrite is needed."""
    return (
        date_segments(df)
        .groupBy("place_id")
        .agg(
            F.count(F.lit(1)).alias("n_segments"),
            F.sum("n_days").alias("n_days"),
            F.min("start_date").alias("start_date"),
            F.max("end_date").alias("end_date"),
        )
        .withColumn("needs_split", F.col("n_segments") > 1)
    )


def compact_segments(df: DataFrame, path: str, apply: bool = False) -> DataFrame:
    """Rebuild the cache below a new path and return its index.

    The segments are found once. Every row carries the start of its segment, fetched by
    place and day. Rows are range-sorted by place, segment and date, so that a reader of
    one segment skips all other row groups; folders are only one per start year. The
    index is written last: a cache without one isn't complete. Rows without place or
    date are left out. Without ``apply`` nothing is written.
    """
    if not apply:
        return segment_index(date_segments(df))
    segments = reliable(date_segments(df))
    starts = segments.select(
        F.col("place_id").alias("_p"),
        F.explode(F.sequence("start_date", "end_date")).alias("_day"),
        F.date_format("start_date", "yyyyMMdd").alias("segment_start"),
        F.year("start_date").alias("start_year"),
    )
    order = ["start_year", "place_id", "segment_start", "date"]
    (
        df.drop("segment_start", "start_year")
        .join(starts, (F.col("place_id") == F.col("_p")) & (F.col("date").cast("date") == F.col("_day")))
        .drop("_p", "_day")
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .write.mode("errorifexists")
        .partitionBy("start_year")
        .parquet(f"{path}/data")
    )
    index = segment_index(segments)
    index.write.mode("errorifexists").parquet(f"{path}/index")
    return index


def index_summary(index: DataFrame) -> DataFrame:
    return index.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.countDistinct("place_id").alias("n_places"),
        F.min("start_date").alias("min_start"),
        F.max("end_date").alias("max_end"),
    )


def check_features(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """One row: rows, missing or non-numeric values per column, duplicate (date, location) rows.

    Counted per key first, so the duplicate check needs no window.
    """
    needed = [c for c in dict.fromkeys([*IDENTITY_COLUMNS, *features]) if c != "stage_id"]
    require_columns(df, needed)
    numeric = [c for c in needed if c not in ("date", "location_id", "place_id")]
    per_key = df.groupBy("date", "location_id").agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.count_if(S.number(F.col(c)).isNull()).alias(c) for c in numeric],
    )
    return per_key.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum(F.when(F.col("date").isNull(), F.col("_n"))), F.lit(0)).alias("bad_date"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(f"bad_{c}") for c in numeric],
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_rows"),
    )


def require_features(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Raise when the feature contract is broken."""
    counts = check_features(df, features).first().asDict()
    broken = {k: v for k, v in counts.items() if k != "n_rows" and v}
    if broken:
        raise ValueError(f"feature contract broken: {broken}")
    return df


def check_inference(
    df: DataFrame, features: Sequence[str], ids: Sequence[int] = TARGET_IDS
) -> DataFrame:
    """One row of violations of the inference input contract."""
    needed = dict.fromkeys([*features, "stage_id", "prediction_date", "latitude", "longitude"])
    require_columns(df, needed)
    stage = F.col("stage_id").try_cast("double")
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("prediction_date").try_cast("date").isNull()).alias("bad_dates"),
        F.count_if(stage.isNull()).alias("bad_stage_ids"),
        F.count_if(stage.isNotNull() & ~stage.cast("int").isin(list(ids))).alias("unknown_targets"),
        *[
            F.count_if(S.number(F.col(c)).isNull()).alias(f"bad_{c}")
            for c in features
            if c != "stage_id"
        ],
    )


def require_inference(
    df: DataFrame, features: Sequence[str], ids: Sequence[int] = TARGET_IDS
) -> DataFrame:
    counts = check_inference(df, features, ids).first().asDict()
    broken = {k: v for k, v in counts.items() if k != "n_rows" and v}
    if broken:
        raise ValueError(f"inference contract broken: {broken}")
    return df


def event_range(events: DataFrame) -> DataFrame:
    return events.agg(
        F.count(F.lit(1)).alias("n_events"),
        F.to_date(F.min("stage_date")).alias("min_date"),
        F.to_date(F.max("stage_date")).alias("max_date"),
        F.datediff(F.max("stage_date"), F.min("stage_date")).alias("span_days"),
    )


def events_per_year(events: DataFrame) -> DataFrame:
    return events.groupBy(F.year("stage_date").alias("year")).agg(
        F.count(F.lit(1)).alias("n_events")
    )


def mapping_report(df: DataFrame) -> DataFrame:
    """How many rows kept a location after a mapping join."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count("location_id").alias("n_mapped"),
        F.countDistinct("location_id").alias("n_locations"),
    )


def reconcile_labels(left: DataFrame, right: DataFrame) -> DataFrame:
    """Status of each left label: exact match, strict month/day swap, or unresolved.

    Matching needs the same location and stage.  Both lookups are equi-joins on
    distinct labels.
    """
    keys = ["location_id", "stage_id"]
    known = right.select(*keys, F.to_date("stage_date").alias("_day")).distinct()
    labels = left.select(*keys, F.to_date("stage_date").alias("stage_day"), "source_file").distinct()
    can_swap = (F.dayofmonth("stage_day") <= 12) & (
        F.dayofmonth("stage_day") != F.month("stage_day")
    )
    swapped = F.when(
        can_swap, F.make_date(F.year("stage_day"), F.dayofmonth("stage_day"), F.month("stage_day"))
    )
    exact = known.withColumnRenamed("_day", "stage_day").withColumn("_exact", F.lit(True))
    swap = known.withColumnRenamed("_day", "_swapped").withColumn("_swap", F.lit(True))
    return (
        labels.withColumn("_swapped", swapped)
        .join(exact, [*keys, "stage_day"], "left")
        .join(swap, [*keys, "_swapped"], "left")
        .withColumn(
            "status",
            F.when(F.col("_exact"), "exact")
            .when(F.col("_swap"), "month_day_swap")
            .otherwise("unresolved"),
        )
        .select(*keys, "stage_day", "source_file", "status")
    )


def reconciliation_counts(status: DataFrame) -> DataFrame:
    return status.groupBy("source_file").agg(
        F.count(F.lit(1)).alias("n_labels"),
        *[
            F.count_if(F.col("status") == s).alias(f"n_{s}")
            for s in ("exact", "month_day_swap", "unresolved")
        ],
    )
