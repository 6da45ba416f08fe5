"""Event cleaning, canonical targets, curated and derived labels."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seasontide.config import OUTPUT_IDS, TARGET_IDS, TARGET_NAMES, Settings
from seasontide.functions import scalars as S
from seasontide.functions.ordering import keep_first
from seasontide.sources.readers import until

# Curated observations (region, location, latitude, longitude, stage, date).
CURATED_EVENTS = (
    ("Chicago", "Glen Flora Country Club", 42.392092067115186, -87.83332773512043, 1, "2025-05-05"),
    ("Chicago", "Glen Flora Country Club", 42.392092067115186, -87.83332773512043, 2, "2025-05-18"),
    ("Chicago", "Glen Flora Country Club", 42.392092067115186, -87.83332773512043, 3, "2025-06-01"),
    ("Kentucky", "Champion Trace", 37.973038, -84.633743, 1, "2026-04-02"),
    ("Kentucky", "Houston Oaks", 38.171783, -84.294525, 1, "2026-04-02"),
    ("Kentucky", "University of Louisville Golf Club", 38.212247, -85.359902, 1, "2026-03-30"),
    ("Kentucky", "Frankfort Country Club", 38.204946, -84.810389, 1, "2026-04-13"),
    ("Kentucky", "Champion Trace", 37.973038, -84.633743, 2, "2026-04-23"),
    ("Kentucky", "University of Louisville Golf Club", 38.212247, -85.359902, 2, "2026-04-27"),
    ("Kentucky", "Frankfort Country Club", 38.204946, -84.810389, 2, "2026-05-11"),
    ("Kentucky", "Frankfort Country Club", 38.204946, -84.810389, 3, "2026-06-08"),
)


def _lookup(key: Column, table: dict) -> Column:
    """Chained ``when`` over a small fixed table; NULL when absent."""
    value = F.lit(None)
    for k, v in table.items():
        value = F.when(key == k, F.lit(v)).otherwise(value)
    return value


def drop_placeholders(df: DataFrame, day: str = "12-31") -> DataFrame:
    """Drop rows dated on the placeholder month-day; undated rows stay."""
    month, dom = (int(x) for x in day.split("-"))
    at = F.col("stage_date")
    return df.where(at.isNull() | (F.month(at) != month) | (F.dayofmonth(at) != dom))


def canonicalize_events(df: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """Rewrite ``stage_id`` as the stable target id and record where the label came from."""
    rules = {
        "stage 1": (1, "observed_stage1"),
        "stage 2": (2, "observed_stage2"),
        "stage 3": (3, "observed_stage3"),
    }
    if cfg.phase2_as_stage3:
        rules["phase 2"] = (3, "observed_phase2_as_stage3")
    if cfg.observed_phase1:
        rules["phase 1"] = (4, "observed_phase1")
    known = drop_placeholders(df, cfg.placeholder_month_day) if cfg.exclude_placeholders else df
    raw_id = F.col("stage_id") if "stage_id" in df.columns else F.lit(None).cast("int")
    label, target = F.col("_label"), F.col("canonical_event_id")
    # the label is normalised once; later projections read the column
    return (
        known.withColumn("_label", S.normalize_label(F.col("stage_name")))
        .where(label.isin(list(rules)))
        .withColumns(
            {
                "stage_name_raw": F.col("stage_name"),
                "raw_stage_id": raw_id,
                "label_source": _lookup(label, {k: v[1] for k, v in rules.items()}),
                "canonical_event_id": _lookup(label, {k: v[0] for k, v in rules.items()}),
            }
        )
        .withColumns(
            {
                "stage_id": target,
                "canonical_event_name": _lookup(target, TARGET_NAMES),
                "stage_name": _lookup(target, TARGET_NAMES),
            }
        )
        .drop("_label")
    )


def legacy_stage(df: DataFrame) -> DataFrame:
    """Legacy mapping: exact names "Stage 1" .. "Stage 5", id parsed from the name."""
    names = [f"Stage {i}" for i in range(1, 6)]
    return (
        df.where(F.col("stage_name").isin(names))
        .withColumn("stage_id", F.regexp_extract("stage_name", r"Stage (\d+)", 1).cast("int"))
        .drop("stage_name")
    )


def curated_events(spark: SparkSession) -> DataFrame:
    """The curated observations as a typed event table."""
    rows = spark.createDataFrame(
        list(CURATED_EVENTS),
        "region string, location_name string, latitude double, longitude double, "
        "stage_id int, stage_date string",
    )
    return describe_curated(rows)


def describe_curated(rows: DataFrame) -> DataFrame:
    """Ids, dates and provenance flags of curated rows."""
    when = F.col("stage_date").cast("timestamp_ntz")
    location = F.concat(
        F.lit("manual_"),
        S.slug(F.col("region")),
        F.lit("_"),
        F.year(when).cast("string"),
        F.lit("_"),
        S.slug(F.col("location_name")),
    )
    return rows.withColumns(
        {
            "stage_date": when,
            "stage_name": F.concat(F.lit("Stage "), F.col("stage_id").cast("string")),
            "year": F.year(when),
            "day_of_year": F.dayofyear(when),
            "location_id": location,
            "manual_event_id": F.concat(
                location, F.lit("_stage_"), F.col("stage_id").cast("string")
            ),
            "data_source": F.lit("manual_curated"),
            "is_manual_event": F.lit(True),
        }
    )


def append_manual(df: DataFrame, manual: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """Union of observed and curated rows; columns missing on either side become NULL."""
    observed = df
    if "is_manual_event" not in df.columns:
        observed = observed.withColumn("is_manual_event", F.lit(False))
    if "data_source" not in df.columns:
        observed = observed.withColumn("data_source", F.lit(cfg.observed_source))
    return observed.unionByName(manual, allowMissingColumns=True)


def append_midpoint(
    df: DataFrame, cfg: Settings = Settings(), order: Sequence[str] = ("stage_name_raw",)
) -> DataFrame:
    """Derived target 4 at the exact midpoint of the earliest stage 1 and stage 2.

    The other columns come from the earliest of the two; ``order`` breaks ties
    after (date, stage).
    """
    if not cfg.derived_phase1:
        return df
    base = df.withColumn("location_id", F.col("location_id").cast("string"))
    if "year" not in df.columns:
        base = base.withColumn("year", F.year("stage_date"))
    ties = [c for c in order if c in base.columns]
    keys = ["location_id", "year"]
    row = F.struct(*[F.col(c) for c in base.columns])
    rank = F.struct("stage_date", "stage_id", *ties)
    first = (
        base.where(F.col("stage_id").isin(1, 2) & F.col("stage_date").isNotNull())
        .groupBy(*keys)
        .agg(
            F.min(F.when(F.col("stage_id") == 1, F.col("stage_date"))).alias("_s1"),
            F.min(F.when(F.col("stage_id") == 2, F.col("stage_date"))).alias("_s2"),
            F.min_by(row, rank).alias("_row"),
        )
        .where(F.col("_s1").isNotNull() & F.col("_s2").isNotNull())
    )
    middle = S.midpoint(F.col("_s1"), F.col("_s2"))
    derived = first.select("_row.*", "_s1", "_s2").withColumns(
        {
            "stage_date": middle.cast("timestamp_ntz"),
            "stage_id": F.lit(4),
            "canonical_event_id": F.lit(4),
            "stage_name": F.lit(TARGET_NAMES[4]),
            "canonical_event_name": F.lit(TARGET_NAMES[4]),
            "stage_name_raw": F.lit("Derived Phase 1 midpoint"),
            "label_source": F.lit("derived_phase1_midpoint_stage1_stage2"),
            "is_derived_phase1": F.lit(True),
            "phase1_stage1_date": F.col("_s1"),
            "phase1_stage2_date": F.col("_s2"),
            "day_of_year": F.dayofyear(middle),
        }
    )
    flagged = (
        base
        if "is_derived_phase1" in base.columns
        else base.withColumn("is_derived_phase1", F.lit(False))
    )
    return flagged.unionByName(derived.drop("_s1", "_s2"), allowMissingColumns=True)


def source_rank(df: DataFrame) -> Column:
    """Observed rows first, curated next, derived last."""
    rank = F.lit(0)
    if "is_manual_event" in df.columns:
        rank = F.when(F.coalesce(F.col("is_manual_event"), F.lit(False)), 1).otherwise(rank)
    if "is_derived_phase1" in df.columns:
        rank = F.when(F.coalesce(F.col("is_derived_phase1"), F.lit(False)), 2).otherwise(rank)
    return rank


def dedupe_events(df: DataFrame, order: Sequence[Column | str] | None = None) -> DataFrame:
    """Keep the first row per (latitude, longitude, year, stage)."""
    ties = [c for c in ("label_source", "stage_name_raw") if c in df.columns]
    order = order or [source_rank(df), "stage_date", "location_id", *ties]
    return keep_first(df, ["latitude", "longitude", "year", "stage_id"], order)


def exclude_locations(df: DataFrame, ids: Iterable[str] | DataFrame) -> DataFrame:
    """Drop listed locations; a table of ids is anti-joined, a short list is a filter."""
    if isinstance(ids, DataFrame):
        return df.join(ids.select("location_id").distinct(), "location_id", "left_anti")
    ids = list(ids)
    return df.where(~F.coalesce(F.col("location_id").isin(ids), F.lit(False))) if ids else df


def exclude_pairs(df: DataFrame, pairs: Iterable[tuple[str, int]] | DataFrame) -> DataFrame:
    """Drop listed (location, year) pairs."""
    if isinstance(pairs, DataFrame):
        return df.join(pairs.select("location_id", "year"), ["location_id", "year"], "left_anti")
    bad = F.lit(False)
    for location, year in pairs:
        bad = bad | ((F.col("location_id") == location) & (F.col("year") == year))
    return df.where(~F.coalesce(bad, F.lit(False)))


def season_filter(df: DataFrame, low: int = 60, high: int = 152) -> DataFrame:
    """Keep days of year in [low, high]; curated rows always stay."""
    keep = F.col("day_of_year").between(low, high)
    if "is_manual_event" in df.columns:
        keep = keep | F.coalesce(F.col("is_manual_event"), F.lit(False))
    return df.where(keep)


def prepare_events(
    raw: DataFrame, cutoff: str, cfg: Settings = Settings(), canonical: bool = True
) -> DataFrame:
    """Cleaned events known at ``cutoff``: map, add curated and derived rows, dedupe, filter."""
    from seasontide.sources.readers import read_events

    events = read_events(raw, cutoff)
    events = canonicalize_events(events, cfg) if canonical else legacy_stage(events)
    if cfg.manual_events:
        events = until(append_manual(events, curated_events(raw.sparkSession), cfg), cutoff)
    if canonical:
        events = append_midpoint(events, cfg)
    events = dedupe_events(events)
    events = exclude_pairs(events, cfg.excluded_pairs)
    events = season_filter(events, *cfg.season_doy)
    return exclude_locations(events, cfg.excluded_locations)


def prepare_event_export(
    export: DataFrame, cfg: Settings = Settings(), manual: DataFrame | None = None
) -> DataFrame:
    """Exported events plus curated rows and their midpoints, first per (location, year, stage)."""
    if not cfg.manual_events:
        return export
    manual = curated_events(export.sparkSession) if manual is None else manual
    curated = append_midpoint(manual, cfg, order=("manual_event_id",))
    both = export.withColumn("_rank", F.lit(0)).unionByName(
        curated.withColumn("_rank", F.lit(1)), allowMissingColumns=True
    )
    both = both.withColumn("event_year", F.year("stage_date"))
    order = ["_rank", "stage_date", "latitude", "longitude"]
    return keep_first(both, ["location_id", "event_year", "stage_id"], order).drop("_rank")


def normalize_actuals(df: DataFrame, years: Sequence[int], stages: Sequence[int]) -> DataFrame:
    """Earliest actual day per (year, location, stage) of the chosen years and stages."""
    optional = [c for c in ("location_name", "location_state", "state_code") if c in df.columns]
    kept = df.where(F.col("year").isin(list(years)) & F.col("stage_id").isin(list(stages))).select(
        F.col("location_id").cast("string").alias("location_id"),
        "stage_id",
        "year",
        F.to_date("stage_date").alias("stage_date"),
        "latitude",
        "longitude",
        *optional,
    )
    return keep_first(
        kept, ["year", "location_id", "stage_id"], ["stage_date", "latitude", "longitude", *optional]
    )


def observed_phases(
    df: DataFrame, year: int, names: Sequence[str] = ("Phase 1", "Phase 2"), day: str = "12-31"
) -> DataFrame:
    """Earliest observed row per (location, phase name) of a year, placeholders left out."""
    start = F.lit(f"{year}-01-01").cast("timestamp_ntz")
    end = F.lit(f"{year + 1}-01-01").cast("timestamp_ntz")
    kept = df.where(
        (F.col("stage_date") >= start)
        & (F.col("stage_date") < end)
        & F.col("stage_name").isin(list(names))
        & (S.month_day(F.col("stage_date")) != day)
    )
    return keep_first(kept, ["location_id", "stage_name"], ["stage_date", "latitude", "longitude"])


def add_output_names(df: DataFrame) -> DataFrame:
    """Business output id, name and order of each target."""
    key = F.col("stage_id").try_cast("double").cast("int")
    return df.withColumns(
        {
            "model_stage_id": key,
            "output_event_id": _lookup(key, OUTPUT_IDS),
            "output_event_name": _lookup(key, TARGET_NAMES),
            "output_event_order": _lookup(key, {t: i + 1 for i, t in enumerate(TARGET_IDS)}),
        }
    )


def derive_phase1(df: DataFrame) -> DataFrame:
    """Fallback phase 1: midpoint of the predicted stage 1 and 2 dates, floored to the day.

    Nothing is derived when the frame already holds direct target-4 predictions.
    """
    wanted = ("prediction_date", "location_id", "place_id", "latitude", "longitude")
    keys = [c for c in wanted if c in df.columns]
    if "prediction_date" not in keys:
        raise ValueError("prediction_date is required")
    base = add_output_names(df).withColumns(
        {"is_derived_event": F.lit(False), "derivation_rule": F.lit(None).cast("string")}
    )
    has_direct = df.where("stage_id = 4").exists()
    day = F.col("predicted_stage_date").cast("timestamp_ntz")
    middle = S.midpoint(F.col("_d1"), F.col("_d2"))
    derived = (
        df.where(F.col("stage_id").isin(1, 2) & ~has_direct)
        .groupBy(*keys)
        .agg(
            F.min(F.when(F.col("stage_id") == 1, day)).alias("_d1"),
            F.min(F.when(F.col("stage_id") == 2, day)).alias("_d2"),
        )
        .where(F.col("_d1").isNotNull() & F.col("_d2").isNotNull())
        .withColumns(
            {
                "stage_id": F.lit(4),
                "output_event_id": F.lit(OUTPUT_IDS[4]),
                "output_event_name": F.lit(TARGET_NAMES[4]),
                "output_event_order": F.lit(2),
                "predicted_stage_date": F.to_date(middle),
                "is_derived_event": F.lit(True),
                "derivation_rule": F.lit("midpoint(predicted Stage 1, predicted Stage 2)"),
            }
        )
        .withColumn(
            "predicted_days",
            F.datediff("predicted_stage_date", F.to_date("prediction_date")).cast("double"),
        )
        .drop("_d1", "_d2")
    )
    return base.unionByName(derived, allowMissingColumns=True)


def label_coverage(
    df: DataFrame, cutoff: str, years: int, ids: Sequence[int] = TARGET_IDS
) -> DataFrame:
    """Labels per target in [cutoff - years, cutoff); absent targets get zeros."""
    start = S.years_before(cutoff, years)
    end = F.lit(cutoff).cast("date")
    counts = (
        df.where(
            (F.col("stage_date") >= start.cast("timestamp_ntz"))
            & (F.col("stage_date") < end.cast("timestamp_ntz"))
            & F.col("stage_id").isin(list(ids))
        )
        .groupBy("stage_id")
        .agg(
            F.count("stage_date").alias("n_events"),
            F.countDistinct(F.year("stage_date")).alias("n_distinct_years"),
            F.countDistinct("location_id").alias("n_distinct_locations"),
        )
    )
    targets = df.sparkSession.range(1).select(
        F.explode(F.array(*[F.lit(int(i)) for i in ids])).alias("stage_id")
    )
    return targets.join(counts, "stage_id", "left").select(
        "stage_id",
        *[
            F.coalesce(c, F.lit(0)).alias(c)
            for c in ("n_events", "n_distinct_years", "n_distinct_locations")
        ],
        start.alias("window_start"),
        end.alias("cutoff_date"),
    )


def coverage_status(coverage: DataFrame, min_events: int = 20, min_years: int = 2) -> DataFrame:
    """Coverage with a verdict per target."""
    enough = (F.col("n_events") >= min_events) & (F.col("n_distinct_years") >= min_years)
    return coverage.withColumn("sufficient", enough)


def require_coverage(coverage: DataFrame, min_events: int = 20, min_years: int = 2) -> DataFrame:
    """Raise when a target has too few recent labels (one row per target is collected)."""
    if min_events <= 0 or min_years <= 0:
        raise ValueError("coverage minimums must be positive")
    short = coverage_status(coverage, min_events, min_years).where("not sufficient").collect()
    if short:
        raise RuntimeError(f"too few recent labels to retrain: {[r.asDict() for r in short]}")
    return coverage


def label_counts(df: DataFrame) -> DataFrame:
    source = F.col("label_source") if "label_source" in df.columns else F.lit(None).cast("string")
    return (
        df.withColumn("label_source", F.coalesce(source, F.lit("unknown")))
        .groupBy("stage_id", "label_source")
        .agg(F.count(F.lit(1)).alias("n_events"))
    )
