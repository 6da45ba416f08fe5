"""Sources, sinks and event cleaning over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from seasontide.config import Settings
from seasontide.operators import events as B
from seasontide.plans import adapters as A
from seasontide.plans.registry import query, scratch_dir
from seasontide.sources import readers as R
from seasontide.sources import sinks as K

CUTOFF = "2000-12-31"
OBSERVED = Settings(manual_events=False)


def canonical(spark, sf, cutoff="2026-12-31"):
    return B.canonicalize_events(R.read_events(A.raw_events(spark, sf), cutoff), OBSERVED)


def prepared(spark, sf, cutoff="2026-12-31"):
    return B.prepare_events(A.raw_events(spark, sf), cutoff, OBSERVED)


@query(
    "read_events",
    "A1",
    """SELECT location_id, latitude, longitude, stage_id, stage_name, stage_date,
              CAST(year(stage_date) AS INTEGER) AS year, CAST(dayofyear(stage_date) AS INTEGER) AS day_of_year
       FROM raw_events WHERE stage_date <= TIMESTAMP '2000-12-31'""",
)
def _(spark, sf):
    return R.read_events(A.raw_events(spark, sf), CUTOFF)


@query(
    "read_event_export",
    "A2",
    """SELECT location_id, latitude, longitude, stage_id, stage_date,
              CAST(year(stage_date) AS INTEGER) AS event_year
       FROM raw_events WHERE stage_id IN (1, 4, 2, 3) AND stage_date IS NOT NULL""",
)
def _(spark, sf):
    export = A.raw_events(spark, sf).select(
        F.col("location_id"),
        F.col("latitude").cast("string").alias("latitude"),
        F.col("longitude").cast("string").alias("longitude"),
        F.col("stage_id").cast("string").alias("stage_id"),
        F.col("stage_date").cast("string").alias("stage_date"),
    )
    return R.read_event_export(export)


@query(
    "read_features",
    "A3",
    """SELECT date, location_id, place_id, latitude, longitude, cumu_gdd_air, doy::DOUBLE AS doy FROM located""",
    rounds="cumu_gdd_air",
)
def _(spark, sf):
    from seasontide.plans.feature_queries import located

    return R.read_features(located(spark, sf), ["cumu_gdd_air", "doy"])


@query(
    "read_requests",
    "A4",
    """SELECT location_id AS loc, latitude, longitude,
              CAST(stage_date AS DATE) AS start_date, CAST(stage_date AS DATE) + stage_id * 10 - 20 AS end_date,
              CASE WHEN stage_id * 10 < 20 THEN 'start_after_end' ELSE 'ok' END AS status,
              strftime(stage_date, '%Y%m%d') AS start_yyyymmdd,
              strftime(CAST(stage_date AS DATE) + stage_id * 10 - 20, '%Y%m%d') AS end_yyyymmdd
       FROM raw_events""",
)
def _(spark, sf):
    end = F.date_add(F.to_date("stage_date"), F.col("stage_id") * 10 - 20)
    requests = A.raw_events(spark, sf).select(
        F.col("location_id").alias("loc"),
        "latitude",
        "longitude",
        F.date_format("stage_date", "M/d/yy").alias("start_date"),
        F.date_format(end, "yyyy-MM-dd").alias("end_date"),
    )
    return R.read_requests(requests)


@query(
    "read_coverage",
    "A5",
    """SELECT centroid_lat, centroid_lon, place_id, location_id, latitude, longitude FROM coverage c
       WHERE place_id = (SELECT min(place_id) FROM coverage d
                         WHERE d.centroid_lat = c.centroid_lat AND d.centroid_lon = c.centroid_lon)""",
)
def _(spark, sf):
    return R.read_coverage(A.coverage(spark, sf))


@query(
    "read_coverage_locations",
    "A5",
    """SELECT centroid_lat, centroid_lon, min(place_id) AS place_id, location_id, min(latitude) AS latitude,
              min(longitude) AS longitude
       FROM coverage GROUP BY centroid_lat, centroid_lon, location_id""",
)
def _(spark, sf):
    return R.read_coverage(A.coverage(spark, sf), with_location=True)


@query(
    "land_weather",
    "A6",
    """SELECT w.place_id, w.date, w.air_temp_max_c, c.state_code
       FROM weather_daily w JOIN coverage c ON c.place_id = w.place_id
       WHERE w.date BETWEEN DATE '1997-06-01' AND DATE '1997-07-31'""",
)
def _(spark, sf):
    path = scratch_dir(spark)
    weather, cover = A.weather_daily(spark, sf), A.coverage(spark, sf)
    # the second landing adds the days that the first one left
    K.land_weather(weather, cover, path, "1997-06-01", "1997-06-09")
    stored = K.land_weather(weather, cover, path, "1997-06-01", "1997-07-31")
    return stored.select("place_id", "date", "air_temp_max_c", "state_code")


@query(
    "missing_landed_days",
    "A6",
    """SELECT CAST(d AS DATE) AS date FROM range(DATE '1997-01-01', DATE '2000-01-01', INTERVAL 1 DAY) t(d)
       WHERE CAST(d AS DATE) NOT IN (SELECT CAST(stage_date AS DATE) FROM canon WHERE stage_id = 1)""",
)
def _(spark, sf):
    seen = canonical(spark, sf).where("stage_id = 1").select(F.to_date("stage_date").alias("date"))
    return K.missing_days(seen, "1997-01-01", "1999-12-31")


@query(
    "scan_features",
    "A7",
    """SELECT place_id, date, cumu_gdd_air, doy FROM features
       WHERE date BETWEEN DATE '1998-03-01' AND DATE '1998-06-30'""",
    rounds="cumu_gdd_air",
)
def _(spark, sf):
    from seasontide.plans.feature_queries import features

    return R.scan_features(
        features(spark, sf, ("1998-03-01", "1998-06-30")),
        ["place_id", "date", "cumu_gdd_air", "doy", "not_there"],
        "1998-03-01",
        "1998-06-30",
    )


@query(
    "write_predictions",
    "A8",
    """SELECT location_id, stage_id, predicted_days, predicted_stage_date, prediction_date
       FROM trajectory WHERE prediction_date = DATE '2024-01-15'""",
)
def _(spark, sf):
    path = scratch_dir(spark)
    K.write_predictions(A.trajectory(spark, sf), path, "2024-01-15")
    return spark.read.parquet(path).select(
        "location_id", "stage_id", "predicted_days", "predicted_stage_date", "prediction_date"
    )


@query(
    "write_outputs",
    "A9",
    "SELECT stage_id, count(*) AS n_rows, max(prediction_date) AS last_date FROM trajectory GROUP BY stage_id",
)
def _(spark, sf):
    path = scratch_dir(spark)
    summary = A.trajectory(spark, sf).groupBy("stage_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.max("prediction_date").alias("last_date")
    )
    K.write_outputs({"summary": summary}, path, "run1")
    stored = spark.read.schema("stage_id int, n_rows bigint, last_date date")
    return stored.option("header", True).csv(f"{path}/runs/{R.latest_run(spark, path)}/summary.csv")


CUTOFFS = ("1997-12-31", "1999-06-30", "2000-12-31")


@query(
    "snapshot_by_cutoff",
    "A10",
    """SELECT p.location_id, p.stage_id, p.stage_date, c.cutoff
       FROM prepared p JOIN (VALUES (DATE '1997-12-31'), (DATE '1999-06-30'), (DATE '2000-12-31')) c(cutoff)
         ON p.stage_date <= c.cutoff""",
)
def _(spark, sf):
    events = prepared(spark, sf).select("location_id", "stage_id", "stage_date")
    return R.snapshot_by_cutoff(events, CUTOFFS)


@query(
    "snapshot_manifest",
    "A10",
    """SELECT c.cutoff, count(*) AS n_rows, max(p.stage_date) AS last_stage_date
       FROM prepared p JOIN (VALUES (DATE '1997-12-31'), (DATE '1999-06-30'), (DATE '2000-12-31')) c(cutoff)
         ON p.stage_date <= c.cutoff GROUP BY c.cutoff""",
)
def _(spark, sf):
    return R.snapshot_manifest(R.snapshot_by_cutoff(prepared(spark, sf), CUTOFFS))


@query(
    "scan_history",
    "A11",
    """SELECT prediction_date, location_id, stage_id, predicted_days FROM trajectory
       WHERE prediction_date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'""",
)
def _(spark, sf):
    history = A.trajectory(spark, sf).select(
        "prediction_date", "location_id", "stage_id", "predicted_days"
    )
    return R.scan_history(history, "2024-01-05", "2024-01-20")


@query(
    "pending_dates",
    "A12",
    """SELECT DISTINCT prediction_date FROM trajectory WHERE prediction_date NOT IN
         (SELECT prediction_date FROM trajectory WHERE predicted_days > 60)""",
)
def _(spark, sf):
    runs = A.trajectory(spark, sf)
    plan = runs.select("prediction_date").distinct()
    return R.pending_dates(plan, runs.where("predicted_days > 60"))


@query(
    "scan_places",
    "A13",
    """SELECT place_id, date, air_temp_max_c, precip_total_mm FROM weather_daily
       WHERE date BETWEEN DATE '1998-03-01' AND DATE '1998-06-01'
         AND place_id IN (SELECT place_id FROM coverage WHERE location_id IS NOT NULL)""",
)
def _(spark, sf):
    places = A.coverage(spark, sf).where("location_id IS NOT NULL")
    weather = A.weather_daily(spark, sf).select(
        "place_id", "date", "air_temp_max_c", "precip_total_mm"
    )
    return R.scan_places(weather, places, "1998-03-01", "1998-06-01")


@query(
    "consolidate_weather",
    "A14",
    """SELECT loc, date, tmax AS air_temp_max_c, pull_id FROM (
         SELECT *, row_number() OVER (PARTITION BY loc, date ORDER BY pull_id DESC, pull_line DESC) AS rn
         FROM weather_rows) WHERE rn = 1""",
)
def _(spark, sf):
    pulls = A.weather_rows(spark, sf).select(
        "loc",
        "date",
        F.col("temperature_c_2_m_above_gnd_max").alias("air_temp_max_c"),
        "pull_id",
        "pull_line",
    )
    merged = R.consolidate_weather(
        pulls, ["air_temp_max_c"], [F.desc("pull_id"), F.desc("pull_line")]
    )
    return merged.drop("pull_line")


@query(
    "stride_sample",
    "A15",
    """SELECT o_orderkey, o_orderdate FROM (
         SELECT *, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS rn FROM orders)
       WHERE (rn - 1) % 7 = 0""",
)
def _(spark, sf):
    orders = A.table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return R.stride_sample(orders, ["o_orderdate", "o_orderkey"], 7)


# ---------------------------------------------------------------- events


@query(
    "normalize_label",
    "B1",
    """SELECT stage_name, lower(trim(regexp_replace(stage_name, '\\s+', ' ', 'g'))) AS label, count(*) AS n
       FROM raw_events GROUP BY stage_name""",
)
def _(spark, sf):
    from seasontide.functions.scalars import normalize_label

    return (
        A.raw_events(spark, sf)
        .groupBy("stage_name")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("stage_name", normalize_label(F.col("stage_name")).alias("label"), "n")
    )


@query(
    "canonicalize_events",
    "B2",
    """SELECT location_id, stage_date, stage_name_raw, raw_stage_id, stage_id, label_source,
              CASE stage_id WHEN 1 THEN 'Stage 1' WHEN 2 THEN 'Stage 2' ELSE 'Stage 3 / Phase 2' END AS stage_name
       FROM canon""",
)
def _(spark, sf):
    return canonical(spark, sf).select(
        "location_id",
        "stage_date",
        "stage_name_raw",
        "raw_stage_id",
        "stage_id",
        "label_source",
        "stage_name",
    )


@query(
    "canonicalize_observed_phase1",
    "B2",
    """SELECT CASE stage_id WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 4 THEN 4 ELSE 3 END AS stage_id,
              CASE stage_id WHEN 1 THEN 'observed_stage1' WHEN 2 THEN 'observed_stage2' WHEN 3 THEN 'observed_stage3'
                   WHEN 4 THEN 'observed_phase1' ELSE 'observed_phase2_as_stage3' END AS label_source,
              count(*) AS n
       FROM raw_events WHERE strftime(stage_date, '%m-%d') <> '12-31' GROUP BY ALL""",
)
def _(spark, sf):
    cfg = Settings(observed_phase1=True)
    events = B.canonicalize_events(R.type_events(A.raw_events(spark, sf)), cfg)
    return events.groupBy("stage_id", "label_source").agg(F.count(F.lit(1)).alias("n"))


@query(
    "drop_placeholders",
    "B3",
    """SELECT location_id, stage_id, stage_date FROM raw_events
       WHERE NOT (month(stage_date) = 12 AND day(stage_date) = 31)""",
)
def _(spark, sf):
    return B.drop_placeholders(
        A.raw_events(spark, sf).select("location_id", "stage_id", "stage_date")
    )


@query(
    "legacy_stage",
    "B4",
    """SELECT location_id, stage_date, CAST(right(stage_name, 1) AS INTEGER) AS stage_id
       FROM raw_events WHERE stage_name IN ('Stage 1', 'Stage 2', 'Stage 3', 'Stage 4', 'Stage 5')""",
)
def _(spark, sf):
    return B.legacy_stage(
        A.raw_events(spark, sf).select("location_id", "stage_date", "stage_id", "stage_name")
    )


def _manual(spark, sf):
    """Curated rows of the test: the first order of each region's nations."""
    return B.describe_curated(
        A.table(spark, sf, "nation")
        .join(A.table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col("r_name").alias("region"),
            F.concat(F.col("n_name"), F.lit(" Golf & Club!")).alias("location_name"),
            A.lat_of(F.col("n_nationkey")).alias("latitude"),
            A.lon_of(F.col("n_nationkey")).alias("longitude"),
            (F.col("n_nationkey") % 3 + 1).cast("int").alias("stage_id"),
            F.date_add(F.lit("1999-04-01").cast("date"), F.col("n_nationkey")).alias("stage_date"),
        )
    )


@query(
    "append_manual",
    "B5",
    """SELECT location_id, stage_id, stage_date, label_source, false AS is_manual_event,
              'observed' AS data_source, NULL::VARCHAR AS manual_event_id, NULL::VARCHAR AS region FROM canon
       UNION ALL
       SELECT loc, stage_id, stage_date, NULL, true, 'manual_curated', loc || '_stage_' || stage_id, r_name FROM (
         SELECT 'manual_' || trim(regexp_replace(lower(r_name), '[^a-z0-9]+', '_', 'g'), '_') || '_1999_'
                || trim(regexp_replace(lower(n_name || ' Golf & Club!'), '[^a-z0-9]+', '_', 'g'), '_') AS loc,
                CAST(n_nationkey % 3 + 1 AS INTEGER) AS stage_id,
                CAST(DATE '1999-04-01' + n_nationkey AS TIMESTAMP) AS stage_date, r_name
         FROM nation JOIN region ON n_regionkey = r_regionkey)""",
)
def _(spark, sf):
    return B.append_manual(canonical(spark, sf), _manual(spark, sf)).select(
        "location_id",
        "stage_id",
        "stage_date",
        "label_source",
        "is_manual_event",
        "data_source",
        "manual_event_id",
        "region",
    )


@query(
    "append_midpoint",
    "B6",
    """SELECT location_id, stage_date, stage_name_raw, stage_id, label_source, year, day_of_year,
              false AS is_derived_phase1, NULL::TIMESTAMP AS phase1_stage1_date,
              NULL::TIMESTAMP AS phase1_stage2_date FROM canon
       UNION ALL
       SELECT location_id, stage_date, stage_name_raw, stage_id, label_source, year, day_of_year,
              true, phase1_stage1_date, phase1_stage2_date FROM midpoints""",
)
def _(spark, sf):
    return B.append_midpoint(canonical(spark, sf)).select(
        "location_id",
        "stage_date",
        "stage_name_raw",
        "stage_id",
        "label_source",
        "year",
        "day_of_year",
        "is_derived_phase1",
        "phase1_stage1_date",
        "phase1_stage2_date",
    )


@query(
    "dedupe_events",
    "B7",
    "SELECT latitude, longitude, year, stage_id, location_id, stage_date, label_source FROM deduped",
)
def _(spark, sf):
    return B.dedupe_events(B.append_midpoint(canonical(spark, sf))).select(
        "latitude", "longitude", "year", "stage_id", "location_id", "stage_date", "label_source"
    )


@query(
    "exclude_locations",
    "B8",
    """SELECT location_id, stage_id, stage_date FROM canon
       WHERE location_id NOT IN (SELECT CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_acctbal < 1000)""",
)
def _(spark, sf):
    outliers = (
        A.table(spark, sf, "supplier")
        .where("s_acctbal < 1000")
        .select(F.col("s_suppkey").cast("string").alias("location_id"))
    )
    return B.exclude_locations(
        canonical(spark, sf).select("location_id", "stage_id", "stage_date"), outliers
    )


@query(
    "exclude_pairs",
    "B9",
    """SELECT location_id, year, stage_id, stage_date FROM canon c
       WHERE NOT EXISTS (SELECT 1 FROM raw_events r WHERE r.stage_id = 4
                         AND r.location_id = c.location_id AND year(r.stage_date) = c.year)""",
)
def _(spark, sf):
    bad = (
        R.type_events(A.raw_events(spark, sf))
        .where("stage_id = 4")
        .select("location_id", "year")
        .distinct()
    )
    kept = canonical(spark, sf).select("location_id", "year", "stage_id", "stage_date")
    return B.exclude_pairs(kept, bad)


@query(
    "season_filter",
    "B10",
    """SELECT location_id, stage_id, stage_date, day_of_year FROM canon
       WHERE day_of_year >= 60 AND day_of_year <= 152""",
)
def _(spark, sf):
    return B.season_filter(
        canonical(spark, sf).select("location_id", "stage_id", "stage_date", "day_of_year")
    )


@query(
    "prepare_events",
    "B11",
    """SELECT location_id, latitude, longitude, stage_id, stage_date, label_source, year, day_of_year FROM prepared""",
)
def _(spark, sf):
    return prepared(spark, sf).select(
        "location_id",
        "latitude",
        "longitude",
        "stage_id",
        "stage_date",
        "label_source",
        "year",
        "day_of_year",
    )


@query(
    "prepare_events_with_curated",
    "B11",
    """SELECT stage_id, year, count(*) AS n FROM prepared GROUP BY ALL
       UNION ALL SELECT * FROM (VALUES (1, 2025, 1), (2, 2025, 1), (3, 2025, 1), (4, 2025, 1),
                                       (1, 2026, 4), (2, 2026, 3), (3, 2026, 1), (4, 2026, 3))""",
)
def _(spark, sf):
    return (
        B.prepare_events(A.raw_events(spark, sf), "2026-12-31")
        .groupBy("stage_id", "year")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "prepare_event_export",
    "B12",
    """WITH m AS (SELECT 'manual_' || trim(regexp_replace(lower(r_name), '[^a-z0-9]+', '_', 'g'), '_') || '_1999_'
                || trim(regexp_replace(lower(n_name || ' Golf & Club!'), '[^a-z0-9]+', '_', 'g'), '_') AS location_id,
                CAST(n_nationkey % 3 + 1 AS INTEGER) AS stage_id,
                CAST(DATE '1999-04-01' + n_nationkey AS TIMESTAMP) AS stage_date
         FROM nation JOIN region ON n_regionkey = r_regionkey)
       SELECT location_id, stage_id, CAST(year(stage_date) AS INTEGER) AS event_year, min(stage_date) AS stage_date
       FROM (SELECT location_id, stage_id, stage_date FROM raw_events WHERE stage_id IN (1, 2, 3, 4)
             UNION ALL SELECT * FROM m) GROUP BY ALL""",
)
def _(spark, sf):
    export = R.read_event_export(A.raw_events(spark, sf).drop("stage_name"))
    merged = B.prepare_event_export(export, manual=_manual(spark, sf))
    return merged.select("location_id", "stage_id", "event_year", "stage_date")


@query(
    "normalize_actuals",
    "B13",
    """SELECT location_id, stage_id, year, CAST(min(stage_date) AS DATE) AS stage_date FROM canon
       WHERE year IN (1997, 1998, 1999) AND stage_id IN (1, 2) GROUP BY ALL""",
)
def _(spark, sf):
    actuals = B.normalize_actuals(canonical(spark, sf), [1997, 1998, 1999], [1, 2])
    return actuals.select("location_id", "stage_id", "year", "stage_date")


@query(
    "observed_phases",
    "B14",
    """SELECT location_id, stage_name, min(stage_date) AS stage_date FROM raw_events
       WHERE year(stage_date) = 1998 AND stage_name IN ('Phase 1', 'PHASE 2')
         AND strftime(stage_date, '%m-%d') <> '12-31' GROUP BY ALL""",
)
def _(spark, sf):
    phases = B.observed_phases(A.raw_events(spark, sf), 1998, ("Phase 1", "PHASE 2"))
    return phases.select("location_id", "stage_name", "stage_date")


@query(
    "add_output_names",
    "B15",
    """SELECT location_id, prediction_date, stage_id, stage_id AS model_stage_id,
              CASE stage_id WHEN 1 THEN 'stage_1' WHEN 4 THEN 'phase_1' WHEN 2 THEN 'stage_2' ELSE 'stage_3_phase_2' END AS output_event_id,
              CASE stage_id WHEN 1 THEN 'Stage 1' WHEN 4 THEN 'Phase 1' WHEN 2 THEN 'Stage 2' ELSE 'Stage 3 / Phase 2' END AS output_event_name,
              CASE stage_id WHEN 1 THEN 1 WHEN 4 THEN 2 WHEN 2 THEN 3 ELSE 4 END AS output_event_order
       FROM trajectory""",
)
def _(spark, sf):
    return B.add_output_names(
        A.trajectory(spark, sf).select("location_id", "prediction_date", "stage_id")
    )


@query(
    "derive_phase1",
    "B16",
    """WITH t AS (SELECT * FROM trajectory WHERE stage_id <> 4),
       p AS (SELECT prediction_date, location_id,
                    min(CASE WHEN stage_id = 1 THEN predicted_stage_date END) AS d1,
                    min(CASE WHEN stage_id = 2 THEN predicted_stage_date END) AS d2 FROM t GROUP BY ALL)
       SELECT prediction_date, location_id, stage_id, predicted_stage_date, predicted_days,
              false AS is_derived_event FROM t
       UNION ALL
       SELECT prediction_date, location_id, 4, d, CAST(d - prediction_date AS DOUBLE), true FROM (
         SELECT *, CAST(d1::TIMESTAMP + (d2::TIMESTAMP - d1::TIMESTAMP) / 2 AS DATE) AS d FROM p
         WHERE d1 IS NOT NULL AND d2 IS NOT NULL)""",
    rounds="predicted_days",
)
def _(spark, sf):
    frame = A.trajectory(spark, sf).where("stage_id <> 4")
    return B.derive_phase1(frame).select(
        "prediction_date",
        "location_id",
        "stage_id",
        "predicted_stage_date",
        "predicted_days",
        "is_derived_event",
    )


COVERAGE_SQL = """SELECT t.stage_id, count(p.stage_date) AS n_events,
              count(DISTINCT year(p.stage_date)) AS n_distinct_years,
              count(DISTINCT p.location_id) AS n_distinct_locations,
              DATE '1997-06-01' AS window_start, DATE '2000-06-01' AS cutoff_date{extra}
       FROM (VALUES (1), (4), (2), (3), (9)) t(stage_id)
       LEFT JOIN prepared p ON p.stage_id = t.stage_id
         AND p.stage_date >= DATE '1997-06-01' AND p.stage_date < DATE '2000-06-01'
       GROUP BY t.stage_id"""


@query("label_coverage", "B17", COVERAGE_SQL.format(extra=""))
def _(spark, sf):
    return B.label_coverage(prepared(spark, sf), "2000-06-01", 3, (1, 4, 2, 3, 9))


@query(
    "coverage_status",
    "B18",
    COVERAGE_SQL.format(
        extra=", count(p.stage_date) >= 20 AND count(DISTINCT year(p.stage_date)) >= 2 AS sufficient"
    ),
)
def _(spark, sf):
    coverage = B.label_coverage(prepared(spark, sf), "2000-06-01", 3, (1, 4, 2, 3, 9))
    return B.coverage_status(coverage)


@query(
    "label_counts",
    "B19",
    "SELECT stage_id, label_source, count(*) AS n_events FROM prepared GROUP BY ALL",
)
def _(spark, sf):
    return B.label_counts(prepared(spark, sf))
