"""Spatial and interval joins and data audits over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from seasontide.operators import audits as I
from seasontide.operators import spatial as C
from seasontide.plans import adapters as A
from seasontide.plans.feature_queries import located
from seasontide.plans.registry import query, scratch_dir
from seasontide.plans.source_queries import prepared


def requests(spark, sf):
    """One request per customer: a point and a date window."""
    key = F.col("c_custkey")
    start = F.date_add(F.lit("1996-01-01").cast("date"), (key * 17 % 1500).cast("int"))
    return A.table(spark, sf, "customer").select(
        key.cast("string").alias("loc"),
        (F.lit(35.0) + key * 31 % 1000 / 100.0).alias("latitude"),
        (F.lit(-92.0) + key * 57 % 2400 / 100.0).alias("longitude"),
        start.alias("start_date"),
        F.date_add(start, (key % 90).cast("int")).alias("end_date"),
    )


REQUESTS = """(SELECT CAST(c_custkey AS VARCHAR) AS loc, 35.0::DOUBLE + c_custkey * 31 % 1000 / 100.0::DOUBLE AS latitude,
       -92.0::DOUBLE + c_custkey * 57 % 2400 / 100.0::DOUBLE AS longitude,
       DATE '1996-01-01' + CAST(c_custkey * 17 % 1500 AS INTEGER) AS start_date,
       DATE '1996-01-01' + CAST(c_custkey * 17 % 1500 AS INTEGER) + CAST(c_custkey % 90 AS INTEGER) AS end_date
       FROM customer)"""
HAVERSINE = """2 * 6371.0088::DOUBLE * asin(sqrt(least(1.0::DOUBLE,
       pow(sin((radians({lat2}) - radians({lat1})) / 2), 2)
       + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin((radians({lon2}) - radians({lon1})) / 2), 2))))"""
KM = HAVERSINE.format(lat1="r.latitude", lon1="r.longitude", lat2="c.centroid_lat", lon2="c.centroid_lon")
NEAREST_KM = f"""(SELECT * FROM (SELECT r.loc, r.latitude AS input_lat, r.longitude AS input_lon, c.place_id,
       c.centroid_lat, c.centroid_lon, {KM} AS distance_km,
       row_number() OVER (PARTITION BY r.loc ORDER BY {KM}, c.place_id) AS rn
       FROM {REQUESTS} r, coverage c) WHERE rn = 1)"""


@query(
    "location_year_windows",
    "C1",
    """SELECT location_id, min(latitude) AS lat, min(longitude) AS lon, make_date(year, 3, 1) AS start_date,
              make_date(year, 6, 1) AS end_date, location_id || '__' || year AS location_year_key, year AS pull_year
       FROM prepared GROUP BY location_id, year""",
)
def _(spark, sf):
    return C.location_year_windows(prepared(spark, sf))


@query(
    "location_windows",
    "C2",
    """SELECT location_id, latitude AS lat, longitude AS lon, DATE '1998-03-01' AS start_date, DATE '1998-05-31' AS end_date,
              1998 AS pull_year, location_id || '__1998' AS location_year_key FROM locations""",
)
def _(spark, sf):
    return C.location_windows(A.locations(spark, sf), "1998-03-01", "1998-05-31")


def points(spark, sf):
    return requests(spark, sf).select(F.col("loc").alias("location_id"), "latitude", "longitude")


@query(
    "nearest_centroid",
    "C3",
    f"""SELECT location_id, place_id, distance_sq_deg FROM (
         SELECT r.loc AS location_id, c.place_id,
                pow(c.centroid_lat - r.latitude, 2) + pow(c.centroid_lon - r.longitude, 2) AS distance_sq_deg,
                row_number() OVER (PARTITION BY r.loc ORDER BY
                  pow(c.centroid_lat - r.latitude, 2) + pow(c.centroid_lon - r.longitude, 2), c.place_id) AS rn
         FROM {REQUESTS} r, coverage c) WHERE rn = 1""",
    rounds="distance_sq_deg",
)
def _(spark, sf):
    found = C.nearest_centroid(points(spark, sf), A.coverage(spark, sf))
    return found.select("location_id", "place_id", "distance_sq_deg")


@query(
    "remap_locations",
    "C3",
    f"""WITH m AS (SELECT loc, place_id FROM (
         SELECT r.loc, c.place_id, row_number() OVER (PARTITION BY r.loc ORDER BY
                  pow(c.centroid_lat - r.latitude, 2) + pow(c.centroid_lon - r.longitude, 2), c.place_id) AS rn
         FROM {REQUESTS} r, coverage c) WHERE rn = 1)
       SELECT w.place_id, count(DISTINCT w.date) AS n_days, count(DISTINCT m.loc) AS n_locations, count(*) AS n_rows
       FROM weather_daily w LEFT JOIN m ON w.place_id = m.place_id GROUP BY w.place_id""",
)
def _(spark, sf):
    mapping = C.nearest_centroid(points(spark, sf), A.coverage(spark, sf))
    weather = A.weather_daily(spark, sf).select("place_id", "date")
    return C.remap_locations(weather, mapping).groupBy("place_id").agg(
        F.countDistinct("date").alias("n_days"),
        F.countDistinct("location_id").alias("n_locations"),
        F.count(F.lit(1)).alias("n_rows"),
    )


@query(
    "nearest_haversine",
    "C4",
    f"SELECT loc, input_lat, input_lon, place_id, distance_km FROM {NEAREST_KM}",
    rounds="distance_km",
)
def _(spark, sf):
    found = C.nearest_haversine(requests(spark, sf), A.coverage(spark, sf))
    return found.select("loc", "input_lat", "input_lon", "place_id", "distance_km")


BOX_KM = HAVERSINE.format(lat1="r.latitude", lon1="r.longitude", lat2="w.centroid_lat", lon2="w.centroid_lon")


@query(
    "nearest_in_box",
    "C5",
    f"""SELECT point_id, date, place_id, air_temp_max_c, distance_km FROM (
         SELECT r.loc AS point_id, w.date, w.place_id, w.air_temp_max_c, {BOX_KM} AS distance_km,
                row_number() OVER (PARTITION BY r.loc, w.date ORDER BY {BOX_KM}, w.place_id) AS rn
         FROM {REQUESTS} r JOIN weather_daily w
           ON w.centroid_lat BETWEEN r.latitude - 0.5 AND r.latitude + 0.5
          AND w.centroid_lon BETWEEN r.longitude - 0.5 AND r.longitude + 0.5
         WHERE w.date BETWEEN DATE '1998-04-01' AND DATE '1998-04-30') WHERE rn = 1""",
    rounds="distance_km",
)
def _(spark, sf):
    wanted = requests(spark, sf).select(F.col("loc").alias("point_id"), "latitude", "longitude")
    weather = A.weather_daily(spark, sf).select(
        "place_id", "centroid_lat", "centroid_lon", "date", "air_temp_max_c"
    )
    found = C.nearest_in_box(wanted, weather, "1998-04-01", "1998-04-30")
    return found.select("point_id", "date", "place_id", "air_temp_max_c", "distance_km")


@query(
    "locate_in_cells",
    "C6",
    f"""SELECT r.loc AS location_id, l.place_id FROM {REQUESTS} r LEFT JOIN locations l
        ON r.longitude > round(l.longitude - 0.05::DOUBLE, 4) AND r.longitude < round(l.longitude + 0.05::DOUBLE, 4)
       AND r.latitude > round(l.latitude - 0.05::DOUBLE, 4) AND r.latitude < round(l.latitude + 0.05::DOUBLE, 4)""",
)
def _(spark, sf):
    found = C.locate_in_cells(points(spark, sf), A.cells(spark, sf))
    return found.select("location_id", "place_id")


@query(
    "trim_to_windows",
    "C7",
    """SELECT location_id, date FROM located l WHERE EXISTS (SELECT 1 FROM prepared p
         WHERE p.location_id = l.location_id AND p.year = year(l.date))
         AND date BETWEEN make_date(year(date), 3, 1) AND make_date(year(date), 6, 1)""",
)
def _(spark, sf):
    windows = C.location_year_windows(prepared(spark, sf))
    return C.trim_to_windows(located(spark, sf).select("location_id", "date"), windows)


def strict(spark, sf):
    wanted = requests(spark, sf)
    loc_map = C.nearest_haversine(wanted, A.coverage(spark, sf))
    weather = A.weather_daily(spark, sf).select("place_id", "date", "air_temp_max_c")
    windows = wanted.select("loc", "start_date", "end_date")
    return C.interval_join(weather, windows, loc_map), loc_map


STRICT = f"""(SELECT w.place_id, w.date, w.air_temp_max_c, r.loc, r.start_date, r.end_date, m.distance_km
       FROM {REQUESTS} r JOIN {NEAREST_KM} m ON m.loc = r.loc
       JOIN weather_daily w ON w.place_id = m.place_id AND w.date BETWEEN r.start_date AND r.end_date)"""


@query(
    "interval_join",
    "C8",
    f"SELECT place_id, date, air_temp_max_c, loc, start_date, end_date, distance_km FROM {STRICT}",
    rounds="distance_km",
)
def _(spark, sf):
    joined, _ = strict(spark, sf)
    return joined.select(
        "place_id", "date", "air_temp_max_c", "loc", "start_date", "end_date", "distance_km"
    )


@query(
    "request_summary",
    "C9",
    f"""SELECT loc, count(*) AS n_rows, min(date) AS min_date, max(date) AS max_date,
              count(DISTINCT place_id) AS n_place_ids, min(place_id) AS place_id FROM {STRICT} GROUP BY loc""",
)
def _(spark, sf):
    joined, loc_map = strict(spark, sf)
    return C.request_summary(joined, loc_map).select(
        "loc", "n_rows", "min_date", "max_date", "n_place_ids", "place_id"
    )


def custom(spark, sf):
    return requests(spark, sf).select(F.col("loc").alias("name"), "latitude", "longitude")


CUSTOM = f"""(SELECT input_name, input_latitude, input_longitude, place_id, centroid_lat, centroid_lon,
         source_location_id, coalesce(source_location_id, printf('custom_gridpoint_%09.5f_%010.5f', centroid_lat, centroid_lon)) AS location_id,
         coalesce(slat, centroid_lat) AS latitude, coalesce(slon, centroid_lon) AS longitude FROM (
       SELECT r.loc AS input_name, r.latitude AS input_latitude, r.longitude AS input_longitude, c.place_id,
              c.centroid_lat, c.centroid_lon, c.location_id AS source_location_id, c.latitude AS slat, c.longitude AS slon,
              row_number() OVER (PARTITION BY r.loc ORDER BY
                pow(c.centroid_lat - r.latitude, 2) + pow(c.centroid_lon - r.longitude, 2), c.place_id) AS rn
       FROM {REQUESTS} r, coverage c) WHERE rn = 1)"""


@query(
    "map_custom_points",
    "C10",
    f"""SELECT input_name, place_id, source_location_id, location_id, latitude, longitude FROM {CUSTOM}""",
)
def _(spark, sf):
    mapped = C.map_custom_points(custom(spark, sf), A.coverage(spark, sf))
    return mapped.select(
        "input_name", "place_id", "source_location_id", "location_id", "latitude", "longitude"
    )


@query(
    "resolve_scope",
    "C11",
    f"""SELECT location_id, min(place_id) AS place_id, min(latitude) AS latitude, min(longitude) AS longitude FROM (
         SELECT location_id, place_id, latitude, longitude FROM coverage
         WHERE location_id IN (SELECT location_id FROM prepared WHERE stage_id = 1)
         UNION ALL SELECT location_id, place_id, latitude, longitude FROM {CUSTOM})
       WHERE location_id IS NOT NULL GROUP BY location_id""",
)
def _(spark, sf):
    cover = A.coverage(spark, sf)
    ids = prepared(spark, sf).where("stage_id = 1").select("location_id").distinct()
    scope = C.resolve_scope(cover, ids, C.map_custom_points(custom(spark, sf), cover))
    return scope.select("location_id", "place_id", "latitude", "longitude")


@query(
    "normalize_weather",
    "C12",
    """SELECT location_id, date, CAST(tmax AS VARCHAR) AS air_temp_max_c, hum AS humidity_mean_pct FROM weather_rows""",
)
def _(spark, sf):
    return C.normalize_weather(A.weather_rows(spark, sf))


@query(
    "grid_points",
    "C13",
    """SELECT DISTINCT place_id, centroid_lat, centroid_lon FROM weather_daily WHERE date = DATE '1998-05-05'""",
)
def _(spark, sf):
    return C.grid_points(A.weather_daily(spark, sf), "1998-05-05")


@query(
    "band_coverage",
    "C14",
    """SELECT place_id, centroid_lat, state_code,
              CASE WHEN centroid_lat < 37 THEN '35-37N' WHEN centroid_lat < 39 THEN '37-39N'
                   WHEN centroid_lat < 40 THEN '39-40N' ELSE '40-42N' END AS lat_band
       FROM coverage WHERE centroid_lat >= 33 AND centroid_lat < 42
         AND state_code IN ('1', '2', '3', '4', '5', '6', '7', '8', '9', '10', '11', '12', '13', '14', '15')""",
)
def _(spark, sf):
    states = [str(i) for i in range(1, 16)]
    found = C.band_coverage(A.coverage(spark, sf), states)
    return found.select("place_id", "centroid_lat", "state_code", "lat_band")


@query(
    "enrich_weather",
    "C15",
    """SELECT w.place_id, w.date, w.centroid_lat, c.location_id, c.state_code
       FROM weather_daily w JOIN coverage c ON w.place_id = c.place_id""",
)
def _(spark, sf):
    weather = A.weather_daily(spark, sf).select("place_id", "date", "centroid_lat")
    enriched = C.enrich_weather(weather, A.coverage(spark, sf))
    return enriched.select("place_id", "date", "centroid_lat", "location_id", "state_code")


# ---------------------------------------------------------------- audits


def index(spark, sf):
    return I.normalize_index(A.cache_index(spark, sf))


@query(
    "date_gaps",
    "I1",
    """SELECT i.place_id, i.start_date, i.end_date, CAST(i.end_date - i.start_date + 1 AS INTEGER) AS expected_dates,
              (SELECT count(*) FROM weather_daily w WHERE w.place_id = i.place_id) AS actual_dates,
              m.missing_count, m.missing_dates
       FROM cache_index i JOIN (
         SELECT place_id, start_date, end_date, count(d) AS missing_count,
                coalesce(string_agg(CAST(d AS VARCHAR), ',' ORDER BY d), '') AS missing_dates
         FROM (SELECT c.*, e.d FROM cache_index c LEFT JOIN (
                 SELECT c2.place_id, c2.start_date, CAST(x.d AS DATE) AS d
                 FROM cache_index c2, range(c2.start_date, c2.end_date + INTERVAL 1 DAY, INTERVAL 1 DAY) x(d)
                 WHERE NOT EXISTS (SELECT 1 FROM weather_daily w WHERE w.place_id = c2.place_id AND w.date = CAST(x.d AS DATE))) e
               ON e.place_id = c.place_id AND e.start_date = c.start_date)
         GROUP BY place_id, start_date, end_date) m
       ON m.place_id = i.place_id AND m.start_date = i.start_date""",
)
def _(spark, sf):
    gaps = I.date_gaps(A.weather_daily(spark, sf), index(spark, sf))
    listed = F.array_join(F.col("missing_dates").cast("array<string>"), ",")
    return gaps.withColumn("missing_dates", listed)


@query(
    "unindexed_places",
    "I2",
    "SELECT DISTINCT place_id FROM weather_daily WHERE place_id NOT IN (SELECT place_id FROM cache_index)",
)
def _(spark, sf):
    return I.unindexed(A.weather_daily(spark, sf), index(spark, sf))


@query("normalize_index", "I3", "SELECT place_id, start_date, end_date FROM cache_index")
def _(spark, sf):
    return index(spark, sf)


@query("date_segments", "I4", "SELECT place_id, start_date, end_date, n_days FROM islands")
def _(spark, sf):
    return I.date_segments(A.weather_daily(spark, sf))


@query(
    "segment_report",
    "I5",
    """SELECT place_id, count(*) AS n_segments, CAST(sum(n_days) AS BIGINT) AS n_days, min(start_date) AS start_date,
              max(end_date) AS end_date, count(*) > 1 AS needs_split FROM islands GROUP BY place_id""",
)
def _(spark, sf):
    return I.segment_report(A.weather_daily(spark, sf))


@query(
    "segment_index",
    "I5",
    """SELECT place_id, strftime(start_date, '%Y%m%d') AS start_compact, strftime(end_date, '%Y%m%d') AS end_compact,
              'cache/' || place_id || '_' || strftime(start_date, '%Y%m%d') || '_' || strftime(end_date, '%Y%m%d') AS key
       FROM islands""",
)
def _(spark, sf):
    return I.compact_segments(A.weather_daily(spark, sf), scratch_dir(spark))


@query(
    "index_summary",
    "I6",
    """SELECT count(*) AS n_rows, count(DISTINCT place_id) AS n_places, min(start_date) AS min_start,
              max(end_date) AS max_end FROM cache_index""",
)
def _(spark, sf):
    return I.index_summary(index(spark, sf))


@query(
    "check_features",
    "I7",
    """SELECT count(*) AS n_rows, 0::BIGINT AS bad_date, count_if(latitude IS NULL)::BIGINT AS bad_latitude,
              count_if(longitude IS NULL)::BIGINT AS bad_longitude, count_if(hum IS NULL)::BIGINT AS bad_humidity,
              count(*) - count(DISTINCT (date, location_id)) AS duplicate_rows
       FROM (SELECT w.*, c.latitude, c.longitude, CASE WHEN hum > 0.05 THEN hum END AS hum FROM
             (SELECT * EXCLUDE (hum), CASE WHEN hum > 0.05 THEN hum END AS hum FROM weather_rows) w
             JOIN coverage c ON c.place_id = 'grid_' || w.location_id)""",
)
def _(spark, sf):
    value = F.col("relative_humidity_pct_2_m_above_gnd_avg")
    rows = A.weather_rows(spark, sf).select(
        "date",
        "location_id",
        F.concat(F.lit("grid_"), F.col("location_id")).alias("place_id"),
        F.when(value > 0.05, value.cast("string")).otherwise("bad").alias("humidity"),
    )
    cover = A.coverage(spark, sf).select("place_id", "latitude", "longitude")
    return I.check_features(rows.join(cover, "place_id"), ["humidity"])


@query(
    "check_inference",
    "I8",
    """SELECT count(*) AS n_rows, 0::BIGINT AS bad_dates, 0::BIGINT AS bad_stage_ids,
              count_if(stage_id NOT IN (1, 4, 2))::BIGINT AS unknown_targets,
              count_if(predicted_days = 0)::BIGINT AS bad_value FROM trajectory""",
)
def _(spark, sf):
    rows = A.trajectory(spark, sf).withColumn(
        "value", F.when(F.col("predicted_days") != 0, F.col("predicted_days"))
    )
    return I.check_inference(rows, ["stage_id", "value"], (1, 4, 2))


@query(
    "event_range",
    "I9",
    """SELECT count(*) AS n_events, CAST(min(stage_date) AS DATE) AS min_date, CAST(max(stage_date) AS DATE) AS max_date,
              CAST(date_diff('day', min(stage_date), max(stage_date)) AS INTEGER) AS span_days FROM prepared""",
)
def _(spark, sf):
    return I.event_range(prepared(spark, sf))


@query("events_per_year", "I9", "SELECT year, count(*) AS n_events FROM prepared GROUP BY year")
def _(spark, sf):
    return I.events_per_year(prepared(spark, sf))


@query(
    "mapping_report",
    "I10",
    """SELECT count(*) AS n_rows, count(c.location_id) AS n_mapped, count(DISTINCT c.location_id) AS n_locations
       FROM weather_daily w LEFT JOIN coverage c ON w.place_id = c.place_id""",
)
def _(spark, sf):
    mapped = A.coverage(spark, sf).where("location_id IS NOT NULL")
    return I.mapping_report(C.remap_locations(A.weather_daily(spark, sf).select("place_id"), mapped))


def label_pair(spark, sf):
    """Delivered labels: two in five arrive with day and month swapped, the others a day late or right."""
    day, stage = F.to_date("stage_date"), F.col("stage_id")
    swapped = F.when(
        F.dayofmonth(day) <= 12, F.make_date(F.year(day), F.dayofmonth(day), F.month(day))
    ).otherwise(day)
    delivered = F.when(stage <= 2, swapped).when(stage == 3, F.date_add(day, 1)).otherwise(day)
    raw = A.raw_events(spark, sf)
    left = raw.select(
        "location_id",
        "stage_id",
        delivered.alias("stage_date"),
        F.concat(F.lit("file_"), F.year(day).cast("string")).alias("source_file"),
    )
    return left, raw.select("location_id", "stage_id", "stage_date")


RECONCILED = """(WITH k AS (SELECT DISTINCT location_id, stage_id, CAST(stage_date AS DATE) AS d FROM raw_events),
       l AS (SELECT DISTINCT location_id, stage_id, 'file_' || year(stage_date) AS source_file,
               CASE WHEN stage_id <= 2 AND day(stage_date) <= 12 THEN make_date(year(stage_date), day(stage_date), month(stage_date))
                    WHEN stage_id = 3 THEN CAST(stage_date AS DATE) + 1 ELSE CAST(stage_date AS DATE) END AS stage_day FROM raw_events)
       SELECT l.*, CASE
         WHEN EXISTS (SELECT 1 FROM k WHERE k.location_id = l.location_id AND k.stage_id = l.stage_id AND k.d = l.stage_day) THEN 'exact'
         WHEN day(stage_day) <= 12 AND day(stage_day) <> month(stage_day) AND EXISTS (SELECT 1 FROM k WHERE
              k.location_id = l.location_id AND k.stage_id = l.stage_id AND month(k.d) = day(l.stage_day)
              AND day(k.d) = month(l.stage_day) AND year(k.d) = year(l.stage_day)) THEN 'month_day_swap'
         ELSE 'unresolved' END AS status FROM l)"""


@query(
    "reconcile_labels",
    "I11",
    f"SELECT location_id, stage_id, stage_day, source_file, status FROM {RECONCILED}",
)
def _(spark, sf):
    return I.reconcile_labels(*label_pair(spark, sf))


@query(
    "reconciliation_counts",
    "I11",
    f"""SELECT source_file, count(*) AS n_labels, count(CASE WHEN status = 'exact' THEN 1 END) AS n_exact,
              count(CASE WHEN status = 'month_day_swap' THEN 1 END) AS n_month_day_swap,
              count(CASE WHEN status = 'unresolved' THEN 1 END) AS n_unresolved FROM {RECONCILED} GROUP BY source_file""",
)
def _(spark, sf):
    return I.reconciliation_counts(I.reconcile_labels(*label_pair(spark, sf)))
