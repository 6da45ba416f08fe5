"""Features, training frames and termination over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from seasontide.config import Settings
from seasontide.operators import features as D
from seasontide.operators import frames as E
from seasontide.operators import termination as G
from seasontide.plans import adapters as A
from seasontide.plans.registry import query
from seasontide.plans.source_queries import prepared

TEST_DATE = "1999-06-01"
MATRIX_FEATURES = ("cumu_gdd_air", "rolling_gdd_air")
KEYS = "date location_id pest_year stage_id".split()


def steady(name):
    """Rounded to 3 digits; the small shift keeps exact ties off the rounding edge."""
    return F.round(F.col(name) + 0.0002, 3) + 0.0


def features(spark, sf, dates=None):
    return D.engineer_features(A.weather_daily(spark, sf), dates=dates)


def located(spark, sf, dates=None):
    return D.engineer_features(
        A.weather_daily(spark, sf), mode="train", mapping=A.locations(spark, sf), dates=dates
    )


@query("unify_coords", "D1", "SELECT place_id, date, latitude, longitude, precip_total_mm FROM feat0")
def _(spark, sf):
    return D.unify_coords(A.weather_daily(spark, sf)).select(
        "place_id", "date", "latitude", "longitude", "precip_total_mm"
    )


@query(
    "celsius_to_fahrenheit",
    "D2",
    "SELECT place_id, date, air_temp_max_f, air_temp_min_f FROM feat0",
    rounds="air_temp_max_f air_temp_min_f",
)
def _(spark, sf):
    return D.add_temperatures(A.weather_daily(spark, sf)).select(
        "place_id", "date", "air_temp_max_f", "air_temp_min_f"
    )


@query(
    "growing_degree_days",
    "D3",
    "SELECT place_id, date, gdd_air FROM feat1",
    rounds="gdd_air",
)
def _(spark, sf):
    df = D.add_degree_days(D.add_temperatures(A.weather_daily(spark, sf)))
    return df.select("place_id", "date", "gdd_air")


@query("cold_degree_days", "D4", "SELECT place_id, date, cdd_air FROM feat1", rounds="cdd_air")
def _(spark, sf):
    df = D.add_degree_days(D.add_temperatures(A.weather_daily(spark, sf)))
    return df.select("place_id", "date", "cdd_air")


@query("day_of_year", "D5", "SELECT place_id, date, doy FROM feat0")
def _(spark, sf):
    return D.add_calendar(A.weather_daily(spark, sf)).select("place_id", "date", "doy")


@query(
    "season_year",
    "D6",
    """SELECT date, CAST(CASE WHEN date < make_date(year(date), 3, 1) THEN year(date) - 1 ELSE year(date) END AS INTEGER) AS pest_year,
              count(*) AS n FROM weather_daily GROUP BY date""",
)
def _(spark, sf):
    season = D.add_calendar(A.weather_daily(spark, sf))
    return season.groupBy("date", "pest_year").agg(F.count(F.lit(1)).alias("n"))


@query(
    "season_cumulative",
    "D7",
    """SELECT place_id, date, cumu_gdd_air, cumu_precip_total_mm, cumu_humidity_mean_pct, cumu_cdd_air FROM features""",
    rounds="cumu_gdd_air cumu_precip_total_mm cumu_humidity_mean_pct cumu_cdd_air",
)
def _(spark, sf):
    base = D.add_calendar(
        D.add_degree_days(D.add_temperatures(D.unify_coords(A.weather_daily(spark, sf))))
    )
    cols = [f"cumu_{m}" for m in ("gdd_air", "precip_total_mm", "humidity_mean_pct", "cdd_air")]
    return D.season_cumulative(base).select("place_id", "date", *cols)


@query(
    "season_rolling",
    "D8",
    """SELECT place_id, date, avg(gdd_air) OVER r AS rolling_gdd_air, avg(precip_total_mm) OVER r AS rolling_precip_total_mm
       FROM feat1 WINDOW r AS (PARTITION BY pest_year, place_id ORDER BY date ROWS 6 PRECEDING)""",
    rounds="rolling_gdd_air rolling_precip_total_mm",
)
def _(spark, sf):
    base = D.add_calendar(
        D.add_degree_days(D.add_temperatures(D.unify_coords(A.weather_daily(spark, sf))))
    )
    return D.season_rolling(base, 7, ["gdd_air", "precip_total_mm"]).select(
        "place_id", "date", "rolling_gdd_air", "rolling_precip_total_mm"
    )


@query(
    "dedupe_weather",
    "D9",
    """SELECT location_id, date, pull_id, pull_line FROM (
         SELECT *, row_number() OVER (PARTITION BY date, location_id ORDER BY pull_id, pull_line) AS rn FROM weather_rows)
       WHERE rn = 1""",
)
def _(spark, sf):
    rows = A.weather_rows(spark, sf).select("location_id", "date", "pull_id", "pull_line")
    return D.dedupe_weather(rows, order=["pull_id", "pull_line"])


@query(
    "weather_compression",
    "D9",
    """SELECT count(*) AS rows_before, count(DISTINCT (date, location_id)) AS rows_after,
              count(*) / count(DISTINCT (date, location_id)) AS compression FROM weather_rows""",
    rounds="compression",
)
def _(spark, sf):
    return D.compression(A.weather_rows(spark, sf))


@query(
    "attach_locations",
    "D10",
    """SELECT w.place_id, w.date, c.location_id FROM weather_daily w
       JOIN coverage c ON w.place_id = c.place_id WHERE c.location_id IS NOT NULL""",
)
def _(spark, sf):
    weather = A.weather_daily(spark, sf).select("place_id", "date")
    return D.attach_locations(weather, A.coverage(spark, sf))


@query(
    "engineer_features",
    "D11",
    """SELECT location_id, place_id, date, latitude, longitude, doy, pest_year, gdd_air, cdd_air,
              cumu_gdd_air, cumu_precip_total_mm, cumu_cdd_air, rolling_gdd_air, rolling_humidity_mean_pct,
              rolling_cdd_air FROM located""",
    rounds="gdd_air cdd_air cumu_gdd_air cumu_precip_total_mm cumu_cdd_air rolling_gdd_air"
    " rolling_humidity_mean_pct rolling_cdd_air",
)
def _(spark, sf):
    return located(spark, sf).select(
        "location_id",
        "place_id",
        "date",
        "latitude",
        "longitude",
        "doy",
        "pest_year",
        "gdd_air",
        "cdd_air",
        "cumu_gdd_air",
        "cumu_precip_total_mm",
        "cumu_cdd_air",
        "rolling_gdd_air",
        "rolling_humidity_mean_pct",
        "rolling_cdd_air",
    )


# ---------------------------------------------------------------- frames


@query(
    "forward_asof",
    "E1",
    "SELECT date, location_id, pest_year, stage_id, stage_date, day_of_year FROM nextev",
)
def _(spark, sf):
    return E.forward_asof(located(spark, sf), prepared(spark, sf)).select(
        *KEYS, "stage_date", "day_of_year"
    )


@query(
    "coalesce_coords",
    "E2",
    """SELECT date, location_id, pest_year, stage_id, event_latitude AS latitude, event_longitude AS longitude FROM nextev""",
)
def _(spark, sf):
    frame = E.coalesce_coords(E.forward_asof(located(spark, sf), prepared(spark, sf)))
    return frame.select(*KEYS, "latitude", "longitude")


@query(
    "training_window",
    "E3",
    """SELECT place_id, date FROM weather_daily WHERE date >= DATE '1996-06-01' AND date < DATE '1999-06-01'""",
)
def _(spark, sf):
    weather = A.weather_daily(spark, sf).select("place_id", "date")
    return E.training_window(weather, TEST_DATE, 3)


@query(
    "training_window_legacy",
    "E3",
    """SELECT place_id, date FROM weather_daily WHERE date >= DATE '1997-03-01' AND date <= DATE '1999-06-01'""",
)
def _(spark, sf):
    weather = A.weather_daily(spark, sf).select("place_id", "date")
    return E.training_window(weather, TEST_DATE, None, True, "1997-03-01")


@query(
    "signed_target",
    "E4",
    """SELECT date, location_id, pest_year, stage_id, CAST(day_of_year - doy AS INTEGER) AS signed_days_to_event,
              greatest(CAST(day_of_year - doy AS INTEGER), 0) AS days_to_event FROM nextev""",
)
def _(spark, sf):
    frame = E.signed_target(E.forward_asof(located(spark, sf), prepared(spark, sf)))
    return frame.select(*KEYS, "signed_days_to_event", "days_to_event")


@query(
    "post_event_rows",
    "E5",
    """SELECT date, location_id, pest_year, stage_id, stage_date, signed_days_to_event, 0 AS days_to_event FROM (
         SELECT *, row_number() OVER (PARTITION BY date, location_id, pest_year, stage_id ORDER BY stage_date) AS rn
         FROM postrows) WHERE rn = 1""",
)
def _(spark, sf):
    rows = E.post_event_rows(located(spark, sf), prepared(spark, sf), 10)
    return rows.select(*KEYS, "stage_date", "signed_days_to_event", "days_to_event")


@query(
    "augment_training_rows",
    "E6",
    """SELECT date, location_id, pest_year, stage_id, signed_days_to_event FROM (
         SELECT *, row_number() OVER (PARTITION BY date, location_id, pest_year, stage_id ORDER BY r, stage_date) AS rn FROM (
           SELECT date, location_id, pest_year, stage_id, stage_date, CAST(day_of_year - doy AS INTEGER) AS signed_days_to_event, 1 AS r FROM nextev
           UNION ALL SELECT date, location_id, pest_year, stage_id, stage_date, signed_days_to_event, 0 FROM postrows))
       WHERE rn = 1""",
)
def _(spark, sf):
    weather, events = located(spark, sf), prepared(spark, sf)
    base = E.signed_target(E.coalesce_coords(E.forward_asof(weather, events)))
    both = E.augment(base, E.post_event_rows(weather, events, 10))
    return both.select(*KEYS, "signed_days_to_event")


def matrix(spark, sf):
    return E.training_matrix(
        prepared(spark, sf), located(spark, sf), TEST_DATE, features=MATRIX_FEATURES
    )


@query(
    "training_matrix",
    "E7",
    """SELECT date, location_id, pest_year, stage_id, signed_days_to_event, latitude, longitude, cumu_gdd_air, rolling_gdd_air FROM matrix""",
    rounds="cumu_gdd_air rolling_gdd_air",
)
def _(spark, sf):
    return matrix(spark, sf).select(
        *KEYS, "signed_days_to_event", "latitude", "longitude", "cumu_gdd_air", "rolling_gdd_air"
    )


@query(
    "training_matrix_summary",
    "E7",
    """SELECT pest_year, stage_id, count(*) AS n_rows, avg(signed_days_to_event) AS mean_days,
              quantile_cont(signed_days_to_event, 0.9) AS p90_days FROM matrix GROUP BY pest_year, stage_id""",
    rounds="mean_days p90_days",
)
def _(spark, sf):
    days = F.col("signed_days_to_event")
    return (
        matrix(spark, sf)
        .groupBy("pest_year", "stage_id")
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.avg(days).alias("mean_days"),
            F.percentile(days.cast("int"), F.lit(0.9)).alias("p90_days"),
        )
    )


@query(
    "training_matrix_local",
    "E8",
    """SELECT w.date, w.location_id, e.stage_id,
              CAST(floor(epoch(e.stage_date - w.date::TIMESTAMP) / 86400.0) AS DOUBLE) AS signed_days_to_event
       FROM located w JOIN prepared e ON w.location_id = e.location_id AND year(w.date) = e.year
        AND w.date <= e.stage_date + INTERVAL 10 DAY
       WHERE e.stage_date >= DATE '1996-06-01' AND e.stage_date < DATE '1999-06-01'""",
)
def _(spark, sf):
    rows = E.training_matrix_local(
        prepared(spark, sf), located(spark, sf), TEST_DATE, features=MATRIX_FEATURES
    )
    return rows.select("date", "location_id", "stage_id", "signed_days_to_event")


@query(
    "aligned_window",
    "E9",
    "SELECT place_id, date FROM weather_daily WHERE date BETWEEN DATE '1997-06-01' AND DATE '1999-06-01'",
)
def _(spark, sf):
    return E.aligned_window(A.weather_daily(spark, sf).select("place_id", "date"), TEST_DATE, 2)


@query(
    "expand_stages",
    "E10",
    """SELECT place_id, date, stage_id, doy, cumu_gdd_air, latitude, longitude
       FROM features, (VALUES (1), (4), (2), (3)) s(stage_id)
       WHERE date BETWEEN DATE '1998-04-01' AND DATE '1998-05-31'""",
    rounds="cumu_gdd_air",
)
def _(spark, sf):
    return E.expand_stages(
        features(spark, sf, ("1998-04-01", "1998-05-31")),
        "1998-04-01",
        "1998-05-31",
        features=("stage_id", "doy", "cumu_gdd_air")
    )


@query(
    "build_trajectory",
    "E11",
    """SELECT location_id, date, stage_id, doy FROM located, (VALUES (1), (4), (2), (3)) s(stage_id)
       WHERE year(date) = 1998 AND date <= DATE '1998-06-30'
         AND location_id IN (SELECT location_id FROM prepared WHERE year = 1998)""",
)
def _(spark, sf):
    frame = E.build_trajectory(
        located(spark, sf, ("1998-01-01", "1998-06-30")), prepared(spark, sf), 1998
    )
    return frame.select("location_id", "date", "stage_id", "doy")


@query(
    "restrict_to_plan",
    "E12",
    """SELECT location_id, date, place_id FROM located l WHERE EXISTS (
         SELECT 1 FROM prepared p WHERE p.location_id = l.location_id AND CAST(p.stage_date AS DATE) - 7 = l.date)""",
)
def _(spark, sf):
    plan = prepared(spark, sf).select(
        F.date_sub(F.to_date("stage_date"), 7).alias("prediction_date"), "location_id"
    )
    rows = located(spark, sf).select("location_id", "date", "place_id")
    return E.restrict_to_plan(rows, plan)


# ---------------------------------------------------------------- termination

TRACK = "location_id stage_id prediction_date".split()


def signal(spark, sf):
    return G.trajectory_signal(A.trajectory(spark, sf))


@query(
    "trajectory_signal",
    "G1",
    """SELECT location_id, stage_id, prediction_date, signal, pdoy AS prediction_day_of_year,
              latitude AS feature_latitude, longitude AS feature_longitude, CAST(stage_id AS VARCHAR) AS stage FROM signal""",
)
def _(spark, sf):
    return signal(spark, sf).select(
        *TRACK, "signal", "prediction_day_of_year", "feature_latitude", "feature_longitude", "stage"
    )


@query(
    "trajectory_key",
    "G2",
    "SELECT stage_id, trajectory_year, location_id, count(*) AS n_rows FROM trajectory GROUP BY ALL",
)
def _(spark, sf):
    frame = signal(spark, sf)
    return frame.groupBy(*G.trajectory_key(frame)).agg(F.count(F.lit(1)).alias("n_rows"))


@query(
    "trajectory_lags",
    "G3",
    "SELECT location_id, stage_id, prediction_date, signal_lag1, signal_lag2, signal_lag3 FROM lagged",
)
def _(spark, sf):
    return G.add_lags(signal(spark, sf)).select(*TRACK, "signal_lag1", "signal_lag2", "signal_lag3")


@query(
    "trajectory_slopes",
    "G4",
    """SELECT location_id, stage_id, prediction_date, signal - signal_lag1 AS slope_1,
              signal_lag1 - signal_lag2 AS slope_2, signal_lag2 - signal_lag3 AS slope_3 FROM lagged""",
    rounds="slope_1 slope_2 slope_3",
)
def _(spark, sf):
    frame = G.add_slopes(G.add_lags(signal(spark, sf)))
    return frame.select(*TRACK, "slope_1", "slope_2", "slope_3")


@query(
    "trajectory_recent",
    "G5",
    """SELECT location_id, stage_id, prediction_date, avg(signal) OVER w AS recent_mean_3,
              CASE WHEN count(signal) OVER w >= 2 THEN stddev_samp(signal) OVER w END AS recent_std_3,
              min(signal) OVER w AS recent_min_3, max(signal) OVER w AS recent_max_3
       FROM signal WINDOW w AS (PARTITION BY trajectory_year, location_id, stage_id ORDER BY prediction_date
                                ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)""",
    rounds="recent_mean_3 recent_std_3",
)
def _(spark, sf):
    return G.add_recent(signal(spark, sf)).select(
        *TRACK, "recent_mean_3", "recent_std_3", "recent_min_3", "recent_max_3"
    )


@query(
    "linear_crossing",
    "G6",
    """SELECT location_id, stage_id, prediction_date, round(crossing_0 + 0.0002::DOUBLE, 3) + 0.0 AS crossing_0,
              round(crossing_m05 + 0.0002::DOUBLE, 3) + 0.0 AS crossing_m05 FROM crossed""",
)
def _(spark, sf):
    frame = G.linear_crossing(signal(spark, sf), 0.0, "crossing_0")
    frame = G.linear_crossing(frame, -0.5, "crossing_m05")
    return frame.select(
        *TRACK,
        steady("crossing_0").alias("crossing_0"),
        steady("crossing_m05").alias("crossing_m05"),
    )


@query(
    "forward_fill",
    "G8",
    """SELECT location_id, stage_id, prediction_date,
              last_value(CASE WHEN raw_signed_days < 10 THEN raw_signed_days END IGNORE NULLS) OVER
                (PARTITION BY trajectory_year, location_id, stage_id ORDER BY prediction_date
                 ROWS UNBOUNDED PRECEDING) AS seen FROM trajectory""",
)
def _(spark, sf):
    frame = A.trajectory(spark, sf).withColumn(
        "seen", F.when(F.col("raw_signed_days") < 10, F.col("raw_signed_days"))
    )
    return G.ffill(frame, "seen").select(*TRACK, "seen")


@query(
    "days_to_crossing",
    "G9",
    """SELECT location_id, stage_id, prediction_date, round(crossing_0 - pdoy + 0.0002::DOUBLE, 3) + 0.0 AS days_to_rolling_crossing_0 FROM crossed""",
)
def _(spark, sf):
    frame = signal(spark, sf)
    for tag, threshold in G.CROSSINGS:
        frame = G.linear_crossing(frame, threshold, f"rolling_linear_crossing_{tag}")
        frame = G.spline_crossing(frame, f"rolling_spline_crossing_{tag}")
    days = steady("days_to_rolling_crossing_0")
    return G.days_to_crossing(frame).select(*TRACK, days.alias("days_to_rolling_crossing_0"))


@query(
    "termination_features",
    "G10",
    """SELECT l.location_id, l.stage_id, l.prediction_date, l.signal_lag3, l.signal - l.signal_lag1 AS slope_1,
              c.pdoy AS prediction_day_of_year, round(c.crossing_m05 + 0.0002::DOUBLE, 3) + 0.0 AS crossing_m05,
              round(c.crossing_0 - c.pdoy + 0.0002::DOUBLE, 3) + 0.0 AS days_0
       FROM lagged l JOIN crossed c USING (trajectory_year, location_id, stage_id, prediction_date)""",
    rounds="slope_1",
)
def _(spark, sf):
    return G.termination_features(A.trajectory(spark, sf)).select(
        *TRACK,
        "signal_lag3",
        "slope_1",
        "prediction_day_of_year",
        steady("rolling_linear_crossing_minus_0_5").alias("crossing_m05"),
        steady("days_to_rolling_crossing_0").alias("days_0"),
    )


def scored(spark, sf):
    """Trajectories with the raw signal standing in for the learned days."""
    return A.trajectory(spark, sf).withColumn("learned_days_remaining", F.col("raw_signed_days"))


@query(
    "adjust_score",
    "G11",
    """SELECT location_id, stage_id, prediction_date, adjusted0 AS termination_adjusted_days_remaining FROM lock0""",
    rounds="termination_adjusted_days_remaining",
)
def _(spark, sf):
    return G.adjust_score(scored(spark, sf)).select(*TRACK, "termination_adjusted_days_remaining")


@query(
    "history_days",
    "G12",
    """SELECT location_id, stage_id, prediction_date, CAST(hist AS INTEGER) AS termination_history_days,
              hist > 7 AS termination_output_applied FROM lock0""",
)
def _(spark, sf):
    return G.history_days(scored(spark, sf)).select(
        *TRACK, "termination_history_days", "termination_output_applied"
    )


def locked(spark, sf):
    return G.lock_trajectories(scored(spark, sf), Settings())


@query(
    "first_hit_lock",
    "G13",
    """SELECT location_id, stage_id, prediction_date, reached AS termination_reached, first_hit AS termination_first_hit,
              CASE WHEN reached THEN decision END AS termination_decision_date,
              adjusted AS termination_adjusted_days_remaining FROM locked""",
    rounds="termination_adjusted_days_remaining",
)
def _(spark, sf):
    return G.first_hit_lock(G.adjust_score(scored(spark, sf))).select(
        *TRACK,
        "termination_reached",
        "termination_first_hit",
        "termination_decision_date",
        "termination_adjusted_days_remaining",
    )


@query(
    "estimated_date",
    "G14",
    """SELECT location_id, stage_id, prediction_date, CAST(CASE WHEN reached THEN decision ELSE
              prediction_date + CAST(floor(adjusted) AS INTEGER) END AS DATE) AS estimated_day FROM locked""",
)
def _(spark, sf):
    frame = G.estimated_date(G.first_hit_lock(G.adjust_score(scored(spark, sf))))
    return frame.select(*TRACK, F.to_date("termination_estimated_stage_date").alias("estimated_day"))


@query(
    "overwrite_business",
    "G15",
    """SELECT location_id, stage_id, prediction_date,
              CASE WHEN applied THEN adjusted ELSE predicted_days END AS predicted_days,
              CAST(CASE WHEN applied AND reached THEN decision
                   WHEN applied THEN prediction_date + CAST(floor(adjusted) AS INTEGER)
                   ELSE predicted_stage_date END AS DATE) AS predicted_stage_date,
              predicted_days AS base_predicted_days, predicted_stage_date AS base_predicted_stage_date FROM locked""",
    rounds="predicted_days base_predicted_days",
)
def _(spark, sf):
    return locked(spark, sf).select(
        *TRACK,
        "predicted_days",
        "predicted_stage_date",
        "base_predicted_days",
        "base_predicted_stage_date",
    )


@query(
    "zero_day_lock",
    "G16",
    """WITH h AS (SELECT *, predicted_days <= 1.0 AND coalesce(lead(predicted_days) OVER w <= 1.0, false) AS run
                  FROM detail WINDOW w AS (PARTITION BY model_version, location_id, stage_id ORDER BY prediction_date)),
       d AS (SELECT model_version, location_id, stage_id, min(CASE WHEN run THEN prediction_date END) AS lock_at FROM h GROUP BY ALL)
       SELECT h.model_version, h.location_id, h.stage_id, h.prediction_date,
              CASE WHEN h.prediction_date >= d.lock_at THEN 0.0::DOUBLE ELSE h.predicted_days END AS predicted_days,
              CASE WHEN h.prediction_date >= d.lock_at THEN d.lock_at ELSE h.predicted_stage_date END AS predicted_stage_date,
              coalesce(h.prediction_date >= d.lock_at, false) AS termination_reached
       FROM h JOIN d USING (model_version, location_id, stage_id)""",
    rounds="predicted_days",
)
def _(spark, sf):
    key = ("model_version", "test_year", "location_id", "stage_id")
    frame = G.zero_day_lock(A.detail(spark, sf), 1.0, 2, key, fill_termination=True)
    return frame.select(
        "model_version", *TRACK, "predicted_days", "predicted_stage_date", "termination_reached"
    )


@query(
    "raw_zero_lock",
    "G17",
    """SELECT location_id, stage_id, prediction_date, coalesce(prediction_date >= lock_at, false) AS termination_reached,
              CASE WHEN prediction_date >= lock_at THEN lock_at END AS termination_decision_date FROM (
         SELECT *, min(CASE WHEN raw_signed_days <= 0 THEN prediction_date END) OVER
                (PARTITION BY trajectory_year, location_id, stage_id) AS lock_at FROM trajectory)""",
)
def _(spark, sf):
    return G.raw_zero_lock(A.trajectory(spark, sf)).select(
        *TRACK, "termination_reached", "termination_decision_date"
    )


