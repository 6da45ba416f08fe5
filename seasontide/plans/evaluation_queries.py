"""Planning, evaluation and report tables over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from seasontide.operators import evaluation as H
from seasontide.operators import intervals as I
from seasontide.operators import models as M
from seasontide.operators import reports as P
from seasontide.operators import spatial as C
from seasontide.operators import termination as G
from seasontide.plans import adapters as A
from seasontide.plans.feature_queries import located
from seasontide.plans.registry import query
from seasontide.plans.source_queries import prepared

YEARS = (1997, 1998, 1999)
STAGES = (1, 4, 2, 3)


# ---------------------------------------------------------------- planning


@query(
    "backtest_plan",
    "H1",
    """SELECT location_id, stage_id, year, stage_date, stage_date - INTERVAL 7 DAY AS testing_date,
              CAST(stage_date - INTERVAL 7 DAY AS DATE) AS testing_date_only, latitude, longitude
       FROM prepared WHERE year IN (1997, 1998, 1999)""",
)
def _(spark, sf):
    return H.backtest_plan(prepared(spark, sf), YEARS, STAGES)


@query(
    "locations_by_date",
    "H2",
    """SELECT testing_date_only, bucket, count(*) AS n_locations,
              string_agg(location_id, ',' ORDER BY location_id) AS location_ids
       FROM (SELECT DISTINCT CAST(stage_date - INTERVAL 7 DAY AS DATE) AS testing_date_only, location_id,
                    substr(md5(location_id), 1, 1) AS bucket FROM prepared WHERE year IN (1997, 1998, 1999))
       GROUP BY testing_date_only, bucket""",
)
def _(spark, sf):
    plan = H.backtest_plan(prepared(spark, sf), YEARS, STAGES)
    listed = F.array_join("location_ids", ",")
    return H.locations_by_date(plan).withColumn("location_ids", listed)


@query(
    "event_windows",
    "H3",
    "SELECT event_year, location_id, stage_id, stage_date, prediction_date, days_from_event FROM windows",
)
def _(spark, sf):
    return H.event_windows(A.track_events(spark, sf)).select(
        "event_year", "location_id", "stage_id", "stage_date", "prediction_date", "days_from_event"
    )


GRID = """(SELECT y AS test_year, CAST(d AS DATE) AS prediction_date FROM (VALUES (1997), (1998), (1999)) v(y),
       range(make_date(y, 3, 1), make_date(y, 6, 2), INTERVAL 3 DAY) t(d))"""
SCHEDULE = f"""(SELECT * FROM {GRID} UNION SELECT year, CAST(stage_date AS DATE) FROM prepared
       WHERE year IN (1997, 1998, 1999) AND CAST(stage_date AS DATE) BETWEEN make_date(year, 3, 1) AND make_date(year, 6, 1))"""


@query("prediction_schedule", "H4", f"SELECT test_year, prediction_date FROM {SCHEDULE}")
def _(spark, sf):
    return H.prediction_schedule(prepared(spark, sf), YEARS)


@query(
    "schedule_summary",
    "H5",
    f"""SELECT test_year, make_date(test_year, 1, 1) AS training_cutoff, make_date(test_year - 1, 12, 31) AS train_data_through,
              count(*) AS n_prediction_dates, min(prediction_date) AS first_prediction_date,
              max(prediction_date) AS last_prediction_date,
              (SELECT count(DISTINCT location_id) FROM prepared p WHERE p.year = test_year) AS n_locations
       FROM {SCHEDULE} GROUP BY test_year""",
)
def _(spark, sf):
    events = prepared(spark, sf)
    places = events.select(F.col("year").alias("test_year"), "location_id")
    return H.schedule_summary(H.prediction_schedule(events, YEARS), places)


@query(
    "sample_locations",
    "H6",
    """SELECT test_year, location_id FROM (
         SELECT *, row_number() OVER (PARTITION BY test_year ORDER BY md5((42 + test_year) || ':' || location_id), location_id) AS rn
         FROM (SELECT DISTINCT year AS test_year, location_id FROM prepared)) WHERE rn <= 5""",
)
def _(spark, sf):
    return H.sample_locations(prepared(spark, sf), 5, 42)


# ---------------------------------------------------------------- predictions


@query(
    "collapse_predictions",
    "H7",
    """SELECT prediction_date, location_id, stage_id, quantile_cont(predicted_days, 0.5) AS predicted_days,
              quantile_cont(raw_signed_days, 0.5) AS raw_signed_days, count(*) AS n_rows, min(place_id) AS place_id,
              prediction_date + CAST(floor(quantile_cont(predicted_days, 0.5)) AS INTEGER) AS predicted_stage_date
       FROM dup_predictions GROUP BY prediction_date, location_id, stage_id""",
    rounds="predicted_days raw_signed_days",
)
def _(spark, sf):
    return H.collapse_predictions(A.duplicate_predictions(spark, sf)).select(
        "prediction_date",
        "location_id",
        "stage_id",
        "predicted_days",
        "raw_signed_days",
        "n_rows",
        "place_id",
        "predicted_stage_date",
    )


def window_detail(spark, sf):
    return H.event_window_detail(
        H.event_windows(A.track_events(spark, sf)), A.trajectory(spark, sf), 0.0, 1.0
    )


@query(
    "event_window_detail",
    "H8",
    """SELECT event_year, location_id, stage_id, stage_date, prediction_date, days_from_event, predicted_days,
              predicted_stage_date, error_days, abs_error_days, terminated, near_zero FROM window_detail""",
)
def _(spark, sf):
    return window_detail(spark, sf).select(
        "event_year",
        "location_id",
        "stage_id",
        "stage_date",
        "prediction_date",
        "days_from_event",
        "predicted_days",
        "predicted_stage_date",
        "error_days",
        "abs_error_days",
        "terminated",
        "near_zero",
    )


def lead_eval(spark, sf):
    predictions = A.trajectory(spark, sf).select(
        "location_id",
        "stage_id",
        F.col("trajectory_year").alias("prediction_year"),
        "prediction_date",
        "predicted_stage_date",
        "latitude",
        "longitude",
    )
    return H.lead_evaluation(predictions, A.track_events(spark, sf), 7)


@query(
    "lead_evaluation",
    "H9",
    """SELECT location_id, stage_id, prediction_year, prediction_date, predicted_stage_date, actual_stage_date,
              error_days, location_state FROM lead_eval""",
)
def _(spark, sf):
    return lead_eval(spark, sf).select(
        "location_id",
        "stage_id",
        "prediction_year",
        "prediction_date",
        "predicted_stage_date",
        F.to_date("actual_stage_date").alias("actual_stage_date"),
        "error_days",
        "location_state",
    )


ERRORS = """count(*) AS n_predictions, avg(error_days) AS mean_error, quantile_cont(error_days, 0.5) AS median_error,
       avg(abs(error_days)) AS mae_error, avg(CAST(abs(error_days) <= 3 AS INTEGER)) AS within_3d,
       avg(CAST(abs(error_days) <= 5 AS INTEGER)) AS within_5d, quantile_cont(abs(error_days), 0.9) AS p90_abs_error"""


@query(
    "error_summary",
    "H10",
    f"""SELECT prediction_year, stage_id, {ERRORS}, 'year_stage' AS scope FROM lead_eval GROUP BY prediction_year, stage_id
        UNION ALL SELECT prediction_year, NULL, {ERRORS}, 'year' FROM lead_eval GROUP BY prediction_year""",
    rounds="mean_error median_error mae_error within_3d within_5d p90_abs_error",
)
def _(spark, sf):
    return H.error_summary(lead_eval(spark, sf))


SCOPE = """count(*) AS n, avg(abs(error_days)) AS mae, sqrt(avg(error_days * error_days)) AS rmse, avg(error_days) AS bias,
       quantile_cont(abs(error_days), 0.5) AS median_abs_error, avg(CAST(abs(error_days) <= 7 AS INTEGER)) AS within_7d"""


@query(
    "scope_metrics",
    "H11",
    f"""SELECT 'overall' AS scope, {SCOPE} FROM lead_eval
        UNION ALL SELECT 'stage_id=' || stage_id, {SCOPE} FROM lead_eval GROUP BY stage_id""",
    rounds="mae rmse bias median_abs_error within_7d",
)
def _(spark, sf):
    return H.scope_metrics(lead_eval(spark, sf))


FRACTIONAL = """(SELECT stage_id, CAST(2020 + CAST(location_id AS BIGINT) % 3 AS INTEGER) AS prediction_year,
        raw_signed_days - CAST(actual_stage_date - prediction_date AS DOUBLE) AS e FROM trajectory)"""


def fractional_errors(spark, sf):
    return A.trajectory(spark, sf).select(
        "stage_id",
        (2020 + F.col("location_id").cast("long") % 3).cast("int").alias("prediction_year"),
        (F.col("raw_signed_days") - F.datediff("actual_stage_date", "prediction_date")).alias("error_days"),
    )


@query(
    "error_summary_fractional",
    "H10",
    f"""SELECT prediction_year, stage_id, count(*) AS n_predictions, avg(e) AS mean_error, quantile_cont(e, 0.5) AS median_error,
              avg(abs(e)) AS mae_error, avg(CAST(abs(e) <= 3 AS DOUBLE)) AS within_3d, avg(CAST(abs(e) <= 5 AS DOUBLE)) AS within_5d,
              quantile_cont(abs(e), 0.9) AS p90_abs_error,
              CASE WHEN grouping(stage_id) = 1 THEN 'year' ELSE 'year_stage' END AS scope
       FROM {FRACTIONAL} GROUP BY GROUPING SETS ((prediction_year, stage_id), (prediction_year))""",
    rounds="mean_error median_error mae_error within_3d within_5d p90_abs_error",
)
def _(spark, sf):
    return H.error_summary(fractional_errors(spark, sf))


@query(
    "scope_metrics_fractional",
    "H11",
    f"""SELECT CASE WHEN grouping(stage_id) = 1 THEN 'overall' ELSE 'stage_id=' || stage_id END AS scope, count(*) AS n,
              avg(abs(e)) AS mae, sqrt(avg(e * e)) AS rmse, avg(e) AS bias, quantile_cont(abs(e), 0.5) AS median_abs_error,
              avg(CAST(abs(e) <= 7 AS DOUBLE)) AS within_7d
       FROM {FRACTIONAL} GROUP BY ROLLUP (stage_id)""",
    rounds="mae rmse bias median_abs_error within_7d",
)
def _(spark, sf):
    return H.scope_metrics(fractional_errors(spark, sf))


@query(
    "location_metrics",
    "H12",
    """WITH l AS (SELECT prediction_year AS year, stage_id, location_id, location_state, count(*) AS n,
                   sqrt(avg(error_days * error_days)) AS rmse, avg(abs(error_days)) AS mae, avg(error_days) AS bias
                  FROM lead_eval GROUP BY ALL)
       SELECT *, avg(mae) OVER (PARTITION BY year, stage_id, location_state) AS mae_state FROM l""",
    rounds="rmse mae bias mae_state",
)
def _(spark, sf):
    rows = lead_eval(spark, sf).withColumn("year", F.col("prediction_year"))
    return H.location_metrics(rows).select(
        "year", "stage_id", "location_id", "location_state", "n", "rmse", "mae", "bias", "mae_state"
    )


@query(
    "event_window_summary",
    "H13",
    """SELECT event_year, stage_id, count(*) AS n_event_windows, CAST(sum(n_prediction_rows) AS BIGINT) AS n_prediction_rows,
              CAST(count_if(terminated_within_window) AS BIGINT) AS terminated_windows,
              CAST(count_if(near_zero_within_window) AS BIGINT) AS near_zero_windows,
              quantile_cont(min_predicted_days, 0.5) AS median_min_predicted_days,
              quantile_cont(day0_predicted_days, 0.5) AS median_day0_predicted_days,
              quantile_cont(median_abs_error_days, 0.5) AS median_abs_error_days,
              avg(mean_abs_error_days) AS mean_abs_error_days,
              quantile_cont(p90_abs_error_days, 0.5) AS p90_abs_error_days,
              count_if(terminated_within_window) / count(*) AS termination_rate,
              count_if(near_zero_within_window) / count(*) AS near_zero_rate,
              0.0::DOUBLE AS termination_threshold, 1.0::DOUBLE AS near_zero_threshold
       FROM window_level GROUP BY event_year, stage_id""",
    rounds="median_min_predicted_days median_day0_predicted_days median_abs_error_days mean_abs_error_days"
    " p90_abs_error_days termination_rate near_zero_rate",
)
def _(spark, sf):
    return H.event_window_summary(window_detail(spark, sf), 0.0, 1.0)


@query(
    "non_terminated_windows",
    "H14",
    """SELECT event_year, stage_id, location_id, stage_date, min_predicted_days, median_abs_error_days
       FROM window_level WHERE NOT terminated_within_window""",
    rounds="min_predicted_days median_abs_error_days",
)
def _(spark, sf):
    return H.non_terminated(window_detail(spark, sf)).select(
        "event_year",
        "stage_id",
        "location_id",
        "stage_date",
        "min_predicted_days",
        "median_abs_error_days",
    )


def versioned_windows(spark, sf):
    """Two-version predictions inside the event windows."""
    windows = H.event_windows(A.track_events(spark, sf), 7, 7)
    cols = ["model_version", "location_id", "stage_id", "prediction_date", "predicted_days"]
    return windows.join(
        A.detail(spark, sf).select(*cols), ["location_id", "stage_id", "prediction_date"], "left"
    )


@query(
    "behavior_summary",
    "H15",
    """WITH d AS (SELECT model_version, location_id, stage_id, actual_stage_date AS stage_date, prediction_date, predicted_days
                  FROM detail WHERE abs(prediction_date - actual_stage_date) <= 7),
       n AS (SELECT *, lead(predicted_days) OVER (PARTITION BY model_version, location_id, stage_id, stage_date
                    ORDER BY prediction_date) AS nx FROM d)
       SELECT model_version, count(DISTINCT (location_id, stage_id, stage_date)) AS n_event_windows,
              count(*) AS n_prediction_rows, CAST(count_if(nx - predicted_days > 1.0) AS BIGINT) AS bounce_back_count,
              count_if(nx - predicted_days > 1.0) / nullif(count(nx), 0) AS bounce_back_rate,
              CAST(count_if(prediction_date > stage_date AND predicted_days > 0) AS BIGINT) AS post_event_positive_count,
              count_if(prediction_date > stage_date AND predicted_days > 0) / nullif(count_if(prediction_date > stage_date), 0) AS post_event_positive_rate
       FROM n GROUP BY model_version""",
    rounds="bounce_back_rate post_event_positive_rate",
)
def _(spark, sf):
    return H.behavior_summary(versioned_windows(spark, sf))


def diagnostics(spark, sf):
    key = ("model_version", "test_year", "location_id", "stage_id")
    return H.trajectory_diagnostics(G.raw_zero_lock(A.detail(spark, sf), key))


@query(
    "trajectory_diagnostics",
    "H16",
    """SELECT model_version, location_id, stage_id, prediction_date, days_from_event, stage_date_error_days,
              within_3d, within_5d, within_7d, predicted_days_delta, predicted_stage_date_delta_days, bounce_up,
              post_event_positive FROM diagnostics""",
    rounds="predicted_days_delta",
)
def _(spark, sf):
    return diagnostics(spark, sf).select(
        "model_version",
        "location_id",
        "stage_id",
        "prediction_date",
        "days_from_event",
        "stage_date_error_days",
        "within_3d",
        "within_5d",
        "within_7d",
        "predicted_days_delta",
        "predicted_stage_date_delta_days",
        "bounce_up",
        "post_event_positive",
    )


TERMINATIONS = """(SELECT model_version, test_year, location_id, stage_id, actual_stage_date, hit IS NOT NULL AS termination_reached,
         hit AS termination_decision_date, coalesce(hit, last_stage) AS termination_estimated_stage_date,
         CAST(hit - actual_stage_date AS INTEGER) AS termination_error_days FROM (
       SELECT model_version, test_year, location_id, stage_id, min(actual_stage_date) AS actual_stage_date,
              min(CASE WHEN raw_signed_days <= 0 THEN prediction_date END) AS hit,
              arg_max(predicted_stage_date, prediction_date) AS last_stage
       FROM detail GROUP BY model_version, test_year, location_id, stage_id))"""


def terminations(spark, sf):
    key = ("model_version", "test_year", "location_id", "stage_id")
    locked = G.raw_zero_lock(A.detail(spark, sf), key)
    return H.termination_events(
        locked.withColumn("termination_estimated_stage_date", F.col("termination_decision_date"))
    )


@query(
    "termination_events",
    "H17",
    f"""SELECT model_version, test_year, location_id, stage_id, actual_stage_date, termination_reached,
              termination_decision_date, termination_estimated_stage_date, termination_error_days,
              abs(termination_error_days) AS abs_termination_error_days,
              coalesce(termination_error_days < 0, false) AS termination_early,
              coalesce(termination_error_days > 0, false) AS termination_late,
              CASE WHEN termination_reached THEN 'first_termination_reached'
                   ELSE 'last_available_prediction_no_termination' END AS selection_rule FROM {TERMINATIONS}""",
)
def _(spark, sf):
    return terminations(spark, sf).drop("latitude", "longitude")


RATES = (
    "bias_stage_date_error mae_stage_date_error rmse_stage_date_error median_abs_stage_date_error"
    " p90_abs_stage_date_error within_3d_rate within_5d_rate within_7d_rate bounce_up_rate"
    " post_event_positive_rate termination_reached_rate"
)


def track_summary(spark, sf):
    return H.trajectory_summary(diagnostics(spark, sf))


@query("trajectory_summary", "H18", "SELECT * FROM track_summary", rounds=RATES)
def _(spark, sf):
    return track_summary(spark, sf)


def zero_detail(spark, sf):
    return H.zero_day_errors(A.detail(spark, sf))


@query(
    "zero_day_errors",
    "H19",
    """SELECT *, CASE WHEN zero_day_error_days < 0 THEN 'early' WHEN zero_day_error_days > 0 THEN 'late'
                      WHEN zero_day_error_days = 0 THEN 'exact' ELSE 'not_reached' END AS zero_day_error_direction
       FROM zero_detail""",
)
def _(spark, sf):
    return zero_detail(spark, sf).select(
        "model_version",
        "test_year",
        "location_id",
        "stage_id",
        "actual_stage_date",
        "first_prediction_date",
        "last_prediction_date",
        "n_prediction_rows",
        "zero_day_reached",
        "first_zero_prediction_date",
        "zero_day_error_days",
        "abs_zero_day_error_days",
        "zero_day_error_direction",
    )


ZERO_RATES = (
    "zero_day_reached_rate mean_zero_day_error_days median_zero_day_error_days"
    " mean_abs_zero_day_error_days median_abs_zero_day_error_days p90_abs_zero_day_error_days"
)


@query(
    "zero_day_summary",
    "H20",
    """SELECT * REPLACE (CAST(zero_day_reached_count AS BIGINT) AS zero_day_reached_count,
              CAST(early_zero_count AS BIGINT) AS early_zero_count, CAST(exact_zero_count AS BIGINT) AS exact_zero_count,
              CAST(late_zero_count AS BIGINT) AS late_zero_count),
              early_zero_count / nullif(zero_day_reached_count, 0) AS early_zero_rate_among_reached,
              exact_zero_count / nullif(zero_day_reached_count, 0) AS exact_zero_rate_among_reached,
              late_zero_count / nullif(zero_day_reached_count, 0) AS late_zero_rate_among_reached FROM zero_summary""",
    rounds=ZERO_RATES
    + " early_zero_rate_among_reached exact_zero_rate_among_reached late_zero_rate_among_reached",
)
def _(spark, sf):
    return H.zero_day_summary(zero_detail(spark, sf))


COMPARED = ("zero_day_reached_rate", "mean_zero_day_error_days", "p90_abs_zero_day_error_days")


@query(
    "compare_versions",
    "H21",
    "SELECT a.test_year, a.stage_id, "
    + ", ".join(f"a.{m} AS {m}_A, b.{m} AS {m}_B, b.{m} - a.{m} AS {m}_delta" for m in COMPARED)
    + """ FROM zero_summary a JOIN zero_summary b ON a.test_year = b.test_year AND a.stage_id = b.stage_id
          WHERE a.model_version = 'A' AND b.model_version = 'B'""",
    rounds=" ".join(f"{m}_A {m}_B {m}_delta" for m in COMPARED),
)
def _(spark, sf):
    return H.compare_versions(H.zero_day_summary(zero_detail(spark, sf)), "A", "B", COMPARED)


@query(
    "join_next_actual",
    "H22",
    """SELECT location_id, stage_id, prediction_date, actual,
              CAST(floor(epoch(predicted_stage_date::TIMESTAMP - actual) / 86400.0) AS INTEGER) AS error_days FROM (
         SELECT t.location_id, t.stage_id, t.prediction_date, t.predicted_stage_date, (SELECT min(e.stage_date) FROM prepared e
                WHERE e.location_id = t.location_id AND e.stage_id = t.stage_id AND e.stage_date >= t.prediction_date
                  AND (CASE WHEN month(e.stage_date) < 3 THEN year(e.stage_date) - 1 ELSE year(e.stage_date) END)
                    = (CASE WHEN month(t.prediction_date) < 3 THEN year(t.prediction_date) - 1 ELSE year(t.prediction_date) END)) AS actual
         FROM (SELECT l.location_id, s.stage_id, l.date AS prediction_date, l.date + 9 AS predicted_stage_date
               FROM located l, (VALUES (1), (2), (3), (4)) s(stage_id)) t)""",
)
def _(spark, sf):
    from seasontide.operators.frames import add_stages

    days = located(spark, sf)
    predictions = add_stages(days, (1, 2, 3, 4)).select(
        "location_id",
        "stage_id",
        F.col("date").alias("prediction_date"),
        F.date_add("date", 9).alias("predicted_stage_date"),
    )
    return H.join_next_actual(predictions, prepared(spark, sf)).select(
        "location_id",
        "stage_id",
        "prediction_date",
        F.col("actual_stage_date").alias("actual"),
        "error_days",
    )


@query(
    "run_summary",
    "H23",
    "SELECT event_type AS status, count(*) AS n_runs FROM events GROUP BY event_type",
)
def _(spark, sf):
    log = A.table(spark, sf, "events").select(F.col("event_type").alias("status"))
    return H.run_summary(log)


def prepared_windows(spark, sf):
    """Event windows of the prepared stage-1 events, predicted as day offset plus error."""
    windows = H.event_windows(prepared(spark, sf).where("stage_id = 1"))
    doy = F.dayofyear("stage_date")
    days = (doy % 23 - F.col("days_from_event")) / 2.0
    return windows.withColumns(
        {"predicted_days": days, "abs_error_days": F.abs(F.col("days_from_event")) + doy % 5}
    )


OPEN = """(SELECT event_year, location_id, stage_date, min(predicted_days) AS min_predicted_days,
         quantile_cont(abs_error_days, 0.5) AS median_abs_error,
         max(CASE WHEN o = 0 THEN predicted_days END) AS day0_predicted_days, CAST(dayofyear(stage_date) AS INTEGER) AS current_doy
       FROM (SELECT DISTINCT year AS event_year, location_id, CAST(stage_date AS DATE) AS stage_date, o,
                    (dayofyear(stage_date) % 23 - o) / 2.0::DOUBLE AS predicted_days, abs(o) + dayofyear(stage_date) % 5 AS abs_error_days
             FROM prepared, range(-3, 4) t(o) WHERE stage_id = 1)
       GROUP BY event_year, location_id, stage_date HAVING min(predicted_days) > 0)"""
NON_CONVERGED = f"""(SELECT w.*, h.history_n, h.history_years, h.history_median_doy,
         h.history_median_doy - w.current_doy AS days_earlier_than_history_median,
         f.cumu_gdd_air AS day0_cumu_gdd_air, f.latitude AS day0_latitude
       FROM {OPEN} w JOIN (SELECT w2.event_year, w2.location_id, w2.stage_date, count(e.stage_date) AS history_n,
           coalesce(string_agg(DISTINCT CAST(e.year AS VARCHAR), ',' ORDER BY CAST(e.year AS VARCHAR)), '') AS history_years,
           quantile_cont(CASE WHEN e.year IS NOT NULL THEN dayofyear(e.stage_date) END, 0.5) AS history_median_doy
         FROM {OPEN} w2 LEFT JOIN prepared e ON e.location_id = w2.location_id AND e.stage_id = 1 AND e.year <> w2.event_year
         GROUP BY w2.event_year, w2.location_id, w2.stage_date) h
         ON h.event_year = w.event_year AND h.location_id = w.location_id AND h.stage_date = w.stage_date
       LEFT JOIN located f ON f.location_id = w.location_id AND f.date = w.stage_date)"""
CAUSE = """CASE WHEN days_earlier_than_history_median >= 14 AND day0_latitude <= 39 THEN 'historically_early_likely_training_coverage_gap'
       WHEN min_predicted_days <= 3 THEN 'near_convergence_likely_postprocess_or_short_window'
       WHEN day0_cumu_gdd_air >= 50 AND day0_predicted_days >= 7 THEN 'warm_signal_but_late_prediction_possible_feature_or_generalization_gap'
       ELSE 'requires_manual_review' END"""


def non_converged(spark, sf):
    return H.non_converged(prepared_windows(spark, sf), prepared(spark, sf), located(spark, sf))


@query(
    "non_converged_windows",
    "H24",
    f"""SELECT event_year, location_id, stage_date, min_predicted_days, median_abs_error, day0_predicted_days,
              history_n, history_years, history_median_doy, days_earlier_than_history_median, day0_cumu_gdd_air,
              day0_latitude FROM {NON_CONVERGED}""",
    rounds="min_predicted_days median_abs_error history_median_doy days_earlier_than_history_median day0_cumu_gdd_air",
)
def _(spark, sf):
    return non_converged(spark, sf).select(
        "event_year",
        "location_id",
        "stage_date",
        "min_predicted_days",
        "median_abs_error",
        "day0_predicted_days",
        "history_n",
        "history_years",
        "history_median_doy",
        "days_earlier_than_history_median",
        "day0_cumu_gdd_air",
        "day0_latitude",
    )


@query(
    "root_cause_counts",
    "H25",
    f"SELECT {CAUSE} AS root_cause_label, count(*) AS n_windows FROM {NON_CONVERGED} GROUP BY 1",
)
def _(spark, sf):
    return H.root_cause_counts(H.root_cause(non_converged(spark, sf)))


BIN = """CASE WHEN predicted_days <= 0 THEN '0' WHEN predicted_days <= 1 THEN '(0,1]' WHEN predicted_days <= 3 THEN '(1,3]'
       WHEN predicted_days <= 7 THEN '(3,7]' WHEN predicted_days <= 14 THEN '(7,14]' WHEN predicted_days <= 30 THEN '(14,30]'
       WHEN predicted_days > 30 THEN '>30' END"""


@query(
    "bin_heatmap",
    "H26",
    f"""SELECT b AS predicted_days_bin, """
    + ", ".join(
        f"count(CASE WHEN days_from_event = {d} THEN 1 END) AS {f'd{d}'.replace('-', 'm')}"
        for d in range(-3, 4)
    )
    + f""" FROM (VALUES ('0'), ('(0,1]'), ('(1,3]'), ('(3,7]'), ('(7,14]'), ('(14,30]'), ('>30')) v(b)
        LEFT JOIN window_detail w ON {BIN} = b GROUP BY b""",
)
def _(spark, sf):
    return H.bin_heatmap(window_detail(spark, sf), list(range(-3, 4)))


@query(
    "focus_summary",
    "H27",
    """WITH w AS (SELECT event_year, location_id, stage_date, count(*) AS n, min(predicted_days) AS lo, max(predicted_days) AS hi,
              bool_or(coalesce(predicted_days <= 0, false)) AS hit,
              bool_or(coalesce(predicted_days <= 0, false) AND days_from_event IN (-1, 0, 1)) AS fhit
              FROM window_detail GROUP BY ALL)
       SELECT CAST(sum(n) AS BIGINT) AS n_rows, count(DISTINCT location_id) AS n_locations, count(*) AS n_windows,
              min(lo) AS min_predicted_days, max(hi) AS max_predicted_days, quantile_cont(lo, 0.5) AS median_window_min,
              CAST(count_if(hit) AS BIGINT) AS terminated_windows, CAST(count_if(fhit) AS BIGINT) AS focus_terminated_windows,
              (SELECT quantile_cont(abs_error_days, 0.5) FROM window_detail) AS median_abs_error_days,
              (SELECT quantile_cont(abs_error_days, 0.5) FROM window_detail WHERE days_from_event IN (-1, 0, 1)) AS focus_median_abs_error_days
       FROM w""",
    rounds="median_window_min median_abs_error_days focus_median_abs_error_days",
)
def _(spark, sf):
    return H.focus_summary(window_detail(spark, sf))


@query(
    "outlier_summary",
    "H28",
    """SELECT location_id, event_year, stage_date, latitude, longitude, min(predicted_days) AS min_predicted_days,
              max(predicted_days) AS max_predicted_days, quantile_cont(abs_error_days, 0.5) AS median_abs_error,
              avg(abs_error_days) AS mean_abs_error, min(predicted_stage_date) AS first_predicted_stage_date,
              max(predicted_stage_date) AS last_predicted_stage_date, bool_or(terminated) AS any_terminated,
              (array_agg(prediction_date ORDER BY abs_error_days DESC, prediction_date) FILTER (abs_error_days IS NOT NULL))[1] AS worst_prediction_date,
              max(abs_error_days) AS worst_abs_error,
              (array_agg(prediction_date ORDER BY abs_error_days, prediction_date) FILTER (abs_error_days IS NOT NULL))[1] AS best_prediction_date,
              min(abs_error_days) AS best_abs_error
       FROM window_detail GROUP BY location_id, event_year, stage_date, latitude, longitude""",
    rounds="median_abs_error mean_abs_error",
)
def _(spark, sf):
    return H.outlier_summary(window_detail(spark, sf))


# ---------------------------------------------------------------- reports


def band_days(spark, sf):
    banded = A.trajectory(spark, sf).withColumn("lat_band", C.latitude_band(F.col("latitude")))
    return P.band_daily(banded.where("lat_band IS NOT NULL"))


@query(
    "band_daily",
    "H29",
    "SELECT * FROM band_days",
    rounds="mean_predicted_days median_predicted_days mean_raw_signed_days mean_predicted_stage_day predicted_days_diff",
)
def _(spark, sf):
    return band_days(spark, sf)


@query(
    "band_metrics",
    "H30",
    """WITH s AS (SELECT lat_band, max(rise) AS up FROM (
         SELECT lat_band, mean_predicted_days - lag(mean_predicted_days) OVER (PARTITION BY lat_band ORDER BY prediction_date) AS rise
         FROM band_days WHERE prediction_date BETWEEN DATE '2024-01-07' AND DATE '2024-01-14') GROUP BY lat_band)
       SELECT b.lat_band, greatest(coalesce(min(s.up), 0.0::DOUBLE), 0.0::DOUBLE) AS max_upward_swing,
              arg_max(mean_predicted_stage_day, prediction_date) - arg_min(mean_predicted_stage_day, prediction_date) AS net_drift_days,
              count(CASE WHEN predicted_days_diff > 0 THEN 1 END) AS positive_jump_days,
              arg_min(mean_predicted_days, prediction_date) AS start_mean_predicted_days,
              arg_max(mean_predicted_days, prediction_date) AS end_mean_predicted_days,
              arg_max(n_places, prediction_date) AS n_places_end
       FROM band_days b LEFT JOIN s ON s.lat_band = b.lat_band GROUP BY b.lat_band""",
    rounds="max_upward_swing net_drift_days start_mean_predicted_days end_mean_predicted_days",
)
def _(spark, sf):
    return P.band_metrics(band_days(spark, sf), "2024-01-07", "2024-01-14")


def doy_frame(spark, sf):
    rows = A.detail(spark, sf).withColumn("prediction_year", F.col("test_year"))
    return P.doy_comparison(
        {v: rows.where(F.col("model_version") == v).drop("model_version") for v in ("A", "B")}
    )


@query(
    "doy_comparison",
    "H31",
    """SELECT model_version, location_id, stage_id, prediction_date, CAST(dayofyear(predicted_stage_date) AS INTEGER) AS predicted_doy,
              CAST(dayofyear(actual_stage_date) AS INTEGER) AS actual_doy,
              CAST(dayofyear(predicted_stage_date) - dayofyear(actual_stage_date) AS INTEGER) AS doy_error FROM detail""",
)
def _(spark, sf):
    return doy_frame(spark, sf).select(
        "model_version",
        "location_id",
        "stage_id",
        "prediction_date",
        "predicted_doy",
        "actual_doy",
        "doy_error",
    )


@query(
    "ols_band",
    "H32",
    """WITH f AS (SELECT model_version, stage_id, count(*) AS n, regr_slope(y, x) AS b, regr_intercept(y, x) AS a,
                    avg(x) AS mx, regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy, regr_sxy(y, x) AS sxy
                  FROM (SELECT model_version, stage_id, CAST(dayofyear(actual_stage_date) AS DOUBLE) AS x,
                               CAST(dayofyear(predicted_stage_date) AS DOUBLE) AS y FROM detail)
                  GROUP BY model_version, stage_id)
       SELECT model_version, stage_id, g AS x, a + b * g AS y_fit,
              a + b * g - 1.96 * sqrt((syy - sxy * sxy / sxx) / (n - 2) * (1.0 / n + (g - mx) * (g - mx) / sxx)) AS y_low,
              a + b * g + 1.96 * sqrt((syy - sxy * sxy / sxx) / (n - 2) * (1.0 / n + (g - mx) * (g - mx) / sxx)) AS y_high
       FROM f, (VALUES (10.0::DOUBLE), (15.0::DOUBLE), (20.0::DOUBLE)) t(g) WHERE n >= 3 AND sxx > 0""",
    rounds="y_fit y_low y_high",
)
def _(spark, sf):
    return P.ols_band(
        doy_frame(spark, sf),
        "actual_doy",
        "predicted_doy",
        [10.0, 15.0, 20.0],
        ["model_version", "stage_id"],
    )


def _manifest_sql(v: str) -> str:
    f = f"FILTER (model_version = '{v}')"
    return f"""count(*) {f} AS {v}_n_points, count(*) FILTER (model_version = '{v}' AND bounce_up) AS {v}_bounce_up_count,
      avg(abs_stage_date_error_days) {f} AS {v}_mae_stage_date_error,
      quantile_cont(abs_stage_date_error_days, 0.5) {f} AS {v}_median_abs_error,
      avg(abs(predicted_stage_date_delta_days)) {f} AS {v}_mean_abs_drift_days,
      min(prediction_date) {f} AS {v}_first_prediction_date, max(prediction_date) {f} AS {v}_last_prediction_date"""


@query(
    "trajectory_manifest",
    "H33",
    f"""SELECT row_number() OVER (ORDER BY test_year, location_id, stage_id) AS trajectory_id, * FROM (
         SELECT test_year, location_id, stage_id, min(actual_stage_date) AS actual_stage_date,
                string_agg(DISTINCT model_version, ',' ORDER BY model_version) AS model_versions, count(*) AS n_rows,
                {_manifest_sql("A")}, {_manifest_sql("B")}
         FROM diagnostics GROUP BY test_year, location_id, stage_id)""",
    rounds="A_mae_stage_date_error A_median_abs_error A_mean_abs_drift_days B_mae_stage_date_error"
    " B_median_abs_error B_mean_abs_drift_days",
)
def _(spark, sf):
    return P.trajectory_manifest(diagnostics(spark, sf), ["A", "B"])


@query(
    "top_improvements",
    "H34",
    """SELECT test_year, location_id, stage_id, a AS mae_a, b AS mae_b, a - b AS improvement FROM (
         SELECT test_year, location_id, stage_id, avg(abs_stage_date_error_days) FILTER (model_version = 'A') AS a,
                avg(abs_stage_date_error_days) FILTER (model_version = 'B') AS b
         FROM diagnostics GROUP BY test_year, location_id, stage_id)
       WHERE a - b IS NOT NULL ORDER BY a - b DESC, test_year, location_id, stage_id LIMIT 10""",
    rounds="mae_a mae_b improvement",
)
def _(spark, sf):
    return P.top_improvements(diagnostics(spark, sf), 10, "A", "B")


@query(
    "equal_width_bins",
    "H35",
    """WITH r AS (SELECT min(latitude) AS lo, max(latitude) - min(latitude) AS w FROM diagnostics),
       b AS (SELECT d.*, r.lo, r.w, CAST(greatest(least(coalesce(ceil((latitude - lo) / nullif(w / 5, 0)), 1), 5), 1) AS INTEGER) AS bin
             FROM diagnostics d, r)
       SELECT bin, lo + (bin - 1) * w / 5 - CASE WHEN bin = 1 THEN w * 0.001::DOUBLE ELSE 0.0::DOUBLE END AS bin_low, lo + bin * w / 5 AS bin_high,
              coalesce(avg(abs_stage_date_error_days) FILTER (model_version = 'A'), 0) AS mean_A,
              coalesce(avg(abs_stage_date_error_days) FILTER (model_version = 'B'), 0) AS mean_B
       FROM b GROUP BY bin, lo, w""",
    rounds="bin_low bin_high mean_A mean_B",
)
def _(spark, sf):
    return P.equal_width_bins(
        diagnostics(spark, sf), "latitude", "abs_stage_date_error_days", ["A", "B"]
    )


MEANS = ("mae_stage_date_error", "rmse_stage_date_error")


@query(
    "summary_means",
    "H36",
    "SELECT stage_id, "
    + ", ".join(
        f"avg({m}) FILTER (model_version = 'A') AS {m}_A, avg({m}) FILTER (model_version = 'B') AS {m}_B,"
        f" avg({m}) FILTER (model_version = 'A') - avg({m}) FILTER (model_version = 'B') AS {m}_improvement"
        for m in MEANS
    )
    + " FROM track_summary GROUP BY stage_id",
    rounds=" ".join(f"{m}_A {m}_B {m}_improvement" for m in MEANS),
)
def _(spark, sf):
    return P.summary_means(track_summary(spark, sf), "stage_id", MEANS, "A", "B")


@query(
    "policy_comparison",
    "H37",
    f"""SELECT model_version AS method, avg(CAST(termination_reached AS INTEGER)) AS reached_rate,
              avg(abs(termination_error_days)) AS decision_mae,
              sqrt(avg(termination_error_days * termination_error_days)) AS decision_rmse
       FROM {TERMINATIONS} GROUP BY model_version""",
    rounds="reached_rate decision_mae decision_rmse",
)
def _(spark, sf):
    events = terminations(spark, sf).select(
        F.col("model_version").alias("method"),
        "termination_reached",
        F.col("termination_error_days").alias("decision_error_days"),
        F.col("abs_termination_error_days").alias("abs_decision_error_days"),
    )
    return P.policy_comparison(events)


OVERALL = """(SELECT model_version, avg(abs_stage_date_error_days) AS mae, sqrt(avg(stage_date_error_days * stage_date_error_days)) AS rmse,
       quantile_cont(abs_stage_date_error_days, 0.9) AS p90, avg(CAST(within_3d AS INTEGER)) AS w3, avg(CAST(within_5d AS INTEGER)) AS w5,
       avg(CAST(post_event_positive AS INTEGER)) AS pep, avg(CAST(termination_reached AS INTEGER)) AS trr FROM diagnostics GROUP BY model_version)"""


@query(
    "metric_table",
    "H38",
    "SELECT metric, va AS value_a, vb AS value_b, vb - va AS delta FROM ("
    + " UNION ALL ".join(
        f"SELECT '{label}' AS metric, max({c}) FILTER (model_version = 'A') AS va, max({c}) FILTER (model_version = 'B') AS vb FROM {OVERALL}"
        for label, c in (
            ("MAE", "mae"),
            ("RMSE", "rmse"),
            ("P90 abs error", "p90"),
            ("Within 3d rate", "w3"),
            ("Within 5d rate", "w5"),
            ("Post-event positive rate", "pep"),
            ("Termination active row rate", "trr"),
        )
    )
    + f""" UNION ALL SELECT 'Termination reached trajectory rate',
           avg(CAST(termination_reached AS INTEGER)) FILTER (model_version = 'A'),
           avg(CAST(termination_reached AS INTEGER)) FILTER (model_version = 'B') FROM {TERMINATIONS})""",
    rounds="value_a value_b delta",
)
def _(spark, sf):
    overall = H.trajectory_summary(diagnostics(spark, sf), ["model_version"])
    return P.metric_table(overall, "A", "B", terminations(spark, sf))


@query(
    "latest_pivot",
    "H39",
    """SELECT location_id, latitude, longitude, """
    + ", ".join(
        f"min(CASE WHEN stage_id = {s} THEN predicted_stage_date END) AS stage_{s}" for s in STAGES
    )
    + """ FROM trajectory WHERE prediction_date = (SELECT max(prediction_date) FROM trajectory)
          GROUP BY location_id, latitude, longitude""",
)
def _(spark, sf):
    return P.latest_pivot(
        A.trajectory(spark, sf), STAGES, ["location_id", "latitude", "longitude"]
    )


@query(
    "locations_per_year",
    "H40",
    """SELECT year, bucket, string_agg(location_id, ', ' ORDER BY location_id) AS location_ids,
              (SELECT count(DISTINCT location_id) FROM prepared q WHERE q.stage_id = 1 AND q.year = d.year) AS n_locations
       FROM (SELECT DISTINCT year, location_id, substr(md5(location_id), 1, 1) AS bucket FROM prepared
             WHERE stage_id = 1 AND year IN (1997, 1998, 1999)) d
       GROUP BY year, bucket""",
)
def _(spark, sf):
    return P.locations_per_year(prepared(spark, sf), 1, YEARS)


@query(
    "matched_delta",
    "H41",
    """SELECT count(*) AS n_matched, avg(abs(a.stage_date_error_days)) AS full_mae_days, avg(abs(b.stage_date_error_days)) AS ablated_mae_days,
              avg(abs(b.stage_date_error_days)) - avg(abs(a.stage_date_error_days)) AS delta_mae,
              sqrt(avg(a.stage_date_error_days * a.stage_date_error_days)) AS full_rmse_days,
              sqrt(avg(b.stage_date_error_days * b.stage_date_error_days)) AS ablated_rmse_days,
              sqrt(avg(b.stage_date_error_days * b.stage_date_error_days)) - sqrt(avg(a.stage_date_error_days * a.stage_date_error_days)) AS delta_rmse
       FROM diagnostics a JOIN diagnostics b ON a.location_id = b.location_id AND a.stage_id = b.stage_id
        AND a.prediction_date = b.prediction_date AND a.model_version = 'A' AND b.model_version = 'B'""",
    rounds="full_mae_days ablated_mae_days delta_mae full_rmse_days ablated_rmse_days delta_rmse",
)
def _(spark, sf):
    rows = A.detail(spark, sf).select(
        "model_version",
        "location_id",
        "stage_id",
        "prediction_date",
        F.datediff("predicted_stage_date", "actual_stage_date").alias("error_days"),
    )
    return H.matched_delta(
        rows.where("model_version = 'A'"),
        rows.where("model_version = 'B'"),
        ["location_id", "stage_id", "prediction_date"],
    )


@query(
    "walk_forward_summary",
    "H42",
    """SELECT trajectory_year, stage_id, count(*) AS n, avg(abs(e)) AS mae, sqrt(avg(e * e)) AS rmse, avg(e) AS bias
       FROM (SELECT trajectory_year, stage_id, CAST(predicted_stage_date - actual_stage_date AS DOUBLE) AS e FROM trajectory)
       GROUP BY trajectory_year, stage_id""",
    rounds="mae rmse bias",
)
def _(spark, sf):
    return H.walk_forward_summary(A.trajectory(spark, sf))


@query(
    "worst_trajectories",
    "H43",
    """SELECT test_year, location_id, stage_id, count(CASE WHEN post_event_positive THEN 1 END) AS n_post_event_positive
       FROM diagnostics WHERE model_version = 'A' GROUP BY test_year, location_id, stage_id
       ORDER BY 4 DESC, 1, 2, 3 LIMIT 10""",
)
def _(spark, sf):
    return P.worst_trajectories(diagnostics(spark, sf), 10, "A")


GRID_SQL = """(SELECT alpha AS ridge_alpha, theta, avg(abs(raw_signed_days * alpha / (alpha + 10.0::DOUBLE) - theta)) AS decision_mae
       FROM trajectory, (VALUES (1.0::DOUBLE), (30.0::DOUBLE), (100.0::DOUBLE)) a(alpha),
            (VALUES (2.0::DOUBLE), (4.25::DOUBLE), (6.0::DOUBLE)) t(theta) GROUP BY alpha, theta)"""


def alpha_grid(spark, sf):
    """Mean shrunk signal error at every (alpha, theta) of a small grid."""
    alphas, thetas = (1.0, 30.0, 100.0), (2.0, 4.25, 6.0)
    pairs = F.array(
        *[
            F.struct(F.lit(a).alias("ridge_alpha"), F.lit(t).alias("theta"))
            for a in alphas
            for t in thetas
        ]
    )
    rows = A.trajectory(spark, sf).select("raw_signed_days", F.explode(pairs).alias("g"))
    gap = F.col("raw_signed_days") * F.col("ridge_alpha") / (F.col("ridge_alpha") + 10.0)
    return (
        rows.select("raw_signed_days", "g.*")
        .groupBy("ridge_alpha", "theta")
        .agg(F.avg(F.abs(gap - F.col("theta"))).alias("decision_mae"))
    )


@query(
    "grid_at_alpha",
    "H44",
    f"SELECT * FROM {GRID_SQL} WHERE ridge_alpha = 30",
    rounds="decision_mae",
)
def _(spark, sf):
    return P.grid_at_alpha(alpha_grid(spark, sf), 30.0)


@query(
    "grid_near_threshold",
    "H44",
    f"SELECT * FROM {GRID_SQL} WHERE theta = 4.25",
    rounds="decision_mae",
)
def _(spark, sf):
    return P.grid_near_threshold(alpha_grid(spark, sf), 4.5)


# ---------------------------------------------------------------- model-free parts of section F


#: Locations dealt to five seasons.
SEASON_OF = "(2020 + CAST(location_id AS BIGINT) % 5)"


@query(
    "conformal_interval",
    "F5",
    f"""SELECT location_id, stage_id, prediction_date, predicted_days AS pred, predicted_days - q AS pred_lower,
              predicted_days + q AS pred_upper
       FROM trajectory JOIN (SELECT season, quantile_cont(abs(raw_signed_days - CAST(actual_stage_date - prediction_date AS DOUBLE)), 0.9) AS q
                             FROM trajectory, range(2020, 2025) s(season) WHERE {SEASON_OF} <> season GROUP BY season)
         ON {SEASON_OF} = season""",
    rounds="pred pred_lower pred_upper",
    digits=9,  # sums of binary fractions would tie at six
)
def _(spark, sf):
    """Every row with an interval that the other seasons' errors give."""
    gap = F.datediff("actual_stage_date", "prediction_date")
    rows = A.trajectory(spark, sf).select(
        "location_id",
        "stage_id",
        "prediction_date",
        F.col("predicted_days").alias("pred"),
        (2020 + F.col("location_id").cast("long") % 5).alias("season"),
        (F.col("raw_signed_days") - gap).alias("error"),
    )
    return M.cross_conformal_interval(rows, "season", 0.1).drop("season", "error")


@query(
    "interval_width_by_stage",
    "F5",
    f"""SELECT stage_id, quantile_cont(abs(raw_signed_days - CAST(actual_stage_date - prediction_date AS DOUBLE)), 0.9) AS width,
              count(*) AS n_errors FROM trajectory WHERE {SEASON_OF} < 2024 GROUP BY stage_id""",
    rounds="width",
    digits=9,
)
def _(spark, sf):
    rows = A.trajectory(spark, sf).where(2020 + F.col("location_id").cast("long") % 5 < 2024)
    errors = rows.withColumn("error", F.col("raw_signed_days") - F.datediff("actual_stage_date", "prediction_date"))
    return I.interval_width(errors, 0.1, ["stage_id"])


@query(
    "bag_counts",
    "F5",
    """SELECT tree, bag, count(*) AS n_rows, CAST(sum(raw_signed_days) AS DOUBLE) AS sum_signal FROM (
         SELECT CAST(tree AS INTEGER) AS tree, raw_signed_days, CASE WHEN u < exp(-1) THEN 0 WHEN u < 2 * exp(-1) THEN 1
             WHEN u < 2.5 * exp(-1) THEN 2 WHEN u < (2.5 + 1 / 6.0::DOUBLE) * exp(-1) THEN 3 ELSE 4 END AS bag
         FROM (SELECT tree, raw_signed_days, CAST(CAST('0x' || substr(md5(location_id || '|' || stage_id || '|' ||
                 strftime(prediction_date, '%Y-%m-%d') || '|' || tree), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0::DOUBLE AS u
               FROM trajectory, range(5) t(tree))) GROUP BY tree, bag""",
    rounds="sum_signal",
)
def _(spark, sf):
    """Rows of each bag count (four stands for four and more) of five trees."""
    rows = A.trajectory(spark, sf)
    keys = ("location_id", "stage_id", "prediction_date")
    bags = F.array(*[F.struct(F.lit(t).alias("tree"), F.least(I.bag_count(keys, t), F.lit(4)).alias("bag")) for t in range(5)])
    return (
        rows.select(F.explode(bags).alias("b"), "raw_signed_days")
        .groupBy("b.tree", "b.bag")
        .agg(F.count(F.lit(1)).alias("n_rows"), F.sum("raw_signed_days").alias("sum_signal"))
    )


@query(
    "format_predictions",
    "F6",
    """SELECT stage_id, latitude, longitude, place_id, location_id, prediction_date, trajectory_year, raw_signed_days,
              predicted_days, predicted_stage_date FROM trajectory""",
)
def _(spark, sf):
    scored = A.trajectory(spark, sf).drop("predicted_days", "predicted_stage_date")
    return M.format_predictions(scored)


@query(
    "first_hit_events",
    "F13",
    """SELECT test_year, location_id, stage_id, model_version, decision_date, actual_stage_date,
              CAST(decision_date - actual_stage_date AS DOUBLE) AS error_days FROM (
         SELECT test_year, location_id, stage_id, model_version, min(actual_stage_date) AS actual_stage_date,
                min(CASE WHEN raw_signed_days <= 4.5 THEN prediction_date END) AS decision_date
         FROM detail GROUP BY test_year, location_id, stage_id, model_version) WHERE decision_date IS NOT NULL""",
)
def _(spark, sf):
    rows = A.detail(spark, sf).withColumn(
        "adjusted", F.greatest(F.col("raw_signed_days") - 4.5, F.lit(0.0))
    )
    return M.first_hit_events(rows, ("test_year", "location_id", "stage_id", "model_version"))


LOCKED_SWEEP = """(SELECT v AS zero_threshold, count(*) AS n_rows,
         avg(CAST(CASE WHEN d.prediction_date >= l.lock_at THEN 0 ELSE d.predicted_days END > 0 AND d.prediction_date > d.actual_stage_date AS INTEGER)) AS post_event_positive_rate
       FROM (VALUES (0.5::DOUBLE), (1.0::DOUBLE), (2.0::DOUBLE)) t(v), detail d
       JOIN (SELECT v2, model_version, location_id, stage_id, min(CASE WHEN run THEN prediction_date END) AS lock_at FROM (
               SELECT v2, model_version, location_id, stage_id, prediction_date, predicted_days <= v2 AND coalesce(lead(predicted_days) OVER
                 (PARTITION BY v2, model_version, location_id, stage_id ORDER BY prediction_date) <= v2, false) AS run
               FROM detail, (VALUES (0.5::DOUBLE), (1.0::DOUBLE), (2.0::DOUBLE)) t2(v2)) GROUP BY ALL) l
         ON l.model_version = d.model_version AND l.location_id = d.location_id AND l.stage_id = d.stage_id
       WHERE l.v2 = v GROUP BY v)"""


def lock_sweep(spark, sf):
    key = ("model_version", "test_year", "location_id", "stage_id")
    return G.lock_sweep(A.detail(spark, sf), (0.5, 1.0, 2.0), 2, key)


@query(
    "sweep_lock_threshold",
    "F14",
    f"SELECT * FROM {LOCKED_SWEEP}",
    rounds="post_event_positive_rate",
)
def _(spark, sf):
    return lock_sweep(spark, sf)


@query(
    "sweep_best",
    "F14",
    f"SELECT * FROM {LOCKED_SWEEP} ORDER BY post_event_positive_rate, zero_threshold LIMIT 1",
    rounds="post_event_positive_rate",
)
def _(spark, sf):
    return P.best_rows(lock_sweep(spark, sf), ["post_event_positive_rate", "zero_threshold"])
