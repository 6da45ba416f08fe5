"""SQL definitions of the adapter views and of intermediate results, for the oracles.

Written from the operator specifications, independently of the Spark code.
"""

VIEWS = {
    "nplaces": "SELECT count(*) AS n FROM supplier",
    "locations": """
        SELECT CAST(s_suppkey AS VARCHAR) AS location_id, 'grid_' || s_suppkey AS place_id,
               36.0::DOUBLE + (s_suppkey * 7 % 90) / 10.0::DOUBLE AS latitude,
               -90.0::DOUBLE + (s_suppkey * 13 % 200) / 10.0::DOUBLE AS longitude,
               CAST(s_nationkey AS VARCHAR) AS state
        FROM supplier""",
    "coverage": """
        SELECT l.latitude + 0.03::DOUBLE AS centroid_lat, l.longitude - 0.04::DOUBLE AS centroid_lon, l.place_id,
               CASE WHEN s.s_acctbal >= 0 THEN l.location_id END AS location_id,
               CASE WHEN s.s_acctbal >= 0 THEN l.latitude END AS latitude,
               CASE WHEN s.s_acctbal >= 0 THEN l.longitude END AS longitude,
               l.state AS state_code
        FROM locations l JOIN supplier s ON CAST(s.s_suppkey AS VARCHAR) = l.location_id""",
    "weather_daily": """
        SELECT 'grid_' || l_suppkey AS place_id,
               36.0::DOUBLE + (l_suppkey * 7 % 90) / 10.0::DOUBLE AS centroid_lat,
               -90.0::DOUBLE + (l_suppkey * 13 % 200) / 10.0::DOUBLE AS centroid_lon,
               CAST(l_shipdate AS DATE) AS date,
               max(l_quantity) * 0.8::DOUBLE AS air_temp_max_c,
               min(l_quantity) * 0.4::DOUBLE AS air_temp_min_c,
               CAST(sum(CAST(round(l_tax * 100) AS BIGINT)) AS DOUBLE) AS precip_total_mm,
               50.0::DOUBLE + sum(CAST(round(l_discount * 100) AS BIGINT)) * 4.0::DOUBLE / count(*) AS humidity_mean_pct
        FROM lineitem GROUP BY l_suppkey, CAST(l_shipdate AS DATE)""",
    "weather_rows": """
        SELECT CAST(l_suppkey AS VARCHAR) AS loc, CAST(l_suppkey AS VARCHAR) AS location_id,
               CAST(l_shipdate AS DATE) AS date, l_quantity AS tmax, l_discount AS hum,
               l_orderkey AS pull_id, l_linenumber AS pull_line
        FROM lineitem""",
    "raw_events": """
        SELECT CAST(k AS VARCHAR) AS location_id,
               36.0::DOUBLE + (k * 7 % 90) / 10.0::DOUBLE AS latitude,
               -90.0::DOUBLE + (k * 13 % 200) / 10.0::DOUBLE AS longitude,
               digit AS stage_id,
               CASE digit WHEN 1 THEN 'Stage 1' WHEN 2 THEN ' stage  2 ' WHEN 3 THEN 'Stage 3'
                          WHEN 4 THEN 'Phase 1' ELSE 'PHASE 2' END AS stage_name,
               stage_date
        FROM (SELECT o_custkey % (SELECT n FROM nplaces) AS k,
                     CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS digit,
                     CAST(o_orderdate AS TIMESTAMP) AS stage_date FROM orders)""",
    "canon": """
        SELECT location_id, latitude, longitude, stage_date,
               stage_name AS stage_name_raw, stage_id AS raw_stage_id,
               CASE stage_id WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 3 END AS stage_id,
               CASE stage_id WHEN 1 THEN 'observed_stage1' WHEN 2 THEN 'observed_stage2'
                    WHEN 3 THEN 'observed_stage3' ELSE 'observed_phase2_as_stage3' END AS label_source,
               CAST(year(stage_date) AS INTEGER) AS year,
               CAST(dayofyear(stage_date) AS INTEGER) AS day_of_year
        FROM raw_events
        WHERE stage_id IN (1, 2, 3, 5) AND strftime(stage_date, '%m-%d') <> '12-31'""",
    "midpoints": """
        SELECT f.location_id, f.latitude, f.longitude,
               p.s1 + (p.s2 - p.s1) / 2 AS stage_date,
               'Derived Phase 1 midpoint' AS stage_name_raw, f.raw_stage_id, 4 AS stage_id,
               'derived_phase1_midpoint_stage1_stage2' AS label_source, f.year,
               CAST(dayofyear(p.s1 + (p.s2 - p.s1) / 2) AS INTEGER) AS day_of_year,
               p.s1 AS phase1_stage1_date, p.s2 AS phase1_stage2_date
        FROM (SELECT location_id, year, min(CASE WHEN stage_id = 1 THEN stage_date END) AS s1,
                     min(CASE WHEN stage_id = 2 THEN stage_date END) AS s2
              FROM canon WHERE stage_id IN (1, 2) GROUP BY ALL) p
        JOIN (SELECT *, row_number() OVER (PARTITION BY location_id, year
                     ORDER BY stage_date, stage_id, stage_name_raw) AS rn
              FROM canon WHERE stage_id IN (1, 2)) f
          ON f.location_id = p.location_id AND f.year = p.year AND f.rn = 1
        WHERE p.s1 IS NOT NULL AND p.s2 IS NOT NULL""",
    "labelled": """
        SELECT location_id, latitude, longitude, stage_date, stage_name_raw, stage_id, label_source,
               year, day_of_year, 0 AS src FROM canon
        UNION ALL
        SELECT location_id, latitude, longitude, stage_date, stage_name_raw, stage_id, label_source,
               year, day_of_year, 2 AS src FROM midpoints""",
    "deduped": """
        SELECT * EXCLUDE (rn) FROM (
            SELECT *, row_number() OVER (PARTITION BY latitude, longitude, year, stage_id
                   ORDER BY src, stage_date, location_id, label_source, stage_name_raw) AS rn
            FROM labelled) WHERE rn = 1""",
    "prepared": """
        SELECT * FROM deduped WHERE day_of_year BETWEEN 60 AND 152 AND location_id <> '5'""",
    "feat0": """
        SELECT place_id, centroid_lat AS latitude, centroid_lon AS longitude, date,
               air_temp_max_c, air_temp_min_c, precip_total_mm, humidity_mean_pct,
               air_temp_max_c * 9 / 5 + 32 AS air_temp_max_f,
               air_temp_min_c * 9 / 5 + 32 AS air_temp_min_f,
               CAST(dayofyear(date) AS INTEGER) AS doy,
               CAST(CASE WHEN month(date) < 3 THEN year(date) - 1 ELSE year(date) END AS INTEGER) AS pest_year
        FROM weather_daily""",
    "feat1": """
        SELECT *, greatest((air_temp_max_f + air_temp_min_f) / 2 - 50.0::DOUBLE, 0.0::DOUBLE) AS gdd_air,
               greatest(50.0::DOUBLE - (air_temp_min_f + air_temp_max_f) / 2, 0.0::DOUBLE) AS cdd_air
        FROM feat0""",
    "features": """
        SELECT *,
               sum(gdd_air) OVER c AS cumu_gdd_air, sum(precip_total_mm) OVER c AS cumu_precip_total_mm,
               sum(humidity_mean_pct) OVER c AS cumu_humidity_mean_pct, sum(cdd_air) OVER c AS cumu_cdd_air,
               avg(gdd_air) OVER r AS rolling_gdd_air, avg(precip_total_mm) OVER r AS rolling_precip_total_mm,
               avg(humidity_mean_pct) OVER r AS rolling_humidity_mean_pct, avg(cdd_air) OVER r AS rolling_cdd_air
        FROM feat1
        WINDOW c AS (PARTITION BY pest_year, place_id ORDER BY date ROWS UNBOUNDED PRECEDING),
               r AS (PARTITION BY pest_year, place_id ORDER BY date ROWS 13 PRECEDING)""",
    "located": """
        SELECT f.*, l.location_id FROM features f JOIN locations l ON f.place_id = l.place_id""",
    "nextev": """
        SELECT w.*, e.stage_id, e.stage_date, e.day_of_year, e.latitude AS event_latitude,
               e.longitude AS event_longitude
        FROM located w
        JOIN (SELECT w2.location_id, w2.date, e2.stage_id, min(e2.stage_date) AS next_date
              FROM located w2 JOIN prepared e2
                ON w2.location_id = e2.location_id AND w2.pest_year = e2.year
               AND e2.stage_date >= w2.date GROUP BY ALL) n
          ON n.location_id = w.location_id AND n.date = w.date
        JOIN prepared e ON e.location_id = w.location_id AND e.year = w.pest_year
          AND e.stage_id = n.stage_id AND e.stage_date = n.next_date""",
    "postrows": """
        SELECT w.*, e.stage_id, e.stage_date, e.day_of_year,
               -CAST(floor(epoch(w.date::TIMESTAMP - e.stage_date) / 86400.0) AS INTEGER) AS signed_days_to_event
        FROM located w JOIN prepared e
          ON w.location_id = e.location_id AND w.pest_year = e.year
         AND w.date >= e.stage_date AND w.date <= e.stage_date + INTERVAL 10 DAY""",
    "matrix": """
        SELECT date, location_id, pest_year, stage_id, signed_days_to_event,
               latitude, longitude, cumu_gdd_air, rolling_gdd_air FROM (
          SELECT *, row_number() OVER (PARTITION BY date, location_id, pest_year, stage_id
                                       ORDER BY rnk, stage_date) AS rn FROM (
            SELECT date, location_id, pest_year, stage_id, stage_date, event_latitude AS latitude,
                   event_longitude AS longitude, cumu_gdd_air, rolling_gdd_air,
                   CAST(day_of_year - doy AS INTEGER) AS signed_days_to_event, 1 AS rnk
            FROM nextev WHERE date >= DATE '1996-06-01' AND date < DATE '1999-06-01'
            UNION ALL
            SELECT date, location_id, pest_year, stage_id, stage_date, latitude, longitude,
                   cumu_gdd_air, rolling_gdd_air, signed_days_to_event, 0 AS rnk
            FROM postrows WHERE date < DATE '1999-06-01'))
        WHERE rn = 1""",
    "ev": """
        SELECT user_id, CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 4
                             WHEN 'purchase' THEN 2 ELSE 3 END AS stage_id,
               CAST(ts AS DATE) AS prediction_date, CAST(round(value * 100) AS BIGINT) AS cents
        FROM events""",
    "sig": """
        SELECT user_id, stage_id, prediction_date,
               floor((25.0::DOUBLE - day(prediction_date)
                     + (sum(cents) / (count(*) * 100.0::DOUBLE) - 50.0::DOUBLE) / 10.0::DOUBLE) * 64.0::DOUBLE) / 64.0::DOUBLE AS raw_signed_days
        FROM ev GROUP BY user_id, stage_id, prediction_date""",
    "trajectory": """
        SELECT CAST(user_id AS VARCHAR) AS location_id,
               'grid_' || (user_id % (SELECT n FROM nplaces)) AS place_id, stage_id,
               36.0::DOUBLE + (user_id % (SELECT n FROM nplaces) * 7 % 90) / 10.0::DOUBLE AS latitude,
               -90.0::DOUBLE + (user_id % (SELECT n FROM nplaces) * 13 % 200) / 10.0::DOUBLE AS longitude,
               prediction_date, CAST(year(prediction_date) AS INTEGER) AS trajectory_year,
               raw_signed_days, greatest(raw_signed_days, 0.0::DOUBLE) AS predicted_days,
               prediction_date + CAST(floor(greatest(raw_signed_days, 0.0::DOUBLE)) AS INTEGER) AS predicted_stage_date,
               DATE '2024-01-10' + CAST(user_id % 12 AS INTEGER) AS actual_stage_date
        FROM sig""",
    "dup_predictions": """
        SELECT CAST(user_id AS VARCHAR) AS location_id,
               'grid_' || (user_id % (SELECT n FROM nplaces)) AS place_id, stage_id,
               36.0::DOUBLE + (user_id % (SELECT n FROM nplaces) * 7 % 90) / 10.0::DOUBLE AS latitude,
               -90.0::DOUBLE + (user_id % (SELECT n FROM nplaces) * 13 % 200) / 10.0::DOUBLE AS longitude,
               prediction_date, CAST(year(prediction_date) AS INTEGER) AS trajectory_year,
               raw AS raw_signed_days, greatest(raw, 0.0::DOUBLE) AS predicted_days
        FROM (SELECT *, floor((25.0::DOUBLE - day(prediction_date)
                     + (cents / 100.0::DOUBLE - 50.0::DOUBLE) / 10.0::DOUBLE) * 64.0::DOUBLE) / 64.0::DOUBLE AS raw FROM ev)""",
    "detail": """
        SELECT * EXCLUDE (raw_signed_days, predicted_days, predicted_stage_date, v, d),
               2024 AS test_year, v AS model_version,
               raw_signed_days + d AS raw_signed_days,
               greatest(raw_signed_days + d, 0.0::DOUBLE) AS predicted_days,
               prediction_date + CAST(floor(greatest(raw_signed_days + d, 0.0::DOUBLE)) AS INTEGER) AS predicted_stage_date
        FROM trajectory, (VALUES ('A', 0.0::DOUBLE), ('B', 1.0::DOUBLE)) s(v, d)""",
    "track_events": """
        SELECT DISTINCT location_id, stage_id, 2024 AS year, actual_stage_date AS stage_date,
               latitude, longitude,
               'S' || (CAST(location_id AS BIGINT) % (SELECT n FROM nplaces) % 7) AS location_state,
               'loc ' || location_id AS location_name
        FROM trajectory""",
    "cache_index": """
        SELECT DISTINCT 'grid_' || l_suppkey AS place_id, min(CAST(l_shipdate AS DATE)) AS start_date,
               max(CAST(l_shipdate AS DATE)) AS end_date
        FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal >= 0)
        GROUP BY l_suppkey, year(l_shipdate)""",
    "signal": """
        SELECT *, raw_signed_days AS signal, CAST(dayofyear(prediction_date) AS DOUBLE) AS pdoy
        FROM trajectory""",
    "lagged": """
        SELECT *, lag(signal, 1) OVER w AS signal_lag1, lag(signal, 2) OVER w AS signal_lag2,
               lag(signal, 3) OVER w AS signal_lag3
        FROM signal WINDOW w AS (PARTITION BY trajectory_year, location_id, stage_id ORDER BY prediction_date)""",
    "crossed": """
        SELECT *,
          CASE WHEN lo < hi AND abs(slope) > 1e-8 THEN (0.0::DOUBLE - icpt) / slope END AS crossing_0,
          CASE WHEN lo < hi AND abs(slope) > 1e-8 THEN (-0.5::DOUBLE - icpt) / slope END AS crossing_m05
        FROM (SELECT *, regr_slope(signal, pdoy) OVER w AS slope, regr_intercept(signal, pdoy) OVER w AS icpt,
                     min(pdoy) OVER w AS lo, max(pdoy) OVER w AS hi
              FROM signal WINDOW w AS (PARTITION BY trajectory_year, location_id, stage_id
                     ORDER BY prediction_date ROWS UNBOUNDED PRECEDING))""",
    "lock0": """
        SELECT *, greatest(raw_signed_days - 4.5::DOUBLE, 0.0::DOUBLE) AS adjusted0,
               dense_rank() OVER (PARTITION BY trajectory_year, location_id, stage_id
                                  ORDER BY prediction_date) AS hist
        FROM trajectory""",
    "locked": """
        SELECT l.*, d.decision, coalesce(l.prediction_date >= d.decision, false) AS reached,
               coalesce(l.prediction_date = d.decision, false) AS first_hit,
               CASE WHEN l.prediction_date >= d.decision THEN 0.0::DOUBLE ELSE adjusted0 END AS adjusted,
               hist > 7 AS applied
        FROM lock0 l LEFT JOIN (
            SELECT trajectory_year, location_id, stage_id, min(prediction_date) AS decision
            FROM lock0 WHERE hist > 7 AND adjusted0 <= 0 GROUP BY ALL) d
          USING (trajectory_year, location_id, stage_id)""",
    "windows": """
        SELECT year AS event_year, location_id, stage_id, stage_date, latitude, longitude,
               CAST(stage_date + CAST(o AS INTEGER) AS DATE) AS prediction_date, CAST(o AS INTEGER) AS days_from_event
        FROM track_events, range(-3, 4) t(o)""",
    "window_detail": """
        SELECT w.*, p.raw_signed_days, p.predicted_days, p.predicted_stage_date,
               CAST(p.predicted_stage_date - w.stage_date AS INTEGER) AS error_days,
               CAST(abs(p.predicted_stage_date - w.stage_date) AS INTEGER) AS abs_error_days,
               coalesce(p.predicted_days <= 0, false) AS terminated,
               coalesce(p.predicted_days <= 1.0, false) AS near_zero
        FROM windows w LEFT JOIN trajectory p USING (location_id, stage_id, prediction_date)""",
    "window_level": """
        SELECT event_year, stage_id, location_id, stage_date, count(*) AS n_prediction_rows,
               min(predicted_days) AS min_predicted_days,
               max(CASE WHEN days_from_event = 0 THEN predicted_days END) AS day0_predicted_days,
               quantile_cont(abs_error_days, 0.5) AS median_abs_error_days,
               avg(abs_error_days) AS mean_abs_error_days,
               quantile_cont(abs_error_days, 0.9) AS p90_abs_error_days,
               bool_or(terminated) AS terminated_within_window,
               bool_or(near_zero) AS near_zero_within_window
        FROM window_detail GROUP BY event_year, stage_id, location_id, stage_date""",
    "diagnostics": """
        SELECT *, CAST(prediction_date - actual_stage_date AS INTEGER) AS days_from_event,
               CAST(predicted_stage_date - actual_stage_date AS INTEGER) AS stage_date_error_days,
               CAST(abs(predicted_stage_date - actual_stage_date) AS INTEGER) AS abs_stage_date_error_days,
               abs(predicted_stage_date - actual_stage_date) <= 3 AS within_3d,
               abs(predicted_stage_date - actual_stage_date) <= 5 AS within_5d,
               abs(predicted_stage_date - actual_stage_date) <= 7 AS within_7d,
               predicted_days - lag(predicted_days) OVER w AS predicted_days_delta,
               CAST(predicted_stage_date - lag(predicted_stage_date) OVER w AS INTEGER) AS predicted_stage_date_delta_days,
               coalesce(predicted_days - lag(predicted_days) OVER w > 0, false) AS bounce_up,
               prediction_date > actual_stage_date AND predicted_days > 0 AS post_event_positive,
               coalesce(prediction_date >= min(CASE WHEN raw_signed_days <= 0 THEN prediction_date END)
                   OVER (PARTITION BY model_version, test_year, location_id, stage_id), false) AS termination_reached
        FROM detail WINDOW w AS (PARTITION BY model_version, test_year, location_id, stage_id ORDER BY prediction_date)""",
    "zero_detail": """
        SELECT *, CAST(first_zero_prediction_date - actual_stage_date AS INTEGER) AS zero_day_error_days,
               CAST(abs(first_zero_prediction_date - actual_stage_date) AS INTEGER) AS abs_zero_day_error_days
        FROM (SELECT model_version, test_year, location_id, stage_id,
                     min(actual_stage_date) AS actual_stage_date, min(prediction_date) AS first_prediction_date,
                     max(prediction_date) AS last_prediction_date, count(*) AS n_prediction_rows,
                     bool_or(predicted_days <= 0) AS zero_day_reached,
                     min(CASE WHEN predicted_days <= 0 THEN prediction_date END) AS first_zero_prediction_date
              FROM detail GROUP BY ALL)""",
    "zero_summary": """
        SELECT model_version, test_year, stage_id, count(*) AS n_trajectories,
               count_if(zero_day_reached) AS zero_day_reached_count,
               avg(CAST(zero_day_reached AS INTEGER)) AS zero_day_reached_rate,
               avg(zero_day_error_days) AS mean_zero_day_error_days,
               quantile_cont(zero_day_error_days, 0.5) AS median_zero_day_error_days,
               avg(abs_zero_day_error_days) AS mean_abs_zero_day_error_days,
               quantile_cont(abs_zero_day_error_days, 0.5) AS median_abs_zero_day_error_days,
               quantile_cont(abs_zero_day_error_days, 0.9) AS p90_abs_zero_day_error_days,
               count_if(zero_day_error_days < 0) AS early_zero_count,
               count_if(zero_day_error_days = 0) AS exact_zero_count,
               count_if(zero_day_error_days > 0) AS late_zero_count
        FROM zero_detail GROUP BY model_version, test_year, stage_id""",
    "lead_eval": """
        SELECT p.location_id, p.stage_id, p.trajectory_year AS prediction_year, p.prediction_date,
               p.predicted_stage_date, e.stage_date AS actual_stage_date,
               CAST(p.predicted_stage_date - e.stage_date AS INTEGER) AS error_days,
               p.latitude, p.longitude, e.location_state, e.location_name
        FROM trajectory p JOIN track_events e
          ON p.location_id = e.location_id AND p.stage_id = e.stage_id
         AND p.prediction_date + 7 = e.stage_date""",
    "track_summary": """
        SELECT model_version, test_year, stage_id, count(*) AS n_prediction_rows,
               count(DISTINCT location_id) AS n_trajectories,
               avg(stage_date_error_days) AS bias_stage_date_error,
               avg(abs_stage_date_error_days) AS mae_stage_date_error,
               sqrt(avg(stage_date_error_days * stage_date_error_days)) AS rmse_stage_date_error,
               quantile_cont(abs_stage_date_error_days, 0.5) AS median_abs_stage_date_error,
               quantile_cont(abs_stage_date_error_days, 0.9) AS p90_abs_stage_date_error,
               avg(CAST(within_3d AS INTEGER)) AS within_3d_rate,
               avg(CAST(within_5d AS INTEGER)) AS within_5d_rate,
               avg(CAST(within_7d AS INTEGER)) AS within_7d_rate,
               avg(CAST(bounce_up AS INTEGER)) AS bounce_up_rate,
               avg(CAST(post_event_positive AS INTEGER)) AS post_event_positive_rate,
               avg(CAST(termination_reached AS INTEGER)) AS termination_reached_rate
        FROM diagnostics GROUP BY model_version, test_year, stage_id""",
    "banded": """
        SELECT *, CASE WHEN latitude >= 33 AND latitude < 35 THEN '33-35N'
                       WHEN latitude >= 35 AND latitude < 37 THEN '35-37N'
                       WHEN latitude >= 37 AND latitude < 39 THEN '37-39N'
                       WHEN latitude >= 39 AND latitude < 40 THEN '39-40N'
                       WHEN latitude >= 40 AND latitude < 42 THEN '40-42N' END AS lat_band
        FROM trajectory""",
    "band_days": """
        SELECT *, mean_predicted_days - lag(mean_predicted_days) OVER
                 (PARTITION BY lat_band ORDER BY prediction_date) AS predicted_days_diff
        FROM (SELECT lat_band, prediction_date, avg(predicted_days) AS mean_predicted_days,
                     quantile_cont(predicted_days, 0.5) AS median_predicted_days,
                     avg(raw_signed_days) AS mean_raw_signed_days,
                     avg(CAST(predicted_stage_date - prediction_date AS INTEGER)) AS mean_predicted_stage_day,
                     count(DISTINCT place_id) AS n_places
              FROM banded WHERE lat_band IS NOT NULL GROUP BY lat_band, prediction_date)""",
    "islands": """
        SELECT place_id, min(date) AS start_date, max(date) AS end_date, count(*) AS n_days
        FROM (SELECT *, date - CAST(row_number() OVER (PARTITION BY place_id ORDER BY date) AS INTEGER) AS grp
              FROM (SELECT DISTINCT place_id, date FROM weather_daily))
        GROUP BY place_id, grp""",
}
