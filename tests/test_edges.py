"""Literal rows for the semantics that are easy to get wrong."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from seasontide.config import Settings
from seasontide.functions import scalars as S
from seasontide.operators import audits as I
from seasontide.operators import evaluation as H
from seasontide.operators import events as B
from seasontide.operators import features as D
from seasontide.operators import frames as E
from seasontide.operators import reports as P
from seasontide.operators import spatial as C
from seasontide.operators import termination as G
from seasontide.sources import readers as R

D8 = dt.date


def ts(text):
    return dt.datetime.fromisoformat(text)


EVENT = (
    "location_id string, latitude double, longitude double, stage_id int, stage_name string, "
    "stage_date timestamp_ntz"
)


def event(spark, *rows):
    return spark.createDataFrame(list(rows), EVENT)


def test_label_normalisation(spark):
    df = spark.createDataFrame([("  phase\t  2",), (None,), ("Odd",)], "stage_name string")
    got = [r[0] for r in df.select(S.normalize_label(F.col("stage_name"))).collect()]
    assert got == ["phase 2", "", "odd"]


def test_canonical_mapping_and_placeholders(spark):
    df = event(
        spark,
        ("1", 1.0, 2.0, 7, " Phase  2", ts("2025-05-01")),
        ("1", 1.0, 2.0, 7, "Phase 1", ts("2025-05-01")),
        ("1", 1.0, 2.0, 7, None, ts("2025-05-01")),
        ("1", 1.0, 2.0, 7, "stage 1", ts("2025-12-31")),
        ("1", 1.0, 2.0, 7, "Stage 1", None),
    )
    got = {(r.stage_id, r.label_source) for r in B.canonicalize_events(df).collect()}
    assert got == {(3, "observed_phase2_as_stage3"), (1, "observed_stage1")}
    assert B.canonicalize_events(df, Settings(observed_phase1=True)).count() == 3


def test_midpoint_keeps_half_days(spark):
    df = event(
        spark,
        ("1", 1.0, 2.0, 1, "Stage 1", ts("2025-04-01")),
        ("1", 1.0, 2.0, 1, "Stage 1", ts("2025-04-09")),
        ("1", 1.0, 2.0, 2, "Stage 2", ts("2025-04-06")),
        ("2", 1.0, 2.0, 2, "Stage 2", ts("2025-04-06")),
    )
    events = B.append_midpoint(B.canonicalize_events(R.type_events(df)))
    derived = events.where("is_derived_phase1").collect()
    assert [(r.location_id, r.stage_date, r.day_of_year) for r in derived] == [
        ("1", ts("2025-04-03 12:00:00"), 93)
    ]


def test_season_filter_is_literal_in_leap_years(spark):
    days = ["2023-02-28", "2023-03-01", "2023-06-01", "2024-02-29", "2024-05-31", "2024-06-01"]
    df = R.type_events(event(spark, *[("1", 1.0, 2.0, 1, "Stage 1", ts(d)) for d in days]))
    kept = sorted(str(r.stage_date.date()) for r in B.season_filter(df).collect())
    assert kept == ["2023-03-01", "2023-06-01", "2024-02-29", "2024-05-31"]


def test_coverage_gate(spark):
    df = event(spark, ("1", 1.0, 2.0, 1, "Stage 1", ts("2025-04-01")))
    coverage = B.label_coverage(df, "2026-01-01", 3)
    assert {r.stage_id: r.n_events for r in coverage.collect()} == {1: 1, 4: 0, 2: 0, 3: 0}
    with pytest.raises(RuntimeError):
        B.require_coverage(coverage)


def test_derive_phase1_only_without_direct_rows(spark):
    schema = "prediction_date date, location_id string, stage_id int, predicted_stage_date date"
    rows = [
        (D8(2025, 4, 1), "1", 1, D8(2025, 4, 4)),
        (D8(2025, 4, 1), "1", 2, D8(2025, 4, 9)),
    ]
    derived = B.derive_phase1(spark.createDataFrame(rows, schema)).where("is_derived_event")
    assert [(r.predicted_stage_date, r.predicted_days) for r in derived.collect()] == [
        (D8(2025, 4, 6), 5.0)
    ]
    rows.append((D8(2025, 4, 1), "1", 4, D8(2025, 4, 5)))
    direct = B.derive_phase1(spark.createDataFrame(rows, schema))
    assert direct.where("is_derived_event").count() == 0


def test_season_year_and_null_measures(spark):
    rows = [
        ("p", D8(2024, 2, 28), 1.0),
        ("p", D8(2024, 2, 29), 2.0),
        ("p", D8(2024, 3, 1), 4.0),
        ("p", D8(2024, 3, 2), None),
        ("p", D8(2024, 3, 5), 8.0),
    ]
    df = D.add_calendar(spark.createDataFrame(rows, "place_id string, date date, x double"))
    out = D.season_rolling(D.season_cumulative(df, ["x"]), 2, ["x"]).orderBy("date").collect()
    assert [r.pest_year for r in out] == [2023, 2023, 2024, 2024, 2024]
    assert [r.cumu_x for r in out] == [1.0, 3.0, 4.0, None, 12.0]
    # counts rows, not days
    assert [r.rolling_x for r in out] == [1.0, 1.5, 4.0, 4.0, 8.0]


def test_degree_days_keep_null(spark):
    df = spark.createDataFrame([(None, 20.0), (10.0, 30.0)], "a double, b double")
    got = df.select(S.gdd(F.col("a"), F.col("b")), S.cdd(F.col("a"), F.col("b"))).collect()
    assert [tuple(r) for r in got] == [(None, None), (0.0, 30.0)]


def season(spark, days, location="1"):
    return spark.createDataFrame(
        [(location, d, d.year, 9.0, 8.0, 1.0) for d in days],
        "location_id string, date date, pest_year int, latitude double, longitude double, f double",
    )


def test_half_day_label_targets(spark):
    days = [D8(2025, 4, 1) + dt.timedelta(i) for i in range(8)]
    events = R.type_events(event(spark, ("1", 1.0, 2.0, 4, "x", ts("2025-04-03 12:00:00"))))
    matrix = E.training_matrix(
        events, season(spark, days), "2026-01-01", Settings(post_event_days=3), features=["f"]
    )
    got = {r.date.day: (r.signed_days_to_event, r.latitude) for r in matrix.collect()}
    assert got == {1: (2, 1.0), 2: (1, 1.0), 3: (0, 1.0), 4: (0, 9.0), 5: (-1, 9.0), 6: (-2, 9.0)}
    post = E.post_event_rows(season(spark, days), events, 3).collect()
    assert sorted((r.date.day, r.signed_days_to_event) for r in post) == [(4, 0), (5, -1), (6, -2)]


def test_one_pass_labels_equal_the_separate_operators(spark):
    days = [D8(2025, 3, 20) + dt.timedelta(i) for i in range(40)]
    events = R.type_events(
        event(
            spark,
            ("1", 1.0, 2.0, 1, "a", ts("2025-04-01")),
            ("1", 1.0, 2.0, 1, "a", ts("2025-04-05")),
            ("1", 1.0, 2.0, 2, "b", ts("2025-04-10 12:00:00")),
        )
    )
    weather = season(spark, days)
    cols = ["date", "stage_id", "stage_date", "signed_days_to_event", "days_to_event", "latitude"]
    base = E.signed_target(E.coalesce_coords(E.forward_asof(weather, events)))
    want = E.augment(base, E.post_event_rows(weather, events, 5)).select(*cols)
    got = E.training_matrix(
        events,
        weather,
        "2026-01-01",
        Settings(post_event_days=5, window_years=None),
        features=["f"],
    ).select(*cols)
    assert sorted(map(tuple, want.collect())) == sorted(map(tuple, got.collect()))


def test_nearest_tie_and_far_points(spark):
    grid = spark.createDataFrame(
        [("b", 10.0, 10.0), ("a", 10.0, 12.0), ("c", -60.0, 170.0)],
        "place_id string, centroid_lat double, centroid_lon double",
    )
    points = spark.createDataFrame(
        [("t", 10.0, 11.0), ("far", 89.0, -179.0), ("s", -59.9, 170.3)],
        "location_id string, latitude double, longitude double",
    )
    got = {r.location_id: r.place_id for r in C.nearest_centroid(points, grid).collect()}
    assert got == {"t": "a", "far": "b", "s": "c"}


def test_nearest_haversine_crosses_the_date_line(spark):
    grid = spark.createDataFrame(
        [("w", 0.0, -179.9), ("e", 0.0, 170.0)],
        "place_id string, centroid_lat double, centroid_lon double",
    )
    points = spark.createDataFrame(
        [("x", 0.0, 179.9)], "loc string, latitude double, longitude double"
    )
    row = C.nearest_haversine(points, grid).first()
    assert row.place_id == "w" and abs(row.distance_km - 22.239) < 0.01


def test_nearest_matches_brute_force(spark):
    import random

    rng = random.Random(3)
    g = [(f"g{i}", rng.uniform(-80, 80), rng.uniform(-179, 179)) for i in range(300)]
    p = [(f"p{i}", rng.uniform(-89, 89), rng.uniform(-179, 179)) for i in range(200)]
    grid = spark.createDataFrame(g, "place_id string, centroid_lat double, centroid_lon double")
    pts = spark.createDataFrame(p, "location_id string, latitude double, longitude double")
    want = {n: min(((a - x) ** 2 + (o - y) ** 2, k) for k, a, o in g)[1] for n, x, y in p}
    got = {r.location_id: r.place_id for r in C.nearest_centroid(pts, grid).collect()}
    assert got == want
    import math

    def km(a, o, x, y):
        a, o, x, y = map(math.radians, (a, o, x, y))
        h = math.sin((a - x) / 2) ** 2 + math.cos(a) * math.cos(x) * math.sin((o - y) / 2) ** 2
        return 2 * math.asin(math.sqrt(h))

    want = {n: min((km(a, o, x, y), k) for k, a, o in g)[1] for n, x, y in p}
    pts = pts.withColumnRenamed("location_id", "loc")
    got = {r.loc: r.place_id for r in C.nearest_haversine(pts, grid).collect()}
    assert got == want


def test_polygon_edges_holes_and_sizes(spark):
    square = "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 2 1, 2 2, 1 2, 1 1))"
    tiny = "MULTIPOLYGON (((10 10, 10.01 10, 10.01 10.01, 10 10)))"
    cells = spark.createDataFrame([("a", square), ("b", tiny)], "place_id string, boundary string")
    points = spark.createDataFrame(
        [
            ("in", 3.0, 3.0),
            ("edge", 4.0, 2.0),
            ("hole", 1.5, 1.5),
            ("tri", 10.002, 10.008),
            ("out", 10.008, 10.002),
        ],
        "location_id string, latitude double, longitude double",
    )
    got = {r.location_id: r.place_id for r in C.locate_in_cells(points, cells).collect()}
    assert got == {"in": "a", "edge": None, "hole": None, "tri": "b", "out": None}


def track(spark, values, start=D8(2025, 4, 1)):
    rows = [
        (2025, "1", 1, 5.0, 6.0, start + dt.timedelta(i), v, None if v is None else max(v, 0.0))
        for i, v in enumerate(values)
    ]
    return spark.createDataFrame(
        rows,
        "trajectory_year int, location_id string, stage_id int, latitude double, longitude double, "
        "prediction_date date, raw_signed_days double, predicted_days double",
    ).withColumn("predicted_stage_date", F.col("prediction_date"))


def test_first_hit_needs_eight_visible_days(spark):
    def decision(values):
        df = track(spark, values).withColumn("learned_days_remaining", F.col("raw_signed_days"))
        out = G.lock_trajectories(df).orderBy("prediction_date").collect()
        flags = [i + 1 for i, r in enumerate(out) if r.termination_first_hit]
        return flags, [r.termination_reached for r in out], out

    # a hit on day 7 is not eligible, the one on day 8 locks, and a bounce stays locked
    flags, reached, out = decision([9.0] * 6 + [1.0, 2.0, 30.0])
    assert flags == [8] and reached == [False] * 7 + [True, True]
    assert out[-1].predicted_days == 0.0 and out[-1].base_predicted_days == 30.0
    assert out[-1].predicted_stage_date == D8(2025, 4, 8)
    assert out[5].predicted_days == 9.0 and not out[5].termination_output_applied
    assert decision([1.0] * 7)[0] == []
    assert decision([None] * 9)[0] == []


def test_recent_and_crossing_edges(spark):
    one = G.termination_features(track(spark, [5.0])).first()
    assert one.recent_mean_3 is None and one.rolling_linear_crossing_0 is None
    rows = G.termination_features(track(spark, [3.0, 2.0, 1.0])).orderBy("prediction_date").collect()
    assert [r.recent_std_3 for r in rows][:2] == [None, None]
    assert rows[2].rolling_linear_crossing_0 == pytest.approx(94.0)
    assert rows[2].days_to_rolling_crossing_minus_0_5 == pytest.approx(1.5)
    flat = G.termination_features(track(spark, [2.0, 2.0])).orderBy("prediction_date").collect()
    assert flat[1].rolling_linear_crossing_0 is None


def test_zero_day_lock_needs_a_run(spark):
    df = track(spark, [0.5, 3.0, 0.9, 0.2, 7.0])
    out = G.zero_day_lock(df, 1.0, 2, G.TRAJECTORY, True).orderBy("prediction_date").collect()
    assert [r.predicted_days for r in out] == [0.5, 3.0, 0.0, 0.0, 0.0]
    assert [r.termination_reached for r in out] == [False, False, True, True, True]
    with pytest.raises(ValueError):
        G.zero_day_lock(df, 1.0, 1)


def test_floor_days_and_fractions(spark):
    df = spark.createDataFrame(
        [(ts("2025-04-03 12:00:00"), D8(2025, 4, 4))], "a timestamp_ntz, b date"
    )
    row = df.select(
        S.floor_days(F.col("a"), F.col("b")).alias("f"), S.days_between(F.col("a"), F.col("b")).alias("d")
    ).first()
    assert (row.f, row.d) == (-1, -0.5)


def test_requests_are_rejected(spark):
    rows = [("a", 1.0, 2.0, "9/24/25", "2025-10-01"), ("b", 1.0, 2.0, "soon", "2025-10-01")]
    schema = "loc string, latitude double, longitude double, start_date string, end_date string"
    out = R.read_requests(spark.createDataFrame(rows, schema))
    assert [r.status for r in out.orderBy("loc").collect()] == ["ok", "unparsable"]
    assert out.where("loc = 'a'").first().start_date == D8(2025, 9, 24)
    with pytest.raises(ValueError):
        R.require_requests(out)


def test_feature_contract(spark):
    rows = [("1", "p", D8(2025, 4, 1), 1.0, 2.0, 3.0)] * 2
    schema = (
        "location_id string, place_id string, date date, latitude double, longitude double, f double"
    )
    df = spark.createDataFrame(rows, schema)
    with pytest.raises(ValueError, match="duplicate"):
        I.require_features(df, ["f"])
    I.require_features(df.limit(1), ["f"])


def test_gaps_and_segments(spark):
    days = [D8(2025, 1, d) for d in (1, 2, 4, 5, 6, 9)]
    df = spark.createDataFrame([("p", d) for d in days], "place_id string, date date")
    runs = [(r.start_date.day, r.end_date.day, r.n_days) for r in I.date_segments(df).collect()]
    assert sorted(runs) == [(1, 2, 2), (4, 6, 3), (9, 9, 1)]
    index = spark.createDataFrame([("p", "20250101", "20250110"), ("q", "20250101", "20250102")],
                                  "place_id string, start_compact string, end_compact string")
    gaps = {r.place_id: r for r in I.date_gaps(df, I.normalize_index(index)).collect()}
    assert [d.day for d in gaps["p"].missing_dates] == [3, 7, 8, 10]
    assert gaps["q"].missing_count == 2 and gaps["q"].actual_dates == 0


def test_behaviour_rates_are_null_without_rows(spark):
    rows = [("A", "1", 1, D8(2025, 4, 9), D8(2025, 4, 1), 3.0)]
    df = spark.createDataFrame(
        rows,
        "model_version string, location_id string, stage_id int, stage_date date, "
        "prediction_date date, predicted_days double",
    )
    row = H.behavior_summary(df).first()
    assert row.bounce_back_rate is None and row.post_event_positive_rate is None


def test_error_metrics_treat_missing_errors_differently(spark):
    df = spark.createDataFrame(
        [(2025, 1, 2), (2025, 1, None)], "prediction_year int, stage_id int, error_days int"
    )
    by_year = H.error_summary(df).where("scope = 'year'").first()
    assert (by_year.n_predictions, by_year.within_3d) == (2, 0.5)
    overall = H.scope_metrics(df).where("scope = 'overall'").first()
    assert (overall.n, overall.within_7d) == (1, 1.0)


def test_ols_band_needs_three_points_and_spread(spark):
    df = spark.createDataFrame(
        [("a", 1.0, 2.0), ("a", 2.0, 4.0), ("b", 1.0, 1.0), ("b", 1.0, 2.0), ("b", 1.0, 3.0)],
        "k string, x double, y double",
    )
    assert P.ols_band(df, "x", "y", [1.0], ["k"]).count() == 0


def test_schedule_contains_grid_and_events(spark):
    df = spark.createDataFrame(
        [(2025, ts("2025-03-05")), (2025, ts("2025-07-01"))], "year int, stage_date timestamp_ntz"
    )
    got = {r.prediction_date for r in H.prediction_schedule(df, [2025], step=30).collect()}
    assert got == {D8(2025, 3, 1), D8(2025, 3, 5), D8(2025, 3, 31), D8(2025, 4, 30), D8(2025, 5, 30)}


def test_nearest_takes_any_longitude_convention(spark):
    from seasontide.operators import spatial

    points = spark.createDataFrame([(0.0, 300.0)], "latitude double, longitude double")
    grid = spark.createDataFrame([("A", 0.0, 301.0), ("B", 0.0, 100.0)], "place_id string, g_lat double, g_lon double")
    near = spatial._with_nearest(points, grid, "latitude", "longitude", sphere=False)
    assert [r.place_id for r in near.collect()] == ["A"]
    only = spatial._with_nearest(points, grid.where("place_id = 'B'"), "latitude", "longitude", sphere=False)
    assert [r.place_id for r in only.collect()] == ["B"]


def test_scoring_keeps_rows_with_missing_features(spark):
    from seasontide.operators import models

    rows = [(float(i), float(i % 7), float(i)) for i in range(40)]
    train = spark.createDataFrame(rows, "a double, b double, y double")
    model = models.fit_rf(train, ["a", "b"], "y", {"numTrees": 2, "maxDepth": 2})
    scored = models.score(model, spark.createDataFrame([(1.0, 2.0), (1.0, None)], "a double, b double"), ["a", "b"])
    found = {r.b: r[models.RAW] for r in scored.collect()}
    assert found[2.0] is not None and found[None] is None


def test_fractional_percentiles_and_reversed_intervals(spark):
    from pyspark.sql import functions as F

    from seasontide.operators import audits, evaluation

    errors = spark.createDataFrame([(0.9,), (0.9,), (1.9,)], "e double")
    assert errors.agg(evaluation.day_percentile(F.col("e"), 0.5)).first()[0] == 0.9
    index = spark.sql("SELECT 'p' AS place_id, DATE'2024-01-05' AS start_date, DATE'2024-01-02' AS end_date")
    have = spark.sql("SELECT 'p' AS place_id, DATE'2024-01-03' AS date")
    row = audits.date_gaps(have, index).first()
    assert (row.expected_dates, row.missing_count, row.missing_dates) == (0, 0, [])
