"""Skew, whole results and plan shapes."""

import datetime
import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from seasontide.functions.ordering import first_n, keep_first, number_rows
from seasontide.functions.quantiles import exact_percentiles
from seasontide.operators import evaluation as H
from seasontide.operators import features as D
from seasontide.operators import spatial as C
from seasontide.plans import catalog


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all rows under one key, many of them copies; plus a NULL key."""
    rng = random.Random(5)
    rows = [("hot", round(rng.gauss(0, 40), rng.choice((0, 3, 9)))) for _ in range(2000)]
    rows += [("hot", 1.25)] * 1000
    rows += [(f"k{rng.randrange(400)}", rng.uniform(-9000, 9000)) for _ in range(5000)]
    rows += [(None, 4.0), (None, 5.0), ("one", 7.5), ("none", None), ("nan", float("nan"))]
    return rows, spark.createDataFrame(rows, "k string, v double").repartition(8)


def test_percentiles_equal_numpy(skewed):
    rows, df = skewed
    wanted = {"p50": ("v", 0.5), "p90": ("v", 0.9), "p0": ("v", 0.0), "p100": ("v", 1.0)}
    got = {r.k: r for r in exact_percentiles(df, ["k"], wanted).collect()}
    groups = {}
    for k, v in rows:
        if v is not None and v == v:
            groups.setdefault(k, []).append(v)
    assert set(got) == set(groups)
    for k, values in groups.items():
        for name, (_, p) in wanted.items():
            assert got[k][name] == pytest.approx(np.percentile(values, p * 100), abs=1e-9)


def test_global_percentile_of_two_columns(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, 8.0), (4.0, 9.0)], "a double, b double")
    row = exact_percentiles(df, [], {"a": ("a", 0.5), "b": ("b", 0.5)}).first()
    assert (row.a, row.b) == (2.0, 8.5)


def test_percentile_plan_has_no_per_group_buffer(skewed):
    _, df = skewed
    plan = plan_of(exact_percentiles(df, ["k"], {"m": ("v", 0.5)}))
    assert "percentile(" not in plan and "collect_" not in plan


def test_keep_first_limits_before_the_shuffle(skewed):
    _, df = skewed
    kept = keep_first(df, ["k"], ["v"])
    assert plan_of(kept).count("WindowGroupLimit") >= 2
    assert kept.count() == df.select("k").distinct().count()
    assert first_n(df, ["k"], ["v"], 3).where("k = 'hot'").count() == 3


def test_numbers_are_consecutive(skewed):
    _, df = skewed
    tagged = df.withColumn("id", F.monotonically_increasing_id())
    rows = number_rows(tagged, ["k", "v", "id"], "n").orderBy("n").collect()
    assert [r.n for r in rows] == list(range(1, len(rows) + 1))
    key = [((r.k is not None, r.k or ""), r.id) for r in rows]
    assert [k[0] for k in key] == sorted(k[0] for k in key)


def test_collapse_of_a_hot_key(spark):
    rows = [("2025-04-01", "hot", 1, float(i % 7), "a") for i in range(3001)]
    rows += [("2025-04-01", str(i), 1, 2.5, "b") for i in range(50)]
    schema = "prediction_date string, location_id string, stage_id int, predicted_days double, place_id string"
    df = spark.createDataFrame(rows, schema).withColumn(
        "prediction_date", F.to_date("prediction_date")
    )
    got = {r.location_id: r for r in H.collapse_predictions(df).collect()}
    assert len(got) == 51 and got["hot"].n_rows == 3001 and got["hot"].predicted_days == 3.0


def test_collapse_equals_exact_medians(spark):
    """Keys with none, one, two, equal and many values, NULL keys and NaN values."""
    values = {"none": [None, float("nan")], "one": [2.5], "two": [1.25, 4.0], "same": [3.5] * 9, "many": [0.1 * i for i in range(8)], None: [5.0, 1.0, 2.0]}
    rows = [("2025-04-01", k, 1, v, v, "p") for k, own in values.items() for v in own]
    schema = "prediction_date string, location_id string, stage_id int, predicted_days double, raw_signed_days double, place_id string"
    df = spark.createDataFrame(rows, schema).withColumn("prediction_date", F.to_date("prediction_date"))
    got = {r.location_id: r for r in H.collapse_predictions(df).collect()}
    for key, own in values.items():
        clean = [v for v in own if v is not None and v == v]
        want = statistics.median(clean) if clean else None
        assert got[key].predicted_days == pytest.approx(want) and got[key].raw_signed_days == pytest.approx(want)
        assert got[key].n_rows == len(own)
    assert H.collapse_predictions(df.where("false")).count() == 0


def test_collapse_of_few_copies_shuffles_once(spark):
    rows = [("2025-04-01", str(i // 2), 1, float(i), "p") for i in range(100)]
    df = spark.createDataFrame(rows, "prediction_date string, location_id string, stage_id int, predicted_days double, place_id string")
    assert "Exchange" not in plan_of(H.collapse_predictions(df.withColumn("prediction_date", F.to_date("prediction_date"))))


def test_box_search_in_a_dense_cell(spark):
    """300 centroids in one cell, one of them in use for most points, days missing at random."""
    rng = np.random.default_rng(5)
    centroids = [(f"p{i:03}", float(a), float(b)) for i, (a, b) in enumerate(rng.uniform(0.0, 0.5, (300, 2)))]
    days = [datetime.date(2025, 4, d) for d in (1, 2, 3)]
    rows = [(*c, d, float(i)) for i, c in enumerate(centroids) for d in days if (i + d.day) % 3]
    rows += [rows[0], (None, 0.2, 0.2, days[0], -1.0)]
    weather = spark.createDataFrame(rows, "place_id string, centroid_lat double, centroid_lon double, date date, t double")
    points = [(i, 0.21, 0.21) for i in range(200)] + [(200 + i, float(a), float(b)) for i, (a, b) in enumerate(rng.uniform(-0.3, 0.8, (20, 2)))]
    named = spark.createDataFrame(points, "point_id int, latitude double, longitude double")
    found = C.nearest_in_box(named, weather, "2025-04-01", "2025-04-02")
    got = {(r.point_id, r.date): (r.place_id, r.t) for r in found.collect()}

    def km(a, b, c, d):
        a, b, c, d = map(math.radians, (a, b, c, d))
        return math.asin(math.sqrt(math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2))

    want = {}
    for point, lat, lon in points:
        for day in days[:2]:
            near = [(km(lat, lon, r[1], r[2]), r[0] or "", r) for r in rows if r[3] == day and abs(r[1] - lat) <= 0.5 and abs(r[2] - lon) <= 0.5]
            if near:
                row = min(near)[2]
                want[point, day] = (row[0], row[4])
    assert got == want and found.count() == len(want)


def test_daily_dedupe_bounds_the_season_window(spark):
    days = spark.sql(
        "SELECT 'p' AS place_id, explode(sequence(DATE'2024-03-01', DATE'2025-02-28')) AS date"
    )
    copies = days.crossJoin(spark.range(20)).withColumn("x", F.lit(1.0))
    one = D.dedupe_weather(copies, key="place_id", order=["id"])
    out = D.season_cumulative(D.add_calendar(one), ["x"])
    assert out.agg(F.count("*"), F.max("cumu_x")).first() == (365, 365.0)


@pytest.mark.parametrize(
    "names",
    [
        [n for n in catalog.queries() if catalog.survey_ids()[n][0] == letter]
        for letter in "ABCDEGHI"
    ],
    ids=list("ABCDEGHI"),
)
def test_no_cartesian_products(spark, sf, names):
    for name in names:
        plan = plan_of(catalog.queries()[name](spark, sf))
        assert "CartesianProduct" not in plan, name
        assert "BroadcastNestedLoopJoin" not in plan, name


def test_trajectory_windows_share_one_exchange(spark, sf):
    plan = plan_of(catalog.queries()["termination_features"](spark, sf))
    # one for the daily aggregate, one for all windows
    assert plan.count("Exchange hashpartitioning") <= 2


def test_dates_and_columns_reach_the_scan(spark, sf):
    plan = plan_of(catalog.queries()["training_window"](spark, sf))
    scan = plan[plan.index("FileScan parquet") :]
    assert "l_shipdate" in scan.split("PushedFilters")[1].split("ReadSchema")[0]
    assert "l_comment" not in scan and "l_extendedprice" not in scan
