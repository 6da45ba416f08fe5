"""Training stops on short coverage; a day is predicted from a saved bundle; a backtest keeps to earlier seasons."""

import dataclasses
import os

import pytest
from pyspark.sql import functions as F

from seasontide.operators import lifecycle as L
from seasontide.operators import models as M
from seasontide.plans import model_queries as Q

CFG = dataclasses.replace(Q.CFG, min_events_per_target=1, min_years_per_target=1)


@pytest.fixture(scope="module")
def data(spark, sf):
    return Q.stored(spark, sf)


def test_short_coverage_stops_before_saving(data, tmp_path):
    events, daily = data
    path = str(tmp_path / "bundle")
    strict = dataclasses.replace(CFG, min_events_per_target=10**6)
    with pytest.raises(RuntimeError, match="too few recent labels"):
        L.train(events, daily, "1999-06-01", path, strict, fit=lambda *a: pytest.fail("fitted"))
    assert not os.path.exists(path)
    assert L.gate(events, "1999-06-01", dataclasses.replace(strict, window_years=None)) is None


def test_train_and_predict_a_day(spark, data, tmp_path):
    events, daily = data
    path = str(tmp_path / "bundle")
    manifest = {r["name"]: r for r in L.train(events, daily, "1998-01-01", path, CFG, Q.small_gbt).collect()}
    assert manifest["training_cutoff"].value == "1998-01-01" and int(manifest["fact_label_coverage"].value) == len(CFG.target_ids)
    before = events.where(F.col("stage_date") < "1998-01-01")
    assert spark.read.parquet(f"{path}/label_counts").agg(F.sum("n_events")).first()[0] == before.count()
    day = str(daily.where(F.year("date") == 1998).where(F.month("date") == 5).agg(F.max("date")).first()[0])
    out = L.predict_day(spark, daily, path, day, str(tmp_path / "out"), CFG).collect()
    today = daily.where(F.col("date") == F.lit(day).cast("date"))
    assert len(out) == 4 * today.count() and {str(r.prediction_date) for r in out} == {day}
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(out)
    # a changed fact table is noticed
    spark.createDataFrame([(1, "x", 5)], "stage_id int, label_source string, n_events long").write.mode("append").parquet(f"{path}/label_counts")
    with pytest.raises(ValueError, match="label_counts"):
        M.load_bundle(spark, path)


def test_season_start():
    assert L.season_start("2025-02-28") == "2024-03-01" and L.season_start("2025-03-01") == "2025-03-01"


def test_calibrator_window(spark):
    rows = [(y, "a", 1, f"{y}-04-0{d}", float(d), float(d), f"{y}-05-01", float(30 - d)) for y in range(1990, 1999) for d in (1, 2, 3)]
    frame = spark.createDataFrame(
        rows,
        "trajectory_year int, location_id string, stage_id int, day string, raw_signed_days double, predicted_days double, actual string, "
        "actual_days_to_event double",
    ).select(
        "*", F.to_date("day").alias("prediction_date"), F.col("actual").cast("timestamp_ntz").alias("actual_stage_date"),
        F.lit(1.0).alias("latitude"), F.lit(1.0).alias("longitude"),
    )
    years = lambda n: {r.trajectory_year for r in L.calibrator_rows(frame, "1998-01-01", dataclasses.replace(CFG, calibrator_years=n)).collect()}
    assert years(3) == {1995, 1996, 1997} and years(None) == set(range(1990, 1998))


def test_backtest(data):
    events, daily = data
    detail, metrics = L.backtest(events, daily, CFG, Q.small_gbt, years=(1997, 1998))
    assert {r[0] for r in detail.select("trajectory_year").distinct().collect()} == {1997, 1998}
    assert detail.where(F.col("model_train_end_year") >= F.col("trajectory_year")).isEmpty() and metrics.count() > 0
