"""Landing, publishing and cache rebuilds on disk."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from seasontide.operators import audits as I
from seasontide.sources import readers as R
from seasontide.sources import sinks as K


def day(n):
    return dt.date(2025, 4, n)


def weather(spark, days, value=1.0):
    return spark.createDataFrame(
        [(p, day(d), value) for d in days for p in ("p", "q")],
        "place_id string, date date, x double",
    )


def test_landing_skips_landed_days(spark, tmp_path):
    path = str(tmp_path / "raw")
    coverage = spark.createDataFrame([("p", "1")], "place_id string, location_id string")
    K.land_weather(weather(spark, (1, 2)), coverage, path, "2025-04-01", "2025-04-02")
    K.land_weather(weather(spark, (1, 2, 3, 9), 7.0), coverage, path, "2025-04-01", "2025-04-05")
    got = sorted((r.date.day, r.place_id, r.x) for r in spark.read.parquet(path).collect())
    assert got == [(1, "p", 1.0), (2, "p", 1.0), (3, "p", 7.0)]
    gaps = K.missing_days(spark.read.parquet(path).select("date"), "2025-04-01", "2025-04-04")
    assert [r.date for r in gaps.collect()] == [day(4)]


def test_publishing_replaces_only_its_own_day(spark, tmp_path):
    path = str(tmp_path / "pred")
    rows = spark.createDataFrame(
        [(day(1), 1.0), (day(2), 2.0)], "prediction_date date, v double"
    )
    K.write_predictions(rows, path, "2025-04-01")
    K.write_predictions(rows, path, "2025-04-02")
    K.write_predictions(rows.withColumn("v", F.col("v") + 5), path, "2025-04-02")
    got = sorted((r.prediction_date, r.v) for r in spark.read.parquet(path).collect())
    assert got == [(day(1), 1.0), (day(2), 7.0)]


def test_outputs_are_published_by_a_pointer(spark, tmp_path):
    path = str(tmp_path)
    frame = spark.createDataFrame([(1, "a")], "n int, s string")
    K.write_outputs({"detail": frame, "summary": frame}, path, "20250401")
    K.write_outputs({"detail": frame.withColumn("n", F.lit(2))}, path, "20250402")
    assert R.latest_run(spark, path) == "20250402" and R.read_latest(spark, path, "detail").first().n == 2
    assert R.read_table(spark, f"{path}/runs/20250401/detail.csv").first().s == "a"
    with pytest.raises(Exception, match="already exists"):
        K.write_outputs({"detail": frame}, path, "20250401")
    # a run that dies between its tables
    broken = frame.withColumn("n", F.raise_error(F.lit("killed")).cast("int"))
    with pytest.raises(Exception, match="killed"):
        K.write_outputs({"detail": frame, "summary": broken}, path, "20250403")
    assert R.latest_run(spark, path) == "20250402" and R.read_latest(spark, path, "detail").first().n == 2


def test_cache_rebuild_is_dry_unless_applied(spark, tmp_path):
    rows = weather(spark, (1, 2, 5))
    path = str(tmp_path / "cache")
    index = I.compact_segments(rows, path)
    assert index.count() == 4 and not (tmp_path / "cache").exists()
    I.compact_segments(rows, path, apply=True)
    stored = spark.read.parquet(f"{path}/data")
    assert stored.count() == 6
    assert spark.read.parquet(f"{path}/index").where("place_id = 'p'").count() == 2
    starts = {r[0] for r in stored.select(F.col("segment_start").cast("string")).distinct().collect()}
    assert starts == {"20250401", "20250405"}
    # the segment travels with the row: no join on a range of days, a folder per year
    assert [d.name for d in (tmp_path / "cache" / "data").iterdir() if d.is_dir()] == ["start_year=2025"]
    assert {(r.place_id, str(r.date)[:10]) for r in stored.collect()} == {(r.place_id, str(r.date)[:10]) for r in rows.collect()}


def test_snapshots_by_cutoff(spark, tmp_path):
    events = spark.createDataFrame([("a", day(1)), ("b", day(3))], "location_id string, stage_date date")
    events = events.withColumn("stage_date", F.col("stage_date").cast("timestamp_ntz"))
    path = str(tmp_path / "snap")
    K.write_snapshots(R.snapshot_by_cutoff(events, ["2025-04-02", "2025-04-03"]), path)
    got = sorted((str(r.cutoff), r.location_id) for r in spark.read.parquet(path).collect())
    assert got == [("2025-04-02", "a"), ("2025-04-03", "a"), ("2025-04-03", "b")]


def test_stride_sample_cap(spark):
    df = spark.range(100).repartition(7)
    assert sorted(r.id for r in R.stride_sample(df, ["id"], 10, 3).collect()) == [0, 10, 20]
