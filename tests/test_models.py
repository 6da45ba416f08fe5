"""Calibrator parity, fold hygiene, bundles."""

import dataclasses
import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from seasontide.config import Settings
from seasontide.operators import models as M
from seasontide.operators import termination as G
from seasontide.plans import model_queries as Q
from seasontide.plans.registry import QUERIES, scratch_dir


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(1)
    n = 400
    x1, x2 = rng.normal(5, 3, n), rng.normal(0, 10, n)
    stage = rng.integers(1, 4, n)
    y = 2 * x1 - 0.3 * x2 + stage + rng.normal(0, 1, n)
    rows = [
        (float(a) if i % 11 else None, float(b), None, str(s), float(t))
        for i, (a, b, s, t) in enumerate(zip(x1, x2, stage, y))
    ]
    schema = "x1 double, x2 double, empty double, stage string, y double"
    return rows, spark.createDataFrame(rows, schema)


def test_ridge_equals_the_normal_equations(frame):
    rows, df = frame
    model = M.fit_ridge(df, "y", 30.0, ["x1", "x2", "empty"])
    assert model.features == ("x1", "x2")
    x1 = np.array([np.nan if r[0] is None else r[0] for r in rows])
    x1 = np.where(np.isnan(x1), np.nanmedian(x1), x1)
    x2 = np.array([r[1] for r in rows])
    y = np.array([r[4] for r in rows])
    cols = [(c - c.mean()) / c.std() for c in (x1, x2)]
    cols += [np.array([float(r[3] == s) for r in rows]) for s in ("1", "2", "3")]
    design = np.column_stack(cols)
    centred = design - design.mean(0)
    w = np.linalg.solve(centred.T @ centred + 30.0 * np.eye(5), centred.T @ (y - y.mean()))
    assert np.allclose([*model.weights, *model.category_weights], w, atol=1e-8)
    b = y.mean() - design.mean(0) @ w
    got = [r.p for r in model.transform(df, "p").select("p", "x2").orderBy("x2").collect()]
    want = (design @ w + b)[np.argsort(x2)]
    assert np.allclose(got, want, atol=1e-8)
    assert M.RidgeCalibrator.from_json(model.to_json()) == model


def test_unknown_stage_scores_without_its_weight(frame, spark):
    _, df = frame
    model = M.fit_ridge(df, "y", 30.0, ["x1"])
    row = spark.createDataFrame([(model.means[0], "9")], "x1 double, stage string")
    assert model.transform(row, "p").first().p == pytest.approx(model.intercept)


@pytest.fixture(scope="module")
def folds(spark, sf):
    events, daily = Q.stored(spark, sf)
    return events, daily, M.reliable(Q.folds(spark, sf))


def test_folds_see_only_earlier_seasons(spark, folds):
    events, daily, oof = folds
    assert [r[0] for r in oof.select("trajectory_year").distinct().orderBy(F.asc("trajectory_year")).collect()] == list(Q.FOLDS)
    late = oof.where(
        (F.year("prediction_date") != F.col("trajectory_year"))
        | (F.col("model_train_cutoff_date") > F.make_date("trajectory_year", F.lit(1), F.lit(1)))
    )
    assert late.count() == 0
    # changing labels of the scored season does not change its own predictions
    moved = events.withColumn(
        "stage_date",
        F.when(F.col("year") == 1998, F.col("stage_date") + F.expr("INTERVAL '3' DAY")).otherwise(
            F.col("stage_date")
        ),
    )
    again = M.oof_trajectories(moved, daily, Q.small_gbt, Q.CFG, (1998,))
    keys = ["location_id", "stage_id", "prediction_date"]
    both = (
        oof.where("trajectory_year = 1998")
        .select(*keys, F.col(M.RAW).alias("a"))
        .join(again.select(*keys, F.col(M.RAW).alias("b")), keys)
    )
    row = both.agg(F.count("*").alias("n"), F.max(F.abs(F.col("a") - F.col("b"))).alias("d")).first()
    assert row.n > 0 and row.d == 0.0


def test_first_season_keeps_base_output_and_locks_absorb(folds):
    _, _, oof = folds
    out = M.reliable(M.walk_forward_termination(oof, "trajectory_year", Q.CFG))
    first = out.where(F.col("trajectory_year") == Q.FOLDS[0])
    assert first.where("termination_output_applied OR termination_reached").count() == 0
    assert first.where("predicted_days <> base_predicted_days").count() == 0
    late = out.where(F.col("trajectory_year") > Q.FOLDS[0])
    assert late.where("termination_output_applied").count() > 0
    bad = late.where("termination_reached AND predicted_days <> 0").count()
    early = late.where("termination_history_days <= 7 AND termination_output_applied").count()
    assert (bad, early) == (0, 0)
    assert out.count() == oof.count()


def test_bundle_round_trip_and_latest(spark, folds):
    events, daily, oof = folds
    matrix = Q.training_matrix(events, daily, Q.TEST_DATE, Q.CFG)
    base = Q.small_gbt(matrix, Q.CFG.features, Q.CFG.target)
    ridge = M.fit_ridge(G.termination_features(oof), "actual_days_to_event", 30.0)
    path = scratch_dir(spark)
    M.save_bundle(path, base, ridge, Q.CFG, Q.TEST_DATE, {"events": events})
    bundle = M.load_bundle(spark, path)
    assert bundle.calibrator == ridge and bundle.features == Q.CFG.features
    assert bundle.manifest["input_events"] == str(events.count())
    season = Q.build_trajectory(daily, events, 1999, through="1999-05-31")
    visible = season.withColumnRenamed("date", "prediction_date")
    mapped = daily.select("location_id", F.lit("mine").alias("input_name")).distinct()
    past = M.hindcast(
        base, daily, visible, mapped, Q.CFG.features, (1, 2), mapped, ridge, Q.CFG
    )
    row = past.agg(F.count_if("termination_reached"), F.min("input_name"), F.max("stage_id")).first()
    assert row[0] > 0 and row[1] == "mine" and row[2] == 2
    latest = M.predict_latest(visible, bundle, Q.CFG)
    days = [r[0] for r in latest.select("prediction_date").distinct().collect()]
    assert days == [visible.agg(F.max("prediction_date")).first()[0]]
    with pytest.raises(ValueError, match="contract"):
        M.predict_latest(visible.withColumn("doy", F.lit(None).cast("int")), bundle, Q.CFG)


def test_models_by_cutoff_and_fallback(spark, folds):
    _, _, oof = folds
    features = G.termination_features(oof)
    ridge = M.fit_ridge(features, "actual_days_to_event", 30.0)
    out = M.apply_by_cutoff(oof, {"1999-01-01": ridge}, None, Q.CFG)
    got = {
        r.model_train_cutoff_date: r.n
        for r in out.groupBy("model_train_cutoff_date")
        .agg(F.count("learned_days_remaining").alias("n"))
        .collect()
    }
    assert got[dt.date(1999, 1, 1)] > 0 and got[dt.date(1998, 1, 1)] == 0
    every = M.apply_by_cutoff(oof, {"1999-01-01": ridge}, ridge, Q.CFG)
    assert every.where("learned_days_remaining IS NULL").count() == 0


def test_sweep_and_ablation_tables(spark, folds):
    _, _, oof = folds
    keys = ["prediction_date", "location_id", "stage_id"]

    def run(inputs):
        shift = F.lit(float(len(inputs)))
        return oof.select(*keys, (F.col("actual_days_to_event") + shift).alias("error_days"))

    table = M.ablate(run, ["a", "b", "c"], {"one": ["a"], "two": ["a", "b"]}, keys).collect()
    assert {r.feature_group: r.removed_features for r in table} == {"one": "a", "two": "a, b"}
    assert all(r.n_matched == oof.count() for r in table)
    assert table[0].delta_rmse >= table[1].delta_rmse


def test_window_years_must_be_positive(spark, folds):
    events, daily, _ = folds
    with pytest.raises(ValueError):
        Q.training_matrix(events, daily, "1999-01-01", dataclasses.replace(Settings(), window_years=0))


def test_model_queries_return_rows(spark, sf):
    for name in ("fit_random_forest", "monotone_audit", "hindcast"):
        assert QUERIES[name].run(spark, sf).count() > 0


def test_ablation_and_bundle_take_every_season(spark, sf, folds, monkeypatch):
    events, daily, oof = folds

    def known(events, daily, fit, cfg, years=None):
        last = events.agg(F.max("stage_date")).first()[0]
        rows = oof.where(F.col("actual_stage_date") <= F.lit(last))
        return rows.where(F.col("trajectory_year").isin(list(years))) if years else rows

    monkeypatch.setattr(Q, "stored", lambda spark, sf: (events, daily))
    monkeypatch.setattr(Q.M, "oof_trajectories", known)
    table = QUERIES["ablate_base_groups"].run(spark, sf).collect()
    assert len(table) == len(M.BASE_GROUPS) and all(r.n_matched == oof.count() for r in table)
    asked = []
    ridge = M.fit_ridge
    monkeypatch.setattr(Q.M, "fit_ridge", lambda df, *a: asked.append(df) or ridge(df, *a))
    Q.bundle(spark, sf)
    # nothing from after the training cutoff
    visible = oof.where((F.col("actual_stage_date") < Q.TEST_DATE) & (F.col("prediction_date") < Q.TEST_DATE))
    assert asked[0].count() == visible.count()
    assert asked[0].select("trajectory_year").distinct().count() > 1
