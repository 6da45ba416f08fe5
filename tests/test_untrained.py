"""Fits over tables whose events leave nothing to train on, as many locations on one grid point do."""

import os

import pytest
from pyspark.sql import functions as F

from seasontide.operators import intervals as I
from seasontide.operators import models as M
from seasontide.operators.frames import build_trajectory
from seasontide.plans import model_queries as Q
from seasontide.plans.registry import QUERIES, scratch_dir

EMPTY = (
    "ablate_calibrator_groups", "apply_by_cutoff", "bagged_interval", "fit_boosted_trees", "fit_for_cutoff",
    "fit_random_forest", "hindcast", "monotone_audit", "oof_trajectories", "predict_latest", "walk_forward_termination",
)


@pytest.fixture(scope="module")
def winter(spark, sf, tmp_path_factory):
    """The driver tables with every order in January, out of the season."""
    out = tmp_path_factory.mktemp("winter")
    for name in os.listdir(sf):
        if name != "orders.parquet":
            os.symlink(f"{sf}/{name}", out / name)
    day = F.make_date(F.year("o_orderdate"), F.lit(1), F.dayofmonth("o_orderdate")).cast("timestamp_ntz")
    spark.read.parquet(f"{sf}/orders.parquet").withColumn("o_orderdate", day).write.parquet(str(out / "orders.parquet"))
    return str(out)


@pytest.mark.parametrize("name", EMPTY)
def test_no_training_row_gives_no_row(spark, winter, name):
    assert QUERIES[name].run(spark, winter).collect() == []


def test_ablation_without_folds_compares_nothing(spark, winter):
    rows = QUERIES["ablate_base_groups"].run(spark, winter).collect()
    assert {r.feature_group for r in rows} == set(M.BASE_GROUPS)
    assert all(r.n_matched == 0 and r.delta_rmse is None for r in rows)


def test_bundle_without_models(spark, winter, sf):
    manifest = {r["name"]: r.value for r in QUERIES["save_and_load_bundle"].run(spark, winter).collect()}
    assert (manifest["base_model"], manifest["calibrator"]) == ("null", "null")
    events, daily = Q.stored(spark, sf)
    path = scratch_dir(spark)
    M.save_bundle(path, None, None, Q.CFG, Q.TEST_DATE, {"events": events})
    season = build_trajectory(daily, events, 1999, through="1999-05-31").withColumnRenamed("date", "prediction_date")
    loaded = M.load_bundle(spark, path)
    rows = M.predict_trajectory(season, loaded, Q.CFG).collect()
    assert rows and all(r.raw_signed_days is None and r.predicted_days is None for r in rows)


def test_no_calibrator_keeps_the_base_output(spark, sf):
    events, daily = Q.stored(spark, sf)
    matrix = Q.reliable(Q.training_matrix(events, daily, Q.TEST_DATE, Q.CFG))
    base = Q.small_gbt(matrix, Q.CFG.features, Q.CFG.target)
    season = build_trajectory(daily, events, 1999, through="1999-05-31").withColumnRenamed("date", "prediction_date")
    rows = M.predict_trajectory(season, M.Bundle(base, None, Q.CFG.features, {}), Q.CFG).collect()
    assert rows and all(r.predicted_days == max(r.raw_signed_days, 0.0) and not r.termination_output_applied for r in rows)


def test_an_empty_bag_has_no_tree(spark):
    # this key lies in some bags and not in others
    rows = spark.createDataFrame([(1, 2.0, 3.0)], "id int, a double, y double")
    model = I.fit_bagged(rows, ["a"], "y", ["id"], trees=6)
    bags = rows.select([I.bag_count(["id"], t).alias(f"b{t}") for t in range(6)]).first()
    assert [t is None for t in model.trees] == [b == 0 for b in bags] and len({b == 0 for b in bags}) == 2
    assert model.predict(rows).first().pred == 3.0
    assert model.out_of_bag(rows).first().oob is None
    nothing = I.BaggedTrees((None,), model.features, model.keys)
    assert nothing.predict(rows).first().pred is None
