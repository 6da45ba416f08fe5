"""The tree queries fit ensembles of the configured size, in every season."""

import pytest
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from seasontide.operators import models as M
from seasontide.operators.frames import fold_matrix
from seasontide.plans import model_queries as Q
from seasontide.plans.registry import QUERIES

#: Boosted fits of each query over the smallest tables: seasons with an earlier one, times the sets of inputs.
FITS = {
    "ablate_base_groups": len(Q.FOLDS) * (1 + len(M.BASE_GROUPS)),
    "ablate_calibrator_groups": len(Q.FOLDS),
    "fit_boosted_trees": 1,
    "oof_trajectories": len(Q.FOLDS),
    # of all rows before the test date, and of the seasons that start before it
    "save_and_load_bundle": 1 + len([y for y in Q.FOLDS if f"{y}-01-01" < Q.TEST_DATE]),
}


@pytest.fixture
def asked(monkeypatch):
    """Parameters of every boosted fit; what is fitted is one split, which is quick."""
    seen = []

    def regressor(**params):
        seen.append(params)
        return GBTRegressor(**{**params, "maxIter": 1, "maxDepth": 1})

    monkeypatch.setattr(M, "GBTRegressor", regressor)
    return seen


@pytest.mark.parametrize("name", FITS)
def test_every_fit_has_the_configured_size(spark, sf, asked, name):
    assert QUERIES[name].run(spark, sf).count() > 0
    assert len(asked) == FITS[name] and all(p == Q.CFG.tree_params for p in asked)


def test_folds_side_by_side_equal_folds_one_by_one(spark, sf):
    events, daily = Q.stored(spark, sf)
    matrix = Q.reliable(fold_matrix(events, daily, Q.CFG))

    def fit(df, features, label):
        return M.fit_gbt(df, features, label, {"maxIter": 2, "maxDepth": 3})

    keys = ["trajectory_year", "location_id", "stage_id", "prediction_date"]
    beside = M.oof_trajectories(events, daily, fit, Q.CFG, matrix=matrix).select(*keys, M.RAW)
    assert [r[0] for r in beside.select(keys[0]).distinct().orderBy(keys[0]).collect()] == list(Q.FOLDS)
    for year in Q.FOLDS:
        alone = M.oof_trajectories(events, daily, fit, Q.CFG, (year,), matrix).select(*keys, M.RAW)
        both = beside.where(F.col(keys[0]) == year)
        assert alone.count() == both.count() and alone.exceptAll(both).isEmpty()


def test_tasks_follow_the_rows(spark):
    assert [M.training_tasks(n) for n in (0, 1, M.ROWS_PER_TASK, M.ROWS_PER_TASK + 1)] == [1, 1, 1, 2]
    tasks = []
    rows = spark.range(10, numPartitions=4).withColumn("y", F.col("id") * 2.0)
    M.fit_if_any(lambda df, features, label: tasks.append(df.rdd.getNumPartitions()), rows, ["id"], "y")
    assert tasks == [1]
