"""Calibrators from sums per season against separate fits; folds as filters of one matrix."""

import dataclasses

import numpy as np
import pytest
from pyspark.sql import functions as F

from seasontide.functions.quantiles import prefix_medians
from seasontide.operators import calibrator as C
from seasontide.operators import models as M
from seasontide.operators.frames import fold_matrix, fold_rows, training_matrix
from seasontide.plans import model_queries as Q

INPUTS = ["x1", "x2", "late", "same", "empty"]


@pytest.fixture(scope="module")
def rows(spark):
    """Missing values, an input that starts late, one that never varies, one without values, a hot season."""
    rng = np.random.default_rng(3)
    made = []
    for season, n in ((2001, 60), (2002, 700), (2003, 50), (2005, 40)):
        for i in range(n):
            x1, x2 = float(rng.normal(500, 3)), float(rng.integers(0, 9))
            stage = str(rng.integers(1, 4)) if i % 17 else None
            y = 2 * x1 - x2 + rng.normal() if i % 13 else None
            late = float(rng.normal()) if season > 2002 else float("nan")
            made.append((season, x1 if i % 5 else None, x2 if i % 7 else float("nan"), late, 36.6, None, stage, y))
    made += [(None, 1.0, 1.0, 1.0, 36.6, None, "1", 5.0), (2006, 1.0, 1.0, 1.0, 36.6, None, "1", None)]
    schema = "season int, x1 double, x2 double, late double, same double, empty double, stage string, y double"
    return spark.createDataFrame(made, schema).repartition(5)


def normal_equations(df, inputs, with_stage):
    """The calibrator from a dense design matrix."""
    data = [r for r in df.collect() if r.y is not None]
    x = np.array([[np.nan if r[c] is None else r[c] for c in inputs] for r in data], float).reshape(len(data), len(inputs))
    used = [i for i in range(len(inputs)) if not np.isnan(x[:, i]).all()]
    medians = [float(np.nanmedian(x[:, i])) for i in used]
    filled = np.column_stack([np.where(np.isnan(x[:, i]), m, x[:, i]) for i, m in zip(used, medians)])
    means, scales = filled.mean(0), filled.std(0)
    scales[filled.min(0) == filled.max(0)] = 1.0
    stages = sorted({r.stage for r in data if r.stage}) if with_stage else []
    flags = [[float(r.stage == s) for s in stages] for r in data]
    design = np.hstack([(filled - means) / scales, np.array(flags).reshape(len(data), len(stages))])
    y = np.array([r.y for r in data])
    centred = design - design.mean(0)
    w = np.linalg.solve(centred.T @ centred + 30.0 * np.eye(design.shape[1]), centred.T @ (y - y.mean()))
    n = len(used)
    return C.RidgeCalibrator(
        tuple(inputs[i] for i in used), tuple(medians), tuple(means), tuple(scales), tuple(w[:n]), tuple(stages), tuple(w[n:]),
        float(y.mean() - design.mean(0) @ w),
    )


def alike(a, df, inputs=INPUTS, with_stage=True):
    for b, digits in ((normal_equations(df, inputs, with_stage), 1e-9), (M.fit_ridge(df, "y", 30.0, inputs, with_stage), 1e-9)):
        assert a.features == b.features and a.categories == b.categories
        for name in ("medians", "means", "scales", "weights", "category_weights"):
            assert np.allclose(getattr(a, name), getattr(b, name), rtol=digits, atol=digits), name
        assert a.intercept == pytest.approx(b.intercept, rel=digits)


def test_all_cutoffs_equal_separate_fits(rows):
    sums = C.season_sums(rows, "season", "y", INPUTS)
    assert sums.cutoffs == [2002, 2003, 2005, 2006, 2007]
    for cutoff in sums.cutoffs:
        alike(C.solve(sums, cutoff, 30.0), rows.where(F.col("season") < cutoff))
    for kept, stage in ((["x1"], True), (["x2", "late"], False)):
        alike(C.solve(sums, 2005, 30.0, kept, stage), rows.where("season < 2005"), kept, stage)
    assert C.solve(sums, 2005, 30.0, [], True).features == ()


def test_window_of_seasons(rows):
    sums = C.season_sums(rows, "season", "y", INPUTS, cutoffs=[2004, 2006], window=3)
    alike(C.solve(sums, 2004, 30.0), rows.where("season BETWEEN 2001 AND 2003"))
    alike(C.solve(sums, 2006, 30.0), rows.where("season BETWEEN 2003 AND 2005"))
    with pytest.raises(ValueError):
        C.season_sums(rows, "season", "y", INPUTS, window=0)


def test_prefix_medians(rows):
    found = {(r["cutoff"], r["column"]): r["median"] for r in prefix_medians(rows.where("season is not null"), "season", INPUTS, [2001, 2002, 2006]).collect()}
    data = rows.where("season is not null").select("season", *INPUTS).collect()
    for cutoff in (2002, 2006):
        for i, name in enumerate(INPUTS):
            known = [r[name] for r in data if r.season < cutoff and r[name] is not None and not np.isnan(r[name])]
            assert found.get((cutoff, i)) == (pytest.approx(np.median(known), abs=1e-12) if known else None)
    assert not any(c == 2001 for c, _ in found)


def test_no_rows(rows):
    assert C.season_sums(rows.where("false"), "season", "y", INPUTS).cutoffs == []


def test_folds_equal_a_matrix_per_season(spark, sf):
    events, daily = Q.stored(spark, sf)
    for years in (3, 1, None):
        cfg = dataclasses.replace(Q.CFG, window_years=years, legacy_start="1994-06-01")
        matrix = M.reliable(fold_matrix(events, daily, cfg))
        for year in (1997, 1999):
            prior = events.where(F.col("stage_date") < F.lit(f"{year}-01-01").cast("timestamp_ntz"))
            want = training_matrix(prior, daily, f"{year}-01-01", cfg)
            got = fold_rows(matrix, year, cfg).select(*want.columns)
            assert want.count() > 0 and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
