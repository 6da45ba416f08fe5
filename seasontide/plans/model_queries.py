"""Model fits, calibrators and inference over the driver tables.

Boosted trees have the production size of ``Settings``; random forests and bags are small here.
"""

from __future__ import annotations

import dataclasses
import functools

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seasontide.config import MODEL_FEATURES, Settings
from seasontide.functions.checkpoints import reliable
from seasontide.operators import calibrator as C
from seasontide.operators import intervals as I
from seasontide.operators import models as M
from seasontide.operators import termination as G
from seasontide.operators.frames import build_trajectory, fold_matrix, fold_rows, fold_seasons, training_matrix
from seasontide.plans import adapters as A
from seasontide.plans.feature_queries import TEST_DATE, located
from seasontide.plans.registry import query, scratch_dir
from seasontide.plans.source_queries import prepared

CFG = Settings(manual_events=False)
#: Seasons of the driver tables that have earlier events; the queries take every known season.
FOLDS = (1996, 1997, 1998, 1999, 2000, 2001)


#: The trainer of all boosted trees here; not small any more, but imported by this name.
small_gbt = M.fit_gbt


def small_rf(df, features, label):
    return M.fit_rf(df, features, label, {"numTrees": 10, "maxDepth": 5})


def stored(spark, sf):
    """Events and features written once; every fold reads them."""
    return reliable(prepared(spark, sf)), reliable(located(spark, sf))


def fit_errors(spark, sf, fit):
    events, daily = prepared(spark, sf), located(spark, sf)
    matrix = reliable(training_matrix(events, daily, TEST_DATE, CFG))
    model = M.fit_if_any(fit, matrix, CFG.features, CFG.target)
    gap = F.col(M.RAW) - F.col(CFG.target)
    return (
        M.score(model, matrix, CFG.features)
        .groupBy("stage_id")
        .agg(F.count(F.lit(1)).alias("n_rows"), F.avg(F.abs(gap)).alias("train_mae"))
    )


@query("fit_random_forest", "F1")
def _(spark, sf):
    return fit_errors(spark, sf, small_rf)


@query("fit_boosted_trees", "F2")
def _(spark, sf):
    return fit_errors(spark, sf, M.fit_gbt)


@query(
    "assemble_features",
    "F3",
    """SELECT place_id, date, CAST(doy AS DOUBLE) AS f0, cumu_gdd_air AS f1, latitude AS f2 FROM features""",
    rounds="f1",
)
def _(spark, sf):
    rows = located(spark, sf).withColumn("doy", F.col("doy").cast("string"))
    vector = vector_to_array("features")
    return M.assemble(rows, ["doy", "cumu_gdd_air", "latitude"]).select(
        "place_id", "date", *[vector[i].alias(f"f{i}") for i in range(3)]
    )


@query("monotone_audit", "F4")
def _(spark, sf):
    events, daily = prepared(spark, sf), located(spark, sf)
    matrix = reliable(training_matrix(events, daily, TEST_DATE, CFG))
    model = M.fit_if_any(small_gbt, matrix, CFG.features, CFG.target)
    return M.monotone_audit(model, matrix, "cumu_gdd_air", CFG.features)


@query("bagged_interval", "F5")
def _(spark, sf):
    """Share of later rows inside the interval that out-of-bag errors of earlier ones give."""
    events, daily = stored(spark, sf)
    matrix = reliable(fold_matrix(events, daily, CFG))
    early, late = (matrix.where(F.year("stage_date") < 1999), matrix.where(F.year("stage_date") == 1999))
    keys = ("date", "location_id", "stage_id")
    model = I.fit_bagged(early, CFG.features, CFG.target, keys, trees=10, params={"maxDepth": 5})
    inside = F.col(CFG.target).between(F.col("pred_lower"), F.col("pred_upper"))
    return (
        I.bagged_interval(model, early, late, CFG.target, 0.1)
        .groupBy("stage_id")
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.avg(inside.cast("int")).alias("coverage"),
            F.avg(F.col("pred_upper") - F.col("pred_lower")).alias("mean_width"),
        )
    )


@query("fit_for_cutoff", "F7")
def _(spark, sf):
    events, daily = stored(spark, sf)
    try:
        model, trace = M.fit_for_cutoff(events, daily, 1999, small_gbt, CFG)
    except M.EmptyFold:
        model, trace = None, M.trace_values(1999)
    season = build_trajectory(daily, events, 1999)
    scored = M.format_predictions(M.score(model, season, CFG.features))
    return scored.withColumns({k: F.lit(v) for k, v in trace.items()})


@query(
    "fold_rows",
    "F7",
    """WITH folded AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY date, location_id, pest_year, stage_id
              ORDER BY rnk, stage_date) AS rn FROM (
            SELECT date, location_id, pest_year, stage_id, stage_date, CAST(day_of_year - doy AS INTEGER) AS signed, 1 AS rnk FROM nextev
            UNION ALL
            SELECT date, location_id, pest_year, stage_id, stage_date, signed_days_to_event, 0 AS rnk FROM postrows)) WHERE rn = 1)
       SELECT CAST(y AS INTEGER) AS year, stage_id, count(*) AS n_rows, CAST(sum(1 - rnk) AS BIGINT) AS n_after_event,
              CAST(sum(signed) AS BIGINT) AS sum_target, min(date) AS first_date, max(date) AS last_date
       FROM folded, range(1993, 2003) t(y)
       WHERE date < make_date(y, 1, 1) AND stage_date < make_date(y, 1, 1) AND (rnk = 0 OR date >= make_date(y - 3, 1, 1))
       GROUP BY y, stage_id""",
)
def _(spark, sf):
    """Training rows of every fold, all filters of one stored matrix."""
    events, daily = prepared(spark, sf), located(spark, sf)
    matrix = reliable(fold_matrix(events, daily, CFG))
    after = F.col("after_event").cast("int")
    parts = [
        fold_rows(matrix, year, CFG)
        .groupBy("stage_id")
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.sum(after).alias("n_after_event"),
            F.sum(CFG.target).cast("long").alias("sum_target"),
            F.min("date").alias("first_date"),
            F.max("date").alias("last_date"),
        )
        .withColumn("year", F.lit(year))
        for year in range(1993, 2003)
    ]
    return functools.reduce(DataFrame.unionByName, parts)


@query(
    "fold_seasons",
    "F8",
    """SELECT f.place_id, f.location_id, f.date, a.stage_id, a.year AS trajectory_year, a.actual_stage_date,
              make_date(a.year, 1, 1) AS model_train_cutoff_date, a.year - 1 AS model_train_end_year
       FROM located f JOIN (SELECT location_id, CAST(year(stage_date) AS INTEGER) AS year, stage_id, min(stage_date) AS actual_stage_date
                            FROM prepared WHERE stage_id IN (1, 2, 3, 4) GROUP BY ALL) a
         ON a.location_id = f.location_id AND a.year = year(f.date)
       WHERE strftime(f.date, '%m-%d') BETWEEN '03-01' AND '06-30' AND a.year BETWEEN 1993 AND 2001""",
)
def _(spark, sf):
    rows = fold_seasons(located(spark, sf), prepared(spark, sf), range(1993, 2002), CFG)
    return rows.select(
        "place_id", "location_id", "date", "stage_id", "trajectory_year", "actual_stage_date", "model_train_cutoff_date",
        "model_train_end_year",
    )


def folds(spark, sf):
    events, daily = stored(spark, sf)
    return M.oof_trajectories(events, daily, M.fit_gbt, CFG)


@query("oof_trajectories", "F8")
def _(spark, sf):
    return folds(spark, sf)


@query("fit_ridge", "F9")
def _(spark, sf):
    """Calibrator coefficients, one row per input."""
    frame = A.trajectory(spark, sf).withColumn(
        "actual_days_to_event", F.datediff("actual_stage_date", "prediction_date").cast("double")
    )
    features = reliable(G.termination_features(frame))
    model = M.fit_ridge(features, "actual_days_to_event", CFG.ridge_alpha)
    names = [*model.features, *[f"stage_{c}" for c in model.categories], "intercept"]
    weights = [*model.weights, *model.category_weights, model.intercept]
    table = F.array(
        *[
            F.struct(F.lit(n).alias("input"), F.lit(w).alias("weight"))
            for n, w in zip(names, weights)
        ]
    )
    error = F.col("learned_days_remaining") - F.col("actual_days_to_event")
    scored = model.transform(features).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sqrt(F.avg(error * error)).alias("rmse")
    )
    return scored.select(F.explode(table).alias("_w"), "n_rows", "rmse").select(
        "_w.*", "n_rows", "rmse"
    )


#: Trajectories dealt to five seasons by location, so that every season has its own calibrator.
SEASONS = """seasonal AS (SELECT CAST(2020 + CAST(location_id AS BIGINT) % 5 AS INTEGER) AS season, location_id, stage_id, prediction_date,
      actual_stage_date, CAST(actual_stage_date - prediction_date AS DOUBLE) AS y, signal AS raw_signed_days,
      pdoy AS prediction_day_of_year, latitude AS feature_latitude, signal_lag1, signal_lag2, signal_lag3 FROM lagged)"""
INPUTS = ("raw_signed_days", "prediction_day_of_year", "feature_latitude", "signal_lag1", "signal_lag2", "signal_lag3")


def seasonal(spark, sf):
    rows = A.trajectory(spark, sf).withColumns(
        {
            "trajectory_year": (2020 + F.col("location_id").cast("long") % 5).cast("int"),
            "actual_days_to_event": F.datediff("actual_stage_date", "prediction_date").cast("double"),
        }
    )
    return reliable(G.termination_features(rows))


@query(
    "walk_forward_ridge",
    "F9",
    f"""WITH {SEASONS}, long AS (
          SELECT season, y, unnest({list(INPUTS)}) AS input, unnest([{', '.join(INPUTS)}]) AS x FROM seasonal),
        cut AS (SELECT CAST(c AS INTEGER) AS cutoff FROM range(2021, 2026) t(c)),
        med AS (SELECT cutoff, input, median(x) AS m FROM long JOIN cut ON season < cutoff GROUP BY ALL),
        s AS (SELECT cutoff, input, m AS median, count(*) AS n_rows, avg(coalesce(x, m)) AS mean, stddev_pop(coalesce(x, m)) AS sd,
                     covar_pop(coalesce(x, m), y) AS cov, avg(y) AS intercept
              FROM long JOIN cut ON season < cutoff JOIN med USING (cutoff, input) GROUP BY ALL)
        SELECT cutoff, input, n_rows, median, mean, sd AS scale, n_rows * cov / sd / (n_rows + 30) AS weight, intercept FROM s""",
    rounds="median mean scale weight intercept",
)
def _(spark, sf):
    """Calibrators of one input each, for every cutoff, from one set of sums."""
    sums = C.season_sums(seasonal(spark, sf), "trajectory_year", "actual_days_to_event", INPUTS)
    rows = []
    for cutoff in sums.cutoffs:
        n = int(round(sum(p[-1, -1] for s, p in sums.products.items() if s < cutoff)))
        for name in INPUTS:
            m = C.solve(sums, cutoff, CFG.ridge_alpha, [name], with_stage=False)
            rows.append((cutoff, name, n, m.medians[0], m.means[0], m.scales[0], m.weights[0], m.intercept))
    return spark.createDataFrame(
        rows, "cutoff int, input string, n_rows long, median double, mean double, scale double, weight double, intercept double"
    )


PAIR = ("raw_signed_days", "prediction_day_of_year")
#: Calibrators of both inputs and of each alone, by the closed forms of two and one unknowns.
PAIR_MODELS = f"""{SEASONS}, cut AS (SELECT CAST(c AS INTEGER) AS cutoff FROM range(2021, 2025) t(c)),
    s AS (SELECT cutoff, count(*) AS n, avg(y) AS b, avg({PAIR[0]}) AS m1, avg({PAIR[1]}) AS m2, stddev_pop({PAIR[0]}) AS s1,
                 stddev_pop({PAIR[1]}) AS s2, covar_pop({PAIR[0]}, y) / stddev_pop({PAIR[0]}) AS c1,
                 covar_pop({PAIR[1]}, y) / stddev_pop({PAIR[1]}) AS c2, corr({PAIR[0]}, {PAIR[1]}) AS r
          FROM seasonal JOIN cut ON season < cutoff GROUP BY cutoff),
    w AS (SELECT *, (c1 * (n + 30) - n * r * c2) * n / ((n + 30) * (n + 30) - n * r * n * r) AS w1,
                 (c2 * (n + 30) - n * r * c1) * n / ((n + 30) * (n + 30) - n * r * n * r) AS w2 FROM s),
    learned AS (SELECT t.*, b + w1 * ({PAIR[0]} - m1) / s1 + w2 * ({PAIR[1]} - m2) / s2 AS l0,
                  b + n * c2 / (n + 30) * ({PAIR[1]} - m2) / s2 AS l1, b + n * c1 / (n + 30) * ({PAIR[0]} - m1) / s1 AS l2
                FROM seasonal t LEFT JOIN w ON cutoff = season)"""


@query(
    "ablate_calibrator_pair",
    "F12",
    f"""WITH {PAIR_MODELS}, d AS (SELECT season, location_id, stage_id, min(actual_stage_date) AS a,
          min(CASE WHEN l0 <= 4.5 THEN prediction_date END) AS d0, min(CASE WHEN l1 <= 4.5 THEN prediction_date END) AS d1,
          min(CASE WHEN l2 <= 4.5 THEN prediction_date END) AS d2 FROM learned GROUP BY ALL),
        e AS (SELECT 'signal' AS feature_group, '{PAIR[0]}' AS removed_features, CAST(d0 - a AS DOUBLE) AS f, CAST(d1 - a AS DOUBLE) AS r FROM d
          UNION ALL SELECT 'calendar', '{PAIR[1]}', CAST(d0 - a AS DOUBLE), CAST(d2 - a AS DOUBLE) FROM d)
        SELECT feature_group, removed_features, count(*) AS n_matched, avg(abs(f)) AS full_mae_days, avg(abs(r)) AS ablated_mae_days,
          avg(abs(r)) - avg(abs(f)) AS delta_mae, sqrt(avg(f * f)) AS full_rmse_days, sqrt(avg(r * r)) AS ablated_rmse_days,
          sqrt(avg(r * r)) - sqrt(avg(f * f)) AS delta_rmse
        FROM e WHERE f IS NOT NULL AND r IS NOT NULL GROUP BY ALL""",
    rounds="full_mae_days ablated_mae_days delta_mae full_rmse_days ablated_rmse_days delta_rmse",
)
def _(spark, sf):
    return M.ablate_calibrator(seasonal(spark, sf), {"signal": PAIR[:1], "calendar": PAIR[1:]}, PAIR, cfg=CFG)


@query("walk_forward_termination", "F10")
def _(spark, sf):
    return M.walk_forward_termination(folds(spark, sf), "trajectory_year", CFG)


@query("apply_by_cutoff", "F11")
def _(spark, sf):
    detail = reliable(folds(spark, sf))
    features = reliable(G.termination_features(detail))
    models = {
        f"{y}-01-01": m for y, m in M.walk_forward_models(features, "trajectory_year", CFG).items()
    }
    return M.apply_by_cutoff(detail, models, None, CFG)


@query("ablate_calibrator_groups", "F12")
def _(spark, sf):
    features = reliable(G.termination_features(folds(spark, sf)))
    return M.ablate_calibrator(features, M.TERMINATION_GROUPS, ["stage", *G.NUMERIC_FEATURES], cfg=CFG)


@query("ablate_base_groups", "F12")
def _(spark, sf):
    events, daily = stored(spark, sf)
    keys = ["prediction_date", "location_id", "stage_id"]

    def run(inputs):
        cfg = dataclasses.replace(CFG, features=tuple(inputs))
        fold = M.oof_trajectories(events, daily, M.fit_gbt, cfg)
        return fold.withColumn("error_days", F.col(M.RAW) - F.col("actual_days_to_event"))

    return M.ablate(run, MODEL_FEATURES, M.BASE_GROUPS, keys)


def bundle(spark, sf):
    events, daily = stored(spark, sf)
    matrix = reliable(training_matrix(events, daily, TEST_DATE, CFG))
    base = M.fit_if_any(M.fit_gbt, matrix, CFG.features, CFG.target)
    # every season, but only what was known at the cutoff
    prior = events.where(F.col("stage_date") < F.lit(TEST_DATE).cast("timestamp_ntz"))
    oof = M.oof_trajectories(prior, daily, M.fit_gbt, CFG)
    oof = reliable(oof.where(F.col("prediction_date") < F.lit(TEST_DATE).cast("date")))
    ridge = None if oof.isEmpty() else M.fit_ridge(G.termination_features(oof), "actual_days_to_event", CFG.ridge_alpha)
    path = scratch_dir(spark)
    manifest = M.save_bundle(path, base, ridge, CFG, TEST_DATE, {"events": events, "matrix": matrix})
    return M.load_bundle(spark, path), manifest, events, daily


@query("save_and_load_bundle", "F15")
def _(spark, sf):
    return bundle(spark, sf)[1]


@query("hindcast", "F16")
def _(spark, sf):
    loaded, _, events, daily = bundle(spark, sf)
    dates = events.select(F.to_date("stage_date").alias("prediction_date")).distinct()
    return M.hindcast(loaded.base, daily, dates, A.locations(spark, sf), CFG.features)


@query("predict_latest", "F17")
def _(spark, sf):
    loaded, _, events, daily = bundle(spark, sf)
    season = build_trajectory(daily, events, 1999, through="1999-05-31")
    visible = season.withColumnRenamed("date", "prediction_date")
    return M.predict_latest(visible, loaded, CFG)


@query("termination_score", "G11")
def _(spark, sf):
    frame = A.trajectory(spark, sf).withColumn(
        "actual_days_to_event", F.datediff("actual_stage_date", "prediction_date").cast("double")
    )
    features = reliable(G.termination_features(frame))
    model = M.fit_ridge(features, "actual_days_to_event", CFG.ridge_alpha)
    return G.termination_score(features, model, CFG.termination_threshold).select(
        "location_id",
        "stage_id",
        "prediction_date",
        "learned_days_remaining",
        "termination_adjusted_days_remaining",
    )
