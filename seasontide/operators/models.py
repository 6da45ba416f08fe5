"""Tree regressors, the ridge calibrator and the chronological folds.

The trainers are Spark ML.  A fitted calibrator is a handful of numbers, so it
scores as a column expression inside whole-stage codegen.
"""

from __future__ import annotations

import json
import logging
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import asdict, dataclass
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seasontide.config import TARGET_IDS, Settings
from seasontide.functions import scalars as S
from seasontide.functions.checkpoints import reliable
from seasontide.functions.ordering import keep_first
from seasontide.functions.quantiles import complement_percentiles
from seasontide.operators import calibrator as C
from seasontide.operators import termination as T
from seasontide.operators.audits import require_inference
from seasontide.operators.calibrator import RidgeCalibrator
from seasontide.operators.evaluation import collapse_predictions, delta_columns, matched_delta
from seasontide.operators.events import add_output_names
from seasontide.operators.frames import add_stages, fold_matrix, fold_rows, fold_seasons
from seasontide.operators.intervals import interval_width, steps, thresholds

RAW = "raw_signed_days"
#: Rows that are worth a task of their own; every level of every tree is a job over all tasks.
ROWS_PER_TASK = 100_000
#: Fits that run side by side at most, as the driver holds the trees of each.
FITS_AT_ONCE = 8
log = logging.getLogger(__name__)
Fit = Callable[[DataFrame, Sequence[str], str], PipelineModel]

# ---------------------------------------------------------------- base models


def coerce_features(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Numeric features; anything unparsable becomes NULL."""
    return df.withColumns({c: S.number(F.col(c)) for c in features})


def assemble(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Feature vector in the configured order; rows with a missing feature are skipped."""
    stage = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="skip")
    return stage.transform(coerce_features(df, features))


def _fit(df: DataFrame, features: Sequence[str], label: str, regressor) -> PipelineModel:
    regressor.setParams(featuresCol="features", labelCol=label, predictionCol=RAW)
    assembler = VectorAssembler(
        inputCols=list(features), outputCol="features", handleInvalid="skip"
    )
    typed = coerce_features(df.select(*dict.fromkeys([*features, label])), features)
    typed = typed.withColumn(label, F.col(label).cast("double")).where(F.col(label).isNotNull())
    return Pipeline(stages=[assembler, regressor]).fit(typed)


def fit_rf(
    df: DataFrame, features: Sequence[str], label: str, params: Mapping | None = None
) -> PipelineModel:
    """Random-forest regressor; 200 trees and seed 42 unless overridden."""
    chosen = {"numTrees": 200, "maxDepth": 10, "seed": 42, **(params or {})}
    return _fit(df, features, label, RandomForestRegressor(**chosen))


def fit_gbt(
    df: DataFrame, features: Sequence[str], label: str, params: Mapping | None = None
) -> PipelineModel:
    """Boosted-tree regressor with the configured size, rate and depth."""
    chosen = {**Settings().tree_params, **(params or {})}
    return _fit(df, features, label, GBTRegressor(**chosen))


def training_tasks(rows: int) -> int:
    """Tasks of about ``ROWS_PER_TASK`` rows."""
    return max(1, -(-rows // ROWS_PER_TASK))


def fit_if_any(fit: Fit, df: DataFrame, features: Sequence[str], label: str) -> PipelineModel | None:
    """The fitted model, or None with a warning if there is no row to train on.  Pass a stored table."""
    n = df.count()
    if not n:
        log.warning("no training rows; rows are scored NULL")
        return None
    return fit(df.coalesce(training_tasks(n)), features, label)


def score(model: PipelineModel | None, df: DataFrame, features: Sequence[str]) -> DataFrame:
    """All rows with the raw signed prediction; NULL where a feature is missing or there is no model.

    Rows without a feature are left out of training only.
    """
    if model is None:
        return coerce_features(df.drop(RAW), features).withColumn(RAW, F.lit(None).cast("double"))
    keeping = model.copy()
    for stage in keeping.stages:
        if isinstance(stage, VectorAssembler):
            stage.setHandleInvalid("keep")
    known = F.lit(True)
    for c in features:
        known = known & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    scored = keeping.transform(coerce_features(df.drop(RAW), features)).drop("features")
    return scored.withColumn(RAW, F.when(known, F.col(RAW)))


def format_predictions(df: DataFrame, carried: Sequence[str] = ()) -> DataFrame:
    """Business output of scored rows: clipped days and the predicted calendar day.

    ``carried`` columns go along; a carried trajectory_year replaces that of the date.
    """
    day = F.to_date(F.col("date" if "date" in df.columns else "prediction_date"))
    ids = [c for c in ("place_id", "location_id") if c in df.columns]
    return df.select(
        F.col("stage_id").cast("int").alias("stage_id"),
        "latitude",
        "longitude",
        *ids,
        day.alias("prediction_date"),
        *([] if "trajectory_year" in carried else [F.year(day).alias("trajectory_year")]),
        *carried,
        F.col(RAW),
        S.floor_at_zero(F.col(RAW)).alias("predicted_days"),
    ).withColumn(
        "predicted_stage_date", S.plus_whole_days(F.col("prediction_date"), F.col("predicted_days"))
    )


def monotone_audit(
    model: PipelineModel | None,
    df: DataFrame,
    feature: str,
    features: Sequence[str],
    grid: Sequence[float] | None = None,
) -> DataFrame:
    """Per stage: rows checked and steps at which the prediction rises with the feature.

    Without a grid the values are those between which the ensemble's own thresholds
    lie, so every step of the prediction is seen and the audit is exact.  There are
    at most as many as the trainer's bins.  Each value is scored as one more column
    of the same row, so nothing is shuffled and rows are not multiplied.  Rows with
    another feature missing have no prediction and no step.  No model has no step at all.
    """
    if grid is None:
        grid = [] if model is None else steps(thresholds(model, list(features).index(feature)))
    out = df.select("*", F.col("stage_id").alias("_stage"))
    names = []
    for i, value in enumerate(grid):
        names.append(f"_p{i}")
        out = score(model, out.withColumn(feature, F.lit(float(value))), features)
        out = out.withColumnRenamed(RAW, names[-1])
    rises = F.lit(0)
    for before, after in zip(names, names[1:]):
        rises = rises + F.coalesce((F.col(after) > F.col(before) + 1e-9).cast("int"), F.lit(0))
    return out.groupBy(F.col("_stage").alias("stage_id")).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(rises).alias("n_violations"),
        F.count_if(rises > 0).alias("n_rows_violating"),
        F.lit(len(grid)).alias("n_values"),
    )


def conformal_interval(
    predictions: DataFrame, calibration: DataFrame, alpha: float, pred: str = "pred"
) -> DataFrame:
    """Prediction +- the (1 - alpha) quantile of the absolute calibration error.

    The errors (column error) must come from rows that neither the model was fitted
    on nor ``predictions`` holds: earlier seasons, or out-of-bag rows.
    """
    width = interval_width(calibration, alpha).select("width").scalar()
    return (
        predictions.withColumn("_w", width)
        .withColumns({f"{pred}_lower": F.col(pred) - F.col("_w"), f"{pred}_upper": F.col(pred) + F.col("_w")})
        .drop("_w")
    )


def cross_conformal_interval(
    df: DataFrame, season: str, alpha: float, pred: str = "pred", error: str = "error"
) -> DataFrame:
    """Prediction +- the (1 - alpha) quantile of the absolute errors of all other seasons.

    Every row is predicted and every row with an ``error`` calibrates, but never its own
    season.  NULL interval where no other season has an error.
    """
    # one row per season
    seasons = sorted(r[0] for r in df.select(F.col(season).cast("int")).distinct().collect() if r[0] is not None)
    errors = df.select(F.col(season).cast("int").alias("_s"), F.abs(error).alias("_e"))
    widths = complement_percentiles(errors, "_s", seasons, {"_w": ("_e", 1.0 - alpha)})
    return (
        df.join(widths, F.col(season).cast("int") == F.col("_s"), "left")
        .withColumns({f"{pred}_lower": F.col(pred) - F.col("_w"), f"{pred}_upper": F.col(pred) + F.col("_w")})
        .drop("_s", "_w")
    )


# ---------------------------------------------------------------- ridge calibrator


def fit_ridge(
    df: DataFrame,
    target: str,
    alpha: float = 30.0,
    features: Sequence[str] = T.NUMERIC_FEATURES,
    with_stage: bool = True,
) -> RidgeCalibrator:
    """Fit the calibrator on trajectory features: one cutoff behind all rows.

    Medians are exact and come from value counts; the rest is solved from one matrix
    of sums.  ``df`` is read three times.
    """
    whole = df.withColumn("_season", F.lit(0))
    sums = C.season_sums(whole, "_season", target, features, cutoffs=[1])
    if not sums.cutoffs:
        raise ValueError("no rows to fit the calibrator")
    return C.solve(sums, 1, alpha, with_stage=with_stage)


# ---------------------------------------------------------------- chronological folds


class EmptyFold(ValueError):
    """A fold without a training row."""


def trace_values(year: int) -> dict:
    """Trace values of the model trained strictly before January 1 of ``year``."""
    return {"model_train_cutoff_date": f"{year}-01-01", "model_train_end_year": year - 1}


def fit_for_cutoff(
    events: DataFrame,
    features: DataFrame,
    year: int,
    fit: Fit = fit_gbt,
    cfg: Settings = Settings(),
    matrix: DataFrame | None = None,
) -> tuple[PipelineModel, dict]:
    """Model trained strictly before January 1 of ``year``, with its trace values.

    ``matrix`` is a stored ``frames.fold_matrix``, of which the fold is a filter.
    """
    if matrix is None:
        matrix = reliable(fold_matrix(events, features, cfg))
    rows = fold_rows(matrix, year, cfg)
    n = rows.count()
    if not n:
        raise EmptyFold(f"no training rows before {year}-01-01")
    return fit(rows.coalesce(training_tasks(n)), cfg.features, cfg.target), trace_values(year)


def actual_days(df: DataFrame) -> Column:
    return S.days_between(
        F.col("actual_stage_date").cast("timestamp_ntz"),
        F.col("prediction_date").cast("timestamp_ntz"),
    )


def oof_trajectories(
    events: DataFrame,
    features: DataFrame,
    fit: Fit = fit_gbt,
    cfg: Settings = Settings(),
    years: Iterable[int] | None = None,
    matrix: DataFrame | None = None,
) -> DataFrame:
    """Trajectories of each year scored by a model that saw only earlier events.

    Labels and season rows are built once for all folds; ``matrix`` is a stored
    ``frames.fold_matrix`` if the caller has one.  Each of a handful of seasons needs
    its own model; while a fit has fewer tasks than the cores, several run side by side.
    A season without a training row before it is left out, with a warning; if that
    leaves none, there are no rows.
    """
    # one row per season
    known = sorted(r[0] for r in events.select(F.year("stage_date")).distinct().collect() if r[0])
    years = [y for y in (years or known) if any(k < y for k in known)]
    if matrix is None:
        matrix = reliable(fold_matrix(events, features, cfg))
    kept = [c for c in features.columns if c not in ("trajectory_year", "stage_id", "actual_stage_date")]
    trace = ["trajectory_year", "model_train_cutoff_date", "model_train_end_year", "actual_stage_date"]
    seasons = reliable(fold_seasons(features.select(*kept), events, years, cfg))

    def fold(year: int) -> PipelineModel | None:
        try:
            return fit_for_cutoff(events, features, year, fit, cfg, matrix)[0]
        except EmptyFold as empty:
            log.warning("fold %s is left out: %s", year, empty)
            return None

    spark = matrix.sparkSession
    room = spark.sparkContext.defaultParallelism // training_tasks(matrix.count())
    with ThreadPool(min(max(room, 1), FITS_AT_ONCE)) as pool:
        models = pool.map(inheritable_thread_target(spark)(fold), years, chunksize=1)
    folds = None
    for year, model in zip(years, models):
        if model is None:
            continue
        scored = format_predictions(score(model, seasons.where(F.col("trajectory_year") == year), cfg.features), trace)
        folds = scored if folds is None else folds.unionByName(scored)
    if folds is None:
        log.warning("no season has training rows before it")
        folds = format_predictions(score(None, seasons.where(F.lit(False)), cfg.features), trace)
    return folds.withColumn("actual_days_to_event", actual_days(folds))


def _chained(
    models: Mapping, column: Column, cast: str, fallback: RidgeCalibrator | None = None
) -> Column:
    """Score of the model that belongs to each row; NULL where there is none."""
    out = fallback.expression() if fallback else F.lit(None).cast("double")
    for value, model in models.items():
        out = F.when(column == F.lit(value).cast(cast), model.expression()).otherwise(out)
    return out


def _apply_models(
    features: DataFrame, learned: Column, cfg: Settings, key: Sequence[str], base_columns
) -> DataFrame:
    """Lock all trajectories in one pass; rows without a model keep their base output."""
    scored = features.withColumn("learned_days_remaining", learned)
    locked = T.lock_trajectories(scored, cfg, key)
    has_model = F.col("learned_days_remaining").isNotNull()
    flags = ("termination_output_applied", "termination_reached", "termination_first_hit")
    cleaned = locked.withColumns(
        {
            **{c: F.col(c) & has_model for c in flags},
            "termination_rule": F.when(has_model, F.col("termination_rule")),
            "predicted_days": F.when(has_model, F.col("predicted_days")).otherwise(
                F.col("base_predicted_days")
            ),
            "predicted_stage_date": F.when(has_model, F.col("predicted_stage_date")).otherwise(
                F.to_date("base_predicted_stage_date")
            ),
        }
    )
    added = [c for c in cleaned.columns if c not in features.columns]
    return cleaned.select(*base_columns, *added)


def walk_forward_models(
    features: DataFrame, year: str, cfg: Settings = Settings(), target: str = "actual_days_to_event"
) -> dict[int, RidgeCalibrator]:
    """One calibrator per season with labelled earlier seasons; others have none and stay base.

    All seasons are solved from one set of sums.
    """
    # one row per season
    seasons = [r[0] for r in features.select(year).distinct().collect() if r[0] is not None]
    sums = C.season_sums(features, year, target, cutoffs=sorted(seasons))
    return {y: C.solve(sums, y, cfg.ridge_alpha) for y in sums.cutoffs}


def walk_forward_termination(
    detail: DataFrame, year: str = "trajectory_year", cfg: Settings = Settings()
) -> DataFrame:
    """Calibrate each season with earlier seasons only; the first season stays base.

    Trajectory features do not cross seasons, so they are built once and kept.
    """
    key = [year, "location_id", "stage_id"]
    features = reliable(T.termination_features(detail, key))
    models = walk_forward_models(features, year, cfg)
    learned = _chained(models, F.col(year), "int")
    return _apply_models(features, learned, cfg, key, detail.columns)


def apply_by_cutoff(
    df: DataFrame,
    models: Mapping[str, RidgeCalibrator],
    fallback: RidgeCalibrator | None = None,
    cfg: Settings = Settings(),
    key: Sequence[str] = T.TRAJECTORY,
) -> DataFrame:
    """Apply the calibrator of each training cutoff, else the fallback, else nothing."""
    key = ["model_train_cutoff_date", *key]
    features = T.termination_features(df, key)
    learned = _chained(models, F.col("model_train_cutoff_date"), "date", fallback)
    return _apply_models(features, learned, cfg, key, df.columns)


# ---------------------------------------------------------------- ablation and sweeps

# Feature groups removed one at a time.
BASE_GROUPS = {
    "lifecycle context": ("stage_id",),
    "heat accumulation": ("cumu_gdd_air", "rolling_gdd_air"),
    "moisture": ("rolling_humidity_mean_pct", "cumu_precip_total_mm"),
    "cold accumulation": ("cumu_cdd_air", "rolling_cdd_air"),
    "seasonal and spatial context": ("doy", "latitude", "longitude"),
}
TERMINATION_GROUPS = {
    "static context": (
        "stage",
        "prediction_day_of_year",
        "feature_latitude",
        "feature_longitude",
    ),
    "base prediction signal": ("termination_signal_days", "raw_signed_days", "predicted_days"),
    "recent trajectory shape": (
        "signal_lag1",
        "signal_lag2",
        "signal_lag3",
        "slope_1",
        "slope_2",
        "slope_3",
        "recent_mean_3",
        "recent_std_3",
        "recent_min_3",
        "recent_max_3",
    ),
    "estimated crossing": (
        "rolling_linear_crossing_0",
        "rolling_linear_crossing_minus_0_5",
        "rolling_spline_crossing_0",
        "rolling_spline_crossing_minus_0_5",
        "days_to_rolling_crossing_0",
        "days_to_rolling_crossing_minus_0_5",
    ),
}


def first_hit_events(
    df: DataFrame, key: Sequence[str] = ("test_year", "location_id", "stage_id")
) -> DataFrame:
    """Decision = first date with nothing left, one row per trajectory that has one."""
    hit = F.when(F.col("adjusted") <= 0, F.col("prediction_date"))
    decided = (
        df.groupBy(*key)
        .agg(F.min(hit).alias("decision_date"), F.min("actual_stage_date").alias("actual_stage_date"))
        .where("decision_date IS NOT NULL AND actual_stage_date IS NOT NULL")
    )
    return decided.withColumn(
        "error_days",
        S.days_between(
            F.col("decision_date").cast("timestamp_ntz"),
            F.col("actual_stage_date").cast("timestamp_ntz"),
        ),
    )


def ablate_calibrator(
    features: DataFrame,
    groups: Mapping[str, Sequence[str]],
    inputs: Sequence[str],
    year: str = "trajectory_year",
    cfg: Settings = Settings(),
    target: str = "actual_days_to_event",
    name: str = "feature_group",
) -> DataFrame:
    """Walk-forward calibrators without each group of inputs against those with all; worst loss first.

    One set of sums solves every season and group, and one aggregate over the stored
    trajectory features finds the first hits of all of them.  Runs are compared on the
    trajectories that both reach.  A season without earlier labels has no decision.
    """
    numeric = [c for c in inputs if c != "stage"]
    sums = C.season_sums(features, year, target, numeric)
    runs = [(), *groups.values()]
    key = [year, "location_id", "stage_id"]
    hits = []
    for i, removed in enumerate(runs):
        kept = [c for c in numeric if c not in removed]
        models = {
            y: C.solve(sums, y, cfg.ridge_alpha, kept, "stage" in inputs and "stage" not in removed)
            for y in sums.cutoffs
        }
        learned = _chained(models, F.col(year), "int")
        # NULL without a model, so no hit
        hit = learned - cfg.termination_threshold <= 0
        hits.append(F.min(F.when(hit, F.col("prediction_date"))).alias(f"_d{i}"))
    decided = features.groupBy(*key).agg(*hits, F.min("actual_stage_date").alias("_actual"))

    def error(i: int) -> Column:
        return S.days_between(F.col(f"_d{i}").cast("timestamp_ntz"), F.col("_actual").cast("timestamp_ntz"))

    pairs = [
        F.struct(
            F.lit(label).alias(name),
            F.lit(", ".join(removed)).alias("removed_features"),
            error(0).alias("_f"),
            error(i).alias("_r"),
        )
        for i, (label, removed) in enumerate(groups.items(), 1)
    ]
    both = decided.select(F.explode(F.array(*pairs)).alias("_p")).select("_p.*").where("_f IS NOT NULL AND _r IS NOT NULL")
    return both.groupBy(name, "removed_features").agg(*delta_columns("_f", "_r")).orderBy(F.desc("delta_rmse"), name)


def ablate(
    run: Callable[[list[str]], DataFrame],
    features: Sequence[str],
    specs: Mapping[str, Sequence[str]],
    keys: Sequence[str],
    name: str = "feature_group",
) -> DataFrame:
    """Refit without each group and compare on the common keys; worst loss first.

    ``run`` takes the inputs to use and returns keys with ``error_days``.
    """
    full = reliable(run(list(features)).select(*keys, "error_days"))
    rows = None
    for label, removed in specs.items():
        kept = [f for f in features if f not in removed]
        row = matched_delta(full, run(kept), keys).select(
            F.lit(label).alias(name), F.lit(", ".join(removed)).alias("removed_features"), "*"
        )
        rows = row if rows is None else rows.unionByName(row)
    return rows.orderBy(F.desc("delta_rmse"), name)


def sweep(
    values: Sequence, run: Callable[[object], DataFrame], name: str = "value"
) -> DataFrame:
    """Summaries of one run per parameter value, stacked."""
    out = None
    for value in values:
        row = run(value).withColumn(name, F.lit(value))
        out = row if out is None else out.unionByName(row)
    return out


# ---------------------------------------------------------------- bundles and inference


@dataclass(frozen=True)
class Bundle:
    base: PipelineModel | None
    calibrator: RidgeCalibrator | None
    features: tuple[str, ...]
    manifest: dict


def fingerprint(df: DataFrame) -> DataFrame:
    """Order-independent content hash and row count of a table."""
    cols = [F.col(c).cast("string") for c in sorted(df.columns)]
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.coalesce(F.sum(F.xxhash64(*cols).cast("decimal(38,0)")), F.lit(0)).cast("string").alias(
            "content_hash"
        ),
    )


def save_bundle(
    path: str,
    base: PipelineModel | None,
    calibrator: RidgeCalibrator | None,
    cfg: Settings,
    cutoff: str,
    inputs: Mapping[str, DataFrame],
    facts: Mapping[str, DataFrame] | None = None,
) -> DataFrame:
    """Write both models and a manifest of settings, cutoff, counts and hashes.

    ``facts`` are tables about the training data, such as label coverage and counts;
    they are stored beside the models.  The manifest has their and the inputs' row
    counts and content hashes, and is written last.  An existing bundle is an error.
    A model that had no row to train on is None and named null in the manifest.
    """
    spark = SparkSession.active()
    if base is not None:
        base.write().save(f"{path}/base_model")
    manifest = spark.createDataFrame(
        [
            ("features", json.dumps(list(cfg.features))),
            ("settings", json.dumps(asdict(cfg))),
            ("training_cutoff", cutoff),
            ("calibrator", "null" if calibrator is None else calibrator.to_json()),
            *([("base_model", "null")] if base is None else []),
        ],
        "name string, value string",
    ).withColumn("content_hash", F.sha2("value", 256))
    listed = {f"input_{name}": df for name, df in inputs.items()}
    for name, df in (facts or {}).items():
        df.write.parquet(f"{path}/{name}")
        listed[f"fact_{name}"] = spark.read.parquet(f"{path}/{name}")
    for name, df in listed.items():
        manifest = manifest.unionByName(
            fingerprint(df).select(
                F.lit(name).alias("name"),
                F.col("n_rows").cast("string").alias("value"),
                "content_hash",
            )
        )
    manifest.write.parquet(f"{path}/manifest")
    return spark.read.parquet(f"{path}/manifest")


def load_bundle(spark: SparkSession, path: str) -> Bundle:
    """Read both models back; the manifest and the model must name the same inputs."""
    rows = spark.read.parquet(f"{path}/manifest")
    bad = rows.where("name NOT LIKE 'input_%' AND name NOT LIKE 'fact_%'").where(F.sha2("value", 256) != F.col("content_hash"))
    if not bad.isEmpty():
        raise ValueError("bundle manifest does not match its hashes")
    for fact in rows.where("name LIKE 'fact_%'").collect():
        stored = spark.read.parquet(f"{path}/{fact['name'].removeprefix('fact_')}")
        if fingerprint(stored).first()["content_hash"] != fact["content_hash"]:
            raise ValueError(f"{fact['name']} does not match its hash")
    manifest = {r["name"]: r["value"] for r in rows.collect()}
    base = None if manifest.get("base_model") == "null" else PipelineModel.load(f"{path}/base_model")
    features = tuple(json.loads(manifest["features"]))
    if base is not None and tuple(base.stages[0].getInputCols()) != features:
        raise ValueError("model inputs differ from the manifest")
    calibrator = None if manifest["calibrator"] == "null" else RidgeCalibrator.from_json(manifest["calibrator"])
    return Bundle(base, calibrator, features, manifest)


def predict_trajectory(
    df: DataFrame, bundle: Bundle, cfg: Settings = Settings(), ids: Sequence[int] = TARGET_IDS
) -> DataFrame:
    """Base prediction, lock and output names of a visible seasonal trajectory.

    Without a calibrator rows keep their base output.
    """
    checked = require_inference(df, bundle.features, ids)
    base = format_predictions(score(bundle.base, checked, bundle.features))
    if bundle.calibrator is None:
        features = T.termination_features(base)
        unlocked = _apply_models(features, F.lit(None).cast("double"), cfg, T.TRAJECTORY, base.columns)
        return add_output_names(unlocked)
    return add_output_names(T.apply_termination(base, bundle.calibrator, cfg))


def predict_latest(
    df: DataFrame, bundle: Bundle, cfg: Settings = Settings(), ids: Sequence[int] = TARGET_IDS
) -> DataFrame:
    """Rows of the last visible prediction date."""
    full = predict_trajectory(df, bundle, cfg, ids)
    latest = df.agg(F.max(F.to_date("prediction_date"))).scalar()
    return full.where(F.col("prediction_date") == latest)


def hindcast(
    model: PipelineModel | None,
    daily: DataFrame,
    dates: DataFrame,
    scope: DataFrame,
    features: Sequence[str],
    stages: Sequence[int] = TARGET_IDS,
    mapped: DataFrame | None = None,
    calibrator: RidgeCalibrator | None = None,
    cfg: Settings = Settings(),
) -> DataFrame:
    """Frozen-model predictions for the listed dates, stages and locations, in one batch.

    ``mapped`` (of ``spatial.map_custom_points``) adds the input point of each
    location; a calibrator locks the trajectories of the listed dates.
    """
    wanted = dates.select(F.col("prediction_date").cast("date").alias("date")).distinct()
    rows = daily.join(wanted, "date", "left_semi").join(
        scope.select("location_id"), "location_id", "left_semi"
    )
    scored = score(model, add_stages(rows, stages), features)
    out = collapse_predictions(format_predictions(scored))
    if calibrator is not None:
        out = T.apply_termination(out, calibrator, cfg)
    if mapped is not None:
        inputs = [c for c in mapped.columns if c.startswith(("input_", "mapped_"))]
        named = keep_first(mapped.select("location_id", *inputs), ["location_id"], inputs)
        out = out.join(named, "location_id", "left")
    return out
