"""Training, daily prediction and backtest as one call each."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seasontide.config import Settings
from seasontide.functions.checkpoints import reliable
from seasontide.operators import events as E
from seasontide.operators import models as M
from seasontide.operators import termination as T
from seasontide.operators.evaluation import walk_forward_summary
from seasontide.operators.frames import add_stages, aligned_window, fold_matrix, training_matrix
from seasontide.sources.sinks import write_predictions


def gate(events: DataFrame, cutoff: str, cfg: Settings = Settings()) -> DataFrame | None:
    """Label coverage of the training window; raises where a target has too few labels.

    Without a window there is nothing recent to ask for, and no table.
    """
    if cfg.window_years is None:
        return None
    coverage = E.label_coverage(events, cutoff, cfg.window_years, cfg.target_ids)
    return E.require_coverage(coverage, cfg.min_events_per_target, cfg.min_years_per_target)


def calibrator_rows(oof: DataFrame, cutoff: str, cfg: Settings = Settings()) -> DataFrame:
    """Trajectory features of the out-of-fold rows that the final calibrator is fitted on.

    Features see the whole trajectory before the window is applied, as a row near the
    window's start has its history too.
    """
    known = oof.where(
        (F.col("prediction_date") <= F.lit(cutoff).cast("date"))
        & (F.col("actual_stage_date") < F.lit(cutoff).cast("timestamp_ntz"))
    )
    features = T.termination_features(known)
    if cfg.calibrator_years is None:
        return features
    dated = features.withColumn("date", F.col("prediction_date"))
    return aligned_window(dated, cutoff, cfg.calibrator_years).drop("date")


def train(
    events: DataFrame, daily: DataFrame, cutoff: str, path: str, cfg: Settings = Settings(), fit: M.Fit = M.fit_gbt
) -> DataFrame:
    """Gate, base model, out-of-fold calibrator and bundle below ``path``; returns the manifest.

    ``events`` are prepared events, ``daily`` engineered features; each is read once and
    stored.  Short label coverage raises before anything is fitted or saved.  The base
    model sees the training window up to and with the cutoff; folds and calibrator see
    events before it only.
    """
    coverage = gate(events, cutoff, cfg)
    before = F.col("stage_date") < F.lit(cutoff).cast("timestamp_ntz")
    events, daily = reliable(events.where(before)), reliable(daily.where(F.col("date") <= F.lit(cutoff).cast("date")))
    matrix = reliable(training_matrix(events, daily, cutoff, cfg, include_test_date=True))
    if matrix.isEmpty():
        raise M.EmptyFold(f"no training rows up to {cutoff}")
    base = fit(matrix, cfg.features, cfg.target)
    rows = reliable(calibrator_rows(M.oof_trajectories(events, daily, fit, cfg), cutoff, cfg))
    ridge = M.fit_ridge(rows, "actual_days_to_event", cfg.ridge_alpha)
    facts = {"label_counts": E.label_counts(events)}
    if coverage is not None:
        facts["label_coverage"] = coverage
    return M.save_bundle(path, base, ridge, cfg, cutoff, {"events": events, "matrix": matrix}, facts)


def season_start(day: str) -> str:
    """March 1 of the season that a day lies in."""
    at = date.fromisoformat(day)
    return f"{at.year if (at.month, at.day) >= (3, 1) else at.year - 1}-03-01"


def predict_day(
    spark: SparkSession, daily: DataFrame, bundle_path: str, day: str, output: str | None = None, cfg: Settings = Settings()
) -> DataFrame:
    """Predictions of one day, calibrated on the trajectory since the season's start; stored below ``output`` if given."""
    bundle = M.load_bundle(spark, bundle_path)
    since = F.col("date").between(F.lit(season_start(day)).cast("date"), F.lit(day).cast("date"))
    visible = add_stages(daily.where(since), cfg.target_ids).withColumnRenamed("date", "prediction_date")
    full = M.predict_trajectory(visible, bundle, cfg, cfg.target_ids)
    today = full.where(F.col("prediction_date") == F.lit(day).cast("date"))
    if output is None:
        return today
    today = reliable(today)
    write_predictions(today, output, day)
    return today


def backtest(
    events: DataFrame, daily: DataFrame, cfg: Settings = Settings(), fit: M.Fit = M.fit_gbt, years: Iterable[int] | None = None
) -> tuple[DataFrame, DataFrame]:
    """(trajectories, metrics) of chronological folds with walk-forward calibrators.

    Every season is scored by models of earlier seasons only; all folds share one
    labelled matrix.  Metrics are per (season, target).
    """
    events, daily = reliable(events), reliable(daily)
    matrix = reliable(fold_matrix(events, daily, cfg))
    oof = reliable(M.oof_trajectories(events, daily, fit, cfg, years, matrix))
    detail = reliable(M.walk_forward_termination(oof, "trajectory_year", cfg))
    return detail, walk_forward_summary(detail)
