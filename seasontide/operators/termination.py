"""Causal trajectory features and the first-hit lock.

A trajectory is one (season, location, stage); it holds one row per prediction
date (``evaluation.collapse_predictions`` makes it so), hence at most 366 rows
per window group.  Every window below uses the same partitioning and order, so
Spark plans one exchange and one sort for all of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seasontide.config import Settings
from seasontide.functions import scalars as S

TRAJECTORY = ("trajectory_year", "location_id", "stage_id")

# Calibrator inputs, in training order.
NUMERIC_FEATURES = (
    "prediction_day_of_year",
    "feature_latitude",
    "feature_longitude",
    "termination_signal_days",
    "raw_signed_days",
    "predicted_days",
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
    "rolling_linear_crossing_0",
    "rolling_linear_crossing_minus_0_5",
    "rolling_spline_crossing_0",
    "rolling_spline_crossing_minus_0_5",
    "days_to_rolling_crossing_0",
    "days_to_rolling_crossing_minus_0_5",
)
CROSSINGS = (("0", 0.0), ("minus_0_5", -0.5))
# Fixed value: the rule tag of locked rows.
RULE_NAME = "learned_ridge_v2.4"


def _ordered(key: Sequence[str]):
    return Window.partitionBy(*key).orderBy("prediction_date")


def trajectory_key(df: DataFrame) -> list[str]:
    """Key columns: the first season column with a value, then location or coordinates, then stage.

    One aggregate row is read to see which columns hold values.
    """
    seasons = [c for c in ("trajectory_year", "test_year", "prediction_year") if c in df.columns]
    places = [c for c in ("location_id",) if c in df.columns]
    probe = {}
    if seasons or places:
        probe = (
            df.agg(*[F.bool_or(F.col(c).isNotNull()).alias(c) for c in seasons + places])
            .first()
            .asDict()
        )
    season = next((c for c in seasons if probe[c]), None)
    where = ["location_id"] if probe.get("location_id") else ["feature_latitude", "feature_longitude"]
    return ([season] if season else []) + where + ["stage_id"]


def trajectory_signal(df: DataFrame) -> DataFrame:
    """The raw signal (else the clipped one), day of year and coordinates as features."""
    raw, clipped = S.number(F.col("raw_signed_days")), S.number(F.col("predicted_days"))
    signal = F.coalesce(raw, clipped)
    return df.withColumns(
        {
            "raw_signed_days": raw,
            "predicted_days": clipped,
            "termination_signal_days": signal,
            "signal": signal,
            "prediction_day_of_year": F.dayofyear("prediction_date").cast("double"),
            "feature_latitude": S.number(F.col("latitude")),
            "feature_longitude": S.number(F.col("longitude")),
            "stage": F.col("stage_id").cast("int").cast("string"),
        }
    )


def add_lags(df: DataFrame, key: Sequence[str] = TRAJECTORY) -> DataFrame:
    w = _ordered(key)
    return df.withColumns({f"signal_lag{n}": F.lag("signal", n).over(w) for n in (1, 2, 3)})


def add_slopes(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "slope_1": F.col("signal") - F.col("signal_lag1"),
            "slope_2": F.col("signal_lag1") - F.col("signal_lag2"),
            "slope_3": F.col("signal_lag2") - F.col("signal_lag3"),
        }
    )


def add_recent(df: DataFrame, key: Sequence[str] = TRAJECTORY) -> DataFrame:
    """Statistics of the three rows before the current one; the deviation needs two values."""
    w = _ordered(key).rowsBetween(-3, -1)
    return df.withColumns(
        {
            "recent_mean_3": F.avg("signal").over(w),
            "recent_std_3": F.when(F.count("signal").over(w) >= 2, F.stddev_samp("signal").over(w)),
            "recent_min_3": F.min("signal").over(w),
            "recent_max_3": F.max("signal").over(w),
        }
    )


def linear_crossing(
    df: DataFrame, threshold: float, name: str, key: Sequence[str] = TRAJECTORY
) -> DataFrame:
    """Day at which the line through all visible points reaches the threshold.

    NULL with fewer than two distinct days or a flat line.  The frame ends at the
    current row, so no later prediction leaks in.
    """
    w = _ordered(key).rowsBetween(Window.unboundedPreceding, 0)
    day = F.when(F.col("signal").isNotNull(), F.col("prediction_day_of_year"))
    slope = F.regr_slope("signal", "prediction_day_of_year").over(w)
    intercept = F.regr_intercept("signal", "prediction_day_of_year").over(w)
    two_days = F.min(day).over(w) < F.max(day).over(w)
    return df.withColumn(
        name,
        F.when(two_days & ~S.isclose_zero(slope), (F.lit(threshold) - intercept) / slope),
    )


def spline_crossing(df: DataFrame, name: str) -> DataFrame:
    """The smoothing-spline crossing needs SciPy; without it the feature is NULL."""
    return df if name in df.columns else df.withColumn(name, F.lit(None).cast("double"))


def ffill(df: DataFrame, col: str, key: Sequence[str] = TRAJECTORY) -> DataFrame:
    """Last value seen so far."""
    w = _ordered(key).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(col, F.last(col, ignorenulls=True).over(w))


def days_to_crossing(df: DataFrame) -> DataFrame:
    """Days from the prediction to the crossing, spline first, line otherwise."""
    return df.withColumns(
        {
            f"days_to_rolling_crossing_{tag}": F.coalesce(
                f"rolling_spline_crossing_{tag}", f"rolling_linear_crossing_{tag}"
            )
            - F.col("prediction_day_of_year")
            for tag, _ in CROSSINGS
        }
    )


def termination_features(df: DataFrame, key: Sequence[str] = TRAJECTORY) -> DataFrame:
    """All calibrator inputs of a trajectory frame."""
    out = add_recent(add_slopes(add_lags(trajectory_signal(df), key)), key)
    for tag, threshold in CROSSINGS:
        out = linear_crossing(out, threshold, f"rolling_linear_crossing_{tag}", key)
        out = spline_crossing(out, f"rolling_spline_crossing_{tag}")
        out = ffill(out, f"rolling_spline_crossing_{tag}", key)
    return days_to_crossing(out)


# ---------------------------------------------------------------- lock


def adjust_score(df: DataFrame, threshold: float = 4.5) -> DataFrame:
    """Learned days shifted down by the threshold and floored at zero."""
    return df.withColumns(
        {
            "termination_rule": F.lit(RULE_NAME),
            "termination_threshold": F.lit(float(threshold)),
            "termination_adjusted_days_remaining": S.floor_at_zero(
                F.col("learned_days_remaining") - float(threshold)
            ),
        }
    )


def termination_score(df: DataFrame, model, threshold: float = 4.5) -> DataFrame:
    """Score trajectory features with a fitted calibrator and adjust by the threshold."""
    return adjust_score(model.transform(df, "learned_days_remaining"), threshold)


def history_days(df: DataFrame, min_history: int = 7, key: Sequence[str] = TRAJECTORY) -> DataFrame:
    """Rank of the prediction date in its trajectory; eligible beyond the minimum history."""
    if isinstance(min_history, bool) or not isinstance(min_history, int) or min_history < 0:
        raise ValueError("min_history must be a non-negative int")
    return df.withColumn(
        "termination_history_days", F.dense_rank().over(_ordered(key))
    ).withColumn(
        "termination_output_applied", F.col("termination_history_days") > F.lit(min_history)
    )


def first_hit_lock(
    df: DataFrame, min_history: int = 7, key: Sequence[str] = TRAJECTORY
) -> DataFrame:
    """Lock a trajectory at zero from its first eligible day with nothing left."""
    ranked = history_days(df, min_history, key)
    group = Window.partitionBy(*key).orderBy("prediction_date").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    hit = F.coalesce(
        F.col("termination_output_applied")
        & (F.col("termination_adjusted_days_remaining") <= 0.0),
        F.lit(False),
    )
    numbered = ranked.withColumns({"_hit": hit, "_rn": F.row_number().over(_ordered(key))})
    decided = numbered.withColumns(
        {
            "_at": F.min(F.when(F.col("_hit"), F.col("prediction_date"))).over(group),
            "_first": F.min(F.when(F.col("_hit"), F.col("_rn"))).over(group),
        }
    )
    locked = F.coalesce(F.col("prediction_date") >= F.col("_at"), F.lit(False))
    return decided.withColumns(
        {
            "termination_reached": locked,
            "termination_first_hit": F.coalesce(F.col("_rn") == F.col("_first"), F.lit(False)),
            "termination_decision_date": F.when(locked, F.col("_at")),
            "termination_adjusted_days_remaining": F.when(locked, F.lit(0.0)).otherwise(
                F.col("termination_adjusted_days_remaining")
            ),
        }
    ).drop("_hit", "_rn", "_at", "_first")


def estimated_date(df: DataFrame) -> DataFrame:
    """Decision date once locked, otherwise prediction date plus the adjusted days."""
    ahead = S.plus_days(F.col("prediction_date"), F.col("termination_adjusted_days_remaining"))
    return df.withColumn(
        "termination_estimated_stage_date",
        F.coalesce(F.col("termination_decision_date").cast("timestamp_ntz"), ahead),
    )


def overwrite_business(df: DataFrame) -> DataFrame:
    """Adjusted output where the lock applies; the base output is kept aside."""
    out = df
    for base, col in (
        ("base_predicted_days", "predicted_days"),
        ("base_predicted_stage_date", "predicted_stage_date"),
    ):
        if base not in out.columns:
            out = out.withColumn(base, F.col(col))
    use = (
        F.col("termination_adjusted_days_remaining").isNotNull()
        & F.col("termination_output_applied")
    )
    return out.withColumns(
        {
            "predicted_days": F.when(
                use, F.col("termination_adjusted_days_remaining")
            ).otherwise(F.col("predicted_days")),
            "predicted_stage_date": F.when(
                use, F.to_date("termination_estimated_stage_date")
            ).otherwise(F.to_date("predicted_stage_date")),
        }
    )


def lock_trajectories(
    scored: DataFrame,
    cfg: Settings = Settings(),
    key: Sequence[str] = TRAJECTORY,
    overwrite: bool = True,
) -> DataFrame:
    """From learned days to the business output: adjust, lock, date, overwrite."""
    out = adjust_score(scored, cfg.termination_threshold)
    out = estimated_date(first_hit_lock(out, cfg.min_history_days, key))
    return overwrite_business(out) if overwrite else out


def apply_termination(
    df: DataFrame,
    model,
    cfg: Settings = Settings(),
    key: Sequence[str] = TRAJECTORY,
    overwrite: bool = True,
) -> DataFrame:
    """Trajectory features, calibrator score and lock, keeping the input columns."""
    features = termination_features(df, key)
    scored = model.transform(features, "learned_days_remaining")
    locked = lock_trajectories(scored, cfg, key, overwrite)
    added = [c for c in locked.columns if c not in features.columns]
    return locked.select(*df.columns, *added)


# ---------------------------------------------------------------- simple locks


def zero_day_lock(
    df: DataFrame,
    threshold: float = 1.0,
    days: int = 2,
    key: Sequence[str] = ("location_id", "stage_id", "stage_date"),
    fill_termination: bool = False,
) -> DataFrame:
    """Lock at zero from the start of the first run of ``days`` near-zero predictions."""
    if days < 2:
        raise ValueError("days must be at least 2")
    ordered = _ordered(key)
    near = F.coalesce(F.col("predicted_days") <= threshold, F.lit(False)).cast("int")
    run = F.col("_near") == 1
    marked = df.withColumn("_near", near)
    for step in range(1, days):
        run = run & (F.coalesce(F.lead("_near", step).over(ordered), F.lit(0)) == 1)
    group = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    started = marked.withColumn("_run", run).withColumn(
        "_at", F.min(F.when(F.col("_run"), F.col("prediction_date"))).over(group)
    )
    locked = F.coalesce(F.col("prediction_date") >= F.col("_at"), F.lit(False))
    changed = {
        "predicted_days": F.when(locked, F.lit(0.0)).otherwise(F.col("predicted_days")),
        "predicted_stage_date": F.when(locked, F.to_date("_at")).otherwise(
            F.to_date("predicted_stage_date")
        ),
    }
    if fill_termination:
        at = F.when(locked, F.col("_at"))
        changed |= {
            "termination_reached": locked,
            "termination_decision_date": at,
            "termination_estimated_stage_date": at,
        }
    return started.withColumns(changed).drop("_near", "_run", "_at")


def zero_lock_starts(
    df: DataFrame,
    thresholds: Sequence[float],
    days: int = 2,
    key: Sequence[str] = ("location_id", "stage_id", "stage_date"),
    name: str = "lock_starts",
) -> DataFrame:
    """The date from which ``zero_day_lock`` holds, for every threshold, as one array per row.

    A run of ``days`` rows lies at or below a threshold if its greatest value does, so
    one window over the next rows and one over the trajectory serve all thresholds.
    """
    if days < 2:
        raise ValueError("days must be at least 2")
    ordered = _ordered(key)
    ahead = ordered.rowsBetween(0, days - 1)
    group = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # a NULL never counts as near zero
    worst = F.max(F.coalesce("predicted_days", F.lit(float("inf")))).over(ahead)
    whole = F.count(F.lit(1)).over(ahead) == days
    marked = df.withColumn("_worst", F.when(whole, worst))
    starts = [
        F.min(F.when(F.col("_worst") <= float(v), F.col("prediction_date"))).over(group) for v in thresholds
    ]
    return marked.withColumn(name, F.array(*starts)).drop("_worst")


def lock_sweep(
    df: DataFrame,
    thresholds: Sequence[float],
    days: int = 2,
    key: Sequence[str] = ("location_id", "stage_id", "stage_date"),
) -> DataFrame:
    """(zero_threshold, n_rows, post_event_positive_rate) of ``zero_day_lock`` at each threshold, from one scan."""
    started = zero_lock_starts(df, thresholds, days, key)
    late = F.col("prediction_date") > F.col("actual_stage_date")
    rates = []
    for i in range(len(thresholds)):
        locked = F.coalesce(F.col("prediction_date") >= F.get("lock_starts", F.lit(i)), F.lit(False))
        left = F.when(locked, F.lit(0.0)).otherwise(F.col("predicted_days"))
        rates.append(F.avg(((left > 0) & late).cast("int")).alias(f"_r{i}"))
    row = started.agg(F.count(F.lit(1)).alias("n_rows"), *rates)
    pairs = [
        F.struct(F.lit(float(v)).alias("zero_threshold"), F.col(f"_r{i}").alias("post_event_positive_rate"))
        for i, v in enumerate(thresholds)
    ]
    return row.select(F.explode(F.array(*pairs)).alias("_p"), "n_rows").select("_p.*", "n_rows")


def raw_zero_lock(df: DataFrame, key: Sequence[str] = TRAJECTORY) -> DataFrame:
    """Baseline: reached from the first raw value at or below zero; values stay as they are."""
    group = _ordered(key).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first: Column = F.min(
        F.when(F.col("raw_signed_days") <= 0, F.col("prediction_date"))
    ).over(group)
    return df.withColumn("_at", first).withColumns(
        {
            "termination_reached": F.coalesce(
                F.col("prediction_date") >= F.col("_at"), F.lit(False)
            ),
            "termination_decision_date": F.when(
                F.col("prediction_date") >= F.col("_at"), F.col("_at")
            ),
        }
    ).drop("_at")
