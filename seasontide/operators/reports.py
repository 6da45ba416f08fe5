"""Comparison tables of finished evaluations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seasontide.functions import scalars as S
from seasontide.functions.ordering import number_rows
from seasontide.functions.quantiles import with_percentiles
from seasontide.operators.evaluation import day_percentile, pivot_versions


def band_daily(detail: DataFrame) -> DataFrame:
    """Daily means and medians per latitude band, and the day-over-day change.

    The change is a window over one row per band and day.
    """
    keys = ["lat_band", "prediction_date"]
    ahead = F.datediff("predicted_stage_date", "prediction_date")
    daily = detail.groupBy(*keys).agg(
        F.avg("predicted_days").alias("mean_predicted_days"),
        F.avg("raw_signed_days").alias("mean_raw_signed_days"),
        F.avg(ahead).alias("mean_predicted_stage_day"),
        F.countDistinct("place_id").alias("n_places"),
    )
    daily = with_percentiles(
        daily, detail, keys, {"median_predicted_days": ("predicted_days", 0.5)}
    )
    w = Window.partitionBy("lat_band").orderBy("prediction_date")
    return daily.withColumn(
        "predicted_days_diff",
        F.col("mean_predicted_days") - F.lag("mean_predicted_days").over(w),
    )


def band_metrics(daily: DataFrame, start: str, end: str) -> DataFrame:
    """Per band: largest rise inside a date range, net drift, number of rising days."""
    w = Window.partitionBy("lat_band").orderBy("prediction_date")
    inside = F.col("prediction_date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    mean, stage_day = F.col("mean_predicted_days"), F.col("mean_predicted_stage_day")
    rise = F.when(
        F.col("_in") & F.lag("_in").over(w), mean - F.lag("mean_predicted_days").over(w)
    )
    marked = daily.withColumn("_in", inside).withColumn("_rise", rise)
    date = F.col("prediction_date")
    return marked.groupBy("lat_band").agg(
        F.greatest(F.coalesce(F.max("_rise"), F.lit(0.0)), F.lit(0.0)).alias("max_upward_swing"),
        (F.max_by(stage_day, date) - F.min_by(stage_day, date)).alias("net_drift_days"),
        F.count_if(F.col("predicted_days_diff") > 0).alias("positive_jump_days"),
        F.min_by(mean, date).alias("start_mean_predicted_days"),
        F.max_by(mean, date).alias("end_mean_predicted_days"),
        F.max_by(F.col("n_places"), date).alias("n_places_end"),
    )


def doy_comparison(frames: dict[str, DataFrame]) -> DataFrame:
    """Evaluations of several versions stacked, with predicted and actual days of year."""
    out = None
    for version, df in frames.items():
        tagged = df.withColumn("model_version", F.lit(version))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    predicted, actual = F.dayofyear("predicted_stage_date"), F.dayofyear("actual_stage_date")
    return out.withColumns(
        {"predicted_doy": predicted, "actual_doy": actual, "doy_error": predicted - actual}
    ).dropna(subset=["stage_id", "prediction_year", "predicted_doy", "actual_doy"])


def ols_band(
    df: DataFrame, x: str, y: str, grid: Sequence[float], keys: Sequence[str] = (), z: float = 1.96
) -> DataFrame:
    """Fitted line with a z-based mean band on a grid; groups too small or flat are absent.

    The fit is one row of sums per key; the grid is exploded from that row.
    """
    xs, ys = F.col(x).cast("double"), F.col(y).cast("double")
    fit = df.groupBy(*keys).agg(
        F.regr_count(ys, xs).alias("n"),
        F.regr_slope(ys, xs).alias("slope"),
        F.regr_intercept(ys, xs).alias("intercept"),
        F.regr_avgx(ys, xs).alias("_mean"),
        F.regr_sxx(ys, xs).alias("_sxx"),
        F.regr_syy(ys, xs).alias("_syy"),
        F.regr_sxy(ys, xs).alias("_sxy"),
    )
    ok = fit.where((F.col("n") >= 3) & (F.col("_sxx") > 0))
    residual = F.greatest(
        F.col("_syy") - F.col("_sxy") * F.col("_sxy") / F.col("_sxx"), F.lit(0.0)
    )
    at = ok.withColumn("_mse", residual / (F.col("n") - 2)).withColumn(
        "x", F.explode(F.array(*[F.lit(float(g)) for g in grid]))
    )
    offset = F.col("x") - F.col("_mean")
    half = z * F.sqrt(F.col("_mse") * (1 / F.col("n") + offset * offset / F.col("_sxx")))
    line = F.col("intercept") + F.col("slope") * F.col("x")
    return at.select(
        *keys, "x", line.alias("y_fit"), (line - half).alias("y_low"), (line + half).alias("y_high")
    )


def trajectory_manifest(diagnostics: DataFrame, versions: Sequence[str]) -> DataFrame:
    """One row per trajectory with per-version statistics and a dense id.

    One aggregate covers all versions; the id is numbered by a distributed sort.
    """
    keys = ["test_year", "location_id", "stage_id"]

    def stats(v: str) -> list[Column]:
        here = F.col("model_version") == v

        def only(c: str) -> Column:
            return F.when(here, F.col(c))

        return [
            F.count_if(here).alias(f"{v}_n_points"),
            F.count_if(here & F.col("bounce_up")).alias(f"{v}_bounce_up_count"),
            F.avg(only("abs_stage_date_error_days")).alias(f"{v}_mae_stage_date_error"),
            day_percentile(only("abs_stage_date_error_days"), 0.5).alias(f"{v}_median_abs_error"),
            F.avg(only("abs_predicted_stage_date_drift_days")).alias(f"{v}_mean_abs_drift_days"),
            F.min(only("prediction_date")).alias(f"{v}_first_prediction_date"),
            F.max(only("prediction_date")).alias(f"{v}_last_prediction_date"),
        ]

    rows = diagnostics.groupBy(*keys).agg(
        F.min("actual_stage_date").alias("actual_stage_date"),
        F.array_join(F.array_sort(F.collect_set("model_version")), ",").alias("model_versions"),
        F.count(F.lit(1)).alias("n_rows"),
        *[c for v in versions for c in stats(v)],
    )
    return number_rows(rows, keys, "trajectory_id")


def top_improvements(
    diagnostics: DataFrame, n: int, a: str, b: str
) -> DataFrame:
    """Trajectories whose mean absolute error fell most from version a to version b."""
    keys = ["test_year", "location_id", "stage_id"]
    wide = pivot_versions(diagnostics, keys, [a, b], ["abs_stage_date_error_days"], F.avg)
    first, second = f"abs_stage_date_error_days_{a}", f"abs_stage_date_error_days_{b}"
    return (
        wide.select(*keys, F.col(first).alias("mae_a"), F.col(second).alias("mae_b"))
        .withColumn("improvement", F.col("mae_a") - F.col("mae_b"))
        .where("improvement IS NOT NULL")
        .orderBy(F.desc("improvement"), *keys)
        .limit(n)
    )


def equal_width_bins(df: DataFrame, col: str, value: str, versions: Sequence[str], k: int = 5):
    """Mean value per equal-width, right-closed bin and version; the lowest edge is widened by 0.1 %.

    The range is one row, read as a scalar subquery; edges with a value on them
    follow the closed right side.
    """
    known = df.dropna(subset=[col, value])
    low = known.agg(F.min(col).cast("double")).scalar()
    width = known.agg((F.max(col) - F.min(col)).cast("double")).scalar()
    placed = F.ceil((F.col(col) - F.col("_low")) / F.nullif(F.col("_width") / k, F.lit(0.0)))
    bins = (
        known.withColumns({"_low": low, "_width": width})
        .withColumn("bin", F.greatest(F.least(F.coalesce(placed, F.lit(1)), F.lit(k)), F.lit(1)))
        .withColumn("bin", F.col("bin").cast("int"))
        .withColumns(
            {
                "bin_low": F.col("_low")
                + (F.col("bin") - 1) * F.col("_width") / k
                - F.when(F.col("bin") == 1, F.col("_width") * 0.001).otherwise(0.0),
                "bin_high": F.col("_low") + F.col("bin") * F.col("_width") / k,
            }
        )
    )
    return bins.groupBy("bin", "bin_low", "bin_high").agg(
        *[
            F.coalesce(
                F.avg(F.when(F.col("model_version") == v, F.col(value))), F.lit(0.0)
            ).alias(f"mean_{v}")
            for v in versions
        ]
    )


def summary_means(
    summary: DataFrame, by: str, metrics: Sequence[str], a: str, b: str
) -> DataFrame:
    """Mean of summary metrics per stage or year, versions side by side, and a - b."""
    wide = pivot_versions(summary, [by], [a, b], metrics, F.avg)
    return wide.withColumns(
        {f"{m}_improvement": F.col(f"{m}_{a}") - F.col(f"{m}_{b}") for m in metrics}
    ).drop(f"_n_{a}", f"_n_{b}")


def policy_comparison(events: DataFrame, method: str = "method") -> DataFrame:
    """Reached rate, MAE and RMSE of the decision per method; unreached errors are ignored."""
    return events.groupBy(method).agg(
        S.rate(F.col("termination_reached")).alias("reached_rate"),
        F.avg("abs_decision_error_days").alias("decision_mae"),
        S.rms(F.col("decision_error_days")).alias("decision_rmse"),
    )


# Label and column of each executive metric.
EXECUTIVE_METRICS = (
    ("MAE", "mae_stage_date_error"),
    ("RMSE", "rmse_stage_date_error"),
    ("P90 abs error", "p90_abs_stage_date_error"),
    ("Within 3d rate", "within_3d_rate"),
    ("Within 5d rate", "within_5d_rate"),
    ("Post-event positive rate", "post_event_positive_rate"),
    ("Termination active row rate", "termination_reached_rate"),
)


def metric_table(
    overall: DataFrame, a: str, b: str, events: DataFrame | None = None
) -> DataFrame:
    """One row per metric with both versions and the difference."""
    labels = F.create_map(*[F.lit(x) for label, c in EXECUTIVE_METRICS for x in (c, label)])
    columns = [c for _, c in EXECUTIVE_METRICS]
    typed = overall.select("model_version", *[F.col(c).cast("double").alias(c) for c in columns])
    rows = typed.unpivot("model_version", columns, "_col", "value").withColumn(
        "metric", F.element_at(labels, F.col("_col"))
    )
    rows = rows.select("metric", "model_version", "value")
    if events is not None:
        rate = events.groupBy("model_version").agg(
            S.rate(F.col("termination_reached")).alias("value")
        )
        rows = rows.unionByName(
            rate.withColumn("metric", F.lit("Termination reached trajectory rate"))
        )

    def pick(v: str) -> Column:
        return F.max(F.when(F.col("model_version") == v, F.col("value")))

    return (
        rows.groupBy("metric")
        .agg(pick(a).alias("value_a"), pick(b).alias("value_b"))
        .withColumn("delta", F.col("value_b") - F.col("value_a"))
    )


def latest_pivot(df: DataFrame, stages: Sequence[int], keys: Sequence[str]) -> DataFrame:
    """Predicted dates of the latest prediction day, one column per stage."""
    latest = df.agg(F.max("prediction_date")).scalar()
    return (
        df.where(F.col("prediction_date") == latest)
        .groupBy(*keys)
        .agg(
            *[
                F.min(F.when(F.col("stage_id") == s, F.col("predicted_stage_date"))).alias(
                    f"stage_{s}"
                )
                for s in stages
            ]
        )
    )


def locations_per_year(events: DataFrame, stage: int, years: Sequence[int], digits: int = 1):
    """Distinct locations per year of one stage: the year's count and sorted lists by id bucket.

    A year may hold any number of locations, so the list is split into
    16**digits buckets; the year count is repeated on each of its rows.
    """
    found = (
        events.where((F.col("stage_id") == stage) & F.col("year").isin(list(years)))
        .select("year", "location_id")
        .distinct()
    )
    lists = found.groupBy(
        "year", F.substring(F.md5("location_id"), 1, digits).alias("bucket")
    ).agg(
        F.count("location_id").alias("_n"),
        F.array_join(F.array_sort(F.collect_list("location_id")), ", ").alias("location_ids"),
    )
    counts = lists.groupBy("year").agg(F.sum("_n").alias("n_locations"))
    return lists.drop("_n").join(counts, "year")


def worst_trajectories(diagnostics: DataFrame, n: int, version: str) -> DataFrame:
    """Trajectories with the most positive predictions after their event."""
    keys = ["test_year", "location_id", "stage_id"]
    return (
        diagnostics.where(F.col("model_version") == version)
        .groupBy(*keys)
        .agg(F.count_if("post_event_positive").alias("n_post_event_positive"))
        .orderBy(F.desc("n_post_event_positive"), *keys)
        .limit(n)
    )


def grid_at_alpha(grid: DataFrame, alpha: float) -> DataFrame:
    """Threshold sweep at one alpha, in threshold order."""
    return grid.where(F.col("ridge_alpha") == alpha).orderBy("theta")


def grid_near_threshold(grid: DataFrame, theta: float) -> DataFrame:
    """Alpha sweep at the threshold nearest to ``theta``, in alpha order."""
    gap = F.abs(F.col("theta") - theta)
    nearest = grid.agg(F.min(gap)).scalar()
    return grid.where(gap == nearest).orderBy("ridge_alpha")


def best_rows(runs: DataFrame, metrics: Sequence[str], n: int = 1) -> DataFrame:
    """Best runs by metrics in order, smaller first."""
    return runs.orderBy(*metrics).limit(n)
