"""Backtest planning, error metrics and trajectory diagnostics.

Medians of whole-day errors use ``percentile``: its buffer is a histogram of day
values, a few hundred entries whatever the group size.  Medians of fractional
values use ``exact_percentiles``, which never holds a group in one task.

Trajectory windows expect one row per prediction date (``collapse_predictions``),
so a window group is one season at most.
"""

from __future__ import annotations

import functools
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from seasontide.functions import scalars as S
from seasontide.functions.checkpoints import reliable
from seasontide.functions.ordering import first_n, join_on, keep_first
from seasontide.functions.quantiles import exact_percentiles, level_percentiles, with_percentiles

TRACK = ("model_version", "test_year", "location_id", "stage_id")
WINDOW = ("event_year", "stage_id", "location_id", "stage_date")
PREDICTION = ("prediction_date", "location_id", "stage_id")


def day_percentile(days: Column, p: float) -> Column:
    """Exact percentile of day values; the buffer holds one entry per distinct value."""
    return F.percentile(days.cast("double"), F.lit(p))


# ---------------------------------------------------------------- planning


def backtest_plan(
    events: DataFrame, years: Sequence[int], stages: Sequence[int], lead: int = 7
) -> DataFrame:
    """One testing date per chosen event, ``lead`` days ahead of it."""
    chosen = events.where(F.col("year").isin(list(years)) & F.col("stage_id").isin(list(stages)))
    testing = F.col("stage_date").cast("timestamp_ntz") - F.expr(f"INTERVAL '{int(lead)}' DAY")
    return chosen.select(
        F.col("location_id").cast("string").alias("location_id"),
        "stage_id",
        "year",
        "stage_date",
        testing.alias("testing_date"),
        F.to_date(testing).alias("testing_date_only"),
        "latitude",
        "longitude",
    )


def locations_by_date(plan: DataFrame, digits: int = 1) -> DataFrame:
    """Sorted distinct locations per testing date, in hashed buckets.

    Duplicates are removed before anything is gathered.  A date may hold any
    number of locations, so each list covers one of 16**digits buckets of the
    location id; raise ``digits`` with the number of locations.
    """
    bucket = F.substring(F.md5(F.col("location_id")), 1, digits)
    return (
        plan.select("testing_date_only", "location_id")
        .distinct()
        .groupBy("testing_date_only", bucket.alias("bucket"))
        .agg(
            F.count("location_id").alias("n_locations"),
            F.array_sort(F.collect_list("location_id")).alias("location_ids"),
        )
    )


def event_windows(events: DataFrame, before: int = 3, after: int = 3) -> DataFrame:
    """One row per day of [-before, +after] around each event, first row per key."""
    if before < 0 or after < 0:
        raise ValueError("window sides must be non-negative")
    day = F.to_date("stage_date")
    year = F.col("year") if "year" in events.columns else F.year("stage_date")
    keyed = events.select(
        year.cast("int").alias("event_year"),
        F.col("location_id").cast("string").alias("location_id"),
        F.col("stage_id").cast("int").alias("stage_id"),
        day.alias("stage_date"),
        "latitude",
        "longitude",
    )
    one = keep_first(keyed, WINDOW, ["latitude", "longitude"])
    days = F.sequence(F.date_sub("stage_date", before), F.date_add("stage_date", after))
    return one.withColumn("prediction_date", F.explode(days)).withColumn(
        "days_from_event", F.datediff("prediction_date", "stage_date")
    )


def season_grid(spark, years: Sequence[int], season: tuple[str, str], step: int) -> DataFrame:
    """Every ``step``-th day of each season."""
    rows = spark.range(1).select(F.explode(F.array(*[F.lit(int(y)) for y in years])).alias("test_year"))

    def day(md: str) -> Column:
        month, dom = (int(x) for x in md.split("-"))
        return F.make_date("test_year", F.lit(month), F.lit(dom))

    days = F.sequence(day(season[0]), day(season[1]), F.expr(f"INTERVAL '{int(step)}' DAY"))
    return rows.withColumn("prediction_date", F.explode(days))


def prediction_schedule(
    actuals: DataFrame,
    years: Sequence[int],
    season: tuple[str, str] = ("03-01", "06-01"),
    step: int = 3,
    with_events: bool = True,
) -> DataFrame:
    """Season grid of each year, plus the actual event days inside the season."""
    grid = season_grid(actuals.sparkSession, years, season, step)
    if not with_events:
        return grid
    day = F.to_date("stage_date")
    inside = F.date_format(day, "MM-dd").between(*season)
    extra = actuals.where(F.col("year").isin(list(years)) & inside).select(
        F.col("year").alias("test_year"), day.alias("prediction_date")
    )
    return grid.unionByName(extra).distinct()


def schedule_summary(schedule: DataFrame, locations: DataFrame) -> DataFrame:
    """Per year: cutoff, first and last date, number of dates and locations."""
    dates = schedule.groupBy("test_year").agg(
        F.count("prediction_date").alias("n_prediction_dates"),
        F.min("prediction_date").alias("first_prediction_date"),
        F.max("prediction_date").alias("last_prediction_date"),
    )
    places = locations.groupBy("test_year").agg(
        F.countDistinct("location_id").alias("n_locations")
    )
    cutoff = F.make_date("test_year", F.lit(1), F.lit(1))
    return dates.join(places, "test_year", "left").select(
        "test_year",
        cutoff.alias("training_cutoff"),
        F.date_sub(cutoff, 1).alias("train_data_through"),
        "n_prediction_dates",
        "first_prediction_date",
        "last_prediction_date",
        F.coalesce("n_locations", F.lit(0)).alias("n_locations"),
    )


def sample_locations(df: DataFrame, most: int | None, seed: int) -> DataFrame:
    """At most ``most`` locations per year, in an order fixed by the seed."""
    places = df.select(F.col("year").alias("test_year"), "location_id").distinct()
    if most is None:
        return places
    order = F.md5(F.concat_ws(":", F.lit(seed) + F.col("test_year"), F.col("location_id")))
    return first_n(places, ["test_year"], [order, "location_id"], most)


# ---------------------------------------------------------------- predictions


def collapse_predictions(df: DataFrame) -> DataFrame:
    """One row per (date, location, stage): median values, first constants, row count.

    One aggregate finds the constants, and the number, least and greatest of the values.
    These settle the median of a key with at most two values, or with equal ones. Only
    where other keys are left are their rows read again, for exact percentiles over value
    counts, as a key may hold any number of copies.
    """
    keys = list(PREDICTION)
    medians = {"predicted_days": ("predicted_days", 0.5)}
    if "raw_signed_days" in df.columns:
        medians["raw_signed_days"] = ("raw_signed_days", 0.5)
    skipped = {*keys, *medians, "predicted_stage_date"}
    constants = [c for c in df.columns if c not in skipped]
    # NaN is no value, as in the percentiles
    value = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in medians}
    bounds = [f(v).alias(f"_{name}_{c}") for c, v in value.items() for name, f in (("lo", F.min), ("hi", F.max), ("n", F.count))]
    summary = reliable(
        df.groupBy(*keys).agg(*[F.min(c).alias(c) for c in constants], F.count(F.lit(1)).alias("n_rows"), *bounds)
    )
    settled = F.lit(True)
    for c in medians:
        settled &= (F.col(f"_n_{c}") <= 2) | (F.col(f"_lo_{c}") == F.col(f"_hi_{c}"))
    plain = summary.where(settled).select(
        *keys, *constants, "n_rows", *[(F.col(f"_lo_{c}") + (F.col(f"_hi_{c}") - F.col(f"_lo_{c}")) * 0.5).alias(c) for c in medians]
    )
    many = summary.where(~settled).select(*keys, *constants, "n_rows")
    if many.isEmpty():
        out = plain
    else:
        wanted = many.select(*[F.col(k).alias(f"_w_{k}") for k in keys])
        same = [F.col(k).eqNullSafe(F.col(f"_w_{k}")) for k in keys]
        out = plain.unionByName(with_percentiles(many, df.join(wanted, same, "left_semi"), keys, medians))
    return out.withColumn(
        "predicted_stage_date",
        S.plus_whole_days(F.to_date("prediction_date"), F.col("predicted_days")),
    )


def event_window_detail(
    windows: DataFrame,
    predictions: DataFrame,
    threshold: float = 0.0,
    near_zero: float | None = None,
) -> DataFrame:
    """Event windows with their predictions (if any), errors and flags."""
    cols = [
        c
        for c in (
            "prediction_year",
            "model_train_cutoff_date",
            "model_train_end_year",
            "raw_signed_days",
            "predicted_days",
            "predicted_stage_date",
        )
        if c in predictions.columns
    ]
    joined = windows.join(predictions.select(*PREDICTION, *cols), list(PREDICTION), "left")
    error = F.datediff("predicted_stage_date", "stage_date")
    near = threshold if near_zero is None else near_zero
    return joined.withColumns(
        {
            "actual_stage_date": F.col("stage_date"),
            "error_days": error,
            "abs_error_days": F.abs(error),
            "terminated": F.coalesce(F.col("predicted_days") <= threshold, F.lit(False)),
            "near_zero": F.coalesce(F.col("predicted_days") <= near, F.lit(False)),
        }
    )


def lead_evaluation(predictions: DataFrame, actuals: DataFrame, lead: int = 7) -> DataFrame:
    """Predictions made exactly ``lead`` days before an actual event, with their error."""
    optional = [c for c in ("location_state", "location_name") if c in actuals.columns]
    actual = keep_first(
        actuals.select(
            "location_id",
            "stage_id",
            F.to_date("stage_date").alias("_day"),
            F.col("stage_date").alias("actual_stage_date"),
            *optional,
        ),
        ["location_id", "stage_id", "_day"],
        ["actual_stage_date", *optional],
    )
    ahead = predictions.withColumn("_day", F.date_add("prediction_date", lead))
    return (
        ahead.join(actual, ["location_id", "stage_id", "_day"])
        .drop("_day")
        .withColumn(
            "error_days",
            S.floor_days(
                F.col("predicted_stage_date").cast("timestamp_ntz"), F.col("actual_stage_date")
            ),
        )
    )


def join_next_actual(predictions: DataFrame, actuals: DataFrame) -> DataFrame:
    """Nearest actual event on or after each prediction, in the same location, stage and season.

    The actual days of a (location, stage, season) form one array of at most 366
    days, so predictions are not multiplied and unmatched ones are kept.
    """
    seasons = (
        actuals.select(
            "location_id",
            "stage_id",
            S.pest_year(F.to_date("stage_date")).alias("_season"),
            F.col("stage_date").cast("timestamp_ntz").alias("stage_date"),
        )
        .distinct()
        .groupBy("location_id", "stage_id", "_season")
        .agg(F.array_sort(F.collect_list("stage_date")).alias("_dates"))
    )
    day = F.col("prediction_date").cast("timestamp_ntz")
    return (
        predictions.withColumn("_season", S.pest_year(F.col("prediction_date")))
        .join(seasons, ["location_id", "stage_id", "_season"], "left")
        .withColumn(
            "actual_stage_date", F.array_min(F.filter("_dates", lambda d: d >= day))
        )
        .withColumn(
            "error_days",
            S.floor_days(F.col("predicted_stage_date"), F.col("actual_stage_date")),
        )
        .drop("_season", "_dates")
    )


def run_summary(log: DataFrame) -> DataFrame:
    return log.groupBy("status").agg(F.count(F.lit(1)).alias("n_runs"))


# ---------------------------------------------------------------- error metrics


def _whole_days(df: DataFrame, column: str = "error_days") -> bool:
    """Whether a column's type holds whole days only, so that a group has a few hundred values at most."""
    return isinstance(df.schema[column].dataType, IntegralType)


def _level_metrics(
    df: DataFrame, keys: Sequence[str], levels: Sequence[Sequence[str]], columns: Sequence[Column],
    wanted: Mapping[str, tuple[Column, float]], flag: str,
) -> DataFrame:
    """Aggregates and exact percentiles of several grouping levels; ``flag`` is the bit mask of keys left out.

    Whole-day values use the built-in percentile, whose buffer is a small histogram.
    Fractional ones are counted once for all levels and never held by one task.
    """
    sets = [[F.col(k) for k in level] for level in levels]
    if _whole_days(df):
        exact = [day_percentile(c, p).alias(name) for name, (c, p) in wanted.items()]
        return df.groupingSets(sets, *keys).agg(F.grouping_id(*keys).alias(flag), *columns, *exact)
    summary = df.groupingSets(sets, *keys).agg(F.grouping_id(*keys).alias(flag), *columns)
    values = df.select(*keys, *[c.alias(f"_v_{name}") for name, (c, _) in wanted.items()])
    found = level_percentiles(values, levels, {name: (f"_v_{name}", p) for name, (_, p) in wanted.items()})
    parts = []
    for level, part in zip(levels, found):
        mask = sum(1 << (len(keys) - 1 - i) for i, k in enumerate(keys) if k not in level)
        absent = {k: F.lit(None).cast(df.schema[k].dataType) for k in keys if k not in level}
        parts.append(part.withColumns({**absent, flag: F.lit(mask).cast("long")}))
    return join_on(summary, functools.reduce(DataFrame.unionByName, parts), [*keys, flag])


def error_summary(
    df: DataFrame, year: str = "prediction_year", stage: str = "stage_id"
) -> DataFrame:
    """Error metrics per (year, stage) and per year, both levels from one pass."""
    error = F.col("error_days")
    columns = [
        F.count(F.lit(1)).alias("n_predictions"),
        F.avg(error).alias("mean_error"),
        F.avg(F.abs(error)).alias("mae_error"),
        S.rate(F.abs(error) <= 3).alias("within_3d"),
        S.rate(F.abs(error) <= 5).alias("within_5d"),
    ]
    wanted = {"median_error": (error, 0.5), "p90_abs_error": (F.abs(error), 0.9)}
    rows = _level_metrics(df, [year, stage], [[year, stage], [year]], columns, wanted, "_level")
    return rows.select(
        year, stage, "n_predictions", "mean_error", "median_error", "mae_error", "within_3d", "within_5d", "p90_abs_error",
        F.when(F.col("_level") == 1, "year").otherwise("year_stage").alias("scope"),
    )


def scope_metrics(df: DataFrame) -> DataFrame:
    """Overall and per-stage metrics of the known errors, in one rollup."""
    error = F.col("error_days")
    columns = [
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs(error)).alias("mae"),
        S.rms(error).alias("rmse"),
        F.avg(error).alias("bias"),
        S.rate(F.abs(error) <= 7).alias("within_7d"),
    ]
    known = df.where(error.isNotNull())
    wanted = {"median_abs_error": (F.abs(error), 0.5)}
    rows = _level_metrics(known, ["stage_id"], [["stage_id"], []], columns, wanted, "_level")
    scope = F.when(F.col("_level") == 1, "overall").otherwise(F.concat(F.lit("stage_id="), F.col("stage_id").cast("string")))
    return rows.select(scope.alias("scope"), "n", "mae", "rmse", "bias", "median_abs_error", "within_7d")


def location_metrics(df: DataFrame) -> DataFrame:
    """Metrics per location, with the mean location MAE of its state.

    The state mean is an aggregate joined back, not a window over a state.
    """
    keys = [
        "year",
        "stage_id",
        "location_id",
        "latitude",
        "longitude",
        "location_state",
        "location_name",
    ]
    error = F.col("error_days")
    known = df.dropna(subset=["error_days", "latitude", "longitude", "location_state", "location_name"])
    columns = [
        F.count(F.lit(1)).alias("n"),
        S.rms(error).alias("rmse"),
        F.avg(F.abs(error)).alias("mae"),
        F.avg(error).alias("bias"),
        S.rate(F.abs(error) <= 7).alias("within_7d"),
    ]
    wanted = {"median_abs_error": (F.abs(error), 0.5)}
    per_location = _level_metrics(known, keys, [keys], columns, wanted, "_level").drop("_level")
    state = ["year", "stage_id", "location_state"]
    per_state = per_location.groupBy(*state).agg(F.avg("mae").alias("mae_state"))
    return per_location.join(per_state, state)


def walk_forward_summary(detail: DataFrame) -> DataFrame:
    """Metrics per (season, stage) with fractional-day errors."""
    error = S.days_between(
        F.col("predicted_stage_date").cast("timestamp_ntz"),
        F.col("actual_stage_date").cast("timestamp_ntz"),
    )
    e = F.col("error_days")
    return (
        detail.withColumn("error_days", error)
        .groupBy("trajectory_year", "stage_id")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg(F.abs(e)).alias("mae"),
            S.rms(e).alias("rmse"),
            F.avg(e).alias("bias"),
        )
    )


def delta_columns(full: str, reduced: str) -> list[Column]:
    """Error metrics of two runs and their difference, from their errors of the same rows."""
    mae = [F.avg(F.abs(c)) for c in (full, reduced)]
    rmse = [S.rms(F.col(c)) for c in (full, reduced)]
    return [
        F.count(reduced).alias("n_matched"),
        mae[0].alias("full_mae_days"),
        mae[1].alias("ablated_mae_days"),
        (mae[1] - mae[0]).alias("delta_mae"),
        rmse[0].alias("full_rmse_days"),
        rmse[1].alias("ablated_rmse_days"),
        (rmse[1] - rmse[0]).alias("delta_rmse"),
    ]


def matched_delta(full: DataFrame, reduced: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Error metrics of two runs over their common keys, and the difference."""
    both = full.select(*keys, F.col("error_days").alias("_f")).join(
        reduced.select(*keys, F.col("error_days").alias("_r")), list(keys)
    )
    return both.agg(*delta_columns("_f", "_r"))


# ---------------------------------------------------------------- event windows


def window_level(detail: DataFrame, threshold: float = 0.0, near_zero: float = 0.0) -> DataFrame:
    """One row per event window; a window holds one row per day of its few days."""
    days, error = F.col("predicted_days"), F.col("abs_error_days")
    return detail.groupBy(*WINDOW).agg(
        F.count(F.lit(1)).alias("n_prediction_rows"),
        F.min(days).alias("min_predicted_days"),
        F.max(F.when(F.col("days_from_event") == 0, days)).alias("day0_predicted_days"),
        day_percentile(error, 0.5).alias("median_abs_error_days"),
        F.avg(error).alias("mean_abs_error_days"),
        day_percentile(error, 0.9).alias("p90_abs_error_days"),
        F.bool_or(F.coalesce(days <= threshold, F.lit(False))).alias("terminated_within_window"),
        F.bool_or(F.coalesce(days <= near_zero, F.lit(False))).alias("near_zero_within_window"),
    )


def event_window_summary(
    detail: DataFrame, threshold: float = 0.0, near_zero: float | None = None
) -> DataFrame:
    """Year and stage summary of the event windows: counts, medians, rates."""
    near = threshold if near_zero is None else near_zero
    windows = window_level(detail, threshold, near)
    keys = ["event_year", "stage_id"]
    summary = windows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_event_windows"),
        F.sum("n_prediction_rows").alias("n_prediction_rows"),
        F.count_if("terminated_within_window").alias("terminated_windows"),
        F.count_if("near_zero_within_window").alias("near_zero_windows"),
        F.avg("mean_abs_error_days").alias("mean_abs_error_days"),
    )
    medians = {
        "median_min_predicted_days": ("min_predicted_days", 0.5),
        "median_day0_predicted_days": ("day0_predicted_days", 0.5),
        "median_abs_error_days": ("median_abs_error_days", 0.5),
        "p90_abs_error_days": ("p90_abs_error_days", 0.5),
    }
    return with_percentiles(summary, windows, keys, medians).withColumns(
        {
            "termination_rate": S.ratio(F.col("terminated_windows"), F.col("n_event_windows")),
            "near_zero_rate": S.ratio(F.col("near_zero_windows"), F.col("n_event_windows")),
            "termination_threshold": F.lit(float(threshold)),
            "near_zero_threshold": F.lit(float(near)),
        }
    )


def non_terminated(detail: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Windows that never reached the threshold, worst error first inside year and stage."""
    return (
        window_level(detail, threshold, threshold)
        .where(~F.col("terminated_within_window"))
        .orderBy("event_year", "stage_id", F.desc("median_abs_error_days"), "location_id")
    )


def focus_summary(detail: DataFrame, focus: Sequence[int] = (-1, 0, 1)) -> DataFrame:
    """One row: size, extremes, medians and termination counts, overall and near the event.

    The medians are scalar subqueries of the one-row summary.
    """
    near = F.col("days_from_event").isin(list(focus))
    hit = F.coalesce(F.col("predicted_days") <= 0, F.lit(False))
    windows = detail.groupBy("event_year", "location_id", "stage_date").agg(
        F.count(F.lit(1)).alias("_n"),
        F.min("predicted_days").alias("_min"),
        F.max("predicted_days").alias("_max"),
        F.bool_or(hit).alias("_hit"),
        F.bool_or(hit & near).alias("_focus_hit"),
    )
    summary = windows.agg(
        F.sum("_n").alias("n_rows"),
        F.countDistinct("location_id").alias("n_locations"),
        F.count(F.lit(1)).alias("n_windows"),
        F.min("_min").alias("min_predicted_days"),
        F.max("_max").alias("max_predicted_days"),
        F.count_if("_hit").alias("terminated_windows"),
        F.count_if("_focus_hit").alias("focus_terminated_windows"),
    )

    def median_error(rows: DataFrame) -> Column:
        return rows.agg(day_percentile(F.col("abs_error_days"), 0.5)).scalar()

    return summary.withColumns(
        {
            "median_window_min": exact_percentiles(windows, [], {"m": ("_min", 0.5)}).scalar(),
            "median_abs_error_days": median_error(detail),
            "focus_median_abs_error_days": median_error(detail.where(near)),
        }
    )


def outlier_summary(detail: DataFrame) -> DataFrame:
    """Per event: extremes, errors, termination, and its best and worst prediction day."""
    keys = ["location_id", "event_year", "stage_date", "latitude", "longitude"]
    error = F.col("abs_error_days")

    def extreme(pick, sign: int, col: str) -> Column:
        order = F.struct(error * sign, F.col("prediction_date"))
        return pick(F.when(error.isNotNull(), F.col(col)), F.when(error.isNotNull(), order))

    return detail.groupBy(*keys).agg(
        F.min("predicted_days").alias("min_predicted_days"),
        F.max("predicted_days").alias("max_predicted_days"),
        day_percentile(error, 0.5).alias("median_abs_error"),
        F.avg(error).alias("mean_abs_error"),
        F.min("predicted_stage_date").alias("first_predicted_stage_date"),
        F.max("predicted_stage_date").alias("last_predicted_stage_date"),
        F.bool_or("terminated").alias("any_terminated"),
        extreme(F.min_by, -1, "prediction_date").alias("worst_prediction_date"),
        F.max(error).alias("worst_abs_error"),
        extreme(F.min_by, 1, "prediction_date").alias("best_prediction_date"),
        F.min(error).alias("best_abs_error"),
    )


# Bin labels of predicted days with their upper edges.
DAY_BINS = (
    ("0", 0.0),
    ("(0,1]", 1.0),
    ("(1,3]", 3.0),
    ("(3,7]", 7.0),
    ("(7,14]", 14.0),
    ("(14,30]", 30.0),
    (">30", None),
)


def day_bin(days: Column) -> Column:
    label = F.lit(None).cast("string")
    for name, edge in reversed(DAY_BINS):
        test = days.isNotNull() if edge is None else days <= edge
        label = F.when(test, name).otherwise(label)
    return label


def bin_heatmap(detail: DataFrame, offsets: Sequence[int]) -> DataFrame:
    """Counts of predicted-day bins by days from the event; every bin has a row."""
    binned = detail.withColumn("predicted_days_bin", day_bin(F.col("predicted_days"))).where(
        F.col("predicted_days_bin").isNotNull() & F.col("days_from_event").isNotNull()
    )
    counts = binned.groupBy("predicted_days_bin").agg(
        *[
            F.count_if(F.col("days_from_event") == d).alias(f"d{d}".replace("-", "m"))
            for d in offsets
        ]
    )
    bins = detail.sparkSession.range(1).select(
        F.explode(F.array(*[F.lit(b) for b, _ in DAY_BINS])).alias("predicted_days_bin")
    )
    return bins.join(counts, "predicted_days_bin", "left").na.fill(0)


# ---------------------------------------------------------------- non-converged windows


def non_converged(detail: DataFrame, events: DataFrame, features: DataFrame) -> DataFrame:
    """Windows that never reached zero, with the location's other years and event-day features.

    History excludes the window's own year: the location's histogram of event
    days (one row per year and day, bounded by the calendar) is joined instead
    of its events.
    """
    key = ["event_year", "location_id", "stage_date"]
    days = F.col("predicted_days")
    open_windows = (
        detail.groupBy(*key)
        .agg(
            F.min(days).alias("min_predicted_days"),
            F.max(days).alias("max_predicted_days"),
            day_percentile(F.col("abs_error_days"), 0.5).alias("median_abs_error"),
            F.avg("abs_error_days").alias("mean_abs_error"),
            F.bool_or(F.coalesce(days <= 0, F.lit(False))).alias("terminated_within_window"),
            F.max(F.when(F.col("days_from_event") == 0, days)).alias("day0_predicted_days"),
        )
        .where(~F.col("terminated_within_window"))
        .withColumn("current_doy", F.dayofyear("stage_date"))
    )
    doys = (
        events.where("stage_id = 1")
        .groupBy(
            "location_id",
            F.year("stage_date").alias("_year"),
            F.dayofyear("stage_date").alias("_doy"),
        )
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    history = (
        open_windows.select(*key)
        .join(doys, "location_id")
        .where(F.col("_year") != F.col("event_year"))
        .groupBy(*key)
        .agg(
            F.sum("_n").alias("history_n"),
            F.array_join(F.array_sort(F.collect_set("_year")).cast("array<string>"), ",").alias(
                "history_years"
            ),
            F.percentile("_doy", F.lit(0.5), F.col("_n")).alias("history_median_doy"),
            F.min("_doy").alias("history_min_doy"),
            F.max("_doy").alias("history_max_doy"),
        )
    )
    day0 = features.select(
        "location_id",
        F.col("date").alias("stage_date"),
        *[
            F.col(c).alias(f"day0_{c}")
            for c in (
                "cumu_gdd_air",
                "rolling_gdd_air",
                "rolling_humidity_mean_pct",
                "cumu_precip_total_mm",
                "latitude",
                "longitude",
            )
        ],
    )
    return (
        open_windows.join(history, key, "left")
        .withColumns(
            {
                "history_n": F.coalesce("history_n", F.lit(0)),
                "history_years": F.coalesce("history_years", F.lit("")),
                "days_earlier_than_history_median": F.col("history_median_doy")
                - F.col("current_doy"),
            }
        )
        .join(day0, ["location_id", "stage_date"], "left")
    )


def root_cause(df: DataFrame) -> DataFrame:
    """First matching rule names the likely cause."""
    early, lat = F.col("days_earlier_than_history_median"), F.col("day0_latitude")
    label = (
        F.when((early >= 14) & (lat <= 39.0), "historically_early_likely_training_coverage_gap")
        .when(
            F.col("min_predicted_days") <= 3,
            "near_convergence_likely_postprocess_or_short_window",
        )
        .when(
            (F.col("day0_cumu_gdd_air") >= 50) & (F.col("day0_predicted_days") >= 7),
            "warm_signal_but_late_prediction_possible_feature_or_generalization_gap",
        )
        .otherwise("requires_manual_review")
    )
    return df.withColumn("root_cause_label", label)


def root_cause_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("root_cause_label").agg(F.count(F.lit(1)).alias("n_windows"))


# ---------------------------------------------------------------- trajectories


def behavior_summary(detail: DataFrame, bounce: float = 1.0) -> DataFrame:
    """Per version: windows, bounce-backs among transitions, positives among post-event rows."""
    key = ["model_version", "location_id", "stage_id", "stage_date"]
    w = Window.partitionBy(*key).orderBy("prediction_date")
    known = detail.dropna(subset=["model_version", "predicted_days"]).withColumn(
        "_next", F.lead("predicted_days").over(w)
    )
    after = F.col("prediction_date") > F.col("stage_date")
    per_window = known.groupBy(*key).agg(
        F.count(F.lit(1)).alias("_rows"),
        F.count("_next").alias("_moves"),
        F.count_if(F.col("_next") - F.col("predicted_days") > bounce).alias("_bounces"),
        F.count_if(after).alias("_after"),
        F.count_if(after & (F.col("predicted_days") > 0)).alias("_positive"),
    )
    return per_window.groupBy("model_version").agg(
        F.count(F.lit(1)).alias("n_event_windows"),
        F.sum("_rows").alias("n_prediction_rows"),
        F.sum("_bounces").alias("bounce_back_count"),
        S.ratio(F.sum("_bounces"), F.sum("_moves")).alias("bounce_back_rate"),
        F.sum("_positive").alias("post_event_positive_count"),
        S.ratio(F.sum("_positive"), F.sum("_after")).alias("post_event_positive_rate"),
    )


def trajectory_diagnostics(detail: DataFrame) -> DataFrame:
    """Day offsets, errors, step changes and flags of each trajectory row."""
    w = Window.partitionBy(*TRACK).orderBy("prediction_date")
    offset = F.datediff("prediction_date", "actual_stage_date")
    error = F.datediff("predicted_stage_date", "actual_stage_date")
    out = detail.withColumns(
        {
            "days_from_event": offset,
            "actual_days_to_event": -offset,
            "stage_date_error_days": error,
            "abs_stage_date_error_days": F.abs(error),
            **{f"within_{k}d": F.coalesce(F.abs(error) <= k, F.lit(False)) for k in (3, 5, 7)},
            "predicted_days_delta": F.col("predicted_days") - F.lag("predicted_days").over(w),
            "predicted_stage_date_delta_days": F.datediff(
                "predicted_stage_date", F.lag("predicted_stage_date").over(w)
            ),
        }
    )
    return out.withColumns(
        {
            "abs_predicted_stage_date_drift_days": F.abs("predicted_stage_date_delta_days"),
            "bounce_up": F.coalesce(F.col("predicted_days_delta") > 0, F.lit(False)),
            "post_event_positive": F.coalesce(
                (F.col("days_from_event") > 0) & (F.col("predicted_days") > 0), F.lit(False)
            ),
        }
    )


def termination_events(detail: DataFrame) -> DataFrame:
    """One row per trajectory: its first reached row, else its last row."""
    reached = F.coalesce(F.col("termination_reached"), F.lit(False))
    row = F.struct(
        "predicted_stage_date", "termination_decision_date", "termination_estimated_stage_date"
    )
    optional = [
        c
        for c in ("location_name", "location_state", "latitude", "longitude")
        if c in detail.columns
    ]
    chosen = detail.groupBy(*TRACK).agg(
        F.min("actual_stage_date").alias("actual_stage_date"),
        F.bool_or(reached).alias("termination_reached"),
        F.min_by(
            F.when(reached, row), F.when(reached, F.col("prediction_date"))
        ).alias("_first"),
        F.max_by(row, "prediction_date").alias("_last"),
        *[F.min(c).alias(c) for c in optional],
    )
    decision = F.when(
        F.col("termination_reached"), F.to_date("_first.termination_decision_date")
    )
    estimate = F.when(
        F.col("termination_reached"), F.to_date("_first.termination_estimated_stage_date")
    ).otherwise(F.to_date("_last.predicted_stage_date"))
    error = F.datediff("termination_decision_date", "actual_stage_date")
    return (
        chosen.withColumns(
            {
                "termination_decision_date": decision,
                "termination_estimated_stage_date": estimate,
            }
        )
        .withColumns(
            {
                "termination_error_days": error,
                "abs_termination_error_days": F.abs(error),
                "termination_early": F.coalesce(error < 0, F.lit(False)),
                "termination_late": F.coalesce(error > 0, F.lit(False)),
                "selection_rule": F.when(
                    F.col("termination_reached"), "first_termination_reached"
                ).otherwise("last_available_prediction_no_termination"),
            }
        )
        .drop("_first", "_last")
    )


def trajectory_summary(
    diagnostics: DataFrame, keys: Sequence[str] = ("model_version", "test_year", "stage_id")
) -> DataFrame:
    """Version, year and stage summary; rates are over all rows."""
    error, size = F.col("stage_date_error_days"), F.col("abs_stage_date_error_days")
    return diagnostics.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_prediction_rows"),
        F.countDistinct("location_id").alias("n_trajectories"),
        F.avg(error).alias("bias_stage_date_error"),
        F.avg(size).alias("mae_stage_date_error"),
        S.rms(error).alias("rmse_stage_date_error"),
        day_percentile(size, 0.5).alias("median_abs_stage_date_error"),
        day_percentile(size, 0.9).alias("p90_abs_stage_date_error"),
        S.rate(F.col("within_3d")).alias("within_3d_rate"),
        S.rate(F.col("within_5d")).alias("within_5d_rate"),
        S.rate(F.col("within_7d")).alias("within_7d_rate"),
        S.rate(F.col("bounce_up")).alias("bounce_up_rate"),
        S.rate(F.col("post_event_positive")).alias("post_event_positive_rate"),
        S.rate(F.col("termination_reached")).alias("termination_reached_rate"),
    )


def zero_day_errors(detail: DataFrame, threshold: float = 0.0) -> DataFrame:
    """First day at or below the threshold against the actual day, per trajectory."""
    zero = F.coalesce(F.col("predicted_days") <= threshold, F.lit(False))
    when = F.when(zero, F.col("prediction_date"))
    optional = [
        c
        for c in ("latitude", "longitude", "location_name", "location_state", "state_code")
        if c in detail.columns
    ]
    firsts = detail.groupBy(*TRACK).agg(
        F.min("actual_stage_date").alias("actual_stage_date"),
        F.min("prediction_date").alias("first_prediction_date"),
        F.max("prediction_date").alias("last_prediction_date"),
        F.count(F.lit(1)).alias("n_prediction_rows"),
        F.bool_or(zero).alias("zero_day_reached"),
        F.min(when).alias("first_zero_prediction_date"),
        F.min_by(F.when(zero, F.struct("predicted_days", "predicted_stage_date")), when).alias(
            "_row"
        ),
        *[F.min(c).alias(c) for c in optional],
    )
    error = F.datediff("first_zero_prediction_date", "actual_stage_date")
    return firsts.withColumns(
        {
            "zero_threshold": F.lit(float(threshold)),
            "first_zero_predicted_days": F.col("_row.predicted_days"),
            "first_zero_predicted_stage_date": F.col("_row.predicted_stage_date"),
            "zero_day_error_days": error,
            "abs_zero_day_error_days": F.abs(error),
            "zero_day_error_direction": F.when(error < 0, "early")
            .when(error > 0, "late")
            .when(error == 0, "exact")
            .otherwise("not_reached"),
        }
    ).drop("_row")


def zero_day_summary(detail: DataFrame) -> DataFrame:
    error, size = F.col("zero_day_error_days"), F.col("abs_zero_day_error_days")
    counted = detail.groupBy("model_version", "test_year", "stage_id").agg(
        F.count(F.lit(1)).alias("n_trajectories"),
        F.count_if("zero_day_reached").alias("zero_day_reached_count"),
        S.rate(F.col("zero_day_reached")).alias("zero_day_reached_rate"),
        F.avg(error).alias("mean_zero_day_error_days"),
        day_percentile(error, 0.5).alias("median_zero_day_error_days"),
        F.avg(size).alias("mean_abs_zero_day_error_days"),
        day_percentile(size, 0.5).alias("median_abs_zero_day_error_days"),
        day_percentile(size, 0.9).alias("p90_abs_zero_day_error_days"),
        F.count_if(error < 0).alias("early_zero_count"),
        F.count_if(error == 0).alias("exact_zero_count"),
        F.count_if(error > 0).alias("late_zero_count"),
    )
    return counted.withColumns(
        {
            f"{k}_zero_rate_among_reached": S.ratio(
                F.col(f"{k}_zero_count"), F.col("zero_day_reached_count")
            )
            for k in ("early", "exact", "late")
        }
    )


# Metrics compared between versions.
ZERO_DAY_METRICS = (
    "zero_day_reached_rate",
    "mean_zero_day_error_days",
    "median_zero_day_error_days",
    "mean_abs_zero_day_error_days",
    "median_abs_zero_day_error_days",
    "p90_abs_zero_day_error_days",
    "early_zero_rate_among_reached",
    "exact_zero_rate_among_reached",
    "late_zero_rate_among_reached",
)


def pivot_versions(
    df: DataFrame, keys: Sequence[str], versions: Sequence[str], metrics: Sequence[str], agg=F.max
) -> DataFrame:
    """One column ``metric_version`` per pair, one row per key."""
    is_version = {v: F.col("model_version") == v for v in versions}
    return df.groupBy(*keys).agg(
        *[
            agg(F.when(is_version[v], F.col(m))).alias(f"{m}_{v}")
            for m in metrics
            for v in versions
        ],
        *[F.count_if(is_version[v]).alias(f"_n_{v}") for v in versions],
    )


def compare_versions(
    summary: DataFrame,
    a: str,
    b: str,
    metrics: Sequence[str] = ZERO_DAY_METRICS,
    keys: Sequence[str] = ("test_year", "stage_id"),
) -> DataFrame:
    """Metrics of both versions side by side and b - a, where both versions exist."""
    wide = pivot_versions(summary, keys, [a, b], metrics)
    return (
        wide.where((F.col(f"_n_{a}") > 0) & (F.col(f"_n_{b}") > 0))
        .withColumns({f"{m}_delta": F.col(f"{m}_{b}") - F.col(f"{m}_{a}") for m in metrics})
        .drop(f"_n_{a}", f"_n_{b}")
    )


