"""Training and prediction frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seasontide.config import TARGET_IDS, Settings
from seasontide.functions import scalars as S
from seasontide.functions.ordering import keep_first

TRAINING_KEYS = ("date", "location_id", "pest_year", "stage_id")


def season_events(events: DataFrame) -> DataFrame:
    """Events keyed for the frames: their season is the calendar year of the event."""
    return events.select(
        F.col("location_id").cast("string").alias("location_id"),
        F.col("year").cast("int").alias("pest_year"),
        F.col("stage_id").cast("int").alias("stage_id"),
        F.col("stage_date").cast("timestamp_ntz").alias("stage_date"),
        "day_of_year",
        F.col("latitude").alias("event_latitude"),
        F.col("longitude").alias("event_longitude"),
    )


def events_by_stage(events: DataFrame, stages: Sequence[int], horizon: int = 0) -> DataFrame:
    """One row per (location, season, stage) with its distinct events in one array.

    The array is bounded by the calendar (366 dates), and copies of an event are
    removed by a partial aggregate before anything is gathered.
    """
    keyed = season_events(events).where(F.col("stage_id").isin(list(stages)))
    distinct = keyed.groupBy("location_id", "pest_year", "stage_id", "stage_date").agg(
        F.min(F.struct("event_latitude", "event_longitude", "day_of_year")).alias("e")
    )
    event = F.struct(
        "stage_date",
        "e.day_of_year",
        "e.event_latitude",
        "e.event_longitude",
        F.date_add(F.to_date("stage_date"), horizon).alias("last_day"),
    )
    return distinct.groupBy("location_id", "pest_year", "stage_id").agg(
        F.collect_list(event).alias("_events")
    )


def _first_event(condition) -> Column:
    """Earliest event of the row's array that meets the condition."""
    return F.array_min(F.filter("_events", condition))


def forward_asof(
    weather: DataFrame, events: DataFrame, stages: Sequence[int] = (1, 2, 3, 4, 5)
) -> DataFrame:
    """Each weather day with the next event of each stage in its location and season.

    The join yields one row per weather day and stage, the size of the result,
    and never one per candidate event; AQE can split a hot location.  The next
    event is picked inside the row.  Days without a later event are dropped.
    """
    day = F.col("date").cast("timestamp_ntz")
    return (
        weather.join(events_by_stage(events, stages), ["location_id", "pest_year"])
        .withColumn("_next", _first_event(lambda e: e["stage_date"] >= day))
        .where("_next IS NOT NULL")
        .select(*weather.columns, "stage_id", "_next.*")
        .drop("last_day")
    )


def coalesce_coords(df: DataFrame) -> DataFrame:
    """Event coordinates replace the weather coordinates."""
    return df.withColumns(
        {"latitude": F.col("event_latitude"), "longitude": F.col("event_longitude")}
    ).drop("event_latitude", "event_longitude")


def training_window(
    df: DataFrame,
    test_date: str,
    years: int | None = 3,
    include_test_date: bool = False,
    legacy_start: str = "2018-03-01",
) -> DataFrame:
    """Rows dated [test - years, test) or ]; without a window, from the legacy start."""
    if years is not None and years <= 0:
        raise ValueError("window years must be positive")
    start = F.lit(legacy_start).cast("date") if years is None else S.years_before(test_date, years)
    test = F.lit(test_date).cast("date")
    before_test = F.col("date") <= test if include_test_date else F.col("date") < test
    return df.where((F.col("date") >= start) & before_test)


def signed_target(df: DataFrame) -> DataFrame:
    """Day-of-year difference to the event, and its non-negative twin."""
    delta = F.col("day_of_year") - F.dayofyear("date")
    return df.withColumns(
        {"signed_days_to_event": delta, "days_to_event": F.greatest(delta, F.lit(0))}
    )


def post_event_rows(weather: DataFrame, events: DataFrame, horizon: int) -> DataFrame:
    """Real weather rows from the event to ``horizon`` days after it, counting down from zero.

    Events are expanded to their own days, so the join is an equi-join on
    (location, season, day).
    """
    if horizon <= 0:
        return weather.withColumns(
            {
                "stage_id": F.lit(0),
                "stage_date": F.lit(None).cast("timestamp_ntz"),
                "day_of_year": F.lit(0),
                "days_to_event": F.lit(0),
                "signed_days_to_event": F.lit(0),
            }
        ).where(F.lit(False))
    at = F.col("stage_date")
    first_day = F.date_add(
        F.to_date(at), F.when(at > F.to_date(at).cast("timestamp_ntz"), 1).otherwise(0)
    )
    last_day = F.date_add(F.to_date(at), horizon)
    days = season_events(events).withColumn("date", F.explode(F.sequence(first_day, last_day)))
    since = S.floor_days(F.col("date"), at)
    counted = days.withColumns(
        {"days_to_event": F.lit(0), "signed_days_to_event": -since}
    )
    one = keep_first(
        counted, TRAINING_KEYS, ["stage_date", "event_latitude", "event_longitude"]
    )
    joined = weather.join(one, ["location_id", "pest_year", "date"])
    return joined.withColumns(
        {
            "latitude": F.coalesce("latitude", "event_latitude"),
            "longitude": F.coalesce("longitude", "event_longitude"),
        }
    ).drop("event_latitude", "event_longitude")


def augment(base: DataFrame, post: DataFrame) -> DataFrame:
    """Union in which a post-event row replaces the base row of the same key."""
    both = base.withColumn("_rank", F.lit(1)).unionByName(
        post.withColumn("_rank", F.lit(0)), allowMissingColumns=True
    )
    return keep_first(both, TRAINING_KEYS, ["_rank", "stage_date"]).drop("_rank")


def label_days(
    weather: DataFrame,
    events: DataFrame,
    horizon: int,
    in_window: Column,
    stages: Sequence[int] = (1, 2, 3, 4, 5),
    flag: str | None = None,
) -> DataFrame:
    """``augment`` of the as-of rows and the post-event rows, in one pass over the weather.

    Per row and stage, an event of the last ``horizon`` days wins over the next
    one, so nothing is joined twice and no shuffle is needed to drop the loser.
    Needs one weather row per (date, location).  ``flag`` names a column that tells
    post-event rows.
    """
    date = F.col("date")
    day = date.cast("timestamp_ntz")
    recent = _first_event(lambda e: (e["stage_date"] <= day) & (date <= e["last_day"]))
    past = F.when(F.lit(horizon > 0), recent)
    ahead = F.when(in_window, _first_event(lambda e: e["stage_date"] >= day))
    kept = [c for c in weather.columns if c not in ("latitude", "longitude")]
    after = F.col("_after")
    signed = F.when(after, -S.floor_days(date, F.col("_e.stage_date"))).otherwise(
        F.col("_e.day_of_year") - F.dayofyear(date)
    )

    def coordinate(name: str) -> Column:
        own, event = F.col(name), F.col(f"_e.event_{name}")
        return F.when(after, F.coalesce(own, event)).otherwise(event).alias(name)

    return (
        weather.join(events_by_stage(events, stages, horizon), ["location_id", "pest_year"])
        .withColumns({"_past": past, "_ahead": ahead})
        .withColumns(
            {"_after": F.col("_past").isNotNull(), "_e": F.coalesce("_past", "_ahead")}
        )
        .where("_e IS NOT NULL")
        .withColumn("_signed", signed)
        .select(
            *kept,
            coordinate("latitude"),
            coordinate("longitude"),
            "stage_id",
            F.col("_e.stage_date").alias("stage_date"),
            F.col("_e.day_of_year").alias("day_of_year"),
            F.col("_signed").alias("signed_days_to_event"),
            F.when(after, 0).otherwise(F.greatest("_signed", F.lit(0))).alias("days_to_event"),
            *([after.alias(flag)] if flag else []),
        )
    )


def training_matrix(
    events: DataFrame,
    weather: DataFrame,
    test_date: str,
    cfg: Settings = Settings(),
    include_test_date: bool = False,
    features: Sequence[str] | None = None,
) -> DataFrame:
    """Labelled daily rows before the test date, without NULL target or features.

    As-of rows respect the training window; post-event rows only its end.
    """
    features = list(features or cfg.features)
    if cfg.window_years is not None and cfg.window_years <= 0:
        raise ValueError("window years must be positive")
    test = F.lit(test_date).cast("date")
    start = (
        F.lit(cfg.legacy_start).cast("date")
        if cfg.window_years is None
        else S.years_before(test_date, cfg.window_years)
    )
    date = F.col("date")
    known = weather.where(date <= test if include_test_date else date < test)
    # one row per day and location, so that no training row comes twice
    order = [c for c in ("place_id", *features) if c in weather.columns]
    known = keep_first(known, ["date", "location_id"], order)
    labelled = label_days(known, events, cfg.post_event_days, date >= start)
    return labelled.dropna(subset=list(dict.fromkeys([cfg.target, *features])))


def fold_matrix(events: DataFrame, weather: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """The labelled rows of all seasons, each with the date of its label, for ``fold_rows``.

    A row takes its label from the events of its own season.  Before January 1 of a
    year either all events of a season are known or none, so the label does not depend
    on the fold, and one stored matrix serves all of them.
    """
    order = [c for c in ("place_id", *cfg.features) if c in weather.columns]
    known = keep_first(weather, ["date", "location_id"], order)
    labelled = label_days(known, events, cfg.post_event_days, F.lit(True), flag="after_event")
    return labelled.dropna(subset=list(dict.fromkeys([cfg.target, *cfg.features])))


def fold_rows(matrix: DataFrame, year: int, cfg: Settings = Settings()) -> DataFrame:
    """``training_matrix`` before January 1 of ``year``, as a filter of ``fold_matrix``.

    Rows and labels lie before the cutoff; as-of rows also within the training window.
    """
    if cfg.window_years is not None and cfg.window_years <= 0:
        raise ValueError("window years must be positive")
    cutoff = F.lit(f"{year}-01-01").cast("date")
    start = (
        F.lit(cfg.legacy_start).cast("date")
        if cfg.window_years is None
        else S.years_before(f"{year}-01-01", cfg.window_years)
    )
    known = (F.col("date") < cutoff) & (F.col("stage_date") < cutoff.cast("timestamp_ntz"))
    return matrix.where(known & (F.col("after_event") | (F.col("date") >= start)))


def training_matrix_local(
    events: DataFrame,
    daily: DataFrame,
    cutoff: str,
    cfg: Settings = Settings(),
    features: Sequence[str] | None = None,
) -> DataFrame:
    """Each event with all days of its calendar year up to the horizon; floored day target."""
    features = list(features or cfg.features)
    start = S.years_before(cutoff, cfg.window_years or 3).cast("timestamp_ntz")
    end = F.lit(cutoff).cast("timestamp_ntz")
    labels = events.where((F.col("stage_date") >= start) & (F.col("stage_date") < end)).select(
        "location_id",
        F.year("stage_date").alias("_year"),
        F.col("stage_id").cast("int").alias("stage_id"),
        "stage_date",
    )
    last = F.date_add(F.to_date("stage_date"), cfg.post_event_days)
    return (
        daily.withColumn("_year", F.year("date"))
        .join(labels, ["location_id", "_year"])
        .where(F.col("date") <= last)
        .withColumn(cfg.target, S.floor_days(F.col("stage_date"), F.col("date")).cast("double"))
        .drop("_year", "stage_date")
        .dropna(subset=list(dict.fromkeys([*features, cfg.target])))
    )


def aligned_window(df: DataFrame, cutoff: str, years: int) -> DataFrame:
    """Built features dated [cutoff - years, cutoff], both ends included."""
    return df.where(
        F.col("date").between(S.years_before(cutoff, years), F.lit(cutoff).cast("date"))
    )


def add_stages(df: DataFrame, ids: Sequence[int] = TARGET_IDS) -> DataFrame:
    """Every row once per target id."""
    return df.withColumn("stage_id", F.explode(F.array(*[F.lit(int(i)) for i in ids])))


def expand_stages(
    df: DataFrame,
    start: str,
    end: str | None = None,
    ids: Sequence[int] = TARGET_IDS,
    features: Sequence[str] | None = None,
) -> DataFrame:
    """Feature rows of a date range, once per target id, with the model and id columns."""
    days = (F.lit(start).cast("date"), F.lit(end or start).cast("date"))
    out = add_stages(df.where(F.col("date").between(*days)), ids)
    if features is None:
        return out
    extra = ("date", "latitude", "longitude", "place_id", "location_id")
    cols = list(dict.fromkeys([*features, *[c for c in extra if c in out.columns]]))
    return out.select(*cols)


def build_trajectory(
    daily: DataFrame,
    events: DataFrame,
    year: int,
    ids: Sequence[int] = TARGET_IDS,
    through: str | None = None,
) -> DataFrame:
    """Season rows of the locations with an event that year, once per target id."""
    first = F.lit(f"{year}-01-01").cast("date")
    last = F.lit(through or f"{year}-06-30").cast("date")
    active = events.where(F.year("stage_date") == year).select("location_id")
    year_end = F.lit(f"{year}-12-31").cast("date")
    season = daily.where(F.col("date").between(first, F.least(last, year_end)))
    return add_stages(season.join(active, "location_id", "left_semi"), ids)


def fold_seasons(
    daily: DataFrame,
    events: DataFrame,
    years: Sequence[int],
    cfg: Settings = Settings(),
) -> DataFrame:
    """The season rows that the folds of ``years`` score, once per target id, with their actual date and cutoff.

    A location takes part in the years in which it has an event; a (year, location,
    target) without one has nothing to compare with and is left out.  All years come
    from one scan and one join.
    """
    start, end = (F.lit(x) for x in cfg.trajectory_season)
    day = F.date_format("date", "MM-dd")
    year = F.year("date")
    season = daily.where(year.isin(list(years)) & (day >= start) & (day <= end)).withColumn("trajectory_year", year)
    actual = (
        events.where(F.col("stage_id").isin(list(cfg.target_ids)))
        .groupBy(F.year("stage_date").alias("trajectory_year"), "location_id", F.col("stage_id").cast("int").alias("stage_id"))
        .agg(F.min("stage_date").alias("actual_stage_date"))
    )
    # at most one row per target id and location, so a hot location of one year meets four rows
    return season.join(actual, ["trajectory_year", "location_id"]).withColumns(
        {
            "model_train_cutoff_date": F.make_date("trajectory_year", F.lit(1), F.lit(1)),
            "model_train_end_year": F.col("trajectory_year") - 1,
        }
    )


def restrict_to_plan(df: DataFrame, plan: DataFrame, day: str = "date") -> DataFrame:
    """Rows whose (day, location) is scheduled; one join for all dates."""
    wanted = plan.select(F.col("prediction_date").alias(day), "location_id")
    return df.join(wanted, [day, "location_id"], "left_semi")


