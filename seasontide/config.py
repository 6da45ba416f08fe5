"""Defaults of every operator, in one frozen dataclass."""

from __future__ import annotations

from dataclasses import dataclass, field

# Stable target ids in output order, and their output names.
TARGET_IDS = (1, 4, 2, 3)
TARGET_NAMES = {1: "Stage 1", 2: "Stage 2", 3: "Stage 3 / Phase 2", 4: "Phase 1"}
OUTPUT_IDS = {1: "stage_1", 4: "phase_1", 2: "stage_2", 3: "stage_3_phase_2"}

# Model inputs, in training order.
MODEL_FEATURES = (
    "stage_id",
    "cumu_gdd_air",
    "rolling_gdd_air",
    "rolling_humidity_mean_pct",
    "cumu_precip_total_mm",
    "doy",
    "cumu_cdd_air",
    "rolling_cdd_air",
    "latitude",
    "longitude",
)

# Latitude bands, lower edge included, upper edge excluded.
LATITUDE_BANDS = (
    (33.0, 35.0, "33-35N"),
    (35.0, 37.0, "35-37N"),
    (37.0, 39.0, "37-39N"),
    (39.0, 40.0, "39-40N"),
    (40.0, 42.0, "40-42N"),
)

SEASON_MEASURES = ("gdd_air", "precip_total_mm", "humidity_mean_pct", "cdd_air")


@dataclass(frozen=True)
class Settings:
    # canonical events
    phase2_as_stage3: bool = True
    observed_phase1: bool = False
    derived_phase1: bool = True
    exclude_placeholders: bool = True
    placeholder_month_day: str = "12-31"
    manual_events: bool = True
    observed_source: str = "observed"
    target_ids: tuple[int, ...] = TARGET_IDS
    # event filters
    season_doy: tuple[int, int] = (60, 152)
    excluded_locations: tuple[str, ...] = ("5",)
    excluded_pairs: tuple[tuple[str, int], ...] = (("85", 2024), ("88", 2023), ("61", 2023))
    # features
    season_start: tuple[int, int] = (3, 1)
    rolling_rows: int = 14
    degree_base_f: float = 50.0
    features: tuple[str, ...] = MODEL_FEATURES
    target: str = "signed_days_to_event"
    # training frame
    window_years: int | None = 3
    legacy_start: str = "2018-03-01"
    post_event_days: int = 10
    min_events_per_target: int = 20
    min_years_per_target: int = 2
    trajectory_season: tuple[str, str] = ("03-01", "06-30")
    # termination
    ridge_alpha: float = 30.0
    calibrator_years: int | None = 3
    termination_threshold: float = 4.5
    min_history_days: int = 7
    zero_lock_threshold: float = 1.0
    zero_lock_days: int = 2
    bounce_back_days: float = 1.0
    # evaluation
    lead_days: int = 7
    window_before: int = 3
    window_after: int = 3
    schedule_step_days: int = 3
    schedule_season: tuple[str, str] = ("03-01", "06-01")
    request_window: tuple[str, str] = ("03-01", "06-01")
    box_degrees: float = 0.5
    # base model; boosted trees by default
    tree_params: dict = field(
        default_factory=lambda: {
            "maxIter": 200,
            "stepSize": 0.05,
            "maxDepth": 6,
            "minInstancesPerNode": 20,
            "subsamplingRate": 0.8,
            "seed": 42,
        }
    )
