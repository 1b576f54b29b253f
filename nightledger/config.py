"""Constants and tunables.

Everything numeric that a result depends on lives here, so a job is a pure function of
its input tables and one of these frozen configurations.  No environment variables and
no clock reads: "today" is always an ``as_of`` argument.
"""

from __future__ import annotations

from dataclasses import dataclass

# --- closed vocabularies (fixed values) ---------------------------------------------

ROOM_TYPES = ("standard", "deluxe", "premium", "suite")
COMPETITORS = ("booking", "expedia", "agoda", "makemytrip")
SEASONS = ("winter", "summer", "monsoon", "autumn")
SEGMENTS = ("business", "leisure", "mixed")
EVENT_TYPES = ("competitor_price", "booking", "demand_signal", "price_prediction")

GRAIN = ("hotel_id", "room_type", "stay_date")
ROOM_KEY = ("hotel_id", "room_type")

# --- the feature contract (fixed values) ---------------------------------------------

BASE_FEATURES = (
    "occupancy_rate",
    "available_rooms",
    "total_rooms",
    "booking_count",
    "cancellation_count",
    "competitor_rate",
    "competitor_min_rate",
    "competitor_max_rate",
    "competitor_count",
    "days_to_checkin",
    "lead_time",
    "search_demand",
    "historical_demand",
    "current_room_price",
    "is_weekend",
    "day_of_week",
    "holiday_flag",
    "local_event_score",
    "weather_score",
)
SEASON_FEATURES = tuple(f"season_{name}" for name in SEASONS)
DERIVED_FEATURES = (
    "price_to_competitor",
    "competitor_spread",
    "pickup_velocity",
    "occupancy_x_lead",
    "demand_pressure",
    "competitor_missing",
    "holiday_proximity",
)
FEATURES = BASE_FEATURES + SEASON_FEATURES + DERIVED_FEATURES
TARGET = "target_demand"
FEATURE_VERSION = "v1"

# Which side may overwrite which stored column (fixed values).
DERIVED_OWNED = (
    "days_to_checkin",
    "total_rooms",
    "available_rooms",
    "occupancy_rate",
    "booking_count",
    "cancellation_count",
    "lead_time",
    "historical_demand",
    "current_room_price",
    "competitor_rate",
    "competitor_min_rate",
    "competitor_max_rate",
    "competitor_count",
    "target_demand",
    "feature_version",
    "computed_at",
)
SIGNAL_OWNED = (
    "local_event_score",
    "weather_score",
    "search_demand",
    "holiday_flag",
    "holiday_name",
)
CALENDAR_OWNED = ("day_of_week", "is_weekend", "season")


@dataclass(frozen=True)
class FeatureConfig:
    """Snapshot sampling and window lengths of the feature matrix."""

    horizons: tuple[int, ...] = (0, 1, 2, 3, 5, 7, 10, 14, 21, 30, 45, 60)
    horizon_weights: tuple[float, ...] = (
        0.06, 0.09, 0.09, 0.09, 0.10, 0.11, 0.10, 0.10, 0.09, 0.08, 0.05, 0.04,
    )
    horizon_seed: int = 20260824
    pickup_window_days: int = 7
    history_window_days: int = 28
    incomplete_tail_days: int = 1
    max_target: float = 1.5
    default_search: float = 0.0
    default_weather: float = 0.5
    default_event: float = 0.0
    version: str = FEATURE_VERSION
    # The history window ends on the snapshot night itself, so a horizon-0 row sees
    # its own outcome.  True ends the window one day earlier for every row.
    exclude_same_night: bool = False

    def __post_init__(self) -> None:
        if len(self.horizons) != len(self.horizon_weights):
            raise ValueError("every horizon needs exactly one weight")


@dataclass(frozen=True)
class PricingConfig:
    """Adjustment limits, guardrail thresholds and the blend."""

    baseline_demand: float = 0.65
    demand_limit: float = 0.25
    demand_sensitivity: float = 0.60
    occupancy_limit: float = 0.20
    low_occupancy: float = 0.40
    high_occupancy: float = 0.75
    long_lead_days: int = 21
    short_lead_days: int = 5
    competitor_limit: float = 0.15
    competitor_sensitivity: float = 0.50
    season_limit: float = 0.10
    season_factors: tuple[tuple[str, float], ...] = (
        ("winter", 0.06),
        ("autumn", 0.05),
        ("summer", -0.02),
        ("monsoon", -0.08),
    )
    event_limit: float = 0.15
    event_weight: float = 0.9
    event_threshold: float = 0.01
    holiday_effect: float = 0.5
    weekend_effect: float = 0.3
    # guardrails
    sanity_multiple: float = 5.0
    low_occupancy_block: float = 0.40
    daily_change_cap: float = 0.15
    competitor_upper: float = 0.20
    competitor_lower: float = 0.20
    exceptional_demand: float = 0.92
    min_price: float = 2500.0
    max_price: float = 25000.0
    price_rounding: int = 0
    hit_relative_tolerance: float = 1e-9
    hit_absolute_tolerance: float = 0.005
    currency: str = "INR"
    # blend of the two demand estimates
    forecast_weight: float = 0.5
    fallback_confidence: float = 0.25
    fallback_band: float = 0.20
    single_model_cap: float = 0.70
    full_spread: float = 0.5
    full_disagreement: float = 0.35
    noted_disagreement: float = 0.20
    spread_share: float = 0.6
    agreement_share: float = 0.4


@dataclass(frozen=True)
class ForecastConfig:
    """Set-based series forecaster."""

    horizons: tuple[int, ...] = (7, 14, 30)
    min_training_days: int = 90
    min_days_for_yearly: int = 730
    min_days_for_holidays: int = 730
    yearly_prior_scale: float = 10.0
    interval_width: float = 0.80
    capacity_headroom: float = 1.15
    min_capacity: float = 0.1
    backtest_folds: int = 3
    backtest_horizon: int = 30


@dataclass(frozen=True)
class BoostConfig:
    """Gradient-boosted regressor."""

    max_iter: int = 500
    step_size: float = 0.05
    max_depth: int = 4
    min_instances: int = 20
    subsample: float = 0.8
    feature_subset: str = "sqrt"
    validation_fraction: float = 0.15
    validation_tol: float = 1e-4
    seed: int = 42
    min_labelled_rows: int = 500
    test_days: int = 60


@dataclass(frozen=True)
class MonitorConfig:
    """Thresholds of the data and model checks."""

    booking_max_age_days: int = 7
    competitor_staleness_hours: float = 48.0
    competitor_horizon_days: int = 30
    min_competitor_coverage: float = 0.5
    feature_staleness_hours: float = 36.0
    null_share_critical: float = 0.10
    target_ceiling: float = 1.6
    psi_bins: int = 10
    psi_moderate: float = 0.2
    psi_minor: float = 0.10
    psi_floor: float = 1e-4
    min_sample: int = 50
    drift_window_days: int = 30
    seasonal_history_days: int = 730
    health_hours: int = 24
    min_spread: float = 0.02
    sigma: float = 3.0
    outlier_share: float = 0.05
    min_confidence: float = 0.4
    clamped_share: float = 0.50
    pinned_share: float = 0.10
    watched: tuple[str, ...] = (
        "occupancy_rate",
        "competitor_rate",
        "search_demand",
        "historical_demand",
        "current_room_price",
        "lead_time",
        "booking_count",
    )
    required: tuple[str, ...] = (
        "occupancy_rate",
        "competitor_rate",
        "search_demand",
        "historical_demand",
    )


FEATURE_CONFIG = FeatureConfig()
PRICING_CONFIG = PricingConfig()
FORECAST_CONFIG = ForecastConfig()
BOOST_CONFIG = BoostConfig()
MONITOR_CONFIG = MonitorConfig()
