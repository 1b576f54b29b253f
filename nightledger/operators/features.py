"""Signals, calendar and derived feature columns shared by training and serving."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nightledger.config import FEATURE_CONFIG, FEATURES, GRAIN, SEASONS, FeatureConfig
from nightledger.functions.calendar import city_event_on, season_of
from nightledger.functions.numeric import finite

SIGNALS = ("search_demand", "weather_score", "local_event_score")


def distinct_signals(signals: DataFrame) -> DataFrame:
    """One signal row per night.  The source has no order, so the smallest row wins."""
    present = [c for c in SIGNALS if c in signals.columns]
    return (
        signals.select(*GRAIN, F.struct(*present).alias("s"))
        .groupBy(*GRAIN)
        .agg(F.min("s").alias("s"))
        .select(*GRAIN, "s.*")
    )


def fill_signals(frame: DataFrame, config: FeatureConfig = FEATURE_CONFIG) -> DataFrame:
    """Defaults for nights without signals, and for signal columns that never arrived."""
    defaults = {
        "search_demand": config.default_search,
        "weather_score": config.default_weather,
        "local_event_score": config.default_event,
    }
    return frame.withColumns(
        {
            name: (
                F.coalesce(F.col(name).try_cast("double"), F.lit(value))
                if name in frame.columns
                else F.lit(value)
            )
            for name, value in defaults.items()
        }
    )


def season_flags() -> dict[str, Column]:
    return {
        f"season_{name}": F.expr(f"CASE WHEN season = '{name}' THEN 1D ELSE 0D END")
        for name in SEASONS
    }


def calendar_columns(frame: DataFrame) -> DataFrame:
    """Weekday, weekend, season and holiday flag; needs the holiday columns attached."""
    return frame.withColumns(
        {
            "day_of_week": F.expr("cast(weekday(stay_date) AS DOUBLE)"),
            "is_weekend": F.expr("CASE WHEN weekday(stay_date) >= 5 THEN 1D ELSE 0D END"),
            "holiday_flag": F.expr("CASE WHEN holiday_name IS NOT NULL THEN 1D ELSE 0D END"),
            "season": season_of("stay_date"),
        }
    ).withColumns(season_flags())


def city_event_override(frame: DataFrame) -> DataFrame:
    """Where a row knows its city, the city calendar replaces the signal's event score."""
    on = city_event_on(F.col("city"), F.col("stay_date"))["event_score"]
    score = F.when(F.col("city").isNotNull(), F.coalesce(on, F.lit(0.0)))
    return frame.withColumn("local_event_score", score.otherwise(F.col("local_event_score")))


def derived_columns(frame: DataFrame) -> DataFrame:
    """Ratios and interactions.  The same code runs for training, serving and rebuild.

    The scales are those of the standard configuration whatever horizons a build samples,
    so that a feature means the same in every matrix.
    """
    furthest = float(max(FEATURE_CONFIG.horizons))
    return frame.withColumns(
        {
            "price_to_competitor": F.expr(
                "greatest(0.2D, least(5D,"
                " coalesce(current_room_price / nullif(competitor_rate, 0D), 1D)))"
            ),
            "competitor_spread": F.expr(
                "greatest(0D, least(2D, coalesce((competitor_max_rate - competitor_min_rate)"
                " / nullif(competitor_rate, 0D), 0D)))"
            ),
            "pickup_velocity": F.expr(f"booking_count / {float(FEATURE_CONFIG.pickup_window_days)}D"),
            "occupancy_x_lead": F.expr(
                f"occupancy_rate * (1D - days_to_checkin / {furthest}D)"
            ),
            "demand_pressure": F.expr("search_demand * (1D + local_event_score)"),
        }
    )


def finite_report(matrix: DataFrame) -> DataFrame:
    """Unusable values per feature, in one pass over the matrix."""
    counts = matrix.agg(
        *[F.count_if(~finite(F.col(c).cast("double"))).alias(c) for c in FEATURES]
    )
    return counts.select(
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("bad")) for c in FEATURES])
        ).alias("r")
    ).select("r.feature", F.col("r.bad").alias("unusable_rows"))


def guard_finite(matrix: DataFrame) -> DataFrame:
    """Stop the job at the first row with an unusable feature, without a second pass."""
    bad = F.array_compact(
        F.array(*[F.when(~finite(F.col(c).cast("double")), F.lit(c)) for c in FEATURES])
    )
    verdict = F.when(F.size(bad) == 0, F.lit(True)).otherwise(
        F.raise_error(F.concat(F.lit("unusable feature values: "), F.concat_ws(", ", bad)))
    )
    return matrix.where(verdict)


def ordered_features() -> list[Column]:
    return [F.col(c).cast("double").alias(c) for c in FEATURES]
