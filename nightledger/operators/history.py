"""Trailing demand and cancellations as of each snapshot.

Every cell is emitted twice into one window per room: as an observation on its own
night, and as a probe on its snapshot night.  A range frame over calendar days then
answers the probe directly.  That replaces a calendar spine, two history tables and two
left joins with one shuffle on (hotel, room).  The window partition of a room holds at
most two rows per calendar day, because bookings were summed per night beforehand: its
size is bounded by the length of the calendar, not by the number of bookings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nightledger.config import FEATURE_CONFIG, ROOM_KEY, FeatureConfig


def with_history(
    cells: DataFrame, in_frame: Column, config: FeatureConfig = FEATURE_CONFIG
) -> DataFrame:
    """Add ``historical_demand`` and ``cancellation_count`` to the cells in the frame.

    ``cells`` needs the room key, ``stay_date``, ``snapshot_date``, ``realised`` and
    ``cancels``.  All cells count as observations, including the open tail; only cells
    for which ``in_frame`` holds come back.  A window without observations, and a
    snapshot outside a room's observed span, fall back to the room's own mean over the
    frame, then to zero.
    """
    payload = [c for c in cells.columns if c not in ROOM_KEY]
    observation = F.struct(
        F.unix_date("stay_date").alias("day"),
        F.col("realised").alias("seen"),
        F.col("cancels").alias("lost"),
        F.lit(False).alias("probe"),
    )
    probe = F.struct(
        F.unix_date("snapshot_date").alias("day"),
        F.lit(None).cast("double").alias("seen"),
        F.lit(None).cast("double").alias("lost"),
        F.lit(True).alias("probe"),
    )
    events = cells.select(
        *ROOM_KEY,
        F.struct(*payload).alias("cell"),
        F.explode(
            F.when(in_frame, F.array(observation, probe)).otherwise(F.array(observation))
        ).alias("e"),
    ).select(
        *ROOM_KEY,
        "e.day",
        "e.seen",
        "e.lost",
        "e.probe",
        F.when(F.col("e.probe"), F.col("cell")).alias("cell"),
    )

    by_day = Window.partitionBy(*ROOM_KEY).orderBy("day")
    last = -1 if config.exclude_same_night else 0
    trailing = by_day.rangeBetween(last - config.history_window_days + 1, last)
    whole = by_day.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    observed_day = F.when(~F.col("probe"), F.col("day"))
    windowed = events.select(
        "*",
        F.avg("seen").over(trailing).alias("mean_seen"),
        F.sum("lost").over(trailing).alias("sum_lost"),
        F.min(observed_day).over(whole).alias("first_day"),
        F.max(observed_day).over(whole).alias("last_day"),
    ).where("probe")

    inside = F.col("day").between(F.col("first_day"), F.col("last_day"))
    known = windowed.select(
        *ROOM_KEY,
        "cell",
        F.when(inside, F.col("mean_seen")).alias("mean_seen"),
        F.coalesce(F.when(inside, F.col("sum_lost")), F.lit(0.0)).alias("cancellation_count"),
    )
    own_mean = F.avg("mean_seen").over(Window.partitionBy(*ROOM_KEY))
    return known.select(
        *ROOM_KEY,
        "cell.*",
        F.coalesce("mean_seen", own_mean, F.lit(0.0)).alias("historical_demand"),
        "cancellation_count",
    )


def daily_history(cells: DataFrame, config: FeatureConfig = FEATURE_CONFIG) -> DataFrame:
    """Trailing statistics on every calendar day between a room's first and last night."""
    span = cells.groupBy(*ROOM_KEY).agg(
        F.min("stay_date").alias("first_day"), F.max("stay_date").alias("last_day")
    )
    spine = span.select(
        *ROOM_KEY, F.explode(F.sequence("first_day", "last_day")).alias("stay_date")
    )
    trailing = (
        Window.partitionBy(*ROOM_KEY)
        .orderBy(F.unix_date("stay_date"))
        .rangeBetween(1 - config.history_window_days, 0)
    )
    return spine.join(
        cells.select(*ROOM_KEY, "stay_date", "realised", "cancels"),
        [*ROOM_KEY, "stay_date"],
        "left",
    ).select(
        *ROOM_KEY,
        F.col("stay_date").alias("as_of_date"),
        F.avg("realised").over(trailing).alias("demand_history"),
        F.sum("cancels").over(trailing).alias("cancels_history"),
    )
