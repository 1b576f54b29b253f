"""Booking pickup rows to grain cells: totals, target and the book at the snapshot.

The horizon of a cell is a function of its key, so "what was on the books when the
snapshot was taken" is a conditional sum evaluated on the raw rows.  One hash aggregate
with map-side combine yields totals, target and the whole booking-curve lookup: no
as-of join, no sort, no running sum, and a night that holds a third of all rows is
folded into one partial row per task before anything is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nightledger.config import FEATURE_CONFIG, GRAIN, ROOM_KEY, FeatureConfig
from nightledger.functions.horizon import with_horizon


def normalise_bookings(raw: DataFrame) -> DataFrame:
    """Typed pickup rows: dates truncated, bad numbers zero, empty rows dropped."""
    numbers = ("booking_count", "cancellation_count", "revenue", "adr")
    return raw.selectExpr(
        "hotel_id",
        "cast(room_type AS STRING) AS room_type",
        "to_date(booking_date) AS booking_date",
        "to_date(check_in_date) AS stay_date",
        "cast(bround(coalesce(try_cast(lead_time_days AS DOUBLE), 0D)) AS BIGINT)"
        " AS lead_time_days",
        *[f"coalesce(try_cast({c} AS DOUBLE), 0D) AS {c}" for c in numbers],
    ).where("booking_count > 0")


def normalise_rooms(raw: DataFrame) -> DataFrame:
    return raw.selectExpr(
        "hotel_id",
        "cast(room_type AS STRING) AS room_type",
        "cast(room_count AS INT) AS room_count",
        "cast(base_price AS DOUBLE) AS base_price",
    )


def grain_cells(
    bookings: DataFrame, config: FeatureConfig = FEATURE_CONFIG, horizon: str | None = None
) -> DataFrame:
    """One row per (hotel, room, night): final totals and the book at the snapshot.

    ``horizon`` replaces the sampled horizon by any SQL expression over the grain
    columns, for instance a number.
    """
    rows = bookings.select(
        *GRAIN, "lead_time_days", "booking_count", "cancellation_count", "adr"
    )
    if horizon is None:
        rows = with_horizon(rows, config)
    else:
        rows = rows.withColumn("days_to_checkin", F.expr(f"cast({horizon} AS INT)"))

    def known(value: str, days_earlier: int = 0) -> Column:
        seen = f"lead_time_days >= days_to_checkin + {days_earlier}"
        return F.expr(f"coalesce(sum(CASE WHEN {seen} THEN {value} END), 0D)")

    return (
        rows.groupBy(*GRAIN)
        .agg(
            F.max("days_to_checkin").alias("days_to_checkin"),
            F.sum("booking_count").alias("gross"),
            F.sum("cancellation_count").alias("cancels"),
            known("booking_count").alias("otb"),
            known("lead_time_days * booking_count").alias("otb_lead"),
            known("adr * booking_count").alias("otb_rate"),
            known("booking_count", config.pickup_window_days).alias("otb_before"),
        )
        .withColumn("net_sold", F.expr("gross - cancels"))
    )


def realised(config: FeatureConfig = FEATURE_CONFIG) -> Column:
    """Net rooms over inventory; overbooking counts up to the cap."""
    return F.expr(f"greatest(0D, least({config.max_target}D, net_sold / room_count))")


def last_complete_night(
    bookings: DataFrame, rooms: DataFrame, config: FeatureConfig = FEATURE_CONFIG
) -> Column:
    """Scalar subquery: the newest night whose booking curve has closed."""
    newest = bookings.join(rooms.select(*ROOM_KEY), list(ROOM_KEY), "left_semi").agg(
        F.date_sub(F.max("stay_date"), config.incomplete_tail_days)
    )
    return newest.scalar()


def skeleton(
    bookings: DataFrame, rooms: DataFrame, config: FeatureConfig = FEATURE_CONFIG
) -> DataFrame:
    """Grain cells of known rooms whose night is complete, with the target."""
    return (
        grain_cells(bookings, config)
        .where(F.col("stay_date") <= last_complete_night(bookings, rooms, config))
        .join(rooms, list(ROOM_KEY))
        .withColumn("target_demand", realised(config))
        .withColumn("snapshot_date", F.date_sub("stay_date", F.col("days_to_checkin")))
    )


def require_rows(frame: DataFrame, message: str) -> DataFrame:
    """Fail early when a step left nothing to work on (looks at one row only)."""
    if frame.isEmpty():
        raise ValueError(message)
    return frame


def book_columns(frame: DataFrame) -> DataFrame:
    """Occupancy, availability, pickup, mean lead and mean rate on the books."""
    return frame.withColumns(
        {
            "total_rooms": F.expr("cast(room_count AS DOUBLE)"),
            "occupancy_rate": F.expr("greatest(0D, least(1D, otb / room_count))"),
            "available_rooms": F.expr("greatest(room_count - otb, 0D)"),
            "booking_count": F.expr("greatest(otb - otb_before, 0D)"),
            "lead_time": F.expr(
                "CASE WHEN otb > 0 THEN otb_lead / otb ELSE cast(days_to_checkin AS DOUBLE) END"
            ),
            "current_room_price": F.expr(
                "CASE WHEN otb > 0 THEN otb_rate / otb ELSE base_price END"
            ),
        }
    )


def booking_curve(bookings: DataFrame) -> DataFrame:
    """The full curve: rooms on the books at every observed lead of every night.

    Rows of the same lead are added up first, so the window sees at most one row per
    day of lead however many bookings a night has.
    """
    daily = bookings.groupBy(*GRAIN, "lead_time_days").agg(
        F.sum("booking_count").alias("booked"),
        F.sum(F.col("adr") * F.col("booking_count")).alias("rate_weighted"),
    )
    upto = (
        Window.partitionBy(*GRAIN)
        .orderBy(F.col("lead_time_days").desc())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return daily.select(
        *GRAIN,
        "lead_time_days",
        F.sum("booked").over(upto).alias("otb_rooms"),
        F.sum(F.col("lead_time_days") * F.col("booked")).over(upto).alias("otb_lead"),
        F.sum("rate_weighted").over(upto).alias("otb_rate"),
    )
