"""Integrity rules and request checks as predicates."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# rule name -> what a good row satisfies
RULES: dict[str, dict[str, str]] = {
    "hotels": {
        "star rating 1..5": "star_rating BETWEEN 1 AND 5",
        "rooms above zero": "total_rooms > 0",
    },
    "rooms": {
        "known room type": "room_type IN ('standard', 'deluxe', 'premium', 'suite')",
        "room count above zero": "room_count > 0",
        "base price above zero": "base_price > 0",
        "capacity above zero": "capacity > 0",
        "floor below ceiling": "floor_price IS NULL OR ceiling_price IS NULL OR floor_price < ceiling_price",
    },
    "bookings": {
        "bookings not negative": "booking_count >= 0",
        "cancellations within bookings": "cancellation_count BETWEEN 0 AND booking_count",
        "revenue not negative": "revenue >= 0",
        "adr not negative": "adr >= 0",
        "check-out after check-in": "check_out_date > check_in_date",
        "booked before check-in": "booking_date <= check_in_date",
        "lead not negative": "lead_time_days >= 0",
    },
    "competitor_prices": {
        "known competitor": "competitor IN ('booking', 'expedia', 'agoda', 'makemytrip')",
        "price above zero": "price > 0",
    },
    "demand_features": {
        "weekday 0..6": "day_of_week BETWEEN 0 AND 6",
        "occupancy 0..1": "occupancy_rate BETWEEN 0 AND 1",
        "target not negative": "target_demand >= 0",
        "available not negative": "available_rooms >= 0",
    },
    "predictions": {"confidence 0..1": "confidence BETWEEN 0 AND 1"},
    "pricing_decisions": {
        "positive prices": "base_price > 0 AND raw_recommended_price > 0"
        " AND final_recommended_price > 0"
    },
}


def violations(frame: DataFrame, table: str) -> DataFrame:
    """Rows breaking each rule of a table, in one pass.  Nulls do not break a rule."""
    rules = RULES[table]
    # Rule names hold dots, so the counts get plain names until they are laid out as rows.
    row = frame.agg(
        *[F.expr(f"count_if(NOT ({test}))").alias(f"_{i}") for i, test in enumerate(rules.values())]
    )
    counts = [
        F.struct(F.lit(name).alias("rule"), F.col(f"_{i}").alias("broken_rows"))
        for i, name in enumerate(rules)
    ]
    return row.select(F.explode(F.array(*counts)).alias("r")).select("r.rule", "r.broken_rows")


def first_reason(reasons: list[tuple[str, str]]) -> Column:
    """The first reason whose condition holds, else null."""
    arms = " ".join(f"WHEN {condition} THEN '{reason}'" for reason, condition in reasons)
    return F.expr(f"CASE {arms} END")


def reference_rejects(asked: DataFrame, hotels: DataFrame, rooms: DataFrame) -> DataFrame:
    """Requests naming an unknown hotel, or a room the hotel does not sell."""
    sold = rooms.groupBy("hotel_id").agg(
        F.expr("array_join(array_sort(collect_set(room_type)), ',')").alias("sells")
    )
    known = hotels.select("hotel_id", F.lit(True).alias("_hotel")).distinct()
    offered = rooms.select("hotel_id", "room_type", F.lit(True).alias("_room")).distinct()
    return (
        asked.join(known, "hotel_id", "left")
        .join(offered, ["hotel_id", "room_type"], "left")
        .join(sold, "hotel_id", "left")
        .withColumn(
            "rejected_reason",
            first_reason([("unknown_hotel", "_hotel IS NULL"), ("room_not_sold", "_room IS NULL")]),
        )
        .where("rejected_reason IS NOT NULL")
        .select("hotel_id", "room_type", "rejected_reason", "sells")
    )


def request_rejects(requests: DataFrame, as_of: date, horizon: int = 365) -> DataFrame:
    """Price requests with the first constraint they break, or null."""
    ahead = f"datediff(check_in_date, DATE'{as_of}')"
    price = "NOT ({0} > 0 AND {0} <= 1000000)"
    reasons = [
        ("too_far_ahead", f"{ahead} > {horizon}"),
        ("too_far_back", f"{ahead} < -{horizon}"),
        ("current_price_out_of_range", price.format("current_price")),
        ("competitor_rate_out_of_range", price.format("competitor_rate")),
        ("competitor_min_out_of_range", price.format("competitor_min_rate")),
        ("competitor_max_out_of_range", price.format("competitor_max_rate")),
        ("competitor_band_inverted", "competitor_min_rate > competitor_max_rate"),
        ("occupancy_out_of_range", "NOT (occupancy_rate BETWEEN 0 AND 1)"),
    ]
    return requests.withColumn("rejected_reason", first_reason(reasons))
