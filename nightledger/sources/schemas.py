"""Schemas of the hotel tables and of the event payloads."""

from __future__ import annotations

TABLES: dict[str, str] = {
    "hotels": (
        "hotel_id STRING, hotel_name STRING, city STRING, country STRING, star_rating INT,"
        " total_rooms INT, segment STRING, currency STRING, latitude DOUBLE, longitude DOUBLE,"
        " is_active BOOLEAN"
    ),
    "rooms": (
        "room_id STRING, hotel_id STRING, room_type STRING, capacity INT, room_count INT,"
        " base_price DECIMAL(12,2), floor_price DECIMAL(12,2), ceiling_price DECIMAL(12,2)"
    ),
    "bookings": (
        "event_id STRING, hotel_id STRING, room_type STRING, booking_date DATE,"
        " check_in_date DATE, check_out_date DATE, booking_count INT, cancellation_count INT,"
        " revenue DECIMAL(12,2), adr DECIMAL(12,2), lead_time_days INT, channel STRING"
    ),
    "competitor_prices": (
        "event_id STRING, hotel_id STRING, room_type STRING, competitor STRING,"
        " check_in_date DATE, price DECIMAL(12,2), currency STRING, is_available BOOLEAN,"
        " source STRING, collected_at TIMESTAMP"
    ),
    "demand_signals": (
        "hotel_id STRING, room_type STRING, stay_date DATE, search_demand DOUBLE,"
        " weather_score DOUBLE, local_event_score DOUBLE"
    ),
}

REQUIRED: dict[str, tuple[str, ...]] = {
    "hotels": ("hotel_id", "hotel_name", "city", "star_rating", "total_rooms"),
    "rooms": ("hotel_id", "room_type", "room_count", "base_price"),
    "bookings": (
        "hotel_id",
        "room_type",
        "booking_date",
        "check_in_date",
        "check_out_date",
        "booking_count",
    ),
    "competitor_prices": (
        "hotel_id",
        "room_type",
        "competitor",
        "check_in_date",
        "price",
        "collected_at",
    ),
    "demand_signals": ("hotel_id", "room_type", "stay_date", "search_demand"),
}

# Parents before children.
LOAD_ORDER = ("hotels", "rooms", "bookings", "competitor_prices", "demand_signals")
