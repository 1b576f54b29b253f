"""Hotel views over the supplied star-schema tables.

The supplied tables have no hotels in them, so each hotel table is derived from one of
them by integer arithmetic on its keys.  Everything is a projection (or one aggregate)
over a column-pruned Parquet scan: Spark reads only the columns named here.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FIRST_DAY = date(2025, 1, 1)
LAST_DAY = date(2025, 12, 31)
AS_OF = date(2025, 12, 1)

# Fixed values of the derived hotels.
CITIES = ("Mumbai", "Bengaluru", "New Delhi", "Goa", "Jaipur", "Udaipur")
SEGMENT_CYCLE = ("business", "leisure", "mixed")
ROOM_CYCLE = ("standard", "deluxe", "premium", "suite")
ROOM_COUNTS = (200, 140, 120, 100)
BRAND_CYCLE = ("booking", "expedia", "agoda", "makemytrip")
CHANNEL_CYCLE = ("direct", "ota", "corporate", "walk_in")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# SQL fragments over the raw keys.  One string per column keeps the plan readable and
# costs one call to the JVM instead of one per operator.


def pick(values: tuple, index: str) -> str:
    """Element of a short literal list by position."""
    items = ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values)
    return f"element_at(array({items}), cast({index} + 1 AS INT))"


def hotel_code(index: str) -> str:
    """``H0007``; grows past four digits instead of truncating."""
    text = f"cast({index} AS STRING)"
    return f"concat('H', lpad({text}, greatest(4, length({text})), '0'))"


def base_rate(hotel: str, room: str) -> str:
    return f"cast(3000 + ({hotel} % 8) * 250 + {room} * 1500 AS DOUBLE)"


def folded_day(stamp: str) -> str:
    """A raw date folded into the year the holiday calendar covers."""
    return (
        f"date_add(DATE'{FIRST_DAY}',"
        f" cast(datediff(cast({stamp} AS DATE), DATE'1995-01-01') % 365 AS INT))"
    )


def hotels(spark: SparkSession, folder: str) -> DataFrame:
    index = table(spark, folder, "supplier").selectExpr("s_suppkey div 10 AS idx").distinct()
    return index.selectExpr(
        f"{hotel_code('idx')} AS hotel_id",
        "concat('Hotel ', cast(idx AS STRING)) AS hotel_name",
        f"{pick(CITIES, 'idx % 6')} AS city",
        "'India' AS country",
        "cast(3 + idx % 3 AS INT) AS star_rating",
        f"{sum(ROOM_COUNTS)} AS total_rooms",
        f"{pick(SEGMENT_CYCLE, 'idx % 3')} AS segment",
        "'INR' AS currency",
        "idx % 10 <> 9 AS is_active",
    )


def rooms(spark: SparkSession, folder: str) -> DataFrame:
    index = table(spark, folder, "supplier").selectExpr("s_suppkey div 10 AS idx").distinct()
    base = base_rate("idx", "r")
    return index.selectExpr("idx", "explode(array(0, 1, 2, 3)) AS r").selectExpr(
        f"concat({hotel_code('idx')}, '-', cast(r AS STRING)) AS room_id",
        f"{hotel_code('idx')} AS hotel_id",
        f"{pick(ROOM_CYCLE, 'r')} AS room_type",
        "2 + r AS capacity",
        f"{pick(ROOM_COUNTS, 'r')} AS room_count",
        f"{base} AS base_price",
        f"{base} * 65 / 100 AS floor_price",
        f"{base} * 220 / 100 AS ceiling_price",
    )


def bookings(spark: SparkSession, folder: str) -> DataFrame:
    hotel, room = "(l_suppkey div 10)", "(l_partkey % 4)"
    keyed = table(spark, folder, "lineitem").selectExpr(
        "concat(cast(l_orderkey AS STRING), '-', cast(l_linenumber AS STRING)) AS event_id",
        f"{hotel_code(hotel)} AS hotel_id",
        f"{pick(ROOM_CYCLE, room)} AS room_type",
        f"{folded_day('l_shipdate')} AS check_in_date",
        "cast((l_orderkey * 7 + l_partkey * 3 + l_linenumber) % 91 AS INT) AS lead_time_days",
        "cast(l_quantity AS INT) AS booking_count",
        "cast(CASE WHEN l_returnflag = 'R' THEN cast(l_quantity AS INT) div 5 ELSE 0 END AS INT)"
        " AS cancellation_count",
        f"{base_rate(hotel, room)} * (90 + l_linenumber * 3) / 100 AS adr",
        f"{pick(CHANNEL_CYCLE, 'l_linenumber % 4')} AS channel",
    )
    return keyed.selectExpr(
        "event_id",
        "hotel_id",
        "room_type",
        "date_sub(check_in_date, lead_time_days) AS booking_date",
        "check_in_date",
        "date_add(check_in_date, 1) AS check_out_date",
        "booking_count",
        "cancellation_count",
        "(booking_count - cancellation_count) * adr AS revenue",
        "adr",
        "lead_time_days",
        "channel",
    )


def competitor_prices(spark: SparkSession, folder: str) -> DataFrame:
    hotel, room = "(o_custkey div 150)", "(o_orderkey % 4)"
    keyed = table(spark, folder, "orders").selectExpr(
        "cast(o_orderkey AS STRING) AS event_id",
        f"{hotel_code(hotel)} AS hotel_id",
        f"{pick(ROOM_CYCLE, room)} AS room_type",
        f"{pick(BRAND_CYCLE, '(o_orderkey div 4) % 4')} AS competitor",
        f"{folded_day('o_orderdate')} AS check_in_date",
        f"{base_rate(hotel, room)} * (80 + o_orderkey % 41) / 100 AS price",
        "'INR' AS currency",
        "o_orderstatus <> 'F' AS is_available",
        "CASE WHEN o_orderkey % 3 = 0 THEN 'live' ELSE 'batch' END AS source",
        "cast(o_orderkey % 45 AS INT) AS lead",
    )
    return keyed.selectExpr(
        "event_id",
        "hotel_id",
        "room_type",
        "competitor",
        "check_in_date",
        "price",
        "currency",
        "is_available",
        "source",
        "cast(date_sub(check_in_date, lead) AS TIMESTAMP) AS collected_at",
    )


def demand_signals(spark: SparkSession, folder: str) -> DataFrame:
    return (
        table(spark, folder, "orders")
        .selectExpr(
            f"{hotel_code('(o_custkey div 150)')} AS hotel_id",
            f"{pick(ROOM_CYCLE, 'o_orderkey % 4')} AS room_type",
            f"{folded_day('o_orderdate')} AS stay_date",
            "o_orderkey AS k",
        )
        .groupBy("hotel_id", "room_type", "stay_date")
        .agg(F.count("*").alias("n"), F.sum("k").alias("s"))
        .selectExpr(
            "hotel_id",
            "room_type",
            "stay_date",
            "least(1.0D, n / 4.0D) AS search_demand",
            "(s % 101) / 100.0D AS weather_score",
            "(s % 5) / 10.0D AS local_event_score",
        )
    )
