"""Feature family: normalisation, booking curve, history, market and the matrix."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nightledger.catalog import Registry
from nightledger.config import FEATURES, GRAIN, TARGET
from nightledger.functions import calendar as C
from nightledger.functions.horizon import with_horizon
from nightledger.functions.numeric import settled
from nightledger.operators import bookings as B
from nightledger.operators import features as X
from nightledger.operators import history as H
from nightledger.operators import market as M
from nightledger.plans import features as P
from nightledger.sources import warehouse as W

QUERIES = Registry()

# Digits at which ratios and money are reported.
DIGITS = dict(
    historical_demand=9,
    lead_time=9,
    current_room_price=6,
    target_demand=9,
    occupancy_rate=9,
    competitor_rate=6,
    price_to_competitor=9,
    competitor_spread=9,
    pickup_velocity=9,
    occupancy_x_lead=9,
    demand_pressure=9,
)


def reported(frame: DataFrame) -> DataFrame:
    return settled(frame, **{c: n for c, n in DIGITS.items() if c in frame.columns})


def booked(spark: SparkSession, folder: str) -> DataFrame:
    return B.normalise_bookings(W.bookings(spark, folder))


def stock(spark: SparkSession, folder: str) -> DataFrame:
    return B.normalise_rooms(W.rooms(spark, folder))


def rates(spark: SparkSession, folder: str) -> DataFrame:
    return M.normalise_rates(W.competitor_prices(spark, folder))


def matrix(spark: SparkSession, folder: str) -> DataFrame:
    return P.feature_matrix(
        W.bookings(spark, folder),
        W.rooms(spark, folder),
        W.competitor_prices(spark, folder),
        W.demand_signals(spark, folder),
    )


def nights(spark: SparkSession, folder: str) -> DataFrame:
    """Every night with bookings."""
    return W.bookings(spark, folder).select(F.col("check_in_date").alias("stay_date")).distinct()


def hotel_nights(spark: SparkSession, folder: str) -> DataFrame:
    booked_nights = (
        W.bookings(spark, folder)
        .select("hotel_id", F.col("check_in_date").alias("stay_date"))
        .distinct()
    )
    return booked_nights.join(W.hotels(spark, folder), "hotel_id")


# --- normalisation ---------------------------------------------------------------------


@QUERIES.add("s7_normalised_bookings")
def s7(spark, folder):
    untidy = W.bookings(spark, folder).withColumns(
        {
            "booking_count": F.expr(
                "CASE WHEN channel = 'direct' THEN 'n/a' ELSE cast(booking_count AS STRING) END"
            ),
            "lead_time_days": F.expr("lead_time_days / 2D"),
        }
    )
    return B.normalise_bookings(untidy)


@QUERIES.add("s8_normalised_rooms")
def s8(spark, folder):
    return stock(spark, folder)


# --- skeleton and booking curve -----------------------------------------------------------


@QUERIES.add("a1_skeleton_totals")
def a1(spark, folder):
    cells = B.grain_cells(booked(spark, folder)).join(stock(spark, folder), ["hotel_id", "room_type"])
    return settled(
        cells.select(*GRAIN, "gross", "cancels", "net_sold", B.realised().alias(TARGET)),
        target_demand=9,
    )


@QUERIES.add("a2_complete_nights")
def a2(spark, folder):
    return (
        B.skeleton(booked(spark, folder), stock(spark, folder))
        .groupBy("hotel_id", "room_type")
        .agg(
            F.count("*").alias("nights"),
            F.min("stay_date").alias("first_night"),
            F.max("stay_date").alias("last_night"),
        )
    )


@QUERIES.add("j1_totals_with_rooms")
def j1(spark, folder):
    return (
        B.grain_cells(booked(spark, folder))
        .join(stock(spark, folder), ["hotel_id", "room_type"])
        .select(*GRAIN, "net_sold", "room_count", "base_price")
    )


@QUERIES.add("j2_book_at_horizon")
def j2(spark, folder):
    return B.grain_cells(booked(spark, folder)).select(
        *GRAIN, "days_to_checkin", "otb", "otb_lead", "otb_rate", "otb_before"
    )


@QUERIES.add("w1_booking_curve")
def w1(spark, folder):
    return B.booking_curve(booked(spark, folder))


@QUERIES.add("w12_pickup")
def w12(spark, folder):
    return reported(matrix(spark, folder).select(*GRAIN, "booking_count", "pickup_velocity"))


@QUERIES.add("x1_horizon_choice")
def x1(spark, folder):
    cells = W.bookings(spark, folder).selectExpr(
        "hotel_id", "room_type", "check_in_date AS stay_date"
    ).distinct()
    return with_horizon(cells)


@QUERIES.add("x2_occupancy")
def x2(spark, folder):
    return reported(
        B.book_columns(B.skeleton(booked(spark, folder), stock(spark, folder))).select(
            *GRAIN, "total_rooms", "occupancy_rate", "available_rooms"
        )
    )


@QUERIES.add("x3_mean_lead_and_rate")
def x3(spark, folder):
    return reported(
        B.book_columns(B.skeleton(booked(spark, folder), stock(spark, folder))).select(
            *GRAIN, "lead_time", "current_room_price"
        )
    )


# --- history ---------------------------------------------------------------------------


def _observed(spark, folder) -> DataFrame:
    return (
        B.grain_cells(booked(spark, folder))
        .join(stock(spark, folder), ["hotel_id", "room_type"])
        .select(*GRAIN, "days_to_checkin", "cancels", B.realised().alias("realised"))
    )


@QUERIES.add("w2_trailing_demand")
def w2(spark, folder):
    out = H.daily_history(_observed(spark, folder)).drop("cancels_history")
    return settled(out, demand_history=9)


@QUERIES.add("w3_trailing_cancellations")
def w3(spark, folder):
    return H.daily_history(_observed(spark, folder)).drop("demand_history")


@QUERIES.add("j4_history_at_snapshot")
def j4(spark, folder):
    history = H.daily_history(_observed(spark, folder))
    frame = B.skeleton(booked(spark, folder), stock(spark, folder)).select(*GRAIN, "snapshot_date")
    joined = frame.join(
        history.withColumnRenamed("as_of_date", "snapshot_date"),
        ["hotel_id", "room_type", "snapshot_date"],
        "left",
    )
    return settled(
        joined.select(*GRAIN, "snapshot_date", "demand_history", "cancels_history"),
        demand_history=9,
    )


@QUERIES.add("w4_filled_history")
def w4(spark, folder):
    return reported(
        matrix(spark, folder).select(*GRAIN, "historical_demand", "cancellation_count")
    )


# --- market ------------------------------------------------------------------------------


@QUERIES.add("j3_visible_rates")
def j3(spark, folder):
    return M.freshest_per_source(M.visible_rates(rates(spark, folder)))


@QUERIES.add("a3_competitor_set")
def a3(spark, folder):
    return reported(M.market_at_snapshot(rates(spark, folder)))


@QUERIES.add("w5_freshest_rate")
def w5(spark, folder):
    return M.freshest_per_source(rates(spark, folder))


@QUERIES.add("x4_imputed_market")
def x4(spark, folder):
    frame = B.skeleton(booked(spark, folder), stock(spark, folder)).join(
        M.market_at_snapshot(rates(spark, folder)), list(GRAIN), "left"
    )
    return reported(
        M.impute_market(frame).select(
            *GRAIN,
            "competitor_rate",
            "competitor_min_rate",
            "competitor_max_rate",
            "competitor_count",
            "competitor_missing",
        )
    )


# --- signals and calendar ------------------------------------------------------------------


@QUERIES.add("j5_signals_joined")
def j5(spark, folder):
    per_rate = W.competitor_prices(spark, folder).selectExpr(
        "hotel_id",
        "room_type",
        "check_in_date AS stay_date",
        "cast(event_id AS BIGINT) % 10 / 10D AS search_demand",
        "cast(event_id AS BIGINT) % 7 / 10D AS weather_score",
        "cast(event_id AS BIGINT) % 5 / 10D AS local_event_score",
    )
    frame = B.skeleton(booked(spark, folder), stock(spark, folder)).select(*GRAIN)
    return X.fill_signals(frame.join(X.distinct_signals(per_rate), list(GRAIN), "left"))


@QUERIES.add("x5_signal_defaults")
def x5(spark, folder):
    frame = B.skeleton(booked(spark, folder), stock(spark, folder)).select(*GRAIN)
    partial = W.demand_signals(spark, folder).drop("weather_score")
    return X.fill_signals(frame.join(X.distinct_signals(partial), list(GRAIN), "left"))


@QUERIES.add("x6_calendar_features")
def x6(spark, folder):
    frame = C.with_calendar(
        B.skeleton(booked(spark, folder), stock(spark, folder)).select(*GRAIN)
    )
    return X.calendar_columns(frame).drop("leisure_bias")


@QUERIES.add("x7_city_event_override")
def x7(spark, folder):
    full = P.feature_matrix(
        W.bookings(spark, folder),
        W.rooms(spark, folder),
        W.competitor_prices(spark, folder),
        W.demand_signals(spark, folder),
        hotels=W.hotels(spark, folder),
    )
    return reported(full.select(*GRAIN, "local_event_score", "demand_pressure"))


@QUERIES.add("x8_price_to_competitor")
def x8(spark, folder):
    return reported(matrix(spark, folder).select(*GRAIN, "price_to_competitor"))


@QUERIES.add("x9_competitor_spread")
def x9(spark, folder):
    return reported(matrix(spark, folder).select(*GRAIN, "competitor_spread"))


@QUERIES.add("x10_interactions")
def x10(spark, folder):
    return reported(
        matrix(spark, folder).select(
            *GRAIN, "pickup_velocity", "occupancy_x_lead", "demand_pressure"
        )
    )


@QUERIES.add("x11_finite_report")
def x11(spark, folder):
    return X.finite_report(matrix(spark, folder))


@QUERIES.add("x12_feature_matrix")
def x12(spark, folder):
    return reported(X.guard_finite(matrix(spark, folder)))


# --- serving, rebuild, storage ---------------------------------------------------------------


def requests(spark: SparkSession, folder: str) -> DataFrame:
    """A price request per room night, with parts of what a caller may know left out."""
    day = W.AS_OF
    base = (
        W.bookings(spark, folder)
        .selectExpr("hotel_id", "room_type", "check_in_date AS stay_date")
        .distinct()
        .join(W.rooms(spark, folder), ["hotel_id", "room_type"])
        .join(W.hotels(spark, folder).select("hotel_id", "city"), "hotel_id")
    )
    k = "(dayofyear(stay_date) + room_count)"
    return base.selectExpr(
        *GRAIN,
        "base_price",
        "room_count AS total_rooms",
        "floor_price",
        "ceiling_price",
        f"CASE WHEN {k} % 5 <> 0 THEN city END AS city",
        f"DATE'{day}' AS as_of",
        f"CASE WHEN {k} % 3 = 0 THEN ({k} % 100) / 100D END AS occupancy_rate",
        f"CASE WHEN {k} % 3 = 1 THEN {k} % 90 END AS available_rooms",
        f"CASE WHEN {k} % 4 = 0 THEN base_price * 95 / 100 END AS current_price",
        f"CASE WHEN {k} % 7 = 0 THEN base_price * 110 / 100 END AS competitor_rate",
        f"CASE WHEN {k} % 14 = 0 THEN base_price * 90 / 100 END AS competitor_min_rate",
        f"CASE WHEN {k} % 21 = 0 THEN base_price * 130 / 100 END AS competitor_max_rate",
        f"CASE WHEN {k} % 6 = 0 THEN 0.6D END AS search_demand",
    )


@QUERIES.add("x13_serving_rows")
def x13(spark, folder):
    return reported(P.serving_rows(requests(spark, folder)))


@QUERIES.add("x14_rebuilt_matrix")
def x14(spark, folder):
    return reported(P.rebuild_matrix(P.stored_columns(matrix(spark, folder))))


@QUERIES.add("x15_contract")
def x15(spark, folder):
    columns = [c for c in matrix(spark, folder).columns if c in FEATURES]
    P.check_contract(columns)
    width = len(columns)
    return matrix(spark, folder).agg(
        F.count("*").alias("checked_rows"), F.lit(width).alias("feature_columns")
    )


@QUERIES.add("x17_feature_catalogue")
def x17(spark, folder):
    """How often each catalogued feature is away from zero in the matrix."""
    counts = matrix(spark, folder).agg(*[F.count_if(F.col(c) != 0).alias(c) for c in FEATURES])
    long = counts.unpivot([], list(FEATURES), "feature", "non_zero_rows")
    return long.join(F.broadcast(P.feature_catalogue(spark)), "feature")


@QUERIES.add("x18_feature_records")
def x18(spark, folder):
    return reported(P.feature_records(matrix(spark, folder)))


@QUERIES.add("x19_fingerprint")
def x19(spark, folder):
    return P.fingerprint(matrix(spark, folder))


# --- calendar ----------------------------------------------------------------------------------


@QUERIES.add("k1_season")
def k1(spark, folder):
    return nights(spark, folder).withColumn("season", C.season_of("stay_date"))


@QUERIES.add("k2_weekend")
def k2(spark, folder):
    return nights(spark, folder).withColumn("is_weekend", C.is_weekend("stay_date"))


@QUERIES.add("k3_holiday")
def k3(spark, folder):
    on = C.holiday_on("stay_date")
    names = ("holiday_name", "leisure_bias", "significance")
    return nights(spark, folder).withColumns({name: on[name] for name in names})


@QUERIES.add("k4_holiday_proximity")
def k4(spark, folder):
    return C.with_calendar(nights(spark, folder)).select(
        "stay_date", "holiday_proximity"
    )


@QUERIES.add("k5_active_events")
def k5(spark, folder):
    events = C.city_events(spark)
    return (
        nights(spark, folder)
        .join(F.broadcast(events), C.event_is_active("stay_date"))
        .select("stay_date", "city", "event_name", "intensity")
    )


@QUERIES.add("k6_event_score")
def k6(spark, folder):
    on = C.city_event_on(F.col("city"), F.col("stay_date"))
    return hotel_nights(spark, folder).select(
        "hotel_id",
        "stay_date",
        F.coalesce(on["event_score"], F.lit(0.0)).alias("event_score"),
        F.concat_ws("; ", on["event_names"]).alias("event_names"),
    )


@QUERIES.add("j9_calendar_join")
def j9(spark, folder):
    """Holidays and city events attached to every hotel night."""
    on = C.city_event_on(F.col("city"), F.col("stay_date"))
    return C.with_calendar(hotel_nights(spark, folder)).select(
        "hotel_id",
        "stay_date",
        "holiday_name",
        "holiday_proximity",
        F.coalesce(on["event_score"], F.lit(0.0)).alias("event_score"),
    )
