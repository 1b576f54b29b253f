"""Booking curve, history, market and the matrix on hand-made nights."""

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from nightledger.config import FEATURES, FeatureConfig
from nightledger.operators import bookings as B
from nightledger.operators import features as X
from nightledger.operators import market as M
from nightledger.plans import features as P

STAY = date(2026, 6, 10)
CURVE = {30: 2, 21: 3, 14: 4, 10: 3, 7: 4, 5: 5, 3: 3, 1: 2, 0: 1}
SEVEN_DAYS = FeatureConfig(horizons=(7,), horizon_weights=(1.0,), incomplete_tail_days=0)


def bookings(spark, curve=None, stay=STAY, cancelled=0, hotel="H001"):
    rows = [
        ("e", hotel, "deluxe", stay - timedelta(days=lead), stay, n, min(cancelled, n), 6000.0 * n, 6000.0, lead)
        for lead, n in (curve or CURVE).items()
    ]
    return spark.createDataFrame(
        rows,
        "event_id string, hotel_id string, room_type string, booking_date date, check_in_date date,"
        " booking_count int, cancellation_count int, revenue double, adr double, lead_time_days int",
    )


def rooms(spark):
    return spark.createDataFrame(
        [("H001", "deluxe", 40, 6400.0)], "hotel_id string, room_type string, room_count int, base_price double"
    )


def rates(spark, rows):
    return spark.createDataFrame(
        [("H001", "deluxe", c, STAY, p, datetime.combine(STAY - timedelta(days=lead), datetime.min.time()))
         for c, lead, p in rows],
        "hotel_id string, room_type string, competitor string, check_in_date date, price double,"
        " collected_at timestamp",
    )


def one(frame):
    rows = frame.collect()
    assert len(rows) == 1
    return rows[0]


def test_book_at_seven_days(spark):
    row = one(
        P.feature_matrix(
            bookings(spark), rooms(spark), rates(spark, [("booking", 21, 6000.0), ("booking", 7, 7000.0)]),
            None, SEVEN_DAYS,
        )
    )
    on_books = {lead: n for lead, n in CURVE.items() if lead >= 7}
    held = sum(on_books.values())
    assert row.occupancy_rate == pytest.approx(held / 40)
    assert row.available_rooms == 40 - held
    assert row.booking_count == sum(n for lead, n in on_books.items() if lead < 14)
    assert row.lead_time == pytest.approx(sum(lead * n for lead, n in on_books.items()) / held)
    assert row.current_room_price == 6000.0
    assert row.target_demand == pytest.approx(sum(CURVE.values()) / 40)
    # The observation made exactly at the snapshot is visible and is the freshest.
    assert row.competitor_rate == 7000.0 and row.competitor_count == 1 and row.competitor_missing == 0
    assert [c for c in P.feature_matrix(bookings(spark), rooms(spark), None, None, SEVEN_DAYS).columns
            if c in FEATURES] == list(FEATURES)


def test_nothing_after_the_snapshot_is_seen(spark):
    late = {**CURVE, 6: 9, 5: 20, 0: 7}
    seen = [c for c in FEATURES if c not in ("historical_demand", "cancellation_count")]
    base, changed = (
        one(
            P.feature_matrix(
                bookings(spark, curve), rooms(spark), rates(spark, [("agoda", 9, 5000.0), ("agoda", lead, 9999.0)]),
                None, SEVEN_DAYS,
            )
        )
        for curve, lead in ((CURVE, 3), (late, 2))
    )
    assert [base[c] for c in seen] == [changed[c] for c in seen]
    assert base.competitor_rate == 5000.0
    assert base.target_demand != changed.target_demand


def test_unseen_market_and_empty_book(spark):
    row = one(
        P.feature_matrix(bookings(spark, {2: 3}), rooms(spark), rates(spark, [("agoda", 1, 1.0)]), None, SEVEN_DAYS)
    )
    assert row.competitor_missing == 1 and row.competitor_rate == 6400.0 and row.competitor_count == 0
    assert row.lead_time == 7 and row.current_room_price == 6400.0 and row.occupancy_rate == 0
    assert (row.search_demand, row.weather_score, row.local_event_score) == (0.0, 0.5, 0.0)


def test_history_counts_calendar_days(spark):
    nights = [STAY - timedelta(days=d) for d in (0, 10, 40)]
    frame = bookings(spark, {20: 8}, nights[0], 2)
    for night, n in ((nights[1], 20), (nights[2], 40)):
        frame = frame.unionByName(bookings(spark, {20: n}, night, 2))
    by_night = {
        r.stay_date: r for r in P.feature_matrix(frame, rooms(spark), None, None, SEVEN_DAYS).collect()
    }
    # Snapshot is 3 June: the window reaches back to 7 May and holds the 31 May night only.
    assert by_night[nights[0]].historical_demand == pytest.approx(18 / 40)
    assert by_night[nights[0]].cancellation_count == 2
    # The first night's snapshot lies before any history: the room's own mean is used.
    known = [by_night[nights[0]].historical_demand, by_night[nights[1]].historical_demand]
    assert by_night[nights[2]].historical_demand == pytest.approx(sum(known) / 2, abs=0.5)


def test_tail_and_hot_night(spark):
    # One night with many rows collapses into one cell, whatever its share of the table.
    hot = spark.range(3000).select(
        F.lit("H001").alias("hotel_id"), F.lit("deluxe").alias("room_type"),
        F.lit(STAY).alias("stay_date"), (F.col("id") % 60).cast("int").alias("lead_time_days"),
        F.lit(1.0).alias("booking_count"), F.lit(0.0).alias("cancellation_count"), F.lit(1.0).alias("adr"),
    )
    row = one(B.grain_cells(hot, horizon="30"))
    assert row.gross == 3000 and row.otb == 1500
    with pytest.raises(ValueError):
        B.require_rows(
            B.skeleton(B.normalise_bookings(bookings(spark)), B.normalise_rooms(rooms(spark))), "no complete night"
        )


def test_bad_feature_stops_the_job(spark):
    matrix = P.feature_matrix(bookings(spark), rooms(spark), None, None, SEVEN_DAYS)
    broken = matrix.withColumn("lead_time", F.lit(float("nan")))
    assert {r.feature: r.unusable_rows for r in X.finite_report(broken).collect()}["lead_time"] == 1
    with pytest.raises(Exception, match="lead_time"):
        X.guard_finite(broken).collect()
    with pytest.raises(ValueError, match="out of order"):
        P.check_contract(list(reversed(FEATURES)))


def test_training_and_serving_agree(spark):
    matrix = P.feature_matrix(
        bookings(spark), rooms(spark), rates(spark, [("booking", 10, 5800.0), ("agoda", 9, 6600.0)]), None, SEVEN_DAYS
    )
    trained = one(matrix)
    asked = matrix.select(
        "hotel_id", "room_type", "stay_date", "base_price", "total_rooms", "occupancy_rate",
        F.col("current_room_price").alias("current_price"), "available_rooms", "booking_count",
        "cancellation_count", "competitor_rate", "competitor_min_rate", "competitor_max_rate",
        "competitor_count", "lead_time", "historical_demand",
    )
    served = one(P.serving_rows(asked, STAY - timedelta(days=7)))
    assert [served[c] for c in FEATURES] == pytest.approx([trained[c] for c in FEATURES])


def test_ties_in_the_market(spark):
    rows = rates(spark, [("booking", 5, 100.0), ("booking", 5, 140.0), ("agoda", 5, 90.0), ("agoda", 9, 10.0)])
    typed = M.normalise_rates(rows)
    assert one(M.market_as_of(typed, STAY)).competitor_count == 3
    assert one(M.competitor_set(M.freshest_per_source(typed))).competitor_rate == 95.0


def test_calendar_knows_every_year(spark):
    """Fixed holidays and city events recur; no span of years is left out."""
    from datetime import date

    from pyspark.sql import functions as F

    from nightledger.functions import calendar as C

    days = [
        (date(2028, 12, 25), "Goa"), (date(2023, 1, 26), "New Delhi"), (date(1999, 12, 30), "Goa"),
        (date(2028, 1, 14), "New Delhi"), (date(2031, 1, 14), "New Delhi"), (date(2026, 10, 20), "Mumbai"),
    ]
    frame = spark.createDataFrame(days, "stay_date date, city string")
    on = C.city_event_on(F.col("city"), F.col("stay_date"))
    got = {
        r.stay_date: r
        for r in C.with_calendar(frame).withColumn("score", on["event_score"]).withColumn("names", on["event_names"]).collect()
    }
    assert got[date(2028, 12, 25)].holiday_name == "Christmas"
    assert got[date(2023, 1, 26)].holiday_name == "Republic Day" and got[date(2023, 1, 26)].score == 0.6
    assert got[date(1999, 12, 30)].holiday_name is None
    assert abs(got[date(1999, 12, 30)].holiday_proximity - 0.6667) < 1e-9
    assert got[date(1999, 12, 30)].names == ["New Year Week", "Sunburn Festival"]
    assert got[date(2028, 1, 14)].score == 0.7 and got[date(2031, 1, 14)].score is None
    assert got[date(2026, 10, 20)].holiday_name == "Dussehra" and got[date(2026, 10, 20)].score is None
