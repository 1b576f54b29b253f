"""Statements of the feature family."""

from nightledger.config import FEATURES
from oracles.base import clip, compose, cte, derived, horizon, season

SQL: dict[str, str] = {}
GRAIN = "hotel_id, room_type, stay_date"

DIGITS = dict(
    historical_demand=9, lead_time=9, current_room_price=6, target_demand=9, occupancy_rate=9,
    competitor_rate=6, price_to_competitor=9, competitor_spread=9, pickup_velocity=9,
    occupancy_x_lead=9, demand_pressure=9,
)


def shown(*columns: str) -> str:
    return ", ".join(f"round({c}, {DIGITS[c]}) AS {c}" if c in DIGITS else c for c in columns)


SQL["s7_normalised_bookings"] = compose(
    """
SELECT hotel_id, room_type, booking_date, check_in_date AS stay_date,
       round_even(lead_time_days / 2.0::DOUBLE, 0)::BIGINT AS lead_time_days,
       booking_count::DOUBLE AS booking_count, cancellation_count::DOUBLE AS cancellation_count,
       revenue, adr
FROM bookings WHERE channel <> 'direct' AND booking_count > 0
""",
    "bookings",
)
SQL["s8_normalised_rooms"] = compose(
    "SELECT hotel_id, room_type, room_count, base_price FROM rooms", "rooms"
)
SQL["a1_skeleton_totals"] = compose(
    f"SELECT {GRAIN}, gross, cancels, net_sold, round(realised, 9) AS target_demand FROM cells",
    "cells",
)
SQL["a2_complete_nights"] = compose(
    """
SELECT hotel_id, room_type, count(*) AS nights, min(stay_date) AS first_night,
       max(stay_date) AS last_night FROM skeleton GROUP BY hotel_id, room_type
""",
    "skeleton",
)
SQL["j1_totals_with_rooms"] = compose(
    f"SELECT {GRAIN}, net_sold, room_count::INT AS room_count, base_price FROM cells", "cells"
)
SQL["j2_book_at_horizon"] = compose(
    """
SELECT t.hotel_id, t.room_type, t.stay_date, t.h AS days_to_checkin,
  coalesce(sum(b.booking_count) FILTER (b.lead_time_days >= t.h), 0) AS otb,
  coalesce(sum(b.booking_count * b.lead_time_days) FILTER (b.lead_time_days >= t.h), 0) AS otb_lead,
  coalesce(sum(b.booking_count * b.adr) FILTER (b.lead_time_days >= t.h), 0) AS otb_rate,
  coalesce(sum(b.booking_count) FILTER (b.lead_time_days >= t.h + 7), 0) AS otb_before
FROM totals t JOIN clean_bookings b USING (hotel_id, room_type, stay_date)
GROUP BY t.hotel_id, t.room_type, t.stay_date, t.h
""",
    "totals",
    "clean_bookings",
)
SQL["w1_booking_curve"] = compose(
    f"""
SELECT DISTINCT {GRAIN}, lead_time_days::BIGINT AS lead_time_days,
       sum(booking_count) OVER w AS otb_rooms,
       sum(booking_count * lead_time_days) OVER w AS otb_lead,
       sum(booking_count * adr) OVER w AS otb_rate
FROM clean_bookings
WINDOW w AS (PARTITION BY {GRAIN} ORDER BY lead_time_days DESC
             RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
""",
    "clean_bookings",
)
SQL["w12_pickup"] = compose(
    f"SELECT {GRAIN}, {shown('booking_count', 'pickup_velocity')} FROM matrix", "matrix"
)
SQL["x1_horizon_choice"] = compose(
    f"""
SELECT DISTINCT hotel_id, room_type, check_in_date AS stay_date,
       {horizon('hotel_id', 'room_type', 'check_in_date')} AS days_to_checkin FROM bookings
""",
    "bookings",
)
SQL["x2_occupancy"] = compose(
    f"""
SELECT {GRAIN}, room_count AS total_rooms, round({clip('otb / room_count', 0, 1)}, 9) AS occupancy_rate,
       greatest(room_count - otb, 0) AS available_rooms
FROM skeleton JOIN book USING (hotel_id, room_type, stay_date)
""",
    "book",
)
SQL["x3_mean_lead_and_rate"] = compose(
    f"""
SELECT {GRAIN}, round(CASE WHEN otb = 0 THEN h ELSE otb_lead / otb END, 9) AS lead_time,
       round(CASE WHEN otb = 0 THEN base_price ELSE otb_rate / otb END, 6) AS current_room_price
FROM skeleton JOIN book USING (hotel_id, room_type, stay_date)
""",
    "book",
)
SQL["w2_trailing_demand"] = compose(
    "SELECT hotel_id, room_type, as_of_date, round(demand_history, 9) AS demand_history FROM hist",
    "hist",
)
SQL["w3_trailing_cancellations"] = compose(
    "SELECT hotel_id, room_type, as_of_date, cancels_history FROM hist", "hist"
)
SQL["j4_history_at_snapshot"] = compose(
    """
SELECT s.hotel_id, s.room_type, s.stay_date, s.snapshot_date,
       round(h.demand_history, 9) AS demand_history, h.cancels_history
FROM skeleton s LEFT JOIN hist h ON h.hotel_id = s.hotel_id AND h.room_type = s.room_type
  AND h.as_of_date = s.snapshot_date
""",
    "skeleton",
    "hist",
)
SQL["w4_filled_history"] = compose(
    f"SELECT {GRAIN}, {shown('historical_demand', 'cancellation_count')} FROM history", "history"
)
SQL["j3_visible_rates"] = compose("SELECT * FROM visible", "visible")
SQL["a3_competitor_set"] = compose(
    f"""
SELECT {GRAIN}, {shown('competitor_rate')}, competitor_min_rate, competitor_max_rate,
       competitor_count FROM market
""",
    "market",
)
SQL["w5_freshest_rate"] = compose(
    """
SELECT hotel_id, room_type, check_in_date AS stay_date, competitor, price FROM rates
QUALIFY row_number() OVER (PARTITION BY hotel_id, room_type, check_in_date, competitor
                           ORDER BY collected_at DESC, price) = 1
""",
    "rates",
)
SQL["x4_imputed_market"] = compose(
    f"""
SELECT {GRAIN}, {shown('competitor_rate')}, competitor_min_rate, competitor_max_rate,
       competitor_count, competitor_missing FROM matrix
""",
    "matrix",
)
SQL["j5_signals_joined"] = compose(
    f"""
, per_rate AS (
  SELECT hotel_id, room_type, check_in_date AS stay_date,
         (event_id::BIGINT % 10) / 10.0::DOUBLE AS a, (event_id::BIGINT % 7) / 10.0::DOUBLE AS b,
         (event_id::BIGINT % 5) / 10.0::DOUBLE AS c
  FROM rates
  QUALIFY row_number() OVER (PARTITION BY hotel_id, room_type, check_in_date ORDER BY a, b, c) = 1)
SELECT {GRAIN}, coalesce(a, 0) AS search_demand, coalesce(b, 0.5::DOUBLE) AS weather_score,
       coalesce(c, 0) AS local_event_score
FROM skeleton LEFT JOIN per_rate USING (hotel_id, room_type, stay_date)
""",
    "skeleton",
    "rates",
)
SQL["x5_signal_defaults"] = compose(
    f"""
SELECT {GRAIN}, coalesce(search_demand, 0) AS search_demand, 0.5::DOUBLE AS weather_score,
       coalesce(local_event_score, 0) AS local_event_score
FROM skeleton LEFT JOIN signals USING (hotel_id, room_type, stay_date)
""",
    "skeleton",
    "signals",
)
SQL["x6_calendar_features"] = compose(
    f"""
SELECT {GRAIN}, holiday_name, holiday_proximity, day_of_week, is_weekend, holiday_flag, season,
       season_winter, season_summer, season_monsoon, season_autumn FROM matrix
""",
    "matrix",
)
SQL["x7_city_event_override"] = compose(
    f"""
SELECT {GRAIN}, coalesce(e.event_score, 0) AS local_event_score,
       round(m.search_demand * (1.0::DOUBLE + coalesce(e.event_score, 0)), 9) AS demand_pressure
FROM matrix m JOIN hotels USING (hotel_id)
LEFT JOIN city_days e ON e.city = hotels.city AND e.day = m.stay_date
""",
    "matrix",
    "hotels",
    "city_days",
)
for name, columns in {
    "x8_price_to_competitor": ("price_to_competitor",),
    "x9_competitor_spread": ("competitor_spread",),
    "x10_interactions": ("pickup_velocity", "occupancy_x_lead", "demand_pressure"),
}.items():
    SQL[name] = compose(f"SELECT {GRAIN}, {shown(*columns)} FROM matrix", "matrix")
SQL["x11_finite_report"] = compose(
    " UNION ALL ".join(
        f"SELECT '{f}' AS feature, count(*) FILTER ({f} IS NULL OR NOT isfinite({f}))"
        f" AS unusable_rows FROM matrix"
        for f in FEATURES
    ),
    "matrix",
)
SQL["x12_feature_matrix"] = compose(
    f"""
SELECT {GRAIN}, snapshot_date, 'v1' AS feature_version, season, holiday_name, base_price, net_sold,
       {shown(*FEATURES, 'target_demand')} FROM matrix
""",
    "matrix",
)

_K = "(dayofyear(stay_date) + room_count)"
cte(
    "requests",
    f"""
SELECT DISTINCT b.hotel_id, b.room_type, b.check_in_date AS stay_date, r.base_price,
       r.room_count, r.floor_price, r.ceiling_price, h.city AS hotel_city
FROM bookings b JOIN rooms r USING (hotel_id, room_type) JOIN hotels h USING (hotel_id)
""",
    "bookings",
    "rooms",
    "hotels",
)
cte(
    "asked",
    f"""
SELECT {GRAIN}, base_price, room_count::DOUBLE AS total_rooms, floor_price, ceiling_price,
       CASE WHEN {_K} % 5 <> 0 THEN hotel_city END AS city,
       greatest(date_diff('day', DATE '2025-12-01', stay_date), 0) AS h,
       CASE WHEN {_K} % 3 = 0 THEN ({_K} % 100) / 100.0::DOUBLE END AS occ,
       CASE WHEN {_K} % 3 = 1 THEN ({_K} % 90)::DOUBLE END AS avail,
       CASE WHEN {_K} % 4 = 0 THEN base_price * 95 / 100 END AS current_price,
       CASE WHEN {_K} % 7 = 0 THEN base_price * 110 / 100 END AS rate,
       CASE WHEN {_K} % 14 = 0 THEN base_price * 90 / 100 END AS low,
       CASE WHEN {_K} % 21 = 0 THEN base_price * 130 / 100 END AS high,
       CASE WHEN {_K} % 6 = 0 THEN 0.6::DOUBLE END AS search
FROM requests
""",
    "requests",
)
cte(
    "serving",
    f"""
SELECT hotel_id, room_type, stay_date, base_price, o AS occupancy_rate,
       coalesce(avail, round_even(total_rooms * (1.0::DOUBLE - o), 0)) AS available_rooms, total_rooms,
       0::DOUBLE AS booking_count, 0::DOUBLE AS cancellation_count,
       coalesce(rate, base_price) AS competitor_rate,
       coalesce(low, rate, base_price) AS competitor_min_rate,
       coalesce(high, rate, base_price) AS competitor_max_rate,
       CASE WHEN rate IS NULL THEN 0 ELSE 1 END::DOUBLE AS competitor_count,
       h::DOUBLE AS days_to_checkin, h::DOUBLE AS lead_time, coalesce(search, 0) AS search_demand,
       o AS historical_demand, coalesce(current_price, base_price) AS current_room_price,
       CASE WHEN isodow(stay_date) >= 6 THEN 1 ELSE 0 END::DOUBLE AS is_weekend,
       (isodow(stay_date) - 1)::DOUBLE AS day_of_week,
       CASE WHEN k.holiday_name IS NULL THEN 0 ELSE 1 END::DOUBLE AS holiday_flag,
       coalesce(e.event_score, 0) AS local_event_score, 0.5::DOUBLE AS weather_score,
       {season('stay_date')} AS season,
       CASE WHEN rate IS NULL THEN 1 ELSE 0 END::DOUBLE AS competitor_missing, k.holiday_proximity
FROM (SELECT *, {clip("coalesce(occ, 1.0::DOUBLE - avail / total_rooms, 0)", 0, 1)} AS o FROM asked) a
LEFT JOIN calendar k ON k.day = stay_date
LEFT JOIN city_days e ON e.city = a.city AND e.day = stay_date
""",
    "asked",
    "calendar",
    "city_days",
)
cte("served", derived("serving"), "serving")
SQL["x13_serving_rows"] = compose(f"SELECT {GRAIN}, {shown(*FEATURES)} FROM served", "served")
SQL["x14_rebuilt_matrix"] = compose(
    f"SELECT {GRAIN}, {shown(*FEATURES, 'target_demand')} FROM matrix", "matrix"
)
_GROUPS = {
    "inventory / pickup": FEATURES[:5],
    "competitive set": FEATURES[5:9],
    "timing": FEATURES[9:11],
    "demand signal": FEATURES[11:14],
    "calendar": FEATURES[14:23],
    "derived": FEATURES[23:],
}
SQL["x17_feature_catalogue"] = compose(
    " UNION ALL ".join(
        f"SELECT '{f}' AS feature, count(*) FILTER ({f} <> 0) AS non_zero_rows,"
        f" '{group}' AS feature_group FROM matrix"
        for group, names in _GROUPS.items()
        for f in names
    ),
    "matrix",
)
_COUNTS = (
    "day_of_week", "total_rooms", "available_rooms", "booking_count", "cancellation_count",
    "competitor_count", "days_to_checkin",
)
_REST = [
    c
    for c in (*FEATURES[:19], "target_demand")
    if c not in _COUNTS and c not in ("is_weekend", "holiday_flag")
]
SQL["x18_feature_records"] = compose(
    f"""
SELECT {GRAIN}, season, holiday_name, 'v1' AS feature_version,
       {', '.join(f'round_even({c}, 0)::BIGINT AS {c}' for c in _COUNTS)},
       is_weekend = 1 AS is_weekend, holiday_flag = 1 AS holiday_flag, {shown(*_REST)} FROM matrix
""",
    "matrix",
)

cte("nights", "SELECT DISTINCT check_in_date AS stay_date FROM bookings", "bookings")
cte(
    "hotel_nights",
    """
SELECT DISTINCT b.hotel_id, b.check_in_date AS stay_date, h.city, h.segment, h.star_rating
FROM bookings b JOIN hotels h USING (hotel_id)
""",
    "bookings",
    "hotels",
)
SQL["k1_season"] = compose(f"SELECT stay_date, {season('stay_date')} AS season FROM nights", "nights")
SQL["k2_weekend"] = compose(
    "SELECT stay_date, isodow(stay_date) IN (6, 7) AS is_weekend FROM nights", "nights"
)
SQL["k3_holiday"] = compose(
    """
SELECT stay_date, name AS holiday_name, bias AS leisure_bias, sig AS significance
FROM nights LEFT JOIN holidays ON day = stay_date
""",
    "nights",
    "holidays",
)
SQL["k4_holiday_proximity"] = compose(
    "SELECT stay_date, holiday_proximity FROM nights JOIN calendar ON day = stay_date",
    "nights",
    "calendar",
)
from nightledger.functions.calendar import CITY_EVENTS  # noqa: E402
from oracles.base import quote  # noqa: E402

_EVENT_ROWS = ", ".join(
    f"({quote(n)}, {quote(c)}, {a}, {b}, {i}::DOUBLE, {str(e).lower()})"
    for n, c, a, b, i, e in CITY_EVENTS
)
SQL["k5_active_events"] = compose(
    f"""
SELECT stay_date, city, name AS event_name, intensity
FROM nights, (VALUES {_EVENT_ROWS}) e(name, city, opens, closes, intensity, biennial)
WHERE (NOT biennial OR year(stay_date) % 2 = 0)
  AND ((opens <= closes AND strftime(stay_date, '%m%d')::INT BETWEEN opens AND closes)
    OR (opens > closes AND (strftime(stay_date, '%m%d')::INT >= opens
                            OR strftime(stay_date, '%m%d')::INT <= closes)))
""",
    "nights",
)
SQL["k6_event_score"] = compose(
    """
SELECT hotel_id, stay_date, coalesce(event_score, 0) AS event_score,
       coalesce(event_names, '') AS event_names
FROM hotel_nights n LEFT JOIN city_days e ON e.city = n.city AND e.day = n.stay_date
""",
    "hotel_nights",
    "city_days",
)
SQL["j9_calendar_join"] = compose(
    """
SELECT hotel_id, stay_date, holiday_name, holiday_proximity,
       coalesce(event_score, 0) AS event_score
FROM hotel_nights n JOIN calendar k ON k.day = stay_date
LEFT JOIN city_days e ON e.city = n.city AND e.day = n.stay_date
""",
    "hotel_nights",
    "calendar",
    "city_days",
)
SQL["x15_contract"] = compose(
    f"SELECT count(*) AS checked_rows, {len(FEATURES)}::INT AS feature_columns FROM matrix", "matrix"
)
_SHOWN = ", ".join(
    [f"coalesce({c}::VARCHAR, 'null')" for c in GRAIN.split(", ")]
    + [f"coalesce(round({c} * 1e6)::BIGINT::VARCHAR, 'null')" for c in (*FEATURES, "target_demand")]
)
SQL["x19_fingerprint"] = compose(
    f"""
SELECT count(*) AS hashed_rows,
  sha256(count(*)::VARCHAR || '|' || sum(('0x' || substr(md5(concat_ws('|', {_SHOWN})), 1, 12))::BIGINT)::VARCHAR
    || '|' || '{",".join([*GRAIN.split(", "), *FEATURES, "target_demand"])}') AS fingerprint
FROM matrix
""",
    "matrix",
)
