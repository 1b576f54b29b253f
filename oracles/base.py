"""Shared common table expressions and their composition.

Each statement handed to DuckDB has to stand on the raw tables alone, so the views the
Spark side derives are repeated here as CTEs and pulled in by dependency.
"""

from __future__ import annotations

from datetime import date

from nightledger.config import FEATURE_CONFIG
from nightledger.functions.calendar import CITY_EVENTS, FIXED_HOLIDAYS, MOVABLE_HOLIDAYS
from nightledger.functions.horizon import thresholds
from nightledger.sources.warehouse import CITIES, ROOM_COUNTS, ROOM_CYCLE, SEGMENT_CYCLE

CTES: dict[str, tuple[tuple[str, ...], str]] = {}
# Long chains of dependent expressions, which inlining would multiply.
COMPUTED_ONCE = {"guarded", "guarded_grid", "swept", "repriced"}


def cte(name: str, body: str, *needs: str) -> None:
    CTES[name] = (needs, body.strip())


def compose(body: str, *needs: str) -> str:
    """``WITH`` clause of everything ``needs`` depends on, followed by the statement."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered:
            return
        for parent in CTES[name][0]:
            visit(parent)
        ordered.append(name)

    for name in needs:
        visit(name)
    if not ordered:
        return body.strip()
    parts = ",\n".join(
        f"{name} AS {'MATERIALIZED ' if name in COMPUTED_ONCE else ''}(\n{CTES[name][1]}\n)"
        for name in ordered
    )
    return f"WITH {parts}\n{body.strip()}"


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def listing(values) -> str:
    return "[" + ", ".join(quote(v) if isinstance(v, str) else str(v) for v in values) + "]"


def code(index: str) -> str:
    return f"printf('H%04d', {index})"


def pick(values, index: str) -> str:
    return f"({listing(values)})[(({index}) + 1)::INT]"


def fold(column: str) -> str:
    return (
        f"(DATE '2025-01-01' + (date_diff('day', DATE '1995-01-01', {column}::DATE) % 365)::INT)"
    )


def base(hotel: str, room: str) -> str:
    return f"(3000 + ({hotel} % 8) * 250 + {room} * 1500)::DOUBLE"


def horizon(hotel: str, room: str, day: str) -> str:
    draw = (
        f"('0x' || substr(md5('{FEATURE_CONFIG.horizon_seed}|' || {hotel} || '|' || {room}"
        f" || '|' || ({day})::VARCHAR), 1, 8))::BIGINT"
    )
    steps = thresholds()
    cases = " ".join(f"WHEN {draw} < {edge} THEN {h}" for edge, h in steps[:-1])
    return f"(CASE {cases} ELSE {steps[-1][1]} END)"


def season(day: str) -> str:
    return (
        f"CASE WHEN month({day}) IN (12, 1, 2) THEN 'winter'"
        f" WHEN month({day}) IN (3, 4, 5) THEN 'summer'"
        f" WHEN month({day}) IN (6, 7, 8, 9) THEN 'monsoon' ELSE 'autumn' END"
    )


def clip(value: str, low: float, high: float) -> str:
    return f"greatest({low}::DOUBLE, least({high}::DOUBLE, {value}))"


# --- the derived tables ----------------------------------------------------------------

cte(
    "hotels",
    f"""
SELECT {code('idx')} AS hotel_id, 'Hotel ' || idx::VARCHAR AS hotel_name,
       {pick(CITIES, 'idx % 6')} AS city, 'India' AS country,
       (3 + idx % 3)::INT AS star_rating, {sum(ROOM_COUNTS)}::INT AS total_rooms,
       {pick(SEGMENT_CYCLE, 'idx % 3')} AS segment, 'INR' AS currency,
       (idx % 10 <> 9) AS is_active
FROM (SELECT DISTINCT s_suppkey // 10 AS idx FROM supplier)
""",
)
cte(
    "rooms",
    f"""
SELECT {code('idx')} || '-' || r::VARCHAR AS room_id, {code('idx')} AS hotel_id,
       {pick(ROOM_CYCLE, 'r')} AS room_type, (2 + r)::INT AS capacity,
       ({listing(ROOM_COUNTS)})[(r + 1)::INT]::INT AS room_count,
       {base('idx', 'r')} AS base_price,
       {base('idx', 'r')} * 65 / 100 AS floor_price,
       {base('idx', 'r')} * 220 / 100 AS ceiling_price
FROM (SELECT DISTINCT s_suppkey // 10 AS idx FROM supplier),
     (SELECT unnest([0, 1, 2, 3]) AS r)
""",
)
cte(
    "bookings",
    f"""
SELECT event_id, hotel_id, room_type, (check_in_date - lead_time_days)::DATE AS booking_date,
       check_in_date, (check_in_date + 1)::DATE AS check_out_date, booking_count,
       cancellation_count, (booking_count - cancellation_count) * adr AS revenue, adr,
       lead_time_days, channel
FROM (
  SELECT l_orderkey::VARCHAR || '-' || l_linenumber::VARCHAR AS event_id,
         {code('l_suppkey // 10')} AS hotel_id,
         {pick(ROOM_CYCLE, 'l_partkey % 4')} AS room_type,
         {fold('l_shipdate')}::DATE AS check_in_date,
         ((l_orderkey * 7 + l_partkey * 3 + l_linenumber) % 91)::INT AS lead_time_days,
         l_quantity::INT AS booking_count,
         (CASE WHEN l_returnflag = 'R' THEN l_quantity::INT // 5 ELSE 0 END)::INT
           AS cancellation_count,
         {base('(l_suppkey // 10)', '(l_partkey % 4)')} * (90 + l_linenumber * 3) / 100 AS adr,
         (['direct', 'ota', 'corporate', 'walk_in'])[(l_linenumber % 4 + 1)::INT] AS channel
  FROM lineitem)
""",
)
cte(
    "rates",
    f"""
SELECT event_id, hotel_id, room_type, competitor, check_in_date, price, currency,
       is_available, source, (check_in_date - lead)::TIMESTAMP AS collected_at, lead
FROM (
  SELECT o_orderkey::VARCHAR AS event_id, {code('o_custkey // 150')} AS hotel_id,
         {pick(ROOM_CYCLE, 'o_orderkey % 4')} AS room_type,
         (['booking', 'expedia', 'agoda', 'makemytrip'])[((o_orderkey // 4) % 4 + 1)::INT]
           AS competitor,
         {fold('o_orderdate')}::DATE AS check_in_date,
         {base('(o_custkey // 150)', '(o_orderkey % 4)')} * (80 + o_orderkey % 41) / 100 AS price,
         'INR' AS currency, (o_orderstatus <> 'F') AS is_available,
         CASE WHEN o_orderkey % 3 = 0 THEN 'live' ELSE 'batch' END AS source,
         (o_orderkey % 45)::INT AS lead
  FROM orders)
""",
)
cte(
    "signals",
    f"""
SELECT hotel_id, room_type, stay_date, least(1.0::DOUBLE, n / 4.0::DOUBLE) AS search_demand,
       (s % 101) / 100.0::DOUBLE AS weather_score, (s % 5) / 10.0::DOUBLE AS local_event_score
FROM (
  SELECT {code('o_custkey // 150')} AS hotel_id, {pick(ROOM_CYCLE, 'o_orderkey % 4')} AS room_type,
         {fold('o_orderdate')}::DATE AS stay_date, count(*) AS n, sum(o_orderkey) AS s
  FROM orders GROUP BY 1, 2, 3)
""",
)

# --- the calendar ----------------------------------------------------------------------

_years = range(2019, 2032)
_fixed = ", ".join(
    f"(DATE '{date(y, m, d)}', {quote(n)}, {s}::DOUBLE, {b}::DOUBLE, 1)"
    for y in _years
    for m, d, n, s, b in FIXED_HOLIDAYS
)
_movable = ", ".join(
    f"(DATE '{d}', {quote(n)}, {s}::DOUBLE, {b}::DOUBLE, 0)" for d, n, s, b in MOVABLE_HOLIDAYS
)
cte("all_holidays", f"SELECT * FROM (VALUES {_fixed}, {_movable}) t(day, name, sig, bias, fixed)")
cte(
    "holidays",
    "SELECT day, name, sig, bias FROM all_holidays"
    " QUALIFY row_number() OVER (PARTITION BY day ORDER BY sig DESC, fixed DESC) = 1",
    "all_holidays",
)
cte(
    "days",
    "SELECT unnest(generate_series(DATE '2020-01-01', DATE '2030-12-31', INTERVAL 1 DAY))::DATE"
    " AS day",
)
cte(
    "calendar",
    """
SELECT d.day, h.name AS holiday_name, h.bias AS leisure_bias,
       round(coalesce((SELECT max(n.sig * (1.0::DOUBLE - abs(date_diff('day', n.day, d.day)) / 3.0::DOUBLE))
                       FROM holidays n WHERE n.day BETWEEN d.day - 2 AND d.day + 2), 0.0::DOUBLE), 4)
         AS holiday_proximity
FROM days d LEFT JOIN holidays h ON h.day = d.day
""",
    "days",
    "holidays",
)
_events = ", ".join(
    f"({quote(n)}, {quote(c)}, {a}, {b}, {i}::DOUBLE, {str(e).lower()})"
    for n, c, a, b, i, e in CITY_EVENTS
)
cte(
    "city_days",
    f"""
SELECT city, day, round(1.0::DOUBLE - product(1.0::DOUBLE - intensity), 4) AS event_score,
       string_agg(name, '; ' ORDER BY intensity DESC, name) AS event_names
FROM days, (VALUES {_events}) e(name, city, opens, closes, intensity, biennial)
WHERE (NOT biennial OR year(day) % 2 = 0)
  AND CASE WHEN opens <= closes THEN month(day) * 100 + day(day) BETWEEN opens AND closes
           ELSE month(day) * 100 + day(day) >= opens OR month(day) * 100 + day(day) <= closes END
GROUP BY city, day
""",
    "days",
)

# --- the feature matrix ----------------------------------------------------------------

cte(
    "clean_bookings",
    """
SELECT hotel_id, room_type, check_in_date AS stay_date, booking_date, lead_time_days,
       booking_count::DOUBLE AS booking_count, cancellation_count::DOUBLE AS cancellation_count,
       revenue, adr
FROM bookings WHERE booking_count > 0
""",
    "bookings",
)
cte(
    "totals",
    f"""
SELECT hotel_id, room_type, stay_date, sum(booking_count) AS gross,
       sum(cancellation_count) AS cancels,
       sum(booking_count) - sum(cancellation_count) AS net_sold,
       {horizon('hotel_id', 'room_type', 'stay_date')} AS h
FROM clean_bookings GROUP BY hotel_id, room_type, stay_date
""",
    "clean_bookings",
)
cte(
    "cells",
    f"""
SELECT t.*, r.room_count::DOUBLE AS room_count, r.base_price,
       {clip('net_sold / room_count', 0, 1.5)} AS realised, t.stay_date - h AS snapshot_date
FROM totals t JOIN rooms r USING (hotel_id, room_type)
""",
    "totals",
    "rooms",
)
cte(
    "skeleton",
    "SELECT * FROM cells WHERE stay_date <= (SELECT max(stay_date) - 1 FROM cells)",
    "cells",
)
cte(
    "book",
    """
SELECT s.hotel_id, s.room_type, s.stay_date,
       coalesce(sum(b.booking_count) FILTER (b.lead_time_days >= s.h), 0) AS otb,
       coalesce(sum(b.booking_count * b.lead_time_days) FILTER (b.lead_time_days >= s.h), 0) AS otb_lead,
       coalesce(sum(b.booking_count * b.adr) FILTER (b.lead_time_days >= s.h), 0) AS otb_rate,
       coalesce(sum(b.booking_count) FILTER (b.lead_time_days >= s.h + 7), 0) AS otb_before
FROM skeleton s JOIN clean_bookings b USING (hotel_id, room_type, stay_date)
GROUP BY s.hotel_id, s.room_type, s.stay_date
""",
    "skeleton",
    "clean_bookings",
)
cte(
    "spans",
    "SELECT hotel_id, room_type, min(stay_date) AS a, max(stay_date) AS b FROM cells GROUP BY ALL",
    "cells",
)
cte(
    "hist",
    """
SELECT sp.hotel_id, sp.room_type, d.day AS as_of_date,
       avg(c.realised) OVER w AS demand_history, sum(c.cancels) OVER w AS cancels_history
FROM spans sp JOIN days d ON d.day BETWEEN sp.a AND sp.b
LEFT JOIN cells c ON c.hotel_id = sp.hotel_id AND c.room_type = sp.room_type AND c.stay_date = d.day
WINDOW w AS (PARTITION BY sp.hotel_id, sp.room_type ORDER BY d.day
             ROWS BETWEEN 27 PRECEDING AND CURRENT ROW)
""",
    "spans",
    "days",
    "cells",
)
cte(
    "history",
    """
SELECT s.hotel_id, s.room_type, s.stay_date,
       coalesce(h.demand_history, avg(h.demand_history) OVER (PARTITION BY s.hotel_id, s.room_type),
                0) AS historical_demand,
       coalesce(h.cancels_history, 0) AS cancellation_count
FROM skeleton s LEFT JOIN hist h
  ON h.hotel_id = s.hotel_id AND h.room_type = s.room_type AND h.as_of_date = s.snapshot_date
""",
    "skeleton",
    "hist",
)
cte(
    "visible",
    f"""
SELECT hotel_id, room_type, check_in_date AS stay_date, competitor, price
FROM rates
WHERE lead >= {horizon('hotel_id', 'room_type', 'check_in_date')}
QUALIFY row_number() OVER (PARTITION BY hotel_id, room_type, check_in_date, competitor
                           ORDER BY collected_at DESC, price) = 1
""",
    "rates",
)
cte(
    "market",
    """
SELECT hotel_id, room_type, stay_date, avg(price) AS competitor_rate, min(price) AS competitor_min_rate,
       max(price) AS competitor_max_rate, count(*)::DOUBLE AS competitor_count
FROM visible GROUP BY hotel_id, room_type, stay_date
""",
    "visible",
)
cte(
    "joined",
    f"""
SELECT s.hotel_id, s.room_type, s.stay_date, s.snapshot_date, s.base_price, s.net_sold,
       s.realised AS target_demand, s.room_count AS total_rooms,
       {clip('b.otb / s.room_count', 0, 1)} AS occupancy_rate,
       greatest(s.room_count - b.otb, 0) AS available_rooms,
       greatest(b.otb - b.otb_before, 0) AS booking_count, y.cancellation_count,
       coalesce(m.competitor_rate, s.base_price) AS competitor_rate,
       coalesce(m.competitor_min_rate, s.base_price) AS competitor_min_rate,
       coalesce(m.competitor_max_rate, s.base_price) AS competitor_max_rate,
       coalesce(m.competitor_count, 0) AS competitor_count,
       s.h::DOUBLE AS days_to_checkin,
       CASE WHEN b.otb > 0 THEN b.otb_lead / b.otb ELSE s.h END AS lead_time,
       coalesce(g.search_demand, 0) AS search_demand, y.historical_demand,
       CASE WHEN b.otb > 0 THEN b.otb_rate / b.otb ELSE s.base_price END AS current_room_price,
       CASE WHEN isodow(s.stay_date) >= 6 THEN 1.0 ELSE 0.0 END::DOUBLE AS is_weekend,
       (isodow(s.stay_date) - 1)::DOUBLE AS day_of_week,
       CASE WHEN k.holiday_name IS NOT NULL THEN 1.0 ELSE 0.0 END::DOUBLE AS holiday_flag,
       k.holiday_name, k.holiday_proximity,
       coalesce(g.local_event_score, 0) AS local_event_score,
       coalesce(g.weather_score, 0.5::DOUBLE) AS weather_score,
       {season('s.stay_date')} AS season,
       CASE WHEN m.competitor_rate IS NULL THEN 1.0 ELSE 0.0 END::DOUBLE AS competitor_missing
FROM skeleton s JOIN book b USING (hotel_id, room_type, stay_date)
JOIN history y USING (hotel_id, room_type, stay_date)
LEFT JOIN market m USING (hotel_id, room_type, stay_date)
LEFT JOIN signals g USING (hotel_id, room_type, stay_date)
LEFT JOIN calendar k ON k.day = s.stay_date
""",
    "skeleton",
    "book",
    "history",
    "market",
    "signals",
    "calendar",
)


def derived(source: str) -> str:
    """Ratios and interactions over a relation with the base columns."""
    return f"""
SELECT *, CASE WHEN season = 'winter' THEN 1.0 ELSE 0.0 END::DOUBLE AS season_winter,
       CASE WHEN season = 'summer' THEN 1.0 ELSE 0.0 END::DOUBLE AS season_summer,
       CASE WHEN season = 'monsoon' THEN 1.0 ELSE 0.0 END::DOUBLE AS season_monsoon,
       CASE WHEN season = 'autumn' THEN 1.0 ELSE 0.0 END::DOUBLE AS season_autumn,
       {clip("coalesce(current_room_price / nullif(competitor_rate, 0), 1)", 0.2, 5)}
         AS price_to_competitor,
       {clip("coalesce((competitor_max_rate - competitor_min_rate) / nullif(competitor_rate, 0), 0)", 0, 2)}
         AS competitor_spread,
       booking_count / 7.0::DOUBLE AS pickup_velocity,
       occupancy_rate * (1.0::DOUBLE - days_to_checkin / 60.0::DOUBLE) AS occupancy_x_lead,
       search_demand * (1.0::DOUBLE + local_event_score) AS demand_pressure
FROM {source}
"""


cte("matrix", derived("joined"), "joined")
