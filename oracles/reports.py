"""Statements of the report family."""

import oracles.models  # noqa: F401
from nightledger.config import FEATURES
from oracles.base import compose, cte, season
from oracles.forecast_ctes import forecast

SQL: dict[str, str] = {}
GRAIN = "hotel_id, room_type, stay_date"

cte(
    "kpis",
    """
SELECT hotel_id, round(sold / (560.0 * nights), 4) AS occupancy, round(revenue / sold, 2) AS adr,
       round(sold / (560.0::DOUBLE * nights) * (revenue / sold), 2) AS revpar
FROM (SELECT hotel_id, sum(booking_count - cancellation_count)::DOUBLE AS sold, sum(revenue) AS revenue,
             count(DISTINCT check_in_date) AS nights
      FROM bookings JOIN (SELECT hotel_id, max(check_in_date) AS e FROM bookings GROUP BY 1)
        USING (hotel_id)
      WHERE check_in_date > e - 30 GROUP BY hotel_id)
WHERE sold <> 0 AND hotel_id IN (SELECT hotel_id FROM hotels)
""",
    "bookings",
    "hotels",
)
cte(
    "audit",
    f"""
SELECT md5(hotel_id || '|' || room_type || '|' || stay_date::VARCHAR) AS prediction_id, hotel_id,
       room_type, stay_date AS check_in_date, final_price, price_change_percent, rules,
       CASE WHEN isfinite(blended_demand) THEN blended_demand END AS blended_demand, confidence,
       (20 + dayofyear(stay_date) % 15)::DOUBLE AS latency_ms,
       TIMESTAMP '2025-12-01' - to_minutes(dayofyear(stay_date) * 7 % 1000) AS created_at
FROM guarded_grid WHERE pricing_error IS NULL
""",
    "guarded_grid",
)
cte(
    "facts",
    f"""
SELECT s.*, s.sold / r.room_count AS occupancy, s.revenue / nullif(s.sold, 0) AS adr, h.city, h.segment,
       (isodow(stay_date) - 1)::INT AS dow, month(stay_date)::INT AS month,
       isodow(stay_date) >= 6 AS is_weekend, m.competitor_rate, m.competitor_min, m.competitor_max,
       m.competitor_count, g.search_demand, g.local_event_score
FROM (SELECT hotel_id, room_type, check_in_date AS stay_date,
             sum(booking_count - cancellation_count)::BIGINT AS sold, sum(revenue) AS revenue
      FROM bookings GROUP BY 1, 2, 3) s
JOIN rooms r USING (hotel_id, room_type) JOIN hotels h USING (hotel_id)
LEFT JOIN (SELECT hotel_id, room_type, check_in_date AS stay_date, avg(price) AS competitor_rate,
                  min(price) AS competitor_min, max(price) AS competitor_max, count(*) AS competitor_count
           FROM rates GROUP BY 1, 2, 3) m USING (hotel_id, room_type, stay_date)
LEFT JOIN signals g USING (hotel_id, room_type, stay_date)
""",
    "bookings",
    "rooms",
    "hotels",
    "rates",
    "signals",
)

SQL["f1_hotel_list"] = compose(
    "SELECT * FROM hotels WHERE lower(city) = 'mumbai' AND is_active ORDER BY hotel_id LIMIT 500",
    "hotels",
)
SQL["f2_hotel_detail"] = compose(
    """
SELECT h.hotel_id, h.city, h.star_rating, r.rooms, k.occupancy, k.adr, k.revpar
FROM hotels h LEFT JOIN (
  SELECT hotel_id, string_agg(room_type || ':' || room_count::VARCHAR, ',' ORDER BY base_price) AS rooms
  FROM rooms GROUP BY 1) r USING (hotel_id) LEFT JOIN kpis k USING (hotel_id)
""",
    "hotels",
    "rooms",
    "kpis",
)
SQL["f3_training_rows"] = compose(
    f"""SELECT {GRAIN}, 'v1' AS feature_version, round(target_demand, 9) AS target_demand FROM matrix
    WHERE stay_date BETWEEN DATE '2025-03-01' AND DATE '2025-09-30'""",
    "matrix",
)
SQL["f5_rate_listing"] = compose(
    """
SELECT event_id, competitor, room_type, check_in_date, price, is_available FROM rates
WHERE hotel_id = 'H0000' AND check_in_date BETWEEN DATE '2025-06-01' AND DATE '2025-07-01'

""",
    "rates",
)
SQL["f6_pricing_history"] = compose(
    """
SELECT prediction_id, room_type, check_in_date, final_price AS final_recommended_price,
       round(price_change_percent, 8) AS price_change_percent, blended_demand, confidence
FROM audit WHERE hotel_id = 'H0000'
""",
    "audit",
)
SQL["f7_reference_check"] = compose(
    """
, asked_for AS (
  SELECT DISTINCT CASE WHEN lead_time_days = 13 THEN 'X' || hotel_id ELSE hotel_id END AS hotel_id,
         CASE WHEN lead_time_days = 17 THEN 'penthouse' ELSE room_type END AS room_type FROM bookings)
SELECT a.hotel_id, a.room_type,
       CASE WHEN a.hotel_id NOT IN (SELECT hotel_id FROM hotels) THEN 'unknown_hotel' ELSE 'room_not_sold' END
         AS rejected_reason,
       (SELECT string_agg(DISTINCT room_type, ',' ORDER BY room_type) FROM rooms r
        WHERE r.hotel_id = a.hotel_id) AS sells
FROM asked_for a
WHERE NOT EXISTS (SELECT 1 FROM rooms r WHERE r.hotel_id = a.hotel_id AND r.room_type = a.room_type)
""",
    "bookings",
    "hotels",
    "rooms",
)
SQL["f8_request_constraints"] = compose(
    """
SELECT CASE WHEN date_diff('day', DATE '2025-12-01', d) > 365 THEN 'too_far_ahead'
            WHEN date_diff('day', DATE '2025-12-01', d) < -365 THEN 'too_far_back'
            WHEN lead_time_days % 11 = 0 OR adr > 1e6 THEN 'current_price_out_of_range'
            WHEN adr * (1 + lead_time_days % 3) > adr * 2 THEN 'competitor_band_inverted'
            WHEN lead_time_days / 80.0 > 1 THEN 'occupancy_out_of_range' END AS rejected_reason,
       count(*) AS n
FROM (SELECT *, check_in_date + CASE WHEN lead_time_days % 9 = 0 THEN 700 ELSE 0 END AS d FROM bookings)
GROUP BY 1
""",
    "bookings",
)
SQL["s1_raw_frames"] = compose(
    " UNION ALL ".join(
        f"SELECT '{label}' AS table_name, count(*) AS n, count(DISTINCT hotel_id) AS hotels FROM {name}"
        for label, name in (
            ("rooms", "rooms"), ("hotels", "hotels"), ("bookings", "bookings"),
            ("competitor_prices", "rates"), ("demand_signals", "signals"),
        )
    ),
    "rooms", "hotels", "bookings", "rates", "signals",
)
SQL["s2_csv_read"] = compose(
    """
SELECT CASE WHEN channel <> 'walk_in' THEN channel END AS channel, count(*) AS n,
       min(booking_date) AS first_booking, max(check_out_date) AS last_check_out, sum(revenue) AS revenue
FROM bookings GROUP BY 1
""",
    "bookings",
)
SQL["s6_load_report"] = compose(
    """
SELECT 'rows:hotels' AS item, count(*) AS value FROM hotels
UNION ALL SELECT 'rows:rooms', count(*) FROM rooms
UNION ALL SELECT 'rows:bookings', count(*) FROM bookings
UNION ALL SELECT 'rooms without a hotel', count(*) FROM rooms WHERE hotel_id NOT IN (SELECT hotel_id FROM hotels)
UNION ALL SELECT 'hotels without rooms', count(*) FROM hotels
  WHERE hotel_id NOT IN (SELECT hotel_id FROM rooms)
""",
    "hotels",
    "rooms",
    "bookings",
)
SQL["s11_collection_plan"] = compose(
    """
SELECT hotel_id, city, (DATE '2025-12-01' + h)::DATE AS check_in_date, 4::BIGINT AS look_ups
FROM hotels, (SELECT unnest([1, 7, 14, 30]) AS h)
""",
    "hotels",
)
SQL["s11_collection_budget"] = compose(
    """
SELECT count(*) * 16 AS planned, (count(*) * 32)::DOUBLE AS seconds, count(*) * 16 > 400 AS too_many_requests,
       count(*) * 32 > 300 AS too_slow FROM hotels
""",
    "hotels",
)
SQL["x16_owned_upsert"] = compose(
    f"""
SELECT {GRAIN}, coalesce(g.search_demand, m.search_demand) AS search_demand,
       coalesce(g.weather_score, m.weather_score) AS weather_score,
       coalesce(g.local_event_score, m.local_event_score) AS local_event_score,
       round(m.occupancy_rate, 9) AS occupancy_rate, round(m.target_demand, 9) AS target_demand,
       m.holiday_flag::INT AS holiday_flag
FROM signals g FULL OUTER JOIN matrix m USING (hotel_id, room_type, stay_date)
""",
    "signals",
    "matrix",
)
SQL["c13_integrity_rules"] = compose(
    """
SELECT rule, n AS broken_rows FROM (
  SELECT 'bookings not negative' AS rule, count(*) FILTER (booking_count < 0) AS n FROM bookings
  UNION ALL SELECT 'cancellations within bookings', count(*) FILTER (lead_time_days = 5) FROM bookings
  UNION ALL SELECT 'revenue not negative', count(*) FILTER (revenue < 0) FROM bookings
  UNION ALL SELECT 'adr not negative', count(*) FILTER (adr < 0) FROM bookings
  UNION ALL SELECT 'check-out after check-in', count(*) FILTER (lead_time_days = 6) FROM bookings
  UNION ALL SELECT 'booked before check-in', count(*) FILTER (booking_date > check_in_date) FROM bookings
  UNION ALL SELECT 'lead not negative', count(*) FILTER (lead_time_days < 0) FROM bookings)
""",
    "bookings",
)
SQL["a4_trading_kpis"] = compose("SELECT * FROM kpis", "kpis")
SQL["a5_estate_overview"] = compose(
    """
SELECT count(*) AS hotels, sum(total_rooms)::BIGINT AS rooms, count(DISTINCT city) AS cities,
       round(avg(occupancy), 6) AS occupancy, round(avg(adr), 4) AS adr, round(avg(revpar), 4) AS revpar
FROM hotels LEFT JOIN kpis USING (hotel_id)
""",
    "hotels",
    "kpis",
)
cte(
    "market_all",
    f"""
SELECT hotel_id, room_type, check_in_date AS stay_date, avg(price) AS competitor_rate,
       min(price) AS competitor_min_rate, max(price) AS competitor_max_rate,
       count(*)::DOUBLE AS competitor_count, (max(price) - min(price)) / avg(price) * 100 AS spread_percent
FROM (SELECT * FROM rates QUALIFY row_number() OVER (
        PARTITION BY hotel_id, room_type, check_in_date, competitor ORDER BY collected_at DESC, price) = 1)
GROUP BY 1, 2, 3
""",
    "rates",
)
SQL["a6_market_summary"] = compose(
    """
SELECT * REPLACE (round(competitor_rate, 6) AS competitor_rate, round(spread_percent, 6) AS spread_percent)
FROM market_all
""",
    "market_all",
)
SQL["a7_market_kpis"] = compose(
    """
SELECT hotel_id, room_type, count(*) AS nights, round(avg(competitor_rate), 4) AS market_average,
       min(competitor_min_rate) AS cheapest, max(competitor_max_rate) AS dearest,
       round(avg(spread_percent), 6) AS mean_spread,
       round(avg((competitor_rate < base_price)::INT), 6) AS share_above_market
FROM market_all JOIN rooms USING (hotel_id, room_type) GROUP BY 1, 2
""",
    "market_all",
    "rooms",
)
SQL["a8_source_summary"] = compose(
    """
SELECT competitor, round(avg(price), 4) AS rate, count(*) AS observations,
       round(avg(is_available::INT), 6) AS available FROM rates GROUP BY 1
""",
    "rates",
)
SQL["a9_price_spread"] = compose(
    """
SELECT competitor, min(price) AS lowest, quantile_cont(price, 0.25) AS lower_quartile,
       quantile_cont(price, 0.5) AS median, quantile_cont(price, 0.75) AS upper_quartile,
       max(price) AS highest FROM rates GROUP BY 1
""",
    "rates",
)
cte(
    "month_ahead",
    forecast(
        "filled",
        "hotel_id, room_type",
        "SELECT hotel_id, room_type, day AS ds FROM filled_trend, days"
        " WHERE day BETWEEN DATE '2025-11-15' AND DATE '2025-12-14'",
    ),
    "filled_band",
    "days",
)
SQL["a10_weekly_shape"] = compose(
    """
SELECT hotel_id, room_type, (isodow(ds) - 1)::INT AS weekday, round(avg(forecast), 6) AS mean_forecast
FROM month_ahead GROUP BY 1, 2, 3
""",
    "month_ahead",
)
SQL["a10_forecast_extremes"] = compose(
    """
SELECT hotel_id, room_type, round(avg(f), 5) AS mean_demand, max(f) AS peak,
       (array_agg(ds ORDER BY f DESC, ds))[1] AS peak_date, min(f) AS trough,
       (array_agg(ds ORDER BY f, ds))[1] AS trough_date, round(avg(u - l), 5) AS mean_width
FROM (SELECT *, round(forecast, 6) AS f, round(forecast_lower, 6) AS l, round(forecast_upper, 6) AS u
      FROM month_ahead) GROUP BY 1, 2
""",
    "month_ahead",
)
SQL["a12_feed_status"] = compose(
    """
SELECT source, count(*) AS rows,
       count(*) FILTER (collected_at >= TIMESTAMP '2025-11-30 23:30:00') AS last_hour,
       max(collected_at)::DATE AS newest FROM rates
WHERE collected_at <= TIMESTAMP '2025-12-01 00:30:00' GROUP BY 1
""",
    "rates",
)
SQL["a13_feature_coverage"] = compose(
    """
SELECT count(*) AS rows, count(*) FILTER (room_type <> 'suite') AS computed,
       count(*) FILTER (days_to_checkin < 30) AS labelled, min(stay_date) AS first_stay_date,
       max(stay_date) AS last_stay_date,
       round(count(*) FILTER (room_type <> 'suite') / count(*), 4) AS coverage FROM matrix
""",
    "matrix",
)
SQL["a14_dataset_summary"] = compose(
    """
SELECT hotel_id, count(DISTINCT check_in_date) AS nights, count(*) AS rows,
       sum(booking_count)::BIGINT AS rooms_booked,
       sum(booking_count - cancellation_count)::BIGINT AS rooms_sold,
       sum(cancellation_count)::BIGINT AS cancellations, sum(revenue) AS revenue,
       round(avg(lead_time_days), 3) AS mean_lead_time,
       round(sum(cancellation_count) / sum(booking_count), 3) AS cancellation_rate,
       round(sum(revenue) / sum(booking_count - cancellation_count), 3) AS adr
FROM bookings GROUP BY 1
""",
    "bookings",
)
SQL["a15_matrix_summary"] = compose(
    """
SELECT count(*) AS rows, count(DISTINCT hotel_id) AS hotels, count(DISTINCT stay_date) AS stay_dates,
       min(stay_date) AS first_night, max(stay_date) AS last_night,
       (SELECT string_agg(h::VARCHAR, ',' ORDER BY h)
        FROM (SELECT DISTINCT days_to_checkin::INT AS h FROM matrix)) AS horizons,
       round(avg(competitor_missing), 6) AS competitor_gap_share, round(avg(target_demand), 6) AS target_mean,
       round(stddev_samp(target_demand), 6) AS target_std
FROM matrix
""",
    "matrix",
)
_CORR = " UNION ALL ".join(
    f"SELECT '{f}' AS feature, corr({f}, target_demand) AS correlation FROM matrix" for f in FEATURES
)
SQL["a16_target_correlations"] = compose(
    f"""SELECT feature, round(correlation, 6) AS correlation FROM ({_CORR})
    WHERE correlation IS NOT NULL AND NOT isnan(correlation)""",
    "matrix",
)
SQL["a17_grouped_correlation"] = compose(
    """
SELECT round(min(r), 6) AS lowest, round(quantile_cont(r, 0.5), 6) AS median, round(max(r), 6) AS highest
FROM (SELECT corr(occupancy, adr) AS r FROM facts GROUP BY hotel_id, room_type) WHERE r IS NOT NULL
""",
    "facts",
)
SQL["a18_cancellation_by_lead"] = compose(
    """
SELECT CASE WHEN lead_time_days <= 7 THEN '0-7' WHEN lead_time_days <= 30 THEN '8-30'
            WHEN lead_time_days <= 60 THEN '31-60' ELSE '61-90' END AS lead_bucket,
       round(sum(cancellation_count) / sum(booking_count), 9) AS cancellation_rate
FROM bookings WHERE lead_time_days <= 90 GROUP BY 1
""",
    "bookings",
)
SQL["a19_lead_by_segment"] = compose(
    """
SELECT segment, round(sum(lead_time_days * booking_count) / sum(booking_count), 6) AS mean_lead
FROM bookings JOIN hotels USING (hotel_id) GROUP BY 1
""",
    "bookings",
    "hotels",
)
_BAND = """CASE WHEN local_event_score < 0.1 THEN 'quiet' WHEN local_event_score > 0.5 THEN 'busy'
     ELSE 'between' END"""
SQL["a19_lead_by_event_band"] = compose(
    f"""
SELECT {_BAND} AS band, round(sum(lead_time_days * booking_count) / sum(booking_count), 6) AS mean_lead
FROM bookings b JOIN signals g ON b.hotel_id = g.hotel_id AND b.room_type = g.room_type
  AND b.check_in_date = g.stay_date GROUP BY 1
""",
    "bookings",
    "signals",
)
for name, keys in {
    "a20_occupancy_by_segment_weekend": "segment, is_weekend",
    "a20_occupancy_by_city_season": f"city, {season('stay_date')} AS season",
    "a20_occupancy_by_event_band": f"{_BAND} AS band",
}.items():
    SQL[name] = compose(
        f"SELECT {keys}, round(avg(occupancy), 6) AS mean_occupancy FROM facts GROUP BY ALL", "facts"
    )
SQL["a20_monthly_range"] = compose(
    """
SELECT city, room_type, round(max(m) - min(m), 6) AS peak_to_trough
FROM (SELECT city, room_type, month, avg(occupancy) AS m FROM facts GROUP BY 1, 2, 3) GROUP BY 1, 2
""",
    "facts",
)
SQL["a21_observation_coverage"] = compose(
    """
SELECT count(*) AS observed, (SELECT count(*) * 365 * 4 * 8 FROM rooms) AS possible,
       round(count(*) / (SELECT count(*) * 365 * 4 * 8 FROM rooms), 9) AS coverage FROM rates
""",
    "rates",
    "rooms",
)
SQL["a21_median_spread"] = compose(
    """
SELECT round(quantile_cont((competitor_max - competitor_min) / competitor_rate, 0.5), 6) AS median_spread
FROM facts WHERE competitor_min IS NOT NULL
""",
    "facts",
)
SQL["a22_nightly_facts"] = compose(
    f"""
SELECT {GRAIN}, city, segment, sold, revenue, round(occupancy, 9) AS occupancy, round(adr, 6) AS adr, dow,
       month, round(competitor_rate, 6) AS competitor_rate, competitor_min, competitor_max,
       competitor_count, search_demand FROM facts
""",
    "facts",
)
SQL["a23_price_histogram"] = compose(
    """
SELECT least(floor((price - lo) / ((hi - lo) / 30.0::DOUBLE))::INT + 1, 30) AS bin, count(*) AS n,
       round(max(mean), 4) AS mean
FROM rates, (SELECT min(price) AS lo, max(price) AS hi, avg(price) AS mean FROM rates) GROUP BY 1
""",
    "rates",
)
SQL["a24_decision_kpis"] = compose(
    """
SELECT hotel_id, count(*) AS decisions, round(avg(final_price), 4) AS mean_final,
       round(avg(price_change_percent), 6) AS mean_change, round(avg((rules <> '')::INT), 9) AS clamped_share
FROM guarded_grid WHERE pricing_error IS NULL GROUP BY 1
""",
    "guarded_grid",
)
SQL["a25_guardrail_counts"] = compose(
    """
SELECT rule, count(*) AS n FROM (SELECT unnest(string_split(rules, ',')) AS rule FROM guarded_grid
                                 WHERE pricing_error IS NULL AND rules <> '') GROUP BY 1
""",
    "guarded_grid",
)
SQL["w6_recent_decisions"] = compose(
    """
SELECT prediction_id, final_price AS final_recommended_price FROM audit
ORDER BY created_at DESC, prediction_id LIMIT 5000
""",
    "audit",
)
SQL["a5_revpar_ranking"] = compose(
    """
SELECT rank() OVER (ORDER BY revpar DESC)::INT AS place, hotel_id, city, revpar FROM hotels JOIN kpis USING (hotel_id)
""",
    "hotels",
    "kpis",
)
_LOADED = ("hotels", "rooms", "bookings", "competitor_prices", "demand_signals")
SQL["s2_csv_tables"] = compose(
    " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, count(*) AS n, count(DISTINCT hotel_id) AS hotels FROM {c}"
        for t, c in zip(_LOADED, ("hotels", "rooms", "bookings", "rates", "signals"))
    ),
    "hotels", "rooms", "bookings", "rates", "signals",
)
SQL["s3_csv_write"] = compose("SELECT count(*) AS rows, count(hotel_id) AS named FROM matrix", "matrix")
SQL["s5_bulk_load"] = SQL["s6_load_report"]
SQL["s4_aligned_frame"] = compose("SELECT * REPLACE (revenue::DECIMAL(12,2) AS revenue, adr::DECIMAL(12,2) AS adr) FROM bookings", "bookings")
SQL["s9_json_report"] = SQL["a15_matrix_summary"]


def _broken(table: str, source: str, rules: dict[str, str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{table}' AS table_name, '{rule}' AS rule, count(*) FILTER ({test}) AS broken_rows FROM {source}"
        for rule, test in rules.items()
    )


_NUMBER = "substr(hotel_id, 2)::INT"
SQL["c13_integrity_of_all_tables"] = compose(
    " UNION ALL ".join(
        [
            _broken("hotels", "hotels", {
                "star rating 1..5": f"{_NUMBER} % 3 = 0", "rooms above zero": f"{_NUMBER} % 4 = 1"}),
            _broken("rooms", "rooms", {
                "known room type": f"{_NUMBER} % 5 = 0", "room count above zero": "room_count <= 0",
                "base price above zero": f"{_NUMBER} % 7 = 2", "capacity above zero": "false",
                "floor below ceiling": f"{_NUMBER} % 2 = 0"}),
            _broken("competitor_prices", "rates", {
                "known competitor": "event_id::BIGINT % 11 = 0", "price above zero": "event_id::BIGINT % 13 = 0"}),
            _broken("demand_features", "matrix", {
                "weekday 0..6": "false", "occupancy 0..1": "day_of_week = 6",
                "target not negative": "day_of_week = 2", "available not negative": "available_rooms < 0"}),
        ]
    ),
    "hotels", "rooms", "rates", "matrix",
)
