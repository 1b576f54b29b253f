"""Statements of the streaming and text families."""

import oracles.features  # noqa: F401
from nightledger.functions import text as X
from oracles.base import compose, cte, season

SQL: dict[str, str] = {}

# What each message should turn into, told from the row it was made of.
cte(
    "fates",
    """
SELECT 'booking' AS kind, CASE WHEN lead_time_days <> 10 THEN event_id END AS event_id,
  CASE WHEN lead_time_days = 11 THEN 'X9' ELSE hotel_id END AS hotel_id,
  CASE WHEN lead_time_days IN (3, 9) THEN NULL WHEN lead_time_days = 6 THEN 'mystery' ELSE 'booking' END
    AS event_type,
  CASE lead_time_days WHEN 3 THEN 'not_an_object' WHEN 9 THEN 'not_an_object'
    WHEN 4 THEN 'unknown_envelope_field' WHEN 5 THEN 'unsupported_version'
    WHEN 6 THEN 'unknown_event_type' END AS envelope_poison,
  CASE lead_time_days WHEN 7 THEN 'cancelled_more_than_booked' WHEN 8 THEN 'stay_not_positive'
    WHEN 12 THEN 'unknown_room_type_value' END AS payload_poison,
  CASE WHEN lead_time_days = 11 THEN 'unknown_hotel'
       WHEN hotel_id = 'H0003' AND room_type = 'suite' THEN 'unknown_room_type' END AS rejected
FROM bookings
UNION ALL
SELECT 'rate', event_id, hotel_id, 'competitor_price', NULL,
  CASE WHEN event_id::BIGINT % 13 = 0 THEN 'price_out_of_range' END,
  CASE WHEN hotel_id NOT IN (SELECT hotel_id FROM hotels) THEN 'unknown_hotel'
       WHEN hotel_id = 'H0003' AND room_type = 'suite' THEN 'unknown_room_type' END
FROM rates
UNION ALL
SELECT 'signal', 's' || event_id, hotel_id, 'demand_signal', NULL, NULL,
  CASE WHEN hotel_id NOT IN (SELECT hotel_id FROM hotels) THEN 'unknown_hotel'
       WHEN hotel_id = 'H0003' AND room_type = 'suite' THEN 'unknown_room_type' END
FROM rates
""",
    "bookings",
    "rates",
    "hotels",
)
cte(
    "judged",
    "SELECT *, coalesce(envelope_poison, payload_poison) AS poison FROM fates",
    "fates",
)
SQL["t1_decoded_envelopes"] = compose(
    "SELECT event_type, envelope_poison AS poison, count(*) AS n FROM fates GROUP BY 1, 2", "fates"
)
SQL["t2_poison_routing"] = compose(
    """SELECT CASE WHEN poison IS NULL THEN 'valid' ELSE 'dead_letter' END AS route, count(*) AS n
    FROM judged GROUP BY 1""",
    "judged",
)
SQL["t3_payload_rules"] = compose("SELECT poison, count(*) AS n FROM judged GROUP BY 1", "judged")
SQL["t4_event_times"] = compose(
    """
SELECT event_id, strftime(collected_at + to_seconds(event_id::BIGINT % 80000), '%Y-%m-%d %H:%M:%S') AS event_time
FROM rates
""",
    "rates",
)
SQL["t5_reference_rules"] = compose(
    "SELECT event_type, rejected, count(*) AS n FROM judged WHERE poison IS NULL GROUP BY 1, 2", "judged"
)
SQL["j12_stream_static_join"] = compose(
    """SELECT hotel_id, rejected, count(*) AS n FROM judged
    WHERE poison IS NULL AND event_type = 'booking' GROUP BY 1, 2""",
    "judged",
)
SQL["t6_routed_events"] = compose(
    """
SELECT CASE kind WHEN 'booking' THEN 'bookings' WHEN 'rate' THEN 'competitor_prices' ELSE 'demand_signals' END
  AS handler, count(*) AS n FROM judged WHERE poison IS NULL AND rejected IS NULL GROUP BY 1
""",
    "judged",
)
SQL["t7_idempotent_append"] = compose(
    """
SELECT DISTINCT event_id, 1::BIGINT AS n FROM judged
WHERE poison IS NULL AND rejected IS NULL AND kind = 'booking' AND event_id IS NOT NULL
UNION ALL SELECT * FROM (SELECT 'made up', count(*) AS n FROM judged
WHERE poison IS NULL AND rejected IS NULL AND kind = 'booking' AND event_id IS NULL) WHERE n > 0
""",
    "judged",
)
SQL["t8_latest_signals"] = compose(
    f"""
SELECT hotel_id, room_type, check_in_date AS stay_date, max(k) % 10 / 10.0::DOUBLE AS search_demand,
       max(k) % 7 / 10.0::DOUBLE AS weather_score, max(k) % 5 / 10.0::DOUBLE AS local_event_score,
       {season('check_in_date')} AS season, (isodow(check_in_date) - 1)::INT AS day_of_week,
       isodow(check_in_date) >= 6 AS is_weekend, false AS holiday_flag
FROM (SELECT *, event_id::BIGINT AS k FROM rates)
WHERE hotel_id IN (SELECT hotel_id FROM hotels) AND NOT (hotel_id = 'H0003' AND room_type = 'suite')
GROUP BY hotel_id, room_type, check_in_date
""",
    "rates",
    "hotels",
)
cte(
    "last_signals",
    f"""
SELECT hotel_id, room_type, check_in_date AS stay_date, max(k) % 10 / 10.0::DOUBLE AS search_demand,
       max(k) % 7 / 10.0::DOUBLE AS weather_score, max(k) % 5 / 10.0::DOUBLE AS local_event_score,
       {season('check_in_date')} AS season, (isodow(check_in_date) - 1)::INT AS day_of_week,
       isodow(check_in_date) >= 6 AS is_weekend
FROM (SELECT *, event_id::BIGINT AS k FROM rates)
WHERE hotel_id IN (SELECT hotel_id FROM hotels) AND NOT (hotel_id = 'H0003' AND room_type = 'suite')
GROUP BY hotel_id, room_type, check_in_date
""",
    "rates",
    "hotels",
)
SQL["t8_stored_features"] = compose(
    """
SELECT hotel_id, room_type, stay_date,
  round(CASE WHEN s.season IS NULL THEN m.local_event_score ELSE s.local_event_score END, 9) AS local_event_score,
  round(CASE WHEN s.season IS NULL THEN m.weather_score ELSE s.weather_score END, 9) AS weather_score,
  round(CASE WHEN s.season IS NULL THEN m.search_demand ELSE s.search_demand END, 9) AS search_demand,
  CASE WHEN s.season IS NULL THEN m.holiday_flag = 1 ELSE false END AS holiday_flag,
  CASE WHEN s.season IS NULL THEN m.holiday_name END AS holiday_name,
  CASE WHEN m.season IS NULL THEN s.day_of_week::BIGINT ELSE round_even(m.day_of_week, 0)::BIGINT END AS day_of_week,
  CASE WHEN m.season IS NULL THEN s.is_weekend ELSE m.is_weekend = 1 END AS is_weekend,
  coalesce(m.season, s.season) AS season,
  round_even(m.booking_count, 0)::BIGINT AS booking_count,
  round_even(m.competitor_count, 0)::BIGINT AS competitor_count,
  round(m.occupancy_rate, 9) AS occupancy_rate, round(m.historical_demand, 9) AS historical_demand,
  round(m.competitor_rate, 9) AS competitor_rate, round(m.target_demand, 9) AS target_demand,
  CASE WHEN m.season IS NOT NULL THEN 'v1' END AS feature_version
FROM matrix m FULL OUTER JOIN last_signals s USING (hotel_id, room_type, stay_date)
""",
    "matrix",
    "last_signals",
)
SQL["t12_service_counters"] = compose(
    """
, served AS (SELECT competitor, event_id::BIGINT AS k FROM rates)
SELECT 'observations' AS counter, competitor AS label, count(*) AS n FROM served WHERE k % 4 <> 0 GROUP BY 2
UNION ALL SELECT 'decisions', (k % 3 <> 0)::VARCHAR, count(*) FROM served WHERE k % 4 = 0 GROUP BY 2
UNION ALL SELECT 'guardrail_hits', 'MAX_DAILY_RISE', count(*) FROM served WHERE k % 20 = 0 HAVING count(*) > 0
UNION ALL SELECT 'guardrail_hits', 'ROOM_FLOOR', count(*) FROM served WHERE k % 28 = 0 HAVING count(*) > 0
""",
    "rates",
)
SQL["t11_send_outcomes"] = compose(
    """
SELECT hotel_id AS key, outcome,
  CASE outcome WHEN 'dropped' THEN 'no value' WHEN 'failed' THEN 'ConnectionError: refused' END AS error, count(*) AS n
FROM (SELECT hotel_id, CASE WHEN event_id::BIGINT % 11 = 0 THEN 'dropped'
        WHEN event_id::BIGINT % 17 = 0 THEN 'failed' ELSE 'sent' END AS outcome FROM rates)
GROUP BY 1, 2
""",
    "rates",
)
SQL["t9_batch_counters"] = compose(
    """
, ok AS (SELECT * FROM judged WHERE poison IS NULL AND rejected IS NULL)
SELECT outcome, reason, n::BIGINT AS n FROM (
  SELECT 'polled' AS outcome, 'all' AS reason, count(*) AS n FROM judged
  UNION ALL SELECT 'poison', poison, count(*) FROM judged WHERE poison IS NOT NULL GROUP BY 2
  UNION ALL SELECT 'rejected', rejected, count(*) FROM judged
    WHERE poison IS NULL AND rejected IS NOT NULL GROUP BY 2
  UNION ALL SELECT 'written', 'bookings', count(DISTINCT event_id) + count(*) FILTER (event_id IS NULL)
    FROM ok WHERE kind = 'booking'
  UNION ALL SELECT 'duplicate', 'bookings', count(event_id) - count(DISTINCT event_id)
    FROM ok WHERE kind = 'booking'
  UNION ALL SELECT 'written', 'competitor_prices', count(DISTINCT event_id) FROM ok WHERE kind = 'rate'
  UNION ALL SELECT 'duplicate', 'competitor_prices', count(*) - count(DISTINCT event_id)
    FROM ok WHERE kind = 'rate'
  UNION ALL SELECT 'written', 'demand_signals', count(*) FROM ok WHERE kind = 'signal')
""",
    "judged",
)
SQL["t10_replayed_stream"] = compose(
    """
SELECT 'bookings' AS table_name, count(DISTINCT event_id) + 2 * count(*) FILTER (event_id IS NULL) AS n FROM judged
  WHERE poison IS NULL AND rejected IS NULL AND kind = 'booking'
UNION ALL SELECT 'competitor_prices', count(DISTINCT event_id) FROM judged
  WHERE poison IS NULL AND rejected IS NULL AND kind = 'rate'
UNION ALL SELECT 'demand_signals', count(*) FROM (
  SELECT DISTINCT hotel_id, room_type, check_in_date FROM rates
  WHERE hotel_id IN (SELECT hotel_id FROM hotels) AND NOT (hotel_id = 'H0003' AND room_type = 'suite'))
""",
    "judged",
    "rates",
    "hotels",
)
SQL["t11_published_messages"] = compose(
    "SELECT hotel_id AS key, count(*) AS n FROM rates GROUP BY 1", "rates"
)
SQL["t12_running_counters"] = compose(
    """SELECT source, CASE WHEN event_id::BIGINT % 13 = 0 THEN 'price_out_of_range' END AS poison,
    count(*) AS n FROM rates GROUP BY 1, 2""",
    "rates",
)
SQL["t7_stream_deduplication"] = compose("SELECT DISTINCT 's' || event_id AS event_id FROM rates", "rates")

# --- text ---------------------------------------------------------------------------------

cte(
    "texts",
    """
SELECT event_id, k, hotel_id, room_type, check_in_date,
  CASE WHEN is_available AND k % 5 <> 3 THEN price END AS price, is_available,
  (['suite', NULL, 'deluxe', NULL, 'premium', 'standard'])[(k % 6 + 1)::INT] AS named,
  (1 + k % 3)::INT AS nights
FROM (SELECT *, event_id::BIGINT AS k FROM rates)
""",
    "rates",
)
SQL["k8_price_strings"] = compose("SELECT event_id, price FROM texts", "texts")
_RX = X.PRICE.replace("'", "''")
SQL["k8_page_prices"] = f"""
SELECT page_id, CASE WHEN v > 0 THEN v END AS price
FROM (SELECT page_id, try_cast(rtrim(regexp_replace(regexp_extract(html, '{_RX}', 1), '{X.SEPARATORS}', '', 'g'), '.')
                               AS DOUBLE) AS v FROM pages)
"""
SQL["k9_room_names"] = compose(
    """
SELECT event_id, CASE k % 6 WHEN 1 THEN 'standard' ELSE named END AS site_room,
       CASE k % 6 WHEN 1 THEN 'premium' ELSE named END AS portal_room
FROM texts
""",
    "texts",
)
SQL["k11_nightly_prices"] = compose(
    "SELECT event_id, CASE WHEN nights <= 1 OR k % 5 IN (1, 4) THEN price END AS price FROM texts", "texts"
)
cte(
    "cards",
    """
SELECT hotel_id || '|' || room_type || '|' || check_in_date::VARCHAR || '|' || (k // 4096)::VARCHAR AS page_id,
  room_type, (row_number() OVER (PARTITION BY hotel_id, room_type, check_in_date, k // 4096 ORDER BY k) - 1)::INT
    AS position,
  price, CASE k % 6 WHEN 1 THEN 'standard' ELSE named END AS card_room,
  dayofyear(check_in_date) % 9 = 0 AS odd
FROM texts
""",
    "texts",
)
SQL["k10_rate_cards"] = compose(
    """
SELECT page_id, position, (['booking', 'expedia', 'agoda', 'makemytrip'])[position % 4 + 1] AS competitor,
       price, card_room FROM cards WHERE NOT odd
""",
    "cards",
)
SQL["k10_page_report"] = compose(
    """
SELECT page_id, count(*) FILTER (NOT odd) AS cards,
       count(*) FILTER (NOT odd AND price IS NOT NULL AND card_room = room_type) AS rates,
       count(*) FILTER (NOT odd AND price IS NULL) AS sold_out, bool_and(odd) AS parse_failed
FROM cards GROUP BY 1
""",
    "cards",
)
_ROOM = " ".join(
    f"WHEN regexp_matches(lower(card), '{'|'.join(words)}') THEN '{room}'" for room, words in X.ROOM_WORDS["site"]
)
cte(
    "site_cards",
    f"""
SELECT page_id, position, card, CASE {_ROOM} END AS card_room, CASE WHEN v > 0 THEN v END AS price
FROM (SELECT *, try_cast(rtrim(regexp_replace(regexp_extract(card, '{_RX}', 1), '{X.SEPARATORS}', '', 'g'), '.')
                         AS DOUBLE) AS v
      FROM (SELECT page_id, unnest(c) AS card, unnest(range(len(c)))::INT AS position
            FROM (SELECT page_id, regexp_extract_all(html, '(?s)<p>(.*?)</p>', 1) AS c FROM pages)))
""",
)
SQL["k10_site_cards"] = compose(
    """
SELECT page_id, position, (['booking', 'expedia', 'agoda', 'makemytrip'])[position % 4 + 1] AS competitor,
       price, card_room FROM site_cards
""",
    "site_cards",
)
SQL["k10_site_report"] = compose(
    """
SELECT page_id, count(card) AS cards, count(*) FILTER (price IS NOT NULL AND card_room = 'standard') AS rates,
       count(*) FILTER (card IS NOT NULL AND price IS NULL) AS sold_out, count(card) = 0 AS parse_failed
FROM pages LEFT JOIN site_cards USING (page_id) GROUP BY 1
""",
    "site_cards",
)
_CREDENTIAL = X.CREDENTIAL.replace("'", "''")
SQL["k12_redacted_documents"] = f"""
SELECT doc_id, md5(t) AS digest, ((length(t) - length(replace(t, '{X.MASK}', ''))) / {len(X.MASK)})::INT AS masked
FROM (SELECT doc_id, regexp_replace(regexp_replace(text, '{_CREDENTIAL}', '\\1={X.MASK}', 'g'),
        '{X.ADDRESS_PASSWORD}', '://\\1:{X.MASK}@', 'g') AS t FROM documents)
"""
