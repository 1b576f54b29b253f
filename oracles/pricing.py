"""Statements of the pricing family."""

import oracles.features  # noqa: F401  (registers the request CTEs)
from nightledger.operators.pricing import REASONS
from oracles.base import compose, cte, season
from oracles.forecast_ctes import forecast

SQL: dict[str, str] = {}
GRAIN = "hotel_id, room_type, stay_date"
INF = "'Infinity'::DOUBLE"
NAN = "'NaN'::DOUBLE"

cte(
    "grid",
    f"""
SELECT {GRAIN}, CASE WHEN k % 97 = 0 THEN 0 ELSE base_price END::DOUBLE AS base_price,
  CASE WHEN k % 41 = 0 THEN 0 WHEN k % 4 <> 0 THEN base_price * (70 + k % 60) / 100 END::DOUBLE
    AS current_price,
  CASE WHEN k % 29 <> 0 THEN (k * 7 % 101) / 100.0::DOUBLE END AS occupancy_rate,
  (dayofyear(stay_date) % 45)::INT AS days_to_checkin,
  CASE WHEN k % 7 = 0 THEN NULL WHEN k % 31 = 0 THEN {NAN} ELSE base_price * (60 + k % 90) / 100 END
    AS competitor_rate,
  CASE WHEN k % 7 <> 0 THEN base_price * (60 + k % 90) / 100 * 90 / 100 END AS competitor_min_rate,
  CASE WHEN k % 11 = 0 THEN 0::DOUBLE WHEN k % 7 <> 0
       THEN base_price * (60 + k % 90) / 100 * 110 / 100 END AS competitor_max_rate,
  {season('stay_date')} AS season, isodow(stay_date) >= 6 AS is_weekend,
  holiday_name IS NOT NULL AS is_holiday, (k % 11) / 10.0::DOUBLE AS event_score,
  CASE WHEN k % 5 <> 0 THEN floor_price END AS floor_price,
  CASE WHEN k % 6 <> 0 THEN ceiling_price END AS ceiling_price,
  CASE WHEN k % 17 = 0 THEN NULL WHEN k % 19 = 0 THEN {NAN} WHEN k % 23 = 0 THEN {INF}
       ELSE (k * 13 % 160) / 100.0::DOUBLE END AS blended_demand,
  (k * 3 % 101) / 100.0::DOUBLE AS confidence
FROM (SELECT *, dayofyear(stay_date) * 3 + room_count + substr(hotel_id, 2)::INT * 5 AS k
      FROM requests) JOIN calendar ON day = stay_date
""",
    "requests",
    "calendar",
)


def adjusted(source: str) -> str:
    """The five adjustments and the raw price over a grid relation."""
    def lim(x: str, n: float) -> str:
        return f"greatest(-{n}::DOUBLE, least({n}::DOUBLE, {x}))"

    return f"""
SELECT *,
  CASE WHEN blended_demand IS NULL OR NOT isfinite(blended_demand) THEN 0.65::DOUBLE
       ELSE blended_demand END AS d,
  (d / 0.65::DOUBLE - 1.0::DOUBLE) * 0.6::DOUBLE AS demand_raw,
  {lim('demand_raw', 0.25)} AS demand_adjustment,
  CASE WHEN d > 0.65::DOUBLE * 1.05::DOUBLE THEN 'above'
       WHEN d < 0.65::DOUBLE * 0.95::DOUBLE THEN 'below' ELSE 'normal' END AS demand_band,
  coalesce(occupancy_rate, 0) AS o, least(greatest(days_to_checkin, 0), 21) / 21.0::DOUBLE AS t,
  CASE WHEN o >= 0.75::DOUBLE
         THEN 0.2::DOUBLE * ((o - 0.75::DOUBLE) / 0.25::DOUBLE) * (0.35::DOUBLE + 0.65::DOUBLE * t)
       WHEN o <= 0.4::DOUBLE THEN -0.2::DOUBLE * ((0.4::DOUBLE - o) / 0.4::DOUBLE) * (1.0::DOUBLE - t)
       ELSE 0.0::DOUBLE END AS occupancy_raw,
  {lim('occupancy_raw', 0.2)} AS occupancy_adjustment,
  CASE WHEN o >= 0.75::DOUBLE AND days_to_checkin >= 21 THEN 'selling early'
       WHEN o >= 0.75::DOUBLE THEN 'nearly full'
       WHEN o <= 0.4::DOUBLE AND days_to_checkin <= 5 THEN 'distressed'
       WHEN o <= 0.4::DOUBLE THEN 'behind with time left' ELSE 'on pace' END AS occupancy_band,
  CASE WHEN competitor_rate IS NULL THEN NULL WHEN isfinite(competitor_rate) THEN competitor_rate
       ELSE base_price END AS c,
  CASE WHEN c > 0 AND base_price > 0 THEN (c - base_price) / base_price END AS gap,
  coalesce(gap * 0.5::DOUBLE, 0) AS competitor_raw,
  {lim('competitor_raw', 0.15)} AS competitor_adjustment,
  CASE WHEN c IS NULL THEN 'unseen' WHEN gap IS NULL THEN 'unusable'
       WHEN gap > 0.02::DOUBLE THEN 'headroom' WHEN gap < -0.02::DOUBLE THEN 'exposed'
       ELSE 'level' END AS competitor_band,
  CASE season WHEN 'winter' THEN 0.06 WHEN 'autumn' THEN 0.05 WHEN 'summer' THEN -0.02
       WHEN 'monsoon' THEN -0.08 ELSE 0 END::DOUBLE AS season_adjustment,
  0.15::DOUBLE * (1.0::DOUBLE
    - (CASE WHEN event_score > 0.01::DOUBLE THEN 1.0::DOUBLE - event_score * 0.9::DOUBLE ELSE 1 END)
    * (CASE WHEN is_holiday THEN 0.5::DOUBLE ELSE 1 END)
    * (CASE WHEN is_weekend THEN 0.7::DOUBLE ELSE 1 END)) AS event_raw,
  {lim('event_raw', 0.15)} AS event_adjustment,
  greatest(0.5::DOUBLE, least(1.0::DOUBLE, 0.5::DOUBLE + 0.5::DOUBLE * confidence)) AS confidence_scale,
  (demand_adjustment + occupancy_adjustment + competitor_adjustment + season_adjustment
    + event_adjustment) * confidence_scale AS total_adjustment,
  CASE WHEN base_price > 0 THEN NULL ELSE 'base price is not positive' END AS pricing_error,
  CASE WHEN base_price > 0 THEN base_price * (1.0::DOUBLE + total_adjustment) END AS raw_price
FROM {source}
"""


_BROKEN = "(p0 IS NULL OR NOT isfinite(p0) OR p0 <= 0)"
# rule, condition, new price; {p} is the price before the rule
_RULES = [
    ("LOW_OCCUPANCY_RISE_BLOCK", "occupancy_rate < 0.4 AND {p} > current_price", "current_price"),
    ("MAX_DAILY_RISE", "current_price > 0 AND {p} > current_price * 1.15::DOUBLE",
     "current_price * 1.15::DOUBLE"),
    ("MAX_DAILY_FALL", "current_price > 0 AND {p} < current_price * 0.85::DOUBLE",
     "current_price * 0.85::DOUBLE"),
    ("COMPETITOR_UPPER_BAND",
     "competitor_max_rate <> 0 AND {p} > competitor_max_rate * 1.2::DOUBLE AND (blended_demand IS NULL"
     " OR isnan(blended_demand) OR blended_demand < 0.92)", "competitor_max_rate * 1.2::DOUBLE"),
    ("COMPETITOR_LOWER_BAND",
     "competitor_min_rate <> 0 AND {p} < competitor_min_rate * 0.8::DOUBLE",
     "competitor_min_rate * 0.8::DOUBLE"),
    ("ROOM_CEILING", "ceiling_price <> 0 AND {p} > ceiling_price", "ceiling_price"),
    ("ROOM_FLOOR", "floor_price <> 0 AND {p} < floor_price", "floor_price"),
    ("MAX_PRICE_CEILING", "{p} > 25000", "25000::DOUBLE"),
    ("MIN_PRICE_FLOOR", "{p} < 2500", "2500::DOUBLE"),
]


def guarded(source: str) -> str:
    """The rules one subquery at a time: an alias used within its own SELECT is expanded
    where it is used, which would multiply over ten dependent rules."""
    stage = (
        f"SELECT *, raw_price AS p0, CASE WHEN {_BROKEN.replace('p0', 'raw_price')} THEN base_price"
        " WHEN raw_price > base_price * 5 AND abs(base_price * 5 - raw_price) > 0.005"
        f" THEN base_price * 5 ELSE raw_price END AS p1 FROM {source}"
    )
    names = ["SANITY_CHECK"]
    for i, (name, when, to) in enumerate(_RULES, start=1):
        when = when.format(p=f"p{i}")
        stage = (
            f"SELECT *, CASE WHEN {when} AND abs({to} - p{i}) > greatest(0.005::DOUBLE, 1e-9 *"
            f" greatest(abs({to}), abs(p{i}))) THEN {to} ELSE p{i} END AS p{i + 1} FROM ({stage})"
        )
        names.append(name)
    last = f"p{len(names)}"
    rules = ", ".join(
        f"CASE WHEN p{i + 1} IS DISTINCT FROM p{i} THEN '{n}' END" for i, n in enumerate(names)
    )
    return f"""
SELECT *, (final_price - coalesce(nullif(current_price, 0), base_price))
    / coalesce(nullif(current_price, 0), base_price) * 100 AS price_change_percent
FROM (SELECT *, CASE WHEN pricing_error IS NULL THEN concat_ws(',', {rules}) END AS rules,
             CASE WHEN pricing_error IS NULL THEN round_even({last}, 0) END AS final_price
      FROM ({stage}))
"""


cte("adjusted", adjusted("grid"), "grid")
cte(
    "unsteady",
    f"""
SELECT * REPLACE (CASE WHEN k2 % 13 = 0 THEN {NAN} WHEN k2 % 13 = 1 THEN {INF} WHEN k2 % 13 = 2 THEN -5
  WHEN k2 % 13 = 3 THEN base_price * 6 WHEN k2 % 13 = 4 THEN current_price + 0.004::DOUBLE
  ELSE raw_price END AS raw_price)
FROM (SELECT *, dayofyear(stay_date) + substr(hotel_id, 2)::INT AS k2 FROM adjusted)
""",
    "adjusted",
)
cte("guarded", guarded("unsteady"), "unsteady")
cte("guarded_grid", guarded("adjusted"), "adjusted")

SQL["p1_demand_adjustment"] = compose(
    f"""SELECT {GRAIN}, round(demand_raw, 9) AS demand_raw,
    round(demand_adjustment, 9) AS demand_adjustment, demand_band FROM adjusted""",
    "adjusted",
)
SQL["p2_occupancy_adjustment"] = compose(
    f"""SELECT {GRAIN}, round(occupancy_raw, 9) AS occupancy_raw,
    round(occupancy_adjustment, 9) AS occupancy_adjustment, occupancy_band FROM adjusted""",
    "adjusted",
)
SQL["p3_competitor_adjustment"] = compose(
    f"""SELECT {GRAIN}, round(competitor_raw, 9) AS competitor_raw,
    round(competitor_adjustment, 9) AS competitor_adjustment, competitor_band FROM adjusted""",
    "adjusted",
)
SQL["p4_season_adjustment"] = compose(
    f"SELECT {GRAIN}, season, season_adjustment FROM adjusted", "adjusted"
)
SQL["p5_event_adjustment"] = compose(
    f"""SELECT {GRAIN}, round(event_raw, 9) AS event_raw,
    round(event_adjustment, 9) AS event_adjustment FROM adjusted""",
    "adjusted",
)
SQL["p6_raw_price"] = compose(
    f"""SELECT {GRAIN}, confidence_scale, round(total_adjustment, 9) AS total_adjustment,
    round(raw_price, 8) AS raw_price, pricing_error FROM adjusted""",
    "adjusted",
)


def rule_report(*wanted: str) -> str:
    names = ["SANITY_CHECK"] + [r[0] for r in _RULES]
    parts = [
        f"SELECT {GRAIN}, '{n}' AS rule, round(p{i}, 8) AS price_before,"
        f" round(p{i + 1}, 8) AS price_after FROM guarded"
        f" WHERE pricing_error IS NULL AND p{i + 1} IS DISTINCT FROM p{i}"
        for i, n in enumerate(names)
        if n in wanted
    ]
    return compose(" UNION ALL ".join(parts), "guarded")


SQL["p7_sanity_guardrail"] = rule_report("SANITY_CHECK")
SQL["p8_low_occupancy_block"] = rule_report("LOW_OCCUPANCY_RISE_BLOCK")
SQL["p9_daily_change_cap"] = rule_report("MAX_DAILY_RISE", "MAX_DAILY_FALL")
SQL["p10_competitor_band"] = rule_report("COMPETITOR_UPPER_BAND", "COMPETITOR_LOWER_BAND")
SQL["p11_absolute_limits"] = rule_report(
    "ROOM_CEILING", "ROOM_FLOOR", "MAX_PRICE_CEILING", "MIN_PRICE_FLOOR"
)
SQL["p12_guardrail_log"] = compose(f"SELECT {GRAIN}, rules, final_price FROM guarded", "guarded")
SQL["p13_change_percent"] = compose(
    f"""SELECT {GRAIN}, final_price, round(price_change_percent, 8) AS price_change_percent
    FROM guarded""",
    "guarded",
)
SQL["p17_waterfall"] = compose(
    " UNION ALL ".join(
        f"SELECT {GRAIN}, {i} AS step, '{label}' AS label, round({amount}, 8) AS amount"
        " FROM adjusted WHERE pricing_error IS NULL"
        for i, (label, amount) in enumerate(
            [("base", "base_price")]
            + [
                (n, f"base_price * {n}_adjustment")
                for n in ("demand", "occupancy", "competitor", "season", "event")
            ]
            + [("raw", "raw_price")]
        )
    ),
    "adjusted",
)
def explained() -> str:
    """The account of a decision, one line per part; halves are rounded away from zero."""
    def money(x: str) -> str:
        return f"format('{{:,}}', round({x})::BIGINT)"

    lines = [f"'Base rate: INR ' || {money('base_price')}"]
    lines += [
        f"printf('{n.title()}: %+.1f%%', round({n}_adjustment * 100, 1))"
        for n in ("demand", "occupancy", "competitor", "season", "event")
    ]
    lines.append(f"'Unguarded price: INR ' || {money('raw_price')}")
    hits = ", ".join(
        f"CASE WHEN p{i + 1} IS DISTINCT FROM p{i} THEN '{n} ' || {money(f'p{i}')} || ' to ' || {money(f'p{i + 1}')} END"
        for i, n in enumerate(["SANITY_CHECK"] + [r[0] for r in _RULES])
    )
    lines.append(f"'Guardrails: ' || coalesce(nullif(concat_ws('; ', {hits}), ''), 'none')")
    lines.append(f"'Final price: INR ' || {money('final_price')}")
    return f"CASE WHEN pricing_error IS NULL THEN concat_ws(chr(10), {', '.join(lines)}) END"


SQL["p19_explanation"] = compose(
    f"SELECT {GRAIN}, {explained()} AS explanation FROM guarded_grid", "guarded_grid"
)
cte(
    "swept_grid",
    """
SELECT * REPLACE (candidate AS occupancy_rate)
FROM grid, (SELECT unnest([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.98])::DOUBLE AS candidate)
""",
    "grid",
)
cte("swept_adjusted", adjusted("swept_grid"), "swept_grid")
cte("swept", guarded("swept_adjusted"), "swept_adjusted")
SQL["p18_occupancy_sweep"] = compose(
    f"""
SELECT {GRAIN}, candidate AS occupancy_rate, round(raw_price, 8) AS raw_price, final_price,
       CASE WHEN rules = '' THEN 0 ELSE length(rules) - length(replace(rules, ',', '')) + 1 END::INT
         AS guardrail_count
FROM swept
""",
    "swept",
)
SQL["j11_sweep_candidates"] = compose(
    f"""
SELECT {GRAIN}, candidate
FROM requests, (SELECT unnest([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.98])::DOUBLE AS candidate)
""",
    "requests",
)
SQL["p20_price_events"] = compose(
    """
SELECT hotel_id AS key, md5(hotel_id || '|' || room_type || '|' || stay_date::VARCHAR) AS prediction_id,
       room_type, stay_date::VARCHAR AS check_in_date, final_price,
       round(greatest(raw_price, 0.01), 8) AS raw_price,
       CASE WHEN rules = '' THEN 0 ELSE length(rules) - length(replace(rules, ',', '')) + 1 END::INT
         AS guardrail_count
FROM guarded_grid WHERE pricing_error IS NULL
""",
    "guarded_grid",
)

# --- context and the batch reprice --------------------------------------------------------

cte(
    "stored",
    f"""
SELECT {GRAIN}, realised AS target_demand, greatest(0, least(1, otb / room_count)) AS occupancy_rate
FROM skeleton JOIN book USING (hotel_id, room_type, stay_date)
""",
    "book",
    "skeleton",
)
cte(
    "market_now",
    f"""
SELECT {GRAIN}, avg(price) AS competitor_rate, min(price) AS competitor_min_rate,
       max(price) AS competitor_max_rate, count(*) AS competitor_count
FROM (SELECT hotel_id, room_type, check_in_date AS stay_date, price,
             rank() OVER (PARTITION BY hotel_id, room_type, check_in_date, competitor
                          ORDER BY collected_at DESC) AS r
      FROM rates WHERE collected_at BETWEEN TIMESTAMP '2025-11-01' AND TIMESTAMP '2025-12-01')
WHERE r = 1 GROUP BY {GRAIN}
""",
    "rates",
)
cte(
    "weekday_history",
    """
SELECT hotel_id, room_type, (isodow(stay_date) - 1)::INT AS weekday,
       avg(target_demand) AS fallback_demand
FROM stored GROUP BY 1, 2, 3
""",
    "stored",
)
SQL["a11_weekday_history"] = compose(
    "SELECT hotel_id, room_type, weekday, round(fallback_demand, 9) AS fallback_demand"
    " FROM weekday_history",
    "weekday_history",
)
SQL["j7_market_as_of"] = compose(
    f"""SELECT {GRAIN}, round(competitor_rate, 6) AS competitor_rate, competitor_min_rate,
    competitor_max_rate, competitor_count FROM market_now""",
    "market_now",
)
SQL["f4_stored_features"] = compose(
    f"""SELECT {GRAIN}, round(target_demand, 9) AS target_demand,
    round(occupancy_rate, 9) AS occupancy_rate
    FROM requests LEFT JOIN stored USING (hotel_id, room_type, stay_date)""",
    "requests",
    "stored",
)
cte(
    "context",
    f"""
SELECT a.hotel_id, a.room_type, a.stay_date, a.base_price, a.current_price,
  coalesce(a.occ, 1.0::DOUBLE - a.avail / a.total_rooms, s.occupancy_rate) AS occupancy_rate,
  a.h::INT AS days_to_checkin, coalesce(a.rate, m.competitor_rate) AS competitor_rate,
  coalesce(a.low, m.competitor_min_rate, a.rate) AS competitor_min_rate,
  coalesce(a.high, m.competitor_max_rate, a.rate) AS competitor_max_rate,
  {season('a.stay_date')} AS season, isodow(a.stay_date) >= 6 AS is_weekend,
  k.holiday_name IS NOT NULL AS is_holiday, coalesce(e.event_score, 0) AS event_score,
  a.floor_price, a.ceiling_price
FROM asked a JOIN hotels h ON h.hotel_id = a.hotel_id
LEFT JOIN stored s ON s.hotel_id = a.hotel_id AND s.room_type = a.room_type AND s.stay_date = a.stay_date
LEFT JOIN market_now m
  ON m.hotel_id = a.hotel_id AND m.room_type = a.room_type AND m.stay_date = a.stay_date
LEFT JOIN calendar k ON k.day = a.stay_date
LEFT JOIN city_days e ON e.city = h.city AND e.day = a.stay_date
""",
    "asked",
    "hotels",
    "stored",
    "market_now",
    "calendar",
    "city_days",
)
SQL["p15_pricing_context"] = compose(
    """
SELECT * REPLACE (round(occupancy_rate, 9) AS occupancy_rate,
  round(competitor_rate, 6) AS competitor_rate, round(competitor_min_rate, 6) AS competitor_min_rate,
  round(competitor_max_rate, 6) AS competitor_max_rate) FROM context
""",
    "context",
)


def blended(source: str) -> str:
    """The blend over a relation with both estimates and the fallback."""
    conf = "greatest(0, least(1, 1.0::DOUBLE - {} / 0.5::DOUBLE))"
    return f"""
SELECT *, abs(forecast - boosted) AS disagreement,
  CASE WHEN forecast IS NULL AND boosted IS NULL THEN 'none'
       WHEN forecast IS NOT NULL AND boosted IS NOT NULL THEN 'both'
       WHEN boosted IS NULL THEN 'series' ELSE 'boosted' END AS mode,
  coalesce(fallback_demand, 0.65::DOUBLE) AS fb,
  CASE mode WHEN 'both' THEN 0.5::DOUBLE * forecast_lower + 0.5::DOUBLE * boosted_lower
       WHEN 'series' THEN forecast_lower WHEN 'boosted' THEN boosted_lower END AS lo,
  CASE mode WHEN 'both' THEN 0.5::DOUBLE * forecast_upper + 0.5::DOUBLE * boosted_upper
       WHEN 'series' THEN forecast_upper WHEN 'boosted' THEN boosted_upper END AS hi,
  CASE mode WHEN 'none' THEN fb WHEN 'series' THEN forecast WHEN 'boosted' THEN boosted
       ELSE greatest(0.5::DOUBLE * forecast + 0.5::DOUBLE * boosted, 0) END AS blended_demand,
  CASE mode WHEN 'both' THEN 0.5 WHEN 'series' THEN 1.0 ELSE 0.0 END::DOUBLE AS forecast_weight,
  CASE mode WHEN 'none' THEN 0.25::DOUBLE
       WHEN 'both' THEN round(0.6::DOUBLE * {conf.format('(hi - lo)')}
         + 0.4::DOUBLE * greatest(0, least(1, 1.0::DOUBLE - disagreement / 0.35::DOUBLE)), 4)
       ELSE least({conf.format('greatest(hi - lo, 0)')}, 0.7::DOUBLE) END AS confidence,
  CASE mode WHEN 'none' THEN greatest(fb - 0.2::DOUBLE, 0) WHEN 'both' THEN greatest(lo, 0) ELSE lo END
    AS demand_lower,
  CASE mode WHEN 'none' THEN fb + 0.2::DOUBLE WHEN 'both' THEN greatest(hi, lo) ELSE hi END
    AS demand_upper
FROM {source}
"""


_EK = "(dayofyear(stay_date) * 7 + substr(hotel_id, 2)::INT * 3 + length(room_type))"
cte(
    "estimates",
    f"""
SELECT {GRAIN},
  CASE WHEN {_EK} % 3 <> 0 THEN occupancy_rate - 0.2::DOUBLE END AS forecast,
  CASE WHEN {_EK} % 3 <> 0 THEN occupancy_rate - 0.25::DOUBLE END AS forecast_lower,
  CASE WHEN {_EK} % 3 <> 0 THEN occupancy_rate - 0.1::DOUBLE END AS forecast_upper,
  CASE WHEN {_EK} % 5 <> 0 THEN ({_EK} % 90) / 100.0::DOUBLE END AS boosted,
  CASE WHEN {_EK} % 5 <> 0 THEN ({_EK} % 90) / 100.0::DOUBLE - 0.11::DOUBLE END AS boosted_lower,
  CASE WHEN {_EK} % 5 <> 0 THEN ({_EK} % 90) / 100.0::DOUBLE + 0.07::DOUBLE END AS boosted_upper,
  CASE WHEN {_EK} % 2 = 0 THEN w.fallback_demand END AS fallback_demand
FROM stored s LEFT JOIN weekday_history w USING (hotel_id, room_type)
WHERE w.weekday = isodow(s.stay_date) - 1
""",
    "stored",
    "weekday_history",
)
cte("blended", blended("estimates"), "estimates")
SQL["m15_blended_demand"] = compose(
    f"""
SELECT {GRAIN}, round(blended_demand, 9) AS blended_demand, forecast_weight,
       round(demand_lower, 9) AS demand_lower, round(demand_upper, 9) AS demand_upper,
       CASE mode WHEN 'both' THEN 'series,boosted' WHEN 'none' THEN '' ELSE mode END AS sources,
       mode <> 'both' AS degraded
FROM blended
""",
    "blended",
)
SQL["m16_confidence"] = compose(
    f"""
SELECT {GRAIN}, round(confidence, 6) AS confidence, round(disagreement, 9) AS disagreement,
  CASE mode WHEN 'none' THEN CASE WHEN fallback_demand IS NULL THEN 'baseline used'
                                  ELSE 'stored history used' END
       WHEN 'boosted' THEN 'series forecast missing' WHEN 'series' THEN 'regressor missing'
       ELSE CASE WHEN disagreement > 0.2 THEN 'estimates disagree' ELSE '' END END AS notes
FROM blended
""",
    "blended",
)
cte(
    "past_weekday_history",
    """
SELECT hotel_id, room_type, (isodow(stay_date) - 1)::INT AS weekday,
       avg(target_demand) AS fallback_demand
FROM stored WHERE stay_date < DATE '2025-12-01' GROUP BY 1, 2, 3
""",
    "stored",
)
cte(
    "night_forecasts",
    forecast(
        "past",
        "hotel_id, room_type",
        "SELECT hotel_id, room_type, stay_date AS ds FROM context",
    ),
    "context",
    "past_trend",
    "past_weekly",
    "past_band",
)
cte(
    "demanded",
    f"""
SELECT c.*, f.forecast, f.forecast_lower, f.forecast_upper, NULL::DOUBLE AS boosted,
       NULL::DOUBLE AS boosted_lower, NULL::DOUBLE AS boosted_upper, w.fallback_demand
FROM context c
LEFT JOIN night_forecasts f ON f.hotel_id = c.hotel_id AND f.room_type = c.room_type AND f.ds = c.stay_date
LEFT JOIN past_weekday_history w ON w.hotel_id = c.hotel_id AND w.room_type = c.room_type
  AND w.weekday = isodow(c.stay_date) - 1
""",
    "context",
    "night_forecasts",
    "past_weekday_history",
)
cte("reprice_blend", blended("demanded"), "demanded")
cte("reprice_adjusted", adjusted("reprice_blend"), "reprice_blend")
cte("repriced", guarded("reprice_adjusted"), "reprice_adjusted")
SQL["p14_reprice_grid"] = compose(
    f"""
SELECT {GRAIN}, base_price, current_price, round(blended_demand, 6) AS blended_demand,
       round(confidence, 6) AS confidence, round(demand_adjustment, 6) AS demand_adjustment,
       round(occupancy_adjustment, 6) AS occupancy_adjustment,
       round(competitor_adjustment, 6) AS competitor_adjustment, season_adjustment,
       round(event_adjustment, 6) AS event_adjustment,
       round(total_adjustment, 6) AS total_adjustment, round(raw_price, 4) AS raw_price, final_price,
       round(price_change_percent, 4) AS price_change_percent, rules
FROM repriced
""",
    "repriced",
)
SQL["p16_audit_rows"] = compose("SELECT count(*) AS pairs, count(*) AS distinct_ids FROM context", "context")
_REASONS = " ".join(f"WHEN '{rule}' THEN '{text}'" for rule, text in REASONS.items())
SQL["p12_guardrail_reasons"] = compose(
    f"""
SELECT rule, CASE rule {_REASONS} END AS reason, count(*) AS n
FROM (SELECT unnest(string_split(rules, ',')) AS rule FROM guarded WHERE rules <> '') GROUP BY 1, 2
""",
    "guarded",
)
