"""Statements of the monitoring family."""

import oracles.reports  # noqa: F401
from oracles.base import compose, cte
from oracles.models import metrics

SQL: dict[str, str] = {}


def check(name: str, severity: str, value: str, threshold: str, source: str, detail: str = "NULL") -> str:
    return (
        f"SELECT '{name}' AS check_name, {severity} AS severity, round({value}::DOUBLE, 4) AS value,"
        f" ({threshold})::DOUBLE AS threshold, ({detail})::VARCHAR AS detail FROM {source}"
    )


cte(
    "watched",
    """
SELECT * REPLACE (CASE WHEN competitor_missing = 0 THEN competitor_rate END AS competitor_rate),
       CASE WHEN room_type = 'suite' THEN 'v0' ELSE 'v1' END AS feature_version,
       TIMESTAMP '2025-12-01' - to_hours(dayofyear(stay_date) % 20 + 40) AS computed_at
FROM matrix
""",
    "matrix",
)
_REFERENCE = check(
    "reference_data", "CASE WHEN n = 0 OR e > 0 THEN 'critical' ELSE 'ok' END",
    "CASE WHEN n > 0 AND e > 0 THEN e ELSE n END", "NULL",
    "(SELECT count(*) AS n, count(*) FILTER (hotel_id NOT IN (SELECT hotel_id FROM rooms{w})) AS e FROM hotels)",
)
_RECENCY = check(
    "booking_recency", "CASE WHEN a > 7 THEN 'warning' ELSE 'ok' END", "a", "CASE WHEN a > 7 THEN 7 END",
    "(SELECT date_diff('day', max(check_in_date), DATE '2025-12-01') AS a FROM bookings{w})",
)
_FRESH = check(
    "{n}", "CASE WHEN h > {l} THEN 'warning' ELSE 'ok' END", "round(h, 1)", "CASE WHEN h > {l} THEN {l} END",
    "(SELECT epoch(TIMESTAMP '2025-12-01' - max({c})) / 3600 AS h FROM {t})",
)
_COVERAGE = check(
    "competitor_coverage", "CASE WHEN s < 0.5 THEN 'warning' ELSE 'ok' END", "s",
    "CASE WHEN s < 0.5 THEN 0.5 END",
    "(SELECT least(count(DISTINCT check_in_date) / 31, 1) AS s FROM rates"
    " WHERE check_in_date BETWEEN DATE '2025-12-01' AND DATE '2025-12-31')",
)
_VERSION = check(
    "feature_version", "CASE WHEN mix = 'v1' THEN 'ok' ELSE 'warning' END", "NULL", "NULL",
    "(SELECT string_agg(v || '=' || n, ',' ORDER BY v) AS full_mix, string_agg(v, ',' ORDER BY v) AS mix"
    " FROM (SELECT feature_version AS v, count(*) AS n FROM watched GROUP BY 1))", "full_mix",
)
_NULLS = check(
    "feature_nulls", "CASE WHEN w > 0.1 THEN 'critical' WHEN w > 0 THEN 'warning' ELSE 'ok' END",
    "CASE WHEN w > 0 THEN w END", "NULL",
    "(SELECT greatest(" + ", ".join(
        f"round(count(*) FILTER ({c} IS NULL) / count(*), 4)"
        for c in ("occupancy_rate", "competitor_rate", "search_demand", "historical_demand")
    ) + ") AS w FROM watched)",
)
_TARGET = check(
    "target_range", "CASE WHEN hi > 1.6 OR lo < 0 THEN 'critical' ELSE 'ok' END", "hi",
    "CASE WHEN hi > 1.6 OR lo < 0 THEN 1.6 END",
    "(SELECT min(target_demand) AS lo, max(target_demand) AS hi FROM watched)",
)
_DUPES = check(
    "duplicate_grain", "CASE WHEN k > 0 THEN 'critical' ELSE 'ok' END", "CASE WHEN k > 0 THEN k END", "NULL",
    "(SELECT count(*) AS k FROM (SELECT 1 FROM {t} GROUP BY hotel_id, room_type, {d} HAVING count(*) > 1))",
)
SQL["d1_reference_data"] = compose(
    _REFERENCE.replace("{w}", ""), "hotels", "rooms"
)
SQL["d2_booking_recency"] = compose(
    _RECENCY.replace("{w}", ""), "bookings"
)


def fresh(name: str, limit: int, column: str, table: str) -> str:
    return (
        _FRESH.replace("{n}", name).replace("{l}", str(limit)).replace("{c}", column).replace("{t}", table)
    )


SQL["d3_competitor_freshness"] = compose(
    fresh("competitor_freshness", 48, "collected_at",
          "rates"), "rates",
)
SQL["d4_competitor_coverage"] = compose(_COVERAGE, "rates")
SQL["d5_feature_freshness"] = compose(
    fresh("feature_freshness", 36, "computed_at", "watched"), "watched"
)
SQL["d6_feature_version"] = compose(_VERSION, "watched")
SQL["d7_feature_nulls"] = compose(_NULLS, "watched")
SQL["d8_target_range"] = compose(_TARGET, "watched")
SQL["d9_duplicate_grain"] = compose(
    _DUPES.replace("{t}", "bookings").replace("{d}", "check_in_date"), "bookings"
)
_REPORT = " UNION ALL ".join(
    [
        _REFERENCE.replace("{w}", ""),
        _RECENCY.replace("{w}", ""),
        fresh("competitor_freshness", 48, "collected_at", "rates"),
        _COVERAGE,
        fresh("feature_freshness", 36, "computed_at", "watched"),
        _VERSION,
        _NULLS,
        _TARGET,
        _DUPES.replace("{t}", "watched").replace("{d}", "stay_date"),
    ]
)
_NEEDS = ("hotels", "rooms", "bookings", "rates", "watched")
SQL["d10_data_report"] = compose(_REPORT, *_NEEDS)
SQL["d10_verdict"] = compose(
    f"""
SELECT count(*) FILTER (severity = 'ok') AS passed, count(*) AS total,
       CASE max(r) WHEN 2 THEN 'critical' WHEN 1 THEN 'warning' ELSE 'ok' END AS worst,
       (max(r) = 2)::INT AS exit_code
FROM (SELECT severity, CASE severity WHEN 'critical' THEN 2 WHEN 'warning' THEN 1 ELSE 0 END AS r
      FROM ({_REPORT}))
""",
    *_NEEDS,
)


def psi(long: str) -> str:
    """PSI per feature of a relation (feature, value, recent)."""
    steps = ", ".join(f"{i / 10}" for i in range(11))
    return f"""
SELECT s.feature, CASE WHEN s.rn >= 50 AND s.cn >= 50 AND len(s.e) >= 3 THEN p.psi END AS psi,
       s.rm AS reference_mean, s.cm AS current_mean, s.rn AS reference_n, s.cn AS current_n
FROM (SELECT feature, list_sort(list_distinct(quantile_cont(value, [{steps}]) FILTER (NOT recent))) AS e,
             count(*) FILTER (NOT recent) AS rn, count(*) FILTER (recent) AS cn,
             avg(value) FILTER (NOT recent) AS rm, avg(value) FILTER (recent) AS cm
      FROM {long} WHERE value IS NOT NULL GROUP BY 1) s
LEFT JOIN (
  SELECT feature, sum((c - r) * ln(c / r)) AS psi
  FROM (SELECT feature, b, greatest(count(*) FILTER (NOT recent) / max(rn), 1e-4) AS r,
               greatest(count(*) FILTER (recent) / max(cn), 1e-4) AS c
        FROM (SELECT l.feature, l.recent, t.rn, t.cn,
                     len(list_filter(t.e[2:len(t.e) - 1], lambda x: x <= l.value)) AS b
              FROM {long} l JOIN (
                SELECT feature,
                       list_sort(list_distinct(quantile_cont(value, [{steps}]) FILTER (NOT recent))) AS e,
                       count(*) FILTER (NOT recent) AS rn, count(*) FILTER (recent) AS cn
                FROM {long} WHERE value IS NOT NULL GROUP BY 1) t USING (feature)
              WHERE l.value IS NOT NULL) GROUP BY 1, 2) GROUP BY 1) p USING (feature)
"""


cte(
    "price_long",
    "SELECT competitor AS feature, price AS value, check_in_date >= DATE '2025-11-01' AS recent FROM rates",
    "rates",
)
SQL["d11_population_stability"] = compose(
    f"""
SELECT feature, round(psi, 6) AS psi, round(reference_mean, 4) AS reference_mean,
       round(current_mean, 4) AS current_mean, reference_n, current_n FROM ({psi('price_long')})
""",
    "price_long",
)
_SEVERITY = """CASE WHEN psi IS NULL OR isnan(psi) THEN 'ok' WHEN psi >= 0.2 THEN 'critical'
       WHEN psi >= 0.1 THEN 'warning' ELSE 'ok' END"""
cte(
    "lead_long",
    """
SELECT channel AS feature, lead_time_days::DOUBLE AS value,
       CASE WHEN channel = 'ota' THEN lead_time_days < 40 ELSE check_in_date >= DATE '2025-11-01' END AS recent
FROM bookings
""",
    "bookings",
)
SQL["d12_psi_severity"] = compose(
    f"SELECT feature, {_SEVERITY} AS severity FROM ({psi('lead_long')})", "lead_long"
)
_ROUNDED = {
    "occupancy_rate": "round(occupancy_rate, 6)", "competitor_rate": "round(competitor_rate, 6)",
    "search_demand": "search_demand", "historical_demand": "round(historical_demand, 6)",
    "current_room_price": "round(current_room_price, 6)", "lead_time": "round(lead_time, 6)",
    "booking_count": "booking_count",
}
cte(
    "drift_long",
    " UNION ALL ".join(
        f"SELECT '{f}' AS feature, {e} AS value, stay_date >= DATE '2025-11-01' AS recent FROM watched"
        for f, e in _ROUNDED.items()
    ),
    "watched",
)
SQL["d13_feature_drift"] = compose(
    f"""
SELECT feature, round(psi, 5) AS psi, round(reference_mean, 4) AS reference_mean,
       round(current_mean, 4) AS current_mean, reference_n, current_n, {_SEVERITY} AS severity
FROM ({psi('drift_long')})
""",
    "drift_long",
)
_CAVEAT = check(
    "drift_seasonality_caveat", "'warning'", "d", "730",
    "(SELECT date_diff('day', min(stay_date), max(stay_date)) AS d FROM watched) WHERE d < 730",
)
SQL["d14_seasonality_caveat"] = compose(_CAVEAT, "watched")
cte(
    "newest",
    "SELECT * FROM audit WHERE created_at BETWEEN TIMESTAMP '2025-11-30' AND TIMESTAMP '2025-12-01'",
    "audit",
)
cte(
    "prediction_stats",
    """
SELECT count(*) AS n, count(blended_demand) AS known, round(avg(blended_demand), 4) AS demand_mean,
       round(stddev_samp(blended_demand), 4) AS demand_std, round(min(blended_demand), 4) AS demand_min,
       round(max(blended_demand), 4) AS demand_max, round(avg(confidence), 4) AS confidence_mean,
       round(quantile_cont(latency_ms, 0.95), 2) AS latency_p95_ms,
       (SELECT round(count(*) FILTER (abs(blended_demand - m) > 3 * greatest(s, 1e-9)) / count(blended_demand), 6)
        FROM newest, (SELECT avg(blended_demand) AS m, stddev_samp(blended_demand) AS s FROM newest))
         AS outlier_share
FROM newest
""",
    "newest",
)
SQL["d15_prediction_stats"] = compose("SELECT * FROM prediction_stats", "prediction_stats")
_PREDICTION = " UNION ALL ".join(
    [
        check("prediction_volume", "'ok'", "known", "50", "prediction_stats WHERE known < 50"),
        check("prediction_variance", "CASE WHEN demand_std < 0.02 THEN 'critical' ELSE 'ok' END", "demand_std",
              "CASE WHEN demand_std < 0.02 THEN 0.02 END", "prediction_stats WHERE known >= 50"),
        check("prediction_outliers", "CASE WHEN outlier_share > 0.05 THEN 'warning' ELSE 'ok' END",
              "outlier_share", "0.05", "prediction_stats WHERE known >= 50"),
        check("prediction_confidence", "'warning'", "confidence_mean", "0.4",
              "prediction_stats WHERE known >= 50 AND confidence_mean < 0.4"),
    ]
)
SQL["d15_prediction_health"] = compose(_PREDICTION, "prediction_stats")
cte(
    "price_stats",
    """
SELECT count(*) AS n, round(avg(final_price), 2) AS price_mean, round(min(final_price), 2) AS price_min,
       round(max(final_price), 2) AS price_max, round(avg((rules <> '')::INT), 4) AS clamped_share,
       round(avg(price_change_percent), 2) AS mean_change_percent,
       round(avg((final_price <= 2500 OR final_price >= 25000)::INT), 4) AS pinned_share
FROM newest
""",
    "newest",
)
SQL["d16_price_stats"] = compose("SELECT * FROM price_stats", "price_stats")
_PRICE = " UNION ALL ".join(
    [
        check("guardrail_pressure", "CASE WHEN clamped_share > 0.5 THEN 'warning' ELSE 'ok' END",
              "clamped_share", "CASE WHEN clamped_share > 0.5 THEN 0.5 END", "price_stats"),
        check("absolute_limits", "'warning'", "pinned_share", "0.1", "price_stats WHERE pinned_share > 0.1"),
    ]
)
SQL["d16_price_health"] = compose(_PRICE, "price_stats")
cte(
    "outcomes",
    """
SELECT a.hotel_id, a.room_type, m.stay_date, a.blended_demand, m.target_demand
FROM audit a JOIN matrix m ON m.hotel_id = a.hotel_id AND m.room_type = a.room_type
  AND m.stay_date = a.check_in_date WHERE a.check_in_date < DATE '2025-12-01'
""",
    "audit",
    "matrix",
)
SQL["d17_realised_accuracy"] = compose(
    f"""
SELECT {metrics('target_demand', 'blended_demand')} FROM outcomes WHERE blended_demand IS NOT NULL
""",
    "outcomes",
)
SQL["j8_predictions_with_outcomes"] = compose(
    "SELECT * REPLACE (round(target_demand, 9) AS target_demand) FROM outcomes", "outcomes"
)
_DRIFT = (
    f"SELECT 'drift:' || feature AS check_name, {_SEVERITY} AS severity, round(psi, 4) AS value,"
    f" 0.2::DOUBLE AS threshold, NULL::VARCHAR AS detail FROM ({psi('drift_long')})"
)
SQL["d18_model_report"] = compose(
    " UNION ALL ".join([_PREDICTION, _PRICE, _CAVEAT, _DRIFT]),
    "prediction_stats",
    "price_stats",
    "watched",
    "drift_long",
)


def _spread(relation: str, section: str, columns: str) -> str:
    """One row as rows of figures; nulls are kept."""
    names = [c.strip() for c in columns.split(",")]
    return " UNION ALL ".join(
        f"SELECT '{section}' AS section, '{c}' AS name, round({c}::DOUBLE, 4) AS value, NULL::VARCHAR AS severity FROM {relation}"
        for c in names
    )


_SCORES = "n, mae, rmse, mape, smape, weighted_mape, r2, bias, mape_coverage"
cte("realised", f"SELECT {metrics('target_demand', 'blended_demand')} FROM outcomes WHERE blended_demand IS NOT NULL", "outcomes")
_HEALTH = " UNION ALL ".join(
    [
        f"SELECT 'check' AS section, check_name AS name, round(value, 4) AS value, severity FROM ({_PREDICTION} UNION ALL {_PRICE} UNION ALL {_CAVEAT})",
        f"SELECT 'drift', feature, round(psi, 4), {_SEVERITY} FROM ({psi('drift_long')})",
        _spread("prediction_stats", "prediction",
                "n, known, demand_mean, demand_std, demand_min, demand_max, confidence_mean, latency_p95_ms, outlier_share"),
        _spread("price_stats", "price",
                "n, price_mean, price_min, price_max, clamped_share, mean_change_percent, pinned_share"),
        _spread("realised WHERE n >= 50", "accuracy", _SCORES),
        "SELECT 'guardrail', rule, count(*)::DOUBLE, NULL FROM (SELECT unnest(string_split(rules, ',')) AS rule FROM newest"
        " WHERE rules <> '') GROUP BY 2",
    ]
)
_HEALTH_NEEDS = ("prediction_stats", "price_stats", "watched", "drift_long", "newest", "realised")
SQL["d18_model_health"] = compose(_HEALTH, *_HEALTH_NEEDS)
SQL["d18_health_severity"] = compose(
    f"""
SELECT CASE max(CASE severity WHEN 'critical' THEN 2 WHEN 'warning' THEN 1 ELSE 0 END) WHEN 2 THEN 'critical'
         WHEN 1 THEN 'warning' ELSE 'ok' END AS severity,
       count(*) FILTER (section = 'drift' AND severity <> 'ok') AS drifting, count(*) FILTER (section = 'drift') AS watched,
       count(*) FILTER (section = 'check' AND severity <> 'ok') AS failing
FROM ({_HEALTH}) WHERE severity IS NOT NULL
""",
    *_HEALTH_NEEDS,
)
SQL["j6_hotels_without_rooms"] = compose(
    "SELECT hotel_id, city FROM hotels WHERE hotel_id NOT IN (SELECT hotel_id FROM rooms)",
    "hotels",
    "rooms",
)
