"""Statements of the model family."""

import oracles.pricing  # noqa: F401  (registers the stored-feature CTEs)
from nightledger.config import FEATURES
from oracles.base import compose, cte
from oracles.forecast_ctes import forecast, register, register_filled

SQL: dict[str, str] = {}
GRAIN = "hotel_id, room_type, stay_date"
ROOM = "hotel_id, room_type"

SQL["w9_daily_series"] = compose("SELECT hotel_id, room_type, ds, round(y, 9) AS y FROM series", "series")
SQL["w8_gap_filled_series"] = compose(
    "SELECT hotel_id, room_type, ds, round(y, 9) AS y FROM filled", "filled"
)
SQL["j10_complete_calendar"] = compose(
    """
SELECT d.hotel_id, d.room_type, count(*) AS calendar_days, count(s.ds) AS observed_days
FROM filled_days d LEFT JOIN series s USING (hotel_id, room_type, ds) GROUP BY 1, 2
""",
    "filled_days",
    "series",
)
_wd = ", ".join(
    f"round(max(w.weekly) FILTER (w.wd = {d + 1}), 9) AS weekday_{d}" for d in range(7)
)
SQL["m1_series_models"] = compose(
    f"""
SELECT t.hotel_id, t.room_type, t.n AS n_observations, t.history_end, round(t.capacity, 9) AS capacity,
       round(t.slope, 9) AS slope, {_wd}, round(b.q_low, 9) AS band_low, round(b.q_high, 9) AS band_high
FROM filled_trend t JOIN filled_weekly w USING ({ROOM}) JOIN filled_band b USING ({ROOM})
GROUP BY ALL
""",
    "filled_band",
)
_BAND = """round(forecast, 6) AS forecast, round(forecast_lower, 6) AS forecast_lower,
       round(forecast_upper, 6) AS forecast_upper"""
_next = forecast(
    "filled",
    ROOM,
    "SELECT hotel_id, room_type, step::INT AS step, (history_end + step)::DATE AS ds"
    " FROM (SELECT hotel_id, room_type, history_end, unnest(range(1, 31))::INT AS step FROM filled_trend)",
)
SQL["m2_nested_horizons"] = compose(
    f"""
SELECT hotel_id, room_type, step, ds, {_BAND}, h AS horizon_days
FROM ({_next}), (SELECT unnest([7, 14, 30]) AS h) WHERE step <= h
""",
    "filled_band",
)
_range = forecast(
    "filled",
    ROOM,
    "SELECT hotel_id, room_type, day AS ds FROM filled_trend, days"
    " WHERE day BETWEEN DATE '2025-11-15' AND DATE '2025-12-14'",
)
SQL["m3_forecast_range"] = compose(
    f"SELECT hotel_id, room_type, ds, {_BAND} FROM ({_range})", "filled_band", "days"
)
SQL["m4_forecast_holidays"] = compose(
    """
SELECT day AS ds, name AS holiday_name, -1 AS lower_window, 1 AS upper_window,
       greatest(1, 10 * max(sig) OVER (PARTITION BY name)) AS prior_scale
FROM holidays WHERE year(day) BETWEEN (SELECT min(year(check_in_date)) FROM bookings)
  AND (SELECT max(year(check_in_date)) + 2 FROM bookings)
""",
    "holidays",
    "bookings",
)
cte(
    "folded",
    """
SELECT f.*, k.fold, (e.b - k.fold * 30)::DATE AS cutoff
FROM filled f JOIN (SELECT hotel_id, room_type, max(ds) AS b, count(*) AS n FROM filled GROUP BY ALL) e
  USING (hotel_id, room_type), (SELECT unnest([1, 2, 3]) AS fold) k
WHERE e.n >= 180
""",
    "filled",
)
cte("fold_train", "SELECT hotel_id, room_type, fold, ds, y FROM folded WHERE ds <= cutoff", "folded")
register("fold_train", "hotel_id, room_type, fold")
cte(
    "fold_scores",
    forecast(
        "fold_train",
        "hotel_id, room_type, fold",
        "SELECT hotel_id, room_type, fold, ds, y AS actual FROM folded"
        " WHERE ds > cutoff AND ds <= cutoff + 30",
    ),
    "folded",
    "fold_train_band",
)


def metrics(a: str, p: str, lo: str | None = None, hi: str | None = None, digits: int = 5) -> str:
    band = (
        f", round(avg(({a} BETWEEN {lo} AND {hi})::INT), 6) AS interval_coverage" if lo else ""
    )
    return f"""
  count(*) AS n, round(avg(abs({a} - {p})), 6) AS mae, round(sqrt(avg(({a} - {p}) ** 2)), 6) AS rmse,
  round(avg(abs(({a} - {p}) / {a})) FILTER (abs({a}) >= 0.02) * 100, {digits}) AS mape,
  round(coalesce(avg(abs({a} - {p}) / ((abs({a}) + abs({p})) / 2)) FILTER (abs({a}) + abs({p}) > 0), 0)
    * 100, {digits}) AS smape,
  round(sum(abs({a} - {p})) / nullif(sum(abs({a})), 0) * 100, {digits}) AS weighted_mape,
  round(1 - sum(({a} - {p}) ** 2) / nullif(var_pop({a}) * count(*), 0), 6) AS r2,
  round(avg({p} - {a}), 6) AS bias, round(avg((abs({a}) >= 0.02)::INT), 6) AS mape_coverage{band}"""


SQL["w11_rolling_folds"] = compose(
    f"SELECT fold, {metrics('actual', 'forecast', 'forecast_lower', 'forecast_upper')}"
    " FROM fold_scores GROUP BY fold",
    "fold_scores",
)
cte(
    "series_scores",
    f"""
SELECT hotel_id, room_type, count(*) AS n, avg(abs(actual - forecast)) AS mae,
  sqrt(avg((actual - forecast) ** 2)) AS rmse,
  avg(abs((actual - forecast) / actual)) FILTER (abs(actual) >= 0.02) * 100 AS mape,
  coalesce(avg(abs(actual - forecast) / ((abs(actual) + abs(forecast)) / 2))
    FILTER (abs(actual) + abs(forecast) > 0), 0) * 100 AS smape,
  sum(abs(actual - forecast)) / nullif(sum(abs(actual)), 0) * 100 AS weighted_mape,
  1 - sum((actual - forecast) ** 2) / nullif(var_pop(actual) * count(*), 0) AS r2,
  avg(forecast - actual) AS bias,
  avg((actual BETWEEN forecast_lower AND forecast_upper)::INT) AS interval_coverage
FROM fold_scores GROUP BY 1, 2
""",
    "fold_scores",
)
SQL["m5_series_report"] = compose(
    "SELECT sum(n)::BIGINT AS n, "
    + ", ".join(
        f"round(sum({m} * n) / sum(n) FILTER ({m} IS NOT NULL), {5 if 'mape' in m else 6}) AS {m}"
        for m in ("mae", "rmse", "mape", "smape", "weighted_mape", "r2", "bias", "interval_coverage")
    )
    + " FROM series_scores",
    "series_scores",
)
SQL["w10_chronological_split"] = compose(
    """
SELECT CASE WHEN stay_date <= (SELECT max(stay_date) - 60 FROM stored) THEN 'train' ELSE 'test' END AS side,
       count(*) AS n, min(stay_date) AS first_night, max(stay_date) AS last_night
FROM stored GROUP BY 1
""",
    "stored",
)
cte(
    "scored",
    f"""SELECT {GRAIN}, days_to_checkin, target_demand AS actual, historical_demand AS predicted
    FROM matrix""",
    "matrix",
)
SQL["m8_metrics"] = compose(
    f"SELECT {metrics('actual', 'predicted', '(predicted - 0.2037::DOUBLE)', '(predicted + 0.2037::DOUBLE)')}"
    " FROM scored",
    "scored",
)
SQL["m9_baseline_metrics"] = compose(
    """
SELECT count(*) AS n, round(avg(abs(actual - m)), 6) AS mae, round(sqrt(avg((actual - m) ** 2)), 6) AS rmse,
  round(avg(abs((actual - m) / actual)) FILTER (abs(actual) >= 0.02) * 100, 5) AS mape,
  round(avg(m - actual), 6) AS bias
FROM scored, (SELECT avg(actual) AS m FROM scored)
""",
    "scored",
)
_BY = """
SELECT {g}, count(*) AS n, round(avg(abs(actual - predicted)), 6) AS mae,
  round(sqrt(avg((actual - predicted) ** 2)), 6) AS rmse,
  round(avg(abs((actual - predicted) / actual)) FILTER (abs(actual) >= 0.02) * 100, 5) AS mape,
  round(1 - sum((actual - predicted) ** 2) / nullif(var_pop(actual) * count(*), 0), 6) AS r2,
  round(avg(predicted - actual), 6) AS bias, round(avg(abs(actual - m)), 6) AS baseline_mae
FROM (SELECT *, avg(actual) OVER (PARTITION BY {g}) AS m FROM scored) GROUP BY {g} HAVING count(*) >= 5
"""
SQL["m10_metrics_by_horizon"] = compose(_BY.format(g="days_to_checkin"), "scored")
SQL["m10_metrics_by_hotel"] = compose(
    f"""
SELECT h.*, room_types, least_mae, most_mae
FROM ({_BY.format(g="hotel_id")}) h LEFT JOIN (
  SELECT hotel_id, count(*) AS room_types, round(min(e), 6) AS least_mae, round(max(e), 6) AS most_mae
  FROM (SELECT hotel_id, room_type, avg(abs(actual - predicted)) AS e FROM scored GROUP BY 1, 2 HAVING count(*) >= 5)
  GROUP BY 1) r ON r.hotel_id = h.hotel_id
""",
    "scored",
)
SQL["m13_improvement"] = compose(
    """
SELECT room_type, round(avg(abs(actual - predicted)), 6) AS mae, round(avg(abs(actual - m)), 6) AS baseline_mae,
       round(1 - avg(abs(actual - predicted)) / avg(abs(actual - m)), 6) AS improvement
FROM (SELECT *, avg(actual) OVER (PARTITION BY room_type) AS m FROM scored) GROUP BY room_type
""",
    "scored",
)
SQL["m7_residual_band"] = compose(
    f"""
SELECT {GRAIN}, round(greatest(predicted - s, 0), 6) AS boosted_lower,
       round(predicted + s, 6) AS boosted_upper,
       round(CASE WHEN predicted <= 0 THEN 0
             ELSE greatest(0, least(1, 1 - s / greatest(predicted, 1e-6))) END, 6) AS boosted_confidence
FROM scored, (SELECT stddev_pop(actual - predicted) AS s FROM scored)
""",
    "scored",
)
SQL["s10_model_catalogue"] = compose(
    """
, v AS (SELECT days_to_checkin::INT AS k, count(*) AS n, avg(abs(actual - predicted)) AS mae
        FROM scored GROUP BY 1)
SELECT 'v' || k AS version, k AS version_number, n, round(mae, 6) AS mae, mae < 0.4 AS usable,
       k = (SELECT max(k) FROM v WHERE mae < 0.4) AS is_served
FROM v
""",
    "scored",
)
from nightledger.config import FEATURES  # noqa: E402

SQL["w7_top_importances"] = compose(
    "SELECT feature, round(correlation, 6) AS correlation FROM ("
    + " UNION ALL ".join(
        f"SELECT '{f}' AS feature, corr({f}, target_demand) AS correlation FROM matrix"
        for f in FEATURES
    )
    + ") WHERE correlation IS NOT NULL AND NOT isnan(correlation)"
    " ORDER BY abs(correlation) DESC, feature LIMIT 12",
    "matrix",
)
SQL["m5_fit_report"] = compose(
    """
SELECT hotel_id, room_type, days >= 90 AS fitted, days AS n_observations,
       CASE WHEN days < 90 THEN days::VARCHAR || ' days of history, 90 needed' END AS error
FROM (SELECT hotel_id, CASE WHEN room_type = 'suite' AND ds >= DATE '2025-11-01' THEN 'suite, recent' ELSE room_type END AS room_type,
             date_diff('day', min(ds), max(ds)) + 1 AS days FROM series GROUP BY 1, 2)
""",
    "series",
)
cte(
    "sides",
    """SELECT *, stay_date > (SELECT max(stay_date) - 60 FROM matrix) AS held FROM matrix""",
    "matrix",
)
SQL["m14_training_steps"] = compose(
    """
, w AS (
  SELECT count(*) FILTER (NOT held) AS n_train, min(stay_date) FILTER (NOT held) AS train_start,
         max(stay_date) FILTER (NOT held) AS train_end, count(*) FILTER (held) AS n_test,
         min(stay_date) FILTER (held) AS test_start, max(stay_date) FILTER (held) AS test_end,
         avg(target_demand) FILTER (NOT held) AS level
  FROM sides),
f AS (
  SELECT round(avg(abs(target_demand - level)), 6) AS mean, round(avg(abs(target_demand - historical_demand)), 6) AS history,
         count(target_demand) AS n
  FROM sides, w WHERE held),
runs AS (SELECT * FROM (VALUES ('v1', 'mean'), ('v1', 'broken'), ('v1', 'history'), ('v2', 'broken'), ('v2', 'history')) AS r(version, step))
SELECT version, step, step <> 'broken' AS succeeded, CASE WHEN step = 'broken' THEN 'ValueError: no such model' END AS error,
       CASE step WHEN 'mean' THEN mean WHEN 'history' THEN history END AS mae, CASE WHEN step <> 'broken' THEN n END AS scored_rows,
       n_train, train_start, train_end, n_test, test_start, test_end
FROM runs, w, f
""",
    "sides",
)
SQL["m6_prediction_rows"] = compose(
    """
SELECT hotel_id, room_type, count(*) AS n, min(stay_date) AS first_night, max(stay_date) AS last_night,
       0::BIGINT AS below_zero, count(*) FILTER (target_demand IS NULL) AS missing
FROM sides WHERE held GROUP BY 1, 2
""",
    "sides",
)
_NAMES = ", ".join(f"'{f}'" for f in FEATURES)
SQL["m11_importance_shares"] = f"""
SELECT {len(FEATURES)}::BIGINT AS features, {len(FEATURES)}::BIGINT AS different, 1.0::DOUBLE AS total, 0::BIGINT AS outside,
       sha256(array_to_string(list_sort([{_NAMES}]), ',')) AS names
"""

# --- two years of history ---------------------------------------------------------------------

cte(
    "two_years",
    f"SELECT {ROOM}, ds, y FROM series UNION ALL SELECT {ROOM}, (ds - 400)::DATE, y * 0.9::DOUBLE FROM series",
    "series",
)
register_filled("two_years", "longer")
register("longer", ROOM)
cte(
    "day_terms",
    """
SELECT d.day, CASE WHEN h.name IS NOT NULL THEN h.name || '|0' WHEN e.name IS NOT NULL THEN e.name || '|-1'
                   WHEN a.name IS NOT NULL THEN a.name || '|1' END AS term,
       greatest(1, 10 * coalesce(h.sig, e.sig, a.sig)) AS scale
FROM days d LEFT JOIN holidays h ON h.day = d.day LEFT JOIN holidays e ON e.day = d.day + 1
  LEFT JOIN holidays a ON a.day = d.day - 1
""",
    "days",
    "holidays",
)
cte(
    "longer_base",
    f"""
SELECT {ROOM}, ds, y, n, month(ds) AS m, term, scale,
       (intercept + slope * date_diff('day', DATE '2020-01-01', ds)) * weekly AS base
FROM (SELECT *, isodow(ds) AS wd FROM longer) JOIN longer_trend USING ({ROOM}) JOIN longer_weekly USING ({ROOM}, wd)
  JOIN day_terms ON day = ds
""",
    "longer",
    "longer_trend",
    "longer_weekly",
    "day_terms",
)
cte(
    "longer_months",
    f"""
SELECT {ROOM}, m, (sum(y * base) + 0.01::DOUBLE) / (sum(base * base) + 0.01::DOUBLE) AS yearly
FROM longer_base WHERE n >= 730 GROUP BY {ROOM}, m
""",
    "longer_base",
)
cte(
    "longer_festive",
    f"""
SELECT {ROOM}, term, (sum(y * x) + max(w)) / (sum(x * x) + max(w)) AS festive
FROM (SELECT b.*, base * yearly AS x, 1 / pow(max(scale) OVER (PARTITION BY {ROOM}, term), 2) AS w
      FROM longer_base b JOIN longer_months USING ({ROOM}, m) WHERE term IS NOT NULL)
GROUP BY {ROOM}, term
""",
    "longer_base",
    "longer_months",
)
SQL["m1_two_year_terms"] = compose(
    f"""
SELECT {ROOM}, n AS n_observations, kind, term, round(factor, 9) AS factor
FROM (SELECT {ROOM}, 'month' AS kind, m::VARCHAR AS term, yearly AS factor FROM longer_months
      UNION ALL SELECT {ROOM}, 'holiday', term, festive FROM longer_festive) JOIN longer_trend USING ({ROOM})
""",
    "longer_months",
    "longer_festive",
    "longer_trend",
)
_CENTRE = """(intercept + slope * date_diff('day', DATE '2020-01-01', ds)) * coalesce(weekly, 1) * coalesce(yearly, 1)
  * coalesce(festive, 1)"""
SQL["m1_two_year_forecast"] = compose(
    f"""
, q AS (
  SELECT {ROOM}, quantile_cont(r, 0.1) AS low, quantile_cont(r, 0.9) AS high
  FROM (SELECT {ROOM}, y - base * coalesce(yearly, 1) * coalesce(festive, 1) AS r FROM longer_base
        LEFT JOIN longer_months USING ({ROOM}, m) LEFT JOIN longer_festive USING ({ROOM}, term))
  GROUP BY {ROOM}),
c AS (
  SELECT {ROOM}, ds, capacity, low, high, {_CENTRE} AS centre
  FROM longer_trend JOIN q USING ({ROOM}) CROSS JOIN
       (SELECT day AS ds, isodow(day) AS wd, month(day) AS m, term FROM day_terms
        WHERE day BETWEEN DATE '2025-12-10' AND DATE '2026-02-07')
  LEFT JOIN longer_weekly USING ({ROOM}, wd) LEFT JOIN longer_months USING ({ROOM}, m)
  LEFT JOIN longer_festive USING ({ROOM}, term))
SELECT {ROOM}, ds, round(greatest(0, least(capacity, centre)), 6) AS forecast,
       round(greatest(0, least(capacity, centre + low)), 6) AS forecast_lower,
       round(greatest(0, least(capacity, centre + high)), 6) AS forecast_upper
FROM c
""",
    "longer_trend",
    "longer_weekly",
    "longer_months",
    "longer_festive",
    "longer_base",
    "day_terms",
)
