"""CTEs of the series forecaster."""

from oracles.base import cte

cte(
    "series",
    """
SELECT hotel_id, room_type, stay_date AS ds, realised AS y FROM skeleton
""",
    "skeleton",
)
cte("past_series", "SELECT * FROM series WHERE ds < DATE '2025-12-01'", "series")


def register_filled(source: str, name: str) -> None:
    """Every calendar day of each series of ``source``, gaps on the line between neighbours."""
    cte(
        f"{name}_days",
        f"""
SELECT s.hotel_id, s.room_type, d.day AS ds
FROM (SELECT hotel_id, room_type, min(ds) AS a, max(ds) AS b FROM {source} GROUP BY ALL) s
JOIN days d ON d.day BETWEEN s.a AND s.b
""",
        source,
        "days",
    )
    cte(
        name,
        f"""
SELECT hotel_id, room_type, ds,
       CASE WHEN y IS NOT NULL THEN y
            ELSE y0 + (y1 - y0) * date_diff('day', d0, ds) / date_diff('day', d0, d1) END AS y
FROM (
  SELECT d.hotel_id, d.room_type, d.ds, s.y,
         last_value(s.y IGNORE NULLS) OVER w AS y0, last_value(s.ds IGNORE NULLS) OVER w AS d0,
         first_value(s.y IGNORE NULLS) OVER v AS y1, first_value(s.ds IGNORE NULLS) OVER v AS d1
  FROM {name}_days d LEFT JOIN {source} s USING (hotel_id, room_type, ds)
  WINDOW w AS (PARTITION BY d.hotel_id, d.room_type ORDER BY d.ds
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         v AS (PARTITION BY d.hotel_id, d.room_type ORDER BY d.ds
               ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
""",
        f"{name}_days",
        source,
    )


register_filled("series", "filled")
register_filled("past_series", "past")


def fitted(source: str, keys: str) -> tuple[str, str, str]:
    """Trend, weekday factors and band of every series in ``source`` (under two years)."""
    on = ", ".join(keys.split(", "))
    trend = f"""
SELECT {keys}, count(*) AS n, min(ds) AS history_start, max(ds) AS history_end,
       greatest(max(y) * 1.15::DOUBLE, 0.1::DOUBLE) AS capacity,
       regr_slope(y, date_diff('day', DATE '2020-01-01', ds)) AS slope,
       regr_intercept(y, date_diff('day', DATE '2020-01-01', ds)) AS intercept
FROM {source} GROUP BY {keys} HAVING count(*) >= 90
"""
    weekly = f"""
SELECT {keys}, isodow(ds) AS wd,
       coalesce(sum(y) / nullif(sum(intercept + slope * date_diff('day', DATE '2020-01-01', ds)), 0), 1)
         AS weekly
FROM {source} JOIN {source}_trend USING ({on}) GROUP BY {keys}, isodow(ds)
"""
    band = f"""
SELECT {keys}, quantile_cont(r, 0.1) AS q_low, quantile_cont(r, 0.9) AS q_high
FROM (SELECT {keys}, y - (intercept + slope * date_diff('day', DATE '2020-01-01', ds)) * weekly AS r
      FROM (SELECT *, isodow(ds) AS wd FROM {source}) JOIN {source}_trend USING ({on})
      JOIN {source}_weekly USING ({on}, wd))
GROUP BY {keys}
"""
    return trend, weekly, band


def register(source: str, keys: str) -> None:
    trend, weekly, band = fitted(source, keys)
    cte(f"{source}_trend", trend, source)
    cte(f"{source}_weekly", weekly, source, f"{source}_trend")
    cte(f"{source}_band", band, source, f"{source}_trend", f"{source}_weekly")


def forecast(source: str, keys: str, dated: str) -> str:
    """Forecast of ``dated`` (keys, ds, anything else) from the fit over ``source``."""
    centre = "(intercept + slope * date_diff('day', DATE '2020-01-01', ds)) * coalesce(weekly, 1)"
    return f"""
SELECT d.*, intercept + slope * date_diff('day', DATE '2020-01-01', ds) AS trend,
       greatest(0, least(capacity, {centre})) AS forecast,
       greatest(0, least(capacity, {centre} + q_low)) AS forecast_lower,
       greatest(0, least(capacity, {centre} + q_high)) AS forecast_upper
FROM (SELECT *, isodow(ds) AS wd FROM ({dated})) d
JOIN {source}_trend USING ({keys}) JOIN {source}_band USING ({keys})
LEFT JOIN {source}_weekly USING ({keys}, wd)
"""


register("filled", "hotel_id, room_type")
register("past", "hotel_id, room_type")
