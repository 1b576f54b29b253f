"""Seasons, weekends, holidays and city events.

Holidays and events are literals of a fixed size (about forty holidays, nineteen events)
inside the expressions that look a row's day up, so no join is needed and no span of years is
left out: fixed holidays and city events recur by month and day, movable ones are dated.
"""

from __future__ import annotations

from datetime import date

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values ---------------------------------------------------------------------

SEASON_BY_MONTH = {
    1: "winter", 2: "winter", 3: "summer", 4: "summer", 5: "summer", 6: "monsoon",
    7: "monsoon", 8: "monsoon", 9: "monsoon", 10: "autumn", 11: "autumn", 12: "winter",
}

# month, day, name, significance, leisure bias
FIXED_HOLIDAYS = (
    (1, 1, "New Year's Day", 0.95, 0.9),
    (1, 14, "Makar Sankranti / Pongal", 0.55, 0.7),
    (1, 26, "Republic Day", 0.70, 0.6),
    (4, 14, "Ambedkar Jayanti", 0.35, 0.5),
    (5, 1, "Labour Day", 0.30, 0.6),
    (8, 15, "Independence Day", 0.75, 0.7),
    (10, 2, "Gandhi Jayanti", 0.60, 0.6),
    (12, 25, "Christmas", 0.90, 0.95),
    (12, 31, "New Year's Eve", 1.00, 1.0),
)

# day, name, significance, leisure bias
MOVABLE_HOLIDAYS = (
    ("2024-03-25", "Holi", 0.80, 0.75),
    ("2024-04-11", "Eid al-Fitr", 0.65, 0.6),
    ("2024-06-17", "Bakrid", 0.55, 0.6),
    ("2024-09-07", "Ganesh Chaturthi", 0.70, 0.65),
    ("2024-10-12", "Dussehra", 0.75, 0.7),
    ("2024-11-01", "Diwali", 1.00, 0.8),
    ("2025-02-26", "Maha Shivaratri", 0.45, 0.6),
    ("2025-03-14", "Holi", 0.80, 0.75),
    ("2025-03-31", "Eid al-Fitr", 0.65, 0.6),
    ("2025-04-06", "Ram Navami", 0.40, 0.6),
    ("2025-04-18", "Good Friday", 0.40, 0.7),
    ("2025-06-07", "Bakrid", 0.55, 0.6),
    ("2025-08-16", "Janmashtami", 0.50, 0.6),
    ("2025-08-27", "Ganesh Chaturthi", 0.70, 0.65),
    ("2025-10-02", "Dussehra", 0.80, 0.7),
    ("2025-10-20", "Diwali", 1.00, 0.8),
    ("2025-11-05", "Guru Nanak Jayanti", 0.45, 0.6),
    ("2026-02-15", "Maha Shivaratri", 0.45, 0.6),
    ("2026-03-04", "Holi", 0.80, 0.75),
    ("2026-03-21", "Eid al-Fitr", 0.65, 0.6),
    ("2026-03-26", "Ram Navami", 0.40, 0.6),
    ("2026-04-03", "Good Friday", 0.40, 0.7),
    ("2026-05-01", "Buddha Purnima", 0.35, 0.6),
    ("2026-05-27", "Bakrid", 0.55, 0.6),
    ("2026-09-04", "Janmashtami", 0.50, 0.6),
    ("2026-09-14", "Ganesh Chaturthi", 0.70, 0.65),
    ("2026-10-20", "Dussehra", 0.80, 0.7),
    ("2026-11-08", "Diwali", 1.00, 0.8),
    ("2026-11-24", "Guru Nanak Jayanti", 0.45, 0.6),
    ("2027-03-11", "Eid al-Fitr", 0.65, 0.6),
    ("2027-03-22", "Holi", 0.80, 0.75),
    ("2027-09-03", "Ganesh Chaturthi", 0.70, 0.65),
    ("2027-10-09", "Dussehra", 0.80, 0.7),
    ("2027-10-29", "Diwali", 1.00, 0.8),
)

# name, city, first month*100+day, last month*100+day, intensity, even years only
CITY_EVENTS = (
    ("New Year Week", "Goa", 1226, 102, 1.00, False),
    ("Sunburn Festival", "Goa", 1227, 1230, 0.90, False),
    ("Goa Carnival", "Goa", 214, 218, 0.60, False),
    ("Jaipur Literature Festival", "Jaipur", 122, 126, 0.85, False),
    ("Wedding Season (winter)", "Jaipur", 1115, 1215, 0.65, False),
    ("Wedding Season (spring)", "Jaipur", 120, 228, 0.55, False),
    ("Teej Festival", "Jaipur", 805, 812, 0.45, False),
    ("Destination Wedding Season", "Udaipur", 1101, 220, 0.90, False),
    ("Mewar Festival", "Udaipur", 320, 324, 0.50, False),
    ("Bengaluru Tech Summit", "Bengaluru", 1118, 1121, 0.80, False),
    ("Aero India", "Bengaluru", 210, 214, 0.70, True),
    ("IPL Home Fixtures", "Bengaluru", 401, 520, 0.45, False),
    ("Mumbai Marathon", "Mumbai", 117, 119, 0.50, False),
    ("Lakme Fashion Week (spring)", "Mumbai", 311, 315, 0.60, False),
    ("Lakme Fashion Week (autumn)", "Mumbai", 1008, 1012, 0.60, False),
    ("IPL Home Fixtures", "Mumbai", 401, 520, 0.45, False),
    ("India International Trade Fair", "New Delhi", 1114, 1127, 0.80, False),
    ("Auto Expo", "New Delhi", 112, 118, 0.70, True),
    ("Republic Day Week", "New Delhi", 123, 127, 0.60, False),
)

# --------------------------------------------------------------------------------------


def season_of(day: str) -> Column:
    """Season of a date column on the Indian calendar."""
    names = ", ".join(f"'{SEASON_BY_MONTH[month]}'" for month in range(1, 13))
    return F.expr(f"element_at(array({names}), month({day}))")


def is_weekend(day: str) -> Column:
    return F.expr(f"weekday({day}) >= 5")


def literal_table(spark: SparkSession, rows: list[tuple], names: list[str]) -> DataFrame:
    """A small fixed table that stays inside the plan (no job, no Python worker)."""
    columns = {name: list(values) for name, values in zip(names, zip(*rows))}
    return spark.createDataFrame(pa.table(columns))


def _listed(first: date, last: date) -> list[tuple]:
    fixed = [
        (date(year, month, day), name, sig, bias, 1)
        for year in range(first.year, last.year + 1)
        for month, day, name, sig, bias in FIXED_HOLIDAYS
    ]
    movable = [(date.fromisoformat(d), name, sig, bias, 0) for d, name, sig, bias in MOVABLE_HOLIDAYS]
    return [row for row in fixed + movable if first <= row[0] <= last]


def holidays(spark: SparkSession, first: date, last: date) -> DataFrame:
    """One holiday per date: the more significant one, and the fixed one on a tie."""
    names = ["day", "holiday_name", "significance", "leisure_bias", "fixed"]
    rank = F.struct("significance", "fixed")
    return (
        literal_table(spark, _listed(first, last), names)
        .groupBy("day")
        .agg(
            F.max_by("holiday_name", rank).alias("holiday_name"),
            F.max_by("leisure_bias", rank).alias("leisure_bias"),
            F.max("significance").alias("significance"),
        )
    )


def _entry(name: str, significance: float, bias: float, fixed: int) -> str:
    return (
        f"named_struct('significance', {significance}D, 'fixed', {fixed},"
        f' \'holiday_name\', "{name}", \'leisure_bias\', {bias}D)'
    )


# The holidays as map literals: by month and day, and by date.
_YEARLY = ", ".join(
    f"{month * 100 + dom}, {_entry(name, sig, bias, 1)}" for month, dom, name, sig, bias in FIXED_HOLIDAYS
)
_DATED = ", ".join(f"DATE'{d}', {_entry(name, sig, bias, 0)}" for d, name, sig, bias in MOVABLE_HOLIDAYS)


def _holiday(day: str) -> str:
    return (
        f"greatest(try_element_at(map({_YEARLY}), month({day}) * 100 + dayofmonth({day})),"
        f" try_element_at(map({_DATED}), {day}))"
    )


def holiday_on(day: str) -> Column:
    """The holiday of any day (a date expression), or null: the more significant one, the fixed
    one on a tie.

    A struct of significance, fixed, holiday_name and leisure_bias, in that order of rank.
    """
    return F.expr(_holiday(day))


def holiday_proximity(day: str, window: int = 2) -> Column:
    """The strongest pressure of a holiday within ``window`` days, with linear decay."""
    offsets = ", ".join(str(o) for o in range(-window, window + 1))
    felt = f"{_holiday(f'date_add({day}, o)')}.significance * (1D - abs(o) / {float(window + 1)}D)"
    return F.expr(f"round(coalesce(array_max(transform(array({offsets}), o -> {felt})), 0D), 4)")


def city_events(spark: SparkSession) -> DataFrame:
    return literal_table(
        spark,
        list(CITY_EVENTS),
        ["event_name", "city", "opens", "closes", "intensity", "biennial"],
    )


def event_is_active(day: str) -> Column:
    """Window test for a row carrying ``opens``, ``closes`` and ``biennial``."""
    md = f"(month({day}) * 100 + dayofmonth({day}))"
    return F.expr(
        f"(NOT biennial OR year({day}) % 2 = 0) AND CASE WHEN opens <= closes"
        f" THEN {md} BETWEEN opens AND closes ELSE {md} >= opens OR {md} <= closes END"
    )


def city_event_on(city: Column, day: Column) -> Column:
    """What is on in a city on any day, or null: a struct of event_score and event_names.

    Overlapping events combine as ``1 - product(1 - intensity)``; names come strongest first.
    """
    names = ("event_name", "city", "opens", "closes", "intensity", "biennial")
    listed = F.array(
        *[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, event)]) for event in CITY_EVENTS]
    )
    md = F.month(day) * 100 + F.dayofmonth(day)

    def active(e: Column) -> Column:
        inside = F.when(e["opens"] <= e["closes"], md.between(e["opens"], e["closes"])).otherwise(
            (md >= e["opens"]) | (md <= e["closes"])
        )
        return (e["city"] == city) & (~e["biennial"] | (F.year(day) % 2 == 0)) & inside

    found = F.filter(listed, active)
    quiet = F.aggregate(found, F.lit(1.0), lambda acc, e: acc * (1.0 - e["intensity"]))
    ranked = F.array_sort(F.transform(found, lambda e: F.struct((-e["intensity"]).alias("k"), e["event_name"].alias("event_name"))))
    return F.when(
        F.size(found) > 0,
        F.struct(
            F.round(1.0 - quiet, 4).alias("event_score"),
            F.transform(ranked, lambda e: e["event_name"]).alias("event_names"),
        ),
    )


def with_calendar(frame: DataFrame, day: str = "stay_date") -> DataFrame:
    """Attach holiday columns for ``day``; an ordinary day has no name and proximity 0."""
    on = holiday_on(day)
    return frame.withColumns(
        {
            "holiday_name": on["holiday_name"],
            "leisure_bias": on["leisure_bias"],
            "holiday_proximity": holiday_proximity(day),
        }
    )
