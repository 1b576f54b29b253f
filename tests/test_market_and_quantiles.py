"""Freshest rates, no look-ahead, and quantiles of skewed values."""

from datetime import date

import numpy as np
from pyspark.sql import functions as F

from nightledger.operators import analytics, market, monitoring
from nightledger.operators.quantiles import exact_quantiles

RATE = (
    "hotel_id string, room_type string, stay_date date, competitor string, source string,"
    " price double, collected_at timestamp_ntz"
)


def rates(spark, rows):
    night = date(2026, 6, 10)
    out = spark.createDataFrame([("H1", "deluxe", night, c, c, p, None) for c, p, _ in rows], RATE)
    times = F.create_map(*[x for c, p, t in rows for x in (F.lit(f"{c}{p}"), F.lit(t))])
    key = F.concat("competitor", F.col("price").cast("string"))
    return out.withColumn("collected_at", times[key].cast("timestamp"))


def test_freshest_price_orders_fractions_of_seconds_and_cents(spark):
    seen = rates(
        spark,
        [
            ("a", 6000.0, "2026-06-01 10:00:00.1"), ("a", 7000.0, "2026-06-01 10:00:00.9"),
            ("b", 6000.004, "2026-06-01 10:00:00"), ("b", 6000.001, "2026-06-01 10:00:00"),
            ("c", 3000000.0, "2026-06-01 10:00:00"), ("c", 2500000.0, "2026-06-01 10:00:00"),
        ],
    )
    got = {r.competitor: r.price for r in market.freshest_per_source(seen).collect()}
    assert got == {"a": 7000.0, "b": 6000.001, "c": 2500000.0}


def test_later_rates_move_nothing(spark):
    early = [("a", 5000.0, "2026-06-01 00:00:00"), ("b", 5200.0, "2026-05-30 08:00:00")]
    late = [("a", 9000.0, "2026-06-01 00:00:01"), ("b", 9100.0, "2026-06-05 00:00:00")]
    as_of = date(2026, 6, 1)
    one, two = rates(spark, early), rates(spark, early + late)
    assert market.market_as_of(one, as_of).collect() == market.market_as_of(two, as_of).collect()
    moment = "2026-06-01 00:00:00"
    assert analytics.feed_status(one, moment).collect() == analytics.feed_status(two, moment).collect()


def test_quantiles_of_a_sliver_and_an_outlier(spark):
    values = np.concatenate([np.linspace(1.0, 1.001, 4_000), [1e12]])
    rows = [("x", float(v), 1) for v in values] + [("y", 5.0, 7)]
    counted = spark.createDataFrame(rows, "k string, value double, n long")
    got = {r.k: r.q for r in exact_quantiles(counted, ["k"], [0.0, 0.25, 0.5, 0.95, 1.0]).collect()}
    assert np.allclose(got["x"], np.quantile(values, [0.0, 0.25, 0.5, 0.95, 1.0]))
    assert got["y"] == [5.0] * 5


def test_health_window_takes_every_row(spark):
    rows = spark.range(12_000).selectExpr(
        "cast(id AS STRING) AS prediction_id", "0.5D + (id % 7) / 100D AS blended_demand",
        "0.8D AS confidence", "cast(id AS DOUBLE) AS latency_ms",
        "TIMESTAMP'2026-01-02 00:00:00' - make_interval(0, 0, 0, 0, 0, 0, id) AS created_at",
    )
    stats = monitoring.prediction_stats(rows, date(2026, 1, 2)).first()
    assert stats.n == 12_000 and stats.latency_p95_ms == round(float(np.quantile(np.arange(12_000), 0.95)), 2)


def test_places_with_equals_across_ranges(spark):
    revpars = [float(i % 211) for i in range(3_000)] + [500.0] * 1_500 + [0.5, 999.0]
    rows = [(f"H{i}", "city", r) for i, r in enumerate(revpars)] + [("none", "city", None), ("none too", None, None)]
    table = spark.createDataFrame(rows, "hotel_id string, city string, revpar double")
    got = analytics.revpar_ranking(table.drop("revpar"), table.drop("city"))
    places = {r.hotel_id: (r.place, r.revpar) for r in got.collect()}
    first = {}
    for i, r in enumerate(sorted(revpars, reverse=True)):
        first.setdefault(r, i + 1)
    first[None] = len(revpars) + 1
    assert places == {h: (first[r], r) for h, _, r in rows}
    assert analytics.revpar_ranking(table.drop("revpar").limit(0), table.drop("city")).count() == 0
    assert got.schema["place"].dataType.simpleString() == "int"
