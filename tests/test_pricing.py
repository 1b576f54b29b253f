"""Adjustments and guardrails, each from both sides and at the edge."""

import math
from datetime import date

import pytest

from nightledger.operators.demand import blend
from nightledger.operators.pricing import explanation, price_grid

COLUMNS = (
    "hotel_id string, room_type string, stay_date date, base_price double, current_price double,"
    " occupancy_rate double, days_to_checkin int, competitor_rate double, competitor_min_rate double,"
    " competitor_max_rate double, season string, is_weekend boolean, is_holiday boolean,"
    " event_score double, floor_price double, ceiling_price double, blended_demand double, confidence double"
)
NEUTRAL = dict(
    hotel_id="H001", room_type="deluxe", stay_date=date(2026, 5, 5), base_price=5000.0, current_price=None,
    occupancy_rate=0.6, days_to_checkin=14, competitor_rate=None, competitor_min_rate=None,
    competitor_max_rate=None, season=None, is_weekend=False, is_holiday=False, event_score=0.0,
    floor_price=None, ceiling_price=None, blended_demand=0.65, confidence=1.0,
)
NAMES = list(NEUTRAL)


def price(spark, *cases):
    rows = [tuple({**NEUTRAL, **case}[n] for n in NAMES) for case in cases]
    return price_grid(spark.createDataFrame(rows, COLUMNS)).collect()


def rules(row):
    return [g.rule for g in row.guardrails]


def test_adjustments(spark):
    neutral, high, broken, early, late, market, far, festive = price(
        spark,
        {},
        dict(blended_demand=0.70, confidence=0.85),
        dict(blended_demand=math.nan),
        dict(occupancy_rate=1.0, days_to_checkin=30),
        dict(occupancy_rate=0.0, days_to_checkin=0),
        dict(competitor_rate=5500.0),
        dict(competitor_rate=50000.0),
        dict(event_score=1.0, is_holiday=True, is_weekend=True),
    )
    assert neutral.final_price == 5000 and neutral.guardrails == []
    assert high.demand_adjustment == pytest.approx((0.70 / 0.65 - 1) * 0.6)
    assert high.total_adjustment == pytest.approx(high.demand_adjustment * 0.925)
    assert broken.demand_adjustment == pytest.approx(0.0)
    assert early.occupancy_adjustment == pytest.approx(0.20)
    assert late.occupancy_adjustment == pytest.approx(-0.20)
    assert market.competitor_adjustment == pytest.approx(0.05)
    assert far.competitor_adjustment == pytest.approx(0.15)
    assert festive.event_adjustment == pytest.approx(0.15 * (1 - 0.1 * 0.5 * 0.7))


def test_guardrails_apply_in_order(spark):
    block, rise, fall, edge, upper, exceptional, lower, low, high, room = price(
        spark,
        dict(occupancy_rate=0.39, current_price=4000.0),
        dict(current_price=4000.0),
        dict(current_price=8000.0),
        dict(current_price=5000.0 / 1.15),
        dict(competitor_max_rate=4000.0),
        dict(competitor_max_rate=2600.0, blended_demand=0.95, confidence=0.0),
        dict(competitor_min_rate=8000.0),
        dict(base_price=1000.0),
        dict(base_price=40000.0),
        dict(floor_price=5200.0, ceiling_price=9000.0),
    )
    assert rules(block) == ["LOW_OCCUPANCY_RISE_BLOCK"] and block.final_price == 4000
    assert rules(rise) == ["MAX_DAILY_RISE"] and rise.final_price == 4600
    assert rules(fall) == ["MAX_DAILY_FALL"] and fall.final_price == 6800
    assert rules(edge) == []
    assert rules(upper) == ["COMPETITOR_UPPER_BAND"] and upper.final_price == 4800
    assert rules(exceptional) == []
    assert rules(lower) == ["COMPETITOR_LOWER_BAND"] and lower.final_price == 6400
    assert rules(low) == ["MIN_PRICE_FLOOR"] and low.final_price == 2500
    assert rules(high) == ["MAX_PRICE_CEILING"] and high.final_price == 25000
    assert rules(room) == ["ROOM_FLOOR"] and room.final_price == 5200


def test_every_price_stays_inside_the_limits(spark):
    wild = [math.nan, math.inf, -math.inf, None, 0.0, -1.0, 1e12]
    cases = [
        {field: value, "confidence": 0.5}
        for field in ("blended_demand", "occupancy_rate", "competitor_rate", "event_score")
        for value in wild
    ]
    for row in price(spark, *cases):
        assert 2500 <= row.final_price <= 25000
    bad, = price(spark, dict(base_price=0.0))
    assert bad.final_price is None and bad.pricing_error


def test_filters_on_prices_plan_quickly(spark):
    rows = [tuple({**NEUTRAL, "competitor_rate": 5000.0 + i}[n] for n in NAMES) for i in range(50)]
    priced = price_grid(spark.createDataFrame(rows, COLUMNS))
    # Half-even rounding takes 5000.5 down, so two rows stay at the base price.
    assert priced.where("final_price > 5000").count() == priced.count() - 2
    assert "Final price" in explanation(priced).first().explanation


def test_blend_of_estimates(spark):
    frame = spark.createDataFrame(
        [
            (0.6, 0.5, 0.7, 0.8, 0.7, 0.9, None),
            (0.6, 0.5, 0.7, None, None, None, None),
            (None, None, None, None, None, None, 0.4),
            (None, None, None, None, None, None, None),
            (0.2, 0.1, 0.3, 0.9, 0.8, 1.0, None),
        ],
        "forecast double, forecast_lower double, forecast_upper double, boosted double,"
        " boosted_lower double, boosted_upper double, fallback_demand double",
    )
    both, single, stored, nothing, apart = blend(frame).collect()
    assert both.blended_demand == pytest.approx(0.7)
    assert both.confidence == pytest.approx(0.6 * 0.6 + 0.4 * (1 - 0.2 / 0.35), abs=1e-4)
    assert single.confidence == pytest.approx(0.6) and single.degraded and single.sources == ["series"]
    assert stored.blended_demand == 0.4 and stored.confidence == 0.25
    assert nothing.blended_demand == 0.65 and nothing.demand_lower == pytest.approx(0.45)
    assert apart.notes == ["estimates disagree"]


def test_nights_are_summed_once_for_decisions(spark, monkeypatch):
    """Context, models and history of a reprice, and both audit tables, read what is written once."""
    from nightledger.catalog import pricing as Q

    nights = [("H001", "deluxe", date(2025, 11, 1 + i), 0.5, 0.5) for i in range(20)]
    built, seen = [], {}

    def stored(spark, folder):
        built.append(folder)
        return spark.createDataFrame(nights, "hotel_id string, room_type string, stay_date date, target_demand double, occupancy_rate double")

    def reprice(context, models, history):
        seen.update(context=context, history=history)
        return context

    monkeypatch.setattr(Q, "stored", stored)
    monkeypatch.setattr(Q, "context", lambda spark, folder, features=None: stored(spark, folder) if features is None else features)
    monkeypatch.setattr(Q.P, "reprice", reprice)
    Q.decisions(spark, "f")
    assert built == ["f"]
    assert all(len(frame.inputFiles()) > 0 for frame in seen.values())
    assert seen["context"].count() == 20

    def audit_tables(decisions, *rest):
        seen["audit"] = decisions
        out = decisions.selectExpr("cast(stay_date AS STRING) AS prediction_id", "1D AS final_recommended_price")
        return out, out

    monkeypatch.setattr(Q, "decisions", lambda spark, folder: stored(spark, folder))
    monkeypatch.setattr(Q.P, "audit_tables", audit_tables)
    assert [tuple(r) for r in Q.p16(spark, "f").collect()] == [(20, 20)]
    assert len(seen["audit"].inputFiles()) > 0
