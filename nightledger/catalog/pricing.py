"""Pricing family: blend, adjustments, guardrails, decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nightledger.catalog import Registry
from nightledger.catalog import features as FQ
from nightledger.config import GRAIN
from nightledger.functions.calendar import is_weekend, season_of, with_calendar
from nightledger.functions.numeric import settled
from nightledger.operators import bookings as B
from nightledger.operators import demand as D
from nightledger.operators import forecast as S
from nightledger.operators import market as M
from nightledger.operators import pricing as R
from nightledger.plans import pricing as P
from nightledger.sources import warehouse as W
from nightledger.sources.files import write_and_read

QUERIES = Registry()

_K = "(dayofyear(stay_date) * 3 + room_count + cast(substring(hotel_id, 2) AS INT) * 5)"
SWEEP = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.98)
RUN_AT = "2025-12-01 00:00:00"


def grid(spark: SparkSession, folder: str) -> DataFrame:
    """Every booked room night with a spread of inputs, including broken ones."""
    cells = (
        W.bookings(spark, folder)
        .selectExpr("hotel_id", "room_type", "check_in_date AS stay_date")
        .distinct()
        .join(W.rooms(spark, folder), ["hotel_id", "room_type"])
    )
    dated = with_calendar(cells).withColumn("k", F.expr(_K))
    rate = "base_price * (60 + k % 90) / 100"
    return dated.select(
        *GRAIN,
        F.expr("CASE WHEN k % 97 = 0 THEN 0D ELSE base_price END").alias("base_price"),
        F.expr(
            "CASE WHEN k % 41 = 0 THEN 0D WHEN k % 4 <> 0 THEN base_price * (70 + k % 60) / 100 END"
        ).alias("current_price"),
        F.expr("CASE WHEN k % 29 <> 0 THEN (k * 7 % 101) / 100D END").alias("occupancy_rate"),
        F.expr("dayofyear(stay_date) % 45").alias("days_to_checkin"),
        F.expr(
            f"CASE WHEN k % 7 = 0 THEN NULL WHEN k % 31 = 0 THEN double('NaN') ELSE {rate} END"
        ).alias("competitor_rate"),
        F.expr(f"CASE WHEN k % 7 <> 0 THEN {rate} * 90 / 100 END").alias("competitor_min_rate"),
        F.expr(
            f"CASE WHEN k % 11 = 0 THEN 0D WHEN k % 7 <> 0 THEN {rate} * 110 / 100 END"
        ).alias("competitor_max_rate"),
        season_of("stay_date").alias("season"),
        is_weekend("stay_date").alias("is_weekend"),
        F.expr("holiday_name IS NOT NULL").alias("is_holiday"),
        F.expr("(k % 11) / 10D").alias("event_score"),
        F.expr("CASE WHEN k % 5 <> 0 THEN floor_price END").alias("floor_price"),
        F.expr("CASE WHEN k % 6 <> 0 THEN ceiling_price END").alias("ceiling_price"),
        F.expr(
            "CASE WHEN k % 17 = 0 THEN NULL WHEN k % 19 = 0 THEN double('NaN')"
            " WHEN k % 23 = 0 THEN double('Infinity') ELSE (k * 13 % 160) / 100D END"
        ).alias("blended_demand"),
        F.expr("(k * 3 % 101) / 100D").alias("confidence"),
    )


def flat(decisions: DataFrame) -> DataFrame:
    """Decisions with the guardrail log as text, for reports."""
    return decisions.withColumn(
        "rules", F.expr("array_join(transform(guardrails, g -> g.rule), ',')")
    ).drop("guardrails")


DIGITS = dict(
    demand_raw=9,
    demand_adjustment=9,
    occupancy_raw=9,
    occupancy_adjustment=9,
    competitor_raw=9,
    competitor_adjustment=9,
    event_raw=9,
    event_adjustment=9,
    total_adjustment=9,
    raw_price=8,
    price_change_percent=8,
)


def reported(frame: DataFrame) -> DataFrame:
    return settled(frame, **{c: n for c, n in DIGITS.items() if c in frame.columns})


@QUERIES.add("p1_demand_adjustment")
def p1(spark, folder):
    out = R.demand_adjustment(grid(spark, folder))
    return reported(out.select(*GRAIN, "demand_raw", "demand_adjustment", "demand_band"))


@QUERIES.add("p2_occupancy_adjustment")
def p2(spark, folder):
    out = R.occupancy_adjustment(grid(spark, folder))
    return reported(out.select(*GRAIN, "occupancy_raw", "occupancy_adjustment", "occupancy_band"))


@QUERIES.add("p3_competitor_adjustment")
def p3(spark, folder):
    out = R.competitor_adjustment(grid(spark, folder))
    return reported(out.select(*GRAIN, "competitor_raw", "competitor_adjustment", "competitor_band"))


@QUERIES.add("p4_season_adjustment")
def p4(spark, folder):
    return R.season_adjustment(grid(spark, folder)).select(*GRAIN, "season", "season_adjustment")


@QUERIES.add("p5_event_adjustment")
def p5(spark, folder):
    return reported(
        R.event_adjustment(grid(spark, folder)).select(*GRAIN, "event_raw", "event_adjustment")
    )


@QUERIES.add("p6_raw_price")
def p6(spark, folder):
    out = R.raw_price(grid(spark, folder))
    return reported(
        out.select(*GRAIN, "confidence_scale", "total_adjustment", "raw_price", "pricing_error")
    )


def _unsteady(spark, folder) -> DataFrame:
    """The grid with raw prices that include broken and extreme ones."""
    return (
        R.raw_price(grid(spark, folder))
        .withColumn("_k", F.expr("dayofyear(stay_date) + cast(substring(hotel_id, 2) AS INT)"))
        .withColumn(
            "raw_price",
            F.expr(
                "CASE WHEN _k % 13 = 0 THEN double('NaN') WHEN _k % 13 = 1 THEN double('Infinity')"
                " WHEN _k % 13 = 2 THEN -5D WHEN _k % 13 = 3 THEN base_price * 6"
                " WHEN _k % 13 = 4 THEN current_price + 0.004D ELSE raw_price END"
            ),
        )
    )


def _rule_report(spark, folder, *rules: str) -> DataFrame:
    """Per night: the price before and after each of the named rules, where they bit."""
    names = ", ".join(f"'{r}'" for r in rules)
    priced = R.counted(R.guarded_price(_unsteady(spark, folder)), "rules")
    hits = priced.select(
        *GRAIN, F.expr(f"inline(filter(guardrails, g -> g.rule IN ({names})))")
    )
    return settled(
        hits.selectExpr(*GRAIN, "rule", "before AS price_before", "after AS price_after"),
        price_before=8,
        price_after=8,
    )


@QUERIES.add("p7_sanity_guardrail")
def p7(spark, folder):
    return _rule_report(spark, folder, "SANITY_CHECK")


@QUERIES.add("p8_low_occupancy_block")
def p8(spark, folder):
    return _rule_report(spark, folder, "LOW_OCCUPANCY_RISE_BLOCK")


@QUERIES.add("p9_daily_change_cap")
def p9(spark, folder):
    return _rule_report(spark, folder, "MAX_DAILY_RISE", "MAX_DAILY_FALL")


@QUERIES.add("p10_competitor_band")
def p10(spark, folder):
    return _rule_report(spark, folder, "COMPETITOR_UPPER_BAND", "COMPETITOR_LOWER_BAND")


@QUERIES.add("p11_absolute_limits")
def p11(spark, folder):
    return _rule_report(
        spark, folder, "ROOM_CEILING", "ROOM_FLOOR", "MAX_PRICE_CEILING", "MIN_PRICE_FLOOR"
    )


@QUERIES.add("p12_guardrail_log")
def p12(spark, folder):
    out = flat(R.guarded_price(_unsteady(spark, folder)))
    return out.select(*GRAIN, "rules", "final_price")


@QUERIES.add("p12_guardrail_reasons")
def p12b(spark, folder):
    """How often each rule moved a price, with the reason that the log gives."""
    priced = R.counted(R.guarded_price(_unsteady(spark, folder)), "reasons")
    hits = priced.select(F.expr("inline(guardrails)"))
    return hits.groupBy("rule", "reason").agg(F.count("*").alias("n"))


@QUERIES.add("p13_change_percent")
def p13(spark, folder):
    out = R.guarded_price(_unsteady(spark, folder))
    return reported(out.select(*GRAIN, "final_price", "price_change_percent"))


# --- context, demand and the batch reprice --------------------------------------------------


def stored(spark: SparkSession, folder: str) -> DataFrame:
    """Target and occupancy per night as the feature table holds them."""
    return B.book_columns(B.skeleton(FQ.booked(spark, folder), FQ.stock(spark, folder))).select(
        *GRAIN, "target_demand", "occupancy_rate"
    )


def context(spark: SparkSession, folder: str, features: DataFrame | None = None) -> DataFrame:
    """``features``: the stored rows, if they are written already."""
    return P.pricing_context(
        FQ.requests(spark, folder).drop("base_price"),
        stored(spark, folder) if features is None else features,
        M.market_as_of(FQ.rates(spark, folder), W.AS_OF),
        W.rooms(spark, folder),
        W.hotels(spark, folder),
        W.AS_OF,
    )


def past(features: DataFrame) -> DataFrame:
    """What was known at ``AS_OF``: later nights have no label yet."""
    return features.where(F.col("stay_date") < F.lit(W.AS_OF))


def models(features: DataFrame) -> DataFrame:
    return S.fit(S.fill_gaps(S.daily_series(past(features))))


def decisions(spark: SparkSession, folder: str) -> DataFrame:
    # Context, models and history read the nights, which are summed from the bookings once.
    features = write_and_read(stored(spark, folder), "stored")
    return P.reprice(
        context(spark, folder, features),
        models=models(features),
        history=D.weekday_history(past(features)),
    )


@QUERIES.add("m15_blended_demand")
def m15(spark, folder):
    return settled(
        D.blend(_estimates(spark, folder)).select(
            *GRAIN,
            "blended_demand",
            "forecast_weight",
            "demand_lower",
            "demand_upper",
            F.expr("array_join(sources, ',')").alias("sources"),
            "degraded",
        ),
        blended_demand=9,
        demand_lower=9,
        demand_upper=9,
    )


@QUERIES.add("m16_confidence")
def m16(spark, folder):
    return settled(
        D.blend(_estimates(spark, folder)).select(
            *GRAIN, "confidence", "disagreement", F.expr("array_join(notes, '; ')").alias("notes")
        ),
        confidence=6,
        disagreement=9,
    )


def _estimates(spark, folder) -> DataFrame:
    """Two estimates per night with gaps in either, in both and in the history."""
    k = "(dayofyear(stay_date) * 7 + cast(substring(hotel_id, 2) AS INT) * 3 + length(room_type))"
    history = D.weekday_history(stored(spark, folder))
    cells = stored(spark, folder).withColumn("weekday", F.expr("weekday(stay_date)"))
    return cells.join(history, ["hotel_id", "room_type", "weekday"], "left").selectExpr(
        *GRAIN,
        f"CASE WHEN {k} % 3 <> 0 THEN occupancy_rate - 0.2D END AS forecast",
        f"CASE WHEN {k} % 3 <> 0 THEN occupancy_rate - 0.25D END AS forecast_lower",
        f"CASE WHEN {k} % 3 <> 0 THEN occupancy_rate - 0.1D END AS forecast_upper",
        f"CASE WHEN {k} % 5 <> 0 THEN ({k} % 90) / 100D END AS boosted",
        f"CASE WHEN {k} % 5 <> 0 THEN ({k} % 90) / 100D - 0.11D END AS boosted_lower",
        f"CASE WHEN {k} % 5 <> 0 THEN ({k} % 90) / 100D + 0.07D END AS boosted_upper",
        f"CASE WHEN {k} % 2 = 0 THEN fallback_demand END AS fallback_demand",
    )


@QUERIES.add("a11_weekday_history")
def a11(spark, folder):
    return settled(D.weekday_history(stored(spark, folder)), fallback_demand=9)


@QUERIES.add("j7_market_as_of")
def j7(spark, folder):
    return settled(M.market_as_of(FQ.rates(spark, folder), W.AS_OF), competitor_rate=6)


@QUERIES.add("f4_stored_features")
def f4(spark, folder):
    """Stored occupancy and target for every night somebody asked about."""
    asked = FQ.requests(spark, folder).select(*GRAIN)
    return settled(
        asked.join(stored(spark, folder), list(GRAIN), "left"), target_demand=9, occupancy_rate=9
    )


@QUERIES.add("p15_pricing_context")
def p15(spark, folder):
    return settled(
        context(spark, folder),
        occupancy_rate=9,
        competitor_rate=6,
        competitor_min_rate=6,
        competitor_max_rate=6,
        event_score=6,
    )


@QUERIES.add("p14_reprice_grid")
def p14(spark, folder):
    return settled(
        flat(decisions(spark, folder)).select(
            *GRAIN,
            "base_price",
            "current_price",
            "blended_demand",
            "confidence",
            *[f"{a}_adjustment" for a in R.ADJUSTMENTS],
            "total_adjustment",
            "raw_price",
            "final_price",
            "price_change_percent",
            "rules",
        ),
        blended_demand=6,
        confidence=6,
        demand_adjustment=6,
        occupancy_adjustment=6,
        competitor_adjustment=6,
        event_adjustment=6,
        total_adjustment=6,
        raw_price=4,
        price_change_percent=4,
    )


@QUERIES.add("p16_audit_rows")
def p16(spark, folder):
    """Both audit tables written from one frame, read back and matched one to one."""
    priced = write_and_read(decisions(spark, folder), "decisions")
    predictions, audit = P.audit_tables(priced, RUN_AT, "series-1")
    left = write_and_read(predictions, "predictions")
    right = write_and_read(audit, "pricing_decisions")
    return left.join(right.select("prediction_id", "final_recommended_price"), "prediction_id").agg(
        F.count("*").alias("pairs"),
        F.countDistinct("prediction_id").alias("distinct_ids"),
    )


@QUERIES.add("p17_waterfall")
def p17(spark, folder):
    out = R.waterfall(R.raw_price(grid(spark, folder)).where("pricing_error IS NULL"), list(GRAIN))
    return settled(out, amount=8)


@QUERIES.add("p18_occupancy_sweep")
def p18(spark, folder):
    out = R.occupancy_sweep(grid(spark, folder), SWEEP)
    return settled(
        out.select(
            *GRAIN,
            "occupancy_rate",
            "raw_price",
            "final_price",
            F.expr("cast(size(guardrails) AS INT)").alias("guardrail_count"),
        ),
        raw_price=8,
    )


@QUERIES.add("j11_sweep_candidates")
def j11(spark, folder):
    values = ", ".join(f"{v}D" for v in SWEEP)
    cells = W.bookings(spark, folder).selectExpr(
        "hotel_id", "room_type", "check_in_date AS stay_date"
    ).distinct()
    return cells.withColumn("candidate", F.expr(f"explode(array({values}))"))


@QUERIES.add("p19_explanation")
def p19(spark, folder):
    return R.explanation(R.price_grid(grid(spark, folder))).select(*GRAIN, "explanation")


@QUERIES.add("p20_price_events")
def p20(spark, folder):
    priced = R.price_grid(grid(spark, folder)).withColumn(
        "prediction_id", F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in GRAIN]))
    )
    events = R.price_events(priced, "series-1")
    return events.selectExpr(
        "key",
        "get_json_object(payload, '$.prediction_id') AS prediction_id",
        "get_json_object(payload, '$.room_type') AS room_type",
        "get_json_object(payload, '$.check_in_date') AS check_in_date",
        "cast(get_json_object(payload, '$.final_recommended_price') AS DOUBLE) AS final_price",
        "round(cast(get_json_object(payload, '$.raw_recommended_price') AS DOUBLE), 8) AS raw_price",
        "cast(json_array_length(get_json_object(payload, '$.guardrails_applied')) AS INT)"
        " AS guardrail_count",
    )
