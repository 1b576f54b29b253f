"""Monitoring family: data checks, drift, prediction and price health."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nightledger.catalog import Registry
from nightledger.catalog import features as FQ
from nightledger.catalog.reports import audit
from nightledger.config import MONITOR_CONFIG, TARGET
from nightledger.functions.numeric import settled
from nightledger.operators import monitoring as O
from nightledger.sources import warehouse as W
from nightledger.sources.files import write_and_read

QUERIES = Registry()


def stored(spark: SparkSession, folder: str) -> DataFrame:
    """The feature table as monitoring sees it: two versions, some rates missing."""
    return FQ.matrix(spark, folder).withColumns(
        {
            "feature_version": F.expr("CASE WHEN room_type = 'suite' THEN 'v0' ELSE 'v1' END"),
            "competitor_rate": F.expr("CASE WHEN competitor_missing = 0 THEN competitor_rate END"),
            "computed_at": F.expr(
                "timestampadd(HOUR, -(dayofyear(stay_date) % 20) - 40, TIMESTAMP'2025-12-01 00:00:00')"
            ),
        }
    )


def check(name: str):
    def register(build):
        QUERIES[name] = lambda spark, folder: settled(build(spark, folder), value=4)
        return build

    return register


@check("d1_reference_data")
def d1(spark, folder):
    return O.reference_data(W.hotels(spark, folder), W.rooms(spark, folder))


@check("d2_booking_recency")
def d2(spark, folder):
    return O.booking_recency(W.bookings(spark, folder), W.AS_OF)


@check("d3_competitor_freshness")
def d3(spark, folder):
    return O.competitor_freshness(W.competitor_prices(spark, folder), W.AS_OF)


@check("d4_competitor_coverage")
def d4(spark, folder):
    return O.competitor_coverage(W.competitor_prices(spark, folder), W.AS_OF)


@check("d5_feature_freshness")
def d5(spark, folder):
    return O.feature_freshness(stored(spark, folder), W.AS_OF)


@check("d6_feature_version")
def d6(spark, folder):
    return O.feature_version(stored(spark, folder))


@check("d7_feature_nulls")
def d7(spark, folder):
    return O.feature_nulls(stored(spark, folder))


@check("d8_target_range")
def d8(spark, folder):
    return O.target_range(stored(spark, folder))


@check("d9_duplicate_grain")
def d9(spark, folder):
    rows = W.bookings(spark, folder).selectExpr("hotel_id", "room_type", "check_in_date AS stay_date")
    return O.duplicate_grain(rows)


def _data_report(spark, folder) -> DataFrame:
    return O.data_report(
        W.hotels(spark, folder),
        W.rooms(spark, folder),
        W.bookings(spark, folder),
        W.competitor_prices(spark, folder),
        stored(spark, folder),
        W.AS_OF,
    )


@QUERIES.add("d10_data_report")
def d10(spark, folder):
    return settled(_data_report(spark, folder), value=4)


@QUERIES.add("d10_verdict")
def d10b(spark, folder):
    return O.verdict(_data_report(spark, folder))


@QUERIES.add("d11_population_stability")
def d11(spark, folder):
    """PSI of each competitor's prices: the last month against everything before."""
    long = W.competitor_prices(spark, folder).selectExpr(
        "competitor AS feature", "price AS value", "check_in_date >= DATE'2025-11-01' AS recent"
    )
    out = O.population_stability(long)
    return settled(out, psi=6, reference_mean=4, current_mean=4)


@QUERIES.add("d12_psi_severity")
def d12(spark, folder):
    long = W.bookings(spark, folder).selectExpr(
        "channel AS feature",
        "cast(lead_time_days AS DOUBLE) AS value",
        "CASE WHEN channel = 'ota' THEN lead_time_days < 40 ELSE check_in_date >= DATE'2025-11-01'"
        " END AS recent",
    )
    out = O.population_stability(long).withColumn("severity", F.expr(O.psi_severity()))
    return out.select("feature", "severity")


@QUERIES.add("d13_feature_drift")
def d13(spark, folder):
    rounded = settled(
        stored(spark, folder),
        occupancy_rate=6, competitor_rate=6, historical_demand=6, current_room_price=6, lead_time=6,
    )
    # Ranges, shares and means each read the rows, which are built once.
    needed = rounded.select("feature_version", "stay_date", *MONITOR_CONFIG.watched)
    out = O.feature_drift(write_and_read(needed, "stored"), W.AS_OF)
    return settled(out, psi=5, reference_mean=4, current_mean=4)


@check("d14_seasonality_caveat")
def d14(spark, folder):
    return O.seasonality_caveat(stored(spark, folder))


@QUERIES.add("d15_prediction_stats")
def d15(spark, folder):
    return settled(O.prediction_stats(audit(spark, folder), W.AS_OF), outlier_share=6)


@check("d15_prediction_health")
def d15b(spark, folder):
    return O.prediction_checks(O.prediction_stats(audit(spark, folder), W.AS_OF))


@QUERIES.add("d16_price_stats")
def d16(spark, folder):
    return O.price_stats(audit(spark, folder), W.AS_OF)


@check("d16_price_health")
def d16b(spark, folder):
    return O.price_checks(O.price_stats(audit(spark, folder), W.AS_OF))


@QUERIES.add("d17_realised_accuracy")
def d17(spark, folder):
    out = O.realised_accuracy(
        audit(spark, folder), FQ.matrix(spark, folder).select("hotel_id", "room_type", "stay_date", TARGET),
        W.AS_OF,
    )
    return settled(
        out, mae=6, rmse=6, mape=5, smape=5, weighted_mape=5, r2=6, bias=6, mape_coverage=6
    )


@QUERIES.add("j8_predictions_with_outcomes")
def j8(spark, folder):
    served = audit(spark, folder).selectExpr(
        "hotel_id", "room_type", "check_in_date AS stay_date", "blended_demand"
    )
    out = served.where(F.col("stay_date") < F.lit(W.AS_OF)).join(
        FQ.matrix(spark, folder).select("hotel_id", "room_type", "stay_date", TARGET),
        ["hotel_id", "room_type", "stay_date"],
    )
    return settled(out, target_demand=9)


@QUERIES.add("d18_model_report")
def d18(spark, folder):
    # Every check reads the tables, which are built once.
    rows = write_and_read(audit(spark, folder), "served")
    rounded = settled(
        stored(spark, folder),
        occupancy_rate=6, competitor_rate=6, historical_demand=6, current_room_price=6, lead_time=6,
    )
    kept = write_and_read(rounded.select("feature_version", "stay_date", *MONITOR_CONFIG.watched), "stored")
    return settled(O.model_report(kept, rows, rows, W.AS_OF), value=4)


def _health(spark, folder) -> DataFrame:
    rounded = settled(
        stored(spark, folder),
        occupancy_rate=6, competitor_rate=6, historical_demand=6, current_room_price=6, lead_time=6,
    )
    return O.model_health(rounded, audit(spark, folder), W.AS_OF)


@QUERIES.add("d18_model_health")
def d18b(spark, folder):
    """The whole report: checks, drift, statistics, guardrail hits and realised accuracy."""
    # Accuracy is settled as d17 shows it first.
    digits = F.expr("CASE WHEN section <> 'accuracy' THEN value WHEN name LIKE '%mape' THEN round(value, 5) ELSE round(value, 6) END")
    return settled(_health(spark, folder).withColumn("value", digits), value=4)


@QUERIES.add("d18_health_severity")
def d18c(spark, folder):
    return O.health_severity(_health(spark, folder))


@QUERIES.add("j6_hotels_without_rooms")
def j6(spark, folder):
    rooms = W.rooms(spark, folder).select("hotel_id")
    return W.hotels(spark, folder).join(rooms, "hotel_id", "left_anti").select("hotel_id", "city")
