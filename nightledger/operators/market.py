"""Competitor rates: freshest observation per source and market summaries.

"Freshest" is expressed as ``max_by(price, freshness)`` with a numeric order, so Spark keeps a
hash aggregate with map-side combine.  A window or a sort per key would pull a popular
night into one task first.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nightledger.config import FEATURE_CONFIG, GRAIN, FeatureConfig
from nightledger.functions.horizon import horizon
from nightledger.functions.numeric import dbl, ratio

def normalise_rates(raw: DataFrame) -> DataFrame:
    """Typed observations with the lead at which each was seen; unpriced rows dropped."""
    return raw.selectExpr(
        "hotel_id",
        "cast(room_type AS STRING) AS room_type",
        "to_date(check_in_date) AS stay_date",
        "competitor",
        "try_cast(price AS DOUBLE) AS price",
        "cast(collected_at AS TIMESTAMP) AS collected_at",
        "datediff(to_date(check_in_date), to_date(collected_at)) AS observation_lead",
    ).where("price IS NOT NULL")


def freshness() -> Column:
    """Larger is fresher; of equal times the lower price is.

    Microseconds of the observation with the price (to 1e-8) as the low-order part: one
    DECIMAL that orders observations totally and stays mutable in a hash aggregate.
    """
    return F.expr(
        "cast(unix_micros(collected_at) AS DECIMAL(17,0)) * cast(100000000000000000000 AS DECIMAL(21,0))"
        " - coalesce(try_cast(least(price, 1e11D) * 1e8D AS DECIMAL(20,0)), 0BD)"
    )


def freshest_per_source(rates: DataFrame) -> DataFrame:
    """One price per (hotel, room, night, competitor)."""
    return rates.groupBy(*GRAIN, "competitor").agg(F.max_by("price", freshness()).alias("price"))


def visible_rates(rates: DataFrame, config: FeatureConfig = FEATURE_CONFIG) -> DataFrame:
    """Only what had been collected by the snapshot of the night."""
    return rates.where(F.col("observation_lead") >= horizon(config))


def competitor_set(freshest: DataFrame) -> DataFrame:
    """Mean, lowest, highest and number of sources per night."""
    return freshest.groupBy(*GRAIN).agg(
        F.avg("price").alias("competitor_rate"),
        F.min("price").alias("competitor_min_rate"),
        F.max("price").alias("competitor_max_rate"),
        F.count("*").cast("double").alias("competitor_count"),
    )


def market_at_snapshot(rates: DataFrame, config: FeatureConfig = FEATURE_CONFIG) -> DataFrame:
    return competitor_set(freshest_per_source(visible_rates(rates, config)))


def impute_market(frame: DataFrame) -> DataFrame:
    """A market nobody saw is assumed to sit where we are, and is flagged."""
    missing = F.col("competitor_rate").isNull()
    base = F.col("base_price")
    filled = {
        name: F.coalesce(F.col(name), base)
        for name in ("competitor_rate", "competitor_min_rate", "competitor_max_rate")
    }
    return frame.withColumns(
        {
            "competitor_missing": F.when(missing, 1.0).otherwise(0.0),
            "competitor_count": F.coalesce("competitor_count", F.lit(0.0)),
            **filled,
        }
    )


def market_as_of(rates: DataFrame, as_of: date, lookback_days: int = 30) -> DataFrame:
    """Competitive set per night from the newest observations of each source.

    Observations that share the newest timestamp of a source all count.  Prices are
    combined per timestamp first, so ties survive without a rank or a self-join.  Nothing
    collected after ``as_of`` is looked at.
    """
    recent = rates.where(
        (F.col("collected_at") >= F.date_sub(F.lit(as_of), lookback_days).cast("timestamp"))
        & (F.col("collected_at") <= F.lit(as_of).cast("timestamp"))
        & (F.col("price") != 0)
    )
    moments = recent.groupBy(*GRAIN, "competitor", "collected_at").agg(
        F.sum("price").alias("total"),
        F.count("*").alias("n"),
        F.min("price").alias("low"),
        F.max("price").alias("high"),
    )
    newest = moments.groupBy(*GRAIN, "competitor").agg(
        *[F.max_by(c, "collected_at").alias(c) for c in ("total", "n", "low", "high")]
    )
    return newest.groupBy(*GRAIN).agg(
        ratio(F.sum("total"), F.sum("n")).alias("competitor_rate"),
        F.min("low").alias("competitor_min_rate"),
        F.max("high").alias("competitor_max_rate"),
        F.sum("n").alias("competitor_count"),
    )


def market_summary(rates: DataFrame) -> DataFrame:
    """Per night and room: the freshest rates summarised, with the relative spread.

    The whole window is summarised; a row limit belongs to the listing only.
    """
    return competitor_set(freshest_per_source(rates)).withColumn(
        "spread_percent",
        ratio(F.col("competitor_max_rate") - F.col("competitor_min_rate"), F.col("competitor_rate"))
        * 100.0,
    )


def market_kpis(summary: DataFrame, rooms: DataFrame) -> DataFrame:
    """Per room: nights, rates, spread and how often our base rate is above the market."""
    return (
        summary.join(rooms.select("hotel_id", "room_type", "base_price"), ["hotel_id", "room_type"])
        .groupBy("hotel_id", "room_type")
        .agg(
            F.count("*").alias("nights"),
            F.avg("competitor_rate").alias("market_average"),
            F.min("competitor_min_rate").alias("cheapest"),
            F.max("competitor_max_rate").alias("dearest"),
            F.avg("spread_percent").alias("mean_spread"),
            F.avg(F.when(F.col("competitor_rate") < F.col("base_price"), 1.0).otherwise(0.0)).alias(
                "share_above_market"
            ),
        )
    )


def source_summary(rates: DataFrame) -> DataFrame:
    """Per source: mean rate, observations and share available, cheapest first."""
    return (
        rates.groupBy("competitor")
        .agg(
            F.avg("price").alias("rate"),
            F.count("*").alias("observations"),
            F.avg(dbl(F.col("is_available").cast("int"))).alias("available"),
        )
        .orderBy("rate", "competitor")
    )
