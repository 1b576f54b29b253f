"""The feature matrix, serving rows and the rebuild from stored columns."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightledger.config import (
    BASE_FEATURES,
    DERIVED_FEATURES,
    FEATURE_CONFIG,
    FEATURES,
    GRAIN,
    ROOM_KEY,
    SEASON_FEATURES,
    TARGET,
    FeatureConfig,
)
from nightledger.functions.calendar import with_calendar
from nightledger.functions.numeric import clip
from nightledger.operators import bookings as B
from nightledger.operators import features as X
from nightledger.operators import history as H
from nightledger.operators import market as M



def feature_matrix(
    bookings: DataFrame,
    rooms: DataFrame,
    competitor_prices: DataFrame | None,
    signals: DataFrame | None,
    config: FeatureConfig = FEATURE_CONFIG,
    hotels: DataFrame | None = None,
) -> DataFrame:
    """One row per (hotel, room, night) with the 30 features and the target.

    Shuffle layout: bookings, rates and signals are each aggregated on the grain and
    joined on the grain, so the joins reuse the partitioning of the aggregates.  The
    rooms join and the history window then share one shuffle on (hotel, room); where
    rooms are small the join is a broadcast chosen by its size estimate.

    Pass ``hotels`` to take event scores from the city calendar instead of the signals.
    """
    spark = bookings.sparkSession
    booked = B.normalise_bookings(bookings)
    stock = B.normalise_rooms(rooms)

    cells = B.grain_cells(booked, config)
    if competitor_prices is not None:
        rates = M.normalise_rates(competitor_prices)
        cells = cells.join(M.market_at_snapshot(rates, config), list(GRAIN), "left")
    else:
        cells = cells.withColumns(
            {
                c: F.lit(None).cast("double")
                for c in (
                    "competitor_rate",
                    "competitor_min_rate",
                    "competitor_max_rate",
                    "competitor_count",
                )
            }
        )
    if signals is not None:
        cells = cells.join(X.distinct_signals(signals), list(GRAIN), "left")

    cells = (
        cells.join(stock, list(ROOM_KEY))
        .withColumn("realised", B.realised(config))
        .withColumn("snapshot_date", F.date_sub("stay_date", F.col("days_to_checkin")))
    )
    complete = F.col("stay_date") <= B.last_complete_night(booked, stock, config)
    frame = H.with_history(cells.withColumn("complete", complete), F.col("complete"), config)

    frame = B.book_columns(frame).withColumnRenamed("realised", TARGET)
    frame = X.fill_signals(M.impute_market(frame), config)
    frame = X.calendar_columns(with_calendar(frame))
    if hotels is not None:
        frame = frame.join(hotels.select("hotel_id", "city"), "hotel_id", "left")
        frame = X.city_event_override(frame)
    frame = X.derived_columns(frame)
    return frame.select(
        *GRAIN,
        "snapshot_date",
        F.lit(config.version).alias("feature_version"),
        "season",
        "holiday_name",
        "base_price",
        "net_sold",
        *X.ordered_features(),
        TARGET,
    )


def serving_rows(
    requests: DataFrame, as_of: date | None = None, config: FeatureConfig = FEATURE_CONFIG
) -> DataFrame:
    """Feature rows for a batch of price requests.

    ``requests`` holds the grain, ``base_price``, ``total_rooms`` and optionally ``city``
    and whatever else the caller knows; absent and null values take the neutral
    assumption.  Derived columns come from the code the training matrix uses.
    """
    spark = requests.sparkSession

    def given(name: str, kind: str = "double"):
        return F.col(name).cast(kind) if name in requests.columns else F.lit(None).cast(kind)

    day = F.lit(as_of) if as_of is not None else F.col("as_of")
    horizon = F.greatest(F.datediff("stay_date", day), F.lit(0))
    total = given("total_rooms")
    available = given("available_rooms")
    occupancy = clip(
        F.coalesce(
            given("occupancy_rate"), 1.0 - available / F.nullif(total, F.lit(0.0)), F.lit(0.0)
        ),
        0.0,
        1.0,
    )
    base = given("base_price")
    rate = given("competitor_rate")
    rows = requests.withColumns({"_occupancy": occupancy, "_horizon": horizon})
    rows = with_calendar(rows)
    rows = X.calendar_columns(rows)
    event = given("local_event_score")
    if "city" in requests.columns:
        lookup = X.city_event_override(
            rows.withColumn("_given_event", event).withColumn("local_event_score", F.lit(0.0))
        )
        rows = lookup.withColumn(
            "local_event_score", F.coalesce("_given_event", "local_event_score")
        )
    else:
        rows = rows.withColumn("local_event_score", F.coalesce(event, F.lit(0.0)))

    rows = rows.withColumns(
        {
            "occupancy_rate": F.col("_occupancy"),
            "available_rooms": F.coalesce(
                available, F.bround(total * (1.0 - F.col("_occupancy")))
            ),
            "total_rooms": total,
            "booking_count": F.coalesce(given("booking_count"), F.lit(0.0)),
            "cancellation_count": F.coalesce(given("cancellation_count"), F.lit(0.0)),
            "competitor_missing": F.when(rate.isNull(), 1.0).otherwise(0.0),
            "competitor_min_rate": F.coalesce(given("competitor_min_rate"), rate, base),
            "competitor_max_rate": F.coalesce(given("competitor_max_rate"), rate, base),
            "competitor_count": F.coalesce(
                given("competitor_count"), F.when(rate.isNull(), 0.0).otherwise(1.0)
            ),
            "competitor_rate": F.coalesce(rate, base),
            "days_to_checkin": F.col("_horizon").cast("double"),
            "lead_time": F.coalesce(given("lead_time"), F.col("_horizon").cast("double")),
            "search_demand": F.coalesce(given("search_demand"), F.lit(config.default_search)),
            "weather_score": F.coalesce(given("weather_score"), F.lit(config.default_weather)),
            "historical_demand": F.coalesce(given("historical_demand"), F.col("_occupancy")),
            "current_room_price": F.coalesce(given("current_price"), base),
        }
    )
    rows = X.derived_columns(rows)
    return rows.select(*GRAIN, *X.ordered_features())


def stored_columns(matrix: DataFrame) -> DataFrame:
    """What the feature table keeps: keys, base columns, target, version."""
    return matrix.select(
        *GRAIN,
        "season",
        "holiday_name",
        "feature_version",
        *BASE_FEATURES,
        TARGET,
    )


def rebuild_matrix(stored: DataFrame) -> DataFrame:
    """Model input from stored base columns; everything else is a function of them."""
    spark = stored.sparkSession
    frame = with_calendar(stored.drop("holiday_name"))
    frame = frame.withColumns(
        {
            "is_weekend": F.col("is_weekend").cast("double"),
            "holiday_flag": F.col("holiday_flag").cast("double"),
            "competitor_missing": F.when(
                F.coalesce("competitor_count", F.lit(0.0)) == 0, 1.0
            ).otherwise(0.0),
            }
    ).withColumns(X.season_flags())
    frame = X.derived_columns(frame)
    return frame.select(*GRAIN, *X.ordered_features(), TARGET)


def feature_records(matrix: DataFrame) -> DataFrame:
    """Rows as the feature table stores them: whole counts, booleans, NaN as null."""
    counts = (
        "day_of_week",
        "total_rooms",
        "available_rooms",
        "booking_count",
        "cancellation_count",
        "competitor_count",
        "days_to_checkin",
    )
    flags = ("is_weekend", "holiday_flag")
    other = [c for c in (*BASE_FEATURES, TARGET) if c not in counts and c not in flags]
    return matrix.select(
        *GRAIN,
        "season",
        "holiday_name",
        "feature_version",
        *[F.bround(c).cast("bigint").alias(c) for c in counts],
        *[F.col(c).cast("boolean").alias(c) for c in flags],
        *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in other],
    )


def check_contract(columns: list[str]) -> None:
    """Raise a distinct error for missing, unexpected and reordered feature columns."""
    missing = [c for c in FEATURES if c not in columns]
    extra = [c for c in columns if c not in FEATURES]
    if missing:
        raise ValueError(f"missing features: {missing}")
    if extra:
        raise ValueError(f"unexpected features: {extra}")
    if list(columns) != list(FEATURES):
        raise ValueError("features are out of order")


def feature_catalogue(spark) -> DataFrame:
    """Every feature with the group it belongs to."""
    groups = (
        ("inventory / pickup", BASE_FEATURES[:5]),
        ("competitive set", BASE_FEATURES[5:9]),
        ("timing", BASE_FEATURES[9:11]),
        ("demand signal", BASE_FEATURES[11:14]),
        ("calendar", BASE_FEATURES[14:19] + SEASON_FEATURES),
        ("derived", DERIVED_FEATURES),
    )
    rows = [(name, group) for group, names in groups for name in names]
    return spark.createDataFrame(rows, "feature string, feature_group string")


def fingerprint(matrix: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row that changes when any feature or target value (or any of ``columns``) changes.

    Row hashes are added up, so the result does not depend on the order of the rows and
    needs no sort.
    """
    columns = [*GRAIN, *FEATURES, TARGET] if columns is None else columns
    # Whole millionths as text, so that any engine gets the same hash.
    shown = [
        F.col(c).cast("string") if c in GRAIN else F.round(F.col(c) * 1e6).cast("bigint").cast("string")
        for c in columns
    ]
    text = F.concat_ws("|", *[F.coalesce(c, F.lit("null")) for c in shown])
    row = F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("decimal(38,0)")
    return matrix.agg(F.count("*").alias("n"), F.sum(row).alias("total")).select(
        F.col("n").alias("hashed_rows"),
        F.sha2(
            F.concat_ws("|", F.col("n").cast("string"), F.col("total").cast("string"),
                        F.lit(",".join(columns))),
            256,
        ).alias("fingerprint"),
    )
