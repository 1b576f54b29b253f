"""Report family: listings, trading, market, feature and booking analytics."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nightledger.catalog import Registry
from nightledger.catalog import features as FQ
from nightledger.catalog import models as MQ
from nightledger.catalog import pricing as PQ
from nightledger.config import GRAIN, ROOM_TYPES, TARGET
from nightledger.functions.numeric import settled
from nightledger.operators import analytics as A
from nightledger.operators import forecast as S
from nightledger.operators import market as M
from nightledger.operators import pricing as R
from nightledger.operators import quality as Z
from nightledger.sources.schemas import LOAD_ORDER
from nightledger.sources import files
from nightledger.sources import warehouse as W

QUERIES = Registry()
HOTEL = "H0000"


def facts(spark: SparkSession, folder: str) -> DataFrame:
    return A.nightly_facts(
        W.bookings(spark, folder),
        W.rooms(spark, folder),
        W.hotels(spark, folder),
        W.competitor_prices(spark, folder),
        W.demand_signals(spark, folder),
    )


def kpis(spark, folder) -> DataFrame:
    return A.trading_kpis(W.bookings(spark, folder), W.hotels(spark, folder))


def decisions(spark: SparkSession, folder: str) -> DataFrame:
    priced = R.price_grid(PQ.grid(spark, folder)).where("pricing_error IS NULL")
    return R.counted(priced, "reports")


def audit(spark: SparkSession, folder: str) -> DataFrame:
    """Decisions as the audit tables hold them, with the time each was made."""
    return decisions(spark, folder).select(
        F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in GRAIN])).alias("prediction_id"),
        "hotel_id",
        "room_type",
        F.col("stay_date").alias("check_in_date"),
        F.col("final_price").alias("final_recommended_price"),
        F.col("raw_price").alias("raw_recommended_price"),
        "price_change_percent",
        F.expr("transform(guardrails, g -> g.rule)").alias("guardrails_applied"),
        F.expr(R.finite_or("blended_demand", "NULL")).cast("double").alias("blended_demand"),
        "confidence",
        F.expr("20D + dayofyear(stay_date) % 15").alias("latency_ms"),
        F.lit("series-1").alias("model_version"),
        F.expr(
            "timestampadd(MINUTE, -(dayofyear(stay_date) * 7 % 1000), TIMESTAMP'2025-12-01 00:00:00')"
        ).alias("created_at"),
    )


# --- listings -------------------------------------------------------------------------------


@QUERIES.add("f1_hotel_list")
def f1(spark, folder):
    return A.hotel_list(W.hotels(spark, folder), city="mumbai", active=True, limit=500)


@QUERIES.add("f2_hotel_detail")
def f2(spark, folder):
    out = A.hotel_detail(W.hotels(spark, folder), W.rooms(spark, folder), kpis(spark, folder))
    listed = "array_join(transform(rooms, r -> concat(r.room_type, ':', cast(r.room_count AS STRING))), ',')"
    return out.selectExpr(
        "hotel_id", "city", "star_rating", f"{listed} AS rooms", "occupancy", "adr", "revpar"
    )


@QUERIES.add("f3_training_rows")
def f3(spark, folder):
    stored = FQ.matrix(spark, folder)
    out = A.training_rows(stored, "v1", date(2025, 3, 1), date(2025, 9, 30))
    return settled(out.select(*GRAIN, "feature_version", TARGET), target_demand=9)


@QUERIES.add("f5_rate_listing")
def f5(spark, folder):
    out = A.rate_listing(W.competitor_prices(spark, folder), HOTEL, date(2025, 6, 1))
    return out.select("event_id", "competitor", "room_type", "check_in_date", "price", "is_available")


@QUERIES.add("f6_pricing_history")
def f6(spark, folder):
    rows = audit(spark, folder)
    predictions = rows.select("prediction_id", "blended_demand", "confidence", "model_version")
    out = A.pricing_history(
        rows.drop("blended_demand", "confidence", "model_version"), predictions, HOTEL
    )
    return settled(
        out.select(
            "prediction_id", "room_type", "check_in_date", "final_recommended_price",
            "price_change_percent", "blended_demand", "confidence",
        ),
        price_change_percent=8,
    )


@QUERIES.add("f7_reference_check")
def f7(spark, folder):
    """Requests for hotels or rooms that do not exist, with what the hotel does sell."""
    asked = W.bookings(spark, folder).selectExpr(
        "CASE WHEN lead_time_days = 13 THEN concat('X', hotel_id) ELSE hotel_id END AS hotel_id",
        "CASE WHEN lead_time_days = 17 THEN 'penthouse' ELSE room_type END AS room_type",
    ).distinct()
    return Z.reference_rejects(asked, W.hotels(spark, folder), W.rooms(spark, folder))


@QUERIES.add("f8_request_constraints")
def f8(spark, folder):
    asked = W.bookings(spark, folder).selectExpr(
        "event_id",
        "date_add(check_in_date, CASE WHEN lead_time_days % 9 = 0 THEN 700 ELSE 0 END) AS check_in_date",
        "CASE WHEN lead_time_days % 11 = 0 THEN -1D ELSE adr END AS current_price",
        "adr AS competitor_rate",
        "adr * (1 + lead_time_days % 3) AS competitor_min_rate",
        "adr * 2 AS competitor_max_rate",
        "lead_time_days / 80D AS occupancy_rate",
    )
    return Z.request_rejects(asked, W.AS_OF).groupBy("rejected_reason").agg(F.count("*").alias("n"))


@QUERIES.add("s1_raw_frames")
def s1(spark, folder):
    """Rows of each of the five raw tables, read with the columns the build needs."""
    frames = {
        "rooms": W.rooms(spark, folder),
        "hotels": W.hotels(spark, folder),
        "bookings": W.bookings(spark, folder),
        "competitor_prices": W.competitor_prices(spark, folder),
        "demand_signals": W.demand_signals(spark, folder),
    }
    parts = [
        f.agg(F.count("*").alias("n"), F.countDistinct("hotel_id").alias("hotels")).select(
            F.lit(name).alias("table_name"), "n", "hotels"
        )
        for name, f in frames.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _csv_round_trip(spark, folder) -> DataFrame:
    from nightledger.session import work_dir

    path = work_dir(spark, "bookings-csv")
    rows = files.align(
        W.bookings(spark, folder).withColumn(
            "channel", F.expr("CASE WHEN channel <> 'walk_in' THEN channel END")
        ),
        "bookings",
    )
    files.write_csv(rows, path)
    return files.read_csv(spark, path, "bookings")


@QUERIES.add("s2_csv_read")
def s2(spark, folder):
    return _csv_round_trip(spark, folder).groupBy("channel").agg(
        F.count("*").alias("n"),
        F.min("booking_date").alias("first_booking"),
        F.max("check_out_date").alias("last_check_out"),
        F.sum("revenue").cast("double").alias("revenue"),
    )


@QUERIES.add("s2_csv_tables")
def s2b(spark, folder):
    """All five tables written as CSV in parent order and read back with their schemas."""
    from nightledger.session import work_dir

    frames = {
        "hotels": W.hotels(spark, folder).withColumns(
            {"latitude": F.lit(None).cast("double"), "longitude": F.lit(None).cast("double")}
        ),
        "rooms": W.rooms(spark, folder),
        "bookings": W.bookings(spark, folder),
        "competitor_prices": W.competitor_prices(spark, folder),
        "demand_signals": W.demand_signals(spark, folder),
    }
    parts = []
    for table in LOAD_ORDER:
        if table in frames:
            path = work_dir(spark, f"{table}-csv")
            files.write_csv(files.align(frames[table], table), path)
            read = files.read_csv(spark, path, table)
            parts.append(
                read.agg(F.count("*").alias("n"), F.countDistinct("hotel_id").alias("hotels")).select(
                    F.lit(table).alias("table_name"), "n", "hotels"
                )
            )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@QUERIES.add("s3_csv_write")
def s3(spark, folder):
    """The matrix written as CSV and counted as it is read back; part files carry a header each."""
    from nightledger.session import work_dir

    path = work_dir(spark, "matrix-csv")
    matrix = FQ.matrix(spark, folder)
    files.write_csv(matrix, path)
    back = spark.read.schema(matrix.schema).option("header", True).csv(path)
    return back.agg(F.count("*").alias("rows"), F.count("hotel_id").alias("named"))


@QUERIES.add("s4_aligned_frame")
def s4(spark, folder):
    return files.align(W.bookings(spark, folder).withColumn("unknown", F.lit(1)), "bookings")


@QUERIES.add("s5_bulk_load")
def s5(spark, folder):
    from nightledger.session import work_dir

    path = work_dir(spark, "load")
    frames = {
        "hotels": W.hotels(spark, folder).withColumns(
            {"latitude": F.lit(None).cast("double"), "longitude": F.lit(None).cast("double")}
        ),
        "rooms": W.rooms(spark, folder),
        "bookings": W.bookings(spark, folder),
    }
    done = files.bulk_load(frames, path)
    return files.verify_load(spark, path, done)


@QUERIES.add("s6_load_report")
def s6(spark, folder):
    frames = {
        "hotels": W.hotels(spark, folder),
        "rooms": W.rooms(spark, folder),
        "bookings": W.bookings(spark, folder),
    }
    return files.load_report(frames)


@QUERIES.add("s9_json_report")
def s9(spark, folder):
    from nightledger.session import work_dir

    report = A.matrix_summary(FQ.matrix(spark, folder))
    path = work_dir(spark, "summary-json")
    files.write_json(report, path)
    back = files.read_json(spark, path, report.schema)
    return settled(back, competitor_gap_share=6, target_mean=6, target_std=6)


@QUERIES.add("s11_collection_plan")
def s11(spark, folder):
    plan = A.collection_plan(W.hotels(spark, folder), W.AS_OF, (1, 7, 14, 30), ROOM_TYPES)
    return plan.groupBy("hotel_id", "city", "check_in_date").agg(F.count("*").alias("look_ups"))


@QUERIES.add("s11_collection_budget")
def s11b(spark, folder):
    plan = A.collection_plan(W.hotels(spark, folder), W.AS_OF, (1, 7, 14, 30), ROOM_TYPES)
    return A.collection_budget(plan)


@QUERIES.add("x16_owned_upsert")
def x16(spark, folder):
    """Rebuilt features merged into stored rows whose signals belong to the stream."""
    from nightledger.config import CALENDAR_OWNED, DERIVED_OWNED, SIGNAL_OWNED
    from nightledger.operators.merge import owned_merge
    from nightledger.plans.features import feature_records

    stored = W.demand_signals(spark, folder).withColumn("occupancy_rate", F.lit(None).cast("double"))
    built = feature_records(FQ.matrix(spark, folder))
    merged = owned_merge(
        stored, built, list(GRAIN), list(DERIVED_OWNED), [*SIGNAL_OWNED, *CALENDAR_OWNED]
    )
    return settled(
        merged.select(
            *GRAIN, "search_demand", "weather_score", "local_event_score", "occupancy_rate",
            TARGET, F.col("holiday_flag").cast("int").alias("holiday_flag"),
        ),
        occupancy_rate=9,
        target_demand=9,
    )


@QUERIES.add("c13_integrity_rules")
def c13(spark, folder):
    """Broken integrity rules per table, counted."""
    damaged = W.bookings(spark, folder).withColumns(
        {
            "cancellation_count": F.expr(
                "CASE WHEN lead_time_days = 5 THEN booking_count + 1 ELSE cancellation_count END"
            ),
            "check_out_date": F.expr(
                "CASE WHEN lead_time_days = 6 THEN check_in_date ELSE check_out_date END"
            ),
        }
    )
    return Z.violations(damaged, "bookings")


@QUERIES.add("c13_integrity_of_all_tables")
def c13b(spark, folder):
    """Broken rules of the other tables, each with damage of its own, in one pass per table."""
    number = "cast(substring(hotel_id, 2) AS INT)"
    k = "cast(event_id AS BIGINT)"
    damaged = {
        "hotels": W.hotels(spark, folder).withColumns(
            {
                "star_rating": F.expr(f"CASE WHEN {number} % 3 = 0 THEN 9 ELSE star_rating END"),
                "total_rooms": F.expr(f"CASE WHEN {number} % 4 = 1 THEN 0 ELSE total_rooms END"),
            }
        ),
        "rooms": W.rooms(spark, folder).withColumns(
            {
                "room_type": F.expr(f"CASE WHEN {number} % 5 = 0 THEN 'attic' ELSE room_type END"),
                "floor_price": F.expr(f"CASE WHEN {number} % 2 = 0 THEN ceiling_price ELSE floor_price END"),
                "base_price": F.expr(f"CASE WHEN {number} % 7 = 2 THEN -base_price ELSE base_price END"),
            }
        ),
        "competitor_prices": W.competitor_prices(spark, folder).withColumns(
            {
                "competitor": F.expr(f"CASE WHEN {k} % 11 = 0 THEN 'unknown' ELSE competitor END"),
                "price": F.expr(f"CASE WHEN {k} % 13 = 0 THEN 0D ELSE price END"),
            }
        ),
        "demand_features": FQ.matrix(spark, folder).withColumn(
            "occupancy_rate", F.expr("CASE WHEN day_of_week = 6 THEN 1.5D ELSE occupancy_rate END")
        ).withColumn("target_demand", F.expr("CASE WHEN day_of_week = 2 THEN -1D ELSE target_demand END")),
    }
    parts = [
        Z.violations(frame, table).select(F.lit(table).alias("table_name"), "rule", "broken_rows")
        for table, frame in damaged.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


# --- trading ----------------------------------------------------------------------------------


@QUERIES.add("a4_trading_kpis")
def a4(spark, folder):
    return kpis(spark, folder)


@QUERIES.add("a5_estate_overview")
def a5(spark, folder):
    return settled(
        A.estate_overview(W.hotels(spark, folder), kpis(spark, folder)), occupancy=6, adr=4, revpar=4
    )


@QUERIES.add("a5_revpar_ranking")
def a5b(spark, folder):
    return A.revpar_ranking(W.hotels(spark, folder), kpis(spark, folder))


@QUERIES.add("a6_market_summary")
def a6(spark, folder):
    return settled(M.market_summary(FQ.rates(spark, folder)), competitor_rate=6, spread_percent=6)


@QUERIES.add("a7_market_kpis")
def a7(spark, folder):
    out = M.market_kpis(M.market_summary(FQ.rates(spark, folder)), W.rooms(spark, folder))
    return settled(out, market_average=4, mean_spread=6, share_above_market=6)


@QUERIES.add("a8_source_summary")
def a8(spark, folder):
    return settled(M.source_summary(W.competitor_prices(spark, folder)), rate=4, available=6)


@QUERIES.add("a9_price_spread")
def a9(spark, folder):
    return A.price_spread(W.competitor_prices(spark, folder))


def _month_ahead(spark, folder):
    return S.forecast_range(MQ.fitted(spark, folder), date(2025, 11, 15), 30)


@QUERIES.add("a10_weekly_shape")
def a10(spark, folder):
    return settled(A.weekly_shape(_month_ahead(spark, folder)), mean_forecast=6)


@QUERIES.add("a10_forecast_extremes")
def a10b(spark, folder):
    rounded = settled(_month_ahead(spark, folder), forecast=6, forecast_lower=6, forecast_upper=6)
    return settled(
        A.forecast_extremes(rounded), mean_demand=5, mean_width=5
    )


@QUERIES.add("a12_feed_status")
def a12(spark, folder):
    out = A.feed_status(W.competitor_prices(spark, folder), "2025-12-01 00:30:00")
    return out.withColumn("newest", F.to_date("newest"))


@QUERIES.add("a13_feature_coverage")
def a13(spark, folder):
    partly = FQ.matrix(spark, folder).withColumns(
        {
            "feature_version": F.expr("CASE WHEN room_type <> 'suite' THEN feature_version END"),
            TARGET: F.expr(f"CASE WHEN days_to_checkin < 30 THEN {TARGET} END"),
        }
    )
    return A.feature_coverage(partly)


@QUERIES.add("a14_dataset_summary")
def a14(spark, folder):
    return settled(
        A.dataset_summary(W.bookings(spark, folder)), mean_lead_time=3, cancellation_rate=3, adr=3
    )


@QUERIES.add("a15_matrix_summary")
def a15(spark, folder):
    return settled(
        A.matrix_summary(FQ.matrix(spark, folder)),
        competitor_gap_share=6,
        target_mean=6,
        target_std=6,
    )


@QUERIES.add("a16_target_correlations")
def a16(spark, folder):
    return settled(A.target_correlations(FQ.matrix(spark, folder)), correlation=6)


@QUERIES.add("a17_grouped_correlation")
def a17(spark, folder):
    return settled(
        A.grouped_correlation(facts(spark, folder), "occupancy", "adr"),
        lowest=6,
        median=6,
        highest=6,
    )


@QUERIES.add("a18_cancellation_by_lead")
def a18(spark, folder):
    return settled(A.cancellation_by_lead(W.bookings(spark, folder)), cancellation_rate=9)


@QUERIES.add("a19_lead_by_segment")
def a19(spark, folder):
    booked = W.bookings(spark, folder).join(
        W.hotels(spark, folder).select("hotel_id", "segment"), "hotel_id"
    )
    return settled(A.weighted_lead(booked, "segment"), mean_lead=6)


@QUERIES.add("a19_lead_by_event_band")
def a19b(spark, folder):
    booked = W.bookings(spark, folder).withColumnRenamed("check_in_date", "stay_date")
    banded = booked.join(W.demand_signals(spark, folder), list(GRAIN)).withColumn(
        "band", A.event_band()
    )
    return settled(A.weighted_lead(banded, "band"), mean_lead=6)


def _occupancy_by(*keys: str):
    def query(spark, folder):
        frame = facts(spark, folder).withColumn(
            "season", FQ.C.season_of("stay_date")
        ).withColumn("band", A.event_band())
        return settled(
            frame.groupBy(*keys).agg(F.avg("occupancy").alias("mean_occupancy")), mean_occupancy=6
        )

    return query


QUERIES["a20_occupancy_by_segment_weekend"] = _occupancy_by("segment", "is_weekend")
QUERIES["a20_occupancy_by_city_season"] = _occupancy_by("city", "season")
QUERIES["a20_occupancy_by_event_band"] = _occupancy_by("band")


@QUERIES.add("a20_monthly_range")
def a20(spark, folder):
    monthly = facts(spark, folder).groupBy("city", "room_type", "month").agg(
        F.avg("occupancy").alias("m")
    )
    out = monthly.groupBy("city", "room_type").agg((F.max("m") - F.min("m")).alias("peak_to_trough"))
    return settled(out, peak_to_trough=6)


@QUERIES.add("a21_observation_coverage")
def a21(spark, folder):
    return settled(
        A.observation_coverage(
            W.competitor_prices(spark, folder), W.rooms(spark, folder), 365, 4, 8
        ),
        coverage=9,
    )


@QUERIES.add("a21_median_spread")
def a21b(spark, folder):
    spread = F.expr("(competitor_max - competitor_min) / competitor_rate")
    out = facts(spark, folder).where("competitor_min IS NOT NULL").select(spread.alias("s"))
    return settled(A.median(out, "s").withColumnRenamed("median", "median_spread"), median_spread=6)


@QUERIES.add("a22_nightly_facts")
def a22(spark, folder):
    out = facts(spark, folder).select(
        *GRAIN, "city", "segment", "sold", "revenue", "occupancy", "adr", "dow", "month",
        "competitor_rate", "competitor_min", "competitor_max", "competitor_count", "search_demand",
    )
    return settled(out, occupancy=9, adr=6, competitor_rate=6)


@QUERIES.add("a23_price_histogram")
def a23(spark, folder):
    return settled(A.histogram(W.competitor_prices(spark, folder), "price"), mean=4)


@QUERIES.add("a24_decision_kpis")
def a24(spark, folder):
    return settled(
        A.decision_kpis(decisions(spark, folder)), mean_final=4, mean_change=6, clamped_share=9
    )


@QUERIES.add("a25_guardrail_counts")
def a25(spark, folder):
    return A.guardrail_counts(decisions(spark, folder))


@QUERIES.add("w6_recent_decisions")
def w6(spark, folder):
    from nightledger.operators.monitoring import recent

    return recent(audit(spark, folder), 5000).select("prediction_id", "final_recommended_price")
