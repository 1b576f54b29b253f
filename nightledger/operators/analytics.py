"""Trading, market, booking and feature reports."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nightledger.config import FEATURES, GRAIN, ROOM_KEY, TARGET
from nightledger.functions.numeric import ratio
from nightledger.operators.quantiles import exact_quantiles
from nightledger.sources.files import write_and_read

WINDOW_NIGHTS = 30

# --- trading ------------------------------------------------------------------------------


def trading_kpis(bookings: DataFrame, hotels: DataFrame, nights: int = WINDOW_NIGHTS) -> DataFrame:
    """Occupancy, ADR and RevPAR of each hotel over its own last nights.

    Bookings are added up per hotel and night first; both the window end and the totals
    come from that small table, and a hotel with no sales drops out.
    """
    nightly = bookings.groupBy("hotel_id", "check_in_date").agg(
        F.sum(F.col("booking_count") - F.col("cancellation_count")).alias("sold"),
        F.sum("revenue").alias("revenue"),
    )
    ends = nightly.groupBy("hotel_id").agg(F.max("check_in_date").alias("window_end"))
    return (
        nightly.join(ends, "hotel_id")
        .where(F.col("check_in_date") > F.date_sub("window_end", nights))
        .groupBy("hotel_id", "window_end")
        .agg(
            F.sum("sold").alias("sold"),
            F.sum("revenue").alias("revenue"),
            F.count("*").alias("nights"),
        )
        .join(hotels.select("hotel_id", "total_rooms"), "hotel_id")
        .where("sold <> 0 AND total_rooms > 0")
        .withColumns(
            {
                "_occupancy": F.expr("sold / (total_rooms * nights)"),
                "_adr": F.expr("revenue / sold"),
            }
        )
        .selectExpr(
            "hotel_id",
            "round(_occupancy, 4) AS occupancy",
            "round(_adr, 2) AS adr",
            "round(_occupancy * _adr, 2) AS revpar",
        )
    )


def estate_overview(hotels: DataFrame, kpis: DataFrame) -> DataFrame:
    """One row over all hotels; averages over those that trade."""
    return hotels.join(kpis, "hotel_id", "left").agg(
        F.count("*").alias("hotels"),
        F.sum("total_rooms").alias("rooms"),
        F.countDistinct("city").alias("cities"),
        F.avg("occupancy").alias("occupancy"),
        F.avg("adr").alias("adr"),
        F.avg("revpar").alias("revpar"),
    )


def revpar_ranking(hotels: DataFrame, kpis: DataFrame) -> DataFrame:
    """Hotels by revenue per available room, the best first; equals share a rank, none comes last.

    A place is one more than the number of better hotels: those of better ranges of values, then
    those of better values in the same range.  Hotels are counted per value first, so neither a
    range nor a value that many hotels share gathers them in one task.
    """
    traded = hotels.select("hotel_id", "city").join(kpis.select("hotel_id", "revpar"), "hotel_id")
    # Written, since the values are counted, ranged and joined with the hotels again.
    traded = write_and_read(traded, "ranking-hotels")
    values = traded.groupBy("revpar").agg(F.count("*").alias("_n"))
    ranged = values.repartitionByRange(F.desc("revpar")).withColumn("_range", F.spark_partition_id())
    ranged = write_and_read(ranged, "ranking-values")
    # One row per range, of which there are as many as shuffle partitions.
    earlier = F.sum("_size").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    ahead = (
        ranged.groupBy("_range").agg(F.sum("_n").alias("_size")).select("_range", F.coalesce(earlier, F.lit(0)).alias("_ahead"))
    )
    better = F.sum("_n").over(
        Window.partitionBy("_range").orderBy(F.desc("revpar")).rowsBetween(Window.unboundedPreceding, -1)
    )
    places = ranged.withColumn("_better", F.coalesce(better, F.lit(0))).join(ahead, "_range")
    places = places.select(F.col("revpar").alias("_value"), F.expr("int(1 + _ahead + _better)").alias("place"))
    return traded.join(places, F.col("revpar").eqNullSafe(F.col("_value"))).select("place", "hotel_id", "city", "revpar")


def nightly_facts(
    bookings: DataFrame, rooms: DataFrame, hotels: DataFrame, rates: DataFrame, signals: DataFrame
) -> DataFrame:
    """Sales, occupancy, rate, market and signals of every room night."""
    sales = bookings.groupBy("hotel_id", "room_type", F.col("check_in_date").alias("stay_date")).agg(
        F.sum(F.col("booking_count") - F.col("cancellation_count")).alias("sold"),
        F.sum("revenue").alias("revenue"),
        F.sum("booking_count").alias("gross"),
        F.sum("cancellation_count").alias("cancels"),
    )
    market = rates.groupBy("hotel_id", "room_type", F.col("check_in_date").alias("stay_date")).agg(
        F.avg("price").alias("competitor_rate"),
        F.min("price").alias("competitor_min"),
        F.max("price").alias("competitor_max"),
        F.count("*").alias("competitor_count"),
    )
    return (
        sales.join(market, list(GRAIN), "left")
        .join(signals, list(GRAIN), "left")
        .join(rooms.select(*ROOM_KEY, "room_count"), list(ROOM_KEY))
        .join(hotels.select("hotel_id", "city", "segment"), "hotel_id")
        .withColumns(
            {
                "occupancy": F.expr("sold / room_count"),
                "adr": ratio(F.col("revenue"), F.col("sold")),
                "dow": F.expr("weekday(stay_date)"),
                "month": F.expr("month(stay_date)"),
                "is_weekend": F.expr("weekday(stay_date) >= 5"),
            }
        )
    )


def dataset_summary(bookings: DataFrame) -> DataFrame:
    """Per hotel: nights, rows, sales, cancellation rate, ADR.

    Nights are counted through a first aggregate per night, which keeps the distinct
    count a plain hash aggregate with map-side combine.
    """
    nightly = bookings.groupBy("hotel_id", "check_in_date").agg(
        F.count("*").alias("n"),
        F.sum("booking_count").alias("booked"),
        F.sum("cancellation_count").alias("cancelled"),
        F.sum("revenue").alias("revenue"),
        F.sum("lead_time_days").alias("lead"),
    )
    return (
        nightly.groupBy("hotel_id")
        .agg(
            F.count("*").alias("nights"),
            F.sum("n").alias("rows"),
            F.sum("booked").alias("rooms_booked"),
            F.sum(F.col("booked") - F.col("cancelled")).alias("rooms_sold"),
            F.sum("cancelled").alias("cancellations"),
            F.sum("revenue").alias("revenue"),
            F.sum("lead").alias("_lead"),
        )
        .withColumns(
            {
                "mean_lead_time": ratio(F.col("_lead"), F.col("rows")),
                "cancellation_rate": ratio(F.col("cancellations"), F.col("rooms_booked")),
                "adr": ratio(F.col("revenue"), F.col("rooms_sold")),
            }
        )
        .drop("_lead")
    )


# --- bookings -------------------------------------------------------------------------------


def cancellation_by_lead(bookings: DataFrame) -> DataFrame:
    bucket = F.expr(
        "CASE WHEN lead_time_days <= 7 THEN '0-7' WHEN lead_time_days <= 30 THEN '8-30'"
        " WHEN lead_time_days <= 60 THEN '31-60' WHEN lead_time_days <= 90 THEN '61-90' END"
    )
    return (
        bookings.where("lead_time_days > -1 AND lead_time_days <= 90")
        .groupBy(bucket.alias("lead_bucket"))
        .agg(ratio(F.sum("cancellation_count"), F.sum("booking_count")).alias("cancellation_rate"))
    )


def weighted_lead(bookings: DataFrame, by: str) -> DataFrame:
    """Mean lead time weighted by rooms booked."""
    weight = F.col("booking_count")
    return bookings.groupBy(by).agg(
        ratio(F.sum(F.col("lead_time_days") * weight), F.sum(weight)).alias("mean_lead")
    )


def event_band(score: str = "local_event_score"):
    return F.expr(
        f"CASE WHEN {score} < 0.1D THEN 'quiet' WHEN {score} > 0.5D THEN 'busy' ELSE 'between' END"
    )


# --- market ----------------------------------------------------------------------------------


def price_spread(rates: DataFrame, by: str = "competitor") -> DataFrame:
    """Five-number summary of prices per group.

    Prices are counted first and only the buckets around the five ranks are ordered, so a
    group with a third of all rows is never gathered in one task.
    """
    counted = rates.groupBy(by, F.col("price").alias("value")).agg(F.count("*").alias("n"))
    return exact_quantiles(counted, [by], [0.0, 0.25, 0.5, 0.75, 1.0]).selectExpr(
        by, "q[0] AS lowest", "q[1] AS lower_quartile", "q[2] AS median",
        "q[3] AS upper_quartile", "q[4] AS highest",
    )


def median(frame: DataFrame, column: str) -> DataFrame:
    """Exact median of a column of any length, as one row."""
    counted = (
        frame.where(F.col(column).isNotNull())
        .groupBy(F.lit(0).alias("_all"), F.col(column).alias("value"))
        .agg(F.count("*").alias("n"))
    )
    return exact_quantiles(counted, ["_all"], [0.5]).select(F.col("q")[0].alias("median"))


def feed_status(rates: DataFrame, as_of: str) -> DataFrame:
    """Rows in total and within the last hour, the newest observation, rows per source.

    What is stamped later than ``as_of`` had not been seen then and is left out.
    """
    seen = rates.where(F.col("collected_at") <= F.expr(f"TIMESTAMP'{as_of}'"))
    per_source = seen.groupBy("source").agg(
        F.count("*").alias("rows"),
        F.count_if(
            F.col("collected_at") >= F.expr(f"TIMESTAMP'{as_of}' - INTERVAL 1 HOUR")
        ).alias("last_hour"),
        F.max("collected_at").alias("newest"),
    )
    return per_source.orderBy(F.desc("rows"), "source")


def observation_coverage(rates: DataFrame, rooms: DataFrame, nights: int, sources: int, leads: int) -> DataFrame:
    """Observations over the number there could be."""
    possible = rooms.agg((F.count("*") * nights * sources * leads)).scalar()
    return rates.agg(F.count("*").alias("observed")).withColumn("possible", possible).withColumn(
        "coverage", F.expr("observed / possible")
    )


# --- features --------------------------------------------------------------------------------


def feature_coverage(stored: DataFrame) -> DataFrame:
    return stored.agg(
        F.count("*").alias("rows"),
        F.count("feature_version").alias("computed"),
        F.count(TARGET).alias("labelled"),
        F.min("stay_date").alias("first_stay_date"),
        F.max("stay_date").alias("last_stay_date"),
    ).withColumn("coverage", F.expr("coalesce(round(computed / nullif(rows, 0), 4), 0D)"))


def matrix_summary(matrix: DataFrame) -> DataFrame:
    return matrix.agg(
        F.count("*").alias("rows"),
        F.countDistinct("hotel_id").alias("hotels"),
        F.countDistinct("stay_date").alias("stay_dates"),
        F.min("stay_date").alias("first_night"),
        F.max("stay_date").alias("last_night"),
        F.expr(
            "array_join(transform(array_sort(collect_set(cast(days_to_checkin AS INT))),"
            " h -> cast(h AS STRING)), ',')"
        ).alias("horizons"),
        F.avg("competitor_missing").alias("competitor_gap_share"),
        F.avg(TARGET).alias("target_mean"),
        F.stddev_samp(TARGET).alias("target_std"),
    )


def target_correlations(matrix: DataFrame) -> DataFrame:
    """Correlation of every feature with the target, strongest first; one pass."""
    row = matrix.agg(*[F.corr(F.col(c), F.col(TARGET)).alias(c) for c in FEATURES])
    return (
        row.unpivot([], list(FEATURES), "feature", "correlation")
        .where("correlation IS NOT NULL AND NOT isnan(correlation)")
        .orderBy(F.desc(F.abs("correlation")), "feature")
    )


def grouped_correlation(frame: DataFrame, left: str, right: str) -> DataFrame:
    """Lowest, median and highest correlation within the rooms."""
    per_room = (
        frame.groupBy(*ROOM_KEY)
        .agg(F.corr(left, right).alias("value"))
        .where("value IS NOT NULL AND NOT isnan(value)")
    )
    counted = per_room.groupBy(F.lit(0).alias("_all"), "value").agg(F.count("*").alias("n"))
    return exact_quantiles(counted, ["_all"], [0.0, 0.5, 1.0]).selectExpr(
        "q[0] AS lowest", "q[1] AS median", "q[2] AS highest"
    )


def histogram(frame: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """Equal-width bins between the extremes, with the mean to draw beside them."""
    ends = frame.agg(
        F.struct(F.min(column).alias("lo"), F.max(column).alias("hi"), F.avg(column).alias("mean"))
    ).scalar()
    placed = frame.where(F.col(column).isNotNull()).select(
        F.col(column).alias("x"), ends.alias("e")
    )
    position = F.expr(
        f"CASE WHEN e.hi = e.lo THEN 1 ELSE least(cast(floor((x - e.lo) / ((e.hi - e.lo) / {bins}D))"
        f" AS INT) + 1, {bins}) END"
    )
    return placed.groupBy(position.alias("bin")).agg(
        F.count("*").alias("n"), F.max("e.mean").alias("mean")
    )


# --- forecasts --------------------------------------------------------------------------------


def weekly_shape(forecasts: DataFrame) -> DataFrame:
    return forecasts.groupBy(*ROOM_KEY, F.expr("weekday(ds)").alias("weekday")).agg(
        F.avg("forecast").alias("mean_forecast")
    )


def forecast_extremes(forecasts: DataFrame) -> DataFrame:
    """Peak and trough with their dates (the first on a tie), and the mean band width."""
    day = F.unix_date("ds")
    return forecasts.groupBy(*ROOM_KEY).agg(
        F.avg("forecast").alias("mean_demand"),
        F.max("forecast").alias("peak"),
        F.max_by("ds", F.struct("forecast", -day)).alias("peak_date"),
        F.min("forecast").alias("trough"),
        F.min_by("ds", F.struct("forecast", day)).alias("trough_date"),
        F.avg(F.col("forecast_upper") - F.col("forecast_lower")).alias("mean_width"),
    )


# --- decisions ---------------------------------------------------------------------------------


def decision_kpis(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy("hotel_id").agg(
        F.count("*").alias("decisions"),
        F.avg("final_price").alias("mean_final"),
        F.avg("price_change_percent").alias("mean_change"),
        F.avg(F.when(F.size("guardrails") > 0, 1.0).otherwise(0.0)).alias("clamped_share"),
    )


def guardrail_counts(decisions: DataFrame) -> DataFrame:
    return (
        decisions.select(F.explode(F.expr("transform(guardrails, g -> g.rule)")).alias("rule"))
        .groupBy("rule")
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), "rule")
    )


# --- listings -----------------------------------------------------------------------------------


def hotel_list(
    hotels: DataFrame, city: str | None = None, stars: int | None = None,
    active: bool | None = None, after: str | None = None, *, limit: int,
) -> DataFrame:
    """A page of ``limit`` hotels by id; ``after`` is the last id of the page before."""
    frame = hotels if after is None else hotels.where(F.col("hotel_id") > after)
    if city is not None:
        frame = frame.where(F.lower("city") == city.lower())
    if stars is not None:
        frame = frame.where(F.col("star_rating") == stars)
    if active is not None:
        frame = frame.where(F.col("is_active") == active)
    return frame.orderBy("hotel_id").limit(limit)


def hotel_detail(hotels: DataFrame, rooms: DataFrame, kpis: DataFrame) -> DataFrame:
    """Each hotel with its rooms, cheapest first, and its trading figures."""
    listed = rooms.groupBy("hotel_id").agg(
        F.array_sort(
            F.collect_list(F.struct("base_price", "room_type", "room_count", "capacity"))
        ).alias("rooms")
    )
    return hotels.join(listed, "hotel_id", "left").join(kpis, "hotel_id", "left")


def training_rows(
    stored: DataFrame, version: str | None = None, start: date | None = None, end: date | None = None
) -> DataFrame:
    frame = stored.where(F.col(TARGET).isNotNull())
    if version is not None:
        frame = frame.where(F.col("feature_version") == version)
    if start is not None:
        frame = frame.where(F.col("stay_date") >= F.lit(start))
    if end is not None:
        frame = frame.where(F.col("stay_date") <= F.lit(end))
    return frame


def rate_listing(
    rates: DataFrame, hotel_id: str, start: date, days: int = 30,
    room_type: str | None = None, limit: int | None = None,
) -> DataFrame:
    """Observations of one hotel in a window, newest first within a night; all of them, or a page."""
    frame = rates.where(
        (F.col("hotel_id") == hotel_id)
        & F.col("check_in_date").between(F.lit(start), F.date_add(F.lit(start), days))
    )
    if room_type is not None:
        frame = frame.where(F.col("room_type") == room_type)
    ordered = frame.orderBy("check_in_date", F.desc("collected_at"), "event_id")
    return ordered if limit is None else ordered.limit(limit)


def pricing_history(
    audit: DataFrame, predictions: DataFrame, hotel_id: str,
    room_type: str | None = None, limit: int | None = None,
) -> DataFrame:
    """Decisions of one hotel with the demand behind them, newest first; all, or a page."""
    frame = audit.where(F.col("hotel_id") == hotel_id)
    if room_type is not None:
        frame = frame.where(F.col("room_type") == room_type)
    wanted = predictions.select("prediction_id", "blended_demand", "confidence", "model_version")
    ordered = frame.join(wanted, "prediction_id").orderBy(F.desc("created_at"), "prediction_id")
    return ordered if limit is None else ordered.limit(limit)


def collection_plan(
    hotels: DataFrame, as_of: date, horizons: tuple[int, ...], room_types: tuple[str, ...]
) -> DataFrame:
    """Rate look-ups to make: every hotel, horizon and room type, exploded in place."""
    days = ", ".join(str(h) for h in horizons)
    kinds = ", ".join(f"'{r}'" for r in room_types)
    return (
        hotels.select("hotel_id", "city", F.expr(f"explode(array({days}))").alias("horizon"))
        .withColumn("room_type", F.expr(f"explode(array({kinds}))"))
        .withColumn("check_in_date", F.expr(f"date_add(DATE'{as_of}', horizon)"))
    )


def collection_budget(
    plan: DataFrame, rate_limit: float = 2.0, max_requests: int = 400, max_seconds: float = 300.0
) -> DataFrame:
    return plan.agg(F.count("*").alias("planned")).selectExpr(
        "planned",
        f"planned * {rate_limit}D AS seconds",
        f"planned > {max_requests} AS too_many_requests",
        f"planned * {rate_limit}D > {max_seconds}D AS too_slow",
    )
