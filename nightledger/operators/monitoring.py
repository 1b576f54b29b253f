"""Data-quality and model-health checks.

Every check is one aggregate that yields one row ``(check, severity, value, threshold,
detail)``; a report is their union.  "Now" is always an argument.
"""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightledger.config import (
    FEATURE_VERSION,
    GRAIN,
    MONITOR_CONFIG,
    PRICING_CONFIG,
    TARGET,
    MonitorConfig,
    PricingConfig,
)
from nightledger.operators.metrics import evaluate
from nightledger.operators.quantiles import exact_quantiles
from nightledger.sources.files import write_and_read

RANK = "CASE severity WHEN 'critical' THEN 2 WHEN 'warning' THEN 1 ELSE 0 END"


def _row(
    frame: DataFrame, name: str, severity: str, value: str = "NULL", threshold: str = "NULL",
    detail: str = "NULL",
) -> DataFrame:
    return frame.selectExpr(
        f"'{name}' AS check_name",
        f"{severity} AS severity",
        f"cast({value} AS DOUBLE) AS value",
        f"cast({threshold} AS DOUBLE) AS threshold",
        f"cast({detail} AS STRING) AS detail",
    )


def reference_data(hotels: DataFrame, rooms: DataFrame) -> DataFrame:
    """No hotels, or hotels nobody can book, is critical."""
    marked = hotels.select("hotel_id").distinct().join(
        rooms.select("hotel_id", F.lit(1).alias("_sold")).distinct(), "hotel_id", "left"
    )
    counts = marked.agg(F.count("*").alias("n"), F.count_if(F.col("_sold").isNull()).alias("empty"))
    return _row(
        counts,
        "reference_data",
        "CASE WHEN n = 0 OR empty > 0 THEN 'critical' ELSE 'ok' END",
        "CASE WHEN n > 0 AND empty > 0 THEN empty ELSE n END",
    )


def booking_recency(
    bookings: DataFrame, as_of: date, config: MonitorConfig = MONITOR_CONFIG
) -> DataFrame:
    newest = bookings.agg(F.max("check_in_date").alias("d")).selectExpr(
        f"datediff(DATE'{as_of}', d) AS age"
    )
    limit = config.booking_max_age_days
    return _row(
        newest,
        "booking_recency",
        f"CASE WHEN age IS NULL THEN 'critical' WHEN age > {limit} THEN 'warning' ELSE 'ok' END",
        "age",
        f"CASE WHEN age > {limit} THEN {limit} END",
    )


def _staleness(frame: DataFrame, column: str, name: str, as_of: date, limit: float) -> DataFrame:
    age = frame.agg(F.max(column).alias("t")).selectExpr(
        f"(unix_timestamp(TIMESTAMP'{as_of} 00:00:00') - unix_timestamp(t)) / 3600D AS hours"
    )
    return _row(
        age,
        name,
        f"CASE WHEN hours IS NULL THEN 'critical' WHEN hours > {limit}D THEN 'warning'"
        " ELSE 'ok' END",
        "round(hours, 1)",
        f"CASE WHEN hours > {limit}D THEN {limit}D END",
    )


def competitor_freshness(
    rates: DataFrame, as_of: date, config: MonitorConfig = MONITOR_CONFIG
) -> DataFrame:
    return _staleness(
        rates, "collected_at", "competitor_freshness", as_of, config.competitor_staleness_hours
    )


def competitor_coverage(
    rates: DataFrame, as_of: date, config: MonitorConfig = MONITOR_CONFIG
) -> DataFrame:
    """Share of the coming nights of the calendar that have any rate."""
    days = config.competitor_horizon_days
    limit = config.min_competitor_coverage
    covered = (
        rates.where(f"check_in_date BETWEEN DATE'{as_of}' AND date_add(DATE'{as_of}', {days})")
        .agg(F.countDistinct("check_in_date").alias("n"))
        .selectExpr(f"least(n / {days + 1}D, 1D) AS share")
    )
    return _row(
        covered,
        "competitor_coverage",
        f"CASE WHEN share < {limit}D THEN 'warning' ELSE 'ok' END",
        "round(share, 4)",
        f"CASE WHEN share < {limit}D THEN {limit}D END",
    )


def feature_freshness(
    stored: DataFrame, as_of: date, config: MonitorConfig = MONITOR_CONFIG
) -> DataFrame:
    return _staleness(
        stored, "computed_at", "feature_freshness", as_of, config.feature_staleness_hours
    )


def feature_version(stored: DataFrame, running: str = FEATURE_VERSION) -> DataFrame:
    """The mix of versions in the store against the one the code produces."""
    mix = (
        stored.where("feature_version IS NOT NULL")
        .groupBy("feature_version")
        .agg(F.count("*").alias("n"))
        .agg(
            F.count("*").alias("versions"),
            F.count_if(F.col("feature_version") != running).alias("stale"),
            F.expr(
                "array_join(array_sort(collect_list(concat(feature_version, '=',"
                " cast(n AS STRING)))), ',')"
            ).alias("mix"),
        )
    )
    return _row(
        mix,
        "feature_version",
        "CASE WHEN versions = 0 THEN 'critical' WHEN stale > 0 THEN 'warning' ELSE 'ok' END",
        detail="nullif(mix, '')",
    )


def feature_nulls(stored: DataFrame, config: MonitorConfig = MONITOR_CONFIG) -> DataFrame:
    """Null share of the columns a model cannot do without, in one pass."""
    shares = stored.where("feature_version IS NOT NULL").agg(
        F.count("*").alias("n"),
        F.greatest(
            *[
                F.round(F.count_if(F.col(c).isNull()) / F.nullif(F.count("*"), F.lit(0)), 4)
                for c in config.required
            ]
        ).alias("worst"),
    )
    return _row(
        shares,
        "feature_nulls",
        f"CASE WHEN n = 0 OR worst > {config.null_share_critical}D THEN 'critical'"
        " WHEN worst > 0 THEN 'warning' ELSE 'ok' END",
        "CASE WHEN worst > 0 THEN worst END",
    )


def target_range(stored: DataFrame, config: MonitorConfig = MONITOR_CONFIG) -> DataFrame:
    span = stored.agg(F.min(TARGET).alias("lo"), F.max(TARGET).alias("hi"))
    top = config.target_ceiling
    return _row(
        span,
        "target_range",
        f"CASE WHEN lo IS NULL THEN 'warning' WHEN hi > {top}D OR lo < 0 THEN 'critical'"
        " ELSE 'ok' END",
        "hi",
        f"CASE WHEN hi > {top}D OR lo < 0 THEN {top}D END",
    )


def duplicate_grain(stored: DataFrame) -> DataFrame:
    repeated = (
        stored.groupBy(*GRAIN).agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*").alias("k"))
    )
    return _row(
        repeated,
        "duplicate_grain",
        "CASE WHEN k > 0 THEN 'critical' ELSE 'ok' END",
        "CASE WHEN k > 0 THEN k END",
    )


def union_checks(checks: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def data_report(
    hotels: DataFrame, rooms: DataFrame, bookings: DataFrame, rates: DataFrame, stored: DataFrame,
    as_of: date,
) -> DataFrame:
    """All data checks; the jobs behind them are independent branches of one plan."""
    return union_checks(
        [
            reference_data(hotels, rooms),
            booking_recency(bookings, as_of),
            competitor_freshness(rates, as_of),
            competitor_coverage(rates, as_of),
            feature_freshness(stored, as_of),
            feature_version(stored),
            feature_nulls(stored),
            target_range(stored),
            duplicate_grain(stored),
        ]
    )


def verdict(checks: DataFrame) -> DataFrame:
    """Passed, total, the worst severity, and the exit code it maps to."""
    return checks.agg(
        F.count_if(F.col("severity") == "ok").alias("passed"),
        F.count("*").alias("total"),
        F.max(F.expr(RANK)).alias("rank"),
    ).selectExpr(
        "passed",
        "total",
        "element_at(array('ok', 'warning', 'critical'), rank + 1) AS worst",
        "cast(rank = 2 AS INT) AS exit_code",
    )


# --- drift --------------------------------------------------------------------------------------


def population_stability(
    long: DataFrame, config: MonitorConfig = MONITOR_CONFIG, keys: list[str] = ["feature"]  # noqa: B006
) -> DataFrame:
    """PSI per key between reference and current values, all keys in one job.

    ``long`` holds the keys, ``value`` and ``recent``.  Bin edges are quantiles of the
    reference side, found without gathering a feature in one task; the binning itself is
    a conditional count over (value, count) pairs.
    """
    usable = long.where("value IS NOT NULL AND NOT isnan(value) AND abs(value) <> double('Infinity')")
    counted = usable.groupBy(*keys, "value").agg(
        F.count_if(~F.col("recent")).alias("old"), F.count_if("recent").alias("new")
    )
    steps = [i / config.psi_bins for i in range(config.psi_bins + 1)]
    quantiles = exact_quantiles(counted, keys, steps, weight="old")
    stats = (
        counted.groupBy(*keys)
        .agg(
            F.sum("old").alias("reference_n"),
            F.sum("new").alias("current_n"),
            (F.sum(F.col("value") * F.col("old")) / F.nullif(F.sum("old"), F.lit(0))).alias(
                "reference_mean"
            ),
            (F.sum(F.col("value") * F.col("new")) / F.nullif(F.sum("new"), F.lit(0))).alias(
                "current_mean"
            ),
        )
        .join(quantiles, keys, "left")
        .withColumn("edges", F.expr("array_sort(array_distinct(q))"))
        .withColumn("inner", F.expr("CASE WHEN size(edges) >= 3 THEN slice(edges, 2, size(edges) - 2) END"))
    )
    binned = counted.join(
        F.broadcast(stats.select(*keys, "inner", "reference_n", "current_n")), keys
    ).withColumn("bin", F.expr("size(filter(inner, edge -> edge <= value))"))
    shares = binned.groupBy(*keys, "bin").agg(
        (F.sum("old") / F.max("reference_n")).alias("r"),
        (F.sum("new") / F.max("current_n")).alias("c"),
    )
    floor = config.psi_floor
    terms = shares.selectExpr(
        *keys, f"greatest(r, {floor}D) AS r", f"greatest(c, {floor}D) AS c"
    ).groupBy(*keys).agg(F.sum(F.expr("(c - r) * ln(c / r)")).alias("psi"))
    enough = (
        f"reference_n >= {config.min_sample} AND current_n >= {config.min_sample} AND size(edges) >= 3"
    )
    return stats.join(terms, keys, "left").selectExpr(
        *keys,
        f"CASE WHEN {enough} THEN psi END AS psi",
        "reference_mean",
        "current_mean",
        "reference_n",
        "current_n",
    )


def psi_severity(config: MonitorConfig = MONITOR_CONFIG) -> str:
    return (
        f"CASE WHEN psi IS NULL OR isnan(psi) THEN 'ok' WHEN psi >= {config.psi_moderate}D"
        f" THEN 'critical' WHEN psi >= {config.psi_minor}D THEN 'warning' ELSE 'ok' END"
    )


def feature_drift(
    stored: DataFrame, as_of: date, config: MonitorConfig = MONITOR_CONFIG
) -> DataFrame:
    """Recent rows against everything older for each watched feature; nothing when either
    side is empty."""
    long = (
        stored.where("feature_version IS NOT NULL")
        .withColumn(
            "recent", F.expr(f"stay_date >= date_sub(DATE'{as_of}', {config.drift_window_days})")
        )
        .unpivot(["recent"], list(config.watched), "feature", "value")
    )
    return (
        population_stability(long, config)
        .where("reference_n > 0 AND current_n > 0")
        .withColumn("severity", F.expr(psi_severity(config)))
    )


def seasonality_caveat(
    stored: DataFrame, config: MonitorConfig = MONITOR_CONFIG
) -> DataFrame:
    """Under two years of history drift cannot be told from the season."""
    span = stored.agg(F.datediff(F.max("stay_date"), F.min("stay_date")).alias("days")).where(
        f"days < {config.seasonal_history_days}"
    )
    return _row(
        span, "drift_seasonality_caveat", "'warning'", "days", str(config.seasonal_history_days)
    )


# --- predictions and prices -------------------------------------------------------------------------


def recent(frame: DataFrame, n: int, tie: str = "prediction_id") -> DataFrame:
    """The newest rows; a top-n, so only n rows per task are ever kept."""
    return frame.orderBy(F.desc("created_at"), tie).limit(n)


def in_window(frame: DataFrame, as_of: date, hours: int) -> DataFrame:
    """All rows created within ``hours`` before ``as_of``, however many there are."""
    end = F.lit(as_of).cast("timestamp")
    return frame.where(
        F.col("created_at").between(end - F.expr(f"INTERVAL {hours} HOURS"), end)
    )


def prediction_stats(
    predictions: DataFrame, as_of: date, config: MonitorConfig = MONITOR_CONFIG
) -> DataFrame:
    """Distribution of the predictions of the health window and the share of outliers in it."""
    rows = write_and_read(
        in_window(predictions, as_of, config.health_hours).select(
            "blended_demand", "confidence", "latency_ms"
        ),
        "health",
    )
    stats = rows.agg(
        F.count("*").alias("n"),
        F.count("blended_demand").alias("known"),
        F.round(F.avg("blended_demand"), 4).alias("demand_mean"),
        F.round(F.stddev_samp("blended_demand"), 4).alias("demand_std"),
        F.round(F.min("blended_demand"), 4).alias("demand_min"),
        F.round(F.max("blended_demand"), 4).alias("demand_max"),
        F.round(F.avg("confidence"), 4).alias("confidence_mean"),
        F.avg("blended_demand").alias("_mean"),
        F.stddev_samp("blended_demand").alias("_std"),
    )
    counted = (
        rows.where(F.col("latency_ms").isNotNull())
        .groupBy(F.lit(0).alias("_all"), F.col("latency_ms").alias("value"))
        .agg(F.count("*").alias("n"))
    )
    slow = exact_quantiles(counted, ["_all"], [0.95]).agg(
        F.round(F.max(F.col("q")[0]), 2).alias("latency_p95_ms")
    )
    # The written window is read again; the statistics are one row.
    outliers = (
        rows.join(F.broadcast(stats.select("_mean", "_std")))
        .agg(
            F.count_if(
                F.abs(F.col("blended_demand") - F.col("_mean"))
                > config.sigma * F.greatest(F.col("_std"), F.lit(1e-9))
            ).alias("_far"),
            F.count("blended_demand").alias("_known"),
        )
        .selectExpr("_far / nullif(_known, 0) AS outlier_share")
    )
    return stats.drop("_mean", "_std").join(F.broadcast(slow)).join(F.broadcast(outliers))


def prediction_checks(stats: DataFrame, config: MonitorConfig = MONITOR_CONFIG) -> DataFrame:
    few = f"known < {config.min_sample}"
    volume = _row(
        stats.where(few),
        "prediction_volume",
        "CASE WHEN n = 0 THEN 'warning' ELSE 'ok' END",
        "known",
        str(config.min_sample),
    )
    enough = stats.where(f"NOT ({few})")
    variance = _row(
        enough,
        "prediction_variance",
        f"CASE WHEN demand_std < {config.min_spread}D THEN 'critical' ELSE 'ok' END",
        "demand_std",
        f"CASE WHEN demand_std < {config.min_spread}D THEN {config.min_spread}D END",
    )
    outliers = _row(
        enough,
        "prediction_outliers",
        f"CASE WHEN outlier_share > {config.outlier_share}D THEN 'warning' ELSE 'ok' END",
        "round(outlier_share, 4)",
        f"{config.outlier_share}D",
    )
    unsure = _row(
        enough.where(f"confidence_mean < {config.min_confidence}D"),
        "prediction_confidence",
        "'warning'",
        "confidence_mean",
        f"{config.min_confidence}D",
    )
    return union_checks([volume, variance, outliers, unsure])


def price_stats(
    audit: DataFrame, as_of: date, config: MonitorConfig = MONITOR_CONFIG, pricing: PricingConfig = PRICING_CONFIG
) -> DataFrame:
    """Distribution of the prices of the health window and how hard the guardrails press on them."""
    final = F.col("final_recommended_price")
    pinned = (final <= pricing.min_price) | (final >= pricing.max_price)
    return in_window(audit, as_of, config.health_hours).agg(
        F.count("*").alias("n"),
        F.round(F.avg(final), 2).alias("price_mean"),
        F.round(F.min(final), 2).alias("price_min"),
        F.round(F.max(final), 2).alias("price_max"),
        F.round(F.avg(F.when(F.size("guardrails_applied") > 0, 1.0).otherwise(0.0)), 4).alias(
            "clamped_share"
        ),
        F.round(F.avg("price_change_percent"), 2).alias("mean_change_percent"),
        F.round(F.avg(F.when(pinned, 1.0).otherwise(0.0)), 4).alias("pinned_share"),
    )


def price_checks(stats: DataFrame, config: MonitorConfig = MONITOR_CONFIG) -> DataFrame:
    empty = _row(stats.where("n = 0"), "pricing_volume", "'warning'")
    some = stats.where("n > 0")
    pressure = _row(
        some,
        "guardrail_pressure",
        f"CASE WHEN clamped_share > {config.clamped_share}D THEN 'warning' ELSE 'ok' END",
        "clamped_share",
        f"CASE WHEN clamped_share > {config.clamped_share}D THEN {config.clamped_share}D END",
    )
    pinned = _row(
        some.where(f"pinned_share > {config.pinned_share}D"),
        "absolute_limits",
        "'warning'",
        "pinned_share",
        f"{config.pinned_share}D",
    )
    return union_checks([empty, pressure, pinned])


def realised_accuracy(
    predictions: DataFrame, stored: DataFrame, as_of: date, config: MonitorConfig = MONITOR_CONFIG
) -> DataFrame:
    """Served predictions against what the completed nights turned out to be."""
    served = predictions.withColumnRenamed("check_in_date", "stay_date")
    scored = (
        served.where(F.col("stay_date") < F.lit(as_of))
        .join(stored.where(F.col(TARGET).isNotNull()).select(*GRAIN, TARGET), list(GRAIN))
        .select(F.col(TARGET).alias("actual"), F.col("blended_demand").alias("predicted"))
    )
    return evaluate(scored).where(f"n >= {config.min_sample}")


def model_report(
    stored: DataFrame, predictions: DataFrame, audit: DataFrame, as_of: date
) -> DataFrame:
    """Prediction and price checks plus one row per watched feature."""
    drift = _row(
        feature_drift(stored, as_of).withColumn("name", F.concat(F.lit("drift:"), "feature")),
        "",
        "severity",
        "psi",
        f"{MONITOR_CONFIG.psi_moderate}D",
        "name",
    ).withColumn("check_name", F.col("detail")).withColumn("detail", F.lit(None).cast("string"))
    return union_checks(
        [
            prediction_checks(prediction_stats(predictions, as_of)),
            price_checks(price_stats(audit, as_of)),
            seasonality_caveat(stored),
            drift,
        ]
    )


def _figures(row: DataFrame, section: str) -> DataFrame:
    """A one-row frame as rows (section, name, value); what is null stays out."""
    numbers = row.select(*[F.col(c).cast("double").alias(c) for c in row.columns])
    return numbers.unpivot([], numbers.columns, "name", "value").select(F.lit(section).alias("section"), "name", "value")


def guardrail_counts(audit: DataFrame, as_of: date, config: MonitorConfig = MONITOR_CONFIG) -> DataFrame:
    """How often each guardrail changed a price of the health window."""
    rules = in_window(audit, as_of, config.health_hours).select(F.explode("guardrails_applied").alias("rule"))
    return rules.groupBy("rule").agg(F.count("*").alias("n"))


def model_health(
    stored: DataFrame, audit: DataFrame, as_of: date, config: MonitorConfig = MONITOR_CONFIG
) -> DataFrame:
    """The whole model report as rows: section, name, value, severity.

    Sections: ``check`` and ``drift`` carry a severity; ``prediction``, ``price`` and ``accuracy``
    are the figures behind them, ``guardrail`` the hits of each rule.  Too few completed nights
    give no accuracy; the caveat on seasons stands only beside drift.  Both tables are written once
    and read from there; the figures are one row each, so the checks cost no further scan.
    """
    needed = (
        "hotel_id", "room_type", "check_in_date", "created_at", "blended_demand", "confidence", "latency_ms",
        "final_recommended_price", "price_change_percent", "guardrails_applied",
    )
    served = write_and_read(audit.select(*needed), "served")
    kept = write_and_read(stored, "stored")
    predictions = write_and_read(prediction_stats(served, as_of, config), "prediction-figures")
    prices = write_and_read(price_stats(served, as_of, config), "price-figures")
    accuracy = realised_accuracy(served.select(*needed[:3], "blended_demand"), kept, as_of, config)
    drift = write_and_read(feature_drift(kept, as_of), "drift")
    checks = union_checks(
        [
            prediction_checks(predictions, config),
            price_checks(prices, config),
            # A caveat on nothing would only confuse.
            seasonality_caveat(kept, config).join(F.broadcast(drift.select("feature").limit(1)), how="cross").drop("feature"),
        ]
    )
    judged = [
        checks.select(F.lit("check").alias("section"), F.col("check_name").alias("name"), F.col("value").cast("double").alias("value"), "severity"),
        drift.select(F.lit("drift").alias("section"), F.col("feature").alias("name"), F.col("psi").alias("value"), "severity"),
    ]
    counts = guardrail_counts(served, as_of, config)
    plain = [
        _figures(predictions, "prediction"),
        _figures(prices, "price"),
        _figures(accuracy, "accuracy"),
        counts.select(F.lit("guardrail").alias("section"), F.col("rule").alias("name"), F.col("n").cast("double").alias("value")),
    ]
    return union_checks([*judged, *[p.withColumn("severity", F.lit(None).cast("string")) for p in plain]])


def health_severity(health: DataFrame) -> DataFrame:
    """The worst severity of a model report, and how many features drift and checks fail."""
    failing = F.col("severity") != "ok"
    return health.where("severity IS NOT NULL").agg(
        F.max(F.expr(RANK)).alias("rank"),
        F.count_if(failing & (F.col("section") == "drift")).alias("drifting"),
        F.count_if(F.col("section") == "drift").alias("watched"),
        F.count_if(failing & (F.col("section") == "check")).alias("failing"),
    ).selectExpr("element_at(array('ok', 'warning', 'critical'), rank + 1) AS severity", "drifting", "watched", "failing")
