"""All series forecast in one job.

A series is one (hotel, room).  Trend, weekday, month and holiday factors are grouped
aggregates over the daily series, so the number of series only changes the number of
rows: there is no loop over series, no model object and no Python in the plan.  The
daily series is pre-aggregated, hence a window partition holds one row per calendar day.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nightledger.config import FORECAST_CONFIG, ROOM_KEY, ForecastConfig
from nightledger.functions.calendar import holiday_on

SERIES = list(ROOM_KEY)
_ORIGIN = "DATE'2020-01-01'"


def daily_series(stored: DataFrame, day: str = "stay_date", value: str = "target_demand") -> DataFrame:
    """Mean demand per room and day, nulls dropped."""
    return (
        stored.where(F.col(value).isNotNull())
        .groupBy(*SERIES, F.col(day).alias("ds"))
        .agg(F.avg(value).alias("y"))
    )


def fill_gaps(series: DataFrame, keys: list[str] = SERIES) -> DataFrame:
    """Every calendar day of a series, missing days on the line between their neighbours.

    Each row stands for the days up to the next one, so one pass in order of the days does.
    """
    ordered = Window.partitionBy(*keys).orderBy("ds")
    before = ordered.rowsBetween(Window.unboundedPreceding, 0)
    known = F.expr("CASE WHEN y IS NOT NULL THEN struct(ds AS d, y AS y) END")
    window = ", ".join(f"`{k}`" for k in keys)
    return (
        series.where(F.col("ds").isNotNull())
        .withColumn("_known", known)
        .select(
            *keys,
            "ds",
            "y",
            F.lead("ds").over(ordered).alias("_next"),
            F.last("_known", ignorenulls=True).over(before).alias("_a"),
            F.expr(f"lead(_known) IGNORE NULLS OVER (PARTITION BY {window} ORDER BY ds)").alias("_b"),
        )
        .withColumn(
            "_day",
            F.explode(F.expr("sequence(ds, greatest(ds, date_sub(coalesce(_next, ds), 1)))")),
        )
        .select(
            *keys,
            F.col("_day").alias("ds"),
            F.expr(
                "CASE WHEN _day = ds AND y IS NOT NULL THEN y"
                " WHEN _a IS NULL THEN _b.y WHEN _b IS NULL THEN _a.y"
                " ELSE _a.y + (_b.y - _a.y) * datediff(_day, _a.d) / datediff(_b.d, _a.d) END"
            ).alias("y"),
        )
    )


def holiday_term(day: str) -> F.Column:
    """The holiday a day belongs to, as a struct of ``term`` and ``scale``, or null.

    A day is part of its own holiday, else of the one it is the eve of, else of the one it
    follows; each place is a term of its own.  ``scale`` is how far its factor may move.
    """
    places = ((0, day), (-1, f"date_add({day}, 1)"), (1, f"date_sub({day}, 1)"))
    found = [
        F.when(
            holiday_on(at).isNotNull(),
            F.struct(
                F.concat(holiday_on(at)["holiday_name"], F.lit(f"|{place}")).alias("term"),
                F.greatest(F.lit(1.0), F.lit(10.0) * holiday_on(at)["significance"]).alias("scale"),
            ),
        )
        for place, at in places
    ]
    return F.coalesce(*found)


def fit(
    filled: DataFrame, keys: list[str] = SERIES, config: ForecastConfig = FORECAST_CONFIG
) -> DataFrame:
    """One row of coefficients per series with enough history.

    demand = trend x weekday x month x holiday.  Month and holiday factors stay at one
    until there are two years to learn them from: with less, each is a single
    observation.  They are ridge estimates around one: of the factors of a group of terms no
    two share a day, so the Gram matrix of a group is diagonal, a grouped sum per term, and a
    factor is ``(sum(y * x) + w) / (sum(x * x) + w)`` for ``w = 1 / scale ** 2``, where x is the
    fit without it.  A holiday has a term for its eve and for the day after it too.  The band
    is the pair of residual quantiles around the fit.
    """
    whole = Window.partitionBy(*keys)
    weekday = Window.partitionBy(*keys, "weekday")
    month = Window.partitionBy(*keys, "month")
    holiday = Window.partitionBy(*keys, "term")

    def ridge(x: str, window, scale: F.Column) -> F.Column:
        weight = F.lit(1.0) / (scale * scale)
        return (F.sum(F.expr(f"y * {x}")).over(window) + weight) / (F.sum(F.expr(f"{x} * {x}")).over(window) + weight)

    frame = (
        filled.withColumn("weekday", F.expr("weekday(ds)"))
        # Sums by weekday come first: their order of rows serves those of the whole series too.
        .withColumn("_by_weekday", F.sum("y").over(weekday))
        .withColumns({"t": F.expr(f"cast(datediff(ds, {_ORIGIN}) AS DOUBLE)"), "month": F.expr("month(ds)")})
        .withColumns(
            {
                "n": F.count("*").over(whole),
                "peak": F.max("y").over(whole),
                "slope": F.regr_slope("y", "t").over(whole),
                "intercept": F.regr_intercept("y", "t").over(whole),
            }
        )
        .where(F.col("n") >= config.min_training_days)
        .withColumn("trend", F.expr("intercept + slope * t"))
        .withColumn(
            "weekly",
            F.coalesce(F.col("_by_weekday") / F.nullif(F.sum("trend").over(weekday), F.lit(0.0)), F.lit(1.0)),
        )
        # Looked up only where there are enough days to use it.
        .withColumn("_holiday", F.when(F.col("n") >= config.min_days_for_holidays, holiday_term("ds")))
        .withColumns({"term": F.col("_holiday.term"), "scale": F.col("_holiday.scale")})
        .withColumn(
            "yearly",
            F.when(
                F.col("n") >= config.min_days_for_yearly,
                ridge("(trend * weekly)", month, F.lit(config.yearly_prior_scale)),
            ).otherwise(F.lit(1.0)),
        )
        .withColumn(
            "festive",
            F.when(
                F.col("term").isNotNull(),
                ridge("(trend * weekly * yearly)", holiday, F.max("scale").over(holiday)),
            ).otherwise(F.lit(1.0)),
        )
        .withColumn("residual", F.expr("y - trend * weekly * yearly * festive"))
    )
    tail = (1.0 - config.interval_width) / 2.0
    return frame.groupBy(*keys).agg(
        F.count("*").alias("n_observations"),
        F.min("ds").alias("history_start"),
        F.max("ds").alias("history_end"),
        F.max("slope").alias("slope"),
        F.max("intercept").alias("intercept"),
        F.greatest(
            F.max("peak") * config.capacity_headroom, F.lit(config.min_capacity)
        ).alias("capacity"),
        *[
            F.max(F.expr(f"CASE WHEN weekday = {d} THEN weekly END")).alias(f"weekday_{d}")
            for d in range(7)
        ],
        *[
            F.max(F.expr(f"CASE WHEN month = {m} THEN yearly END")).alias(f"month_{m}")
            for m in range(1, 13)
        ],
        F.expr(
            "map_from_entries(collect_set(CASE WHEN term IS NOT NULL THEN struct(term, festive) END))"
        ).alias("holiday_factors"),
        F.percentile("residual", F.array(F.lit(tail), F.lit(1.0 - tail))).alias("band"),
        F.max(F.expr("n >= " + str(config.min_days_for_yearly))).alias("yearly_enabled"),
    )


def predict(dated: DataFrame) -> DataFrame:
    """Evaluate coefficients joined with a ``ds`` column: forecast, band and trend."""
    weekday = ", ".join(f"weekday_{d}" for d in range(7))
    month = ", ".join(f"month_{m}" for m in range(1, 13))
    return (
        dated.withColumn("_festival", F.when(F.size("holiday_factors") > 0, holiday_term("ds")["term"]))
        .withColumn("trend", F.expr(f"intercept + slope * datediff(ds, {_ORIGIN})"))
        .withColumn(
            "_centre",
            F.expr(
                f"trend * coalesce(element_at(array({weekday}), weekday(ds) + 1), 1D)"
                f" * coalesce(element_at(array({month}), month(ds)), 1D)"
                " * coalesce(try_element_at(holiday_factors, coalesce(_festival, '')), 1D)"
            ),
        )
        .withColumns(
            {
                "forecast": F.expr("greatest(0D, least(capacity, _centre))"),
                "forecast_lower": F.expr("greatest(0D, least(capacity, _centre + band[0]))"),
                "forecast_upper": F.expr("greatest(0D, least(capacity, _centre + band[1]))"),
            }
        )
    )


_OUTPUT = ["ds", "forecast", "forecast_lower", "forecast_upper", "trend"]


def forecast_next(models: DataFrame, days: int, keys: list[str] = SERIES) -> DataFrame:
    """The next ``days`` days after each series ends; shorter horizons are prefixes."""
    future = models.withColumn(
        "step", F.explode(F.sequence(F.lit(1), F.lit(days)))
    ).withColumn("ds", F.expr("date_add(history_end, step)"))
    return predict(future).select(*keys, "step", *_OUTPUT)


def nested_horizons(forecast: DataFrame, config: ForecastConfig = FORECAST_CONFIG) -> DataFrame:
    """Each horizon as the prefix of one forecast."""
    values = ", ".join(str(h) for h in config.horizons)
    return forecast.withColumn("horizon_days", F.expr(f"explode(array({values}))")).where(
        "step <= horizon_days"
    )


def forecast_range(models: DataFrame, start: date, days: int, keys: list[str] = SERIES) -> DataFrame:
    """A fixed span of dates, wherever a series ended."""
    dated = models.withColumn(
        "ds", F.expr(f"explode(sequence(DATE'{start}', date_add(DATE'{start}', {days - 1})))")
    )
    return predict(dated).select(*keys, *_OUTPUT)


def forecast_dates(models: DataFrame, wanted: DataFrame, keys: list[str] = SERIES) -> DataFrame:
    """Arbitrary nights, one row per distinct series and date asked for."""
    dated = wanted.select(*keys, "ds").distinct().join(models, keys)
    return predict(dated).select(*keys, *_OUTPUT)


def with_forecast(nights: DataFrame, models: DataFrame, day: str = "stay_date") -> DataFrame:
    """Forecast and band beside each night; null for a series without a model.

    Coefficients are one row per series and are joined on the series, so the nights are
    neither made distinct nor joined back.
    """
    own = [c for c in models.columns if c not in SERIES]
    marked = models.select(*SERIES, F.struct(*own).alias("_model"))
    joined = nights.join(marked, SERIES, "left")
    answers = predict(
        joined.select("*", F.col(day).alias("ds"), *[F.col(f"_model.{c}").alias(c) for c in own])
    )
    known = F.col("_model").isNotNull()
    return answers.select(
        *[F.col(c) for c in nights.columns],
        *[F.when(known, F.col(c)).alias(c) for c in ("forecast", "forecast_lower", "forecast_upper")],
    )


def backtest(
    filled: DataFrame, keys: list[str] = SERIES, config: ForecastConfig = FORECAST_CONFIG
) -> DataFrame:
    """Rolling-origin folds: each cutoff one horizon later, refitted, scored on what follows.

    Folds are a key column, so all folds of all series are fitted in the same job.
    """
    k, h = config.backtest_folds, config.backtest_horizon
    whole = Window.partitionBy(*keys)
    sized = filled.withColumns(
        {"_n": F.count("*").over(whole), "_end": F.max("ds").over(whole)}
    ).where(F.col("_n") >= config.min_training_days + k * h)
    folds = ", ".join(str(f) for f in range(1, k + 1))
    # Dealt out again by fold, so that the size of a task is that of what it sorts, not a k-th of it.
    folded = (
        sized.withColumn("fold", F.expr(f"explode(array({folds}))"))
        .withColumn("_cutoff", F.expr(f"date_sub(_end, fold * {h})"))
        .where(f"ds <= date_add(_cutoff, {h})")
        .select(*keys, "fold", "ds", "y", "_cutoff")
        .repartition(*keys, "fold")
    )
    train = folded.where("ds <= _cutoff").select(*keys, "fold", "ds", "y")
    test = folded.where(f"ds > _cutoff AND ds <= date_add(_cutoff, {h})").select(
        *keys, "fold", "ds", F.col("y").alias("actual")
    )
    models = fit(train, [*keys, "fold"], config)
    return predict(test.join(models, [*keys, "fold"])).select(
        *keys, "fold", "ds", "actual", "forecast", "forecast_lower", "forecast_upper"
    )


def fit_report(series: DataFrame, models: DataFrame, config: ForecastConfig = FORECAST_CONFIG) -> DataFrame:
    """Every series with whether it was fitted, and why not."""
    counted = series.groupBy(*SERIES).agg(
        F.expr("datediff(max(ds), min(ds)) + 1").alias("calendar_days"),
    )
    fitted = models.select(*SERIES, "n_observations")
    return counted.join(fitted, SERIES, "left").selectExpr(
        *SERIES,
        "n_observations IS NOT NULL AS fitted",
        "cast(calendar_days AS BIGINT) AS n_observations",
        f"CASE WHEN n_observations IS NULL THEN concat(cast(calendar_days AS STRING),"
        f" ' days of history, {config.min_training_days} needed') END AS error",
    )
