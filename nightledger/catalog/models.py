"""Model family: series forecasts, metrics, boosted regressor."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nightledger.catalog import Registry
from nightledger.catalog import features as FQ
from nightledger.catalog.pricing import context, flat, models, past, stored
from nightledger.config import BOOST_CONFIG, GRAIN, ROOM_KEY, TARGET
from nightledger.functions import calendar as C
from nightledger.functions.numeric import settled
from nightledger.operators import analytics as A
from nightledger.operators import demand as D
from nightledger.operators import forecast as S
from nightledger.operators import metrics as E
from nightledger.plans import model_store as MS
from nightledger.plans import pricing as PP
from nightledger.plans import training as T
from nightledger.session import work_dir
from nightledger.sources import files
from nightledger.sources import warehouse as W

QUERIES = Registry()

BAND = dict(forecast=6, forecast_lower=6, forecast_upper=6)
METRICS = dict(
    mae=6, rmse=6, mape=5, smape=5, weighted_mape=5, r2=6, bias=6, mape_coverage=6,
    interval_coverage=6, baseline_mae=6,
)
#: Shuffles of each feature, as in the training run that is rebuilt.
REPEATS = 5


def metric_digits(frame: DataFrame) -> DataFrame:
    return settled(frame, **{c: n for c, n in METRICS.items() if c in frame.columns})


def series(spark: SparkSession, folder: str) -> DataFrame:
    return S.daily_series(stored(spark, folder))


def fitted(spark: SparkSession, folder: str) -> DataFrame:
    return S.fit(S.fill_gaps(series(spark, folder)))


@QUERIES.add("w9_daily_series")
def w9(spark, folder):
    return settled(series(spark, folder), y=9)


@QUERIES.add("w8_gap_filled_series")
def w8(spark, folder):
    return settled(S.fill_gaps(series(spark, folder)), y=9)


@QUERIES.add("j10_complete_calendar")
def j10(spark, folder):
    """Days each series should have and has."""
    observed = series(spark, folder)
    full = S.fill_gaps(observed).select(*ROOM_KEY, "ds")
    return (
        full.join(observed, [*ROOM_KEY, "ds"], "left")
        .groupBy(*ROOM_KEY)
        .agg(F.count("*").alias("calendar_days"), F.count("y").alias("observed_days"))
    )


@QUERIES.add("m1_series_models")
def m1(spark, folder):
    out = fitted(spark, folder).select(
        *ROOM_KEY,
        "n_observations",
        "history_end",
        "capacity",
        "slope",
        *[f"weekday_{d}" for d in range(7)],
        F.col("band")[0].alias("band_low"),
        F.col("band")[1].alias("band_high"),
    )
    return settled(
        out, capacity=9, slope=9, band_low=9, band_high=9, **{f"weekday_{d}": 9 for d in range(7)}
    )


def two_years(spark: SparkSession, folder: str) -> DataFrame:
    """Models of the series preceded by themselves, 400 days earlier and a tenth lower."""
    # Both nights of a row at once, so that the nights are built once and not for each half.
    both = F.expr("inline(array(struct(ds, y), struct(date_sub(ds, 400) AS ds, y * 0.9D AS y)))")
    return S.fit(S.fill_gaps(series(spark, folder).select(*ROOM_KEY, both)))


@QUERIES.add("m1_two_year_terms")
def m1b(spark, folder):
    """Month and holiday factors of series with two years of history."""
    months = ", ".join(f"struct('month' AS kind, '{m}' AS term, month_{m} AS factor)" for m in range(1, 13))
    festive = "transform(map_entries(holiday_factors), e -> struct('holiday' AS kind, e.key AS term, e.value AS factor))"
    out = two_years(spark, folder).select(*ROOM_KEY, "n_observations", F.expr(f"explode(concat(array({months}), {festive})) AS f"))
    return settled(out.select(*ROOM_KEY, "n_observations", "f.*").where("factor IS NOT NULL"), factor=9)


@QUERIES.add("m1_two_year_forecast")
def m1c(spark, folder):
    """Two months over the turn of the year, from two years of history."""
    out = S.forecast_range(two_years(spark, folder), date(2025, 12, 10), 60).drop("trend")
    return settled(out, **BAND)


@QUERIES.add("m2_nested_horizons")
def m2(spark, folder):
    out = S.nested_horizons(S.forecast_next(fitted(spark, folder), 30)).drop("trend")
    return settled(out, **BAND)


@QUERIES.add("m3_forecast_range")
def m3(spark, folder):
    out = S.forecast_range(fitted(spark, folder), date(2025, 11, 15), 30).drop("trend")
    return settled(out, **BAND)


@QUERIES.add("m4_forecast_holidays")
def m4(spark, folder):
    """Holiday rows of the years the bookings cover, with one weight per holiday name."""
    years = W.bookings(spark, folder).agg(
        F.min(F.year("check_in_date")).alias("a"), (F.max(F.year("check_in_date")) + 2).alias("b")
    ).first()
    known = C.holidays(spark, date(years.a or 2000, 1, 1), date(years.b or 2000, 12, 31))
    if years.a is None:
        known = known.limit(0)  # without bookings there is no year to list
    weight = known.groupBy("holiday_name").agg(
        F.greatest(F.lit(1.0), 10.0 * F.max("significance")).alias("prior_scale")
    )
    return known.join(weight, "holiday_name").select(
        F.col("day").alias("ds"),
        "holiday_name",
        F.lit(-1).alias("lower_window"),
        F.lit(1).alias("upper_window"),
        "prior_scale",
    )


def _folds(spark, folder) -> DataFrame:
    return S.backtest(S.fill_gaps(series(spark, folder)))


@QUERIES.add("w11_rolling_folds")
def w11(spark, folder):
    out = E.evaluate(
        _folds(spark, folder),
        ["fold"],
        predicted="forecast",
        lower="forecast_lower",
        upper="forecast_upper",
    )
    return metric_digits(out)


@QUERIES.add("m5_series_report")
def m5(spark, folder):
    """Observation-weighted means of the per-series backtest metrics."""
    per_series = E.evaluate(
        _folds(spark, folder),
        list(ROOM_KEY),
        predicted="forecast",
        lower="forecast_lower",
        upper="forecast_upper",
    )
    names = ["mae", "rmse", "mape", "smape", "weighted_mape", "r2", "bias", "interval_coverage"]
    return metric_digits(E.weighted_means(per_series, names))


@QUERIES.add("w10_chronological_split")
def w10(spark, folder):
    frame = stored(spark, folder)
    cutoff = T.split_cutoff(frame, BOOST_CONFIG.test_days)
    side = F.when(F.col("stay_date") <= cutoff, "train").otherwise("test")
    return frame.groupBy(side.alias("side")).agg(
        F.count("*").alias("n"),
        F.min("stay_date").alias("first_night"),
        F.max("stay_date").alias("last_night"),
    )


def scored(spark: SparkSession, folder: str) -> DataFrame:
    """Trailing demand taken as a prediction of the target."""
    return FQ.matrix(spark, folder).select(
        *GRAIN,
        "days_to_checkin",
        F.col(TARGET).alias("actual"),
        F.col("historical_demand").alias("predicted"),
    )


@QUERIES.add("m8_metrics")
def m8(spark, folder):
    out = scored(spark, folder).withColumns(
        {"lower": F.expr("predicted - 0.2037D"), "upper": F.expr("predicted + 0.2037D")}
    )
    return metric_digits(E.evaluate(out, lower="lower", upper="upper"))


@QUERIES.add("m9_baseline_metrics")
def m9(spark, folder):
    return metric_digits(E.baseline(scored(spark, folder)).select("n", "mae", "rmse", "mape", "bias"))


@QUERIES.add("m10_metrics_by_horizon")
def m10(spark, folder):
    out = E.metrics_by(scored(spark, folder), "days_to_checkin")
    return metric_digits(out.drop("smape", "weighted_mape", "mape_coverage"))


@QUERIES.add("m10_metrics_by_hotel")
def m10b(spark, folder):
    """Metrics of every hotel, and of its worst and best room type, as a regressor is served per hotel."""
    rows = scored(spark, folder)
    by_hotel = E.metrics_by(rows, "hotel_id").drop("smape", "weighted_mape", "mape_coverage")
    series = F.concat_ws("/", "hotel_id", "room_type")
    rooms = E.metrics_by(rows.withColumn("series", series), "series")
    spread = rooms.groupBy(F.substring_index("series", "/", 1).alias("hotel_id")).agg(
        F.count("*").alias("room_types"), F.min("mae").alias("least_mae"), F.max("mae").alias("most_mae")
    )
    return settled(metric_digits(by_hotel.join(spread, "hotel_id", "left")), least_mae=6, most_mae=6)


@QUERIES.add("m13_improvement")
def m13(spark, folder):
    out = E.improvement(E.metrics_by(scored(spark, folder), "room_type"))
    return settled(
        out.select("room_type", "mae", "baseline_mae", "improvement"),
        mae=6,
        baseline_mae=6,
        improvement=6,
    )


@QUERIES.add("m7_residual_band")
def m7(spark, folder):
    rows = scored(spark, folder).withColumnsRenamed({"predicted": "boosted", "actual": TARGET})
    out = D.residual_band(rows.withColumn("residual_std", T.residual_std(rows)))
    return settled(
        out.select(*GRAIN, "boosted_lower", "boosted_upper", "boosted_confidence"),
        boosted_lower=6,
        boosted_upper=6,
        boosted_confidence=6,
    )


@QUERIES.add("m5_fit_report")
def m5b(spark, folder):
    """Which series could be fitted; the last nights of suites are a series of their own, too short on purpose."""
    recent = "room_type = 'suite' AND ds >= DATE'2025-11-01'"
    split = F.expr(f"CASE WHEN {recent} THEN 'suite, recent' ELSE room_type END")
    filled = S.fill_gaps(series(spark, folder).withColumn("room_type", split))
    return S.fit_report(filled, S.fit(filled))


# --- boosted regressor --------------------------------------------------------------------------


def _trained(spark, folder):
    matrix = files.write_and_read(FQ.matrix(spark, folder), "matrix")
    train, test = T.chronological_split(matrix, BOOST_CONFIG)
    return MS.stored_boosted(train, BOOST_CONFIG, fit=T.fit_boosted), train, test


@QUERIES.add("m6_boosted_predictions")
def m6(spark, folder):
    model, _, test = _trained(spark, folder)
    return T.predict_boosted(model, test).select(*GRAIN, TARGET, "boosted")


@QUERIES.add("m11_impurity_importance")
def m11(spark, folder):
    model, _, _ = _trained(spark, folder)
    return T.impurity_importance(spark, model)


@QUERIES.add("w7_top_importances")
def w7(spark, folder):
    """The twelve features most correlated with the target."""
    top = A.target_correlations(FQ.matrix(spark, folder)).limit(12)
    return settled(top, correlation=6)


@QUERIES.add("w7_importance_top20")
def w7b(spark, folder):
    """The twenty features that matter most to the regressor."""
    model, _, _ = _trained(spark, folder)
    return T.impurity_importance(spark, model).limit(20)


@QUERIES.add("m12_permutation_importance")
def m12(spark, folder):
    model, _, test = _trained(spark, folder)
    return T.permutation_importance(model, test, repeats=REPEATS)


@QUERIES.add("m14_training_record")
def m14(spark, folder):
    model, train, test = _trained(spark, folder)
    record = T.training_record(train, test, T.predict_boosted(model, test), "v1", BOOST_CONFIG)
    path = work_dir(spark, "reports")
    files.write_json(record, path)
    return files.read_json(spark, path, record.schema)


@QUERIES.add("m14_training_steps")
def m14b(spark, folder):
    """Two runs over the same split: what became of each step, one of which always fails."""
    train, test = T.chronological_split(files.write_and_read(FQ.matrix(spark, folder), "matrix"), BOOST_CONFIG)

    def mean(train: DataFrame, test: DataFrame) -> DataFrame:
        level = train.agg(F.avg(TARGET)).scalar()
        error = F.avg(F.abs(F.col(TARGET) - F.col("level")))
        return test.withColumn("level", level).agg(F.round(error, 6).alias("mae"), F.count(TARGET).alias("n"))

    def history(train: DataFrame, test: DataFrame) -> DataFrame:
        error = F.avg(F.abs(F.col(TARGET) - F.col("historical_demand")))
        return test.agg(F.round(error, 6).alias("mae"), F.count(TARGET).alias("n"))

    def broken(train: DataFrame, test: DataFrame) -> DataFrame:
        raise ValueError("no such model")

    root = work_dir(spark, "training-runs")
    steps = [MS.Step("mean", mean), MS.Step("broken", broken), MS.Step("history", history)]
    for chosen in (steps, steps[1:]):
        record = MS.run_steps(train, test, chosen, root)
    return MS.records(spark, root, record.schema).selectExpr(
        "version", "step", "succeeded", "error", "figures['mae'] AS mae", "cast(figures['n'] AS BIGINT) AS scored_rows",
        "n_train", "train_start", "train_end", "n_test", "test_start", "test_end",
    )


@QUERIES.add("m6_prediction_rows")
def m6b(spark, folder):
    """What can be said of every prediction without knowing it: rows, windows, floor and skill."""
    model, _, test = _trained(spark, folder)
    out = T.predict_boosted(model, test)
    error = F.abs(F.col(TARGET) - F.col("boosted"))
    return out.groupBy("hotel_id", "room_type").agg(
        F.count("*").alias("n"),
        F.min("stay_date").alias("first_night"),
        F.max("stay_date").alias("last_night"),
        F.count_if(F.col("boosted") < 0).alias("below_zero"),
        F.count_if(F.col("boosted").isNull() | F.isnan("boosted") | error.isNull()).alias("missing"),
    )


@QUERIES.add("m11_importance_shares")
def m11b(spark, folder):
    """Every feature once, with importances that are shares of one."""
    model, _, _ = _trained(spark, folder)
    shares = T.impurity_importance(spark, model)
    return shares.agg(
        F.count("*").alias("features"),
        F.count_distinct("feature").alias("different"),
        F.round(F.sum("importance"), 9).alias("total"),
        F.count_if((F.col("importance") < 0) | (F.col("importance") > 1)).alias("outside"),
        F.sha2(F.concat_ws(",", F.array_sort(F.collect_list("feature"))), 256).alias("names"),
    )


@QUERIES.add("s10_model_catalogue")
def s10(spark, folder):
    """Reports of several versions written as JSON, listed in numeric order of version."""
    per_horizon = E.evaluate(scored(spark, folder), ["days_to_checkin"]).selectExpr(
        "concat('v', cast(days_to_checkin AS INT)) AS version",
        "n",
        "mae",
        "mae < 0.4D AS usable",
    )
    path = work_dir(spark, "catalogue")
    files.write_json(per_horizon, path)
    listed = T.model_catalogue(files.read_json(spark, path, per_horizon.schema))
    chosen = T.choose_version(listed)
    return listed.join(
        chosen.withColumnRenamed("version", "served"), F.col("version") == F.col("served"), "left"
    ).selectExpr("version", "version_number", "n", "round(mae, 6) AS mae", "usable",
                 "served IS NOT NULL AS is_served")


@QUERIES.add("p14_reprice_two_models")
def p14b(spark, folder):
    """The batch reprice with both models: series forecast and regressor, fitted on past nights."""
    matrix = files.write_and_read(FQ.matrix(spark, folder), "matrix")
    # The last known nights are held out: their residuals, which the fit has not seen, give the band.
    known = matrix.where(F.col("stay_date") < F.lit(W.AS_OF))
    cutoff = T.split_cutoff(known, BOOST_CONFIG.test_days)
    train, held = known.where(F.col("stay_date") <= cutoff), known.where(F.col("stay_date") > cutoff)
    if train.isEmpty():
        train, held = known, known.limit(0)  # too short a history to hold nights out: no band
    model = MS.stored_boosted(train, BOOST_CONFIG, fit=T.fit_boosted)
    spread = T.predict_boosted(model, held).agg(
        F.stddev_pop(F.col(TARGET) - F.col("boosted")).alias("residual_std")
    )
    boosted = T.predict_boosted(model, matrix).select(*GRAIN, "boosted").join(F.broadcast(spread))
    features = files.write_and_read(stored(spark, folder), "stored")
    out = PP.reprice(
        context(spark, folder, features),
        models=models(features),
        boosted=D.residual_band(boosted),
        history=D.weekday_history(past(features)),
    )
    return flat(out).select(
        *GRAIN, "forecast", "boosted", "blended_demand", "confidence", "raw_price", "final_price", "rules"
    )
