"""Metrics, forecaster and drift arithmetic against plain Python."""

import math
import random
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from nightledger.catalog import models as M
from nightledger.config import BOOST_CONFIG
from nightledger.operators import forecast as S
from nightledger.operators import metrics as E
from nightledger.operators import monitoring as O
from nightledger.operators.merge import latest_per_key, owned_merge


def test_metrics_against_numpy(spark):
    actual, predicted = [0.5, 0.0, 0.8, 1.0, None], [0.4, 0.1, 0.9, 0.7, 0.3]
    frame = spark.createDataFrame(list(zip(actual, predicted)), "actual double, predicted double")
    row = E.evaluate(frame).first()
    a, p = np.array(actual[:4]), np.array(predicted[:4])
    assert row.n == 4
    assert row.mae == pytest.approx(np.abs(a - p).mean())
    assert row.rmse == pytest.approx(math.sqrt(((a - p) ** 2).mean()))
    assert row.r2 == pytest.approx(1 - ((a - p) ** 2).sum() / ((a - a.mean()) ** 2).sum())
    assert row.mape_coverage == 0.75
    flat = spark.createDataFrame([(0.0, 0.0), (0.0, 0.0)], "actual double, predicted double")
    row = E.evaluate(flat).first()
    assert row.smape == 0 and row.weighted_mape is None and row.r2 is None


def daily(spark, days, start=date(2024, 1, 1), hotel="H001"):
    rng = random.Random(7)
    rows = [
        (hotel, "deluxe", start + timedelta(days=i),
         0.65 * (1 + 0.0002 * i) + (0.18 if (start + timedelta(days=i)).weekday() >= 5 else -0.05)
         + rng.gauss(0, 0.03))
        for i in range(days)
        if i % 37 != 5
    ]
    return spark.createDataFrame(rows, "hotel_id string, room_type string, ds date, y double")


def test_forecaster_beats_the_mean_and_covers(spark):
    filled = S.fill_gaps(daily(spark, 420))
    assert filled.count() == 420
    folds = S.backtest(filled)
    scored = E.evaluate(
        folds, predicted="forecast", lower="forecast_lower", upper="forecast_upper"
    ).first()
    base = E.baseline(folds.select("actual")).first()
    assert scored.mae < 0.6 * base.mae
    assert 0.6 < scored.interval_coverage <= 1.0
    models = S.fit(filled)
    nested = S.nested_horizons(S.forecast_next(models, 30)).groupBy("horizon_days").count()
    assert {r["horizon_days"]: r["count"] for r in nested.collect()} == {7: 7, 14: 14, 30: 30}


def test_short_series_is_reported_and_long_one_has_months(spark):
    series = daily(spark, 60, hotel="SHORT").unionByName(daily(spark, 800, hotel="LONG"))
    models = S.fit(S.fill_gaps(series))
    assert [(r.hotel_id, r.yearly_enabled) for r in models.collect()] == [("LONG", True)]
    report = {r.hotel_id: r for r in S.fit_report(series, models).collect()}
    assert report["LONG"].fitted and not report["SHORT"].fitted and "90 needed" in report["SHORT"].error


def test_gaps_are_filled_in_one_pass(spark, capsys):
    day = lambda n: date(2025, 3, 1) + timedelta(days=n)
    known = {"A": {0: 1.0, 1: 3.0, 4: 9.0, 5: None, 6: 5.0}, "B": {0: None, 2: 4.0, 4: None}, "C": {1: None}, "D": {None: 2.0}}
    rows = [(h, "deluxe", None if n is None else day(n), y) for h, days in known.items() for n, y in days.items()]
    filled = S.fill_gaps(spark.createDataFrame(rows, "hotel_id string, room_type string, ds date, y double"))
    got = {(r.hotel_id, (r.ds - day(0)).days): r.y for r in filled.collect()}
    a = [1.0, 3.0, 5.0, 7.0, 9.0, 7.0, 5.0]
    assert got == {**{("A", n): y for n, y in enumerate(a)}, **{("B", n): 4.0 for n in range(5)}, ("C", 1): None}
    filled.explain()
    plan = capsys.readouterr().out.lower()
    assert "join" not in plan and "unboundedfollowing" not in plan  # the latter looks ahead anew from every day


def test_folds_are_dealt_out_before_they_are_sorted(spark, capsys):
    S.backtest(S.fill_gaps(daily(spark, 420))).explain()
    plan = capsys.readouterr().out
    assert "REPARTITION_BY_COL" in plan  # else a task sorts every fold of what it was sized for


def psi_by_hand(reference, current, bins=10):
    edges = np.unique(np.percentile(reference, np.linspace(0, 100, bins + 1)))
    edges[0], edges[-1] = -np.inf, np.inf
    r = np.clip(np.histogram(reference, edges)[0] / len(reference), 1e-4, None)
    c = np.clip(np.histogram(current, edges)[0] / len(current), 1e-4, None)
    return float(((c - r) * np.log(c / r)).sum())


def test_population_stability(spark):
    rng = np.random.default_rng(3)
    old, new = np.round(rng.normal(0, 1, 400), 2), np.round(rng.normal(0.8, 1, 300), 2)
    rows = [("shifted", float(v), False) for v in old] + [("shifted", float(v), True) for v in new]
    rows += [("flat", 1.0, i % 2 == 0) for i in range(200)]
    rows += [("few", float(i), i % 2 == 0) for i in range(20)]
    out = O.population_stability(spark.createDataFrame(rows, "feature string, value double, recent boolean"))
    psi = {r.feature: r.psi for r in out.collect()}
    assert psi["shifted"] == pytest.approx(psi_by_hand(old, new))
    assert psi["flat"] is None and psi["few"] is None


def test_empty_tables_are_critical(spark):
    none = spark.createDataFrame([], "hotel_id string, check_in_date date, collected_at timestamp")
    day = date(2025, 12, 1)
    assert O.reference_data(none, none).first().severity == "critical"
    assert O.booking_recency(none, day).first().severity == "critical"
    assert O.competitor_freshness(none, day).first().severity == "critical"
    assert O.competitor_coverage(none, day).first().severity == "warning"
    assert O.verdict(O.booking_recency(none, day)).first().exit_code == 1


def test_owned_merge_and_latest(spark):
    stored = spark.createDataFrame([("a", 1, None), ("b", 2, 5)], "k string, signal int, derived int")
    built = spark.createDataFrame([("a", 9, 7), ("c", 8, 6)], "k string, signal int, derived int")
    merged = owned_merge(stored, built, ["k"], ["derived"], ["signal"])
    assert {r.k: (r.signal, r.derived) for r in merged.collect()} == {"a": (1, 7), "b": (2, 5), "c": (8, 6)}
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("a", 2, "z")], "k string, t int, v string")
    assert latest_per_key(rows, ["k"], ["t"]).first().v == "y"
    assert rows.agg(F.count("*")).first()[0] == 3


TRAINED = (
    "m6_boosted_predictions", "m11_impurity_importance", "w7_importance_top20",
    "m12_permutation_importance", "m14_training_record", "p14_reprice_two_models",
)


@pytest.fixture
def two_nights(spark, monkeypatch):
    """A matrix of one training and one test night in place of the folder's."""
    matrix = spark.createDataFrame([(date(2025, 1, 1),), (date(2025, 12, 1),)], "stay_date date")
    monkeypatch.setattr(M.FQ, "matrix", lambda *_: matrix)
    monkeypatch.setattr(M.files, "write_and_read", lambda frame, name: frame)


@pytest.mark.parametrize("name", TRAINED)
def test_training_queries_fit_the_whole_configuration(spark, two_nights, monkeypatch, name):
    class Asked(Exception):
        pass

    def fit(rows, config=BOOST_CONFIG):
        raise Asked(config)

    monkeypatch.setattr(M.T, "fit_boosted", fit)
    with pytest.raises(Asked) as asked:
        M.QUERIES[name](spark, "")
    assert asked.value.args == (BOOST_CONFIG,)


def test_permutation_query_shuffles_each_feature_five_times(spark, two_nights, monkeypatch):
    monkeypatch.setattr(M.T, "fit_boosted", lambda rows, config=BOOST_CONFIG: None)
    monkeypatch.setattr(M.T, "permutation_importance", lambda model, test, repeats=3, seed=42: repeats)
    assert M.QUERIES["m12_permutation_importance"](spark, "") == 5
