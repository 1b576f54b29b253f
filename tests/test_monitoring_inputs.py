"""Monitoring queries build their tables once and read what is written."""

from datetime import date

from nightledger.config import MONITOR_CONFIG


def test_drift_and_report_read_written_tables(spark, monkeypatch):
    from nightledger.catalog import monitoring as Q

    values = ", ".join(f"cast(id AS DOUBLE) AS {c}" for c in (*MONITOR_CONFIG.watched, "occupancy_rate", "historical_demand", "current_room_price"))
    names = list(dict.fromkeys(values.split(", ")))
    nights = spark.range(20).selectExpr("'v1' AS feature_version", "DATE'2025-11-01' AS stay_date", *names)
    seen = {}

    def feature_drift(rows, as_of):
        seen["drift"] = rows
        return rows.selectExpr("'x' AS feature", "1D AS psi", "1D AS reference_mean", "1D AS current_mean").limit(1)

    def model_report(stored, predictions, audit, as_of):
        seen.update(stored=stored, predictions=predictions, audit=audit)
        return stored.selectExpr("1D AS value")

    monkeypatch.setattr(Q, "stored", lambda spark, folder: nights)
    monkeypatch.setattr(Q, "audit", lambda spark, folder: spark.range(3))
    monkeypatch.setattr(Q.O, "feature_drift", feature_drift)
    monkeypatch.setattr(Q.O, "model_report", model_report)
    Q.d13(spark, "f")
    Q.d18(spark, "f")
    assert all(len(frame.inputFiles()) > 0 for frame in seen.values()) and len(seen) == 4
    assert seen["drift"].count() == seen["stored"].count() == 20 and seen["audit"].count() == 3
    assert {r.stay_date for r in seen["drift"].collect()} == {date(2025, 11, 1)}
