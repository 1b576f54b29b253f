"""Decoding, checks and idempotent ingestion."""

import json
import re
from datetime import date

from nightledger.streaming import envelope as E
from nightledger.streaming import ingest as I

DAY = date(2025, 12, 1)
BOOKING = dict(
    hotel_id="H001", room_type="deluxe", booking_date="2025-11-01", check_in_date="2025-12-05",
    check_out_date="2025-12-06", booking_count=3,
)


def message(payload=None, **fields):
    body = dict(
        event_id="e1", event_type="booking", version=1, timestamp="2025-11-01T10:00:00Z", source="test",
        payload={**BOOKING, **(payload or {})},
    )
    body.update(fields)
    return json.dumps({k: v for k, v in body.items() if v is not None})


def frames(spark):
    hotels = spark.createDataFrame([("H001",)], "hotel_id string")
    rooms = spark.createDataFrame([("H001", "deluxe")], "hotel_id string, room_type string")
    return hotels, rooms


def reasons(spark, *texts, strict=False, empty=False):
    hotels, rooms = frames(spark)
    if empty:
        hotels = hotels.where("false")
    raw = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, value string")
    rows = E.classify(raw, hotels, rooms, DAY, strict).orderBy("i").collect()
    return [r.poison or r.rejected for r in rows]


def test_reasons(spark):
    assert reasons(
        spark,
        message(),
        "not json",
        "[1]",
        message(extra=1),
        message(event_type="mystery"),
        message(version=2),
        message(version=0),
        message(timestamp="yesterday"),
        message({"colour": "red"}),
        message({"booking_count": -1}),
        message({"cancellation_count": 4}),
        message({"check_out_date": "2025-12-05"}),
        message({"room_type": "attic"}),
        message({"hotel_id": "H999"}),
        message({"room_type": "suite"}),
    ) == [
        None, "not_an_object", "not_an_object", "unknown_envelope_field", "unknown_event_type",
        "unsupported_version", "unsupported_version", "bad_timestamp", "unknown_payload_field",
        "bad_booking_count", "cancelled_more_than_booked", "stay_not_positive",
        "unknown_room_type_value", "unknown_hotel", "unknown_room_type",
    ]
    assert reasons(spark, message(), empty=True) == [None]
    assert reasons(spark, message(), empty=True, strict=True) == ["no_reference_data"]


def test_redelivery_and_new_checkpoint_add_nothing(spark, tmp_path):
    signal = dict(hotel_id="H001", room_type="deluxe", stay_date="2025-12-05")
    first = [
        message(), message(), message(event_id=None), "broken",
        message(event_id="s1", event_type="demand_signal", payload={**signal, "search_demand": 0.2}),
    ]
    second = [
        message({"booking_count": 9}),
        message(event_id="e2"),
        message(event_id="s2", event_type="demand_signal", timestamp="2025-11-02T00:00:00Z",
                payload={**signal, "search_demand": 0.9}),
    ]
    # message() merges the booking payload in; signals must not carry its fields.
    def clean(text):
        if "demand_signal" not in text:
            return text
        body = json.loads(text)
        body["payload"] = {k: v for k, v in body["payload"].items() if k in (*signal, "search_demand")}
        return json.dumps(body)

    source, tables = str(tmp_path / "in"), str(tmp_path / "out")
    hotels, rooms = frames(spark)

    def deliver(texts, checkpoint):
        spark.createDataFrame([("k", clean(t)) for t in texts], "key string, value string").coalesce(
            1
        ).write.mode("append").parquet(source)
        I.ingest(
            I.message_stream(spark, source, 1), tables, str(tmp_path / checkpoint),
            lambda: hotels, lambda: rooms, DAY,
        ).awaitTermination()

    deliver(first, "c1")
    deliver(second, "c1")
    named = lambda: sorted(
        (r.event_id, r.booking_count)
        for r in spark.read.parquet(f"{tables}/bookings").collect()
        if len(r.event_id) < 36
    )
    assert named() == [("e1", 3), ("e2", 3)]
    assert I.current_signals(spark, tables).first().search_demand == 0.9
    deliver([message(event_id="e3")], "c2")  # everything again, plus one
    assert named() == [("e1", 3), ("e2", 3), ("e3", 3)]
    assert I.current_signals(spark, tables).count() == 1
    poison = spark.read.parquet(f"{tables}/dead_letters")
    assert poison.where("value = 'broken'").count() == 2


def test_checked_messages_are_kept_without_their_text(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    texts = [message(), "not json", message({"hotel_id": "H999"}, event_id="e2")]
    spark.createDataFrame([(None, t) for t in texts], "key string, value string").coalesce(1).write.parquet(source)
    limit = spark.conf.get("spark.sql.codegen.hugeMethodLimit")
    hotels, rooms = frames(spark)
    I.ingest(I.message_stream(spark, source), out, checkpoint, lambda: hotels, lambda: rooms, DAY).awaitTermination()
    staged = spark.read.parquet(f"{out}/staged")
    assert {"key", "payload"}.isdisjoint(staged.columns)
    assert [r.value for r in staged.where("value IS NOT NULL").collect()] == ["not json"]
    assert [r.value for r in spark.read.parquet(f"{out}/dead_letters").collect()] == ["not json"]
    assert [r.event_id for r in spark.read.parquet(f"{out}/bookings").collect()] == ["e1"]
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == limit  # of the stream's session only


def test_rules_are_made_of_methods_that_the_jvm_compiles(spark):
    raw = spark.range(3).selectExpr("cast(id AS STRING) AS value")
    plan = E.check_payload(E.decode(raw), DAY)._jdf.queryExecution().executedPlan()
    code = spark._jvm.org.apache.spark.sql.execution.debug.__getattr__("package").codegenString(plan)
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", code)]
    assert sizes and max(sizes) < I.COMPILED


def test_a_join_with_references_does_not_multiply_the_expressions(spark):
    hotels, rooms = frames(spark)
    raw = spark.range(3).selectExpr("cast(id AS STRING) AS value")
    joined = E.classify(raw, hotels, rooms, DAY)._jdf.queryExecution().analyzed().toString()
    # Plain equality of keys is traced back to the scan, null-safe equality is not.
    assert "<=> _h#" in joined and "= _h#" not in joined.replace("<=> _h#", "")
    unknown = spark.createDataFrame([(None, "deluxe"), ("H001", None)], "hotel_id string, room_type string")
    row = E.classify(spark.createDataFrame([(message(),)], "value string"), hotels, unknown, DAY).first()
    assert row.rejected == "unknown_room_type"


def test_fields_that_come_twice_or_null_or_as_odd_numbers(spark):
    whole = message()
    payload = json.dumps(BOOKING)
    texts = [
        whole[:-1] + ', "event_type": "mystery"}',  # the last one counts
        whole.replace('"event_type": "booking"', '"event_type": "mystery", "event_type": "booking"'),
        whole.replace("}}", ', "booking_count": -1}}'),
        whole.replace("}}", ', "adr": null, "channel": null}}'),
        whole.replace("}}", ', "price": 1}}'),
        whole.replace("}}", ', "adr": NaN}}'),
        whole.replace("}}", ', "adr": "NaN"}}'),
        whole.replace('"version": 1', '"version": Infinity'),
        whole.replace('"version": 1', '"version": null'),
        whole.replace(payload, json.dumps(payload)),  # a payload in text
        whole.replace(payload, json.dumps(payload.replace("}", ', "adr": NaN}'))),
        whole + " and more",
        f"[{whole}]",
        whole.replace('"', "'"),
        whole.replace("H001", "H\t01"),
    ]
    assert reasons(spark, *texts) == [
        "unknown_event_type", None, "bad_booking_count", None, "unknown_payload_field", "not_an_object",
        None, "not_an_object", None, None, "missing_payload", None, "not_an_object", None, "unknown_event_type",
    ]
