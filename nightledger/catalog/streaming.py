"""Streaming family: decoding, checks, idempotent ingestion, counters."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nightledger.catalog import Registry
from nightledger.catalog import features as FQ
from nightledger.config import CALENDAR_OWNED, GRAIN, SIGNAL_OWNED, TARGET
from nightledger.functions.numeric import settled
from nightledger.plans import features as P
from nightledger.session import work_dir
from nightledger.sources import warehouse as W
from nightledger.streaming import envelope as E
from nightledger.streaming import ingest as I
from nightledger.streaming import tables as K

QUERIES = Registry()


def known_rooms(spark: SparkSession, folder: str) -> DataFrame:
    """All rooms; the suites of one hotel go by another name, so events that name them are unknown."""
    named = "CASE WHEN hotel_id = 'H0003' AND room_type = 'suite' THEN 'annex' ELSE room_type END"
    return W.rooms(spark, folder).withColumn("room_type", F.expr(named))


def booking_messages(spark: SparkSession, folder: str) -> DataFrame:
    """Envelopes of all bookings; some leads are damaged in a way of their own."""
    rows = W.bookings(spark, folder).withColumns(
        {
            "event_time": F.expr(
                "timestampadd(SECOND, booking_count, cast(booking_date AS TIMESTAMP))"
            ),
            "event_id": F.expr("CASE WHEN lead_time_days <> 10 THEN event_id END"),
            "hotel_id": F.expr("CASE WHEN lead_time_days = 11 THEN 'X9' ELSE hotel_id END"),
            "room_type": F.expr("CASE WHEN lead_time_days = 12 THEN 'penthouse' ELSE room_type END"),
            "cancellation_count": F.expr(
                "CASE WHEN lead_time_days = 7 THEN booking_count + 1 ELSE cancellation_count END"
            ),
            "check_out_date": F.expr(
                "CASE WHEN lead_time_days = 8 THEN check_in_date ELSE check_out_date END"
            ),
        }
    )
    lead = F.datediff("check_in_date", "booking_date")
    wrapped = E.wrap(rows.withColumn("_lead", lead), "booking", "synthetic", "_lead")
    return wrapped.selectExpr(
        "key",
        "CASE WHEN _lead = 3 THEN substring(value, 1, 40)"
        " WHEN _lead = 4 THEN regexp_replace(value, '^[{]', '{\"extra\":1,')"
        " WHEN _lead = 5 THEN replace(value, '\"version\":1', '\"version\":2')"
        " WHEN _lead = 6 THEN replace(value, '\"event_type\":\"booking\"', '\"event_type\":\"mystery\"')"
        " WHEN _lead = 9 THEN '[1,2]' ELSE value END AS value",
    )


def rate_messages(spark: SparkSession, folder: str) -> DataFrame:
    """Envelopes of all rates with zoned, offset and naive timestamps; some bad prices."""
    k = "cast(event_id AS BIGINT)"
    rows = W.competitor_prices(spark, folder).withColumns(
        {
            "event_time": F.expr(f"timestampadd(SECOND, cast({k} % 80000 AS INT), collected_at)"),
            "price": F.expr(f"CASE WHEN {k} % 13 = 0 THEN -1D ELSE price END"),
            "currency": F.lit("inr"),
        }
    )
    local = "date_format(timestampadd(MINUTE, 330, cast(t AS TIMESTAMP)), \"yyyy-MM-dd'T'HH:mm:ss\")"
    said = F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return (
        E.wrap(rows.withColumns({"t": said, "n": F.expr(k)}), "competitor_price", "synthetic", "t", "n")
        .selectExpr(
            "key",
            "CASE n % 3 WHEN 0 THEN value WHEN 1 THEN replace(value, t, replace(t, 'Z', ''))"
            f" ELSE replace(value, t, concat({local}, '+05:30')) END AS value",
        )
    )


def signal_messages(spark: SparkSession, folder: str) -> DataFrame:
    """One signal per rate, so a night is updated several times."""
    k = "cast(event_id AS BIGINT)"
    rows = W.competitor_prices(spark, folder).selectExpr(
        "concat('s', event_id) AS event_id",
        "hotel_id",
        "room_type",
        "check_in_date AS stay_date",
        f"{k} % 10 / 10D AS search_demand",
        f"{k} % 7 / 10D AS weather_score",
        f"{k} % 5 / 10D AS local_event_score",
        f"timestampadd(SECOND, cast({k} AS INT), TIMESTAMP'2025-01-01 00:00:00') AS event_time",
    )
    return E.wrap(rows, "demand_signal")


def wire(spark: SparkSession, folder: str) -> DataFrame:
    return reduce(
        DataFrame.unionByName,
        [f(spark, folder) for f in (booking_messages, rate_messages, signal_messages)],
    )


def classified(spark: SparkSession, folder: str) -> DataFrame:
    return E.classify(
        wire(spark, folder), W.hotels(spark, folder), known_rooms(spark, folder), W.AS_OF
    )


@QUERIES.add("t1_decoded_envelopes")
def t1(spark, folder):
    return E.decode(wire(spark, folder)).groupBy("event_type", "poison").agg(F.count("*").alias("n"))


@QUERIES.add("t2_poison_routing")
def t2(spark, folder):
    route = F.when(F.col("poison").isNull(), "valid").otherwise("dead_letter")
    return classified(spark, folder).groupBy(route.alias("route")).agg(F.count("*").alias("n"))


@QUERIES.add("t3_payload_rules")
def t3(spark, folder):
    out = E.check_payload(E.decode(wire(spark, folder)), W.AS_OF)
    return out.groupBy("poison").agg(F.count("*").alias("n"))


@QUERIES.add("t4_event_times")
def t4(spark, folder):
    out = E.decode(rate_messages(spark, folder))
    return out.select(
        "event_id", F.date_format("event_time", "yyyy-MM-dd HH:mm:ss").alias("event_time")
    )


@QUERIES.add("t5_reference_rules")
def t5(spark, folder):
    return (
        classified(spark, folder)
        .where("poison IS NULL")
        .groupBy("event_type", "rejected")
        .agg(F.count("*").alias("n"))
    )


@QUERIES.add("j12_stream_static_join")
def j12(spark, folder):
    out = classified(spark, folder).where("poison IS NULL AND event_type = 'booking'")
    return out.groupBy("p.hotel_id", "rejected").agg(F.count("*").alias("n"))


@QUERIES.add("t6_routed_events")
def t6(spark, folder):
    accepted = classified(spark, folder).where("poison IS NULL AND rejected IS NULL")
    handler = F.expr(
        "CASE event_type WHEN 'booking' THEN 'bookings' WHEN 'competitor_price' THEN"
        " 'competitor_prices' WHEN 'demand_signal' THEN 'demand_signals' ELSE 'ignored' END"
    )
    return accepted.groupBy(handler.alias("handler")).agg(F.count("*").alias("n"))


def ingested(spark: SparkSession, folder: str, deliveries: int = 1, features=None) -> str:
    """Run the real stream over all messages; more deliveries send everything again."""
    source = work_dir(spark, "messages")
    wire(spark, folder).write.parquet(source)
    tables = work_dir(spark, "ingested")
    for _ in range(deliveries):
        I.ingest(
            I.message_stream(spark, source, files_per_trigger=8),
            tables,
            work_dir(spark, "checkpoint"),
            lambda: W.hotels(spark, folder),
            lambda: known_rooms(spark, folder),
            W.AS_OF,
            features=features,
        ).awaitTermination()
    return tables


GIVEN_ID = "CASE WHEN length(event_id) < 36 THEN event_id ELSE 'made up' END"


@QUERIES.add("t7_idempotent_append")
def t7(spark, folder):
    """Ids in the bookings table after a stream that repeats many of them."""
    rows = spark.read.parquet(f"{ingested(spark, folder)}/bookings")
    # Messages without an id were given a fresh one each; they are counted together.
    return rows.groupBy(F.expr(GIVEN_ID).alias("event_id")).agg(F.count("*").alias("n"))


@QUERIES.add("t8_latest_signals")
def t8(spark, folder):
    return I.current_signals(spark, ingested(spark, folder)).select(
        "hotel_id", "room_type", "stay_date", "search_demand", "weather_score",
        "local_event_score", "season", "day_of_week", "is_weekend", "holiday_flag",
    )


@QUERIES.add("t8_stored_features")
def t8b(spark, folder):
    """Stored feature rows after a stream of signals, with derived columns as they were built."""
    root = work_dir(spark, "feature-rows")
    schema = K.create_features(P.feature_records(FQ.matrix(spark, folder)), root)
    ingested(spark, folder, features=(root, schema))
    return settled(
        K.features(spark, root, schema).select(
            *GRAIN, *SIGNAL_OWNED, *CALENDAR_OWNED, "booking_count", "competitor_count",
            "occupancy_rate", "historical_demand", "competitor_rate", TARGET, "feature_version",
        ),
        occupancy_rate=9, historical_demand=9, competitor_rate=9, target_demand=9, search_demand=9,
        weather_score=9, local_event_score=9,
    )


@QUERIES.add("t9_batch_counters")
def t9(spark, folder):
    rows = spark.read.parquet(f"{ingested(spark, folder)}/counters")
    return rows.groupBy("outcome", "reason").agg(F.sum("n").alias("n"))


@QUERIES.add("t10_replayed_stream")
def t10(spark, folder):
    """Rows per table after every message was delivered twice; without an id, both stay."""
    tables = ingested(spark, folder, deliveries=2)
    parts = [
        rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
        for name, rows in (
            ("bookings", spark.read.parquet(f"{tables}/bookings")),
            ("competitor_prices", spark.read.parquet(f"{tables}/competitor_prices")),
            ("demand_signals", I.current_signals(spark, tables)),
        )
    ]
    return reduce(DataFrame.unionByName, parts)


@QUERIES.add("t11_published_messages")
def t11(spark, folder):
    source, sink = work_dir(spark, "outbox"), work_dir(spark, "published")
    rate_messages(spark, folder).write.parquet(source)
    I.publish(I.message_stream(spark, source, 8), sink, work_dir(spark, "checkpoint")).awaitTermination()
    return spark.read.parquet(sink).groupBy("key").agg(F.count("*").alias("n"))


@QUERIES.add("t12_running_counters")
def t12(spark, folder):
    source, out = work_dir(spark, "messages"), work_dir(spark, "running")
    rate_messages(spark, folder).write.parquet(source)
    counts = I.running_counts(
        E.check_payload(E.decode(I.message_stream(spark, source, 8)), W.AS_OF), "p.source", "poison"
    )

    def keep(batch: DataFrame, batch_id: int) -> None:
        # All counters each time; a reader sees those of one batch or the next.
        before, label = K.snapshot(spark, out), f"batch-{batch_id}"
        rows = I.settled_batch(batch, out, label)
        K.publish(spark, before, label, K.write_parts(rows, F.lit("all"), "source", out, label))

    (
        counts.writeStream.outputMode("complete")
        .foreachBatch(keep)
        .option("checkpointLocation", work_dir(spark, "checkpoint"))
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    return K.read(spark, out, counts.schema, K.snapshot(spark, out).parts)


@QUERIES.add("t12_service_counters")
def t12b(spark, folder):
    """Observations by source, decisions by whether they were persisted, and guardrail hits."""
    source, out = work_dir(spark, "served"), work_dir(spark, "counters")
    k = "cast(event_id AS BIGINT)"
    rows = W.competitor_prices(spark, folder).selectExpr(
        f"CASE WHEN {k} % 4 <> 0 THEN competitor END AS source",
        f"CASE WHEN {k} % 4 = 0 THEN {k} % 3 <> 0 END AS persisted",
        f"CASE WHEN {k} % 4 = 0 THEN array_compact(array(CASE WHEN {k} % 5 = 0 THEN 'MAX_DAILY_RISE' END,"
        f" CASE WHEN {k} % 7 = 0 THEN 'ROOM_FLOOR' END)) END AS rules",
    )
    rows.write.parquet(source)
    events = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(source)
    I.count_on(events, out, work_dir(spark, "checkpoint")).awaitTermination()
    return I.counters(spark, out)


def _faulty():
    """Makes connections that take most messages: some at the second try, some never."""

    def connect():
        tried = set()

        def send(key: str | None, value: str) -> None:
            k = int(json.loads(value)["event_id"])
            if k % 17 == 0 or k % 5 == 0 and k not in tried:
                tried.add(k)
                raise ConnectionError("refused")

        return send

    return connect


@QUERIES.add("t11_send_outcomes")
def t11b(spark, folder):
    """What became of each rate's message over a faulty connection; some have no value."""
    source, out = work_dir(spark, "outbox"), work_dir(spark, "outcomes")
    k = "cast(get_json_object(value, '$.event_id') AS BIGINT)"
    messages = rate_messages(spark, folder).withColumn("value", F.expr(f"CASE WHEN {k} % 11 <> 0 THEN value END"))
    messages.write.parquet(source)
    I.send_all(I.message_stream(spark, source, 8), out, work_dir(spark, "checkpoint"), _faulty(), attempts=2).awaitTermination()
    return spark.read.schema(I.SENT).parquet(out).groupBy("key", "outcome", "error").agg(F.count("*").alias("n"))


@QUERIES.add("t7_stream_deduplication")
def t7b(spark, folder):
    """Distinct event ids kept by the bounded-state streaming operator."""
    source, out = work_dir(spark, "messages"), work_dir(spark, "distinct")
    signal_messages(spark, folder).unionByName(signal_messages(spark, folder)).write.parquet(source)
    events = E.decode(I.message_stream(spark, source, 16)).select("event_id", "event_time")
    (
        I.deduplicated(events, "365 days")
        .writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", work_dir(spark, "checkpoint"))
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    return spark.read.parquet(out).select("event_id")
