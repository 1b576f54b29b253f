"""Published tables, the index of ids, stored signals, counters and sending."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from nightledger.config import GRAIN
from nightledger.operators.merge import owned_merge
from nightledger.streaming import ingest as I
from nightledger.streaming import tables as K


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "event_id string")


def test_a_change_counts_once_it_is_published(spark, tmp_path):
    root = str(tmp_path)
    rows = spark.createDataFrame([(i, f"k{i}") for i in range(20)], "n int, event_id string")
    part = F.format_string("p%d", F.col("n") % 2)
    empty = K.snapshot(spark, root)
    assert empty.generation == 0 and K.read(spark, root, rows.schema, empty.parts).count() == 0
    parts = K.write_parts(rows, part, "event_id", root, "a")
    assert K.snapshot(spark, root) == empty  # written, not published
    K.publish(spark, empty, "a", parts)
    for n in range(2, 7):  # manifests take turns, the last one counts
        before = K.snapshot(spark, root)
        parts = K.write_parts(rows.withColumn("n", F.col("n") + n), part, "event_id", root, f"b{n}")
        K.publish(spark, before, f"b{n}", parts)
        now = K.snapshot(spark, root)
        assert (now.generation, now.label) == (n, f"b{n}")
        assert K.read(spark, root, rows.schema, now.parts).agg(F.min("n")).first()[0] == n
    assert len(list((tmp_path / "manifest").glob("slot=*"))) == K.SLOTS
    assert {(p.part, p.rows) for p in now.parts} == {("p0", 10), ("p1", 10)}
    K.publish(spark, now, "none", K.write_parts(rows.limit(0), part, "event_id", root, "none"))
    assert K.snapshot(spark, root).parts == () and K.snapshot(spark, root).label == "none"


def test_only_files_that_may_hold_an_id_are_opened(spark, tmp_path):
    root = str(tmp_path)
    for n in range(5):  # ids that grow with time: ranges of batches do not meet
        batch = spark.range(n * 1_000, (n + 1) * 1_000).select(F.format_string("%08d", "id").alias("event_id"))
        K.remember(spark, K.snapshot(spark, root), batch, f"batch-{n}", buckets=4, files=99)
    index = K.snapshot(spark, root)
    assert len(index.parts) == 20 and sum(p.rows for p in index.parts) == 5_000
    asked = ids(spark, "00001234", "00001235", "99999999")
    opened = K.files_with(index, asked, buckets=4)
    assert 1 <= len(opened) <= 2 and all("batch-1" in p.path for p in opened)
    held = K.known(spark, index, asked, buckets=4)
    assert sorted(r.event_id for r in held.collect()) == ["00001234", "00001235"]
    assert all("batch-1" in f for f in K.read(spark, root, K.IDS, opened).inputFiles())
    nothing = ids(spark, "zz")
    assert K.files_with(index, nothing, buckets=4) == [] and K.known(spark, index, nothing, buckets=4).count() == 0


def test_crowded_buckets_become_one_file(spark, tmp_path):
    root = str(tmp_path)
    for n in range(7):
        K.remember(spark, K.snapshot(spark, root), ids(spark, *(f"{n}-{i}" for i in range(50))), f"b{n}", buckets=2, files=3)
        index = K.snapshot(spark, root)
        assert len(index.parts) <= 2 * 4 and sum(p.rows for p in index.parts) == 50 * (n + 1)
    every = ids(spark, *(f"{n}-{i}" for n in range(7) for i in range(50)))
    assert K.known(spark, index, every, buckets=2).count() == 350


def bookings(spark, *rows):
    return spark.createDataFrame([(i, datetime(2025, 1, t), n) for i, t, n in rows], "event_id string, event_time timestamp, n int")


def test_append_survives_failure_and_replay(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "bookings")
    held = lambda: sorted((r.event_id, r.n) for r in spark.read.parquet(path).collect())
    first = bookings(spark, ("a", 1, 1), ("a", 2, 2), ("b", 1, 3))
    remember = K.remember
    with monkeypatch.context() as m:  # rows are written, the index is not
        m.setattr(K, "remember", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            I.append_new(first, path, "s-0")
    assert K.remember is remember
    for _ in range(2):  # the batch again, and once more after it was published
        I.append_new(first, path, "s-0")
        assert held() == [("a", 1), ("b", 3)]
    I.append_new(bookings(spark, ("b", 9, 4), ("c", 9, 5)), path, "s-1")  # a redelivery with another time
    I.append_new(bookings(spark, ("b", 9, 4), ("c", 9, 5)), path, "s-1")
    assert held() == [("a", 1), ("b", 3), ("c", 5)]
    I.append_new(bookings(spark).limit(0), path, "s-2")
    assert held() == [("a", 1), ("b", 3), ("c", 5)]


def test_a_table_without_an_index_gets_one(spark, tmp_path):
    path = str(tmp_path / "bookings")
    bookings(spark, ("a", 1, 1)).write.parquet(f"{path}/batch=old-0")
    I.append_new(bookings(spark, ("a", 2, 2), ("b", 2, 3)), path, "s-0")
    assert sorted(r.event_id for r in spark.read.parquet(path).collect()) == ["a", "b"]


FEATURES = (
    "hotel_id string, room_type string, stay_date date, booking_count long, local_event_score double, weather_score double,"
    " search_demand double, holiday_flag boolean, holiday_name string, day_of_week int, is_weekend boolean, season string"
)


def test_signals_go_into_stored_rows(spark, tmp_path):
    root = str(tmp_path)
    night = lambda m, d=1: date(2025, m, d)
    old = (0.0, 0.0, 0.0, True, "Old day", 9, False, "kept")
    rows = [("H1", "deluxe", night(1), 7, *old), ("H1", "deluxe", night(1, 2), 8, *old), ("H1", "deluxe", night(2), 9, *old)]
    schema = K.create_features(spark.createDataFrame(rows, FEATURES), root)

    def deliver(label, *signals):
        made = [("H1", "deluxe", s, e, datetime(2025, 1, t), 0.5, 0.6, demand, False, None, 3, True, "new") for s, e, t, demand in signals]
        names = (
            "hotel_id string, room_type string, stay_date date, event_id string, event_time timestamp, local_event_score double,"
            " weather_score double, search_demand double, holiday_flag boolean, holiday_name string, day_of_week int, is_weekend boolean, season string"
        )
        K.upsert_signals(spark, root, schema, spark.createDataFrame(made, names), label)
        return {r.stay_date: r for r in K.features(spark, root, schema).collect()}

    before = {p.part: p.path for p in K.snapshot(spark, root).parts}
    now = deliver("s-0", (night(1), "e5", 5, 0.1), (night(1, 3), "e1", 5, 0.2))
    paths = {p.part: p.path for p in K.snapshot(spark, root).parts}
    assert paths["2025-02"] == before["2025-02"] and paths["2025-01"] != before["2025-01"]
    got = now[night(1)]
    assert (got.search_demand, got.weather_score, got.holiday_flag, got.holiday_name) == (0.1, 0.6, False, None)
    assert (got.booking_count, got.day_of_week, got.season) == (7, 9, "kept")  # derived and calendar columns stay
    assert now[night(1, 2)][3:12] == (8, *old) and now[night(2)][3:12] == (9, *old)
    assert (now[night(1, 3)].booking_count, now[night(1, 3)].season, now[night(1, 3)].search_demand) == (None, "new", 0.2)
    assert deliver("s-0", (night(1), "e9", 9, 0.9)) == now  # the same batch again
    assert deliver("s-1", (night(1), "e4", 4, 0.9))[night(1)].search_demand == 0.1  # an older event
    assert deliver("s-2", (night(1), "e4", 5, 0.9))[night(1)].search_demand == 0.1  # equal time, smaller id
    assert deliver("s-3", (night(1), "e6", 5, 0.7))[night(1)].search_demand == 0.7


def events(spark, path, *files):
    for rows in files:
        spark.createDataFrame(rows, "source string, persisted boolean, rules array<string>").coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema("source string, persisted boolean, rules array<string>").option("maxFilesPerTrigger", 1).parquet(path)


def test_three_counters_grow(spark, tmp_path):
    source, root, checkpoint = (str(tmp_path / n) for n in ("in", "counters", "checkpoint"))
    first = [("site", None, None), ("site", None, []), (None, True, ["A", "B"]), (None, False, ["A"]), (None, None, None)]
    I.count_on(events(spark, source, first, [("portal", None, None), (None, True, ["A", None])]), root, checkpoint).awaitTermination()
    got = lambda: {(r.counter, r.label): r.n for r in I.counters(spark, root).collect()}
    want = {
        ("observations", "site"): 2, ("observations", "portal"): 1, ("decisions", "true"): 2, ("decisions", "false"): 1,
        ("guardrail_hits", "A"): 3, ("guardrail_hits", "B"): 1, ("guardrail_hits", None): 1,
    }
    assert got() == want
    I.count_on(events(spark, source, [("site", None, None)]), root, checkpoint).awaitTermination()
    assert got() == {**want, ("observations", "site"): 3}


def test_moved_counters_are_read_from_what_was_written(spark, tmp_path, monkeypatch):
    source, root, checkpoint = (str(tmp_path / n) for n in ("in", "counters", "checkpoint"))
    read, write_parts = [], K.write_parts
    monkeypatch.setattr(K, "write_parts", lambda rows, *rest: read.append(rows.inputFiles()) or write_parts(rows, *rest))
    I.count_on(events(spark, source, [("site", None, None)]), root, checkpoint).awaitTermination()
    assert len(read) == 1 and read[0]  # files, and not the state of the stream once more


def test_what_became_of_messages(spark, tmp_path):
    def faulty():
        tried = {}

        def send(key, value):
            tried[value] = tried.get(value, 0) + 1
            if value == "never" or value == "third" and tried[value] < 3:
                raise OSError(f"no {value}")

        return send

    source, path = str(tmp_path / "in"), str(tmp_path / "outcomes")
    rows = [("a", "ok"), (None, "ok"), ("b", "third"), ("c", "never"), ("d", None), ("e", "x" * 50)]
    spark.createDataFrame(rows, "key string, value string").coalesce(1).write.parquet(source)

    def sent(name, **more):
        stream = I.message_stream(spark, source)
        I.send_all(stream, f"{path}-{name}", str(tmp_path / name), faulty, largest=40, **more).awaitTermination()
        return {(r.key, r.value): (r.outcome, r.attempts, r.error) for r in spark.read.parquet(f"{path}-{name}").collect()}

    assert sent("three") == {
        ("a", "ok"): ("sent", 1, None), (None, "ok"): ("sent", 1, None), ("b", "third"): ("sent", 3, None),
        ("c", "never"): ("failed", 3, "OSError: no never"), ("d", None): ("dropped", 0, "no value"), ("e", "x" * 50): ("dropped", 0, "too large"),
    }
    assert sent("one", attempts=1)["b", "third"] == ("failed", 1, "OSError: no third")
    assert {v for v in sent("off", enabled=False).values()} == {("dropped", 0, "disabled")}
    again = I.resend_failed(spark, f"{path}-one", str(tmp_path / "again"), faulty, attempts=3).collect()
    assert {(r.value, r.outcome) for r in again} == {("third", "sent"), ("never", "failed")}

    def no_broker():
        raise ConnectionError("unreachable")

    down = I.send_all(I.message_stream(spark, source), f"{path}-down", str(tmp_path / "down"), no_broker, attempts=2)
    down.awaitTermination()
    outcomes = spark.read.parquet(f"{path}-down").groupBy("outcome").count().collect()
    assert {r.outcome: r["count"] for r in outcomes} == {"failed": 5, "dropped": 1}


def test_stored_rows_are_read_once_and_keep_what_is_newer(spark, tmp_path, monkeypatch):
    day = date(2025, 3, 1)
    when = [datetime(2025, 3, 1, h) for h in range(4)]
    columns = "hotel_id string, room_type string, stay_date date, search_demand double, signal_time timestamp, signal_event string"
    stored = spark.createDataFrame(
        [("A", "suite", day, 0.1, None, None), ("B", "suite", day, 0.2, when[2], "m"), ("C", "suite", day, 0.3, when[2], "m"),
         ("D", "suite", day, 0.4, when[2], "m"), (None, "suite", day, 0.5, when[0], "m")], columns,
    )
    incoming = spark.createDataFrame(
        [("A", "suite", day, 0.6, when[0], "a"), ("B", "suite", day, 0.7, when[1], "z"), ("C", "suite", day, 0.8, when[2], "n"),
         ("D", "suite", day, 0.9, when[2], "m"), ("E", "suite", day, 1.0, None, None)], columns,
    )
    owned = ["search_demand", "signal_time", "signal_event"]
    merged = owned_merge(stored, incoming, list(GRAIN), owned, [], ["signal_time", "signal_event"])
    assert sorted((r.hotel_id or "", r.search_demand) for r in merged.collect()) == [
        ("", 0.5), ("A", 0.6), ("B", 0.2), ("C", 0.8), ("D", 0.4), ("E", 1.0)
    ]

    # A change joins the stored rows once.
    root, joins = str(tmp_path / "rows"), []
    schema = K.create_features(stored.drop("signal_time", "signal_event"), root)
    write = K.write_parts
    monkeypatch.setattr(K, "write_parts", lambda rows, *a: joins.append(rows._jdf.queryExecution().analyzed().toString().count("Join ")) or write(rows, *a))
    K.upsert_signals(spark, root, schema, incoming.withColumnsRenamed({"signal_time": "event_time", "signal_event": "event_id"}), "c")
    assert joins == [1]
    assert {r.hotel_id: r.search_demand for r in K.features(spark, root, schema).collect()}["B"] == 0.7  # not stamped yet
