"""Text patterns, files and the registry."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from nightledger.functions import text as X
from nightledger.operators import quality as Z
from nightledger.sources import files


def values(spark, texts, build):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.v for r in frame.select("i", build(F.col("t")).alias("v")).orderBy("i").collect()]


def test_prices_and_rooms(spark):
    texts = ["₹ 6,450", "INR 5,980", "Rs. 12,300", "₹ 1,04,500", "₹ 6200", "Sold out", "₹ 0", ""]
    assert values(spark, texts, X.parse_price) == [6450.0, 5980.0, 12300.0, 104500.0, 6200.0, None, None, None]
    names = ["Deluxe King", "Executive Suite", "Superior Twin", "Pod 7B"]
    portal = lambda c: X.classify_room(c, "portal")
    assert values(spark, names, portal) == ["deluxe", "suite", "premium", None]


def test_redaction(spark):
    texts = ["password=abc, x", "API-Key: 'a b'", "db://me:pw@host/x", "token of thanks", "hush1234"]
    mask = X.MASK
    assert values(spark, texts, lambda c: X.redact(c, ("hush1234", "abc"))) == [
        f"password={mask}, x", f"API-Key={mask}", f"db://me:{mask}@host/x", "token of thanks", mask,
    ]


def test_files_round_trip(spark, tmp_path):
    rooms = spark.createDataFrame(
        [("r1", "H1", "deluxe", 2, 40, 6400.0, None, 9000.0)],
        "room_id string, hotel_id string, room_type string, capacity int, room_count int,"
        " base_price double, floor_price double, ceiling_price double",
    )
    aligned = files.align(rooms.withColumn("junk", F.lit(1)), "rooms")
    assert "junk" not in aligned.columns
    files.write_csv(aligned, str(tmp_path / "rooms"))
    back = files.read_csv(spark, str(tmp_path / "rooms"), "rooms").first()
    assert back.floor_price is None and float(back.base_price) == 6400.0
    with pytest.raises(ValueError, match="base_price"):
        files.align(rooms.drop("base_price"), "rooms")
    assert {r.rule: r.broken_rows for r in Z.violations(rooms, "rooms").collect()}["known room type"] == 0


def test_registry():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    assert len(queries) > 170
