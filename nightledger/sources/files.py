"""Reading and writing the hotel tables as CSV, JSON and Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nightledger.session import work_dir
from nightledger.sources.schemas import LOAD_ORDER, REQUIRED, TABLES


def read_csv(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A table written as CSV, with dates, times and booleans restored.

    Empty text becomes null.  The schema is given, so nothing is inferred and the file
    is read once.
    """
    return (
        spark.read.schema(TABLES[table])
        .option("header", True)
        .option("nullValue", "")
        .option("emptyValue", "")
        .option("dateFormat", "yyyy-MM-dd")
        .option("timestampFormat", "yyyy-MM-dd HH:mm:ss")
        .csv(path)
    )


def write_csv(frame: DataFrame, path: str) -> None:
    frame.write.mode("overwrite").option("header", True).option("dateFormat", "yyyy-MM-dd").option(
        "timestampFormat", "yyyy-MM-dd HH:mm:ss"
    ).csv(path)


def align(frame: DataFrame, table: str) -> DataFrame:
    """Columns of the target table only, in its order and types; fail on missing ones."""
    target = T.StructType.fromDDL(TABLES[table])
    missing = [c for c in REQUIRED[table] if c not in frame.columns]
    if missing:
        raise ValueError(f"{table}: missing required columns {missing}")
    return frame.select(
        *[
            F.col(f.name).cast(f.dataType).alias(f.name)
            for f in target.fields
            if f.name in frame.columns
        ]
    )


def bulk_load(frames: dict[str, DataFrame], folder: str, truncate: bool = True) -> list[str]:
    """Write tables parents first; returns the order.  ``truncate`` replaces old rows."""
    done = []
    for table in LOAD_ORDER:
        if table in frames:
            align(frames[table], table).write.mode(
                "overwrite" if truncate else "append"
            ).parquet(f"{folder}/{table}")
            done.append(table)
    return done


def verify_load(spark: SparkSession, folder: str, tables: list[str]) -> DataFrame:
    """Rows per table, rooms without a hotel and hotels without rooms."""
    return load_report({t: spark.read.parquet(f"{folder}/{t}") for t in tables})


def load_report(frames: dict[str, DataFrame]) -> DataFrame:
    counts = [
        frame.agg(F.count("*").alias("value")).select(F.lit(f"rows:{name}").alias("item"), "value")
        for name, frame in frames.items()
    ]
    hotels, rooms = frames["hotels"], frames["rooms"]
    counts.append(
        rooms.join(hotels.select("hotel_id"), "hotel_id", "left_anti")
        .agg(F.count("*").alias("value"))
        .select(F.lit("rooms without a hotel").alias("item"), "value")
    )
    counts.append(
        hotels.join(rooms.select("hotel_id"), "hotel_id", "left_anti")
        .agg(F.count("*").alias("value"))
        .select(F.lit("hotels without rooms").alias("item"), "value")
    )
    report = counts[0]
    for part in counts[1:]:
        report = report.unionByName(part)
    return report


def write_json(frame: DataFrame, path: str) -> None:
    frame.write.mode("overwrite").json(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_and_read(frame: DataFrame, name: str) -> DataFrame:
    """Write a table into the work folder and continue from it.

    Cuts the lineage at a durable point: what was written survives a lost executor.
    """
    spark = frame.sparkSession
    path = work_dir(spark, name)
    frame.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
