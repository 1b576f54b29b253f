"""What the operators share: reading, written intermediate tables, folds and batch limits."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import nightledger
from nightledger.session import work_dir

#: What separates words: space and the ASCII controls 9 to 13.
SPACE = "\x20\t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of one Arrow batch sent to a Python worker; a longer text travels alone.
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Make the session ready for Python workers: batches are bounded by bytes, so that long
    texts do not add up, and this package is sent along, so that workers can import it."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    context = spark.sparkContext
    if not getattr(context, "_nightledger_sent", None):
        package = Path(nightledger.__file__).resolve().parent
        # Served by the driver while it lives, so it is a folder of the driver's own.
        folder = tempfile.TemporaryDirectory()
        archive = Path(folder.name, "nightledger.zip")
        with zipfile.ZipFile(archive, "w") as out:
            for file in sorted(package.rglob("*.py")):
                out.write(file, str(Path("nightledger", file.relative_to(package))))
        context.addPyFile(str(archive))
        context._nightledger_sent = folder


def store(frame: DataFrame, name: str) -> DataFrame:
    """Write ``frame`` to the shared work folder and read it back.

    Cuts the lineage: a lost executor costs the tasks it ran, not what is written, and a
    table that is read twice is the same both times.
    """
    spark = frame.sparkSession
    path = work_dir(spark, name)
    frame.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def fold(key: Column, parts: int) -> Column:
    """crc32 of the key's text modulo ``parts``; a null key counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % F.lit(parts)


def one_label(labels: DataFrame, column: str) -> DataFrame:
    """One row per document with its label: the largest where a document repeats; rows
    without id or label are left out."""
    return (
        labels.select("doc_id", F.col(column).cast("int").alias("label"))
        .where("doc_id IS NOT NULL AND label IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
    )
