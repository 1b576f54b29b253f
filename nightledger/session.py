"""Session set-up and the shared work folder.

Jobs take whatever session they are given; :func:`tune` only sets the handful of runtime
options that results or plans depend on.  Sizing (executors, memory, the number of
shuffle partitions) belongs to the cluster, so it is left alone when already chosen.
"""

from __future__ import annotations

import atexit
import functools
import os
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

_RUNTIME = {
    # Dates and hours mean UTC everywhere.
    "spark.sql.session.timeZone": "UTC",
    # Re-plan joins, coalesce small partitions and split skewed ones at run time.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def build_session(cores: str = "8", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("nightledger")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.parquet.compression.codec", "zstd")
    )
    for key, value in _RUNTIME.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def tune(spark: SparkSession) -> SparkSession:
    """Set the runtime options results depend on; sizing is left to the cluster."""
    for key, value in _RUNTIME.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


@functools.lru_cache(maxsize=1)
def _local_root() -> str:
    """One temporary folder per local process, removed when it ends."""
    root = tempfile.mkdtemp(prefix="nightledger-")
    atexit.register(shutil.rmtree, root, ignore_errors=True)
    return root


def work_root(spark: SparkSession) -> str:
    """The folder for tables and streaming checkpoints that jobs write.

    On a cluster it lies below ``spark.checkpoint.dir``, which every executor can read,
    so a lost executor loses nothing.  A temporary folder is used only where that
    setting is missing and the master is local.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        root = _local_root()
    return root


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below :func:`work_root`."""
    return os.path.join(work_root(spark), f"{name}-{uuid.uuid4().hex[:12]}")
