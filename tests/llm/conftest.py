import os
import random
import sys

import pytest
from pyspark.sql import types as T

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from invented_texts import invented  # noqa: E402

DOCUMENT = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)
#: Names that operators use for themselves.
CLASHING = ("size", "label", "score", "n", "a", "b", "id", "shard", "slot", "kept", "held_out", "x", "features", "words", "part", "open", "target", "copies", "source_size", "key", "mark", "hits", "mask")


@pytest.fixture(scope="session")
def frame(spark):
    """Makes a documents table of (doc_id, text, lang, source) rows with clashing columns added."""

    def make(rows, clashing=True):
        out = spark.createDataFrame([(*r, None) for r in rows], DOCUMENT).repartition(3)
        from pyspark.sql import functions as F

        return out.withColumns({c: F.lit("other") for c in CLASHING}) if clashing else out

    return make


@pytest.fixture(scope="session")
def odd(frame):
    """Nulls in every column, empty and very long texts, repeated rows and repeated ids."""
    rng = random.Random(5)
    long_text = invented(rng, "en", 60_000)
    shared = invented(rng, "en", 40)
    rows = [
        (1, shared, "en", "s1"),
        (1, shared, "en", "s1"),
        (2, shared, None, None),
        (3, None, "en", "s1"),
        (4, "", "en", None),
        (5, " \n\t ", "en", "s2"),
        (6, "one two", "en", "s2"),
        (7, "one two", "fr", "s2"),
        (8, "!!! 12", "de", "s3"),
        (9, long_text, "en", "s3"),
        (10, long_text + " end", "en", "s3"),
        (None, shared, "en", "s1"),
        (None, None, None, None),
        (11, invented(rng, "de", 30), "de", "s1"),
        (11, invented(rng, "fr", 30), "fr", "s1"),
        (12, "Licensed under the Apache License, Version 2.0.\n" + shared, "en", "s4"),
    ]
    return frame(rows), rows


@pytest.fixture(scope="session")
def none(frame):
    return frame([])


@pytest.fixture(scope="session")
def labels(spark):
    def make(rows):
        return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")

    return make
