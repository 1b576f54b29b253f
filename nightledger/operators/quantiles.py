"""Exact quantiles of groups of any size.

The built-in exact percentile keeps all distinct values of a group in one task.  Here the
distinct values are dealt into ranges of (key, value) whose edges Spark samples from the data,
so a sliver that holds almost all values of a key is split like any other.  Counts per range
locate the few that hold the wanted ranks, and only the values in those are ordered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nightledger.sources.files import write_and_read


def exact_quantiles(
    counted: DataFrame, keys: list[str], probabilities: list[float], weight: str = "n"
) -> DataFrame:
    """``keys`` and ``q``: linearly interpolated quantiles, in the order asked for.

    ``counted`` has one row per key and distinct ``value`` with its number of
    occurrences.  Groups without occurrences are left out.
    """
    rows = counted.where(F.col(weight) > 0).select(
        *keys, "value", F.col(weight).cast("bigint").alias("_n")
    )
    ranged = rows.repartitionByRange(*keys, "value").withColumn("_bucket", F.spark_partition_id())
    # Written, since a range's number has to stay the same in all that follows.
    placed = write_and_read(ranged, "quantiles")
    in_order = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    sizes = (
        placed.groupBy(*keys, "_bucket")
        .agg(F.sum("_n").alias("_size"))
        .withColumn("_end", F.sum("_size").over(in_order))
        .withColumn("_total", F.sum("_size").over(Window.partitionBy(*keys)))
        .withColumn("_start", F.expr("_end - _size"))
    )
    listed = ", ".join(f"struct({i} AS i, {p}D AS p)" for i, p in enumerate(probabilities))
    ranks = (
        sizes.withColumn("_t", F.expr(f"explode(array({listed}))"))
        .withColumn("_position", F.expr("_t.p * (_total - 1)"))
        .withColumn("_rank", F.expr("explode(array(floor(_position), ceil(_position)))"))
        .where("_rank >= _start AND _rank < _end")
        .select(
            *keys, "_bucket", "_start", F.col("_t.i").alias("_i"), "_position", "_rank",
        )
        .distinct()
    )
    wanted = ranks.select(*keys, "_bucket", "_start").distinct()
    within = Window.partitionBy(*keys, "_bucket").orderBy("value").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    located = (
        placed.select(*keys, "_bucket", "value", "_n")
        .join(wanted, [*keys, "_bucket"])
        .withColumn("_to", F.col("_start") + F.sum("_n").over(within))
        .withColumn("_from", F.expr("_to - _n"))
        .drop("_start", "_n")
    )
    hits = located.join(ranks.drop("_start"), [*keys, "_bucket"]).where(
        "_rank >= _from AND _rank < _to"
    )
    values = hits.groupBy(*keys, "_i").agg(
        F.min("value").alias("_low"), F.max("value").alias("_high"), F.max("_position").alias("_position")
    ).withColumn("_q", F.expr("_low + (_high - _low) * (_position - floor(_position))"))
    return values.groupBy(*keys).agg(
        F.expr("transform(array_sort(collect_list(struct(_i, _q))), e -> e._q)").alias("q")
    )
