"""Mixing sources to target weights by hash thresholds.

Each document has a 60-bit hash of its id and text.  Words are summed by source and hash
bucket; the bucket in which a source's budget runs out is refined twelve bits at a time until it
holds one hash.  The threshold found that way is nested: with a larger budget it only grows.
Documents below the threshold are taken once more than the rest of their source; nothing is
sorted, and per source only a histogram of 4,096 buckets is ordered.

A source over its own size is repeated: with target t and size S every document is taken
floor(t / S) times, and documents below the threshold once more.

Edge cases: a null text has size 0, a null source is a source of its own and comes last, rows
with equal id and text share a hash and are taken alike, an empty table gives an empty result,
other columns are kept by :func:`mix` (helper columns carry the prefix ``_mix_``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nightledger.llm.common import WORD, store, table

BITS, LEVELS = 12, 5
TOP = BITS * LEVELS


def _measured(documents: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    mark = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(text.cast("binary"))))
    return documents.withColumns(
        {
            "_mix_none": F.col("source").isNull(),
            "_mix_source": F.coalesce(F.col("source").cast("string"), F.lit("")),
            "_mix_size": F.regexp_count(text, F.lit(WORD)).cast("long"),
            "_mix_hash": F.conv(F.substring(mark, 1, TOP // 4), 16, 10).cast("long"),
        }
    )


def targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """Target of every source; ``sizes`` has one row per source (_mix_none, _mix_source, source_size).

    Weights go round over the sources in code point order, null last.  ``share`` of all sizes is
    dealt out by weight; a target stops at ``most`` times its source, and what lies above goes to
    the rest by weight until none is above.  That fixed point is found in one pass over the
    sources in the order in which they reach their limit: one row per source.
    """
    whole = Window.partitionBy()
    order = Window.orderBy("_mix_none", "_mix_source")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.row_number().over(order) - 1) % len(weights) + 1)
    ranked = sizes.select("*", w.alias("w"), (F.lit(float(most)) * F.col("source_size")).alias("limit"))
    filled = Window.orderBy(F.col("limit") / F.col("w"), "_mix_none", "_mix_source")
    filling = filled.rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranked.select(
        "*",
        F.sum("source_size").over(whole).alias("all"),
        F.sum("w").over(whole).alias("all_w"),
        F.coalesce(F.sum("limit").over(filling), F.lit(0.0)).alias("full"),
        F.coalesce(F.sum("w").over(filling), F.lit(0.0)).alias("full_w"),
        F.row_number().over(filled).alias("turn"),
    )
    level = (F.lit(float(share)) * F.col("all") - F.col("full")) / (F.col("all_w") - F.col("full_w"))
    # The first source that does not reach its limit sets the level for all that follow.
    ranked = ranked.withColumn("first", F.when(F.col("limit") > level * F.col("w"), F.struct("turn", level.alias("level"))))
    ranked = ranked.withColumn("level", F.min("first").over(whole)["level"])
    return ranked.select(
        "_mix_none",
        "_mix_source",
        "source_size",
        F.least("limit", F.coalesce(F.col("level") * F.col("w"), F.col("limit"))).alias("target"),
    )


def thresholds(measured: DataFrame, goals: DataFrame) -> DataFrame:
    """Per source the whole takings of each document and the hash up to which (exclusive) one
    more is taken: (_mix_none, _mix_source, source_size, target, copies, below)."""
    keys = ["_mix_none", "_mix_source"]
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    state = goals.withColumn("copies", copies).select(
        "*",
        (F.col("target") - F.col("copies") * F.col("source_size")).alias("need"),
        F.lit(0).cast("long").alias("prefix"),
        F.lit(0.0).alias("cum"),
    )
    for level in range(LEVELS):
        rest = TOP - BITS * level
        inside = measured.join(state.select(*keys, "prefix"), keys).where(
            F.shiftright("_mix_hash", rest) == F.col("prefix") if level else F.lit(True)
        )
        histogram = inside.groupBy(*keys, F.shiftright("_mix_hash", rest - BITS).alias("bucket")).agg(
            F.sum("_mix_size").alias("words"), F.min("_mix_hash").alias("lo"), F.max("_mix_hash").alias("hi")
        )
        running = Window.partitionBy(*keys).orderBy("bucket")
        found = (
            histogram.withColumn("upto", F.sum("words").over(running))
            .join(state.select(*keys, "need", "cum"), keys)
            .where(F.col("cum") + F.col("upto") >= F.col("need"))
            .groupBy(*keys)
            .agg(F.min(F.struct("bucket", "upto", "words", "lo", "hi")).alias("b"))
        )
        # No bucket reaches the need (or the source is empty): everything lies below.
        state = store(
            state.join(found, keys, "left").select(
                *keys,
                "source_size",
                "target",
                "copies",
                "need",
                F.coalesce(F.col("b.bucket"), (F.shiftleft(F.lit(1).cast("long"), BITS * (level + 1)))).alias("prefix"),
                F.coalesce(F.col("cum") + F.col("b.upto") - F.col("b.words"), F.col("cum")).alias("cum"),
                F.col("b.words").alias("words"),
                F.col("b.hi").alias("hi"),
                (F.col("b.lo") < F.col("b.hi")).alias("open"),
            ),
            "mix-level",
        )
        if state.where("open").isEmpty():
            break
    # The boundary hash itself is taken where that comes nearer to the need.
    nearer = F.abs(F.col("cum") + F.col("words") - F.col("need")) < F.abs(F.col("cum") - F.col("need"))
    below = F.when(F.col("hi").isNull(), F.lit(1 << TOP)).when(nearer, F.col("hi") + 1).otherwise(F.col("hi"))
    return state.select(*keys, "source_size", "target", "copies", below.cast("long").alias("below"))


def plan(documents: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """``documents`` with ``_mix_size``, ``_mix_hash``, ``source_size``, ``target`` and ``_mix_times``."""
    measured = _measured(documents)
    narrow = store(measured.select("_mix_none", "_mix_source", "_mix_size", "_mix_hash"), "mix-sizes")
    sizes = narrow.groupBy("_mix_none", "_mix_source").agg(F.sum("_mix_size").alias("source_size"))
    cut = thresholds(narrow, store(targets(sizes, weights, share, most), "mix-targets"))
    planned = measured.drop("source_size", "target", "copies", "below").join(cut, ["_mix_none", "_mix_source"])
    return planned.withColumn("_mix_times", F.col("copies") + (F.col("_mix_hash") < F.col("below")).cast("long"))


def mix(documents: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """The mix: every document as often as it is taken, with its own columns."""
    planned = plan(documents, weights, share, most)
    repeated = planned.withColumn("_mix_copy", F.explode(F.array_repeat(F.lit(1), F.col("_mix_times").cast("int"))))
    return repeated.select(*documents.columns)


def query(spark, folder):
    """What the mix takes of every document at weights 5, 2, 1 and 150 % of all words."""
    planned = plan(table(spark, folder, "documents"), (5, 2, 1), 1.5, 2.0)
    return planned.select(
        "doc_id",
        F.col("_mix_size").alias("size"),
        "source_size",
        "target",
        (F.col("_mix_size") * F.col("_mix_times")).alias("taken"),
    )


SQL = """
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS h
  FROM documents),
s AS (
  SELECT source, source IS NULL AS none, sum(size)::BIGINT AS source_size,
    [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT]::DOUBLE AS w
  FROM d GROUP BY source),
f AS (
  SELECT *, 2.0::DOUBLE * source_size AS lim, sum(source_size) OVER ()::DOUBLE AS total, sum(w) OVER () AS total_w,
    coalesce(sum(2.0::DOUBLE * source_size) OVER o, 0) AS filled, coalesce(sum(w) OVER o, 0) AS filled_w,
    row_number() OVER (ORDER BY 2.0::DOUBLE * source_size / w, none, source) AS turn
  FROM s WINDOW o AS (ORDER BY 2.0::DOUBLE * source_size / w, none, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (
  SELECT arg_min((1.5::DOUBLE * total - filled) / (total_w - filled_w), turn)
    FILTER (lim > (1.5::DOUBLE * total - filled) / (total_w - filled_w) * w) AS level FROM f),
t AS (
  SELECT source, source_size, least(lim, coalesce(level * w, lim)) AS target FROM f, l),
g AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS copies FROM t),
h AS (SELECT source, h, sum(size) AS words FROM d GROUP BY source, h),
c AS (SELECT *, coalesce(sum(words) OVER (PARTITION BY source ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cum FROM h),
x AS (
  SELECT c.source, h, g.source_size, target, copies,
    CASE WHEN cum >= target - copies * g.source_size AND cum > 0 THEN 0
      WHEN cum + words < target - copies * g.source_size THEN 1
      WHEN abs(cum + words - (target - copies * g.source_size)) < abs(cum - (target - copies * g.source_size)) THEN 1 ELSE 0 END AS extra
  FROM c JOIN g ON c.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, (size * (copies + extra))::BIGINT AS taken
FROM d JOIN x ON d.source IS NOT DISTINCT FROM x.source AND d.h = x.h
"""
