"""Rendezvous sharding: every record goes to the shard that draws highest for its key.

A shard's draw for a key is ``-weight / ln(u)``, where ``u`` in (0, 1) is taken from MD5 of
"key:shard".  Nothing but the key, the shard and its weight enters a draw, so a further shard
takes over the keys for which it draws highest and no other key moves.

Only DataFrame functions are used.  Edge cases: a null key is the empty key (all such records
meet in one shard), a null text has size 1 and the crc of no bytes, repeated rows each get a
slot of their own, an empty table gives an empty result, other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nightledger.llm.common import store

#: Hex digits of the key hash that split a shard into pieces numbered by separate tasks.
PIECE_DIGITS = 4
#: Repeated rows are counted before they are numbered, and laid out again in runs of this many.
RUN = 10_000


def draw(key: Column, shard: Column, weight: Column) -> Column:
    """The shard's draw for the key; positive, the highest wins."""
    bits = F.conv(F.substring(F.md5(F.concat_ws(":", key, shard.cast("string"))), 1, 13), 16, 10)
    return -weight / F.log((bits.cast("double") + 0.5) / F.lit(float(1 << 52)))


def choose(key: Column, weights: Sequence[float]) -> Column:
    """The shard of the key among ``len(weights)`` shards; equal draws go to the lower shard."""
    if not weights or min(weights) <= 0:
        raise ValueError("shards need positive weights")
    key = F.coalesce(key.cast("string"), F.lit(""))
    draws = F.array(*[F.struct(draw(key, F.lit(i), F.lit(float(w))), F.lit(-i)) for i, w in enumerate(weights)])
    return (-F.array_max(draws)["col2"]).cast("int")


def assign(records: DataFrame, key: str, weights: Sequence[float], into: str = "shard") -> DataFrame:
    """``records`` with the shard of each in column ``into`` (replaced where it exists)."""
    return records.withColumn(into, choose(F.col(key), weights))


def numbered(documents: DataFrame, weights: Sequence[float], grown: Sequence[float]) -> DataFrame:
    """Shard, slot and the shard under ``grown`` weights of every document.

    Slots run without gaps from 0 in the order of (MD5 of the key, key, size, crc).  Equal rows
    are first counted; a shard is numbered in up to 16**PIECE_DIGITS pieces of the key hash, each
    shifted by the rows of the pieces before it, so no task sorts a shard.
    """
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.md5(key.cast("binary")).alias("mark"),
    )
    counted = store(
        rows.groupBy("doc_id", "size", "text_crc32", "mark")
        .agg(F.count(F.lit(1)).alias("copies"))
        .select(
            "*",
            choose(F.col("doc_id"), weights).alias("shard"),
            choose(F.col("doc_id"), grown).alias("grown_shard"),
            F.substring("mark", 1, PIECE_DIGITS).alias("piece"),
        ),
        "shards",
    )
    before = Window.partitionBy("shard").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        counted.groupBy("shard", "piece")
        .agg(F.sum("copies").alias("n"))
        .select("shard", "piece", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    )
    within = (
        Window.partitionBy("shard", "piece")
        .orderBy("mark", "doc_id", "size", "text_crc32")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = counted.withColumn("skipped", F.coalesce(F.sum("copies").over(within), F.lit(0)))
    placed = placed.join(starts, ["shard", "piece"]).withColumn("first", F.col("start") + F.col("skipped"))
    runs = placed.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(RUN).cast("long"))))
    step = F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.lit(RUN).cast("long"), F.col("copies") - F.col("run")) - 1))
    return runs.withColumn("step", step).select(
        "doc_id",
        "size",
        "text_crc32",
        "shard",
        (F.col("first") + F.col("run") + F.col("step")).alias("slot"),
        "grown_shard",
    )


def query(spark, folder):
    """All documents over 16 equal shards, and over 17."""
    from nightledger.llm.common import table

    rows = numbered(table(spark, folder, "documents"), [1.0] * 16, [1.0] * 17)
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


#: CRC-32 byte by byte from its table, built from the polynomial; draws and slots as above.
SQL = """
WITH RECURSIVE t(i, k, c) AS (
  SELECT i, 0, i::UBIGINT FROM range(256) r(i)
  UNION ALL
  SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(3988292384::UBIGINT, c >> 1) ELSE c >> 1 END FROM t WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS tab FROM t WHERE k = 8),
d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(doc_id::VARCHAR, '') AS k FROM documents),
s AS (
  SELECT doc_id, k, md5(k) AS mark, (octet_length(encode(text)) + 1)::BIGINT AS size,
    xor(4294967295::UBIGINT, list_reduce(
      list_prepend(4294967295::UBIGINT, list_transform(regexp_extract_all(hex(encode(text)), '..'),
        lambda x: ('0x' || x)::UBIGINT)),
      lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255)::INT + 1])))::BIGINT AS text_crc32
  FROM d, crc),
w AS (
  SELECT k, i, -1.0::DOUBLE / ln((('0x' || substr(md5(k || ':' || i::VARCHAR), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496) AS draw
  FROM (SELECT DISTINCT k FROM d), range(17) r(i)),
p AS (
  SELECT k, (arg_max(i, (draw, -i)) FILTER (i < 16))::INT AS shard, arg_max(i, (draw, -i))::INT AS grown_shard
  FROM w GROUP BY k)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY mark, doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, grown_shard
FROM s JOIN p USING (k)
"""
