"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are ordered by length and cut into buckets of bounded size.  The longest bucket gives
every query a first threshold, its k-th best score there.  In any other bucket a query needs a
cosine of at least ``threshold / (query length * longest vector of the bucket)``:

* above 1 the bucket is passed over;
* from ``COORDINATE`` on, the query's largest coordinates confine those of any vector that could
  pass, and only vectors inside all the ranges are verified;
* below, only the prefix of the bucket that is long enough is verified.

Verified products are exact integers.  Bucket and query blocks meet in co-grouped tasks of bounded
size; pairs of blocks that no query can use are dropped before the shuffle; what leaves a task is
at most k rows per query.

Edge cases: vectors that are null or hold null or non-finite components take no part, nor do rows
without id; an id that repeats counts once, with its smallest vector; missing trailing components
count as 0; equal scores go to the smaller id; fewer than k candidates give fewer rows; scores
beyond a long saturate; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nightledger.llm.common import prepare, store, table

BUCKET, QUERIES = 4_096, 1_024
SCALE = 1024
#: Local cosine threshold from which coordinates prune better than length.
COORDINATE = 0.7
COORDINATES = 3
#: Below this bound on every partial sum, products of doubles are exact integers.
EXACT = 2.0**52
SCORES = "query_id long, vec_id long, score long"


def prepared(vectors: DataFrame, scale: int) -> DataFrame:
    """vec_id, whole components and length of the vectors that take part, one row per id."""
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("double"))
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.where("vec_id IS NOT NULL AND embedding IS NOT NULL").where(~odd)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v")).groupBy("vec_id").agg(F.min("v").alias("v"))
    return rows.withColumn("length", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(column), width))
    for i, v in enumerate(column):
        out[i, : len(v)] = v
    return out


def _products(q: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Exact inner products as longs."""
    bound = np.abs(q).sum() * (np.abs(m).max() if m.size else 0.0)
    if bound < EXACT:
        return (m @ q).astype(np.int64)
    own = [int(x) for x in q]
    exact = [sum(a * int(x) for a, x in zip(own, row)) for row in m]
    return np.array([max(-(1 << 63), min((1 << 63) - 1, s)) for s in exact], np.int64)


def best_in_bucket(q, qid, qlen, least, m, mid, mlen, k: int):
    """Ids and scores of the up to ``k`` best vectors of one bucket for one query.

    ``m`` is ordered by descending length ``mlen``; ``least``: the score to reach, or None.
    """
    rows = np.arange(len(m))
    if least is not None and least > 0 and qlen > 0:
        local = least / (qlen * mlen[0]) if mlen[0] > 0 else np.inf
        if local > 1 + 1e-9:
            return mid[:0], np.empty(0, np.int64)
        # A vector shorter than this cannot reach the score.
        rows = rows[: np.searchsorted(-mlen, -(least / qlen) * (1 - 1e-9), side="right")]
        if local >= COORDINATE and len(rows):
            # Within the angle phi of the query, a vector's angle to axis f is within phi of the query's.
            unit, at = q / qlen, m[rows] / mlen[rows, None]
            phi = np.arccos(np.clip(least / (qlen * mlen[rows]), -1, 1))
            inside = np.ones(len(rows), bool)
            for f in np.argsort(-np.abs(unit), kind="stable")[:COORDINATES]:
                alpha = np.arccos(np.clip(unit[f], -1, 1))
                inside &= at[:, f] >= np.cos(np.minimum(np.pi, alpha + phi)) - 1e-7
                inside &= at[:, f] <= np.cos(np.maximum(0, alpha - phi)) + 1e-7
            rows = rows[inside]
    score = _products(q, m[rows])
    keep = mid[rows] != qid
    if least is not None:
        keep &= score >= least
    rows, score = rows[keep], score[keep]
    if len(rows) > k:
        order = np.lexsort((mid[rows], -score))[:k]
        rows, score = rows[order], score[order]
    return mid[rows], score


def _task(k: int):
    def run(key: tuple, queries: pd.DataFrame, bucket: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(bucket):
            bucket = bucket.sort_values(["length", "vec_id"], ascending=[False, True])
            width = max(max(map(len, queries["v"])), max(map(len, bucket["v"])))
            m, mid, mlen = _matrix(bucket["v"], width), bucket["vec_id"].to_numpy(), bucket["length"].to_numpy()
            q = _matrix(queries["v"], width)
            for i, (qid, qlen, least) in enumerate(zip(queries["vec_id"], queries["length"], queries["least"])):
                ids, scores = best_in_bucket(q[i], qid, qlen, None if pd.isna(least) else int(least), m, mid, mlen, k)
                out.append(pd.DataFrame({"query_id": qid, "vec_id": ids, "score": scores}))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({c: np.empty(0, np.int64) for c in ("query_id", "vec_id", "score")})

    return run


def top_k(vectors: DataFrame, queries: str, k: int = 10, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` best other vectors of each query; ``queries``
    is a condition on ``vec_id``."""
    spark = vectors.sparkSession
    prepare(spark)
    rows = store(prepared(vectors, scale), "vectors")
    n, asked = rows.count(), rows.where(queries).count()
    buckets, blocks = max(1, -(-n // BUCKET)), max(1, -(-asked // QUERIES))
    # Length buckets are ranges of (length, id), so equal lengths are split by id.
    ranged = rows.repartitionByRange(buckets, F.desc("length"), "vec_id").withColumn("bucket", F.spark_partition_id())
    ranged = ranged.withColumn("piece", F.floor(F.row_number().over(Window.partitionBy("bucket").orderBy(F.desc("length"), "vec_id")) / BUCKET))
    ranged = store(ranged.withColumn("bucket", F.col("bucket").cast("long") * (1 << 20) + F.col("piece")).drop("piece"), "buckets")
    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    asking = rows.where(queries).withColumn("block", block)

    ends = ranged.groupBy("bucket").agg(F.max("length").alias("longest"))
    top = ends.agg(F.min("bucket")).first()[0] or 0
    first = ranged.where(F.col("bucket") == top)
    each = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    start = asking.withColumn("least", F.lit(None).cast("long")).groupBy("block")
    seeded = store(start.cogroup(first.select("*", each).groupBy("block")).applyInPandas(_task(k), SCORES), "seeded")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    least = seeded.withColumn("rank", place).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("least"))
    asking = store(asking.join(least, "vec_id", "left"), "asking")

    # Pairs of blocks in which some query could still find something.
    need = asking.groupBy("block").agg(
        F.min(F.when(F.col("length") > 0, F.col("least") / F.col("length"))).alias("reach"),
        F.max((F.col("least").isNull() | (F.col("least") <= 0) | (F.col("length") == 0)).cast("int")).alias("open"),
    )
    pairs = ends.where(F.col("bucket") != top).select("*", each).join(need, "block")
    pairs = store(pairs.where((F.col("open") == 1) | (F.col("longest") * (1 + 1e-9) >= F.col("reach"))).select("block", "bucket"), "pairs")
    left = asking.join(pairs, "block").select("block", "bucket", "vec_id", "v", "length", "least").groupBy("block", "bucket")
    right = ranged.join(pairs, "bucket").select(F.col("block").alias("to_block"), F.col("bucket").alias("of_bucket"), "vec_id", "v", "length")
    rest = left.cogroup(right.groupBy("to_block", "of_bucket")).applyInPandas(_task(k), SCORES)
    ranked = seeded.unionByName(rest).withColumn("rank", place).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def query(spark, folder):
    """The ten best neighbours of every hundredth vector among all vectors."""
    return top_k(table(spark, folder, "embeddings"), "vec_id % 100 = 0")


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)::BIGINT) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
