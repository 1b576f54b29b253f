"""Hard negatives by Kronecker-packed products.

Scores are inner products of whole vectors.  Candidates' components are biased to be non-negative
and laid side by side as fields of one wide whole number per dimension, each field wide enough for
a whole inner product.  Multiplying that number by an anchor's (biased) component and adding up over
dimensions leaves every candidate's sum in its own field, from where it is unpacked and the bias
taken off.  Scores are exact.  Where two fields or more fit, the wide number is a double of 53 bits,
so that one matrix product multiplies all of a block; otherwise it is an integer of any width, and so
are scores beyond a long (which saturate at the end).

Anchors and candidates lie in blocks of bounded size.  Tiles of blocks meet in co-grouped tasks, first
for each anchor's positives, then for the negatives in each positive's window.  A task keeps the best
of each (anchor, positive) as it goes, so what leaves it is bounded by the number wanted, and labels
play no part in who meets whom: one label may hold most rows.

Edge cases: rows whose id, label or vector is null or whose vector holds null or non-finite components
take no part; an id that repeats counts once, with its smallest (label, vector); missing trailing
components count as 0; equal scores go to the smaller id; an anchor without another row of its label
has no rows, nor has a positive without a negative in its window; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nightledger.llm.common import prepare, store, table
from nightledger.llm.whitening import matrix

SCALE, POSITIVES, NEGATIVES = 256, 5, 10
#: A negative scores between these percentages of the positive.
LOW, HIGH = 30, 90
BLOCK, AT_ONCE = 2_048, 256
#: Rows of a tile of candidates and of a tile of anchors.
TILE, ANCHORS = 65_536, 16_384
#: Whole numbers up to this are exact doubles.
EXACT = 53
LONGEST = (1 << 63) - 1
PAIRS = "anchor_id long, vec_id long, score long"
FOUND = "anchor_id long, positive_id long, positive_score long, vec_id long, score long"


class Packed:
    """Candidates' whole vectors ``x`` (rows) in fields of wide numbers, for anchors whose
    components lie within ``low`` and ``high``."""

    def __init__(self, x: np.ndarray, low: int, high: int):
        self.rows, self.width = x.shape
        self.bias, self.anchor_bias = -min(0, int(x.min(initial=0))), -min(0, low)
        most = (int(x.max(initial=0)) + self.bias) * (high + self.anchor_bias) * max(1, self.width)
        self.bits = max(1, most.bit_length())
        self.fields = EXACT // self.bits
        # A field holds (x + p)(a + q) = xa + q x + p a + pq, summed over dimensions.
        self.sums = [int(s) for s in x.sum(1, dtype=object)] if self.fields < 2 else x.sum(1)
        if self.fields >= 2:
            biased = np.zeros((-(-self.rows // self.fields) * self.fields, self.width))
            biased[: self.rows] = x + self.bias
            self.shifts = 2.0 ** (self.bits * np.arange(self.fields))
            self.wide = np.tensordot(self.shifts, biased.reshape(-1, self.fields, self.width), (0, 1))
        else:
            size = -(-self.bits // 8)
            self.bits = 8 * size
            self.wide = [int.from_bytes(b"".join((int(c) + self.bias).to_bytes(size, "little") for c in column), "little") for column in x.T]

    def scores(self, anchors: np.ndarray) -> np.ndarray:
        """Inner products, anchors by candidates; saturated where beyond a long."""
        p, q = self.bias, self.anchor_bias
        if self.fields >= 2:
            products = (anchors + q).astype(float) @ self.wide.T
            out = np.empty((len(anchors), len(self.wide), self.fields), np.int64)
            for f in range(self.fields - 1, -1, -1):
                field = np.floor(products / self.shifts[f])
                products -= field * self.shifts[f]
                out[:, :, f] = field
            out = out.reshape(len(anchors), -1)[:, : self.rows]
            out -= (p * anchors.sum(1) + p * q * self.width)[:, None]
            out -= (q * self.sums)[None, :]
            return out
        out = np.zeros((len(anchors), self.rows), np.int64)
        size = self.bits // 8
        for i, anchor in enumerate(anchors):
            own = [int(a) for a in anchor]
            total = sum(wide * (a + q) for wide, a in zip(self.wide, own))
            fields = total.to_bytes(size * self.rows, "little")
            less = p * sum(own) + p * q * self.width
            for k in range(self.rows):
                score = int.from_bytes(fields[k * size : (k + 1) * size], "little") - less - q * self.sums[k]
                out[i, k] = max(-LONGEST - 1, min(LONGEST, score))
        return out


class Best:
    """The ``k`` highest scores of each of ``groups`` groups, ties to the smaller id."""

    def __init__(self, groups: int, k: int):
        self.k = k
        self.group, self.id, self.score = (np.empty(0, np.int64) for _ in range(3))
        #: A score below this is of no use to the group.
        self.least = np.full(groups, -LONGEST - 1, np.int64)

    def add(self, group: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        if not len(group):
            return
        group = np.concatenate([self.group, group])
        ids, scores = np.concatenate([self.id, ids]), np.concatenate([self.score, scores])
        # ~score orders downwards and, unlike -score, has no overflow.
        order = np.lexsort((ids, ~scores, group))
        group = group[order]
        start = np.searchsorted(group, group, side="left")
        place = np.arange(len(group)) - start
        kept = place < self.k
        order, last = order[kept], order[place == self.k - 1]
        self.group, self.id, self.score = group[kept], ids[order], scores[order]
        self.least[group[place == self.k - 1]] = scores[last]


def whole(vectors: DataFrame, label: Column, scale: int) -> DataFrame:
    """vec_id, label and whole components ``x`` of the rows that take part, one row per id."""
    odd = F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    x = F.transform("embedding", lambda c: F.floor(c.cast("double") * scale))
    rows = vectors.where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL").where(~odd)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.struct(label.cast("long").alias("label"), x.alias("x")).alias("row"))
    return rows.groupBy("vec_id").agg(F.min("row").alias("row")).select("vec_id", "row.label", "row.x")


def _blocks(width: int, kind: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, len(batch), BLOCK):
                rows = batch.iloc[at : at + BLOCK]
                ids, labels = rows["vec_id"].to_numpy("<i8"), rows["label"].to_numpy("<i8")
                x = matrix(rows["x"], width, kind)
                yield pd.DataFrame({"block": [(part << 32) + number], "rows": [len(x)], "ids": [ids.tobytes()], "labels": [labels.tobytes()], "x": [x.tobytes()]})
                number += 1

    return run


def _unpacked(row, width: int, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = np.frombuffer(row.x, kind).reshape(-1, width)
    return np.frombuffer(row.ids, "<i8"), np.frombuffer(row.labels, "<i8"), x.astype(np.int64)


def _runs(anchors: pd.DataFrame, candidates: pd.DataFrame, width: int, kind: str):
    """Scores of each block of candidates with each run of anchors, and what they are of."""
    if not len(anchors) or not len(candidates):
        return
    mine = [_unpacked(r, width, kind) for r in anchors.itertuples()]
    ids, labels, x = (np.concatenate(part) for part in zip(*mine))
    low, high = int(x.min(initial=0)), int(x.max(initial=0))
    for row in candidates.itertuples():
        their_ids, their_labels, theirs = _unpacked(row, width, kind)
        packed = Packed(theirs, low, high)
        for at in range(0, len(ids), AT_ONCE):
            part = slice(at, at + AT_ONCE)
            yield part, ids[part], labels[part], their_ids, their_labels, packed.scores(x[part])


def _sized(anchors: pd.DataFrame) -> int:
    return int(anchors["rows"].sum()) if len(anchors) else 0


def _joined(anchors: pd.DataFrame, column: str) -> np.ndarray:
    return np.frombuffer(b"".join(anchors[column]), "<i8")


def _positives(width: int, kind: str, k: int):
    def run(key: tuple, anchors: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        best = Best(_sized(anchors), k)
        for part, ids, labels, their_ids, their_labels, scores in _runs(anchors, candidates, width, kind):
            good = (labels[:, None] == their_labels) & (ids[:, None] != their_ids) & (scores >= best.least[part, None])
            i, j = np.nonzero(good)
            best.add(part.start + i, their_ids[j], scores[i, j])
        return pd.DataFrame({"anchor_id": _joined(anchors, "ids")[best.group], "vec_id": best.id, "score": best.score})

    return run


def _window(positive: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest score s with low * positive <= 100 * s <= high * positive."""
    least = [min(LONGEST, -(-low * int(p) // 100)) for p in positive]
    most = [max(-LONGEST - 1, high * int(p) // 100) for p in positive]
    return np.array(least, np.int64), np.array(most, np.int64)


def _negatives(width: int, kind: str, wanted: int, k: int, low: int, high: int):
    def run(key: tuple, anchors: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        own = _joined(anchors, "ids")
        n = len(own)
        # Positives of an anchor by place; a missing one has an empty window.
        positives, values = (_joined(anchors, c).reshape(n, wanted) for c in ("positive_ids", "positive_scores"))
        counts = _joined(anchors, "positive_counts")
        least, most = _window(values.ravel(), low, high)
        missing = np.arange(wanted)[None, :] >= counts[:, None]
        least[missing.ravel()], most[missing.ravel()] = LONGEST, -LONGEST - 1
        best = Best(n * wanted, k)
        best.least = least.copy()
        most = most.reshape(n, wanted)
        for part, _, labels, their_ids, their_labels, scores in _runs(anchors, candidates, width, kind):
            other = labels[:, None] != their_labels
            for p in range(wanted):
                floor = best.least.reshape(n, wanted)[part, p]
                i, j = np.nonzero(other & (scores >= floor[:, None]) & (scores <= most[part, p][:, None]))
                best.add((part.start + i) * wanted + p, their_ids[j], scores[i, j])
        anchor, place = np.divmod(best.group, wanted)
        return pd.DataFrame(
            {"anchor_id": own[anchor], "positive_id": positives[anchor, place], "positive_score": values[anchor, place], "vec_id": best.id, "score": best.score}
        )

    return run


def _with_positives(width: int, kind: str, k: int):
    """Blocks of anchors, each anchor with its positives, in fixed places."""

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("vec_id")
        n = len(group)
        ids, scores, counts = np.zeros((n, k), "<i8"), np.zeros((n, k), "<i8"), np.zeros(n, "<i8")
        for i, (a, b) in enumerate(zip(group["positive_ids"], group["positive_scores"])):
            counts[i] = len(a)
            ids[i, : len(a)], scores[i, : len(b)] = a, b
        return pd.DataFrame(
            {
                "block": [int(key[0])], "rows": [n], "ids": [group["vec_id"].to_numpy("<i8").tobytes()], "labels": [group["label"].to_numpy("<i8").tobytes()],
                "x": [matrix(group["x"], width, kind).tobytes()], "positive_ids": [ids.tobytes()], "positive_scores": [scores.tobytes()], "positive_counts": [counts.tobytes()],
            }
        )

    return run


BLOCKS = "block long, rows int, ids binary, labels binary, x binary"
ANCHOR_BLOCKS = BLOCKS + ", positive_ids binary, positive_scores binary, positive_counts binary"


def _tiled(blocks: DataFrame, tiles: int, others: int, own: str, other: str) -> DataFrame:
    """Each block once for every tile of the other side.

    Both numbers are of one type: co-grouped keys of different types hash differently, and so may
    never meet.
    """
    tile = F.pmod(F.xxhash64("block"), F.lit(tiles)).cast("int").alias(own)
    return blocks.select("*", tile, F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias(other))


def mine(
    vectors: DataFrame,
    anchors: str,
    label: Column | None = None,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
    scale: int = SCALE,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id and both scores; ``anchors`` is a condition on
    ``vec_id`` and ``label`` an expression that replaces the label."""
    spark = vectors.sparkSession
    prepare(spark)
    rows = store(whole(vectors, F.col("label") if label is None else label, scale), "whole")
    ends = rows.agg(
        F.max(F.size("x")).alias("width"), F.min(F.array_min("x")).alias("low"), F.max(F.array_max("x")).alias("high"),
        F.count("*").alias("n"), F.count(F.when(F.expr(anchors), 1)).alias("asked"),
    ).first()
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not ends.asked:
        return spark.createDataFrame([], schema)
    largest = max(-(ends.low or 0), ends.high or 0)
    kind, width = "<i2" if largest < 1 << 15 else "<i4" if largest < 1 << 31 else "<i8", max(1, ends.width)
    # Enough tiles for all cores, none too large for a task.
    tile = max(BLOCK, min(TILE, ends.n // (3 * spark.sparkContext.defaultParallelism)))
    tiles, anchor_tiles = -(-ends.n // tile), -(-ends.asked // ANCHORS)
    packing = _blocks(width, kind)
    candidates = store(rows.mapInPandas(packing, BLOCKS), "candidates")
    asking = store(rows.where(anchors).coalesce(max(1, ends.asked // BLOCK)).mapInPandas(packing, BLOCKS), "anchors")

    right = _tiled(candidates, tiles, anchor_tiles, "tile", "anchor_tile").groupBy("tile", "anchor_tile")
    left = _tiled(asking, anchor_tiles, tiles, "anchor_tile", "tile").groupBy("tile", "anchor_tile")
    found = left.cogroup(right).applyInPandas(_positives(width, kind, positives), PAIRS)
    place = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id"))
    found = found.withColumn("place", place).where(F.col("place") <= positives)
    # Fewer positives than wanted rows at most, so the lists are short.
    lists = found.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("place", "vec_id", "score"))).alias("best"))
    asked = rows.where(anchors).join(lists, rows["vec_id"] == lists["anchor_id"])
    blocks = -(-ends.asked // BLOCK)
    asked = asked.select(
        F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("block"), "vec_id", "label", "x",
        F.col("best.vec_id").alias("positive_ids"), F.col("best.score").alias("positive_scores"),
    )
    asked = store(asked.groupBy("block").applyInPandas(_with_positives(width, kind, positives), ANCHOR_BLOCKS), "asked")

    left = _tiled(asked, anchor_tiles, tiles, "anchor_tile", "tile").groupBy("tile", "anchor_tile")
    mined = left.cogroup(right).applyInPandas(_negatives(width, kind, positives, negatives, low, high), FOUND)
    rank = F.row_number().over(Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("score"), "vec_id"))
    return mined.withColumn("rank", rank).where(F.col("rank") <= negatives).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"),
    )


def query(spark, folder):
    """Hard negatives of every hundredth vector; labels of every seventh are moved on first."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(table(spark, folder, "embeddings"), "vec_id % 100 = 0", moved)


SQL = """
WITH v AS (
  SELECT vec_id, label, x FROM (
    SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY label, x) AS copy FROM (
      SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda c: floor(c::DOUBLE * 256)::BIGINT) AS x
      FROM embeddings
      WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0))
  WHERE copy = 1),
s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id AS vec_id, a.label = c.label AS alike,
    list_inner_product(a.x::DOUBLE[], c.x::DOUBLE[])::BIGINT AS score
  FROM v a JOIN v c ON a.vec_id % 100 = 0 AND c.vec_id <> a.vec_id),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id,
  (row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id))::INT AS rank,
  s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.alike
WHERE 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
QUALIFY rank <= 10
"""
