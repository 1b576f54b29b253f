"""Connected components of an edge table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightledger.llm.common import store


def components(edges: DataFrame) -> DataFrame:
    """``id`` and ``root`` of every node of ``edges`` (a, b: long); equal roots, same component.

    Each round every node moves to the neighbour (or itself) of smallest random rank, and edges
    are rewritten between the nodes moved to; those that fall together vanish.  Ranks are drawn
    anew each round, so chains shrink by a constant factor and hubs vanish at once.  Every round
    is written; nothing is gathered.
    """
    left = store(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    roots = None
    turn = 0
    while not left.isEmpty():
        turn += 1
        both = left.union(left.select("b", "a"))
        rank = F.xxhash64(F.lit(turn), "b")
        near = both.groupBy("a").agg(F.min(rank).alias("r"), F.min_by("b", rank).alias("v"))
        moves = store(
            near.select("a", F.when(F.col("r") < F.xxhash64(F.lit(turn), "a"), F.col("v")).otherwise(F.col("a")).alias("to")), "moves"
        )
        one = left.join(moves, "a").select(F.col("to").alias("x"), "b")
        two = one.join(moves.withColumnRenamed("a", "b"), "b").select("x", F.col("to").alias("y")).where("x <> y")
        left = store(two.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        if roots is None:
            roots = moves.select(F.col("a").alias("id"), F.col("to").alias("root"))
        else:
            step = moves.select(F.col("a").alias("root"), "to")
            roots = roots.join(step, "root", "left").select("id", F.coalesce("to", "root").alias("root"))
    if roots is None:
        return left.select(F.col("a").alias("id"), F.col("b").alias("root"))
    return store(roots, "roots")
