"""Deterministic snapshot horizon per (hotel, room, night)."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nightledger.config import FEATURE_CONFIG, FeatureConfig

_SPAN = 2**32


def thresholds(config: FeatureConfig = FEATURE_CONFIG) -> list[tuple[int, int]]:
    """``(upper draw, horizon)`` pairs for a 32-bit draw."""
    total = sum(config.horizon_weights)
    edges = [round(part / total * _SPAN) for part in accumulate(config.horizon_weights)]
    return list(zip(edges, config.horizons))


def _draw(config: FeatureConfig) -> str:
    key = f"concat_ws('|', '{config.horizon_seed}', hotel_id, room_type, cast(stay_date AS STRING))"
    return f"cast(conv(substring(md5({key}), 1, 8), 16, 10) AS BIGINT)"


def _choice(config: FeatureConfig, draw: str) -> str:
    *steps, (_, furthest) = thresholds(config)
    cases = " ".join(f"WHEN {draw} < {edge} THEN {horizon}" for edge, horizon in steps)
    return f"CASE {cases} ELSE {furthest} END" if steps else str(furthest)


def horizon(config: FeatureConfig = FEATURE_CONFIG) -> Column:
    """The horizon of a row's night for use in a filter.

    The draw is bound to a lambda variable: a filter on a column of :func:`with_horizon` would
    restate that column, hash and all, in every branch of the choice.
    """
    return F.expr(f"element_at(transform(array({_draw(config)}), d -> {_choice(config, 'd')}), 1)")


def with_horizon(
    rows: DataFrame, config: FeatureConfig = FEATURE_CONFIG, name: str = "days_to_checkin"
) -> DataFrame:
    """Add the horizon of each row's night: a weighted choice by a hash of the grain key.

    A function of the key alone, so it can be evaluated on raw fact rows: no join with
    the grain is needed to know at which lead a row's snapshot was taken.  The draw is a
    column of its own so that the hash is computed once per row.
    """
    return (
        rows.withColumn("_draw", F.expr(_draw(config)))
        .withColumn(name, F.expr(_choice(config, "_draw")))
        .drop("_draw")
    )
