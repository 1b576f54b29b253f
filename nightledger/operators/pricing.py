"""Adjustments and guardrails as column expressions over a grid of room nights.

A grid row carries ``base_price``, ``current_price``, ``occupancy_rate``,
``days_to_checkin``, ``competitor_rate`` with its band, ``season``, ``is_weekend``,
``is_holiday``, ``event_score``, ``floor_price``, ``ceiling_price``, ``blended_demand``
and ``confidence``.  Every step is a projection, so pricing an estate is one narrow
stage that stays in generated code: nothing shuffles and nothing leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightledger.config import PRICING_CONFIG, PricingConfig

ADJUSTMENTS = ("demand", "occupancy", "competitor", "season", "event")


def finite_or(value: str, fallback: str) -> str:
    """The value where it is a real number, else the fallback.

    NaN has to be ruled out before anything is compared: Spark orders it above all
    numbers.
    """
    return (
        f"CASE WHEN {value} IS NULL OR isnan({value}) OR abs({value}) = double('Infinity')"
        f" THEN {fallback} ELSE {value} END"
    )


def clamp(value: str, limit: float) -> str:
    return f"greatest(-{limit}D, least({limit}D, {value}))"


# --- the five adjustments -----------------------------------------------------------------


def demand_adjustment(grid: DataFrame, config: PricingConfig = PRICING_CONFIG) -> DataFrame:
    """Forecast demand relative to a normal night, damped and limited."""
    base = config.baseline_demand
    return grid.withColumn(
        "_demand", F.expr(f"cast({finite_or('blended_demand', f'{base}D')} AS DOUBLE)")
    ).selectExpr(
        "*",
        f"(_demand / {base}D - 1D) * {config.demand_sensitivity}D AS demand_raw",
        f"CASE WHEN _demand > {base}D * 1.05D THEN 'above' WHEN _demand < {base}D * 0.95D"
        " THEN 'below' ELSE 'normal' END AS demand_band",
    ).withColumn("demand_adjustment", F.expr(clamp("demand_raw", config.demand_limit)))


def occupancy_adjustment(grid: DataFrame, config: PricingConfig = PRICING_CONFIG) -> DataFrame:
    """Rooms sold weighed against the time left to sell the rest.

    Selling out early earns the full rise and selling out late a third of it; an empty
    house is discounted only as the night draws near.
    """
    low, high, limit = config.low_occupancy, config.high_occupancy, config.occupancy_limit
    days = config.long_lead_days
    return (
        grid.withColumns(
            {
                "_occupancy": F.expr(f"cast({finite_or('occupancy_rate', '0D')} AS DOUBLE)"),
                "_lead": F.expr("cast(coalesce(days_to_checkin, 0) AS INT)"),
            }
        )
        .withColumn("_time_left", F.expr(f"least(greatest(_lead, 0), {days}) / {days}D"))
        .withColumn(
            "occupancy_raw",
            F.expr(
                f"CASE WHEN _occupancy >= {high}D THEN {limit}D * ((_occupancy - {high}D)"
                f" / {1.0 - high}D) * (0.35D + 0.65D * _time_left)"
                f" WHEN _occupancy <= {low}D THEN -{limit}D * (({low}D - _occupancy) / {low}D)"
                " * (1D - _time_left) ELSE 0D END"
            ),
        )
        .withColumns(
            {
                "occupancy_adjustment": F.expr(clamp("occupancy_raw", limit)),
                "occupancy_band": F.expr(
                    f"CASE WHEN _occupancy >= {high}D THEN"
                    f"   CASE WHEN _lead >= {days} THEN 'selling early' ELSE 'nearly full' END"
                    f" WHEN _occupancy <= {low}D THEN"
                    f"   CASE WHEN _lead <= {config.short_lead_days} THEN 'distressed'"
                    "    ELSE 'behind with time left' END"
                    " ELSE 'on pace' END"
                ),
            }
        )
    )


def competitor_adjustment(grid: DataFrame, config: PricingConfig = PRICING_CONFIG) -> DataFrame:
    """Half the gap to the market, limited; an unseen or unusable market moves nothing."""
    return (
        grid.withColumn(
            "_rate",
            F.expr(
                "CASE WHEN competitor_rate IS NULL THEN NULL ELSE "
                f"cast({finite_or('competitor_rate', 'base_price')} AS DOUBLE) END"
            ),
        )
        .withColumn(
            "_gap",
            F.expr(
                "CASE WHEN _rate > 0 AND base_price > 0 THEN (_rate - base_price) / base_price END"
            ),
        )
        .withColumn(
            "competitor_raw", F.expr(f"coalesce(_gap * {config.competitor_sensitivity}D, 0D)")
        )
        .withColumns(
            {
                "competitor_adjustment": F.expr(clamp("competitor_raw", config.competitor_limit)),
                "competitor_band": F.expr(
                    "CASE WHEN _rate IS NULL THEN 'unseen' WHEN _gap IS NULL THEN 'unusable'"
                    " WHEN _gap > 0.02D THEN 'headroom' WHEN _gap < -0.02D THEN 'exposed'"
                    " ELSE 'level' END"
                ),
            }
        )
    )


def season_adjustment(grid: DataFrame, config: PricingConfig = PRICING_CONFIG) -> DataFrame:
    """A small correction for the time of year."""
    arms = " ".join(f"WHEN '{name}' THEN {factor}D" for name, factor in config.season_factors)
    return grid.withColumn("season_raw", F.expr(f"CASE season {arms} ELSE 0D END")).withColumn(
        "season_adjustment", F.expr(clamp("season_raw", config.season_limit))
    )


def event_adjustment(grid: DataFrame, config: PricingConfig = PRICING_CONFIG) -> DataFrame:
    """City events, holidays and the weekend, combined with diminishing returns."""
    return (
        grid.withColumn(
            "_score",
            F.expr(
                f"greatest(0D, least(1D, cast({finite_or('event_score', '0D')} AS DOUBLE)))"
            ),
        )
        .withColumn(
            "event_raw",
            F.expr(
                f"{config.event_limit}D * (1D - CASE WHEN _score > {config.event_threshold}D"
                f" THEN 1D - _score * {config.event_weight}D ELSE 1D END"
                f" * CASE WHEN is_holiday THEN 1D - {config.holiday_effect}D ELSE 1D END"
                f" * CASE WHEN is_weekend THEN 1D - {config.weekend_effect}D ELSE 1D END)"
            ),
        )
        .withColumn("event_adjustment", F.expr(clamp("event_raw", config.event_limit)))
    )


def raw_price(grid: DataFrame, config: PricingConfig = PRICING_CONFIG) -> DataFrame:
    """Sum of the five adjustments, scaled by confidence, applied to the base price."""
    for step in (
        demand_adjustment,
        occupancy_adjustment,
        competitor_adjustment,
        season_adjustment,
        event_adjustment,
    ):
        grid = step(grid, config)
    total = " + ".join(f"{name}_adjustment" for name in ADJUSTMENTS)
    return (
        grid.withColumns(
            {
                "unscaled_total": F.expr(total),
                "confidence_scale": F.expr(
                    "greatest(0.5D, least(1D, 0.5D + 0.5D * confidence))"
                ),
                "pricing_error": F.expr(
                    "CASE WHEN base_price > 0 THEN NULL ELSE 'base price is not positive' END"
                ),
            }
        )
        .withColumn("total_adjustment", F.expr("unscaled_total * confidence_scale"))
        .withColumn(
            "raw_price",
            F.expr("CASE WHEN base_price > 0 THEN base_price * (1D + total_adjustment) END"),
        )
    )


# --- guardrails -----------------------------------------------------------------------------


_HIT = "array<struct<rule:string,before:double,after:double,delta:double,reason:string>>"

#: Why each rule moves a price, as the log says it.
REASONS = {
    "SANITY_CHECK": "no usable price, or far above the base rate",
    "LOW_OCCUPANCY_RISE_BLOCK": "no rise while few rooms are sold",
    "MAX_DAILY_RISE": "rise larger than a day may bring",
    "MAX_DAILY_FALL": "fall larger than a day may bring",
    "COMPETITOR_UPPER_BAND": "too far above the dearest competitor",
    "COMPETITOR_LOWER_BAND": "too far below the cheapest competitor",
    "ROOM_CEILING": "above the ceiling of the room",
    "ROOM_FLOOR": "below the floor of the room",
    "MAX_PRICE_CEILING": "above the highest price of the estate",
    "MIN_PRICE_FLOOR": "below the lowest price of the estate",
}


def guardrail_bounds(config: PricingConfig = PRICING_CONFIG) -> str:
    """The rules in the order they apply, as an array of bounds.

    No bound depends on the price, only on the situation, so the rules are data: each
    sets an upper or a lower bound, null where it is switched off.  Null and zero limits
    switch a rule off; the low-occupancy block alone treats a zero current price as a
    price.  The first rule also repairs a price that is not a positive number.
    """
    cap = config.daily_change_cap
    exceptional = (
        f"coalesce(NOT isnan(blended_demand) AND blended_demand >= {config.exceptional_demand}D,"
        " false)"
    )
    rules = [
        ("SANITY_CHECK", "upper", f"base_price * {config.sanity_multiple}D"),
        (
            "LOW_OCCUPANCY_RISE_BLOCK",
            "upper",
            f"CASE WHEN occupancy_rate < {config.low_occupancy_block}D THEN current_price END",
        ),
        (
            "MAX_DAILY_RISE",
            "upper",
            f"CASE WHEN current_price > 0 THEN current_price * {1.0 + cap}D END",
        ),
        (
            "MAX_DAILY_FALL",
            "lower",
            f"CASE WHEN current_price > 0 THEN current_price * {1.0 - cap}D END",
        ),
        (
            "COMPETITOR_UPPER_BAND",
            "upper",
            f"CASE WHEN NOT {exceptional} THEN nullif(competitor_max_rate, 0D)"
            f" * {1.0 + config.competitor_upper}D END",
        ),
        (
            "COMPETITOR_LOWER_BAND",
            "lower",
            f"nullif(competitor_min_rate, 0D) * {1.0 - config.competitor_lower}D",
        ),
        ("ROOM_CEILING", "upper", "nullif(ceiling_price, 0D)"),
        ("ROOM_FLOOR", "lower", "nullif(floor_price, 0D)"),
        ("MAX_PRICE_CEILING", "upper", f"{config.max_price}D"),
        ("MIN_PRICE_FLOOR", "lower", f"{config.min_price}D"),
    ]
    entries = [
        f"named_struct('rule', '{name}', 'upper', {bound if side == 'upper' else 'NULL'},"
        f" 'lower', {bound if side == 'lower' else 'NULL'},"
        f" 'repair', {'base_price' if name == 'SANITY_CHECK' else 'NULL'},"
        f" 'reason', '{REASONS[name]}')"
        for name, side, bound in rules
    ]
    kind = "array<struct<rule:string,upper:double,lower:double,repair:double,reason:string>>"
    return f"cast(array({', '.join(entries)}) AS {kind})"


def guarded_price(priced: DataFrame, config: PricingConfig = PRICING_CONFIG) -> DataFrame:
    """Apply the bounds in order, log the ones that moved the price, round half-even.

    A fold over the array of bounds: its size does not grow with the number of rules, so
    a filter on the final price can be pushed through it.  Ten dependent projections
    would multiply into each other there.  A bound within the tolerance of the price
    changes nothing and is not logged.
    """
    broken = "(acc.price IS NULL OR isnan(acc.price) OR abs(acc.price) = double('Infinity') OR acc.price <= 0)"
    target = (
        f"CASE WHEN b.repair IS NOT NULL AND {broken} THEN b.repair"
        " WHEN acc.price > b.upper THEN b.upper WHEN acc.price < b.lower THEN b.lower END"
    )
    moved = (
        f"(b.repair IS NOT NULL AND {broken}) OR abs({target} - acc.price) >"
        f" greatest({config.hit_absolute_tolerance}D, {config.hit_relative_tolerance}D *"
        f" greatest(abs({target}), abs(acc.price)))"
    )
    hit = (
        f"named_struct('rule', b.rule, 'before', acc.price, 'after', {target},"
        f" 'delta', {target} - acc.price, 'reason', b.reason)"
    )
    fold = (
        f"aggregate({guardrail_bounds(config)},"
        f" named_struct('price', raw_price, 'hits', cast(array() AS {_HIT})),"
        f" (acc, b) -> CASE WHEN {moved} THEN"
        f" named_struct('price', {target}, 'hits', array_append(acc.hits, {hit})) ELSE acc END)"
    )
    return (
        priced.withColumn("_folded", F.expr(f"CASE WHEN pricing_error IS NULL THEN {fold} END"))
        .withColumns(
            {
                "guardrails": F.expr("_folded.hits"),
                "final_price": F.expr(f"bround(_folded.price, {config.price_rounding})"),
            }
        )
        .withColumn(
            "price_change_percent",
            F.expr(
                "(final_price - coalesce(nullif(current_price, 0D), base_price))"
                " / coalesce(nullif(current_price, 0D), base_price) * 100D"
            ),
        )
        .drop("_folded")
    )


def price_grid(grid: DataFrame, config: PricingConfig = PRICING_CONFIG) -> DataFrame:
    """Adjustments, raw price, guardrails and the final price for every grid row."""
    priced = guarded_price(raw_price(grid, config), config)
    return priced.drop(
        "_demand", "_occupancy", "_lead", "_time_left", "_rate", "_gap", "_score"
    )


def counted(decisions: DataFrame, name: str = "pricing") -> DataFrame:
    """Count decisions, and those a guardrail changed, while the job runs.

    The metrics arrive with the job's own result.  The node also stops the optimizer
    from pushing a filter on a priced column below the pricing expressions: there it
    would be restated in terms of every intermediate column, which costs far more time
    to plan than the filter saves.  Filter room nights before pricing them.
    """
    return decisions.observe(
        name,
        F.count("*").alias("decisions"),
        F.count_if(F.size("guardrails") > 0).alias("clamped"),
    )


# --- views on decisions -----------------------------------------------------------------------


def waterfall(decisions: DataFrame, key: list[str]) -> DataFrame:
    """Long form of a price: base, five steps in currency, raw total."""
    steps = ", ".join(
        f"struct({i} AS step, '{name}' AS label, base_price * {name}_adjustment AS amount)"
        for i, name in enumerate(ADJUSTMENTS, start=1)
    )
    last = len(ADJUSTMENTS) + 1
    return decisions.select(
        *key,
        F.expr(
            f"explode(array(struct(0 AS step, 'base' AS label, base_price AS amount), {steps},"
            f" struct({last} AS step, 'raw' AS label, raw_price AS amount)))"
        ).alias("s"),
    ).select(*key, "s.step", "s.label", "s.amount")


def occupancy_sweep(
    grid: DataFrame, candidates: tuple[float, ...], config: PricingConfig = PRICING_CONFIG
) -> DataFrame:
    """Every night priced at each candidate occupancy.  The candidates are a short list
    and are exploded in place, so the sweep stays a narrow stage."""
    values = ", ".join(f"{c}D" for c in candidates)
    swept = grid.drop("occupancy_rate").withColumn(
        "occupancy_rate", F.expr(f"explode(array({values}))")
    )
    return price_grid(swept, config)


def explanation(decisions: DataFrame, config: PricingConfig = PRICING_CONFIG) -> DataFrame:
    """A readable account of each decision."""
    money = f"'{config.currency} %,.0f'"
    parts = [
        f"format_string('Base rate: {config.currency} %,.0f', base_price)",
        *[
            f"format_string('{name.title()}: %+.1f%%', {name}_adjustment * 100)"
            for name in ADJUSTMENTS
        ],
        f"concat('Unguarded price: ', format_string({money}, raw_price))",
        "CASE WHEN size(guardrails) = 0 THEN 'Guardrails: none'"
        " ELSE concat('Guardrails: ', array_join(transform(guardrails, g ->"
        " concat(g.rule, format_string(' %,.0f to %,.0f', g.before, g.after))), '; ')) END",
        f"concat('Final price: ', format_string({money}, final_price))",
    ]
    return decisions.withColumn(
        "explanation",
        F.expr(f"CASE WHEN pricing_error IS NULL THEN concat_ws('\\n', {', '.join(parts)}) END"),
    )


def price_events(decisions: DataFrame, model_version: str) -> DataFrame:
    """Key and JSON payload to publish for each decision; the key keeps a hotel in order."""
    payload = (
        "to_json(named_struct('hotel_id', hotel_id, 'room_type', room_type,"
        " 'check_in_date', stay_date, 'prediction_id', prediction_id,"
        " 'base_price', base_price, 'raw_recommended_price', greatest(raw_price, 0.01D),"
        " 'final_recommended_price', final_price,"
        " 'price_change_percent', price_change_percent, 'blended_demand', blended_demand,"
        f" 'confidence', confidence, 'model_version', '{model_version}',"
        " 'guardrails_applied', transform(guardrails, g -> g.rule)))"
    )
    return decisions.where("pricing_error IS NULL").selectExpr(
        "hotel_id AS key", f"{payload} AS payload"
    )
