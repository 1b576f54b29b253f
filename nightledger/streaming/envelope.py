"""Decoding and checking event envelopes as columns.

The same functions run on a stream and on a batch.  An event gets at most one reason:
``poison`` for what cannot be decoded, ``rejected`` for what names unknown hotels or
rooms.  Nothing raises, so one bad message never blocks the rest.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightledger.config import COMPETITORS, EVENT_TYPES, ROOM_TYPES, SEASONS
from nightledger.operators.quality import first_reason

SUPPORTED_VERSION = 1
MAX_DAYS_AHEAD = 730

ENVELOPE_FIELDS = ("event_id", "event_type", "version", "timestamp", "source", "payload")

# Fields of each payload; a star marks a required one.
PAYLOADS = {
    "competitor_price": (
        "*hotel_id", "*competitor", "*room_type", "*check_in_date", "*price", "currency",
        "is_available", "source",
    ),
    "booking": (
        "*hotel_id", "*room_type", "*booking_date", "*check_in_date", "*check_out_date",
        "*booking_count", "cancellation_count", "revenue", "adr", "channel",
    ),
    "demand_signal": (
        "*hotel_id", "*room_type", "*stay_date", "*search_demand", "weather_score",
        "local_event_score", "holiday_flag", "holiday_name", "season",
    ),
    "price_prediction": (
        "*hotel_id", "*room_type", "*check_in_date", "*prediction_id", "*base_price",
        "*raw_recommended_price", "*final_recommended_price", "*price_change_percent",
        "*blended_demand", "*confidence", "*model_version", "guardrails_applied",
    ),
}


def _names(fields) -> list[str]:
    return [f.lstrip("*") for f in fields]


_ALL_FIELDS = list(dict.fromkeys(n for fields in PAYLOADS.values() for n in _names(fields)))


def _quoted(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


#: JSON text to a map of text.  Numbers that ``json_object_keys`` does not know are not read here
#: either, so text that gives a map is an object to both.
_MAP = "from_json({0}, 'MAP<STRING, STRING>', map('allowNonNumericNumbers', 'false'))"
#: Bytes up to which no string in a text can be too long for ``json_object_keys``.
PLAIN_BYTES = 10_000_000


def _plain(fields: str, values: str, named, compared: str) -> str:
    """Whether all keys of a map are known ones and come once; ``values`` is a struct of what it
    holds for the ``named`` ones.  The ``compared`` keys, known and each once, are asked for only
    where a value is null."""
    given = " + ".join(f"cast({values}.{n} IS NOT NULL AS INT)" for n in named)
    return f"coalesce(size({fields}) = {given} OR size({fields}) = size({compared}), false)"


def counted(events: DataFrame, stage: str, reason: str) -> DataFrame:
    """Count the events passing a stage and those it marked, as metrics of the job.

    The node also keeps filters on the reason above the parsing: pushed below it, the
    reason would be restated with the JSON parsed anew at every mention.
    """
    return events.observe(
        stage, F.count("*").alias("events"), F.count(reason).alias(reason)
    )


def decode(raw: DataFrame) -> DataFrame:
    """Envelope columns from a ``value`` column of JSON text, with a poison reason, and the fields
    of the payload as a map for :func:`check_payload`.

    Only the type and the payload are required.  A missing id gets a fresh one, so such
    a message can never be recognised as a redelivery.
    """
    ddl = ", ".join(f"{name} STRING" for name in ENVELOPE_FIELDS)
    text = "cast(value AS STRING)"
    # A plain text is parsed once, into a map; one that names a field twice or an unknown one, or
    # is no such object, is judged by its keys and a struct.
    found = ", ".join(f"'{n}', try_element_at(_map, '{n}')" for n in ENVELOPE_FIELDS)
    known = f"array({_quoted(ENVELOPE_FIELDS)})"
    keys = f"array_intersect(map_keys(_map), {known})"
    plain = f"octet_length({text}) < {PLAIN_BYTES} AND {_plain('_map', '_v', ENVELOPE_FIELDS, keys)}"
    frame = (
        raw.withColumn("_map", F.expr(_MAP.format(text)))
        .withColumn("_v", F.expr(f"named_struct({found})"))
        .withColumn("_plain", F.expr(plain))
        .withColumns(
            {
                "_keys": F.expr(f"CASE WHEN NOT _plain THEN json_object_keys({text}) END"),
                "_e": F.when(F.col("_plain"), F.col("_v")).otherwise(F.from_json(F.expr(text), ddl)),
            }
        )
    )
    frame = frame.withColumns(
        {
            "event_id": F.coalesce(F.col("_e.event_id"), F.expr("uuid()")),
            "event_type": F.col("_e.event_type"),
            "version": F.expr("coalesce(try_cast(_e.version AS INT), CASE WHEN _e.version IS NULL THEN 1 END)"),
            "event_time": F.expr("try_to_timestamp(_e.timestamp)"),
            "event_source": F.expr("coalesce(_e.source, 'synthetic')"),
            "payload": F.col("_e.payload"),
            "_fields": F.expr(_MAP.format("_e.payload")),
        }
    )
    reason = first_reason(
        [
            ("not_an_object", "NOT _plain AND _keys IS NULL"),
            (
                "unknown_envelope_field",
                f"NOT _plain AND size(array_except(_keys, {known})) > 0",
            ),
            ("unknown_event_type", f"event_type IS NULL OR event_type NOT IN ({_quoted(EVENT_TYPES)})"),
            (
                "missing_payload",
                f"payload IS NULL OR ((_fields IS NULL OR octet_length(payload) >= {PLAIN_BYTES})"
                " AND json_object_keys(payload) IS NULL)",
            ),
            ("unsupported_version", f"version IS NULL OR version < 1 OR version > {SUPPORTED_VERSION}"),
            ("bad_timestamp", "_e.timestamp IS NOT NULL AND event_time IS NULL"),
            ("source_too_long", "length(event_source) > 32"),
        ]
    )
    columns = ("event_id", "event_type", "version", "event_time", "event_source", "payload", "_fields")
    return counted(
        frame.select(*raw.columns, *columns, reason.alias("poison")), "decoded", "poison"
    )


def check_payload(decoded: DataFrame, as_of: date) -> DataFrame:
    """Typed payload columns and the first structural rule a payload breaks."""
    ddl = ", ".join(f"{name} STRING" for name in _ALL_FIELDS)
    kinds = list(PAYLOADS)
    kind = " ".join(f"WHEN '{name}' THEN {i}" for i, name in enumerate(kinds))

    def found(name: str) -> str:
        """A field is looked up only in payloads that may have it."""
        having = [str(i) for i, k in enumerate(kinds) if name in _names(PAYLOADS[k])]
        return f"'{name}', CASE WHEN _kind IN ({', '.join(having)}) THEN try_element_at(_fields, '{name}') END"

    allowed = " ".join(f"WHEN {i} THEN array({_quoted(_names(PAYLOADS[k]))})" for i, k in enumerate(kinds))
    # A function of a lambda keeps a projection out of whole-stage code, where it would add to a
    # method that is too long for the JVM to compile by then.
    keys = f"array_distinct(filter(map_keys(_fields), k -> array_contains(CASE _kind {allowed} END, k)))"
    known = _plain("_fields", "_v", _ALL_FIELDS, keys)
    frame = (
        decoded.withColumn("_kind", F.expr(f"CASE WHEN poison IS NULL THEN CASE event_type {kind} END END"))
        .withColumn("_v", F.expr(f"named_struct({', '.join(map(found, _ALL_FIELDS))})"))
        .withColumn("_known", F.expr(f"_kind IS NOT NULL AND {known}"))
    )
    typed = F.when(F.col("_known"), F.col("_v")).otherwise(
        F.from_json(F.when(F.col("poison").isNull(), F.col("payload")), ddl)
    )
    frame = frame.withColumn("p", typed)
    is_type = {name: f"event_type = '{name}'" for name in PAYLOADS}

    def number(name: str) -> str:
        return f"try_cast(p.{name} AS DOUBLE)"

    def day(name: str) -> str:
        return f"try_cast(p.{name} AS DATE)"

    def unusable(name: str, rule: str, kind=number) -> str:
        """Present but not parseable, or outside its range."""
        value = kind(name)
        return f"(p.{name} IS NOT NULL AND NOT coalesce({value} {rule}, false))"

    score = "BETWEEN 0 AND 1"
    required = " OR ".join(
        f"({is_type[name]} AND ("
        + " OR ".join(f"p.{f[1:]} IS NULL" for f in fields if f.startswith("*"))
        + "))"
        for name, fields in PAYLOADS.items()
    )
    dates = " OR ".join(
        f"(p.{f} IS NOT NULL AND {day(f)} IS NULL)"
        for f in ("check_in_date", "check_out_date", "booking_date", "stay_date")
    )
    reasons = [
        # The lambda keeps the rules out of whole-stage code too.
        (
            "unknown_payload_field",
            "NOT _known AND exists(json_object_keys(payload),"
            f" k -> NOT array_contains(CASE _kind {allowed} END, k))",
        ),
        ("missing_payload_field", required),
        ("hotel_id_length", "length(p.hotel_id) NOT BETWEEN 1 AND 16"),
        ("unknown_room_type_value", f"p.room_type NOT IN ({_quoted(ROOM_TYPES)})"),
        ("bad_date", dates),
        ("unknown_competitor", f"p.competitor NOT IN ({_quoted(COMPETITORS)})"),
        ("price_out_of_range", unusable("price", "BETWEEN 1e-9 AND 1000000")),
        ("currency_length", "length(p.currency) <> 3"),
        (
            "too_far_ahead",
            f"{is_type['competitor_price']} AND"
            f" datediff({day('check_in_date')}, DATE'{as_of}') > {MAX_DAYS_AHEAD}",
        ),
        ("stay_not_positive", f"{day('check_out_date')} <= {day('check_in_date')}"),
        ("bad_booking_count", unusable("booking_count", ">= 0")),
        ("bad_cancellation_count", unusable("cancellation_count", ">= 0")),
        ("cancelled_more_than_booked", f"{number('cancellation_count')} > {number('booking_count')}"),
        ("negative_money", f"{unusable('revenue', '>= 0')} OR {unusable('adr', '>= 0')}"),
        ("channel_length", "length(p.channel) > 24"),
        (
            "score_out_of_range",
            " OR ".join(
                unusable(f, score)
                for f in ("search_demand", "weather_score", "local_event_score", "confidence")
            ),
        ),
        ("unknown_season", f"p.season NOT IN ({_quoted(SEASONS)})"),
        (
            "price_not_positive",
            " OR ".join(
                unusable(f, "> 0")
                for f in ("base_price", "raw_recommended_price", "final_recommended_price")
            ),
        ),
        ("negative_demand", unusable("blended_demand", ">= 0")),
        (
            "text_too_long",
            "length(p.prediction_id) > 36 OR length(p.model_version) > 32 OR"
            " length(p.holiday_name) > 64 OR length(p.source) > 16",
        ),
    ]
    marked = frame.withColumn("poison", F.coalesce(F.col("poison"), first_reason(reasons)))
    return counted(marked.drop("_fields", "_kind", "_v", "_known"), "checked", "poison")


def check_references(
    checked: DataFrame, hotels: DataFrame, rooms: DataFrame, strict: bool = False
) -> DataFrame:
    """Reject events naming a hotel or room nobody knows.

    The reference side is read anew for each micro-batch.  With no hotels at all events
    pass, unless ``strict``: an empty table usually means the loader has not run yet.
    """
    empty = hotels.agg((F.count("*") == 0)).scalar()
    known = hotels.select(F.col("hotel_id").alias("_h"), F.lit(True).alias("_hotel")).dropna().distinct()
    offered = rooms.select(
        F.col("hotel_id").alias("_rh"), F.col("room_type").alias("_rt"), F.lit(True).alias("_room")
    ).dropna().distinct()
    # Null is not among the keys, so null-safe equality is equality.  The optimizer traces plain
    # equality back to the scan, through all the expressions that a payload comes from.
    joined = (
        checked.join(known, F.col("p.hotel_id").eqNullSafe(F.col("_h")), "left")
        .join(
            offered,
            F.col("p.hotel_id").eqNullSafe(F.col("_rh")) & F.col("p.room_type").eqNullSafe(F.col("_rt")),
            "left",
        )
        .withColumn("_empty", empty)
    )
    reasons = first_reason(
        [
            ("missing_hotel_id", "p.hotel_id IS NULL OR p.hotel_id = ''"),
            ("no_reference_data", f"_empty AND {str(strict).lower()}"),
            ("unknown_hotel", "NOT _empty AND _hotel IS NULL"),
            ("unknown_room_type", "NOT _empty AND _room IS NULL"),
        ]
    )
    marked = joined.withColumn("rejected", F.when(F.col("poison").isNull(), reasons))
    return counted(
        marked.drop("_h", "_hotel", "_rh", "_rt", "_room", "_empty"), "referenced", "rejected"
    )


def classify(
    raw: DataFrame, hotels: DataFrame, rooms: DataFrame, as_of: date, strict: bool = False
) -> DataFrame:
    """Every event with its typed payload and ``poison`` / ``rejected`` reasons."""
    return check_references(check_payload(decode(raw), as_of), hotels, rooms, strict)


def bookings_of(accepted: DataFrame) -> DataFrame:
    return accepted.where("event_type = 'booking'").selectExpr(
        "event_id",
        "event_time",
        "p.hotel_id",
        "p.room_type",
        "cast(p.booking_date AS DATE) AS booking_date",
        "cast(p.check_in_date AS DATE) AS check_in_date",
        "cast(p.check_out_date AS DATE) AS check_out_date",
        "cast(p.booking_count AS INT) AS booking_count",
        "cast(coalesce(p.cancellation_count, '0') AS INT) AS cancellation_count",
        "cast(coalesce(p.revenue, '0') AS DOUBLE) AS revenue",
        "cast(coalesce(p.adr, '0') AS DOUBLE) AS adr",
        "greatest(datediff(cast(p.check_in_date AS DATE), cast(p.booking_date AS DATE)), 0)"
        " AS lead_time_days",
        "coalesce(p.channel, 'direct') AS channel",
    )


def rates_of(accepted: DataFrame) -> DataFrame:
    return accepted.where("event_type = 'competitor_price'").selectExpr(
        "event_id",
        "event_time",
        "p.hotel_id",
        "p.room_type",
        "p.competitor",
        "cast(p.check_in_date AS DATE) AS check_in_date",
        "cast(p.price AS DOUBLE) AS price",
        "upper(coalesce(p.currency, 'INR')) AS currency",
        "cast(coalesce(p.is_available, 'true') AS BOOLEAN) AS is_available",
        "coalesce(p.source, 'synthetic') AS source",
        "event_time AS collected_at",
    )


def signals_of(accepted: DataFrame) -> DataFrame:
    """Exogenous columns of a night; season and weekday are ours, not the producer's."""
    from nightledger.functions.calendar import season_of

    return accepted.where("event_type = 'demand_signal'").selectExpr(
        "event_id",
        "event_time",
        "p.hotel_id",
        "p.room_type",
        "cast(p.stay_date AS DATE) AS stay_date",
        "cast(p.search_demand AS DOUBLE) AS search_demand",
        "cast(coalesce(p.weather_score, '0.5') AS DOUBLE) AS weather_score",
        "cast(coalesce(p.local_event_score, '0') AS DOUBLE) AS local_event_score",
        "cast(coalesce(p.holiday_flag, 'false') AS BOOLEAN) AS holiday_flag",
        "p.holiday_name",
    ).withColumns(
        {
            "season": season_of("stay_date"),
            "day_of_week": F.expr("weekday(stay_date)"),
            "is_weekend": F.expr("weekday(stay_date) >= 5"),
        }
    )


def wrap(rows: DataFrame, event_type: str, source: str = "synthetic", *kept: str) -> DataFrame:
    """Key and JSON envelope for rows with ``event_id``, ``event_time`` and payload columns, beside
    the columns that are ``kept``."""
    fields = [n for n in _names(PAYLOADS[event_type]) if n in rows.columns]
    payload = F.struct(*fields)
    envelope = F.struct(
        F.col("event_id"),
        F.lit(event_type).alias("event_type"),
        F.lit(SUPPORTED_VERSION).alias("version"),
        F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"),
        F.lit(source).alias("source"),
        payload.alias("payload"),
    )
    return rows.select(F.col("hotel_id").alias("key"), F.to_json(envelope).alias("value"), *kept)
