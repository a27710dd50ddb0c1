"""Texts and classes derived from single values."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from flightops.functions.payload import extract_delay_minutes
from flightops.functions.times import iso_local
from flightops.schemas import (
    HIGH_RISK_OVER,
    HISTORY_CATEGORIES,
    HISTORY_DESCRIPTIONS,
    MEDIUM_RISK_OVER,
    OTHER_CATEGORY,
    SIGNALED_DESCRIPTION,
    SIGNALED_TYPE,
)


def _lookup(values: Mapping[str, object], key: Column) -> Column:
    pairs = [F.lit(v) for pair in values.items() for v in pair]
    return F.try_element_at(F.create_map(*pairs), key)


def transition_details(from_state: Column, to_state: Column) -> Column:
    return F.concat(
        F.lit("Flight transitioned from "), F.coalesce(from_state, F.lit("null")), F.lit(" to "), to_state
    )


def state_change_payload(
    number: Column, previous: Column, new: Column, ts: Column, gate: Column, delay: Column
) -> Column:
    """Message body as JSON text; null fields are written."""
    return F.to_json(
        F.struct(
            number.alias("flightNumber"),
            previous.alias("previousState"),
            new.alias("newState"),
            iso_local(ts).alias("timestamp"),
            gate.alias("gate"),
            delay.alias("delay"),
        ),
        {"ignoreNullFields": "false"},
    )


def describe_history_event(event_type: Column, signal_name: Column) -> Column:
    fallback = F.lower(F.replace(F.replace(event_type, F.lit("EVENT_TYPE_"), F.lit("")), F.lit("_"), F.lit(" ")))
    return F.when(
        event_type == SIGNALED_TYPE,
        F.concat(F.lit(SIGNALED_DESCRIPTION), F.coalesce(signal_name, F.lit(""))),
    ).otherwise(F.coalesce(_lookup(HISTORY_DESCRIPTIONS, event_type), fallback))


def categorize_history_event(event_type: Column) -> Column:
    by_type = {t: category for category, types in HISTORY_CATEGORIES.items() for t in types}
    return F.coalesce(_lookup(by_type, event_type), F.lit(OTHER_CATEGORY))


def estimated_delay(event_type: Column, data: Column, default_by_type: Mapping[str, int] | None = None) -> Column:
    """Delay named in the payload, else a value by event type, else 0."""
    named = extract_delay_minutes(data)
    if not default_by_type:
        return named
    given = F.try_variant_get(F.try_parse_json(data), "$.delayMinutes", "variant").isNotNull()
    return F.when(given, named).otherwise(F.coalesce(_lookup(default_by_type, event_type), F.lit(0)))


def risk_score(delay_minutes: Column) -> Column:
    return (
        F.when(delay_minutes > HIGH_RISK_OVER, F.lit("HIGH"))
        .when(delay_minutes > MEDIUM_RISK_OVER, F.lit("MEDIUM"))
        .otherwise(F.lit("LOW"))
    )
