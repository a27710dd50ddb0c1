"""Events to signals, request checks, and which signals reach an open flight."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flightops.functions.keys import flight_key
from flightops.functions.payload import extract_delay_minutes, extract_gate, extract_reason
from flightops.operators.skew import behind_own_exchange
from flightops.schemas import (
    CANCEL,
    DELAY,
    DELAY_REQUIRED,
    DELAY_TOO_SMALL,
    GATE,
    GATE_REQUIRED,
    JOURNEY_ID_REQUIRED,
    LEGS_REQUIRED,
    REASON_REQUIRED,
    REQUIRED_MESSAGES,
    SIGNAL_OF_EVENT,
)


def events_to_signals(events: DataFrame) -> DataFrame:
    """Events that steer a flight, as signals with their argument filled in."""
    kind = F.col("event_type")
    signal = F.lit(None).cast("string")
    for event_type, name in SIGNAL_OF_EVENT.items():
        signal = F.when(kind == event_type, name).otherwise(signal)
    data = F.col("data")
    return (
        events.filter(kind.isin(*SIGNAL_OF_EVENT))
        .withColumn("signal", signal)
        .select(
            flight_key(F.col("flight_number"), F.col("flight_date")).alias("flight_key"),
            "signal",
            F.when(F.col("signal") == DELAY, extract_delay_minutes(data)).alias("delay_minutes"),
            F.when(F.col("signal") == GATE, extract_gate(data)).alias("gate"),
            F.when(F.col("signal") == CANCEL, extract_reason(data)).alias("reason"),
            "event_seq",
            "event_ts",
        )
    )


def unmapped_events(events: DataFrame) -> DataFrame:
    """Valid events that steer nothing."""
    return events.filter(~F.col("event_type").isin(*SIGNAL_OF_EVENT))


def dedup_replayed_events(events: DataFrame, delay: str | None = None) -> DataFrame:
    """Each event once. For a stream, give how late a replay may come (`event_ts` must be TIMESTAMP)."""
    if delay is None:
        return events.dropDuplicates(["flight_number", "event_seq"])
    return events.withWatermark("event_ts", delay).dropDuplicatesWithinWatermark(["flight_number", "event_seq"])


# --- request checks -----------------------------------------------------------------------


def _blank(value: Column) -> Column:
    return value.isNull() | ~value.rlike(r"[^\x00-\x20]")


def _present(violations: list[Column]) -> Column:
    return F.array_compact(F.array(*violations))


def _leg_violations(get, prefix: Column | None = None) -> list[Column]:
    found = []
    for name, message in REQUIRED_MESSAGES.items():
        text = name not in ("flight_date", "scheduled_departure", "scheduled_arrival")
        missing = _blank(get(name)) if text else get(name).isNull()
        shown = F.lit(message) if prefix is None else F.concat(prefix, F.lit(message))
        found.append(F.when(missing, shown))
    return found


def validate_flight_requests(requests: DataFrame) -> DataFrame:
    """Requests that break a rule, with all messages in `violations`."""
    return requests.withColumn("violations", _present(_leg_violations(F.col))).filter(F.size("violations") > 0)


def valid_flight_requests(requests: DataFrame) -> DataFrame:
    """Requests that break no rule; only these start a flight."""
    return requests.filter(F.size(_present(_leg_violations(F.col))) == 0)


def validate_journeys(requests: DataFrame) -> DataFrame:
    """Journeys without id or legs, or with a leg that breaks a flight rule."""

    def check_leg(leg: Column, index: Column) -> Column:
        prefix = F.concat(F.lit("flights["), index.cast("string"), F.lit("]: "))
        return _present(_leg_violations(leg.getField, prefix))

    own = _present(
        [
            F.when(F.col("journey_id").isNull(), JOURNEY_ID_REQUIRED),
            F.when(F.coalesce(F.size("legs"), F.lit(0)) <= 0, LEGS_REQUIRED),
        ]
    )
    legs = F.flatten(F.transform(F.coalesce("legs", F.slice("legs", 1, 0)), check_leg))
    all_found = F.concat(own, F.coalesce(legs, F.array().cast("array<string>")))
    return requests.withColumn("violations", all_found).filter(F.size("violations") > 0)


def validate_signals(signals: DataFrame) -> DataFrame:
    """Signals whose argument a request would not be allowed to carry, with the message."""
    kind = F.col("signal")
    error = (
        F.when((kind == DELAY) & F.col("delay_minutes").isNull(), DELAY_REQUIRED)
        .when((kind == DELAY) & (F.col("delay_minutes") < 1), DELAY_TOO_SMALL)
        .when((kind == GATE) & _blank(F.col("gate")), GATE_REQUIRED)
        .when((kind == CANCEL) & _blank(F.col("reason")), REASON_REQUIRED)
    )
    return signals.withColumn("violation", error).filter(F.col("violation").isNotNull())


# --- routing ------------------------------------------------------------------------------
# `flights_with_end` has one row per flight (lifecycle.flights_with_end), so each join below
# yields at most one row per signal. In all of them the signals are the left side, the one a
# hot flight makes large and the adaptive skew join can split.


def accepted_signals(signals: DataFrame, flights_with_end: DataFrame) -> DataFrame:
    """Signals that reach a flight that exists and is open."""
    open_between = behind_own_exchange(flights_with_end.select("flight_key", "start_ts", "end_ts"), "flight_key")
    return (
        signals.join(open_between, "flight_key")
        .filter(F.col("event_ts").between(F.col("start_ts"), F.col("end_ts")))
        .select(*signals.columns)
    )


def signals_without_flight(signals: DataFrame, flights: DataFrame) -> DataFrame:
    return signals.join(flights.select("flight_key"), "flight_key", "left_anti")


def signals_outside_window(signals: DataFrame, flights_with_end: DataFrame) -> DataFrame:
    """Signals to a known flight before its start or after its end."""
    open_between = behind_own_exchange(flights_with_end.select("flight_key", "start_ts", "end_ts"), "flight_key")
    problem = F.when(F.col("event_ts") < F.col("start_ts"), "before_start").when(
        F.col("event_ts") > F.col("end_ts"), "after_end"
    )
    return (
        signals.join(open_between, "flight_key")
        .withColumn("problem", problem)
        .filter(F.col("problem").isNotNull())
        .select(*signals.columns, "problem")
    )


def known_flights_signalled(flights: DataFrame, accepted: DataFrame) -> DataFrame:
    """Flights with at least one accepted signal."""
    # Reduced to one row per flight first: a semi join cannot split a hot right side.
    signalled = accepted.select("flight_key").distinct()
    return flights.join(signalled, "flight_key", "left_semi")
