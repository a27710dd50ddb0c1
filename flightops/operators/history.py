"""Reads over the history: lookups, audit trail, state feed, active flights, export."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flightops.functions.describe import categorize_history_event, describe_history_event
from flightops.functions.keys import is_flight_key, journey_key, state_ordinal
from flightops.functions.times import (
    epoch_micros,
    epoch_millis,
    format_event_time,
    iso_duration,
    timestamp_lit,
)
from flightops.operators.lifecycle import (
    flight_details,
    fold_of_states,
    states_of_slots,
    transitions_of_fold,
    with_slot,
)
from flightops.operators.ordered import with_row_number, with_running_last
from flightops.operators.skew import behind_own_exchange
from flightops.schemas import (
    CANCEL,
    CANCELLED_MESSAGE,
    DEFAULT_DELAY,
    DOMAIN_EVENT_TYPES,
    FEED_SIZE,
    FLIGHT_ENDED_TYPE,
    FLIGHT_STARTED_TYPE,
    LEG_ENDED_TYPE,
    LEG_STARTED_TYPE,
    PHASES,
    REQUEST_CHANNEL,
    SIGNALED_TYPE,
    STARTED_MESSAGE,
    STATES,
    TERMINAL_STATES,
    TIMER_TYPES,
)
from flightops.session import written


def transitions_for_flight(
    transitions: DataFrame, number: str | None = None, flight_date: dt.date | str | None = None
) -> DataFrame:
    """History rows newest first, of one flight number or of all, on one date or on all."""
    rows = transitions
    if number is not None:
        rows = rows.filter(F.col("flight_number") == number)
    if flight_date is not None:
        rows = rows.filter(F.col("flight_date") == F.lit(str(flight_date)).cast("date"))
    newest = [F.desc("timestamp"), F.desc(state_ordinal(F.col("to_state")))]
    return rows.orderBy(*([] if number is not None else ["flight_number"]), *newest)


def transitions_for_flights(transitions: DataFrame, wanted: DataFrame) -> DataFrame:
    """History rows of every wanted flight_number, or pair with flight_date, newest first per flight.

    Each task sorts its own rows; the whole history is not sorted.
    """
    keys = ["flight_number", *(["flight_date"] if "flight_date" in wanted.columns else [])]
    rows = transitions.join(wanted.select(*keys).distinct(), keys, "left_semi")
    newest = [F.desc("timestamp"), F.desc(state_ordinal(F.col("to_state")))]
    return rows.sortWithinPartitions("flight_number", *newest)


def transitions_by_state(transitions: DataFrame, state: str) -> DataFrame:
    return transitions.filter(F.col("to_state") == state)


def audit_trail(history: DataFrame, key: str | None = None, zone: str = "UTC") -> DataFrame:
    """History events made readable: of one key in event order, or of all keys as a table.

    The whole table is not sorted; `event_id` carries the order within each key.
    """
    rows = history if key is None else history.filter(F.col("flight_key") == key).orderBy("event_id")
    return rows.select(
        "flight_key",
        "event_id",
        "event_type",
        format_event_time(F.col("event_ts"), zone).alias("timestamp"),
        describe_history_event(F.col("event_type"), F.col("signal_name")).alias("description"),
        categorize_history_event(F.col("event_type")).alias("category"),
    )


def build_history(transitions: DataFrame, accepted: DataFrame, execution: DataFrame | None = None) -> DataFrame:
    """Numbered history events (input of `audit_trail`) from the tables of the domain.

    A flight's first transition is its start and its last one its end; between them stand the
    accepted signals. Legs that ran are events of their journey's key.
    """
    rank = {kind: F.lit(i).alias("rank") for i, kind in enumerate(DOMAIN_EVENT_TYPES)}
    state = F.col("to_state")
    kind = F.when(state == STATES[0], FLIGHT_STARTED_TYPE).when(state.isin(*TERMINAL_STATES), FLIGHT_ENDED_TYPE)
    none, no_seq = F.lit(None).cast("string"), F.lit(0).cast("bigint")
    ends = transitions.select("flight_key", F.col("timestamp").alias("event_ts"), kind.alias("event_type"))
    order = F.when(F.col("event_type") == FLIGHT_STARTED_TYPE, rank[FLIGHT_STARTED_TYPE]).otherwise(rank[FLIGHT_ENDED_TYPE])
    rows = (
        ends.filter(F.col("event_type").isNotNull())
        .select("flight_key", "event_ts", order.alias("rank"), no_seq.alias("seq"), "event_type", none.alias("signal_name"))
        .unionByName(
            accepted.select(
                "flight_key",
                "event_ts",
                rank[SIGNALED_TYPE],
                F.col("event_seq").alias("seq"),
                F.lit(SIGNALED_TYPE).alias("event_type"),
                F.col("signal").alias("signal_name"),
            )
        )
    )
    if execution is not None:
        times = F.array(
            *[
                F.struct(F.col(at).alias("event_ts"), rank[kind], F.lit(kind).alias("event_type"))
                for at, kind in (("leg_start", LEG_STARTED_TYPE), ("leg_end", LEG_ENDED_TYPE))
            ]
        )
        legs = execution.filter(F.col("leg_start").isNotNull())
        legs = legs.select(journey_key(F.col("journey_id")).alias("flight_key"), "leg", F.inline(times))
        rows = rows.unionByName(
            legs.select(
                "flight_key",
                "event_ts",
                "rank",
                F.col("leg").cast("bigint").alias("seq"),
                "event_type",
                none.alias("signal_name"),
            )
        )
    return with_row_number(rows, ["flight_key"], ["event_ts", "rank", "seq"], "event_id", once=True).select(
        "flight_key", "event_ts", "event_type", "signal_name", "event_id"
    )


def build_audit_trail(transitions: DataFrame, accepted: DataFrame, execution: DataFrame | None = None) -> DataFrame:
    return audit_trail(build_history(transitions, accepted, execution))


def requested(signals: DataFrame) -> DataFrame:
    """Signals sent by a request; those from the topic change a flight but announce nothing themselves.

    A table without the column `channel` holds requests only.
    """
    return signals.filter(F.col("channel") == REQUEST_CHANNEL) if "channel" in signals.columns else signals


def state_changes(transitions: DataFrame, accepted: DataFrame, flights: DataFrame) -> DataFrame:
    """Messages about state: those of the lifecycle and those sent at once for each request.

    Values in force count all accepted signals; only requests report (`requested`). A delay or gate
    request reports the current state twice, a cancellation request reports CANCELLED before the
    flight itself gets there. `origin` tells the two kinds apart.
    """
    known = with_running_last(
        accepted, ["flight_key"], ["event_ts", "event_seq"], {"last_gate": "gate", "last_delay": "delay_minutes"}
    )
    offset = epoch_micros(F.col("event_ts")) - epoch_micros(F.col("start_ts"))
    elapsed, passed = F.lit(0).cast("bigint"), F.lit(0)
    for phase in range(PHASES - 1):
        elapsed = elapsed + F.element_at("phase_seconds", phase + 1)
        passed = passed + (offset > elapsed * 1_000_000).cast("int")
    current = F.get(F.array(*[F.lit(s) for s in STATES[:PHASES]]), passed)
    facts = flights.select("flight_key", "flight_number", F.col("gate").alias("own_gate"), "start_ts", "phase_seconds")
    requests = requested(known).join(facts, "flight_key").withColumn("current", current)
    return _changes_of_flights(transitions).unionByName(_changes_of_requests(requests))


def _changes_of_flights(transitions: DataFrame) -> DataFrame:
    return transitions.select(
        "flight_key",
        "flight_number",
        F.col("from_state").alias("previous_state"),
        F.col("to_state").alias("new_state"),
        "timestamp",
        "gate",
        "delay",
        F.lit("lifecycle").alias("origin"),
    )


def _changes_of_requests(requests: DataFrame) -> DataFrame:
    """Requests with the state (`current`) and values (`last_gate`, `last_delay`) in force at their moment."""
    return requests.select(
        "flight_key",
        "flight_number",
        F.col("current").alias("previous_state"),
        F.when(F.col("signal") == CANCEL, "CANCELLED").otherwise(F.col("current")).alias("new_state"),
        F.col("event_ts").alias("timestamp"),
        F.coalesce("last_gate", "own_gate").alias("gate"),
        F.coalesce("last_delay", F.lit(DEFAULT_DELAY)).alias("delay"),
        F.lit("operator").alias("origin"),
    )


def state_changes_of_signals(flights: DataFrame, signals: DataFrame) -> DataFrame:
    """The same messages from signals that no one has judged yet, with one join of signals and flights.

    That join gives every signal its slot, and the slot gives the state in force; reduced per slot, the same rows are the fold, which
    gives the lifecycle's own messages and the slot each flight ends in. A signal is accepted up to that slot. All
    signals before an accepted one are accepted too, so the values in force need no verdict. The joined rows are written once.
    """
    facts = flights.select("flight_key", "flight_number", F.col("gate").alias("own_gate"), "start_ts", "phase_seconds")
    slotted = with_slot(signals.join(facts, "flight_key")).drop("start_ts", "phase_seconds", "reason")
    slotted = written(slotted, "slotted")
    states = written(states_of_slots(slotted), "states")
    folded = fold_of_states(flights.join(states, "flight_key", "left"), flights.columns)

    order = ["event_ts", "event_seq"]
    known = with_running_last(slotted, ["flight_key"], order, {"last_gate": "gate", "last_delay": "delay_minutes"})
    ends = states.select("flight_key", F.coalesce("cancel_slot", F.lit(PHASES)).alias("end_slot"))
    accepted = requested(known).join(behind_own_exchange(ends, "flight_key"), "flight_key").filter("slot <= end_slot")
    current = F.get(F.array(*[F.lit(s) for s in STATES[:PHASES]]), F.greatest(F.col("slot") - 1, F.lit(0)))
    return _changes_of_flights(transitions_of_fold(folded)).unionByName(_changes_of_requests(accepted.withColumn("current", current)))


def live_state_events(flights: DataFrame, accepted: DataFrame) -> DataFrame:
    """The feed shown live: one entry per flight start and per cancellation request."""
    started = flights.select(
        "flight_number",
        F.lit(STATES[0]).alias("state"),
        F.lit(STARTED_MESSAGE).alias("message"),
        epoch_millis(F.col("start_ts")).alias("timestamp"),
    )
    cancelled = (
        requested(accepted)
        .filter(F.col("signal") == CANCEL)
        .join(flights.select("flight_key", "flight_number"), "flight_key")
        .select(
            "flight_number",
            F.lit("CANCELLED").alias("state"),
            F.concat(F.lit(CANCELLED_MESSAGE), "reason").alias("message"),
            epoch_millis(F.col("event_ts")).alias("timestamp"),
        )
    )
    return started.unionByName(cancelled)


def recent_events(feed: DataFrame, n: int = FEED_SIZE) -> DataFrame:
    """Newest entries of the feed."""
    return feed.orderBy(F.desc("timestamp"), F.desc("flight_number"), "state", "message").limit(n)


def latest_by_flight_number(rows: DataFrame, order: list[str]) -> DataFrame:
    """The last row of each flight number, whatever its date."""
    others = [c for c in rows.columns if c != "flight_number"]
    latest = rows.groupBy("flight_number").agg(F.max_by(F.struct(*others), F.struct(*order)).alias("last"))
    return latest.select("flight_number", "last.*")


def with_category(history: DataFrame) -> DataFrame:
    """History events, numbered or not, with their category."""
    return history.withColumn("category", categorize_history_event(F.col("event_type")))


def history_counts(audit: DataFrame) -> DataFrame:
    """Events per key and category, and per key over all categories (`total`)."""
    return (
        audit.rollup("flight_key", "category")
        .agg(F.count(F.lit(1)).alias("n_events"), F.grouping("flight_key").alias("all_keys"))
        .filter(F.col("all_keys") == 0)
        .select("flight_key", F.coalesce("category", F.lit("total")).alias("category"), "n_events")
    )


def history_milestones(audit: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    return audit.groupBy("flight_key").agg(
        F.bool_or(kind == FLIGHT_STARTED_TYPE).alias("has_started"),
        F.bool_or(kind == FLIGHT_ENDED_TYPE).alias("has_completed"),
        F.bool_or(kind.isin(*TIMER_TYPES)).alias("has_timer"),
        F.bool_or(kind == SIGNALED_TYPE).alias("has_signal"),
    )


def active_flights(flights: DataFrame, signals: DataFrame, as_of, limit: int | None = None) -> DataFrame:
    """Flights running at `as_of` with state, gate, delay and elapsed time."""
    at = timestamp_lit(as_of)
    begun = flights.filter(is_flight_key(F.col("flight_key")) & (F.col("start_ts") <= at))
    running = flight_details(begun, signals, as_of).filter(~F.col("current_state").isin(*TERMINAL_STATES))
    rows = running.select(
        "flight_key",
        "flight_number",
        "current_state",
        "gate",
        "delay",
        F.col("start_ts").alias("start_time"),
        iso_duration(F.col("start_ts"), at).alias("elapsed"),
    )
    return rows if limit is None else rows.orderBy("flight_key").limit(limit)


def _number_of_key(key: str) -> Column:
    return F.regexp_extract(key, r"^flight-(.*)-\d{4}-\d{2}-\d{2}$", 1).alias("flight_number")


def export_history(audit: DataFrame, exported_at) -> DataFrame:
    """The readable history for a download: one row per event, whatever the number of events of a key."""
    return audit.select(
        "flight_key",
        _number_of_key("flight_key"),
        timestamp_lit(exported_at).alias("exported_at"),
        "event_id",
        "event_type",
        "timestamp",
        "description",
        "category",
    )


def export_envelopes(history: DataFrame, exported_at) -> DataFrame:
    """One row per key with the number of its events; `history` need not be numbered."""
    counts = history.groupBy("flight_key").agg(F.count(F.lit(1)).alias("event_count"))
    return counts.select("flight_key", _number_of_key("flight_key"), timestamp_lit(exported_at).alias("exported_at"), "event_count")
