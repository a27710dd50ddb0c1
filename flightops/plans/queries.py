"""The registered queries: every operator over the views of the given tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flightops.functions.keys import default_flight_date
from flightops.operators import analytics, enrich, history, journeys, lifecycle, signals, starts
from flightops.plans import views
from flightops.schemas import REQUEST_CHANNEL
from flightops.session import shared_dir, tune
from flightops.sources import events, requests, stores

AS_OF = "2024-01-15 12:00:00"
STAMP = "2024-01-31 00:00:00"
HISTORY_DATE = "2024-01-15"
LOOKUP_STATION = "ORD"
TIGHT_MINUTES = 1200

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


class Tables:
    """The views over one table folder and what several queries derive from them, each built once."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        self.sf_dir = sf_dir

    def view(self, name: str) -> DataFrame:
        return getattr(views, name)(self.spark, self.sf_dir)

    @cached_property
    def flights(self) -> DataFrame:
        return self.view("flights")

    @cached_property
    def events(self) -> DataFrame:
        return self.view("flight_events")

    @cached_property
    def signals(self) -> DataFrame:
        return signals.events_to_signals(self.events)

    @cached_property
    def moves(self) -> DataFrame:
        return lifecycle.flight_transitions(self.flights, self.signals)

    @cached_property
    def transitions(self) -> DataFrame:
        return lifecycle.transitions_with_context(self.flights, self.signals)

    @cached_property
    def flights_with_end(self) -> DataFrame:
        return lifecycle.flights_with_end(self.flights, self.signals)

    @cached_property
    def accepted(self) -> DataFrame:
        return signals.accepted_signals(self.signals, self.flights_with_end)

    @cached_property
    def outcomes(self) -> DataFrame:
        return lifecycle.flight_outcome(self.flights, self.signals)

    @cached_property
    def legs(self) -> DataFrame:
        return requests.journey_legs(self.view("journeys"))

    @cached_property
    def scheduled(self) -> DataFrame:
        return journeys.journey_schedule(self.view("journeys"))

    @cached_property
    def cascaded(self) -> DataFrame:
        outcomes = journeys.leg_outcomes(self.scheduled, self.signals, own_time=True)
        cancels = journeys.accepted_journey_signals(self.view("journey_signals"), self.scheduled)
        return journeys.cascade_cancellations(outcomes, cancels)

    @cached_property
    def journey_run(self) -> DataFrame:
        return journeys.aircraft_handoff(self.cascaded)

    @cached_property
    def execution(self) -> DataFrame:
        return journeys.execution_of(self.journey_run)

    @cached_property
    def state_changes(self) -> DataFrame:
        return history.state_changes_of_signals(self.flights, self.by_channel(self.signals))

    @staticmethod
    def by_channel(sent: DataFrame) -> DataFrame:
        """Every other event came as a request, the rest from the topic."""
        return sent.withColumn("channel", F.when(F.col("event_seq") % 2 == 0, REQUEST_CHANNEL).otherwise("topic"))

    @cached_property
    def accepted_by_channel(self) -> DataFrame:
        return self.by_channel(self.accepted)

    @cached_property
    def wanted(self) -> DataFrame:
        """Numbers looked up in the history: those of every flight from one station."""
        return self.flights.filter(F.col("departure_station") == LOOKUP_STATION).select("flight_number").distinct()

    @cached_property
    def audit(self) -> DataFrame:
        return history.audit_trail(self.view("history_events"))


def query(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    """Register a query under its function name; it runs with the package's session settings."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(Tables(tune(spark), sf_dir))

    QUERIES[build.__name__] = run
    return build


def _joined(column: str):
    return F.array_join(column, "; ").alias(column)


# --- sources and sinks --------------------------------------------------------------------


@query
def parse_flight_events(t):
    return events.parse_flight_events(t.view("raw_messages"))


@query
def dead_letter_events(t):
    return events.dead_letter_events(t.view("raw_messages"))


@query
def flights_from_requests(t):
    return requests.flights_from_requests(signals.valid_flight_requests(t.view("flight_requests")))


@query
def rejected_starts(t):
    return starts.rejected_starts(t.view("start_requests"), t.signals)


@query
def journey_legs(t):
    return t.legs.drop("phase_seconds")


@query
def read_transitions(t):
    path = shared_dir(t.spark, "transitions")
    stores.write_transitions(t.transitions, path)
    return stores.read_transitions(t.spark, path)


@query
def write_state_changes(t):
    return stores.state_change_messages(t.state_changes)


@query
def live_state_events(t):
    return history.live_state_events(t.flights, t.accepted_by_channel)


@query
def export_history(t):
    return history.export_history(t.audit, AS_OF)


@query
def export_envelopes(t):
    return history.export_envelopes(t.view("history_source"), AS_OF)


# --- events and requests ------------------------------------------------------------------


@query
def events_to_signals(t):
    return t.signals


@query
def unmapped_events(t):
    return signals.unmapped_events(t.events)


@query
def dedup_replayed_events(t):
    return signals.dedup_replayed_events(t.view("replayed_events"))


@query
def validate_flight_requests(t):
    found = signals.validate_flight_requests(t.view("flight_requests"))
    return found.select("flight_key", _joined("violations"))


@query
def validate_journeys(t):
    found = signals.validate_journeys(t.view("journey_requests"))
    return found.select("journey_id", F.size("legs").alias("n_legs"), _joined("violations"))


@query
def validate_signals(t):
    return signals.validate_signals(t.signals)


@query
def enriched_events(t):
    return enrich.enriched_events(t.events, stamp=STAMP)


# --- lifecycle ----------------------------------------------------------------------------


@query
def phase_timeline(t):
    return lifecycle.phase_timeline(t.flights)


@query
def total_duration(t):
    return lifecycle.total_duration(t.flights)


@query
def effective_cancellations(t):
    return lifecycle.effective_cancellations(t.flights, t.signals)


@query
def flight_transitions(t):
    return t.moves


@query
def transitions_with_context(t):
    return t.transitions


@query
def flight_details(t):
    return lifecycle.flight_details(t.flights, t.signals, AS_OF).drop("start_ts")


@query
def flight_outcome(t):
    return t.outcomes


@query
def latest_signals(t):
    return lifecycle.latest_signals(t.accepted)


@query
def transition_order_violations(t):
    feed = t.state_changes.select("flight_key", F.col("new_state").alias("to_state"), "timestamp", "origin")
    return lifecycle.transition_order_violations(feed, ["timestamp", "origin", "to_state"])


# --- journeys -----------------------------------------------------------------------------


@query
def journey_links(t):
    return journeys.journey_links(t.view("journeys")).select(
        "journey_id", "leg", "flight_number", "previous_flight_number", "next_flight_number", "flight_key"
    )


@query
def journey_sizes(t):
    return journeys.journey_sizes(t.view("journeys"))


@query
def journey_schedule(t):
    return t.scheduled.select("journey_id", "leg", "flight_key", "leg_start")


@query
def journey_execution(t):
    return t.execution


@query
def cascade_cancellations(t):
    return t.cascaded.select("journey_id", "leg", "flight_key", "own_state", "current_state", "cancelled_by")


@query
def rejected_journey_signals(t):
    return journeys.rejected_journey_signals(t.view("journey_signals"), t.scheduled)


@query
def aircraft_handoff(t):
    return t.journey_run.select("journey_id", "leg", "flight_key", "aircraft")


@query
def journey_transitions(t):
    return journeys.transitions_of_run(t.journey_run)


@query
def journey_status(t):
    leg = F.col("l")
    return (
        journeys.journey_status(t.execution)
        .select("journey_id", F.posexplode("legs").alias("position", "l"))
        .select("journey_id", "position", *[leg[c].alias(c) for c in ("leg", "flight_number", "current_state",
                                                                     "gate", "delay", "aircraft")])
    )


@query
def current_leg_index(t):
    return journeys.current_leg_index(t.execution)


# --- joins --------------------------------------------------------------------------------


@query
def accepted_signals(t):
    return t.accepted


@query
def signals_without_flight(t):
    return signals.signals_without_flight(t.signals, t.flights)


@query
def signals_outside_window(t):
    return signals.signals_outside_window(t.signals, t.flights_with_end)


@query
def known_flights_signalled(t):
    return signals.known_flights_signalled(t.flights, t.accepted).select(
        "flight_key", "flight_number", "flight_date"
    )


@query
def active_flights(t):
    return history.active_flights(t.flights, t.signals, AS_OF)


# --- history ------------------------------------------------------------------------------


@query
def transitions_for_flight(t):
    return history.transitions_for_flights(t.transitions, t.wanted)


@query
def transitions_for_flight_date(t):
    asked_on = default_flight_date(F.lit(None).cast("date"), dt.date.fromisoformat(HISTORY_DATE))
    return history.transitions_for_flights(t.transitions, t.wanted.withColumn("flight_date", asked_on))


@query
def audit_trail(t):
    return t.audit


@query
def build_audit_trail(t):
    return history.build_audit_trail(t.transitions, t.accepted, t.execution)


@query
def state_changes(t):
    return t.state_changes


@query
def recent_events(t):
    return history.recent_events(history.live_state_events(t.flights, t.accepted_by_channel))


@query
def latest_by_flight_number(t):
    return history.latest_by_flight_number(
        t.transitions.select(
            "flight_number", "flight_key", "from_state", "to_state", "timestamp", "gate", "delay"
        ),
        ["timestamp", "flight_key"],
    )


@query
def history_counts(t):
    return history.history_counts(history.with_category(t.view("history_source")))


@query
def history_milestones(t):
    return history.history_milestones(t.view("history_source"))


# --- analytics ----------------------------------------------------------------------------


@query
def avg_delay_by_route(t):
    return analytics.avg_delay_by_route(t.outcomes)


@query
def avg_delay_by_hour(t):
    return analytics.avg_delay_by_hour(t.outcomes)


@query
def time_in_state(t):
    return analytics.time_in_state(t.moves)


@query
def phase_bottlenecks(t):
    return analytics.phase_bottlenecks(analytics.time_in_state(t.moves))


@query
def actual_vs_scheduled(t):
    return analytics.actual_vs_scheduled(t.moves, t.flights)


@query
def on_time_performance(t):
    return analytics.on_time_performance(t.outcomes)


@query
def ops_kpis(t):
    return analytics.ops_kpis(t.outcomes)


@query
def delay_windows(t):
    return analytics.delay_windows(t.signals)


@query
def flight_patterns_by_date(t):
    return analytics.flight_patterns_by_date(t.outcomes)


@query
def transitions_near_events(t):
    return analytics.transitions_near_events(t.moves, t.view("external_events"))


@query
def transitions_by_state(t):
    return history.transitions_by_state(t.transitions, "CANCELLED")


@query
def event_patterns(t):
    return analytics.event_patterns(t.signals)


@query
def connection_slack(t):
    return analytics.connection_slack(t.legs, t.execution, TIGHT_MINUTES)


@query
def station_load(t):
    return analytics.station_load(t.flights_with_end)


@query
def history_enriched_events(t):
    return enrich.history_enriched_events(t.events, t.flights, analytics.past_delay_by_route(t.outcomes))


@query
def risk_mix(t):
    return enrich.risk_mix(enrich.enriched_events(t.events, stamp=STAMP))
