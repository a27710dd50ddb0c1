from __future__ import annotations

import rows as r
from pyspark.sql import functions as F

from flightops.operators import analytics, history, lifecycle
from flightops.operators import signals as sg
from flightops.schemas import STATES


def _states(frame, number):
    found = frame.filter(F.col("flight_number") == number).orderBy("timestamp").collect()
    return [(t.from_state, t.to_state) for t in found]


def test_plain_run_and_cancellation_in_each_phase(spark):
    # Entry times are at minutes 0, 1, 3, 6, 10, 15; C1…C5 are cancelled inside phase 1…5.
    flights = r.flights(spark, *[r.flight(n) for n in ("PLAIN", "C1", "C2", "C3", "C4", "C5")])
    signals = r.signals(spark, *[r.cancel(f"C{i + 1}", m) for i, m in enumerate((0.5, 2, 4, 8, 12))])
    moves = lifecycle.flight_transitions(flights, signals).cache()
    assert _states(moves, "PLAIN") == list(zip([None, *STATES[:5]], STATES[:6], strict=True))
    for i in range(1, 5):
        states = _states(moves, f"C{i}")
        assert len(states) == i + 1
        assert states[-1] == (STATES[i - 1], "CANCELLED")
    assert _states(moves, "C5")[-1] == ("LANDED", "COMPLETED")

    effective = {c.flight_key: c for c in lifecycle.effective_cancellations(flights, signals).collect()}
    assert set(effective) == {r.key(f"C{i}") for i in range(1, 5)}
    assert effective[r.key("C2")].effective_ts == r.at(3)
    assert effective[r.key("C2")].cancel_ts == r.at(2)
    assert effective[r.key("C2")].from_state == "BOARDING"


def test_cancellation_on_a_boundary_takes_effect_there(spark):
    flights = r.flights(spark, r.flight("T"), r.flight("S"))
    signals = r.signals(spark, r.cancel("T", 3), r.cancel("S", 0))
    moves = lifecycle.flight_transitions(flights, signals)
    assert _states(moves, "T")[-1] == ("BOARDING", "CANCELLED")
    assert _states(moves, "S") == [(None, "SCHEDULED"), ("SCHEDULED", "CANCELLED")]


def test_last_delay_and_gate_hold_at_each_transition(spark):
    flights = r.flights(spark, r.flight("AA1", gate="A1"), r.flight("AA2", gate=None))
    signals = r.signals(
        spark,
        r.delay("AA1", 0.5, 45, 1),
        r.delay("AA1", 2, 30, 2),
        r.gate("AA1", 3, "C12", 3),
        r.gate("AA1", 12, "", 4),
        r.delay("AA1", 20, 99, 5),
    )
    history_rows = lifecycle.transitions_with_context(flights, signals).orderBy("flight_key", "timestamp").collect()
    first = [(t.to_state, t.delay, t.gate) for t in history_rows if t.flight_number == "AA1"]
    assert first == [
        ("SCHEDULED", 0, "A1"),
        ("BOARDING", 45, "A1"),
        ("DEPARTED", 30, "C12"),
        ("IN_FLIGHT", 30, "C12"),
        ("LANDED", 30, "C12"),
        ("COMPLETED", 30, ""),
    ]
    assert {t.gate for t in history_rows if t.flight_number == "AA2"} == {""}
    assert history_rows[0].event_details == "Flight transitioned from null to SCHEDULED"
    assert history_rows[0].id == f"{r.key('AA1')}:SCHEDULED"


def test_same_time_signals_are_ordered_by_sequence(spark):
    flights = r.flights(spark, r.flight("AA1"))
    signals = r.signals(spark, r.delay("AA1", 2, 5, seq=9), r.delay("AA1", 2, 7, seq=3))
    assert lifecycle.flight_outcome(flights, signals).first().delay == 5


def test_details_show_the_raw_delay_and_outcome_only_a_positive_one(spark):
    flights = r.flights(spark, r.flight("AA1")).withColumn("delay", F.lit(12))
    signals = r.signals(spark, r.delay("AA1", 0.5, 30, 1), r.delay("AA1", 2, 0, 2), r.gate("AA1", 4, "F9", 3))
    end = lifecycle.flight_details(flights, signals, r.at(60)).first()
    assert (end.delay, end.gate, end.current_state) == (0, "F9", "COMPLETED")
    outcome = lifecycle.flight_outcome(flights, signals).first()
    assert (outcome.delay, outcome.gate, outcome.current_state) == (12, "F9", "COMPLETED")


def test_details_over_time(spark):
    flights = r.flights(spark, r.flight("AA1"))
    signals = r.signals(spark, r.delay("AA1", 2, 30, 1), r.cancel("AA1", 4, seq=2), r.gate("AA1", 7, "Z1", 3))
    seen = [lifecycle.flight_details(flights, signals, r.at(m)).first() for m in (-1, 0, 1, 2.5, 5, 6, 30)]
    assert [s.current_state for s in seen] == [
        None, "SCHEDULED", "BOARDING", "BOARDING", "DEPARTED", "CANCELLED", "CANCELLED",
    ]
    assert [s.delay for s in seen] == [0, 0, 0, 30, 30, 30, 30]
    assert {s.gate for s in seen} == {"A1"}


def test_signals_are_accepted_or_rejected(spark):
    flights = r.flights(spark, r.flight("AA1"), r.flight("AA2"), r.flight("AA3"))
    signals = r.signals(
        spark,
        r.delay("AA1", -1, 1, 1),
        r.delay("AA1", 0, 1, 2),
        r.delay("AA1", 15, 1, 3),
        r.delay("AA1", 15.1, 1, 4),
        r.delay("XX", 1, 1, 5),
        r.cancel("AA2", 2, seq=6),
        r.delay("AA2", 3, 1, 7),
        r.delay("AA2", 3.1, 1, 8),
    )
    ended = lifecycle.flights_with_end(flights, signals)
    accepted = sg.accepted_signals(signals, ended)
    outside = sg.signals_outside_window(signals, ended)
    unknown = sg.signals_without_flight(signals, flights)
    assert sorted(s.event_seq for s in accepted.collect()) == [2, 3, 6, 7]
    assert sorted((s.event_seq, s.problem) for s in outside.collect()) == [
        (1, "before_start"), (4, "after_end"), (8, "after_end"),
    ]
    assert [s.event_seq for s in unknown.collect()] == [5]
    known = sg.known_flights_signalled(flights, accepted)
    assert sorted(f.flight_number for f in known.collect()) == ["AA1", "AA2"]


def test_latest_signals(spark):
    signals = r.signals(
        spark,
        r.delay("AA1", 1, 45, 1), r.delay("AA1", 2, 0, 2), r.gate("AA1", 1, "B10", 3),
        r.cancel("AA1", 3, "first", 4), r.cancel("AA1", 5, "second", 5),
    )
    last = lifecycle.latest_signals(signals).first()
    assert (last.last_delay, last.last_gate, last.first_cancel_ts, last.last_reason) == (0, "B10", r.at(3), "second")


def test_timeline_and_duration(spark):
    flights = r.flights(spark, r.flight("AA1"))
    timeline = lifecycle.phase_timeline(flights).orderBy("ordinal").collect()
    assert [(t.state, t.entered_at) for t in timeline] == [
        (s, r.at(m)) for s, m in zip(STATES[:6], (0, 1, 3, 6, 10, 15), strict=True)
    ]
    assert lifecycle.total_duration(flights).first().total_seconds == 900


def test_order_violations(spark):
    flights = r.flights(spark, r.flight("AA1"), r.flight("AA2"))
    moves = lifecycle.transitions_with_context(flights, r.signals(spark, r.cancel("AA2", 2)))
    assert lifecycle.transition_order_violations(moves).count() == 0
    broken = moves.withColumn(
        "to_state", F.when(F.col("to_state") == "LANDED", "BOARDING").otherwise(F.col("to_state"))
    )
    found = lifecycle.transition_order_violations(broken).collect()
    assert [(v.flight_number, v.to_state, v.previous_to_state) for v in found] == [("AA1", "BOARDING", "IN_FLIGHT")]


def test_active_flights_and_elapsed(spark):
    flights = r.flights(spark, r.flight("AA1"), r.flight("AA2"))
    signals = r.signals(spark, r.delay("AA1", 1, 45, 1), r.cancel("AA2", 0.5, seq=2))
    active = history.active_flights(flights, signals, r.at(5.25)).collect()
    assert [(a.flight_number, a.current_state, a.delay, a.elapsed) for a in active] == [
        ("AA1", "DEPARTED", 45, "PT5M15S")
    ]
    assert history.active_flights(flights, signals, r.at(0.5)).count() == 2
    assert history.active_flights(flights, signals, r.at(0.5), limit=1).first().flight_number == "AA1"
    assert history.active_flights(flights, signals, r.at(15)).count() == 0


def test_state_changes_report_requests_at_once(spark):
    flights = r.flights(spark, r.flight("AA1"))
    signals = r.signals(spark, r.delay("AA1", 0.5, 45, 1), r.gate("AA1", 2, "C1", 2), r.cancel("AA1", 4, seq=3))
    accepted = sg.accepted_signals(signals, lifecycle.flights_with_end(flights, signals))
    moves = lifecycle.transitions_with_context(flights, signals)
    changes = history.state_changes(moves, accepted, flights).orderBy("timestamp").collect()
    shown = [(c.origin[0], c.previous_state, c.new_state, c.gate, c.delay) for c in changes]
    assert shown == [
        ("l", None, "SCHEDULED", "A1", 0),
        ("o", "SCHEDULED", "SCHEDULED", "A1", 45),
        ("l", "SCHEDULED", "BOARDING", "A1", 45),
        ("o", "BOARDING", "BOARDING", "C1", 45),
        ("l", "BOARDING", "DEPARTED", "C1", 45),
        ("o", "DEPARTED", "CANCELLED", "C1", 45),
        ("l", "DEPARTED", "CANCELLED", "C1", 45),
    ]


def test_audit_trail_is_rebuilt_in_order(spark):
    flights = r.flights(spark, r.flight("AA1"))
    signals = r.signals(spark, r.delay("AA1", 1, 45, 1), r.cancel("AA1", 2, seq=2))
    accepted = sg.accepted_signals(signals, lifecycle.flights_with_end(flights, signals))
    rebuilt = history.build_history(lifecycle.transitions_with_context(flights, signals), accepted)
    trail = history.audit_trail(rebuilt, r.key("AA1")).collect()
    assert history.audit_trail(rebuilt, "flight-XX").count() == 0
    assert history.build_audit_trail(lifecycle.transitions_with_context(flights, signals), accepted).count() == 4
    assert [e.event_id for e in trail] == list(range(1, 5))
    assert [e.description for e in trail] == [
        "Workflow execution started",
        "Signal received: announceDelay",
        "Signal received: cancelFlight",
        "Workflow execution completed successfully",
    ]
    assert [e.category for e in trail[:3]] == ["lifecycle", "signal", "signal"]


def test_history_is_newest_first(spark):
    flights = r.flights(spark, r.flight("AA1"), r.flight("AA2"))
    moves = lifecycle.transitions_with_context(flights, r.signals(spark, r.cancel("AA2", 2)))
    newest = history.transitions_for_flight(moves, "AA1", r.DAY).collect()
    assert [t.to_state for t in newest] == list(reversed(STATES[:6]))
    assert history.transitions_for_flight(moves, "AA1", "2020-01-01").count() == 0
    assert history.transitions_by_state(moves, "CANCELLED").first().flight_number == "AA2"
    latest = history.latest_by_flight_number(moves, ["timestamp"]).collect()
    assert {t.flight_number: t.to_state for t in latest} == {"AA1": "COMPLETED", "AA2": "CANCELLED"}


def test_export_keeps_every_event_as_a_row(spark):
    audit = spark.range(1, 26).selectExpr(
        "'flight-AA-1-2026-01-27' as flight_key", "id as event_id", "'T' as event_type", "'' as timestamp",
        "'' as description", "'other' as category",
    )
    rows = history.export_history(audit, "2026-01-26 14:35:00").orderBy("event_id").collect()
    assert [e.event_id for e in rows] == list(range(1, 26))
    assert rows[0].flight_number == "AA-1"
    envelope = history.export_envelopes(audit, "2026-01-26 14:35:00").collect()
    assert [(e.flight_number, e.event_count) for e in envelope] == [("AA-1", 25)]


def test_topic_signals_change_values_but_send_nothing(spark):
    flights = r.flights(spark, r.flight("AA1"))
    signals = r.signals(spark, r.delay("AA1", 0.5, 45, 1), r.gate("AA1", 2, "C1", 2), r.cancel("AA1", 4, seq=3))
    accepted = sg.accepted_signals(signals, lifecycle.flights_with_end(flights, signals))
    by_channel = accepted.withColumn("channel", F.when(F.col("event_seq") == 2, "request").otherwise("topic"))
    moves = lifecycle.transitions_with_context(flights, signals)
    sent = history.state_changes(moves, by_channel, flights).filter("origin = 'operator'").collect()
    assert [(c.new_state, c.gate, c.delay) for c in sent] == [("BOARDING", "C1", 45)]
    assert history.live_state_events(flights, by_channel).count() == 1


def test_lookup_of_several_flights(spark):
    flights = r.flights(spark, r.flight("AA1"), r.flight("AA2"), r.flight("AA3"))
    moves = lifecycle.transitions_with_context(flights, r.signals(spark))
    wanted = spark.createDataFrame([("AA1",), ("AA3",), ("AA3",), ("XX",)], "flight_number string")
    found = history.transitions_for_flights(moves, wanted).coalesce(1).filter("flight_number = 'AA3'").collect()
    assert [t.to_state for t in found] == list(reversed(STATES[:6]))
    assert history.transitions_for_flights(moves, wanted).count() == 12
    other_day = wanted.withColumn("flight_date", F.lit("2020-01-01").cast("date"))
    assert history.transitions_for_flights(moves, other_day).count() == 0


def test_past_delays_know_only_the_days_before(spark):
    rows = [("A", "B", f"2026-01-0{d}", delay) for d, delay in ((1, 10), (1, 20), (2, 60), (4, 0))]
    outcomes = spark.createDataFrame(rows, "departure_station string, arrival_station string, flight_date string, delay int")
    past = analytics.past_delay_by_route(outcomes).orderBy("flight_date").collect()
    assert [p.route_avg_delay for p in past] == [None, 15.0, 30.0]


def test_time_in_state(spark):
    flights = r.flights(spark, r.flight("AA1"))
    moves = lifecycle.flight_transitions(flights, r.signals(spark, r.cancel("AA1", 2)))
    dwell = {d.state: d.seconds for d in analytics.time_in_state(moves).collect()}
    assert dwell == {"SCHEDULED": 60, "BOARDING": 120}
