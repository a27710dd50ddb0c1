from __future__ import annotations

import pytest
import rows as r
from pyspark.sql import functions as F

from flightops.operators import journeys

CANCELS = "journey_id string, reason string, event_ts timestamp_ntz"
# A leg takes 15 minutes, then 1 second turnaround.
LEG = 15 + 1 / 60


def _journeys(spark, *journeys_: tuple):
    return spark.createDataFrame(
        [(journey_id, [leg[1:] for leg in legs]) for journey_id, legs in journeys_],
        "journey_id string, legs array<struct<flight_number:string,flight_date:date,departure_station:string,"
        "arrival_station:string,scheduled_departure:timestamp_ntz,scheduled_arrival:timestamp_ntz,gate:string,"
        "aircraft:string,start_ts:timestamp_ntz,phase_seconds:array<int>>>",
    )


def _run(spark, legs, signals=(), cancels=()):
    scheduled = journeys.journey_schedule(_journeys(spark, ("J", legs)))
    cancelled = spark.createDataFrame([("J", "Weather", ts) for ts in cancels], CANCELS)
    execution = journeys.journey_execution(scheduled, r.signals(spark, *signals), cancelled)
    return execution.orderBy("leg").collect(), journeys.current_leg_index(execution).first().current_leg_index


LEGS = [r.flight("AA100"), r.flight("AA200"), r.flight("AA300")]


def test_legs_run_one_after_the_other(spark):
    legs, index = _run(spark, LEGS)
    assert [leg.current_state for leg in legs] == ["COMPLETED"] * 3
    assert [leg.leg_start for leg in legs] == [r.at(0), r.at(LEG), r.at(2 * LEG)]
    assert [leg.n_transitions for leg in legs] == [6, 6, 6]
    assert index == 2


def test_cancelled_leg_cancels_the_rest(spark):
    legs, index = _run(spark, LEGS, [r.cancel("AA200", LEG + 2)])
    assert [leg.current_state for leg in legs] == ["COMPLETED", "CANCELLED", "CANCELLED"]
    assert [leg.cancelled_by for leg in legs] == [None, "leg", "cascade"]
    assert [leg.n_transitions for leg in legs] == [6, 3, 0]
    assert legs[2].leg_start is None
    assert index == 1


@pytest.mark.parametrize(("minutes", "completed"), [(-1, 3), (0, 0), (7, 1), (LEG, 1), (LEG + 1, 2), (100, 3)])
def test_journey_cancellation_spares_the_leg_under_way(spark, minutes, completed):
    legs, index = _run(spark, LEGS, cancels=[r.at(minutes)])
    assert [leg.current_state for leg in legs] == ["COMPLETED"] * completed + ["CANCELLED"] * (3 - completed)
    assert index == min(completed, 2)


@pytest.mark.parametrize(
    ("given", "cancelled", "flown"),
    [
        (("X", None, "Y"), None, ["X", "X", "X"]),
        (("X", None, "Y"), "AA200", ["X", "X", "Y"]),
        ((None, "X", "Y"), None, [None, "X", "X"]),
        ((None, None, None), None, [None, None, None]),
    ],
)
def test_aircraft_is_handed_on(spark, given, cancelled, flown):
    legs = [r.flight(leg[1], aircraft=a) for leg, a in zip(LEGS, given, strict=True)]
    run, _ = _run(spark, legs, [r.cancel(cancelled, LEG + 2)] if cancelled else [])
    assert [leg.aircraft for leg in run] == flown


def test_signals_reach_the_leg_at_its_own_time(spark):
    signals = [r.delay("AA200", 1, 99, 1), r.delay("AA200", LEG + 1, 30, 2), r.gate("AA100", 3, "C1", 3)]
    legs, _ = _run(spark, LEGS, signals)
    assert [leg.delay for leg in legs] == [0, 30, 0]
    assert [leg.gate for leg in legs] == ["C1", "A1", "A1"]


def test_links_sizes_and_status(spark):
    nested = _journeys(spark, ("J", LEGS), ("ONE", [r.flight("AA9")]), ("EMPTY", []))
    links = journeys.journey_links(nested).filter("journey_id = 'J'").orderBy("leg").collect()
    assert [(x.previous_flight_number, x.next_flight_number) for x in links] == [
        (None, "AA200"), ("AA100", "AA300"), ("AA200", None),
    ]
    assert {x.journey_id: x.n_legs for x in journeys.journey_sizes(nested).collect()} == {"J": 3, "ONE": 1, "EMPTY": 0}
    scheduled = journeys.journey_schedule(nested)
    none = spark.createDataFrame([], CANCELS)
    status = journeys.journey_status(journeys.journey_execution(scheduled, r.signals(spark), none))
    by_id = {s.journey_id: [leg.flight_number for leg in s.legs] for s in status.collect()}
    assert by_id == {"J": ["AA100", "AA200", "AA300"], "ONE": ["AA9"]}


def test_turnaround_is_a_parameter(spark):
    scheduled = journeys.journey_schedule(_journeys(spark, ("J", LEGS)), turnaround_seconds=60)
    starts = [leg.leg_start for leg in scheduled.orderBy("leg").collect()]
    assert starts == [r.at(0), r.at(16), r.at(32)]


def test_cancellation_of_another_journey_does_nothing(spark):
    scheduled = journeys.journey_schedule(_journeys(spark, ("J", LEGS)))
    other = spark.createDataFrame([("K", "x", r.at(0))], CANCELS)
    states = journeys.journey_execution(scheduled, r.signals(spark), other).select("current_state").distinct()
    assert [s.current_state for s in states.collect()] == ["COMPLETED"]
    assert scheduled.filter(F.col("journey_key") == "journey-J").count() == 3


def test_a_cancellation_before_the_start_is_rejected_and_hides_no_later_one(spark):
    scheduled = journeys.journey_schedule(_journeys(spark, ("J", LEGS)))
    sent = spark.createDataFrame([("J", "early", r.at(-1)), ("J", "late", r.at(LEG + 1)), ("K", "x", r.at(0))], CANCELS)
    execution = journeys.journey_execution(scheduled, r.signals(spark), sent).orderBy("leg").collect()
    assert [leg.current_state for leg in execution] == ["COMPLETED", "COMPLETED", "CANCELLED"]
    rejected = journeys.rejected_journey_signals(sent, scheduled).orderBy("journey_id").collect()
    assert [(s.journey_id, s.reason, s.problem) for s in rejected] == [("J", "early", "before_start"), ("K", "x", "unknown_journey")]


def test_legs_that_ran_have_history_rows(spark):
    scheduled = journeys.journey_schedule(_journeys(spark, ("J", LEGS)))
    signals = r.signals(spark, r.gate("AA100", 3, "C1", 1), r.cancel("AA200", LEG + 2, seq=2))
    none = spark.createDataFrame([], CANCELS)
    rows = journeys.journey_transitions(scheduled, signals, none).orderBy("leg", "timestamp").collect()
    assert [t.leg for t in rows] == [0] * 6 + [1] * 3
    assert [t.gate for t in rows[:4]] == ["A1", "A1", "C1", "C1"]
    assert [(t.to_state, t.timestamp) for t in rows[6:]] == [
        ("SCHEDULED", r.at(LEG)), ("BOARDING", r.at(LEG + 1)), ("CANCELLED", r.at(LEG + 3)),
    ]


def test_links_and_schedule_need_no_shuffle(spark):
    nested = _journeys(spark, ("J", LEGS))
    for frame in (journeys.journey_links(nested), journeys.journey_schedule(nested)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan
        assert "Exchange" not in plan


def test_a_flight_shared_by_two_journeys_runs_in_each(spark):
    """Twelve and six rows, and one signal counts for both executions of its flight."""
    nested = _journeys(spark, ("J1", [r.flight("AA100"), r.flight("AA200")]), ("J2", [r.flight("AA200")]))
    scheduled = journeys.journey_schedule(nested)
    none = spark.createDataFrame([], CANCELS)
    sent = r.signals(spark, r.delay("AA200", 2, 25))
    execution = journeys.journey_execution(scheduled, sent, none, own_time=True).orderBy("journey_id", "leg").collect()
    assert [(x.journey_id, x.leg, x.delay, x.n_transitions) for x in execution] == [("J1", 0, 0, 6), ("J1", 1, 25, 6), ("J2", 0, 25, 6)]
    rows = journeys.journey_transitions(scheduled, sent, none, own_time=True).collect()
    assert len(rows) == 18
    entered = {(x.journey_id, x.leg): x.timestamp for x in rows if x.to_state == "SCHEDULED"}
    assert entered == {("J1", 0): r.at(0), ("J1", 1): r.at(LEG), ("J2", 0): r.at(0)}
    # In journey time the same signal meets only the execution that runs then.
    alone = journeys.journey_execution(scheduled, sent, none).orderBy("journey_id", "leg").collect()
    assert [x.delay for x in alone] == [0, 0, 25]
