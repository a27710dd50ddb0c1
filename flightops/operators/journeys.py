"""Multi-leg journeys.

A journey arrives as one nested row, so its legs are few enough for one record and a window
per journey is bounded. What can be large, the signals of a leg, goes through the lifecycle
fold, which handles a hot leg.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flightops.functions.times import plus_seconds
from flightops.operators.lifecycle import RUN, fold_of_states, slot_states, transitions_of_fold
from flightops.operators.skew import behind_own_exchange
from flightops.schemas import DEFAULT_DELAY, PHASES, TURNAROUND_SECONDS
from flightops.sources.requests import legs_in_journey

_FOLD = ("cancel_slot", "end_slot", "entered", "gates", "delays")


def _legs_so_far():
    return Window.partitionBy("journey_id").orderBy("leg").rowsBetween(Window.unboundedPreceding, Window.currentRow)


def journey_links(journeys: DataFrame) -> DataFrame:
    """Each leg with the flight numbers before and after it."""
    return (
        legs_in_journey(journeys)
        .withColumns(
            {
                "previous_flight_number": F.get("legs", F.col("leg") - 1)["flight_number"],
                "next_flight_number": F.get("legs", F.col("leg") + 1)["flight_number"],
            }
        )
        .drop("legs")
    )


def journey_sizes(journeys: DataFrame) -> DataFrame:
    return journeys.select("journey_id", F.coalesce(F.size("legs"), F.lit(0)).alias("n_legs"))


def journey_schedule(journeys: DataFrame, turnaround_seconds: int = TURNAROUND_SECONDS) -> DataFrame:
    """Each leg with its start: that of the journey plus the earlier legs and turnarounds.

    Legs before a cancelled one always run in full, so the sum holds for every leg that runs.
    """
    none = F.lit(0).cast("bigint")

    def length(leg: Column) -> Column:
        return F.aggregate(leg["phase_seconds"], none, lambda acc, x: acc + x) + turnaround_seconds

    earlier = F.slice("legs", F.lit(1), F.col("leg"))
    offset = F.aggregate(earlier, none, lambda acc, leg: acc + length(leg))
    start = plus_seconds(F.get("legs", F.lit(0))["start_ts"], offset)
    return legs_in_journey(journeys).withColumn("leg_start", start).drop("legs")


def leg_runs(scheduled: DataFrame, own_time: bool = False) -> DataFrame:
    """`scheduled` with `start_ts` as the time that its signals refer to: the leg's start, or the flight's own.

    Signals are in journey time by default: they count where they fall while the leg runs. With `own_time` they
    are those of the flight as planned alone, and move with it to where the journey puts the leg.
    """
    return scheduled if own_time else scheduled.withColumn("start_ts", F.col("leg_start"))


def legs_with_states(legs: DataFrame, states: DataFrame) -> DataFrame:
    """Legs with the states of their runs. A flight that several legs share is folded once and handed to each."""
    return legs.join(behind_own_exchange(states, "flight_key"), list(RUN), "left")


def outcomes_of_legs(legs: DataFrame, columns: list[str]) -> DataFrame:
    """Each leg as if it ran, from its state; keeps the fold, which its history rows are made of."""
    folded = fold_of_states(legs.withColumn("start_ts", F.col("leg_start")), columns)
    last_delay = F.get("delays", F.col("end_slot"))
    return folded.select(
        "journey_id",
        "leg",
        "flight_key",
        "flight_number",
        "flight_date",
        "leg_start",
        F.col("end_ts").alias("leg_end"),
        F.when(F.col("cancel_slot").isNotNull(), "CANCELLED").otherwise("COMPLETED").alias("own_state"),
        F.col("gate").alias("planned_gate"),
        F.coalesce(F.get("gates", F.col("end_slot")), "gate").alias("gate"),
        F.when(last_delay > 0, last_delay).otherwise(F.lit(DEFAULT_DELAY)).alias("delay"),
        "aircraft",
        (F.coalesce("cancel_slot", F.lit(PHASES)) + 1).alias("n_transitions"),
        *_FOLD,
    )


def leg_outcomes(scheduled: DataFrame, signals: DataFrame, own_time: bool = False) -> DataFrame:
    """Each leg as if it ran, whatever the others do."""
    runs = leg_runs(scheduled, own_time)
    states = slot_states(runs.select(*RUN).distinct(), signals, RUN)
    return outcomes_of_legs(legs_with_states(runs, states), scheduled.columns)


def _with_journey_start(journey_signals: DataFrame, scheduled: DataFrame) -> DataFrame:
    starts = scheduled.filter(F.col("leg") == 0).select("journey_id", F.col("leg_start").alias("journey_start"))
    return journey_signals.join(starts, "journey_id", "left")


def accepted_journey_signals(journey_signals: DataFrame, scheduled: DataFrame) -> DataFrame:
    """Signals that find their journey begun; one before the start reaches nothing."""
    known = _with_journey_start(journey_signals, scheduled)
    return known.filter(F.col("event_ts") >= F.col("journey_start")).select(*journey_signals.columns)


def rejected_journey_signals(journey_signals: DataFrame, scheduled: DataFrame) -> DataFrame:
    """The other signals, with `problem`: unknown_journey or before_start."""
    problem = F.when(F.col("journey_start").isNull(), "unknown_journey").when(
        F.col("event_ts") < F.col("journey_start"), "before_start"
    )
    known = _with_journey_start(journey_signals, scheduled).withColumn("problem", problem)
    return known.filter(F.col("problem").isNotNull()).select(*journey_signals.columns, "problem")


def cascade_cancellations(outcomes: DataFrame, journey_signals: DataFrame) -> DataFrame:
    """Adds `current_state` and `cancelled_by`. `journey_signals` are those the journey accepts.

    A journey stops at the first leg that ends cancelled (`leg`) or that would start at or
    after the journey's cancellation (`journey`); all later legs are cancelled too (`cascade`).
    """
    cancels = journey_signals.groupBy("journey_id").agg(F.min("event_ts").alias("journey_cancel_ts"))
    stops = (
        F.when(F.col("leg_start") >= F.col("journey_cancel_ts"), "journey")
        .when(F.col("own_state") == "CANCELLED", "leg")
    )
    earlier = Window.partitionBy("journey_id").orderBy("leg").rowsBetween(Window.unboundedPreceding, -1)
    stopped = outcomes.join(cancels, "journey_id", "left").withColumn("stops", stops)
    stopped_before = F.coalesce(F.max(F.col("stops").isNotNull()).over(earlier), F.lit(False))
    return (
        stopped.withColumn("cancelled_by", F.when(stopped_before, "cascade").otherwise(F.col("stops")))
        .withColumn("current_state", F.when(F.col("cancelled_by").isNotNull(), "CANCELLED").otherwise("COMPLETED"))
        .drop("stops", "journey_cancel_ts")
    )


def aircraft_handoff(outcomes: DataFrame) -> DataFrame:
    """Replace `aircraft` by the first one known so far, up to and with the first cancelled leg."""
    first_known = F.first("aircraft", ignorenulls=True).over(_legs_so_far())
    earlier = Window.partitionBy("journey_id").orderBy("leg").rowsBetween(Window.unboundedPreceding, -1)
    reached = ~F.coalesce(F.max(F.col("current_state") == "CANCELLED").over(earlier), F.lit(False))
    return outcomes.withColumn("aircraft", F.when(reached, first_known).otherwise(F.col("aircraft")))


def journey_run(
    scheduled: DataFrame, signals: DataFrame, journey_signals: DataFrame, own_time: bool = False
) -> DataFrame:
    """Every leg after the journey's end with its fold; `execution_of` and `transitions_of_run` are views of it."""
    accepted = accepted_journey_signals(journey_signals, scheduled)
    return aircraft_handoff(cascade_cancellations(leg_outcomes(scheduled, signals, own_time), accepted))


def _ran() -> Column:
    return F.coalesce(F.col("cancelled_by"), F.lit("")).isin("", "leg")


def execution_of(run: DataFrame) -> DataFrame:
    """Legs that never ran have no times and no transitions."""

    def if_ran(name: str, otherwise: Column) -> Column:
        return F.when(_ran(), F.col(name)).otherwise(otherwise).alias(name)

    return run.select(
        "journey_id",
        "leg",
        "flight_key",
        "flight_number",
        if_ran("leg_start", F.lit(None)),
        if_ran("leg_end", F.lit(None)),
        "current_state",
        "cancelled_by",
        if_ran("gate", F.col("planned_gate")),
        if_ran("delay", F.lit(DEFAULT_DELAY)),
        "aircraft",
        if_ran("n_transitions", F.lit(0)),
    )


def transitions_of_run(run: DataFrame) -> DataFrame:
    """History rows of every leg that ran, at journey time and with the aircraft it was handed."""
    legs = run.filter(_ran()).withColumn("gate", F.col("planned_gate"))
    return transitions_of_fold(legs, also=("journey_id", "leg"))


def journey_execution(
    scheduled: DataFrame, signals: DataFrame, journey_signals: DataFrame, own_time: bool = False
) -> DataFrame:
    """Every leg after the journey's end."""
    return execution_of(journey_run(scheduled, signals, journey_signals, own_time))


def journey_transitions(
    scheduled: DataFrame, signals: DataFrame, journey_signals: DataFrame, own_time: bool = False
) -> DataFrame:
    """The history rows of the journey's legs, from the same fold as the execution."""
    return transitions_of_run(journey_run(scheduled, signals, journey_signals, own_time))


def journey_status(execution: DataFrame) -> DataFrame:
    """One row per journey with its legs in order."""
    leg = F.struct("leg", "flight_number", "current_state", "gate", "delay", "aircraft")
    return execution.groupBy("journey_id").agg(F.sort_array(F.collect_list(leg)).alias("legs"))


def current_leg_index(execution: DataFrame) -> DataFrame:
    """Index of the last leg tried: the first cancelled one, else the last."""
    return execution.groupBy("journey_id").agg(
        F.coalesce(F.min(F.when(F.col("current_state") == "CANCELLED", F.col("leg"))), F.max("leg")).alias(
            "current_leg_index"
        )
    )
