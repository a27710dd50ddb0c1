"""Reports over outcomes, transitions, signals and journeys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flightops.functions.keys import state_ordinal
from flightops.functions.times import epoch_micros, seconds_between
from flightops.operators.ordered import with_running_last
from flightops.operators.skew import behind_own_exchange
from flightops.schemas import CANCEL, DELAY, GATE


def _mean(value: Column) -> Column:
    return F.round(F.avg(value), 6)


def _share(condition: Column) -> Column:
    return _mean(condition.cast("int"))


def _delay_summary() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("n_flights"),
        _mean(F.col("delay")).alias("avg_delay"),
        F.max("delay").alias("max_delay"),
    ]


def avg_delay_by_route(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("departure_station", "arrival_station").agg(*_delay_summary())


def past_delay_by_route(outcomes: DataFrame) -> DataFrame:
    """Per route and day with flights, `route_avg_delay`: the mean over all days before, null on the first.

    The window runs over one row per day.
    """
    per_day = outcomes.groupBy("departure_station", "arrival_station", "flight_date").agg(
        F.sum("delay").alias("s"), F.count(F.lit(1)).alias("n")
    )
    route = Window.partitionBy("departure_station", "arrival_station").orderBy("flight_date")
    before = route.rowsBetween(Window.unboundedPreceding, -1)
    mean = F.round(F.sum("s").over(before) / F.sum("n").over(before), 6).alias("route_avg_delay")
    return per_day.select("departure_station", "arrival_station", "flight_date", mean)


def avg_delay_by_hour(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy(F.hour("scheduled_departure").alias("departure_hour")).agg(*_delay_summary())


def time_in_state(transitions: DataFrame) -> DataFrame:
    """Seconds each state lasted; the last state of a flight has no length.

    The history table holds one row per flight and state (that is its id), so a flight has at
    most seven rows and the window per flight is bounded.
    """
    order = Window.partitionBy("flight_key").orderBy("timestamp", state_ordinal(F.col("to_state")))
    return (
        transitions.select(
            "flight_key",
            F.col("to_state").alias("state"),
            F.col("timestamp").alias("entered_at"),
            F.lead("timestamp").over(order).alias("left_at"),
        )
        .filter(F.col("left_at").isNotNull())
        .withColumn("seconds", seconds_between(F.col("entered_at"), F.col("left_at")))
    )


def phase_bottlenecks(dwell: DataFrame, k: int = 3) -> DataFrame:
    """The `k` states that hold flights longest on average, with exact percentiles.

    Lengths are counted first, so that what reaches the few per-state tasks is one row per
    state and distinct number of seconds, however many flights there are.
    """
    counted = dwell.groupBy("state", "seconds").agg(F.count(F.lit(1)).alias("n"))
    return (
        counted.groupBy("state")
        .agg(
            F.sum("n").alias("n_flights"),
            F.round(F.sum(F.col("seconds") * F.col("n")) / F.sum("n"), 6).alias("mean_seconds"),
            F.round(F.percentile("seconds", 0.5, F.col("n")), 6).alias("p50_seconds"),
            F.round(F.percentile("seconds", 0.95, F.col("n")), 6).alias("p95_seconds"),
        )
        .orderBy(F.desc("mean_seconds"), "state")
        .limit(k)
    )


def actual_vs_scheduled(transitions: DataFrame, flights: DataFrame) -> DataFrame:
    """Seconds from the schedule to the real departure and landing; null if it never happened."""

    def reached(state: str) -> Column:
        return F.min(F.when(F.col("to_state") == state, F.col("timestamp")))

    actual = transitions.groupBy("flight_key").agg(
        reached("DEPARTED").alias("departed_at"), reached("LANDED").alias("landed_at")
    )
    schedule = flights.select("flight_key", "scheduled_departure", "scheduled_arrival")
    return schedule.join(actual, "flight_key", "left").select(
        "flight_key",
        seconds_between(F.col("scheduled_departure"), F.col("departed_at")).alias("departure_variance_seconds"),
        seconds_between(F.col("scheduled_arrival"), F.col("landed_at")).alias("arrival_variance_seconds"),
    )


def on_time_performance(outcomes: DataFrame, threshold_minutes: int = 15) -> DataFrame:
    """Share of flights per route and day that are not later than the threshold."""
    return outcomes.groupBy("departure_station", "arrival_station", "flight_date").agg(
        F.count(F.lit(1)).alias("n_flights"),
        _share(F.col("delay") <= threshold_minutes).alias("on_time_share"),
    )


def ops_kpis(outcomes: DataFrame) -> DataFrame:
    """Counts per date and station, per date (`ALL` stations) and over everything (`ALL`, `ALL`)."""
    cancelled = F.col("current_state") == "CANCELLED"

    def shown(name: str) -> Column:
        return F.when(F.grouping(name) == 1, "ALL").otherwise(F.col(name).cast("string"))

    return (
        outcomes.rollup("flight_date", "departure_station")
        .agg(
            shown("flight_date").alias("day"),
            shown("departure_station").alias("station"),
            F.count(F.lit(1)).alias("n_flights"),
            F.count_if(cancelled).alias("n_cancelled"),
            F.count_if(~cancelled).alias("n_completed"),
            F.count_if(F.col("delay") > 0).alias("n_delayed"),
            _share(cancelled).alias("cancel_rate"),
        )
        .drop("flight_date", "departure_station")
    )


def delay_windows(
    signals: DataFrame, size: str = "1 hour", slide: str | None = "30 minutes", watermark: str | None = None
) -> DataFrame:
    """Delay announcements in tumbling (`slide=None`) or hopping time windows.

    For a stream give `watermark`, and `event_ts` as TIMESTAMP.
    """
    delays = signals.filter(F.col("signal") == DELAY)
    if watermark is not None:
        delays = delays.withWatermark("event_ts", watermark)
    return (
        delays.groupBy(F.window("event_ts", size, slide))
        .agg(
            F.count(F.lit(1)).alias("n_delays"),
            _mean(F.col("delay_minutes")).alias("avg_minutes"),
            F.max("delay_minutes").alias("max_minutes"),
        )
        .select("window.start", "window.end", "n_delays", "avg_minutes", "max_minutes")
        .withColumnsRenamed({"start": "window_start", "end": "window_end"})
    )


def flight_patterns_by_date(outcomes: DataFrame) -> DataFrame:
    """Per flight number over all dates: usual outcome (first by name if tied), mean delay, cancel rate."""
    return outcomes.groupBy("flight_number").agg(
        F.count(F.lit(1)).alias("n_dates"),
        F.mode("current_state", True).alias("usual_outcome"),
        _mean(F.col("delay")).alias("avg_delay"),
        _share(F.col("current_state") == "CANCELLED").alias("cancel_rate"),
    )


def transitions_near_events(transitions: DataFrame, external: DataFrame, minutes: int = 10) -> DataFrame:
    """External events with the transitions of the same flight at most `minutes` away.

    A flight has at most seven transitions, so the join is linear in the external events.
    """
    distance = epoch_micros(F.col("external_ts")) - epoch_micros(F.col("timestamp"))
    moves = behind_own_exchange(transitions.select("flight_key", "to_state", "timestamp"), "flight_key")
    return (
        external.join(moves, "flight_key")
        .filter(F.abs(distance) <= minutes * 60 * 1_000_000)
        .select("flight_key", "to_state", "timestamp", "external_ts", "k", distance.alias("offset_micros"))
    )


def event_patterns(signals: DataFrame, within_seconds: int = 7200) -> DataFrame:
    """Flights that show a pattern: two gate changes close together, or a delay before a cancellation."""
    order = ["event_ts", "event_seq"]
    gates = with_running_last(
        signals.filter(F.col("signal") == GATE).select("flight_key", *order),
        ["flight_key"],
        order,
        {"previous_ts": "event_ts"},
        include_current=False,
    )
    gap = epoch_micros(F.col("event_ts")) - epoch_micros(F.col("previous_ts"))
    hopping = (
        gates.filter(gap <= within_seconds * 1_000_000)
        .groupBy("flight_key")
        .agg(F.count(F.lit(1)).alias("n_rapid_gate_changes"))
    )
    first_delay = F.min(F.when(F.col("signal") == DELAY, F.col("event_ts")))
    last_cancel = F.max(F.when(F.col("signal") == CANCEL, F.col("event_ts")))
    delayed = (
        signals.groupBy("flight_key")
        .agg((first_delay < last_cancel).alias("delay_then_cancel"))
        .filter("delay_then_cancel")
    )
    return hopping.join(delayed, "flight_key", "full").select(
        "flight_key",
        F.coalesce("n_rapid_gate_changes", F.lit(0)).alias("n_rapid_gate_changes"),
        F.coalesce("delay_then_cancel", F.lit(False)).alias("delay_then_cancel"),
    )


def connection_slack(legs: DataFrame, execution: DataFrame, tight_minutes: int = 60) -> DataFrame:
    """Minutes between a leg's scheduled arrival plus its delay and the next leg's departure."""
    delays = execution.select("journey_id", "leg", "delay")
    order = Window.partitionBy("journey_id").orderBy("leg")
    slack = seconds_between(F.col("scheduled_arrival"), F.col("next_departure")) / F.lit(60) - F.col("delay")
    return (
        legs.select("journey_id", "leg", "flight_key", "scheduled_departure", "scheduled_arrival")
        .join(delays, ["journey_id", "leg"])
        .withColumn("next_departure", F.lead("scheduled_departure").over(order))
        .filter(F.col("next_departure").isNotNull())
        .withColumn("slack_minutes", slack)
        .select(
            "journey_id",
            "leg",
            "flight_key",
            "slack_minutes",
            (F.col("slack_minutes") < tight_minutes).alias("tight"),
        )
    )


def station_load(flights_with_end: DataFrame) -> DataFrame:
    """Flights open per departure station and hour."""
    hours = F.sequence(
        F.date_trunc("hour", F.col("start_ts").cast("timestamp")),
        F.date_trunc("hour", F.col("end_ts").cast("timestamp")),
        F.expr("interval 1 hour"),
    )
    return (
        flights_with_end.select(F.col("departure_station").alias("station"), F.explode(hours).alias("hour"))
        .groupBy("station", F.col("hour").cast("timestamp_ntz").alias("hour"))
        .agg(F.count(F.lit(1)).alias("n_open"))
    )
