"""The lifecycle of a flight as one fold over its signals.

A flight's six state-entry times follow from its start and its five phase lengths, so each
signal can be given the *slot* of the first entry time at or after it, on its own, once it is
joined with its flight. A slot needs to keep only its last delay, its last gate and whether a
cancellation fell into it. That makes the whole fold one join and one aggregation with a
bounded row per flight: no window over a flight's signals, however many there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flightops.functions.describe import transition_details
from flightops.functions.keys import state_ordinal
from flightops.functions.times import micros, timestamp_lit
from flightops.operators.ordered import with_running_last
from flightops.schemas import CANCEL, CANCEL_BOUNDARIES, DEFAULT_DELAY, DELAY, GATE, PHASES, STATES

SLOTS = range(PHASES + 1)
PLANNED = STATES[: PHASES + 1]


def _elapsed(phases: int) -> str:
    """SQL text: seconds from the start to the end of the first `phases` phases."""
    return " + ".join(["0", *[f"element_at(phase_seconds, {p})" for p in range(1, phases + 1)]])


# SQL texts of the planned entry time of each state.
_ENTRY_TIMES = ["start_ts", *[f"timestampadd(SECOND, {_elapsed(i)}, start_ts)" for i in SLOTS[1:]]]
_STATE_LIST = "array(" + ", ".join(f"'{state}'" for state in PLANNED) + ")"


def phase_timeline(flights: DataFrame) -> DataFrame:
    """Planned entry into each of the six states, one row each."""
    rows = ", ".join(f"named_struct('ordinal', {i}, 'state', '{PLANNED[i]}', 'entered_at', {_ENTRY_TIMES[i]})" for i in SLOTS)
    return flights.selectExpr("flight_key", f"inline(array({rows})) as (ordinal, state, entered_at)")


def total_duration(flights: DataFrame) -> DataFrame:
    total = F.aggregate("phase_seconds", F.lit(0), lambda acc, x: acc + x)
    return flights.select("flight_key", total.alias("total_seconds"))


def _slotted(flights: DataFrame, signals: DataFrame) -> DataFrame:
    """Signals inside their flight's planned span with their slot. One row per signal at most."""
    return with_slot(signals.join(flights.select("flight_key", "start_ts", "phase_seconds"), "flight_key"))


def with_slot(joined: DataFrame) -> DataFrame:
    """Rows that carry a signal and its flight's start and phases, if inside the planned span, with their slot."""
    offset = f"({micros('event_ts')} - {micros('start_ts')})"
    ends = [f"1000000L * ({_elapsed(i)})" for i in SLOTS]
    passed = " + ".join(f"cast({offset} > {end} as int)" for end in ends[:PHASES])
    return joined.filter(f"{offset} between 0 and {ends[PHASES]}").withColumn("slot", F.expr(passed))


def _cancel_slot() -> Column:
    """Slot at whose entry time a cancellation in `slot` takes effect; null if it never does."""
    return F.when(F.col("slot") <= CANCEL_BOUNDARIES, F.greatest(F.col("slot"), F.lit(1)))


def effective_cancellations(flights: DataFrame, signals: DataFrame) -> DataFrame:
    """Flights that get cancelled: first effective signal, boundary it takes effect at, state left."""
    cancels = _slotted(flights, signals.filter(F.col("signal") == CANCEL))
    first = (
        cancels.withColumn("cancel_slot", _cancel_slot())
        .filter(F.col("cancel_slot").isNotNull())
        .groupBy("flight_key")
        .agg(F.min("event_ts").alias("cancel_ts"), F.min("cancel_slot").alias("cancel_slot"))
    )
    bounded = flights.select("flight_key", "start_ts", "phase_seconds").join(first, "flight_key")
    return bounded.select(
        "flight_key",
        "cancel_ts",
        F.expr(f"get(array({', '.join(_ENTRY_TIMES)}), cancel_slot) as effective_ts"),
        F.expr(f"get({_STATE_LIST}, cancel_slot - 1) as from_state"),
    )


# What a run of a flight keeps of its signals: the boundary it is cancelled at and, for each slot, the last
# delay and gate with their place in the order of events. Two of these rows merge into one by `merged_states`.
RUN = ("flight_key", "start_ts", "phase_seconds")
_DELAYS, _GATES = [f"_d{i}" for i in SLOTS], [f"_g{i}" for i in SLOTS]
STATE_COLUMNS = ("cancel_slot", *_DELAYS, *_GATES)


def states_of_slots(slotted: DataFrame, keys: tuple[str, ...] = ("flight_key",)) -> DataFrame:
    """One row per `keys` with STATE_COLUMNS. Reduced per slot first, so that a hot key is spread over the tasks before."""

    def last(kind: str, value: str, name: str) -> Column:
        there = (F.col("signal") == kind) & F.col(value).isNotNull()
        return F.max(F.when(there, F.struct("event_ts", "event_seq", F.col(value).alias("value")))).alias(name)

    per_slot = slotted.groupBy(*keys, "slot").agg(
        last(DELAY, "delay_minutes", "d"), last(GATE, "gate", "g"), F.max(F.col("signal") == CANCEL).alias("cancelled")
    )
    return per_slot.groupBy(*keys).agg(
        F.min(F.when(F.col("cancelled"), _cancel_slot())).alias("cancel_slot"),
        *[F.max(F.when(F.col("slot") == i, F.col("d"))).alias(_DELAYS[i]) for i in SLOTS],
        *[F.max(F.when(F.col("slot") == i, F.col("g"))).alias(_GATES[i]) for i in SLOTS],
    )


def slot_states(flights: DataFrame, signals: DataFrame, keys: tuple[str, ...] = ("flight_key",)) -> DataFrame:
    """The states of flights that have signals inside their planned span."""
    return states_of_slots(_slotted(flights, signals), keys)


def merged_states(states: DataFrame, keys: tuple[str, ...] = RUN) -> DataFrame:
    """Partial states of the same keys put together; their order does not matter."""
    return states.groupBy(*keys).agg(
        F.min("cancel_slot").alias("cancel_slot"), *[F.max(c).alias(c) for c in (*_DELAYS, *_GATES)]
    )


def fold_of_states(rows: DataFrame, columns: list[str]) -> DataFrame:
    """`columns` of `rows`, which carry STATE_COLUMNS, and the fold of `fold_flights`."""

    def in_force(names: list[str]) -> str:
        """Latest value at each entry: that of the own slot, else of the slot before, …"""
        latest = (", ".join(names[j] for j in range(i, -1, -1)) for i in SLOTS)
        return "array(" + ", ".join(f"coalesce({values}).value" for values in latest) + ")"

    return rows.selectExpr(
        *columns,
        "cancel_slot",
        f"coalesce(cancel_slot, {PHASES}) as end_slot",
        f"array({', '.join(_ENTRY_TIMES)}) as entered",
        f"{in_force(_GATES)} as gates",
        f"{in_force(_DELAYS)} as delays",
    ).selectExpr("*", "get(entered, end_slot) as end_ts")


def fold_flights(flights: DataFrame, signals: DataFrame, keys: tuple[str, ...] = ("flight_key",)) -> DataFrame:
    """`flights` plus the folded signals, still one row per flight.

    Adds `cancel_slot`, `end_slot` and `end_ts`, and the arrays `entered` (entry times),
    `gates` and `delays` (values in force at each entry, null if never signalled). A slot's
    values count for an entry only up to `end_slot`; later signals find the flight closed. A
    signal without its value changes nothing. Where keys have several runs, `keys` is RUN.
    """
    return fold_of_states(flights.join(slot_states(flights, signals, keys), list(keys), "left"), flights.columns)


def flights_with_end(flights: DataFrame, signals: DataFrame) -> DataFrame:
    """`flights` plus `end_ts`. Only cancellations can move the end, so only they are joined."""
    cancels = signals.filter(F.col("signal") == CANCEL)
    slots = _slotted(flights, cancels).groupBy("flight_key").agg(F.min(_cancel_slot()).alias("cancel_slot"))
    end = f"get(array({', '.join(_ENTRY_TIMES)}), coalesce(cancel_slot, {PHASES})) as end_ts"
    return flights.join(slots, "flight_key", "left").selectExpr(*flights.columns, end)


def transitions_of_fold(folded: DataFrame, first: str = "0", last: str = "end_slot", also: tuple[str, ...] = ()) -> DataFrame:
    """History rows of folded flights: the planned entries up to the end, CANCELLED if cut short.

    `first` and `last` narrow the entries, as SQL over a folded row; `also` are columns to keep.
    """
    rows = ", ".join(
        f"""named_struct(
            'from_state', {f"'{PLANNED[i - 1]}'" if i else "cast(null as string)"},
            'to_state', if(cancel_slot = {i}, 'CANCELLED', '{PLANNED[i]}'),
            'timestamp', entered[{i}], 'gate', coalesce(gates[{i}], gate, ''),
            'delay', coalesce(delays[{i}], {DEFAULT_DELAY}))"""
        for i in SLOTS
    )
    happened = f"inline(slice(array({rows}), {first} + 1, {last} - {first} + 1)) as (from_state, to_state, timestamp, gate, delay)"
    return folded.selectExpr("flight_key", "flight_number", "flight_date", "aircraft", *also, happened).select(
        F.concat_ws(":", "flight_key", "to_state").alias("id"),
        "flight_key",
        "flight_number",
        "flight_date",
        "from_state",
        "to_state",
        "timestamp",
        "gate",
        "delay",
        "aircraft",
        F.lit("STATE_TRANSITION").alias("event_type"),
        transition_details(F.col("from_state"), F.col("to_state")).alias("event_details"),
        *also,
    )


def flight_transitions(flights: DataFrame, signals: DataFrame) -> DataFrame:
    """Which states each flight really entered, when, and from where."""
    cancels = signals.filter(F.col("signal") == CANCEL)
    return transitions_of_fold(fold_flights(flights, cancels)).select(
        "flight_key", "flight_number", "flight_date", "from_state", "to_state", "timestamp"
    )


def transitions_with_context(flights: DataFrame, signals: DataFrame, keys: tuple[str, ...] = ("flight_key",)) -> DataFrame:
    """The same rows with the gate and delay in force at that moment: the history table."""
    return transitions_of_fold(fold_flights(flights, signals, keys))


def flight_details(flights: DataFrame, signals: DataFrame, as_of) -> DataFrame:
    """Every flight as seen at `as_of`: state (null before the start), last delay, last gate."""
    at = timestamp_lit(as_of)
    folded = fold_flights(flights, signals.filter(F.col("event_ts") <= at))
    entered = F.size(F.filter("entered", lambda time: time <= at))
    reached = F.least(entered - 1, F.col("end_slot"))
    state = F.when(reached == F.col("cancel_slot"), "CANCELLED").otherwise(
        F.get(F.expr(_STATE_LIST), F.when(reached >= 0, reached))
    )
    return folded.select(
        "flight_key",
        "flight_number",
        "flight_date",
        "departure_station",
        "arrival_station",
        "scheduled_departure",
        "scheduled_arrival",
        state.alias("current_state"),
        F.coalesce(F.get("gates", F.col("end_slot")), "gate").alias("gate"),
        "aircraft",
        F.coalesce(F.get("delays", F.col("end_slot")), F.lit(DEFAULT_DELAY)).alias("delay"),
        "start_ts",
    )


def flight_outcome(flights: DataFrame, signals: DataFrame) -> DataFrame:
    """Every flight after its end. Only a positive delay replaces the flight's own."""
    own_delay = F.col("delay") if "delay" in flights.columns else F.lit(DEFAULT_DELAY)
    last_delay = F.get("delays", F.col("end_slot"))
    return fold_flights(flights, signals).select(
        "flight_key",
        "flight_number",
        "flight_date",
        "departure_station",
        "arrival_station",
        "scheduled_departure",
        "scheduled_arrival",
        F.when(F.col("cancel_slot").isNotNull(), "CANCELLED").otherwise("COMPLETED").alias("current_state"),
        F.coalesce(F.get("gates", F.col("end_slot")), "gate").alias("gate"),
        "aircraft",
        F.when(last_delay > 0, last_delay).otherwise(own_delay).alias("delay"),
        "end_ts",
    )


def latest_signals(signals: DataFrame) -> DataFrame:
    """Per flight: last delay, last gate, first cancellation, last reason."""
    order = F.struct("event_ts", "event_seq")

    def last(kind: str, value: str, name: str) -> Column:
        return F.max_by(value, F.when(F.col("signal") == kind, order)).alias(name)

    return signals.groupBy("flight_key").agg(
        last(DELAY, "delay_minutes", "last_delay"),
        last(GATE, "gate", "last_gate"),
        F.min(F.when(F.col("signal") == CANCEL, F.col("event_ts"))).alias("first_cancel_ts"),
        last(CANCEL, "reason", "last_reason"),
    )


def transition_order_violations(rows: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Rows whose state is not after the one before it; CANCELLED may follow any state.

    `rows` is a state feed (flight_key, to_state, timestamp, …) that need not be sound, so a
    key may hold any number of rows; `order` must be unique within a key.
    """
    order = order or ["timestamp", "id"]
    ranked = rows.withColumn("ordinal", state_ordinal(F.col("to_state")))
    return (
        with_running_last(
            ranked,
            ["flight_key"],
            order,
            {"previous_ordinal": "ordinal", "previous_to_state": "to_state"},
            include_current=False,
            once=True,
        )
        .filter((F.col("ordinal") <= F.col("previous_ordinal")) & (F.col("to_state") != "CANCELLED"))
        .drop("ordinal", "previous_ordinal")
    )
