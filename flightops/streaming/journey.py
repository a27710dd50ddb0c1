"""Journeys as a stream: journeys, flight-keyed signals and journey cancellations in, leg results out.

Signals are those of the topic: they name a flight, not a journey. An open journey's legs, whose start times follow from
the legs before, are the dimension that the settled signals are routed by. A signal is reduced per run of
its flight and slot first, and the reduced rows are handed to every leg that shares the run. A journey is settled
when the watermark has passed all that can change one of its legs; then the batch operators finish it from the states.

A job's tables (`batches.results`): `execution`, `transitions`, `rejected` (signals that meet no leg),
`rejected_cancellations`, `refused_journeys` (a journey that is open already), `late`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from flightops.functions.times import plus_seconds
from flightops.operators import journeys as legs_of
from flightops.operators.lifecycle import RUN, STATE_COLUMNS, slot_states, states_of_slots, with_slot
from flightops.operators.skew import behind_own_exchange
from flightops.schemas import TURNAROUND_SECONDS
from flightops.streaming.batches import MicroBatch, as_time, close_job, due_rows, run_job
from flightops.streaming.lifecycle import _with_states

_JOURNEYS, _SIGNALS, _CANCELS = "journey", "signal", "cancellation"
_CANCELLED = "journey_id string, journey_cancel_ts timestamp_ntz"


def journey_rows(journeys: DataFrame, signals: DataFrame, journey_signals: DataFrame) -> DataFrame:
    """The inputs as one stream (kind, ts, journey, sent, cancelled). Journeys without legs have no time and stay out."""
    begun = journeys.filter(F.size("legs") > 0).select(
        F.lit(_JOURNEYS).alias("kind"), F.get("legs", F.lit(0))["start_ts"].alias("ts"), F.struct("journey_id", "legs").alias("journey")
    )
    sent = signals.select(F.lit(_SIGNALS).alias("kind"), F.col("event_ts").alias("ts"), F.struct(*signals.columns).alias("sent"))
    cancelled = journey_signals.select(
        F.lit(_CANCELS).alias("kind"), F.col("event_ts").alias("ts"), F.struct(*journey_signals.columns).alias("cancelled")
    )
    return begun.unionByName(sent, allowMissingColumns=True).unionByName(cancelled, allowMissingColumns=True)


def _scheduled(journeys: DataFrame, turnaround_seconds: int, own_time: bool) -> DataFrame:
    """Legs with `done_ts`: when all that can change a leg of the journey has happened."""
    legs = legs_of.leg_runs(legs_of.journey_schedule(journeys, turnaround_seconds), own_time)
    length = F.aggregate("phase_seconds", F.lit(0).cast("bigint"), lambda acc, x: acc + x)
    ends = F.greatest(plus_seconds(F.col("leg_start"), length), plus_seconds(F.col("start_ts"), length))
    return legs.withColumn("done_ts", F.max(ends).over(Window.partitionBy("journey_id")))


def _routed(signals: DataFrame, legs: DataFrame) -> DataFrame:
    """`signals` with the runs of their flight whose planned span they meet (`met`), and `problem` if there is none.

    A flight has few different runs, however many journeys share one.
    """
    length = F.aggregate("phase_seconds", F.lit(0).cast("bigint"), lambda acc, x: acc + x)
    runs = legs.select(*RUN).distinct().withColumn("end_ts", plus_seconds(F.col("start_ts"), length))
    spans = runs.groupBy("flight_key").agg(F.collect_list(F.struct("start_ts", "end_ts", "phase_seconds")).alias("runs"))
    joined = signals.join(behind_own_exchange(spans, "flight_key"), "flight_key", "left")
    met = F.filter("runs", lambda x: F.col("event_ts").between(x["start_ts"], x["end_ts"]))
    problem = F.when(F.col("runs").isNull(), "no_leg").when(F.size(met) == 0, "outside_leg")
    return joined.select(*signals.columns, met.alias("met"), problem.alias("problem"))


def settle_journeys(
    batch: MicroBatch, rows: DataFrame, delay_seconds: int, turnaround_seconds: int, own_time: bool, last: bool = False
) -> None:
    """One micro-batch of `journey_rows`."""
    signal, cancel = (rows.schema[name].dataType for name in ("sent", "cancelled"))
    due, watermark = due_rows(batch, rows, (_JOURNEYS, _SIGNALS, _CANCELS), delay_seconds, last)
    due = batch.keep("due", due)
    sent = due.filter(F.col("kind") == _JOURNEYS).select("journey.*")
    signals = due.filter(F.col("kind") == _SIGNALS).select("sent.*")
    cancels = due.filter(F.col("kind") == _CANCELS).select("cancelled.*")

    planned = _scheduled(sent, turnaround_seconds, own_time)
    nothing = slot_states(planned, signals, RUN).schema
    schema = StructType(list(planned.schema.fields))
    for name in STATE_COLUMNS:
        schema = schema.add(name, nothing[name].dataType)
    running = batch.before("legs", schema)
    once = Window.partitionBy("journey_id").orderBy(F.get("legs", F.lit(0))["start_ts"], F.xxhash64("legs"))
    numbered = sent.withColumn("__n", F.row_number().over(once))
    numbered = numbered.join(running.select("journey_id", F.lit(1).alias("__open")).distinct(), "journey_id", "left")
    counts = F.col("__open").isNull() & (F.col("__n") == 1)
    batch.put("refused_journeys", numbered.filter(~counts).select(*sent.columns))
    begun = _scheduled(numbered.filter(counts).select(*sent.columns), turnaround_seconds, own_time)
    fresh = [F.lit(None).cast(nothing[c].dataType).alias(c) for c in STATE_COLUMNS]
    legs = batch.keep("begun", running.unionByName(begun.select("*", *fresh)))

    routed = batch.keep("routed", _routed(signals, legs))
    batch.put("rejected", routed.filter("problem is not null").select(*signal.names, "problem"))
    met = routed.filter("problem is null").select(*signal.names, F.inline("met"))
    legs = batch.keep("merged", _with_states(legs, states_of_slots(with_slot(met), RUN)).drop("signalled"))

    # A cancellation before the start reaches nothing; of the others the first counts.
    batch.put("rejected_cancellations", legs_of.rejected_journey_signals(cancels, legs).select(*cancel.names, "problem"))
    taken = legs_of.accepted_journey_signals(cancels, legs).select("journey_id", F.col("event_ts").alias("journey_cancel_ts"))
    taken = batch.before("cancelled", _CANCELLED).unionByName(taken)
    taken = batch.keep("taken", taken.groupBy("journey_id").agg(F.min("journey_cancel_ts").alias("journey_cancel_ts")))

    done = F.lit(False) if watermark is None else F.col("done_ts") <= as_time(watermark)
    closed, still = legs.filter(done), legs.filter(~done)
    columns = [c for c in planned.columns if c != "done_ts"]
    outcomes = legs_of.outcomes_of_legs(closed.drop("done_ts"), columns)
    finished = legs_of.cascade_cancellations(outcomes, taken.withColumnRenamed("journey_cancel_ts", "event_ts"))
    finished = batch.keep("finished", legs_of.aircraft_handoff(finished))
    batch.put("execution", legs_of.execution_of(finished))
    batch.put("transitions", legs_of.transitions_of_run(finished))
    batch.keep("legs", still)
    batch.keep("cancelled", taken.join(still.select("journey_id").distinct(), "journey_id", "left_semi"))


def stream_journey(
    journeys: DataFrame,
    signals: DataFrame,
    journey_signals: DataFrame,
    folder: str,
    checkpoint: str,
    delay_seconds: int = 600,
    turnaround_seconds: int = TURNAROUND_SECONDS,
    own_time: bool = False,
    available_now: bool = False,
) -> StreamingQuery:
    """Run journeys (nested rows, by their first leg's start), topic signals and journey cancellations into `folder`.

    `own_time` as in the batch operators: whether signals refer to the flight's own start or to its leg's.
    """

    def settle(batch: MicroBatch, rows: DataFrame, last: bool) -> None:
        settle_journeys(batch, rows, delay_seconds, turnaround_seconds, own_time, last)

    return run_job(journey_rows(journeys, signals, journey_signals), settle, folder, checkpoint, available_now)


def close_journeys(
    spark: SparkSession,
    journeys: DataFrame,
    signals: DataFrame,
    journey_signals: DataFrame,
    folder: str,
    batches: int,
    turnaround_seconds: int = TURNAROUND_SECONDS,
    own_time: bool = False,
) -> None:
    """Settle all that is still open after `batches` micro-batches; the frames give the inputs' schemas."""
    schema = journey_rows(journeys, signals, journey_signals).schema
    close_job(spark, schema, lambda batch, rows, last: settle_journeys(batch, rows, 0, turnaround_seconds, own_time, last), folder, batches)
