"""The flight lifecycle as a stream: starts and signals in; history, verdicts and live rows out.

Every micro-batch settles the rows that the watermark has reached. A settled signal's verdict is final: whether a
cancellation ended its flight before depends only on earlier signals, and those are settled too. Accepted signals are
reduced per slot in the JVM, as in the batch fold, and merged into the states of the open runs: one row of fixed size
per run. Entries that the watermark has passed become history rows. So the outputs are those of the batch operators over all
rows that were not late, whatever micro-batch brought which row, and a hot flight is spread over the tasks.

A job's tables (`batches.results`):

* `history`: the rows of the stored history,
* `accepted`, `rejected` (with `problem`: before_start, after_end, or no_flight if no run was open any more): every
  settled signal is in one of them,
* `refused_starts`: starts of a flight under way,
* `updates`: per micro-batch the current row of each flight that changed,
* `late`: rows behind the watermark, of either kind.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, StructType

from flightops.operators.lifecycle import (
    PLANNED,
    RUN,
    STATE_COLUMNS,
    fold_of_states,
    slot_states,
    states_of_slots,
    transitions_of_fold,
    with_slot,
)
from flightops.operators.skew import behind_own_exchange
from flightops.operators.starts import select_starts
from flightops.schemas import CANCEL, DEFAULT_DELAY
from flightops.streaming.batches import MicroBatch, as_time, close_job, due_rows, run_job

Push = Callable[[DataFrame, int], None]
_STARTS, _SIGNALS = "start", "signal"


def lifecycle_rows(starts: DataFrame, signals: DataFrame) -> DataFrame:
    """Both inputs as one stream (kind, ts, start, sent)."""
    begun = starts.select(F.lit(_STARTS).alias("kind"), F.col("start_ts").alias("ts"), F.struct(*starts.columns).alias("start"))
    sent = signals.select(F.lit(_SIGNALS).alias("kind"), F.col("event_ts").alias("ts"), F.struct(*signals.columns).alias("sent"))
    return begun.unionByName(sent, allowMissingColumns=True)


def _with_states(runs: DataFrame, found: DataFrame, keys: tuple[str, ...] = RUN) -> DataFrame:
    """Runs whose states are put together with what this micro-batch found for them; `signalled` tells if it did."""
    renamed = found.select(*keys, *[F.col(c).alias(f"new_{c}") for c in STATE_COLUMNS], F.lit(True).alias("signalled"))
    joined = runs.join(behind_own_exchange(renamed, keys[0]), list(keys), "left")
    merged = {c: (F.least if c == "cancel_slot" else F.greatest)(c, f"new_{c}") for c in STATE_COLUMNS}
    return joined.withColumns(merged).select(*runs.columns, F.coalesce("signalled", F.lit(False)).alias("signalled"))


def _verdicts(signals: DataFrame, runs: DataFrame) -> DataFrame:
    """`signals` with `run` (start_ts, end_ts, phase_seconds) of the run each meets, null if none, and `problem`.

    A key's runs are few and arrive as one row, so the signals, which may be many, stay on the side that can be split.
    """
    spans = runs.groupBy("flight_key").agg(F.collect_list(F.struct("start_ts", "end_ts", "phase_seconds")).alias("runs"))
    joined = signals.join(behind_own_exchange(spans, "flight_key"), "flight_key", "left")
    meets = F.filter("runs", lambda x: F.col("event_ts").between(x["start_ts"], x["end_ts"]))
    first = F.array_min(F.transform("runs", lambda x: x["start_ts"]))
    problem = F.when(F.col("runs").isNull(), "no_flight").when(F.col("event_ts") < first, "before_start").otherwise("after_end")
    return joined.withColumn("run", F.get(meets, F.lit(0))).withColumn("problem", F.when(F.col("run").isNull(), problem)).drop("runs")


def _state_schema(flight: StructType, states: StructType) -> StructType:
    schema = StructType(list(flight.fields))
    for name in STATE_COLUMNS:
        schema = schema.add(name, states[name].dataType)
    return schema.add("next", IntegerType())


def settle_lifecycle(
    batch: MicroBatch, rows: DataFrame, delay_seconds: int, last: bool = False, push: Push | None = None
) -> None:
    """One micro-batch of `lifecycle_rows`."""
    flight, signal = (rows.schema[name].dataType for name in ("start", "sent"))
    due, watermark = due_rows(batch, rows, (_STARTS, _SIGNALS), delay_seconds, last)
    due = batch.keep("due", due)
    starts = due.filter(F.col("kind") == _STARTS).select("start.*")
    signals = due.filter(F.col("kind") == _SIGNALS).select("sent.*")
    cancels = signals.filter(F.col("signal") == CANCEL)

    # Which runs there are: the open ones, whose end may have come nearer, and the starts that meet none of them.
    nothing = slot_states(starts, signals, RUN).schema
    running = batch.before("open", _state_schema(flight, nothing))
    ends = fold_of_states(_with_states(running, slot_states(running, cancels, RUN)), [*flight.names, "next"])
    busy = batch.keep("busy", ends.select(*flight.names, "end_ts"))
    accepted, refused = select_starts(starts, cancels, busy.select("flight_key", "end_ts"))
    batch.put("refused_starts", refused)
    fresh = [F.lit(None).cast(nothing[c].dataType).alias(c) for c in STATE_COLUMNS]
    runs = running.unionByName(accepted.select(*flight.names, *fresh, F.lit(0).alias("next")))
    spans = busy.select(*RUN, "end_ts").unionByName(accepted.select(*RUN, "end_ts"))

    judged = batch.keep("judged", _verdicts(signals, spans))
    batch.put("accepted", judged.filter("run is not null").select(*signal.names))
    batch.put("rejected", judged.filter("run is null").select(*signal.names, "problem"))
    met = judged.filter("run is not null").select(*signal.names, "run.start_ts", "run.phase_seconds")
    merged = batch.keep("merged", _with_states(runs, states_of_slots(with_slot(met), RUN)))

    # How far each run is: the last entry that the watermark has passed, or its end.
    folded = fold_of_states(merged, [*flight.names, *STATE_COLUMNS[1:], "next", "signalled"])
    passed = F.size(F.filter("entered", lambda time: time <= as_time(watermark))) - 1
    folded = folded.withColumn("upto", F.least(passed, F.col("end_slot")))
    batch.put("history", transitions_of_fold(folded.filter("upto >= next"), "next", "upto"))
    still = folded.filter("upto < end_slot").withColumn("next", F.greatest("next", F.col("upto") + 1))
    batch.keep("open", still.select(*flight.names, *STATE_COLUMNS, "next"))

    reached = F.greatest("upto", F.lit(0))
    state = F.when(reached == F.col("cancel_slot"), "CANCELLED").otherwise(F.get(F.array(*[F.lit(s) for s in PLANNED]), reached))
    updates = batch.put(
        "updates",
        folded.filter("signalled or upto >= next").select(
            "flight_key",
            "flight_number",
            state.alias("current_state"),
            F.coalesce(F.get("gates", F.col("end_slot")), "gate").alias("gate"),
            F.coalesce(F.get("delays", F.col("end_slot")), F.lit(DEFAULT_DELAY)).alias("delay"),
            "aircraft",
            F.lit(watermark).cast("bigint").alias("as_of_us"),
        ),
    )
    if push is not None:
        push(updates, batch.batch_id)


def stream_lifecycle(
    starts: DataFrame,
    signals: DataFrame,
    folder: str,
    checkpoint: str,
    delay_seconds: int = 600,
    available_now: bool = False,
    push: Push | None = None,
) -> StreamingQuery:
    """Fold streams of flights (by `start_ts`) and signals (by `event_ts`) into the tables of `folder`.

    `push` is handed the changed flights of every micro-batch and its number.
    """

    def settle(batch: MicroBatch, rows: DataFrame, last: bool) -> None:
        settle_lifecycle(batch, rows, delay_seconds, last, push)

    return run_job(lifecycle_rows(starts, signals), settle, folder, checkpoint, available_now)


def close_lifecycle(spark: SparkSession, starts: DataFrame, signals: DataFrame, folder: str, batches: int) -> None:
    """Settle all that is still open after `batches` micro-batches; the two frames give the inputs' schemas."""
    schema = lifecycle_rows(starts, signals).schema
    close_job(spark, schema, lambda batch, rows, last: settle_lifecycle(batch, rows, 0, last), folder, batches)
