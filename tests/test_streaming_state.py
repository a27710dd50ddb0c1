"""Streams give what the batch operators give, whatever is cut into which micro-batch, and lose no row."""

from __future__ import annotations

import pytest
import rows as r
from compare import rows_of
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flightops.operators import lifecycle
from flightops.operators import signals as sg
from flightops.operators.lifecycle import RUN
from flightops.operators.starts import accepted_starts, rejected_starts
from flightops.plans.queries import Tables
from flightops.streaming.batches import results
from flightops.streaming.journey import close_journeys, stream_journey
from flightops.streaming.lifecycle import close_lifecycle, stream_lifecycle

PARTS = 3


def _rows(frame: DataFrame) -> list[tuple]:
    return rows_of(frame.columns, [tuple(x) for x in frame.collect()])


def _split(frame: DataFrame, ts: str, path: str, parts=range(PARTS)) -> None:
    """One file per stretch of ten days."""
    for part in parts:
        first, last = f"2024-01-{1 + 10 * part:02d}", f"2024-01-{11 + 10 * part:02d}"
        within = F.col(ts) < last if part == 0 else F.col(ts) >= first
        if 0 < part < PARTS - 1:
            within &= F.col(ts) < last
        frame.filter(within).coalesce(1).write.mode("append").parquet(path)


def _stream(spark, path: str) -> DataFrame:
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def _done(query) -> int:
    """Wait for the end; the number of micro-batches run so far."""
    query.awaitTermination(900)
    assert query.exception() is None
    return query.lastProgress["batchId"] + 1


@pytest.fixture(scope="module")
def tables(spark, sf_dir) -> Tables:
    return Tables(spark, sf_dir)


def test_lifecycle_stream_equals_batch_over_a_restart(spark, tables, tmp_path):
    """History equals L5 and the rejects J2 and J3 together; the second run goes on from the first one's checkpoint."""
    starts, signals, folder = f"{tmp_path}/starts", f"{tmp_path}/signals", f"{tmp_path}/job"
    pushed = []

    def run() -> int:
        return _done(
            stream_lifecycle(
                _stream(spark, starts), _stream(spark, signals), folder, f"{tmp_path}/c", 600, True,
                push=lambda rows, batch_id: pushed.append((batch_id, rows.select("flight_key", "current_state", "gate", "delay").collect())),
            )
        )

    for parts in ((0, 1), (2,)):
        _split(tables.flights, "start_ts", starts, parts)
        _split(tables.signals, "event_ts", signals, parts)
        batches = run()
    before = results(spark, folder, "history").count()
    close_lifecycle(spark, tables.flights, tables.signals, folder, batches)

    assert 0 < before < tables.transitions.count()
    assert _rows(results(spark, folder, "history")) == _rows(tables.transitions)
    assert _rows(results(spark, folder, "accepted")) == _rows(tables.accepted)
    unknown = sg.signals_without_flight(tables.signals, tables.flights)
    outside = sg.signals_outside_window(tables.signals, tables.flights_with_end).drop("problem")
    assert _rows(results(spark, folder, "rejected").drop("problem")) == _rows(unknown.unionByName(outside))
    assert results(spark, folder, "late").count() == 0 == results(spark, folder, "refused_starts").count()
    # The last row pushed for a flight is its end.
    latest = {x.flight_key: x.current_state for _, rows in pushed for x in rows}
    latest |= {x.flight_key: x.current_state for x in results(spark, f"{folder}", "updates").filter("as_of_us > 2e17").collect()}
    assert latest == {x.flight_key: x.current_state for x in tables.outcomes.collect()}


def _feed(spark, tmp_path, flights, batches, name="job"):
    """Signals micro-batch by micro-batch; every flight comes with the first, and a far start drives the watermark."""
    starts, signals, folder = (f"{tmp_path}/{name}-{x}" for x in ("starts", "signals", "out"))
    for part, sent in enumerate(batches):
        r.signals(spark, *sent).coalesce(1).write.mode("append").parquet(signals)
        known = flights if part == 0 else flights.limit(0)
        known.coalesce(1).write.mode("append").parquet(starts)
        done = _done(stream_lifecycle(_stream(spark, starts), _stream(spark, signals), folder, f"{tmp_path}/{name}-c", 60, True))
    close_lifecycle(spark, flights, r.signals(spark), folder, done)
    return folder


def _far(spark):
    """A start so far ahead that only the signals' times move the watermark."""
    row = list(r.flight("END"))
    row[9] = r.at(10_000)
    return tuple(row)


def test_a_late_signal_comes_out_once_and_every_row_is_accounted_for(spark, tmp_path):
    flights = r.flights(spark, r.flight("AA1"), r.flight("AA2"), _far(spark))
    batches = [
        [r.delay("AA1", 1, 10, 1), r.gate("AA2", 2, "B1", 2), r.delay("AA1", 5, 20, 3)],
        [r.delay("AA1", 4, 99, 4), r.gate("AA1", 4.5, "G", 5), r.delay("NONE", 7, 1, 6), r.delay("AA1", 9, 30, 7)],
        [r.cancel("AA1", 7, seq=8), r.cancel("AA1", 9.5, seq=9), r.delay("AA1", 12, 40, 10), r.delay("AA2", 30, 5, 11)],
    ]
    folder = _feed(spark, tmp_path, flights, batches)
    seqs = {name: sorted(x[0] for x in results(spark, folder, name).select(
        "sent.event_seq" if name == "late" else "event_seq").collect()) for name in ("late", "accepted", "rejected")}
    # Watermarks after the micro-batches: minute 4 and minute 8; a row at the watermark is late.
    assert seqs == {"late": [4, 8], "accepted": [1, 2, 3, 5, 7, 9], "rejected": [6, 10, 11]}
    problems = {x.event_seq: x.problem for x in results(spark, folder, "rejected").collect()}
    # The run of the last one was settled and closed a micro-batch before.
    assert problems == {6: "no_flight", 10: "after_end", 11: "no_flight"}
    on_time = [s for batch in batches for s in batch if s[5] not in seqs["late"]]
    want = lifecycle.transitions_with_context(flights, r.signals(spark, *on_time))
    assert _rows(results(spark, folder, "history")) == _rows(want)


def test_a_delay_request_pushes_one_row(spark, tmp_path):
    flights = r.flights(spark, r.flight("AA1"), r.flight("AA2"), _far(spark))
    sent = [[r.delay("AA2", 0.1, 1, 0)], [r.delay("AA1", 1.5, 10, 1)], [r.delay("AA2", 2.6, 5, 2)], [r.delay("AA1", 3.8, 7, 3)]]
    folder = _feed(spark, tmp_path, flights, sent)
    pushed = {}
    for x in spark.read.parquet(f"{folder}/out/updates").collect():
        pushed.setdefault(x.batch_id, []).append((x.flight_key, x.current_state, x.delay))
    # Both flights began boarding before the third watermark; before the fourth there is the request alone.
    assert sorted(pushed[2]) == [(r.key("AA1"), "BOARDING", 10), (r.key("AA2"), "BOARDING", 1)]
    assert pushed[3] == [(r.key("AA2"), "BOARDING", 5)]


def _starts(spark):
    """A second start while the first runs, one after the first was cancelled, one right at an end."""
    def begun(number, minutes):
        row = list(r.flight(number))
        row[9] = r.at(minutes)
        return tuple(row)

    starts = r.flights(
        spark, begun("AA1", 0), begun("AA1", 5), begun("AA1", 5), begun("AA2", 0), begun("AA2", 4), begun("AA2", 8),
        begun("AA3", 0), begun("AA3", 15), begun("AA3", 15.1),
    )
    return starts, r.signals(spark, r.cancel("AA2", 2, seq=1), r.delay("AA2", 5, 33, 2), r.gate("AA3", 20, "Z", 3))


def test_a_second_start_counts_only_after_the_end_of_the_first(spark):
    starts, signals = _starts(spark)
    refused = [(x.flight_key, x.start_ts, x.running_since, x.running_until) for x in rejected_starts(starts, signals).collect()]
    assert sorted(refused) == sorted([
        (r.key("AA1"), r.at(5), r.at(0), r.at(15)), (r.key("AA1"), r.at(5), r.at(0), r.at(15)),
        (r.key("AA2"), r.at(8), r.at(4), r.at(19)), (r.key("AA3"), r.at(15), r.at(0), r.at(15)),
    ])
    kept = accepted_starts(starts, signals)
    history = lifecycle.transitions_with_context(kept, signals, RUN)
    rows = {}
    for x in history.orderBy("timestamp").collect():
        rows.setdefault(x.flight_key, []).append((x.to_state, x.delay, x.gate))
    assert [len(rows[r.key(n)]) for n in ("AA1", "AA2", "AA3")] == [6, 3 + 6, 12]
    assert [x[1] for x in rows[r.key("AA2")]] == [0, 0, 0, 0, 33, 33, 33, 33, 33]
    assert [x[2] for x in rows[r.key("AA3")]][6:] == ["A1", "A1", "A1", "Z", "Z", "Z"]


def test_the_stream_refuses_the_same_starts(spark, tmp_path):
    starts, signals = _starts(spark)
    paths = {name: f"{tmp_path}/{name}" for name in ("starts", "signals")}
    for frame, ts, name in ((starts, "start_ts", "starts"), (signals, "event_ts", "signals")):
        for low, high in ((-1, 4.5), (4.5, 100)):
            frame.filter((F.col(ts) >= r.at(low)) & (F.col(ts) < r.at(high))).coalesce(1).write.mode("append").parquet(paths[name])
    folder = f"{tmp_path}/job"
    done = _done(stream_lifecycle(_stream(spark, paths["starts"]), _stream(spark, paths["signals"]), folder, f"{tmp_path}/c", 1, True))
    close_lifecycle(spark, starts, signals, folder, done)
    assert _rows(results(spark, folder, "refused_starts").select("flight_key", "start_ts")) == _rows(
        rejected_starts(starts, signals).select("flight_key", "start_ts"))
    assert _rows(results(spark, folder, "history")) == _rows(lifecycle.transitions_with_context(accepted_starts(starts, signals), signals, RUN))


def test_journey_stream_equals_batch(spark, tables, tmp_path):
    """Topic signals, keyed by flight, in; the batch execution and history out, and the rejected cancellations."""
    journeys = tables.view("journeys").withColumn("start_ts", F.col("legs")[0]["start_ts"])
    cancels = tables.view("journey_signals")
    paths = {name: f"{tmp_path}/{name}" for name in ("journeys", "signals", "cancels")}
    for frame, ts, name in ((journeys, "start_ts", "journeys"), (tables.signals, "event_ts", "signals"), (cancels, "event_ts", "cancels")):
        _split(frame, ts, paths[name])
    folder = f"{tmp_path}/job"
    inputs = [_stream(spark, paths[name]) for name in ("journeys", "signals", "cancels")]
    done = _done(stream_journey(*inputs, folder, f"{tmp_path}/c", own_time=True, available_now=True))
    settled = results(spark, folder, "execution").count()
    close_journeys(spark, journeys, tables.signals, cancels, folder, done, own_time=True)
    assert 0 < settled < tables.execution.count()
    assert _rows(results(spark, folder, "execution")) == _rows(tables.execution)
    transitions = results(spark, folder, "transitions")
    from flightops.operators.journeys import rejected_journey_signals, transitions_of_run

    assert _rows(transitions) == _rows(transitions_of_run(tables.journey_run))
    late = results(spark, folder, "late").filter("kind = 'cancellation'").select("cancelled.*", F.lit("late").alias("problem"))
    rejected = results(spark, folder, "rejected_cancellations").unionByName(late)
    assert _rows(rejected.drop("problem")) == _rows(rejected_journey_signals(cancels, tables.scheduled).drop("problem"))
    unknown = sg.signals_without_flight(tables.signals, tables.flights)
    assert _rows(results(spark, folder, "rejected").filter("problem = 'no_leg'").drop("problem")) == _rows(unknown)
