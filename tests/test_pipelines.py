from __future__ import annotations

import json

import pytest
import rows as r
from compare import rows_of
from pyspark.sql import functions as F

from flightops.operators import analytics, enrich, history, lifecycle
from flightops.operators.signals import dedup_replayed_events, events_to_signals
from flightops.plans.queries import Tables
from flightops.sources import stores
from flightops.sources.events import parse_flight_events, read_flight_events
from flightops.streaming import pipelines


@pytest.fixture(scope="module")
def tables(spark, sf_dir) -> Tables:
    return Tables(spark, sf_dir)


@pytest.fixture(scope="module")
def raw_folder(tables, tmp_path_factory) -> str:
    """The raw messages in three files."""
    path = str(tmp_path_factory.mktemp("raw") / "messages")
    tables.view("raw_messages").repartition(3).write.parquet(path)
    return path


def _stream(spark, folder: str):
    return read_flight_events(spark, folder, streaming=True)


def _rows(frame):
    return rows_of(frame.columns, [tuple(x) for x in frame.collect()])


def _finish(query):
    query.awaitTermination(300)
    assert query.exception() is None


def _to_memory(spark, frame, name: str, mode: str = "append"):
    query = frame.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    _finish(query)
    return spark.table(name)


def test_enrichment_stream_equals_batch(spark, tables, raw_folder):
    stamp = "2026-01-27 10:30:00"
    streamed = _to_memory(spark, pipelines.stream_enrich(_stream(spark, raw_folder), stamp=stamp), "enriched")
    batch = enrich.enriched_events(parse_flight_events(tables.view("raw_messages")), stamp=stamp)
    assert _rows(streamed) == _rows(batch)


def test_enriched_messages_are_plain_events_again(spark, tables, raw_folder, tmp_path):
    _finish(pipelines.write_enriched(_stream(spark, raw_folder), f"{tmp_path}/c", available_now=True, path=f"{tmp_path}/out"))
    hop = read_flight_events(spark, f"{tmp_path}/out", "json")
    assert _rows(parse_flight_events(hop)) == _rows(parse_flight_events(tables.view("raw_messages")))
    body = json.loads(hop.filter("value like '%delayMinutes%'").first().value)
    assert list(body) == ["eventType", "flightNumber", "flightDate", "data", "estimatedDelay", "riskScore",
                          "enrichedTimestamp"]


def test_replays_are_dropped_in_a_stream(spark, tables, tmp_path):
    replayed = tables.view("replayed_events").withColumn("event_ts", F.col("event_ts").cast("timestamp"))
    replayed.repartition(2).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(replayed.schema).parquet(f"{tmp_path}/in")
    kept = _to_memory(spark, dedup_replayed_events(stream, "60 days"), "deduped")
    assert kept.count() == kept.select("event_seq").distinct().count() == tables.events.count()


def test_store_ignores_replayed_rows(spark, tmp_path):
    flights = r.flights(spark, r.flight("AA1"), r.flight("AA2"))
    moves = lifecycle.transitions_with_context(flights, r.signals(spark, r.cancel("AA2", 2)))
    path = f"{tmp_path}/history"
    stores.write_transitions(moves.filter("flight_number = 'AA1'"), path)
    stores.write_transitions(moves, path)
    stores.write_transitions(moves.unionByName(moves), path)
    stored = stores.read_transitions(spark, path)
    assert stored.columns == moves.columns
    assert _rows(stored) == _rows(moves)
    newest = history.transitions_for_flight(stored, "AA1", r.DAY)
    assert [t.to_state for t in newest.collect()][:2] == ["COMPLETED", "LANDED"]
    plan = newest._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(flight_date" in plan
    assert "EqualTo(flight_number,AA1)" in plan


def test_a_replayed_batch_overwrites_its_own_rows_only(spark, tmp_path):
    flights = r.flights(spark, r.flight("AA1"), r.flight("AA2"))
    moves = lifecycle.transitions_with_context(flights, r.signals(spark, r.cancel("AA2", 2)))
    path = f"{tmp_path}/batches"
    stores.write_transition_batch(moves.filter("flight_number = 'AA1'"), path, 0)
    for _ in range(2):
        stores.write_transition_batch(moves.filter("flight_number = 'AA2'").unionByName(moves.filter("flight_number = 'AA2'")), path, 1)
    assert _rows(stores.read_transitions(spark, path)) == _rows(moves)
    # Appends and batches share one layout.
    stores.write_transitions(moves, path)
    assert _rows(stores.read_transitions(spark, path)) == _rows(moves)


def test_history_stream_live_rows_and_messages(spark, tables, tmp_path):
    moves = tables.transitions
    moves.repartition(2).write.parquet(f"{tmp_path}/moves")
    stream = lambda: spark.readStream.schema(moves.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/moves")

    _finish(pipelines.write_history_stream(stream(), f"{tmp_path}/store", f"{tmp_path}/c1", available_now=True))
    _finish(pipelines.write_history_stream(stream(), f"{tmp_path}/store", f"{tmp_path}/c2", available_now=True))
    assert _rows(stores.read_transitions(spark, f"{tmp_path}/store")) == _rows(moves)

    pushed = []
    push = lambda rows, batch_id: pushed.append((batch_id, rows.collect()))
    _finish(pipelines.live_flight_updates(stream(), push, f"{tmp_path}/c3", available_now=True))
    assert sorted(b for b, _ in pushed) == [0, 1]
    for _, rows in pushed:
        assert len({x.flight_key for x in rows}) == len(rows)
    newest = {}
    for _, rows in pushed:
        for x in rows:
            newest[x.flight_key] = max(newest.get(x.flight_key, (x.timestamp, "")), (x.timestamp, x.to_state))
    ends = moves.filter(F.col("to_state").isin("COMPLETED", "CANCELLED")).collect()
    assert {k: v[1] for k, v in newest.items()} == {x.flight_key: x.to_state for x in ends}

    _finish(pipelines.write_state_change_stream(stream(), f"{tmp_path}/c4", available_now=True, path=f"{tmp_path}/messages"))
    sent = spark.read.schema("key string, value string").json(f"{tmp_path}/messages")
    assert sent.count() == moves.count()
    first = json.loads(sent.filter("value like '%\"newState\":\"SCHEDULED\"%'").first().value)
    assert first["previousState"] is None
    assert set(first) == {"flightNumber", "previousState", "newState", "timestamp", "gate", "delay"}


def test_state_changes_to_a_folder(spark, tmp_path):
    flights = r.flights(spark, r.flight("AA1"))
    moves = lifecycle.transitions_with_context(flights, r.signals(spark))
    changes = moves.withColumnsRenamed({"from_state": "previous_state", "to_state": "new_state"})
    stores.write_state_changes(changes, f"{tmp_path}/m")
    sent = spark.read.json(f"{tmp_path}/m")
    assert {x.key for x in sent.collect()} == {"AA1"}
    assert sent.count() == 6
    short = stores.state_change_messages(changes.drop("gate", "delay")).first()
    assert json.loads(short.value)["gate"] is None
    assert json.loads(short.value)["delay"] == 0


def test_delay_windows_stream_equals_batch(spark, tables, tmp_path):
    signals = tables.signals.withColumn("event_ts", F.col("event_ts").cast("timestamp"))
    signals.coalesce(1).write.parquet(f"{tmp_path}/s")
    end = signals.filter("signal = 'announceDelay'").limit(1).withColumn("event_ts", F.expr("timestamp'2024-06-01'"))
    stream = spark.readStream.schema(signals.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/s")
    end.coalesce(1).write.mode("append").parquet(f"{tmp_path}/s")
    for slide, name in (("30 minutes", "hopping"), (None, "tumbling")):
        streamed = _to_memory(spark, analytics.delay_windows(stream, "1 hour", slide, "1 hour"), name)
        assert _rows(streamed) == _rows(analytics.delay_windows(signals, "1 hour", slide))


def test_route_history_joins_a_stream(spark, tables, tmp_path):
    means = analytics.past_delay_by_route(tables.outcomes)
    tables.events.write.parquet(f"{tmp_path}/e")
    stream = spark.readStream.schema(tables.events.schema).parquet(f"{tmp_path}/e")
    streamed = _to_memory(spark, enrich.history_enriched_events(stream, tables.flights, means), "with_route")
    assert _rows(streamed) == _rows(enrich.history_enriched_events(tables.events, tables.flights, means))


def test_late_rows_go_to_their_own_folder(spark, tmp_path):
    schema = "event_seq bigint, event_ts timestamp_ntz"
    for part, minutes in enumerate(([0, 60, 5], [40, 55, 61, 200], [100, 190, 191])):
        rows = [(part * 10 + i, r.at(m)) for i, m in enumerate(minutes)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = [f"{tmp_path}/{name}" for name in ("good", "late", "marks", "c")]
    _finish(pipelines.write_with_late_rows(stream, 600, *out, available_now=True))
    late = {x.event_seq for x in spark.read.parquet(out[1]).collect()}
    good = {x.event_seq for x in spark.read.parquet(out[0]).collect()}
    # The watermarks are minute 50 and minute 190; a row at the watermark itself is late.
    assert late == {10, 20, 21}
    assert good == {0, 1, 2, 11, 12, 13, 22}


def test_signals_of_a_stream(spark, tables, raw_folder):
    streamed = _to_memory(spark, events_to_signals(parse_flight_events(_stream(spark, raw_folder))), "signals")
    assert _rows(streamed) == _rows(events_to_signals(parse_flight_events(tables.view("raw_messages"))))
