"""Streams from source to sink: enrichment, history, messages, live views, late rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from flightops.functions.keys import state_ordinal
from flightops.functions.times import epoch_micros, iso_local
from flightops.operators.enrich import enriched_events
from flightops.sources.events import parse_flight_events
from flightops.sources.stores import state_change_messages, write_transition_batch


def stream_enrich(raw: DataFrame, **options) -> DataFrame:
    """Raw messages parsed and enriched; stateless, so it runs in any output mode."""
    return enriched_events(parse_flight_events(raw), **options)


def enriched_messages(enriched: DataFrame) -> DataFrame:
    """Enriched events as keyed JSON messages; readers of plain events can read them too."""
    body = F.struct(
        F.col("event_type").alias("eventType"),
        F.col("flight_number").alias("flightNumber"),
        F.col("flight_date").cast("string").alias("flightDate"),
        F.col("data"),
        F.col("estimated_delay").alias("estimatedDelay"),
        F.col("risk_score").alias("riskScore"),
        iso_local(F.col("enriched_timestamp")).alias("enrichedTimestamp"),
    )
    return enriched.select(
        F.col("flight_number").alias("key"), F.to_json(body).alias("value"), "event_seq", "event_ts"
    )


def _started(writer: DataStreamWriter, checkpoint: str, available_now: bool) -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def write_messages(
    messages: DataFrame,
    checkpoint: str,
    path: str | None = None,
    topic_options: dict | None = None,
    available_now: bool = False,
) -> StreamingQuery:
    """Stream of (key, value, …) to a topic, or to a folder of JSON lines."""
    if topic_options is not None:
        options = {"kafka.acks": "1", "kafka.retries": "3", **topic_options}
        writer = messages.select("key", "value").writeStream.format("kafka").options(**options)
    else:
        # The writer's default would cut times to milliseconds.
        writer = messages.writeStream.format("json").options(
            path=path, timestampNTZFormat="yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
        )
    return _started(writer, checkpoint, available_now)


def write_enriched(raw: DataFrame, checkpoint: str, available_now: bool = False, **sink) -> StreamingQuery:
    """The whole hop: raw messages in, enriched messages out."""
    return write_messages(enriched_messages(stream_enrich(raw)), checkpoint, available_now=available_now, **sink)


def write_state_change_stream(transitions: DataFrame, checkpoint: str, available_now: bool = False, **sink):
    """State-change messages of a stream of history rows."""
    changes = transitions.withColumnsRenamed({"from_state": "previous_state", "to_state": "new_state"})
    return write_messages(state_change_messages(changes), checkpoint, available_now=available_now, **sink)


def write_history_stream(
    transitions: DataFrame, path: str, checkpoint: str, available_now: bool = False
) -> StreamingQuery:
    """History rows written to the store. A micro-batch that is replayed overwrites what it wrote before."""

    def append(batch: DataFrame, batch_id: int) -> None:
        write_transition_batch(batch, path, batch_id)

    return _started(transitions.writeStream.foreachBatch(append), checkpoint, available_now)


def live_flight_updates(
    transitions: DataFrame, push: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = False
) -> StreamingQuery:
    """Per micro-batch the current row of every flight that changed, handed to `push(rows, batch_id)`.

    Keeps no state of its own: the rows already carry the flight's current values.
    """

    def latest(batch: DataFrame, batch_id: int) -> None:
        others = [c for c in batch.columns if c != "flight_key"]
        order = F.struct("timestamp", state_ordinal(F.col("to_state")).alias("ordinal"))
        rows = batch.groupBy("flight_key").agg(F.max_by(F.struct(*others), order).alias("row"))
        push(rows.select("flight_key", "row.*"), batch_id)

    writer = transitions.writeStream.outputMode("update").foreachBatch(latest)
    return _started(writer, checkpoint, available_now)


def write_with_late_rows(
    events: DataFrame,
    delay_seconds: int,
    on_time_path: str,
    late_path: str,
    marks_path: str,
    checkpoint: str,
    available_now: bool = False,
) -> StreamingQuery:
    """Split a stream by the watermark rule: rows `delay_seconds` or more behind the newest event of
    the earlier micro-batches are late and go to a folder of their own.

    Each micro-batch overwrites its own subfolder, so a replay changes nothing. `marks_path` gets
    one row per micro-batch, the newest event time so far; the next one reads just that row.
    """

    def split(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            event_us = epoch_micros(F.col("event_ts"))
            newest = batch.agg(F.max(event_us)).first()[0]
            before = None
            if batch_id > 0:
                marks = spark.read.schema("newest_us bigint").parquet(f"{marks_path}/batch_id={batch_id - 1}")
                before = marks.first().newest_us
            late = F.lit(False) if before is None else event_us <= before - delay_seconds * 1_000_000
            part = f"batch_id={batch_id}"
            batch.filter(~late).write.mode("overwrite").parquet(f"{on_time_path}/{part}")
            batch.filter(late).write.mode("overwrite").parquet(f"{late_path}/{part}")
            reached = max((ts for ts in (before, newest) if ts is not None), default=None)
            mark = spark.range(1).select(F.lit(reached).cast("bigint").alias("newest_us"))
            mark.write.mode("overwrite").parquet(f"{marks_path}/{part}")
        finally:
            batch.unpersist()

    return _started(events.writeStream.foreachBatch(split), checkpoint, available_now)
