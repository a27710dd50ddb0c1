"""Stored history and outgoing messages."""

from __future__ import annotations

import uuid

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flightops.functions.describe import state_change_payload
from flightops.schemas import DEFAULT_DELAY, TRANSITIONS


def read_transitions(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """The stored history. Filters on `flight_date` prune folders, others reach the scan.

    `fmt` may name any installed reader; a folder written by `write_transitions` is parquet.
    """
    stored = spark.read.schema(TRANSITIONS).format(fmt).load(path)
    return stored.select(*[field.split()[0] for field in TRANSITIONS.split(", ")])


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        read_transitions(spark, path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return False
    return True


def _write_ranges(rows: DataFrame, path: str, batch: str, mode: str) -> None:
    """Tasks take ranges of (date, flight number), so a busy date is written by many of them, a task writes few
    dates, and files carry narrow min/max ranges."""
    (
        rows.withColumn("batch_id", F.lit(batch))
        .repartitionByRange("flight_date", "flight_number")
        .sortWithinPartitions("flight_date", "flight_number", "timestamp")
        .write.mode(mode)
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("flight_date", "batch_id")
        .parquet(path)
    )


def write_transition_batch(transitions: DataFrame, path: str, batch_id: int | str) -> None:
    """Write the rows of one batch, each id once, into folders of its own below their dates.

    A batch that is replayed overwrites just those folders, so nothing that is stored has to be read. Batches are
    expected to hold different rows, as those of a stream do; for rows that may be stored already see `write_transitions`.
    """
    _write_ranges(transitions.dropDuplicates(["id"]), path, f"b{batch_id}", "overwrite")


def write_transitions(transitions: DataFrame, path: str) -> None:
    """Append the rows whose id is not stored yet, partitioned by date.

    Of the store only the ids of the folders between the first and last date of the new rows are read.
    """
    # Kept for the passes below: finding its dates, sampling the ranges, writing.
    new = transitions.dropDuplicates(["id"]).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        unseen = new
        if _exists(new.sparkSession, path):
            first, last = new.agg(F.min("flight_date"), F.max("flight_date")).first()
            stored = read_transitions(new.sparkSession, path).filter(F.col("flight_date").between(first, last))
            unseen = new.join(stored.select("id"), "id", "left_anti")
        _write_ranges(unseen, path, f"a{uuid.uuid4().hex}", "append")
    finally:
        new.unpersist()


def state_change_messages(changes: DataFrame) -> DataFrame:
    """State changes as keyed JSON messages; the key is the flight number.

    Changes without `gate` or `delay` columns are sent with no gate and a delay of 0.
    """
    gate = F.col("gate") if "gate" in changes.columns else F.lit(None).cast("string")
    delay = F.col("delay") if "delay" in changes.columns else F.lit(DEFAULT_DELAY)
    states = [F.col(name) for name in ("flight_number", "previous_state", "new_state", "timestamp")]
    return changes.select(
        F.col("flight_number").alias("key"), state_change_payload(*states, gate, delay).alias("value")
    )


def write_state_changes(changes: DataFrame, path: str | None = None, topic_options: dict | None = None) -> None:
    """Send the messages to a folder of JSON lines, or to a topic (`topic` and servers in the options)."""
    messages = state_change_messages(changes)
    if topic_options is not None:
        options = {"kafka.acks": "1", "kafka.retries": "3", **topic_options}
        messages.write.format("kafka").options(**options).save()
    else:
        messages.write.mode("append").json(path)
