"""Flight events: reading, parsing, rejects."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flightops.functions.payload import json_text
from flightops.schemas import EVENT_TYPES, RAW_MESSAGES


def read_flight_events(
    spark: SparkSession,
    source: str | Mapping[str, str],
    fmt: str = "parquet",
    streaming: bool = False,
) -> DataFrame:
    """Raw messages (event_seq, event_ts, key, value) from a topic or a folder.

    `source` is a folder path, or the options of the topic reader (servers, `subscribe`).
    `fmt` is `kafka`, `parquet`, `json` (one object per line with the four columns) or
    `text` (one message per line). A text line carries neither order nor time, so both are
    null: parsing works, time-based operators need another source.
    """
    reader = spark.readStream if streaming else spark.read
    if fmt == "kafka":
        options = {"startingOffsets": "earliest", **dict(source)}
        topic = reader.format("kafka").options(**options).load()
        # One partition per flight number keeps the offset order; the partition number goes
        # into the high digits so that the sequence is unique over the topic.
        return topic.select(
            (F.col("partition").cast("bigint") * F.lit(1 << 48) + F.col("offset")).alias("event_seq"),
            F.col("timestamp").cast("timestamp_ntz").alias("event_ts"),
            F.col("key").cast("string").alias("key"),
            F.col("value").cast("string").alias("value"),
        )
    if fmt == "text":
        return reader.text(source).select(
            F.lit(None).cast("bigint").alias("event_seq"),
            F.lit(None).cast("timestamp_ntz").alias("event_ts"),
            F.lit(None).cast("string").alias("key"),
            "value",
        )
    return reader.schema(RAW_MESSAGES).format(fmt).load(source)


def _is_date(text: Column) -> Column:
    return text.rlike(r"^\d{4}-\d{2}-\d{2}$") & text.try_cast("date").isNotNull()


def _parsed(raw: DataFrame) -> DataFrame:
    """Every message with its fields and, if it cannot be used, the reason."""
    documents = raw.withColumn("doc", F.try_parse_json("value"))
    # A type or date that is an object or array is not valid as text either.
    fields = F.struct(
        F.col("doc").isNull().alias("malformed"),
        F.try_variant_get("doc", "$.eventType", "string").alias("event_type"),
        json_text(F.col("doc"), "$.flightNumber").alias("flight_number"),
        F.try_variant_get("doc", "$.flightDate", "string").alias("date_text"),
        json_text(F.col("doc"), "$.data").alias("data"),
    )
    # The one-element list keeps the optimizer from repeating the parse in each condition of
    # the filter on `reason`, which it would push below the projection.
    fields = documents.select(*raw.columns, F.inline(F.array(fields)))
    reason = (
        F.when(F.col("malformed"), "bad_json")
        .when(
            F.col("event_type").isNull() | F.col("flight_number").isNull() | F.col("date_text").isNull(),
            "missing_field",
        )
        .when(~F.col("event_type").isin(*EVENT_TYPES), "unknown_type")
        .when(~_is_date(F.col("date_text")), "bad_date")
    )
    return fields.withColumn("reason", reason)


def parse_flight_events(raw: DataFrame) -> DataFrame:
    """Messages that are well-formed, complete, of a known type and with an ISO date."""
    return (
        _parsed(raw)
        .filter(F.col("reason").isNull())
        .select(
            "event_type",
            "flight_number",
            F.col("date_text").try_cast("date").alias("flight_date"),
            "data",
            "event_seq",
            "event_ts",
        )
    )


def dead_letter_events(raw: DataFrame) -> DataFrame:
    """The other messages, whole, with the reason."""
    return _parsed(raw).filter(F.col("reason").isNotNull()).select("event_seq", "event_ts", "key", "value", "reason")
