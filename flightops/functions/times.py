"""Time arithmetic and text forms."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def timestamp_lit(value: dt.datetime | str) -> Column:
    """A zone-less timestamp literal."""
    return F.lit(str(value)).cast("timestamp_ntz")


def plus_seconds(ts: Column, seconds: Column) -> Column:
    return F.timestamp_add("SECOND", seconds, ts)


def micros(ts: str) -> str:
    """SQL text: microseconds since 1970; needs the UTC session zone for zone-less input."""
    return f"unix_micros(cast({ts} as timestamp))"


def epoch_micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def epoch_millis(ts: Column) -> Column:
    return F.unix_millis(ts.cast("timestamp"))


def seconds_between(start: Column, end: Column) -> Column:
    """Whole seconds, truncated."""
    return F.floor((epoch_micros(end) - epoch_micros(start)) / F.lit(1_000_000)).cast("bigint")


def format_event_time(ts: Column, zone: str = "UTC") -> Column:
    """`yyyy-MM-dd HH:mm:ss` of a UTC time in a zone."""
    local = ts if zone == "UTC" else F.convert_timezone(F.lit("UTC"), F.lit(zone), ts)
    return F.date_format(local, "yyyy-MM-dd HH:mm:ss")


def iso_local(ts: Column) -> Column:
    """ISO text as short as exactness allows: seconds and fraction only if they are not zero."""
    micros = F.pmod(epoch_micros(ts), F.lit(1_000_000))
    pattern = (
        F.when((micros == 0) & (F.second(ts) == 0), F.date_format(ts, "yyyy-MM-dd'T'HH:mm"))
        .when(micros == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"))
        .when(micros % 1000 == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS"))
    )
    return pattern.otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


def iso_duration(start: Column, end: Column) -> Column:
    """Elapsed time as `PT#H#M#S`, zero parts left out."""
    micros = epoch_micros(end) - epoch_micros(start)
    total = F.floor(micros / 1_000_000).cast("bigint")
    fraction = F.rtrim(F.lpad((micros % 1_000_000).cast("string"), 6, "0"), F.lit("0"))
    hours, minutes, seconds = F.floor(total / 3600), F.floor(total / 60) % 60, total % 60
    seconds_text = F.concat(
        seconds.cast("string"), F.when(fraction != "", F.concat(F.lit("."), fraction)).otherwise("")
    )
    return F.when(micros == 0, F.lit("PT0S")).otherwise(
        F.concat(
            F.lit("PT"),
            F.when(hours > 0, F.concat(hours.cast("string"), F.lit("H"))).otherwise(""),
            F.when(minutes > 0, F.concat(minutes.cast("string"), F.lit("M"))).otherwise(""),
            F.when(seconds_text != "0", F.concat(seconds_text, F.lit("S"))).otherwise(""),
        )
    )
