"""Flight and journey keys, lifecycle order."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from flightops.schemas import STATES


def flight_key(number: Column, date: Column) -> Column:
    return F.concat(F.lit("flight-"), number, F.lit("-"), date.cast("string"))


def journey_key(journey_id: Column) -> Column:
    return F.concat(F.lit("journey-"), journey_id)


def is_flight_key(key: Column) -> Column:
    return key.startswith("flight-")


def flight_number_from_key(key: Column) -> Column:
    """Second dash-separated part, or the key itself. Lossy for numbers that contain a dash."""
    parts = F.split(F.rtrim(key, F.lit("-")), "-")
    return F.when(F.size(parts) >= 2, F.get(parts, F.lit(1))).otherwise(key)


def default_flight_date(date: Column, as_of_date: dt.date) -> Column:
    return F.coalesce(date, F.lit(as_of_date))


def state_ordinal(state: Column) -> Column:
    """Position in the lifecycle from 0, null for an unknown state."""
    position = F.array_position(F.array(*[F.lit(s) for s in STATES]), state)
    return F.when(position > 0, (position - 1).cast("int"))
