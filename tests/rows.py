"""Small hand-written inputs."""

from __future__ import annotations

import datetime as dt

from flightops.schemas import CANCEL, DELAY, GATE, SIGNALS

DAY = dt.date(2026, 1, 27)
START = dt.datetime(2026, 1, 27, 10, 0, 0)
# Entry times at minute 0, 1, 3, 6, 10 and 15.
PHASE_SECONDS = [60, 120, 180, 240, 300]

FLIGHTS = (
    "flight_key string, flight_number string, flight_date date, departure_station string, arrival_station string, "
    "scheduled_departure timestamp_ntz, scheduled_arrival timestamp_ntz, gate string, aircraft string, "
    "start_ts timestamp_ntz, phase_seconds array<int>"
)


def at(minutes: float) -> dt.datetime:
    return START + dt.timedelta(minutes=minutes)


def key(number: str) -> str:
    return f"flight-{number}-{DAY}"


def flight(number: str, gate: str | None = "A1", aircraft: str | None = "N12345") -> tuple:
    return (key(number), number, DAY, "ORD", "DFW", at(120), at(300), gate, aircraft, START, PHASE_SECONDS)


def flights(spark, *rows: tuple):
    return spark.createDataFrame(list(rows), FLIGHTS)


def delay(number: str, minutes: float, value: int, seq: int = 0) -> tuple:
    return (key(number), DELAY, value, None, None, seq, at(minutes))


def gate(number: str, minutes: float, value: str, seq: int = 0) -> tuple:
    return (key(number), GATE, None, value, None, seq, at(minutes))


def cancel(number: str, minutes: float, reason: str = "Weather conditions", seq: int = 0) -> tuple:
    return (key(number), CANCEL, None, None, reason, seq, at(minutes))


def signals(spark, *rows: tuple):
    return spark.createDataFrame(list(rows), SIGNALS)
