"""Which starts of a flight count: one is refused while an accepted run of the same key is under way."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flightops.operators.lifecycle import flights_with_end
from flightops.session import written

_KEYS = ["flight_key", "start_ts"]


def select_starts(starts: DataFrame, signals: DataFrame, busy: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(accepted with `end_ts`, rejected) of the rows of `starts`.

    A run lasts to its planned end or to the boundary at which a cancellation sent during it takes effect, that
    moment included. `busy` (flight_key, end_ts) holds runs accepted before. Of several starts at one moment one counts.

    Every round accepts the first start of each key that meets no run, so there are as many rounds as the busiest
    key has runs, however many starts it has: a key's starts are reduced where they lie, never gathered.
    """
    columns = starts.columns
    # The id is written once, so that it stays the same in all rounds.
    rest = written(starts.withColumn("__id", F.monotonically_increasing_id()), "starts")
    every = rest
    accepted = None
    while True:
        if busy is not None:
            ends = busy.groupBy("flight_key").agg(F.max("end_ts").alias("__busy"))
            free = F.col("__busy").isNull() | (F.col("start_ts") > F.col("__busy"))
            rest = written(rest.join(ends, "flight_key", "left").filter(free).drop("__busy"), "starts")
        others = [c for c in columns if c not in _KEYS]
        order = F.struct("start_ts", F.xxhash64(*others), "__id")
        first = rest.groupBy("flight_key").agg(F.min_by(F.struct("start_ts", "__id", *others), order).alias("first"))
        found = flights_with_end(first.select("flight_key", "first.*"), signals)
        found = written(found.select(*columns, "__id", "end_ts"), "runs")
        if accepted is not None and not found.limit(1).count():
            break
        accepted = found if accepted is None else accepted.unionByName(found)
        own = found.select("flight_key", "end_ts")
        busy = own if busy is None else busy.unionByName(own)
    rejected = every.join(accepted.select("__id"), "__id", "left_anti").select(*columns)
    return accepted.select(*columns, "end_ts"), rejected


def rejected_starts(starts: DataFrame, signals: DataFrame) -> DataFrame:
    """Refused starts with the run they met (`running_since`, `running_until`)."""
    accepted, rejected = select_starts(starts, signals)
    runs = accepted.select("flight_key", F.col("start_ts").alias("running_since"), F.col("end_ts").alias("running_until"))
    met = F.col("start_ts").between(F.col("running_since"), F.col("running_until"))
    return rejected.select(*_KEYS).join(runs, "flight_key").filter(met)


def accepted_starts(starts: DataFrame, signals: DataFrame) -> DataFrame:
    """The starts that count, as flights for the lifecycle operators; a key may have several runs, one after the other."""
    return select_starts(starts, signals)[0].drop("end_ts")
