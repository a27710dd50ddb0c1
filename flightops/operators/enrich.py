"""Events with delay estimate and risk, and with what history says about their route."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flightops.functions.describe import estimated_delay, risk_score
from flightops.functions.keys import flight_key
from flightops.functions.times import timestamp_lit


def enriched_events(
    events: DataFrame, default_delay_by_type: Mapping[str, int] | None = None, stamp=None
) -> DataFrame:
    """Events plus `estimated_delay`, `risk_score`, `enriched_timestamp`.

    Stateless, so the same for a table and a stream. `stamp` fixes the time for tables;
    without it the processing time is used.
    """
    delay = estimated_delay(F.col("event_type"), F.col("data"), default_delay_by_type)
    at = F.current_timestamp().cast("timestamp_ntz") if stamp is None else timestamp_lit(stamp)
    return (
        events.withColumn("estimated_delay", delay)
        .withColumn("risk_score", risk_score(F.col("estimated_delay")))
        .withColumn("enriched_timestamp", at)
    )


def history_enriched_events(events: DataFrame, flights: DataFrame, past_delays: DataFrame) -> DataFrame:
    """Events plus the mean delay of their route on the days before; null for unknown flights or no such day.

    `past_delays` has one row per route and day (analytics.past_delay_by_route).

    The event side stays on the left of both joins, where a hot flight can be split. Whether
    the route table is broadcast is left to its measured size.
    """
    routes = flights.select("flight_key", "departure_station", "arrival_station")
    keyed = events.withColumn("flight_key", flight_key(F.col("flight_number"), F.col("flight_date")))
    return keyed.join(routes, "flight_key", "left").join(
        past_delays, ["departure_station", "arrival_station", "flight_date"], "left"
    )


def risk_mix(enriched: DataFrame) -> DataFrame:
    """Events per day and risk level, one column per level."""
    return (
        enriched.groupBy("flight_date")
        .pivot("risk_score", ["LOW", "MEDIUM", "HIGH"])
        .agg(F.count(F.lit(1)))
        .select(
            "flight_date",
            *[F.coalesce(F.col(level), F.lit(0)).alias(f"n_{level.lower()}") for level in ("LOW", "MEDIUM", "HIGH")],
        )
    )
