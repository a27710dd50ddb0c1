"""Flight and journey requests turned into entity rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flightops.functions.keys import flight_key, journey_key
from flightops.schemas import DEFAULT_DELAY


def flights_from_requests(requests: DataFrame) -> DataFrame:
    """Request rows as flights: key, initial state, no delay."""
    return requests.select(
        flight_key(F.col("flight_number"), F.col("flight_date")).alias("flight_key"),
        "flight_number",
        "flight_date",
        "departure_station",
        "arrival_station",
        "scheduled_departure",
        "scheduled_arrival",
        F.lit("SCHEDULED").alias("current_state"),
        "gate",
        "aircraft",
        F.lit(DEFAULT_DELAY).alias("delay"),
    )


def journey_legs(journeys: DataFrame) -> DataFrame:
    """One row per leg of each nested journey, `leg` counting from 0."""
    return legs_in_journey(journeys).drop("legs")


def legs_in_journey(journeys: DataFrame) -> DataFrame:
    """The same with all legs of the journey at hand in `legs`, so that neighbours need no shuffle."""
    legs = journeys.select("journey_id", "legs", F.posexplode("legs").alias("leg", "flight"))
    return legs.select(
        "journey_id",
        journey_key(F.col("journey_id")).alias("journey_key"),
        "leg",
        "flight.*",
        "legs",
    ).withColumn("flight_key", flight_key(F.col("flight_number"), F.col("flight_date")))
