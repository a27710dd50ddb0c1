"""Flight-domain views over the given `events` table.

Every view is a plain projection or aggregation of the whole table, so work grows with it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flightops.operators.ordered import with_row_number
from flightops.schemas import HISTORY_DESCRIPTIONS, SIGNALED_TYPE

# --- Fixed values: what a source row stands for ---------------------------------------------
DEPARTURES = ("ORD", "DFW", "LAX", "JFK", "ATL", "DEN", "SFO", "SEA", "MIA", "BOS")
ARRIVALS = ("PHX", "LAS", "MSP", "DTW", "PHL", "CLT", "IAH", "EWR", "SAN", "TPA")
GATE_LETTERS = ("A", "B", "C", "D", "E", "F", "G", "H", "I", "J")
CLICK_TYPES = ("FLIGHT_SCHEDULED", "BOARDING_STARTED", "DEPARTURE", "ARRIVAL")
FIRST_DAY = "2024-01-01"
HISTORY_TYPES = (
    *HISTORY_DESCRIPTIONS,
    SIGNALED_TYPE,
    "EVENT_TYPE_ACTIVITY_TASK_SCHEDULED",
    "EVENT_TYPE_ACTIVITY_TASK_COMPLETED",
    "EVENT_TYPE_UPSERT_WORKFLOW_SEARCH_ATTRIBUTES",
)
SIGNAL_NAMES = ("announceDelay", "changeGate", "cancelFlight")
# --------------------------------------------------------------------------------------------


EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"

# SQL texts over a source row: day, days since the first, number and key of its flight.
DAY = "to_date(ts)"
DAY_NUMBER = f"datediff({DAY}, DATE'{FIRST_DAY}')"
NUMBER = "concat('FL', user_id)"
KEY = f"concat('flight-FL', user_id, '-', cast({DAY} as string))"
K = r"""cast(regexp_extract(props, '"k"\\s*:\\s*([0-9]+)', 1) as int)"""


def _list(values: tuple[str, ...]) -> str:
    return "array(" + ", ".join(f"'{v}'" for v in values) + ")"


def _pick(values: tuple[str, ...], index: str) -> str:
    return f"get({_list(values)}, cast({index} as int))"


def source_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.schema(EVENTS).parquet(f"{sf_dir}/events.parquet")


def flights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One flight per user and day.

    Reduced by user and day rather than by the key built from them: a join by the key then
    shuffles these few rows once more, and in exchange can split a hot flight.
    """
    flown = source_events(spark, sf_dir).filter(f"(user_id + {DAY_NUMBER}) % 11 <> 0")
    keyed = flown.selectExpr("user_id as u", f"{DAY} as flight_date").distinct()
    dn = f"datediff(flight_date, DATE'{FIRST_DAY}')"
    midnight = "cast(flight_date as timestamp_ntz)"
    phases = ", ".join(f"cast(60 * (120 + (u * 7 + {dn} * 13 + {p} * 31) % 181) as int)" for p in range(5))
    return keyed.selectExpr(
        "concat('flight-FL', u, '-', cast(flight_date as string)) as flight_key",
        "concat('FL', u) as flight_number",
        "flight_date",
        f"{_pick(DEPARTURES, 'u % 10')} as departure_station",
        f"{_pick(ARRIVALS, f'(u + {dn}) % 10')} as arrival_station",
        f"timestampadd(HOUR, cast(3 + u % 6 as int), {midnight}) as scheduled_departure",
        f"timestampadd(HOUR, cast(3 + u % 6 + 2 + u % 4 as int), {midnight}) as scheduled_arrival",
        f"concat({_pick(GATE_LETTERS, 'u % 10')}, u % 20 + 1) as gate",
        f"case when (u + {dn}) % 3 <> 0 then concat('N', 100 + u % 50) end as aircraft",
        f"{midnight} as start_ts",
        f"array({phases}) as phase_seconds",
    )


def flight_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One typed flight event per source row."""
    rows = source_events(spark, sf_dir).selectExpr("event_id", "ts", "user_id", "event_type", "value", f"{K} as k")
    return rows.selectExpr(
        f"""case when event_type = 'purchase' then 'DELAY_ANNOUNCED'
                 when event_type = 'view' then 'GATE_CHANGED'
                 when event_type = 'signup' then 'GATE_ASSIGNED'
                 when event_type = 'error' and k % 2 = 0 then 'FLIGHT_CANCELLED'
                 when event_type = 'error' then 'DELAY_ANNOUNCED'
                 else {_pick(CLICK_TYPES, 'k % 4')} end as event_type""",
        f"{NUMBER} as flight_number",
        f"{DAY} as flight_date",
        """case when event_type = 'purchase' then concat('{"delayMinutes":', floor(value), '}')
                when event_type = 'view' then concat('{"gate":"C', k, '"}')
                when event_type = 'signup' then concat('{"gate":"B', k, '"}')
                when event_type = 'error' and k % 2 = 0 then concat('{"reason":"R', k, '"}')
                else '{}' end as data""",
        "event_id as event_seq",
        "ts as event_ts",
    )


def raw_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as topic messages, some of them broken; the first rule that fits applies."""
    rule = F.lit(None).cast("string")
    broken = ((97, "cut"), (89, "type"), (83, "number"), (79, "date"), (73, "no_data"), (71, "bad_data"))
    for divisor, name in reversed(broken):
        rule = F.when(F.col("event_seq") % divisor == 1, name).otherwise(rule)
    rule = F.coalesce(rule, F.lit("none"))
    value = F.to_json(
        F.struct(
            F.when(F.col("rule") == "type", "DIVERTED").otherwise(F.col("event_type")).alias("eventType"),
            F.when(F.col("rule") != "number", F.col("flight_number")).alias("flightNumber"),
            F.when(F.col("rule") == "date", F.date_format("flight_date", "yyyy/MM/dd"))
            .otherwise(F.col("flight_date").cast("string"))
            .alias("flightDate"),
            F.when(F.col("rule") == "bad_data", "not json")
            .when(F.col("rule") != "no_data", F.col("data"))
            .alias("data"),
        )
    )
    return (
        flight_events(spark, sf_dir)
        .withColumn("rule", rule)
        .withColumn("whole", value)
        .select(
            "event_seq",
            "event_ts",
            F.col("flight_number").alias("key"),
            F.when(F.col("rule") == "cut", F.expr("left(whole, length(whole) - 5)"))
            .otherwise(F.col("whole"))
            .alias("value"),
        )
    )


def replayed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events with every fiftieth delivered twice."""
    copies = F.when(F.col("event_seq") % 50 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return flight_events(spark, sf_dir).withColumn("copy", F.explode(copies)).drop("copy")


LEG_FIELDS = (
    "flight_number",
    "flight_date",
    "departure_station",
    "arrival_station",
    "scheduled_departure",
    "scheduled_arrival",
    "gate",
    "aircraft",
    "start_ts",
    "phase_seconds",
)


def journeys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's flights of one week as one nested journey of at most seven legs."""
    week = f"datediff(flight_date, DATE'{FIRST_DAY}') div 7"
    journey_id = F.expr(f"concat('J', substring(flight_number, 3), 'W', {week})")
    by_date = F.struct("flight_date", *[c for c in LEG_FIELDS if c != "flight_date"])
    return (
        flights(spark, sf_dir)
        .groupBy(journey_id.alias("journey_id"))
        .agg(F.sort_array(F.collect_list(by_date)).alias("legs"))
    )


def journey_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cancellation 30 h after the start of every journey whose user and week add up to a multiple of 5.

    Odd multiples have another one 2 h before the start, which finds no journey.
    """
    made = journeys(spark, sf_dir).select(
        "journey_id",
        F.split(F.expr("substring(journey_id, 2)"), "W").alias("parts"),
        F.col("legs")[0]["start_ts"].alias("start_ts"),
    )
    user, week = F.col("parts")[0].cast("bigint"), F.col("parts")[1].cast("bigint")
    hours = F.when((user + week) % 10 == 5, F.array(F.lit(30), F.lit(-2))).otherwise(F.array(F.lit(30)))
    sent = made.filter((user + week) % 5 == 0).withColumn("hours", F.explode(hours))
    return sent.select(
        "journey_id",
        F.lit("Weather").alias("reason"),
        (F.col("start_ts") + F.make_dt_interval(hours=F.col("hours"))).alias("event_ts"),
    )


def history_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw history of each key: events of 18 types."""
    return source_events(spark, sf_dir).selectExpr(
        f"{KEY} as flight_key",
        "ts as event_ts",
        f"{_pick(HISTORY_TYPES, 'event_id % 18')} as event_type",
        f"{_pick(SIGNAL_NAMES, f'{K} % 3')} as signal_name",
    )


def history_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, numbered within each key."""
    return with_row_number(history_source(spark, sf_dir), ["flight_key"], ["event_ts"], "event_id")


def external_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors = source_events(spark, sf_dir).filter("event_type = 'error'")
    return errors.selectExpr(f"{KEY} as flight_key", "ts as external_ts", f"{K} as k")


def _user_of_number() -> Column:
    return F.expr("substring(flight_number, 3)").cast("bigint")


def flight_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flights as requests, some with blank fields."""
    user = _user_of_number()
    return flights(spark, sf_dir).withColumns(
        {
            "gate": F.when(user % 13 != 0, F.col("gate")),
            "departure_station": F.when(user % 17 == 0, F.lit("  ")).otherwise(F.col("departure_station")),
        }
    )


def journey_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The journeys as requests, some without legs; legs keep their missing aircraft."""
    user = F.split(F.expr("substring(journey_id, 2)"), "W")[0].cast("bigint")
    return journeys(spark, sf_dir).withColumn(
        "legs", F.when(user % 19 == 0, F.slice("legs", 1, 0)).otherwise(F.col("legs"))
    )


def start_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flights' starts; some users send a second one 8 h later, some a third one 26 h after the first."""
    user = _user_of_number()
    hours = F.concat(
        F.array(F.lit(0)),
        F.when(user % 3 == 0, F.array(F.lit(8))).otherwise(F.array().cast("array<int>")),
        F.when(user % 4 == 0, F.array(F.lit(26))).otherwise(F.array().cast("array<int>")),
    )
    sent = flights(spark, sf_dir).withColumn("hours", F.explode(hours))
    return sent.withColumn("start_ts", F.col("start_ts") + F.make_dt_interval(hours=F.col("hours"))).drop("hours")
