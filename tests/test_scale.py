"""What the plans must look like, and that a hot flight neither changes results nor stays in one task."""

from __future__ import annotations

import re

import pytest
from compare import rows_of
from pyspark.sql import functions as F

from flightops.operators import lifecycle
from flightops.operators.history import state_changes
from flightops.operators.signals import accepted_signals
from flightops.plans.queries import QUERIES, Tables

NO_BROADCAST = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}


@pytest.fixture
def shuffled(spark):
    """Joins as they are planned for tables too large to broadcast."""
    before = {k: spark.conf.get(k, None) for k in NO_BROADCAST}
    for k, v in NO_BROADCAST.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.fixture
def small_skew(shuffled):
    """Thresholds low enough for the skew handling to act on test data."""
    conf = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1KB",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {k: shuffled.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        shuffled.conf.set(k, v)
    yield shuffled
    for k, v in before.items():
        shuffled.conf.unset(k) if v is None else shuffled.conf.set(k, v)


def _plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def _final_plan(frame) -> str:
    frame.write.format("noop").mode("overwrite").save()
    frame.collect()
    return _plan(frame)


def _rows(frame):
    return rows_of(frame.columns, [tuple(x) for x in frame.collect()])


@pytest.fixture(scope="module")
def hot(spark, sf_dir, tmp_path_factory):
    """The signals, plus half as many again for one flight, spread over its day."""
    t = Tables(spark, sf_dir)
    key = t.flights.orderBy("flight_key").first().flight_key
    path = str(tmp_path_factory.mktemp("hot"))
    start = t.flights.filter(F.col("flight_key") == key).first().start_ts
    extra = spark.range(0, 60_000, numPartitions=6).select(
        F.lit(key).alias("flight_key"),
        F.when(F.col("id") % 3 == 0, "changeGate").otherwise("announceDelay").alias("signal"),
        F.when(F.col("id") % 3 != 0, (F.col("id") % 90).cast("int")).alias("delay_minutes"),
        F.when(F.col("id") % 3 == 0, F.concat(F.lit("H"), F.col("id").cast("string"))).alias("gate"),
        F.lit(None).cast("string").alias("reason"),
        (F.col("id") + 1_000_000).alias("event_seq"),
        F.timestamp_add("SECOND", F.col("id"), F.lit(start)).alias("event_ts"),
    )
    t.signals.unionByName(extra).write.parquet(f"{path}/signals")
    t.flights.write.parquet(f"{path}/flights")
    return spark.read.parquet(f"{path}/flights"), spark.read.parquet(f"{path}/signals"), key


def test_no_query_pairs_everything_or_leaves_the_jvm(shuffled, sf_dir):
    for name, build in QUERIES.items():
        if name == "read_transitions":
            continue
        plan = _plan(build(shuffled, sf_dir))
        assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin|Python|ArrowEval", plan), name


def test_a_window_never_covers_all_signals_of_a_flight(shuffled, sf_dir):
    """Windows run over time buckets, over one row per bucket, or over rows with a bound per key."""
    t = Tables(shuffled, sf_dir)
    assert "Window" not in _plan(t.transitions)
    assert "Window" not in _plan(t.accepted)
    assert "Window" not in _plan(t.outcomes)
    changes = _plan(state_changes(t.transitions, t.accepted, t.flights))
    windows = re.findall(r"Window \[.*", changes)
    assert windows and all("_bucket" in w for w in windows)


def test_columns_and_filters_reach_the_scan(shuffled, hot):
    flights, signals, _ = hot
    plan = lifecycle.flight_details(flights, signals, "2024-01-15 12:00:00")._jdf.queryExecution().toString()
    assert "LessThanOrEqual(event_ts" in plan
    scan = re.findall(r"FileScan parquet \[[^\]]*delay_minutes[^\]]*\].*", plan)[0]
    assert "reason" not in scan.split("]")[0]
    moves = _plan(lifecycle.flight_transitions(flights, signals))
    assert "EqualTo(signal,cancelFlight)" in moves


def test_hot_flight_is_split_and_right(small_skew, hot):
    flights, signals, key = hot
    per_flight = lifecycle.transitions_with_context(flights, signals)
    plan = _final_plan(per_flight)
    assert "skew=true" in plan
    # Last values of the hot flight, found without the engine's operators.
    mine = signals.filter(F.col("flight_key") == key).toPandas().sort_values(["event_ts", "event_seq"])
    for row in per_flight.filter(F.col("flight_key") == key).collect():
        seen = mine[mine.event_ts <= row.timestamp]
        delays, gates = seen.delay_minutes.dropna(), seen.gate.dropna()
        assert row.delay == (int(delays.iloc[-1]) if len(delays) else 0)
        if len(gates):
            assert row.gate == gates.iloc[-1]


def test_hot_flight_routing_is_split(small_skew, hot):
    flights, signals, _ = hot
    accepted = accepted_signals(signals, lifecycle.flights_with_end(flights, signals))
    plan = _final_plan(accepted)
    assert "skew=true" in plan


def test_running_values_spread_a_hot_flight(small_skew, hot):
    flights, signals, key = hot
    accepted = accepted_signals(signals, lifecycle.flights_with_end(flights, signals))
    changes = state_changes(lifecycle.transitions_with_context(flights, signals), accepted, flights)
    mine = changes.filter((F.col("flight_key") == key) & (F.col("origin") == "operator"))
    rows = mine.orderBy("timestamp").toPandas()
    expected = accepted.filter(F.col("flight_key") == key).orderBy("event_ts", "event_seq").toPandas()
    assert len(rows) == len(expected)
    assert (rows.delay.to_numpy() == expected.delay_minutes.ffill().fillna(0).astype(int).to_numpy()).all()
    own = flights.filter(F.col("flight_key") == key).first().gate
    assert (rows.gate.to_numpy() == expected.gate.ffill().fillna(own).to_numpy()).all()


def test_signals_are_shuffled_once_for_the_fold(shuffled, hot):
    """One exchange of the signals, two narrow ones of the flights; both aggregations run in place."""
    flights, signals, _ = hot
    plan = _plan(lifecycle.transitions_with_context(flights, signals))
    exchanges = re.findall(r"Exchange hashpartitioning\((\w+)#", plan)
    assert exchanges == ["flight_key"] * 3


def _scans(frame) -> int:
    return len(re.findall(r"FileScan parquet .*?events\.parquet", frame._jdf.queryExecution().toString().split("== Physical Plan ==")[1]))


def test_state_changes_take_one_join_and_few_scans(shuffled, sf_dir):
    """What is joined is written once, so the plans that follow read the events for the flights' own rows only."""
    for name in ("state_changes", "write_state_changes", "transition_order_violations"):
        assert _scans(QUERIES[name](shuffled, sf_dir)) <= 1, name
    assert _scans(QUERIES["journey_transitions"](shuffled, sf_dir)) <= 6


def test_messages_of_signals_equal_those_of_judged_ones(spark, sf_dir):
    t = Tables(spark, sf_dir)
    assert _rows(t.state_changes) == _rows(state_changes(t.transitions, t.accepted_by_channel, t.flights))
