from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from flightops.functions import describe, keys, payload, times
from flightops.operators import enrich, signals
from flightops.plans.queries import Tables
from flightops.schemas import HISTORY_CATEGORIES, HISTORY_DESCRIPTIONS, RAW_MESSAGES
from flightops.sources.events import dead_letter_events, parse_flight_events, read_flight_events


def _message(**fields) -> str:
    good = {"eventType": "DELAY_ANNOUNCED", "flightNumber": "AA1234", "flightDate": "2026-01-27",
            "data": '{"delayMinutes":45}'}
    return json.dumps({k: v for k, v in {**good, **fields}.items() if v != "absent"})


def _raw(spark, *values: str):
    rows = [(i, None, "AA1234", value) for i, value in enumerate(values)]
    return spark.createDataFrame(rows, RAW_MESSAGES)


def _one(spark, expression, **columns):
    frame = spark.range(1)
    for name, (value, kind) in columns.items():
        frame = frame.withColumn(name, F.lit(value).cast(kind))
    return frame.select(expression.alias("x")).first().x


@pytest.mark.parametrize(
    ("value", "reason"),
    [
        (_message()[:-5], "bad_json"),
        ("", "bad_json"),
        ("not json", "bad_json"),
        ("[1, 2]", "missing_field"),
        (_message(flightNumber="absent"), "missing_field"),
        (_message(eventType="absent"), "missing_field"),
        (_message(flightDate=None), "missing_field"),
        (_message(eventType="DIVERTED"), "unknown_type"),
        (_message(eventType="delay_announced"), "unknown_type"),
        (_message(flightDate="2026/01/27"), "bad_date"),
        (_message(flightDate="2026-1-27"), "bad_date"),
        (_message(flightDate="2026-02-30"), "bad_date"),
    ],
)
def test_broken_messages_are_kept_with_a_reason(spark, value, reason):
    raw = _raw(spark, value)
    assert parse_flight_events(raw).count() == 0
    dead = dead_letter_events(raw).first()
    assert (dead.reason, dead.value) == (reason, value)


def test_messages_are_parsed_and_extra_fields_ignored(spark):
    raw = _raw(
        spark,
        _message(),
        _message(data="absent"),
        _message(data=None),
        _message(flightNumber=17, riskScore="HIGH"),
        _message(data={"delayMinutes": 5}),
        '{"eventType":"X",' + _message()[1:],
        _message() + " tail",
    )
    events = parse_flight_events(raw).orderBy("event_seq").collect()
    assert [e.data for e in events] == ['{"delayMinutes":45}', None, None, '{"delayMinutes":45}', "",
                                        '{"delayMinutes":45}', '{"delayMinutes":45}']
    assert [e.flight_number for e in events] == ["AA1234"] * 3 + ["17"] + ["AA1234"] * 3
    assert str(events[0].flight_date) == "2026-01-27"


@pytest.mark.parametrize(
    ("data", "minutes"),
    [
        ('{"delayMinutes":45}', 45), ('{"delayMinutes":"45"}', 45), ('{"delayMinutes":45.7}', 45),
        ('{"delayMinutes":"45.7"}', 45), ('{"delayMinutes":-5}', -5), ('{"delayMinutes":"soon"}', 0),
        ('{"delayMinutes":null}', 0), ('{"delayMinutes":true}', 1), ('{"delayMinutes":{}}', 0), ("{}", 0),
        ("not json", 0), ('{"delayMinutes":45', 0), (None, 0), ("", 0),
    ],
)
def test_delay_minutes(spark, data, minutes):
    assert _one(spark, payload.extract_delay_minutes(F.col("data")), data=(data, "string")) == minutes


@pytest.mark.parametrize(
    ("data", "gate"),
    [('{"gate":"C12"}', "C12"), ('{"gate":7}', "7"), ('{"gate":""}', ""), ('{"gate":["C12"]}', ""), ('{"gate":"[C]"}', "[C]"),
     ('{"gate":"C12"', ""), ("{}", ""), (None, "")],
)
def test_gate(spark, data, gate):
    assert _one(spark, payload.extract_gate(F.col("data")), data=(data, "string")) == gate


@pytest.mark.parametrize(("data", "reason"), [('{"reason":"Weather"}', "Weather"), ("{}", "Unknown reason"), (None, "Unknown reason")])
def test_reason(spark, data, reason):
    assert _one(spark, payload.extract_reason(F.col("data")), data=(data, "string")) == reason


def test_event_types_map_to_signals(spark):
    raw = _raw(
        spark,
        _message(),
        _message(eventType="GATE_CHANGED", data='{"gate":"C12"}'),
        _message(eventType="GATE_ASSIGNED", data="{}"),
        _message(eventType="FLIGHT_CANCELLED", data='{"reason":"Weather conditions"}'),
        _message(eventType="BOARDING_STARTED"),
    )
    events = parse_flight_events(raw)
    mapped = signals.events_to_signals(events).orderBy("event_seq").collect()
    assert [(s.signal, s.delay_minutes, s.gate, s.reason) for s in mapped] == [
        ("announceDelay", 45, None, None), ("changeGate", None, "C12", None), ("changeGate", None, "", None),
        ("cancelFlight", None, None, "Weather conditions"),
    ]
    assert {s.flight_key for s in mapped} == {"flight-AA1234-2026-01-27"}
    assert [e.event_type for e in signals.unmapped_events(events).collect()] == ["BOARDING_STARTED"]


def test_no_event_is_lost(spark, sf_dir):
    t = Tables(spark, sf_dir)
    raw = t.view("raw_messages")
    parsed = parse_flight_events(raw)
    assert parsed.count() + dead_letter_events(raw).count() == raw.count()
    assert signals.events_to_signals(parsed).count() + signals.unmapped_events(parsed).count() == parsed.count()
    routed = (t.accepted, signals.signals_without_flight(t.signals, t.flights),
              signals.signals_outside_window(t.signals, t.flights_with_end))
    assert sum(part.count() for part in routed) == t.signals.count()


def test_readers_of_folders(spark, tmp_path):
    raw = _raw(spark, _message(), "broken")
    raw.write.parquet(f"{tmp_path}/p")
    raw.write.json(f"{tmp_path}/j")
    raw.select("value").write.text(f"{tmp_path}/t")
    for fmt, folder in (("parquet", "p"), ("json", "j"), ("text", "t")):
        read = read_flight_events(spark, f"{tmp_path}/{folder}", fmt)
        assert read.schema.simpleString() == raw.schema.simpleString()
        assert [e.flight_number for e in parse_flight_events(read).collect()] == ["AA1234"]
    assert read_flight_events(spark, f"{tmp_path}/p", streaming=True).isStreaming


def test_keys(spark):
    for key, number in (("flight-JRN1-L2-2026-01-27", "JRN1"), ("flight-AA1234-2026-01-27", "AA1234"),
                        ("flight-", "flight-"), ("x", "x")):
        assert _one(spark, keys.flight_number_from_key(F.col("k")), k=(key, "string")) == number
    assert _one(spark, keys.is_flight_key(F.col("k")), k=("flight-AA1-2026-01-27", "string"))
    assert not _one(spark, keys.is_flight_key(F.col("k")), k=("journey-J1", "string"))
    assert _one(spark, keys.journey_key(F.col("k")), k=("J1", "string")) == "journey-J1"
    ranks = [_one(spark, keys.state_ordinal(F.col("s")), s=(s, "string")) for s in ("SCHEDULED", "CANCELLED", "X", None)]
    assert ranks == [0, 6, None, None]
    import datetime as dt

    given = _one(spark, keys.default_flight_date(F.col("d"), dt.date(2026, 1, 27)), d=(None, "date"))
    assert given == dt.date(2026, 1, 27)


@pytest.mark.parametrize(
    ("seconds", "text"),
    [(0, "PT0S"), (59, "PT59S"), (60, "PT1M"), (3600, "PT1H"), (3661, "PT1H1M1S"), (90000, "PT25H"), (1.5, "PT1.5S"),
     (0.25, "PT0.25S")],
)
def test_iso_duration(spark, seconds, text):
    end = f"timestamp_ntz'2026-01-27 00:00:00' + make_dt_interval(0, 0, 0, {seconds})"
    start = F.expr("timestamp_ntz'2026-01-27 00:00:00'")
    assert _one(spark, times.iso_duration(start, F.expr(end))) == text


@pytest.mark.parametrize(
    ("given", "text"),
    [("10:30:00", "10:30"), ("10:30:05", "10:30:05"), ("10:30:05.25", "10:30:05.250"), ("10:30:00.000001", "10:30:00.000001")],
)
def test_iso_local(spark, given, text):
    assert _one(spark, times.iso_local(F.expr(f"timestamp_ntz'2026-01-27 {given}'"))) == f"2026-01-27T{text}"


def test_event_time_in_a_zone(spark):
    ts = F.expr("timestamp_ntz'2026-01-26 14:32:15'")
    assert _one(spark, times.format_event_time(ts)) == "2026-01-26 14:32:15"
    assert _one(spark, times.format_event_time(ts, "America/New_York")) == "2026-01-26 09:32:15"


def test_history_texts(spark):
    def describe_type(kind, name=None):
        return _one(spark, describe.describe_history_event(F.col("t"), F.col("n")), t=(kind, "string"), n=(name, "string"))

    def category(kind):
        return _one(spark, describe.categorize_history_event(F.col("t")), t=(kind, "string"))

    assert describe_type("EVENT_TYPE_WORKFLOW_EXECUTION_SIGNALED", "changeGate") == "Signal received: changeGate"
    assert describe_type("EVENT_TYPE_ACTIVITY_TASK_SCHEDULED") == "activity task scheduled"
    assert describe_type("EVENT_TYPE_TIMER_FIRED") == HISTORY_DESCRIPTIONS["EVENT_TYPE_TIMER_FIRED"]
    assert category("EVENT_TYPE_ACTIVITY_TASK_SCHEDULED") == "other"
    assert category("EVENT_TYPE_MARKER_RECORDED") == "other"
    for name, kinds in HISTORY_CATEGORIES.items():
        assert category(kinds[-1]) == name


@pytest.mark.parametrize(("minutes", "risk"), [(30, "LOW"), (31, "MEDIUM"), (60, "MEDIUM"), (61, "HIGH"), (0, "LOW")])
def test_risk(spark, minutes, risk):
    assert _one(spark, describe.risk_score(F.lit(minutes))) == risk


def test_enrichment(spark):
    raw = _raw(spark, _message(), _message(eventType="BOARDING_STARTED", data="{}"))
    events = parse_flight_events(raw)
    plain = enrich.enriched_events(events, stamp="2026-01-27 10:30:00").orderBy("event_seq").collect()
    assert [(e.estimated_delay, e.risk_score) for e in plain] == [(45, "MEDIUM"), (0, "LOW")]
    assert str(plain[0].enriched_timestamp) == "2026-01-27 10:30:00"
    typed = enrich.enriched_events(events, {"BOARDING_STARTED": 70}).orderBy("event_seq").collect()
    assert [(e.estimated_delay, e.risk_score) for e in typed] == [(45, "MEDIUM"), (70, "HIGH")]


def test_request_checks(spark):
    good = ("AA1", "2026-01-27", "ORD", "DFW", "2026-01-27 10:00", "2026-01-27 12:00", "A1", "N1")
    schema = ("flight_number string, flight_date string, departure_station string, arrival_station string, "
              "scheduled_departure string, scheduled_arrival string, gate string, aircraft string")
    requests = spark.createDataFrame([good, (" ", None, "\t", "", None, None, None, " \n"), good[:6] + ("A1", None)], schema)
    found = [v.violations for v in signals.validate_flight_requests(requests).orderBy(F.size("violations")).collect()]
    assert found[0] == ["Aircraft is required"]
    assert len(found) == 2 and len(found[1]) == 8

    legs = requests.agg(F.collect_list(F.struct(*requests.columns)).alias("legs")).withColumn("journey_id", F.lit("J"))
    journeys = legs.unionByName(legs.withColumn("legs", F.slice("legs", 1, 0)).withColumn("journey_id", F.lit(None).cast("string")))
    by_id = {j.journey_id: j.violations for j in signals.validate_journeys(journeys).collect()}
    assert by_id[None] == ["Journey ID is required", "At least one flight leg is required"]
    assert len(by_id["J"]) == 9 and by_id["J"][-1] == "flights[2]: Aircraft is required"
    null_legs = journeys.filter("journey_id = 'J'").withColumn("legs", F.expr("if(true, null, legs)"))
    assert signals.validate_journeys(null_legs).first().violations == ["At least one flight leg is required"]

    sent = spark.createDataFrame(
        [("announceDelay", 0, None, None), ("announceDelay", 1, None, None), ("announceDelay", None, None, None),
         ("changeGate", None, " ", None), ("changeGate", None, "A", None), ("cancelFlight", None, None, "")],
        "signal string, delay_minutes int, gate string, reason string",
    )
    assert sorted(v.violation for v in signals.validate_signals(sent).collect()) == [
        "Cancellation reason is required", "Delay minutes is required", "Delay must be at least 1 minute",
        "New gate is required",
    ]
