"""DuckDB SQL for the registered queries, written apart from the Spark plans.

`VIEWS` are named subqueries over the given tables; a query text gets those it names as a
`WITH` list.
"""

from __future__ import annotations

import re

from flightops.plans.queries import AS_OF, HISTORY_DATE, LOOKUP_STATION, STAMP, TIGHT_MINUTES
from flightops.plans.views import ARRIVALS, CLICK_TYPES, DEPARTURES, GATE_LETTERS, HISTORY_TYPES, SIGNAL_NAMES
from flightops.schemas import (
    HISTORY_CATEGORIES,
    HISTORY_DESCRIPTIONS,
    REQUIRED_MESSAGES,
    SIGNALED_DESCRIPTION,
    SIGNALED_TYPE,
    STATES,
)


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _iso(ts: str) -> str:
    return (
        f"CASE WHEN epoch_us({ts}) % 60000000 = 0 THEN strftime({ts}, '%Y-%m-%dT%H:%M') "
        f"WHEN epoch_us({ts}) % 1000000 = 0 THEN strftime({ts}, '%Y-%m-%dT%H:%M:%S') "
        f"WHEN epoch_us({ts}) % 1000 = 0 THEN strftime({ts}, '%Y-%m-%dT%H:%M:%S.%g') "
        f"ELSE strftime({ts}, '%Y-%m-%dT%H:%M:%S.%f') END"
    )


def _text(value: str) -> str:
    return f"coalesce('\"' || {value} || '\"', 'null')"


def _described(kind: str, name: str) -> str:
    cases = " ".join(f"WHEN {kind} = '{t}' THEN '{text}'" for t, text in HISTORY_DESCRIPTIONS.items())
    return (
        f"CASE WHEN {kind} = '{SIGNALED_TYPE}' THEN '{SIGNALED_DESCRIPTION}' || coalesce({name}, '') {cases} "
        f"ELSE lower(replace(replace({kind}, 'EVENT_TYPE_', ''), '_', ' ')) END"
    )


def _category(kind: str) -> str:
    cases = " ".join(f"WHEN {kind} IN ({_list(ts)[1:-1]}) THEN '{c}'" for c, ts in HISTORY_CATEGORIES.items())
    return f"CASE {cases} ELSE 'other' END"


def _violations(flight: str, prefix: str = "''") -> str:
    """Messages of a flight request that lacks its station, gate or aircraft (nothing else is ever blank here)."""
    parts = [
        f"CASE WHEN trim(coalesce({flight}.{name}, '')) = '' THEN {prefix} || '{REQUIRED_MESSAGES[name]}' END"
        for name in ("departure_station", "gate", "aircraft")
    ]
    return f"[{', '.join(parts)}]"


VIEWS: dict[str, str] = {
    "src": """
        SELECT event_id, ts, user_id, event_type, value,
               CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
               CAST(ts AS DATE) AS d,
               CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS dn,
               'FL' || user_id AS fn,
               'flight-FL' || user_id || '-' || CAST(CAST(ts AS DATE) AS VARCHAR) AS fk
        FROM events""",
    "flights": f"""
        SELECT DISTINCT fk AS flight_key, fn AS flight_number, d AS flight_date, user_id AS u, dn,
               {_list(DEPARTURES)}[user_id % 10 + 1] AS departure_station,
               {_list(ARRIVALS)}[(user_id + dn) % 10 + 1] AS arrival_station,
               CAST(d AS TIMESTAMP) + to_hours(CAST(3 + user_id % 6 AS INTEGER)) AS scheduled_departure,
               CAST(d AS TIMESTAMP) + to_hours(CAST(3 + user_id % 6 + 2 + user_id % 4 AS INTEGER)) AS scheduled_arrival,
               {_list(GATE_LETTERS)}[user_id % 10 + 1] || (user_id % 20 + 1) AS gate,
               CASE WHEN (user_id + dn) % 3 <> 0 THEN 'N' || (100 + user_id % 50) END AS aircraft,
               CAST(d AS TIMESTAMP) AS start_ts
        FROM src WHERE (user_id + dn) % 11 <> 0""",
    "phases": """
        SELECT flight_key, p, 60 * (120 + (u * 7 + dn * 13 + p * 31) % 181) AS secs
        FROM flights, generate_series(0, 4) g(p)""",
    "timeline": f"""
        SELECT f.flight_key, CAST(o AS INTEGER) AS ordinal, {_list(STATES)}[o + 1] AS state,
               f.start_ts + to_seconds(CAST(coalesce(
                   (SELECT sum(secs) FROM phases x WHERE x.flight_key = f.flight_key AND x.p < o), 0) AS BIGINT)) AS entered_at
        FROM flights f, generate_series(0, 5) g(o)""",
    "typed": f"""
        SELECT CASE WHEN event_type = 'purchase' THEN 'DELAY_ANNOUNCED'
                    WHEN event_type = 'view' THEN 'GATE_CHANGED'
                    WHEN event_type = 'signup' THEN 'GATE_ASSIGNED'
                    WHEN event_type = 'error' AND k % 2 = 0 THEN 'FLIGHT_CANCELLED'
                    WHEN event_type = 'error' THEN 'DELAY_ANNOUNCED'
                    ELSE {_list(CLICK_TYPES)}[k % 4 + 1] END AS event_type,
               fn AS flight_number, d AS flight_date,
               CASE WHEN event_type = 'purchase' THEN '{{"delayMinutes":' || CAST(floor(value) AS BIGINT) || '}}'
                    WHEN event_type = 'view' THEN '{{"gate":"C' || k || '"}}'
                    WHEN event_type = 'signup' THEN '{{"gate":"B' || k || '"}}'
                    WHEN event_type = 'error' AND k % 2 = 0 THEN '{{"reason":"R' || k || '"}}'
                    ELSE '{{}}' END AS data,
               event_id AS event_seq, ts AS event_ts, fk AS flight_key
        FROM src""",
    "sig": """
        SELECT flight_key,
               CASE event_type WHEN 'DELAY_ANNOUNCED' THEN 'announceDelay'
                               WHEN 'FLIGHT_CANCELLED' THEN 'cancelFlight' ELSE 'changeGate' END AS signal,
               CASE WHEN event_type = 'DELAY_ANNOUNCED'
                    THEN coalesce(CAST(json_extract_string(data, '$.delayMinutes') AS INTEGER), 0) END AS delay_minutes,
               CASE WHEN event_type IN ('GATE_CHANGED', 'GATE_ASSIGNED')
                    THEN coalesce(json_extract_string(data, '$.gate'), '') END AS gate,
               CASE WHEN event_type = 'FLIGHT_CANCELLED'
                    THEN coalesce(json_extract_string(data, '$.reason'), 'Unknown reason') END AS reason,
               event_seq, event_ts
        FROM typed
        WHERE event_type IN ('DELAY_ANNOUNCED', 'GATE_CHANGED', 'GATE_ASSIGNED', 'FLIGHT_CANCELLED')""",
    "raw": """
        SELECT event_seq, event_ts, flight_number AS key,
               CASE WHEN event_seq % 97 = 1 THEN 'cut' WHEN event_seq % 89 = 1 THEN 'type'
                    WHEN event_seq % 83 = 1 THEN 'number' WHEN event_seq % 79 = 1 THEN 'date'
                    WHEN event_seq % 73 = 1 THEN 'no_data' WHEN event_seq % 71 = 1 THEN 'bad_data'
                    ELSE 'none' END AS rule,
               event_type, flight_number, flight_date, data
        FROM typed""",
    "messages": """
        SELECT *, '{"eventType":"' || CASE WHEN rule = 'type' THEN 'DIVERTED' ELSE event_type END || '"'
               || CASE WHEN rule = 'number' THEN '' ELSE ',"flightNumber":"' || flight_number || '"' END
               || ',"flightDate":"' || CASE WHEN rule = 'date' THEN strftime(flight_date, '%Y/%m/%d') ELSE strftime(flight_date, '%Y-%m-%d') END || '"'
               || CASE rule WHEN 'no_data' THEN '' WHEN 'bad_data' THEN ',"data":"not json"'
                       ELSE ',"data":"' || replace(data, '"', '\\"') || '"' END || '}' AS whole
        FROM raw""",
    "hit": """
        SELECT s.flight_key, min(s.event_ts) AS cancel_ts
        FROM sig s JOIN timeline b0 ON b0.flight_key = s.flight_key AND b0.ordinal = 0
                   JOIN timeline b4 ON b4.flight_key = s.flight_key AND b4.ordinal = 4
        WHERE s.signal = 'cancelFlight' AND s.event_ts BETWEEN b0.entered_at AND b4.entered_at
        GROUP BY 1""",
    "cancelled": """
        SELECT h.flight_key, h.cancel_ts, min(t.ordinal) AS ordinal, min(t.entered_at) AS effective_ts
        FROM hit h JOIN timeline t ON t.flight_key = h.flight_key
             AND t.ordinal BETWEEN 1 AND 4 AND t.entered_at >= h.cancel_ts
        GROUP BY 1, 2""",
    "entered": """
        SELECT t.flight_key, t.ordinal,
               CASE WHEN t.ordinal = c.ordinal THEN 'CANCELLED' ELSE t.state END AS to_state, t.entered_at AS timestamp
        FROM timeline t LEFT JOIN cancelled c ON c.flight_key = t.flight_key
        WHERE c.ordinal IS NULL OR t.ordinal <= c.ordinal""",
    "moves": """
        SELECT e.flight_key, f.flight_number, f.flight_date, e.ordinal,
               lag(e.to_state) OVER (PARTITION BY e.flight_key ORDER BY e.ordinal) AS from_state, e.to_state, e.timestamp
        FROM entered e JOIN flights f ON f.flight_key = e.flight_key""",
    "ends": "SELECT flight_key, min(timestamp) AS start_ts, max(timestamp) AS end_ts FROM entered GROUP BY 1",
    "accepted": """
        SELECT s.* FROM sig s JOIN ends e ON e.flight_key = s.flight_key AND s.event_ts BETWEEN e.start_ts AND e.end_ts""",
    "gates": "SELECT * FROM accepted WHERE signal = 'changeGate'",
    "delays": "SELECT * FROM accepted WHERE signal = 'announceDelay'",
    "trans": """
        SELECT m.flight_key || ':' || m.to_state AS id, m.flight_key, m.flight_number, m.flight_date,
               m.from_state, m.to_state, m.timestamp, coalesce(g.gate, f.gate, '') AS gate,
               coalesce(d.delay_minutes, 0) AS delay, f.aircraft, 'STATE_TRANSITION' AS event_type,
               'Flight transitioned from ' || coalesce(m.from_state, 'null') || ' to ' || m.to_state AS event_details
        FROM moves m JOIN flights f ON f.flight_key = m.flight_key
             ASOF LEFT JOIN gates g ON g.flight_key = m.flight_key AND m.timestamp >= g.event_ts
             ASOF LEFT JOIN delays d ON d.flight_key = m.flight_key AND m.timestamp >= d.event_ts""",
    "seen": f"""
        SELECT f.*,
               (SELECT arg_max(e.to_state, e.ordinal) FROM entered e
                WHERE e.flight_key = f.flight_key AND e.timestamp <= TIMESTAMP '{AS_OF}') AS current_state,
               coalesce((SELECT arg_max(x.gate, x.event_ts) FROM gates x
                WHERE x.flight_key = f.flight_key AND x.event_ts <= TIMESTAMP '{AS_OF}'), f.gate) AS shown_gate,
               coalesce((SELECT arg_max(x.delay_minutes, x.event_ts) FROM delays x
                WHERE x.flight_key = f.flight_key AND x.event_ts <= TIMESTAMP '{AS_OF}'), 0) AS delay
        FROM flights f""",
    "outcomes": """
        SELECT f.flight_key, f.flight_number, f.flight_date, f.departure_station, f.arrival_station,
               f.scheduled_departure, f.scheduled_arrival,
               CASE WHEN c.flight_key IS NULL THEN 'COMPLETED' ELSE 'CANCELLED' END AS current_state,
               coalesce((SELECT arg_max(x.gate, x.event_ts) FROM gates x WHERE x.flight_key = f.flight_key), f.gate) AS gate,
               f.aircraft,
               greatest(coalesce((SELECT arg_max(x.delay_minutes, x.event_ts) FROM delays x
                                  WHERE x.flight_key = f.flight_key), 0), 0) AS delay,
               e.end_ts
        FROM flights f JOIN ends e ON e.flight_key = f.flight_key
             LEFT JOIN cancelled c ON c.flight_key = f.flight_key""",
    "legs": """
        SELECT 'J' || u || 'W' || (dn // 7) AS journey_id, u, dn // 7 AS w,
               CAST(row_number() OVER (PARTITION BY u, dn // 7 ORDER BY flight_date) - 1 AS INTEGER) AS leg, f.*
        FROM flights f""",
    "lengths": "SELECT flight_key, sum(secs) AS total FROM phases GROUP BY 1",
    "planned": """
        SELECT l.*, first_value(l.start_ts) OVER w + to_seconds(CAST(coalesce(
                   sum(n.total + 1) OVER (PARTITION BY l.journey_id ORDER BY l.leg
                                          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT)) AS leg_start
        FROM legs l JOIN lengths n ON n.flight_key = l.flight_key
        WINDOW w AS (PARTITION BY l.journey_id ORDER BY l.leg)""",
    "jsig": """
        SELECT s.flight_key, s.signal, s.delay_minutes, s.gate, p.leg_start + (s.event_ts - p.start_ts) AS event_ts
        FROM sig s JOIN planned p ON p.flight_key = s.flight_key""",
    "jtime": """
        SELECT t.flight_key, t.ordinal, p.leg_start + (t.entered_at - p.start_ts) AS entered_at
        FROM timeline t JOIN planned p ON p.flight_key = t.flight_key""",
    "jcut": """
        SELECT s.flight_key, min(t.ordinal) AS ordinal
        FROM (SELECT x.flight_key, min(x.event_ts) AS cancel_ts
              FROM jsig x JOIN jtime a ON a.flight_key = x.flight_key AND a.ordinal = 0
                          JOIN jtime b ON b.flight_key = x.flight_key AND b.ordinal = 4
              WHERE x.signal = 'cancelFlight' AND x.event_ts BETWEEN a.entered_at AND b.entered_at GROUP BY 1) s
             JOIN jtime t ON t.flight_key = s.flight_key AND t.ordinal BETWEEN 1 AND 4 AND t.entered_at >= s.cancel_ts
        GROUP BY 1""",
    "jend": """
        SELECT t.flight_key, t.entered_at AS leg_end, coalesce(c.ordinal, 5) AS slot
        FROM jtime t LEFT JOIN jcut c ON c.flight_key = t.flight_key WHERE t.ordinal = coalesce(c.ordinal, 5)""",
    "jcancel": """
        SELECT journey_id, min(start_ts) + INTERVAL 30 HOUR AS cancel_ts FROM legs
        WHERE (u + w) % 5 = 0 GROUP BY 1""",
    "stops": """
        SELECT p.*, e.leg_end, e.slot,
               CASE WHEN c.flight_key IS NULL THEN 'COMPLETED' ELSE 'CANCELLED' END AS own_state,
               CASE WHEN p.leg_start >= j.cancel_ts THEN 'journey' WHEN c.flight_key IS NOT NULL THEN 'leg' END AS stop
        FROM planned p JOIN jend e ON e.flight_key = p.flight_key
             LEFT JOIN jcut c ON c.flight_key = p.flight_key
             LEFT JOIN jcancel j ON j.journey_id = p.journey_id""",
    "first_stop": "SELECT journey_id, min(leg) AS stop_leg FROM stops WHERE stop IS NOT NULL GROUP BY 1",
    "run": """
        SELECT s.*, f.stop_leg, CASE WHEN s.leg > f.stop_leg THEN 'cascade' WHEN s.leg = f.stop_leg THEN s.stop END AS cancelled_by,
               CASE WHEN s.leg >= f.stop_leg THEN 'CANCELLED' ELSE 'COMPLETED' END AS current_state,
               coalesce(s.leg < f.stop_leg OR (s.leg = f.stop_leg AND s.stop = 'leg'), true) AS ran
        FROM stops s LEFT JOIN first_stop f ON f.journey_id = s.journey_id""",
    "handed": """
        SELECT r.*, CASE WHEN r.stop_leg IS NULL OR r.leg <= r.stop_leg
                    THEN (SELECT arg_min(x.aircraft, x.leg) FROM legs x
                          WHERE x.journey_id = r.journey_id AND x.leg <= r.leg AND x.aircraft IS NOT NULL)
                    ELSE r.aircraft END AS flown
        FROM run r""",
    "execution": """
        SELECT h.journey_id, h.leg, h.flight_key, h.flight_number,
               CASE WHEN h.ran THEN h.leg_start END AS leg_start, CASE WHEN h.ran THEN h.leg_end END AS leg_end,
               h.current_state, h.cancelled_by,
               CASE WHEN h.ran THEN coalesce((SELECT arg_max(s.gate, s.event_ts) FROM jsig s
                    WHERE s.flight_key = h.flight_key AND s.signal = 'changeGate'
                          AND s.event_ts BETWEEN h.leg_start AND h.leg_end), h.gate) ELSE h.gate END AS gate,
               CASE WHEN h.ran THEN greatest(coalesce((SELECT arg_max(s.delay_minutes, s.event_ts) FROM jsig s
                    WHERE s.flight_key = h.flight_key AND s.signal = 'announceDelay'
                          AND s.event_ts BETWEEN h.leg_start AND h.leg_end), 0), 0) ELSE 0 END AS delay,
               h.flown AS aircraft, CASE WHEN h.ran THEN h.slot + 1 ELSE 0 END AS n_transitions
        FROM handed h""",
    "numbered": f"""
        SELECT fk AS flight_key, row_number() OVER (PARTITION BY fk ORDER BY ts) AS event_id, ts AS event_ts,
               {_list(HISTORY_TYPES)}[event_id % 18 + 1] AS event_type, {_list(SIGNAL_NAMES)}[k % 3 + 1] AS signal_name
        FROM src""",
    "trail": f"""
        SELECT flight_key, event_id, event_type, strftime(event_ts, '%Y-%m-%d %H:%M:%S') AS timestamp,
               {_described('event_type', 'signal_name')} AS description, {_category('event_type')} AS category
        FROM numbered""",
    "changes": f"""
        SELECT flight_key, flight_number, from_state AS previous_state, to_state AS new_state, timestamp, gate, delay,
               'lifecycle' AS origin
        FROM trans
        UNION ALL
        SELECT a.flight_key, f.flight_number, st.state,
               CASE WHEN a.signal = 'cancelFlight' THEN 'CANCELLED' ELSE st.state END, a.event_ts,
               coalesce((SELECT arg_max(x.gate, x.event_ts) FROM gates x
                         WHERE x.flight_key = a.flight_key AND x.event_ts <= a.event_ts), f.gate),
               coalesce((SELECT arg_max(x.delay_minutes, x.event_ts) FROM delays x
                         WHERE x.flight_key = a.flight_key AND x.event_ts <= a.event_ts), 0),
               'operator'
        FROM accepted a JOIN flights f ON f.flight_key = a.flight_key
             JOIN (SELECT s.event_seq, arg_max(t.state, t.ordinal) AS state FROM accepted s
                   JOIN timeline t ON t.flight_key = s.flight_key
                        AND (t.entered_at < s.event_ts OR t.ordinal = 0) GROUP BY 1) st
               ON st.event_seq = a.event_seq
        WHERE a.event_seq % 2 = 0""",
    "feed": """
        SELECT flight_number, 'SCHEDULED' AS state, 'Flight workflow started' AS message, epoch_us(start_ts) // 1000 AS timestamp
        FROM flights
        UNION ALL
        SELECT f.flight_number, 'CANCELLED', 'Flight cancelled: ' || a.reason, epoch_us(a.event_ts) // 1000
        FROM accepted a JOIN flights f ON f.flight_key = a.flight_key WHERE a.signal = 'cancelFlight'
              AND a.event_seq % 2 = 0""",
    "rebuilt": """
        SELECT flight_key, timestamp AS ts, 0 AS r, 0 AS seq, 'EVENT_TYPE_WORKFLOW_EXECUTION_STARTED' AS event_type, NULL AS name
        FROM moves WHERE ordinal = 0
        UNION ALL SELECT flight_key, event_ts, 1, event_seq, 'EVENT_TYPE_WORKFLOW_EXECUTION_SIGNALED', signal FROM accepted
        UNION ALL SELECT flight_key, timestamp, 4, 0, 'EVENT_TYPE_WORKFLOW_EXECUTION_COMPLETED', NULL
        FROM moves WHERE to_state IN ('COMPLETED', 'CANCELLED')
        UNION ALL SELECT 'journey-' || journey_id, leg_start, 5, leg, 'EVENT_TYPE_CHILD_WORKFLOW_EXECUTION_STARTED', NULL
        FROM execution WHERE leg_start IS NOT NULL
        UNION ALL SELECT 'journey-' || journey_id, leg_end, 6, leg, 'EVENT_TYPE_CHILD_WORKFLOW_EXECUTION_COMPLETED', NULL
        FROM execution WHERE leg_start IS NOT NULL""",
    "dwell": """
        SELECT * FROM (SELECT flight_key, to_state AS state, timestamp AS entered_at,
                       lead(timestamp) OVER (PARTITION BY flight_key ORDER BY ordinal) AS left_at FROM moves)
        WHERE left_at IS NOT NULL""",
    "enriched": f"""
        SELECT event_type, flight_number, flight_date, data, event_seq, event_ts,
               coalesce(CAST(json_extract_string(data, '$.delayMinutes') AS INTEGER), 0) AS estimated_delay,
               CASE WHEN coalesce(CAST(json_extract_string(data, '$.delayMinutes') AS INTEGER), 0) > 60 THEN 'HIGH'
                    WHEN coalesce(CAST(json_extract_string(data, '$.delayMinutes') AS INTEGER), 0) > 30 THEN 'MEDIUM'
                    ELSE 'LOW' END AS risk_score,
               TIMESTAMP '{STAMP}' AS enriched_timestamp
        FROM typed""",
    "past_route": """
        SELECT departure_station, arrival_station, flight_date, round(sum(s) OVER w / sum(n) OVER w, 6) AS route_avg_delay
        FROM (SELECT departure_station, arrival_station, flight_date, sum(delay) AS s, count(*) AS n FROM outcomes GROUP BY 1, 2, 3)
        WINDOW w AS (PARTITION BY departure_station, arrival_station ORDER BY flight_date
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    "by_route": """
        SELECT departure_station, arrival_station, count(*) AS n_flights, round(avg(delay), 6) AS avg_delay,
               max(delay) AS max_delay
        FROM outcomes GROUP BY 1, 2""",
    "sent_starts": """
        SELECT f.flight_key, f.u, h, f.start_ts + to_hours(h) AS start_ts FROM flights f, (VALUES (0), (8), (26)) x(h)
        WHERE h = 0 OR (h = 8 AND u % 3 = 0) OR (h = 26 AND u % 4 = 0)""",
    "sent_hits": """
        SELECT s.flight_key, s.h, min(g.event_ts) AS cancel_ts
        FROM sent_starts s JOIN timeline b ON b.flight_key = s.flight_key AND b.ordinal = 4
             JOIN sig g ON g.flight_key = s.flight_key AND g.signal = 'cancelFlight'
                  AND g.event_ts BETWEEN s.start_ts AND b.entered_at + to_hours(s.h) GROUP BY 1, 2""",
    "sent_ends": """
        SELECT s.flight_key, s.h, s.start_ts, min(t.entered_at + to_hours(s.h)) AS end_ts
        FROM sent_starts s LEFT JOIN sent_hits c ON c.flight_key = s.flight_key AND c.h = s.h
             JOIN timeline t ON t.flight_key = s.flight_key AND (t.ordinal = 5
                  OR (t.ordinal BETWEEN 1 AND 4 AND t.entered_at + to_hours(s.h) >= c.cancel_ts))
        GROUP BY 1, 2, 3""",
    "sent_chain": """
        SELECT a.flight_key, a.start_ts AS s0, a.end_ts AS e0, b.start_ts AS s1, b.end_ts AS e1, b.start_ts > a.end_ts AS ok1, c.start_ts AS s2
        FROM sent_ends a LEFT JOIN sent_ends b ON b.flight_key = a.flight_key AND b.h = 8
             LEFT JOIN sent_ends c ON c.flight_key = a.flight_key AND c.h = 26 WHERE a.h = 0""",
    "asked": """
        SELECT flight_key, u, aircraft, CASE WHEN u % 13 <> 0 THEN gate END AS gate,
               CASE WHEN u % 17 = 0 THEN '  ' ELSE departure_station END AS departure_station,
               flight_number, flight_date, arrival_station, scheduled_departure, scheduled_arrival
        FROM flights""",
}

_TRANSITION_COLUMNS = (
    "id, flight_key, flight_number, flight_date, from_state, to_state, timestamp, gate, delay, aircraft, "
    "event_type, event_details"
)

TEXTS: dict[str, str] = {
    "parse_flight_events": """
        SELECT event_type, flight_number, flight_date,
               CASE rule WHEN 'no_data' THEN NULL WHEN 'bad_data' THEN 'not json' ELSE data END AS data, event_seq, event_ts
        FROM raw WHERE rule IN ('none', 'no_data', 'bad_data')""",
    "dead_letter_events": """
        SELECT event_seq, event_ts, key, CASE WHEN rule = 'cut' THEN left(whole, length(whole) - 5) ELSE whole END AS value,
               CASE rule WHEN 'cut' THEN 'bad_json' WHEN 'type' THEN 'unknown_type' WHEN 'number' THEN 'missing_field'
                    ELSE 'bad_date' END AS reason
        FROM messages WHERE rule IN ('cut', 'type', 'number', 'date')""",
    "flights_from_requests": f"""
        SELECT flight_key, flight_number, flight_date, departure_station, arrival_station, scheduled_departure,
               scheduled_arrival, 'SCHEDULED' AS current_state, gate, aircraft, 0 AS delay
        FROM asked a WHERE len(list_filter({_violations('a')}, lambda x: x IS NOT NULL)) = 0""",
    "rejected_starts": """
        SELECT flight_key, s1 AS start_ts, s0 AS running_since, e0 AS running_until FROM sent_chain WHERE NOT ok1
        UNION ALL SELECT flight_key, s2, CASE WHEN ok1 THEN s1 ELSE s0 END, CASE WHEN ok1 THEN e1 ELSE e0 END
        FROM sent_chain WHERE s2 <= CASE WHEN ok1 THEN e1 ELSE e0 END""",
    "journey_legs": """
        SELECT journey_id, 'journey-' || journey_id AS journey_key, leg, flight_number, flight_date, departure_station,
               arrival_station, scheduled_departure, scheduled_arrival, gate, aircraft, start_ts, flight_key
        FROM legs""",
    "read_transitions": f"SELECT {_TRANSITION_COLUMNS} FROM trans",
    "write_state_changes": f"""
        SELECT flight_number AS key, '{{"flightNumber":"' || flight_number || '","previousState":' || {_text('previous_state')}
               || ',"newState":"' || new_state || '","timestamp":"' || {_iso('timestamp')} || '","gate":' || {_text('gate')}
               || ',"delay":' || delay || '}}' AS value
        FROM changes""",
    "live_state_events": "SELECT * FROM feed",
    "export_history": f"""
        SELECT flight_key, regexp_extract(flight_key, '^flight-(.*)-[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$', 1) AS flight_number,
               TIMESTAMP '{AS_OF}' AS exported_at, event_id, event_type, timestamp, description, category
        FROM trail""",
    "export_envelopes": f"""
        SELECT flight_key, regexp_extract(flight_key, '^flight-(.*)-[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$', 1) AS flight_number,
               TIMESTAMP '{AS_OF}' AS exported_at, count(*) AS event_count
        FROM trail GROUP BY 1""",
    "events_to_signals": "SELECT * FROM sig",
    "unmapped_events": """
        SELECT event_type, flight_number, flight_date, data, event_seq, event_ts FROM typed
        WHERE event_type IN ('FLIGHT_SCHEDULED', 'BOARDING_STARTED', 'DEPARTURE', 'ARRIVAL')""",
    "dedup_replayed_events": "SELECT event_type, flight_number, flight_date, data, event_seq, event_ts FROM typed",
    "validate_flight_requests": f"""
        SELECT flight_key, array_to_string(list_filter({_violations('a')}, lambda x: x IS NOT NULL), '; ') AS violations
        FROM asked a WHERE len(list_filter({_violations('a')}, lambda x: x IS NOT NULL)) > 0""",
    "validate_journeys": f"""
        SELECT journey_id, CAST(CASE WHEN any_value(u) % 19 = 0 THEN 0 ELSE count(*) END AS INTEGER) AS n_legs,
               CASE WHEN any_value(u) % 19 = 0 THEN 'At least one flight leg is required'
                    ELSE string_agg(found, '; ' ORDER BY leg) END AS violations
        FROM (SELECT l.*, nullif(array_to_string(list_filter(
                     {_violations('l', "'flights[' || l.leg || ']: '")}, lambda x: x IS NOT NULL), '; '), '') AS found FROM legs l)
        GROUP BY 1 HAVING any_value(u) % 19 = 0 OR count(found) > 0""",
    "validate_signals": "SELECT *, 'Delay must be at least 1 minute' AS violation FROM sig WHERE delay_minutes < 1",
    "enriched_events": "SELECT * FROM enriched",
    "phase_timeline": "SELECT flight_key, ordinal, state, entered_at FROM timeline",
    "total_duration": "SELECT flight_key, CAST(sum(secs) AS INTEGER) AS total_seconds FROM phases GROUP BY 1",
    "effective_cancellations": f"""
        SELECT flight_key, cancel_ts, effective_ts, {_list(STATES)}[ordinal] AS from_state FROM cancelled""",
    "flight_transitions": """
        SELECT flight_key, flight_number, flight_date, from_state, to_state, timestamp FROM moves""",
    "transitions_with_context": f"SELECT {_TRANSITION_COLUMNS} FROM trans",
    "flight_details": """
        SELECT flight_key, flight_number, flight_date, departure_station, arrival_station, scheduled_departure,
               scheduled_arrival, current_state, shown_gate AS gate, aircraft, delay
        FROM seen""",
    "flight_outcome": "SELECT * FROM outcomes",
    "latest_signals": """
        SELECT flight_key, arg_max(delay_minutes, event_ts) FILTER (signal = 'announceDelay') AS last_delay,
               arg_max(gate, event_ts) FILTER (signal = 'changeGate') AS last_gate,
               min(event_ts) FILTER (signal = 'cancelFlight') AS first_cancel_ts,
               arg_max(reason, event_ts) FILTER (signal = 'cancelFlight') AS last_reason
        FROM accepted GROUP BY 1""",
    "transition_order_violations": f"""
        SELECT flight_key, to_state, timestamp, origin, previous_to_state FROM (
            SELECT flight_key, new_state AS to_state, timestamp, origin,
                   lag(new_state) OVER (PARTITION BY flight_key ORDER BY timestamp, origin, new_state) AS previous_to_state
            FROM changes)
        WHERE to_state <> 'CANCELLED'
              AND list_position({_list(STATES)}, to_state) <= list_position({_list(STATES)}, previous_to_state)""",
    "journey_links": """
        SELECT journey_id, leg, flight_number, lag(flight_number) OVER w AS previous_flight_number,
               lead(flight_number) OVER w AS next_flight_number, flight_key
        FROM legs WINDOW w AS (PARTITION BY journey_id ORDER BY leg)""",
    "journey_sizes": "SELECT journey_id, CAST(count(*) AS INTEGER) AS n_legs FROM legs GROUP BY 1",
    "journey_schedule": "SELECT journey_id, leg, flight_key, leg_start FROM planned",
    "journey_execution": "SELECT * FROM execution",
    "journey_transitions": f"""
        SELECT e.flight_key || ':' || e.to_state AS id, e.flight_key, h.flight_number, h.flight_date, e.from_state, e.to_state,
               e.timestamp,
               coalesce((SELECT arg_max(s.gate, s.event_ts) FROM jsig s
                    WHERE s.flight_key = e.flight_key AND s.signal = 'changeGate'
                          AND s.event_ts BETWEEN h.leg_start AND e.timestamp), h.gate, '') AS gate,
               coalesce((SELECT arg_max(s.delay_minutes, s.event_ts) FROM jsig s
                    WHERE s.flight_key = e.flight_key AND s.signal = 'announceDelay'
                          AND s.event_ts BETWEEN h.leg_start AND e.timestamp), 0) AS delay,
               'STATE_TRANSITION' AS event_type,
               'Flight transitioned from ' || coalesce(e.from_state, 'null') || ' to ' || e.to_state AS event_details,
               h.journey_id, h.leg, h.flown AS aircraft
        FROM (SELECT *, lag(to_state) OVER (PARTITION BY flight_key ORDER BY ordinal) AS from_state
              FROM (SELECT t.flight_key, t.ordinal, t.entered_at AS timestamp,
                           CASE WHEN t.ordinal = c.ordinal THEN 'CANCELLED' ELSE {_list(STATES)}[t.ordinal + 1] END AS to_state
                    FROM jtime t LEFT JOIN jcut c ON c.flight_key = t.flight_key
                    WHERE c.ordinal IS NULL OR t.ordinal <= c.ordinal)) e
             JOIN handed h ON h.flight_key = e.flight_key WHERE h.ran""",
    "cascade_cancellations": """
        SELECT journey_id, leg, flight_key, own_state, current_state, cancelled_by FROM run""",
    "rejected_journey_signals": """
        SELECT journey_id, 'Weather' AS reason, min(start_ts) - INTERVAL 2 HOUR AS event_ts, 'before_start' AS problem
        FROM legs WHERE (u + w) % 10 = 5 GROUP BY 1""",
    "aircraft_handoff": "SELECT journey_id, leg, flight_key, flown AS aircraft FROM handed",
    "journey_status": """
        SELECT journey_id, leg AS position, leg, flight_number, current_state, gate, delay, aircraft FROM execution""",
    "current_leg_index": """
        SELECT journey_id, coalesce(min(leg) FILTER (current_state = 'CANCELLED'), max(leg)) AS current_leg_index
        FROM execution GROUP BY 1""",
    "accepted_signals": "SELECT * FROM accepted",
    "signals_without_flight": "SELECT * FROM sig WHERE flight_key NOT IN (SELECT flight_key FROM flights)",
    "signals_outside_window": """
        SELECT s.*, CASE WHEN s.event_ts < e.start_ts THEN 'before_start' ELSE 'after_end' END AS problem
        FROM sig s JOIN ends e ON e.flight_key = s.flight_key
        WHERE s.event_seq NOT IN (SELECT event_seq FROM accepted)""",
    "known_flights_signalled": """
        SELECT flight_key, flight_number, flight_date FROM flights
        WHERE flight_key IN (SELECT flight_key FROM accepted)""",
    "active_flights": f"""
        SELECT flight_key, flight_number, current_state, shown_gate AS gate, delay, start_ts AS start_time,
               'PT' || CASE WHEN s // 3600 > 0 THEN (s // 3600) || 'H' ELSE '' END
                    || CASE WHEN s // 60 % 60 > 0 THEN (s // 60 % 60) || 'M' ELSE '' END
                    || CASE WHEN s % 60 > 0 OR s = 0 THEN (s % 60) || 'S' ELSE '' END AS elapsed
        FROM (SELECT *, epoch_us(TIMESTAMP '{AS_OF}') // 1000000 - epoch_us(start_ts) // 1000000 AS s FROM seen)
        WHERE current_state NOT IN ('COMPLETED', 'CANCELLED')""",
    "transitions_for_flight": f"""
        SELECT {_TRANSITION_COLUMNS} FROM trans
        WHERE flight_number IN (SELECT flight_number FROM flights WHERE departure_station = '{LOOKUP_STATION}')""",
    "transitions_for_flight_date": f"""
        SELECT {_TRANSITION_COLUMNS} FROM trans WHERE flight_date = DATE '{HISTORY_DATE}'
        AND flight_number IN (SELECT flight_number FROM flights WHERE departure_station = '{LOOKUP_STATION}')""",
    "audit_trail": "SELECT * FROM trail",
    "build_audit_trail": f"""
        SELECT flight_key, row_number() OVER (PARTITION BY flight_key ORDER BY ts, r, seq) AS event_id, event_type,
               strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp, {_described('event_type', 'name')} AS description,
               {_category('event_type')} AS category
        FROM rebuilt""",
    "state_changes": "SELECT * FROM changes",
    "recent_events": """
        SELECT * FROM feed ORDER BY timestamp DESC, flight_number DESC, state, message LIMIT 20""",
    "latest_by_flight_number": """
        SELECT flight_number, flight_key, from_state, to_state, timestamp, gate, delay FROM (
            SELECT *, row_number() OVER (PARTITION BY flight_number ORDER BY timestamp DESC, flight_key DESC) AS n FROM trans)
        WHERE n = 1""",
    "history_counts": """
        SELECT flight_key, category, count(*) AS n_events FROM trail GROUP BY 1, 2
        UNION ALL SELECT flight_key, 'total', count(*) FROM trail GROUP BY 1""",
    "history_milestones": """
        SELECT flight_key, bool_or(event_type = 'EVENT_TYPE_WORKFLOW_EXECUTION_STARTED') AS has_started,
               bool_or(event_type = 'EVENT_TYPE_WORKFLOW_EXECUTION_COMPLETED') AS has_completed,
               bool_or(event_type IN ('EVENT_TYPE_TIMER_STARTED', 'EVENT_TYPE_TIMER_FIRED')) AS has_timer,
               bool_or(event_type = 'EVENT_TYPE_WORKFLOW_EXECUTION_SIGNALED') AS has_signal
        FROM trail GROUP BY 1""",
    "avg_delay_by_route": "SELECT * FROM by_route",
    "avg_delay_by_hour": """
        SELECT CAST(hour(scheduled_departure) AS INTEGER) AS departure_hour, count(*) AS n_flights,
               round(avg(delay), 6) AS avg_delay, max(delay) AS max_delay
        FROM outcomes GROUP BY 1""",
    "time_in_state": "SELECT *, CAST(epoch(left_at) - epoch(entered_at) AS BIGINT) AS seconds FROM dwell",
    "phase_bottlenecks": """
        SELECT state, count(*) AS n_flights, round(avg(secs), 6) AS mean_seconds,
               round(quantile_cont(secs, 0.5), 6) AS p50_seconds, round(quantile_cont(secs, 0.95), 6) AS p95_seconds
        FROM (SELECT state, epoch(left_at) - epoch(entered_at) AS secs FROM dwell)
        GROUP BY 1 ORDER BY mean_seconds DESC, state LIMIT 3""",
    "actual_vs_scheduled": """
        SELECT f.flight_key,
               CAST(epoch(min(m.timestamp) FILTER (m.to_state = 'DEPARTED')) - epoch(f.scheduled_departure) AS BIGINT)
                   AS departure_variance_seconds,
               CAST(epoch(min(m.timestamp) FILTER (m.to_state = 'LANDED')) - epoch(f.scheduled_arrival) AS BIGINT)
                   AS arrival_variance_seconds
        FROM flights f JOIN moves m ON m.flight_key = f.flight_key
        GROUP BY f.flight_key, f.scheduled_departure, f.scheduled_arrival""",
    "on_time_performance": """
        SELECT departure_station, arrival_station, flight_date, count(*) AS n_flights,
               round(avg(CASE WHEN delay <= 15 THEN 1 ELSE 0 END), 6) AS on_time_share
        FROM outcomes GROUP BY 1, 2, 3""",
    "ops_kpis": """
        SELECT CASE WHEN grouping(flight_date) = 1 THEN 'ALL' ELSE CAST(flight_date AS VARCHAR) END AS day,
               CASE WHEN grouping(departure_station) = 1 THEN 'ALL' ELSE departure_station END AS station,
               count(*) AS n_flights, count(*) FILTER (current_state = 'CANCELLED') AS n_cancelled,
               count(*) FILTER (current_state = 'COMPLETED') AS n_completed, count(*) FILTER (delay > 0) AS n_delayed,
               round(avg(CASE WHEN current_state = 'CANCELLED' THEN 1 ELSE 0 END), 6) AS cancel_rate
        FROM outcomes GROUP BY ROLLUP (flight_date, departure_station)""",
    "delay_windows": """
        SELECT w AS window_start, w + INTERVAL 1 HOUR AS window_end, count(*) AS n_delays,
               round(avg(delay_minutes), 6) AS avg_minutes, max(delay_minutes) AS max_minutes
        FROM (SELECT delay_minutes, unnest([time_bucket(INTERVAL 30 MINUTE, event_ts),
                     time_bucket(INTERVAL 30 MINUTE, event_ts) - INTERVAL 30 MINUTE]) AS w
              FROM sig WHERE signal = 'announceDelay')
        GROUP BY 1""",
    "flight_patterns_by_date": """
        SELECT o.flight_number, count(*) AS n_dates, any_value(m.current_state) AS usual_outcome,
               round(avg(o.delay), 6) AS avg_delay,
               round(avg(CASE WHEN o.current_state = 'CANCELLED' THEN 1 ELSE 0 END), 6) AS cancel_rate
        FROM outcomes o JOIN (
            SELECT flight_number, current_state,
                   row_number() OVER (PARTITION BY flight_number ORDER BY count(*) DESC, current_state) AS n
            FROM outcomes GROUP BY 1, 2) m ON m.flight_number = o.flight_number AND m.n = 1
        GROUP BY 1""",
    "transitions_near_events": """
        SELECT m.flight_key, m.to_state, m.timestamp, s.ts AS external_ts, s.k,
               epoch_us(s.ts) - epoch_us(m.timestamp) AS offset_micros
        FROM moves m JOIN src s ON s.fk = m.flight_key AND s.event_type = 'error'
             AND s.ts BETWEEN m.timestamp - INTERVAL 10 MINUTE AND m.timestamp + INTERVAL 10 MINUTE""",
    "transitions_by_state": f"SELECT {_TRANSITION_COLUMNS} FROM trans WHERE to_state = 'CANCELLED'",
    "event_patterns": """
        SELECT * FROM (
            SELECT k.flight_key,
                   (SELECT count(*) FROM (SELECT event_ts, lag(event_ts) OVER (ORDER BY event_ts) AS p FROM sig s
                     WHERE s.flight_key = k.flight_key AND s.signal = 'changeGate') WHERE event_ts - p <= INTERVAL 2 HOUR)
                   AS n_rapid_gate_changes,
                   EXISTS (SELECT 1 FROM sig a JOIN sig b ON b.flight_key = a.flight_key AND b.signal = 'cancelFlight'
                           AND a.event_ts < b.event_ts
                           WHERE a.flight_key = k.flight_key AND a.signal = 'announceDelay') AS delay_then_cancel
            FROM (SELECT DISTINCT flight_key FROM sig) k)
        WHERE n_rapid_gate_changes > 0 OR delay_then_cancel""",
    "connection_slack": f"""
        SELECT journey_id, leg, flight_key, slack_minutes, slack_minutes < {TIGHT_MINUTES} AS tight FROM (
            SELECT l.journey_id, l.leg, l.flight_key,
                   CAST((epoch(n.scheduled_departure) - epoch(l.scheduled_arrival)) / 60 - x.delay AS DOUBLE) AS slack_minutes
            FROM legs l JOIN legs n ON n.journey_id = l.journey_id AND n.leg = l.leg + 1
                 JOIN execution x ON x.flight_key = l.flight_key)""",
    "station_load": """
        SELECT departure_station AS station, hour, count(*) AS n_open FROM (
            SELECT f.departure_station,
                   unnest(generate_series(date_trunc('hour', e.start_ts), date_trunc('hour', e.end_ts), INTERVAL 1 HOUR)) AS hour
            FROM flights f JOIN ends e ON e.flight_key = f.flight_key)
        GROUP BY 1, 2""",
    "history_enriched_events": """
        SELECT t.*, f.departure_station, f.arrival_station, r.route_avg_delay
        FROM typed t LEFT JOIN flights f ON f.flight_key = t.flight_key
             LEFT JOIN past_route r ON r.departure_station = f.departure_station
                  AND r.arrival_station = f.arrival_station AND r.flight_date = t.flight_date""",
    "risk_mix": """
        SELECT flight_date, count(*) FILTER (risk_score = 'LOW') AS n_low,
               count(*) FILTER (risk_score = 'MEDIUM') AS n_medium, count(*) FILTER (risk_score = 'HIGH') AS n_high
        FROM enriched GROUP BY 1""",
}


def _needed(text: str, found: set[str]) -> set[str]:
    for name in VIEWS:
        if name not in found and re.search(rf"\b(FROM|JOIN)\s+{name}\b", text):
            found.add(name)
            _needed(VIEWS[name], found)
    return found


def oracle_sql() -> dict[str, str]:
    texts = {}
    for name, text in TEXTS.items():
        needed = _needed(text, set())
        subqueries = ",\n".join(f"{view} AS ({VIEWS[view]})" for view in VIEWS if view in needed)
        texts[name] = f"WITH {subqueries}\n{text}"
    return texts
