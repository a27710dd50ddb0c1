"""Table schemas and the fixed values of the flight domain."""

from __future__ import annotations

# --- Fixed values -------------------------------------------------------------------------
# Lifecycle states in order; CANCELLED can follow any of the first four.
STATES = ("SCHEDULED", "BOARDING", "DEPARTED", "IN_FLIGHT", "LANDED", "COMPLETED", "CANCELLED")
TERMINAL_STATES = ("COMPLETED", "CANCELLED")
# A cancellation is looked at when one of the first four phases ends, never after LANDED.
CANCEL_BOUNDARIES = 4
PHASES = 5

EVENT_TYPES = (
    "FLIGHT_SCHEDULED",
    "GATE_ASSIGNED",
    "GATE_CHANGED",
    "DELAY_ANNOUNCED",
    "BOARDING_STARTED",
    "DEPARTURE",
    "ARRIVAL",
    "FLIGHT_CANCELLED",
)
SIGNAL_OF_EVENT = {
    "DELAY_ANNOUNCED": "announceDelay",
    "GATE_CHANGED": "changeGate",
    "GATE_ASSIGNED": "changeGate",
    "FLIGHT_CANCELLED": "cancelFlight",
}
DELAY, GATE, CANCEL = "announceDelay", "changeGate", "cancelFlight"

DEFAULT_DELAY = 0
DEFAULT_GATE = ""
DEFAULT_REASON = "Unknown reason"

# Risk thresholds in minutes, both exclusive.
HIGH_RISK_OVER = 60
MEDIUM_RISK_OVER = 30

TURNAROUND_SECONDS = 1
FEED_SIZE = 20

REQUIRED_MESSAGES = {
    "flight_number": "Flight number is required",
    "flight_date": "Flight date is required",
    "departure_station": "Departure station is required",
    "arrival_station": "Arrival station is required",
    "scheduled_departure": "Scheduled departure is required",
    "scheduled_arrival": "Scheduled arrival is required",
    "gate": "Gate is required",
    "aircraft": "Aircraft is required",
}
JOURNEY_ID_REQUIRED = "Journey ID is required"
LEGS_REQUIRED = "At least one flight leg is required"
DELAY_REQUIRED = "Delay minutes is required"
DELAY_TOO_SMALL = "Delay must be at least 1 minute"
GATE_REQUIRED = "New gate is required"
REASON_REQUIRED = "Cancellation reason is required"

STARTED_MESSAGE = "Flight workflow started"
CANCELLED_MESSAGE = "Flight cancelled: "

HISTORY_DESCRIPTIONS = {
    "EVENT_TYPE_WORKFLOW_EXECUTION_STARTED": "Workflow execution started",
    "EVENT_TYPE_WORKFLOW_EXECUTION_COMPLETED": "Workflow execution completed successfully",
    "EVENT_TYPE_WORKFLOW_EXECUTION_FAILED": "Workflow execution failed",
    "EVENT_TYPE_WORKFLOW_TASK_SCHEDULED": "Workflow task scheduled",
    "EVENT_TYPE_WORKFLOW_TASK_STARTED": "Workflow task started processing",
    "EVENT_TYPE_WORKFLOW_TASK_COMPLETED": "Workflow task completed",
    "EVENT_TYPE_TIMER_STARTED": "Timer started (state transition delay)",
    "EVENT_TYPE_TIMER_FIRED": "Timer fired (state transition triggered)",
    "EVENT_TYPE_MARKER_RECORDED": "Workflow marker recorded",
    "EVENT_TYPE_START_CHILD_WORKFLOW_EXECUTION_INITIATED": "Child workflow start initiated",
    "EVENT_TYPE_CHILD_WORKFLOW_EXECUTION_STARTED": "Child workflow execution started",
    "EVENT_TYPE_CHILD_WORKFLOW_EXECUTION_COMPLETED": "Child workflow execution completed",
    "EVENT_TYPE_WORKFLOW_EXECUTION_CANCELED": "Workflow execution canceled",
    "EVENT_TYPE_WORKFLOW_EXECUTION_TERMINATED": "Workflow execution terminated",
}
REQUEST_CHANNEL = "request"
SIGNALED_TYPE = "EVENT_TYPE_WORKFLOW_EXECUTION_SIGNALED"
FLIGHT_STARTED_TYPE = "EVENT_TYPE_WORKFLOW_EXECUTION_STARTED"
FLIGHT_ENDED_TYPE = "EVENT_TYPE_WORKFLOW_EXECUTION_COMPLETED"
TIMER_TYPES = ("EVENT_TYPE_TIMER_STARTED", "EVENT_TYPE_TIMER_FIRED")
LEG_STARTED_TYPE = "EVENT_TYPE_CHILD_WORKFLOW_EXECUTION_STARTED"
LEG_ENDED_TYPE = "EVENT_TYPE_CHILD_WORKFLOW_EXECUTION_COMPLETED"
# In the order in which events of the same time stand.
DOMAIN_EVENT_TYPES = (FLIGHT_STARTED_TYPE, SIGNALED_TYPE, FLIGHT_ENDED_TYPE, LEG_STARTED_TYPE, LEG_ENDED_TYPE)
SIGNALED_DESCRIPTION = "Signal received: "

HISTORY_CATEGORIES = {
    "lifecycle": (
        "EVENT_TYPE_WORKFLOW_EXECUTION_STARTED",
        "EVENT_TYPE_WORKFLOW_EXECUTION_COMPLETED",
        "EVENT_TYPE_WORKFLOW_EXECUTION_FAILED",
        "EVENT_TYPE_WORKFLOW_EXECUTION_CANCELED",
        "EVENT_TYPE_WORKFLOW_EXECUTION_TERMINATED",
    ),
    "signal": ("EVENT_TYPE_WORKFLOW_EXECUTION_SIGNALED",),
    "timer": ("EVENT_TYPE_TIMER_STARTED", "EVENT_TYPE_TIMER_FIRED"),
    "child_workflow": (
        "EVENT_TYPE_START_CHILD_WORKFLOW_EXECUTION_INITIATED",
        "EVENT_TYPE_CHILD_WORKFLOW_EXECUTION_STARTED",
        "EVENT_TYPE_CHILD_WORKFLOW_EXECUTION_COMPLETED",
    ),
    "task": (
        "EVENT_TYPE_WORKFLOW_TASK_SCHEDULED",
        "EVENT_TYPE_WORKFLOW_TASK_STARTED",
        "EVENT_TYPE_WORKFLOW_TASK_COMPLETED",
    ),
}
OTHER_CATEGORY = "other"
# --- End of fixed values ------------------------------------------------------------------

FLIGHT_FIELDS = (
    "flight_key string, flight_number string, flight_date date, departure_station string, "
    "arrival_station string, scheduled_departure timestamp_ntz, scheduled_arrival timestamp_ntz, "
    "gate string, aircraft string, previous_flight_number string, next_flight_number string, "
    "start_ts timestamp_ntz, phase_seconds array<int>"
)
SIGNALS = (
    "flight_key string, signal string, delay_minutes int, gate string, reason string, "
    "event_seq bigint, event_ts timestamp_ntz"
)
RAW_MESSAGES = "event_seq bigint, event_ts timestamp_ntz, key string, value string"
TRANSITIONS = (
    "id string, flight_key string, flight_number string, flight_date date, from_state string, "
    "to_state string, timestamp timestamp_ntz, gate string, delay int, aircraft string, "
    "event_type string, event_details string"
)
