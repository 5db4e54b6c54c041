"""Stored table layouts, OTLP request layouts and the promoted hot fields."""

from __future__ import annotations

METRICS = """
    event_date DATE, timestamp TIMESTAMP, ts_ns BIGINT, ingest_time TIMESTAMP, source STRING, name STRING,
    kind STRING, unit STRING, value DOUBLE, org_id STRING, user_hash STRING, session_id STRING, model STRING,
    language STRING, edit_type STRING, subtype STRING, start_type STRING, query_source STRING, tool_name STRING,
    decision STRING, department STRING, team_id STRING, cost_center STRING, region STRING, app_version STRING,
    entrypoint STRING, attributes MAP<STRING,STRING>, dedup_id STRING
"""

EVENTS = """
    event_date DATE, timestamp TIMESTAMP, ts_ns BIGINT, ingest_time TIMESTAMP, source STRING, event_type STRING,
    org_id STRING, user_hash STRING, session_id STRING, correlation_id STRING, model STRING, status_code STRING,
    decision STRING, numbers MAP<STRING,DOUBLE>, dims MAP<STRING,STRING>, department STRING, team_id STRING,
    region STRING, app_version STRING, attributes MAP<STRING,STRING>, redaction_flags ARRAY<STRING>,
    content_class STRING, content_keyid STRING, content_fields MAP<STRING,STRING>, dedup_id STRING
"""

PERSON_DIRECTORY = """
    org_id STRING, account_hash STRING, person_id STRING, display_name STRING, email STRING,
    external_id STRING, updated_at TIMESTAMP
"""

TEAM_MEMBERSHIP = "org_id STRING, account_hash STRING, team STRING, updated_at TIMESTAMP"

DIRECTORY_FILE = """
    org STRING, people ARRAY<STRUCT<accountUuid: STRING, displayName: STRING, email: STRING,
                                    externalId: STRING, personId: STRING>>
"""


def _names(ddl: str) -> list[str]:
    flat = " ".join(ddl.split())
    return [part.split()[0] for part in _split_top(flat)]


def _split_top(text: str) -> list[str]:
    parts, depth, start = [], 0, 0
    for i, ch in enumerate(text):
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            parts.append(text[start:i].strip())
            start = i + 1
    return [*parts, text[start:].strip()]


METRIC_COLUMNS = _names(METRICS)
EVENT_COLUMNS = _names(EVENTS)

# Map entries the query blocks read, stored a second time as flat columns of the
# deduplicated tables: Parquet cannot prune single map keys, so a query over the
# maps would read every attribute of every event.
HOT_DIMS = (
    "tool_name", "success", "mcp_server", "agent.name", "agent_type", "skill.name", "server_name",
    "plugin.name", "plugin.version", "marketplace.name", "plugin.scope", "enabled_via", "has_hooks", "has_mcp",
    "hook_event", "hook_source", "is_plugin", "transport_type", "from_mode", "to_mode", "trigger",
    "decision_source",
)
HOT_NUMBERS = (
    "duration_ms", "cost_usd", "skill_path_count", "command_path_count", "agent_path_count", "num_hooks",
    "num_success", "num_blocking", "num_cancelled", "num_non_blocking_error", "total_duration_ms", "status_code",
    "total_tokens", "total_tool_uses", "cache_read_tokens", "cache_creation_tokens", "input_tokens",
    "output_tokens", "response_length", "prompt_length",
)
HOT_ATTRIBUTES = ("effort", "agent.name", "start_type")


def hot_column(prefix: str, key: str) -> str:
    return f"{prefix}_{key.replace('.', '_')}"


# OTLP/JSON. Leaf values are read as text because integers may arrive as strings or
# numbers. Lists and key/value lists are read as JSON text, since a Spark schema cannot
# recurse; `otlp.nested_texts` works through them at any depth.
_SCALARS = "stringValue: STRING, boolValue: STRING, intValue: STRING, doubleValue: STRING"
ANY_VALUE = f"STRUCT<{_SCALARS}, arrayValue: STRUCT<values: STRING>, kvlistValue: STRUCT<values: STRING>>"
ATTRIBUTES = f"ARRAY<STRUCT<key: STRING, value: {ANY_VALUE}>>"
# An innermost list: its members are values or keys with values, in which lists are worked out already.
_WORKED_OUT = f"{_SCALARS}, arrayValue: STRUCT<values: STRUCT<list: STRING>>, kvlistValue: STRUCT<values: STRUCT<fields: STRING>>"
MEMBERS = f"ARRAY<STRUCT<key: STRING, value: STRUCT<{_WORKED_OUT}>, {_WORKED_OUT}>>"


_SCOPE = "scope: STRUCT<name: STRING, version: STRING>"
_POINTS = (
    f"STRUCT<dataPoints: ARRAY<STRUCT<attributes: {ATTRIBUTES}, timeUnixNano: STRING, "
    "startTimeUnixNano: STRING, asInt: STRING, asDouble: STRING>>>"
)
OTLP_METRICS = f"""
    resourceMetrics ARRAY<STRUCT<
        resource: STRUCT<attributes: {ATTRIBUTES}>,
        scopeMetrics: ARRAY<STRUCT<{_SCOPE},
            metrics: ARRAY<STRUCT<name: STRING, unit: STRING, sum: {_POINTS}, gauge: {_POINTS}>>>>>>,
    _corrupt_record STRING
"""
OTLP_LOGS = f"""
    resourceLogs ARRAY<STRUCT<
        resource: STRUCT<attributes: {ATTRIBUTES}>,
        scopeLogs: ARRAY<STRUCT<{_SCOPE},
            logRecords: ARRAY<STRUCT<timeUnixNano: STRING, observedTimeUnixNano: STRING, severityNumber: STRING,
                body: STRUCT<stringValue: STRING>, attributes: {ATTRIBUTES}>>>>>>,
    _corrupt_record STRING
"""
