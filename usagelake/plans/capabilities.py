"""Plugins, hooks, MCP servers, skills and permission modes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagelake import fixed_values as fx
from usagelake.functions.maps import count_if, day_text, dim, label, number, total_of, zero
from usagelake.operators.relational import descending, top_n, with_latest
from usagelake.plans import blocks as b

_PLUGIN_TEXTS = {
    "version": "plugin.version",
    "marketplace": "marketplace.name",
    "scope": "plugin.scope",
    "enabled_via": "enabled_via",
}
_PLUGIN_COUNTS = {
    "skills": "skill_path_count",
    "commands": "command_path_count",
    "agents": "agent_path_count",
}


def _plugin_events(e) -> DataFrame:
    return b.event(e, "plugin").withColumn("name", dim(e, "plugin.name"))


def _plugin_facts(rows: DataFrame) -> DataFrame:
    """One row of facts per plugin; a count that is missing takes part as 0."""

    def flag(key: str) -> Column:
        return F.coalesce(dim(rows, key) == "true", F.lit(False))

    texts = {c: F.coalesce(dim(rows, key), F.lit("")) for c, key in _PLUGIN_TEXTS.items()}
    return with_latest(
        rows,
        ["name"],
        texts | {"has_hooks": flag("has_hooks"), "has_mcp": flag("has_mcp")},
        {f"_{c}": F.max(zero(number(rows, key))) for c, key in _PLUGIN_COUNTS.items()} | {"_events": F.count("*")},
        {c: zero(F.max(f"_{c}")) for c in _PLUGIN_COUNTS} | {"events": F.sum("_events")},
    )


def plugins(e) -> DataFrame:
    return descending(_plugin_facts(_plugin_events(e).where("name != ''")), "events", "name")


def hooks_by_event(e) -> DataFrame:
    rows = b.event(e, "hook").withColumn("hook_event", label(dim(e, "hook_event"), fx.NONE_LABEL))

    def summed(key: str) -> Column:
        return total_of(number(rows, key))

    grouped = rows.groupBy("hook_event").agg(
        F.count("*").alias("executions"),
        summed("num_hooks").alias("hooks"),
        summed("num_success").alias("success"),
        summed("num_blocking").alias("blocking"),
        summed("num_cancelled").alias("cancelled"),
        summed("num_non_blocking_error").alias("errors"),
        b.average(rows, "total_duration_ms").alias("avg_ms"),
    )
    return descending(grouped, "executions", "hook_event")


def hooks_by_source(e):
    return b.count_by(b.event(e, "hook"), dim(e, "hook_source"), "source", "count", fx.NONE_LABEL)


def _connections(e) -> DataFrame:
    return b.event(e, "mcp_server_connection")


def mcp_totals(e) -> DataFrame:
    rows = _connections(e)
    return rows.agg(
        F.count("*").alias("connections"),
        b.average(rows, "duration_ms").alias("avg_connect_ms"),
        count_if(dim(rows, "is_plugin") == "true").alias("plugin_provided"),
    )


def mcp_by_transport(e):
    return b.count_by(_connections(e), dim(e, "transport_type"), "transport", "count", fx.NONE_LABEL)


def mcp_connected_servers(e) -> DataFrame:
    rows = _connections(e).withColumn("server", dim(e, "server_name")).where("server != ''")
    grouped = rows.groupBy("server").agg(
        F.count("*").alias("connections"), b.average(rows, "duration_ms").alias("avg_connect_ms")
    )
    return top_n(grouped, "connections", "server", 20)


def mcp_tool_calls(e) -> DataFrame:
    return b.tool_usage(e, key="mcp_server", key_name="server", uses="calls")


def cap_skills(e):
    return b.count_by(b.event(e, "skill_activated"), dim(e, "skill.name"), "name", "count", n=20)


def cap_session_starts(m):
    return b.session_starts(m)


def _switches(e) -> DataFrame:
    return b.event(e, "permission_mode_changed")


def autonomy_total(e):
    return _switches(e).agg(F.count("*").alias("total"))


def autonomy_by_mode(e):
    return b.count_by(_switches(e), dim(e, "to_mode"), "mode", "count", fx.NONE_LABEL)


def autonomy_transitions(e) -> DataFrame:
    rows = _switches(e)
    grouped = rows.groupBy(
        dim(rows, "from_mode").alias("from_mode"), dim(rows, "to_mode").alias("to_mode")
    ).agg(F.count("*").alias("count"))
    labelled = grouped.withColumns({c: label(F.col(c), fx.NONE_LABEL) for c in ("from_mode", "to_mode")})
    return descending(labelled, "count", "from_mode", "to_mode")


def autonomy_by_trigger(e):
    return b.count_by(_switches(e), dim(e, "trigger"), "trigger", "count", fx.NONE_LABEL)


def capabilities(m, e) -> dict[str, DataFrame]:
    return {
        "plugins": plugins(e),
        "hooks": hooks_by_event(e),
        "hooks_by_source": hooks_by_source(e),
        "mcp": mcp_totals(e),
        "mcp_by_transport": mcp_by_transport(e),
        "mcp_connected_servers": mcp_connected_servers(e),
        "mcp_servers": mcp_tool_calls(e),
        "skills": cap_skills(e),
        "session_starts": cap_session_starts(m),
        "autonomy_total": autonomy_total(e),
        "autonomy_by_mode": autonomy_by_mode(e),
        "autonomy_transitions": autonomy_transitions(e),
        "autonomy_by_trigger": autonomy_by_trigger(e),
    }


def _of_plugin(e, name: str) -> DataFrame:
    return _plugin_events(e).where(F.col("name") == F.lit(name))


def plugin_info(e, name: str) -> DataFrame:
    """One row of facts about a plugin; no row when it was not seen."""
    return _plugin_facts(_of_plugin(e, name))


def plugin_versions(e, name):
    rows = _of_plugin(e, name)
    return b.count_by(rows, dim(rows, "plugin.version"), "version", "count")


def plugin_users(e, name):
    return b.users_by(_of_plugin(e, name), "events", 20)


def plugin_by_day(e, name):
    grouped = _of_plugin(e, name).groupBy("event_date").agg(F.count("*").alias("events"))
    return grouped.orderBy("event_date").select(day_text(F.col("event_date")).alias("day"), "events")


def plugin_detail(e, name: str) -> dict[str, DataFrame]:
    return {
        "info": plugin_info(e, name),
        "versions": plugin_versions(e, name),
        "users": plugin_users(e, name),
        "by_day": plugin_by_day(e, name),
    }
