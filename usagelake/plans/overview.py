"""Organization discovery and the overview blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usagelake import fixed_values as fx
from usagelake.functions.maps import attribute, count_if, dim, sum_if, total_of
from usagelake.functions.text import ns_text
from usagelake.operators.relational import merge_left, top_n, union_all
from usagelake.plans import blocks as b


def orgs(metrics_bronze: DataFrame, events_bronze: DataFrame) -> DataFrame:
    """Row counts and newest time per organization over every delivery, replays included."""

    def per_org(rows: DataFrame) -> DataFrame:
        return rows.groupBy("org_id").agg(F.count("*").alias("n"), F.max("ts_ns").alias("seen"))

    both = union_all(per_org(metrics_bronze), per_org(events_bronze))
    merged = both.groupBy("org_id").agg(F.sum("n").alias("rows"), F.max("seen").alias("seen"))
    return merged.orderBy(F.col("seen").desc(), "org_id").select(
        "org_id", "rows", ns_text(F.col("seen")).alias("last_seen")
    )


def cost_by_model(m):
    return b.sum_by(b.metric(m, "cost.usage"), F.col("model"), "model", "cost", fx.UNKNOWN_LABEL)


def cost_by_day(m):
    return b.sum_by_day(b.metric(m, "cost.usage"), "cost")


def cost_by_source(m):
    return b.sum_by(b.metric(m, "cost.usage"), F.col("query_source"), "source", "cost", fx.MAIN_LABEL)


def tokens_by_type(m):
    return b.sum_by(b.metric(m, "token.usage"), F.col("subtype"), "token_type", "tokens", fx.NONE_LABEL)


def adoption(m):
    return b.distinct_counts(m, [], {"active_users": "user_hash", "sessions": "session_id"})


def edit_decisions(m):
    value, decision = F.col("value"), F.col("decision")
    return b.metric(m, "code_edit_tool.decision").agg(
        sum_if(value, decision == "accept").alias("accept"), sum_if(value, decision == "reject").alias("reject")
    )


def api_totals(e):
    kind = F.col("event_type")
    return e.where(kind.isin("api_request", "api_error")).agg(
        count_if(kind == "api_request").alias("api_requests"), count_if(kind == "api_error").alias("api_errors")
    )


def lines_of_code(m):
    return b.sum_by(b.metric(m, "lines_of_code.count"), F.col("subtype"), "subtype", "lines", fx.NONE_LABEL)


def commits(m):
    return b.total(b.metric(m, "commit.count"), "commits")


def pull_requests(m):
    return b.total(b.metric(m, "pull_request.count"), "pull_requests")


def active_time(m):
    return b.sum_by(b.metric(m, "active_time.total"), F.col("subtype"), "subtype", "seconds", fx.NONE_LABEL)


def sessions_by_start(m):
    return b.session_starts(m)


def tools_top(e):
    return b.tool_usage(e)


def tool_decisions_top(e):
    rows = b.event(e, "tool_decision").withColumn("tool", dim(e, "tool_name")).where("tool != ''")
    grouped = rows.groupBy("tool").agg(*b.decisions(rows))
    ranked = grouped.withColumn("_all", F.col("accept") + F.col("reject") + F.col("block"))
    return top_n(ranked, "_all", "tool", 20).drop("_all")


def agent_uses(e):
    """Events of any kind per agent name."""
    return b.count_by(e, dim(e, "agent.name"), "agent_type", "uses", n=20)


def agent_tokens(m):
    named = b.metric(m, "token.usage").withColumn("agent_type", attribute(m, "agent.name"))
    return named.where("agent_type != ''").groupBy("agent_type").agg(total_of(F.col("value")).alias("tokens"))


def subagents(m, e):
    return merge_left(agent_uses(e), agent_tokens(m), "agent_type", {"tokens": 0.0})


def cost_by_effort(m):
    return b.sum_by(b.metric(m, "cost.usage"), attribute(m, "effort"), "effort", "cost", fx.NONE_LABEL)


def cost_by_user_top(m):
    grouped = b.metric(m, "cost.usage").groupBy("user_hash").agg(total_of(F.col("value")).alias("cost"))
    return top_n(grouped, "cost", "user_hash", 10)


def activity_by_hour(e):
    return b.hourly_activity(e)


def skills_top(e):
    rows = b.event(e, "skill_activated")
    return b.count_by(rows, dim(e, "skill.name"), "name", "count", n=20)


def mcp_connected_top(e):
    rows = b.event(e, "mcp_server_connection")
    return b.count_by(rows, dim(e, "server_name"), "name", "count", n=20)


def plugins_top(e):
    return b.count_by(b.event(e, "plugin"), dim(e, "plugin.name"), "name", "count", n=20)


METRIC_BLOCKS = {
    "cost_by_model": cost_by_model,
    "cost_by_day": cost_by_day,
    "cost_by_source": cost_by_source,
    "tokens_by_type": tokens_by_type,
    "adoption": adoption,
    "edit_decisions": edit_decisions,
    "lines_of_code": lines_of_code,
    "commits": commits,
    "pull_requests": pull_requests,
    "active_time": active_time,
    "sessions_by_start": sessions_by_start,
    "cost_by_effort": cost_by_effort,
    "cost_by_user_top": cost_by_user_top,
}
EVENT_BLOCKS = {
    "api_totals": api_totals,
    "tools_top": tools_top,
    "tool_decisions_top": tool_decisions_top,
    "activity_by_hour": activity_by_hour,
    "skills_top": skills_top,
    "mcp_connected_top": mcp_connected_top,
    "plugins_top": plugins_top,
}


def summary(m, e) -> dict[str, DataFrame]:
    """All overview blocks of one organization and range."""
    return {
        **{name: block(m) for name, block in METRIC_BLOCKS.items()},
        **{name: block(e) for name, block in EVENT_BLOCKS.items()},
        "subagents": subagents(m, e),
    }


def metric_breakdowns(m) -> DataFrame:
    """Every metric sum of the overview in one scan: (block, key, value).

    One aggregate over all groupings instead of one scan per block. Each metric
    row expands only into the groupings its name takes part in, and partial sums
    shrink them before the shuffle.
    """
    subtype = F.col("subtype")
    day = F.date_format("event_date", "yyyy-MM-dd")
    cost_keys = {
        "cost_by_model": F.col("model"),
        "cost_by_day": day,
        "cost_by_source": F.col("query_source"),
        "cost_by_effort": attribute(m, "effort"),
    }
    keys_of = {
        "cost.usage": cost_keys,
        "token.usage": {"tokens_by_type": subtype},
        "lines_of_code.count": {"lines_of_code": subtype},
        "active_time.total": {"active_time": subtype},
        "session.count": {"sessions_by_start": b.start_type(m)},
        "commit.count": {"commits": F.lit("")},
        "pull_request.count": {"pull_requests": F.lit("")},
        "code_edit_tool.decision": {"edit_decisions": F.col("decision")},
    }
    missing = {
        "cost_by_model": fx.UNKNOWN_LABEL,
        "cost_by_source": fx.MAIN_LABEL,
        "cost_by_effort": fx.NONE_LABEL,
        "tokens_by_type": fx.NONE_LABEL,
        "lines_of_code": fx.NONE_LABEL,
        "active_time": fx.NONE_LABEL,
        "sessions_by_start": fx.NONE_LABEL,
    }
    summed = _grouped_at_once(m, "name", keys_of, total_of(F.col("value")).alias("value"), "value")
    return _labelled(summed, missing)


def event_breakdowns(e) -> DataFrame:
    """Every event count of the reports in one scan: (block, key, count). Top lists leave out the key ''."""
    keys_of = {
        "skill_activated": {"skills": dim(e, "skill.name")},
        "plugin": {"plugins": dim(e, "plugin.name")},
        "mcp_server_connection": {
            "mcp_servers": dim(e, "server_name"),
            "mcp_by_transport": dim(e, "transport_type"),
        },
        "hook": {"hooks_by_source": dim(e, "hook_source")},
        "permission_mode_changed": {
            "autonomy_by_mode": dim(e, "to_mode"),
            "autonomy_by_trigger": dim(e, "trigger"),
        },
        "tool_result": {"decision_sources": dim(e, "decision_source")},
        "api_error": {"errors_by_model": F.col("model")},
        "api_refusal": {"refusals_by_model": F.col("model")},
    }
    missing = {
        "mcp_by_transport": fx.NONE_LABEL,
        "hooks_by_source": fx.NONE_LABEL,
        "autonomy_by_mode": fx.NONE_LABEL,
        "autonomy_by_trigger": fx.NONE_LABEL,
        "decision_sources": fx.UNKNOWN_LABEL,
        "errors_by_model": fx.UNKNOWN_LABEL,
        "refusals_by_model": fx.UNKNOWN_LABEL,
    }
    counted = _grouped_at_once(e, "event_type", keys_of, F.count("*").alias("count"))
    return _labelled(counted, missing).where("key <> ''")


def _grouped_at_once(rows: DataFrame, kind: str, keys_of: dict, aggregate, *values: str) -> DataFrame:
    """Aggregate per (block, key); a row takes part in the blocks of its kind only."""
    groupings = None
    for name, keys in keys_of.items():
        parts = F.array(*[F.struct(F.lit(k).alias("block"), v.alias("key")) for k, v in keys.items()])
        is_kind = F.col(kind) == name
        groupings = F.when(is_kind, parts) if groupings is None else groupings.when(is_kind, parts)
    return (
        rows.select(F.explode(groupings).alias("g"), *values)
        .groupBy(F.col("g.block").alias("block"), F.col("g.key").alias("key"))
        .agg(aggregate)
    )


def _labelled(grouped: DataFrame, missing: dict[str, str]) -> DataFrame:
    labels = F.create_map(*[F.lit(x) for pair in missing.items() for x in pair])
    key = F.col("key")
    shown = F.when(key == "", F.coalesce(F.try_element_at(labels, F.col("block")), F.lit(""))).otherwise(key)
    return grouped.withColumn("key", shown)
