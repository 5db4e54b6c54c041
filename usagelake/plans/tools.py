"""Tool and agent blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usagelake.functions.maps import count_if, day_text, dim, number, rate, total_of, zero
from usagelake.operators.quantile import exact_quantiles
from usagelake.operators.relational import beside, merge_full_outer, merge_left, top_n, with_latest
from usagelake.plans import blocks as b
from usagelake.plans.overview import agent_tokens


TOOLS = 500  # rows of the tool list


def tool_results(e) -> DataFrame:
    return b.event(e, "tool_result").withColumn("tool", dim(e, "tool_name")).where("tool != ''")


def _decisions_by_tool(e) -> DataFrame:
    decided = b.event(e, "tool_decision").withColumn("tool", dim(e, "tool_name")).where("tool != ''")
    return decided.groupBy("tool").agg(*b.decisions(decided))


def tool_facts(e) -> DataFrame:
    """Uses, successes, server and decisions of every tool, in no order and without a list's cut."""
    rows = tool_results(e)
    usage = with_latest(
        rows,
        ["tool"],
        {"mcp_server": dim(rows, "mcp_server")},
        {"_uses": F.count("*"), "_ok": b.successes(rows)},
        {"uses": F.sum("_uses"), "ok": F.sum("_ok")},
    )
    missing = {"mcp_server": "", "uses": 0, "ok": 0, "accept": 0, "reject": 0, "block": 0}
    return merge_full_outer(usage, _decisions_by_tool(e), "tool", missing)


def tools_list(e) -> DataFrame:
    """Usage, latency and users per tool merged with its approval decisions."""
    rows = tool_results(e)
    timing = number(rows, "duration_ms")
    usage = with_latest(
        rows,
        ["tool"],
        {"mcp_server": dim(rows, "mcp_server")},
        {"_uses": F.count("*"), "_ok": b.successes(rows), "_ms": F.sum(timing), "_timed": F.count(timing)},
        {
            "uses": F.sum("_uses"),
            "success_rate": rate(F.sum("_ok"), F.sum("_uses")),
            "avg_ms": zero(rate(F.sum("_ms"), F.sum("_timed"))),
        },
    )
    users = rows.groupBy("tool", "user_hash").agg(F.count("*").alias("_n")).groupBy("tool").agg(F.count("user_hash").alias("users"))
    top = top_n(usage, "uses", "tool", TOOLS)
    timed = rows.select("tool", number(rows, "duration_ms").alias("_ms"))
    of_top = timed.join(F.broadcast(top.select("tool")), "tool", "left_semi")  # TOOLS rows at most
    slow = exact_quantiles(of_top, ["tool"], "_ms", {"p95_ms": 0.95}, most_groups=TOOLS)
    busiest = merge_left(top, users, "tool", {"users": 0})
    merged = merge_full_outer(
        merge_left(busiest, slow, "tool", {"p95_ms": 0.0}),
        _decisions_by_tool(e),
        "tool",
        {
            "mcp_server": "", "uses": 0, "success_rate": 0.0, "avg_ms": 0.0, "users": 0, "p95_ms": 0.0,
            "accept": 0, "reject": 0, "block": 0,
        },
    )
    return top_n(merged, "uses", "tool", TOOLS)


def _of_tool(e, tool: str, kind: str = "tool_result") -> DataFrame:
    return b.event(e, kind).where(dim(e, "tool_name") == F.lit(tool))


def tool_uses_by_day(e, tool):
    rows = _of_tool(e, tool)
    grouped = rows.groupBy("event_date").agg(
        F.count("*").alias("uses"), rate(b.successes(rows), F.count("*")).alias("success_rate")
    )
    return grouped.orderBy("event_date").select(
        day_text(F.col("event_date")).alias("day"), "uses", "success_rate"
    )


def tool_latency(e, tool):
    rows = _of_tool(e, tool)
    timed = rows.select(number(rows, "duration_ms").alias("_ms"))
    both = beside(timed.agg(F.avg("_ms").alias("avg_ms")), exact_quantiles(timed, [], "_ms", {"p95_ms": 0.95}))
    return both.select(zero(F.col("avg_ms")).alias("avg_ms"), zero(F.col("p95_ms")).alias("p95_ms"))


def tool_decisions(e, tool):
    rows = _of_tool(e, tool, "tool_decision")
    return rows.agg(*b.decisions(rows))


def tool_top_users(e, tool):
    return b.users_by(_of_tool(e, tool), "uses", 10)


def tool_detail(e, tool: str) -> dict[str, DataFrame]:
    return {
        "uses_by_day": tool_uses_by_day(e, tool),
        "latency": tool_latency(e, tool),
        "decisions": tool_decisions(e, tool),
        "top_users": tool_top_users(e, tool),
    }


def agents_list(e) -> DataFrame:
    rows = b.event(e, "subagent").withColumn("agent_type", dim(e, "agent_type")).where("agent_type != ''")
    grouped = rows.groupBy("agent_type").agg(
        F.count("*").alias("uses"),
        total_of(number(rows, "total_tokens")).alias("tokens"),
        total_of(number(rows, "total_tool_uses")).alias("tool_uses"),
        F.count_distinct("user_hash").alias("users"),
        b.average(rows, "duration_ms").alias("avg_duration_ms"),
    )
    return top_n(grouped, "uses", "agent_type", 200)


def agents_by_name(m, e) -> DataFrame:
    """Agents by the name events carry, with the tokens the metrics attribute to them."""
    rows = e.withColumn("agent_type", dim(e, "agent.name")).where("agent_type != ''")
    uses = rows.groupBy("agent_type").agg(
        F.count("*").alias("uses"), F.count_distinct("user_hash").alias("users")
    )
    merged = merge_left(top_n(uses, "uses", "agent_type", 200), agent_tokens(m), "agent_type", {"tokens": 0.0})
    return merged.withColumn("tool_uses", F.lit(0).cast("bigint"))


def _of_agent(e, agent: str) -> DataFrame:
    return b.event(e, "subagent").where(dim(e, "agent_type") == F.lit(agent))


def agent_uses_by_day(e, agent):
    rows = _of_agent(e, agent)
    grouped = rows.groupBy("event_date").agg(
        F.count("*").alias("uses"), total_of(number(rows, "total_tokens")).alias("tokens")
    )
    return grouped.orderBy("event_date").select(day_text(F.col("event_date")).alias("day"), "uses", "tokens")


def agent_top_users(e, agent):
    return b.users_by(_of_agent(e, agent), "uses", 10)


def agent_detail(e, agent: str) -> dict[str, DataFrame]:
    return {"uses_by_day": agent_uses_by_day(e, agent), "top_users": agent_top_users(e, agent)}


def friction(e) -> DataFrame:
    """Tools by the share of calls rejected or blocked, worst first."""
    rows = b.event(e, "tool_decision").withColumn("tool", dim(e, "tool_name")).where("tool != ''")
    decision = F.col("decision")
    grouped = rows.groupBy("tool").agg(
        F.count("*").alias("total"),
        count_if(decision == "reject").alias("rejects"),
        count_if(decision == "block").alias("blocks"),
    )
    rated = grouped.withColumn("friction_rate", rate(F.col("rejects") + F.col("blocks"), F.col("total")))
    return top_n(rated, "friction_rate", "tool", 20)
