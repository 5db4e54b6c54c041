"""Team blocks. Facts are reduced per user and session before they meet the membership."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usagelake import fixed_values as fx
from usagelake.functions.maps import count_if, dim, label, number, rate, sum_if, total_of, zero
from usagelake.operators.relational import descending, merge_full_outer, team_join, top_n
from usagelake.plans import blocks as b


def _session_totals(m) -> DataFrame:
    name = F.col("name")
    return b.per_session(m, {"cost": name == "cost.usage", "tokens": name == "token.usage"})


def teams(m, e, membership) -> DataFrame:
    """Members, cost, tokens, sessions and tool calls per team; teams with only one side still count."""
    sessions = team_join(_session_totals(m), membership)
    totals = sessions.groupBy("team").agg(
        F.count_distinct("user_hash").alias("members"),
        total_of(F.col("cost")).alias("cost"),
        total_of(F.col("tokens")).alias("tokens"),
        F.count_distinct("session_id").alias("sessions"),
    )
    per_user = b.event(e, "tool_result").groupBy("user_hash").agg(F.count("*").alias("n"))
    calls = team_join(per_user, membership).groupBy("team").agg(F.sum("n").alias("tool_calls"))
    merged = merge_full_outer(
        totals, calls, "team", {"members": 0, "cost": 0.0, "tokens": 0.0, "sessions": 0, "tool_calls": 0}
    )
    return descending(merged, "cost", "team")


def _in_team(per_user: DataFrame, membership: DataFrame, team: str) -> DataFrame:
    return team_join(per_user, membership).where(F.col("team") == F.lit(team))


def team_cost_by_day(m, membership, team):
    daily = b.metric(m, "cost.usage").groupBy("user_hash", "event_date").agg(total_of(F.col("value")).alias("value"))
    return b.sum_by_day(_in_team(daily, membership, team), "cost")


def member_totals(m, membership, team):
    """Cost, tokens and sessions of every member."""
    return _in_team(_session_totals(m), membership, team).groupBy("user_hash").agg(
        total_of(F.col("cost")).alias("cost"),
        total_of(F.col("tokens")).alias("tokens"),
        F.count("session_id").alias("sessions"),  # one row per session already
    )


def team_members(m, membership, team):
    return top_n(member_totals(m, membership, team), "cost", "user_hash", 100)


def team_models(m, membership, team):
    per_user = b.metric(m, "cost.usage").groupBy("user_hash", "model").agg(total_of(F.col("value")).alias("value"))
    grouped = _in_team(per_user, membership, team).groupBy("model").agg(total_of(F.col("value")).alias("cost"))
    return descending(grouped.withColumn("model", label(F.col("model"), fx.UNKNOWN_LABEL)), "cost", "model")


def team_tools(e, membership, team):
    rows = b.event(e, "tool_result").withColumn("tool", dim(e, "tool_name")).where("tool != ''")
    duration = number(rows, "duration_ms")
    per_user = rows.groupBy("user_hash", "tool").agg(
        F.count("*").alias("uses"),
        count_if(dim(rows, "success") == "true").alias("_ok"),
        F.sum(duration).alias("_ms"),
        F.count(duration).alias("_timed"),
    )
    grouped = (
        _in_team(per_user, membership, team)
        .groupBy("tool")
        .agg(*[F.sum(c).alias(c) for c in ("uses", "_ok", "_ms", "_timed")])
        .select(
            "tool",
            "uses",
            rate(F.col("_ok"), F.col("uses")).alias("success_rate"),
            zero(rate(F.col("_ms"), F.col("_timed"))).alias("avg_ms"),
        )
    )
    return top_n(grouped, "uses", "tool", 20)


def team_detail(m, e, membership, team: str) -> dict[str, DataFrame]:
    return {
        "cost_by_day": team_cost_by_day(m, membership, team),
        "members": team_members(m, membership, team),
        "models": team_models(m, membership, team),
        "tools": team_tools(e, membership, team),
    }


