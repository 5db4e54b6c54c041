"""Per-user and per-model blocks and the cost trend."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usagelake import fixed_values as fx
from usagelake.functions.maps import attribute, day_text, label, sum_if, total_of
from usagelake.functions.text import ns_text
from usagelake.operators.relational import merge_full_outer, top_n
from usagelake.plans import blocks as b


def people(m, e) -> DataFrame:
    """Users by cost: metric totals merged with tool calls; users with only one side still count."""
    value, name = F.col("value"), F.col("name")
    totals = m.groupBy("user_hash").agg(
        sum_if(value, name == "cost.usage").alias("cost"),
        sum_if(value, name == "token.usage").alias("tokens"),
        sum_if(value, (name == "lines_of_code.count") & (F.col("subtype") == "added")).alias("lines_added"),
        F.count_distinct("session_id").alias("sessions"),
        F.max("ts_ns").alias("_seen"),
    )
    totals = totals.withColumn("last_active", ns_text(F.col("_seen"))).drop("_seen")
    calls = b.event(e, "tool_result").groupBy("user_hash").agg(F.count("*").alias("tool_calls"))
    merged = merge_full_outer(
        totals,
        calls,
        "user_hash",
        {"cost": 0.0, "tokens": 0.0, "lines_added": 0.0, "sessions": 0, "last_active": "", "tool_calls": 0},
    )
    return top_n(merged, "cost", "user_hash", 500)


def of_user(rows: DataFrame, user: str) -> DataFrame:
    return rows.where(F.col("user_hash") == F.lit(user))


def person_cost_by_day(m, user):
    return b.sum_by_day(b.metric(of_user(m, user), "cost.usage"), "cost")


def person_tokens(m, user):
    rows = b.metric(of_user(m, user), "token.usage")
    return b.sum_by(rows, F.col("subtype"), "token_type", "tokens", fx.NONE_LABEL)


def person_models(m, user):
    rows = b.metric(of_user(m, user), "cost.usage")
    return b.sum_by(rows, F.col("model"), "model", "cost", fx.UNKNOWN_LABEL)


def person_sessions(m, user):
    return of_user(m, user).agg(F.count_distinct("session_id").alias("sessions"))


def person_lines(m, user):
    rows = b.metric(of_user(m, user), "lines_of_code.count")
    return b.sum_by(rows, F.col("subtype"), "subtype", "lines", fx.NONE_LABEL)


def person_tools(e, user):
    return b.tool_usage(of_user(e, user))


def person_activity_by_hour(e, user):
    return b.hourly_activity(of_user(e, user))


def person_detail(m, e, user: str) -> dict[str, DataFrame]:
    return {
        "cost_by_day": person_cost_by_day(m, user),
        "tokens": person_tokens(m, user),
        "models": person_models(m, user),
        "sessions": person_sessions(m, user),
        "lines_of_code": person_lines(m, user),
        "tools": person_tools(e, user),
        "activity_by_hour": person_activity_by_hour(e, user),
    }


def _of_model(m, model: str, name: str = "cost.usage") -> DataFrame:
    return b.metric(m, name).where(F.col("model") == F.lit(model))


def model_cost_by_day(m, model):
    return b.sum_by_day(_of_model(m, model), "cost")


def model_tokens(m, model):
    rows = _of_model(m, model, "token.usage")
    return b.sum_by(rows, F.col("subtype"), "token_type", "tokens", fx.NONE_LABEL)


def model_top_users(m, model):
    grouped = _of_model(m, model).groupBy("user_hash").agg(total_of(F.col("value")).alias("cost"))
    return top_n(grouped, "cost", "user_hash", 10)


def model_cost_by_source(m, model):
    return b.sum_by(_of_model(m, model), F.col("query_source"), "source", "cost", fx.MAIN_LABEL)


def model_cost_by_effort(m, model):
    return b.sum_by(_of_model(m, model), attribute(m, "effort"), "effort", "cost", fx.NONE_LABEL)


def model_detail(m, model: str) -> dict[str, DataFrame]:
    return {
        "cost_by_day": model_cost_by_day(m, model),
        "tokens_by_type": model_tokens(m, model),
        "top_users": model_top_users(m, model),
        "cost_by_source": model_cost_by_source(m, model),
        "cost_by_effort": model_cost_by_effort(m, model),
    }


def cost_trend(m) -> DataFrame:
    """Cost per day and model, in no order."""
    grouped = b.metric(m, "cost.usage").groupBy("event_date", "model").agg(total_of(F.col("value")).alias("cost"))
    return grouped.select("event_date", label(F.col("model"), fx.UNKNOWN_LABEL).alias("model"), "cost", F.col("model").alias("_model"))


def cost_timeseries(m) -> DataFrame:
    return cost_trend(m).orderBy("event_date", "_model").select(day_text(F.col("event_date")).alias("day"), "model", "cost")
